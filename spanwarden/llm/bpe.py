"""BPE encoding and decoding with word ends, for vocabularies in the tokenizers library's file format.

A word's symbols form a doubly linked list; a priority queue holds the adjacent pairs that have a
merge, by rank and then position. Popping an entry whose symbols have changed since skips it as stale.
Decoding concatenates the ids' vocabulary strings with the blank that the file's missing decoder asks for.

Which characters are letters and numbers differs between Unicode tables, so the driver asks the library
about every code point once and ships the answer. Texts with code points that Python's tables don't know
are normalised by the library.

Defined results: null and empty texts, and texts of white space, have no tokens and an empty decoded text;
texts of any length are read whole. A null id stays null, repeated rows and ids each give a row, and an
empty table gives an empty result. Strings of special tokens inside a text are those tokens, as the library
takes them by default. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import once, per_batch, texts, tune

#: Words and chunks that each half of a worker's memory holds.
REMEMBERED = 350_000
#: White space as the library takes it, inside a character class.
_BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_BLANKS}]+")
#: Blanks that str.split() leaves or takes beyond the class above.
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself where printable, else the next of 256 and up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges, lowest rank first and leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    alive, get = list(symbols), ranks.get
    queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    while queue:
        _, i, left, right = pop(queue)
        j = after[i]
        if j < 0 or alive[i] != left or alive[j] != right:
            continue  # stale: one of the two has merged meanwhile
        alive[i], alive[j] = left + right, ""
        k = after[i] = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if (r := get((alive[i], alive[k]))) is not None:
                push(queue, (r, i, alive[i], alive[k]))
        if (h := before[i]) >= 0 and (r := get((alive[h], alive[i]))) is not None:
            push(queue, (r, h, alive[h], alive[i]))
    return [s for s in alive if s]


class Memory:
    """A bounded memo in two halves: the younger takes what is used, and replaces the older when it is full."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key: str):
        if (value := self.young.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[key] = value


def ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out, start, last = [], None, None
    for p in [*points, None]:
        if last is not None and (p is None or p != last + 1):
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = p
        start = p if start is None else start
        last = p
    return "".join(out)


def code_points(whole: bool = True) -> list[int]:
    """All code points of text; else without the planes that hold, and will hold, no letter or number of any table: 4 to 13 and private use."""
    return [*range(0xD800), *range(0xE000, sys.maxunicode + 1)] if whole else [*range(0xD800), *range(0xF900, 0x40000)]


def classes(file: str) -> dict[str, str]:
    """Character classes: letters and numbers as the library's split pattern takes them."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(file).pre_tokenizer
    letters, numbers, points = [], [], code_points(False)
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]

        def inside(mark: str) -> tuple[set[int], set[int]]:
            """Which of the part's characters lie within one piece with marks around, and which lie in any."""
            whole, any_piece = set(), set()
            for _, (a, b) in split.pre_tokenize_str(" ".join(mark + chr(p) + mark for p in part)):
                first, last = a // 4, (b - 1) // 4  # four characters a code point
                if first == last and b - a == 3:
                    whole.add(part[first])
                if a <= 4 * first + 1 < b:
                    any_piece.add(part[first])
            return whole, any_piece

        (letter, shown), (other, _) = inside("x"), inside("!")
        letters += sorted(letter)
        numbers += sorted(shown - letter - other)
    return {"letters": ranges(letters), "numbers": ranges(numbers)}


class WordBpe:
    """Encoder and decoder of one vocabulary file: NFC, one blank for white space, lower case, a split pattern, bytes, word ends."""

    def __init__(self, file: str, known: dict[str, str] | None = None):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, known = spec["model"], known or classes(file)
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.ranks = {(tuple(m) if isinstance(m, list) else tuple(m.split(" "))): r for r, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name, inside in (("L", known["letters"]), ("N", known["numbers"])):
            pattern = pattern.replace(rf"[\p{{{name}}}]", f"[{inside}]").replace(rf"\p{{{name}}}", inside)
        self.words = re.compile(pattern.replace(r"\s", _BLANKS))
        self.only_letters = re.compile(f"[{known['letters']}]+")
        self.assigned: set[str] = set()  # characters met that Python's tables know
        self.library = Tokenizer.from_file(file).normalizer
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = byte_letters()
        self.word_ids, self.chunks = Memory(), Memory()

    def word(self, word: str) -> list[int]:
        if (ids := self.word_ids.get(word)) is None:
            symbols = [self.letters[b] for b in word.encode()]
            symbols[-1] += self.end
            ids = [self.vocab[s] for s in merged(symbols, self.ranks) if s in self.vocab]
            self.word_ids.put(word, ids)
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids as little-endian 32-bit integers of normalised text without blanks."""
        if (got := self.chunks.get(chunk)) is None:
            # a chunk of letters is one word of the split pattern
            ids = self.word(chunk) if self.only_letters.fullmatch(chunk) else [i for w in self.words.findall(chunk) for i in self.word(w)]
            got = array("I", ids).tobytes()
            self.chunks.put(chunk, got)
        return got

    def known(self, text: str) -> bool:
        """Do Python's tables know all characters of a text?"""
        new = set(text) - self.assigned
        self.assigned |= {c for c in new if unicodedata.category(c) != "Cn"}
        return new <= self.assigned

    def normal(self, text: str) -> list[str]:
        """The chunks between white space, normalised."""
        if not text.isascii():
            if not self.known(text):
                return [c for c in self.library.normalize_str(text).split(" ") if c]
            text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # letter by letter: no final sigma
        return [c for c in _SPACE.split(text) if c] if _ODD_SPACE.search(text) else text.split()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        parts = [text]
        if "<|" in text:
            parts = self.specials.split(text)
        found: list[bytes] = []
        for part in parts:
            if part in self.special:
                found.append(array("I", [self.special[part]]).tobytes())
            elif part:
                chunks = self.normal(part)
                known = list(map(self.chunks.young.get, chunks))
                found += [self.chunk(c) if k is None else k for k, c in zip(known, chunks, strict=True)] if None in known else known
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The text that the library decodes from ids: its file names no decoder, so strings joined by blanks."""
        return " ".join(map(self.strings.__getitem__, array("I", ids)))


def load(file: str, known: dict[str, str] | None = None) -> WordBpe:
    return once(("bpe", file), lambda: WordBpe(file, known))


def encoded(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers), n_tokens and decoded text of every row of docs (doc_id, text)."""
    return _apply(docs, file, False)


def digests(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text of every row of docs (doc_id, text)."""
    return _apply(docs, file, True)


def _apply(docs: DataFrame, file: str, digest: bool) -> DataFrame:
    tune(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(classes(file))  # some tens of kilobytes

    def work(batch: pa.RecordBatch, bpe: WordBpe):
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        out = {"doc_id": batch.column(0), "n_tokens": [len(b) // 4 for b in ids]}
        if digest:
            return out | {"ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids], "decoded_sha256": [hashlib.sha256(bpe.decode(b).encode()).hexdigest() for b in ids]}
        return out | {"ids": ids, "decoded": list(map(bpe.decode, ids))}

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string")
    docs = docs.withColumn("doc_id", docs["doc_id"].cast("long"))
    return per_batch(texts(docs, "doc_id", "text"), schema, work, lambda: (load(file, known.value),))

"""Token counts of whole texts for a sentencepiece BPE model, with a whole-token shortcut.

No piece of such a model has a space mark behind another character, and none has a line feed: a text
splits exactly before runs of space marks and around line feeds into pre-tokens that encode alone. The
vocabulary strings that encode as one token are proved offline, once a worker, by encoding each; texts
count these pre-tokens directly and only the rest are merged, once each, by the library.

Defined results: null and empty texts have 0 tokens and 0 bytes; blank texts have the tokens of their
blanks. Texts of any length are counted whole. A null id stays null, repeated rows and ids each give a
row, and an empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import once, per_batch, texts, tune

OVER = 4096
#: Pre-tokens that a worker remembers besides the proven ones; at the bound it starts anew.
REMEMBERED = 500_000
MARK = "▁"
_RUNS = regex.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+")


class PieceCounts:
    """Tokens of each pre-token: `spaced` holds words after one space, `plain` others as they stand."""

    def __init__(self, model: str, proven: tuple[list[str], list[str]] | None = None):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.proven = [dict.fromkeys(words, 1) for words in proven or self.prove()]
        self.spaced, self.plain = map(dict, self.proven)

    def prove(self) -> tuple[list[str], list[str]]:
        """The vocabulary strings that encode alone as one token, after one space and as they stand."""
        if self.lib.normalize("  ﬁ ①\tA") != f"{MARK * 3}ﬁ{MARK}①\tA":
            raise ValueError("the model's normaliser changes text; pre-tokens can't be told apart")
        ids = [i for i in range(self.lib.get_piece_size()) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i))]
        pieces = [self.lib.id_to_piece(i) for i in ids]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a word's start or a line's end")
        words = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and p[1] != MARK]
        rest = [p.replace(MARK, " ") for p in pieces if p[0] != MARK or p.startswith(MARK * 2) or p == MARK]
        return tuple([w for w, n in zip(x, measure(x), strict=True) if n == 1] for x, measure in ((words, self.of_words), (rest, self.of_others)))

    def of_words(self, words: list[str]) -> list[int]:
        """Tokens of words after one space: the library puts this space before a text."""
        return list(map(len, self.lib.encode(words, num_threads=1)))

    def of_others(self, tokens: list[str]) -> list[int]:
        """Tokens of pre-tokens as they stand: a line feed, a token of its own as byte, parts them from the library's space."""
        return [len(f) - 2 for f in self.lib.encode(["\n" + t for t in tokens], num_threads=1)]

    def learn(self, spaced: set[str], plain: set[str]) -> None:
        if len(self.spaced) + len(self.plain) + len(spaced) + len(plain) > REMEMBERED + sum(map(len, self.proven)):
            self.spaced, self.plain = map(dict, self.proven)
        for known, new, measure in ((self.spaced, list(spaced), self.of_words), (self.plain, list(plain), self.of_others)):
            known.update(zip(new, measure(new), strict=True))


def pre_tokens(text: str) -> tuple[list[str], list[str], int]:
    """The words of a text after one space each, its other pre-tokens, and the number of its line feeds, each one token."""
    if not text:
        return [], [], 0
    spaced: list[str] = []
    plain: list[str] = []
    lines = (" " + text).split("\n")
    for line in lines:
        if "  " in line or MARK in line or line[-1:] == " ":
            for t in _RUNS.findall(line):
                if t[0] == " " and len(t) > 1 and t[1] not in " " + MARK:
                    spaced.append(t[1:])
                else:
                    plain.append(t)
        elif line:
            words = line.split(" ")
            if words[0]:
                plain.append(words[0])
            spaced += words[1:]
    return spaced, plain, len(lines) - 1


def counts(model: str, proven: tuple[list[str], list[str]] | None = None) -> PieceCounts:
    return once(("pieces", model), lambda: PieceCounts(model, proven))


def count_batch(bodies: list[str | None], known: PieceCounts) -> list[int]:
    """Tokens of each text: pre-tokens that are known count at once, the rest of some texts are merged together."""
    out = []
    for at in range(0, len(bodies), 256):
        missed = []
        for text in bodies[at : at + 256]:
            spaced, plain, n = pre_tokens(text or "")
            rest = []
            for tokens, have in ((spaced, known.spaced), (plain, known.plain)):
                found = list(map(have.get, tokens, repeat(0)))
                n += sum(found)
                rest.append([t for t, k in zip(tokens, found, strict=True) if not k] if 0 in found else [])
            out.append(n)
            missed.append(rest)
        known.learn(*(set().union(*(m[i] for m in missed)) for i in (0, 1)))
        for i, (spaced, plain) in enumerate(missed, at):
            out[i] += sum(map(known.spaced.__getitem__, spaced)) + sum(map(known.plain.__getitem__, plain))
    return out


def token_counts(docs: DataFrame, model: str, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text). model: the file's path on every machine."""
    tune(docs.sparkSession)
    proven = docs.sparkSession.sparkContext.broadcast(PieceCounts(model).prove())  # bounded by the vocabulary

    def work(batch: pa.RecordBatch, known: PieceCounts):
        bodies = batch.column(1).to_pylist()
        n = count_batch(bodies, known)
        return {"doc_id": batch.column(0), "n_bytes": [len((t or "").encode()) for t in bodies], "n_tokens": n, "over_limit": [x > over for x in n]}

    docs = docs.withColumn("doc_id", docs["doc_id"].cast("long"))
    return per_batch(texts(docs, "doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", work, lambda: (counts(model, proven.value),))

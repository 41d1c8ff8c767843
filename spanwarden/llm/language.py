"""Language of texts by cross-parsing: the language whose labelled text needs the fewest normalised phrases wins.

A text is parsed greedily from left to right into phrases, each the longest match that occurs anywhere in a
language's sample. A suffix automaton of the sample gives the matches: a text walks its states, and where no
transition is left, a phrase ends and the next one starts at the root. A phrase names a place in a sample of N
bytes, so it costs log2(N + 1) bits; the costs of all languages are those of one code each for the text, and the
score is the share that the winner has of 2 ** -bits. Samples of different sizes compare by this norm.

Texts are read as lower-case UTF-8 bytes, ASCII other than letters as one blank. Many texts walk an automaton in
step, as numpy columns: a text of over SEGMENT bytes is parsed in segments, and a phrase ends with its segment.

The model is fitted on a bounded sample: at most SAMPLE_TEXTS different labelled texts a language in the order of
their hash, at most SLICE characters of each from a place that the hash gives, without lines that several languages
have, at most SAMPLE bytes a language and SAMPLES in all. Only rows whose crc32(doc_id) mod 4 is not 2, with a text and a language, are read for it; rows
of null id have no remainder and are not. Every row is predicted, from its whole text.

Defined results: null texts and texts without a letter are `und` with score 0, as are all texts if no language is
learned; texts of any length are read whole; ties go to the first language by name. A null id stays null and is
not held out, repeated rows and ids each give a row, and an empty table gives an empty result. Columns other than
doc_id, text and lang are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import once, per_batch, texts, tune

SAMPLE_TEXTS = 400
SLICE = 512
SAMPLE = 64 << 10
#: Bytes of all samples together: an automaton takes up to 2 * alphabet * 4 bytes a byte, in each worker.
SAMPLES = 512 << 10
#: Texts that walk in step are laid out in rows of so many bytes.
SEGMENT = 1024
#: Bytes of a batch that walk at once.
STRIDE = 4 << 20
UNKNOWN = "und"
#: ASCII letters in lower case and bytes beyond ASCII as they are; the rest is blank.
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def plain(text: str) -> bytes:
    """A text as the automata read it."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of each state; every substring of data, and nothing else, is a path from state 0."""
    after, link, length, last = [{}], [-1], [0], 0
    for c in data:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return after


def walk_table(after: list[dict[int, int]], symbols: dict[int, int]) -> np.ndarray:
    """state * symbols + symbol -> 4 * (next state * symbols) + the phrases that the symbol ends.

    Symbol 0 is padding, which ends the row's phrase and rests in a state of its own. A symbol that the sample lacks,
    as the last one always is, is a phrase alone.
    """
    width, states = len(symbols) + 2, len(after)
    rest = states  # after padding
    root = np.full(width, -1, np.int64)
    for c, s in after[0].items():
        root[symbols[c]] = s
    lacks = root < 0
    begun = np.where(lacks, 0, root) * 4 * width
    table = np.tile(begun + 1 + lacks, (states + 1, 1))
    for i, row in enumerate(after):
        if row:
            table[i, [symbols[c] for c in row]] = np.fromiter(row.values(), np.int64, len(row)) * 4 * width
    table[0] = begun + lacks  # no phrase ends here
    table[:, 0] = rest * 4 * width + 1
    table[0, 0] = table[rest, 0] = rest * 4 * width
    return table.reshape(-1).astype(np.int32)


class Parser:
    """Phrases of texts in each language's sample."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        seen = sorted(set(b"".join(samples.values())))
        symbols = {c: i + 1 for i, c in enumerate(seen)}
        self.width = len(seen) + 2
        self.symbols = bytes(symbols.get(b, self.width - 1) for b in range(256))  # no text has 13 of the 256 bytes
        self.tables = [walk_table(suffix_automaton(samples[n]), symbols) for n in self.names]
        self.bits = np.log2(np.array([len(samples[n]) + 1 for n in self.names]))

    def phrases(self, bodies: list[bytes]) -> np.ndarray:
        """Number of phrases of each text (rows) in each language (columns)."""
        out = np.zeros((len(bodies), len(self.names)), np.int64)
        at = 0
        while at < len(bodies):
            end, size = at, 0
            while end < len(bodies) and (end == at or size + len(bodies[end]) <= STRIDE):
                size += len(bodies[end])
                end += 1
            out[at:end] = self._phrases(bodies[at:end])
            at = end
        return out

    def _phrases(self, bodies: list[bytes]) -> np.ndarray:
        segments = np.array([-(-len(b) // SEGMENT) for b in bodies])
        owner = np.repeat(np.arange(len(bodies)), segments)
        out = np.zeros((len(bodies), len(self.names)), np.int64)
        if not len(owner):
            return out
        # texts are padded to whole segments; the longest segments stand first, so that those that end drop out
        size = np.full(len(owner), SEGMENT)
        ends = np.cumsum(segments)
        some = segments > 0
        size[ends[some] - 1] = np.array([len(b) for b in bodies])[some] - (segments[some] - 1) * SEGMENT
        data = b"".join(b.translate(self.symbols).ljust(k * SEGMENT, b"\0") for b, k in zip(bodies, segments.tolist(), strict=True))
        order = np.argsort(-size, kind="stable")
        rows = np.frombuffer(data, np.uint8).reshape(-1, SEGMENT)[order]
        columns = np.ascontiguousarray(rows.T)
        active = np.searchsorted(-size[order], -np.arange(SEGMENT), side="left")  # rows longer than each column's place
        for k, table in enumerate(self.tables):
            place = np.zeros(len(owner), np.int64)
            ended = np.zeros(len(owner), np.int64)
            for i in range(int(size.max())):
                n = active[i]
                step = table.take(place[:n] + columns[i, :n])
                ended[:n] += step & 3
                place[:n] = step >> 2
            ended += place != 0  # the last phrase of a segment
            out[:, k] = np.bincount(owner[order], ended, len(bodies))
        return out

    def predicted(self, bodies: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        lettered = [t is not None and (any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t))) for t in bodies]
        langs, scores = [UNKNOWN] * len(bodies), [0.0] * len(bodies)
        asked = [i for i, known in enumerate(lettered) if known and self.names]
        bits = self.phrases([plain(bodies[i]) for i in asked]) * self.bits
        best = bits.argmin(axis=1) if asked else []
        share = 1 / np.exp2(np.minimum(0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1) if asked else []
        for i, b, s in zip(asked, best, share, strict=True):
            langs[i], scores[i] = self.names[b], float(s)
        return langs, scores


def samples(docs: DataFrame) -> dict[str, bytes]:
    """Labelled text of each language, at most SAMPLE bytes each and SAMPLES in all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 <> 2")
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return {}
    # hashes below a language's bound: about twice the texts wanted, as copies fall together
    bound = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * SAMPLE_TEXTS / n))))
    share = (F.col("h").cast("double") / 2.0**64) + 0.5
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - SLICE, F.lit(1))).cast("int") + 1
    taken = rows.where(share <= F.element_at(bound, F.col("lang"))).select("lang", "h", F.substring("text", start, F.lit(SLICE)).alias("text"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    taken = taken.dropDuplicates(["lang", "h", "text"]).withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE_TEXTS).orderBy("lang", "k")
    lines: dict[str, dict[bytes, None]] = {}
    for r in taken.collect():
        lines.setdefault(r.lang, {}).update(dict.fromkeys(map(plain, r.text.splitlines())))
    shared = Counter(line for own in lines.values() for line in own)  # notices that stand in texts of several languages teach none
    most = min(SAMPLE, SAMPLES // len(sizes))
    found = {lang: b" ".join(x for x in own if shared[x] == 1)[:most].strip() for lang, own in lines.items()}
    return {lang: data for lang, data in found.items() if data}


def languages(docs: DataFrame, fitted: dict[str, bytes] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang). fitted: samples by language, else those of docs."""
    tune(docs.sparkSession)
    known = samples(docs) if fitted is None else fitted
    key = ("language", zlib.crc32(repr(sorted(known.items())).encode()))

    def work(batch: pa.RecordBatch, parser: Parser):
        ids = batch.column(0).to_pylist()
        lang, score = parser.predicted(batch.column(1).to_pylist())
        return {"doc_id": ids, "held_out": list(map(held_out, ids)), "lang_pred": lang, "score": score}

    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return per_batch(texts(docs, "doc_id", "text"), "doc_id long, held_out boolean, lang_pred string, score double", work, lambda: (once(key, lambda: Parser(known)),))

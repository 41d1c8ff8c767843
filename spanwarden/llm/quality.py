"""Quality rules as a short-circuit cascade.

A bounded sample gives each rule's cost and how many texts it rejects; rules then run by rejections per
cost, highest first, and a text leaves the cascade at its first rejection. The order changes the time
only: the verdict is that no rule rejects.

Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
Defined results: null, empty and blank texts have no words and fail the base; texts of any length are read
whole. A null id stays null, repeated rows and ids each give a row, rules of equal gain run by name, and an
empty table gives an empty result. Columns other than doc_id and text are not read by quality() and pass
through filtered().
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, per_batch, texts, tune
from .minhash import _P, Hashes, _mix

#: Texts of the sample that costs and selectivities come from, about.
SAMPLE = 2000
WINDOW = 8


class Text:
    """A text and what rules share, each made when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.words = text.encode().split()
        self.n_words = len(self.words)

    def __getattr__(self, name: str):
        value = self.__dict__[name] = getattr(Text, "_" + name)(self)
        return value

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, "#*$%&|<>"))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\v\f\r")]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _points(self) -> np.ndarray:
        return np.frombuffer(self.text.encode("utf-32-le"), np.uint32)

    def _upper(self) -> int:
        """Characters that lower case changes; 0 where it changes the length, which no shouting does."""
        low = self.text.lower()
        return int((np.frombuffer(low.encode("utf-32-le"), np.uint32) != self.points).sum()) if len(low) == len(self.text) else 0

    def _letters(self) -> int:
        """ASCII letters and all characters from U+00AA on."""
        p = self.points
        return int((((p | 32) - 97 < 26) | (p >= 0xAA)).sum())

    def n_repeat_words(self, hashes: Hashes) -> int:
        """Words in windows of WINDOW words that the text has twice or more."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        h = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, self.n_words)
        acc = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            acc = acc * _P + h[j : n + j]
        acc = _mix(acc)
        ordered = np.sort(acc)
        same = ordered[1:] == ordered[:-1]
        if not same.any():
            return 0
        at = np.flatnonzero(np.isin(acc, np.unique(ordered[1:][same])))
        edge = np.zeros(self.n_words + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        return int((np.cumsum(edge[:-1]) > 0).sum())


#: name: does the rule reject this text? They hold for running prose in any language with blanks between words.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 100 * t.n_symbols > 10 * t.word_chars,
    "duplicate_lines": lambda t: len(t.lines) >= 4 and 100 * t.n_dup_lines > 50 * len(t.lines),
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
    "shouting": lambda t: 2 * t.upper > t.word_chars,
    "exclamations": lambda t: 10 * t.text.count("!") > 3 * t.n_words,
    "few_letters": lambda t: 2 * t.letters < t.word_chars,
    "bars": lambda t: 4 * t.text.count("|") > t.n_words,
    "stuttering": lambda t: 100 * sum(map(bytes.__eq__, t.words[1:], t.words)) > 30 * t.n_words,
    "few_distinct_words": lambda t: t.n_words >= 50 and 20 * len(set(t.words)) < t.n_words,
}


def measured(docs: DataFrame) -> list[str]:
    """The rules, most rejections per second of the sample first; ties by name."""
    total = docs.count()
    sample = docs.select("text").sample(min(1.0, SAMPLE / max(1, total)), seed=7)

    def work(batch: pa.RecordBatch):
        out = []
        for text in batch.column(0).to_pylist():
            for name, rejects in RULES.items():
                fresh = Text(text or "")
                start = time.perf_counter_ns()
                out.append((name, bool(rejects(fresh)), time.perf_counter_ns() - start))
        return {"rule": [o[0] for o in out], "rejected": [o[1] for o in out], "ns": [o[2] for o in out]}

    rows = per_batch(sample, "rule string, rejected boolean, ns long", work).groupBy("rule").agg(F.count_if("rejected").alias("rejected"), F.sum("ns").alias("ns")).collect()
    gain = {r["rule"]: r["rejected"] / max(1, r["ns"]) for r in rows}
    return sorted(RULES, key=lambda name: (-gain.get(name, 0.0), name))


def verdict(text: Text, order: list[str]) -> str | None:
    """The first rule in this order that rejects the text."""
    return next((name for name in order if RULES[name](text)), None)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Measures and verdict of every row of docs (doc_id, text). order: of the rules; else as a sample tells."""
    tune(docs.sparkSession)
    order = order or measured(docs)

    def work(batch: pa.RecordBatch, hashes: Hashes):
        rows = []
        for body in batch.column(1).to_pylist():
            t = Text(body or "")
            repeated = t.n_repeat_words(hashes)
            failed = t.n_words < 20 or 100 * repeated > 30 * t.n_words
            rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, repeated, failed, not failed and verdict(t, order) is None))
        names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
        return {"doc_id": batch.column(0)} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return per_batch(texts(docs, "doc_id", "text"), SCHEMA, work, lambda: (once(("quality-words",), Hashes),))


def filtered(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of docs whose text the base and all rules keep, columns as they are."""
    order = order or measured(docs)
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch, hashes: Hashes):
        keep = []
        for body in batch.column(at).to_pylist():
            t = Text(body or "")
            keep.append(t.n_words >= 20 and verdict(t, order) is None and 100 * t.n_repeat_words(hashes) <= 30 * t.n_words)
        return batch.filter(pa.array(keep))

    return per_batch(docs, docs.schema, work, lambda: (once(("quality-words",), Hashes),))

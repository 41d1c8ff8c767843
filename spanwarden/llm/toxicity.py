"""Toxicity by weak supervision.

Many voters (seed words, words and stems that training labels point to, and patterns) vote on texts. A
generative label model estimates their accuracies and correlations: voters that agree within a class beyond
chance are dependent, and each set of dependent voters becomes one voter whose vote is how many
of them are there (none, one, more). Expectation maximisation then gives, without labels, every such voter's
rates in either class and the posterior labels. A vote speaks for its class as its rates tell; a voter that
is silent says nothing, for a text of another language has none of its words; that all are silent counts
once. A linear classifier over words, stems and patterns is trained on the posteriors, and gives every
text's score.

Training takes a bounded sample, SAMPLE texts of the labelled training rows in a fixed random order;
the labels there choose the names that may vote, by cross-validation how telling a name must be and when two
voters count as dependent, and fix the class balance. Correlations are those within the classes that the
posteriors tell. Every text is scored whole.

Defined results: null, empty and blank texts get the score of a text without any feature. A null id is in no
training sample and not held out; of rows that repeat an id the least text trains, of its labels the
greatest; every row is scored. Names of equal evidence rank by name. With no positive training label the
seed words alone vote. An empty table gives an empty result, and very long texts are read whole. Columns
other than doc_id, text and toxic are not read by scored() and pass through filtered().
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_batch, texts, tune

#: Labelled texts that voters and classifier are made from, at most.
SAMPLE = 20_000
THRESHOLD = 0.3
#: Votes in a class from which a correlation counts, and texts of label 1 that a voter needs in the sample.
SEEN = 5
#: What cross-validation within the training sample chooses from: share of the texts of label 1 that a voter needs, and
#: texts of label 1 to one other that have a name which votes; then the correlation from which two voters are dependent.
VOTERS, DEPENDENT = [(s, p) for s in (0.005, 0.02) for p in (4, 9, 19)], (0.5, 0.3, 0.7)
FOLDS, FOLD_ROUNDS = 4, 25
#: G² that a name needs: chance passes 1 in 10,000.
EVIDENCE = 15.1
STEMS = (4, 5, 6)
#: Seed lexicon: fixed values.
SEEDS = ("clown", "disgusting", "dumb", "fool", "garbage", "hate", "idiot", "imbecile", "jerk", "kill", "loser", "moron", "pathetic", "pig", "scum", "shut", "stupid", "trash", "ugly", "worthless")
SEED_NAMES = frozenset("=" + s for s in SEEDS)
_WORD = re.compile(r"[^\W\d_]+")
_ASCII_CAPITALS = bytes(range(65, 91))
#: Words whose features a worker remembers; at the bound it starts anew.
REMEMBERED = 300_000


def names_of(word: str) -> tuple[str, ...]:
    """Feature names of a word: itself and its stems."""
    return ("=" + word, *("^" + word[:n] for n in STEMS if len(word) > n))


def capitals(text: str) -> int:
    """Upper-case characters of the whole text."""
    if text.isascii():
        return len(text) - len(text.encode().translate(None, _ASCII_CAPITALS))
    return sum(map(str.isupper, text))


def patterns(text: str, words: set[str]) -> list[str]:
    """Features of a text besides its words."""
    out = []
    if text.count("!") >= 3:
        out.append("p!")
    if len(text) >= 40 and capitals(text) * 2 > len(text):
        out.append("pA")
    return out


def found(text: str | None) -> set[str]:
    """All feature names of a text."""
    text = text or ""
    words = set(_WORD.findall(text.lower()))
    return {f for w in words for f in names_of(w)} | set(patterns(text, words))


def held_out(ids):
    """A column: is this row outside the training rows?"""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the training sample."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__id IS NOT NULL AND __toxic IS NOT NULL")
    chosen = chosen.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__toxic").alias("__toxic")).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
    rows = docs.select(docs["doc_id"].cast("long").alias("__doc"), "text").join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    return rows.groupBy("__id").agg(F.min("text").alias("text"), F.max("__toxic").alias("toxic")).select("text", "toxic")


def likelihood_ratio(yes, no, n1: int, n0: int):
    """G² of a name's presence against the label, a column of counts."""
    share = (yes + no) / F.lit(float(n1 + n0))

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    return 2 * (term(yes, share * n1) + term(no, share * n0) + term(n1 - yes, (1 - share) * n1) + term(n0 - no, (1 - share) * n0))


def candidates(rows: DataFrame) -> list[tuple[str, int, int]]:
    """The names that tell about the labels, most telling first, with positive and other texts that have each. The sample bounds them."""

    def work(batch: pa.RecordBatch):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for f in found(text):
                counts.setdefault(f, [0, 0])[0 if toxic else 1] += 1
        return {"f": list(counts), "yes": [c[0] for c in counts.values()], "no": [c[1] for c in counts.values()]}

    per = per_batch(rows, "f string, yes long, no long", work).groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    total = rows.agg(F.count_if(F.col("toxic") == 1).alias("yes"), F.count_if(F.col("toxic") != 1).alias("no")).first()
    n1, n0 = max(1, total["yes"]), max(1, total["no"])
    top = per.where(F.col("yes") + F.col("no") >= 3).withColumn("g", likelihood_ratio(F.col("yes"), F.col("no"), n1, n0)).where(F.col("g") >= EVIDENCE)
    return [(r["f"], r["yes"], r["no"]) for r in top.orderBy(F.desc("g"), "f").collect()]


def feature_matrix(rows: DataFrame, names: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each row the numbers of the names it has, and its label."""
    index = {f: i for i, f in enumerate(names)}

    def work(batch: pa.RecordBatch):
        return {"at": [sorted(index[f] for f in found(t) if f in index) for t in batch.column(0).to_pylist()], "toxic": batch.column(1)}

    got = per_batch(rows, "at array<int>, toxic int", work).collect()
    return [np.array(r["at"], np.int64) for r in got], np.array([r["toxic"] == 1 for r in got], float)


def dependent_sets(votes: np.ndarray, classes: np.ndarray, least: float = 0.5) -> list[list[int]]:
    """The voters in sets that depend on each other within a class.

    votes: texts by voters, 0 or 1; classes: each text's. A pair's correlation is the greatest that a class shows in
    which both have SEEN votes. Sets grow along the most correlated pairs first, while half of their pairs are dependent.
    """
    n = votes.shape[1]
    most = np.zeros((n, n))
    for c in (0, 1):
        own = votes[classes == c]
        seen = own.sum(axis=0)
        if len(own):
            mean = seen / len(own)
            spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
            corr = ((own.T @ own) / len(own) - np.outer(mean, mean)) / np.outer(spread, spread)
            most = np.maximum(most, np.where(np.minimum.outer(seen, seen) >= SEEN, corr, 0))
    np.fill_diagonal(most, 0)
    where = {i: [i] for i in range(n)}
    for at in np.argsort(-most, axis=None, kind="stable").tolist():
        i, j = divmod(at, n)
        if most[i, j] < least:
            break
        if i < j and where[i] is not where[j] and (most[np.ix_(where[i], where[j])] >= least).mean() >= 0.5:
            joined = where[i] + where[j]
            for k in joined:
                where[k] = joined
    return sorted({id(x): sorted(x) for x in where.values()}.values())


def label_model(votes: np.ndarray, sets: list[list[int]], prior: np.ndarray, share: float, strength: float = 30.0, rounds: int = 100, silence: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Posteriors of texts, and for each set of voters the rates (2 by 3) of none, one or more votes in either class.

    By expectation maximisation; the sets are independent given the class. silence: does a voter without a vote
    speak for a class too, as voters do that could vote on any text? Else only the silence of all does, as a last
    set (0: some vote, 1: none). prior: a voter's rates expected beforehand (2 by voters), which weigh as
    `strength` texts and keep the classes' meaning fixed.
    """
    levels = [np.minimum(votes[:, s].sum(axis=1), 2).astype(int) for s in sets]
    expected = []
    for s in sets:
        none = 1 - prior[:, s].max(axis=1)
        some = (1 - none) * (1.0 if len(s) == 1 else 0.5)
        expected.append(np.clip(np.stack([none, some, 1 - none - some], axis=1), 1e-5, 1))
    if not silence:
        levels.append((np.max(levels, axis=0) == 0).astype(int))
        expected.append(np.array([[0.1, 0.9, 1e-5], [0.9, 0.1, 1e-5]]))
    # the places (text, set and level) where a level isn't 0, as most are: a round goes over these alone
    n, sets_ = len(votes), len(levels)
    owner = np.concatenate([np.flatnonzero(level) for level in levels])
    place = np.concatenate([3 * k + level[level > 0] for k, level in enumerate(levels)])
    beforehand = np.stack(expected, axis=1)  # classes by sets by levels
    rates = beforehand.copy()
    post = np.full(n, share)
    for _ in range(rounds):
        ratio = np.log(rates[1]) - np.log(rates[0])
        ratio[:, 0] *= silence
        more = (ratio - ratio[:, :1]).ravel()
        odds = np.log(share / (1 - share)) + ratio[:, 0].sum() + np.bincount(owner, more[place], n)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for c, w in ((1, new), (0, 1 - new)):
            count = np.bincount(place, w[owner], 3 * sets_).reshape(sets_, 3)
            count[:, 0] = w.sum() - count[:, 1:].sum(axis=1)
            rates[c] = np.clip((count + strength * beforehand[c]) / (w.sum() + strength * beforehand[c].sum(axis=1, keepdims=True)), 1e-5, 1)
        done = n == 0 or np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, list(rates.transpose(1, 0, 2))


def linear(rows: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 300, rate: float = 0.5, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier on soft labels, by AdaGrad on the whole sample."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    w, b, g, gb = np.zeros(size), 0.0, np.full(size, 1e-6), 1e-6
    importance = np.where(target > 0.5, 6.0, 1.0)
    importance /= importance.sum()
    for _ in range(rounds):
        z = b + np.bincount(owner, w[at], len(rows))
        slope = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        s = np.bincount(at, slope[owner], size) + decay * w
        g += s * s
        gb += slope.sum() ** 2
        w -= rate * s / np.sqrt(g)
        b -= rate * slope.sum() / np.sqrt(gb)
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """weights by feature name, and bias."""
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.keep(training_rows(docs, labels), "sample")  # one pass over documents; the sample is read again below
    chosen = candidates(rows)
    x, gold = feature_matrix(rows, [f for f, _, _ in chosen] + sorted(SEED_NAMES.difference(f for f, _, _ in chosen)))
    scratch.drop()
    return model_from(chosen, x, gold)


def counted(x: list[np.ndarray], size: int) -> np.ndarray:
    """How many rows have each name."""
    return np.bincount(np.concatenate(x) if x else np.zeros(0, np.int64), minlength=size)


def voters_of(names: list[str], yes: np.ndarray, every: np.ndarray, positive: float, support: float, pure: int) -> list[int]:
    """Numbers of the names that vote: the seed lexicon, and names that few texts but those of label 1 have. yes, every: counts in those texts and in all."""
    return [i for i, f in enumerate(names) if every[i] and (f in SEED_NAMES or yes[i] >= max(SEEN, support * positive) and yes[i] >= pure * (every[i] - yes[i]))]


def vote_matrix(x: list[np.ndarray], voters: list[int] | tuple[int, ...], size: int) -> np.ndarray:
    """Texts by voters, 0 or 1."""
    votes = np.zeros((len(x), len(voters)), np.float32)
    place = np.full(size, -1)
    place[list(voters)] = np.arange(len(voters))
    owner, at = np.repeat(np.arange(len(x)), [len(r) for r in x]), place[np.concatenate(x) if x else np.zeros(0, np.int64)]
    votes[owner[at >= 0], at[at >= 0]] = 1
    return votes


def posteriors(votes: np.ndarray, least: float, share: float, rounds: int = 100) -> np.ndarray:
    """Posteriors of texts by the label model: accuracies with independent voters first, then correlations within the classes that these tell, and accuracies again."""
    prior = np.tile([[0.003], [0.05]], (1, votes.shape[1]))  # every voter's alike: a vote is rare, and rarer in class 0
    post, _ = label_model(votes, [[i] for i in range(votes.shape[1])], prior, share, rounds=rounds)
    return label_model(votes, dependent_sets(votes, post >= 0.5, least), prior, share, rounds=rounds)[0]


def chosen_parameters(names: list[str], x: list[np.ndarray], gold: np.ndarray, share: float) -> tuple[float, float, int]:
    """Correlation, support and purity whose label model says most about texts that chose none of its voters: least log loss over FOLDS folds of the sample.

    A fold's labels choose voters for the other folds only; the label model reads no labels. Ties go to the first.
    """
    fold, size = np.arange(len(x)) % FOLDS, len(names)
    counts = []  # of all folds but each
    for k in range(FOLDS):
        others = [i for i in range(len(x)) if fold[i] != k]
        counts.append((counted([x[i] for i in others if gold[i]], size), counted([x[i] for i in others], size), gold[fold != k].sum()))
    known: dict[tuple, np.ndarray] = {}

    def loss(least: float, support: float, pure: int) -> float:
        total = 0.0
        for k in range(FOLDS):
            voters = tuple(voters_of(names, *counts[k], support, pure))
            if voters:
                key = (voters, least)
                if key not in known:
                    known[key] = np.clip(posteriors(vote_matrix(x, voters, size), least, share, FOLD_ROUNDS), 1e-4, 1 - 1e-4)
                post, want = known[key][fold == k], gold[fold == k]
                total -= (want * np.log(post) + (1 - want) * np.log(1 - post)).sum()
            else:
                total = np.inf
        return round(total, 6)

    support, pure = min(VOTERS, key=lambda v: loss(DEPENDENT[0], *v))
    return min(DEPENDENT, key=lambda d: loss(d, support, pure)), support, pure


def model_from(chosen: list[tuple[str, int, int]], x: list[np.ndarray], gold: np.ndarray) -> dict:
    """The model from names with their counts and the sample's rows of name numbers; seeds that have no count stand last."""
    known = {f: (y, n) for f, y, n in chosen}
    names = [f for f, _, _ in chosen] + sorted(SEED_NAMES.difference(known))
    share = min(0.5, max(0.02, float(gold.mean()) if len(gold) else 0.1))
    least, support, pure = chosen_parameters(names, x, gold, share)
    every, yes = counted(x, len(names)), counted([r for r, g in zip(x, gold, strict=True) if g], len(names))
    votes = vote_matrix(x, voters_of(names, yes, every, gold.sum(), support, pure), len(names))
    if not votes.size:
        return {"weights": dict.fromkeys(SEED_NAMES, 2.0), "bias": -3.0}
    post = posteriors(votes, least, share)
    w, b = linear(x, post, len(names))
    for i, f in enumerate(names):  # seeds that no text of the sample has keep a weight of their own
        if f in SEED_NAMES and not any(known.get(f, (0, 0))):
            w[i] = 2.0
    return {"weights": {f: float(v) for f, v in zip(names, w, strict=True) if v}, "bias": float(b)}


class Scorer:
    def __init__(self, model: dict):
        weights = model["weights"]
        self.bias, self.pattern = model["bias"], {f: w for f, w in weights.items() if f[0] == "p"}

        class Words(dict):
            """Each word's features that have a weight."""

            def __missing__(self, word: str) -> tuple:
                if len(self) > REMEMBERED:
                    self.clear()
                f = self[word] = tuple(n for n in names_of(word) if n in weights)
                return f

        self.weights, self.words = weights, Words()

    def score(self, text: str | None) -> float:
        text = text or ""
        words = set(_WORD.findall(text.lower()))
        have = {f for fs in filter(None, map(self.words.__getitem__, words)) for f in fs}
        z = self.bias + sum(self.weights[f] for f in sorted(have)) + sum(self.pattern.get(f, 0.0) for f in patterns(text, words))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def scored(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels: doc_id, toxic."""
    tune(docs.sparkSession)
    model = model or train(docs, labels)

    def work(batch: pa.RecordBatch, scorer: Scorer):
        score = [scorer.score(t) for t in batch.column(1).to_pylist()]
        ids = batch.column(0).to_pylist()
        return {"doc_id": ids, "held_out": [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids], "score": score, "predicted": [int(s >= THRESHOLD) for s in score]}

    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return per_batch(texts(docs, "doc_id", "text"), "doc_id long, held_out boolean, score double, predicted int", work, lambda: (Scorer(model),))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't call toxic, columns as they are."""
    model, at = train(docs, labels), docs.columns.index("text")

    def work(batch: pa.RecordBatch, scorer: Scorer):
        return batch.filter(pa.array([scorer.score(t) < THRESHOLD for t in batch.column(at).to_pylist()]))

    return per_batch(docs, docs.schema, work, lambda: (Scorer(model),))

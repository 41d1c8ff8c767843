"""Packing by optimal length buckets.

The global histogram of token counts, one row a distinct length, goes to a dynamic program that chooses the
bucket boundaries with the least padding, each bucket padding its documents to its longest. The best split
points never move back as lengths grow, so the program divides and conquers over them. Inside each bucket
documents form batches of as many rows as the token budget holds at the bucket's length. Batch numbers come
from prefix sums over (bucket, slice) counts of distinct (doc_id, n_tokens), so no task ever sees a whole
bucket, nor all rows of an id that repeats.

Defined results: null, empty and blank texts of 0 tokens take a length of 1 in buckets; a document longer
than the budget is a batch of its own, whole; rows that repeat an id are packed each; null ids sort first;
documents of one slice stand by doc_id and length, so ties are rows that are alike. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .token_counts import token_counts

BUCKETS, BUDGET = 16, 65_536
#: Documents of a slice, about: what one task ranks. Rows that one repeated document makes at a time.
SLICE, REPEATS = 20_000, 100_000


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """The longest length of each bucket, ascending, and the least padding in all.

    lengths: distinct, ascending, with the documents of each. O(buckets * lengths * log lengths) in 64-bit integers.
    """
    x, c = np.array(lengths, np.int64), np.array(counts, np.int64)
    n = len(x)
    if not n:
        return [], 0
    docs, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = np.concatenate([[0], x * docs[1:] - tokens[1:]])  # of the first j lengths in one bucket
    came = [np.zeros(n + 1, np.int64)]
    for _ in range(min(buckets, n) - 1):
        new, prior = best.copy(), np.zeros(n + 1, np.int64)
        prior[1] = came[-1][1]
        ahead = best + tokens  # the part of a split point's cost that no longer length changes
        todo = [(2, n, 1, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            end = min(last, j - 1)
            cost = ahead[first : end + 1] - x[j - 1] * docs[first : end + 1]
            k = first + int(cost.argmin())
            new[j], prior[j] = cost[k - first] + x[j - 1] * docs[j] - tokens[j], k
            todo += [(low, j - 1, first, k), (j + 1, high, k, last)]
        best = new
        came.append(prior)
    out, j = [], n
    for prior in reversed(came):
        if j:
            out.append(int(x[j - 1]))
            j = int(prior[j])
    return sorted(out), int(best[n])


def packed(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch_id, row of every row of lengths (doc_id, n_tokens)."""
    spark = lengths.sparkSession
    scratch = Scratch(spark, "packing")
    plain = scratch.keep(lengths.select("doc_id", "n_tokens"), "lengths")
    length = F.greatest(F.col("n_tokens"), F.lit(1))
    histogram = sorted((r[0], r[1]) for r in plain.groupBy(length).count().collect())
    ends, _ = boundaries([h[0] for h in histogram], [h[1] for h in histogram], buckets)
    total = sum(h[1] for h in histogram)
    slices = max(1, -(-total // SLICE))
    bucket = F.lit(len(ends) - 1)
    for i, end in reversed(list(enumerate(ends))):
        bucket = F.when(length <= end, i).otherwise(bucket)
    placed = plain.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("__rows"))
    placed = placed.select("doc_id", "n_tokens", "__rows", bucket.alias("bucket"), F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(slices)).alias("__slice"))
    top = placed.groupBy("bucket", "__slice").agg(F.sum("__rows").alias("__n"), F.max("n_tokens").alias("__longest"))
    before = Window.partitionBy("bucket").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    bases = top.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("bucket_length", F.greatest(F.max("__longest").over(Window.partitionBy("bucket")), F.lit(1)))
    within = Window.partitionBy("bucket", "__slice").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("__at", F.coalesce(F.sum("__rows").over(within), F.lit(0))).join(bases.select("bucket", "__slice", "__base", "bucket_length"), ["bucket", "__slice"])
    # a document that repeats very often makes its rows in parts
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1, F.lit(REPEATS).cast("long")))
    rows = rows.withColumn("__from", part).withColumn("__k", F.explode(F.sequence("__from", F.least(F.col("__from") + REPEATS, F.col("__rows")) - 1)))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length")))
    at = F.col("__base") + F.col("__at") + F.col("__k")
    return rows.select("doc_id", "n_tokens", "bucket", F.col("bucket_length").cast("long"), F.floor(at / capacity).cast("long").alias("batch_id"), (at % capacity).cast("int").alias("row"))


def pack_documents(docs: DataFrame, model: str, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """packed() of the token counts of docs (doc_id, text)."""
    return packed(token_counts(docs, model).select("doc_id", "n_tokens"), buckets, budget)

"""A hash-chained audit log: sealing, verification, filtering."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

GENESIS = "0" * 64
#: Fields in the order that the digest reads them.
FIELDS = ("actor", "action", "kind", "fingerprint", "rule", "path", "reason", "details")


def canonical(prev_hash: Column) -> Column:
    """Sorted-key JSON of an event with its place and the hash before it."""
    names = sorted(["v", "seq", "ts", "prev_hash", *FIELDS])
    return F.to_json(F.struct(*(prev_hash.alias(n) if n == "prev_hash" else F.col(n) for n in names)), {"ignoreNullFields": "false"})


def digest(prev_hash: Column) -> Column:
    return F.sha2(canonical(prev_hash), 256)


def first_break(log: DataFrame, by: list[str], own: Callable | None = digest) -> DataFrame:
    """by, events, first_broken: the first seq whose prev_hash, number or own hash is wrong; null for whole chains."""
    w = Window.partitionBy(*by).orderBy("seq")
    wrong = (F.col("prev_hash") != F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))) | (F.col("seq") != F.coalesce(F.lag("seq").over(w) + 1, F.first("seq").over(w)))
    if own is not None:
        wrong = wrong | (F.col("hash") != own(F.col("prev_hash")))
    checked = log.withColumn("__wrong", wrong)
    return checked.groupBy(*by).agg(F.count("*").alias("events"), F.min(F.when(F.col("__wrong"), F.col("seq"))).alias("first_broken"))


def sealed(events: DataFrame, by: list[str]) -> DataFrame:
    """events (v, seq, ts and FIELDS) with prev_hash and hash, each chain folded in seq order.

    A chain is one log, as long as one writer's; its rows stream through one task, which holds the last hash.
    """
    hole = "\u0001"
    rows = events.withColumn("__text", canonical(F.lit(hole))).withColumn("__log", F.to_json(F.struct(*by)))
    rows = rows.repartition("__log").sortWithinPartitions("__log", "seq")
    empty = json.dumps(hole)
    schema = StructType([*events.schema, StructField("prev_hash", StringType()), StructField("hash", StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, last = None, GENESIS
        for batch in batches:
            before, own = [], []
            for text, name in zip(batch.column("__text").to_pylist(), batch.column("__log").to_pylist(), strict=True):
                before.append(last := last if name == log else GENESIS)
                log, last = name, hashlib.sha256(text.replace(f'"prev_hash":{empty}', f'"prev_hash":"{last}"', 1).encode()).hexdigest()
                own.append(last)
            kept = batch.drop_columns(["__text", "__log"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(before), pa.array(own)], names=[*kept.schema.names, "prev_hash", "hash"])

    return rows.mapInArrow(fold, schema)


def filtered(log: DataFrame, since: str | None = None, until: str | None = None, **equal: str) -> DataFrame:
    """Rows of a log by field values and an ISO time range."""
    for name, value in equal.items():
        log = log.where(F.col(name) == value)
    if since:
        log = log.where(F.col("ts") >= since)
    return log.where(F.col("ts") < until) if until else log


def once(events: DataFrame, key: list[str]) -> DataFrame:
    """Events that are logged once a key: the first by seq."""
    w = Window.partitionBy(*key).orderBy("seq")
    return events.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")

"""Monitoring as Structured Streaming: windows, sessions, incremental scans and an idempotent drift loop.

Windows and sessions are extensions of this engine; the loop commits state only after its push succeeded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift
from ..operators.findings import same


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """day, event_type, n, total of events (ts timestamp, event_type, value); on streams put a watermark first."""
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, by: list[str]) -> DataFrame:
    """Sessions of events by key; they end `gap` after their last event."""
    w = F.session_window("ts", gap)
    return events.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def event_stream(spark: SparkSession, folder: str, files: str = "*.parquet", late: str = "1 hour") -> DataFrame:
    """The events files of a folder, by a glob on their names, as a stream with a watermark."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def incremental(files: DataFrame, cache: DataFrame, scan: Callable[[DataFrame], DataFrame], version: str, options: str = "") -> tuple[DataFrame, DataFrame]:
    """Findings of files, scanning only those whose content no cache row (file_key, findings) has; and the new cache.

    The key holds the engine's version, the options of the scan, the project, the path and the content; files without
    findings are remembered too.
    """
    keyed = files.withColumn("file_key", F.sha2(F.concat_ws("\u0001", F.lit(version), F.lit(options), F.coalesce("project", F.lit("")), "path", "text"), 256))
    fresh = keyed.dropDuplicates(["file_key"]).join(cache.select("file_key"), "file_key", "left_anti")
    found = scan(fresh.drop("file_key")).groupBy("project", "path").agg(F.collect_list(F.struct("*")).alias("findings"))
    own = fresh.select("file_key", "project", "path").alias("r").join(found.alias("f"), same(["project", "path"], "r", "f"), "left")
    rows = own.select("file_key", "findings")
    kept = cache.join(keyed.select("file_key"), "file_key", "left_semi").unionByName(rows)
    return kept.select(F.explode("findings").alias("f")).select("f.*"), kept


def drift_loop(snapshots: DataFrame, state: str, push: Callable[[DataFrame, int], None], checkpoint: str):
    """A query over a stream of findings that pushes each batch's drift against the state table of its target.

    The new state is written, under the batch's number, only after push() returned: a batch that fails is
    pushed again with the same number, for which the receiver can be idempotent. A batch compares itself with the
    state of the last batch before it, so one that runs again after its state was written gives the same drift and
    writes the same state; older states go.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/current")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        kept = [s.getPath() for s in store.listStatus(folder)] if store.exists(folder) else []
        kept = {int(p.getName().split("=")[1]): p for p in kept if p.getName().startswith("batch=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
        earlier = [n for n in kept if n < number]
        before = spark.read.schema(df.schema).parquet(f"{state}/current/batch={max(earlier)}") if earlier else df.limit(0)
        push(drift.scan_drift(before, df), number)
        df.write.mode("overwrite").parquet(f"{state}/current/batch={number}")
        for n in sorted(earlier)[:-1]:  # the state before this one stays for a batch that runs again
            store.delete(kept[n], True)

    return snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

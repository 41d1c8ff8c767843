"""What the operators share: scratch tables, size checks and plain helpers."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of (id) that may be broadcast; beyond it joins shuffle. 2 million longs are 16 MB.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as spark.checkpoint.dir names it.

    Only a session whose executors are threads of the driver may leave it unset; a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes and rows, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read more than once. options: of their writer."""

    def __init__(self, spark: SparkSession, label: str, **options):
        self.spark, self.base, self.options = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", options
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").options(**self.options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS, width=None) -> DataFrame:
    """df with a broadcast hint if it proves to have few rows, else df for a shuffled join.

    width: a column of each row's bytes where rows hold more than a few numbers; together they may be BROADCAST_BYTES.
    """
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.lit(8) if width is None else width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def once(key: tuple, make: Callable[[], object]) -> object:
    """What make() gives, made once in each Python worker: tokenizers and memos outlive a task there.

    A worker holds one such state: that of another operator, run before, goes first.
    """
    states = sys.__dict__.setdefault("_spanwarden_states", {})
    if key not in states:
        states.clear()
        states[key] = make()
    return states[key]


def texts(df: DataFrame, *names: str) -> DataFrame:
    """The columns that an operator reads; others, whatever their names, stay behind."""
    return df.select(*(F.col(n) for n in names))


def per_batch(df: DataFrame, schema: str | StructType, work: Callable[..., Iterable[dict | list]], start: Callable[[], tuple] | None = None) -> DataFrame:
    """mapInArrow with one call of work(batch, *state) for each Arrow batch; start() makes a task's state.

    work returns a dict of column lists, or a pyarrow RecordBatch.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else ()
        for batch in batches:
            if batch.num_rows:
                out = work(batch, *state)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)

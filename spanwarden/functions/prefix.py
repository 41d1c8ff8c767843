"""Prefix sums over groups of any size: rows are dealt by ranges of group and order, so no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep


def with_sum_before(df: DataFrame, by: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value over the rows of its group that come before, in order.

    A range has its own running sums; what comes before it in the group is a prefix sum over one row a range. Rows
    that are equal in order come as they stand.
    """
    columns = df.columns
    rows = df.withColumn("__value", F.coalesce(value, F.lit(0)).cast("long")).withColumn("__at", F.monotonically_increasing_id())
    rows = keep(rows.repartitionByRange(*by, *order, "__at").withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by, "__range").orderBy(*order, "__at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*by, "__range").agg(F.sum("__value").alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    same = F.col("r.__range") == F.col("b.__range")
    for k in by:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    own = rows.withColumn("__own", F.coalesce(F.sum("__value").over(before), F.lit(0)))
    return own.alias("r").join(bases.alias("b"), same).select(*(f"r.{c}" for c in columns), (F.col("r.__own") + F.col("b.__base")).alias(name))

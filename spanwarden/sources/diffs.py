"""Unified diffs as tables: each line of a commit's patch with its file, its kind and its numbers before and after.

A hunk's head gives where its lines start and how many it has; running sums over the lines after it count those used
up, so a line that looks like a file's head inside a hunk is content, and each added line gets its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _name(line: Column, mark: str) -> Column:
    """The path of a --- or +++ line without its prefix and time, quoted or not; null for /dev/null."""
    named = F.regexp_replace(F.regexp_extract(line, rf"^{mark} ([^\t]+)", 1), r'^"(.*)"$', "$1")
    return F.when(F.rlike(line, F.lit(rf"^{mark} ")) & (named != "/dev/null"), F.regexp_replace(named, "^[ab]/", ""))


def diff_lines(patches: DataFrame) -> DataFrame:
    """project, commit, seq, path, change (+, - or blank), old_line, new_line, content of patches (project, commit, seq, text).

    text is what a log with patches or a diff gives for one commit; a null text, and lines outside hunks, give no rows.
    """
    key = ["project", "commit", "seq"]
    rows = patches.select(*key, F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    order = Window.partitionBy(*key).orderBy("at")
    until, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.rlike("raw", F.lit(HUNK))
    parts = [F.regexp_extract("raw", HUNK, i) for i in range(1, 5)]
    number = lambda p, empty: F.when(head, F.when(p == "", F.lit(empty)).otherwise(p.try_cast("long")))
    mark = F.substring("raw", 1, 1)
    uses_old, uses_new = (F.when(~head & mark.isin(*kinds), 1).otherwise(0) for kinds in ((" ", "-"), (" ", "+")))
    rows = rows.select("*", F.count_if(head).over(until).alias("hunk"), *(F.last(number(p, e), True).over(until).alias(n) for p, e, n in zip(parts, (1, 1, 1, 1), ("a", "a_n", "c", "c_n"), strict=True)), uses_old.alias("o"), uses_new.alias("n"), head.alias("head"))
    inside = Window.partitionBy(*key, "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    used = [F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("o", "n")]
    rows = rows.withColumn("used_old", used[0]).withColumn("used_new", used[1])
    content = (F.col("hunk") > 0) & ~F.col("head") & ((F.col("used_old") < F.col("a_n")) | (F.col("used_new") < F.col("c_n"))) & mark.isin(" ", "+", "-")
    rows = rows.withColumn("content", content)
    file = F.when(~F.col("content"), F.coalesce(_name(F.col("raw"), r"\+\+\+"), _name(F.col("raw"), "---")))
    # a new file's name stands at its +++ line, after the old one's; a deleted file has the old one only
    rows = rows.withColumn("path", F.last(file, True).over(until)).where("content")
    change = F.trim(mark)
    old = F.when(mark != "+", F.col("a") + F.col("used_old"))
    new = F.when(mark != "-", F.col("c") + F.col("used_new"))
    return rows.select(*key, "path", change.alias("change"), old.cast("int").alias("old_line"), new.cast("int").alias("new_line"), F.substring("raw", F.lit(2), F.length("raw")).alias("content"))


def changed_lines(patches: DataFrame) -> DataFrame:
    """project, path, line of the lines that patches add, for findings.in_diff; a file that only loses lines has one row of null line."""
    rows = diff_lines(patches).where("change <> ''")
    added = rows.where("change = '+'").select("project", "path", F.col("new_line").alias("line")).distinct()
    lost = rows.groupBy("project", "path").agg(F.count_if(F.col("change") == "+").alias("n")).where("n = 0")
    return added.unionByName(lost.select("project", "path", F.lit(None).cast("int").alias("line")))

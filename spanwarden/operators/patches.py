"""Unified diffs of rewritten lines, and which rules' rewrites may apply by themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import line_array
from .findings import same

#: Lines of context around a change.
CONTEXT = 3
#: Rules whose rewrite applies by itself unless told otherwise: fixed values.
AUTO_APPLY = ("patterns.python-yaml-load", "patterns.flask-debug-true")


def _hunk(lines: Column, new: Column, h: Column) -> Column:
    """A hunk's text: head, context, and for each run of changed lines the old ones, then the new ones."""
    start, end = F.greatest(h["first"] - CONTEXT, F.lit(1)), F.least(h["last"] + CONTEXT, F.size(lines))

    def is_new(i: Column) -> Column:
        return F.try_element_at(new, i).isNotNull()

    def run_end(i: Column) -> Column:
        """The last line of the run of changed lines that starts at i."""
        stop = F.filter(F.sequence(i, end + 1), lambda j: ~is_new(j))
        return F.coalesce(F.try_element_at(stop, F.lit(1)), end + 1) - 1

    def shown(i: Column) -> Column:
        run = F.sequence(i, run_end(i))
        old = F.array_join(F.transform(run, lambda j: F.concat(F.lit("-"), F.element_at(lines, j))), "\n")
        fixed = F.array_join(F.transform(run, lambda j: F.concat(F.lit("+"), F.try_element_at(new, j))), "\n")
        return F.when(~is_new(i), F.concat(F.lit(" "), F.element_at(lines, i))).when((i == start) | ~is_new(i - 1), F.concat(old, F.lit("\n"), fixed))

    size = end - start + 1
    span = F.when(size == 1, start.cast("string")).otherwise(F.concat_ws(",", start.cast("string"), size.cast("string")))
    body = F.filter(F.transform(F.sequence(start, end), shown), lambda x: x.isNotNull())
    return F.concat(F.lit("@@ -"), span, F.lit(" +"), span, F.lit(" @@\n"), F.array_join(body, "\n"))


def unified_diffs(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """project, path, patch of files(project, path, text) after fixes (project, path, line, replacement), lines that keep their number.

    Changes that at most 2 * CONTEXT unchanged lines part share a hunk. Of several fixes of a line the least counts;
    fixes that change nothing, or of lines that aren't there, are no changes, and files without changes give no row.
    """
    each = fixes.where("line IS NOT NULL AND replacement IS NOT NULL").groupBy("project", "path", "line").agg(F.min("replacement").alias("replacement"))
    by_file = each.groupBy("project", "path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("line").cast("int"), "replacement"))).alias("fixes"))
    met = files.select("project", "path", line_array(F.col("text")).alias("lines")).alias("f").join(by_file.alias("x"), same(["project", "path"], "f", "x")).select("f.*", "fixes")
    met = met.withColumn("new", F.map_filter("fixes", lambda k, v: (k >= 1) & (k <= F.size("lines")) & (F.try_element_at("lines", k) != v))).where(F.size("new") > 0)
    island = "struct<first:int,last:int>"

    def grow(acc: Column, i: Column) -> Column:
        near = (F.size(acc) > 0) & (i - F.try_element_at(acc, F.lit(-1))["last"] - 1 <= 2 * CONTEXT)
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), i.alias("last"))))
        return F.when(near, longer).otherwise(F.array_append(acc, F.struct(i.alias("first"), i.alias("last"))))

    met = met.withColumn("hunks", F.aggregate(F.array_sort(F.map_keys("new")), F.array().cast(f"array<{island}>"), grow))
    text = F.array_join(F.transform("hunks", lambda h: _hunk(F.col("lines"), F.col("new"), h)), "\n")
    return met.select("project", "path", F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"), text, F.lit("\n")).alias("patch"))


def automatic(history: DataFrame, base: tuple[str, ...] = AUTO_APPLY, graduate: tuple[str, ...] = (), demote: tuple[str, ...] = (), least: int = 20, share: float = 0.95) -> DataFrame:
    """rule_id, rewrites, verified, automatic of history (rule_id, verified): may a rule's rewrite apply by itself?

    The base may, and what is named to graduate, and rules with at least `least` rewrites of which `share` verified; not what
    is named to demote, and not what has so many rewrites and fewer verified. Rules without history keep what is named.
    """
    counts = history.groupBy("rule_id").agg(F.count("*").alias("rewrites"), F.count_if("verified").alias("verified"))
    named = history.sparkSession.createDataFrame([(r,) for r in sorted({*base, *graduate, *demote})] or [("",)], "rule_id string")
    every = counts.join(named.where("rule_id <> ''"), "rule_id", "full").na.fill(0, ["rewrites", "verified"])
    proven = (F.col("rewrites") >= least) & (F.col("verified") >= share * F.col("rewrites"))
    failed = (F.col("rewrites") >= least) & ~proven
    told = F.col("rule_id").isin(*graduate) if graduate else F.lit(False)
    out = F.col("rule_id").isin(*demote) if demote else F.lit(False)
    first = F.col("rule_id").isin(*base) if base else F.lit(False)
    return every.withColumn("automatic", ~out & (told | proven | (first & ~failed)))

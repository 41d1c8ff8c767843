"""Differences between two states: scans, package inventories, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed(findings: DataFrame) -> DataFrame:
    """findings with a key: the fingerprint, and from its second occurrence in line order on #n."""
    own = ["project"] if "project" in findings.columns else []
    n = F.row_number().over(Window.partitionBy(*own, "fingerprint").orderBy(F.coalesce("start_line", F.lit(0)), "ordinal"))
    return findings.withColumn("__n", n).withColumn("key", F.when(F.col("__n") == 1, F.col("fingerprint")).otherwise(F.concat_ws("#", "fingerprint", F.col("__n").cast("string")))).drop("__n")


def scan_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change (added, removed, severity_changed or unchanged), before_severity, after_severity, rule_id, path; after
    the project where both states have one."""
    project = ["project"] if "project" in before.columns and "project" in after.columns else []
    side = (*project, "key", "severity", "rule_id", "path")
    b, a = keyed(before).select(*side).alias("b"), keyed(after).select(*side).alias("a")
    change = F.when(F.col("b.key").isNull(), "added").when(F.col("a.key").isNull(), "removed").when(F.col("a.severity") != F.col("b.severity"), "severity_changed").otherwise("unchanged")
    same = F.col("a.key") == F.col("b.key")
    for p in project:
        same = same & F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}"))
    both = b.join(a, same, "full")
    return both.select(*(F.coalesce(f"a.{p}", f"b.{p}").alias(p) for p in project), F.coalesce("a.key", "b.key").alias("key"), change.alias("change"), F.col("b.severity").alias("before_severity"), F.col("a.severity").alias("after_severity"), F.coalesce("a.rule_id", "b.rule_id").alias("rule_id"), F.coalesce("a.path", "b.path").alias("path"))


def package_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, old_version, new_version, change; of rows that share a key the last by ordinal counts."""

    def last(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.max_by("version", "ordinal").alias(name))

    both = last(old, "old_version").join(last(new, "new_version"), keys, "full")
    change = F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "removed").when(F.col("old_version") != F.col("new_version"), "changed").otherwise("unchanged")
    return both.select(*keys, "old_version", "new_version", change.alias("change"))


#: Rule, severity and CWE of each change.
DIFF_RULES = {"added": ("dependency-diff.added", 2, "CWE-1104"), "removed": ("dependency-diff.removed", 0, None), "changed": ("dependency-diff.changed", 2, "CWE-1104")}


def diff_findings(diff: DataFrame) -> DataFrame:
    """Findings of a package_diff over (ecosystem, package, manifest)."""

    def by_change(at: int):
        out = F.lit(None)
        for change, row in DIFF_RULES.items():
            out = F.when(F.col("change") == change, F.lit(row[at])).otherwise(out)
        return out

    cwe = by_change(2)
    return diff.where("change <> 'unchanged'").select(by_change(0).alias("rule_id"), F.lit("dependency-diff").alias("scanner"), F.col("manifest").cast("string").alias("path"), by_change(1).cast("int").alias("severity"), F.lit(2).alias("confidence"), F.when(cwe.isNull(), F.array().cast("array<string>")).otherwise(F.array(cwe)).alias("cwe"), F.concat_ws(" ", "package", "old_version", "new_version").alias("snippet"))


def file_integrity(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Findings from two path states (path, digest, mode, readable): created, removed, changed, permissions, unreadable."""
    k, s = known.alias("k"), seen.alias("s")
    both = k.join(s, F.col("k.path") == F.col("s.path"), "full")
    rule = (
        F.when(F.col("s.path").isNotNull() & ~F.coalesce("s.readable", F.lit(True)), "fim.unreadable")
        .when(F.col("k.path").isNull(), "fim.file-created")
        .when(F.col("s.path").isNull(), "fim.file-removed")
        .when(~F.col("k.digest").eqNullSafe(F.col("s.digest")), "fim.content-changed")
        .when(~F.col("k.mode").eqNullSafe(F.col("s.mode")), "fim.permission-changed")
    )
    severity = F.when(F.col("rule_id").isin("fim.unreadable", "fim.permission-changed"), 2).otherwise(3)
    return both.select(F.coalesce("k.path", "s.path").alias("path"), rule.alias("rule_id")).where("rule_id IS NOT NULL").select("path", "rule_id", severity.alias("severity"), F.lit(2).alias("confidence"))


def set_drift(before: DataFrame, after: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """For array columns of both states: what each gained and lost by key."""
    b, a = before.alias("b"), after.alias("a")
    empty = F.array().cast("array<string>")
    columns = []
    for c in sets:
        old, new = F.coalesce(f"b.{c}", empty), F.coalesce(f"a.{c}", empty)
        columns += [F.array_sort(F.array_except(new, old)).alias(f"{c}_added"), F.array_sort(F.array_except(old, new)).alias(f"{c}_removed")]
    return b.join(a, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *columns)

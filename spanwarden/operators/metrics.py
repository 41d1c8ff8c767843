"""Accuracy of detection against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERALL = "(overall)"


def ratio(part: Column, whole: Column) -> Column:
    """Four decimals, null where the denominator is 0."""
    return F.round(part / F.nullif(whole, F.lit(0)).cast("double"), 4)


def confusion(cases: DataFrame) -> DataFrame:
    """tp, fp, tn, fn and rates of (category, vulnerable, flagged), by category and pooled: one pass with grouping sets."""
    v, f = F.col("vulnerable"), F.col("flagged")
    g = cases.rollup("category").agg(F.count_if(v & f).alias("tp"), F.count_if(~v & f).alias("fp"), F.count_if(~v & ~f).alias("tn"), F.count_if(v & ~f).alias("fn"), F.grouping("category").alias("__all"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    raw_tpr, raw_fpr = tp / F.nullif(tp + fn, F.lit(0)), fp / F.nullif(fp + tn, F.lit(0))
    raw_p = tp / F.nullif(tp + fp, F.lit(0))
    f1 = F.when(raw_p + raw_tpr > 0, 2 * raw_p * raw_tpr / (raw_p + raw_tpr)).when(raw_p.isNotNull() & raw_tpr.isNotNull(), F.lit(0.0))
    return g.select(F.when(F.col("__all") == 1, OVERALL).otherwise(F.col("category")).alias("category"), "tp", "fp", "tn", "fn", ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fp).alias("precision"), F.round(f1, 4).alias("f1"), F.round(raw_tpr - raw_fpr, 4).alias("score"))


def category_mean(cases: DataFrame) -> DataFrame:
    """The unweighted mean of unrounded rates over categories."""
    v, f = F.col("vulnerable"), F.col("flagged")
    g = cases.groupBy("category").agg((F.count_if(v & f) / F.nullif(F.count_if(v), F.lit(0))).alias("tpr"), (F.count_if(~v & f) / F.nullif(F.count_if(~v), F.lit(0))).alias("fpr"))
    return g.agg(F.round(F.avg("tpr"), 4).alias("tpr"), F.round(F.avg("fpr"), 4).alias("fpr"), F.round(F.avg(F.col("tpr") - F.col("fpr")), 4).alias("score"))


def recall(cases: DataFrame) -> DataFrame:
    """grp, cases, detected and recall of (grp, detected), by group and over all."""
    g = cases.rollup("grp").agg(F.count("*").alias("cases"), F.count_if("detected").alias("detected"), F.grouping("grp").alias("__all"))
    return g.select(F.when(F.col("__all") == 1, OVERALL).otherwise(F.col("grp")).alias("grp"), "cases", "detected", ratio(F.col("detected"), F.col("cases")).alias("recall"))


def in_window(changed: DataFrame, findings: DataFrame, window: int, labels: DataFrame | None = None) -> DataFrame:
    """case_id, detected: does a finding lie within `window` lines of one of the case's changed lines (case_id, project, path, line; the project may be absent)?

    Lines meet in buckets of window + 1, neighbours included. labels (case_id, cwe) ask for a CWE as well.
    """
    wide = window + 1
    file = ["project", "path"] if "project" in changed.columns and "project" in findings.columns else ["path"]
    near = changed.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("line") / wide) + k)))
    own = findings.where("start_line IS NOT NULL").select(*file, "start_line", "cwe", F.floor(F.col("start_line") / wide).alias("bucket"))
    hits = near.join(own, [*file, "bucket"]).where(F.abs(F.col("start_line") - F.col("line")) <= window)
    if labels is not None:
        hits = hits.withColumn("cwe", F.explode("cwe")).join(labels, ["case_id", "cwe"], "left_semi")
    found = hits.select("case_id").distinct().withColumn("__hit", F.lit(True))
    return changed.select("case_id").distinct().join(found, "case_id", "left").select("case_id", F.coalesce("__hit", F.lit(False)).alias("detected"))


def outcomes(vulnerable: DataFrame, patched: DataFrame) -> DataFrame:
    """case_id, detected, flagged_after_fix from in_window() of both versions."""
    return vulnerable.join(patched.select("case_id", F.col("detected").alias("flagged_after_fix")), "case_id", "left").withColumn("flagged_after_fix", F.coalesce("flagged_after_fix", F.lit(False)))


def summary(cases: DataFrame) -> DataFrame:
    """Counts and rates of outcomes (case_id, detected, flagged_after_fix)."""
    d, f = F.col("detected"), F.col("flagged_after_fix")
    g = cases.agg(F.count("*").alias("cases"), F.count_if(d).alias("detected"), F.count_if(~d).alias("missed"), F.count_if(f).alias("flagged_after_fix"), F.count_if(d & f).alias("still_flagged"), F.count_if(d & ~f).alias("fix_aware_detected"))
    n = F.col("cases")
    return g.select("*", ratio(F.col("detected"), n).alias("recall"), ratio(F.col("fix_aware_detected"), n).alias("fix_aware_recall"), ratio(F.col("detected"), F.col("detected") + F.col("flagged_after_fix")).alias("precision_proxy"))


def by_advisory(cases: DataFrame, advisory: DataFrame) -> DataFrame:
    """Outcomes of advisories (case_id, ghsa_id): each is what any of its files is."""
    return cases.join(advisory, "case_id").groupBy("ghsa_id").agg(F.bool_or("detected").alias("detected"), F.bool_or("flagged_after_fix").alias("flagged_after_fix")).withColumnRenamed("ghsa_id", "case_id")


def folded_summary(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """section, key, n, items of two summaries (section, key, n, items): counts add up, lists follow each other, what one side lacks is the other's."""
    both = mine.withColumn("__side", F.lit(0)).unionByName(theirs.withColumn("__side", F.lit(1)))
    part = lambda side: F.max_by("items", F.when(F.col("__side") == side, 1))
    none = F.array().cast("array<string>")
    listed = F.when(F.count("items") > 0, F.concat(F.coalesce(part(0), none), F.coalesce(part(1), none)))
    return both.groupBy("section", "key").agg(F.sum("n").alias("n"), listed.alias("items"))

"""Scan history: the latest of each project, retention, trends, overall numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _newest():
    return Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))


def clamped(scans: DataFrame, now) -> DataFrame:
    """Scans dated in the future count as of now."""
    return scans.withColumn("created_at", F.least("created_at", now))


def latest(scans: DataFrame) -> DataFrame:
    """The newest scan of each project and how many it has; one shuffle, no ranking of the rest."""
    newest = F.max_by(F.struct("id", "created_at", "risk_score", "highest_severity"), F.struct("created_at", "id"))
    return scans.groupBy("project_id").agg(newest.alias("s"), F.count("*").alias("scans")).select("project_id", "s.*", "scans")


def retained(scans: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` scans of each project."""
    return scans.withColumn("__k", F.row_number().over(_newest())).where(F.col("__k") <= keep).drop("__k")


def pruned(scans: DataFrame, findings: DataFrame, projects: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scans, findings and projects after retention: findings go with their scans, projects with their last one."""
    kept = retained(scans, keep)
    return kept, findings.join(kept.select(F.col("id").alias("scan_id")), "scan_id", "left_semi"), projects.join(kept.select(F.col("project_id").alias("id")), "id", "left_semi")


def trend(scans: DataFrame) -> DataFrame:
    """Scans with the change of risk against the one before."""
    return scans.withColumn("change", F.col("risk_score") - F.lag("risk_score").over(Window.partitionBy("project_id").orderBy("created_at", "id")))


def by_risk(scans: DataFrame) -> DataFrame:
    """Projects' latest scans, riskiest first."""
    return latest(scans).orderBy(F.desc_nulls_last("risk_score"), "project_id")


def stats(scans: DataFrame) -> DataFrame:
    """projects, scans, open_critical and worst_risk, the last two over latest scans."""
    return latest(scans).agg(F.count("*").alias("projects"), F.sum("scans").alias("scans"), F.count_if(F.col("highest_severity") == 4).alias("open_critical"), F.max("risk_score").alias("worst_risk"))

"""Secrets in the history of a repository: those of added lines of all commits, each secret once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources.diffs import diff_lines
from .rules import PLACEHOLDER, SECRETS, Rule


def history_secrets(patches: DataFrame, rules: Sequence[Rule] = SECRETS) -> DataFrame:
    """Findings secrets.history.<rule> of patches (project, commit, seq, text), seq counting commits from the oldest.

    A secret is known by the digest of its whole value: it is reported once a project and rule, at the commit, file
    and line that had it first. Findings have the commit, the digest and the value's first characters only. Lines are
    read whole, for a window would cut a secret at its end and give another digest; every secret of a line counts.
    """
    added = diff_lines(patches).where("change = '+'")

    def values_of(i: int) -> Column:
        values = F.array_distinct(F.regexp_extract_all("content", F.lit(rules[i].pattern), F.lit(1)))
        return F.transform(F.filter(values, lambda v: (v != "") & ~F.rlike(v, F.lit(PLACEHOLDER))), lambda v: F.struct(F.lit(i).alias("rule"), v.alias("value")))

    hits = F.flatten(F.array(*(values_of(i) for i in range(len(rules)))))
    rows = added.select("project", "commit", "seq", "path", "new_line", F.explode(hits).alias("h"))
    rows = rows.select("project", F.col("h.rule").alias("rule"), F.sha2(F.col("h.value"), 256).alias("digest"), F.struct("seq", "path", F.col("new_line").alias("line"), "commit", scoring.redacted(F.col("h.value")).alias("shown")).alias("place"))
    first = rows.groupBy("project", "rule", "digest").agg(F.min("place").alias("p"))
    about = F.array(*(F.struct(F.lit(f"secrets.history.{r.id.split('.', 1)[1]}").alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), F.array(*map(F.lit, r.cwe)).alias("cwe")) for r in rules))
    said = first.withColumn("a", F.element_at(about, F.col("rule") + 1))
    return said.select("project", "p.path", F.col("p.line").alias("start_line"), F.col("p.line").alias("end_line"), "a.rule_id", F.lit("secrets").alias("scanner"), "a.severity", "a.confidence", F.lit(2).alias("likelihood"), "a.cwe", F.col("p.shown").alias("snippet"), F.array(F.lit("secret"), F.lit("history")).alias("tags"), F.col("p.commit").alias("commit"), "digest")

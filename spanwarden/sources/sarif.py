"""SARIF 2.1.0 results as findings.

Files are read with a schema, runs and results exploded, and each result meets its rule by index, else by
id. Bounds on size, depth and counts hold at ingestion; what breaks them, or isn't SARIF, gives no rows
but a row in refused().
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of a file: fixed values.
MAX_BYTES, MAX_DEPTH, MAX_RUNS, MAX_RESULTS = 50_000_000, 64, 1000, 100_000
_TEXT = "struct<text:string>"
_RULE = f"struct<id:string,name:string,shortDescription:{_TEXT},fullDescription:{_TEXT},defaultConfiguration:struct<level:string>,properties:struct<`security-severity`:string,tags:array<string>>,helpUri:string>"
_REGION = f"struct<startLine:int,endLine:int,startColumn:int,endColumn:int,snippet:{_TEXT}>"
_RESULT = f"struct<ruleId:string,ruleIndex:int,rule:struct<id:string,index:int>,level:string,kind:string,message:{_TEXT},locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>,region:{_REGION}>>>,partialFingerprints:map<string,string>,suppressions:array<struct<kind:string,status:string>>,baselineState:string,properties:struct<`security-severity`:string,tags:array<string>>>"
_DRIVER = f"struct<name:string,rules:array<{_RULE}>>"
SCHEMA = f"struct<version:string,runs:array<struct<tool:struct<driver:{_DRIVER},extensions:array<{_DRIVER}>>,results:array<{_RESULT}>>>>"


_STRING_OR_BRACKET = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\Z)|([\[{])|([\]}])', re.S)


def _depth(text: str) -> int:
    """The deepest nesting of brackets outside strings; an unclosed string ends with the text."""
    steps = (1 if m.lastindex == 1 else -1 for m in _STRING_OR_BRACKET.finditer(text) if m.lastindex)
    return max(accumulate(steps, initial=0))


def _why(text: str | None) -> str | None:
    """Why a text is refused, None if it isn't."""
    if text is None or len(text) > MAX_BYTES:
        return "too large"
    if _depth(text) > MAX_DEPTH:
        return "nested too deeply"

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("a key occurs twice")
        return dict(items)

    try:
        doc = json.loads(text, object_pairs_hook=pairs)
    except ValueError as e:
        return str(e)
    runs = doc.get("runs") if isinstance(doc, dict) else None
    if not isinstance(runs, list):
        return "no runs"
    if len(runs) > MAX_RUNS or sum(len(r.get("results") or []) for r in runs if isinstance(r, dict)) > MAX_RESULTS:
        return "too many runs or results"
    return None


def checked(files: DataFrame) -> DataFrame:
    """files(path, text) with `refused`, the reason or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(refused=[_why(t) for t in b["text"]])

    return files.select("path", "text").mapInPandas(run, "path string, text string, refused string")


def refused(files: DataFrame) -> DataFrame:
    return checked(files).where("refused IS NOT NULL").select("path", "refused")


def read_sarif(files: DataFrame) -> DataFrame:
    """Findings of SARIF texts: severity by security-severity, then the result's level, then the rule's; confidence one step down.

    Suppressed, absent-baseline and passing results stay out. Control characters leave messages.
    """
    ok = checked(files).where("refused IS NULL").select(F.col("path").alias("file"), F.from_json("text", SCHEMA).alias("s"))
    runs = ok.select("file", F.posexplode("s.runs").alias("run", "r"))
    components = F.concat(F.array(F.col("r.tool.driver")), F.coalesce(F.col("r.tool.extensions"), F.array()))
    rules = F.flatten(F.transform(components, lambda c: F.coalesce(c["rules"], F.array())))
    results = runs.select("file", "run", F.col("r.tool.driver.name").alias("tool"), F.col("r.tool.driver.rules").alias("own"), rules.alias("rules"), F.posexplode("r.results").alias("at", "x"))
    index, name = F.coalesce("x.ruleIndex", "x.rule.index"), F.coalesce("x.ruleId", "x.rule.id")
    by_index = F.when(index >= 0, F.try_element_at("own", index + 1))
    by_id = F.try_element_at(F.filter("rules", lambda r: r["id"] == name), F.lit(1))
    results = results.withColumn("rule", F.coalesce(F.when(by_index["id"].eqNullSafe(name) | name.isNull(), by_index), by_id, by_index))
    kept = results.where(
        ~F.exists(F.coalesce("x.suppressions", F.array()), lambda s: F.coalesce(s["status"], F.lit("accepted")) == "accepted")
        & (F.coalesce("x.baselineState", F.lit("new")) != "absent")
        & F.coalesce("x.kind", F.lit("fail")).isin("fail", "open", "review")
    )
    score = F.coalesce(F.col("x.properties.security-severity"), F.col("rule.properties.security-severity")).try_cast("double")
    level = F.coalesce("x.level", "rule.defaultConfiguration.level", F.lit("warning"))
    severity = F.when(score >= 9, 4).when(score >= 7, 3).when(score >= 4, 2).when(score > 0, 1).when(score == 0, 0).when(level == "error", 3).when(level == "warning", 2).when(level == "note", 1).otherwise(0)
    place = F.try_element_at("x.locations", F.lit(1))["physicalLocation"]
    tags = F.concat(F.coalesce("x.properties.tags", F.array()), F.coalesce("rule.properties.tags", F.array()))
    cwe = F.array_distinct(F.transform(F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?i)cwe[-/_]?0*\d+"))), lambda t: F.concat(F.lit("CWE-"), F.regexp_extract(t, r"(?i)cwe[-/_]?0*(\d+)", 1))))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(place["artifactLocation"]["uri"], F.lit("(no location)")), r"^file://+", ""), r"^\./", "")
    clean = F.regexp_replace(F.coalesce("x.message.text", F.lit("")), r"\x1b\[[0-9;]*[A-Za-z]|[\x00-\x08\x0b-\x1f\x7f]", "")
    order = F.struct("file", "run", "at")
    out = kept.select(
        order.alias("place"), F.concat_ws(".", F.lower(F.regexp_replace("tool", r"[^A-Za-z0-9]+", "-")), F.coalesce(name, "rule.id", F.lit("unknown"))).alias("rule_id"), F.lower("tool").alias("scanner"),
        F.coalesce("rule.shortDescription.text", "rule.name", clean).alias("title"), clean.alias("message"), uri.alias("path"), place["region"]["startLine"].alias("start_line"), place["region"]["endLine"].alias("end_line"),
        place["region"]["startColumn"].alias("start_column"), place["region"]["endColumn"].alias("end_column"), place["region"]["snippet"]["text"].alias("snippet"), severity.cast("int").alias("severity"), F.lit(1).alias("confidence"),
        F.lit(2).alias("likelihood"), cwe.alias("cwe"), F.array(F.lit("imported")).alias("tags"), F.upper(F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?i)(CVE-\d{4}-\d+)", 1), F.lit(""))).alias("cve"),
        F.try_element_at(F.map_values(F.coalesce("x.partialFingerprints", F.create_map().cast("map<string,string>"))), F.lit(1)).alias("tool_fingerprint"),
    )
    return out

"""Merging imported reports with a scan's own findings and with each other, in the order of the reports."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import MERGE_LINES, keys

#: Advisory ids in rule ids: a fixed value.
ADVISORY = re.compile(r"\b(CVE-\d{4}-\d{4,}|GHSA(?:-[23456789cfghjmpqrvwx]{4}){3})\b", re.I)
#: The scanner of findings that are made of others; they are nothing's duplicate.
SYNTHETIC = "chains"
KEPT = "ordinal long, severity int, also_reported_by array<string>"
_KEPT = pa.schema([("ordinal", pa.int64()), ("severity", pa.int32()), ("also_reported_by", pa.list_(pa.string()))])


def merged_rows(rows: list[dict]) -> list[dict]:
    """What stays of one file's findings: own ones first, then each report in order meets what has stayed so far.

    It joins the closest finding of another scanner with a common advisory, or with a common weakness within
    MERGE_LINES; on a tie the earliest. Own findings stay; of two reports the graver one, then the surer one does.
    Candidates are found by advisory and by line, so a file with many findings takes no longer per finding.
    """
    kept: list[dict | None] = []
    by_line: dict[int, list[int]] = {}
    by_advisory: dict[str, list[int]] = {}

    def place(row: dict, at: int) -> None:
        kept[at] = row
        if row["start_line"] is not None:
            by_line.setdefault(row["start_line"], []).append(at)
        for a in row["ids"]:
            by_advisory.setdefault(a, []).append(at)

    def distance(a: dict, b: dict) -> int:
        return abs(a["start_line"] - b["start_line"]) if a["start_line"] is not None and b["start_line"] is not None else 0

    def record(stays: dict, goes: dict) -> None:
        for entry in [*goes["also"], f"{goes['scanner']}:{goes['rule_id']}"]:
            if entry not in stays["also"]:
                stays["also"].append(entry)
        stays["severity"] = max(stays["severity"], goes["severity"])

    for row in sorted(rows, key=lambda r: (r["imported"], r["ordinal"])):
        row["also"] = list(row["also_reported_by"] or ())
        row["ids"] = {m.upper() for m in ADVISORY.findall(row["rule_id"] or "")} | ({row["cve"].upper()} if row["cve"] else set())
        best = None
        if row["imported"] and row["scanner"] != SYNTHETIC:
            near = {i for a in row["ids"] for i in by_advisory.get(a, ()) if row["ids"] & kept[i]["ids"]}
            if row["start_line"] is not None:
                for line in range(row["start_line"] - MERGE_LINES, row["start_line"] + MERGE_LINES + 1):
                    near |= {i for i in by_line.get(line, ()) if kept[i]["start_line"] == line and set(kept[i]["cwe"] or ()) & set(row["cwe"] or ())}
            near = {i for i in near if kept[i]["scanner"] not in (row["scanner"], SYNTHETIC)}
            best = min(near, key=lambda i: (distance(kept[i], row), i), default=None)
        if best is None:
            kept.append(None)
            place(row, len(kept) - 1)
        elif kept[best]["imported"] and (row["severity"], row["confidence"]) > (kept[best]["severity"], kept[best]["confidence"]):
            record(row, kept[best])
            place(row, best)
        else:
            record(kept[best], row)
    return [{"ordinal": r["ordinal"], "severity": r["severity"], "also_reported_by": r["also"] or None} for r in kept]


def merge_reports(native: DataFrame, imported: DataFrame) -> DataFrame:
    """Own findings and those imported ones that are no duplicates, with also_reported_by and the graver severity.

    Ordinals are unique over both sides and give the order of reports. Findings of a file are merged in one task; a
    file's size bounds them.
    """
    none = F.lit(None).cast("array<string>")
    sides = [s.withColumn("also_reported_by", F.col("also_reported_by") if "also_reported_by" in s.columns else none).withColumn("imported", F.lit(flag)) for s, flag in ((native, False), (imported, True))]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    own = keys(native, imported)
    asked = both.select(*own, "ordinal", "imported", "scanner", "rule_id", "start_line", F.col("severity").cast("int").alias("severity"), F.col("confidence").cast("int").alias("confidence"), "cwe", "cve", "also_reported_by")

    def fold(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(merged_rows(table.to_pylist()), schema=_KEPT)

    stays = asked.groupBy(*own).applyInArrow(fold, KEPT)
    return both.drop("severity", "also_reported_by", "imported").join(stays, "ordinal")

"""JSON reports of scans as findings: a baseline or one side of a drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.model import SEVERITIES, rank

SCHEMA = """findings array<struct<rule_id:string,scanner:string,project:string,severity:string,fingerprint:string,
location:struct<path:string,start_line:int,end_line:int,snippet:string>>>"""


def read_reports(raw: DataFrame) -> DataFrame:
    """Findings of reports (file, text, an object with a list of findings): file, ordinal, project, rule_id, scanner, path, start_line, end_line, snippet, severity, fingerprint.

    Severities are labels or ranks. A text that is no such object gives no row: see refused().
    """
    rows = raw.select("file", F.from_json("text", SCHEMA).alias("r")).select("file", F.posexplode("r.findings").alias("ordinal", "f"))
    level = F.coalesce(rank(F.col("f.severity"), SEVERITIES), F.col("f.severity").try_cast("int"))
    place = F.col("f.location")
    own = scoring.fingerprint(F.col("f.rule_id"), place["path"], place["snippet"], place["start_line"])
    out = rows.select("file", "ordinal", "f.project", "f.rule_id", "f.scanner", place["path"].alias("path"), place["start_line"].alias("start_line"), place["end_line"].alias("end_line"), place["snippet"].alias("snippet"), level.alias("severity"), F.coalesce("f.fingerprint", own).alias("fingerprint"))
    return out.where("rule_id IS NOT NULL AND path IS NOT NULL")


def refused(raw: DataFrame) -> DataFrame:
    """Files whose text is no object with a list of findings, so that a broken baseline isn't taken for an empty one."""
    return raw.where(F.from_json("text", SCHEMA)["findings"].isNull()).select("file")

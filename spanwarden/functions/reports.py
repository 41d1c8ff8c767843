"""Report formats from findings. Texts of one file are assembled in Spark as far as they are tables (JSON,
CSV, SARIF, SBOM); JUnit, Markdown and HTML are made of one text row a finding, and hold every finding."""

from __future__ import annotations

import html as escaping
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scoring
from .model import CONFIDENCES, SEVERITIES, label
from .store import keep

#: Columns of the CSV report, in order; SARIF levels and scores by severity: fixed values.
CSV = ("id", "rule_id", "scanner", "severity", "confidence", "likelihood", "risk_score", "title", "path", "start_line", "cwe", "owasp", "tags", "fingerprint")
LEVELS = ("note", "note", "warning", "error", "error")
SCORES = ("0.0", "3.0", "5.5", "8.0", "9.5")


def _named(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity_name", label(F.col("severity"), SEVERITIES)).withColumn("confidence_name", label(F.col("confidence"), CONFIDENCES))


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def csv_rows(findings: DataFrame) -> DataFrame:
    """The fixed columns, arrays joined by semicolons; absent ones are empty."""
    out = []
    for c in CSV:
        if c not in findings.columns:
            out.append(F.lit(None).cast("string").alias(c))
        elif dict(findings.dtypes)[c].startswith("array"):
            out.append(F.array_join(c, ";").alias(c))
        elif c == "severity":
            out.append(label(F.col(c), SEVERITIES).alias(c))
        else:
            out.append(F.col(c))
    return findings.select(*out)


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).csv(path)


def percent_encoded(path: Column) -> Column:
    """A path as a URI: everything but unreserved characters and slashes in hex of its bytes."""
    chars = F.filter(F.split(path, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.when(F.rlike(c, F.lit(r"^[A-Za-z0-9_.~/-]$")), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1"))), "")


#: Results of a SARIF document, about.
RESULTS = 20_000


def sarif(findings: DataFrame, tool: str = "spanwarden", version: str = "1", by: list[str] | None = None) -> DataFrame:
    """`part` and `sarif`, after the columns of `by`: documents of about RESULTS results, each a whole run with the rules
    it needs in first-seen order and its results in ordinal order. A file's results are in one part; a group of few
    has part 0 alone.
    """
    by = by or []
    findings = keep(findings, "sarif")  # read for parts, rules and results
    if by:
        parts = findings.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(float(RESULTS))).alias("__parts"))
        findings = findings.join(parts, by)
    else:
        findings = findings.withColumn("__parts", F.lit(max(1, -(-findings.count() // RESULTS))))
    findings = findings.withColumn("part", F.pmod(F.xxhash64("path"), F.col("__parts")).cast("int")).drop("__parts")
    by = [*by, "part"]
    first = findings.groupBy(*by, "rule_id").agg(F.min("ordinal").alias("first"), F.max("severity").alias("severity"))
    first = first.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy("first")) - 1)  # a row a rule
    levels, scores = F.array(*map(F.lit, LEVELS)), F.array(*map(F.lit, SCORES))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.element_at(levels, F.col("severity") + 1).alias("level")).alias("defaultConfiguration"), F.struct(F.element_at(scores, F.col("severity") + 1).alias("security-severity")).alias("properties"))
    rules = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", rule.alias("rule")))), lambda x: x["rule"]).alias("rules"))
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")))
    place = F.array(F.struct(F.struct(F.struct(percent_encoded(F.col("path")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    body = F.struct(F.col("rule_id").alias("ruleId"), F.col("index").alias("ruleIndex"), F.element_at(levels, F.col("severity") + 1).alias("level"), F.struct(F.coalesce("snippet", "rule_id").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    results = findings.join(first.select(*by, "rule_id", "index"), [*by, "rule_id"]).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", body.alias("r")))), lambda x: x["r"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return rules.join(results, by).select(*by, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def gitlab(findings: DataFrame) -> DataFrame:
    """Rows of a GitLab report: ids stay unique by an occurrence number."""
    n = F.row_number().over(Window.partitionBy("fingerprint").orderBy("ordinal"))
    key = F.when(n == 1, F.col("fingerprint")).otherwise(F.concat_ws("#", "fingerprint", n.cast("string")))
    name = F.element_at(F.array(*map(F.lit, ("Info", "Low", "Medium", "High", "Critical"))), F.col("severity") + 1)
    return findings.withColumn("__key", key).select(F.sha2("__key", 256).alias("id"), F.lit("sast").alias("category"), F.col("rule_id").alias("name"), name.alias("severity"), F.col("path").alias("file"), "start_line", "end_line")


def escaped(text: Column) -> Column:
    """Text as content of XML and HTML."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def md_escaped(text: Column) -> Column:
    """Markdown's own characters, line ends and control characters made harmless."""
    shown = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}]", "")
    return F.regexp_replace(shown, r"([\\`*_{}\[\]<>()#+\-.!|])", r"\\$1")


WORST_FIRST = (("severity", False), ("risk_score", False), ("ordinal", True))
IN_ORDER = (("ordinal", True),)


def _sorted(rows: DataFrame, order: tuple[tuple[str, bool], ...], first: str | None = None) -> DataFrame:
    return rows.orderBy(*([first] if first else []), *(F.asc(c) if up else F.desc(c) for c, up in order))


def _lines(findings: DataFrame, text: Column, order: tuple[tuple[str, bool], ...]) -> DataFrame:
    return _sorted(_named(findings).select(*(c for c, _ in order), text.alias("text")), order)


def _joined(lines: DataFrame) -> str:
    return "".join(r.text for r in lines.select("text").toLocalIterator())


def _place(none: str) -> Column:
    return F.concat("path", F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit(none)))


def write_text(lines: DataFrame, order: tuple[tuple[str, bool], ...], head: str, tail: str, path: str) -> None:
    """A report as text files in the folder path: the head, all lines in order, the tail. Spark writes it; no machine holds it.

    Files are in the order of their names; a line of the files is a row of text.
    """
    spark = lines.sparkSession
    ends = spark.createDataFrame([(0, head), (2, tail)], "place int, text string").where("text <> ''")
    rows = lines.withColumn("place", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    _sorted(rows.withColumn("text", F.regexp_replace("text", r"\n$", "")), order, "place").select("text").write.mode("overwrite").text(path)


def junit_lines(findings: DataFrame) -> DataFrame:
    """A row for each finding in ordinal order: its test case as text, with the columns that order it."""
    case = F.concat(F.lit('<testcase classname="'), escaped(F.col("scanner")), F.lit('" name="'), escaped(F.col("rule_id")), F.lit('"><failure message="'), escaped(F.col("severity_name")), F.lit('">'), escaped(_place("None")), F.lit("</failure></testcase>"))
    return _lines(findings, case, IN_ORDER)


def _junit_ends(findings: DataFrame) -> tuple[str, str]:
    n = findings.count()
    return f'<?xml version="1.0" encoding="UTF-8"?><testsuite name="security" tests="{n}" failures="{n}">', "</testsuite>"


def junit(findings: DataFrame) -> str:
    """The whole report as one string, for reports of a size that the driver can hold; else write_junit."""
    head, tail = _junit_ends(findings)
    return head + _joined(junit_lines(findings)) + tail


def write_junit(findings: DataFrame, path: str) -> None:
    write_text(junit_lines(findings), IN_ORDER, *_junit_ends(findings), path)


def markdown_lines(findings: DataFrame) -> DataFrame:
    """A row for each finding, the worst first: its table row as text, with the columns that order it."""
    place = F.concat(md_escaped(F.col("path")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("")))
    return _lines(findings, F.concat(F.lit("| "), "severity_name", F.lit(" | "), md_escaped(F.col("rule_id")), F.lit(" | "), place, F.lit(" | "), F.col("risk_score").cast("string"), F.lit(" |\n")), WORST_FIRST)


def _markdown_head(findings: DataFrame, target: str) -> str:
    title = findings.sparkSession.range(1).select(md_escaped(F.lit(target)).alias("t")).first().t
    return f"# Security report {title}\n\n| severity | rule | place | risk |\n|---|---|---|---|\n"


def markdown(findings: DataFrame, target: str = "") -> str:
    """The whole report as one string, for reports of a size that the driver can hold; else write_markdown."""
    return _markdown_head(findings, target) + _joined(markdown_lines(findings))


def write_markdown(findings: DataFrame, path: str, target: str = "") -> None:
    write_text(markdown_lines(findings), WORST_FIRST, _markdown_head(findings, target), "", path)


def html_lines(findings: DataFrame) -> DataFrame:
    """A row for each finding, the worst first: its table row as text, with the columns that order it."""
    cells = (F.col("severity_name"), escaped(F.col("rule_id")), escaped(_place("")), F.col("risk_score").cast("string"))
    return _lines(findings, F.concat(F.lit("<tr>"), *(x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))), F.lit("</tr>")), WORST_FIRST)


def _html_ends(target: str) -> tuple[str, str]:
    return f"<!DOCTYPE html><title>Security report</title><h1>{escaping.escape(target)}</h1><table>", "</table>"


def html(findings: DataFrame, target: str = "") -> str:
    """The whole report as one string, for reports of a size that the driver can hold; else write_html."""
    head, tail = _html_ends(target)
    return head + _joined(html_lines(findings)) + tail


def write_html(findings: DataFrame, path: str, target: str = "") -> None:
    write_text(html_lines(findings), WORST_FIRST, *_html_ends(target), path)


#: Report formats by name: (findings, path) to files of the folder path.
REPORTERS: dict[str, Callable[[DataFrame, str], None]] = {"json": write_json, "csv": write_csv, "junit": write_junit, "markdown": write_markdown, "html": write_html}


def register(name: str, write: Callable[[DataFrame, str], None]) -> None:
    """Adds a report format of one's own; its name must be free."""
    if name in REPORTERS:
        raise ValueError(f"a reporter {name} is there already")
    REPORTERS[name] = write


def report(findings: DataFrame, name: str, path: str) -> None:
    """Writes findings in a format by its name."""
    if name not in REPORTERS:
        raise ValueError(f"no such reporter: {name}")
    REPORTERS[name](findings, path)


def badge(findings: DataFrame) -> DataFrame:
    """One row: label, message and colour by the worst severity that occurs."""
    worst = F.max("severity")
    name = F.when(worst.isNull(), "passing").otherwise(F.lower(label(worst, SEVERITIES)))
    colour = F.when(worst.isNull(), "brightgreen").when(worst >= 4, "red").when(worst == 3, "orange").when(worst == 2, "yellow").otherwise("green")
    return findings.agg(F.lit("security").alias("label"), name.alias("message"), colour.alias("color"))


def vex(matches: DataFrame) -> DataFrame:
    """Distinct (cve, purl) statements: not_affected just where the package isn't imported."""
    rows = matches.where("cve IS NOT NULL").withColumn("purl", scoring.purl(F.col("ecosystem"), F.col("package"), F.col("version")))
    status = F.when(F.bool_and(F.col("reachability").eqNullSafe("not_imported")), "not_affected").otherwise("affected")
    return rows.groupBy("cve", "purl").agg(status.alias("status"))


def cyclonedx(packages: DataFrame, serial: str, by: list[str] | None = None) -> DataFrame:
    """One row, `bom`, or one for each group of `by`: a CycloneDX 1.5 document of distinct packages; references are 32 hex digits of SHA-256."""
    by = by or []
    p = packages.select(*by, "ecosystem", "package", "version").distinct().withColumn("purl", scoring.purl(F.col("ecosystem"), F.col("package"), F.col("version")))
    part = F.struct(F.col("purl").alias("key"), F.struct(F.lit("library").alias("type"), F.substring(F.sha2("purl", 256), 1, 32).alias("bom-ref"), F.col("package").alias("name"), "version", "purl").alias("c"))
    return p.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["c"]).alias("components")).select(*by, F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(serial).alias("serialNumber"), F.lit(1).alias("version"), "components")).alias("bom"))


def spdx(packages: DataFrame, namespace: str, created: datetime | None = None) -> DataFrame:
    """One row, `bom`: an SPDX 2.3 document."""
    when = (created or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    p = packages.select("ecosystem", "package", "version").distinct().withColumn("purl", scoring.purl(F.col("ecosystem"), F.col("package"), F.col("version")))
    ref = F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))
    part = F.struct(F.col("purl").alias("key"), F.struct(F.concat(F.lit("SPDXRef-"), F.substring(F.sha2("purl", 256), 1, 32)).alias("SPDXID"), F.col("package").alias("name"), F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.array(ref).alias("externalRefs")).alias("c"))
    head = [F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.lit(namespace).alias("documentNamespace"), F.struct(F.lit(when).alias("created")).alias("creationInfo")]
    return p.agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["c"]).alias("packages")).select(F.to_json(F.struct(*head, "packages")).alias("bom"))


def sbom_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Purls of two package tables: added or removed."""

    def purls(p: DataFrame) -> DataFrame:
        return p.select(scoring.purl(F.col("ecosystem"), F.col("package"), F.col("version")).alias("purl")).distinct()

    a, b = purls(old), purls(new)
    return b.join(a, "purl", "left_anti").withColumn("change", F.lit("added")).union(a.join(b, "purl", "left_anti").withColumn("change", F.lit("removed")))


def push_payload(findings: DataFrame, target: str) -> DataFrame:
    """One row, `payload`: findings from LOW on and lower-case counts."""
    real = findings.where("severity >= 1")
    counts = F.struct(*(F.count_if(F.col("severity") == i).alias(n.lower()) for i, n in enumerate(SEVERITIES)))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct("rule_id", "path", "start_line", "fingerprint").alias("f")))), lambda x: x["f"])
    return real.agg(F.to_json(F.struct(F.lit(target).alias("target"), counts.alias("counts"), rows.alias("findings"))).alias("payload"))

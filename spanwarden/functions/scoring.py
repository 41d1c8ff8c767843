"""Scalar formulas over findings, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import HIGH, LOW, MEDIUM

#: Python's white space for str patterns, as a Java class.
WHITE = r"(?U)[\s\x1c-\x1f]+"
STATES = ("verified", "confirmed", "fixed", "accepted", "false_positive", "likely", "detected")
CONFIRMING = ("secret_verify", "dast", "host", "fim", "container-image")


def risk_score(severity: Column, confidence: Column, likelihood: Column) -> Column:
    """0 to 100 in one decimal, halves to even."""
    weight = F.lit(0.6) + F.lit(0.25) * (confidence + 1) / F.lit(3.0) + F.lit(0.15) * (likelihood + 1) / F.lit(5.0)
    return F.bround(F.lit(100.0) * (severity / F.lit(4.0)) * weight, 1)


def fingerprint(rule_id: Column, path: Column, snippet: Column, line: Column, tool: Column | None = None) -> Column:
    """rule|path|digest of the snippet without white space, or of the line where the snippet is blank.

    tool: the digest that an importing tool gave, which comes first.
    """
    bare = F.regexp_replace(F.coalesce(snippet, F.lit("")), WHITE, "")
    own = F.when(bare != "", F.substring(F.sha1(bare), 1, 12)).otherwise(F.concat(F.lit("L"), F.coalesce(line.cast("string"), F.lit("None"))))
    return F.concat_ws("|", rule_id, path, own if tool is None else F.coalesce(tool, own))


def contextual_risk(base: Column, severity: Column, reachable: Column, chained: Column, exposed: Column, production: Column, exploited: Column, verified: Column) -> Column:
    """The base and its boosts, at most 100."""

    def add(when: Column, points: float) -> Column:
        return F.when(when, F.lit(float(points))).otherwise(F.lit(0.0))

    boost = add(severity >= HIGH, 10) + add(reachable, 15) + add(chained, 20) + add(exposed & (severity >= MEDIUM), 10)
    return F.least(F.lit(100.0), F.bround(base + boost + add(production, 5) + add(exploited, 12) + add(verified, 8), 1))


def verification_state(scanner: Column, confidence: Column, existing: Column, fixed: Column, dynamic: Column, evidence: Column) -> Column:
    """The first state whose condition holds."""
    return (
        F.when(fixed, "fixed")
        .when(existing.isin(*STATES), existing)
        .when(dynamic, "verified")
        .when(scanner.isin(*CONFIRMING), "confirmed")
        .when((confidence >= 2) & evidence, "confirmed")
        .when(confidence >= 1, "likely")
        .otherwise("detected")
    )


def risk_band(risk: Column) -> Column:
    return F.when(risk >= 75, "Critical").when(risk >= 50, "High").when(risk >= 25, "Medium").when(risk > 0, "Low").otherwise("None")


def posture(total: Column, errors: Column, highest: Column, gate: Column) -> Column:
    """CLEAN, FAIL, REVIEW or PASS; gate is null where none is set."""
    return (
        F.when((total == 0) & (errors == 0), "CLEAN")
        .when(gate.isNotNull() & (total > 0) & (highest >= gate), "FAIL")
        .when((total > 0) & (highest >= HIGH), "REVIEW")
        .when((total > 0) & (highest >= LOW), F.when(gate.isNotNull(), "PASS").otherwise("REVIEW"))
        .otherwise("CLEAN")
    )


def aggregate_risk(top: Column, total: Column, n: Column) -> Column:
    """The highest score and a share of the rest, from max, sum and count of the scores."""
    return F.when(n > 0, F.least(F.lit(100.0), F.bround(top + (total - top) / (F.lit(20.0) * n), 1))).otherwise(F.lit(0.0))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda c: c == d)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def redacted(secret: Column) -> Column:
    """The first three characters and how many there were."""
    return F.concat(F.substring(secret, 1, 3), F.lit("… [redacted, "), F.char_length(secret).cast("string"), F.lit(" chars]"))


def version_key(version: Column) -> Column:
    """Leading digits of the parts between dots, dashes and pluses, up to the first part without, which counts 0."""
    digits = F.transform(F.split(version, r"[.+-]"), lambda p: F.regexp_extract(p, r"^(\d{1,18})", 1))
    stop = F.array_position(digits, "")
    heads = F.when(stop > 0, F.slice(digits, F.lit(1), stop.cast("int"))).otherwise(digits)
    return F.transform(heads, lambda p: F.when(p == "", F.lit(0)).otherwise(p.cast("long")).cast("long"))


def clause(text: Column) -> tuple[Column, Column]:
    """The comparison of a clause, blank for a bare version, and its version's key."""
    op = F.regexp_extract(F.trim(text), r"^(<=|>=|==|<|>)?", 1)
    return op, version_key(F.trim(F.regexp_replace(F.trim(text), r"^(<=|>=|==|<|>)", "")))


def meets(own: Column, op: Column, bound: Column) -> Column:
    """Does a version's key stand to a bound as the comparison says?"""
    return F.when(op == "<=", own <= bound).when(op == "<", own < bound).when(op == ">=", own >= bound).when(op == ">", own > bound).otherwise(own == bound)


def in_range(version: Column, vulnerable: Column) -> Column:
    """Does a version meet a clause: <=, <, >=, > or == and a version, or a bare version for equality?"""
    return meets(version_key(version), *clause(vulnerable))


def package_name(ecosystem: Column, name: Column) -> Column:
    """PyPI names with one dash for runs of dash, underscore and dot; all in lower case."""
    return F.lower(F.when(F.lower(ecosystem) == "pypi", F.regexp_replace(name, r"[-_.]+", "-")).otherwise(name))


def import_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[-_.]+", "_"))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """A package URL."""
    kind = F.lower(ecosystem)
    kind = F.when(kind == "go", "golang").when(kind == "packagist", "composer").when(kind.isin("crates.io", "rust"), "cargo").when(kind == "rubygems", "gem").otherwise(kind)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), name, F.lit("@"), version)


#: Weights of the CVSS 3 base metrics: fixed values of the published standard.
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR changed": {"N": 0.85, "L": 0.68, "H": 0.5},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
}


def _weight(metric: Column, table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), metric)


def cvss_score(vector: Column) -> Column:
    """The base score of a CVSS 3 vector, of a bare number the number; null for anything else."""
    parts = F.str_to_map(F.regexp_replace(F.upper(F.trim(vector)), r"^CVSS:3\.[01]/", ""), F.lit("/"), F.lit(":"))

    def metric(k: str) -> Column:
        return F.element_at(parts, k)

    changed = metric("S") == "C"
    privileges = F.when(changed, _weight(metric("PR"), CVSS["PR changed"])).otherwise(_weight(metric("PR"), CVSS["PR"]))
    ease = F.lit(8.22) * _weight(metric("AV"), CVSS["AV"]) * _weight(metric("AC"), CVSS["AC"]) * privileges * _weight(metric("UI"), CVSS["UI"])
    iss = F.lit(1.0) - (F.lit(1.0) - _weight(metric("C"), CVSS["CIA"])) * (F.lit(1.0) - _weight(metric("I"), CVSS["CIA"])) * (F.lit(1.0) - _weight(metric("A"), CVSS["CIA"]))
    impact = F.when(changed, F.lit(7.52) * (iss - 0.029) - F.lit(3.25) * F.pow(F.greatest(iss - 0.02, F.lit(0.0)), F.lit(15.0))).otherwise(F.lit(6.42) * iss)
    total = F.when(changed, F.lit(1.08) * (impact + ease)).otherwise(impact + ease)
    raw = F.when(total.isNotNull(), F.least(F.lit(10.0), total))  # least() alone would skip a null
    # the standard's round-up: to the next tenth, over integers
    scaled = F.round(raw * 100000, 0).cast("long")
    up = F.when(scaled % 10000 == 0, scaled / F.lit(100000.0)).otherwise((F.floor(scaled / F.lit(10000.0)) + 1) / F.lit(10.0))
    return F.coalesce(F.when((impact <= 0) & ease.isNotNull(), F.lit(0.0)).when(raw.isNotNull(), up), F.trim(vector).try_cast("double"))


def cvss_band(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW").otherwise("MEDIUM")


def rule_matches(rule_id: Column, target: Column) -> Column:
    """Equal, or the target after a dot at the end."""
    return (rule_id == target) | F.endswith(rule_id, F.concat(F.lit("."), target))


def glob_regex(pattern: Column) -> Column:
    """A file glob (* ? [..]) column as a regular expression for the whole path; * crosses slashes."""
    quoted = F.regexp_replace(pattern, r"([.^$+{}()|\\])", r"\\$1")
    return F.concat(F.lit("^(?s:"), F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), r"\[!", "[^"), F.lit(")$"))


def path_matches(path: Column, pattern: Column) -> Column:
    """The glob on the path or on its last name, or a folder's /** before it."""
    expr = glob_regex(pattern)
    inside = F.endswith(pattern, F.lit("/**")) & F.startswith(path, F.substring(pattern, F.lit(1), F.greatest(F.length(pattern) - 2, F.lit(0))))
    return F.rlike(path, expr) | F.rlike(F.element_at(F.split(path, "/"), -1), expr) | inside

"""Grades of pattern findings by data flow: is what a call takes made from literals only, from input, or from something unknown?

Assignments of a file give each name a verdict by constant propagation to a fixed point: tainted if any value holds
input or a tainted name, literal if all values are made from literals and literal names only, else unknown. Calls have
their whole arguments, over as many lines as they take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.code import STRINGS, calls, extents, tokens
from ..sources.files import line_array
from .blocks import TAINT_SOURCE
from .findings import same

#: Rules that are graded, and the calls that they are about.
SHELL = ("patterns.python-shell-true", "patterns.python-os-system")
LOADS = ("patterns.python-pickle-loads",)
YAML = ("patterns.python-yaml-load",)
CALLEES = r"^(?:subprocess\.\w+|os\.(?:system|popen)|(?:c?[pP]ickle|dill|marshal)\.loads?|yaml\.\w*load\w*)$"
ASSIGN = r"^\s*([A-Za-z_]\w*)\s*(?::[^=\n]+)?(\+?=)(?!=)\s*(.+)$"
#: Names that an expression takes: not attributes, keywords or names of arguments; words of the language are none.
NAME = r"(?<![\w.'\"])([A-Za-z_]\w*)(?!\w*\s*=(?!=))"
WORDS = ("True", "False", "None", "and", "or", "not", "in", "is", "if", "else", "for", "lambda")


def verdicts(steps: list) -> list[tuple[str, str]]:
    """(name, verdict) of a file's assignments (name, tainted, known, names). known: nothing but literals and names is in the value."""
    of: dict[str, list] = {}
    for s in steps:
        of.setdefault(s["name"], []).append(s)
    have = {n: "literal" for n in of}  # falls to unknown, then to tainted
    changed = True
    while changed:
        changed = False
        for name, values in of.items():
            kinds = [have.get(n, "unknown") for s in values for n in s["names"]]
            new = "tainted" if any(s["tainted"] for s in values) or "tainted" in kinds else "unknown" if not all(s["known"] for s in values) or "unknown" in kinds else "literal"
            if new != have[name] and not (have[name] == "tainted"):
                have[name], changed = new, True
    return list(have.items())


def _names(value: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(value, r"(?<!\w)[bfruBFRU]{1,2}(?=['\"])", ""), STRINGS, " ' ")
    held = F.flatten(F.transform(F.regexp_extract_all(value, F.lit(r"[fF](?:\"[^\"\n]*\"|'[^'\n]*')"), F.lit(0)), lambda s: F.regexp_extract_all(s, F.lit(r"\{\s*([A-Za-z_]\w*)"), F.lit(1))))
    return F.filter(F.array_distinct(F.concat(F.regexp_extract_all(bare, F.lit(NAME), F.lit(1)), held)), lambda n: ~n.isin(*WORDS))


def _calls_something(value: Column) -> Column:
    """Does an expression call, index or read an attribute: can't its value be told from its names?"""
    return F.rlike(F.regexp_replace(value, STRINGS, " ' "), F.lit(r"[\w\])]\s*[(\[]|\w\.\w|\bawait\b|\blambda\b"))


def line_verdicts(files: DataFrame) -> DataFrame:
    """project, path, line, kind (shell, loads or yaml), verdict of the calls of Python files."""
    python = files.where("language = 'Python'").select("project", "path", "language", "text")

    def step(line: Column) -> Column:
        value = F.regexp_extract(line, ASSIGN, 3)
        return F.when(F.rlike(line, F.lit(ASSIGN)), F.struct(F.regexp_extract(line, ASSIGN, 1).alias("name"), F.rlike(value, F.lit(TAINT_SOURCE)).alias("tainted"), (~_calls_something(value)).alias("known"), F.concat(_names(value), F.when(F.regexp_extract(line, ASSIGN, 2) == "+=", F.array(F.regexp_extract(line, ASSIGN, 1))).otherwise(F.array().cast("array<string>"))).alias("names")))

    steps = F.filter(F.transform(line_array(F.col("text")), step), lambda x: x.isNotNull())
    fold = F.udf(verdicts, "array<struct<name:string,verdict:string>>")
    known = python.select("project", "path", fold(steps).alias("names"))
    found = calls(python, extents(tokens(python)), F.rlike("callee", F.lit(CALLEES)))
    kind = F.when(F.rlike("callee", F.lit(r"^yaml\.")), "yaml").when(F.rlike("callee", F.lit("loads?$")), "loads").otherwise("shell")
    payload = F.regexp_replace("args", r",?\s*(?:shell|Loader|capture_output|text|check|timeout|stdout|stderr|encoding)\s*=\s*[\w.]+", "")
    found = found.select("project", "path", "line", kind.alias("kind"), payload.alias("payload"), _names(payload).alias("asked"))
    met = found.alias("c").join(known.alias("k"), same(["project", "path"], "c", "k"), "left")
    own = F.transform("c.asked", lambda n: F.coalesce(F.try_element_at(F.transform(F.filter("k.names", lambda x: x["name"] == n), lambda x: x["verdict"]), F.lit(1)), F.lit("unknown")))
    verdict = F.when(F.rlike("c.payload", F.lit(TAINT_SOURCE)) | F.array_contains(own, "tainted"), "tainted").when(_calls_something(F.col("c.payload")) | F.array_contains(own, "unknown"), "unknown").otherwise("literal")
    rows = met.select("c.project", "c.path", "c.line", "c.kind", verdict.alias("verdict"))
    # of several calls of one kind on a line the worst counts
    rank = F.when(F.col("verdict") == "tainted", 2).when(F.col("verdict") == "unknown", 1).otherwise(0)
    return rows.groupBy("project", "path", "line", "kind").agg(F.max_by("verdict", rank).alias("verdict"))


def graded(findings: DataFrame, of: DataFrame) -> DataFrame:
    """findings after verdicts (project, path, line, kind, verdict) of their lines.

    Shell calls and pickles of literals go. YAML of input is sure, of literals LOW and unsure; an unknown origin changes nothing.
    """
    rule = F.col("rule_id")
    kind = F.when(rule.isin(*SHELL), "shell").when(rule.isin(*LOADS), "loads").when(rule.isin(*YAML), "yaml")
    asked = findings.withColumn("kind", kind)
    on = same(["project", "path", "kind"], "f", "v") & (F.col("f.start_line") == F.col("v.line"))
    met = asked.alias("f").join(of.alias("v"), on, "left").select("f.*", "v.verdict")
    yaml, literal = F.col("kind") == "yaml", F.col("verdict") == "literal"
    met = met.where(~F.coalesce(literal & ~yaml, F.lit(False)))
    met = met.withColumn("severity", F.when(yaml & literal, 1).otherwise(F.col("severity"))).withColumn("confidence", F.when(yaml & literal, 0).when(yaml & (F.col("verdict") == "tainted"), 2).otherwise(F.col("confidence")))
    return met.drop("kind", "verdict")

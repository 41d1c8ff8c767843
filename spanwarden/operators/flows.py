"""Data flow between the lines of a file by joins: names assigned from a source, through further assignments,
to lines where a sink takes them. Serves JavaScript and language-model code, where no parser is at hand.

Names are as wide as a file; a value that a sanitizer has touched on its way is clean. Chains have any
length: the assignments of one file are followed in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import CRITICAL, HIGH, MEDIUM
from ..sources.files import has, line_array, pieces, text_has
from .blocks import finding

ASSIGN = r"^\s*(?:export\s+)?(?:const\s+|let\s+|var\s+)?([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=(?!=)\s*(.+)$"
NAME = r"(?<![\w$.])([A-Za-z_$][\w$]*)"


def reached(assigned: list) -> list[str]:
    """The names that a source reaches through a file's assignments: rows of name, direct (holds a source), names (that it takes)."""
    takers: dict[str, list[str]] = {}
    for a in assigned:
        for n in a.names:
            takers.setdefault(n, []).append(a.name)
    todo = [a.name for a in assigned if a.direct]
    seen = set(todo)
    while todo:
        for name in takers.get(todo.pop(), ()):
            if name not in seen:
                seen.add(name)
                todo.append(name)
    return sorted(seen)


@dataclass(frozen=True)
class Sink:
    rule: str
    pattern: str  # its last part opens the arguments; what stands after it is looked at
    severity: int
    cwe: tuple[str, ...]
    clean: str = ""


def flow(files: DataFrame, source: str, sinks: tuple[Sink, ...], scanner: str, clean: str, confidence: int = 1) -> DataFrame:
    """Findings of sinks whose arguments hold a source or a name that one reached.

    A file's lines are an array of its row: assignments and sinks are read from it in one pass, without a shuffle.
    """
    key = ["project", "path"]

    def assigned(line: Column) -> Column:
        value = F.regexp_extract(line, ASSIGN, 2)
        takes = F.rlike(line, F.lit(ASSIGN)) & ~F.rlike(value, F.lit(clean))
        return F.when(takes, F.struct(F.regexp_extract(line, ASSIGN, 1).alias("name"), has(value, source).alias("direct"), F.array_distinct(F.regexp_extract_all(value, F.lit(NAME), F.lit(1))).alias("names")))

    def opened(s: Sink, text: Column) -> Column:
        hit = F.rlike(text, F.lit(s.pattern)) & ~F.rlike(text, F.lit(clean))
        if s.clean:
            hit = hit & ~F.rlike(text, F.lit(s.clean))
        return F.when(hit, F.struct(F.lit(s.rule).alias("rule"), F.lit(s.severity).alias("severity"), F.array(*map(F.lit, s.cwe)).alias("cwe"), F.regexp_extract(text, f"(?:{s.pattern})(.*)$", 1).alias("rest")))

    def sunk(line: Column, at: Column) -> Column:
        found = F.flatten(F.transform(pieces(line), lambda w: F.filter(F.array(*(opened(s, w["segment"]) for s in sinks)), lambda x: x.isNotNull())))
        return F.transform(found, lambda x: F.struct((at + 1).alias("line"), line.alias("content"), x["rule"].alias("rule"), x["severity"].alias("severity"), x["cwe"].alias("cwe"), x["rest"].alias("rest")))

    of = files.select(*key, line_array(F.col("text")).alias("lines"))
    of = of.select(*key, F.flatten(F.transform("lines", sunk)).alias("hits"), "lines").where(F.size("hits") > 0)
    of = of.select(*key, "hits", F.filter(F.transform("lines", assigned), lambda x: x.isNotNull()).alias("steps"))
    of = of.withColumn("reached", F.udf(reached, "array<string>")(F.when(F.exists("steps", lambda x: x["direct"]), F.col("steps")).otherwise(F.slice("steps", 1, 0))))
    met = of.select(*key, "reached", F.explode("hits").alias("h")).select(*key, "reached", "h.*")
    names = F.regexp_extract_all("rest", F.lit(NAME), F.lit(1))
    met = met.where(F.rlike("rest", F.lit(source)) | F.arrays_overlap(names, "reached"))
    return finding(met, F.col("rule"), scanner, F.col("severity"), F.col("cwe"), confidence).distinct()


JS_SOURCE = r"\breq(?:uest)?\.(?:query|params|body|headers|cookies|url)\b|\blocation\.(?:hash|search|href)\b|\bprocess\.argv\b|document\.(?:cookie|referrer)"
JS_CLEAN = r"(?i)parseInt\(|Number\(|encodeURIComponent\(|DOMPurify|sanitize|escapeHtml|path\.basename\(|validator\."
JS_SINKS = (
    Sink("ast-js.ast-sql-injection", r"\.(?:query|execute|raw)\(", HIGH, ("CWE-89",), r"\.(?:query|execute)\(\s*['\"][^'\"]*['\"]\s*,"),
    Sink("ast-js.ast-command-injection", r"\b(?:exec|execSync|spawn|spawnSync)\(", HIGH, ("CWE-78",)),
    Sink("ast-js.ast-path-traversal", r"\b(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream|sendFile|unlink)\(", MEDIUM, ("CWE-22",)),
    Sink("ast-js.ast-code-injection", r"\beval\(|new\s+Function\(", HIGH, ("CWE-95",)),
    Sink("ast-js.ast-xss", r"\.(?:innerHTML|outerHTML)\s*=|document\.write\(|\bres\.(?:send|write)\(", MEDIUM, ("CWE-79",)),
)

MODEL_CALL = r"(?i)\b(?:client|openai|anthropic|llm|model|chain|agent|completion|chat)[\w.]*\.(?:create|invoke|generate\w*|predict|run|complete|call)\(|\b(?:llm|chain|agent)\("
LLM_CLEAN = r"(?i)ast\.literal_eval|json\.loads|html\.escape|shlex\.quote|bleach\.clean|sanitize|allowlist|DOMPurify"
LLM_SINKS = (
    Sink("llm.insecure-output-handling", r"\b(?:eval|exec)\(", CRITICAL, ("CWE-95",)),
    Sink("llm.insecure-output-handling", r"os\.(?:system|popen)\(|subprocess\.\w+\(|child_process\.\w+\(|\bexecSync\(", CRITICAL, ("CWE-78",)),
    Sink("llm.insecure-output-handling", r"\.(?:execute|executemany|query|raw)\(", HIGH, ("CWE-89",)),
    Sink("llm.insecure-output-handling", r"(?:Markup|mark_safe|render_template_string)\(|\.innerHTML\s*=|dangerouslySetInnerHTML", HIGH, ("CWE-79",)),
    Sink("llm.insecure-output-handling", r"requests\.\w+\(|urlopen\(|\bfetch\(|axios\.\w+\(", MEDIUM, ("CWE-918",)),
    Sink("llm.insecure-output-handling", r"(?<![\w.])open\(|os\.remove\(|shutil\.rmtree\(", MEDIUM, ("CWE-22",)),
)
USER_INPUT = r"request\.(?:args|form|values|json|data|get_json)|\binput\s*\(|\breq(?:uest)?\.(?:query|params|body)\b|user_input|requests\.get\(|\.read\(\)|fetch\("
PROMPT_SINKS = (
    Sink("llm.untrusted-input-in-system-prompt", r"(?i)['\"]role['\"]\s*:\s*['\"]system['\"]\s*,\s*['\"]content['\"]\s*:|system(?:_prompt|_message)?\s*=\s*f?['\"]", MEDIUM, ("CWE-77", "CWE-74")),
    Sink("llm.prompt-injection", MODEL_CALL, MEDIUM, ("CWE-74",)),
)


def javascript(files: DataFrame) -> DataFrame:
    return flow(files.where("language IN ('JavaScript', 'TypeScript')"), JS_SOURCE, JS_SINKS, "ast-js", JS_CLEAN)


def language_models(files: DataFrame) -> DataFrame:
    """Model output in dangerous sinks, and outside input in prompts, in files that call a model at all."""
    code = files.where(F.col("language").isin("Python", "JavaScript", "TypeScript") & text_has(F.col("text"), MODEL_CALL))
    return flow(code, MODEL_CALL, LLM_SINKS, "llm", LLM_CLEAN).unionByName(flow(code, USER_INPUT, PROMPT_SINKS, "llm", LLM_CLEAN, 0))


def replace_line_hits(line_findings: DataFrame, flow_findings: DataFrame) -> DataFrame:
    """flow findings and the line findings that none of them covers at their line."""
    covered = flow_findings.select("project", "path", "start_line").distinct()
    return line_findings.join(covered, ["project", "path", "start_line"], "left_anti").unionByName(flow_findings, allowMissingColumns=True)

"""Entry points: detectors by name, profiles, and a scan from files to finished findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import CRITICAL, HIGH
from ..functions.store import keep
from ..operators import agent_calls, agent_config, behavior, blocks, dependencies, drift, flows, grading, probes, rules, secrets_history, taint
from ..operators import findings as ops
from ..sources import imports, manifests, osv
from ..sources.files import base_name, lines, spread

API_VERSION = 1


@dataclass(frozen=True)
class Detector:
    """Line rules, which all detectors of a scan share one pass for, and functions from files to findings.

    with_tables: functions that read side tables too (see TABLES), each with the names it needs; where one is not
    given, the function does not run. A name with a question mark is passed only if it is given.
    """

    rules: tuple[rules.Rule, ...] = ()
    more: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    with_tables: tuple[tuple[tuple[str, ...], Callable[..., DataFrame]], ...] = ()


#: Side tables that detectors read: name and columns.
TABLES = {
    "advisories": "id, ecosystem, package, vulnerable, severity, cve",
    "osv": "text",
    "signals": "cve, epss, percentile, kev",
    "malicious": "ecosystem, name",
    "popular": "ecosystem, name",
    "previous_packages": "project, ecosystem, manifest, package, version",
    "npm_manifests": "package, version, text",
    "patches": "project, commit, seq, text",
    "commits": "target, seq, email, paths",
    "tracked": "target, path",
    "images": "target, user, privileged, ports",
    "answers": "target, url, marker, body, headers",
}
PROVENANCE = r"(?i)(?:\.intoto\.jsonl?|provenance[^/]*\.json|attestation[^/]*\.json)$"


def vulnerable_packages(files: DataFrame, advisories: DataFrame | None = None, records: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """Packages of the files' manifests with the advisories that hold their versions, one for each CVE.

    advisories have a clause each, records are OSV texts. Findings say whether the project's code imports the package;
    with signals they have epss and kev too, and an exploited one is almost certain to be met.
    """
    own = manifests.packages(files)
    places = dependencies.inventory(own)
    found = dependencies.vulnerable(own, advisories).withColumn("cwe", F.array(F.lit("CWE-1104"))) if advisories is not None else osv.vulnerable(own, osv.records(records))
    found = dependencies.one_per_cve(found.withColumn("cve", F.nullif("cve", F.lit(""))))
    if signals is not None:
        found = dependencies.with_signals(found, signals)
    rows = dependencies.advisory_findings(found, places)
    return dependencies.imported(rows, imports.modules(files))


def named_packages(files: DataFrame, of: DataFrame, rule: str, severity: int, pick: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Findings on the first manifest of the packages that pick() chooses by a list of names."""
    places = dependencies.inventory(manifests.packages(files))
    chosen = pick(places.select("ecosystem", "package").distinct(), of).select("ecosystem", "package").distinct()
    rows = places.join(chosen, ["ecosystem", "package"])
    return rows.select("project", F.col("manifest").alias("path"), F.lit(rule).alias("rule_id"), F.lit("supply-chain").alias("scanner"), F.lit(severity).alias("severity"), F.concat_ws("==", "package", "version").alias("snippet"), F.array(F.lit("CWE-506")).alias("cwe"))


def lifecycle_scripts(files: DataFrame) -> DataFrame:
    return dependencies.lifecycle_scripts(files.where(base_name(F.col("path")) == "package.json")).withColumn("scanner", F.lit("supply-chain"))


def provenance(files: DataFrame) -> DataFrame:
    """Attestations of the files, and projects with packages but without any."""
    attests = F.rlike("path", F.lit(PROVENANCE))
    packaged = base_name(F.col("path")).isin(*(n for n, _ in manifests.FORMATS))
    return blocks.attestations(files.where(attests)).unionByName(blocks.without_attestations(files, packaged, attests))


def interfaces(files: DataFrame) -> DataFrame:
    """OpenAPI texts in JSON and YAML."""
    return blocks.openapi(files.where(F.rlike("path", F.lit(r"(?i)(?:openapi|swagger)[^/]*\.(?:json|ya?ml)$"))))


def package_changes(files: DataFrame, previous: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Differences between the packages of the files' manifests and those of an earlier state; with npm manifests also what changed versions can newly do."""
    key = ["project", "ecosystem", "manifest", "package"]
    old, new = (p.withColumn("ordinal", F.col("version")) for p in (previous, manifests.packages(files)))
    changes = drift.package_diff(old, new, key)
    found = drift.diff_findings(changes)
    return found if registry is None else found.unionByName(behavior.anomaly_findings(changes, behavior.fingerprints(registry)), allowMissingColumns=True)


def probed(check: Callable[..., DataFrame], scanner: str) -> Callable[..., DataFrame]:
    """Findings of a check over probe tables, as those of files: the target is the path."""

    def run(files: DataFrame, *tables: DataFrame) -> DataFrame:
        return check(*tables).select(F.lit(None).cast("string").alias("project"), F.col("target").alias("path"), "rule_id", F.lit(scanner).alias("scanner"), "severity", "confidence", "cwe", F.col("detail").alias("snippet"))

    return run


#: In the order in which scanners run, which settles ties between findings.
DETECTORS: dict[str, Detector] = {
    "secrets": Detector(rules.SECRETS, with_tables=((("patches",), lambda files, patches: secrets_history.history_secrets(patches)),)),
    "patterns": Detector(rules.PATTERNS, (blocks.path_traversal,)),
    "ast-python": Detector(more=(taint.python_taint,)),
    "ast-python-xfile": Detector(more=(taint.cross_file,)),
    "ast-js": Detector(more=(flows.javascript,)),
    "lang-sast": Detector(rules.LANGUAGE),
    "malware": Detector(rules.MALWARE),
    "iac": Detector(rules.IAC),
    "container": Detector(rules.CONTAINER, (blocks.capability_blocks,)),
    "cicd": Detector(rules.CICD, (blocks.permission_blocks,)),
    "cloud": Detector(rules.CLOUD, (blocks.iam_wildcards,)),
    "business-logic": Detector(rules.LOGIC, (blocks.business_logic,)),
    "dependencies": Detector(with_tables=((("advisories", "signals?"), lambda files, a, s=None: vulnerable_packages(files, a, signals=s)), (("osv", "signals?"), lambda files, r, s=None: vulnerable_packages(files, records=r, signals=s)))),
    "dependency-diff": Detector(with_tables=((("previous_packages", "npm_manifests?"), package_changes),)),
    "supply-chain": Detector(
        more=(lifecycle_scripts,),
        with_tables=(
            (("malicious",), lambda files, bad: named_packages(files, bad, "supply-chain.known-malicious", CRITICAL, dependencies.malicious)),
            (("popular",), lambda files, popular: named_packages(files, popular, "supply-chain.typosquat", HIGH, dependencies.typosquats)),
        ),
    ),
    "provenance": Detector(more=(provenance,)),
    "api": Detector(more=(interfaces,)),
    "git-security": Detector(with_tables=((("commits", "tracked"), probed(probes.repositories, "git-security")),)),
    "container-image": Detector(with_tables=((("images",), probed(probes.container_images, "container-image")),)),
    "dast": Detector(with_tables=((("answers",), probed(probes.dast, "dast")),)),
    "authz": Detector(more=(blocks.authorization,)),
    "agent-config": Detector(more=(agent_config.agent_config,)),
    "llm": Detector(rules.LLM, (flows.language_models, agent_calls.agent_calls, agent_calls.prompt_literals)),
}
#: Detectors by use: fixed values. A detector whose side tables are not given, or whose files are not there, adds nothing.
PROFILES = {
    "fast": ("secrets", "patterns", "malware", "dependencies"),
    "standard": tuple(DETECTORS),
    "deep": ("secrets", "patterns", "malware", "ast-python", "ast-python-xfile", "ast-js", "lang-sast", "dependencies", "dependency-diff", "supply-chain", "provenance", "authz", "api", "business-logic", "git-security", "iac", "cicd", "container", "container-image", "cloud", "llm", "agent-config", "dast"),
    "supply-chain": ("dependencies", "dependency-diff", "supply-chain", "provenance"),
    "ci": ("secrets", "patterns", "dependencies", "cicd", "iac"),
    "production": ("secrets", "dependencies", "supply-chain", "iac", "container", "cloud", "cicd"),
}
#: What a detector can find in: it is left out of a plan where no file has one of these languages.
NEEDS = {"ast-python": ("Python",), "ast-python-xfile": ("Python",), "ast-js": ("JavaScript", "TypeScript"), "llm": ("Python", "JavaScript", "TypeScript")}


def register(name: str, detector: Detector, api_version: int = API_VERSION) -> None:
    """Adds a detector of one's own; its name must be free and its version known."""
    if name in DETECTORS:
        raise ValueError(f"a detector {name} is there already")
    if api_version != API_VERSION:
        raise ValueError(f"detectors have version {API_VERSION} here, not {api_version}")
    DETECTORS[name] = detector


def detect(files: DataFrame, scanners: Iterable[str] | None = None, profile: str = "standard", tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Findings of the chosen detectors with an ordinal in file, detector, line and rule order. tables: see TABLES."""
    names = list(scanners or PROFILES[profile])
    tables = tables or {}
    if unknown := [n for n in names if n not in DETECTORS]:
        raise ValueError(f"no such detector: {', '.join(unknown)}")
    if unknown := [t for t in tables if t not in TABLES]:
        raise ValueError(f"no such table: {', '.join(unknown)}")
    files = spread(files)
    there = {r[0] for r in files.select("language").distinct().collect()}
    names = [n for n in names if n not in NEEDS or there.intersection(NEEDS[n])]
    chosen = [DETECTORS[n] for n in names]
    parts = [f(files) for d in chosen for f in d.more]
    parts += [f(files, *(tables[t.rstrip("?")] for t in needed if t.rstrip("?") in tables)) for d in chosen for needed, f in d.with_tables if all(t in tables or t.endswith("?") for t in needed)]
    if line_rules := tuple(r for d in chosen for r in d.rules):
        parts.append(rules.match_rules(files, line_rules).withColumn("__line_rule", F.lit(True)))
    if not parts:
        raise ValueError("nothing to run")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    none = F.array().cast("array<string>")
    defaults = {"start_line": F.lit(None).cast("int"), "end_line": F.col("start_line"), "confidence": F.lit(1), "likelihood": F.lit(2), "cwe": none, "tags": none}
    for c, value in defaults.items():
        out = out.withColumn(c, F.coalesce(c, value) if c in out.columns else value)
    if "__line_rule" in out.columns:
        # one pass over the files makes all findings; flows then replace what line rules say about the same line
        out = keep(out, "detected")
        if "llm" in names:
            on = ["project", "path", "start_line", "scanner"]
            flow = out.where("scanner = 'llm' AND __line_rule IS NULL").select(*on).distinct()
            covered = F.col("__line_rule") & (F.col("scanner") == "llm") & F.col("__flow").isNotNull()
            out = out.alias("f").join(flow.withColumn("__flow", F.lit(1)).alias("c"), ops.same(on, "f", "c"), "left").select("f.*", "__flow").where(~F.coalesce(covered, F.lit(False))).drop("__flow")
        if any(r.id in (*grading.SHELL, *grading.LOADS, *grading.YAML) for r in line_rules) and "Python" in there:
            out = grading.graded(out, grading.line_verdicts(files))
        out = out.drop("__line_rule")
    at = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("scanner")), F.lit(len(names)))
    # unique by file and rank in it, and sorted like them: no task ranks all findings, and no two files can clash
    own = Window.partitionBy("project", "path").orderBy("__at", F.col("start_line").asc_nulls_first(), "rule_id", "snippet")
    place = F.concat_ws("\u0001", F.coalesce("project", F.lit("")), "path", F.lpad(F.row_number().over(own).cast("string"), 10, "0"))
    return out.withColumn("__at", at).withColumn("ordinal", place).drop("__at")


def scan(files: DataFrame, scanners: Iterable[str] | None = None, profile: str = "standard", tables: dict[str, DataFrame] | None = None, **finish) -> DataFrame:
    """detect() and all that follows it (see findings.finished), inline suppressions included."""
    names = list(scanners or PROFILES[profile])
    return ops.finished(detect(files, names, tables=tables), of_lines=lines(files), ran=[n for n in names if n.startswith("ast-")], **finish)

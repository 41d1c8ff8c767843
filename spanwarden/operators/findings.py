"""What happens to findings after detection: suppression, de-duplication, context, policies, filters, scores.

Every function takes and returns DataFrames. Small side tables (allow entries, policies, context rows) come
from a run's configuration; they become one expression over findings, not a join, and SIDE_ROWS bounds them.
Findings carry an `ordinal`, their place in scan order, which settles ties. A file is (project, path): where
both sides of a step have a project, it is part of every key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.model import CRITICAL, HIGH, INFO, LOW, SEVERITIES, rank
from ..functions.prefix import with_sum_before
from ..functions.store import keep
from ..sources.files import excluded, suffix

#: Lines within which two scanners' reports of one weakness are one: fixed values.
DEDUPE_LINES, MERGE_LINES = 3, 2
AST_CWES = ("CWE-89", "CWE-79", "CWE-22", "CWE-95")
AST_SUFFIXES = {"ast-python": (".py",), "ast-js": (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")}
#: Rows that a side table of a run may have.
SIDE_ROWS = 2000
#: Rules whose lines have a rewrite.
REWRITES = ("patterns.python-yaml-load", "patterns.tls-verify-disabled", "patterns.flask-debug-true", "patterns.weak-hash-md5-sha1", "patterns.python-shell-true", "patterns.python-xml-resolve-entities", "patterns.python-weak-random-token")
EXPOSURE = {"internal": -1, "partner": 0, "internet": 1, "public": 1}
#: Verdicts by which first-party code uses a dependency: fixed values.
REACHABLE = ("imported", "REACHABLE", "VERIFIED")
#: Secrets that open a cloud, by rule and by what stands around one of another rule: fixed values.
CLOUD_SECRETS = ("aws-access-key-id", "aws-secret-access-key", "google-api-key")
CLOUD_HINT = r"(?i)(AWS_|aws_secret|gcp|azure|metadata\.google)"
#: Comment openers by suffix besides # and //: fixed values.
OPENERS = {"--": (".sql", ".lua", ".hs"), "<!--": (".html", ".htm", ".xhtml", ".xml", ".md", ".markdown"), ";": (".ini", ".lisp", ".lsp", ".el", ".clj")}


def keys(*sides: DataFrame, of: tuple[str, ...] = ("path",)) -> list[str]:
    """of, after the project where all sides have one."""
    return [*(["project"] if all("project" in s.columns for s in sides) else []), *of]


def same(on: list[str], left: str, right: str) -> Column:
    """Are the keys of two aliased sides equal? Findings of no project belong to the same one, none."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in on))


def side_rows(entries: DataFrame, *order: str) -> list[Row]:
    """The rows of a side table in order; ValueError beyond SIDE_ROWS, for such a table is no configuration."""
    rows = (entries.orderBy(*order) if order else entries).limit(SIDE_ROWS + 1).collect()
    if len(rows) > SIDE_ROWS:
        raise ValueError(f"a side table of a run may have {SIDE_ROWS} rows")
    return rows


def _either(conditions: list[Column]) -> Column:
    """Is any of the conditions true? Unknown ones are not."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions), F.lit(False)), F.lit(False))


def with_scores(findings: DataFrame) -> DataFrame:
    """findings with risk_score and fingerprint."""
    c = F.col
    return findings.withColumn("risk_score", scoring.risk_score(c("severity"), c("confidence"), c("likelihood"))).withColumn("fingerprint", scoring.fingerprint(c("rule_id"), c("path"), c("snippet"), c("start_line")))


def inline_suppressed(findings: DataFrame, of_lines: DataFrame, today: Column, marker: str = "spanwarden-ignore") -> DataFrame:
    """findings without those whose own line has an ignore comment with a reason, not expired, for any or this rule."""
    body = rf"\s*{marker}(?::\s*([A-Za-z0-9_.\-]+))?[^\n]*?reason\s*=\s*['\"]([^'\"]+)['\"](?:[^\n]*?until\s*=\s*(\d{{4}}-\d{{2}}-\d{{2}}))?"
    opener = F.lit(r"(?:#|//)")
    for mark, kinds in OPENERS.items():
        opener = F.when(suffix(F.col("path")).isin(*kinds), F.lit(rf"(?:#|//|{mark})")).otherwise(opener)
    expr = F.concat(opener, F.lit(body))
    content = F.col("content")
    marked = of_lines.where(F.contains(content, F.lit(marker))).where(F.rlike(content, expr))
    until = F.call_function("regexp_extract", content, expr, F.lit(3))
    marked = marked.withColumn("__until", F.when(until != "", F.try_to_date(until, "yyyy-MM-dd"))).withColumn("__dated", until != "").withColumn("__rule", F.call_function("regexp_extract", content, expr, F.lit(1)))
    on = keys(findings, of_lines, of=("path", "start_line"))
    marked = marked.where(~F.col("__dated") | (F.col("__until") >= today)).withColumnRenamed("line", "start_line").select(*on, "__rule")
    hidden = same(on, "f", "m") & ((F.col("m.__rule") == "") | scoring.rule_matches(F.col("f.rule_id"), F.col("m.__rule")))
    return findings.alias("f").join(marked.alias("m"), hidden, "left_anti")


def active(entries: DataFrame, today: Column) -> DataFrame:
    """Allow entries (rule, path, reason, until) that have a reason, name a rule or path, and have not expired."""
    return entries.where((F.coalesce("reason", F.lit("")) != "") & (F.coalesce("rule", "path").isNotNull()) & (F.col("until").isNull() | (F.col("until") >= today)))


def allowlisted(findings: DataFrame, entries: DataFrame, today: Column) -> DataFrame:
    """findings without those that an active allow entry matches."""
    yes = F.lit(True)
    hits = [(yes if e.rule is None else scoring.rule_matches(F.col("rule_id"), F.lit(e.rule))) & (yes if e.path is None else scoring.path_matches(F.col("path"), F.lit(e.path))) for e in side_rows(active(entries, today))]
    return findings.where(~_either(hits))


def with_exceptions(findings: DataFrame, exceptions: DataFrame, today: Column) -> DataFrame:
    """Exceptions (fingerprint, status, expires_at, ordinal) applied: suppressed findings go, others get a verification.

    The last entry of a fingerprint counts; an expired one does not.
    """
    on = keys(findings, exceptions, of=("fingerprint",))
    live = exceptions.where(F.col("expires_at").isNull() | (F.col("expires_at") >= today)).groupBy(*on).agg(F.max_by("status", "ordinal").alias("__status"))
    joined = findings.alias("f").join(live.alias("e"), same(on, "f", "e"), "left").select("f.*", "__status").where(F.coalesce(F.col("__status") != "suppress", F.lit(True)))
    state = F.when(F.col("__status") == "accept", "accepted").when(F.col("__status") == "false_positive", "false_positive")
    old = F.col("verification") if "verification" in findings.columns else F.lit(None).cast("string")
    return joined.withColumn("verification", F.coalesce(state, old)).drop("__status")


def not_excluded(findings: DataFrame, globs: list[str]) -> DataFrame:
    """Imported findings without those of paths that a scan leaves out; places that are no paths, in parentheses, stay."""
    return findings.where(F.startswith("path", F.lit("(")) | ~excluded(F.col("path"), globs))


def prefer_ast(findings: DataFrame, ran: list[str]) -> DataFrame:
    """findings without pattern guesses of classes that a syntax tier has covered in those files."""
    covered = [s for name in ran for s in AST_SUFFIXES.get(name, ())]
    if not covered:
        return findings
    owned = F.arrays_overlap("cwe", F.array(*map(F.lit, AST_CWES)))
    return findings.where(~((F.col("scanner") == "patterns") & owned & suffix(F.col("path")).isin(*covered)))


def deduplicated(findings: DataFrame) -> DataFrame:
    """One of the reports of a weakness by several scanners within DEDUPE_LINES of the last one kept.

    The fold runs within (project, path, CWEs), in line and then scan order: the higher confidence, severity, rewrite,
    syntax tier stays, on a tie the lower rule id. Findings without a line or a CWE all stay. Each depends on the last
    one kept, so the rows of a group stream through one task in order; it holds one of them.
    """
    place = F.struct(*keys(findings), F.array_sort("cwe").alias("cwes")).alias("group")
    loose = F.col("start_line").isNull() | (F.size("cwe") <= 0)
    rewrite, ast = F.col("rule_id").isin(*REWRITES).cast("int"), F.startswith("scanner", F.lit("ast-")).cast("int")
    merit = F.struct("confidence", "severity", rewrite.alias("rewrite"), ast.alias("ast"))
    asked = F.struct(loose.alias("loose"), F.xxhash64(place).alias("group"), F.to_json(place).alias("key"), F.col("start_line").alias("line"), merit.alias("merit"), F.col("rule_id").alias("rule"), F.col("scanner").alias("tool"))
    rows = findings.withColumn("__asked", asked).repartition("__asked.group").sortWithinPartitions("__asked.group", "__asked.key", "start_line", "ordinal")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the last row kept of the present group, and the batch of one row that it is
        for batch in batches:
            kept: list[int] = []
            at = None  # its place in this batch
            own = batch.drop_columns(["__asked"])
            for i, row in enumerate(batch.column("__asked").to_pylist()):
                if row["loose"]:
                    kept.append(i)
                    continue
                near = last is not None and last["key"] == row["key"] and last["tool"] != row["tool"] and row["line"] - last["line"] <= DEDUPE_LINES
                mine, other = (tuple(r["merit"].values()) for r in (row, last or row))
                if near and not (mine > other or mine == other and row["rule"] < last["rule"]):
                    continue
                if not near and last is not None:
                    if at is None:
                        yield held
                    else:
                        kept.append(at)
                last, at = row, i
            yield own.take(pa.array(sorted(kept), pa.int64()))
            if at is not None:
                held = own.slice(at, 1)
        if last is not None:
            yield held

    return rows.mapInArrow(fold, findings.schema)


def merged(native: DataFrame, imported: DataFrame) -> DataFrame:
    """imported findings joined to native ones that report the same issue: same file, another scanner, a shared
    CWE within MERGE_LINES or a shared CVE; the nearest, then the earliest. Lines meet in buckets of
    MERGE_LINES + 1 and their neighbours, so the band join is an equi join.

    Returns native findings with also_reported_by and the higher severity, and imported ones that match none.
    A match between two imported findings is left to deduplicated().
    """
    wide = MERGE_LINES + 1
    native, imported = keep(native, "native"), keep(imported, "imported")  # each is read several times below
    on = keys(native, imported)
    n = native.select(*(F.col(k).alias(f"n_{k}") for k in on if k != "path"), F.col("ordinal").alias("n_ordinal"), F.col("scanner").alias("n_scanner"), F.col("path").alias("n_path"), F.col("start_line").alias("n_line"), F.col("cwe").alias("n_cwe"), F.col("cve").alias("n_cve"))
    near = n.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("n_line") / wide) + d)))
    own = imported.withColumn("bucket", F.floor(F.col("start_line") / wide))
    same_file = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in on))
    band = own.join(near, same_file & (own["bucket"] == near["bucket"])).where((F.abs(F.col("start_line") - F.col("n_line")) <= MERGE_LINES) & F.arrays_overlap("cwe", "n_cwe"))
    same_cve = imported.join(n, same_file & (F.upper("cve") == F.upper("n_cve")))
    columns = ["ordinal", "n_ordinal", "scanner", "n_scanner", "rule_id", "severity", "start_line", "n_line"]
    pairs = band.select(*columns).union(same_cve.select(*columns)).where("scanner <> n_scanner").withColumn("distance", F.coalesce(F.abs(F.col("start_line") - F.col("n_line")), F.lit(0)))
    first = Window.partitionBy("ordinal").orderBy("distance", "n_ordinal")
    chosen = pairs.withColumn("__k", F.row_number().over(first)).where("__k = 1")
    also = chosen.groupBy("n_ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws(":", "scanner", "rule_id").alias("entry")))), lambda x: x["entry"]).alias("also_reported_by"), F.max("severity").alias("__raised"))
    kept = native.join(also, native["ordinal"] == also["n_ordinal"], "left").drop("n_ordinal")
    kept = kept.withColumn("severity", F.greatest("severity", F.coalesce("__raised", "severity"))).drop("__raised")
    alone = imported.join(chosen.select("ordinal"), "ordinal", "left_anti").withColumn("also_reported_by", F.lit(None).cast("array<string>"))
    return kept.unionByName(alone)


def regraded(findings: DataFrame, classes: DataFrame | None = None, internal: DataFrame | None = None, exposure: DataFrame | None = None) -> DataFrame:
    """Severity and likelihood after the project's context, in this order, the first entry that matches each:
    data classes raise by one (from LOW on), internal paths lower by one, exposure levels move the likelihood.
    Adds original_severity and changes."""
    out = findings.withColumn("original_severity", F.col("severity")).withColumn("changes", F.array().cast("array<string>"))

    def first_match(rows: DataFrame, entries: DataFrame, what: Callable[[Row], str]) -> DataFrame:
        """rows with __m: what of the first entry whose path matches, as one ladder of cases."""
        ladder = F.lit(None).cast("string")
        for e in reversed(side_rows(entries, "ordinal")):
            ladder = F.when(scoring.path_matches(F.col("path"), F.lit(e.path)), F.lit(what(e))).otherwise(ladder)
        return rows.withColumn("__m", ladder)

    if classes is not None:
        out = first_match(out, classes, lambda e: ",".join(e.classes or ()))
        up = F.col("__m").isNotNull() & (F.col("severity") >= LOW)
        out = out.withColumn("severity", F.when(up, F.least(F.col("severity") + 1, F.lit(CRITICAL))).otherwise(F.col("severity")))
        out = out.withColumn("changes", F.when(F.col("__m").isNotNull(), F.array_append("changes", F.concat(F.lit("sensitive-data:"), F.col("__m")))).otherwise(F.col("changes"))).drop("__m")
    if internal is not None:
        out = first_match(out, internal, lambda e: e.path)
        out = out.withColumn("severity", F.when(F.col("__m").isNotNull(), F.greatest(F.col("severity") - 1, F.lit(INFO))).otherwise(F.col("severity")))
        out = out.withColumn("changes", F.when(F.col("__m").isNotNull(), F.array_append("changes", F.lit("internal"))).otherwise(F.col("changes"))).drop("__m")
    if exposure is not None:
        out = first_match(out, exposure, lambda e: e.level)
        step = F.lit(0)
        for level, by in EXPOSURE.items():
            step = F.when(F.col("__m") == level, by).otherwise(step)
        out = out.withColumn("likelihood", F.when(F.col("__m").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(4), F.col("likelihood") + step))).otherwise(F.col("likelihood")))
        out = out.withColumn("changes", F.when(F.col("__m").isNotNull(), F.array_append("changes", F.concat(F.lit("exposure:"), F.col("__m")))).otherwise(F.col("changes"))).drop("__m")
    return out


def at_least(findings: DataFrame, floor: int) -> DataFrame:
    """Findings whose severity, now or before the context changed it, reaches the floor."""
    before = F.col("original_severity") if "original_severity" in findings.columns else F.col("severity")
    return findings.where(F.greatest("severity", before) >= floor)


def in_diff(findings: DataFrame, changed: DataFrame, manifests: list[str] | None = None) -> DataFrame:
    """Findings on changed lines (project, path, line; the project may be absent), file-level ones on changed files,
    and all where nothing changed. A finding meets the lines of its own file only, without a row for each line.

    Dependency findings stay if their manifest changed.
    """
    if changed.isEmpty():
        return findings
    on = keys(findings, changed)
    whole = F.col("f.start_line").isNull() | F.col("f.scanner").isin(*(manifests or ["dependencies", "supply-chain", "dependency-diff"]))
    within = F.col("c.line").between(F.col("f.start_line"), F.greatest("f.start_line", F.coalesce("f.end_line", "f.start_line")))
    return findings.alias("f").join(changed.select(*on, "line").distinct().alias("c"), same(on, "f", "c") & (whole | within), "left_semi")


def new_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """current without the fingerprints of baseline."""
    on = keys(current, baseline, of=("fingerprint",))
    return current.alias("c").join(baseline.select(*on).distinct().alias("b"), same(on, "c", "b"), "left_anti")


def policy_violations(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """(policy, action, findings' columns) for each policy (id, action, severity, scanner, rule, tag, cwe) and finding that meets all it names."""
    tests: dict[str, Callable[[str], Column]] = {
        "severity": lambda v: F.col("severity") >= rank(F.lit(v), SEVERITIES),
        "scanner": lambda v: F.col("scanner") == v,
        "rule": lambda v: scoring.rule_matches(F.col("rule_id"), F.lit(v)),
        "tag": lambda v: F.array_contains("tags", v),
        "cwe": lambda v: F.array_contains("cwe", v),
    }
    met = []
    for p in side_rows(policies):
        meets = reduce(lambda a, b: a & b, (test(p[c]) for c, test in tests.items() if p[c] is not None), F.lit(True))
        met.append(F.when(meets, F.struct(F.lit(p.id).alias("policy"), F.lit(p.action).alias("action"))))
    none = F.struct(F.lit(None).cast("string").alias("policy"), F.lit(None).cast("string").alias("action"))
    hits = F.filter(F.array(*met) if met else F.array(F.when(F.lit(False), none)), lambda x: x.isNotNull())
    return findings.withColumn("__p", F.explode(hits)).select("*", "__p.policy", "__p.action").drop("__p")


def gate(findings: DataFrame, fail_on: int | None, errors: int = 0) -> DataFrame:
    """One row: total, highest, failed. Errors fail a run that has a gate."""
    highest = F.coalesce(F.max("severity"), F.lit(INFO))
    failed = F.lit(False) if fail_on is None else (highest >= fail_on) & (F.count("*") > 0) | F.lit(errors > 0)
    return findings.agg(F.count("*").alias("total"), highest.alias("highest"), failed.alias("failed"))


def severity_counts(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of all five severities, zeros included, for all findings or for each group."""
    counts = [F.count_if(F.col("severity") == i).alias(name) for i, name in enumerate(SEVERITIES)]
    return findings.groupBy(*(by or [])).agg(*counts)


def risk_by(findings: DataFrame, by: list[str]) -> DataFrame:
    """Aggregate risk, findings and highest severity of each group of findings with risk_score."""
    g = findings.groupBy(*by).agg(F.max("risk_score").alias("__top"), F.sum("risk_score").alias("__sum"), F.count("*").alias("findings"), F.max("severity").alias("highest_severity"))
    return g.select(*by, scoring.aggregate_risk(F.col("__top"), F.col("__sum"), F.col("findings")).alias("aggregate_risk"), "findings", "highest_severity")


def chains(findings: DataFrame, kev_reachable: bool = True) -> DataFrame:
    """Attack chains: (chain, project, path, start_line, severity, first_ordinal, members, cwe) from findings that occur
    together; the first two make a chain, and it has their CWEs.

    Per file: prompt injection with a way to execute; a secret with an injection. Per project: a server-side
    request with a cloud credential; an exploited dependency that is imported; a malicious one in a diff; a
    public service without authentication.
    """
    rule, cwe = F.col("rule_id"), F.col("cwe")

    def any_cwe(*names: str) -> Column:
        return F.arrays_overlap(cwe, F.array(*map(F.lit, names)))

    injection = F.endswith(rule, F.lit("prompt-injection"))
    executes = (F.contains(rule, F.lit("insecure-output")) | F.contains(rule, F.lit("agent-shell")) | F.contains(rule, F.lit("unrestricted-tool")) | any_cwe("CWE-78", "CWE-95")) & ~injection
    secret = (F.col("scanner") == "secrets") & ~F.contains(rule, F.lit(".history"))
    hint = F.rlike(F.coalesce(F.col("snippet") if "snippet" in findings.columns else F.lit(""), F.lit("")), F.lit(CLOUD_HINT))
    cloud = (F.col("scanner") == "secrets") & (F.element_at(F.split(rule, r"\."), -1).isin(*CLOUD_SECRETS) | hint)
    kev = (F.col("scanner") == "dependencies") & (F.col("kev") if "kev" in findings.columns else F.lit(False))
    reach = F.col("reachability") if "reachability" in findings.columns else F.lit(None)
    per_file = [("llm-injection-to-execution", injection, executes, CRITICAL), ("secret-plus-injection", secret, any_cwe("CWE-78", "CWE-89", "CWE-95"), HIGH)]
    whole = [
        ("ssrf-to-cloud-credentials", any_cwe("CWE-918"), cloud, CRITICAL),
        ("kev-reachable-dependency", kev & (reach == "imported"), kev & (reach == "imported"), CRITICAL),
        ("malicious-dependency-in-diff", F.col("scanner") == "dependency-diff", rule == "supply-chain.known-malicious", CRITICAL),
        ("exposed-service-unauthenticated", (F.col("scanner") == "iac") & F.contains(F.lower(rule), F.lit("public")), rule == "authz.missing-authentication", CRITICAL),
    ]
    groups: list[DataFrame] = []
    for own, specs in ((["project", "path"], per_file), (["project"], whole)):
        firsts = []
        for i, (_, a, b, _) in enumerate(specs):
            member = F.struct("path", "start_line", "cwe")
            firsts += [F.min(F.when(x, F.col("ordinal"))).alias(f"{side}{i}") for side, x in (("a", a), ("b", b))]
            firsts += [F.min_by(member, F.when(x, F.col("ordinal"))).alias(f"m{side}{i}") for side, x in (("a", a), ("b", b))]
        g = findings.groupBy(*own).agg(*firsts)
        each = []
        for i, (name, _, _, severity) in enumerate(specs):
            both = F.col(f"a{i}").isNotNull() & F.col(f"b{i}").isNotNull()
            cwes = F.array_sort(F.array_union(f"ma{i}.cwe", f"mb{i}.cwe"))
            row = F.struct(F.lit(name).alias("chain"), F.col(f"ma{i}.path").alias("path"), F.col(f"ma{i}.start_line").alias("start_line"), F.lit(severity).alias("severity"), F.col(f"a{i}").alias("first_ordinal"), F.array(f"a{i}", f"b{i}").alias("members"), cwes.alias("cwe"))
            each.append(F.when(both, row))
        found = F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("c")
        groups.append(g.select("project", found).select("c.chain", "project", "c.path", "c.start_line", "c.severity", "c.first_ordinal", "c.members", "c.cwe"))
    return groups[0].unionByName(groups[1])


def with_chains(findings: DataFrame) -> DataFrame:
    """findings and one more for each attack chain, on the place of its first member, with its members' ordinals."""
    numeric = dict(findings.dtypes)["ordinal"] in ("int", "bigint")
    key = ("chain", F.coalesce("project", F.lit("")), "path")
    place = F.xxhash64(*key).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62) if numeric else F.concat_ws("\u0001", F.lit("\uffff"), *key)
    found = chains(findings).withColumn("ordinal", place).drop("first_ordinal")
    about = {"rule_id": F.concat(F.lit("chains."), F.col("chain")), "scanner": F.lit("chains"), "end_line": F.col("start_line"), "confidence": F.lit(1), "likelihood": F.lit(3), "tags": F.array(F.lit("attack-chain"), F.col("chain")), "original_severity": F.col("severity"), "changes": F.array().cast("array<string>")}
    found = found.withColumns({c: v for c, v in about.items() if c in findings.columns or c in ("rule_id", "scanner", "confidence", "likelihood", "tags")}).drop("chain")
    return findings.unionByName(found, allowMissingColumns=True)


def top_for_review(findings: DataFrame, k: int = 25, by: list[str] | None = None) -> DataFrame:
    """findings with `reviewed`: are they among the k riskiest (of their group)?"""
    if not by:  # no task ranks all findings: each partition gives its k
        top = findings.orderBy(F.desc("risk_score"), "ordinal").limit(k).select("ordinal", F.lit(True).alias("reviewed"))
        return findings.join(F.broadcast(top), "ordinal", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
    order = Window.partitionBy(*by).orderBy(F.desc("risk_score"), "ordinal")
    return findings.withColumn("reviewed", F.row_number().over(order) <= k)


def ordered(findings: DataFrame) -> DataFrame:
    """Severity, confidence and risk highest first, ties in scan order."""
    return findings.orderBy(F.desc("severity"), F.desc("confidence"), F.desc("risk_score"), "ordinal")


def numbered(findings: DataFrame) -> DataFrame:
    """findings with an id: scanner, rule and a number in (path, line, rule) order, by prefix sums over ranges."""
    rows = with_sum_before(findings, ["scanner", "rule_id"], ["path", F.col("start_line").asc_nulls_first(), "ordinal"], F.lit(1), "__n")
    return rows.withColumn("id", F.concat_ws(":", "scanner", "rule_id", (F.col("__n") + 1).cast("string"))).drop("__n")


def finished(findings: DataFrame, *, of_lines: DataFrame | None = None, allow: DataFrame | None = None, ran: list[str] | None = None, context: dict | None = None, floor: int = INFO, exceptions: DataFrame | None = None, today: Column | None = None, exposed: bool = False, production: bool = False) -> DataFrame:
    """The whole chain after detection, in its fixed order."""
    today = F.current_date() if today is None else today
    out = findings
    if of_lines is not None:
        out = inline_suppressed(out, of_lines, today)
    if allow is not None:
        out = allowlisted(out, allow, today)
    out = keep(deduplicated(prefer_ast(out, ran or [])), "findings")
    out = at_least(with_chains(regraded(out, **(context or {}))), floor)
    out = with_scores(out)
    none = F.lit(None).cast("string")
    out = out.withColumn("verification", scoring.verification_state(F.col("scanner"), F.col("confidence"), none, F.lit(False), F.lit(False), F.lit(False)))
    reachable = F.array_contains("tags", "reachable") | F.col("reachability").isin(*REACHABLE) if "reachability" in out.columns else F.array_contains("tags", "reachable")
    chained = F.array_contains("tags", "attack-chain") | (F.col("scanner") == "chains")
    tagged = F.arrays_overlap("tags", F.array(F.lit("kev"), F.lit("epss-high")))
    out = out.withColumn("contextual_risk", scoring.contextual_risk(F.col("risk_score"), F.col("severity"), F.coalesce(reachable, F.lit(False)), chained, F.lit(exposed), F.lit(production), tagged, F.col("verification") == "verified"))
    if exceptions is not None:
        out = with_exceptions(out, exceptions, today)
    return ordered(out)



"""Registered queries over the given tables, each with the SQL that must give the same rows.

The documents table is the corpus: its sources are projects, its rows files. A small rule set, written in
the regular expressions that Spark and the SQL engine share, gives the findings that most queries process.
TPC-H-like tables stand for packages (lineitem: supplier = project, part = package, quantity = version),
orders for scans (customer = project, order = scan), events for a monitoring stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.model import CRITICAL, HIGH, INFO, LOW, MEDIUM, SEVERITIES
from ..operators import dependencies, drift, history, metrics
from ..operators import findings as ops
from ..operators.rules import PLACEHOLDER, Rule, match_rules
from ..sources.files import documents_as_files, language_summary, lines, spread

DOC_RULES = (
    Rule("secrets.generic-credential", HIGH, ("CWE-798",), r"(?i)(?:password|passwd|secret|token|api[_-]?key)\s*[:=]\s*['\"]?([A-Za-z0-9_/+=-]{8,})"),
    Rule("pii.email", LOW, ("CWE-359",), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", confidence=2),
    Rule("pii.ip-address", LOW, ("CWE-200",), r"(?:^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?:[^0-9.]|$)"),
    Rule("pii.phone-number", MEDIUM, ("CWE-359",), r"\+[0-9][ ().0-9-]{7,}[0-9]", likelihood=3),
    Rule("pii.long-number", MEDIUM, ("CWE-359",), r"(?:^|[^0-9])[0-9]{13,19}(?:[^0-9]|$)", confidence=0),
    Rule("text.shouting", INFO, ("CWE-1116",), r"[A-Z]{3,}!!", confidence=0, likelihood=4),
    Rule("license.notice", LOW, ("CWE-1104",), r"(?i)licensed under the|all rights reserved", confidence=2, likelihood=1),
    Rule("text.markup-noise", CRITICAL, ("CWE-116", "CWE-798"), r"[#$%&*]{3} [^ ]+[#$%&*]{3} ", confidence=0, likelihood=0),
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread(documents_as_files(table(spark, d, "documents")))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Findings of DOC_RULES with an ordinal by document, line and rule, and scores."""
    raw = match_rules(corpus(spark, d), DOC_RULES)
    number = F.create_map(*[F.lit(x) for i, r in enumerate(DOC_RULES) for x in (r.id, i)])
    doc = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long")
    raw = raw.withColumn("ordinal", doc * 4294967296 + F.col("start_line") * 64 + F.element_at(number, F.col("rule_id")))
    return ops.with_scores(raw)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_sql(i: int, r: Rule) -> str:
    p = _quoted(r.pattern)
    extra = f" AND NOT regexp_matches(regexp_extract(content, {p}, 1), {_quoted(PLACEHOLDER)})" if r.scanner == "secrets" else ""
    cwe = "[" + ",".join(map(_quoted, r.cwe)) + "]"
    return f"SELECT project, path, line AS start_line, doc_id * 4294967296 + line * 64 + {i} AS ordinal, {_quoted(r.id)} AS rule_id, {_quoted(r.scanner)} AS scanner, {r.severity} AS severity, {r.confidence} AS confidence, {r.likelihood} AS likelihood, {cwe} AS cwe, substr(trim(content), 1, 200) AS snippet FROM lines WHERE regexp_matches(content, {p}){extra}"


RISK = "round_even(100e0 * (severity / 4e0) * (6e-1 + 25e-2 * (confidence + 1) / 3e0 + 15e-2 * (likelihood + 1) / 5e0), 1)"
LINES = """lines AS (SELECT source AS project, 'docs/' || lang || '/' || doc_id || '.txt' AS path, doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS content FROM documents)"""
FOUND = f"""{LINES}, raw AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(DOC_RULES))}),
found AS (SELECT *, {RISK} AS risk_score, rule_id || '|' || path || '|' || CASE WHEN regexp_replace(snippet, '\\s+', '', 'g') <> '' THEN substr(sha1(regexp_replace(snippet, '\\s+', '', 'g')), 1, 12) ELSE 'L' || start_line END AS fingerprint FROM raw)"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- sources and scalar formulas


@query(f"WITH {LINES} SELECT path, count(*) AS n_lines, max(length(content)) AS longest FROM lines WHERE NOT (content = '' AND line = (SELECT max(l.line) FROM lines l WHERE l.path = lines.path)) GROUP BY path")
def corpus_lines(spark, d):
    """Lines of each file."""
    return lines(corpus(spark, d)).groupBy("path").agg(F.count("*").alias("n_lines"), F.max(F.length("content")).alias("longest"))


@query("SELECT source AS project, 'Text' AS language, count(*) AS files FROM documents GROUP BY source")
def files_per_language(spark, d):
    return language_summary(corpus(spark, d))


@query(f"WITH {FOUND} SELECT project, path, start_line, rule_id, severity, snippet FROM found")
def rule_matches(spark, d):
    """One projection of all rules over bounded windows of lines."""
    return found(spark, d).select("project", "path", "start_line", "rule_id", "severity", "snippet")


@query(f"WITH {FOUND} SELECT project, count(*) AS secret_lines FROM found WHERE scanner = 'secrets' GROUP BY project")
def secret_lines_by_source(spark, d):
    return found(spark, d).where("scanner = 'secrets'").groupBy("project").agg(F.count("*").alias("secret_lines"))


@query(f"WITH {FOUND} SELECT ordinal, risk_score, fingerprint FROM found")
def finding_risk_score(spark, d):
    return found(spark, d).select("ordinal", "risk_score", "fingerprint")


@query("""WITH v AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?i)(?:token|password)\\s*=\\s*"?([0-9a-f]{16,})', 1))) AS value FROM documents), c AS (SELECT doc_id, value, unnest(string_split(value, '')) AS ch FROM v WHERE value <> ''), g AS (SELECT doc_id, value, ch, count(*) AS n FROM c GROUP BY ALL)
SELECT doc_id, value, round(-sum(n / length(value)::DOUBLE * log2(n / length(value)::DOUBLE)), 6) AS entropy FROM g GROUP BY doc_id, value HAVING round(-sum(n / length(value)::DOUBLE * log2(n / length(value)::DOUBLE)), 6) >= 3.5""")
def high_entropy_tokens(spark, d):
    """Credential values of 3.5 bits a character and more, all of a document's, each once."""
    values = F.array_distinct(F.regexp_extract_all("text", F.lit(r'(?i)(?:token|password)\s*=\s*"?([0-9a-f]{16,})'), F.lit(1)))
    docs = table(spark, d, "documents").select("doc_id", F.explode(values).alias("value")).where("value <> ''")
    return docs.withColumn("entropy", F.round(scoring.entropy(F.col("value")), 6)).where("entropy >= 3.5")


@query(f"WITH {FOUND} SELECT fingerprint, count(*) AS findings, min(start_line) AS first_line FROM found GROUP BY fingerprint")
def fingerprint_dedupe(spark, d):
    return found(spark, d).groupBy("fingerprint").agg(F.count("*").alias("findings"), F.min("start_line").alias("first_line"))


@query(f"WITH {FOUND} SELECT ordinal, least(100e0, round_even(risk_score + CASE WHEN severity >= 3 THEN 10e0 ELSE 0e0 END + 0e0 + 0e0 + CASE WHEN severity >= 2 THEN 10e0 ELSE 0e0 END + 5e0 + 0e0 + CASE WHEN confidence >= 2 THEN 8e0 ELSE 0e0 END, 1)) AS contextual_risk, CASE WHEN confidence >= 1 THEN 'likely' ELSE 'detected' END AS verification, CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High' WHEN risk_score >= 25 THEN 'Medium' WHEN risk_score > 0 THEN 'Low' ELSE 'None' END AS band FROM found")
def contextual_risk(spark, d):
    """An exposed production project whose sure findings are verified."""
    f, no, c = found(spark, d), F.lit(False), F.col
    return f.select(
        "ordinal",
        scoring.contextual_risk(c("risk_score"), c("severity"), no, no, F.lit(True), F.lit(True), no, c("confidence") >= 2).alias("contextual_risk"),
        scoring.verification_state(c("scanner"), c("confidence"), F.lit(None).cast("string"), no, no, no).alias("verification"),
        scoring.risk_band(c("risk_score")).alias("band"),
    )


# ---- aggregates


@query(f"WITH {FOUND} SELECT project, " + ", ".join(f"count(*) FILTER (severity = {i}) AS {n}" for i, n in enumerate(SEVERITIES)) + " FROM found GROUP BY project")
def severity_counts_dense(spark, d):
    return ops.severity_counts(found(spark, d), ["project"])


@query(f"WITH {FOUND} SELECT project, least(100e0, round_even(max(risk_score) + (sum(risk_score) - max(risk_score)) / (20e0 * count(*)), 1)) AS aggregate_risk, count(*) AS findings, max(severity) AS highest_severity FROM found GROUP BY project")
def aggregate_risk_by_source(spark, d):
    return ops.risk_by(found(spark, d).withColumn("risk_score", F.col("risk_score")), ["project"])


@query(f"WITH {FOUND}, s AS (SELECT project, count(*) AS total, max(severity) AS highest FROM found GROUP BY project) SELECT project, CASE WHEN highest >= 4 THEN 'FAIL' WHEN highest >= 3 THEN 'REVIEW' WHEN highest >= 1 THEN 'PASS' ELSE 'CLEAN' END AS posture FROM s")
def posture_status(spark, d):
    s = found(spark, d).groupBy("project").agg(F.count("*").alias("total"), F.max("severity").alias("highest"))
    return s.select("project", scoring.posture(F.col("total"), F.lit(0), F.col("highest"), F.lit(4)).alias("posture"))


@query(f"WITH {FOUND} SELECT count(*) AS total, coalesce(max(severity), 0) AS highest, coalesce(max(severity), 0) >= 3 AS failed FROM found")
def ci_gate(spark, d):
    return ops.gate(found(spark, d), HIGH)


@query(f"WITH {FOUND} SELECT project, path, rule_id, count(*) AS n, 100e0 * count(*) / sum(count(*)) OVER (PARTITION BY project) AS share FROM found GROUP BY project, path, rule_id")
def rule_shares(spark, d):
    """Findings of each rule in a file, and their percentage of the project's."""
    g = found(spark, d).groupBy("project", "path", "rule_id").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("project")))


@query(f"WITH {FOUND} SELECT rule_id, project, count(*) AS n, grouping(project) AS all_projects FROM found GROUP BY ROLLUP (rule_id, project) HAVING grouping(rule_id) = 0")
def rule_rollup(spark, d):
    """Findings by rule and project, and by rule over all projects."""
    return found(spark, d).rollup("rule_id", "project").agg(F.count("*").alias("n"), F.grouping("project").cast("long").alias("all_projects"), F.grouping("rule_id").alias("__all")).where("__all = 0").drop("__all")


# ---- filters and side tables

ALLOW = [("generic-credential", "docs/de/*", "fixture", None), (None, "docs/es/1*", "vendored", None), ("shouting", None, "", None), ("email", None, "known", "2020-01-01")]
ALLOW_SQL = "NOT ((rule_id LIKE '%.generic-credential' AND path LIKE 'docs/de/%') OR path LIKE 'docs/es/1%')"


@query(f"WITH {FOUND} SELECT ordinal, rule_id, path FROM found WHERE {ALLOW_SQL}")
def allowlist_anti_join(spark, d):
    entries = spark.createDataFrame(ALLOW, "rule string, path string, reason string, until string").withColumn("until", F.to_date("until"))
    return ops.allowlisted(found(spark, d), entries, F.to_date(F.lit("2024-06-01"))).select("ordinal", "rule_id", "path")


@query(f"WITH {FOUND}, base AS (SELECT DISTINCT fingerprint FROM found WHERE start_line % 3 = 0) SELECT ordinal, fingerprint FROM found WHERE fingerprint NOT IN (SELECT fingerprint FROM base)")
def baseline_anti_join(spark, d):
    """What a baseline of every third line doesn't know."""
    f = found(spark, d)
    return ops.new_findings(f, f.where("start_line % 3 = 0")).select("ordinal", "fingerprint")


@query(f"WITH {FOUND}, e AS (SELECT fingerprint, arg_max(CASE WHEN ordinal % 3 = 0 THEN 'suppress' WHEN ordinal % 3 = 1 THEN 'accept' ELSE 'false_positive' END, ordinal) AS status FROM found WHERE ordinal % 5 < 3 GROUP BY fingerprint) SELECT ordinal, CASE status WHEN 'accept' THEN 'accepted' WHEN 'false_positive' THEN 'false_positive' END AS verification FROM found LEFT JOIN e USING (fingerprint) WHERE status IS NULL OR status <> 'suppress'")
def exception_join(spark, d):
    """Exceptions drawn from the findings themselves, the last one of a fingerprint counting."""
    f = found(spark, d)
    status = F.when(F.col("ordinal") % 3 == 0, "suppress").when(F.col("ordinal") % 3 == 1, "accept").otherwise("false_positive")
    e = f.where("ordinal % 5 < 3").select("fingerprint", status.alias("status"), F.lit(None).cast("date").alias("expires_at"), "ordinal")
    return ops.with_exceptions(f, e, F.to_date(F.lit("2024-06-01"))).select("ordinal", "verification")


@query(f"WITH {FOUND}, p(policy, action) AS (VALUES ('no-secrets', 'block'), ('pii-review', 'warn'), ('cwe-359', 'warn')) SELECT policy, action, ordinal FROM found, p WHERE (policy = 'no-secrets' AND severity >= 3 AND scanner = 'secrets') OR (policy = 'pii-review' AND severity >= 2 AND rule_id LIKE '%.phone-number') OR (policy = 'cwe-359' AND list_contains(cwe, 'CWE-359'))")
def policy_violations(spark, d):
    rows = [("no-secrets", "block", "HIGH", "secrets", None, None, None), ("pii-review", "warn", "medium", None, "phone-number", None, None), ("cwe-359", "warn", None, None, None, None, "CWE-359")]
    policies = spark.createDataFrame(rows, "id string, action string, severity string, scanner string, rule string, tag string, cwe string")
    return ops.policy_violations(found(spark, d), policies).select("policy", "action", "ordinal")


@query(f"""WITH {FOUND}, m AS (SELECT *, CASE WHEN path LIKE 'docs/de/%' THEN 1 WHEN path LIKE 'docs/%7.txt' THEN 2 END AS cls, path LIKE 'docs/fr/%' AS inner_path, CASE WHEN path LIKE 'docs/en/1%' THEN 1 WHEN path LIKE 'docs/en/%' THEN -1 ELSE 0 END AS step FROM found),
a AS (SELECT *, CASE WHEN cls IS NOT NULL AND severity >= 1 THEN least(severity + 1, 4) ELSE severity END AS s1 FROM m) SELECT ordinal, severity AS original_severity, CASE WHEN inner_path THEN greatest(s1 - 1, 0) ELSE s1 END AS severity, greatest(0, least(4, likelihood + step)) AS likelihood FROM a""")
def context_regrade(spark, d):
    classes = spark.createDataFrame([("docs/de/**", ["pii"], 1), ("docs/*7.txt", ["payment"], 2)], "path string, classes array<string>, ordinal int")
    internal = spark.createDataFrame([("docs/fr/*", 1)], "path string, ordinal int")
    exposure = spark.createDataFrame([("docs/en/1*", "internet", 1), ("docs/en/*", "internal", 2)], "path string, level string, ordinal int")
    return ops.regraded(found(spark, d), classes, internal, exposure).select("ordinal", "original_severity", "severity", "likelihood")


@query(f"WITH {FOUND}, c AS (SELECT 'docs/' || lang || '/' || doc_id || '.txt' AS path, doc_id % 4 + 1 AS line FROM documents WHERE doc_id % 2 = 0) SELECT ordinal FROM found WHERE EXISTS (SELECT 1 FROM c WHERE c.path = found.path AND c.line BETWEEN found.start_line AND found.start_line)")
def diff_scope(spark, d):
    """Findings on the changed lines of a diff that touches every other file."""
    changed = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), (F.col("doc_id") % 4 + 1).cast("int").alias("line"))
    return ops.in_diff(found(spark, d), changed).select("ordinal")


@query(f"WITH {FOUND} SELECT ordinal, severity FROM found WHERE severity >= 2")
def min_severity(spark, d):
    return ops.at_least(found(spark, d), MEDIUM).select("ordinal", "severity")


# ---- joins, folds and windows


@query(f"""WITH {FOUND}, n AS (SELECT * FROM found WHERE rule_id IN ('pii.phone-number', 'pii.email')), i AS (SELECT * FROM found WHERE rule_id = 'pii.long-number'),
p AS (SELECT i.ordinal, n.ordinal AS n_ordinal, row_number() OVER (PARTITION BY i.ordinal ORDER BY abs(i.start_line - n.start_line), n.ordinal) AS k FROM i JOIN n ON i.path = n.path AND abs(i.start_line - n.start_line) <= 2 AND i.scanner <> n.rule_id)
SELECT n.ordinal AS ordinal, greatest(n.severity, coalesce(x.raised, n.severity)) AS severity, coalesce(x.also, 0) AS also FROM n LEFT JOIN (SELECT n_ordinal, count(*) AS also, max(i.severity) AS raised FROM p JOIN i USING (ordinal) WHERE k = 1 GROUP BY n_ordinal) x ON x.n_ordinal = n.ordinal
UNION ALL SELECT ordinal, severity, 0 FROM i WHERE ordinal NOT IN (SELECT ordinal FROM p)""")
def band_join_merge(spark, d):
    """Imported findings (long numbers, as another tool's) folded into the nearest native one within two lines."""
    f = found(spark, d).withColumn("cve", F.lit(None).cast("string"))
    native = f.where(F.col("rule_id").isin("pii.phone-number", "pii.email"))
    imported = f.where("rule_id = 'pii.long-number'").withColumn("scanner", F.lit("imported"))
    out = ops.merged(native, imported)
    return out.select("ordinal", "severity", F.coalesce(F.size("also_reported_by"), F.lit(0)).cast("long").alias("also")).withColumn("also", F.greatest(F.col("also"), F.lit(0)))


@query(f"WITH {FOUND} SELECT project, path, min(ordinal) FILTER (scanner = 'secrets') AS first_ordinal, 3 AS severity FROM found GROUP BY project, path HAVING count(*) FILTER (scanner = 'secrets') > 0 AND count(*) FILTER (list_has_any(cwe, ['CWE-78', 'CWE-89', 'CWE-95'])) + count(*) FILTER (rule_id = 'pii.email') > 0")
def chain_secret_plus_injection(spark, d):
    """Secrets with an injection in one file; e-mail findings stand for injections here."""
    f = found(spark, d).withColumn("cwe", F.when(F.col("rule_id") == "pii.email", F.array(F.lit("CWE-89"))).otherwise(F.col("cwe")))
    return ops.chains(f).where("chain = 'secret-plus-injection'").select("project", "path", "first_ordinal", "severity")


@query(f"WITH {FOUND} SELECT ordinal, project, row_number() OVER (PARTITION BY project ORDER BY risk_score DESC, ordinal) <= 25 AS reviewed FROM found")
def top_k_enrichment(spark, d):
    return ops.top_for_review(found(spark, d), 25, ["project"]).select("ordinal", "project", "reviewed")


@query(f"WITH {FOUND} SELECT ordinal, scanner || ':' || rule_id || ':' || row_number() OVER (PARTITION BY scanner, rule_id ORDER BY path, start_line, ordinal) AS id FROM found")
def finding_numbers(spark, d):
    return ops.numbered(found(spark, d)).select("ordinal", "id")


@query(f"""WITH {FOUND}, k AS (SELECT *, fingerprint || CASE WHEN row_number() OVER (PARTITION BY start_line % 2, fingerprint ORDER BY start_line, ordinal) = 1 THEN '' ELSE '#' || row_number() OVER (PARTITION BY start_line % 2, fingerprint ORDER BY start_line, ordinal) END AS key FROM (SELECT * EXCLUDE (fingerprint), rule_id || '|' || path AS fingerprint FROM found)),
b AS (SELECT * FROM k WHERE start_line % 2 = 1), a AS (SELECT * FROM k WHERE start_line % 2 = 0)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' WHEN a.severity <> b.severity THEN 'severity_changed' ELSE 'unchanged' END AS change, b.severity AS before_severity, a.severity AS after_severity FROM b FULL JOIN a ON a.key = b.key""")
def scan_drift(spark, d):
    """Two scans: findings on odd lines before, on even lines after."""
    f = found(spark, d).withColumn("fingerprint", F.concat_ws("|", "rule_id", "path"))
    return drift.scan_drift(f.where("start_line % 2 = 1"), f.where("start_line % 2 = 0")).select("key", "change", "before_severity", "after_severity")


@query("""WITH c AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, before || '>' || role AS step FROM c WHERE before IS NOT NULL AND before <> role""")
def role_trust_boundary(spark, d):
    """Turns where a conversation passes from one role to another."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("before", F.lag("role").over(w)).where("before IS NOT NULL AND before <> role")
    return c.select("conv_id", "turn", F.concat_ws(">", "before", "role").alias("step"))


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS seen, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS guarded FROM conversations) SELECT conv_id, turn, n, seen::BIGINT AS seen, guarded FROM c WHERE role = 'assistant'""")
def guard_window(spark, d):
    """Assistant turns with the text of three turns and whether a system turn stands in the last five."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"), F.sum(F.length("text")).over(w.rowsBetween(-2, 0)).alias("seen"), F.max((F.col("role") == "system").cast("int")).over(w.rowsBetween(-4, 0)).alias("guarded"))
    return c.where("role = 'assistant'").drop("role")


@query("""SELECT page_id, url, CASE WHEN url LIKE 'http://%' THEN true ELSE false END AS plain_http, regexp_matches(html, '(?i)<script[^>]*>') AS has_script, regexp_matches(html, '(?i)<form[^>]*>') AS has_form, regexp_matches(url, '[?&](?:token|key|utm_source)=') AS parameter FROM pages WHERE url LIKE 'http://%' OR regexp_matches(url, '[?&](?:token|key|utm_source)=')""")
def http_url_pages(spark, d):
    p = table(spark, d, "pages")
    plain, parameter = F.startswith("url", F.lit("http://")), F.rlike("url", F.lit("[?&](?:token|key|utm_source)="))
    return p.where(plain | parameter).select("page_id", "url", plain.alias("plain_http"), F.rlike("html", F.lit("(?i)<script[^>]*>")).alias("has_script"), F.rlike("html", F.lit("(?i)<form[^>]*>")).alias("has_form"), parameter.alias("parameter"))


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def known_texts(spark, d):
    """Documents that hold a known text whole, met by the text's first line of three words or more in either table."""
    from ..operators.matching import containing

    docs, known = table(spark, d, "documents"), table(spark, d, "benchmark")
    return containing(docs.select("doc_id", "text"), known.select("item_id", F.col("text").alias("known")))


# ---- packages


def packages(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    version = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string"), F.lit(".0"))
    return li.select(F.col("p_type").alias("ecosystem"), F.col("l_suppkey").alias("manifest"), F.col("p_brand").alias("package"), version.alias("version"), F.col("l_orderkey").alias("ordinal"), "l_linenumber", "l_returnflag")


PACKAGES = "packages AS (SELECT p_type AS ecosystem, l_suppkey AS manifest, p_brand AS package, l_linenumber || '.' || l_quantity::INT || '.0' AS version, l_orderkey AS ordinal, l_linenumber, l_quantity::INT AS minor, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {PACKAGES}, i AS (SELECT ecosystem, package, version, manifest, row_number() OVER (PARTITION BY ecosystem, package, version ORDER BY manifest) AS k FROM packages) SELECT ecosystem, package, version, manifest FROM i WHERE k = 1")
def package_inventory(spark, d):
    """The first manifest of each package version."""
    return dependencies.inventory(packages(spark, d).withColumn("parser_rank", F.lit(0)))


def advisories(spark, d):
    p = table(spark, d, "part").where("p_size <= 7")
    op = F.element_at(F.array(*map(F.lit, ["<", "<=", ">=", "==", ">"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    clause = F.concat(op, F.lit(" "), (F.col("p_size")).cast("string"), F.lit("."), (F.col("p_partkey") % 50).cast("string"), F.lit(".0"))
    level = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.concat(F.lit("ADV-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("ecosystem"), F.col("p_brand").alias("package"), clause.alias("vulnerable"), level.alias("severity"), F.concat(F.lit("CVE-"), (F.col("p_partkey") % 40).cast("string")).alias("cve"))


ADVISORIES = "advisories AS (SELECT 'ADV-' || p_partkey AS id, p_partkey, p_type AS ecosystem, p_brand AS package, p_size AS major, p_partkey % 50 AS minor, p_partkey % 5 AS severity, 'CVE-' || (p_partkey % 40) AS cve FROM part WHERE p_size <= 7)"
VULNERABLE = f"""{PACKAGES}, {ADVISORIES}, pk AS (SELECT DISTINCT ecosystem, package, version, l_linenumber AS major, minor FROM packages),
vulnerable AS (SELECT pk.ecosystem, pk.package, pk.version, a.id, a.cve, a.severity FROM pk JOIN advisories a ON pk.ecosystem = a.ecosystem AND pk.package = a.package AND CASE a.p_partkey % 5 WHEN 0 THEN (pk.major, pk.minor) < (a.major, a.minor) WHEN 1 THEN (pk.major, pk.minor) <= (a.major, a.minor) WHEN 2 THEN (pk.major, pk.minor) >= (a.major, a.minor) WHEN 3 THEN (pk.major, pk.minor) = (a.major, a.minor) ELSE (pk.major, pk.minor) > (a.major, a.minor) END)"""


@query(f"WITH {VULNERABLE} SELECT ecosystem, package, version, id FROM vulnerable")
def advisory_match(spark, d):
    """Packages with the advisories whose version range they are in."""
    return dependencies.vulnerable(packages(spark, d), advisories(spark, d)).select("ecosystem", "package", "version", "id")


@query(f"WITH {VULNERABLE}, k AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, package, version, cve ORDER BY severity DESC, id) AS k FROM vulnerable) SELECT ecosystem, package, version, cve, id FROM k WHERE k = 1")
def cve_argmax(spark, d):
    """One advisory for each CVE of a package, the most severe."""
    return dependencies.vulnerable_once(packages(spark, d), advisories(spark, d)).select("ecosystem", "package", "version", "cve", "id")


@query(f"WITH {VULNERABLE}, s AS (SELECT 'CVE-' || n_nationkey AS cve, n_nationkey / 25e0 AS epss, n_nationkey % 4 = 0 AS kev FROM nation) SELECT package, version, id, epss, coalesce(kev, false) AS kev FROM vulnerable LEFT JOIN s USING (cve)")
def exploit_signals(spark, d):
    signals = table(spark, d, "nation").select(F.concat(F.lit("CVE-"), F.col("n_nationkey").cast("string")).alias("cve"), (F.col("n_nationkey") / 25.0).alias("epss"), (F.col("n_nationkey") % 4 == 0).alias("kev"))
    return dependencies.with_signals(dependencies.vulnerable(packages(spark, d), advisories(spark, d)), signals).select("package", "version", "id", "epss", "kev")


@query("""WITH names AS (SELECT DISTINCT p_name AS name FROM part), popular AS (SELECT DISTINCT p_name || 's' AS popular FROM part WHERE length(p_name) % 2 = 0 UNION SELECT DISTINCT p_name FROM part WHERE length(p_name) % 3 = 0) SELECT name, min(popular) AS popular FROM names, popular WHERE levenshtein(lower(name), lower(popular)) <= 1 AND lower(name) <> lower(popular) AND lower(name) NOT IN (SELECT lower(popular) FROM popular) GROUP BY name""")
def typosquat(spark, d):
    """Names one edit from a popular one (some names in the plural, and some as they are), through deletion neighbourhoods: an equi join, not a product."""
    part = table(spark, d, "part")
    names = part.select(F.lit("npm").alias("ecosystem"), F.col("p_name").alias("package")).distinct()
    popular = part.where("length(p_name) % 2 = 0").select(F.concat("p_name", F.lit("s")).alias("name")).union(part.where("length(p_name) % 3 = 0").select("p_name")).distinct().select(F.lit("npm").alias("ecosystem"), "name")
    return dependencies.typosquats(names, popular).select(F.col("package").alias("name"), F.col("lookalike").alias("popular"))


@query("""WITH pk AS (SELECT DISTINCT p_brand AS package FROM part), imp AS (SELECT DISTINCT lower(regexp_replace(p_brand, '[-_.]+', '_', 'g')) AS module FROM part WHERE p_size < 3) SELECT package, CASE WHEN lower(regexp_replace(package, '[-_.]+', '_', 'g')) IN (SELECT module FROM imp) THEN 'imported' ELSE 'not_imported' END AS reachability FROM pk""")
def reachability(spark, d):
    part = table(spark, d, "part")
    imports = part.where("p_size < 3").select(F.col("p_brand").alias("module"))
    alias = spark.createDataFrame([("no-such-distribution", "other")], "distribution string, module string")
    return dependencies.reachability(part.select(F.col("p_brand").alias("package")).distinct(), imports, alias).select("package", "reachability")


DIFF = f"""WITH {PACKAGES}, o AS (SELECT ecosystem, package, manifest, arg_max(version, ordinal * 100 + l_linenumber) AS version FROM packages WHERE l_returnflag = 'A' GROUP BY ALL), n AS (SELECT ecosystem, package, manifest, arg_max(version, ordinal * 100 + l_linenumber) AS version FROM packages WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT coalesce(o.ecosystem, n.ecosystem) AS ecosystem, coalesce(o.package, n.package) AS package, coalesce(o.manifest, n.manifest) AS manifest, o.version AS old_version, n.version AS new_version, CASE WHEN o.version IS NULL THEN 'added' WHEN n.version IS NULL THEN 'removed' WHEN o.version <> n.version THEN 'changed' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.ecosystem = n.ecosystem AND o.package = n.package AND o.manifest = n.manifest"""


@query(DIFF)
def dependency_diff(spark, d):
    """Inventories of returned and accepted items, the last version of a key on either side."""
    p = packages(spark, d).withColumn("ordinal", F.col("ordinal") * 100 + F.col("l_linenumber"))
    return drift.package_diff(p.where("l_returnflag = 'A'"), p.where("l_returnflag = 'R'"), ["ecosystem", "package", "manifest"])


@query(DIFF.replace("ecosystem, package, manifest, arg_max", "ecosystem, package, arg_max").replace("coalesce(o.manifest, n.manifest) AS manifest, ", "").replace(" AND o.manifest = n.manifest", ""))
def inventory_drift(spark, d):
    p = packages(spark, d).withColumn("ordinal", F.col("ordinal") * 100 + F.col("l_linenumber"))
    return drift.package_diff(p.where("l_returnflag = 'A'"), p.where("l_returnflag = 'R'"), ["ecosystem", "package"])


# ---- history, audit, accuracy, monitoring


def scans(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created_at"), F.bround(F.col("o_totalprice") / 10000.0, 1).alias("risk_score"), (F.col("o_orderkey") % 5).cast("int").alias("highest_severity"))


SCANS = "scans AS (SELECT o_orderkey AS id, o_custkey AS project_id, o_orderdate AS created_at, round_even(o_totalprice / 10000e0, 1) AS risk_score, (o_orderkey % 5)::INT AS highest_severity FROM orders)"


@query(f"WITH {SCANS}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS k, count(*) OVER (PARTITION BY project_id) AS scans FROM scans) SELECT project_id, id, created_at, risk_score, highest_severity, scans FROM k WHERE k = 1")
def latest_scan_per_project(spark, d):
    return history.latest(scans(spark, d))


@query(f"WITH {SCANS}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS k FROM scans) SELECT id, project_id FROM k WHERE k <= 3")
def retention(spark, d):
    """The newest three scans of each project."""
    return history.retained(scans(spark, d), 3).select("id", "project_id")


@query(f"WITH {SCANS} SELECT project_id, id, created_at, risk_score, risk_score - lag(risk_score) OVER (PARTITION BY project_id ORDER BY created_at, id) AS change FROM scans")
def risk_trend(spark, d):
    return history.trend(scans(spark, d)).select("project_id", "id", "created_at", "risk_score", "change")


@query(f"WITH {SCANS}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS k FROM scans) SELECT count(DISTINCT project_id) AS projects, count(*) AS scans, count(*) FILTER (k = 1 AND highest_severity = 4) AS open_critical, max(risk_score) FILTER (k = 1) AS worst_risk FROM k")
def dashboard_stats(spark, d):
    return history.stats(scans(spark, d))


CONFUSION = """WITH c AS (SELECT source AS category, toxic = 1 AS vulnerable, regexp_matches(text, '(?i)idiot|moron|stupid|trash|loser') AS flagged FROM documents JOIN labels USING (doc_id)), g AS (SELECT category, count(*) FILTER (vulnerable AND flagged) AS tp, count(*) FILTER (NOT vulnerable AND flagged) AS fp, count(*) FILTER (NOT vulnerable AND NOT flagged) AS tn, count(*) FILTER (vulnerable AND NOT flagged) AS fn FROM c GROUP BY GROUPING SETS ((category), ()))
SELECT coalesce(category, '(overall)') AS category, tp, fp, tn, fn, round(tp / nullif(tp + fn, 0)::DOUBLE, 4) AS tpr, round(fp / nullif(fp + tn, 0)::DOUBLE, 4) AS fpr, round(tp / nullif(tp + fp, 0)::DOUBLE, 4) AS precision FROM g"""


@query(CONFUSION)
def confusion_metrics(spark, d):
    """A word list measured against the toxicity labels, per source and over all."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    cases = docs.select(F.col("source").alias("category"), (F.col("toxic") == 1).alias("vulnerable"), F.rlike("text", F.lit("(?i)idiot|moron|stupid|trash|loser")).alias("flagged"))
    return metrics.confusion(cases).select("category", "tp", "fp", "tn", "fn", "tpr", "fpr", "precision")


@query("""WITH c AS (SELECT lang, quality, regexp_matches(text, '!!|\\|') AS detected FROM documents JOIN labels USING (doc_id) WHERE quality = 0) SELECT coalesce(lang, '(overall)') AS grp, count(*) AS cases, count(*) FILTER (detected) AS detected, round(count(*) FILTER (detected) / count(*)::DOUBLE, 4) AS recall FROM c GROUP BY ROLLUP (lang)""")
def recall_by_group(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality = 0")
    return metrics.recall(docs.select(F.col("lang").alias("grp"), F.rlike("text", F.lit(r"!!|\|")).alias("detected")))


@query(f"""WITH {FOUND}, c AS (SELECT doc_id AS case_id, 'docs/' || lang || '/' || doc_id || '.txt' AS path, unnest([doc_id % 5 + 1, doc_id % 9 + 3]) AS line FROM documents) SELECT case_id, bool_or(f.ordinal IS NOT NULL) AS detected FROM c LEFT JOIN found f ON f.path = c.path AND abs(f.start_line - c.line) <= 3 GROUP BY case_id""")
def heldout_window(spark, d):
    """Cases with a finding within three lines of a changed one."""
    docs = table(spark, d, "documents")
    changed = docs.select(F.col("doc_id").alias("case_id"), F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.explode(F.array((F.col("doc_id") % 5 + 1).cast("int"), (F.col("doc_id") % 9 + 3).cast("int"))).alias("line"))
    return metrics.in_window(changed, found(spark, d), 3)


AUDIT_SQL = """WITH e AS (SELECT user_id AS actor, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events) SELECT actor, count(*) AS events, min(seq) FILTER (event_id % 97 IN (5, 7)) AS first_broken FROM e GROUP BY actor"""


@query(AUDIT_SQL)
def hash_chain_verify(spark, d):
    """Sealed chains of event records by user, some records and some links tampered with: the first broken place of each."""
    from ..operators import audit

    w = Window.partitionBy("actor").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("actor"), "event_id", F.lit(1).alias("v"), F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("action"), F.col("props").alias("details"))
    e = e.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
    e = e.withColumns({c: F.lit(None).cast("string") for c in audit.FIELDS if c not in ("actor", "action", "details")})
    log = audit.sealed(e, ["actor"])
    log = log.withColumn("details", F.when(F.col("event_id") % 97 == 5, "tampered").otherwise(F.col("details"))).withColumn("prev_hash", F.when(F.col("event_id") % 97 == 7, "tampered").otherwise(F.col("prev_hash")))
    return audit.first_break(log, ["actor"]).select(F.col("actor").cast("long").alias("actor"), "events", "first_broken")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def monitor_tumbling_counts(spark, d):
    """Daily counts of monitoring events; streaming.monitor gives the same rows from a stream."""
    from ..streaming.monitor import tumbling

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(e, "1 day").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session""")
def monitor_sessions(spark, d):
    """Sessions of a user's events with gaps of six hours at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(w)
    s = table(spark, d, "events").withColumn("session", F.sum(F.when(gap <= 6 * 3600, 0).otherwise(1)).over(w))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("session")

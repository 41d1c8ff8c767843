"""More registered queries: suppression, correlation over projects, reports, file states, inventories, accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reports, scoring
from ..functions.model import SEVERITIES
from ..functions.prefix import with_sum_before
from ..operators import analysis, audit, dependencies, drift, history, metrics, probes
from ..operators import findings as ops
from ..sources.files import lines, windows
from .queries import ADVISORIES, FOUND, LINES, PACKAGES, SCANS, VULNERABLE, advisories, corpus, found, packages, query, scans, table

TODAY = "2024-06-01"


@query(f"WITH {FOUND} SELECT ordinal FROM found WHERE NOT (path LIKE 'docs/es/%' AND start_line % 2 = 0 AND (start_line % 4 <> 0 OR rule_id LIKE '%.email'))")
def inline_suppression(spark, d):
    """Ignore comments put on every other line of Spanish files, on every fourth for one rule only."""
    f = found(spark, d)
    every, one = "# spanwarden-ignore reason='known'", "# spanwarden-ignore: email reason='known' until=2030-01-01"
    note = F.when(F.startswith("path", F.lit("docs/es/")) & (F.col("line") % 2 == 0), F.when(F.col("line") % 4 == 0, one).otherwise(every)).otherwise("")
    noted = lines(corpus(spark, d)).withColumn("content", F.concat_ws(" ", F.lit("x"), note))
    return ops.inline_suppressed(f, noted, F.to_date(F.lit(TODAY))).select("ordinal")


@query(f"""WITH {LINES} SELECT path, line, greatest(1, ceil((length(content) - 256) / 1744e0))::INT AS windows FROM lines WHERE length(content) > 2000""")
def line_windows(spark, d):
    """How many overlapping windows each long line has."""
    w = windows(lines(corpus(spark, d))).where(F.length("content") > 2000)
    return w.groupBy("path", "line").agg(F.count("*").cast("int").alias("windows"))


@query(f"WITH {FOUND} SELECT ordinal FROM found WHERE NOT (rule_id = 'pii.email' AND path LIKE 'docs/de/%')")
def ast_preference(spark, d):
    """Pattern findings of a class that a syntax tier owns go in the files it covers: e-mail findings in German files here."""
    f = found(spark, d)
    f = f.withColumn("path", F.when(F.startswith("path", F.lit("docs/de/")), F.regexp_replace("path", "txt$", "py")).otherwise(F.col("path")))
    guess = F.col("rule_id") == "pii.email"
    f = f.withColumn("scanner", F.when(guess, "patterns").otherwise(F.col("scanner"))).withColumn("cwe", F.when(guess, F.array(F.lit("CWE-79"))).otherwise(F.col("cwe")))
    return ops.prefer_ast(f, ["ast-python"]).select("ordinal")


@query(f"WITH {FOUND}, a AS (SELECT project, min(ordinal) AS ordinal FROM found WHERE rule_id = 'pii.ip-address' GROUP BY project), b AS (SELECT DISTINCT project FROM found WHERE scanner = 'secrets') SELECT project, a.ordinal AS first_ordinal FROM a JOIN b USING (project)")
def chain_ssrf_to_credentials(spark, d):
    """Project-wide correlation: addresses stand for server-side requests, credentials for cloud ones."""
    f = found(spark, d)
    f = f.withColumn("cwe", F.when(F.col("rule_id") == "pii.ip-address", F.array(F.lit("CWE-918"))).otherwise(F.col("cwe")))
    f = f.withColumn("rule_id", F.when(F.col("scanner") == "secrets", F.lit("secrets.aws-secret-access-key")).otherwise(F.col("rule_id")))
    return ops.chains(f).where("chain = 'ssrf-to-cloud-credentials'").select("project", "first_ordinal")


@query(f"WITH {FOUND} SELECT rule_id, scanner, {'CASE severity ' + ' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(SEVERITIES)) + ' END'} AS severity, risk_score, path, start_line, array_to_string(cwe, ';') AS cwe, fingerprint FROM found")
def report_csv(spark, d):
    return reports.csv_rows(found(spark, d)).select("rule_id", "scanner", "severity", "risk_score", "path", "start_line", "cwe", "fingerprint")


@query(f"WITH {FOUND} SELECT sha256(fingerprint || CASE WHEN row_number() OVER (PARTITION BY fingerprint ORDER BY ordinal) = 1 THEN '' ELSE '#' || row_number() OVER (PARTITION BY fingerprint ORDER BY ordinal) END) AS id, rule_id AS name, path AS file, start_line FROM found")
def report_gitlab(spark, d):
    return reports.gitlab(found(spark, d)).select("id", "name", "file", "start_line")


@query()
def report_sarif(spark, d):
    """SARIF documents of each project, in parts of bounded size."""
    return reports.sarif(found(spark, d), by=["project"])


@query(f"WITH {FOUND} SELECT 'security' AS label, CASE max(severity) {' '.join(f'WHEN {i} THEN {chr(39)}{n.lower()}{chr(39)}' for i, n in enumerate(SEVERITIES))} ELSE 'passing' END AS message, CASE WHEN max(severity) IS NULL THEN 'brightgreen' WHEN max(severity) >= 4 THEN 'red' WHEN max(severity) = 3 THEN 'orange' WHEN max(severity) = 2 THEN 'yellow' ELSE 'green' END AS color FROM found")
def report_badge(spark, d):
    return reports.badge(found(spark, d))


@query(f"WITH {FOUND}, f AS (SELECT *, CASE WHEN list_has_any(cwe, ['CWE-798']) THEN 'A secret is part of the files.' END AS why FROM found) SELECT ordinal, why, why IS NOT NULL AND severity >= 2 AS simulated FROM f")
def offline_enrichment(spark, d):
    return analysis.enriched(found(spark, d)).select("ordinal", "why", "simulated")


@query(f"WITH {PACKAGES}, p AS (SELECT DISTINCT 'pkg:' || lower(ecosystem) || '/' || package || '@' || version AS purl, package, version FROM packages) SELECT purl, substr(sha256(purl), 1, 32) AS bom_ref, package, version FROM p")
def sbom_components(spark, d):
    """Components as the software bills of materials list them."""
    p = packages(spark, d).select("ecosystem", "package", "version").distinct().withColumn("purl", scoring.purl(F.col("ecosystem"), F.col("package"), F.col("version")))
    return p.select("purl", F.substring(F.sha2("purl", 256), 1, 32).alias("bom_ref"), "package", "version")


@query()
def sbom_cyclonedx(spark, d):
    """The bills of materials themselves, one for each manifest."""
    return reports.cyclonedx(packages(spark, d), "urn:uuid:00000000-0000-0000-0000-000000000000", ["manifest"])


@query(f"WITH {PACKAGES}, o AS (SELECT DISTINCT 'pkg:' || lower(ecosystem) || '/' || package || '@' || version AS purl FROM packages WHERE l_returnflag = 'A'), n AS (SELECT DISTINCT 'pkg:' || lower(ecosystem) || '/' || package || '@' || version AS purl FROM packages WHERE l_returnflag = 'R') SELECT purl, 'added' AS change FROM n WHERE purl NOT IN (SELECT purl FROM o) UNION ALL SELECT purl, 'removed' FROM o WHERE purl NOT IN (SELECT purl FROM n)")
def sbom_diff(spark, d):
    p = packages(spark, d)
    return reports.sbom_diff(p.where("l_returnflag = 'A'"), p.where("l_returnflag = 'R'"))


@query(f"WITH {VULNERABLE}, imp AS (SELECT DISTINCT p_brand AS package FROM part WHERE p_size < 3) SELECT cve, 'pkg:' || lower(ecosystem) || '/' || package || '@' || version AS purl, CASE WHEN bool_and(package NOT IN (SELECT package FROM imp)) THEN 'not_affected' ELSE 'affected' END AS status FROM vulnerable GROUP BY ALL")
def vex_statements(spark, d):
    """Statements on vulnerable packages: not affected just where nothing imports them."""
    part = table(spark, d, "part")
    hits = dependencies.vulnerable(packages(spark, d), advisories(spark, d))
    reach = dependencies.reachability(part.select(F.col("p_brand").alias("package")).distinct(), part.where("p_size < 3").select(F.col("p_brand").alias("module")), spark.createDataFrame([], "distribution string, module string"))
    return reports.vex(hits.join(reach, "package"))


@query(f"WITH {VULNERABLE} SELECT v.id, p.manifest, v.package, v.version, v.severity FROM vulnerable v JOIN (SELECT ecosystem, package, version, min(manifest) AS manifest FROM packages GROUP BY ALL) p USING (ecosystem, package, version)")
def dependency_findings(spark, d):
    """Findings of vulnerable packages in their first manifest."""
    p = packages(spark, d).withColumn("parser_rank", F.lit(0))
    f = dependencies.advisory_findings(dependencies.vulnerable(p, advisories(spark, d)), dependencies.inventory(p))
    split = F.split("snippet", "==")
    return f.select(F.replace("rule_id", F.lit("dependencies."), F.lit("")).alias("id"), F.col("path").alias("manifest"), split[0].alias("package"), split[1].alias("version"), "severity")


@query(f"WITH {PACKAGES}, bad AS (SELECT DISTINCT p_type AS ecosystem, upper(p_brand) AS name FROM part WHERE p_partkey % 11 = 0) SELECT DISTINCT packages.ecosystem, package FROM packages JOIN bad ON packages.ecosystem = bad.ecosystem AND lower(package) = lower(name)")
def known_malicious(spark, d):
    bad = table(spark, d, "part").where("p_partkey % 11 = 0").select(F.col("p_type").alias("ecosystem"), F.upper("p_brand").alias("name"))
    return dependencies.malicious(packages(spark, d).select("ecosystem", "package").distinct(), bad)


@query(f"WITH {ADVISORIES}, s AS (SELECT id, [package || '.' || lower(ecosystem), package || '.f' || (p_partkey % 7)] AS symbols, p_partkey FROM advisories), u AS (SELECT DISTINCT 'f' || (p_size % 4) AS symbol FROM part) SELECT id, CASE WHEN 'f' || (p_partkey % 7) IN (SELECT symbol FROM u) THEN 'reachable' ELSE 'not_reachable' END AS symbol_reachability FROM s")
def symbol_reachability(spark, d):
    p = table(spark, d, "part").where("p_size <= 7")
    m = p.select(F.concat(F.lit("ADV-"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.concat_ws(".", "p_brand", F.lower("p_type")), F.concat(F.col("p_brand"), F.lit(".f"), (F.col("p_partkey") % 7).cast("string"))).alias("affected_symbols"))
    used = table(spark, d, "part").select(F.concat(F.lit("f"), (F.col("p_size") % 4).cast("string")).alias("symbol"))
    return dependencies.symbol_reachability(m, used).select("id", "symbol_reachability")


STATES = """k AS (SELECT user_id::VARCHAR AS path, max(event_type) AS digest, min(event_type) AS mode FROM events WHERE event_id % 2 = 0 AND user_id % 7 <> 1 GROUP BY ALL), s AS (SELECT user_id::VARCHAR AS path, max(event_type) AS digest, arg_min(event_type, event_id) AS mode FROM events WHERE event_id % 2 = 1 AND user_id % 7 <> 2 AND event_type <> 'view' GROUP BY ALL)"""


@query(f"WITH {STATES} SELECT coalesce(k.path, s.path) AS path, CASE WHEN k.path IS NULL THEN 'fim.file-created' WHEN s.path IS NULL THEN 'fim.file-removed' WHEN k.digest <> s.digest THEN 'fim.content-changed' ELSE 'fim.permission-changed' END AS rule_id FROM k FULL JOIN s ON k.path = s.path WHERE k.path IS NULL OR s.path IS NULL OR k.digest <> s.digest OR k.mode <> s.mode")
def file_integrity(spark, d):
    """Two states of paths, from even and odd events of each user."""
    e = table(spark, d, "events")
    path = F.col("user_id").cast("string").alias("path")
    known = e.where("event_id % 2 = 0 AND user_id % 7 <> 1").groupBy(path).agg(F.max("event_type").alias("digest"), F.min("event_type").alias("mode"))
    seen = e.where("event_id % 2 = 1 AND user_id % 7 <> 2 AND event_type <> 'view'").groupBy(path).agg(F.max("event_type").alias("digest"), F.min_by("event_type", "event_id").alias("mode"))
    yes = F.lit(True).alias("readable")
    return drift.file_integrity(known.select("*", yes), seen.select("*", yes)).select("path", "rule_id")


@query("""WITH o AS (SELECT o_custkey AS project, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F')) AS b, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'O')) AS a FROM orders GROUP BY ALL) SELECT project, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)))::INT AS gained, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x)))::INT AS lost FROM o WHERE a IS NOT NULL OR b IS NOT NULL""")
def architecture_drift(spark, d):
    """What each project's set of labels gained and lost between two states."""

    def side(status):
        return table(spark, d, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("project")).agg(F.collect_set("o_orderpriority").alias("labels"))

    return drift.set_drift(side("F"), side("O"), "project", ["labels"]).select("project", F.size("labels_added").alias("gained"), F.size("labels_removed").alias("lost"))


@query("""WITH l AS (SELECT s_suppkey AS target, CASE s_suppkey % 4 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '::' ELSE '10.0.0.' || (s_suppkey % 200) END AS host FROM supplier) SELECT target, CASE WHEN host IN ('0.0.0.0', '::') THEN 'wildcard' WHEN host LIKE '127.%' THEN 'loopback' ELSE 'interface' END AS scope FROM l""")
def listener_scope(spark, d):
    """Bind scopes of listeners parsed from socket listings."""
    k = F.col("s_suppkey") % 4
    host = F.when(k == 0, "0.0.0.0").when(k == 1, "[::ffff:127.0.0.1]").when(k == 2, "[::]").otherwise(F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 200).cast("string")))
    raw = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.concat(F.lit("LISTEN 0 128 "), host, F.lit(":"), (F.col("s_suppkey") % 60000 + 1).cast("string"), F.lit(" *:*")).alias("text"))
    return probes.listeners(raw).select("target", "scope")


@query("""WITH v AS (SELECT doc_id AS case_id, regexp_matches(text, '!!|\\|') AS detected FROM documents), p AS (SELECT doc_id AS case_id, regexp_matches(text, '@') AS flagged FROM documents) SELECT count(*) AS cases, count(*) FILTER (detected) AS detected, count(*) FILTER (NOT detected) AS missed, count(*) FILTER (flagged) AS flagged_after_fix, count(*) FILTER (detected AND flagged) AS still_flagged, count(*) FILTER (detected AND NOT flagged) AS fix_aware_detected, round(count(*) FILTER (detected) / count(*)::DOUBLE, 4) AS recall, round(count(*) FILTER (detected AND NOT flagged) / count(*)::DOUBLE, 4) AS fix_aware_recall, round(count(*) FILTER (detected) / (count(*) FILTER (detected) + count(*) FILTER (flagged))::DOUBLE, 4) AS precision_proxy FROM v JOIN p USING (case_id)""")
def heldout_summary(spark, d):
    docs = table(spark, d, "documents")
    v = docs.select(F.col("doc_id").alias("case_id"), F.rlike("text", F.lit(r"!!|\|")).alias("detected"))
    p = docs.select(F.col("doc_id").alias("case_id"), F.rlike("text", F.lit("@")).alias("detected"))
    return metrics.summary(metrics.outcomes(v, p))


@query("""SELECT source AS advisory, bool_or(regexp_matches(text, '!!')) AS detected, bool_or(regexp_matches(text, '@')) AS flagged_after_fix FROM documents GROUP BY ALL""")
def heldout_advisories(spark, d):
    """An advisory is detected where any of its files is."""
    docs = table(spark, d, "documents")
    o = docs.select(F.col("doc_id").alias("case_id"), F.rlike("text", F.lit("!!")).alias("detected"), F.rlike("text", F.lit("@")).alias("flagged_after_fix"))
    return metrics.by_advisory(o, docs.select(F.col("doc_id").alias("case_id"), F.col("source").alias("ghsa_id"))).withColumnRenamed("case_id", "advisory")


@query("""WITH c AS (SELECT source AS category, toxic = 1 AS v, regexp_matches(text, '(?i)idiot|moron|stupid') AS f FROM documents JOIN labels USING (doc_id)), g AS (SELECT category, count(*) FILTER (v AND f) / nullif(count(*) FILTER (v), 0)::DOUBLE AS tpr, count(*) FILTER (NOT v AND f) / nullif(count(*) FILTER (NOT v), 0)::DOUBLE AS fpr FROM c GROUP BY ALL) SELECT round(avg(tpr), 4) AS tpr, round(avg(fpr), 4) AS fpr, round(avg(tpr - fpr), 4) AS score FROM g""")
def category_mean(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return metrics.category_mean(docs.select(F.col("source").alias("category"), (F.col("toxic") == 1).alias("vulnerable"), F.rlike("text", F.lit("(?i)idiot|moron|stupid")).alias("flagged")))


@query("""SELECT event_type AS action, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') WHERE k = 1 GROUP BY ALL""")
def audit_once(spark, d):
    """Log rows of a time range, once for each actor and action."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))
    return audit.once(audit.filtered(e, "2024-01-05", "2024-01-20"), ["actor", "action"]).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {SCANS}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS k FROM scans) SELECT project_id, id, risk_score FROM k WHERE k = 1 AND risk_score >= 25")
def projects_by_risk(spark, d):
    """Latest scans of projects from a risk of 25 on, riskiest first."""
    return history.by_risk(scans(spark, d)).where("risk_score >= 25").select("project_id", "id", "risk_score")


@query(f"""WITH {FOUND}, b AS (SELECT project, path, sum(least(length(coalesce(text, '')), 20000)) OVER (PARTITION BY project ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, least(length(coalesce(text, '')), 20000) AS n FROM (SELECT source AS project, 'docs/' || lang || '/' || doc_id || '.txt' AS path, text FROM documents)) SELECT project, count(*) AS files, sum(least(n, 1500000 - coalesce(before, 0)))::BIGINT AS chars FROM b WHERE coalesce(before, 0) < 1500000 GROUP BY project""")
def source_blob(spark, d):
    """How much of each project the bounded source tests read."""
    return analysis.source_blob(corpus(spark, d)).groupBy("project").agg(F.count("*").alias("files"), F.sum(F.length("part")).alias("chars"))


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), g AS (SELECT conv_id, bool_or(role = 'system') AS guarded, count(*) FILTER (role = 'user') AS asks, count(*) FILTER (role = 'assistant') AS answers FROM c GROUP BY ALL) SELECT conv_id, asks, answers FROM g WHERE NOT guarded AND asks > 0 AND answers > 0""")
def unguarded_conversations(spark, d):
    """Model calls that have an outside source and an answer but no system turn: grouped, then filtered."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("guarded"), F.count_if(F.col("role") == "user").alias("asks"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return c.where("NOT guarded AND asks > 0 AND answers > 0").drop("guarded")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, len(regexp_extract_all(html, '<a href="/')) AS relative_links, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ORDER BY length(html) DESC, page_id) AS size_rank FROM pages""")
def page_inventory(spark, d):
    """Pages of hosts by size, with their links."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    p = table(spark, d, "pages").withColumn("host", host)
    p = with_sum_before(p.select("page_id", "host", F.length("html").alias("size"), F.size(F.regexp_extract_all("html", F.lit('<a href="/'), F.lit(0))).alias("relative_links")), ["host"], [F.desc("size"), "page_id"], F.lit(1), "before")
    return p.select("page_id", "host", "relative_links", (F.col("before") + 1).cast("int").alias("size_rank"))

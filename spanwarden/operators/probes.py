"""Checks over probe tables: HTTP answers, containers, hosts, repositories. Loaders fill the tables; checks filter them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import CRITICAL, HIGH, INFO, LOW, MEDIUM

#: Headers whose absence is reported, with severity; paths that must not answer: fixed values.
HEADERS = {"strict-transport-security": MEDIUM, "content-security-policy": MEDIUM, "x-content-type-options": LOW, "referrer-policy": LOW}
EXPOSED = (".env", ".git/config", ".git/HEAD", ".aws/credentials", "actuator/env", "server-status", "phpinfo.php", "config.json")
#: Manifests whose changes are reported, and ends of files that must not be tracked: fixed values.
MANIFESTS = ("requirements.txt", "package.json", "go.mod", "Cargo.toml")
DANGEROUS = (".pem", ".key", ".p12", ".env", "id_rsa")
_OPEN = "|".join("/" + p.replace(".", r"\.") + "$" for p in EXPOSED)


def _finding(rows: DataFrame, rule: Column | str, severity: Column | int, confidence: int = 2, cwe: tuple[str, ...] = ()) -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    severity = F.lit(severity) if isinstance(severity, int) else severity
    return rows.select("target", rule.alias("rule_id"), severity.cast("int").alias("severity"), F.lit(confidence).alias("confidence"), (F.array(*map(F.lit, cwe)) if cwe else F.array()).cast("array<string>").alias("cwe"), "detail")


def http_posture(answers: DataFrame) -> DataFrame:
    """answers(target, url, status, headers map in lower case, cookies array of header values): transport, headers, cookies, versions, exposed paths."""
    a = answers.withColumn("detail", F.col("url"))
    ok = a.where("status IS NOT NULL")
    root = ok.where(~F.rlike("url", F.lit(_OPEN)))
    out = _finding(a.where("status IS NULL"), "posture.unreachable", INFO)
    out = out.union(_finding(root.where(F.startswith("url", F.lit("http://"))), "posture.no-https", HIGH, 2, ("CWE-319",)))
    for name, severity in HEADERS.items():
        out = out.union(_finding(root.where(F.try_element_at("headers", F.lit(name)).isNull()), f"posture.missing-{name}", severity))
    framed = F.coalesce(F.try_element_at("headers", F.lit("content-security-policy")), F.lit(""))
    out = out.union(_finding(root.where(F.try_element_at("headers", F.lit("x-frame-options")).isNull() & ~F.contains(framed, F.lit("frame-ancestors"))), "posture.missing-frame-options", MEDIUM, 2, ("CWE-1021",)))
    c = root.select("target", F.explode("cookies").alias("cookie")).withColumn("name", F.regexp_extract("cookie", "^([^=;]+)", 1))
    lacks = F.filter(F.array(*(F.when(~F.contains(F.lower("cookie"), F.lit(x)), F.lit(x)) for x in ("secure", "httponly", "samesite"))), lambda x: x.isNotNull())
    c = c.withColumn("lacks", lacks).where(F.size("lacks") > 0).withColumn("detail", F.concat_ws(" ", "name", F.array_join("lacks", ",")))
    session = F.rlike("name", F.lit("(?i)sess|auth|token|sid"))
    out = out.union(_finding(c, F.concat(F.lit("posture.cookie-flags-"), "name"), F.when(session, MEDIUM).otherwise(LOW)))
    for name in ("server", "x-powered-by"):
        value = F.try_element_at("headers", F.lit(name))
        out = out.union(_finding(root.where(F.rlike(value, F.lit(r"\d"))).withColumn("detail", value), f"posture.version-disclosure-{name}", LOW))
    open_paths = ok.where((F.col("status") == 200) & F.rlike("url", F.lit(_OPEN)))
    return out.union(_finding(open_paths, "posture.exposed-path", HIGH, 2, ("CWE-538",)))


def dast(answers: DataFrame) -> DataFrame:
    """answers(target, url, marker, body, headers): a marker that comes back unescaped, and any-origin CORS."""
    a = answers.withColumn("detail", F.col("url"))
    out = _finding(a.where(F.contains("body", F.concat(F.lit("<"), "marker", F.lit(">")))), "dast.reflected-input", MEDIUM, 2, ("CWE-79",))
    return out.union(_finding(a.where(F.try_element_at("headers", F.lit("access-control-allow-origin")) == "*"), "dast.cors-wildcard", MEDIUM))


def container_images(images: DataFrame) -> DataFrame:
    """images(target, user, privileged, ports array): root user, privileged mode, exposed ports."""
    i = images.withColumn("detail", F.coalesce("user", F.lit("")))
    out = _finding(i.where(F.coalesce("user", F.lit("")).isin("", "0", "root")), "container-image.root-user", HIGH)
    out = out.union(_finding(i.where("privileged"), "container-image.privileged", CRITICAL))
    ports = i.select("target", F.explode("ports").alias("detail")).withColumn("detail", F.col("detail").cast("string"))
    return out.union(_finding(ports, "container-image.exposed-port", LOW))


def bind_scope(address: Column) -> Column:
    """wildcard, loopback or interface of a listener's host, IPv6-mapped addresses as their IPv4 ones."""
    host = F.regexp_replace(F.regexp_replace(address, r"^\[|\]$", ""), r"(?i)^::ffff:", "")
    return F.when(host.isin("*", "0.0.0.0", "::", ""), "wildcard").when(F.rlike(host, F.lit(r"^127\.|^::1$|^localhost$")), "loopback").otherwise("interface")


def listeners(raw: DataFrame) -> DataFrame:
    """raw(target, text) lines of a socket listing to target, host, port, scope."""
    at = F.regexp_extract("text", r"(\[[0-9a-fA-F:.%\w]*\]|[^\s:]+|\*):(\d+)\s", 1)
    port = F.regexp_extract("text", r"(\[[0-9a-fA-F:.%\w]*\]|[^\s:]+|\*):(\d+)\s", 2)
    rows = raw.where(port != "").select("target", F.regexp_replace(at, r"%\w+", "").alias("host"), port.cast("int").alias("port"))
    return rows.withColumn("scope", bind_scope(F.col("host")))


def host_posture(settings: DataFrame, sockets: DataFrame, accounts: DataFrame) -> DataFrame:
    """settings(target, key, value) of the SSH daemon, sockets as listeners(), accounts(target, name, uid, shell)."""
    s = settings.withColumn("detail", F.concat_ws(" ", "key", "value"))
    out = _finding(s.where("lower(key) = 'permitrootlogin' AND lower(value) NOT IN ('no', 'prohibit-password', 'forced-commands-only')"), "host.ssh-root-login", HIGH)
    out = out.union(_finding(s.where("lower(key) = 'passwordauthentication' AND lower(value) = 'yes'"), "host.ssh-password-auth", MEDIUM))
    l = sockets.withColumn("detail", F.concat_ws(":", "host", F.col("port").cast("string")))
    out = out.union(_finding(l.where("scope <> 'loopback'"), "host.open-listener", F.when(F.col("scope") == "wildcard", MEDIUM).otherwise(LOW)))
    people = accounts.where("uid >= 1000 AND NOT shell RLIKE 'nologin|false'").groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("detail"))
    out = out.union(_finding(people, "host.local-accounts", LOW))
    roots = accounts.where("uid = 0").groupBy("target").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("detail")).where("n > 1")
    return out.union(_finding(roots, "host.multiple-uid0", HIGH))


def repositories(commits: DataFrame, tracked: DataFrame) -> DataFrame:
    """commits(target, seq, email, paths array), the last 20 of each target; tracked(target, path): author domains, manifests touched, dangerous files (the first 10)."""
    from pyspark.sql import Window

    newest = commits.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("seq")))).where("k <= 20")
    domains = newest.groupBy("target").agg(F.count_distinct(F.lower(F.element_at(F.split("email", "@"), -1))).alias("n")).where("n > 4").withColumn("detail", F.col("n").cast("string"))
    out = _finding(domains, "git.author-diversity", LOW, 0)
    # a manifest's own last commits: each is reported once a target
    touched = newest.select("target", F.explode("paths").alias("detail")).where(F.col("detail").isin(*MANIFESTS)).distinct()
    out = out.union(_finding(touched, "git.dependency-manifest-change", MEDIUM))
    ends = reduce(lambda a, b: a | b, (F.endswith("path", F.lit(e)) for e in DANGEROUS))
    bad = tracked.where(ends).withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("path"))).where("k <= 10").withColumn("detail", F.col("path"))
    return out.union(_finding(bad, "git.dangerous-tracked-file", HIGH))

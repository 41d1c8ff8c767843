"""Packages against intelligence: advisories, exploit signals, malicious names, look-alikes, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.model import SEVERITIES, rank
from ..functions.store import keep


#: Distributions whose modules have other names: fixed values.
ALIASES = {
    "pyyaml": ("yaml",), "pillow": ("PIL",), "beautifulsoup4": ("bs4",), "scikit-learn": ("sklearn",), "scikit-image": ("skimage",), "opencv-python": ("cv2",), "opencv-python-headless": ("cv2",),
    "python-dateutil": ("dateutil",), "python-dotenv": ("dotenv",), "python-jose": ("jose",), "python-multipart": ("multipart",), "pycryptodome": ("Crypto",), "pycryptodomex": ("Cryptodome",), "pycrypto": ("Crypto",),
    "psycopg2-binary": ("psycopg2",), "mysqlclient": ("MySQLdb",), "pymongo": ("pymongo", "bson", "gridfs"), "protobuf": ("google.protobuf",), "google-cloud-storage": ("google.cloud.storage",), "attrs": ("attr", "attrs"),
    "setuptools": ("setuptools", "pkg_resources"), "pyjwt": ("jwt",), "pyopenssl": ("OpenSSL",), "pyserial": ("serial",), "pysocks": ("socks",), "msgpack-python": ("msgpack",), "django-cors-headers": ("corsheaders",),
    "djangorestframework": ("rest_framework",), "flask-sqlalchemy": ("flask_sqlalchemy",), "gitpython": ("git",), "grpcio": ("grpc",), "ipython": ("IPython",), "markupsafe": ("markupsafe",), "tensorflow-gpu": ("tensorflow",), "torch": ("torch",),
}


def inventory(packages: DataFrame) -> DataFrame:
    """project (where packages have one), ecosystem, package, version, manifest: of each version the first manifest, parsers in their order."""
    on = [*(["project"] if "project" in packages.columns else []), "ecosystem", "package", "version"]
    first = packages.groupBy(*on).agg(F.min(F.struct("parser_rank", "manifest")).alias("__first"))
    return first.select(*on, "__first.manifest")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by the keys of a join whose sides are small and whose pairs are many: a number that is given is not coalesced by bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *by)


def _met(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Distinct (ecosystem, package, version) with __p, their name, joined to the advisories whose range holds the version.

    Versions and clauses are read once a row of either side, not once a pair.
    """
    pk = packages.select("ecosystem", "package", "version").distinct().withColumn("__p", scoring.package_name(F.col("ecosystem"), F.col("package"))).withColumn("__v", scoring.version_key(F.col("version")))
    op, bound = scoring.clause(F.col("vulnerable"))
    adv = advisories.withColumn("__p", scoring.package_name(F.col("ecosystem"), F.col("package"))).drop("package").withColumn("__op", op).withColumn("__bound", bound)
    return dealt(pk, "ecosystem", "__p").join(dealt(adv, "ecosystem", "__p").hint("shuffle_hash"), ["ecosystem", "__p"]).where(scoring.meets(F.col("__v"), F.col("__op"), F.col("__bound"))).drop("__v", "__op", "__bound")


def vulnerable(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Distinct (ecosystem, package, version) joined to the advisories whose range holds the version."""
    return _met(packages, advisories).drop("__p")


def _level() -> Column:
    return F.coalesce(rank(F.col("severity"), SEVERITIES), F.lit(2))


def one_per_cve(matches: DataFrame) -> DataFrame:
    """Of a package's advisories on one CVE the most severe, then the first; those without a CVE all stay."""
    w = Window.partitionBy("ecosystem", "package", "version", F.coalesce("cve", "id")).orderBy(F.desc(_level()), "id")
    return matches.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def vulnerable_once(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """one_per_cve of vulnerable: the advisories on a CVE of a package are put in order before they meet versions.

    What is grouped is one number a pair, in the tasks of the join, so no pair is shuffled or sorted.
    """
    name = scoring.package_name(F.col("ecosystem"), F.col("package"))
    first = Window.partitionBy("ecosystem", name, F.coalesce("cve", "id")).orderBy(F.desc(_level()), "id")
    ranked = keep(advisories.withColumn("__k", F.row_number().over(first)).withColumn("__c", F.coalesce("cve", "id")), "advisories")
    own = ["ecosystem", "__p", "package", "version", "__c"]
    best = _met(packages, ranked.select("ecosystem", "package", "vulnerable", "__c", "__k")).groupBy(*own).agg(F.min("__k").alias("__k"))
    about = ranked.withColumn("__p", name).drop("package")
    return best.join(about, ["ecosystem", "__p", "__c", "__k"]).drop("__p", "__c", "__k")


def with_signals(matches: DataFrame, signals: DataFrame, high: float = 0.5) -> DataFrame:
    """matches with epss, kev and the tags that scores read."""
    out = matches.join(signals.select("cve", "epss", "kev"), "cve", "left").withColumn("kev", F.coalesce("kev", F.lit(False)))
    return out.withColumn("tags", F.filter(F.array(F.when(F.col("kev"), F.lit("kev")), F.when(F.col("epss") >= high, F.lit("epss-high"))), lambda t: t.isNotNull()))


def malicious(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Packages whose normalised name is on the list (ecosystem, name)."""
    bad = known.select(F.lower("ecosystem").alias("__e"), scoring.package_name(F.col("ecosystem"), F.col("name")).alias("__p")).distinct()
    return packages.join(bad, (F.lower("ecosystem") == F.col("__e")) & (scoring.package_name(F.col("ecosystem"), F.col("package")) == F.col("__p")), "left_semi")


def typosquats(packages: DataFrame, popular: DataFrame, distance: int = 1) -> DataFrame:
    """Packages within `distance` edits of a popular name (ecosystem, name) and popular themselves by no name.

    Candidates meet on deletion neighbourhoods: two strings within k edits share a string that k deletions
    or fewer make of each. An equi join and a check take the place of comparing all names.
    """
    pk = packages.select("ecosystem", "package", scoring.package_name(F.col("ecosystem"), F.col("package")).alias("__p"))
    pop = popular.select("ecosystem", F.col("name").alias("lookalike"), scoring.package_name(F.col("ecosystem"), F.col("name")).alias("__q"))

    def neighbours(name, k: int):
        def cuts(s):
            return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s))))

        here = F.array(name)
        for _ in range(k):
            cut = F.flatten(F.transform(here, cuts))
            here = F.array_distinct(F.concat(here, cut))
        return here

    a = pk.withColumn("__key", F.explode(neighbours(F.col("__p"), distance)))
    b = pop.withColumn("__key", F.explode(neighbours(F.col("__q"), distance)))
    close = a.join(b, ["ecosystem", "__key"]).where((F.col("__p") != F.col("__q")) & (F.levenshtein("__p", "__q", distance) >= 0))
    close = close.join(pop.select("ecosystem", F.col("__q").alias("__p")), ["ecosystem", "__p"], "left_anti")
    return close.groupBy("ecosystem", "package").agg(F.min("lookalike").alias("lookalike"))


def reachability(packages: DataFrame, imports: DataFrame, alias: DataFrame) -> DataFrame:
    """packages with reachability: imported, not_imported, or unknown where nothing is imported at all.

    alias maps distributions to the modules they are imported as.
    """
    modules = imports.select(scoring.import_name(F.col("module")).alias("__m")).distinct()
    other = alias.select(scoring.import_name(F.col("distribution")).alias("__d"), scoring.import_name(F.col("module")).alias("__am")).distinct()
    named = packages.withColumn("__d", scoring.import_name(F.col("package"))).join(other, "__d", "left").withColumn("__m", F.coalesce("__am", "__d"))
    seen = named.join(modules.withColumn("__seen", F.lit(True)), "__m", "left").groupBy(*packages.columns).agg(F.coalesce(F.bool_or("__seen"), F.lit(False)).alias("__seen"))
    some = modules.agg((F.count("*") > 0).alias("__some"))
    return seen.join(F.broadcast(some)).withColumn("reachability", F.when(~F.col("__some"), "unknown").when(F.col("__seen"), "imported").otherwise("not_imported")).drop("__seen", "__some")


def symbol_reachability(matches: DataFrame, symbols: DataFrame) -> DataFrame:
    """matches (affected_symbols) with symbol_reachability: reachable if code names one of them whole or by its last part."""
    used = symbols.select(F.col("symbol").alias("__s")).distinct()
    parts = matches.withColumn("__id", F.monotonically_increasing_id())
    asked = parts.select("__id", F.explode_outer("affected_symbols").alias("__full")).withColumn("__s", F.explode(F.array_distinct(F.array("__full", F.element_at(F.split("__full", r"\."), -1)))))
    hit = asked.join(used, "__s", "left_semi").select("__id").distinct().withColumn("__hit", F.lit(True))
    state = F.when(F.size("affected_symbols") <= 0, "unknown").when(F.col("__hit"), "reachable").otherwise("not_reachable")
    return parts.join(hit, "__id", "left").withColumn("symbol_reachability", state).drop("__id", "__hit")


def advisory_findings(matches: DataFrame, places: DataFrame) -> DataFrame:
    """Findings of vulnerable packages in their manifests: places has (ecosystem, package, version, manifest), and may have project."""
    level = F.coalesce(rank(F.col("severity"), SEVERITIES), F.lit(2))
    project = ["project"] if "project" in places.columns else []
    more = [c for c in ("cwe", "fixed", "epss", "kev", "tags") if c in matches.columns]
    out = matches.join(places, ["ecosystem", "package", "version"]).select(*project, F.concat(F.lit("dependencies."), "id").alias("rule_id"), F.lit("dependencies").alias("scanner"), F.col("manifest").alias("path"), level.alias("severity"), F.lit(2).alias("confidence"), F.concat_ws("==", "package", "version").alias("snippet"), "cve", *more, "ecosystem", "package")
    return out.withColumn("likelihood", F.when(F.col("kev"), 4).otherwise(2)) if "kev" in more else out.withColumn("likelihood", F.lit(2))


def imported(rows: DataFrame, modules: DataFrame) -> DataFrame:
    """Findings (project, ecosystem, package) with reachability: does their project's code import the package?

    modules: project, ecosystem, module. Of ecosystems other than PyPI and npm nothing is said, and where a project
    imports nothing it is unknown. A package that is not imported is unlikely to be met, unless it is known exploited.
    """
    names = F.when(F.col("ecosystem") == "PyPI", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for d, m in ALIASES.items() for x in (d, list(m))]), F.lower("package")), F.array(scoring.import_name(F.col("package")), F.lower("package")))).otherwise(F.array(F.lower("package")))
    asked = rows.select("project", "ecosystem", "package").distinct().where(F.col("ecosystem").isin("PyPI", "npm"))
    asked = asked.withColumn("module", F.explode(F.transform(names, lambda n: F.lower(F.when(F.col("ecosystem") == "PyPI", F.element_at(F.split(n, r"\."), 1)).otherwise(n)))))
    known = modules.select("project", "ecosystem", "module").distinct()
    some = known.select("project", "ecosystem").distinct().withColumn("__some", F.lit(True))
    same = F.col("a.project").eqNullSafe(F.col("b.project")) & (F.col("a.ecosystem") == F.col("b.ecosystem"))
    seen = asked.alias("a").join(known.withColumn("__seen", F.lit(True)).alias("b"), same & (F.col("a.module") == F.col("b.module")), "left").groupBy("a.project", "a.ecosystem", "a.package").agg(F.coalesce(F.bool_or("__seen"), F.lit(False)).alias("__seen"))
    verdict = F.when(F.col("__seen"), "imported").when(F.col("__some"), "not_imported").otherwise("unknown")
    seen = seen.alias("a").join(some.alias("b"), same, "left").select("a.project", "a.ecosystem", "a.package", verdict.alias("reachability"))
    out = rows.alias("a").join(seen.alias("b"), same & (F.col("a.package") == F.col("b.package")), "left").select("a.*", "reachability")
    exploited = F.coalesce(F.col("kev"), F.lit(False)) if "kev" in rows.columns else F.lit(False)
    return out.withColumn("likelihood", F.when((F.col("reachability") == "not_imported") & ~exploited, 1).otherwise(F.col("likelihood"))).drop("ecosystem", "package")


#: Lifecycle hooks of npm manifests, and what makes their scripts suspicious: fixed values.
HOOKS = ("preinstall", "install", "postinstall", "prepare")
SUSPICIOUS = r"(?i)\b(?:curl|wget|bash|powershell|certutil|child_process)\b|\bsh\s|\bInvoke-|\b(?:eval|exec)\b|\bchmod\s|https?://|\.exe\b|/dev/tcp|/etc/passwd|~/\.ssh|\bprocess\.env\b"


def lifecycle_scripts(manifests: DataFrame) -> DataFrame:
    """Findings of install hooks in package.json texts (path, text; a project stays) that fetch or run something."""
    scripts = F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")
    project = ["project"] if "project" in manifests.columns else []
    rows = manifests.select(*project, "path", F.explode(scripts).alias("hook", "script")).where(F.col("hook").isin(*HOOKS) & F.rlike("script", F.lit(SUSPICIOUS)))
    return rows.select(*project, "path", F.lit("supply-chain.npm-lifecycle-script").alias("rule_id"), F.lit(3).alias("severity"), F.lit(1).alias("confidence"), F.concat_ws(": ", "hook", "script").alias("snippet"))


def reevaluated(deployed: DataFrame, advisories: DataFrame, seen: DataFrame) -> DataFrame:
    """Advisories that hit deployed packages and that no earlier evaluation (package, version, id) has reported.

    deployed may be a stream: the joins are stream-static.
    """
    return vulnerable(deployed, advisories).join(seen.select("package", "version", "id"), ["package", "version", "id"], "left_anti")

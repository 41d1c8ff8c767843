"""Advisory records in OSV JSON: parsed fields, version intervals, and what they say about packages.

A record's version events (introduced, fixed, last_affected) are put in version order and swept into intervals: one
opens where a version is introduced and closes before a fixed or with a last affected one. Versions that a record
lists alone are intervals of one. A package meets intervals on (ecosystem, name), then its ordered version key must
lie between theirs: the join has one row for each interval of a package, however many clauses a record holds.

Versions compare by their numeric parts (see scoring.version_key) without zeros at the end, so 1.0 equals 1.0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

#: What is read of a record.
RECORD = """id string, summary string, details string, aliases array<string>, severity array<struct<type:string,score:string>>,
references array<struct<url:string>>, database_specific struct<severity:string,cwe_ids:array<string>>,
affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,ecosystem_specific:string,
ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"""
#: Words for severities, references kept, and the weakness of records that name none: fixed values.
WORDS = {"LOW": "LOW", "MODERATE": "MEDIUM", "MEDIUM": "MEDIUM", "HIGH": "HIGH", "CRITICAL": "CRITICAL"}
REFERENCES, UNNAMED = 5, "CWE-1104"
#: module.function in a record's text: a fixed value.
DOTTED = r"\b([a-zA-Z_][\w]*)\.([a-zA-Z_][\w]*)\b"


def version_key(version: Column) -> Column:
    """The numeric parts of a version, without zeros at the end."""
    key = scoring.version_key(version)
    last = F.aggregate(F.transform(key, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), F.lit(0), lambda n, x: F.when(x["p"] != 0, x["i"] + 1).otherwise(n))
    return F.slice(key, F.lit(1), last)


def _band(score: Column) -> Column:
    """The label of a CVSS 3 vector or a bare number above zero; null for anything else."""
    text = F.trim(score)
    value = F.when(F.startswith(F.upper(text), F.lit("CVSS:3")), scoring.cvss_score(text)).otherwise(text.try_cast("double"))
    return F.when(value > 0, scoring.cvss_band(value))


def records(raw: DataFrame) -> DataFrame:
    """Records of raw (text, a JSON object): id, cve, summary, severity (a label), cwe, references, symbols, fixed, affected.

    Texts that are no object with an id give no row.
    """
    r = raw.select(F.from_json("text", RECORD).alias("r")).select("r.*").where("id <> ''")
    none = F.array().cast("array<string>")
    cve = F.coalesce(F.try_element_at(F.filter(F.coalesce("aliases", none), lambda a: F.startswith(a, F.lit("CVE-"))), F.lit(1)), F.lit(""))
    word = F.try_element_at(F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv]), F.upper("database_specific.severity"))
    bands = F.filter(F.transform(F.coalesce("severity", F.array().cast("array<struct<type:string,score:string>>")), lambda s: _band(s["score"])), lambda b: b.isNotNull())
    links = F.filter(F.transform("references", lambda x: x["url"]), lambda u: u != "")
    links = F.concat(F.when(cve != "", F.array(F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), cve))).otherwise(none), F.coalesce(links, none))
    events = F.flatten(F.flatten(F.transform("affected", lambda a: F.transform(a["ranges"], lambda g: g["events"]))))
    fixed = F.try_element_at(F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull()), F.lit(1))
    cwes = F.filter(F.coalesce("database_specific.cwe_ids", none), lambda c: c.isNotNull())
    return r.select(
        "id", cve.alias("cve"), F.coalesce(F.nullif("summary", F.lit("")), F.nullif(F.substring("details", 1, 200), F.lit("")), F.col("id")).alias("summary"),
        F.coalesce(word, F.try_element_at(bands, F.lit(1)), F.lit("MEDIUM")).alias("severity"), F.when(F.size(cwes) > 0, cwes).otherwise(F.array(F.lit(UNNAMED))).alias("cwe"),
        F.slice(links, 1, REFERENCES).alias("references"), _symbols().alias("symbols"), fixed.alias("fixed"), "affected",
    )


def _symbols() -> Column:
    """Names that a record says are affected, and dotted ones of its text, in lower case."""
    none = F.array().cast("array<string>")

    def named(a: Column) -> Column:
        lists = [F.coalesce(F.from_json(F.get_json_object(a["ecosystem_specific"], f"$.{k}"), "array<string>"), none) for k in ("imports", "symbols", "functions")]
        return F.concat(*(F.filter(x, lambda v: v.isNotNull()) for x in lists))

    text = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("details", F.lit("")))
    found = F.concat(F.coalesce(F.flatten(F.transform("affected", named)), none), F.regexp_extract_all(text, F.lit(DOTTED), F.lit(0)))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


_OPEN = "struct<low:array<bigint>,introduced:string,high:array<bigint>,until:string,inclusive:boolean>"


def _swept(events: Column) -> Column:
    """Intervals of a range's events. At one version a fix comes first, then what is introduced, then what is last affected."""
    kinds = (("fixed", 0), ("introduced", 1), ("last_affected", 2))
    marks = F.flatten(F.transform(events, lambda e: F.filter(F.array(*(F.when(e[k].isNotNull(), F.struct(version_key(e[k]).alias("key"), F.lit(rank).alias("kind"), e[k].alias("version"))) for k, rank in kinds)), lambda m: m.isNotNull())))
    start = F.struct(F.array().cast(f"array<{_OPEN}>").alias("done"), F.lit(None).cast("array<bigint>").alias("low"), F.lit(None).cast("string").alias("introduced"))
    nothing = F.lit(None)

    def step(s: Column, m: Column) -> Column:
        opens = (m["kind"] == 1) & s["low"].isNull()
        closes = (m["kind"] != 1) & s["low"].isNotNull()
        closed = F.struct(s["low"].alias("low"), s["introduced"].alias("introduced"), m["key"].alias("high"), m["version"].alias("until"), (m["kind"] == 2).alias("inclusive"))
        return F.struct(F.when(closes, F.array_append(s["done"], closed)).otherwise(s["done"]).alias("done"), F.when(opens, m["key"]).when(closes, nothing).otherwise(s["low"]).alias("low"), F.when(opens, m["version"]).when(closes, nothing).otherwise(s["introduced"]).alias("introduced"))

    def end(s: Column) -> Column:
        rest = F.struct(s["low"].alias("low"), s["introduced"].alias("introduced"), F.lit(None).cast("array<bigint>").alias("high"), F.lit(None).cast("string").alias("until"), F.lit(False).alias("inclusive"))
        return F.when(s["low"].isNotNull(), F.array_append(s["done"], rest)).otherwise(s["done"])

    return F.aggregate(F.array_sort(marks), start, step, end)


def intervals(of: DataFrame) -> DataFrame:
    """id, ecosystem, package, low, introduced, high, until, inclusive of records' affected packages, and fixes: all fixed versions of the package.

    high and until are null where nothing ends an interval. Ranges of commits (GIT) are not versions and are left out.
    """
    a = of.select("id", F.explode("affected").alias("a"))
    ranges = F.filter(F.coalesce("a.ranges", F.array().cast("array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>")), lambda g: F.coalesce(g["type"], F.lit("ECOSYSTEM")) != "GIT")
    swept = F.flatten(F.transform(ranges, lambda g: _swept(g["events"])))
    listed = F.transform(F.coalesce("a.versions", F.array().cast("array<string>")), lambda v: F.struct(version_key(v).alias("low"), v.alias("introduced"), version_key(v).alias("high"), v.alias("until"), F.lit(True).alias("inclusive")))
    fixes = F.filter(F.flatten(F.transform(ranges, lambda g: F.transform(g["events"], lambda e: e["fixed"]))), lambda v: v.isNotNull())
    fixes = F.array_sort(F.transform(fixes, lambda v: F.struct(version_key(v).alias("key"), v.alias("version"))))
    rows = a.select("id", "a.package.ecosystem", F.col("a.package.name").alias("package"), fixes.alias("fixes"), F.explode(F.concat(swept, listed)).alias("i"))
    return rows.where("ecosystem IS NOT NULL AND package IS NOT NULL").select("id", "ecosystem", "package", "fixes", "i.*")


def vulnerable(packages: DataFrame, of: DataFrame) -> DataFrame:
    """Distinct (ecosystem, package, version) with the records whose intervals hold the version, their fields and fixed: the least fixed version above it."""
    pk = packages.select("ecosystem", "package", "version").distinct().withColumn("__p", scoring.package_name(F.col("ecosystem"), F.col("package"))).withColumn("__v", version_key(F.col("version")))
    held = intervals(of).withColumn("__p", scoring.package_name(F.col("ecosystem"), F.col("package"))).drop("package")
    inside = (F.col("__v") >= F.col("low")) & (F.col("high").isNull() | (F.col("__v") < F.col("high")) | F.col("inclusive") & (F.col("__v") == F.col("high")))
    above = F.filter("fixes", lambda f: f["key"] > F.col("__v"))
    met = pk.join(held, ["ecosystem", "__p"]).where(inside).select("ecosystem", "package", "version", "id", F.try_element_at(above, F.lit(1)).alias("fix"))
    met = met.groupBy("ecosystem", "package", "version", "id").agg(F.min("fix").alias("fix"))
    return met.join(of.drop("affected", "fixed"), "id").select(*met.columns[:4], F.col("fix.version").alias("fixed"), *(c for c in of.columns if c not in ("id", "affected", "fixed")))


def resolved(results: DataFrame, of: DataFrame) -> DataFrame:
    """Packages of a look-up (ecosystem, package, version, ids: array<string>) with the records of their ids; ids without a record are dropped."""
    asked = results.select("ecosystem", "package", "version", F.explode(F.array_distinct("ids")).alias("id")).distinct()
    return asked.join(of.drop("affected"), "id").select("ecosystem", "package", "version", "id", *(c for c in of.columns if c not in ("id", "affected")))

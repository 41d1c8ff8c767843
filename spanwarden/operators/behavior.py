"""What a package version can do when it is installed, and what a version can that the one before it could not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.store import keep
from .dependencies import HOOKS, SUSPICIOUS

#: Dependencies beyond which a tree is large, and more of them that a version may have than the one before: fixed values.
LARGE, JUMP = 50, 20
PRINT = ("install_scripts", "bins", "dependency_count", "suspicious")


def fingerprints(manifests: DataFrame) -> DataFrame:
    """package, version, install_scripts, bins, dependency_count, suspicious, capabilities of npm manifests (package, version, text).

    Texts that are no JSON object give no row; fields of another kind than they should have count as absent.
    """
    rows = manifests.where(F.startswith(F.ltrim(F.coalesce("text", F.lit(""))), F.lit("{")) & F.get_json_object("text", "$").isNotNull())

    def fields(path: str) -> Column:
        found = F.get_json_object("text", path)
        return F.coalesce(F.from_json(F.when(F.startswith(found, F.lit("{")), found), "map<string,string>"), F.create_map().cast("map<string,string>"))

    rows = rows.select("package", "version", fields("$.scripts").alias("scripts"), fields("$.bin").alias("bin"), fields("$.dependencies").alias("deps"))
    hooks = F.filter(F.array(*map(F.lit, HOOKS)), lambda h: F.try_element_at("scripts", h).isNotNull())
    body = F.array_join(F.transform(hooks, lambda h: F.try_element_at("scripts", h)), " ")
    out = rows.select("package", "version", hooks.alias("install_scripts"), F.array_sort(F.map_keys("bin")).alias("bins"), F.greatest(F.size(F.map_keys("deps")), F.lit(0)).alias("dependency_count"), F.rlike(body, F.lit(SUSPICIOUS)).alias("suspicious"))
    tags = (("install-script", F.size("install_scripts") > 0), ("executable-bin", F.size("bins") > 0), ("suspicious-script", F.col("suspicious")), ("large-dependency-tree", F.col("dependency_count") > LARGE))
    return out.withColumn("capabilities", F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tags)), lambda x: x.isNotNull()))


def previous_versions(of: DataFrame) -> DataFrame:
    """package, old_version, new_version: each version with the one before it in version order, null for the first."""
    order = Window.partitionBy("package").orderBy(scoring.version_key(F.col("version")), "version")
    return of.select("package", F.lag("version").over(order).alias("old_version"), F.col("version").alias("new_version"))


def anomalies(changes: DataFrame, of: DataFrame) -> DataFrame:
    """package, old_version, new_version, anomaly, detail: what new versions can that old ones could not.

    Of a package that is new only a suspicious script is said; a new version without a fingerprint says nothing.
    """
    of = keep(of, "fingerprints")  # texts are parsed once, not for each side
    own = F.struct(*PRINT, "capabilities")
    side = lambda name: of.select("package", F.col("version").alias(f"{name}_version"), own.alias(name))
    both = changes.select("package", "old_version", "new_version").distinct().join(side("new"), ["package", "new_version"]).join(side("old"), ["package", "old_version"], "left")
    fresh, gained = F.col("old").isNull(), lambda tag: ~F.array_contains("old.capabilities", tag) & F.array_contains("new.capabilities", tag)
    said = (
        ("new-suspicious", fresh & F.col("new.suspicious"), F.array_join("new.install_scripts", ", ")),
        ("install-script", ~fresh & gained("install-script"), F.array_join("new.install_scripts", ", ")),
        ("suspicious-script", ~fresh & gained("suspicious-script"), F.array_join("new.install_scripts", ", ")),
        ("executable-bin", ~fresh & gained("executable-bin"), F.array_join("new.bins", ", ")),
        ("dependency-jump", ~fresh & (F.col("new.dependency_count") > F.col("old.dependency_count") + JUMP), F.concat_ws(" -> ", F.col("old.dependency_count").cast("string"), F.col("new.dependency_count").cast("string"))),
    )
    hits = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("anomaly"), detail.alias("detail"))) for name, test, detail in said)), lambda x: x.isNotNull())
    return both.select("package", "old_version", "new_version", F.explode(hits).alias("a")).select("package", "old_version", "new_version", "a.*")


def anomaly_findings(changes: DataFrame, of: DataFrame) -> DataFrame:
    """Findings of changes (project, ecosystem, manifest, package, old_version, new_version, change): npm packages whose version changed."""
    npm = changes.where("ecosystem = 'npm' AND change = 'changed'")
    found = anomalies(npm, of)
    same = (F.col("c.package") == F.col("a.package")) & F.col("c.old_version").eqNullSafe(F.col("a.old_version")) & (F.col("c.new_version") == F.col("a.new_version"))
    rows = npm.alias("c").join(found.alias("a"), same)
    return rows.select("c.project", F.col("c.manifest").cast("string").alias("path"), F.lit("dependency-diff.behavior-anomaly").alias("rule_id"), F.lit("dependency-diff").alias("scanner"), F.lit(4).alias("severity"), F.lit(1).alias("confidence"), F.lit(3).alias("likelihood"), F.array(F.lit("CWE-506")).alias("cwe"), F.concat_ws(" ", "c.package", "c.old_version", "c.new_version", "a.anomaly", "a.detail").alias("snippet"), F.array(F.lit("supply-chain"), F.lit("behavior-anomaly")).alias("tags"))

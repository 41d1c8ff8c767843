"""Package manifests to packages(project, ecosystem, manifest, package, version, parser_rank).

JSON formats are read with Spark's JSON functions, line formats with split and regular expressions; nested
npm v1 locks are the one tree that a small per-file Python function walks. A malformed file gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import base_name

#: File name, ecosystem, in the order that breaks ties: fixed values.
FORMATS = (
    ("poetry.lock", "PyPI"), ("Pipfile.lock", "PyPI"), ("requirements.txt", "PyPI"), ("package-lock.json", "npm"), ("yarn.lock", "npm"),
    ("package.json", "npm"), ("go.mod", "Go"), ("Cargo.lock", "crates.io"), ("Gemfile.lock", "RubyGems"), ("composer.lock", "Packagist"),
)


def _pairs(found, package, version):
    return F.transform(found, lambda x: F.struct(package(x).alias("package"), version(x).alias("version")))


def _toml_packages():
    """[[package]] blocks with a name and a version."""
    blocks = F.slice(F.split("text", r"(?m)^\[\[package\]\]\s*$"), F.lit(2), F.lit(10**6))
    return _pairs(blocks, lambda b: F.regexp_extract(b, r'(?m)^name\s*=\s*"([^"]+)"', 1), lambda b: F.regexp_extract(b, r'(?m)^version\s*=\s*"([^"]+)"', 1))


def _matches(pattern: str):
    """(package, version) of a pattern's two groups at every match."""
    return _pairs(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x: F.regexp_extract(x, pattern, 1), lambda x: F.regexp_extract(x, pattern, 2))


def _entries(path: str, version, strip: str = ""):
    """(package, version) of a JSON object of objects or strings."""
    m = F.from_json(F.get_json_object("text", path), "map<string,string>")
    return F.transform(F.map_entries(m), lambda e: F.struct(F.regexp_replace(e["key"], strip, "").alias("package") if strip else e["key"].alias("package"), version(e["value"]).alias("version")))


def _pinned(value):
    return F.regexp_replace(value, r"^[=^~v<>\s]*", "")


def _npm_v1(files: DataFrame, rank: int) -> DataFrame:
    """Nested dependency trees of package-lock version 1."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for project, path, text in zip(batch["project"], batch["path"], batch["text"], strict=True):
                try:
                    stack = [json.loads(text).get("dependencies") or {}]
                except (ValueError, AttributeError, RecursionError):
                    continue
                while stack:
                    level = stack.pop()
                    for name, entry in level.items() if isinstance(level, dict) else ():
                        if isinstance(entry, dict):
                            if isinstance(entry.get("version"), str):
                                rows.append((project, "npm", path, name, entry["version"], rank))
                            stack.append(entry.get("dependencies") or {})
            yield pd.DataFrame(rows, columns=["project", "ecosystem", "manifest", "package", "version", "parser_rank"])

    v1 = files.where((base_name(F.col("path")) == "package-lock.json") & F.get_json_object("text", "$.packages").isNull())
    return v1.select("project", "path", "text").mapInPandas(walk, "project string, ecosystem string, manifest string, package string, version string, parser_rank int")


def packages(files: DataFrame) -> DataFrame:
    """Packages of all manifests in files(project, path, text); the project is null where files have none."""
    if "project" not in files.columns:
        files = files.withColumn("project", F.lit(None).cast("string"))
    known = files.where(base_name(F.col("path")).isin(*(n for n, _ in FORMATS)))
    node = r"^.*node_modules/"
    version = lambda v: F.get_json_object(v, "$.version")
    php = F.from_json(F.get_json_object("text", "$.packages"), "array<struct<name:string,version:string>>")
    pipfile = F.concat(*(F.coalesce(_entries(f"$.{part}", lambda v: _pinned(version(v))), F.array()) for part in ("default", "develop")))
    npm_json = F.concat(*(F.coalesce(_entries(f"$.{part}", _pinned), F.array()) for part in ("dependencies", "devDependencies")))
    columns = {
        "poetry.lock": _toml_packages(),
        "Pipfile.lock": pipfile,
        "requirements.txt": _matches(r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*==\s*([A-Za-z0-9.!+_-]+)"),
        "package-lock.json": F.filter(_entries("$.packages", version, node), lambda p: p["package"] != ""),
        "yarn.lock": _matches(r'(?m)^"?(@?[^@"\s][^@"]*)@[^\n]*:\n\s+version:?\s+"?([^"\s]+)"?'),
        "package.json": npm_json,
        "go.mod": _matches(r"(?m)^(?:require\s+|\s+)([\w.\-/]+\.[\w.\-/]+)\s+v([\w.\-+]+)"),
        "Cargo.lock": _toml_packages(),
        "Gemfile.lock": _matches(r"(?m)^ {4}([A-Za-z0-9._-]+) \(([^)\s]+)\)$"),
        "composer.lock": _pairs(php, lambda x: x["name"], lambda x: F.regexp_replace(x["version"], "^v", "")),
    }
    # one pass: each file's pairs by its name
    name, none = base_name(F.col("path")), F.array().cast("array<struct<package:string,version:string>>")
    pairs, ecosystem, rank = none, F.lit(None).cast("string"), F.lit(None).cast("int")
    for at, (n, e) in enumerate(FORMATS):
        pairs, ecosystem, rank = F.when(name == n, columns[n]).otherwise(pairs), F.when(name == n, e).otherwise(ecosystem), F.when(name == n, at).otherwise(rank)
    out = known.select("project", "path", ecosystem.alias("ecosystem"), rank.alias("parser_rank"), F.explode(pairs).alias("p")).where("p.package <> '' AND p.version <> ''")
    return _npm_v1(known, 3).unionByName(out.select("project", "ecosystem", F.col("path").alias("manifest"), "p.package", "p.version", "parser_rank"))

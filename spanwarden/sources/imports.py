"""Modules that a project's own code imports: PyPI names from Python, npm names from JavaScript and TypeScript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import suffix

#: Import statements and what they name: fixed values.
PYTHON = r"(?m)^\s*(?:from\s+([A-Za-z_][\w.]*)\s+import|import\s+(.+))"
NODE = r"(?:require\s*\(\s*['\"]([^'\"]+)['\"]|from\s+['\"]([^'\"]+)['\"])"
NODE_SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")


def modules(files: DataFrame) -> DataFrame:
    """project, ecosystem, module of files(project, path, text), each once: top-level names in lower case."""
    python, node = suffix(F.col("path")) == ".py", suffix(F.col("path")).isin(*NODE_SUFFIXES)
    listed = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(PYTHON), F.lit(2)), lambda m: F.split(m, ",")))
    named = F.transform(listed, lambda p: F.trim(F.element_at(F.split(F.trim(p), " as "), 1)))
    named = F.concat(F.regexp_extract_all("text", F.lit(PYTHON), F.lit(1)), F.filter(named, lambda n: F.rlike(n, F.lit(r"^[A-Za-z_][\w.]*$"))))
    tops = F.transform(named, lambda n: F.element_at(F.split(n, r"\."), 1))
    packages = F.concat(*(F.regexp_extract_all("text", F.lit(NODE), F.lit(i)) for i in (1, 2)))
    packages = F.transform(F.filter(packages, lambda m: ~F.startswith(m, F.lit("."))), lambda m: F.array_join(F.slice(F.split(m, "/"), F.lit(1), F.when(F.startswith(m, F.lit("@")), 2).otherwise(1)), "/"))
    found = F.when(python, tops).when(node, packages)
    rows = files.where(python | node).select("project", F.when(python, "PyPI").otherwise("npm").alias("ecosystem"), F.explode(F.array_distinct(F.transform(found, F.lower))).alias("module"))
    return rows.where("module <> ''").distinct()

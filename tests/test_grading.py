"""Verdicts by constant propagation, behaviour of packages, and sealed logs of some length."""

import json
import time

import pytest
from pyspark.sql import functions as F

from spanwarden.operators import audit, behavior, grading

FILES = "project string, path string, language string, size long, text string"


@pytest.mark.parametrize(
    ("text", "line", "want"),
    [
        ("x = 'a'\nos.system(x)\n", 2, ("shell", "literal")),
        ("x = 'a'\nx = input()\nos.system(x)\n", 3, ("shell", "tainted")),
        ("a = request.args\nb = a\nc = 'x' + b\nsubprocess.run(\n  c,\n  shell=True,\n)\n", 4, ("shell", "tainted")),
        ("def f(x):\n  os.system(x)\n", 2, ("shell", "unknown")),
        ("x = f'{y}'\ny = 'a'\nos.popen(x)\n", 3, ("shell", "literal")),
        ("x = f'{y}'\ny = g()\nos.popen(x)\n", 3, ("shell", "unknown")),
        ("a = b\nb = a\npickle.loads(a)\n", 3, ("loads", "literal")),
        ("pickle.loads(b'abc')\n", 1, ("loads", "literal")),
        ("pickle.loads(b)\n", 1, ("loads", "unknown")),
        ("x = 'a'\nx += z\nyaml.load(x, Loader=yaml.Loader)\n", 3, ("yaml", "unknown")),
        ("yaml.load('a: 1', Loader=yaml.Loader)\n", 1, ("yaml", "literal")),
        ("yaml.load(open(p))\n", 1, ("yaml", "unknown")),
    ],
)
def test_verdicts(spark, text, line, want):
    rows = grading.line_verdicts(spark.createDataFrame([(None, "a.py", "Python", 1, text)], FILES)).collect()
    assert [(r.line, r.kind, r.verdict) for r in rows] == [(line, *want)]


def test_fingerprints_and_what_versions_gain(spark):
    texts = [
        ("a", "1.0", {"scripts": {"test": "curl x"}, "bin": "x.js"}), ("a", "1.10", {"scripts": {"install": "node x"}}), ("a", "1.9", {"scripts": [], "dependencies": {str(i): "1" for i in range(60)}}),
        ("b", "1.0", {"scripts": {"postinstall": "wget x | sh "}, "bin": {"z": "z", "y": "y"}}),
    ]
    rows = [(p, v, json.dumps(t)) for p, v, t in texts] + [("c", "1.0", "nothing"), ("c", "2.0", None), ("c", "3.0", "[]")]
    prints = behavior.fingerprints(spark.createDataFrame(rows, "package string, version string, text string"))
    got = {(r.package, r.version): (r.install_scripts, r.bins, r.dependency_count, r.suspicious, r.capabilities) for r in prints.collect()}
    assert got[("b", "1.0")] == (["postinstall"], ["y", "z"], 0, True, ["install-script", "executable-bin", "suspicious-script"])
    assert got[("a", "1.9")] == ([], [], 60, False, ["large-dependency-tree"]) and got[("a", "1.0")] == ([], [], 0, False, []) and len(got) == 4
    versions = behavior.previous_versions(prints)
    assert {(r.package, r.old_version, r.new_version) for r in versions.collect()} == {("a", None, "1.0"), ("a", "1.0", "1.9"), ("a", "1.9", "1.10"), ("b", None, "1.0")}
    said = {(r.package, r.new_version, r.anomaly, r.detail) for r in behavior.anomalies(versions, prints).collect()}
    assert said == {("a", "1.9", "dependency-jump", "0 -> 60"), ("a", "1.10", "install-script", "install"), ("b", "1.0", "new-suspicious", "postinstall")}


def test_long_logs_are_sealed_in_linear_time(spark):
    i = F.col("id")
    e = spark.range(30_000).select(F.lit(1).alias("v"), i.alias("seq"), F.concat(F.lit("t"), i).alias("ts"), *(F.concat(F.lit(f'{c} "é\\ '), i).alias(c) for c in audit.FIELDS))
    start = time.time()
    log = audit.sealed(e.withColumn("log", F.lit("x")), ["log"])
    row = audit.first_break(log, ["log"]).first()
    assert (row.events, row.first_broken) == (30_000, None) and time.time() - start < 40
    assert audit.first_break(log.withColumn("path", F.when(F.col("seq") == 777, "other").otherwise(F.col("path"))), ["log"]).first().first_broken == 777

"""What must grow in proportion: routes, the ordered fold, whole long lines; and the same interfaces in JSON and YAML."""

import json
import time

import pytest
from pyspark.sql import functions as F

from spanwarden.operators import blocks, findings

FILES = "project string, path string, language string, size long, text string"


def corpus(spark, texts):
    return spark.createDataFrame([("p", p, "Python", len(t), t) for p, t in texts.items()], FILES)


def timed(df):
    start = time.time()
    rows = df.collect()
    return rows, time.time() - start


def test_routes_of_a_long_file(spark):
    text = "@app.get('/a')\ndef f(): pass\n" * 50_000
    blocks.routes(corpus(spark, {"w.py": "@app.get('/a')\n"})).collect()
    rows, took = timed(blocks.routes(corpus(spark, {"a.py": text})).select("line", "next_route", F.size(F.split("window", "\n")).alias("n")))
    assert len(rows) == 50_000 and took < 20
    assert all(r.next_route == r.line + 2 for r in rows if r.line < 99_999) and [r.next_route for r in rows if r.line == 99_999] == [None]


def fold(rows):
    """rows of (line, tool, confidence, rule) in order: those that stay."""
    kept = []
    for r in rows:
        if kept and kept[-1][1] != r[1] and r[0] - kept[-1][0] <= findings.DEDUPE_LINES:
            a, b = kept[-1], r
            if b[2] > a[2] or b[2] == a[2] and b[3] < a[3]:
                kept[-1] = r
        else:
            kept.append(r)
    return kept


@pytest.mark.parametrize("n,gap", [(100_000, 1), (30_000, 5)])
def test_ordered_fold_of_many_findings_of_one_file(spark, n, gap):
    i = F.col("id")
    f = spark.range(n).select(
        i.alias("ordinal"), F.concat(F.lit("r"), i * 7 % 5).alias("rule_id"), F.concat(F.lit("tool"), i * 3 % 4).alias("scanner"), F.lit(None).cast("string").alias("project"), F.lit("a.py").alias("path"),
        (i * gap / 2 + 1).cast("int").alias("start_line"), F.lit(2).alias("severity"), (i * 11 % 3).cast("int").alias("confidence"), F.array(F.lit("CWE-89")).alias("cwe"),
    )
    want = [r[4] for r in fold([(r.start_line, r.scanner, r.confidence, r.rule_id, r.ordinal) for r in f.orderBy("start_line", "ordinal").collect()])]
    rows, took = timed(findings.deduplicated(f).select("ordinal"))
    assert sorted(r.ordinal for r in rows) == sorted(want) and took < 30


def test_business_logic_reads_whole_lines(spark):
    pad = "x" * 5000 + "; "
    rows = blocks.business_logic(corpus(spark, {"a.py": f"{pad}status = 'paid'\n", "b.py": f"{pad}owner\n\nstatus = 'paid'\n", "c.py": f"if {pad}ok:\n\n    update(x)\n", "d.py": "if ok:\nupdate(x)\n", "e.py": "if ok:\n\nupdate(x)\n"})).collect()
    assert sorted((r.path, r.rule_id, r.start_line) for r in rows) == [("a.py", "logic.state-transition", 1), ("c.py", "logic.race-hint", 1), ("e.py", "logic.race-hint", 1)]


def test_cookies_over_several_lines(spark):
    safe = "r.set_cookie(\n    'a',\n    f(x),\n    httponly=True,\n)\n"
    rows = blocks.authorization(corpus(spark, {"a.py": safe, "b.py": safe.replace("True", "False"), "c.py": "r.set_cookie('a')\nx(httponly=True)\n"})).collect()
    assert sorted((r.path, r.rule_id, r.start_line) for r in rows) == [("b.py", "authz.cookie-missing-httponly", 1), ("c.py", "authz.cookie-missing-httponly", 1)]


SPEC = {
    "paths": {
        "/users/{id}": {"get": {"summary": "a: b", "security": [{"key": []}]}, "delete": {"responses": {"200": {"description": "security"}}}, "parameters": [{"name": "id"}]},
        "/open": {"get": {"security": []}, "post": {"tags": ["x"]}},
        "/orders": {"get": {}},
    }
}
YAML = """# an interface
openapi: 3.0.0
paths:
    "/users/{id}":
        get:
            summary: 'a: b'
            security:
            - key: []
        delete:
            responses:
                '200':
                    description: security
        parameters:
        - name: id
    /open:   # all
        get:
            security: []   # none
        post:
            tags:
            - x
    /orders: 
        get: {}
"""


@pytest.mark.parametrize("whole", [None, [], [{"key": []}]])
def test_yaml_interfaces_give_the_rows_of_json(spark, whole):
    text, spec = YAML, dict(SPEC)
    if whole is not None:
        spec["security"] = whole
        text += "security:\n- key: []\n" if whole else "security: []\n"
    of = corpus(spark, {"a/openapi.json": json.dumps(spec), "b/openapi.yaml": text})
    rows = [{(r.route, r.method, r.secured) for r in ops(of.where(F.col("path") == p)).collect()} for ops, p in ((blocks.operations, "a/openapi.json"), (blocks.yaml_operations, "b/openapi.yaml"))]
    assert rows[0] == rows[1] and len(rows[0]) == 5
    hits = [r.path for r in blocks.openapi(of).collect()]
    assert hits.count("a/openapi.json") == hits.count("b/openapi.yaml")


def test_a_scan_reads_the_files_few_times(spark, monkeypatch):
    from spanwarden.functions import store
    from spanwarden.plans import detection_queries, scan

    plans = {}

    def keep(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return store.keep(df, name)

    monkeypatch.setattr(scan, "keep", keep)
    scan.detect(detection_queries._files(spark, "/root/testdata/sf0.001", detection_queries.PLANTS)).columns  # noqa: B018
    assert plans["detected"].count("FileScan") <= 25 and plans["detected"].count("Exchange ") <= 35

"""Streams give what batches give; state moves on only after a push."""

import pytest
from pyspark.sql import functions as F

from spanwarden.operators import findings, rules
from spanwarden.sources import files as src
from spanwarden.streaming import monitor

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_windows_equal_batch(spark):
    q = monitor.tumbling(monitor.event_stream(spark, EVENTS.rpartition("/")[0], "events.parquet"), "1 day").writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = monitor.tumbling(spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    key = lambda df: sorted((str(r.day), r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(spark.table("days")) == key(batch)


def test_incremental_scan_reads_new_content_only(spark):
    def corpus(**texts):
        return spark.createDataFrame([("p", k.replace("_", "."), "Python", len(v), v) for k, v in texts.items()], "project string, path string, language string, size long, text string")

    seen = []

    def scan(files):
        seen.append(sorted(r.path for r in files.collect()))
        return rules.match_rules(files, rules.PATTERNS).select("project", "path", "rule_id", "start_line")

    none = spark.createDataFrame([], "file_key string, findings array<struct<project:string,path:string,rule_id:string,start_line:int>>")
    first, cache = monitor.incremental(corpus(a_py="eval(x)", b_py="1"), none, scan, "1")
    second, _ = monitor.incremental(corpus(a_py="eval(x)", b_py="exec(y)"), cache, scan, "1")
    assert seen == [["a.py", "b.py"], ["b.py"]]
    assert [r.path for r in first.collect()] == ["a.py"]
    assert sorted(r.path for r in second.collect()) == ["a.py", "b.py"]


def test_drift_loop_keeps_its_state_until_a_push_succeeds(spark, tmp_path):
    def snapshot(n, *paths):
        rows = [(i, "r.x", p, 1, 2, "s") for i, p in enumerate(paths)]
        df = spark.createDataFrame(rows, "ordinal long, rule_id string, path string, start_line int, severity int, snippet string")
        df.withColumn("fingerprint", F.concat_ws("|", "rule_id", "path")).write.mode("append").parquet(f"{tmp_path}/in/{n}")
        return df

    snapshot(1, "a", "b")
    schema = spark.read.parquet(f"{tmp_path}/in/1").schema
    pushed, fail = [], [True]

    def push(changes, number):
        if fail[0]:
            fail[0] = False
            raise RuntimeError("the receiver is away")
        pushed.append((number, sorted((r.change, r.path) for r in changes.collect())))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        return monitor.drift_loop(stream, f"{tmp_path}/state", push, f"{tmp_path}/checkpoint")

    with pytest.raises(Exception, match="away"):
        run().awaitTermination(120)
    run().awaitTermination(120)
    snapshot(2, "b", "c")
    run().awaitTermination(120)
    assert pushed == [(0, [("added", "a"), ("added", "b")]), (1, [("added", "c"), ("removed", "a"), ("unchanged", "b")])]


def test_lines_of_a_stream_of_files_match_too(spark):
    f = spark.createDataFrame([("p", "a.py", "Python", 1, "eval(x)")], "project string, path string, language string, size long, text string")
    assert findings.severity_counts(rules.match_rules(f, rules.PATTERNS), ["project"]).first().HIGH == 1
    assert src.lines(f).count() == 1

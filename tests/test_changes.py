"""Merging of reports, unified diffs, automatic rewrites, file integrity with state, cycles over targets."""

import difflib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanwarden.operators import import_merge, patches
from spanwarden.streaming import fim

FINDING = "ordinal long, project string, path string, start_line int, scanner string, rule_id string, severity int, confidence int, cwe array<string>, cve string"


def brute(native, imported):
    """Every report against everything that stayed so far."""
    names = [c.split()[0] for c in FINDING.split(", ")]
    kept = [dict(zip(names, r, strict=True), own=True, also=[]) for r in native]
    for r in imported:
        f = dict(zip(names, r, strict=True), own=False, also=[])
        best = None
        for i, k in enumerate(kept):
            if (k["project"], k["path"]) != (f["project"], f["path"]) or k["scanner"] == f["scanner"] or "chains" in (k["scanner"], f["scanner"]):
                continue
            lines = k["start_line"] is not None and f["start_line"] is not None
            gap = abs(k["start_line"] - f["start_line"]) if lines else 0
            if (k["cve"] and k["cve"] == f["cve"]) or (lines and gap <= 2 and set(k["cwe"]) & set(f["cwe"])):
                if best is None or gap < best[0]:
                    best = (gap, i)
        if best is None:
            kept.append(f)
            continue
        k = kept[best[1]]
        stays, goes = (f, k) if not k["own"] and (f["severity"], f["confidence"]) > (k["severity"], k["confidence"]) else (k, f)
        for e in [*goes["also"], f"{goes['scanner']}:{goes['rule_id']}"]:
            if e not in stays["also"]:
                stays["also"].append(e)
        stays["severity"] = max(stays["severity"], goes["severity"])
        kept[best[1]] = stays
    return sorted((k["ordinal"], k["severity"], tuple(k["also"])) for k in kept)


@pytest.mark.parametrize("seed", range(6))
def test_reports_merge_in_their_order(spark, seed):
    rng = random.Random(seed)

    def row(i, tools):
        return (i, rng.choice(["p", None]), rng.choice(["a", "b"]), rng.choice([None, *range(1, 30)]), rng.choice(tools), f"r{rng.randint(0, 4)}", rng.randint(0, 4), rng.randint(0, 2), rng.sample(["CWE-1", "CWE-2", "CWE-3"], rng.randint(0, 2)), rng.choice([None, None, None, "CVE-2024-1111", "CVE-2024-2222"]))

    native = [row(i, ["n1", "n2", "chains"]) for i in range(40)]
    imported = [row(100 + i, ["x", "y", "n1"]) for i in range(160)]
    got = import_merge.merge_reports(*(spark.createDataFrame(r, FINDING) for r in (native, imported))).collect()
    assert sorted((r.ordinal, r.severity, tuple(r.also_reported_by or ())) for r in got) == brute(native, imported)


@pytest.mark.parametrize("seed", range(4))
def test_unified_diffs(spark, seed):
    rng = random.Random(seed)
    files, fixes, want = [], [], {}
    for k in range(12):
        lines = [f"line {i} of {k} é" for i in range(1, rng.choice([1, 2, 9, 40, 80]) + 1)]
        new = list(lines)
        for i in sorted(rng.sample(range(len(lines)), rng.randint(0, min(9, len(lines))))):
            new[i] = f"fixed {i}"
            fixes.append((None if k % 2 else "p", f"f{k}", i + 1, new[i]))
        files.append((None if k % 2 else "p", f"f{k}", "\n".join(lines) + "\n"))
        if new != lines:
            want[f"f{k}"] = "\n".join(difflib.unified_diff(lines, new, f"a/f{k}", f"b/f{k}", lineterm="")) + "\n"
    fixes += [("p", "f0", 999, "x"), ("p", "none", 1, "x"), ("p", "f2", 1, "line 1 of 2 é")] if ("p", "f2", 1) not in {f[:3] for f in fixes} else []
    got = patches.unified_diffs(spark.createDataFrame(files, "project string, path string, text string"), spark.createDataFrame(fixes, "project string, path string, line int, replacement string")).collect()
    assert {r.path: r.patch for r in got} == want


def test_automatic_rewrites(spark):
    rows = [("good", True)] * 30 + [("poor", i % 2 == 0) for i in range(30)] + [("young", True)] * 3 + [("patterns.flask-debug-true", i % 2 == 0) for i in range(30)]
    got = patches.automatic(spark.createDataFrame(rows, "rule_id string, verified boolean"), graduate=("young",), demote=("other",)).collect()
    assert {r.rule_id for r in got if r.automatic} == {"good", "young", "patterns.python-yaml-load"}


def test_integrity_keeps_state_and_times_out(spark, tmp_path):
    schema = "target string, path string, digest string, mode string, seen timestamp"
    batches = [
        [("t", "a", "1", "644", "10:00"), ("t", "b", "1", "644", "10:00"), ("u", "a", "1", "644", "10:00")],
        [("t", "a", "2", "644", "10:30"), ("u", "a", "1", "600", "10:30")],
        [("t", "a", "2", "644", "12:30"), ("u", "a", "1", "600", "12:30")],
        [("t", "a", "2", "644", "12:40")],
    ]
    folder = tmp_path / "in"

    def put(rows):
        spark.createDataFrame(rows, "target string, path string, digest string, mode string, at string").select("target", "path", "digest", "mode", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "at")).alias("seen")).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        fim.integrity(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    for rows in batches:  # each run goes on where the one before ended
        put(rows)
        run()
    got = defaultdict(list)
    for r in spark.read.schema(fim.FINDINGS).parquet(str(tmp_path / "out")).collect():
        got[(r.target, r.path)].append(r.rule_id)
    assert {k: sorted(v) for k, v in got.items()} == {("t", "a"): ["fim.content-changed"], ("u", "a"): ["fim.permission-changed"], ("t", "b"): ["fim.file-removed"]}


def test_a_failing_target_leaves_the_others(spark):
    def step(target):
        if target == "bad":
            return spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("rule_id"))
        return spark.createDataFrame([(f"r.{target}", 1)], "rule_id string, severity int")

    got = fim.cycle(spark, ["a", "bad", "b"], step).collect()
    assert sorted((r.target, r.rule_id) for r in got) == [("a", "r.a"), ("b", "r.b"), ("bad", "cycle.target-failed")]


def _reported(spark, n):
    schema = "ordinal long, project string, rule_id string, scanner string, path string, start_line int, snippet string, severity int, confidence int, likelihood int, risk_score double"
    return spark.createDataFrame([(i, None, f"a.r{i % 3}<&", "a", f"d/{i} \"x\"|_y.py", None if i % 7 == 0 else i, f"s{i}", i % 5, 1, 2, float(i % 9)) for i in range(n)], schema)


def test_reports_are_written_in_order(spark, tmp_path):
    from spanwarden.functions import reports

    f = _reported(spark, 400).repartition(7)
    for name, whole in (("junit", reports.junit(f)), ("html", reports.html(f)), ("markdown", reports.markdown(f))):
        reports.report(f, name, f"file://{tmp_path}/{name}")
        text = "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        assert text.replace("\n", "") == whole.replace("\n", "") and len(text) > 400 * 30
    assert "&lt;&amp;" in reports.html(f) and r"\|\_y\.py" in reports.markdown(f, "a*b") and r"a\*b" in reports.markdown(f, "a*b")
    reports.register("own", lambda findings, path: findings.write.parquet(path))
    reports.report(f, "own", f"file://{tmp_path}/own")
    assert spark.read.parquet(f"file://{tmp_path}/own").count() == 400
    with pytest.raises(ValueError):
        reports.report(f, "none", "x")
    with pytest.raises(ValueError):
        reports.register("own", None)


def test_a_json_report_is_a_baseline(spark):
    from spanwarden.operators import findings as ops
    from spanwarden.sources import report_json

    f = ops.with_scores(_reported(spark, 30))
    text = f.where("ordinal < 20").agg(F.to_json(F.struct(F.collect_list(F.struct("rule_id", "scanner", F.col("severity").cast("string").alias("severity"), F.struct("path", "start_line", "snippet").alias("location"))).alias("findings"))).alias("text")).withColumn("file", F.lit("old.json"))
    raw = text.unionByName(spark.createDataFrame([("{", "bad.json"), ('{"findings": []}', "empty.json"), (None, "none.json")], "text string, file string"))
    known = report_json.read_reports(raw)
    assert known.count() == 20 and sorted(r.ordinal for r in ops.new_findings(f, known).collect()) == list(range(20, 30))
    assert {r.file for r in report_json.refused(raw).collect()} == {"bad.json", "none.json"}


@pytest.mark.parametrize("listed", [2000, 0])
def test_known_texts_of_any_length(spark, monkeypatch, listed):
    from spanwarden.operators import matching

    monkeypatch.setattr(matching, "LISTED", listed)
    rng = random.Random(7)
    texts = [(i, " ".join(rng.choice(["ab", "ba", "abc", "c", "é"]) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(99, None), (98, "")]
    known = [(i, t[a : a + n]) for i, (a, n) in enumerate((rng.randint(0, 30), rng.choice([1, 2, 5, 9, 20, 70])) for _ in range(60)) if (t := texts[rng.randrange(40)][1])[a : a + n]] + [(500, ""), (501, "zzz")]
    got = matching.containing(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(known, "item_id long, known string")).collect()
    assert sorted(map(tuple, got)) == sorted({(d, k) for d, t in texts for k, w in known if w and t and w in t})


def test_nesting_is_read_outside_strings():
    from spanwarden.sources import sarif

    assert [sarif._depth(t) for t in ('{"a": [1, {"b": "]}[[[["}]}', "", '"[[', '[["\\"[", []]]', '"a\\\\" [[]]', "]]]", '["\\')] == [3, 0, 0, 3, 2, 0, 1]


def test_imports_leave_out_excluded_paths_and_summaries_fold(spark):
    from spanwarden.operators import findings as ops
    from spanwarden.operators import metrics

    f = spark.createDataFrame([("src/a.py",), ("vendor/x/b.py",), ("(image)",), ("c.min.js",)], "path string")
    assert sorted(r.path for r in ops.not_excluded(f, ["vendor/**", "*.min.js"]).collect()) == ["(image)", "src/a.py"]
    s = "section string, key string, n long, items array<string>"
    mine = spark.createDataFrame([("audit", "allow", 2, None), ("context", "cleared", None, ["a"]), ("audit", "own", 1, None)], s)
    theirs = spark.createDataFrame([("audit", "allow", 3, None), ("context", "cleared", None, ["b", "a"]), ("audit", "other", 4, None)], s)
    got = {(r.section, r.key): (r.n, r["items"]) for r in metrics.folded_summary(mine, theirs).collect()}
    assert got == {("audit", "allow"): (5, None), ("context", "cleared"): (None, ["a", "b", "a"]), ("audit", "own"): (1, None), ("audit", "other"): (4, None)}

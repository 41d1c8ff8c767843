"""Advisories meet versions in dealt tasks, and those of one CVE are put in order before."""

from spanwarden.operators import dependencies


def test_one_advisory_of_a_cve_is_chosen_before_the_pairs(spark):
    p = spark.createDataFrame([("PyPI", "A_b", f"{i}.{j}") for i in range(4) for j in range(3)] + [("npm", "x", "1.0")], "ecosystem string, package string, version string")
    levels = ["LOW", "HIGH", None, "CRITICAL"]
    rows = [(f"ADV-{k}", "npm" if k % 11 == 0 else "PyPI", "x" if k % 11 == 0 else "a-b", f"{['<', '<=', '>=', '>', '==', ''][k % 6]} {k % 4}.{k % 3}", levels[k % 4], None if k % 7 == 0 else f"CVE-{k % 5}") for k in range(80)]
    adv = spark.createDataFrame(rows, "id string, ecosystem string, package string, vulnerable string, severity string, cve string")
    want = dependencies.one_per_cve(dependencies.vulnerable(p, adv))
    got = dependencies.vulnerable_once(p, adv)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect())) and want.count() > 50


def test_pairs_are_dealt_by_a_number_that_bytes_do_not_change(spark):
    p = spark.createDataFrame([("npm", f"p{i}", "1.0") for i in range(200)], "ecosystem string, package string, version string")
    adv = spark.createDataFrame([(f"A{i}", "npm", f"p{i}", "<2", "LOW", "C") for i in range(200)], "id string, ecosystem string, package string, vulnerable string, severity string, cve string")
    out = dependencies.vulnerable(p, adv)
    assert out.rdd.getNumPartitions() >= 12 and out.count() == 200

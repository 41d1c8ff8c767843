"""Language ID by cross-parsing: phrases against brute force, odd cases, held-out accuracy."""

import random
import zlib

import pytest

from spanwarden.llm import language

SYLLABLES = {"aa": ["ka", "to", "mi"], "bb": ["shr", "ing", "the"], "cc": ["ñe", "ça", "ou"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def phrases(data, text):
    """Greedy longest matches of text in data; an unmatched byte is a phrase. Segments are parsed alone."""
    n = 0
    for at in range(0, len(text), language.SEGMENT):
        z, i = text[at : at + language.SEGMENT], 0
        while i < len(z):
            m = 1
            while i + m < len(z) and z[i : i + m + 1] in data:
                m += 1
            i, n = i + m, n + 1
    return n


def test_phrases_brute_force():
    rng = random.Random(3)
    samples = {k: words(rng, k, 60).encode() for k in SYLLABLES}
    bodies = [words(rng, rng.choice("abc") * 2, rng.randint(0, 900)) for _ in range(30)] + ["", "zz", "x" * 5000, "日本語 ka", "ka" * 512, "ka" * 511 + "z"]
    bodies = [language.plain(b) for b in bodies]
    got = language.Parser(samples).phrases(bodies).tolist()
    assert got == [[phrases(samples[k], b) for k in sorted(samples)] for b in bodies]


def test_automaton_holds_every_substring():
    data = b"abcbcabcabbab"
    after = language.suffix_automaton(data)

    def has(z):
        s = 0
        for c in z:
            if c not in after[s]:
                return False
            s = after[s][c]
        return True

    rng = random.Random(1)
    for _ in range(2000):
        z = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6)))
        assert has(z) == (z in data)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, lang := rng.choice(sorted(SYLLABLES)), rng.randint(10, 60)) + "\nAll rights reserved.", lang, 7) for i in range(400)]
    rows += [(1000, None, "aa", 1), (1001, "", "aa", 1), (1002, "12 ?!", "bb", 1), (None, "kato mito", None, 1), (1003, "kato mito", None, 1), (1003, "kato mito", None, 1), (1004, "shring " * 50_000, "bb", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_languages(docs):
    got = language.languages(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), ("und", 0.0))
    assert {r.lang_pred for r in got if r.doc_id in (None, 1003)} == {"aa"} and {r.lang_pred for r in got if r.doc_id == 1004} == {"bb"}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 50 and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)


def test_held_out_labels_and_source_change_nothing(docs):
    swapped = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    assert language.samples(swapped) == language.samples(docs)
    assert all(b"reserved" not in data for data in language.samples(docs).values())


def test_no_labels_and_no_rows(docs, spark):
    none = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {(r.lang_pred, r.score) for r in language.languages(none).collect()} == {("und", 0.0)}
    assert language.languages(docs.limit(0)).collect() == []

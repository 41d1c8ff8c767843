"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, conversations, html_text, language, media, minhash, packing, pii, quality, token_counts, token_ids, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A vocabulary file's place; the files are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> dict:
    """What token_ids needs to give the ids of byte_bpe_50k.json."""
    import public_tokenizers

    return {"file": tokenizer("byte_bpe_50k.json"), "ranks_file": tokenizer("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": {"<|endoftext|>": 50256}}


def byte_and_piece() -> dict:
    """What alignment needs of byte_bpe_50k.json and piece_bpe_32k.model."""
    import public_tokenizers

    return {"ranks_file": tokenizer("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "model": tokenizer("piece_bpe_32k.model")}


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_ids(table(spark, sf_dir, "documents"), byte_bpe())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), byte_and_piece())


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash, op2_html_text, op3_token_counts, op4_pii, op5_packing, op6_toxicity, op7_token_ids, op8_quality, op9_bpe, op10_gif, op11_alignment, op12_language, op13_prefix_trie)}

_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Near duplicates by a join of shingles, and components by reaching along links.
NEAR_DUPLICATES_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s"""

#: Measures of texts; a text is kept if the base and no rule of quality.RULES rejects it.
QUALITY_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM t)),
d AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1), k AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM g JOIN d USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT doc_id, text, w, l, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words FROM t LEFT JOIN k USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars OR (len(l) >= 4 AND 100 * n_dup_lines > 50 * len(l)) OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words
OR (length(lower(text)) = length(text) AND 2 * len(list_filter(string_split(text, ''), lambda c: lower(c) <> c)) > word_chars) OR 10 * length(regexp_replace(text, '[^!]', '', 'g')) > 3 * n_words OR 2 * length(regexp_replace(text, '[^A-Za-z\x{{AA}}-\x{{10FFFF}}]', '', 'g')) < word_chars
OR 4 * length(regexp_replace(text, '[^|]', '', 'g')) > n_words OR 100 * len([i for i in range(1, len(w)) if w[i] = w[i + 1]]) > 30 * n_words OR (n_words >= 50 AND 20 * len(list_distinct(w)) < n_words) AS rejected FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM v"""

ORACLE_SQL: dict[str, str] = {"op1_minhash": NEAR_DUPLICATES_SQL, "op8_quality": QUALITY_SQL}

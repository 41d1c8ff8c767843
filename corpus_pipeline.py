"""Documents through a training-data pipeline: toxicity, quality rules, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.

Defined results: null, empty and blank texts have no words, so the quality rules reject them; rows with a null
id pass every stage by their text alone and near_duplicates keeps them; rows that repeat an id are judged each,
and near_duplicates keeps all of them or none; ties keep the smallest id. Texts of any length are read whole.
Columns beyond those of documents pass through all stages but the last, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwarden.llm import minhash, packing, pii, quality, toxicity
from spanwarden.llm.common import Scratch
from spanwarden.llm.queries import table, tokenizer


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls toxic."""
    return toxicity.filtered(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares 0.8 or more of its five-word shingles."""
    return minhash.deduplicated(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places documents in batches of a token budget: doc_id, n_tokens, bucket, bucket_length, batch_id, row."""
    return packing.pack_documents(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("toxicity", toxic), ("quality_rules", rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]

#: No SQL states the classifier and the field; tests hold stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

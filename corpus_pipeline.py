"""The corpus pipeline: quality classifier, near-duplicates, decontamination, personal data, token digests.

Every stage is a function of (spark, docs, sf_dir); ``run`` writes each result as Parquet in the shared folder and reads it back
as the documents of the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import bpe, decontaminate, near_dedup, pii, quality_model, queries
from doclake.llm.common import table, written


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the labels it learns from belong to the table."""
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.deduplicate(docs)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; where one was put in, ``n_chars`` is counted anew."""
    out = pii.pseudonymise(docs, queries.PII_KEY)
    counted = F.when(F.size("pii") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", counted).select(*docs.columns)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of the tokens and of the decoded bytes."""
    return bpe.digests(docs, public_tokenizers.path(queries.RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_text),
    ("near_dedup", one_of_each),
    ("decontaminate", clean_benchmark),
    ("pii", hide_personal_data),
    ("bpe", token_digests),
]

#: No SQL twin: a trained model, consistent sampling, keyed permutations and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs

"""Corpus roll-ups (``r*``) over the per-document results; every grouping combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions import text as tx
from doclake.operators import text as t
from doclake.sources import trees


def corpus_profile(docs: DataFrame) -> DataFrame:
    """r1: documents, words and characters by type and language flag, with subtotals."""
    return (
        docs.select("doc_type", tx.language_flag(F.col("text")).alias("lang_flag"),
                    tx.word_count(F.col("text")).alias("words"), tx.char_count(F.col("text")).alias("chars"))
        .rollup("doc_type", "lang_flag")
        .agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.sum("chars").alias("chars"))
    )


def metric_frequency(docs: DataFrame, k: int = 20) -> DataFrame:
    """r2: the k metrics of each class found in most documents. The rank filter is applied before the shuffle too."""
    freq = t.metric_mentions(docs).groupBy("kind", "metric").agg(F.count("*").alias("doc_freq"))
    w = Window.partitionBy("kind").orderBy(F.col("doc_freq").desc(), F.col("metric"))
    return freq.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def tag_inventory(docs: DataFrame) -> DataFrame:
    """r3: tags over all XML documents, counted by the parser; a row for each tag and task is shuffled."""
    return trees.xml_tag_counts(docs).groupBy("clean_tag").agg(
        *[F.sum(c).alias(c) for c in ("docs", "elements", "attributes", "text_length")])


def key_inventory(docs: DataFrame) -> DataFrame:
    """r4: node paths (array positions dropped) and kinds over all JSON documents, counted by the parser."""
    return trees.json_path_counts(docs).groupBy("path", "kind").agg(F.sum("docs").alias("docs"), F.sum("nodes").alias("nodes"))


def flag_agreement(docs: DataFrame) -> DataFrame:
    """r5: language flag against a known language."""
    return (
        docs.select("lang", tx.language_flag(F.col("text")).alias("lang_flag"))
        .groupBy("lang", "lang_flag").agg(F.count("*").alias("docs"))
    )


def reject_report(processed: DataFrame) -> DataFrame:
    """r6: rejects by reason and extension."""
    return (
        processed.filter(F.col("reason").isNotNull())
        .groupBy("reason", "ext").agg(F.count("*").alias("rejects"))
    )



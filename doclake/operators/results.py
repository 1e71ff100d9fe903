"""Result rows, reject rows, capability table, failure policy (``e*``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import fixed
from doclake.operators import routing
from doclake.sources.registry import DEFAULT, Registry


def result_rows(processed: DataFrame) -> DataFrame:
    """e1: one row per document that succeeded."""
    return processed.filter(F.col("reason").isNull()).select(
        "req_id", F.lit(True).alias("success"), F.lit(fixed.SUCCESS_MESSAGE).alias("message"), "file_name",
        "output_format", "ai_optimized",
        F.when(F.coalesce("s3_path", F.lit("")) != "", "s3").otherwise("base64").alias("input_method"),
        "s3_path",
        F.col("length").alias("input_bytes"),
        F.char_length("result").cast("bigint").alias("output_chars"),
    )


def by_reason(reason: Column, field: int) -> Column:
    """Status (1) or message (2) of a reject reason; unknown reasons are internal errors."""
    known = {r[0]: r[field] for r in fixed.REJECT_MESSAGES}
    out = None
    for name, value in known.items():
        out = F.when(reason == name, F.lit(value)) if out is None else out.when(reason == name, F.lit(value))
    return out.otherwise(F.lit(known["internal_error"]))


def reject_rows(processed: DataFrame) -> DataFrame:
    """e2: one row per document that failed, with status, message and hints; an object that cannot be read has its store's message."""
    status = by_reason(F.col("reason"), 1).cast("bigint")
    message = by_reason(F.col("reason"), 2)
    if "object_error" in processed.columns:
        stored = routing.object_error_message(F.col("object_error"), F.col("bucket_name"), F.col("s3_path"))
        message = F.when(F.col("object_error").isNotNull(), stored).otherwise(message)
    return processed.filter(F.col("reason").isNotNull()).select(
        "req_id", F.lit(False).alias("success"), "file_name", "reason", status.alias("status"),
        F.when(status == 400, fixed.CLIENT_ERROR_TYPE).otherwise("InternalError").alias("error_type"),
        message.alias("message"),
        F.when(status == 400, " | ".join(fixed.CLIENT_HINTS)).otherwise(" | ".join(fixed.SERVER_HINTS)).alias("hints"),
        F.when(status == 400, ", ".join(fixed.SUPPORTED_FORMATS_TEXT)).alias("supported_formats"),
    )


def capabilities(spark: SparkSession, registry: Registry = DEFAULT) -> DataFrame:
    """e3: supported extensions with their reader and how many there are."""
    n = len(registry.readers)
    return (
        registry.frame(spark).select("ext", "reader", "doc_type", F.lit(n).cast("bigint").alias("n_supported")).orderBy("ext")
    )


def usage(files: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """e3 against a corpus: every supported extension with the number of files that have it."""
    counted = files.groupBy(F.lower("ext").alias("ext")).agg(F.count("*").alias("n_files"))
    table = registry.frame(files.sparkSession).withColumn("n_supported", F.lit(len(registry.readers)).cast("bigint"))
    return table.join(counted, "ext", "left").select(
        "ext", "reader", "doc_type", "n_supported", F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files")
    )

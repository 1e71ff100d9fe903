"""Result and dead-letter sinks (s9, s10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.sources import textfiles


def write_results(processed: DataFrame, path: str, mode: str = "append") -> None:
    """s9: one row per document that succeeded, partitioned by document type; rows of a type go to few files, not one for each task."""
    done = processed.filter(F.col("reason").isNull()).hint("rebalance", "doc_type")
    done.write.mode(mode).partitionBy("doc_type").parquet(path)


#: Ending of the file that holds a result.
ENDINGS = {"markdown": "md", "markdown_ai": "md", "plain": "txt", "structured_json": "json"}


def write_texts(processed: DataFrame, path: str, mode: str = "append") -> None:
    """s9: the result of each document that succeeded as a file of its own (``textfiles``); ``path`` is a place that pyarrow's file
    systems open. The index has all other columns."""
    ending = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])[F.col("output_format")]
    done = processed.filter(F.col("reason").isNull())
    named = done.select(F.concat_ws(".", "file_name", F.coalesce(ending, F.lit("txt"))).alias("name"), F.col("result").alias("body"),
                        *[c for c in done.columns if c not in ("result", "reason")])
    textfiles.write_documents(named, path, mode)


def write_rejects(processed: DataFrame, path: str, mode: str = "append") -> None:
    """s10: one row per document that failed, with the reason."""
    processed.filter(F.col("reason").isNotNull()).write.mode(mode).parquet(path)

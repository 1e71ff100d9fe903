"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclake.plans import shared


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` and further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


#: Tables written by each ``settled`` that is under way.
_on_the_way: list[list[DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later reads need neither its lineage nor its executors."""
    spark = df.sparkSession
    folder = shared.new_folder(spark)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    for tables in _on_the_way[-1:]:
        tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of ``written`` tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a table in the shared folder; the tables that it writes on the way are deleted."""
    _on_the_way.append([])
    try:
        df = build()
    finally:
        tables = _on_the_way.pop()
    out = written(df)
    discard(*tables)
    return out


def row_key(id_column: str, text_column: str) -> list[Column]:
    """Columns that tell rows apart even where ids repeat or are null; only equal rows share a key."""
    return [
        F.coalesce(F.col(id_column), F.lit(-1).cast("bigint")).alias("k1"),
        F.xxhash64(F.col(id_column).isNull(), F.col(text_column).isNull(), text_column).alias("k2"),
    ]


def packed_rows(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, z) of every row of ``docs``: its key, and its text (null: empty) compressed for the way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [z.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), b.column("doc_id"), pa.array(raw, pa.binary())], names=["k1", "k2", "doc_id", "z"])

    own = docs.select(*row_key("doc_id", "text"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, z binary")

"""Files of a directory or object store (s1), CSV scans (s3) and JSON documents (s4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclake.functions import text as tx
from doclake.sources import csvfiles, trees

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def with_names(raw: DataFrame) -> DataFrame:
    return raw.select(
        "path",
        tx.base_name(F.col("path")).alias("file_name"),
        F.lower(tx.extension_of(F.col("path"))).alias("ext"),
        "length", "modificationTime", "content",
    )


def scan_files(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """s1: whole files with size and time. ``content`` is read only if selected; ``max_bytes`` is pushed to the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(path)
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    return with_names(raw)


def csv_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_ragged"]])


def scan_csv(spark: SparkSession, path: str | list[str], columns: list[str], multi_line: bool = True, header: bool = True) -> DataFrame:
    """s3: CSV rows as strings, plus ``_ragged`` (the raw record of rows with too few or too many cells).

    Large files are read by many tasks either way. ``multi_line=True`` allows line breaks inside quotes and finds the records by two passes
    (``csvfiles``); pass ``False`` for files without such breaks, which then take one.
    """
    if multi_line:
        return parse_csv(csvfiles.csv_records(spark, path, header), columns)
    return (
        spark.read.schema(csv_schema(columns))
        .option("header", header)
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", "_ragged")
        .option("enforceSchema", True)
        .csv(path)
    )


def parse_csv(records: DataFrame, columns: list[str]) -> DataFrame:
    """s3 for records that are already rows (column ``value``): the same columns, fully parallel."""
    options = {"escape": '"', "columnNameOfCorruptRecord": "_ragged", "mode": "PERMISSIVE"}
    schema = ", ".join(f"`{f.name}` string" for f in csv_schema(columns).fields)
    kept = [c for c in records.columns if c != "value"]
    return records.select(*kept, F.from_csv("value", F.lit(schema), options).alias("r")).select(*kept, "r.*")


def scan_json(docs: DataFrame) -> DataFrame:
    """s4: docs + reason, null where the text is JSON by the parser that makes the nodes (``trees.json_nodes``)."""
    parsed = trees.with_trees(docs, "json", node_fields=["kind"], element_fields=["depth"])
    return parsed.select(*docs.columns, F.when(F.coalesce(parsed["status"] != "ok", F.lit(True)), "malformed").alias("reason"))

"""Rows of a table in one row group are dealt to tasks, whatever the session says."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doclake.functions import cells
from doclake.plans import corpora


@pytest.fixture
def unset(spark):
    held = spark.conf.get("spark.doclake.spread")
    spark.conf.unset("spark.doclake.spread")
    yield spark
    spark.conf.set("spark.doclake.spread", held)


def test_one_row_group_is_worked_on_by_many_tasks(unset, tmp_path):
    unset.range(4000).selectExpr("id AS doc_id", "concat('texto ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = corpora.documents(unset, str(tmp_path))
    sizes = docs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 4000 and len(sizes) >= unset.sparkContext.defaultParallelism and max(sizes) <= 2 * 4000 / len(sizes)


def test_cell_text_is_cleaned_once(spark):
    df = spark.createDataFrame([("  a | \"b\"\n" + "c" * 30,), ("x",), (None,)], "value string").select(cells.escape_cell(F.col("value"), 12).alias("c"))
    assert [r.c for r in df.collect()] == ['a \\| \\"b\\"...'[:9] + "...", "x", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1

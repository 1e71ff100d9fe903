"""Arriving files: bounded files, bounded batches, few tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF_DIR
from doclake.operators import lines
from doclake.plans import corpora, queries, shared
from doclake.streaming import jobs


def test_arriving_files_hold_a_bounded_number_of_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "new_folder", lambda s: str(tmp_path / "data"))
    monkeypatch.setattr(queries, "FILE_TEXTS", 7)
    got = queries.all_queries()["st2_file_arrival"](spark, SF_DIR).collect()
    texts = corpora.documents(spark, SF_DIR)
    assert len(list((tmp_path / "data" / "in").glob("*.txt"))) >= texts.count() / 7
    want = lines.line_stats(texts).agg(F.sum("non_empty_lines"), F.sum("total_words")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_many_files_take_bounded_batches_and_leave_the_session_alone(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for i in range(50):
        (tmp_path / "in" / f"{i}.txt").write_text(f"texto {i}")
    monkeypatch.setattr(jobs, "BATCH_FILES", 20)
    before = spark.conf.getAll
    query = jobs.file_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "*.txt")
    query.awaitTermination()
    assert sorted(p.numInputRows for p in query.recentProgress if p.numInputRows) == [10, 20, 20]
    assert spark.conf.getAll == before
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(f"texto {i}" for i in range(50))

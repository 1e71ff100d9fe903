"""Arriving files are noted by tasks: the driver's log names notes, not files."""

from __future__ import annotations

import json
import os

from doclake.streaming import arrivals, jobs


def _run(spark, folder, glob="*.txt"):
    jobs.file_stream(spark, str(folder / "in"), str(folder / "out"), str(folder / "cp"), glob).awaitTermination()
    return sorted((r.path.removeprefix(f"file:{folder}/in/"), r.text, r.length) for r in spark.read.parquet(str(folder / "out")).collect())


def _logged(folder) -> list[str]:
    logs = [p for p in (folder / "cp" / "sources" / "0").iterdir() if not p.name.startswith(".")]
    return [json.loads(line)["path"] for log in logs for line in log.read_text().splitlines()[1:]]


def test_the_log_of_the_driver_names_notes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BATCH_FILES", 20)
    for i in range(50):
        place = tmp_path / "in" / f"d{i % 3}" / "e é"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{i}.txt").write_text(f"texto {i}")
    for name in ("_hidden.txt", ".dot.txt", "x.txt._COPYING_", "other.csv", "_a=1.txt"):
        (tmp_path / "in" / name).write_text("x")
    (tmp_path / "in" / "_commits").mkdir()
    (tmp_path / "in" / "_commits" / "no.txt").write_text("x")
    want = sorted([("_a=1.txt", "x", 1)] + [(f"d{i % 3}/e é/{i}.txt", f"texto {i}", len(f"texto {i}")) for i in range(50)])
    assert _run(spark, tmp_path) == want
    assert len(_logged(tmp_path)) == 3 and all("/arrivals/listed-" in p for p in _logged(tmp_path))
    # what a broken listing left is passed over, only what is new is noted, and nothing is noted where nothing is new
    (tmp_path / "cp" / "arrivals" / "_new-broken").mkdir()
    (tmp_path / "in" / "later.txt").write_bytes(b"fin")
    assert _run(spark, tmp_path) == sorted([*want, ("later.txt", "fin", 3)])
    assert len(_run(spark, tmp_path)) == 52 and len(_logged(tmp_path)) == 4


def test_a_checkpoint_without_notes_goes_on_without_them(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    with monkeypatch.context() as m:
        m.setattr(arrivals, "walkable", lambda *a: None)
        assert _run(spark, tmp_path) == [("a.txt", "a", 1)]
    (tmp_path / "in" / "b.txt").write_text("b")
    assert _run(spark, tmp_path) == [("a.txt", "a", 1), ("b.txt", "b", 1)]
    assert not os.path.exists(tmp_path / "cp" / "arrivals")


def test_names_are_matched_as_spark_does(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a1.txt", "b2.txt", "c3.csv", "ab.txt", "a[1].txt"):
        (tmp_path / "in" / name).write_text("x")
    root = arrivals.walkable(spark, str(tmp_path / "in"), str(tmp_path / "cp"))
    for glob in ("*.txt", "?[0-9].txt", "{a1,c3}.*", "[^a]*", "a\\[1].txt", None):
        reader = spark.read.format("binaryFile")
        found = (reader.option("pathGlobFilter", glob) if glob else reader).load(str(tmp_path / "in")).select("path")
        assert {r.path for r in arrivals.listed(spark, root, glob).collect()} == {r.path for r in found.collect()}
    assert arrivals.walkable(spark, str(tmp_path / "in*"), str(tmp_path / "cp")) is None

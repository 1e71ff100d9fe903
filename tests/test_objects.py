"""Stored objects, files of single documents, and batches of the request stream that become visible at once."""

from __future__ import annotations

import base64
import errno
import json

import pytest
from pyspark.sql import functions as F

from doclake.operators import results
from doclake.plans.process import outcomes, process, rejects
from doclake.sources import objects, sinks, textfiles
from doclake.sources.objects import ObjectError, Store
from doclake.streaming import jobs

SCHEMA = (
    "req_id bigint, file_name string, file_content string, s3_path string, bucket_name string, output_format string, "
    "ai_optimized boolean, include_metadata boolean, region string"
)


def b64(text):
    return base64.b64encode(text.encode()).decode()


def requested(spark, *rows):
    full = [(i, *r, *[None] * (8 - len(r))) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, SCHEMA)


def plain(name, bucket="b", key=None):
    return (name, None, key or name, bucket, "plain")


# ---- objects ----------------------------------------------------------------------------------


@pytest.fixture
def bucket(tmp_path):
    (tmp_path / "b" / "in").mkdir(parents=True)
    (tmp_path / "b" / "in" / "a.txt").write_text("hola\r\nmundo")
    (tmp_path / "b" / "empty.txt").write_text("")
    (tmp_path / "b" / "l.xml").write_bytes('<?xml version="1.0" encoding="ISO-8859-1"?><r>año</r>'.encode("latin-1"))
    (tmp_path / "secret.txt").write_text("no")
    return Store(f"{tmp_path}/{{bucket}}/{{key}}")


def test_objects_are_read_where_they_are_requested(spark, bucket):
    rows = requested(
        spark, plain("a.txt", key="in/a.txt"), plain("none.txt"), plain("a.txt", "nowhere"), plain("empty.txt"), ("x.txt", b64("inline"), None, None, "plain"),
        plain("s.txt", key="../secret.txt"), plain("in.txt", key="in"), ("l.xml", None, "/l.xml", "b", "markdown_ai"), ("a.txt", None, "in/a.txt"))
    got = {r.req_id: r for r in outcomes(rows, "T", store=bucket).collect()}
    assert (got[1].result, got[5].result) == ("hola\nmundo", "inline") and "- **Text Content:** 3 characters" in got[8].result
    assert {i: (r.reason, r.object_error) for i, r in got.items() if r.reason} == {
        2: ("missing_file", "NoSuchKey"), 3: ("missing_file", "NoSuchBucket"), 4: ("empty_file", None), 6: ("missing_file", "NoSuchKey"),
        7: ("missing_file", "NoSuchKey"), 9: ("missing_bucket", None)}
    assert {r.req_id for r in process(rows, "T", store=bucket).collect()} == {1, 5, 8}
    messages = {r.req_id: (r.message, r.status) for r in results.reject_rows(rejects(rows, store=bucket)).collect()}
    assert messages[2] == ("File 'none.txt' not found in bucket 'b'", 400)
    assert messages[3] == ("S3 bucket 'nowhere' does not exist or you don't have access", 400)
    assert messages[4][0] == "El archivo está vacío"


def test_a_store_tells_its_own_errors(spark):
    codes = {"denied": "AccessDenied", "moved": "PermanentRedirect", "busy": "SlowDown", "odd": "Teapot"}

    def read(bucket, key, region):
        if key in codes:
            raise ObjectError(codes[key])
        return f"{bucket} {key} {region}".encode()

    rows = requested(spark, *[(f"{k}.txt", None, k, "b", "plain", None, None, "eu-west-1") for k in [*codes, "fine"]])
    got = outcomes(rows, "T", store=Store(read=read))
    assert [r.result for r in got.filter("reason IS NULL").collect()] == ["b fine eu-west-1"]
    bad = {r.file_name: (r.reason, r.message) for r in results.reject_rows(got).collect()}
    assert bad == {
        "denied.txt": ("unreadable_file", "Access denied to s3://b/denied. Check your permissions"),
        "moved.txt": ("unreadable_file", "Bucket 'b' is in a different region"),
        "busy.txt": ("unreadable_file", "S3 is throttling requests. Please retry later"),
        "odd.txt": ("unreadable_file", "S3 error (Teapot) accessing s3://b/odd")}


@pytest.mark.parametrize("error,code", [
    (OSError("When reading: AWS Error NO_SUCH_BUCKET during HeadObject"), "NoSuchBucket"), (OSError("AWS Error ACCESS_DENIED during GetObject"), "AccessDenied"),
    (OSError("AWS Error UNKNOWN (HTTP status 301) during HeadObject"), "PermanentRedirect"), (OSError("AWS Error SLOW_DOWN"), "SlowDown"),
    (FileNotFoundError("x"), "NoSuchKey"), (PermissionError("x"), "AccessDenied"), (OSError(errno.EIO, "x"), "EIO"), (OSError("x"), "OSError"),
])
def test_codes_of_errors(error, code):
    assert objects.error_code(error, lambda: True) == code


def test_no_exchange_holds_contents_and_batches_are_bounded(spark, tmp_path, monkeypatch):
    (tmp_path / "b").mkdir()
    rows = requested(spark, *[plain(f"{i}.txt") for i in range(60)])
    for i in range(60):
        (tmp_path / "b" / f"{i}.txt").write_text(str(i) * 50)
    store = Store(f"{tmp_path}/{{bucket}}/{{key}}")
    plan = outcomes(rows, "T", store=store)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(objects, "FLUSH_BYTES", 300)
    out = objects.fetched(rows.coalesce(1), store, F.col("bucket_name"), F.col("s3_path"))
    assert {r.req_id - 1: r.stored.decode() for r in out.collect()} == {i: str(i) * 50 for i in range(60)}


# ---- one file per document --------------------------------------------------------------------


def test_files_hold_the_results(spark, tmp_path):
    rows = requested(
        spark, ("a.txt", b64("uno"), None, None, "plain"), ("a.txt", b64("dos"), None, None, "plain"), ("../d r/ñ?.json", b64("[1]"), None, None, "structured_json"),
        ("c.pdf", b64("x")))
    done = process(rows, "T")
    sinks.write_texts(done, str(tmp_path / "out"))
    want = {r.req_id: r.result for r in done.collect()}
    found = textfiles.read_documents(spark, str(tmp_path / "out"), "req_id bigint, file_name string").collect()
    assert {r.req_id: r.body for r in found} == want and len(found) == 3
    files = [p for p in (tmp_path / "out").glob("*/files/*/*")]
    assert sorted(p.name.split("-", 1)[1] for p in files) == [".._d_r_ñ_.json.json", "a.txt.txt", "a.txt.txt"]
    sinks.write_texts(done.filter("req_id = 1"), str(tmp_path / "out"))
    assert textfiles.read_documents(spark, str(tmp_path / "out"), "req_id bigint").count() == 4
    sinks.write_texts(done.filter("req_id = 2"), str(tmp_path / "out"), "overwrite")
    assert [r.body for r in textfiles.read_documents(spark, str(tmp_path / "out"), "req_id bigint").collect()] == ["dos"]
    assert len(list((tmp_path / "out").glob("*/files/*/*"))) == 1


def test_a_failed_task_or_job_leaves_nothing(spark, tmp_path):
    from pyspark import TaskContext

    marker = str(tmp_path / "failed")

    def fails_once(batches):
        import os

        for b in batches:
            yield b
        if TaskContext.get().partitionId() == 1 and not os.path.exists(marker):
            open(marker, "w").close()
            raise RuntimeError("a task that is lost")

    def always(batches):
        for b in batches:
            yield b
        raise RuntimeError("every attempt fails")

    rows = spark.range(40).selectExpr("id", "concat(id, '.txt') AS name", "repeat(cast(id AS string), 3) AS body").repartition(4).persist()
    out = tmp_path / "out"
    # a local session has no second attempts: the job fails, and leaves nothing
    for broken in (fails_once, always):
        with pytest.raises(Exception):
            textfiles.write_documents(rows.mapInArrow(broken, rows.schema), str(out))
        assert not [p for p in out.rglob("*") if p.is_file()]
        assert textfiles.committed(str(out)) == {}
    textfiles.write_documents(rows.mapInArrow(fails_once, rows.schema), str(out))
    assert {r.id: r.body for r in textfiles.read_documents(spark, str(out), "id bigint").collect()} == {i: str(i) * 3 for i in range(40)}


def test_files_of_lost_attempts_go_with_the_commit(tmp_path):
    import pyarrow as pa

    writer = textfiles.FilesWriter(str(tmp_path), False)
    batch = pa.RecordBatch.from_pydict({"name": ["a", None], "body": ["x", None], "n": [1, 2]})
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([done, None])
    assert textfiles.committed(str(tmp_path)) == {writer.job: {done.task: 2}}
    assert [p.name for p in (tmp_path / writer.job / "files").iterdir()] == [done.task] != [lost.task]
    assert sorted(p.read_text() for p in (tmp_path / writer.job / "files" / done.task).iterdir()) == ["", "x"]


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "name string, body string, n int")
    textfiles.write_documents(empty, str(tmp_path / "out"))
    assert textfiles.read_documents(spark, str(tmp_path / "out"), "n int").collect() == []


# ---- batches ----------------------------------------------------------------------------------


def test_a_batch_is_visible_at_once_or_not_at_all(spark, tmp_path, monkeypatch):
    out, source = str(tmp_path / "out"), tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text(json.dumps({"req_id": 1, "file_name": "a.txt", "file_content": b64("uno"), "output_format": "plain"}) + "\n"
                                   + json.dumps({"req_id": 2, "file_name": "a.pdf", "file_content": b64("uno")}) + "\n")
    start = lambda: jobs.request_stream(spark, str(source), out, str(tmp_path / "cp"), "T").awaitTermination()

    def killed(*_):
        raise RuntimeError("killed before the manifest")

    with monkeypatch.context() as m:
        m.setattr(jobs, "make_visible", killed)
        with pytest.raises(Exception):
            start()
    assert jobs.visible_batches(spark, out) == [] and (tmp_path / "out" / "batches").exists()
    start()
    assert [r.result for r in jobs.read_batches(spark, out, "results").collect()] == ["uno"]
    assert [(r.req_id, r.reason) for r in jobs.read_batches(spark, out, "rejects").collect()] == [(2, "unsupported_extension")]
    (source / "2.json").write_text(json.dumps({"req_id": 3, "file_name": "b.txt", "file_content": b64("dos"), "output_format": "plain"}) + "\n")
    start()
    start()
    assert jobs.visible_batches(spark, out) == [0, 1]
    assert sorted(r.result for r in jobs.read_batches(spark, out, "results").collect()) == ["dos", "uno"]

"""Files, CSV, requests, registry, the whole request way, sinks and streams."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from doclake.operators import csvdocs, results, routing, tabular
from doclake.plans.process import process, rejects
from doclake.sources import files, requests, sinks
from doclake.sources.registry import DEFAULT
from doclake.streaming import jobs

SCHEMA = (
    "req_id bigint, file_name string, file_content string, s3_path string, bucket_name string, output_format string, "
    "ai_optimized boolean, include_metadata boolean"
)
FLOW = (
    '<?xml version="1.0"?>\r\n<e:Pack xmlns:e="urn:e" xmlns:n="urn:n" name="f">\r\n  <n:node id="1"/>\r\n'
    "  <n:node id=\"2\">uno</n:node>\r\n</e:Pack>\r\n"
)
QUEUE = "DEFINE\tQLOCAL(A) +\r\n\tDEPTH(10)\r\n"


def b64(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


@pytest.fixture
def reqs(spark):
    def make(*rows):
        full = [(i, *r, *[None] * (7 - len(r))) for i, r in enumerate(rows, 1)]
        return spark.createDataFrame(full, SCHEMA)

    return make


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("hola")
    (tmp_path / "sub" / "b.json").write_text("{}")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe")
    got = {r.file_name: (r.ext, r.length) for r in files.scan_files(spark, str(tmp_path)).drop("content").collect()}
    assert got == {"a.TXT": ("txt", 4), "b.json": ("json", 2), "c.bin": ("bin", 2)}
    docs = requests.decode_text(files.scan_files(spark, str(tmp_path), "*.{TXT,bin}"))
    assert {r.file_name: (r.text, r.reason) for r in docs.collect()} == {"a.TXT": ("hola", None), "c.bin": (None, "invalid_utf8")}
    assert files.scan_files(spark, str(tmp_path), max_bytes=3).count() == 2


def test_scan_csv(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('a,b,c\n1,"x, ""y""\nz",2\nshort\n1,2,3,, \n4, ,6\n')
    df = files.scan_csv(spark, str(path), ["a", "b", "c"])
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == ("1", 'x, "y"\nz', "2", None)
    assert rows[1][:3] == ("short", None, None) and rows[1][3] is not None
    assert rows[2][:3] == ("1", "2", "3") and rows[2][3] is not None
    done = tabular.completeness(df).collect()[0]
    # the short row's missing cells count as filled; the long row's two extra cells are blank, and so is one cell
    assert (done.total_cells, done.empty_cells) == (12, 3)


def test_column_types(spark):
    rows = [(i, "", f"{i},000", "2024-01-01", "x", "1" if i < 6 else "z") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "_pos int, none string, n string, d string, t string, late string")
    kinds = lambda k: {r.column_name: r.data_type for r in tabular.column_types(df, k).collect()}
    assert kinds(5) == {"none": "Numeric", "n": "Numeric", "d": "Date", "t": "Text", "late": "Numeric"}
    assert kinds(None)["late"] == "Text"


def test_small_preview_has_no_statistics(spark):
    df = spark.createDataFrame([(1, "a|b", None)], "_pos int, x string, y string")
    report = tabular.preview(df, "f.csv").collect()[0].report
    assert report.endswith("| x | y |\n| --- | --- |\n| a|b |  |")


def test_envelopes(spark):
    body = {"req_id": 7, "file_name": "a.txt"}
    events = [json.dumps({"body": json.dumps(body)}), json.dumps(body), json.dumps({"body": body})]
    got = requests.scan_requests(spark.createDataFrame([(e,) for e in events], "value string")).collect()
    assert [(r.req_id, r.file_name) for r in got] == [(7, "a.txt")] * 3


def test_validation_order(reqs):
    rows = reqs((None,), ("a", None), ("a", "x", "p"), ("a", "x", None, None, "html"), ("a", None, "p"), ("a", "x"))
    got = [r.error for r in routing.validate(rows).orderBy("req_id").collect()]
    assert got == ["missing_file_name", "no_source", "two_sources", "bad_output_format", "missing_bucket", None]


def test_options(reqs):
    got = routing.resolve_options(reqs(("a", "x", None, None, "markdown_ai", False))).collect()[0]
    assert (got.ai_optimized, got.include_metadata, got.extract_key_sections, got.max_chunk_size) == (True, True, True, 4000)
    env = {"OUTPUT_FORMAT": "HTML", "AI_OPTIMIZED": "TRUE"}
    assert routing.options_from_env(env)["output_format"] == "markdown"
    assert routing.resolve_options(reqs(("a",)), routing.options_from_env(env)).collect()[0].ai_optimized is True


def test_refusal_is_case_sensitive(reqs):
    rows = reqs(*[(n, b64("Hola")) for n in ["a.pdf", "a.PDF", "a.bar", "a", "a.docm", ".txt"]])
    got = {r.req_id: r.reason for r in rejects(rows).collect()}
    assert got == {1: "unsupported_extension", 3: "unsupported_extension", 4: "no_extension"}


def test_rejects(reqs):
    rows = reqs(
        ("a.txt", "***"), ("a.txt", "abc"), ("a.txt", base64.b64encode(b"\xff\xfe").decode()), ("a.json", b64("{")),
        ("a.txt", None, "k", "b"), ("a.txt", b64("ok")),
    )
    got = [(r.reason, r.status, r.error_type) for r in results.reject_rows(rejects(rows)).orderBy("req_id").collect()]
    assert got == [(w, 400, "ErrorValidacion") for w in ["empty_content", "bad_base64", "invalid_utf8", "malformed", "missing_file"]]


def test_csv_documents(docs_of, value_of):
    body = 'a,b\n1,"x, ""y""\nz"\n\n2\n3,p"q,,\n"4",""\n,"open'
    p = csvdocs.profile(docs_of(body)).collect()[0]
    assert p.header == ["a", "b"]
    assert p.data == [["1", 'x, "y"\nz'], [], ["2"], ["3", 'p"q', "", ""], ["4", ""], ["", "open"]]
    assert (p.types, p.total_cells, p.empty_cells) == (["Numeric", "Text"], 12, 4)
    many = "n,d\n" + "".join(f"{i},2024-01-01\n" for i in range(12))
    report = value_of(csvdocs.report(docs_of(many, ext="csv")), "report")[0]
    assert "- **Total Rows:** 12 (excluding header)\n" in report and "| 9 | 2024-01-01 |\n\n### 📈" in report
    assert "- **Data types detected:** 1 Numeric, 1 Date\n- **Completeness:** 100.0% complete\n" in report
    assert value_of(csvdocs.report(docs_of("a,b\n1,2", "x"), "plain"), "report") == ["a,b\n1,2", "x"]


def test_base64_padding(spark):
    values = ["aG9sYQ==", "aG9s YQ=\n=", "aG9sYQ", "aG9sYQ=", "aG9sYQ==zz", "aG9s", "aG9s====", "a", "", "aGk="]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(requests.decoded(F.col("v")).cast("string")).collect()]
    assert got == ["hola", "hola", None, None, "hola", "hol", "hol", None, "", "hi"]


def test_every_reader(reqs):
    rows = reqs(
        ("q.mq", b64(QUEUE)), ("f.msgflow", b64(FLOW), None, None, "markdown_ai"), ("f.xml", b64("<a>"), None, None, "markdown_ai"),
        ("d.json", b64('{"a":1}'), None, None, "structured_json"), ("c.yml", b64("a: [1"), None, None, "markdown"),
        ("c.yaml", b64("server:\n  host: h\n"), None, None, "markdown_ai"), ("w.docx", b64("PK")), ("d.json", b64("[1]"), None, None, "plain"),
        ("t.txt", b64("TITULO\ncuerpo."), None, None, "markdown_ai"), ("t.txt", b64("x"), None, None, "plain", True, True),
    )
    got = {r.req_id: r for r in process(rows, "T").collect()}
    assert got[1].result == "```text\nDEFINE\tQLOCAL(A) +\n\tDEPTH(10)\n\n```"
    assert "## 🔧 XML Document Analysis\n- **File:** f.msgflow\n- **Root Element:** {urn:e}Pack" in got[2].result
    assert got[2].result.startswith("---\ndocument_type: xml_document\nsource_file: f.msgflow\n")
    assert (got[3].action, got[3].result) == ("raw_text", "<a>")
    record = json.loads(got[4].result)
    assert record["full_content"] == '```json\n{"a":1}\n```' and record["metadata"]["document_type"] == "json_data"
    assert got[5].result.startswith("```yaml\n\n<!-- YAML Parse Error: ") and got[5].result.endswith("-->\na: [1\n```")
    assert "- Possible Database Config\n" in got[6].result
    assert got[7].action == "error_document" and "## ❌ Processing Error" in got[7].result
    assert got[8].result == "[1]"
    assert "- **Structure Type:** Structured" in got[9].result and "## TITULO\ncuerpo." in got[9].result
    assert got[10].result.startswith("---\ndocument_type: text_document\n") and got[10].result.endswith("---\n\nx")


def test_stored_objects_and_custom_reader(spark, reqs):
    rows = reqs(("a.txt", None, "in/a.txt", "b", "plain"), ("a.txt", None, "in/none.txt", "b"), ("z.rev", b64("abc"), None, None, "plain"))
    stored = spark.createDataFrame([("s3://b/in/a.txt", bytearray(b"hola"))], "path string, content binary")
    reverse = lambda f: f.select("doc_id", F.reverse(F.col("content").cast("string")).alias("text"))
    registry = DEFAULT.register("REV", "reversed", reverse)
    got = {r.req_id: (r.doc_type, r.result) for r in process(rows, "T", registry, stored).collect()}
    assert got == {1: ("text_document", "hola"), 3: ("reversed", "cba")}
    assert "rev" in registry.extensions() and "rev" not in DEFAULT.extensions()
    assert [r.reason for r in rejects(rows, registry, stored).collect()] == ["missing_file"]


def test_sinks(spark, reqs, tmp_path):
    rows = reqs(("a.txt", b64("x")), ("b.json", b64("[]")), ("c.pdf", b64("x")))
    sinks.write_results(process(rows, "T"), str(tmp_path / "ok"))
    sinks.write_rejects(rejects(rows), str(tmp_path / "bad"))
    assert {p.name for p in (tmp_path / "ok").glob("doc_type=*")} == {"doc_type=text_document", "doc_type=json_data"}
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["unsupported_extension"]


def test_capabilities(spark):
    rows = results.capabilities(spark).collect()
    assert [r.ext for r in rows] == sorted(r.ext for r in rows) and rows[0].n_supported == len(rows) == 14


def test_object_messages(spark):
    uris = spark.createDataFrame([("s3://b/k/x.txt", "NoSuchKey"), ("s3://b/k", "Odd")], "uri string, code string")
    out = routing.parse_uri(uris).select(routing.object_error_message(F.col("code"), F.col("bucket"), F.col("object_key")).alias("m"))
    assert [r.m for r in out.collect()] == ["File 'k/x.txt' not found in bucket 'b'", "S3 error (Odd) accessing s3://b/k"]


def test_request_stream_equals_batch(spark, reqs, tmp_path):
    rows = reqs(("a.txt", b64("Uno dos")), ("b.json", b64('{"a":1}'), None, None, "markdown_ai"), ("c.pdf", b64("x")), (None,))
    (tmp_path / "in").mkdir()
    rows.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    start = lambda: jobs.request_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "T").awaitTermination()
    start()
    start()  # nothing new: nothing is written twice
    got = jobs.read_batches(spark, str(tmp_path / "out"), "results").select("req_id", "result")
    want = process(rows, "T").select("req_id", "result")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    bad = jobs.read_batches(spark, str(tmp_path / "out"), "rejects")
    assert sorted((r.req_id, r.reason) for r in bad.collect()) == [(3, "unsupported_extension"), (4, "missing_file_name")]


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"uno\r\ndos")
    run = lambda: jobs.file_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff")
    run()
    got = {r.file_name: (r.text, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.txt": ("uno\ndos", None), "b.txt": (None, "invalid_utf8")}


def test_requests_need_no_id_and_may_share_one(spark, reqs):
    rows = reqs(("d.json", b64('{"a":1}'), None, None, "markdown_ai"), ("c.yml", b64("a: 1\n"), None, None, "markdown_ai"), ("f.msgflow", b64(FLOW), None, None, "markdown_ai"))
    want = sorted(r.result for r in process(rows, "T").collect())
    for ids in (F.lit(None).cast("bigint"), F.lit(7), F.concat(F.lit("x"), "req_id")):
        got = process(rows.withColumn("req_id", ids), "T")
        assert sorted(r.result for r in got.collect()) == want and dict(got.dtypes)["req_id"] == dict(rows.select(ids.alias("i")).dtypes)["i"]
        assert {r.action for r in got.collect()} == {"parsed"}
    assert sorted(r.result for r in process(rows.drop("req_id"), "T").collect()) == want
    plan = process(rows, "T")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1


def test_every_unreadable_document_has_a_reason(reqs):
    bomb = "a0: &a0 [x]\n" + "".join(f"a{i}: &a{i} [{', '.join([f'*a{i - 1}'] * 9)}]\n" for i in range(1, 12))
    rows = reqs(
        ("a.yml", b64("fecha: 2024-02-30\n")), ("a.yml", b64("1: uno\n")), ("a.yml", b64("a: &a [*a]\n")), ("a.yml", b64(bomb)),
        ("a.json", b64('{"a":1,"a":2,"b":NaN,"c":' + "9" * 5000 + "}"), None, None, "markdown_ai"), ("a.json", b64('"\\ud800"'), None, None, "markdown_ai"),
        ("a.json", b64("[" * 100_000)), ("a.json", b64("{")),
    )
    ok = {r.req_id: r.result for r in process(rows, "T").collect()}
    bad = {r.req_id: r.reason for r in rejects(rows).collect()}
    assert bad == dict.fromkeys([1, 2, 3, 4, 7, 8], "malformed") and set(ok) == {5, 6}
    assert "9" * 5000 in ok[5] and "- **a:** 2" in ok[5]


def test_stored_objects_by_any_connector_and_declared_encodings(spark, reqs):
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><r>año</r>'
    rows = reqs(("a.txt", None, "in/a.txt", "b", "plain"), ("b.xml", None, "in/b.xml", "b", "markdown_ai"), ("c.xml", None, "in/c.xml", "b", "plain"))
    stored = spark.createDataFrame([
        ("s3a://b/in/a.txt", bytearray(b"hola")), ("s3n://b/in/b.xml", bytearray(latin.encode("latin-1"))),
        ("s3://b/in/c.xml", bytearray("<r>ñ</r>".encode("utf-16")))], "path string, content binary")
    got = {r.req_id: (r.action, r.result) for r in process(rows, "T", files=stored).collect()}
    assert got[1] == ("parsed", "hola") and got[3] == ("parsed", "<r>ñ</r>")
    assert got[2][0] == "parsed" and "- **Text Content:** 3 characters" in got[2][1] and "año" in got[2][1]


def test_request_stream_reads_stored_objects(spark, reqs, tmp_path):
    stored = spark.createDataFrame([("s3a://b/k.txt", bytearray(b"hola"))], "path string, content binary")
    (tmp_path / "in").mkdir()
    reqs(("k.txt", None, "k.txt", "b", "plain")).select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(str(tmp_path / "in"))
    jobs.request_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "T", files=stored).awaitTermination()
    assert [r.result for r in jobs.read_batches(spark, str(tmp_path / "out"), "results").collect()] == ["hola"]
    assert not (tmp_path / "out" / "staged").exists()


def test_shared_folder_is_needed_on_a_cluster_only(spark, monkeypatch):
    from doclake.plans import shared

    assert shared.new_folder(spark)

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.new_folder(Elsewhere)
    Elsewhere.conf = type("C", (), {"get": staticmethod(lambda k, d=None: "s3a://b/cp/")})
    assert shared.new_folder(Elsewhere).startswith("s3a://b/cp/doclake-")


def test_custom_text_is_rendered_as_it_is(reqs):
    registry = DEFAULT.register("rev", "reversed", lambda f: f.select("doc_id", F.lit("TITULO\n- a\n- b").alias("text")))
    got = process(reqs(("z.rev", b64("abc"))), "T", registry).collect()
    assert [r.result for r in got] == ["TITULO\n- a\n- b"]


def test_every_result_is_registered_and_written_as_it_is_rendered(spark):
    from conftest import SF_DIR

    from doclake.plans.queries import all_queries

    queries = all_queries()
    got = queries["e1_result_all"](spark, SF_DIR).collect()
    assert all(r.output_chars == len(r.result) for r in got)
    assert {r.action for r in got} == {r.action for r in queries["e4_reader_fallback"](spark, SF_DIR).collect()}
    shown = {(r.reader, r.output_format) for r in got}
    formats = {"markdown", "markdown_ai", "plain", "structured_json"}
    assert all((reader, f) in shown for reader in ("text", "json", "xml", "yaml", "csv") for f in formats), repr(sorted(shown))[:2000]
    for r in got:
        if r.output_format == "structured_json" and r.action == "parsed":
            assert {"metadata", "sections", "full_content"} <= set(json.loads(r.result))
    want = {r.req_id: r.result for r in got}
    sizes = {r.req_id: r.output_chars for r in queries["e1_result_sizes"](spark, SF_DIR).collect()}
    assert sizes and all(len(want[i]) == n for i, n in sizes.items())
    for name in ("s9_written_results", "st1_stream_results"):
        rows = queries[name](spark, SF_DIR).collect()
        assert len(rows) == len(sizes) and all(want[r.req_id] == r.result for r in rows), name


def test_clean_base64_is_looked_at_once(spark):
    from doclake.sources import requests as rq

    rows = [("aGk=",), ("aG\r\nk=",), ("a-G.k=é",), ("aGk",), ("",), ("***",), ("aGk=aGk=",), ("aGkx",), (None,), ("aGkx\n",)]
    df = spark.createDataFrame(rows, "c string").select(rq.decoded(F.col("c")).alias("b"))
    assert [None if r.b is None else bytes(r.b) for r in df.collect()] == [b"hi", b"hi", b"hi", None, b"", b"", b"hi", b"hi1", None, b"hi1"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "A-Z" not in plan and "CASE WHEN RLIKE" in plan

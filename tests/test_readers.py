"""Readers of one's own that make cells, markdown or trees, through the whole way of a request."""

from __future__ import annotations

import base64

import pytest
from pyspark.sql import functions as F

from doclake.operators import grid, markdown
from doclake.plans.process import outcomes, process
from doclake.sources.registry import DEFAULT

SCHEMA = (
    "req_id bigint, file_name string, file_content string, s3_path string, bucket_name string, output_format string, "
    "ai_optimized boolean, include_metadata boolean"
)
SHEETS = "A;1;1;Nombre;text\nA;1;2;Total;text\nA;2;1;uno|dos;text\nA;2;2;5;number\nA;3;1;=B2*2;text\nB;2;3;x;text\nC;1;1;;empty"


def requests(spark, *rows):
    full = [(i, n, base64.b64encode(t.encode()).decode(), None, None, f, None, None) for i, (n, t, f) in enumerate(rows, 1)]
    return spark.createDataFrame(full, SCHEMA)


def cells_of(files):
    """Lines ``sheet;row;column;value;kind``."""
    line = F.explode(F.split(F.col("content").cast("string"), "\n"))
    parts = F.split("line", ";")
    return files.select("doc_id", line.alias("line")).filter("line LIKE '%;%'").select(
        "doc_id", parts[0].alias("sheet"), parts[1].cast("bigint").alias("row_idx"), parts[2].cast("bigint").alias("col_idx"), parts[3].alias("value"),
        parts[4].alias("kind"))


def test_cells_get_the_reports_of_workbooks(spark):
    registry = DEFAULT.register("xlsx", "excel_workbook", cells_of, output="cells")
    rows = requests(spark, ("a b.xlsx", SHEETS, "markdown_ai"), ("a.xlsx", SHEETS, "markdown"), ("a.xlsx", SHEETS, "plain"), ("n.xlsx", "nothing", "plain"),
                    ("t.txt", "hola", "plain"))
    got = {r.req_id: r for r in process(rows, "T", registry).collect()}
    book = cells_of(spark.createDataFrame([(1, bytearray(SHEETS.encode()))], "doc_id bigint, content binary")).withColumn("book", F.lit("a b.xlsx"))
    want = grid.workbook_report(book).collect()[0].report
    assert want in got[1].result and "- **Archivo:** a b.xlsx\n- **Hojas:** 2\n" in want and "| uno\\|dos | 5 |" in want and "- A3: `=B2\\*2`" in want
    table = "| Nombre | Total |\n| --- | --- |\n| uno\\|dos | 5 |\n| =B2*2 | - |"
    assert got[2].result == f"## A\n{table}\n\n## B\n\n"
    assert got[3].result == "=== A ===\nNombre\tTotal\nuno|dos\t5\n=B2*2\t\n\n=== B ===\n\t\tx\n\n=== C ===\n"
    assert got[4].action == "error_document" and "Error procesando archivo Excel" in got[4].result
    assert got[5].result == "hola" and {got[i].reader for i in (1, 2, 3, 4)} == {"custom:xlsx"} and {got[i].action for i in (1, 2, 3, 5)} == {"parsed"}
    assert {r.req_id: r.result for r in outcomes(rows, "T", registry).collect()} == {i: r.result for i, r in got.items()}


def test_markdown_of_word_documents_is_normalised(spark):
    raw = "TITULO UNO\n\ntexto __a__ __b__\n\n\n\n• uno\n• dos\n"
    registry = DEFAULT.register("docx", "docx_document", lambda f: f.select("doc_id", F.col("content").cast("string").alias("text")), output="markdown")
    rows = requests(spark, ("w.docx", raw, "plain"), ("w.docx", raw, "markdown_ai"))
    got = {r.req_id: r for r in process(rows, "T", registry).collect()}
    clean = markdown.normalise(spark.createDataFrame([(1, raw)], "doc_id bigint, text string")).collect()[0].text
    assert got[1].result == clean != raw and got[1].doc_type == "docx_document"
    assert clean in got[2].result and "## 📝 Word Document Analysis\n- **File:** w.docx\n- **Content:** ~" in got[2].result


@pytest.mark.parametrize("output,text,shown", [
    ("json", '{"server":{"host":"h"},"n":[1,2]}', "server"), ("yaml", "server:\n  host: h\n  port: 1\n", "- Possible Database Config\n"), ("xml", "<r><a x='1'/></r>", "**Root Element:** r")])
def test_trees_get_the_reports_of_their_kind(spark, output, text, shown):
    registry = DEFAULT.register("own", "own_type", lambda f: f.select("doc_id", F.lit(text).alias("text")), output=output)
    rows = requests(spark, ("f.own", "?", "markdown_ai"), (f"f.{output}", text, "markdown_ai"))
    got = {r.req_id: r for r in process(rows, "T", registry).collect()}
    assert shown in got[1].result and got[1].reader == "custom:own" and got[1].action == "parsed"
    body = lambda r: r.result.split("\n", 12)[-1]
    assert body(got[1]).replace("f.own", f"f.{output}")[-60:] == body(got[2])[-60:]


def test_unknown_output_is_refused():
    with pytest.raises(ValueError, match="output must be one of"):
        DEFAULT.register("x", "y", lambda f: f, output="pages")


def test_a_report_needs_two_scans_and_three_shuffles(spark, tmp_path):
    """Of a written table, as its scans are counted; the final plan of an adaptive query has no repeated subtree."""
    cells_of(spark.createDataFrame([(1, bytearray(SHEETS.encode()))], "doc_id bigint, content binary")).withColumn("book", F.lit("b")).write.parquet(str(tmp_path / "c"))
    cells = spark.read.parquet(str(tmp_path / "c"))
    for report, exchanges in ((grid.workbook_report, 3), (grid.preview, 2)):
        plan = report(cells)._jdf.queryExecution().sparkPlan().toString()
        whole = report(cells)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and whole.count("Exchange hashpartitioning") <= exchanges, whole

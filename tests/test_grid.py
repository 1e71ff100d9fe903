"""Spreadsheet grids."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doclake.functions import cells as cl
from doclake.operators import grid


@pytest.fixture
def sheet(spark):
    def make(*rows):
        return spark.createDataFrame([("b", "s", *r) for r in rows], "book string, sheet string, row_idx bigint, col_idx bigint, value string, kind string")

    return make


def test_row_limit_applies_before_empty_rows_are_dropped(sheet):
    cells = sheet((2, 1, "a", "text"), (3, 1, "", "empty"), (999, 1, "b", "text"), (1001, 1, "c", "text"))
    numbered = lambda **k: [(r.row_idx, r.row_no) for r in grid.rows(cells, **k).orderBy("row_no").collect()]
    assert numbered(row_limit=1000) == [(2, 1), (999, 2)] and numbered() == [(2, 1), (999, 2), (1001, 3)]
    done = grid.sheet_summary(cells).collect()[0]
    assert (done.dimensions, done.processed_rows) == ("1001 x 1", 2) and done.note.endswith("de 1001 total")


def test_blank_text_keeps_a_row_except_in_the_legacy_format(sheet):
    cells = sheet((1, 1, " ", "text"), (2, 1, "x", "text"))
    assert grid.rows(cells).count() == 2 and grid.rows(cells, blank_is_empty=True).count() == 1


def test_census(sheet):
    cells = sheet(
        (1, 1, "To be done", "text"), (1, 2, "abc", "text"), (1, 3, "1", "number"), (2, 1, "true", "boolean"),
        (2, 2, "45000", "datetime"), (2, 3, "", "text"), (3, 2, "x-y", "text"))
    got = grid.census(cells).collect()[0]
    assert (got.text, got.number, got.date, got.boolean, got.empty) == (2, 1, 2, 1, 3)


def test_headers_ignore_falsy_cells(sheet):
    cells = sheet((1, 1, "Name", "text"), (1, 2, "0", "number"), (1, 3, "false", "boolean"), (1, 4, "ab", "text"), (1, 5, "123", "text"), (2, 6, "x", "text"))
    check = grid.header_check(cells).collect()[0]
    assert (check.meaningful, check.text_cells, check.is_header) == (3, 2, True)
    assert [r.header for r in grid.smart_headers(cells).orderBy("col_idx").collect()] == ["Name", "Col2", "Col3", "Col4", "Col5", "Col6"]


def test_escapes(spark):
    df = spark.createDataFrame([(' a|b\n\n"c"  ',), ("x" * 21,), ("y" * 15,), ("\\*[z]~`#_",)], "v string")
    v = F.col("v")
    got = [tuple(r) for r in df.select(cl.escape_cell(v, 12), cl.escape_markdown(v)).collect()]
    assert got[0][0] == 'a\\|b \\"c\\"' and got[1][0] == "x" * 9 + "..." and got[2][0] == "y" * 12
    assert got[3][1] == "\\\\\\*\\[z\\]\\~\\`\\#\\_"


def test_display_values(sheet):
    cells = sheet((1, 1, "5.0", "number"), (1, 2, "2.50", "number"), (1, 3, "1", "boolean"), (1, 4, "45000.5", "datetime"), (1, 5, "1", "datetime"), (1, 6, "t", "text"))
    shown = cells.orderBy("col_idx").select(cl.normalise(F.col("value"), F.col("kind"))).collect()
    assert [r[0] for r in shown] == ["5", "2.50", "True", "2023-03-15 12:00:00", "1900-01-01 00:00:00", "t"]


def test_header_without_rows_renders_nothing(sheet):
    cells = sheet((1, 1, "Name", "text"))
    assert grid.preview(cells).filter("mode <> 'plain'").count() == 0
    assert "*No hay datos para mostrar*" in grid.workbook_report(cells).collect()[0].report


def test_report(sheet):
    cells = sheet((1, 1, "Name", "text"), (1, 2, "Age", "text"), (2, 1, "Ana|B", "text"), (3, 2, "=A1", "text"))
    report = grid.workbook_report(cells).collect()[0].report
    assert "- **s**: 3 x 2 (3 filas procesadas) (Tipos: text)\n" in report
    assert "**Fórmulas encontradas:** 1\n- B3: `=A1`\n\n| Name | Age |\n| --- | --- |\n| Ana\\|B | - |\n| - | =A1 |\n" in report


def test_addresses(spark):
    df = spark.range(1).select(*[cl.address(F.lit(7), F.lit(c)).alias(f"c{c}") for c in (1, 26, 27, 50, 702, 703, 16384)])
    assert list(df.collect()[0]) == ["A7", "Z7", "AA7", "AX7", "ZZ7", "AAA7", "XFD7"]

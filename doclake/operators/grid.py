"""Spreadsheet contents as a cells table (``g*``): cells(book, sheet, row_idx, col_idx, value, kind), 1-based.

Previews filter to the rows they show before anything else, and statistics reduce a sheet to one row with a combining aggregate.
``rows``, ``smart_headers`` and ``table_rows`` cover every row and column unless they are given a limit. Ranks of previews are top-k
filters, which Spark applies before the shuffle as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake import fixed
from doclake.functions import cells as cl
from doclake.functions import text as tx
from doclake.functions.frames import let
from doclake.functions.frames import computed

SHEET = ["book", "sheet"]


def filled(cells: DataFrame, blank_is_empty: bool = False) -> DataFrame:
    """Cells that keep a row alive; for the legacy format blank text does not."""
    out = cells.filter(F.col("kind") != "empty")
    return out.filter(tx.strip(F.col("value")) != "") if blank_is_empty else out


def _within(cells: DataFrame, row_limit: int | None) -> DataFrame:
    return cells if row_limit is None else cells.filter(F.col("row_idx") <= row_limit)


def head_cells(
    cells: DataFrame, rows: int | None, columns: int | None = None, blank_is_empty: bool = False, row_limit: int | None = fixed.SHEET_ROW_LIMIT,
) -> DataFrame:
    """Cells of the first ``rows`` kept rows of each sheet (``None``: all), with their row number among the kept rows.

    The physical row limit applies first, then empty rows are dropped.
    """
    w = Window.partitionBy(*SHEET).orderBy("row_idx")
    kept = _within(filled(cells, blank_is_empty), row_limit)
    ranked = kept.withColumn("row_no", F.dense_rank().over(w).cast("bigint"))
    ranked = ranked if rows is None else ranked.filter(F.col("row_no") <= rows)
    return ranked if columns is None else ranked.filter(F.col("col_idx") <= columns)


def rows(cells: DataFrame, blank_is_empty: bool = False, row_limit: int | None = None) -> DataFrame:
    """g1: kept rows of each sheet, numbered; a sheet format holds about a million rows at most."""
    distinct_rows = _within(filled(cells, blank_is_empty), row_limit).select(*SHEET, "row_idx").distinct()
    w = Window.partitionBy(*SHEET).orderBy("row_idx")
    return distinct_rows.withColumn("row_no", F.row_number().over(w).cast("bigint"))


def dimensions(cells: DataFrame) -> DataFrame:
    """Extent of each sheet and its kept rows; the set of kept rows is bounded by the row limit."""
    kept = F.when((F.col("kind") != "empty") & (F.col("row_idx") <= fixed.SHEET_ROW_LIMIT), F.col("row_idx"))
    return cells.groupBy(*SHEET).agg(
        F.max("row_idx").alias("max_row"), F.max("col_idx").alias("max_col"),
        F.size(F.collect_set(kept)).cast("bigint").alias("processed_rows"),
    )


def census(cells: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """g2: cells per kind over the first 20 kept rows × 10 columns, stopping at 100 cells."""
    dims = dims if dims is not None else dimensions(cells)
    width = F.least("max_col", F.lit(fixed.CENSUS_COLUMNS))
    analysed = F.least(F.least("processed_rows", F.lit(fixed.CENSUS_ROWS)) * width, F.lit(fixed.CENSUS_CELLS))
    kinds = [k for k in fixed.CELL_KINDS if k != "empty"]
    head = head_cells(cells, fixed.CENSUS_ROWS, fixed.CENSUS_COLUMNS)
    counted = (
        head.select(*SHEET, "row_no", "col_idx", cl.census_kind(F.col("value"), F.col("kind")).alias("k"))
        .join(dims.select(*SHEET, width.cast("bigint").alias("width"), analysed.cast("bigint").alias("analysed")), SHEET)
        .filter((F.col("row_no") - 1) * F.col("width") + F.col("col_idx") <= fixed.CENSUS_CELLS)
        .groupBy(*SHEET)
        .agg(F.max("analysed").alias("analysed"), *[F.count_if(F.col("k") == k).alias(k) for k in kinds])
    )
    return counted.select(
        *SHEET, *kinds, (F.col("analysed") - sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))).alias("empty")
    )


def header_check(cells: DataFrame) -> DataFrame:
    """g3: whether the first kept row of each sheet looks like a header."""
    s = tx.strip(F.col("value"))
    truthy = cl.is_truthy(F.col("value"), F.col("kind"))
    text = truthy & (F.col("kind") == "text") & (F.char_length(s) > 1) & ~cl.is_digits(s) & (s != "-")
    return (
        head_cells(cells, 1).groupBy(*SHEET)
        .agg(F.count_if(truthy).alias("meaningful"), F.count_if(text).alias("text_cells"))
        .withColumn(
            "is_header",
            (F.col("meaningful") > 0) & (F.col("text_cells") >= F.col("meaningful") * fixed.HEADER_RATIO),
        )
    )


def smart_headers(cells: DataFrame, dims: DataFrame | None = None, columns: int | None = None) -> DataFrame:
    """g4: one header per column (the first ``columns``, ``None``: all): the first row's text if telling, else ``ColN``."""
    dims = dims if dims is not None else dimensions(cells)
    last = F.col("max_col") if columns is None else F.least("max_col", F.lit(columns))
    wanted = dims.select(*SHEET, F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("col_idx"))
    first = head_cells(cells, 1, columns).select(*SHEET, "col_idx", "value", "kind")
    s = tx.strip(cl.normalise(F.col("value"), F.col("kind")))
    telling = cl.is_truthy(F.col("value"), F.col("kind")) & (F.char_length(s) > 2) & ~cl.is_digits(s)
    header = F.when(telling, s).otherwise(F.concat(F.lit("Col"), F.col("col_idx").cast("string")))
    return wanted.join(first, [*SHEET, "col_idx"], "left").select(*SHEET, "col_idx", header.alias("header"))


def header_rows(cells: DataFrame, dims: DataFrame | None = None, columns: int | None = fixed.HEADER_COLUMNS) -> DataFrame:
    """Header and separator line of each sheet's table, and how many columns it has."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda h: h["header"])
    shown = F.transform("headers", lambda h: cl.escape_cell(h, fixed.HEADER_CELL_LENGTH))
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    return (
        smart_headers(cells, dims, columns).groupBy(*SHEET).agg(ordered.alias("headers"))
        .select(*SHEET, F.size("headers").alias("n_headers"), line(shown).alias("header_line"),
                line(F.transform("headers", lambda h: F.lit("---"))).alias("separator_line"))
    )


def table_rows(
    cells: DataFrame, limit: int | None = None, dims: DataFrame | None = None, columns: int | None = None, row_limit: int | None = None,
) -> DataFrame:
    """g7: kept rows as table lines, padded or cut to the header width; missing cells are ``-``. ``None``: all rows, all columns."""
    head = head_cells(cells, limit, columns, row_limit=row_limit)
    cell = let(cl.normalise(F.col("value"), F.col("kind")), lambda t: F.when(t == "", "-").otherwise(cl.escape_cell(t, fixed.BODY_CELL_LENGTH)))
    by_row = head.select(*SHEET, "row_no", "col_idx", cell.alias("cell")).groupBy(*SHEET, "row_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", "cell"))).alias("row")
    )
    shown = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.col("n_headers").cast("bigint")),
        lambda i: F.coalesce(F.try_element_at("row", i), F.lit("-")),
    )
    return (
        by_row.join(header_rows(cells, dims, columns), SHEET)
        .select(*SHEET, "row_no", F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |")).alias("line"))
    )


#: Cells of a row in a map key: ``row * COLUMN_KEYS + column``; no sheet format has so many columns.
COLUMN_KEYS = 1 << 20


def sheet_facts(cells: DataFrame, head_rows: int, columns: int | None) -> DataFrame:
    """One row per sheet with all that its reports show, from two scans and two shuffles:

    extent, ``processed_rows``, ``head`` (cells of the first kept rows, and all cells of the first one; ``columns`` cuts the others) and
    ``formulas``. The kept rows of a sheet are at most SHEET_ROW_LIMIT numbers, and only cells within that limit are shuffled.
    """
    alive = (F.col("kind") != "empty") & (F.col("row_idx") <= fixed.SHEET_ROW_LIMIT)
    formula = (
        (F.col("kind") == "text") & F.startswith("value", F.lit("="))
        & (F.col("row_idx") <= fixed.FORMULA_ROWS) & (F.col("col_idx") <= fixed.FORMULA_COLUMNS)
    )
    extent = cells.groupBy(*SHEET).agg(
        F.max("row_idx").alias("max_row"), F.max("col_idx").alias("max_col"),
        F.array_sort(F.collect_set(F.when(alive, F.col("row_idx")))).alias("kept"))
    extent = extent.select(*SHEET, "max_row", "max_col", F.size("kept").cast("bigint").alias("processed_rows"), F.slice("kept", 1, head_rows).alias("kept"))
    shown = cells.filter(alive).select(*SHEET, "row_idx", "col_idx", "value", "kind", formula.alias("formula"))
    row_no = F.array_position("kept", F.col("row_idx")).cast("bigint")
    met = extent.join(shown, SHEET, "left").withColumn("row_no", row_no)
    in_head = F.col("row_no") > 0
    if columns is not None:
        in_head &= (F.col("row_no") == 1) | (F.col("col_idx") <= columns)
    value, kind, s = F.col("value"), F.col("kind"), tx.strip(F.col("value"))
    text, truthy = cl.normalise(value, kind), cl.is_truthy(value, kind)
    shown_text = tx.strip(text)
    telling = truthy & (F.char_length(shown_text) > 2) & ~cl.is_digits(shown_text)
    cell = F.struct(
        "row_no", "col_idx", text.alias("text"), F.when(text == "", "-").otherwise(cl.escape_cell(text, fixed.BODY_CELL_LENGTH)).alias("cell"),
        truthy.alias("truthy"), (truthy & (kind == "text") & (F.char_length(s) > 1) & ~cl.is_digits(s) & (s != "-")).alias("titled"),
        F.when(telling, cl.escape_cell(shown_text, fixed.HEADER_CELL_LENGTH)).alias("header"), cl.census_kind(value, kind).alias("census"))
    esc = cl.escape_markdown
    found = F.struct("row_idx", "col_idx", F.concat(
        F.lit("- "), esc(cl.address(F.col("row_idx"), F.col("col_idx"))), F.lit(": `"), esc(value), F.lit("`\n")).alias("text"))
    return met.groupBy(*SHEET, "max_row", "max_col", "processed_rows").agg(
        F.array_sort(F.collect_list(F.when(in_head, cell))).alias("head"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("formula"), found))), 1, fixed.FORMULA_HITS).alias("formulas"))


def _table(facts: DataFrame) -> DataFrame:
    """facts + the parts of a sheet's table: ``is_header``, ``header_line``, ``separator_line``, and ``lines`` (row_no, line) of its first 15 rows."""
    first = F.filter("head", lambda x: x["row_no"] == 1)
    meaningful, titled = F.size(F.filter(first, lambda x: x["truthy"])), F.size(F.filter(first, lambda x: x["titled"]))
    narrow = F.filter("head", lambda x: (x["row_no"] <= 15) & (x["col_idx"] <= fixed.HEADER_COLUMNS))
    key = lambda row, col: row * F.lit(COLUMN_KEYS).cast("bigint") + col
    by_key = lambda xs, field: F.map_from_entries(F.transform(xs, lambda x: F.struct(key(x["row_no"], x["col_idx"]), x[field])))
    titles = F.filter(first, lambda x: (x["col_idx"] <= fixed.HEADER_COLUMNS) & x["header"].isNotNull())
    prepared = computed(facts, {
        "is_header": (meaningful > 0) & (titled >= meaningful * fixed.HEADER_RATIO),
        "cols": F.sequence(F.lit(1).cast("bigint"), F.least("max_col", F.lit(fixed.HEADER_COLUMNS).cast("bigint"))),
        "titles": by_key(titles, "header"), "body": by_key(narrow, "cell"),
        "numbers": F.array_distinct(F.transform(narrow, lambda x: x["row_no"])),
    })
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    title = lambda c: F.coalesce(F.try_element_at("titles", key(F.lit(1), c)), F.concat(F.lit("Col"), c.cast("string")))
    return prepared.select(
        *facts.columns, "is_header", line(F.transform("cols", title)).alias("header_line"),
        line(F.transform("cols", lambda c: F.lit("---"))).alias("separator_line"),
        F.transform("numbers", lambda n: F.struct(n.alias("row_no"), line(
            F.transform("cols", lambda c: F.coalesce(F.try_element_at("body", key(n, c)), F.lit("-")))).alias("line"))).alias("lines"))


def _previews(cells: DataFrame) -> DataFrame:
    """Facts and table of each sheet, and ``plain_lines`` (row_no, line), its first 50 rows joined by tabs."""
    key = lambda row, col: row * F.lit(COLUMN_KEYS).cast("bigint") + col
    facts = computed(sheet_facts(cells, fixed.PLAIN_ROWS, None), {
        "texts": F.map_from_entries(F.transform("head", lambda x: F.struct(key(x["row_no"], x["col_idx"]), x["text"]))),
        "numbered": F.array_distinct(F.transform("head", lambda x: x["row_no"])),
    })
    whole = F.sequence(F.lit(1).cast("bigint"), F.col("max_col"))
    plain = F.transform("numbered", lambda n: F.struct(n.alias("row_no"), F.array_join(
        F.transform(whole, lambda c: F.coalesce(F.try_element_at("texts", key(n, c)), F.lit(""))), "\t").alias("line")))
    return _table(facts.withColumn("plain_lines", plain).drop("texts", "numbered"))


def _of_mode(mode: str) -> Column:
    """Lines of a preview mode: ``ai`` has 14 rows after a header row, else the first 15; ``standard`` rows 2 to 8."""
    if mode == "plain":
        return F.col("plain_lines")
    if mode == "standard":
        return F.filter("lines", lambda x: (x["row_no"] >= 2) & (x["row_no"] <= 8))
    return F.filter("lines", lambda x: ~F.col("is_header") | (x["row_no"] > 1))


def preview(cells: DataFrame) -> DataFrame:
    """g8: preview lines of each sheet in the three modes.

    ``ai``: 14 rows after a header row, else the first 15; ``standard``: rows 2 to 8; ``plain``: 50 tab-joined rows.
    """
    named = lambda mode: F.transform(
        _of_mode(mode), lambda x: F.struct(F.lit(mode).alias("mode"), x["row_no"].alias("row_no"), x["line"].alias("line")))
    return _previews(cells).select(*SHEET, F.inline(F.concat(*[named(m) for m in ("ai", "standard", "plain")])))


def sheet_summary(cells: DataFrame) -> DataFrame:
    """g9: extent, processed rows, kinds met and the note about cut rows."""
    dims = dimensions(cells)
    kinds = [k for k in fixed.CELL_KINDS if k != "empty"]
    met = F.array_compact(F.array(*[F.when(F.col(k) > 0, k) for k in kinds]))
    cut = F.col("max_row") > fixed.SHEET_ROW_LIMIT
    return dims.join(census(cells, dims), SHEET).select(
        *SHEET,
        F.concat(F.col("max_row").cast("string"), F.lit(" x "), F.col("max_col").cast("string")).alias("dimensions"),
        "processed_rows", F.array_join(met, ", ").alias("main_types"),
        F.when(cut, F.concat(
            F.lit(f"Mostrando primeras {fixed.SHEET_ROW_LIMIT} filas de "), F.col("max_row").cast("string"), F.lit(" total")
        )).alias("note"),
    )


def formulas(cells: DataFrame) -> DataFrame:
    """g10: the first ten formula cells of each sheet, within 100 rows × 50 columns."""
    w = Window.partitionBy(*SHEET).orderBy("row_idx", "col_idx")
    found = cells.filter(
        (F.col("kind") == "text") & F.startswith("value", F.lit("="))
        & (F.col("row_idx") <= fixed.FORMULA_ROWS) & (F.col("col_idx") <= fixed.FORMULA_COLUMNS)
    )
    return (
        found.withColumn("formula_no", F.row_number().over(w).cast("bigint"))
        .filter(F.col("formula_no") <= fixed.FORMULA_HITS)
        .select(*SHEET, "formula_no", cl.address(F.col("row_idx"), F.col("col_idx")).alias("cell"), F.col("value").alias("formula"))
    )


def _sections(tables: DataFrame) -> DataFrame:
    """(book, sheet, entry, section) of the sheets of ``_table`` that a report shows."""
    esc = cl.escape_markdown
    width = F.least("max_col", F.lit(fixed.CENSUS_COLUMNS))
    counted = F.filter("head", lambda x: (x["row_no"] <= fixed.CENSUS_ROWS) & (x["col_idx"] <= fixed.CENSUS_COLUMNS) & (
        (x["row_no"] - 1) * width + x["col_idx"] <= fixed.CENSUS_CELLS))
    kinds = [k for k in fixed.CELL_KINDS if k != "empty"]
    rows = computed(tables, {"counted": F.transform(counted, lambda x: x["census"])})
    cut = F.col("max_row") > fixed.SHEET_ROW_LIMIT
    note = F.when(cut, F.concat(
        F.lit(f"Mostrando primeras {fixed.SHEET_ROW_LIMIT} filas de "), F.col("max_row").cast("string"), F.lit(" total")))
    rows = rows.withColumns({
        "main_types": F.array_join(F.array_compact(F.array(*[F.when(F.array_contains("counted", k), k) for k in kinds])), ", "),
        "dimensions": F.concat(F.col("max_row").cast("string"), F.lit(" x "), F.col("max_col").cast("string")), "note": note,
        "shown": F.transform(_of_mode("ai"), lambda x: x["line"]),
    })
    entry = F.concat(
        F.lit("- **"), esc(F.col("sheet")), F.lit("**: "), esc(F.col("dimensions")), F.lit(" ("),
        F.col("processed_rows").cast("string"), F.lit(" filas procesadas)"),
        F.when(F.col("main_types") != "", F.concat(F.lit(" (Tipos: "), esc(F.col("main_types")), F.lit(")"))).otherwise(""),
        F.coalesce(F.concat(F.lit(" - "), esc(F.col("note"))), F.lit("")), F.lit("\n"),
    )
    section = F.concat(
        F.lit("### 📄 Hoja: "), esc(F.col("sheet")), F.lit("\n"),
        F.when(
            F.size("formulas") > 0,
            F.concat(F.lit("**Fórmulas encontradas:** "), F.size("formulas").cast("string"), F.lit("\n"),
                     F.array_join(F.transform(F.slice("formulas", 1, 3), lambda x: x["text"]), ""), F.lit("\n")),
        ).otherwise(""),
        F.when(
            F.size("shown") > 0,
            F.concat("header_line", F.lit("\n"), "separator_line", F.lit("\n"), F.array_join("shown", "\n"), F.lit("\n"),
                     F.when(F.col("processed_rows") > 15, F.concat(
                         F.lit("\n*Mostrando primeras 15 filas de "), F.col("processed_rows").cast("string"), F.lit(" total*\n")
                     )).otherwise("")),
        ).otherwise("*No hay datos para mostrar*\n"),
    )
    return rows.select(*tables.columns, entry.alias("entry"), F.when(F.size("counted") > 0, section).alias("section"))


def _report(name: Column, sheets: Column) -> Column:
    """The report of a workbook from its sheets (entry, section) in order."""
    return F.concat(
        F.lit("## 📊 Excel Workbook Analysis\n- **Archivo:** "), cl.escape_markdown(name),
        F.lit("\n- **Hojas:** "), F.size(sheets).cast("string"), F.lit("\n\n### 📋 Estructura de Hojas\n"),
        F.array_join(F.transform(sheets, lambda s: s["entry"]), ""), F.lit("\n"),
        F.array_join(F.transform(sheets, lambda s: s["section"]), "\n"),
    )


def workbook_report(cells: DataFrame) -> DataFrame:
    """g12: one report per workbook: sheet list, then formulas and preview table of each sheet."""
    sheets = _sections(_table(sheet_facts(cells, fixed.CENSUS_ROWS, fixed.HEADER_COLUMNS))).filter("section IS NOT NULL")
    return sheets.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("sheet", "entry", "section"))).alias("sheets")).select(
        "book", _report(F.col("book"), F.col("sheets")).alias("report"))


def workbook_texts(cells: DataFrame) -> DataFrame:
    """(book, sheets, standard, plain): what the output formats show of each workbook; ``workbook_content`` puts it together.

    ``sheets`` goes into the report, ``standard`` has a heading and a table of seven rows for each sheet, ``plain`` 50 rows of each.
    """
    lines = lambda mode: F.transform(_of_mode(mode), lambda x: x["line"])
    table = F.when(F.size(lines("standard")) > 0, F.concat("header_line", F.lit("\n"), "separator_line", F.lit("\n"), F.array_join(lines("standard"), "\n")))
    standard = F.when(F.size("lines") > 0, F.concat(F.lit("## "), cl.escape_markdown(F.col("sheet")), F.lit("\n"), F.coalesce(table, F.lit("")), F.lit("\n")))
    rows = F.when(F.size("plain_lines") > 0, F.concat(F.array_join(lines("plain"), "\n"), F.lit("\n"))).otherwise("")
    plain = F.concat(F.lit("=== "), F.col("sheet"), F.lit(" ===\n"), rows)
    sheets = _sections(_previews(cells)).select(*SHEET, "entry", "section", standard.alias("standard"), plain.alias("plain"))
    of = lambda field: F.array_compact(F.transform("all", lambda s: s[field]))
    return sheets.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("sheet", "entry", "section", "standard", "plain"))).alias("all")).select(
        "book", F.filter("all", lambda s: s["section"].isNotNull()).alias("sheets"),
        F.array_join(of("standard"), "\n").alias("standard"), F.array_join(of("plain"), "\n").alias("plain"))


def workbook_content(name: Column, output_format: Column) -> Column:
    """The content of a workbook in an output format, from the columns of ``workbook_texts``."""
    return (F.when(output_format == "markdown_ai", _report(name, F.col("sheets"))).when(output_format == "plain", F.col("plain"))
            .otherwise(F.col("standard")))


def workbook_error(file_name: Column, error: Column) -> Column:
    """g12: error document of a workbook that cannot be read."""
    return F.concat(
        F.lit("## ❌ Error procesando archivo Excel\n\n**Archivo:** "), cl.escape_markdown(file_name),
        F.lit("\n**Error:** "), cl.escape_markdown(error),
        F.lit(
            "\n\n### 💡 Posibles soluciones:\n- Verificar que el archivo no esté corrupto\n"
            "- Asegurar que el archivo no esté protegido con contraseña\n"
            "- Verificar que sea un archivo Excel válido (.xlsx, .xls, .xlsm)"
        ),
    )

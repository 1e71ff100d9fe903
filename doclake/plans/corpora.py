"""Input corpora of the registered queries, derived from the given tables.

The raw ``documents`` text seldom triggers sections, lists, tables or markup, so each operator family also gets a
corpus whose text is computed row by row from ``orders`` columns. Row by row matters: no grouping is needed to build a
document, so a hot key cannot pile up in one task, and the corpus grows with the table. The same SQL expressions,
with the few dialect differences in ``Dialect``, build the corpora for the SQL check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

REPORT_IDS_FROM = 1_000_000_000_000
PROCESSED_AT = "2024-01-01T00:00:00"


@dataclass(frozen=True)
class Dialect:
    name: str

    def repeat(self, body: str, n: str, sep: str) -> str:
        """``body`` for i = 1..n, joined by ``sep``."""
        if self.name == "spark":
            return f"array_join(transform(sequence(1L, {n}), i -> {body}), {sep})"
        return f"array_to_string(list_transform(generate_series(1, {n}), lambda i: {body}), {sep})"

    def base64(self, c: str) -> str:
        if self.name == "spark":
            return f"regexp_replace(base64(cast({c} AS binary)), '[^A-Za-z0-9+/=]', '')"
        return f"base64(encode({c}))"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.name == "spark" else f"({a} // {b})"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


def report_text(d: Dialect) -> str:
    """Report-like prose: repeated sections, lists, blank lines, headings, money, percentages, durations."""
    cents = "((cast(round(o_totalprice * 100) AS bigint) * i) % 10000000)"
    item = (
        f"concat('- Parte ', (o_orderkey * 7 + i * 13) % 2000, ': ', (o_custkey + i) % 50 + 1, ' unidades, $', "
        f"{d.div(cents, 100)}, '.', lpad(cast({cents} % 100 AS string), 2, '0'), ', ', (i * 3 + o_custkey) % 11, '%')"
    )
    items = d.repeat(item, "o_orderkey % 6 + 1", "chr(10)")
    structured = f"""concat('Resumen del pedido ', o_orderkey, chr(10),
        'El cliente ', o_custkey, ' hizo este pedido con prioridad ', o_orderpriority,
        ' y estado ', o_orderstatus, chr(10), chr(10),
        CASE WHEN o_orderkey % 3 = 0 THEN 'RESULTADOS' ELSE 'Resultados:' END, chr(10),
        {items}, chr(10), chr(10), 'Conclusion', chr(10),
        'Entrega en ', o_orderkey % 12 + 1, ' meses y ', o_orderkey % 9, ' mil unidades.',
        CASE WHEN o_orderkey % 5 = 0 THEN concat(chr(10), 'Summary final', chr(10), 'ok') ELSE '' END)"""
    prose = """concat('  nota del pedido ', o_orderkey, ' con texto corrido y sin titulos, fin.', chr(10), 'sigue aqui. ', chr(10),
        chr(10), 'corta.', chr(10), ' ', chr(9), chr(10), '- uno.', chr(10), '  2. dos.', chr(10),
        'este es otro parrafo largo del cliente ', o_custkey, ' que supera el limite de la nota.', chr(10),
        'a letra suelta.', chr(10))"""
    plain = "concat('una sola linea del cliente ', o_custkey, ', sin listas.')"
    return f"CASE WHEN o_orderkey % 10 = 7 THEN {prose} WHEN o_orderkey % 10 = 9 THEN {plain} ELSE {structured} END"


def json_text(d: Dialect) -> str:
    """JSON objects of varying size and depth; every 17th is malformed."""
    line = (
        """concat('{"n":', i, ',"part":{"key":', (o_orderkey * 7 + i * 13) % 2000, ',"flag":"', o_orderstatus, '"},"qty":', """
        """(o_custkey + i) % 50, '}')"""
    )
    lines = d.repeat(line, "o_orderkey % 12 + 1", "','")
    return f"""CASE WHEN o_orderkey % 17 = 0 THEN concat('{{"order":', o_orderkey, ',')
        WHEN o_orderkey % 19 = 0 THEN concat('{{"k":', o_orderkey, ',"b":true}}')
        ELSE concat('{{"order":', o_orderkey, ',"status":"', o_orderstatus, '","server":{{"host":"h',
            o_orderkey % 7, '","port":null}},"open":',
            CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END,
            CASE WHEN o_orderkey % 5 = 0 THEN ',"api_list":[],"deep":{{"a":{{"b":{{"c":{{"Token":"un valor de texto bastante largo"}}}}}}}},"nada":{{}}' ELSE '' END,
            ',"lines":[', {lines}, ']}}') END"""


def xml_text(d: Dialect) -> str:
    """XML orders in two namespaces; every 10th is malformed."""
    line = (
        """concat('<k:line n="', i, '" flag="', o_orderstatus, '"><part>', (o_orderkey * 7 + i * 13) % 2000, '</part><qty/></k:line>')"""
    )
    lines = d.repeat(line, "o_orderkey % 6 + 1", "''")
    return f"""concat('<order xmlns="urn:ord" xmlns:k="urn:kit" id="', o_orderkey, '">',
        CASE WHEN o_orderkey % 4 = 0 THEN ' nota ' ELSE '' END, {lines},
        CASE WHEN o_orderkey % 10 = 0 THEN '<broken>' ELSE '' END, '</order>')"""


def yaml_text(d: Dialect) -> str:
    """YAML settings; every 17th is malformed."""
    entries = d.repeat("concat('  - id: ', i, chr(10), '    nombre: parte ', (o_orderkey + i) % 40)", "o_orderkey % 4 + 1", "chr(10)")
    return f"""concat('pedido: ', o_orderkey, chr(10), 'estado: ', o_orderstatus, chr(10), 'database:', chr(10), '  host: h',
        o_orderkey % 7, chr(10), '  port: 5432', chr(10), 'abierto: true', chr(10),
        CASE WHEN o_orderkey % 17 = 0 THEN 'mal: [1, 2' ELSE 'nada: null' END, chr(10), 'partes:', chr(10), {entries}, chr(10))"""


def markdown_text(d: Dialect) -> str:
    """Converter-like markdown: escapes, ragged tables, bullets, loose links, JSON lines, over-deep headers."""
    rows = d.repeat("concat('*p', (o_orderkey + i) % 2000, '* *', (o_custkey + i) % 50, '*')", "o_orderkey % 6 + 1", "chr(10)")
    bs = "chr(92)"
    return f"""concat('#Pedido ', {bs}, '(', o_orderkey, {bs}, ')', chr(10),
        'Introducción del pedido', chr(10), chr(10), chr(10),
        'el  cliente', chr(160), o_custkey, ' pide', {bs}, '.  ', chr(10),
        '__Parte__ __Cantidad__', chr(10), {rows}, chr(10), chr(10),
        '| a | b |', chr(10), '|1| ', {bs}, '*2|', chr(10),
        CASE WHEN o_orderkey % 2 = 0 THEN concat('| 3 |', chr(10)) ELSE '' END, chr(10),
        '•punto uno', chr(10), '1', {bs}, '. primero', chr(10),
        'ver http://example.com/', o_orderkey, ' fin', chr(10),
        '{{"a": 1,', chr(10), '"b": 2}}', chr(10), chr(10), '####### mal', chr(10),
        CASE WHEN o_orderkey % 3 = 0 THEN concat('```json', chr(10), '{{"x": ', o_custkey, '}}', chr(10), '```', chr(10), chr(10),
            '```json', chr(10), '{{"y": 2}}', chr(10), '```', chr(10)) ELSE '' END,
        CASE WHEN o_orderkey % 4 = 0 THEN concat('```json', chr(10), '[1. Uno](#uno)', chr(10), '[Dos](#dos)', chr(10), '```', chr(10)) ELSE '' END,
        'correo a', {bs}, '@b', {bs}, '.c y ', {bs}, '# signo', chr(10), 'Fin.', chr(10), chr(10))"""


#: content that suits the extension; every fifth typed document is broken
REQUEST_TEXT = """CASE doc_id % 9
    WHEN 1 THEN concat('{"doc":', doc_id, ',"meta":{"lang":"', lang, '","source":"', source, '"},"n":[', n_chars, ',true,null]',
        CASE WHEN doc_id % 5 = 0 THEN '' ELSE '}' END)
    WHEN 5 THEN concat('<doc id="', doc_id, '"><lang>', lang, '</lang>', CASE WHEN doc_id % 5 = 0 THEN '<' ELSE '' END, '</doc>')
    WHEN 8 THEN concat('doc: ', doc_id, chr(10), 'server:', chr(10), '  host: ', source, CASE WHEN doc_id % 5 = 0 THEN ': [' ELSE '' END, chr(10))
    ELSE text END"""


def csv_text(d: Dialect) -> str:
    """CSV files: quoted cells, a blank cell, short and long rows, 1 to 15 data rows."""
    row = (
        "concat((o_orderkey * 7 + i * 13) % 2000, ',', CASE WHEN i % 4 = 3 THEN ' ' ELSE concat('2024-01-', lpad(cast(i AS string), 2, '0')) END, "
        "CASE WHEN i % 7 = 6 THEN '' WHEN i % 5 = 4 THEN concat(',\"a, \"\"', i, '\"\"', chr(10), 'b\",extra') ELSE concat(',n', i) END)"
    )
    return f"concat('clave,fecha,nota', chr(10), {d.repeat(row, 'o_orderkey % 15 + 1', 'chr(10)')}, chr(10))"


def request_columns(d: Dialect) -> list[str]:
    """Requests with every validation failure; content is the document text."""
    return [
        "doc_id AS req_id",
        """CASE WHEN doc_id % 23 = 0 THEN NULL
             ELSE concat('doc_', doc_id, CASE doc_id % 9 WHEN 0 THEN '.txt' WHEN 1 THEN '.JSON' WHEN 2 THEN '.pdf'
                  WHEN 3 THEN '.PDF' WHEN 4 THEN '.mq' WHEN 5 THEN '.msgflow' WHEN 6 THEN '' WHEN 7 THEN '.bar' ELSE '.yml' END) END AS file_name""",
        f"""CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 31 = 0 THEN '***'
             WHEN doc_id % 37 = 0 THEN '//4A' ELSE {d.base64(f"({REQUEST_TEXT})")} END AS file_content""",
        "CASE WHEN doc_id % 14 = 0 OR doc_id % 13 = 0 THEN concat('in/doc_', doc_id, '.txt') END AS s3_path",
        "CASE WHEN doc_id % 28 = 0 THEN 'bucket-a' END AS bucket_name",
        """CASE doc_id % 6 WHEN 0 THEN 'markdown_ai' WHEN 1 THEN 'plain' WHEN 2 THEN 'structured_json'
             WHEN 3 THEN CASE WHEN doc_id % 2 = 1 THEN 'html' END END AS output_format""",
        "doc_id % 2 = 0 AS ai_optimized",
        "CASE WHEN doc_id % 5 <> 0 THEN doc_id % 4 = 0 END AS include_metadata",
    ]


#: object URIs with every fault, and store error codes
URI = """CASE doc_id % 6 WHEN 0 THEN concat('s3://bucket-', doc_id % 4, '/in/doc_', doc_id, '.txt') WHEN 1 THEN concat('S3://bucket/doc_', doc_id)
    WHEN 2 THEN 's3:///in/x.txt' WHEN 3 THEN 's3://bucket' WHEN 4 THEN concat('s3://bucket//doc_', doc_id, '.json?v=', doc_id)
    ELSE concat('http://example.com/', doc_id) END"""
ERROR_CODE = """CASE doc_id % 7 WHEN 0 THEN 'NoSuchBucket' WHEN 1 THEN 'NoSuchKey' WHEN 2 THEN 'AccessDenied' WHEN 3 THEN 'InvalidBucketName'
    WHEN 4 THEN 'PermanentRedirect' WHEN 5 THEN 'SlowDown' ELSE 'Other' END"""
#: every output format with every combination of flags
RENDER_OPTIONS = [
    "CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'markdown_ai' WHEN 2 THEN 'plain' ELSE 'structured_json' END AS output_format",
    "doc_id % 3 > 0 AS ai_optimized",
    "doc_id % 5 > 0 AS include_metadata",
]

SHEET_ROWS = 1500
SHEETS_PER_BOOK = 4


def grid_keys(d: Dialect) -> list[str]:
    """Sheets of at most 1,500 rows, so their number grows with the table."""
    return [
        f"concat('libro_', {d.div('o_orderkey', SHEET_ROWS * SHEETS_PER_BOOK)}) AS book",
        f"concat('Hoja_', {d.div('o_orderkey', SHEET_ROWS)} % {SHEETS_PER_BOOK}) AS sheet",
        f"o_orderkey % {SHEET_ROWS} + 1 AS row_idx",
    ]


GRID_CELLS = [
    # column, condition, value, kind; row 1 of each sheet is its header
    (1, "row_idx = 1", "'Clave'", "'text'"),
    (2, "row_idx = 1", "'Cliente'", "'text'"),
    (3, "row_idx = 1", "'Estado'", "'text'"),
    (4, "row_idx = 1", "'X'", "'text'"),
    (5, "row_idx = 1", "'Nota'", "'text'"),
    (1, "row_idx > 1 AND o_orderkey % 11 <> 0", "cast(o_orderkey AS string)", "'number'"),
    (2, "row_idx > 1 AND o_orderkey % 11 <> 0", "concat('Customer|', o_custkey)", "'text'"),
    (3, "row_idx > 1 AND o_orderkey % 11 <> 0", "CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END", "'boolean'"),
    (4, "row_idx > 1 AND o_orderkey % 11 <> 0", "concat('2024-01-', lpad(cast(o_orderkey % 28 + 1 AS string), 2, '0'))", "'text'"),
    (5, "row_idx > 1 AND o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0",
     "CASE WHEN o_orderkey % 4 = 0 THEN concat('=A', row_idx) ELSE 'a  \"b\" c' END", "'text'"),
    (6, "row_idx > 1 AND o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0", "cast(cast(o_totalprice AS decimal(18,2)) AS string)", "'number'"),
    (7, "row_idx > 1 AND o_orderkey % 13 = 0", "cast(36526 + o_orderkey % 3000 AS string)", "'datetime'"),
    (7, "row_idx > 1 AND o_orderkey % 13 = 1", "'5.0'", "'number'"),
    (8, "row_idx > 1 AND o_orderkey % 13 = 2", "''", "'text'"),
    (9, "row_idx > 1 AND o_orderkey % 13 = 3 AND o_orderkey % 1500 < 40", "'0'", "'number'"),
]

ORDER_CORPORA = {"jdocs": json_text, "xdocs": xml_text, "ydocs": yaml_text, "mdocs": markdown_text, "cdocs": csv_text}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core that rows are dealt to: short ones even out rows that take long.
TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to ``spark.doclake.spread`` tasks, where that is unset to some for each core, at least as many as a shuffle has.

    A file is read by as many tasks as it has row groups with rows, and one row group may hold a whole table. The work on a row costs
    far more than to move it.
    """
    spark = df.sparkSession
    cores, shuffled = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(int(spark.conf.get("spark.doclake.spread", None) or max(TASKS_PER_CORE * cores, shuffled)))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return spread(table(spark, sf_dir, "orders").select(*cols))


def order_corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ORDER_CORPORA[name](SPARK)
    return _orders(spark, sf_dir).selectExpr("o_orderkey AS doc_id", f"{text} AS text")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr(f"o_orderkey + {REPORT_IDS_FROM} AS doc_id", f"{report_text(SPARK)} AS text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose of ``documents`` and derived reports, named and typed."""
    typed = lambda df, kind: df.selectExpr(
        "doc_id", "text", "concat('in/doc_', doc_id, '.txt') AS file_name", f"'{kind}' AS doc_type"
    )
    return typed(documents(spark, sf_dir), "text_document").unionByName(typed(reports(spark, sf_dir), "docx_document"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return spread(table(spark, sf_dir, "documents").select(*columns)).selectExpr(*request_columns(SPARK))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook cells (book, sheet, row_idx, col_idx, value, kind)."""
    rows = _orders(spark, sf_dir).selectExpr("*", *grid_keys(SPARK))
    structs = ", ".join(
        f"CASE WHEN {cond} THEN struct({col}L AS col_idx, {value} AS value, {kind} AS kind) END"
        for col, cond, value, kind in GRID_CELLS
    )
    return rows.selectExpr("book", "sheet", "row_idx", f"inline(filter(array({structs}), c -> c IS NOT NULL))")


DATASET_COLUMNS = {
    # lineitem as an all-text dataset with blank, missing and odd cells
    "pedido": "cast(l_orderkey AS string)",
    "parte": "CASE WHEN l_partkey % 10 = 0 THEN NULL WHEN l_partkey % 10 = 1 THEN ' ' ELSE cast(l_partkey AS string) END",
    "cantidad": "cast(cast(l_quantity AS decimal(18,2)) AS string)",
    "precio": "concat('1,', lpad(cast(cast(floor(l_extendedprice) AS bigint) % 1000 AS string), 3, '0'), '.50')",
    "fecha": "cast(cast(l_shipdate AS date) AS string)",
    "marca": "CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE l_returnflag END",
    "nota": "concat('linea | ', l_linestatus, ' ', l_linenumber)",
}
DATASET_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"]


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset columns plus ``_pos``, the order of its rows as a sortable struct."""
    order = ", ".join(DATASET_ORDER)
    return spread(table(spark, sf_dir, "lineitem")).selectExpr(
        *[f"{e} AS {n}" for n, e in DATASET_COLUMNS.items()], f"struct({order}) AS _pos"
    )


def duckdb_ctes() -> dict[str, str]:
    """The same corpora as common table expressions for the SQL check."""
    d = DUCKDB
    out = {
        name: f"{name} AS MATERIALIZED (SELECT o_orderkey AS doc_id, {make(d)} AS text FROM orders)"
        for name, make in ORDER_CORPORA.items()
    }
    out["texts"] = f"""texts AS MATERIALIZED (
        SELECT doc_id, text, concat('in/doc_', doc_id, '.txt') AS file_name, doc_type FROM (
          SELECT doc_id, text, 'text_document' AS doc_type FROM documents
          UNION ALL SELECT o_orderkey + {REPORT_IDS_FROM}, {report_text(d)}, 'docx_document' FROM orders))"""
    cols = ", ".join(f"{e} AS {n}" for n, e in DATASET_COLUMNS.items())
    out["dataset"] = f"dataset AS MATERIALIZED (SELECT {cols}, {', '.join(DATASET_ORDER)} FROM lineitem)"
    out["reqs"] = f"reqs AS MATERIALIZED (SELECT {', '.join(request_columns(d))} FROM documents)"
    keys = ", ".join(grid_keys(d))
    parts = " UNION ALL ".join(
        f"SELECT book, sheet, row_idx, CAST({col} AS bigint) AS col_idx, {value} AS value, {kind} AS kind FROM grid_rows WHERE {cond}"
        for col, cond, value, kind in GRID_CELLS
    )
    out["cells"] = f"grid_rows AS (SELECT *, {keys} FROM orders), cells AS MATERIALIZED ({parts})"
    return out

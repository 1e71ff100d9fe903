"""The whole way of a request: validate → decode → admit → route → read → render, with a reason where it ends early.

Every step is computed from the row itself. One parser pass reads JSON, YAML and XML beside the text, and stored objects are read by
the task that holds their request, so nothing is joined, grouped or staged, and requests need no id. Only custom readers (a join on a
row number of their own rows) and stores that Spark alone can open (a join of their files) are exceptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.frames import computed
from doclake.operators import csvdocs, grid, lines, markdown, routing, trees
from doclake.operators import text as t
from doclake.plans import shared
from doclake.sources import objects
from doclake.sources import requests as rq
from doclake.sources import trees as src
from doclake.sources.objects import Store
from doclake.sources.registry import DEFAULT, Reader, Registry

NOT_PARSED = ("excel", "docx")
#: Codes of a store for an object that is not there.
MISSING = ("NoSuchKey", "NoSuchBucket")
NODE_FIELDS = sorted({*trees.REPORT_FIELDS, *trees.YAML_FIELDS})


def _place(uri: Column) -> Column:
    """Bucket and key of an object path, whatever connector its scheme names."""
    return F.regexp_replace(uri, r"^s3[an]?://", "s3://")


def _with_text(rows: DataFrame) -> DataFrame:
    """rows + ``text`` of readers that read text, and bytes of XML that are not UTF-8 and are to be decoded as they declare."""
    utf8 = rq.utf8_text(F.col("content"))
    as_text = ~F.col("reader").isin(*NOT_PARSED) & ~F.startswith("reader", F.lit("custom:")) & F.col("ended").isNull()
    read = computed(rows, {"length": F.octet_length("content").cast("bigint"), "text": F.when(as_text, utf8), "as_text": as_text})
    undecoded = F.when((F.col("reader") == "xml") & F.col("as_text") & F.col("text").isNull(), F.col("content"))
    return read.withColumn("undecoded", undecoded)


def _with_content(checked: DataFrame, files: DataFrame | None, store: Store | None) -> DataFrame:
    """checked + ``content`` and ``object_error``, the store's code of an object that cannot be read."""
    inline = rq.decoded(F.when(F.col("file_content") != "", F.col("file_content")))
    no_error = F.lit(None).cast("string")
    if store is not None:
        region = F.col("region") if "region" in checked.columns else None
        wanted = F.when(F.col("error").isNull(), F.col("s3_path"))
        return computed(objects.fetched(checked, store, F.col("bucket_name"), wanted, region), {"content": F.coalesce("stored", inline)}).drop("stored")
    if files is not None:
        uri = F.concat(F.lit("s3://"), F.col("bucket_name"), F.lit("/"), F.col("s3_path"))
        stored = files.select(_place(F.col("path")).alias("uri"), F.col("content").alias("stored"))
        found = checked.withColumn("uri", uri).join(stored, "uri", "left").drop("uri")
        return computed(found, {"content": F.coalesce("stored", inline), "object_error": no_error}).drop("stored")
    return computed(checked, {"content": inline, "object_error": no_error})


def admitted(
    requests: DataFrame, registry: Registry = DEFAULT, files: DataFrame | None = None, store: Store | None = None,
) -> DataFrame:
    """Requests with options, route, bytes length, ``text``, parsed trees and ``reason`` (null when readable).

    ``store`` is where the objects named by bucket and ``s3_path`` are; each is read by the task that holds its request. Of a store
    that only Spark can open, ``files`` (path, content) has the objects, under s3, s3a or s3n paths; then all of them are read and
    joined. Without either, those requests are missing files. A missing ``req_id`` column reads as null.
    """
    if "req_id" not in requests.columns:
        requests = requests.withColumn("req_id", F.lit(None).cast("bigint"))
    checked = routing.resolve_options(routing.validate(requests))
    from_store = F.coalesce(F.col("s3_path"), F.lit("")) != ""
    loaded = _with_content(checked, files, store).withColumn("ext", routing.request_extension(F.col("file_name"))).drop("file_content")
    ended = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("object_error").isin(*MISSING), "missing_file")
        .when(F.col("object_error").isNotNull(), "unreadable_file")
        .when(F.col("content").isNull(), F.when(from_store, "missing_file").otherwise("bad_base64"))
        .when(F.octet_length("content") == 0, F.when(from_store, "empty_file").otherwise("empty_content"))
        .otherwise(routing.admit_reason(F.lit(False), F.lit(False), F.octet_length("content"), F.col("ext")))
    )
    routed = routing.with_reader(
        loaded.withColumn("ended", ended).withColumn("ext", F.lower("ext")).drop("error"), registry)
    read = _with_text(routed).withColumn("ai", F.col("output_format") == "markdown_ai")
    parsed = src.with_trees(read, wanted="ai", node_fields=NODE_FIELDS, raw="undecoded", summary=True)
    refused = (
        F.when(F.col("text").isNull() & F.col("as_text"), "invalid_utf8")
        .when(F.col("reader").isin("json", "yaml") & (F.col("status") == "malformed"), "malformed")
    )
    return computed(parsed, {"reason": F.coalesce("ended", refused)}).drop("ended", "as_text")


def rejects(
    requests: DataFrame, registry: Registry = DEFAULT, files: DataFrame | None = None, store: Store | None = None,
) -> DataFrame:
    """Requests that end early, with the reason."""
    return admitted(requests, registry, files, store).filter(F.col("reason").isNotNull())


def _custom(rows: DataFrame, registry: Registry) -> DataFrame | None:
    """Rows of custom readers with the content and the action that follow from what their reader makes."""
    own = [r for r in registry.readers if r.fn is not None]
    if not own:
        return None
    folder = shared.new_folder(rows.sparkSession)
    kept = rows.filter(F.startswith("reader", F.lit("custom:"))).drop("nodes", "tree", "xml").withColumn("doc_id", F.monotonically_increasing_id())
    kept.write.parquet(folder)  # the row numbers must not change between the reader and the join
    staged = rows.sparkSession.read.schema(kept.schema).parquet(folder)
    out = None
    for r in own:
        one = _shown(staged.filter(F.col("reader") == r.reader), r).drop("doc_id")
        columns = [*kept.drop("text", "content", "doc_id").columns, "content_out", "action"]
        out = one.select(*columns) if out is None else out.unionByName(one.select(*columns))
    return out


def _shown(mine: DataFrame, r: Reader) -> DataFrame:
    """Rows of one custom reader with ``content_out`` and ``action``."""
    made, rest = r.fn(mine), mine.drop("text", "content")
    parsed = F.lit("parsed").alias("action")
    if r.output == "text":
        return rest.drop("action").join(made.select("doc_id", F.col("text").alias("content_out")), "doc_id").select("*", parsed)
    if r.output == "cells":
        cells = made.select(F.col("doc_id").cast("string").alias("book"), "sheet", "row_idx", "col_idx", "value", "kind")
        texts = grid.workbook_texts(cells).withColumn("doc_id", F.col("book").cast("bigint")).drop("book")
        content = F.when(F.col("sheets").isNotNull(), grid.workbook_content(F.col("file_name"), F.col("output_format")))
        empty = grid.workbook_error(F.col("file_name"), F.lit(NO_CELLS))
        return rest.join(texts, "doc_id", "left").select(*rest.columns, F.coalesce(content, empty).alias("content_out"), F.when(
            content.isNull(), "error_document").otherwise("parsed").alias("action"))
    docs = rest.join(made.select("doc_id", "text"), "doc_id")
    if r.output == "markdown":
        clean = markdown.normalise(docs)
        full = clean.join(markdown.quality(clean.select("doc_id", "text", "file_name")).select("doc_id", "full_header"), "doc_id")
        return full.withColumn("content_out", F.when(F.col("ai"), F.concat("full_header", "text")).otherwise(F.col("text"))).select("*", parsed)
    as_tree = docs.withColumns({"reader": F.lit(r.output), "content": F.lit(None).cast("binary")})
    return _read(src.with_trees(as_tree, wanted="ai", node_fields=NODE_FIELDS, summary=True)).withColumn("reader", F.lit(r.reader))


def _read(rows: DataFrame) -> DataFrame:
    """rows + ``content_out`` and ``action`` of the built-in readers."""
    ai, reader = F.col("ai"), F.col("reader")
    parsed = F.coalesce(F.col("status") == "ok", F.lit(False))
    prepared = csvdocs.profile(rows.withColumn("whole", F.col("text")).withColumn(
        "text", F.when(reader == "csv", F.col("text"))))
    csv_out = computed(prepared, {"csv_out": F.when(reader == "csv", csvdocs.content_expr(F.col("output_format")))})
    plain = csv_out.select(*[c for c in prepared.columns if c not in ("text", "whole", *csvdocs.PROFILE_COLUMNS)], "csv_out", F.col("whole").alias("text"))
    # JSON keeps its fence in every format but plain; a YAML text that is no YAML gets a note
    fence_format = F.when((reader == "json") & (F.col("output_format") != "plain"), "markdown").otherwise(F.col("output_format"))
    noted = F.when(reader == "yaml", F.concat(F.lit("\n<!-- YAML Parse Error: "), F.col("error"), F.lit(" -->\n")))
    fenced = t.fence_expr(F.concat(F.coalesce(noted, F.lit("")), F.col("text")), F.col("fence"), fence_format)
    as_text = reader == "text"
    analysed = lines.with_structure(
        plain.withColumn("fenced", fenced).withColumn("raw", F.col("text")).withColumn("text", F.when(as_text & ai, F.col("text"))))
    report = F.when(as_text & ai, lines.text_report_expr())
    reported = analysed.select(*[c for c in plain.columns if c != "text"], "fenced", report.alias("text_report"), F.col("raw").alias("text"))
    content = (
        F.when(reader == "csv", F.col("csv_out"))
        .when(as_text, F.coalesce("text_report", "fenced"))
        .when(reader == "excel", grid.workbook_error(F.col("file_name"), F.lit(NOT_READ)))
        .when(reader.isin(*NOT_PARSED), error_document("Processing Error", F.col("file_name")))
        .when(parsed & ai & (reader == "json"), trees.json_report_expr())
        .when(parsed & ai & (reader == "yaml"), trees.yaml_report_expr())
        .when(parsed & ai & (reader == "xml"), trees.xml_report_expr())
        .otherwise(F.col("fenced"))
    )
    ok = F.when(reader.isin(*NOT_PARSED), F.lit(False)).when(reader.isin("json", "yaml", "xml"), parsed).otherwise(F.lit(True))
    return reported.select(
        *[c for c in rows.columns if c not in ("text", "content", "nodes", "tree", "xml")],
        content.alias("content_out"), F.when(ok, "parsed").otherwise(F.col("on_error")).alias("action"))


NOT_READ, NO_CELLS = "Binary workbooks are not read", "The workbook has no cells"


def error_document(title: str, file_name: Column) -> Column:
    return F.concat(F.lit(f"## ❌ {title}\n\n**File:** "), file_name, F.lit("\n"))


RESULT_COLUMNS = [
    "req_id", "file_name", "s3_path", "output_format", "ai_optimized", "include_metadata", "ext", "reader", "doc_type", "on_error", "length", "action",
]
REJECT_COLUMNS = ["bucket_name", "reason", "object_error"]


def _rendered(rows: DataFrame, processed_at: str, registry: Registry) -> DataFrame:
    """Results of admitted rows; rows with a reason have none."""
    own = F.startswith("reader", F.lit("custom:")) & F.col("reason").isNull()
    out = _read(rows.filter(~own))
    custom = _custom(rows.filter(own), registry)
    columns = [*RESULT_COLUMNS, *REJECT_COLUMNS]
    if custom is not None:
        out = out.select(*columns, "content_out").unionByName(custom.select(*columns, "content_out"))
    readable, as_is = F.col("reason").isNull(), F.col("action") != "parsed"
    shown = out.withColumn("action", F.when(readable, F.col("action"))).select(
        *columns, F.when(as_is, F.col("content_out")).alias("as_is"), F.when(readable & ~as_is, F.col("content_out")).alias("content"))
    rendered = routing.render(shown, processed_at)
    return rendered.select(*columns, F.when(readable, F.coalesce("as_is", "result")).alias("result"))


def process(
    requests: DataFrame, processed_at: str, registry: Registry = DEFAULT, files: DataFrame | None = None, store: Store | None = None,
) -> DataFrame:
    """Requests → one row with ``result`` for each that can be read; ``rejects`` has the others.

    ``req_id`` is carried as it is, whatever its type; it may be null or repeated.
    """
    readable = admitted(requests, registry, files, store).filter(F.col("reason").isNull())
    return _rendered(readable, processed_at, registry).select(*RESULT_COLUMNS, "reason", "result")


def outcomes(
    requests: DataFrame, processed_at: str, registry: Registry = DEFAULT, files: DataFrame | None = None, store: Store | None = None,
) -> DataFrame:
    """Requests → one row for each: with ``result``, or with ``reason`` and, for objects, their ``object_error``; one pass makes both."""
    return _rendered(admitted(requests, registry, files, store), processed_at, registry)

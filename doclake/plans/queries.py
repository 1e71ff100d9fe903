"""Registered queries: name → function of (spark, directory of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions import cells as cl
from doclake.operators import csvdocs, grid, lines, results, rollups, routing, tabular, text, trees
from doclake.operators import markdown as md
from doclake.plans import corpora as c
from doclake.plans import shared
from doclake.plans.process import admitted, outcomes, process, rejects
from doclake.sources import files as sf
from doclake.sources import requests as rq
from doclake.sources import sinks, textfiles
from doclake.sources import trees as src
from doclake.sources.objects import Store
from doclake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]


def on(corpus: Callable[[SparkSession, str], DataFrame], operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(corpus(spark, sf_dir))


def _metrics(docs: DataFrame) -> DataFrame:
    return text.metrics(docs).select(
        "doc_id", F.size("metrics").cast("bigint").alias("n_metrics"), F.array_join("metrics", " | ").alias("metrics")
    )


def _record(docs: DataFrame) -> DataFrame:
    r = text.structured_record(docs)
    return r.select(
        "doc_id", "record.metadata.*", "record.summary",
        F.array_join("record.key_metrics", " | ").alias("key_metrics"),
        *[F.col(f"record.sections.{k}").alias(f"section_{k}") for k in ["summary", "key_points", "metrics", "recommendations"]],
        "record.full_content",
    )


def text_queries() -> dict[str, Query]:
    return {
        "t1_counts": on(c.texts, text.counts),
        "t2_language_flag": on(c.texts, text.language),
        "t3_front_matter": on(c.texts, lambda d: text.front_matter(d, c.PROCESSED_AT)),
        "t4_metric_extraction": on(c.texts, _metrics),
        "t5_summary": on(c.texts, text.summary),
        "t6_ai_document": on(c.texts, lambda d: text.ai_document(d, c.PROCESSED_AT)),
        "t7_structured_record": on(c.texts, _record),
        "l1_lines": on(c.texts, lines.lines),
        "l2_line_stats": on(c.texts, lines.line_stats),
        "l3_paragraphs": on(c.texts, lines.paragraphs),
        "l4_headings": on(c.texts, lines.headings),
        "l5_lists": on(c.texts, lines.lists),
        "l6_structure_type": on(c.texts, lines.structure),
        "l7_key_sections": on(c.texts, lines.key_sections),
        "l8_heading_rewrite": on(c.texts, lines.heading_rewrite),
        "l9_paragraph_rewrite": on(c.texts, lines.paragraph_rewrite),
        "l10_text_report": on(c.texts, lines.text_report),
    }


# ---- sources, routing, results ---------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request events in the three envelopes: JSON string body, no envelope, object body."""
    request = F.struct("*")
    as_json = F.to_json(request)
    value = (
        F.when(F.col("req_id") % 3 == 0, F.to_json(F.struct(as_json.alias("body"))))
        .when(F.col("req_id") % 3 == 1, as_json)
        .otherwise(F.to_json(F.struct(request.alias("body"))))
    )
    return c.requests(spark, sf_dir).select(value.alias("value"))


REQUEST_COLUMNS = ["req_id", "file_name", "file_content", "s3_path", "bucket_name", "output_format", "ai_optimized", "include_metadata"]


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests seen as stored files: bytes, length, missing flag."""
    content = F.coalesce(rq.decoded(F.col("file_content")), F.lit("").cast("binary"))
    return c.requests(spark, sf_dir).select(
        "req_id", "file_name", F.col("file_content").isNull().alias("missing"), content.alias("content"),
        F.octet_length(content).cast("bigint").alias("length"),
    )


def _decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.decode_text(_stored(spark, sf_dir).select("req_id", "content"))


def _decode_base64(requests: DataFrame) -> DataFrame:
    return rq.decode_base64(requests).select("req_id", F.octet_length("bytes").cast("bigint").alias("n_bytes"), "decode_reason")


def _csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset as CSV records: quoted notes with commas and line breaks, some short and some long rows."""
    df = c.dataset(spark, sf_dir)
    quoted = F.concat(F.lit('"a, ""b"" '), F.col("nota"), F.lit("\n fin\""))
    short = F.concat_ws(",", "pedido", "fecha")
    full = F.concat_ws(",", "pedido", "fecha", quoted)
    long = F.concat(full, F.lit(",sobra"))
    k = F.col("_pos.l_orderkey") % 10
    return df.select("pedido", F.when(k == 3, short).when(k == 4, long).otherwise(full).alias("value")).drop("pedido")


def _scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = sf.parse_csv(_csv_records(spark, sf_dir), ["pedido", "fecha", "nota"])
    return parsed.select("pedido", "fecha", "nota", F.col("_ragged").isNotNull().alias("ragged"))


def _scan_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as files with line breaks inside quotes, read back by many tasks."""
    path = shared.new_folder(spark)
    _csv_records(spark, sf_dir).write.text(path)
    parsed = sf.scan_csv(spark, path, ["pedido", "fecha", "nota"], header=False)
    return parsed.select("pedido", "fecha", "nota", F.col("_ragged").isNotNull().alias("ragged"))


def _scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sf.scan_files(spark, sf_dir, "*.parquet").select("file_name", "ext", "length")


def _uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.documents(spark, sf_dir).selectExpr("doc_id", f"{c.URI} AS uri", f"{c.ERROR_CODE} AS code")


def _object_uri(uris: DataFrame) -> DataFrame:
    message = routing.object_error_message(F.col("code"), F.col("bucket"), F.col("object_key"))
    return routing.parse_uri(uris).withColumn("message", message)


def _render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under every combination of output format and options."""
    d = c.texts(spark, sf_dir).selectExpr("*", *c.RENDER_OPTIONS).withColumn("content", F.col("text"))
    return routing.render(d, c.PROCESSED_AT).select("doc_id", "output_format", "result")


def _fenced(requests: DataFrame) -> DataFrame:
    return routing.fenced(admitted(requests).filter("reason IS NULL AND text IS NOT NULL")).select("req_id", "content")


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(c.requests(spark, sf_dir), c.PROCESSED_AT)


def _expressible(processed: DataFrame) -> DataFrame:
    """All formats of text, and of trees those that show them in a fence: SQL can express these results."""
    fenced = F.col("reader").isin("json", "xml", "yaml") & (F.col("output_format") != "markdown_ai")
    return processed.filter((F.col("action") == "parsed") & ((F.col("reader") == "text") | fenced))


def _result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expressible(_processed(spark, sf_dir)).select("req_id", "output_format", "reader", "result")


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result written as a file of its own and read back; of these the rows whose text SQL can express."""
    path = shared.new_folder(spark)
    sinks.write_texts(_processed(spark, sf_dir), path)
    found = textfiles.read_documents(spark, path, "req_id bigint, output_format string, reader string, action string")
    return _expressible(found).select("req_id", "output_format", "reader", F.col("body").alias("result"))


def _stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as objects of a store; requests for them, some for keys and buckets that are not there."""
    place = shared.new_folder(spark)
    texts = c.documents(spark, sf_dir).select(F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").alias("body"), "doc_id")
    textfiles.write_documents(texts, f"{place}/bucket")
    asked = textfiles.read_index(spark, f"{place}/bucket", "doc_id bigint").selectExpr(
        "doc_id AS req_id", "concat('doc_', doc_id, '.txt') AS file_name", "cast(NULL AS string) AS file_content",
        "if(doc_id % 7 = 3, concat(file, '.gone'), file) AS s3_path", "if(doc_id % 7 = 5, 'nowhere', 'bucket') AS bucket_name",
        "'plain' AS output_format", "false AS ai_optimized", "false AS include_metadata")
    out = outcomes(asked, c.PROCESSED_AT, store=Store(f"{place}/{{bucket}}/{{key}}"))
    return out.select("req_id", "reason", "object_error", "result")


def _all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests, and CSV, JSON, XML, YAML and text documents as requests in every output format."""
    out = c.requests(spark, sf_dir)
    formats = "element_at(array('markdown', 'markdown_ai', 'plain', 'structured_json'), cast(doc_id % 4 AS int) + 1)"
    for k, (corpus, ext) in enumerate([("cdocs", "csv"), ("jdocs", "json"), ("xdocs", "xml"), ("ydocs", "yml"), ("mdocs", "txt")], 1):
        out = out.unionByName(c.order_corpus(spark, sf_dir, corpus).selectExpr(
            f"doc_id + {k} * {c.REPORT_IDS_FROM} AS req_id", f"concat('doc_', doc_id, '.{ext}') AS file_name",
            "base64(encode(text, 'UTF-8')) AS file_content", "cast(NULL AS string) AS s3_path", "cast(NULL AS string) AS bucket_name",
            f"{formats} AS output_format", "doc_id % 3 > 0 AS ai_optimized", "doc_id % 5 > 0 AS include_metadata"))
    return out


def _result_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered result of every request that can be read, whatever its reader, format and action; SQL cannot express them all."""
    return process(_all_kinds(spark, sf_dir), c.PROCESSED_AT).select(
        "req_id", "output_format", "reader", "action", "result", F.char_length("result").cast("bigint").alias("output_chars"))


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(c.requests(spark, sf_dir))


def _written(rows: DataFrame, write, columns: list[str]) -> DataFrame:
    path = shared.new_folder(rows.sparkSession)
    write(rows, path)
    return rows.sparkSession.read.parquet(path).select(*columns)


def ingest_queries() -> dict[str, Query]:
    return {
        "s1_scan_files": _scan_files,
        "s2_decode_text": _decode_text,
        "s3_scan_csv": _scan_csv,
        "s3_scan_csv_files": _scan_csv_files,
        "s4_scan_json_docs": lambda s, d: sf.scan_json(c.order_corpus(s, d, "jdocs")).select("doc_id", "reason"),
        "s7_scan_requests": lambda s, d: rq.scan_requests(_events(s, d)).select(*REQUEST_COLUMNS),
        "s8_decode_base64": on(c.requests, _decode_base64),
        "s9_write_results": lambda s, d: _written(_processed(s, d), sinks.write_results, ["req_id", "file_name", "doc_type", "length"]),
        "s9_text_files": _text_files,
        "s9_written_results": lambda s, d: _written(_processed(s, d), sinks.write_results, ["req_id", "doc_type", "output_format", "result"]),
        "s10_write_rejects": lambda s, d: _written(_rejected(s, d), sinks.write_rejects, ["req_id", "file_name", "reason"]),
        "p1_admit": lambda s, d: routing.admit(_stored(s, d)).select("req_id", "ext", "reason"),
        "p2_route": lambda s, d: routing.route(c.requests(s, d)).select("req_id", "ext", "reader"),
        "p3_supported": lambda s, d: c.requests(s, d).select("req_id", routing.is_supported(F.col("file_name")).alias("supported")),
        "p4_object_uri": on(_uris, _object_uri),
        "p5_validate_request": lambda s, d: routing.validate(c.requests(s, d)).select("req_id", "error"),
        "p6_resolve_options": lambda s, d: routing.resolve_options(c.requests(s, d)).select(
            "req_id", "output_format", "ai_optimized", "include_metadata", "extract_key_sections",
            F.col("max_chunk_size").cast("bigint").alias("max_chunk_size"), "processing_images"),
        "p7_render_mode": _render,
        "t8_type_label": lambda s, d: routing.route(c.requests(s, d)).select("req_id", "doc_type"),
        "t9_fence": on(c.requests, _fenced),
        "e1_result_row": lambda s, d: results.result_rows(_processed(s, d)).drop("output_chars"),
        "e1_result_text": _result_text,
        "e1_result_all": _result_all,
        "e1_result_sizes": lambda s, d: results.result_rows(_processed(s, d)),
        "e2_reject_row": lambda s, d: results.reject_rows(_rejected(s, d)),
        "e2_stored_objects": _stored_objects,
        "e3_capabilities": lambda s, d: results.usage(
            c.requests(s, d).select(routing.request_extension(F.col("file_name")).alias("ext"))),
        "e4_reader_fallback": lambda s, d: _processed(s, d).select("req_id", "reader", "action"),
        "r6_reject_report": lambda s, d: rollups.reject_report(_rejected(s, d)),
    }


# ---- datasets and roll-ups -------------------------------------------------------------------


def dataset_queries() -> dict[str, Query]:
    return {
        "d1_dataset_info": on(c.dataset, tabular.dataset_info),
        "d2_column_types": on(c.dataset, tabular.column_types),
        "d2_column_types_all_rows": on(c.dataset, lambda d: tabular.column_types(d, sample_rows=None)),
        "d3_type_summary": on(c.dataset, lambda d: tabular.type_summary(tabular.column_types(d))),
        "d4_completeness": on(c.dataset, tabular.completeness),
        "d4_column_completeness": on(c.dataset, tabular.column_completeness),
        "d5_preview_table": on(c.dataset, lambda d: tabular.preview(d, "lineitem.csv")),
        "d6_full_table": on(c.dataset, tabular.table_lines),
        "d7_plain_rows": on(c.dataset, tabular.plain_lines),
        "d2_csv_documents": _csv_profile,
        "d6_csv_documents": _csv_tables,
    }


def _csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = csvdocs.profile(c.order_corpus(spark, sf_dir, "cdocs"))
    return p.select(
        "doc_id", F.size("data").cast("bigint").alias("total_rows"), F.array_join("header", ", ").alias("headers"),
        csvdocs.type_summary(F.col("types")).alias("types"), "total_cells", "empty_cells")


def _csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.order_corpus(spark, sf_dir, "cdocs").withColumn("file_name", F.concat(F.lit("d_"), F.col("doc_id"), F.lit(".csv")))
    return csvdocs.report(docs, "markdown")


def rollup_queries() -> dict[str, Query]:
    return {
        "r1_corpus_profile": on(c.texts, rollups.corpus_profile),
        "r2_metric_frequency": on(c.texts, rollups.metric_frequency),
        "r3_tag_inventory": lambda s, d: rollups.tag_inventory(c.order_corpus(s, d, "xdocs")),
        "r4_key_inventory": lambda s, d: rollups.key_inventory(c.order_corpus(s, d, "jdocs")),
        "r5_flag_agreement": lambda s, d: rollups.flag_agreement(c.spread(c.table(s, d, "documents").select("lang", "text"))),
    }


# ---- trees -----------------------------------------------------------------------------------


def _json_and_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = c.spread(c.table(spark, sf_dir, "events").select("event_id", "props"))
    return c.order_corpus(spark, sf_dir, "jdocs").unionByName(
        props.selectExpr(f"event_id + {c.REPORT_IDS_FROM} AS doc_id", "props AS text"))


def _json(fields: list[str] | None, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: operator(src.json_nodes(c.order_corpus(s, d, "jdocs"), fields))


def _xml(fields: list[str] | None, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: operator(src.xml_elements(c.order_corpus(s, d, "xdocs"), fields))


def _named(corpus: str, ext: str) -> Query:
    return lambda s, d: c.order_corpus(s, d, corpus).withColumn("file_name", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(ext)))


def _stats(nodes: DataFrame) -> DataFrame:
    return trees.tree_stats(nodes).withColumn("kinds", F.array_join("kinds", ", "))


def _scan_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.order_corpus(spark, sf_dir, "xdocs")
    found = src.xml_elements(docs, ["ord"]).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.col("n").isNotNull().alias("well_formed"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_elements"))


def _scan_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.order_corpus(spark, sf_dir, "ydocs")
    return _stats(src.yaml_nodes(docs, trees.STAT_FIELDS)).drop("complexity")


def _outline(nodes: DataFrame) -> DataFrame:
    return trees.outline(nodes).select("doc_id", "path", "object_depth", "kind", "description", "left_out")


def tree_queries() -> dict[str, Query]:
    return {
        "s5_scan_xml_docs": _scan_xml,
        "s6_scan_yaml_docs": _scan_yaml,
        "n1_nodes": _json(["path", "depth", "kind", "n_children"], lambda n: n),
        "n2_tree_stats": _json(trees.STAT_FIELDS, lambda n: _stats(n).drop("complexity")),
        "n3_complexity": lambda s, d: trees.tree_stats(
            src.json_nodes(_json_and_props(s, d), trees.STAT_FIELDS)).select("doc_id", "complexity"),
        "n4_outline": _json(trees.OUTLINE_FIELDS, _outline),
        "n5_tree_report": on(_named("jdocs", ".json"), trees.json_report),
        "n5_yaml_report": on(_named("ydocs", ".yml"), trees.yaml_report),
        "n6_config_patterns": _json(trees.CONFIG_FIELDS, trees.config_patterns),
        "n7_top_level": _json(trees.TOP_FIELDS, trees.top_level),
        "x1_elements": _xml(["ord", "depth", "clean_tag", "n_attributes", "text_length"], lambda e: e),
        "x2_xml_stats": _xml(["depth", "tag", "clean_tag", "n_attributes", "text_length"], trees.xml_stats),
        "x3_tag_summary": _xml(
            ["ord", "clean_tag", "parent_tag", "n_attributes", "text_length"],
            lambda e: trees.tag_summary(e).withColumn("children", F.array_join("children", ", "))),
        "x4_namespace": _xml(["depth", "tag"], trees.root_namespace),
        "x5_xml_report": on(_named("xdocs", ".xml"), trees.xml_report),
    }


# ---- grids -----------------------------------------------------------------------------------


def _escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = c.cells(spark, sf_dir).select("value").unionByName(c.documents(spark, sf_dir).select(F.col("text").alias("value")))
    return value.select("value", cl.escape_markdown(F.col("value")).alias("escaped"))


def grid_queries() -> dict[str, Query]:
    return {
        "g1_rows": on(c.cells, lambda d: grid.rows(d, row_limit=fixed.SHEET_ROW_LIMIT)),
        "g1_rows_all": on(c.cells, grid.rows),
        "g2_cell_census": on(c.cells, grid.census),
        "g3_header_check": on(c.cells, grid.header_check),
        "g4_smart_headers": on(c.cells, lambda d: grid.smart_headers(d, columns=fixed.HEADER_COLUMNS)),
        "g5_escape_cell": on(c.cells, lambda d: d.select(
            "book", "sheet", "row_idx", "col_idx", cl.escape_cell(F.col("value"), 12).alias("short"),
            cl.escape_cell(F.col("value"), 100).alias("cell"))),
        "g6_escape_markdown": _escaped,
        "g7_table_rows": on(c.cells, lambda d: grid.table_rows(d, columns=fixed.HEADER_COLUMNS, row_limit=fixed.SHEET_ROW_LIMIT)),
        "g7_table_rows_all": on(c.cells, grid.table_rows),
        "g8_sheet_preview": on(c.cells, grid.preview),
        "g9_sheet_summary": on(c.cells, grid.sheet_summary),
        "g10_formula_scan": on(c.cells, grid.formulas),
        "g11_normalise_value": on(c.cells, lambda d: d.select(
            "book", "sheet", "row_idx", "col_idx", cl.normalise(F.col("value"), F.col("kind")).alias("shown"))),
        "g12_workbook_report": on(c.cells, grid.workbook_report),
    }


# ---- markdown --------------------------------------------------------------------------------


def _markdown(rule) -> Query:
    """A text rule over the markdown corpus and the real documents."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return md.apply(rule)(_markdown_docs(spark, sf_dir)).select("doc_id", "text")

    return query


def _markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = c.documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + c.REPORT_IDS_FROM)
    both = c.order_corpus(spark, sf_dir, "mdocs").unionByName(shifted)
    return both.withColumn("file_name", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".docx")))


def markdown_queries() -> dict[str, Query]:
    return {
        "m1_clean_chars": _markdown(md.clean_characters),
        "m2_headers": _markdown(md.headers),
        "m3_toc": _markdown(md.contents_list),
        "m4_merge_fences": _markdown(md.merge_fences),
        "m5_text_tables": _markdown(md.text_tables),
        "m6_pipe_tables": _markdown(md.pipe_tables),
        "m7_lists": _markdown(md.lists),
        "m8_links": _markdown(md.links),
        "m9_code_blocks": lambda s, d: md.code_blocks(_markdown_docs(s, d)).select("doc_id", "text"),
        "m10_escapes": _markdown(md.escapes),
        "m11_final": _markdown(md.final_format),
        "m12_normalise": lambda s, d: md.normalise(_markdown_docs(s, d)).select("doc_id", "text"),
        "m13_doc_quality": on(_markdown_docs, md.quality),
        "m14_markdown_lint": on(_markdown_docs, md.lint),
        "m14_markdown_verdict": on(_markdown_docs, md.verdict),
    }


# ---- streams ---------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """Folder of what the request stream wrote."""
    folder = shared.new_folder(spark)
    _events(spark, sf_dir).write.text(f"{folder}/in")
    jobs.request_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", c.PROCESSED_AT).awaitTermination()
    return f"{folder}/out"


def _request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, sf_dir)
    columns = ["req_id", "file_name", "doc_type", "reason"]
    results_, rejects_ = (jobs.read_batches(spark, out, kind).select(*columns) for kind in ["results", "rejects"])
    return results_.unionByName(rejects_)


def _stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.read_batches(spark, _streamed(spark, sf_dir), "results").select("req_id", "output_format", "result")


def _stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stream's results those whose text SQL can express."""
    return _expressible(jobs.read_batches(spark, _streamed(spark, sf_dir), "results")).select("req_id", "output_format", "reader", "result")


def _arrived_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its own, and the text that the stream has of it."""
    folder = shared.new_folder(spark)
    texts = c.documents(spark, sf_dir).select(F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("body"))
    textfiles.write_documents(texts, f"{folder}/in")
    jobs.file_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", "*.txt").awaitTermination()
    doc_id = F.regexp_extract("file_name", r"doc_(-?\d+)\.txt$", 1).cast("bigint")
    return spark.read.parquet(f"{folder}/out").select(doc_id.alias("doc_id"), "text", "reason")


#: Texts in a file that arrives: a file is one document, which a task holds whole.
FILE_TEXTS = 1_000


def _file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.new_folder(spark)
    c.documents(spark, sf_dir).select("text").write.option("maxRecordsPerFile", FILE_TEXTS).text(f"{folder}/in")
    jobs.file_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", "*.txt").awaitTermination()
    docs = spark.read.parquet(f"{folder}/out").select(F.col("path").alias("doc_id"), "text")
    return lines.line_stats(docs).agg(
        F.sum("non_empty_lines").alias("non_empty_lines"), F.sum("total_words").alias("total_words"))


def stream_queries() -> dict[str, Query]:
    return {"st1_request_stream": _request_stream, "st1_stream_results": _stream_results, "st1_stream_text": _stream_text,
            "st2_file_arrival": _file_stream, "st2_arrived_documents": _arrived_documents}


def all_queries() -> dict[str, Query]:
    return {
        **text_queries(), **ingest_queries(), **dataset_queries(), **tree_queries(), **grid_queries(),
        **markdown_queries(), **rollup_queries(), **stream_queries(),
    }

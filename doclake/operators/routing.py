"""Admission, routing and request validation (``p*``, t8, t9): column expressions, no joins, usable on streams."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions import text as tx
from doclake.operators import text as t
from doclake.sources.registry import DEFAULT, Registry


def request_extension(file_name: Column) -> Column:
    """Extension of a request's file name; requests are stored under a prefix, so a leading dot is no exception."""
    return tx.extension_of(F.concat(F.lit("_"), file_name))


def admit_reason(missing: Column, unreadable: Column, length: Column, ext: Column) -> Column:
    """p1: first failing check of a file, or null. The refused extensions are compared case-sensitively."""
    return (
        F.when(missing, "missing_file")
        .when(unreadable, "unreadable_file")
        .when(length == 0, "empty_file")
        .when(ext == "", "no_extension")
        .when(ext.isin(fixed.REFUSED_EXTENSIONS), "unsupported_extension")
    )


def admit(files: DataFrame) -> DataFrame:
    """p1: files + reason. ``missing``/``unreadable`` come from the listing; a scan only lists what can be read."""
    flag = lambda name: F.col(name) if name in files.columns else F.lit(False)
    return files.withColumn("ext", request_extension(F.col("file_name"))).withColumn(
        "reason", admit_reason(flag("missing"), flag("unreadable"), F.col("length"), F.col("ext"))
    )


def with_reader(files: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """files(…, ext) + reader, document type, fence language and failure policy."""
    return files.withColumns({n: registry.lookup(F.col("ext"), n) for n in ["reader", "doc_type", "fence", "on_error"]})


def route(files: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """p2, t8: files + lower-cased extension and the columns of ``with_reader``."""
    return with_reader(files.withColumn("ext", F.lower(request_extension(F.col("file_name")))), registry)


def is_supported(file_name: Column, registry: Registry = DEFAULT) -> Column:
    """p3: whether the extension has a reader of its own."""
    ext = tx.extension_of(file_name)
    return (ext != "") & registry.supports(ext)


def parse_uri(uris: DataFrame) -> DataFrame:
    """p4: object URI → bucket, key, base name and the first error."""
    uri = F.col("uri")
    bucket = F.regexp_extract(uri, r"^s3://([^/?#]*)", 1)
    key = F.regexp_extract(uri, r"^s3://[^/?#]*/+([^?#]*)", 1)
    return uris.withColumns({
        "is_object_path": F.startswith(F.lower(uri), F.lit("s3://")),
        "scheme_ok": F.startswith(uri, F.lit("s3://")),
        "bucket": bucket,
        "object_key": key,
        "base_name": tx.base_name(key),
    }).withColumn(
        "error",
        F.when(~F.col("scheme_ok"), "invalid_uri").when(F.col("bucket") == "", "no_bucket")
        .when(F.col("object_key") == "", "no_key"),
    )


def object_error_message(code: Column, bucket: Column, key: Column) -> Column:
    """p4: readable message of an object-store error code."""
    def filled(template: Column) -> Column:
        return F.replace(F.replace(template, F.lit("{bucket}"), bucket), F.lit("{key}"), key)

    out = None
    for known, template in fixed.OBJECT_ERRORS:
        hit = code == known
        out = F.when(hit, filled(F.lit(template))) if out is None else out.when(hit, filled(F.lit(template)))
    other = F.concat(F.lit("S3 error ("), code, F.lit(") accessing s3://"), bucket, F.lit("/"), key)
    return out.otherwise(other)


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def validate(requests: DataFrame) -> DataFrame:
    """p5: requests + ``error``, the first failing rule."""
    content, path = _given(F.col("file_content")), _given(F.col("s3_path"))
    fmt = F.coalesce("output_format", F.lit(fixed.DEFAULT_OUTPUT_FORMAT))
    return requests.withColumn(
        "error",
        F.when(~_given(F.col("file_name")), "missing_file_name")
        .when(~content & ~path, "no_source")
        .when(content & path, "two_sources")
        .when(~fmt.isin(fixed.OUTPUT_FORMATS), "bad_output_format")
        .when(path & ~_given(F.col("bucket_name")), "missing_bucket"),
    )


def resolve_options(requests: DataFrame, defaults: dict | None = None) -> DataFrame:
    """p6: options with defaults; the AI format switches its companions on."""
    base = {
        "output_format": fixed.DEFAULT_OUTPUT_FORMAT, "ai_optimized": False, "include_metadata": False,
        "extract_key_sections": False, "max_chunk_size": fixed.DEFAULT_MAX_CHUNK_SIZE, "processing_images": False,
    } | (defaults or {})
    value = lambda n: F.coalesce(F.col(n), F.lit(base[n])) if n in requests.columns else F.lit(base[n])
    out = requests.withColumns({n: value(n) for n in base})
    ai = F.col("output_format") == "markdown_ai"
    return out.withColumns({n: F.col(n) | ai for n in ["ai_optimized", "include_metadata", "extract_key_sections"]})


def options_from_env(env: dict[str, str] | None = None) -> dict:
    """p6, environment variant: job defaults; an unknown output format means markdown."""
    env = os.environ if env is None else env
    on = lambda name: env.get(name, "").lower() == "true"
    fmt = env.get("OUTPUT_FORMAT", fixed.DEFAULT_OUTPUT_FORMAT).lower()
    return {
        "output_format": fmt if fmt in fixed.OUTPUT_FORMATS else fixed.DEFAULT_OUTPUT_FORMAT,
        "ai_optimized": on("AI_OPTIMIZED"),
        "include_metadata": on("INCLUDE_METADATA"),
        "extract_key_sections": on("EXTRACT_KEY_SECTIONS"),
        "max_chunk_size": int(env.get("MAX_CHUNK_SIZE", fixed.DEFAULT_MAX_CHUNK_SIZE)),
    }


def fenced(docs: DataFrame) -> DataFrame:
    """t9: docs + content in a code fence where the format asks for it."""
    return docs.withColumn("content", t.fence_expr(F.col("text"), F.col("fence"), F.col("output_format")))


def render(docs: DataFrame, processed_at: str) -> DataFrame:
    """p7: docs with ``content`` and options → ``result``.

    The analysis runs on the rendered body, and only for the two formats that print it: for the others the
    analysed text is null and every derived column costs nothing.
    """
    stamp = F.lit(processed_at)
    fmt = F.col("output_format")
    front = t.front_matter_expr(F.col("content"), F.col("file_name"), F.col("doc_type"), stamp)
    with_front = (fmt != "markdown_ai") & F.col("ai_optimized") & F.col("include_metadata")
    body = F.when(with_front, F.concat(front, F.col("content"))).otherwise(F.col("content"))
    keep = [c for c in docs.columns if c not in ("text", "content")]
    prepared = docs.select(*keep, body.alias("body")).withColumn(
        "text", F.when(fmt.isin("markdown_ai", "structured_json"), F.col("body"))
    )
    out = t.analysed(prepared)
    result = (
        F.when(fmt == "markdown_ai", t.ai_document_expr(stamp))
        .when(fmt == "structured_json", F.to_json(t.record_expr()))
        .otherwise(F.col("body"))
    )
    return out.select(*keep, result.alias("result"))

"""Per-document text operators (``t*``): row-local, built-in functions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions import text as tx


def counts(docs: DataFrame) -> DataFrame:
    """t1: words and characters of each document."""
    return docs.select(
        "doc_id", tx.word_count(F.col("text")).alias("word_count"), tx.char_count(F.col("text")).alias("char_count")
    )


def language(docs: DataFrame) -> DataFrame:
    """t2: substring-based language flag."""
    return docs.select(
        "doc_id", tx.indicator_hits(F.col("text")).alias("hits"), tx.language_flag(F.col("text")).alias("lang_flag")
    )


def front_matter_expr(text: Column, file_name: Column, doc_type: Column, processed_at: Column) -> Column:
    return F.concat(
        F.lit("---\ndocument_type: "), doc_type,
        F.lit("\nsource_file: "), tx.base_name(file_name),
        F.lit("\nprocessed_at: "), processed_at,
        F.lit("\nword_count: "), tx.word_count(text).cast("string"),
        F.lit("\nchar_count: "), tx.char_count(text).cast("string"),
        F.lit("\nlanguage: "), tx.language_flag(text),
        F.lit("\nai_ready: true\n---\n\n"),
    )


def front_matter(docs: DataFrame, processed_at: str) -> DataFrame:
    """t3: metadata block; the timestamp is a parameter so that a run can be repeated."""
    return docs.select(
        "doc_id",
        front_matter_expr(F.col("text"), F.col("file_name"), F.col("doc_type"), F.lit(processed_at)).alias("front_matter"),
    )


def metrics_expr(text: Column, low: Column | None = None) -> Column:
    """Distinct metric mentions of all classes, sorted (the order is otherwise undefined); ``low`` is the text in lower case."""
    found = [tx.metric_matches(text, k, low) for k in fixed.METRIC_PATTERNS]
    return F.sort_array(F.array_distinct(F.concat(*found)))  # array_sort compares by an interpreted lambda


def metrics(docs: DataFrame) -> DataFrame:
    """t4: distinct numeric mentions as one array per document."""
    return docs.select("doc_id", metrics_expr(F.col("text")).alias("metrics"))


def metric_mentions(docs: DataFrame) -> DataFrame:
    """t4, long form: one row per document, class and distinct mention; still no shuffle."""
    per_kind = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.array_distinct(tx.metric_matches(F.col("text"), k)).alias("found"))
        for k in fixed.METRIC_PATTERNS
    ])
    return (
        docs.select("doc_id", F.explode(per_kind).alias("m"))
        .select("doc_id", F.col("m.kind").alias("kind"), F.explode("m.found").alias("metric"))
    )


def summary_expr(lines: Column) -> Column:
    """First meaningful lines of an array of lines, joined and cut."""
    stripped = F.transform(lines, tx.strip)
    meaningful = F.filter(
        stripped,
        lambda s: (F.char_length(s) > fixed.SUMMARY_MIN_LENGTH)
        & ~tx.any_of(F.startswith(s, F.lit(p)) for p in fixed.SUMMARY_SKIP_PREFIXES),
    )
    return F.array_join(F.slice(meaningful, 1, fixed.SUMMARY_LINES), " ")


def cut(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def summary(docs: DataFrame) -> DataFrame:
    """t5: opening summary of each document."""
    return (
        docs.select("doc_id", tx.lines_of(F.col("text")).alias("lines"))
        .select("doc_id", summary_expr(F.col("lines")).alias("raw"))
        .select("doc_id", cut(F.col("raw"), fixed.SUMMARY_MAX_LENGTH).alias("summary"))
    )


def section_columns(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``section_<kind>`` columns: the last section of each kind, or null. Row-local.

    ``marks`` holds only the keyword lines, so each section is one slice of the line array.
    """
    low = F.col("__low")
    words = [w for words in fixed.SECTION_KEYWORDS.values() for w in words]
    marks = F.filter(
        F.transform(F.split(low, "\n", -1), lambda x, i: F.struct(tx.section_kind(x).alias("kind"), i.alias("at"))),
        lambda m: m["kind"].isNotNull(),
    )
    # most texts have no keyword at all
    lowered = docs if "__low" in docs.columns else docs.withColumn("__low", F.lower("text"))
    marked = lowered.select(*keep, "lines", F.when(tx.contains_any(low, words), marks).alias("marks"))

    def last_at(kind: str) -> Column:
        return F.array_max(F.transform(F.filter("marks", lambda m: m["kind"] == kind), lambda m: m["at"]))

    marked = marked.select("*", *[last_at(k).alias(f"at_{k}") for k in fixed.SECTION_KEYWORDS])

    def body(kind: str) -> Column:
        at = F.col(f"at_{kind}")
        following = F.array_min(F.transform(F.filter("marks", lambda m: m["at"] > at), lambda m: m["at"]))
        length = F.coalesce(following, F.size("lines")) - at
        kept = F.filter(F.slice(F.col("lines"), at + 1, length), lambda x: ~tx.is_blank(x))
        return F.when(at.isNotNull(), tx.joined(kept))

    return marked.select(*keep, "lines", *[body(k).alias(f"section_{k}") for k in fixed.SECTION_KEYWORDS])


def analysed(docs: DataFrame) -> DataFrame:
    """docs + summary, metrics and sections: the inputs of t6 and t7, one pass over the text."""
    keep = docs.columns
    with_lines = docs.withColumns({"lines": tx.lines_of(F.col("text")), "__low": F.lower("text")})
    with_sections = section_columns(with_lines.withColumn("metrics", metrics_expr(F.col("text"), F.col("__low"))), [*keep, "metrics"])
    out = with_sections.withColumn("raw_summary", summary_expr(F.col("lines")))
    return (
        out.withColumn("summary", cut(F.col("raw_summary"), fixed.SUMMARY_MAX_LENGTH))
        .drop("lines", "raw_summary")
    )


def ai_document_expr(processed_at: Column) -> Column:
    """The full annotated document from the columns of ``analysed``."""
    shown = F.slice("metrics", 1, fixed.MAX_METRICS_SHOWN)
    parts = [
        front_matter_expr(F.col("text"), F.col("file_name"), F.col("doc_type"), processed_at),
        F.lit(fixed.AI_SUMMARY_TITLE + "\n"), F.col("summary"), F.lit("\n\n"),
        F.when(
            F.size("metrics") > 0,
            F.concat(
                F.lit(fixed.AI_METRICS_TITLE + "\n- "), F.array_join(shown, "\n- "), F.lit("\n\n"),
            ),
        ).otherwise(""),
    ]
    for kind, title in fixed.AI_SECTION_TITLES.items():
        body = F.col(f"section_{kind}")
        parts.append(F.when(body.isNotNull(), F.concat(F.lit(title + "\n"), body, F.lit("\n\n"))).otherwise(""))
    parts += [F.lit(fixed.AI_CONTENT_TITLE + "\n"), F.col("text"), F.lit(fixed.AI_FOOTER)]
    return F.concat(*parts)


def ai_document(docs: DataFrame, processed_at: str) -> DataFrame:
    """t6: annotated document of each text."""
    return analysed(docs).select("doc_id", ai_document_expr(F.lit(processed_at)).alias("ai_document"))


def record_expr() -> Column:
    """Nested record of a document from the columns of ``analysed``; missing sections are empty strings."""
    section = lambda kind: F.coalesce(F.col(f"section_{kind}"), F.lit(""))
    return F.struct(
        F.struct(
            tx.base_name(F.col("file_name")).alias("source_file"),
            F.col("doc_type").alias("document_type"),
            tx.word_count(F.col("text")).alias("word_count"),
            tx.char_count(F.col("text")).alias("char_count"),
        ).alias("metadata"),
        F.col("summary").alias("summary"),
        F.col("metrics").alias("key_metrics"),
        F.struct(
            section("summary").alias("summary"),
            F.lit("").alias("key_points"),
            section("metrics").alias("metrics"),
            section("recommendations").alias("recommendations"),
        ).alias("sections"),
        F.col("text").alias("full_content"),
    )


def structured_record(docs: DataFrame) -> DataFrame:
    """t7: one nested record per document; ``F.to_json`` of it is the JSON output format."""
    return analysed(docs).select("doc_id", record_expr().alias("record"))


def fence_expr(content: Column, language: Column, output_format: Column) -> Column:
    """t9: code fence around the content for the plain markdown format."""
    return F.when(
        (output_format == "markdown") & language.isNotNull(),
        F.concat(F.lit("```"), language, F.lit("\n"), content, F.lit("\n```")),
    ).otherwise(content)

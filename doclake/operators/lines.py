"""Line-level operators (``l*``).

A document is one row, so its lines are handled as one array: runs of lines are found by blanking the lines that
do not belong and splitting on the gaps. Nothing here shuffles or sorts; a window per document would move every
line across the network to regain an order the text already has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions import text as tx
from doclake.functions.frames import let
from doclake.operators import text as t


def lines(docs: DataFrame) -> DataFrame:
    """l1: one row per line, positions from 1."""
    return docs.select("doc_id", F.posexplode(tx.lines_of(F.col("text"))).alias("p", "line")).select(
        "doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), "line"
    )


def with_lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("lines", tx.lines_of(F.col("text")))


def filled(lines_: Column) -> Column:
    return F.size(F.filter(lines_, lambda x: (x != "") & ~tx.is_blank(x))).cast("bigint")


def line_stats(docs: DataFrame) -> DataFrame:
    """l2: line, word and character totals."""
    return with_lines(docs).select(
        "doc_id",
        F.size("lines").cast("bigint").alias("total_lines"),
        filled(F.col("lines")).alias("non_empty_lines"),
        tx.word_count(F.col("text")).alias("total_words"),
        tx.char_count(F.col("text")).alias("total_chars"),
    )


def runs(masked: Column) -> Column:
    """Runs of non-empty entries of a line array, each joined by newlines, in order."""
    whole = F.btrim(tx.joined(masked), F.lit("\n"))
    return F.filter(F.split(whole, "\n{2,}", -1), lambda r: r != "")


def paragraph_array(lines_: Column, stripped: Column | None = None) -> Column:
    stripped = F.transform(lines_, tx.strip) if stripped is None else stripped
    return F.transform(runs(stripped), lambda r: F.replace(r, F.lit("\n"), F.lit(" ")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """l3: paragraphs numbered from 1."""
    return (
        with_lines(docs)
        .select("doc_id", F.posexplode(paragraph_array(F.col("lines"))).alias("p", "paragraph"))
        .select("doc_id", (F.col("p") + 1).cast("bigint").alias("paragraph_no"), "paragraph")
    )


def headings(docs: DataFrame) -> DataFrame:
    """l4: heading lines with their position."""
    return (
        lines(docs)
        .select("doc_id", "pos", tx.strip(F.col("line")).alias("heading"))
        .filter(tx.is_heading(F.col("heading")))
    )


def heading_array(lines_: Column) -> Column:
    return F.filter(F.transform(lines_, tx.strip), tx.is_heading)


def list_array(lines_: Column) -> Column:
    """Lists of a document: each is its stripped items joined by newlines, at least two items."""
    masked = F.transform(lines_, lambda x: F.when(tx.is_list_line(x), tx.strip(x)).otherwise(""))
    return F.filter(runs(masked), lambda r: F.contains(r, F.lit("\n")))


def lists(docs: DataFrame) -> DataFrame:
    """l5: maximal runs of two or more list lines."""
    return (
        with_lines(docs)
        .select("doc_id", F.posexplode(list_array(F.col("lines"))).alias("p", "items"))
        .select(
            "doc_id",
            (F.col("p") + 1).cast("bigint").alias("list_no"),
            F.size(F.split("items", "\n")).cast("bigint").alias("n_items"),
            "items",
        )
    )


def structure_expr(n_headings: Column, n_lists: Column) -> Column:
    return (
        F.when(n_headings > 0, "structured").when(n_lists > 0, "semi_structured").otherwise("unstructured")
    )


def with_structure(docs: DataFrame) -> DataFrame:
    """docs + lines, headings, lists, paragraphs and structure type, one pass over the text."""
    lines_, stripped = F.col("lines"), F.col("__stripped")
    return (
        with_lines(docs)
        .withColumn("__stripped", F.transform(lines_, tx.strip))
        .withColumn("headings", F.filter(stripped, tx.is_heading))
        .withColumn("lists", list_array(lines_))
        .withColumn("paragraphs", paragraph_array(lines_, stripped))
        .withColumn("structure_type", structure_expr(F.size("headings"), F.size("lists")))
        .drop("__stripped")
    )


def structure(docs: DataFrame) -> DataFrame:
    """l6: structure type with the counts it rests on."""
    return with_structure(docs).select(
        "doc_id",
        F.size("headings").cast("bigint").alias("n_headings"),
        F.size("lists").cast("bigint").alias("n_lists"),
        "structure_type",
    )


def key_sections(docs: DataFrame) -> DataFrame:
    """l7: last section of each kind, long form."""
    cols = t.section_columns(with_lines(docs), ["doc_id"])
    per_kind = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"section_{k}").alias("body")) for k in fixed.SECTION_KEYWORDS
    ])
    return cols.select("doc_id", F.inline(per_kind)).filter(F.col("body").isNotNull())


def rewritten_headings(lines_: Column) -> Column:
    def rewrite(x: Column) -> Column:
        level = lambda s: (
            F.when(tx.is_upper(s), "## ").when(F.endswith(s, F.lit(":")), "### ")
            .when(tx.heading_numbered(s), "#### ").otherwise("### ")
        )
        return let(tx.strip(x), lambda s: F.when(tx.is_heading(s), F.concat(level(s), s)).otherwise(x))

    return tx.joined(F.transform(lines_, rewrite))


def heading_rewrite(docs: DataFrame) -> DataFrame:
    """l8: heading lines as markdown headings."""
    return with_lines(docs).select("doc_id", rewritten_headings(F.col("lines")).alias("content"))


def rewritten_paragraphs(text: Column, paragraphs_: Column) -> Column:
    numbered = F.transform(
        paragraphs_,
        lambda p, i: F.when(
            F.char_length(p) > fixed.PARAGRAPH_MIN_LENGTH,
            F.concat(F.lit("**Paragraph "), (i + 1).cast("string"), F.lit(":**\n"), p),
        ),
    )
    return F.when(F.size(paragraphs_) > 1, F.array_join(numbered, "\n\n")).otherwise(text)


def paragraph_rewrite(docs: DataFrame) -> DataFrame:
    """l9: numbered long paragraphs, or the raw text when there is at most one paragraph."""
    return (
        with_lines(docs)
        .withColumn("paragraphs", paragraph_array(F.col("lines")))
        .select("doc_id", rewritten_paragraphs(F.col("text"), F.col("paragraphs")).alias("content"))
    )


def text_report_expr() -> Column:
    """Report of a text document from the columns of ``with_structure``."""
    n_headings, n_lists = F.size("headings"), F.size("lists")
    shown = fixed.MAX_HEADINGS_SHOWN
    header = F.concat(
        F.lit(fixed.TEXT_TITLE + "\n- **File:** "), tx.base_name(F.col("file_name")),
        F.lit("\n- **Structure Type:** "), F.initcap(F.replace("structure_type", F.lit("_"), F.lit(" "))),
        F.lit("\n- **Lines:** "), F.size("lines").cast("string"),
        F.lit(" total, "), filled(F.col("lines")).cast("string"),
        F.lit(" with content\n- **Words:** "), tx.thousands(tx.word_count(F.col("text"))),
        F.lit("\n- **Characters:** "), tx.thousands(tx.char_count(F.col("text"))),
        F.lit("\n- **Paragraphs:** "), F.size("paragraphs").cast("string"),
        F.lit("\n\n"),
    )
    outline = F.when(
        n_headings > 0,
        F.concat(
            F.lit(fixed.TEXT_STRUCTURE_TITLE + "\n- "), F.array_join(F.slice("headings", 1, shown), "\n- "), F.lit("\n"),
            F.when(
                n_headings > shown,
                F.concat(F.lit("- ... and "), (n_headings - shown).cast("string"), F.lit(" more sections\n")),
            ).otherwise(""),
            F.lit("\n"),
        ),
    ).otherwise("")
    listing = F.when(
        n_lists > 0,
        F.concat(
            F.lit(fixed.TEXT_LISTS_TITLE + "\nFound "), n_lists.cast("string"),
            F.lit(" structured lists in the document.\n\n"),
        ),
    ).otherwise("")
    content = F.when(F.col("structure_type") == "structured", rewritten_headings(F.col("lines"))).otherwise(
        rewritten_paragraphs(F.col("text"), F.col("paragraphs"))
    )
    return F.concat(header, outline, listing, F.lit(fixed.TEXT_CONTENT_TITLE + "\n\n"), content)


def text_report(docs: DataFrame) -> DataFrame:
    """l10: analysis header and rewritten content of a text document."""
    return with_structure(docs).select("doc_id", text_report_expr().alias("report"))

"""Hand-written cases for text and line rules that are easy to get wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions import predicates as pr
from doclake.functions import text as tx
from doclake.operators import lines, tabular, text


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_strip_is_unicode(spark):
    assert column(spark, ["\t\xa0 a b\u3000\x1f", "\u2028", "x"], tx.strip) == ["a b", "", "x"]


def test_word_count_splits_on_unicode_space(spark):
    assert column(spark, ["a\xa0b\u2003c  d\n", "", " \t"], tx.word_count) == [4, 0, 0]


def test_upper_case(spark):
    assert column(spark, ["ÉÀ 12", "12", "Ab", "ß", "ABC-1"], tx.is_upper) == [True, False, False, False, True]


def test_extension(spark):
    names = ["a.txt", "x/y.z/name", ".bashrc", "a.b.", "A.TAR.gz", "..a", "noext", "dir.d/.hidden.yml"]
    assert column(spark, names, tx.extension_of) == ["txt", "", "", "", "gz", "", "", "yml"]


def test_numbers(spark):
    values = ["1", " 1,234.5 ", "1e5", "1_000", "nan", "-inf", "1d", "1__0", "", ".", ".5", "5.", "0x1", "Infinity"]
    assert column(spark, values, pr.is_number) == [
        True, True, True, True, True, True, False, False, False, False, True, True, False, True]


def test_dates_match_a_prefix(spark):
    values = ["2024-01-31T10", "31/12/2024", "01-02-2024 x", "2024/01/01", "24-01-01"]
    assert column(spark, values, pr.is_date) == [True, True, True, False, False]


@pytest.mark.parametrize("body,expected", [
    ("5 millón", ["5 mil"]),
    ("$1234567.891", ["$1234567.89"]),
    ("3 AÑOS y 3 años", ["3 AÑOS", "3 años"]),
    ("50% de 50% y 1,000 thousand", ["1,000 thousand", "50%"]),
    ("٣% ok", ["٣%"]),
])
def test_metrics(docs_of, value_of, body, expected):
    assert value_of(text.metrics(docs_of(body)), "metrics") == [expected]


def test_language_needs_more_than_five(docs_of, value_of):
    five = "el de que y en "
    assert value_of(text.language(docs_of(five, five + "un ")), "lang_flag") == ["en", "es"]
    # word ends count: "la " holds "a " as well
    assert value_of(text.language(docs_of("el la de que y ")), "hits") == [6]


def test_last_section_of_a_kind_wins(docs_of):
    body = "intro\nResumen uno\n\na\n  \nResultados\nb\nSummary dos\nc"
    got = {r.kind: r.body for r in lines.key_sections(docs_of(body)).collect()}
    assert got == {"summary": "Summary dos\nc", "metrics": "Resultados\nb"}


def test_keyword_order(docs_of):
    got = {r.kind: r.body for r in lines.key_sections(docs_of("conclusion con resultados\nx")).collect()}
    assert got == {"recommendations": "conclusion con resultados\nx"}


def test_summary_skips_and_cuts(docs_of, value_of):
    long = "x" * 300
    body = f"# a heading line\nshort\n---- a rule line\n{long}\n{long}\n"
    assert value_of(text.summary(docs_of(body)), "summary") == [(long + " " + long)[:500] + "..."]


def test_headings(docs_of):
    body = "2024 was good.\nTOTAL.\nCost:\nA plain title\nNot a title.\n" + "A" * 100 + "\nminuscula"
    assert [r.heading for r in lines.headings(docs_of(body)).orderBy("pos").collect()] == [
        "2024 was good.", "TOTAL.", "Cost:", "A plain title"]


def test_lists_use_raw_lines(docs_of):
    body = "- a\n  2. b\nA letter start\n\n* alone\n\n• x\n• y"
    got = [(r.n_items, r.items) for r in lines.lists(docs_of(body)).orderBy("list_no").collect()]
    assert got == [(3, "- a\n2. b\nA letter start"), (2, "• x\n• y")]


def test_paragraphs(docs_of, value_of):
    body = "\n\n  a\nb \n \t\n\nc\n"
    assert value_of(lines.paragraphs(docs_of(body)), "paragraph", "paragraph_no") == ["a b", "c"]


def test_paragraph_rewrite_may_be_empty(docs_of, value_of):
    assert value_of(lines.paragraph_rewrite(docs_of("a\n\nb", "one")), "content") == ["", "one"]


def test_line_stats_of_empty_and_blank(docs_of):
    got = [tuple(r) for r in lines.line_stats(docs_of("", "a\n\n")).orderBy("doc_id").collect()]
    assert got == [(1, 1, 0, 0, 0), (2, 3, 1, 1, 3)]


def test_ai_document_parts(docs_of, value_of):
    doc = value_of(text.ai_document(docs_of("Resumen\nel 5% sube mucho hoy"), "T"), "ai_document")[0]
    assert doc.startswith("---\ndocument_type: text_document\nsource_file: doc_1.txt\nprocessed_at: T\nword_count: 6\n")
    assert "## 📊 Key Metrics\n- 5%\n\n## 📋 Executive Summary\nResumen\nel 5% sube mucho hoy\n\n## 📖" in doc
    assert "Recommendations" not in doc


def test_results_do_not_depend_on_partitions(docs_of):
    docs = docs_of(*[f"Resumen {i}\n- a\n- b\n\n{i}%" for i in range(40)])
    rows = lambda n: sorted(map(str, lines.key_sections(docs.repartition(n)).collect()))
    assert rows(1) == rows(7)


def test_text_operators_do_not_shuffle(docs_of):
    docs = docs_of("a")
    for op in [lines.key_sections, lines.lists, lines.paragraphs, lines.text_report, text.metric_mentions]:
        plan = op(docs)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_cells_are_classified_in_one_look(spark):
    rows = [(" 1,5 ", " 2024-01-02x", " ", "7\n", None), ("\n-2e3 ", "01/02/2024", "　", "2024-01-01", ""), ("", None, None, "8", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    types = tabular.column_types(df, sample_rows=None)
    assert [r.data_type for r in types.orderBy("col_idx").collect()] == ["Numeric", "Date", "Numeric", "Text", "Numeric"]
    assert [r.data_type for r in tabular.column_types(df.limit(0), sample_rows=None).collect()] == ["Numeric"] * 5
    plan = types._jdf.queryExecution().optimizedPlan().toString()
    assert "trim" not in plan and "bool_and" not in plan and plan.count("RLIKE") <= 15


def test_white_space_classes_hold_every_white_space_character(spark):
    chars = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = df.select("c", F.col("c").rlike(rf"\A{tx.SPACE}\z").alias("ws"), F.col("c").rlike(rf"\A{tx.NOT_SPACE}\z").alias("other")).collect()
    assert {r.c for r in got if r.ws} == set(tx.WHITESPACE) and all(r.ws != r.other for r in got)


def test_metrics_equal_the_plain_patterns(spark):
    import random

    r = random.Random(3)
    parts = ["1", "22", "333", "4444", "٣", ",", ".", "%", "$", " ", "\n", "\xa0", "mil", "Millones", "thousand", "años", "AÑO", "year", "meses", "x"]
    df = spark.createDataFrame([("".join(r.choices(parts, k=r.randint(0, 25))),) for _ in range(6000)], "text string")
    for kind, pattern in fixed.METRIC_PATTERNS.items():
        plain = F.regexp_extract_all("text", F.lit("(?iu)" + tx.unicode_regex(pattern)), F.lit(1))
        both = df.select(plain.alias("plain"), tx.metric_matches(F.col("text"), kind).alias("got"))
        assert both.filter("plain <> got").count() == 0 and both.filter("size(plain) > 0").count() > 100
        # a number is tried from its first digit only
        assert kind == "money" or "(?<!" in both._jdf.queryExecution().optimizedPlan().toString()

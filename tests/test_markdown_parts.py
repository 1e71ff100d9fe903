"""The markdown rules look at blocks, not at each line, and find the same as the rules for one line."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doclake.functions import text as tx
from doclake.operators import markdown as md

LINES = [
    "", " ", "\t", "\x85", "```", " ```json ", "\xa0```js", "{", "{}", "[1,", '{"a": 1,', '"b": 2}', '"a" :', 'x: "y"', ':"', "Key: v", "Key:\t", "Key:  ", "Key:\xa0v",
    "GET /x", "GET /x", "GET  x", "HTTP/1.1", "<a>", "<a", "< a>", "a = b: \"c\"", "__A__ __B__", "__A__ __ __", "__ __a__ __b__", "____a__b__", "__A__ *b* *c*",
    "__A__   __B__", "*a* *b*", "* * *b* *c*", "**a*b*", "*a* *b", "a   b", "a  b", "a\xa0\xa0b", "a\xa0 \xa0b", "a\tb", "a\x1c\tb", "a b  ", "\t a", "x|y", "|x|", "| |x| |y", "||",
    "1\\. uno", " ٣\\.  dos ", "1\\.", "•", " • a ", "\t• a", "· · b", "#a\\#b", " # a\\.b", "\\#a\\@", "c\\.d\\:", "http\\://x\\.y", "www\\.a\\/b", "🙂 🙂",
]


def lines_table(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "doc_id bigint, text string")


@pytest.mark.parametrize("start, rule", [
    (md.HEADER_START, lambda x: md.table_headers(tx.strip(x)).isNotNull()),
    (md.ROW_START, lambda x: md.row_values(tx.strip(x)).isNotNull()),
    (md.CODE_START, lambda x: md.code_features(x)["starts"].isNotNull() & ~md.code_features(x)["fence"]),
    (md.FENCE_START, lambda x: md.code_features(x)["fence"]),
], ids=["header", "row", "code", "fence"])
def test_a_start_is_found_as_by_the_rule_for_one_line(spark, start, rule):
    x = F.col("text")
    rows = lines_table(spark).select("text", md.begins(F.concat(x, F.lit("\n")), start).alias("got"), F.coalesce(rule(x), F.lit(False)).alias("expected")).collect()
    assert [r.text for r in rows if r.got != r.expected] == [] and {r.got for r in rows} == {True, False}


@pytest.mark.parametrize("quick, plain", [
    (md.lists, md.per_line(md.list_line)), (md.escapes, md.per_line(md.escape_line)),
    (lambda t: F.coalesce(md._coded(t), md._coded_by_lines(t)), md._coded_by_lines),
], ids=["lists", "escapes", "code"])
def test_whole_texts_come_out_as_line_by_line(spark, docs_of, quick, plain):
    texts = LINES + ["\n".join(LINES[i:i + n]) for n in (2, 3, 7, len(LINES)) for i in range(0, len(LINES) - n + 1)]
    texts += ["Key: v\n" + "x\n" * n + "{\n}\nend" for n in (47, 48, 49, 50)] + ["{[\n" + "x\n" * n + "]}\nend" for n in (46, 47, 48, 49)]
    rows = docs_of(*texts).select("text", quick(F.col("text")).alias("got"), plain(F.col("text")).alias("expected")).collect()
    assert [(r.text, r.got) for r in rows if r.got != r.expected] == []


def test_plain_lines_are_one_part(docs_of):
    plain = "plain words\n" * 20_000
    text = F.col("text")
    for start, block in [(md.HEADER_START, "__A__ __B__\n*1* *2*\n"), (f"{md.FENCE_START}|{md.CODE_START}", "Key: v\nmore\n\n")]:
        kinds = rf"{md.HEADER_START}{md.LINE}(?:{md.ROW_START}{md.LINE})++" if "A__" in block else rf"{md.CODE_START}{md.LINE}(?:(?!{md.BLANK}){md.LINE})*+{md.LINE}"
        parts = docs_of(plain + block + plain).select(md.parts_of(text, kinds, start).alias("p")).collect()[0].p
        assert parts == [plain, block, plain + "\n"]


def test_json_that_leaves_code_behind_is_read_line_by_line(docs_of):
    text = F.col("text")
    rows = docs_of("{ }\nx\n\nend", "{ }\nx\nKey: v\n\nend").select(md._coded(text).alias("c")).collect()
    assert [r.c for r in rows] == ["```json\n{ }\nx\n```\n\nend", None]


def test_long_lines_and_many_lines_need_no_stack(docs_of, value_of):
    long_line = "a*b_c|d \\x " * 30_000
    body = "\n".join([long_line, "", "word\n" * 50_000, "__A__ __B__", "*1* *2*\n" * 5_000, '"k": 1', "end."])
    got = value_of(docs_of(body).transform(md.normalise), "text")[0]
    assert got.count("| 1 | 2 |") == 5_000 and got.endswith('```yaml\n"k": 1\nend.\n```')

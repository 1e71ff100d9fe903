"""What rendered results no longer pay for: plans and steps, with the same results as plain Python."""

from __future__ import annotations

import base64
import random

import pyarrow as pa
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions import text as tx
from doclake.operators import csvdocs, text
from doclake.sources import requests as rq
from doclake.sources import trees as src

PARTS = ["1", "22", ",", ".", "%", "$", " ", "\n", "\t", "\xa0", " ", "\x1c", "mil", "MİL", "mıl", "thouſand", "años", "AÑO", "year", "meſes", "x", "é", "😀", "kpi"]


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_base64_in_lines_is_decoded_without_a_look_at_each_character(spark):
    r = random.Random(5)
    data = [r.randbytes(n) for n in range(200)]
    rows = [(i, base64.encodebytes(d).decode().replace("\n", end)) for i, d in enumerate(data) for end in ("\n", "\r\n", "")]
    df = spark.createDataFrame(rows, "i int, c string").select("i", rq.decoded(F.col("c")).alias("b"))
    assert all(bytes(x.b) == data[x.i] for x in df.collect())
    plan = _optimized(df)
    assert "unbase64(lambda" in plan and "replace(c" in plan


def test_words_and_metrics_of_odd_texts(spark):
    r = random.Random(7)
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 30))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = text.metrics_expr(F.col("text"))
    plain = [F.regexp_extract_all("text", F.lit("(?iu)" + tx.unicode_regex(p)), F.lit(1)) for p in fixed.METRIC_PATTERNS.values()]
    got = df.select("text", tx.word_count(F.col("text")).alias("n"), found.alias("found"), F.array_sort(F.array_distinct(F.concat(*plain))).alias("plain"))
    rows = got.collect()
    assert all(x.n == len(x.text.split()) and x.found == x.plain for x in rows) and sum(bool(x.found) for x in rows) > 300
    assert "array_sort" not in _optimized(df.select(found))  # it compares by an interpreted lambda


def test_csv_without_quotes_is_split(spark):
    r = random.Random(9)
    texts = ["".join(r.choices(["a", "b", ",", "\n", " ", '"', "é"] if i % 2 else ["a", ",", "\n", " "], k=r.randint(0, 20))) for i in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", csvdocs.rows(F.col("text")).alias("rows"))
    for x in df.collect():
        if '"' not in x.text:
            assert x.rows == [line.split(",") if line else [] for line in x.text.removesuffix("\n").split("\n")] if x.text else x.rows == []
    assert "split(" in _optimized(df)


def test_xml_that_no_report_shows_is_checked_only(monkeypatch):
    def parsed(raw: str, asked: bool) -> tuple:
        held = src._Parsed({"nodes": {"kind": pa.string()}}, {"xml": pa.null(), "tree": pa.null()})
        held.add("xml", raw, None, asked)
        return held.status[0], held.error[0], held.xml[0]

    texts = ["<a><b/></a>", "<a>", "<a>&x;</a>", "", "<a xmlns:k='u'><k:b/></a>", "<a><z:b/></a>"]
    want = [parsed(t, True) for t in texts]
    assert [w[0] for w in want] == ["ok", "malformed", "malformed", "malformed", "ok", "malformed"] and want[0][2]["total"] == 2
    monkeypatch.setattr(src, "xml_summary", lambda text: 1 / 0)
    assert [parsed(t, False) for t in texts] == [(*w[:2], None) for w in want]

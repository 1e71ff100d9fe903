"""Operators that judge each row by itself: decontamination, pseudonyms, quality rules, BPE, page text, classifier."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_DIR

from doclake.llm import bpe, decontaminate, html_extract, pii, quality_model, quality_rules

DOCS = "doc_id bigint, text string"
KEY = "k"


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- 1 ----------------------------------------------------------------------------------------


def brute_hits(docs, items, n=10):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            if item_id is None or not v:
                continue
            k = min(n, len(v))
            grams = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in grams:
                    hit |= set(range(i, i + k))
                    named.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEM = "One two three, four five six seven eight nine ten eleven twelve"
CONTAMINATION = [
    (1, "x ONE two-three four five six seven eight nine ten eleven y"), (2, None), (3, ""), (4, "...!"), (None, ITEM + " " + ITEM),
    (5, "short item"), (5, "short item"), (6, "éa short  ITEM é"), (7, "one two three four five six seven eight nine x ten"),
]
ITEMS = [(10, ITEM), (9, "Short item!"), (2, "short ITEM"), (3, None), (4, "  "), (None, "never named item")]


@pytest.mark.parametrize("bound", [100_000, 2])
def test_decontamination_equals_brute_force(spark, bound):
    docs = spark.createDataFrame([(*r, 0, "x") for r in CONTAMINATION], DOCS + ", n_words int, gram string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert sorted(rows(decontaminate.report(docs, items, bound=bound)), key=str) == brute_hits(CONTAMINATION, ITEMS)
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert decontaminate.report(docs, items.limit(0)).filter("contaminated").count() == 0


def test_decontamination_removes_spans_or_documents(spark):
    docs = spark.createDataFrame(CONTAMINATION, DOCS)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert sorted(r[0] for r in rows(decontaminate.remove(docs, items))) == [2, 3, 4, 7]
    spans = decontaminate.remove(docs, items, mode="spans")
    got = {r[0]: r[1] for r in rows(spans)}
    assert got[1].split() == ["x", "y"] and got[6].split() == ["éa", "é"] and got[7] == CONTAMINATION[-1][1] and got[2] is None
    assert not any(r[5] for r in rows(decontaminate.report(spans, items)))


# ---- 3 ----------------------------------------------------------------------------------------


def luhn(digits):
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    values = ["4111 1111 1111 1111", "jo.e+1@mail7.example.com", "123-45-6789", "1985-03-12", "31/12/1999", "12/25/2001", "10.0.255.7",
              "+1 (017) 555-7713", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "GB82 WEST 1234 5698 7654 32"]
    kept = ["4111 1111 1111 1112", "666-45-6789", "1985-02-30", "300.1.1.1", "v2.0", "2024", "a@b", "99/99/2001"]
    docs = spark.createDataFrame(
        [(i, f"é {v}, then {v}!") for i, v in enumerate(values)] + [(50 + i, f"x {v} y") for i, v in enumerate(kept)]
        + [(90, None), (91, ""), (92, values[0]), (92, values[0])], DOCS).selectExpr("*", "'mine' AS pii", "1 AS n_pii")
    got = rows(pii.report(docs, KEY))
    by_id = {r[0]: r for r in got}
    for i, v in enumerate(values):
        a, b = re.fullmatch(r"(?s)é (.*), then (.*)!", by_id[i][1]).groups()
        assert a == b != v and len(by_id) and by_id[i][2] == 2
        if "@" not in v and v.count(".") != 3:
            assert re.sub(r"[0-9]", "9", re.sub("[a-f]", "9", a)) == re.sub(r"[0-9]", "9", re.sub("[a-f]", "9", v)) or "WEST" in v
    card = re.search(r"\d[\d ]{17}\d", by_id[0][1])[0]
    assert luhn([int(c) for c in card if c != " "]) and by_id[92][1] == card
    iban = by_id[9][1][2:29].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    for i, v in enumerate(kept):
        assert by_id[50 + i][1] == f"x {v} y" and by_id[50 + i][2] == 0
    assert by_id[90][1] is None and by_id[91][1] == "" and len(got) == 22
    assert rows(pii.report(docs.filter("doc_id = 0"), "other"))[0][1] != by_id[0][1]
    assert pii.pseudonymise(docs, KEY).columns == ["doc_id", "text", "n_pii", "pii"] and pii.report(docs.limit(0), KEY).count() == 0


def test_values_beside_other_numbers_are_found(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    bare = card.replace(" ", "")
    cases = [(f"{card} 12/27", [card]), (f"Visa {bare} 100 EUR", [bare]), (f"Order 12 {bare}", [bare]), (f"{bare} 555-123-4567", [bare, "555-123-4567"]),
             (f"{iban} ON 3 May", [iban]), (f"{iban.replace(' ', '')} 2024-01-02", [iban.replace(" ", ""), "2024-01-02"]),
             (f"1234 {card} 5678", [card]), (f"{bare} 5500000000000004", [bare, "5500000000000004"]), (f"AB12 {card}", [card]),
             (f"{bare} 12.05.2024", [bare, "12.05.2024"]), ("3782-822463-10005 7", ["3782-822463-10005"]), (f"12 345 {card}", [card]),
             (f"{bare}@mail.example.com", [f"{bare}@mail.example.com"]), ("41111111111111111234567", []), (f"{card[:-1]}2 12", [])]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, (t, _) in enumerate(cases)] + [(100 + i, v) for i, v in enumerate([card, bare, iban])], DOCS)
    got = {r.doc_id: r for r in pii.report(docs, KEY).collect()}
    for i, (t, values) in enumerate(cases):
        assert got[i].n_pii == len(values), (t, got[i].text)
        pattern = re.escape(f"x {t} y")
        for v in values:
            assert v not in got[i].text, (t, got[i].text)
            pattern = pattern.replace(re.escape(v), "(.{%d})" % len(v))
        assert re.fullmatch(pattern, got[i].text), (t, got[i].text)
    assert got[100].text in got[0].text and got[101].text in got[1].text and got[102].text in got[4].text


def test_pseudonyms_are_a_permutation(spark):
    numbers = spark.range(0, 900).selectExpr("id AS doc_id", "concat('2001-01-01 ', date_format(date_add(date'2000-01-01', cast(id AS int)), 'yyyy-MM-dd')) AS text")
    assert pii.report(numbers, KEY).select("text").distinct().count() == 900


# ---- 4 ----------------------------------------------------------------------------------------


def brute_counts(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed)


def test_quality_counts_equal_brute_force(spark):
    good = "\n".join(f"Line{i} has{i} its{i} own{i} words{i} only{i}, none{i} of{i} others{i}." for i in range(9))
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", good, good + "\n" + "| x " * 200, "#x " * 60, good.upper().replace(".", "!! !!"), "é ü 😀\nx\nx\n x",
             "w " * 4000, good + "\nAll rights reserved."]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "false AS kept", "'c' AS cleaned")
    got = {r[0]: tuple(r[1:]) for r in rows(quality_rules.report(docs))}
    for i, t in enumerate(texts):
        assert got[i][:6] == brute_counts(t), t
    assert [i for i in got if got[i][-1]] == [5, 11]
    cleaned = {r.doc_id: r.cleaned for r in quality_rules.judged(docs).select("doc_id", "cleaned").collect()}
    assert cleaned[11] == good and cleaned[0] is None and cleaned[6] == good
    assert quality_rules.report(docs.limit(0)).count() == 0


# ---- 6 ----------------------------------------------------------------------------------------


def test_bpe_equals_the_library_and_round_trips(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoding(path, pattern)
    texts = [None, "", "a", "don't  stop 123abc", "é😀  x" * 900, " " * 3000 + "word" + "\n" * 2500, "x" * 5000, "ab " * 20000, "\t\x1c" * 1500 + "q",
             "<|endoftext|> is text", "y \n" + " " * 1000 + "z" + "　" * 1200]
    for t in texts:
        assert bpe.encode(enc, t or "", 500) == enc.encode_ordinary(t or "")
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "1 AS tokens", "2 AS decoded")
    got = {r.doc_id: r for r in bpe.digests(docs, path, pattern).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.tokenize(docs, path, pattern), path, pattern).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back) and bpe.digests(docs.limit(0), path, pattern).count() == 0


# ---- 8 ----------------------------------------------------------------------------------------


def page(body, nav="Home"):
    return (f"<html><head><title>t</title><style>p{{}}</style><script>var t='<p>';</script></head><body><nav><ul><li>{nav}</ul></nav>"
            f"<div class='ad-box'>Buy</div><article>{body}</article><aside>More</aside><section id=comments><p>First!</p></section>"
            "<form><label>Name</label></form><footer>&copy; all</footer></body></html>")


def test_page_text(spark):
    cases = {
        1: (page("<h1>A &amp; B</h1><p>One\n two<br>three <b>bold</b><p>Last &lt;x&gt;"), "A & B\n\nOne two three bold\n\nLast <x>"),
        2: (None, ""), 3: ("", ""), 4: ("plain &am", "plain &am"), 5: (page("<p>cut &amp"), "cut &"),
        6: ("<body><div class=menu>M</div><div><p>Kept</div><p hidden>no", "Kept"), 7: (page("<p>x</p>") + "<!-- open", "x"),
        8: ("<article><header><h1>T</h1></header><ul><li>a<li>b</ul><!-- c --><p>d</article>", "T\n\na\n\nb\n\nd"),
    }
    pages = spark.createDataFrame([(i, None if i == 4 else "http://h.example/x", h, "mine") for i, (h, _) in cases.items()] * 2,
                                  "page_id bigint, url string, html string, n_chars string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 2 * len(cases) and all(r.text == cases[r.page_id][1] and r.n_chars == len(r.text) for r in got)
    assert html_extract.report(pages.limit(0)).count() == 0


def test_template_text_goes_where_no_article_is_marked(spark):
    body = lambda i: (f"<body><div><p>Site name</p><p>Motto of it</p><div>Contact here</div></div><div><p>Story {i} begins.</p><p>And {i} ends.</p></div>"
                      "<div><p>Bottom line</p></div></body>")
    pages = spark.createDataFrame([(i, "https://a.example/p", body(i)) for i in range(8)] + [(99, "https://b.example/", body(99))], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.report(pages).collect()}
    assert all(got[i] == f"Story {i} begins.\n\nAnd {i} ends." for i in range(8)) and got[99].startswith("Site name")


def test_template_decides_inside_articles_and_outside(spark):
    menu = "<div><p>Site name</p><p>Motto of it</p></div>"
    inside = lambda i: (f"<body>{menu}<article><p>Share this story</p><p>Story {i} begins.</p><p>And {i} ends.</p><p>Share this story</p></article>"
                        "<div><p>Bottom line</p></div></body>")
    beside = lambda i: f"<body>{menu}<article><p>Teaser {i}</p></article><div><p>Long story {i}.</p></div></body>"
    # a share of its host far under half, an article that the host has five times with other menus, copies of one page
    few = lambda i: f"<body><div><p>Shop</p><p>Cart</p><p>Till</p></div><div><p>Article {i}</p></div></body>"
    again = lambda i: f"<body><div><p>Menu {i}</p></div><article><p>One.</p><p>Two {i}.</p><h2>Three.</h2><p>Four.</p></article></body>"
    copied = "<body><div><p>A</p><p>B</p><p>C</p></div></body>"
    pages = spark.createDataFrame(
        [(i, "https://a.example/p", inside(i)) for i in range(8)] + [(10 + i, "https://b.example/", beside(i)) for i in range(6)]
        + [(20 + i, "https://c.example/", few(i) if i < 6 else f"<p>Other {i}") for i in range(40)]
        + [(70 + i, "https://d.example/", again(i) if i < 5 else f"<p>Other {i}") for i in range(15)]
        + [(100 + i, "https://e.example/", copied) for i in range(5)], "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.report(pages).collect()}
    assert all(got[i] == f"Story {i} begins.\n\nAnd {i} ends." for i in range(8))
    assert all(got[10 + i] == f"Teaser {i}\n\nLong story {i}." for i in range(6))
    assert all(got[20 + i] == (f"Article {i}" if i < 6 else f"Other {i}") for i in range(40))
    assert all(f"One.\n\nTwo {i}.\n\nThree.\n\nFour." in got[70 + i] for i in range(5))
    assert all(got[100 + i] == "A\n\nB\n\nC" for i in range(5))


def test_classes_count_where_they_are_ordered_and_nested():
    tokens = html_extract.template_tokens
    assert tokens([1, 9, 4, 5, 6, 8, 2, 3], [[1, 2, 3], [4, 5, 6]]) == {1, 2, 3, 4, 5, 6}
    assert tokens([1, 4, 2, 5, 3, 6], [[1, 2, 3], [4, 5, 6]]) == {1, 2, 3}
    assert tokens([2, 1, 3, 4, 5, 6], [[1, 2, 3], [4, 5, 6]]) == {4, 5, 6} and tokens([1, 2], [[1, 2, 3]]) == set()


def test_names_are_evidence_only():
    text = lambda page: html_extract._text(page, None)
    for opened in ('<div class="content has-sidebar">', '<div id="search-page">', '<section class="related-work">', '<div class="sidebar">', '<div id=modal>'):
        assert text(f"<body>{opened}<article><p>Long story.</p></article><div class=sidebar>More</div></div>") == "Long story.", opened
        assert text(f"<body>{opened}<p>Long story told.</p></div><div class='share-buttons'>Share</div>") == "Long story told.", opened
    assert text('<article><div class="entry-header"><h1>T</h1></div><p class="notice">Note.</p><p>Body.</p><div class="relatedPosts">R</div></article>') == "T\n\nNote.\n\nBody."
    assert text('<div class="site-header">S</div><main>Body</main><ul class="comment-list"><li>C</ul><p class="cookie-banner">K') == "Body"
    assert text('<article>Body <span class="ad">Buy</span> text</article>') == "Body\n\ntext"


# ---- 9 ----------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.report(docs, labels).join(labels, "doc_id").collect()
    tested = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len(tested) > 50 and np.mean([r.predicted == r.quality for r in tested]) > 0.93


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "Some words here.", 5), (2, "x" * 100_000, 5), (2, "x" * 100_000, 5)], DOCS + ", score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id bigint, quality int")
    got = rows(quality_model.report(docs, labels))
    assert len(got) == 5 and [r[2] for r in got if r[0] == 1] == [0.0, 0.0]
    assert quality_model.report(docs.limit(0), labels.limit(0)).count() == 0
    assert quality_model.accepted(docs, labels.limit(0)).columns == docs.columns


def test_sf_dir_queries_return_a_row_for_each_document(spark):
    from doclake.llm.queries import all_queries

    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for name, query in all_queries().items():
        if name != "op8_html_extract":
            assert query(spark, SF_DIR).count() == n, name


def test_the_most_frequent_word_is_counted_wherever_it_stands():
    """One word put in front changes no feature of a long text by much; a frequent word counts wherever it stands."""
    at = quality_model.FEATURES.index("top_word")
    words = [f"w{i}" for i in range(300)]
    spots = list(range(0, 300, 3))
    for k in spots:
        words[k] = "same"
    for text in (" ".join(words), "front " + " ".join(words), " ".join(words[1:])):
        assert abs(quality_model.features(text)[at] - 1 / 3) < 0.01


def test_one_model_of_repeated_ids(spark):
    rows = [(i, ("good words in a line. " if i % 2 else "x# x# x# ") * (3 + i % 5)) for i in range(60)] * 2 + [(i, "another text") for i in range(0, 60, 7)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    models = [quality_model.train(spark.createDataFrame(rows[k:] + rows[:k], "doc_id bigint, text string").repartition(3 + k), labels) for k in (0, 5)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias


def test_deeply_nested_pages_take_linear_time_and_memory():
    import time
    import tracemalloc

    for piece in ("<div>x", "<div class='ad'>x", "<b>x</i>", "<p class=menu>x"):
        page = piece * 25_000
        tracemalloc.start()
        start = time.time()
        text = html_extract._text(page, None)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.time() - start < 60 and peak < 300 << 20, piece
        assert set(text) <= set("x \n")


def test_pages_of_a_large_host_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "LARGE", 5)
    monkeypatch.setattr(html_extract, "SALTS", 4)
    page = lambda i: f"<html><body><div>home</div><div>about us</div><div>mail</div><article><p>Story {i} of many.</p></article><div>end of page</div></body></html>"
    pages = spark.createDataFrame([(i, f"http://big.example/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://s{i}.example/", page(i)) for i in range(4)],
                                  "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.report(pages).collect()}
    assert all(got[i] == f"Story {i} of many." for i in range(40)) and all(f"Story {i} of many." in got[100 + i] for i in range(4)) and len(got) == 44

"""Operators that compare rows with each other: near-duplicates, suffixes, shards, passages; and the pipeline."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR

from doclake.llm import blocks, linking, near_dedup, sharding, shingles, substring_dedup, suffix_dedup
from doclake.llm.common import written

DOCS = "doc_id bigint, text string"


def prose(seed, n):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefghijklmnop"), r.integers(2, 8))) for _ in range(400)]
    return " ".join(w + ("." if r.random() < 0.1 else "") for w in r.choice(words, n))


def edited(text, *places):
    w = text.split()
    for p in places:
        w[p] = "edited"
    return " ".join(w)


# ---- linking ----------------------------------------------------------------------------------


def test_components_equal_union_find(spark):
    r = np.random.default_rng(1)
    links = [tuple(map(int, r.integers(0, 300, 2))) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = dict(tuple(x) for x in linking.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {x: top(x) for x in parent}


def test_connect_finds_every_link_of_a_bucket(spark):
    """Members are similar to their neighbours on a line only, so no leader sees all of them."""
    members = spark.createDataFrame([(7, i) for i in range(30)] + [(8, i) for i in range(100, 106)] + [(9, 500)], "bucket bigint, id bigint")
    near = lambda pairs: pairs.filter("b - a <= 2 AND a < 100")
    got = dict(tuple(x) for x in linking.connect(linking.shared_buckets(members), near).collect())
    assert got == {i: 0 for i in range(30)}


# ---- 2 ----------------------------------------------------------------------------------------


def test_samples_collide_as_often_as_sets_are_similar():
    r = np.random.default_rng(5)
    x = np.sort(r.integers(0, 2**63, 400).astype(np.uint64))
    a, b = (x[:300], np.ones(300, np.float32)), (x[60:400], np.linspace(1, 3, 340).astype(np.float32))
    drawn = [near_dedup.samples(*s, 3000) for s in (a, b)]
    assert abs(np.mean(drawn[0] == drawn[1]) - near_dedup.jaccard(a, b)) < 0.04


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(i, 120) for i in range(12)]
    texts = [*base, edited(base[0], 5), edited(base[0], 60), edited(base[0], 100), base[1], base[1], edited(base[2], 3, 30, 60, 90), None, "", "one two", "one  Two", "one two three"]
    texts += [edited(base[3], k) for k in range(2, 110, 4)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, base[4], 0), (5, base[5], 0)], DOCS + ", comp int")
    every = [(r.doc_id, r.text) for r in docs.collect()]
    counts, total = near_dedup.word_frequencies(docs.select("text"))
    ids, idf = shingles.WordIds(), near_dedup.inverse(counts, total)
    assert total == len(every)
    sets = [near_dedup.weighted(t or "", idf, ids) for _, t in every]
    group = list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            if (every[i][1] or "") == (every[j][1] or "") or near_dedup.jaccard(sets[i], sets[j]) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    heads = {g: min((every[i][0] for i in range(len(every)) if group[i] == g and every[i][0] is not None), default=None) for g in set(group)}
    want = Counter((every[i][0], heads[group[i]], group.count(group[i])) for i in range(len(every)))
    got = near_dedup.report(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(heads.values())
    assert near_dedup.report(docs.limit(0)).count() == 0 and near_dedup.deduplicate(docs.limit(0)).count() == 0


# ---- 5 ----------------------------------------------------------------------------------------


def brute_removal(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i:i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = 1
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_shard", [2000, 2])
def test_suffix_removal_equals_brute_force(spark, per_shard):
    a, b, passage = prose(1, 500), prose(2, 400), prose(3, 90)
    docs = [(1, a), (2, a[200:1500] + "x" + b), (3, b[:399]), (4, b[:400]), (5, None), (6, ""), (7, "z" * 2000), (8, "ab" * 900), (9, a), (9, a), (None, "é" * 700),
            *[(20 + i, prose(50 + i, 60) + passage + prose(90 + i, 60)) for i in range(12)]]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], DOCS + ", k1 int, fp string").repartition(4)
    got = [tuple(r) for r in suffix_dedup.report(df, 400, per_shard).collect()]
    assert sorted(got, key=str) == brute_removal(docs, 400)


def test_suffix_removal_of_empty_tables_and_long_texts(spark, monkeypatch):
    df = spark.createDataFrame([(1, prose(1, 3000)), (2, prose(1, 3000)[2000:9000])], DOCS)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1500)
    assert sorted(map(tuple, suffix_dedup.report(df).collect())) == brute_removal([tuple(r) for r in df.collect()], 400)
    assert suffix_dedup.report(df.limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(3)
    data = np.concatenate([r.integers(97, 99, 900), np.full(300, 97), r.integers(97, 99, 300)]).astype(np.uint8)
    data = np.concatenate([data, data[100:700]])
    order, rank = suffix_dedup.suffix_array(data, 64)
    raw = data.tobytes()
    keys = [raw[i:i + 64] for i in range(len(raw))]
    assert [keys[i] for i in order] == sorted(keys)
    full = np.arange(len(raw) - 63)
    assert len(set(rank[full].tolist())) == len({keys[i] for i in full})
    before = np.full(len(raw), -1)
    before[order[1:]] = order[:-1]
    common = lambda i, j: next((k for k in range(64) if raw[i + k:i + k + 1] != raw[j + k:j + k + 1] or i + k >= len(raw)), 64)
    assert suffix_dedup.common_prefixes(data, before, 64).tolist() == [0 if before[i] < 0 else common(i, before[i]) for i in range(len(raw))]


# ---- 7 ----------------------------------------------------------------------------------------


def test_flow_moves_the_fewest_bytes():
    r = np.random.default_rng(2)
    for _ in range(20):
        supply = [int(x) for x in r.integers(0, 1000, r.integers(1, 6))]
        capacity = sharding.equal_capacities(sum(supply), int(r.integers(1, 7)))
        flow = sharding.min_cost_flow(supply, capacity, lambda i, j: 0 if i == j else 1)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(len(supply))] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= c for k, c in enumerate(capacity))
        stays = sum(min(s, c) for s, c in zip(supply, capacity))
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(supply) - stays
    assert sharding.min_cost_flow([5, 5], [10, 5], lambda i, j: (3, 1)[(i + j) % 2]) == {(0, 1): 5, (1, 0): 5}
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], lambda i, j: 0)


def test_shards_are_near_equal_with_gapless_slots(spark):
    rows = [(i, prose(i, 20 + i % 9) if i % 50 else None, f"s{i % 3 if i % 2 else 0}") for i in range(600)] + [(None, "", None), (7, "same", "s"), (7, "same", "s")]
    docs = spark.createDataFrame(rows, DOCS + ", source string")
    got = sharding.report(docs).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    totals = Counter()
    for r in got:
        totals[r.shard] += r.size
        assert 0 <= r.shard < 8
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert max(totals.values()) - min(totals.values()) <= 4 * max(r.size for r in got)
    assert sharding.report(docs.limit(0)).count() == 0


def test_rewrite_touches_changed_shards_only(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "x" * 99, i % 2) for i in range(100)] + [(200 + i, "y" * 9, 2) for i in range(10)], DOCS + ", old int")
    changed = sharding.rewrite(docs, F.col("old"), 3, [5000, 2500, 2600], str(tmp_path / "out"))
    assert changed == [1, 2]
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.shard for r in out} == {1, 2} and len(out) == 60 and {r.text for r in out} == {"x" * 99, "y" * 9}


# ---- 10 ---------------------------------------------------------------------------------------


def test_passages_are_found_in_paragraphs_and_inside_them(spark):
    passage, common = prose(7, 70) + ".", "And this is how it ends."
    own = [prose(100 + i, 80) + ". " for i in range(8)]
    docs = [(1, own[0] + "\n" + passage), (2, own[1] + passage + " " + own[2]), (3, own[3] + "\n" + edited(passage, 30) + "\n" + own[4]), (4, own[5] + common),
            (5, own[6] + common), (6, None), (7, ""), (8, own[7]), (8, own[7]), (None, "a b")]
    df = spark.createDataFrame([(*d, "c") for d in docs], DOCS + ", class_ids string").repartition(3)
    got = {}
    for r in substring_dedup.report(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = {k: v[0].text for k, v in got.items()}
    assert sum(passage in (t or "") for t in texts.values()) == 1
    assert sum(edited(passage, 30) in t for t in texts.values()) == 0 or passage not in texts[1] + texts[2]
    for k, n in ((1, 0), (2, 1), (2, 2), (3, 3), (3, 4), (4, 5), (5, 6)):
        assert own[n].strip() in texts[k]
    assert common in texts[4] and common in texts[5] and texts[6] == "" and texts[7] == "" and len(got[8]) == 2
    assert substring_dedup.report(df.limit(0)).count() == 0


def hard_wrapped(words, size):
    w = words.split()
    return "\n".join(" ".join(w[i : i + size]) for i in range(0, len(w), size))


def test_passages_in_the_middle_of_documents(spark):
    """A passage of 55 words word for word in the middle of two texts, also with other case and punctuation, goes; 49 shared words stay."""
    passage, short = prose(7, 55), prose(8, 49)
    own = [prose(200 + i, 90) for i in range(14)]
    loud = ", ".join(w.upper() for w in passage.split())
    docs = [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{own[2]} {passage} {own[3]}"), (3, hard_wrapped(f"{own[4]} {loud} {own[5]}", 7)),
            (6, f"{own[10]} {short} {own[11]}"), (7, f"{own[12]} {short} {own[13]}")]
    got = {r.doc_id: r for r in substring_dedup.report(spark.createDataFrame(docs, DOCS).repartition(4)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 6, 7)] == [0, 1, 1, 0, 0]
    assert got[2].text.split() == [*own[2].split(), *own[3].split()] and got[2].removed_words == 55
    assert got[3].text.split() == [*own[4].split(), *own[5].split()]


def test_recall_of_edited_lines(spark):
    """Three lines of 30 words, a word edited in each: the shingles' Jaccard similarity is 0.7, and nine in ten are found."""
    docs = []
    for i in range(30):
        words = prose(400 + i, 90)
        docs.append((i, f"{prose(500 + i, 60)}\n\n{hard_wrapped(words, 30)}\n\n{prose(600 + i, 60)}"))
        docs.append((100 + i, f"{prose(700 + i, 60)}\n\n{hard_wrapped(edited(words, 10, 45, 80), 30)}\n\n{prose(800 + i, 60)}"))
    got = substring_dedup.report(spark.createDataFrame(docs, DOCS).repartition(4)).collect()
    cuts = {r.doc_id: (r.n_removed, r.removed_words) for r in got}
    assert all(cuts[i] == (0, 0) for i in range(30)) and {cuts[100 + i] for i in range(30)} <= {(0, 0), (1, 90)}
    assert sum(cuts[100 + i] == (1, 90) for i in range(30)) >= 27


def slow_cuts(docs):
    """For each document, per word: whether it must go (in a passage of 50 words that one earlier document has), and whether it may (in
    windows of 40 words that earlier documents have); documents without long or edited paragraphs."""
    words = {d: [w.strip(".").lower() for w in t.split()] for d, t in docs}
    grams = {d: {tuple(w[i : i + 50]) for i in range(len(w) - 49)} for d, w in words.items()}
    parts = {d: {tuple(w[i : i + 40]) for i in range(len(w) - 39)} for d, w in words.items()}
    out = {}
    for d, w in words.items():
        must, may = [False] * len(w), [False] * len(w)
        for size, flags, sets in ((50, must, grams), (40, may, parts)):
            for i in range(len(w) - size + 1):
                if any(tuple(w[i : i + size]) in sets[e] for e in words if e < d):
                    flags[i : i + size] = [True] * size
        out[d] = (must, may)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_word_runs_against_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    passages = [prose(300 + i, int(n)) for i, n in enumerate(r.integers(20, 120, 9))]
    docs = []
    for d in range(24):
        parts = []
        for _ in range(int(r.integers(1, 5))):
            parts.append(prose(int(r.integers(10**6)), int(r.integers(3, 60))))
            chosen = passages[int(r.integers(len(passages)))].split()
            at = int(r.integers(0, max(1, len(chosen) - 45)))
            parts.append(" ".join(chosen[at : at + int(r.integers(30, 120))]))
        docs.append((d, " ".join(parts)))  # one line: no paragraph but the whole text
    docs.append((30, docs[3][1]))
    got = {x.doc_id: x for x in substring_dedup.report(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    n = 0
    for d, (must, may) in slow_cuts(docs).items():
        whole, left = dict(docs)[d].split(), got[d].text.split()
        assert len(whole) - len(left) == got[d].removed_words
        # the words that are left, matched in order, tell which are gone
        kept = [w for w, m in zip(whole, may) if not m]
        rest = [w for w, m in zip(whole, must) if not m]
        assert len(kept) <= len(left) <= len(rest), d
        n += sum(must)
    assert n > 500


def test_edit_distance_of_words():
    r = np.random.default_rng(4)
    for _ in range(60):
        a, b = r.integers(0, 6, r.integers(0, 30)).tolist(), r.integers(0, 6, r.integers(0, 30)).tolist()
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert substring_dedup.edits(a, b) == row[-1]


def test_signatures_estimate_jaccard_and_kept_windows_meet():
    x = shingles.mixed(np.arange(1, 301, dtype=np.uint64))
    both = np.concatenate([x[:250], x[50:]])
    a, b = substring_dedup.signatures(both, np.array([[0, 250], [250, 500]]), 2000)
    assert abs(np.mean(a == b) - 200 / 300) < 0.04
    r = np.random.default_rng(6)
    shared = r.integers(1, 1 << 60, 50).astype(np.uint64)
    for _ in range(50):
        one, two = (np.concatenate([r.integers(1, 1 << 60, int(k)).astype(np.uint64) for k in (0,)] + [
            r.integers(1, 1 << 60, int(r.integers(0, 90))).astype(np.uint64), shared, r.integers(1, 1 << 60, int(r.integers(0, 90))).astype(np.uint64)]) for _ in "ab")
        kept = lambda w: set(w[substring_dedup.kept_windows(w, np.array([[0, len(w)]]))].tolist())
        assert kept(substring_dedup.window_hashes(one)) & kept(substring_dedup.window_hashes(two))
    # texts laid end to end have the windows that each has by itself
    texts = [r.integers(1, 1 << 60, int(n)).astype(np.uint64) for n in (0, 30, 40, 45, 300, 39, 51, 1000, 7)]
    sizes = np.array([len(x) for x in texts])
    begin = np.cumsum(sizes) - sizes
    whole = substring_dedup.window_hashes(np.concatenate(texts))
    places = substring_dedup.kept_windows(whole, np.stack([begin, begin + sizes - 39], axis=1))
    want = []
    for x, at in zip(texts, begin.tolist()):
        w = substring_dedup.window_hashes(x)
        n = min(11, len(w))
        want += sorted({at + i + int((w[i : i + n] >> np.uint64(32)).argmin()) for i in range(len(w) - n + 1)} if n else ())
    assert places.tolist() == want


# ---- pipeline ---------------------------------------------------------------------------------


def test_pipeline_equals_its_operators_in_turn(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR).persist()
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    last = p.STAGES[-1][1](spark, docs, SF_DIR)
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(p.run(spark, SF_DIR)) == key(last) and last.count() == before


def test_pipeline_stages_take_nulls_and_empty_tables(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for _, stage in p.STAGES:
        assert stage(spark, odd, SF_DIR).count() <= 3 and stage(spark, docs.limit(0), SF_DIR).count() == 0


# ---- blocks -----------------------------------------------------------------------------------


def test_overlaps_equal_sums_of_minima():
    ids, idf = shingles.WordIds(), near_dedup.inverse(np.arange(near_dedup.SLOTS) % 50, 50)
    texts = [prose(i % 3, 60 + 7 * i) + " x y z x y z x y z x y z" * (i % 4) for i in range(9)] + ["", "one"]
    both, whole = blocks.overlaps([near_dedup.occurrences(t, idf, ids) for t in texts])
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if i == j:
                continue  # what a set has alone is left out of its overlap with itself
            x, y = near_dedup.weighted(a, idf, ids), near_dedup.weighted(b, idf, ids)
            union = whole[i] + whole[j] - both[i, j]
            assert abs((both[i, j] / union if union else 0) - near_dedup.jaccard(x, y)) < 1e-5


def test_a_large_group_that_is_near_but_mostly_not_similar(spark, monkeypatch):
    """Copies of one text with so many edits that few pairs reach the threshold: exactly those are linked, by blocks of any size."""
    monkeypatch.setattr(blocks, "BLOCK", 16)
    r = np.random.default_rng(8)
    base = prose(77, 150)
    texts = [edited(base, *r.choice(150, int(r.integers(1, 6)), replace=False).tolist()) + f" {i}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    counts, total = near_dedup.word_frequencies(docs.select("text"))
    ids, idf = shingles.WordIds(), near_dedup.inverse(counts, total)
    both, whole = blocks.overlaps([near_dedup.occurrences(t, idf, ids) for t in texts])
    similar = both >= 0.8 * (whole[:, None] + whole[None, :] - both)
    assert 0.02 < similar.mean() < 0.6
    members = spark.createDataFrame([(1, i, i) for i in range(120)] + [(2, 5, 5)], "bucket bigint, id bigint, comp bigint")
    packed = near_dedup.packed(docs.selectExpr("doc_id AS id", "text"))

    def vector():
        import zstandard

        own, z = shingles.WordIds(), zstandard.ZstdDecompressor()
        return lambda raw: near_dedup.occurrences(z.decompress(raw).decode(), idf, own)

    links = [tuple(x) for x in blocks.block_links(written(members), written(packed), vector, 0.8).collect()]
    label = list(range(120))
    for i, j in zip(*np.nonzero(similar)):
        label = [label[i] if x == label[j] else x for x in label]
    found = dict(tuple(x) for x in linking.components(written(spark.createDataFrame(links, "a bigint, b bigint"))).collect())
    want = {i: min(j for j in range(120) if label[j] == label[i]) for i in range(120)}
    assert {i: found.get(i, i) for i in range(120)} == want and len(links) < 120 * 12


def test_words_of_many_texts_at_once(monkeypatch):
    import re

    r = np.random.default_rng(5)
    letters = list("abAB ΣςσİıẞÀ«»„“ \x1c\x85\n\n\t .,!…-_漢😀      ")
    texts = ["", "\n", "... \n", *("".join(r.choice(letters, int(n))) for n in r.integers(0, 300, 200))]
    for piece in (1 << 20, 37):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        ids = substring_dedup.NormalIds()
        for text, (hashes, lines, n_lines) in zip(texts, substring_dedup.words_of(texts, ids)):
            expected = [(i, m.span(), core) for i, line in enumerate(text.split("\n")) for m in re.finditer(r"\S+", line)
                        if (core := m.group().strip(substring_dedup._AROUND).lower())]
            assert hashes.tolist() == [substring_dedup.NormalIds.hashed(core) for _, _, core in expected]
            assert lines.tolist() == [i for i, _, _ in expected] and n_lines == text.count("\n") + 1
            first, end = substring_dedup.word_bounds(text)
            at = np.cumsum([0, *(len(x) + 1 for x in text.split("\n"))])
            assert list(zip(first.tolist(), end.tolist())) == [(at[i] + x, at[i] + y) for i, (x, y), _ in expected]


def test_tables_on_the_way_are_deleted(spark):
    import os

    from doclake.llm.common import settled, written

    ways = []

    def build():
        ways.append(written(spark.range(7)))
        return ways[0].filter("id > 2")

    assert settled(build).count() == 4 and not os.path.exists(ways[0]._folder)

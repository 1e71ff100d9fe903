"""The trie of conversations against brute force, and Euler tours of any forest."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest

from doclake.llm import conversations, euler
from doclake.llm.common import written

ROWS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow_trie(rebuilt):
    """All nodes of {id: turns}."""
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in members if p}
        ends = sorted(c for c in ids if len(rebuilt[c]) == len(path))
        out[(min(ids), len(path))] = (
            min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), sum(p[:-1] == path for p in members if p),
            sum(p not in inner for p in below), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=str)


def own_turns(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(x)] for c, x in own.items()}


def respliced(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]  # % as SQL has it, with the sign of c
    return out


def fixture(seed, n, spread=300):
    r = np.random.default_rng(seed)
    rows = []
    for c in r.choice(spread, n, replace=False).tolist():
        for turn in range(int(r.integers(1, 9))):
            rows.append((c, None if r.random() < 0.05 else int(r.integers(0, 6)), ["user", "assistant", None][r.integers(0, 3)],
                         [None, "", "hi", "Grüße 😀", "a longer text"][r.integers(0, 5)]))
    rows += [(5000, 0, "user", "hi"), (5001, 0, "user", "hi"), (-7, 1, "x", "y"), (-100, 1, "x", "y"), (None, 1, "user", "nobody"), (400, 0, "user", "hi")]
    rows += [(5002, 3, "user", "same")] * 4
    return rows


def got(df):
    assert df.columns == COLUMNS and {t for _, t in df.dtypes[:-1]} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_brute_force(spark, monkeypatch, small):
    if small:  # every conversation in pieces, every list ranked by rulers, every node with groups of children
        for module, name, value in ((conversations, "PIECE", 2), (conversations, "BLOCK", 8), (euler, "WALKED", 8), (euler, "SIBLINGS", 3)):
            monkeypatch.setattr(module, name, value)
    rows = fixture(small, 40 if small else 120)
    table = spark.createDataFrame([(*x, "other", 1) for x in rows], f"{ROWS}, c string, n int").repartition(5)
    assert got(conversations.report(table)) == slow_trie(respliced(own_turns(rows)))
    if not small:
        assert got(conversations.prefix_trie(table)) == slow_trie(own_turns(rows))


def test_one_conversation_of_all_rows_is_dealt_to_many_tasks(spark):
    rows = [(7, i, "user" if i % 2 else None, str(i % 5)) for i in range(3000)] + [(8, 0, None, "0")]
    table = spark.createDataFrame(rows, ROWS).repartition(6)
    numbered = conversations.turns_in_order(table)
    assert numbered.filter("c = 7").selectExpr("min(i)", "max(i)", "count(DISTINCT i)").collect()[0][:] == (1, 3000, 3000)
    h = zlib.crc32(b"7") % 6
    nodes = {r["depth"]: r for r in conversations.report(table).filter("conv_id = 7").collect()}
    want = [None, *own_turns(rows)[7][h:]]
    assert len(nodes) == len(want) and nodes[1]["n_leaves"] == 1 and nodes[len(want) - 1]["n_children"] == 0


def test_long_conversations_share_prefixes(spark):
    text = "abc"
    rows = [(c, i, "user", text) for c, n in ((1, 2500), (2, 2500), (3, 1030)) for i in range(n)]
    out = {(r["conv_id"], r["depth"]): r for r in conversations.prefix_trie(spark.createDataFrame(rows, ROWS)).collect()}
    assert len(out) == 2501
    assert out[1, 1030]["n_convs"] == 3 and out[1, 1031]["n_convs"] == 2 and out[1, 2500]["n_leaves"] == 1
    assert out[1, 0]["saved_tokens"] == 3 * (1030 * 2 + 1470)
    assert out[1, 2500]["ends_sha256"] == hashlib.sha256(b"1,2").hexdigest()
    assert out[1, 1030]["ends_sha256"] == hashlib.sha256(b"3").hexdigest()


def test_empty_table(spark):
    assert conversations.report(spark.createDataFrame([], ROWS)).collect() == []


def test_subtree_sums_of_a_forest(spark, monkeypatch):
    monkeypatch.setattr(euler, "WALKED", 20)
    r = np.random.default_rng(3)
    parent = [None, None] + [int(r.integers(max(0, i - 4), i)) if i % 3 else 0 for i in range(2, 260)]
    weight = [int(x) for x in r.integers(-5, 100, len(parent))]
    want = weight[:]
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    nodes = written(spark.createDataFrame(list(zip(range(len(parent)), parent, weight)), "node bigint, parent bigint, w bigint"))
    assert dict(tuple(x) for x in euler.subtree_sums(nodes, ["w"]).collect()) == dict(enumerate(want))

"""Fingerprints and their components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from doclake.llm import simhash

DOCS = "doc_id bigint, text string"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(prints, near):
    """Smallest index reachable."""
    top = list(range(len(prints)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (int(prints[i]) ^ int(prints[j])).bit_count() <= near:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [root(i) for i in range(len(prints))]


def prints_with_clusters(seed, n):
    """Random fingerprints, chains of single flips, and a dense ball."""
    r = np.random.default_rng(seed)
    out = r.integers(0, 1 << 64, n, np.uint64).tolist()
    for x in out[:20]:
        for k in r.permutation(64)[:25].tolist():
            x ^= 1 << k | (1 << (k + 7) % 64 if r.random() < 0.6 else 0)
            x ^= 1 << (k + 11) % 64 if r.random() < 0.3 else 0
            out.append(x)
    center = out[30]
    out += [center ^ sum(1 << int(k) for k in r.permutation(40)[: r.integers(0, 5)]) for _ in range(n)]
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("text", [
    "", None, " \t\n", "One", "one two", "A b\x0bC", "a b c d a b c", "ÄÖ x y   z Ü w q", "A" * 50 + " b" * 400,
    "\x1c\x85 x y z w", "w " * 9 + "end",
])
def test_fingerprint_equals_the_definition(text):
    assert simhash.fingerprint(text or "") == slow_fingerprint(text)


def test_fingerprint_of_a_text_cut_into_blocks(monkeypatch):
    r = np.random.default_rng(5)
    text = " ".join("w" * int(k) + str(k) for k in r.integers(1, 30, 500)) + "\n"
    whole = simhash.fingerprint(text)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(simhash, "BLOCK", size)
        assert simhash.fingerprint(text) == whole == slow_fingerprint(text)


@pytest.mark.parametrize("near", [0, 1, 2, 3])
def test_forest_equals_brute_force(near):
    prints = prints_with_clusters(near, 400)
    assert simhash.forest(prints, near).tolist() == slow_components(prints, near)


def test_no_near_pair_is_lost_between_shards():
    prints = prints_with_clusters(9, 1500)
    nodes = simhash.fitted(prints[::3], 16, 2)
    assert len(nodes) > 50
    together = set()
    for _, members in simhash.routed(prints, nodes, 2):
        close = np.bitwise_count(members[:, None] ^ members[None, :]) <= 2
        together |= {(int(members[i]), int(members[j])) for i, j in zip(*np.nonzero(close))}
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    assert together == {(int(prints[i]), int(prints[j])) for i, j in zip(*np.nonzero(close))}


def test_components_of_documents_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 30)
    r = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(60):
        words = r.choice(vocabulary, r.integers(0, 120)).tolist()
        for _ in range(6):
            texts.append(" ".join(words))
            if words:
                words = words[:]
                words[r.integers(0, len(words))] = "new"
    texts += [None, "", "  ", texts[1], texts[1]]
    rows = [(int(i) * 3 + 1, t) for i, t in zip(r.permutation(len(texts)), texts)] + [(None, texts[1]), (None, "only one without an id")]
    got = simhash.report(spark.createDataFrame([(*x, "x", 1) for x in rows], f"{DOCS}, f string, shard int")).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    label = slow_components(prints, 2)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [(i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, label)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len(set(label)) > 20


def test_empty_table_and_kept_rows(spark):
    assert simhash.report(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(5, "a b c d e"), (3, "A B c d e"), (9, "something else entirely here"), (3, "A B c d e"), (None, "a b c d e")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(tuple(r) for r in kept) == [(3, "A B c d e"), (3, "A B c d e"), (9, "something else entirely here")]

"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from doclake.llm import hard_negatives

ROWS = "vec_id bigint, embedding array<float>, label int"


def slow(rows):
    items = []
    for i, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        items.append((i, [math.floor(256 * float(np.float32(v))) for v in x], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last = lambda i: (i is None, i or 0)
    out = []
    for i, x, label in {(i, tuple(x), label) for i, x, label in items if i is not None and i % 100 == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), last(j), j, other) for j, y, other in items), key=lambda r: (r[0], r[1]))
        for minus, _, j, _ in [r for r in scored if r[3] == label and r[2] != i][:5]:
            p = -minus
            fit = [r for r in scored if r[3] != label and 30 * p <= 100 * -r[0] <= 90 * p][:10]
            out += [(i, j, k, r[2], p, -r[0]) for k, r in enumerate(fit, 1)]
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], f"{ROWS}, id int, score string").repartition(parts)
    df = hard_negatives.report(table)
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                         ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, n, width=6, labels=4):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(v)) for v in r.normal(size=width)], int(r.integers(0, labels))) for i in range(n)]


def test_equals_brute_force(spark):
    rows = random_rows(1, 900)
    want = slow(rows)
    assert len(want) > 200 and got(spark, rows) == want


def test_tiles_and_groups_of_any_size(spark, monkeypatch):
    for name, value in (("TILE", 16), ("ANCHORS", 2), ("STEP", 1)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = random_rows(2, 700)
    assert got(spark, rows, 7) == slow(rows)


def test_ties_repeats_nulls_zeros_and_ragged_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.integers(-1, 2, 3)], int(r.integers(0, 3))) for i in range(0, 400)]  # many equal scores, zeros among them
    rows += [(i, [0.0, 0.0, 0.0], 1) for i in range(500, 620)]
    rows += [(5, [1.0, 0.0, 0.0], 1)] * 3 + [(100, *rows[100][1:])] * 2 + [(100, [1.0, 1.0, 1.0], 2)]
    rows += [(None, [1.0, 1.0, 1.0], 0), (None, [0.5, 0.5, 0.5], 1), (700, None, 1), (701, [1.0], None), (702, [1.0, None], 1)]
    rows += [(703, [float("nan"), 1.0], 1), (704, [float("-inf")], 2), (-100, [1.0, -1.0], 2), (800, [], 1), (-7, [2.0, 1.0, 1.0, 4.0], 0)]
    assert got(spark, rows) == slow(rows)


def test_products_beyond_doubles_are_exact(spark):
    rows = [(i, [3.0e5 * (1 + i % 5) + i * 8, 2.0e5, (-1.0) ** i * (1 + i)], i % 3) for i in range(0, 220)]
    want = slow(rows)
    assert max(r[4] for r in want) > 1 << 53 and got(spark, rows) == want


def test_scores_beyond_longs_do_not_fail(spark):
    rows = [(i, [3.0e38, -3.0e38 if i % 2 else 1.0], i % 3) for i in range(0, 210)]
    assert isinstance(got(spark, rows), list)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (200, [1.0], 1)]])
def test_nothing_to_find(spark, rows):
    assert got(spark, rows) == []

"""All similar pairs of large buckets, by blocks of bounded size and without a row for any pair.

A bucket's members are dealt to blocks by a hash; every two blocks meet in one task. There, shingles that only one member has cannot
be shared and are left out, and the overlaps of all pairs are a product of two matrices over the rest. Only links that connect what
was not connected yet leave the task: at most one for each member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import written
from doclake.llm.simhash import joined

#: Members and bytes of payload that a block should have; columns that are multiplied at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 4 << 20, 4096
#: Share of the larger set that a pair must have in common before another measure than the threshold is asked.
HALF_ALIKE = 0.4

#: Distinct elements of a weighted set, and their weights.
Weighted = tuple[np.ndarray, np.ndarray]


def overlaps(sets: list[Weighted]) -> tuple[np.ndarray, np.ndarray]:
    """Weight that each two different sets have in common, and the weight of each set; an element has the same weight wherever it is."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    elements, place = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
    weights = np.concatenate([s[1] for s in sets]).astype(np.float64)
    whole = np.bincount(owner, weights, n)
    weight = np.zeros(len(elements))
    weight[place] = weights
    shared = np.bincount(place, minlength=len(elements)) > 1
    column = np.cumsum(shared) - 1
    kept = shared[place]
    owner, place, weight = owner[kept], column[place[kept]], weight[shared]
    turn = np.argsort(place, kind="stable")
    owner, place = owner[turn], place[turn]
    out = np.zeros((n, n))
    for at in range(0, len(weight), COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + COLUMNS])
        m = np.zeros((n, min(COLUMNS, len(weight) - at)))
        m[owner[lo:hi], place[lo:hi] - at] = 1
        out += (m * weight[at : at + COLUMNS]) @ m.T
    return out, whole


def new_links(
    sets: list[Weighted], comps: np.ndarray, blocks: np.ndarray, threshold: float, also: Callable[[int, int], bool] | None = None,
) -> list[tuple[int, int]]:
    """Pairs of places that join the components of similar sets; pairs within one of two blocks are left to that block.

    ``also`` is asked about pairs that have HALF_ALIKE of the larger set in common and are not connected otherwise.
    """
    n = len(sets)
    _, first, inverse = np.unique(comps, return_index=True, return_inverse=True)
    before = joined(np.arange(n), np.arange(n), first[inverse])
    if (before == before[0]).all():
        return []
    both, whole = overlaps(sets)
    union = whole[:, None] + whole[None, :] - both
    similar = (both >= threshold * union) & (union > 0)
    if (blocks != blocks[0]).any():
        similar &= blocks[:, None] != blocks[None, :]
    i, j = np.nonzero(np.triu(similar, 1))
    after = joined(before.copy(), i, j)
    if also is not None:
        near = both >= HALF_ALIKE * np.maximum(whole[:, None], whole[None, :])
        if (blocks != blocks[0]).any():
            near &= blocks[:, None] != blocks[None, :]
        for i, j in zip(*np.nonzero(np.triu(near & (after[:, None] != after[None, :]), 1))):
            if after[i] != after[j] and also(i, j):
                after = joined(after, np.array([i]), np.array([j]))
    moved = np.flatnonzero((before == np.arange(n)) & (after != np.arange(n)))
    return list(zip(after[moved].tolist(), moved.tolist()))


def block_links(
    members: DataFrame, payloads: DataFrame, vector: Callable[[], Callable[[bytes], Weighted]], threshold: float,
    also: Callable[[bytes, bytes], bool] | None = None,
) -> DataFrame:
    """(a, b): links that join the components of ``members`` (bucket, id, comp), a table, by all similar pairs in a bucket.

    ``payloads`` (id, z) is a table of what makes the members' sets; ``vector`` returns the function that does. ``also`` is another measure
    of two payloads that links them.
    """
    sized = members.select("bucket", "id", "comp").join(payloads.select("id", F.octet_length("z").alias("size")), "id")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES))
    totals = written(sized.groupBy("bucket").agg(parts.cast("bigint").alias("parts")))
    placed = members.select("bucket", "id", "comp").join(totals, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), "parts"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")).select(
        "bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, key, held = vector(), None, []
        for b in batches:
            out = []
            for bucket, p, q, own, ident, comp, z in zip(*(b.column(c) for c in ("bucket", "p", "q", "own", "id", "comp", "z"))):
                now = (bucket.as_py(), p.as_py(), q.as_py())
                if now != key:
                    out += linked(held)
                    key, held = now, []
                held.append((own.as_py(), ident.as_py(), comp.as_py(), of(z.as_py()), z.as_py() if also else None))
            yield batch(out)
        yield batch(linked(held))

    def linked(held: list[tuple]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        own, ids, comps, sets, raw = zip(*held)
        asked = (lambda i, j: also(raw[i], raw[j])) if also else None
        return [(ids[i], ids[j]) for i, j in new_links(list(sets), np.array(comps), np.array(own), threshold, asked)]

    def batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = met.join(payloads, "id").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return dealt.select("bucket", "p", "q", "own", "id", "comp", "z").mapInArrow(run, "a bigint, b bigint")

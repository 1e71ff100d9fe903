"""Near-duplicate documents by 64-bit fingerprints that differ in few bits, found with vantage-point trees.

A tree splits fingerprints by their Hamming distance from a vantage point: those within the radius go inside, the others outside. By
the triangle inequality two fingerprints that differ in at most ``near`` bits are only split where the inner one is less than
``near`` bits within the radius, so inner fingerprints of that rim are members of the outer side, too (or outer ones of the inner
side, whichever are fewer). Then every near pair meets in a leaf, and all other branches are pruned.

The upper tree is fitted to a bounded sample; it only decides which shards there are, and every fingerprint goes to its shard and to
those whose boundary it overlaps. Each shard goes on with a tree of its own, compares the members of small leaves, and returns the links
as stars of a spanning forest, never all pairs of a group. Equal fingerprints are one item from the start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import written
from doclake.llm.linking import components

#: Words of a shingle; seed of its hash; bits in which near-duplicates differ at most.
SIZE, SEED, NEAR = 3, 42, 2
#: Distinct fingerprints a shard should hold; shards at most; sampled fingerprints for each shard. Larger corpora have larger shards.
SHARD, MAX_SHARDS, SAMPLE = 1024, 16384, 16
#: Members that are compared with each other without a further split; vantage points that are tried for a split.
LEAF, TRIES = 192, 6
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(raw):
        m = _SPACE.search(raw, min(len(raw), at + BLOCK))
        end = m.start() if m else len(raw)
        yield raw[at:end].split()  # bytes.split() cuts at the same six characters
        at = end


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by spaces; there are at least as many words."""
    line = b" ".join(words)
    stops = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *stops]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, stops[size - 1 :])], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str) -> int:
    """Bits that are set in over half the shingle hashes of a text; zero if it has no words."""
    counts, total = np.zeros(64, np.int64), 0
    held: list[bytes] = []
    for block in word_blocks(text.encode("utf-8", "surrogatepass").translate(_LOWER)):
        held += block
        if len(held) >= SIZE:
            hashes = shingle_hashes(held, SIZE)
            counts += bit_counts(hashes)
            total += len(hashes)
            held = held[1 - SIZE :]
    if not total and held:  # fewer words than a shingle has
        hashes = shingle_hashes(held, len(held))
        counts, total = bit_counts(hashes), 1
    return sum(1 << k for k in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of every row of ``docs`` (doc_id, text); f is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py() or "") for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, f bigint")


class Split(NamedTuple):
    """A vantage point, its radius, and whether inner members of the rim also go outside (else outer ones also go inside)."""

    point: int
    radius: int
    outward: bool

    def sides(self, prints: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
        """Which fingerprints go inside, and which outside."""
        distance = np.bitwise_count(prints ^ np.uint64(self.point)).astype(np.int16)
        inner, outer = distance <= self.radius, distance > self.radius
        if self.outward:
            return inner, outer | (distance > self.radius - near) & inner
        return inner | (distance <= self.radius + near) & outer, outer


def best_split(prints: np.ndarray, near: int) -> Split | None:
    """The split with the fewest members on both sides for what it tells; none if all of them leave a side with nearly everything."""
    n, best, least = len(prints), None, np.inf
    for point in prints[:: max(1, n // TRIES)][:TRIES].tolist():
        counts = np.bincount(np.bitwise_count(prints ^ np.uint64(point)), minlength=65)
        within = np.cumsum(counts)
        for r in range(64):
            inner = int(within[r])
            if not 0.05 * n <= inner <= 0.95 * n:
                continue
            rim_in = inner - int(within[r - near]) if r >= near else inner
            rim_out = int(within[min(64, r + near)]) - inner
            extra = min(rim_in, rim_out)
            if inner + (rim_out if rim_out < rim_in else 0) > 0.95 * n or n - inner + (rim_in if rim_in <= rim_out else 0) > 0.95 * n:
                continue
            p = inner / n
            cost = np.log2(1 + extra / n) / -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
            if cost < least:
                best, least = Split(point, r, rim_in <= rim_out), cost
    return best


def fitted(sample: np.ndarray, leaf: int, near: int) -> list[tuple[Split, int, int]]:
    """Nodes of a tree over a sample: split, and the nodes inside and outside; leaves are -1, -2, …; node 0 is the top.

    Empty if the sample is one leaf.
    """
    nodes: list[tuple[Split, int, int]] = []
    leaves = 0

    def grow(prints: np.ndarray) -> int:
        nonlocal leaves
        split = best_split(prints, near) if len(prints) > leaf else None
        if split is None:
            leaves += 1
            return -leaves
        own = len(nodes)
        nodes.append((split, 0, 0))
        inner, outer = split.sides(prints, 0)
        nodes[own] = (split, grow(prints[inner]), grow(prints[outer]))
        return own

    grow(sample)
    return nodes


def routed(prints: np.ndarray, nodes: list[tuple[Split, int, int]], near: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves and their members: fingerprints within them, or across a boundary by less than ``near`` bits."""
    waiting = [(0 if nodes else -1, prints)]
    while waiting:
        at, members = waiting.pop()
        if not len(members):
            continue
        if at < 0:
            yield -at - 1, members
            continue
        split, inside, outside = nodes[at]
        inner, outer = split.sides(members, near)
        waiting += [(inside, members[inner]), (outside, members[outer])]


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest place of the component) after linking places ``i`` and ``j``."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def compared(prints: np.ndarray, near: int) -> np.ndarray:
    """Component labels of distinct fingerprints, each compared with all others."""
    label = np.arange(len(prints))
    rows = max(1, (1 << 18) // max(1, len(prints)))
    for at in range(0, len(prints), rows):
        close = np.bitwise_count(prints[at : at + rows, None] ^ prints[None, at:]) <= near
        i, j = np.nonzero(close)
        label = joined(label, i + at, j + at)
    return label


def forest(prints: np.ndarray, near: int) -> np.ndarray:
    """Component labels of distinct, sorted fingerprints: a vantage-point tree down to small leaves."""
    label, waiting = np.arange(len(prints)), [np.arange(len(prints))]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    while waiting:
        places = waiting.pop()
        members = prints[places]
        split = best_split(members, near) if len(members) > LEAF else None
        if split is None:
            own = compared(members, near)
            moved = np.flatnonzero(own != np.arange(len(own)))
            links.append((places[moved], places[own[moved]]))
        else:
            inner, outer = split.sides(members, near)
            waiting += [places[inner], places[outer]]
    i, j = (np.concatenate(x) for x in zip(*links))
    return joined(label, i, j)


def near_links(items: DataFrame, near: int = NEAR) -> DataFrame:
    """(a, b): stars of a spanning forest of the near pairs of each shard; ``items`` (f) is a table of distinct fingerprints.

    Whatever is connected by pairs that differ in at most ``near`` bits is connected by the links, and nothing else is.
    """
    shards = max(1, min(MAX_SHARDS, items.count() // SHARD))
    drawn = items.orderBy(F.xxhash64("f"), "f").limit(shards * SAMPLE).collect()  # at most MAX_SHARDS * SAMPLE rows
    nodes = fitted(np.array([r["f"] for r in drawn], np.int64).view(np.uint64), SAMPLE, near)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for leaf, members in routed(b.column("f").to_numpy().view(np.uint64), nodes, near):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), leaf)), pa.array(members.view(np.int64))], names=["shard", "f"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for b in batches:
            of, prints = b.column("shard").to_numpy(), b.column("f").to_numpy()
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                if not len(part):
                    continue
                if held and of[part[0]] != shard:
                    yield linked(held)
                    held = []
                shard = of[part[0]]
                held.append(prints[part])
        if held:
            yield linked(held)

    def linked(parts: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.unique(np.concatenate(parts))
        label = forest(prints.view(np.uint64), near)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(prints[label[moved]]), pa.array(prints[moved])], names=["a", "b"])

    dealt = items.select("f").mapInArrow(deal, "shard bigint, f bigint").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(link, "a bigint, b bigint")


def report(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    A null or wordless text has fingerprint zero, which links like any other; rows with equal texts, repeated or not, have equal
    fingerprints and one component. A null doc_id names nothing: a component without any other id has a null component_id. Columns
    other than doc_id and text are not read; an empty table has an empty result.
    """
    prints = written(fingerprints(docs))
    items = written(prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    labels = components(written(near_links(items, near)))
    # tables on both sides of the joins, so that AQE can split a hot fingerprint or component
    named = written(items.join(labels.withColumnRenamed("id", "f"), "f", "left").select("f", "least", F.coalesce("comp", "f").alias("comp")))
    heads = written(named.groupBy("comp").agg(F.min("least").alias("component_id")))
    classes = written(named.join(heads, "comp").select("f", "component_id"))
    return prints.join(classes, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, and those of components without any id."""
    kept = report(docs, near).filter("component_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__kept")), "left_semi")

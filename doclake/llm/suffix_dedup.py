"""Exact repeats of long strings: every byte inside a string of ``length`` bytes that starts anywhere else, too, is removed.

Strings are judged by sorted suffixes, but not all suffixes of a corpus are sorted. The starts of strings are dealt to anchors: a
string's anchor is its k-gram with the smallest hash, which depends on nothing but the string, so equal strings have equal
anchors. Consecutive starts with one anchor are a run, and a run's context is all bytes of its strings. A context that occurs twice
makes all its strings repeats at once; an anchor with one context has none to offer. Only where an anchor has several different
contexts, one copy of each goes to a shard, where a suffix array (Larsson-Sadakane refinement to ``length`` bytes) and common prefixes
(Kasai's rule along the text) tell which strings recur. Anchors with very many contexts are spread over several shards, and what
is single in its shard is looked up among the strings of the others by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import packed_rows, row_key, written
from doclake.llm.shingles import mixed

LENGTH = 400
#: Bytes of an anchor; starts that are handled at a time; bytes of contexts in one suffix array; contexts of an anchor in one shard.
ANCHOR, BATCH_BYTES, SHARD_BYTES, SHARD_CONTEXTS = 96, 2 << 20, 1 << 20, 2000
#: Bytes of contexts that a task gathers before they leave it.
FLUSH_BYTES = 4 << 20

_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every window of ``size`` bytes, by doubling."""
    total, out, done = 0, None, 0
    power, width = _TABLE[data], 1
    while True:
        if size & width:
            if out is None:
                out, done = power, width
            else:
                n = len(data) - done - width + 1
                out = out[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[done : done + n]
                done += width
        if done == size:
            return mixed(out[: len(data) - size + 1])
        n = len(power) - width
        power = power[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width : width + n]
        width *= 2


def sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    width, low = 1, values
    while 2 * width <= size:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = size - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First starts, last starts and anchor hashes of the runs of texts laid end to end in ``data``.

    ``ends[i]`` is where the text of byte i ends; a string must lie in one text.
    """
    hashes = window_hashes(data, ANCHOR)
    place = np.arange(len(hashes), dtype=np.uint64)
    mask = np.uint64((1 << 24) - 1)
    anchor = (sliding_minimum((hashes & ~mask) | place, length - ANCHOR + 1) & mask).astype(np.int64)
    inside = np.arange(len(anchor)) + length <= ends[: len(anchor)]
    fresh = inside.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(fresh)
    stop = inside.copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    return first, np.flatnonzero(stop), hashes[anchor[first]]


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, a, n, fp, ctx) of every run: first start, starts, anchor, and the digest of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waiting: list[tuple[int, int, int, bytes]] = []  # key, offset, part of a text
            size = 0
            for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text")):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                # a long text comes in parts that share length - 1 bytes, so each start lies in one part
                for at in range(0, max(0, len(raw) - length + 1), BATCH_BYTES):
                    part = raw[at : at + BATCH_BYTES + length - 1]
                    waiting.append((k1, k2, at, part))
                    size += len(part)
                    if size >= BATCH_BYTES:
                        yield found(waiting)
                        waiting, size = [], 0
            if waiting:
                yield found(waiting)

    def found(parts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        joined = b"".join(p[3] for p in parts)
        sizes = np.array([len(p[3]) for p in parts])
        stops = np.cumsum(sizes)
        first, last, fp = runs(np.frombuffer(joined, np.uint8), np.repeat(stops, sizes), length)
        owner = np.searchsorted(stops, first, side="right")
        ctx = np.array([xxhash.xxh3_64_intdigest(joined[a : z + length]) for a, z in zip(first.tolist(), last.tolist())], np.uint64)
        base = np.array([p[2] for p in parts]) - (stops - sizes)
        keys = [np.array([p[k] for p in parts], np.int64)[owner] for k in (0, 1)]
        columns = [*keys, first + base[owner], last - first + 1, fp.view(np.int64), ctx.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "a", "n", "fp", "ctx"])

    own = docs.select(*row_key("doc_id", "text"), "text")
    return own.mapInArrow(run, "k1 bigint, k2 bigint, a bigint, n bigint, fp bigint, ctx bigint")


def suffix_array(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next ``length`` bytes, and the rank of each position (equal strings share one).

    Larsson-Sadakane: ranks by h bytes become ranks by 2h bytes by sorting each group by the ranks h bytes on; groups of one are left.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(word, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = word[order[1:]] != word[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    h = 8
    slots = np.arange(n)
    while h < length and len(slots):
        heads = rank[order[slots]]
        alone = np.ones(len(slots), bool)
        alone[1:] &= heads[1:] != heads[:-1]
        alone[:-1] &= heads[1:] != heads[:-1]
        slots = slots[~alone]
        if not len(slots):
            break
        step = min(h, length - h)
        members = order[slots]
        later = members + step
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        heads = rank[members]
        key = heads * np.int64(n + 1) + second
        turn = np.argsort(key, kind="stable")
        members, key, heads = members[turn], key[turn], heads[turn]
        order[slots] = members
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        # a group's rank is the slot of its first member
        rank[members] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        h += step
    return order, rank


def common_prefixes(data: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of each position with the one sorted before it (-1: none), by position.

    Kasai: along the text the length falls by at most one. So it is compared byte by byte only where the predecessor is not the
    one of the position before moved on by one, and follows from there otherwise.
    """
    n = len(data)
    own = np.ones(n, bool)
    own[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0)
    heads = np.flatnonzero(own)
    lcp = np.zeros(n, np.int64)
    active = heads[before[heads] >= 0]
    # the value of a head must reach over its whole chain
    span = np.diff(np.append(heads, n))
    reach = np.zeros(n, np.int64)
    reach[heads] = span + most
    at = 0
    while len(active):
        x, y = active + at, before[active] + at
        ok = (x < n) & (y < n) & (at < reach[active])
        active, x, y = active[ok], x[ok], y[ok]
        same = data[x] == data[y]
        active = active[same]
        lcp[active] += 1
        at += 1
    head_of = heads[np.cumsum(own) - 1]
    return np.minimum(np.maximum(lcp[head_of] - (np.arange(n) - head_of), 0), most)


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the string at each position recurs at another of ``starts``, and the rank of each position's string."""
    order, rank = suffix_array(data, length)
    order = order[starts[order]]
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    same = common_prefixes(data, before, length) >= length
    equal = same.copy()
    equal[before[same]] = True
    return equal, rank


def _contexts(wanted: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """``wanted`` (k1, k2, a, n, fp, salts, single) with the bytes of each context."""

    names = ["k1", "k2", "a", "n", "fp", "salt", "salts", "single", "bytes"]
    types = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        rows, size = [], 0
        for b in batches:
            for k1, k2, marks, raw in zip(*(b.column(c) for c in ("k1", "k2", "marks", "z"))):
                text = z.decompress(raw.as_py())
                for m in marks.as_py():
                    rows.append((k1.as_py(), k2.as_py(), m["a"], m["n"], m["fp"], m["salt"], m["salts"], m["single"], text[m["a"] : m["a"] + m["n"] + length - 1]))
                    size += len(rows[-1][-1])
                    if size >= FLUSH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    by_doc = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "n", "fp", "salt", "salts", "single")).alias("marks"))
    return by_doc.join(packed.dropDuplicates(["k1", "k2"]), ["k1", "k2"]).select("k1", "k2", "marks", "z").mapInArrow(
        run, "k1 bigint, k2 bigint, a bigint, n bigint, fp bigint, salt bigint, salts bigint, single boolean, bytes binary")


def _shards(contexts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, n, fp, bucket, strings): repeated runs of starts; and for spread anchors, packed by buckets of digests, one place
    of each different string of the shard.

    Rows of one (anchor, salt) stand together; suffix arrays are built over about SHARD_BYTES of contexts and end between anchors. An
    anchor has as many buckets as shards, so a bucket of all shards holds about as many strings as one shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for b in batches:
            for r in (row for at in range(0, len(b), 500) for row in b.slice(at, 500).to_pylist()):
                if size >= SHARD_BYTES and (r["fp"], r["salt"]) != (held[-1]["fp"], held[-1]["salt"]):
                    yield judged(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield judged(held)

    def judged(rows: list[dict]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        sizes = np.array([len(r["bytes"]) for r in rows])
        begin = np.cumsum(sizes) - sizes
        counts = np.array([r["n"] for r in rows])
        starts = np.zeros(len(data) + 1, np.int64)
        np.add.at(starts, begin, 1)
        np.add.at(starts, begin + counts, -1)
        valid = np.cumsum(starts)[:-1] > 0
        equal, rank = repeated_starts(data, valid, length)
        out = []
        for r, at, n in zip(rows, begin.tolist(), counts.tolist()):
            hit = equal[at : at + n]
            if r["single"] and hit.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                out += [(r["k1"], r["k2"], r["a"] + int(x), int(y - x), r["fp"], None, None) for x, y in zip(edges[::2], edges[1::2])]
        spread = np.repeat([r["salts"] > 1 for r in rows], sizes) & valid
        if spread.any():
            at = np.flatnonzero(spread)
            at = at[np.unique(rank[at], return_index=True)[1]]
            row = np.searchsorted(begin, at, side="right") - 1
            of = lambda name: np.array([r[name] for r in rows], np.int64)[row]
            digest = window_hashes(data, length)[at]
            fp, bucket = of("fp"), (digest % of("salts").astype(np.uint64)).astype(np.int64)
            table = np.stack([digest.view(np.int64), of("k1"), of("k2"), of("a") + at - begin[row]])
            turn = np.lexsort((bucket, fp))
            cuts = np.flatnonzero((np.diff(fp[turn]) != 0) | (np.diff(bucket[turn]) != 0)) + 1
            out += [(None, None, None, None, int(fp[g[0]]), int(bucket[g[0]]), np.ascontiguousarray(table[:, g]).tobytes()) for g in np.split(turn, cuts)]
        names = ["k1", "k2", "start", "n", "fp", "bucket", "strings"]
        columns = list(zip(*out)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.binary()])], names=names)

    dealt = contexts.repartition("fp", "salt").sortWithinPartitions("fp", "salt")
    return dealt.mapInArrow(run, "k1 bigint, k2 bigint, start bigint, n bigint, fp bigint, bucket bigint, strings binary")


def _across(packs: DataFrame) -> DataFrame:
    """(k1, k2, start, n) of strings that another shard of their anchor has, too.

    ``packs`` (fp, bucket, strings) of one bucket, one from each shard, meet in a task; the digests of all are sorted and each is
    found in them by binary search from both sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for fp, bucket, strings in zip(b.column("fp").to_pylist(), b.column("bucket").to_pylist(), b.column("strings").to_pylist()):
                if held and (fp, bucket) != key:
                    yield merged_shards(held)
                    held = []
                key = (fp, bucket)
                held.append(np.frombuffer(strings, np.int64).reshape(4, -1))
        if held:
            yield merged_shards(held)

    def merged_shards(tables: list[np.ndarray]) -> pa.RecordBatch:
        digest, k1, k2, start = np.concatenate(tables, axis=1)
        ordered = np.sort(digest)
        twice = np.searchsorted(ordered, digest, side="right") - np.searchsorted(ordered, digest, side="left") > 1
        k1, k2, start = k1[twice], k2[twice], start[twice]
        turn = np.lexsort((start, k2, k1))
        k1, k2, start = k1[turn], k2[turn], start[turn]
        first = np.ones(len(start), bool)
        first[1:] = (np.diff(k1) != 0) | (np.diff(k2) != 0) | (np.diff(start) != 1)
        n = np.diff(np.append(np.flatnonzero(first), len(start)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (k1[first], k2[first], start[first], n)], names=["k1", "k2", "start", "n"])

    dealt = packs.repartition("fp", "bucket").sortWithinPartitions("fp", "bucket")
    return dealt.mapInArrow(run, "k1 bigint, k2 bigint, start bigint, n bigint")


def repeats(docs: DataFrame, packed: DataFrame, length: int = LENGTH, per_shard: int = SHARD_CONTEXTS) -> DataFrame:
    """(k1, k2, start, n): runs of starts of repeated strings."""
    anchors = written(_anchors(docs, length))
    # written, as AQE can split a hot anchor in a join of two tables but not where one side is still grouped
    met_again = written(anchors.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"))
    anchors = written(anchors.join(met_again, "fp"))
    contexts = anchors.groupBy("fp", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "a", "n")).alias("one"))
    contexts = written(contexts)
    known = contexts.join(written(contexts.groupBy("fp").agg(F.count("*").alias("kinds"))), "fp")
    copied = contexts.filter("copies > 1").select("fp", "ctx")  # of a written table, for the same reason
    whole = anchors.join(copied, ["fp", "ctx"]).select("k1", "k2", F.col("a").alias("start"), "n")
    salts = F.ceil(F.col("kinds") / per_shard).cast("bigint")
    open_ones = known.filter("kinds > 1").select(
        "one.*", "fp", F.pmod(F.col("ctx"), salts).alias("salt"), salts.alias("salts"), (F.col("copies") == 1).alias("single"))
    sharded = written(_shards(_contexts(open_ones, packed, length), length))
    inside = sharded.filter("strings IS NULL").select("k1", "k2", "start", "n")
    across = _across(sharded.filter("strings IS NOT NULL").select("fp", "bucket", "strings"))
    return whole.unionByName(inside).unionByName(across)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def report(docs: DataFrame, length: int = LENGTH, per_shard: int = SHARD_CONTEXTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. Equal rows are places of their own, so texts of ``length`` bytes or more that occur twice go entirely;
    doc_ids may be null or repeated. Contexts are compared by 128 bits of hashes, strings in a shard by their bytes.
    """
    own = docs.select("doc_id", "text")
    packed = packed_rows(own)
    found = repeats(own, packed, length, per_shard).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for raw, marks in zip(b.column("z"), b.column("runs").to_pylist()):
                text = z.decompress(raw.as_py())
                spans = merged([(m["start"], m["start"] + max(1, m["n"]) - 1 + length) for m in marks or []])
                sha, at = hashlib.sha256(), 0
                for x, y in spans:
                    sha.update(text[at:x])
                    at = y
                sha.update(text[at:])
                out.append((len(text), sum(y - x for x, y in spans), len(spans), sha.hexdigest()))
            columns = [b.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    full = packed.join(found, ["k1", "k2"], "left").select("doc_id", "z", "runs")
    return full.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")

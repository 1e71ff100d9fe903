"""The trie of all prefixes of conversations, and what sharing prefixes saves.

A prefix is known by a polynomial of the digests of its turns modulo a Mersenne prime, which can be put together from pieces: a
conversation of any length is hashed in pieces of bounded length by different tasks. Nodes are groups of equal prefixes. Sums over
subtrees come from an Euler tour: each node's enter and exit arc, ranked distributedly (``euler``), so neither the depth of the trie nor the
number of a node's children bounds what one task does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import discard, written
from doclake.llm.euler import subtree_sums

#: Turns of a conversation that are hashed in one piece; consecutive conv_ids whose decimals are joined before they are digested.
PIECE, BLOCK = 1024, 4096
#: Conversations whose ids agree but for the last two digits may begin with turns of the first of them; at most this many.
FAMILY, HEAD = 100, 5
_PRIME, _BASE = (1 << 127) - 1, 0x2D358DCCAA6C78A5_9E3779B97F4A7C15
_ROOT = bytes(16)


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(c, i, n_own, t, chars), a table: the turns of each conversation numbered from 1, as a digest of role and text.

    Turns are sorted by ranges and numbered by their place in the sorted table, so a conversation with a large part of all rows is
    spread over tasks. Bounds of ranges have only the beginning of role and text, which orders rows as the whole does.
    """
    own = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    begin = [F.substring("role", 1, 32), F.substring("text", 1, 64)]
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    placed = own.repartitionByRange("c", "turn", *begin).sortWithinPartitions("c", "turn", "role", "text").select(
        "c", F.monotonically_increasing_id().alias("at"), digest.alias("t"), F.char_length("text").cast("bigint").alias("chars"))
    placed = written(placed).withColumn("part", F.shiftright("at", 33))
    parts = written(placed.groupBy("c", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")))
    of_one = Window.partitionBy("c")
    before = F.coalesce(F.sum("n").over(of_one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(parts.select("c", "part", "first", before.alias("before"), F.sum("n").over(of_one).alias("n_own")))
    return written(placed.join(starts, ["c", "part"]).select("c", (F.col("at") - F.col("first") + F.col("before") + 1).alias("i"), "n_own", "t", "chars"))


def respliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations begun anew: (c, d, n, t, chars) of their turns and (c, n) of all of them, as tables.

    Conversation c takes its first h turns, h = crc32 of its decimal id modulo 6, from the first conversation of its family, c - c % 100, as far
    as that has any (% with the sign of c), and goes on with its own turns after its first h.
    """
    sizes = written(turns.groupBy("c").agg(F.max("n_own").alias("n_own")))
    plan = sizes.select("c", "n_own", (F.col("c") - F.col("c") % FAMILY).alias("base"), F.crc32(F.col("c").cast("string").cast("binary")).alias("crc"))
    plan = plan.withColumn("h", F.col("crc") % (HEAD + 1)).join(sizes.select(F.col("c").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn(
        "n", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    plan = written(plan.select("c", "base", "h", "taken", "n"))
    rest = turns.join(plan.drop("base"), "c").filter("i > h").select("c", (F.col("taken") + F.col("i") - F.col("h")).alias("d"), "n", "t", "chars")
    heads = turns.filter(f"c % {FAMILY} = 0 AND i <= {HEAD}").select(F.col("c").alias("base"), F.col("i").alias("d"), "t", "chars")
    begun = plan.filter("taken > 0").join(heads, "base").filter("d <= taken").select("c", "d", "n", "t", "chars")
    return written(rest.unionByName(begun)), plan.select("c", "n")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same two tables for conversations that keep their own turns."""
    return (turns.select("c", F.col("i").alias("d"), F.col("n_own").alias("n"), "t", "chars"),
            written(turns.groupBy("c").agg(F.max("n_own").alias("n"))))


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, n, chars, v, pv), a table: the hash of the first d turns of each conversation and of the first d - 1."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, 0
        for b in batches:
            now, before = [], []
            for c, piece, t in zip(b.column("c").to_pylist(), b.column("piece").to_pylist(), b.column("t").to_pylist()):
                if (c, piece) != key:
                    key, value = (c, piece), 0
                before.append(value.to_bytes(16))
                value = (value * _BASE + int.from_bytes(t) + 1) % _PRIME
                now.append(value.to_bytes(16))
            columns = [*(b.column(x) for x in ("c", "piece", "d", "n", "chars")), pa.array(now, pa.binary()), pa.array(before, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "piece", "d", "n", "chars", "v", "pv"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, 0
        for b in batches:
            out = []
            for c, length, v in zip(b.column("c").to_pylist(), b.column("length").to_pylist(), b.column("v").to_pylist()):
                if c != key:
                    key, value = c, 0
                out.append(value.to_bytes(16))
                value = (value * pow(_BASE, length, _PRIME) + int.from_bytes(v)) % _PRIME
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("piece"), pa.array(out, pa.binary())], names=["c", "piece", "start"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = []
            for side, back in (("v", 0), ("pv", 1)):
                both.append(pa.array([
                    ((int.from_bytes(start) * pow(_BASE, (d - 1) % PIECE + 1 - back, _PRIME) + int.from_bytes(v)) % _PRIME).to_bytes(16)
                    for start, d, v in zip(b.column("start").to_pylist(), b.column("d").to_pylist(), b.column(side).to_pylist())], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("c", "d", "n", "chars")), *both], names=["c", "d", "n", "chars", "v", "pv"])

    fields = "d bigint, n bigint, chars bigint, v binary, pv binary"
    dealt = turns.withColumn("piece", F.floor((F.col("d") - 1) / PIECE)).repartition("c", "piece").sortWithinPartitions("c", "piece", "d")
    hashed = written(dealt.select("c", "piece", "d", "n", "t", "chars").mapInArrow(pieces, f"c bigint, piece bigint, {fields}"))
    short, long = hashed.filter(f"n <= {PIECE}").drop("piece"), hashed.filter(f"n > {PIECE}")
    lasts = long.filter(f"d = n OR d % {PIECE} = 0").select("c", "piece", ((F.col("d") - 1) % PIECE + 1).alias("length"), "v")
    starts = written(lasts.repartition("c").sortWithinPartitions("c", "piece").mapInArrow(ends, "c bigint, piece bigint, start binary"))
    whole = long.join(starts, ["c", "piece"]).select("c", "d", "n", "chars", "v", "pv", "start").mapInArrow(put_together, f"c bigint, {fields}")
    out = written(short.unionByName(whole))
    discard(hashed, starts)
    return out


def end_digests(ends: DataFrame) -> DataFrame:
    """(v, ends_sha256): the digest of the ascending decimals of c of each v, comma-joined; ``ends`` is (v, c) without repeats.

    Ids of a block are joined first, wherever they are; the joined texts of a node run through its digest one after the other, and none
    is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for b in batches:
            out = []
            for v, ids in zip(b.column("v").to_pylist(), b.column("ids").to_pylist()):
                if v != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = v, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield batch(out)
        if key is not None:
            yield batch([(key, digest.hexdigest())])

    def batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["v", "ends_sha256"])

    blocks = ends.groupBy("v", F.floor(F.col("c") / BLOCK).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition("v").sortWithinPartitions("v", "block").select("v", "ids").mapInArrow(run, "v binary, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``members`` (c, n) with ``turns`` (c, d, n, t, chars), d from 1 to n.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (childless nodes of the
    subtree, the node included), saved_tokens (over the subtree, (members - 1) times the characters of the last text), ends_sha256 (digest of
    the ids of members that end there). No conversations have no nodes, not even a root.
    """
    paths = prefixes(turns)
    root = members.groupBy().agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        F.lit(_ROOT).alias("v"), F.lit(None).cast("binary").alias("pv"), "conv_id", F.lit(0).cast("bigint").alias("depth"), "n_convs",
        F.lit(0).cast("bigint").alias("chars"))
    shared = paths.groupBy("v").agg(
        F.min("pv").alias("pv"), F.min("c").alias("conv_id"), F.min("d").alias("depth"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"))
    nodes = written(root.unionByName(shared).withColumn("node", F.monotonically_increasing_id()))
    above = nodes.select(F.col("v").alias("pv"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # a table on both sides, so that AQE can split a parent of very many; the root, the parent of most, is put in as a constant
    top = nodes.filter("depth = 0").select("node", "conv_id").collect()
    first = [F.lit(top[0][k] if top else None).cast("bigint").alias(c) for k, c in enumerate(("parent", "parent_conv_id"))]
    none = [F.lit(None).cast("bigint").alias(c) for c in ("parent", "parent_conv_id")]
    named = nodes.filter("depth > 1").join(above, "pv").select(*nodes.columns, "parent", "parent_conv_id").unionByName(
        nodes.filter("depth = 1").select("*", *first)).unionByName(nodes.filter("depth = 0").select("*", *none))
    named = written(named.drop("pv"))
    children = written(named.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    info = written(named.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    weighed = written(info.select("node", "parent", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                                  ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")))
    sums = subtree_sums(weighed, ["n_leaves", "saved_tokens"])
    ends = paths.filter("d = n").select("v", "c").unionByName(members.filter("n = 0").select(F.lit(_ROOT).alias("v"), "c"))
    digests = written(end_digests(ends))
    out = info.join(sums, "node").join(digests, "v", "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the respliced conversations of ``conversations`` (conv_id, turn, role, text).

    Turns are ordered by turn, null first, and equal turns by role and text; equal rows are turns of their own. A null role or text is
    empty; rows without a conv_id belong to no conversation. Other columns are not read; an empty table has an empty result.
    """
    return trie(*respliced(turns_in_order(conversations)))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are; rows as in ``report``."""
    return trie(*as_they_are(turns_in_order(conversations)))

"""Euler tours of forests of any shape and their ranks, as joins of tables.

Every node has an enter and an exit arc; the tour goes down to the first child, on to the next sibling, and up behind the last one.
The tour is ranked without walking it: a sample of arcs are rulers, every arc jumps along the arcs ahead (doubling its jump each
round) until it stands before a ruler, the list of rulers, a sixteenth as long, is ranked in the same way, and each arc adds the rank of
its ruler. A list of a bounded number of arcs is walked in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import discard, written

#: One arc of so many is a ruler; arcs of a list that one task walks; children of a node that are put in order together.
RULERS, WALKED, SIBLINGS = 16, 16384, 4096


def tour(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """(arc, next, …) of a forest; ``nodes`` is a table (node, parent, and ``weights``), roots have a null parent.

    Node v enters by arc 2 v, which has the weights, and leaves by 2 v + 1, which has none. The children of a node are ordered by a
    hash in groups of about SIBLINGS, so that a node with very many children is no task of its own; only the heads of its groups
    stand in one window.
    """
    children = nodes.filter("parent IS NOT NULL").select("node", "parent")
    sizes = written(children.groupBy("parent").agg(F.count("*").alias("n")))
    groups = F.ceil(F.col("n") / SIBLINGS)
    placed = children.join(sizes, "parent").select("node", "parent", F.pmod(F.xxhash64("node"), groups).alias("part"))
    in_part = Window.partitionBy("parent", "part").orderBy("node")
    placed = written(placed.select("*", F.lead("node").over(in_part).alias("then"), F.row_number().over(in_part).alias("at")))
    heads = placed.filter("at = 1").select("parent", "part", "node")
    along = Window.partitionBy("parent").orderBy("part")
    heads = written(heads.select("parent", "part", F.col("node").alias("head"), F.lead("node").over(along).alias("after"),
                                 F.row_number().over(along).alias("at")))
    # the last of a group goes on to the head of the next one
    last = placed.filter("then IS NULL").join(heads.select("parent", "part", "after"), ["parent", "part"]).select("node", "parent", F.col("after").alias("then"))
    onward = placed.filter("then IS NOT NULL").select("node", "parent", "then").unionByName(last)
    first = heads.filter("at = 1").select(F.col("parent").alias("node"), F.col("head").alias("down"))
    enter = nodes.join(first, "node", "left").select(
        (F.col("node") * 2).alias("arc"), F.coalesce(F.col("down") * 2, F.col("node") * 2 + 1).alias("next"), *weights)
    leave = onward.select((F.col("node") * 2 + 1).alias("arc"), F.coalesce(F.col("then") * 2, F.col("parent") * 2 + 1).alias("next"))
    roots = nodes.filter("parent IS NULL").select((F.col("node") * 2 + 1).alias("arc"), F.lit(None).cast("bigint").alias("next"))
    none = [F.lit(0).cast("bigint").alias(w) for w in weights]
    return enter.unionByName(leave.unionByName(roots).select("arc", "next", *none))


def _is_ruler(arc: Column, level: int) -> Column:
    """Whether an arc is a ruler; another sixteenth of what is left at each level."""
    return F.pmod(F.xxhash64(F.lit(level), arc), F.lit(RULERS)) == 0


def ranked(arcs: DataFrame, weights: list[str], level: int = 0) -> DataFrame:
    """(arc, and the sums of ``weights`` from each arc to the end of its list), a table; ``arcs`` is a table (arc, next, weights)."""
    if arcs.count() <= WALKED:
        return _walked(arcs, weights)
    # state: the sum from an arc up to, not with, the arc ``next``; done where that is a ruler or the end
    done = F.col("next").isNull() | _is_ruler(F.col("next"), level)
    parts = [arcs.filter(done).select("arc", "next", *weights)]
    active, made = written(arcs.filter(~done).select("arc", "next", *weights)), []
    while not active.isEmpty():
        ahead = active
        for part in parts:
            ahead = ahead.unionByName(part)
        ahead = ahead.select(F.col("arc").alias("next"), F.col("next").alias("far"), *[F.col(w).alias(f"more_{w}") for w in weights])
        moved = active.join(ahead, "next").select(
            "arc", F.col("far").alias("next"), *[(F.col(w) + F.col(f"more_{w}")).alias(w) for w in weights])
        moved = written(moved)
        made.append(active)
        parts.append(moved.filter(done))
        active = written(moved.filter(~done))
        made.append(moved)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = written(whole)
    discard(active, *made)
    sparse = written(whole.filter(_is_ruler(F.col("arc"), level)))
    rulers = ranked(sparse, weights, level + 1)
    ahead = rulers.select(F.col("arc").alias("next"), *[F.col(w).alias(f"more_{w}") for w in weights])
    out = written(whole.join(ahead, "next", "left").select(
        "arc", *[(F.col(w) + F.coalesce(f"more_{w}", F.lit(0))).alias(w) for w in weights]))
    discard(whole, sparse, rulers)
    return out


def _walked(arcs: DataFrame, weights: list[str]) -> DataFrame:
    """The same for a table of at most WALKED arcs, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follows: dict[int, int | None] = {}
        own: dict[int, tuple[int, ...]] = {}
        for b in batches:
            for arc, then, *values in zip(*[b.column(c).to_pylist() for c in ("arc", "next", *weights)]):
                follows[arc], own[arc] = then, tuple(values)
        sums: dict[int, tuple[int, ...]] = {}
        for start in follows:
            path, at = [], start
            while at is not None and at not in sums:
                path.append(at)
                at = follows[at]
            total = sums[at] if at is not None else (0,) * len(weights)
            for at in reversed(path):
                total = tuple(x + y for x, y in zip(total, own[at]))
                sums[at] = total
        columns = [list(sums), *([v[k] for v in sums.values()] for k in range(len(weights)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["arc", *weights])

    fields = ", ".join(f"{c} bigint" for c in ("arc", *weights))
    return written(arcs.select("arc", "next", *weights).repartition(1).mapInArrow(run, fields))


def subtree_sums(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """(node, and the sum of each of ``weights`` over the subtree of the node): what the tour has from its enter to its exit arc."""
    arcs = written(tour(nodes, weights))
    sums = ranked(arcs, weights)
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    return sums.groupBy(F.shiftright("arc", 1).alias("node")).agg(*[F.sum(sign * F.col(w)).alias(w) for w in weights])

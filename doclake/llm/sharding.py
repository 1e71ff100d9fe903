"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new ones of given capacities.

Only block totals (a bounded number) reach the driver. Each old shard is a line of bytes, in blocks of documents by a hash of
their ids; the flow cuts that line into intervals, one for each new shard, and a document goes where its middle byte lies.
"""

from __future__ import annotations

import heapq
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclake.llm.common import written

#: Blocks of each old shard. Positions are counted inside blocks, so no task ever orders a whole shard.
BLOCKS = 1024


def equal_capacities(total: int, shards: int) -> list[int]:
    """Capacities that sum to ``total`` and differ by at most one byte."""
    return [total // shards + (1 if i < total % shards else 0) for i in range(shards)]


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """{(old, new): bytes} that ships all of ``supply`` within ``capacity`` at the least total cost.

    Successive shortest paths with potentials; the graph has one node for each old and each new shard. ``cost(old, new)`` >= 0
    is the price of a byte.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("capacities are too small")
    n, m = len(supply), len(capacity)
    flow = {(i, j): 0 for i in range(n) for j in range(m)}
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    while any(left):
        # shortest path from any old shard with bytes left to any new shard with room, over residual edges
        dist = [0 - potential[i] if i < n and left[i] else float("inf") for i in range(n + m)]
        low = min(d for d in dist if d != float("inf"))
        dist = [d - low if d != float("inf") else d for d in dist]
        before: list[int | None] = [None] * (n + m)
        queue = [(d, v) for v, d in enumerate(dist) if d != float("inf")]
        heapq.heapify(queue)
        while queue:
            d, v = heapq.heappop(queue)
            if d > dist[v]:
                continue
            edges = [(n + j, cost(v, j)) for j in range(m)] if v < n else [(i, -cost(i, v - n)) for i in range(n) if flow[i, v - n]]
            for to, price in edges:
                nd = d + price + potential[v] - potential[to]
                if nd < dist[to]:
                    dist[to], before[to] = nd, v
                    heapq.heappush(queue, (nd, to))
        potential = [p + (d if d != float("inf") else 0) for p, d in zip(potential, dist)]
        end = min((v for v in range(n, n + m) if room[v - n] and dist[v] != float("inf")), key=lambda v: potential[v])
        path = [end]
        while before[path[-1]] is not None:
            path.append(before[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([left[path[0]], room[end - n], *[flow[b, a - n] for a, b in steps if a >= n]])
        for a, b in steps:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return {k: v for k, v in flow.items() if v}


def sized(docs: DataFrame, old_shard: Column) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one; a null text has none), text_crc32, old_shard and the block of each row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = docs.select(
        "doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"))
    return out.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BLOCKS)).cast("int"))


def layout(narrow: DataFrame, n_old: int, capacities: list[int] | int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Rows of ``sized`` with ``shard`` and ``slot`` (gapless from 0 in each shard), and the flow that was solved.

    ``capacities`` are bytes for each new shard, or a number of shards of equal capacity. Old shard i stays in new shard i as far
    as capacities allow. Equal rows may swap slots; every other choice follows from doc_id, checksum and size.
    """
    blocks = narrow.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"))
    totals = {r["old_shard"]: r["bytes"] for r in blocks.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}
    supply = [totals.get(i, 0) for i in range(n_old)]
    if isinstance(capacities, int):
        capacities = equal_capacities(sum(supply), capacities)
    flow = min_cost_flow(supply, capacities, lambda i, j: 0 if i == j else 1)
    # at most n_old * BLOCKS rows
    starts = blocks.select("old_shard", "block", (F.sum("bytes").over(
        W.partitionBy("old_shard").orderBy("block")) - F.col("bytes")).alias("start"))
    inside = W.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    rows = narrow.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "nth", F.row_number().over(inside))
    middle = F.col("start") + F.col("upto") - F.floor(F.col("size") / 2)
    placed = rows.join(F.broadcast(starts), ["old_shard", "block"]).withColumn("shard", _destination(flow, n_old, middle))
    parts = placed.groupBy("old_shard", "block", "shard").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    # at most one row for each block and cut
    bases = parts.select("old_shard", "block", "shard", "first", (F.sum("n").over(
        W.partitionBy("shard").orderBy("old_shard", "block")) - F.col("n")).alias("base"))
    out = placed.join(F.broadcast(bases), ["old_shard", "block", "shard"])
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", (
        F.col("base") + F.col("nth") - F.col("first")).cast("bigint").alias("slot")), flow


def _destination(flow: dict[tuple[int, int], int], n_old: int, position: Column) -> Column:
    """New shard of a byte position: what stays comes first in each old shard, then the moves in order of the new shard."""
    by_old = F.lit(0)
    for i in range(n_old):
        cuts, upto = [], 0
        for j, amount in sorted(((j, v) for (o, j), v in flow.items() if o == i), key=lambda x: (x[0] != i, x[0])):
            upto += amount
            cuts.append((upto, j))
        if cuts:
            inner = reduce(lambda rest, c: F.when(position <= c[0], F.lit(c[1])).otherwise(rest), reversed(cuts[:-1]), F.lit(cuts[-1][1]))
            by_old = F.when(F.col("old_shard") == i, inner).otherwise(by_old)
    return by_old.cast("int")


def report(docs: DataFrame, n_old: int = 6, n_new: int = 8) -> DataFrame:
    """Documents laid out by source over ``n_old`` shards, moved to ``n_new`` shards of near equal bytes.

    One row per row: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null under this law), old_shard. Null
    sources start in shard 0; null texts have size 1; null doc_ids are ordered first; equal texts may lie in different shards, as
    one group of copies can exceed a shard.
    """
    source = F.when(F.col("source").isNotNull(), F.pmod(F.xxhash64("source"), F.lit(n_old)))
    placed, _ = layout(written(sized(docs, source)), n_old, n_new)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def rewrite(docs: DataFrame, old_shard: Column, n_old: int, capacities: list[int] | int, folder: str) -> list[int]:
    """Write the shards whose content changes as ``folder/shard=N`` and return their numbers; ``plan.json`` lists all moves.

    A new shard that is exactly an old one (nothing moves in or out) keeps its files and is not written. Equal rows of one
    (doc_id, checksum, size) are dealt out in any order. Rows go to their shards by one join on these keys.
    """
    narrow = written(sized(docs, old_shard))
    placed, flow = layout(narrow, n_old, capacities)
    n_new = capacities if isinstance(capacities, int) else len(capacities)
    moved = {j for (i, j) in flow if i != j} | {i for (i, j) in flow if i != j}
    changed = sorted(j for j in range(n_new) if j in moved or j >= n_old)
    nth = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))
    keys = ["doc_id", "text_crc32", "size"]
    where = placed.filter(F.col("shard").isin(changed)).withColumn("__nth", nth(*keys))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.withColumn("text_crc32", F.crc32(raw)).withColumn("size", (F.octet_length(raw) + 1).cast("bigint")).withColumn("__nth", nth(*keys))
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(where[k]) for k in [*keys, "__nth"]])
    out = rows.join(where, same).select(*[rows[c] for c in docs.columns], where["shard"], where["slot"])
    out.repartition("shard", F.floor(F.col("slot") / 100_000)).write.mode("overwrite").partitionBy("shard").parquet(folder)
    plan = [{"from": i, "to": j, "bytes": v} for (i, j), v in sorted(flow.items()) if i != j]
    docs.sparkSession.createDataFrame([(json.dumps(plan),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}_plan")
    return changed

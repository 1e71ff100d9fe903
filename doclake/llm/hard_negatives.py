"""Hard negatives: for an anchor and each of its best positives, the best rows of other labels within a window of the positive's score.

All rows meet all anchors in tiles: packed matrices of rows and of anchors come together in a task by a secondary sort, the anchors first,
so only one tile of anchors and one of rows are in memory. No pair leaves a task that cannot be part of the result: the first pass
sends each task's best positives of an anchor; when the positives are known, the second pass sends each task's best rows of every window.
Those pairs are packed into keys (anchor, descending score, id) and sorted within hash partitions of the anchors. A streaming pass
over the sorted keys opens a window at every positive and emits the negatives that follow, without gathering the pairs of an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from doclake.llm.common import written

#: Positives of an anchor, negatives of a positive; bounds of a negative's score in per cent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows of a tile; anchors of a tile; anchors that are multiplied with a tile of rows at a time.
TILE, ANCHORS, STEP = 4096, 1024, 128
#: Anchors of the registered query and rows that change their label have ids divisible by these; labels; scale of the components.
EVERY, MOVED, CLASSES, SCALE = 100, 7, 10, 256

_MOST = (1 << 63) - 1
_TILE = "q bigint, more array<array<bigint>>, keys binary, ids binary, labels binary, width bigint, short boolean, data binary"
_NAMES = ["keys", "ids", "labels", "width", "short", "data"]


def matrix(vectors: pa.ListArray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component; vectors with fewer components than the longest are filled with zeros."""
    sizes = np.asarray(vectors.value_lengths())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def packed(keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, data: np.ndarray) -> list:
    """A tile of rows as one row; numbers below 2**15 take two bytes."""
    short = bool(np.abs(data).max(initial=0) < 1 << 15)
    raw = data.astype(np.int16 if short else np.float64).tobytes()
    return [keys.tobytes(), ids.tobytes(), labels.tobytes(), data.shape[1], short, raw]


def unpacked(row: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, ids, labels, width, short, raw = row
    ids = np.frombuffer(ids, np.int64)
    data = np.frombuffer(raw, np.int16 if short else np.float64).astype(np.float64).reshape(len(ids), width)
    return np.frombuffer(keys, np.int64), ids, np.frombuffer(labels, np.int64), data


def tiles(items: DataFrame, key: str, scale: float, group: str | None = None) -> DataFrame:
    """Packed tiles of ``items`` (id, label, vector, ``key``, and perhaps scores): TILE rows of a task, or all rows that share ``group``.

    Groups are hash groups of about ANCHORS rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            of = b.column(group).to_numpy() if group else np.arange(len(b)) // TILE
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                if not len(part):
                    continue
                now = b.slice(part[0], len(part))
                if held and (sum(map(len, held)) + len(now) > TILE if not group else held[-1].column(group)[0] != now.column(group)[0]):
                    yield tile(held)
                    held = []
                held.append(now)
        if held:
            yield tile(held)

    def tile(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        ident = [whole[c].to_numpy() for c in (key, "id", "label")]
        row = packed(*ident, matrix(pa.concat_arrays(whole["vector"].chunks), scale))
        values = [whole[group][0].as_py() if group else 0, whole["scores"].to_pylist() if with_scores else None, *row]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, to_arrow_schema(schema))], names=schema.names)

    with_scores = "scores" in items.columns
    schema = T.StructType.fromDDL(_TILE)
    dealt = items.select(*dict.fromkeys([*([group] if group else []), key, "id", "label", "vector", *(["scores"] if with_scores else [])]))
    if group:
        dealt = dealt.repartition(group).sortWithinPartitions(group)
    return dealt.mapInArrow(run, schema)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exactly; missing components are zero, products beyond a long are the nearest long but one."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, -_MOST, _MOST).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` by descending score, ties by id."""
    if len(ids) > count:
        near = scores >= np.partition(scores, len(scores) - count)[len(scores) - count]
        ids, scores = ids[near], scores[near]
    turn = np.lexsort((ids, -scores))[:count]
    return ids[turn], scores[turn]


def bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score of a negative of a positive with this score."""
    return -(-low * score // 100), high * score // 100


def met(rows: DataFrame, anchors: DataFrame, n_groups: int, n_salts: int, keep) -> DataFrame:
    """(a, id, score) of what ``keep`` selects for an anchor among the rows of a task.

    ``rows`` and ``anchors`` are tiles; ``keep`` takes (anchor's id, label, scores that it asks for, ids, labels, scores) and returns ids and
    scores, and is applied again to what it has kept of several tiles (with labels null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor, state = None, None, {}
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].as_py() for c in ("q", "s", "is_row", "more", *_NAMES)}
                if (row["q"], row["s"]) != key:
                    yield from flushed(anchor, state)
                    key, anchor, state = (row["q"], row["s"]), None, {}
                tile = unpacked([row[c] for c in _NAMES])
                if not row["is_row"]:
                    anchor = (tile, row["more"])
                elif anchor is not None:
                    compare(anchor, state, tile)
        yield from flushed(anchor, state)

    def compare(anchor, state, tile) -> None:
        (_, own, own_labels, data), more = anchor
        _, ids, labels, vectors = tile
        for at in range(0, len(own), STEP):
            scores = products(data[at : at + STEP], vectors)
            for k in range(len(scores)):
                x = at + k
                found = keep(own[x], own_labels[x], more[x] if more else None, ids, labels, scores[k])
                if x in state:
                    both = (np.concatenate(p) for p in zip(state[x], found))
                    found = keep(own[x], own_labels[x], more[x] if more else None, next(both), None, next(both))
                state[x] = found

    def flushed(anchor, state) -> Iterator[pa.RecordBatch]:
        if state:
            keys = anchor[0][0]
            a = np.concatenate([np.full(len(v[0]), keys[x]) for x, v in state.items()])
            ids, scores = (np.concatenate([v[k] for v in state.values()]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids), pa.array(scores)], names=["a", "id", "score"])

    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    own = rows.drop("q").select(each(n_groups).alias("q"), "*").withColumns(
        {"s": F.pmod(F.xxhash64("ids", "data"), F.lit(n_salts)), "is_row": F.lit(True)})
    asked = anchors.select("*", each(n_salts).alias("s")).withColumn("is_row", F.lit(False))
    dealt = own.unionByName(asked).repartition("q", "s").sortWithinPartitions("q", "s", "is_row")
    return dealt.mapInArrow(run, "a bigint, id bigint, score bigint")


def sort_key(a: Column, score: Column, ident: Column) -> Column:
    """24 bytes whose order is that of (a, descending score, id)."""
    least = F.lit(-_MOST - 1)
    parts = [a.bitwiseXOR(least), F.bitwise_not(score).bitwiseXOR(least), ident.bitwiseXOR(least)]
    return F.unhex(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts]))


def windows(pairs: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """Results of ``pairs`` (anchor_id, key, positive) by a stream over the sorted keys of an anchor.

    A window lies below its positive, so what belongs to it follows; only where a positive's score is zero can negatives of the same
    score have come before, and the first of these are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ones, zeros = None, [], []
        for b in batches:
            out = []
            for anchor, key, positive in zip(b.column("anchor_id").to_pylist(), b.column("key").to_pylist(), b.column("positive").to_pylist()):
                if key[:8] != now:
                    now, open_ones, zeros = key[:8], [], []
                score, ident = _MOST - int.from_bytes(key[8:16]), int.from_bytes(key[16:]) - _MOST - 1
                if positive:
                    window = [*bounds(score, low, high), 0, ident, score]
                    open_ones.append(window)
                    for other in zeros if score == 0 else []:
                        window[2] += 1
                        out.append((anchor, ident, window[2], other, score, 0))
                    continue
                for w in open_ones:
                    if w[0] <= score <= w[1] and w[2] < negatives:
                        w[2] += 1
                        out.append((anchor, w[3], w[2], ident, w[4], score))
                open_ones = [w for w in open_ones if w[2] < negatives and w[0] <= score]
                if score == 0 and len(zeros) < negatives:
                    zeros.append(ident)
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.int32() if n == "rank" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    dealt = pairs.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key", F.desc("positive"))
    return dealt.mapInArrow(run, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def mine(
    items: DataFrame, is_anchor: Column, scale: float = 1.0, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``items`` (id, label, vector).

    Scores are inner products of the vectors, components floor(scale * x). An anchor's positives are the first ``positives`` other ids of its
    label by descending score, ties by id; a positive's negatives the first ``negatives`` rows of other labels whose score lies between
    ``low`` and ``high`` per cent of the positive's. Equal anchors are one; other repeated rows are rows of their own. A null id stands
    behind all others.
    """
    items = items.select(F.coalesce(F.col("id").cast("bigint"), F.lit(_MOST)).alias("id"), F.col("label").cast("bigint").alias("label"), "vector")
    anchors = written(items.filter(is_anchor).dropDuplicates(["id", "label", "vector"]).withColumn("a", F.monotonically_increasing_id()))
    rows = written(tiles(items, "id", scale))
    n_groups = max(1, -(-anchors.count() // ANCHORS))
    spread = 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_salts = max(1, min(spread, rows.count()))
    anchors = anchors.withColumn("q", F.pmod(F.xxhash64("a"), F.lit(n_groups)))

    def same(ident, label, _, ids, labels, scores):
        if labels is not None:
            fit = (labels == label) & (ids != ident)
            ids, scores = ids[fit], scores[fit]
        return best(ids, scores, positives)

    def other(ident, label, wanted, ids, labels, scores):
        if labels is not None:
            fit = labels != label
            ids, scores = ids[fit], scores[fit]
        chosen = np.zeros(len(ids), bool)
        for score in wanted:
            least, most = bounds(score, low, high)
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            if len(inside) > negatives:
                inside = inside[np.lexsort((ids[inside], -scores[inside]))[:negatives]]
            chosen[inside] = True
        return ids[chosen], scores[chosen]

    found = met(rows, tiles(anchors, "a", scale, "q"), n_groups, n_salts, same)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    found = written(found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= positives).drop("at"))
    wanted = found.groupBy("a").agg(F.sort_array(F.collect_set("score")).alias("scores"))  # at most ``positives`` of them
    negative = met(rows, tiles(anchors.join(wanted, "a"), "a", scale, "q"), n_groups, n_salts, other)
    pairs = negative.withColumn("positive", F.lit(False)).unionByName(found.withColumn("positive", F.lit(True)))
    named = pairs.join(anchors.select("a", F.col("id").alias("anchor_id")), "a").select(
        "anchor_id", sort_key(F.col("a"), F.col("score"), F.col("id")).alias("key"), "positive")
    out = windows(named, negatives, low, high)
    known = lambda c: F.when(F.col(c) != _MOST, F.col(c)).alias(c)
    return out.select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, embedding, label), rows as in ``mine``; anchors are ids divisible by EVERY.

    Rows with a null label, a null vector or a component that is null or not finite take no part. Where vec_id is divisible by MOVED, the
    label is (label + 1) modulo CLASSES. A null vec_id is no anchor and stays null, behind other ids. Vectors of different lengths are filled
    with zeros. Other columns are not read; an empty table has an empty result.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    label = F.col("label").cast("bigint")
    rows = embeddings.filter("label IS NOT NULL AND embedding IS NOT NULL").filter(F.forall("embedding", finite)).select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % MOVED == 0, (label + 1) % CLASSES).otherwise(label).alias("label"),
        F.col("embedding").alias("vector"))
    return mine(rows, F.col("id") % EVERY == 0, SCALE)

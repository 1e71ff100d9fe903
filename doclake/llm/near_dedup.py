"""Near-duplicate documents by consistent weighted sampling.

Documents are weighted sets of five-word shingles: occurrences times the mean inverse document frequency of the shingle's words.
Improved consistent weighted sampling draws samples whose collision probability is the weighted Jaccard similarity; bands of
samples make buckets, candidates of a bucket are verified by the exact weighted Jaccard similarity, and links are closed to classes. A
bucket's members first meet one of them; where that does not connect them all, the rest meet each other in blocks (``blocks``). Equal
texts are one item from the start.

Document frequencies are kept for a fixed number of word slots (words with one hash remainder share theirs), so the table that
every task gets has the same size for any corpus, while the counts cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm import shingles
from doclake.llm.blocks import block_links
from doclake.llm.common import written
from doclake.llm.linking import connect, shared_buckets

#: Slots of words for document frequencies.
SLOTS = 1 << 20
#: Similarity from which two documents are near-duplicates; bands of samples.
THRESHOLD, BANDS, ROWS = 0.8, 10, 4
#: Samples that two documents must have in common before their texts are compared. A pair of similarity 0.8 has 32 of the 40 on
#: average and fewer than 20 five times in a million; one of 0.3 has 20 once in 160 times.
AGREE = 20
#: Shingles that are sampled at a time.
BLOCK = 2048


def node(text):
    """Identity of a text: rows with equal texts (null counts as empty) are one item. 64 bits: for n different texts about
    n * n / 2**65 pairs share one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def word_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with a word of each slot, and the number of documents, over all rows of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, rows = shingles.WordIds(), np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                rows += 1
                counts[np.unique(shingles.word_hashes(t.as_py() or "", ids) % np.uint64(SLOTS)).astype(np.int64)] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(counts[used], rows), pa.int64())], names=["slot", "n"])

    found = texts.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS + 1 rows
    slots, counts = (found.column(c).to_numpy() for c in ("slot", "n"))
    out = np.zeros(SLOTS, np.int64)
    out[slots[slots >= 0]] = counts[slots >= 0]
    return out, int(counts[slots < 0].sum())


def inverse(frequencies: np.ndarray, total: int) -> np.ndarray:
    """Smoothed inverse document frequency of each slot, at least one."""
    return (1 + np.log((1 + total) / (1 + frequencies))).astype(np.float32)


def _counted(text: str, idf: np.ndarray, ids: shingles.WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a text in order, how often each occurs, and its mean inverse document frequency."""
    words = shingles.word_hashes(text, ids)
    if not len(words):
        return words, np.zeros(0, np.int64), np.zeros(0, np.float32)
    all_ = shingles.of_words(words)
    size = min(shingles.SIZE, len(words))
    own = idf[(words % np.uint64(SLOTS)).astype(np.int64)]
    means = np.convolve(own, np.ones(size, np.float32) / size, "valid")
    found, first, counts = np.unique(all_, return_index=True, return_counts=True)
    return found, counts, means[first]


def weighted(text: str, idf: np.ndarray, ids: shingles.WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text in order, and their weights."""
    found, counts, means = _counted(text, idf, ids)
    return found, (counts * means).astype(np.float32)


def occurrences(text: str, idf: np.ndarray, ids: shingles.WordIds) -> tuple[np.ndarray, np.ndarray]:
    """The same weighted set with an element for the first, second, … occurrence of each shingle, all of one weight."""
    found, counts, means = _counted(text, idf, ids)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return shingles.mixed(np.repeat(found, counts) + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), np.repeat(means, counts)


def _uniform(x: np.ndarray, shift: int) -> np.ndarray:
    """Numbers in (0, 1) from 24 bits of a hash."""
    return ((x >> np.uint64(shift)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24) + np.float32(2.0**-25)


def samples(found: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """Improved consistent weighted sampling: for each of ``count`` samples, a hash of the shingle and the level it was drawn at.

    With r and c from Gamma(2, 1) and b uniform, all functions of (shingle, sample): t = floor(ln w / r + b), ln y = r (t - b), and the
    shingle with the smallest ln c - ln y - r is drawn.
    """
    log_w = np.log(weights)
    seeds = shingles.mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    best, chosen = np.full(count, np.inf, np.float32), np.zeros(count, np.uint64)
    for start in range(0, len(found), BLOCK):
        x = found[start : start + BLOCK, None] ^ seeds[None, :]
        lw = log_w[start : start + BLOCK, None]
        h1 = shingles.mixed(x)
        h2 = shingles.mixed(h1 + np.uint64(1))
        r = -np.log(_uniform(h1, 0) * _uniform(h1, 24))
        log_c = np.log(-np.log(_uniform(h2, 0) * _uniform(h2, 24)))
        b = ((h1 >> np.uint64(48)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
        t = np.floor(lw / r + b)
        value = log_c - r * (t - b + 1)
        k = value.argmin(axis=0)
        columns = np.arange(count)
        low = value[k, columns]
        better = low < best
        drawn = shingles.mixed(found[start + k] + shingles.mixed(t[k, columns].astype(np.int64).view(np.uint64)))
        best, chosen = np.where(better, low, best), np.where(better, drawn, chosen)
    return chosen


def bands(texts: DataFrame, idf: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(bucket, id, sketch): the bucket keys of items (id, text) that have words, and a byte of each of their samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights, seen = shingles.WordIds(), idf, set()
        salts = shingles.mixed(np.arange(1, n_bands + 1, dtype=np.uint64))
        for b in batches:
            keys, owners, sketches = [], [], []
            for owner, t in zip(b.column("id").to_pylist(), b.column("text")):
                if owner in seen:  # an equal text of this task
                    continue
                seen.add(owner)
                found, w = weighted(t.as_py() or "", weights, ids)
                if not len(found):
                    continue
                drawn = samples(found, w, n_bands * rows).reshape(n_bands, rows)
                key = salts.copy()
                for k in range(rows):
                    key = shingles.mixed(key + drawn[:, k])
                keys.append(key)
                owners += [owner] * n_bands
                sketches.append(np.tile(drawn.ravel().astype(np.uint8).view(np.int8), n_bands))
            if keys:
                width = n_bands * rows
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(owners) + 1) * width, pa.int32()), pa.array(np.concatenate(sketches), pa.int8()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(owners, pa.int64()), sketch], names=["bucket", "id", "sketch"])

    return texts.select("id", "text").mapInArrow(run, "bucket bigint, id bigint, sketch array<tinyint>")


def alike(a: Column, b: Column) -> Column:
    """Whether two sketches agree in AGREE samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) >= AGREE


def packed(texts: DataFrame) -> DataFrame:
    """(id, z): texts compressed, as they are moved by joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [z.compress((t.as_py() or "").encode("utf-8", "replace")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(raw, pa.binary())], names=["id", "z"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, z binary")


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum()) + float(b[1].sum()) - least
    return least / whole if whole else 0.0


def similar_pairs(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose weighted Jaccard similarity reaches ``threshold``; ``texts`` (id, z) has both sides.

    Texts are joined to pairs and never gathered by item, so AQE can split a hot item; rows arrive sorted by ``a``, whose set is kept
    from one row to the next.
    """
    left = texts.select(F.col("id").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("id").alias("b"), F.col("z").alias("zb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, z = shingles.WordIds(), zstandard.ZstdDecompressor()
        last: dict[str, tuple[int | None, tuple]] = {"a": (None, ()), "b": (None, ())}

        def vector(side: str, owner: int, raw: pa.Scalar):
            if last[side][0] != owner:
                last[side] = (owner, weighted(z.decompress(raw.as_py()).decode(), idf, ids))
            return last[side][1]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            same = [jaccard(vector("a", x, p), vector("b", y, q)) >= threshold for x, y, p, q in zip(
                a, b, batch.column("za"), batch.column("zb"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(same))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "za", "zb").mapInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, comp): the class of each item that is linked to another item; items are ``node`` of the texts."""
    own = docs.select(node(F.col("text")).alias("id"), "text")
    frequencies, total = word_frequencies(docs.select("text"))
    idf = inverse(frequencies, total)
    members = shared_buckets(written(bands(own, idf).distinct()))
    wanted = members.select("id").distinct()
    texts = written(packed(own.join(wanted, "id", "left_semi").dropDuplicates(["id"])))

    def vector():
        ids, z = shingles.WordIds(), zstandard.ZstdDecompressor()
        return lambda raw: occurrences(z.decompress(raw).decode(), idf, ids)

    found = connect(members, lambda pairs: similar_pairs(pairs, texts, idf, threshold), alike,
                    lambda open_ones: block_links(open_ones, texts, vector, threshold))
    return found.withColumnRenamed("id", "item")


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest doc_id of its class), class_size (rows), kept.

    Rows with equal texts are in one class, as are rows whose texts are connected by pairs of at least ``threshold``. Wordless and
    null texts are one class of equal texts. A row is kept if its doc_id is the smallest of its class; null doc_ids come last, and a
    class without any id has a null class_id and its rows are kept.
    """
    own = docs.select("doc_id", node(F.col("text")).alias("item"))
    named = own.join(classes(docs, threshold), "item", "left").select("doc_id", F.coalesce("comp", "item").alias("comp"))
    named = written(named)
    heads = written(named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return named.join(heads, "comp").select(
        "doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the one with the smallest doc_id (nulls last).

    Of the rows that share this id, the one with the smallest item hash stays, and of equal rows any one.
    """
    keyed = docs.withColumn("__item", node(F.col("text")))
    named = keyed.select("doc_id", F.col("__item").alias("item")).join(classes(docs, threshold), "item", "left").select(
        "doc_id", "item", F.coalesce("comp", "item").alias("comp"))
    heads = named.groupBy("comp").agg(F.min_by(
        F.struct("doc_id", "item"), F.struct(F.col("doc_id").isNull(), "doc_id", "item")).alias("h")).select("h.*")
    heads = heads.select(F.col("doc_id").alias("__id"), F.col("item").alias("__head"))
    hit = (F.col("__item") == F.col("__head")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return keyed.join(heads, hit, "left_semi").dropDuplicates(["__item", "doc_id"]).select(*docs.columns)

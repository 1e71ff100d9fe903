"""Repeated passages: paragraphs that are near-copies of others, and runs of words that stand in an earlier document.

A paragraph is a line of enough words, or neighbouring shorter lines. MinHash signatures of its five-word shingles are cut into bands
tuned for high recall, colliding paragraphs are verified by their exact Jaccard similarity or by their edit distance in words, and links
are closed to classes, of which the first occurrence stays.

A passage inside larger paragraphs makes no similar paragraphs. So windows of WINDOW words are matched, too: of their hashes, the least of
every STRETCH neighbours is kept, so a passage of PASSAGE words has a kept window in common wherever it stands, whatever surrounds it.
Documents that share one are read again around it, all windows there are matched, and runs of PASSAGE words and more are cut exactly.

Words are compared without case and without punctuation around them; nothing depends on sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm import shingles
from doclake.llm.blocks import block_links
from doclake.llm.common import row_key, settled, written
from doclake.llm.linking import connect
from doclake.llm.shingles import mixed
from doclake.llm.suffix_dedup import sliding_minimum

#: Words of a paragraph; words from which neighbouring short lines are cut into several paragraphs.
MIN_WORDS, LONG_RUN = 40, 160
#: Jaccard similarity or share of unedited words of near-copies; bands and rows: at 0.8 a pair shares a bucket with probability 0.999, at
#: 0.7, as three edits in 90 words make it, with 0.986.
THRESHOLD, UNEDITED, BANDS, ROWS = 0.8, 0.9, 10, 3
#: Of 16 samples of four bits, those that must agree before words are compared: a pair of similarity 0.8 has fewer four times in
#: a hundred thousand, one of 0.7 once in a thousand.
AGREE = 6
#: Words of a matched window, of a passage; neighbouring windows of which one is kept.
WINDOW, PASSAGE = 40, 50
STRETCH = PASSAGE - WINDOW + 1

#: Characters of texts that are marked together, of what is cut into words at a time.
TOGETHER, PIECE = 200_000, 1 << 20

_AROUND = "!\"#%&'()*+,-./:;<=>?@[]^_`{|}~«»„“”‘’…–—¿¡"
# white space is 1, what may stand around words 2; no such character is beyond the last place
_KINDS = np.zeros(0x3002, np.uint8)
_KINDS[[c for c in range(len(_KINDS)) if chr(c).isspace()]] = 1
_KINDS[[ord(c) for c in _AROUND]] = 2
_SPACE = re.compile(r"\s")
_BASE = 0x5851F42D4C957F2D


class NormalIds:
    """Hash of each word without case and punctuation around it, kept for words met before.

    A word has one place by a hash of its characters as they are; another word of this place takes it over.
    """

    PLACES = 20  # a power of two

    def __init__(self) -> None:
        self.words, self.values = np.zeros(1 << self.PLACES, np.uint64), np.zeros(1 << self.PLACES, np.uint64)
        self.letters = mixed(np.arange(1, 0x110001, dtype=np.uint64))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, text: str, codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``first`` to ``end`` of a text with these characters."""
        if len(self.up) < len(codes):
            grown = np.full(2 * len(codes), pow(_BASE, -1, 1 << 64), np.uint64)
            grown[0] = 1
            self.down = np.cumprod(grown)
            grown[1:] = _BASE
            self.up = np.cumprod(grown)
        sums = np.append(np.uint64(0), np.cumsum(self.letters[codes] * self.down[: len(codes)]))
        found = mixed((sums[end] - sums[first]) * self.up[first]) | np.uint64(1)
        place = found >> np.uint64(64 - self.PLACES)
        out = self.values[place]
        new = np.flatnonzero(self.words[place] != found)
        if len(new):
            words, at, again = np.unique(found[new], return_index=True, return_inverse=True)
            values = np.array([self.hashed(text[x:y]) for x, y in zip(first[new][at].tolist(), end[new][at].tolist())], np.uint64)
            out[new] = values[again]
            self.words[place[new][at]], self.values[place[new][at]] = words, values
        return out

    @staticmethod
    def hashed(core: str) -> int:
        core = core.lower()
        try:
            return xxhash.xxh3_64_intdigest(core) | 1
        except UnicodeEncodeError:  # a lone surrogate
            return xxhash.xxh3_64_intdigest(core.encode("utf-8", "replace")) | 1


def kinds_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text, and which are white space (1) or what may stand around words (2)."""
    if text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8)
        return codes, _KINDS[codes]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, _KINDS[np.minimum(codes, len(_KINDS) - 1)]


def words_within(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First characters and ends of words, and of what is between punctuation around them; a word has more than punctuation."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], kinds == 1, [True]])))
    first, end = edges[::2], edges[1::2]
    solid = np.flatnonzero(kinds == 0)
    before = np.append(0, np.cumsum(kinds == 0))
    words = before[end] > before[first]
    first, end = first[words], end[words]
    return first, end, solid[before[first]], solid[before[end] - 1] + 1


def words_of(texts: list[str], ids: NormalIds) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes of the words of each text, their lines, and the number of lines."""
    whole = "\n".join(texts)
    starts, hashes, lines, at, line = [], [], [], 0, 0
    while at < len(whole):
        cut = _SPACE.search(whole, at + PIECE)
        piece = whole[at : cut.end() if cut else len(whole)]
        codes, kinds = kinds_of(piece)
        first, _, core, core_end = words_within(kinds)
        ends = np.flatnonzero(codes == 10)
        hashes.append(ids.of(piece, codes, core, core_end))
        starts.append(first + at)
        lines.append(np.searchsorted(ends, first) + line)
        at, line = at + len(piece), line + len(ends)
    if not starts:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64), x.count("\n") + 1) for x in texts]
    start, found, line_of = np.concatenate(starts), np.concatenate(hashes), np.concatenate(lines)
    out, s, at, line = [], 0, 0, 0
    for x in texts:
        at += len(x) + 1
        e, n = int(np.searchsorted(start, at)), x.count("\n") + 1
        out.append((found[s:e], line_of[s:e] - line, n))
        s, line = e, line + n
    return out


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First characters and ends of the words of a text."""
    return words_within(kinds_of(text)[1])[:2]


def paragraphs(hashes: np.ndarray, lines: np.ndarray, n_lines: int) -> list[tuple[int, int, int, int]]:
    """First and last line, first word and end of each paragraph.

    Lines of MIN_WORDS words are paragraphs. Shorter ones without an empty line between them are one; where they have over LONG_RUN
    words, they are cut before lines whose hash is the least of five neighbours, so the cuts depend on what stands there alone.
    """
    counts = np.bincount(lines, minlength=n_lines)
    ends = np.cumsum(counts)
    out: list[tuple[int, int, int, int]] = []
    run: list[int] = []

    def unit(first: int, last: int) -> None:
        out.append((first, last, int(ends[first] - counts[first]), int(ends[last])))

    def close() -> None:
        total = int(counts[run].sum()) if run else 0
        if MIN_WORDS <= total <= LONG_RUN:
            unit(run[0], run[-1])
        elif total > LONG_RUN:
            values = np.array([xxhash.xxh3_64_intdigest(hashes[ends[i] - counts[i] : ends[i]].tobytes()) for i in run], np.uint64)
            parts, size = [[]], 0
            for k, i in enumerate(run):
                if size >= MIN_WORDS and values[k] == values[max(0, k - 2) : k + 3].min():
                    parts.append([])
                    size = 0
                parts[-1].append(i)
                size += int(counts[i])
            if size < MIN_WORDS and len(parts) > 1:
                parts[-2:] = [parts[-2] + parts[-1]]
            for part in parts:
                unit(part[0], part[-1])
        run.clear()

    for i, n in enumerate(counts.tolist()):
        if n >= MIN_WORDS:
            close()
            unit(i, i)
        elif n:
            run.append(i)
        else:
            close()
    close()
    return out


def signatures(found: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """Minima of ``count`` hash functions over segments (start, end) of a sequence of shingles."""
    seeds = mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    padded = np.append(mixed(found), np.uint64(0xFFFFFFFFFFFFFFFF))
    out = np.empty((len(bounds), count), np.uint64)
    step = max(1, 400_000 // len(padded))
    for at in range(0, count, step):
        values = padded[:, None] * seeds[None, at : at + step]
        out[:, at : at + step] = np.minimum.reduceat(values, bounds.ravel(), axis=0)[::2]
    return out


def band_keys(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of each paragraph, and its 16 samples of four bits."""
    drawn = mixed(signature).reshape(len(signature), BANDS, ROWS)
    key = np.tile(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signature), 1))
    for k in range(ROWS):
        key = mixed(key + drawn[:, :, k])
    nibbles = drawn.reshape(len(signature), -1)[:, :16] & np.uint64(15)
    sketch = np.zeros(len(signature), np.uint64)
    for k in range(16):
        sketch |= nibbles[:, k] << np.uint64(4 * k)
    return key, sketch


def alike(a: Column, b: Column) -> Column:
    """Whether two sketches agree in AGREE samples."""
    x = a.bitwiseXOR(b)
    for shift in (1, 2):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))) <= 16 - AGREE


def window_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of every window of WINDOW words."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, mixed(hashes), 1
    while True:
        if WINDOW & width:
            if out is None:
                out, done = power, width
            else:
                n = len(hashes) - done - width + 1
                out = out[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[done : done + n]
                done += width
        if done == WINDOW:
            return mixed(out[: len(hashes) - WINDOW + 1])
        n = len(power) - width
        power = power[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width : width + n]
        width *= 2


def kept_windows(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the least of every STRETCH neighbouring window hashes of texts laid end to end.

    ``bounds`` are the first place and the end of each text's own windows; those of two texts are at least STRETCH places apart.
    """
    mask = np.uint64((1 << 32) - 1)
    at = np.arange(len(hashes), dtype=np.uint64)
    # +1 at the first place of a text, -1 behind its last one
    edge = lambda first, end: np.cumsum(np.bincount(first, minlength=len(hashes) + 1) - np.bincount(end, minlength=len(hashes) + 1))[:-1] > 0
    bounds = bounds[bounds[:, 0] < bounds[:, 1]]
    own = edge(bounds[:, 0], bounds[:, 1])
    ranked = np.where(own, (hashes & ~mask) | at, np.uint64(0xFFFFFFFFFFFFFFFF))
    whole = edge(bounds[:, 0], np.maximum(bounds[:, 0] + 1, bounds[:, 1] - STRETCH + 1))
    least = sliding_minimum(np.append(ranked, np.full(STRETCH, np.uint64(0xFFFFFFFFFFFFFFFF))), STRETCH)[: len(hashes)]
    return np.unique((least[whole] & mask).astype(np.int64))


MARKS = (
    "k1 bigint, k2 bigint, t bigint, n_words bigint, paragraphs array<struct<line:bigint,last:bigint,item:bigint>>, "
    "bands array<struct<item:bigint,sketch:bigint,keys:array<bigint>>>, windows array<struct<place:bigint,h:bigint>>"
)


def marks(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its paragraphs by first and last line and hash, bands of paragraphs new to the task, and kept windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen, known = NormalIds(), set(), set()
        for b in batches:
            held, size, at = [], 0, 0
            for i, text in enumerate(b.column("text")):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= TOGETHER or len(held) == 256:
                    yield marked(b.slice(at, len(held)), words_of(held, ids), seen, known)
                    held, size, at = [], 0, i + 1
            if held:
                yield marked(b.slice(at, len(held)), words_of(held, ids), seen, known)

    def marked(b: pa.RecordBatch, texts: list[tuple], seen: set[int], known: set[int]) -> pa.RecordBatch:
        sizes = np.array([len(x[0]) for x in texts])
        begin = np.cumsum(sizes) - sizes
        hashes = np.concatenate([x[0] for x in texts])
        lines, ends, items, owners, fresh, bounds, windowed = [], [], [], [], [], [], []
        for k, ((own, of_line, n_lines), start, t) in enumerate(zip(texts, begin.tolist(), b.column("t").to_pylist())):
            for first, last, s, e in paragraphs(own, of_line, n_lines):
                item = xxhash.xxh3_64_intdigest(own[s:e].tobytes())
                lines.append(first)
                ends.append(last)
                owners.append(k)
                items.append(item)
                if item not in seen:
                    seen.add(item)
                    fresh.append(len(items) - 1)
                    bounds.append((start + s, start + e - shingles.SIZE + 1))
            if t not in known:  # of equal texts, one row of a task has the windows
                known.add(t)
                windowed.append((start, start + len(own) - WINDOW + 1))
        signed, owners = np.array(items, np.uint64).view(np.int64), np.array(owners, np.int64)
        keys, sketches = np.zeros((0, BANDS), np.uint64), np.zeros(0, np.uint64)
        if fresh:
            keys, sketches = band_keys(signatures(shingles.of_words(hashes), np.array(bounds), BANDS * ROWS))
        whole, places = window_hashes(hashes), np.zeros(0, np.int64)
        if len(whole) and windowed:
            places = kept_windows(whole, np.array(windowed))
        holder = np.searchsorted(begin, places, side="right") - 1
        columns = [
            pa.array(sizes), lists(owners, len(texts), {"line": np.array(lines, np.int64), "last": np.array(ends, np.int64), "item": signed}),
            lists(owners[fresh], len(texts), {"item": signed[fresh], "sketch": sketches.view(np.int64), "keys": pa.ListArray.from_arrays(
                pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))}),
            lists(holder, len(texts), {"place": places - begin[holder], "h": whole[places].view(np.int64)})]
        names = ["k1", "k2", "t", "n_words", "paragraphs", "bands", "windows"]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:3]), *columns], names=names)

    def lists(owner: np.ndarray, n: int, fields: dict) -> pa.ListArray:
        """Structs of each of ``n`` rows; ``owner`` rises."""
        ends = np.cumsum(np.bincount(owner, minlength=n))
        values = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields.values()], names=list(fields))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)

    return docs.select(*row_key("doc_id", "text"), F.xxhash64("text").alias("t"), "text").mapInArrow(run, MARKS)


# ---- paragraphs ---------------------------------------------------------------------------------


def _with_words(firsts: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, z): the word hashes of items given by one occurrence (k1, k2, line, last, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = NormalIds()
        for b in batches:
            items, words = [], []
            for wanted, text in zip(b.column("wanted"), b.column("text")):
                lines = text.as_py().split("\n")
                for w in wanted.as_py():
                    items.append(w["item"])
                    words.append(words_of(["\n".join(lines[w["line"] : w["last"] + 1])], ids)[0][0].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(words, pa.binary())], names=["id", "z"])

    by_doc = firsts.groupBy("k1", "k2").agg(F.collect_list(F.struct("line", "last", "item")).alias("wanted"))
    return by_doc.join(texts, ["k1", "k2"]).select("wanted", "text").mapInArrow(run, "id bigint, z binary").dropDuplicates(["id"])


def shingle_set(raw: bytes) -> np.ndarray:
    """Distinct shingles of the words of a paragraph; those of usual paragraphs are kept, as one is compared with many."""
    return _kept_set(raw) if len(raw) <= 4 * LONG_RUN * 4 else _shingle_set(raw)


def _shingle_set(raw: bytes) -> np.ndarray:
    return np.unique(shingles.of_words(np.frombuffer(raw, np.uint32).astype(np.uint64)))


_kept_set = lru_cache(2048)(_shingle_set)


def edits(a: list[int], b: list[int]) -> int:
    """Edit distance of two sequences of words, bit-parallel."""
    if not a or not b:
        return len(a) + len(b)
    of: dict[int, int] = {}
    for i, x in enumerate(a):
        of[x] = of.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for y in b:
        x = of.get(y, 0) | minus
        same = (((x & plus) + plus) ^ plus) | x
        down, up = plus & same, minus | ~(plus | same) & full
        score += bool(up & top) - bool(down & top)
        up = up << 1 | 1
        minus, plus = up & same & full, (down << 1 | ~(up | same)) & full
    return score


def similar(a: bytes, b: bytes, threshold: float) -> bool:
    """Whether two paragraphs have this Jaccard similarity, or differ in few words."""
    x, y = shingle_set(a), shingle_set(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    if both >= threshold * union:
        return True
    n, m = len(a) // 4, len(b) // 4
    allowed = int((1 - UNEDITED) * max(n, m))
    # an edit changes at most SIZE shingles of either side
    if abs(n - m) > allowed or both < max(len(x), len(y)) - shingles.SIZE * allowed:
        return False
    return edits(np.frombuffer(a, np.uint32).tolist(), np.frombuffer(b, np.uint32).tolist()) <= allowed


def similar_pairs(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that are near-copies; ``items`` is (id, z)."""
    left = items.select(F.col("id").alias("a"), F.col("z").alias("za"))
    right = items.select(F.col("id").alias("b"), F.col("z").alias("zb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [similar(p.as_py(), q.as_py(), threshold) for p, q in zip(batch.column("za"), batch.column("zb"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "za", "zb").mapInArrow(run, "a bigint, b bigint")


def repeated_paragraphs(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(k1, k2, line, last, comp) of every paragraph that is not the first of its class; ``marked`` is the table of ``marks``."""
    lines = marked.select("k1", "k2", F.inline("paragraphs"))
    banded = marked.select(F.inline("bands")).select(F.explode("keys").alias("bucket"), F.col("item").alias("id"), "sketch")
    met = written(banded.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi").select("bucket"))
    members = written(banded.join(met, "bucket").distinct())
    wanted = members.select(F.col("id").alias("item")).distinct()
    firsts = lines.join(wanted, "item", "left_semi").groupBy("item").agg(F.min(F.struct("k1", "k2", "line", "last")).alias("f")).select("item", "f.*")
    items = written(_with_words(firsts, texts))

    def vector():
        return lambda raw: (lambda found: (found, np.ones(len(found), np.float32)))(shingle_set(raw))

    comps = connect(members, lambda pairs: similar_pairs(pairs, items, THRESHOLD), alike,
                    lambda open_ones: block_links(open_ones, items, vector, THRESHOLD, lambda a, b: similar(a, b, THRESHOLD))).withColumnRenamed("id", "item")
    named = written(lines.join(comps, "item", "left").select("k1", "k2", "line", "last", F.coalesce("comp", "item").alias("comp")))
    # tables on both sides, so that AQE can split a hot class
    heads = written(named.groupBy("comp").agg(F.min(F.struct("k1", "k2", "line")).alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return named.join(heads, "comp").filter(F.struct("k1", "k2", "line") != F.col("head")).select("k1", "k2", "line", "last", "comp")


# ---- passages -----------------------------------------------------------------------------------


def _nearby(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(k1, k2, place, h) of all windows less than STRETCH words from ``places`` of documents (k1, k2, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = NormalIds()
        for b in batches:
            for k1, k2, places, text in zip(*(b.column(c) for c in ("k1", "k2", "places", "text"))):
                whole = window_hashes(words_of([text.as_py()], ids)[0][0])
                hit = np.zeros(len(whole) + 1, np.int64)
                at = np.array(places.as_py())
                np.add.at(hit, np.maximum(at - STRETCH + 1, 0), 1)
                np.add.at(hit, np.minimum(at + STRETCH, len(whole)), -1)
                near = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k1.as_py()] * len(near), pa.int64()), pa.array([k2.as_py()] * len(near), pa.int64()), pa.array(near),
                     pa.array(whole[near].view(np.int64))], names=["k1", "k2", "place", "h"])

    return asked.join(texts, ["k1", "k2"]).select("k1", "k2", "places", "text").mapInArrow(
        run, "k1 bigint, k2 bigint, place bigint, h bigint")


def repeated_windows(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(k1, k2, places, whole): places of windows that an earlier document has, too; of a text that an earlier row has, all of them.

    ``marked`` is the table of ``marks``.
    """
    holders = written(marked.groupBy("t").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")))
    again = written(holders.filter("lo != hi").select("t", "lo"))
    copies = marked.filter(F.col("n_words") >= PASSAGE).select("k1", "k2", "t").join(again, "t").filter(
        F.struct("k1", "k2") != F.col("lo")).select("k1", "k2").distinct()
    # windows are those of texts, whichever rows have them; only texts that share one are then looked up by their first row
    windows = marked.select("t", F.inline("windows"))
    met = written(windows.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo != hi").select("h"))
    shared = written(windows.join(met, "h").groupBy("t").agg(F.collect_set("place").alias("places")))
    asked = shared.join(holders, "t").select("lo.*", "places")
    near = written(_nearby(asked, texts))
    ends = near.groupBy("h").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi"))
    earlier = written(ends.filter(F.col("lo") != F.col("hi")).select("h", "lo"))
    later = near.join(earlier, "h").filter(F.struct("k1", "k2") != F.col("lo")).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("place")).alias("places"))
    return later.withColumn("whole", F.lit(False)).unionByName(
        copies.select("k1", "k2", F.array().cast("array<bigint>").alias("places"), F.lit(True).alias("whole")))


def runs_of(places: list[int], n_words: int, whole: bool) -> list[tuple[int, int]]:
    """First words and ends of runs of PASSAGE words whose windows are all matched."""
    if whole:
        return [(0, n_words)] if n_words >= PASSAGE else []
    at = np.array(places, np.int64)
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    parts = [p for p in np.split(at, cuts) if len(p)]
    return [(int(p[0]), int(p[-1]) + WINDOW) for p in parts if len(p) + WINDOW - 1 >= PASSAGE]


def spans_to_cut(text: str, lines: list[tuple[int, int]], places: list[int], whole: bool) -> list[tuple[int, int]]:
    """Bounds of what goes: whole paragraphs, by their first and last lines, and runs of matched words."""
    starts = np.cumsum([0, *(len(x) + 1 for x in text.split("\n"))]).tolist()
    cut = [(starts[i], starts[j + 1] - 1) for i, j in lines]
    if whole or places:
        first, end = word_bounds(text)
        cut += [(int(first[x]), int(end[y - 1])) for x, y in runs_of(places, len(first), whole)]
    merged: list[tuple[int, int]] = []
    for x, y in sorted(cut):
        if merged and x <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
        else:
            merged.append((x, y))
    return merged


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_removed (maximal cuts), removed_words, class_ids, text.

    ``class_ids`` names the classes of removed paragraphs, in order; ``text`` is what is left, lines that are cut whole leave no
    empty line. Of equal rows each is treated alike, as one occurrence; a null doc_id comes first in order; null and wordless texts have
    nothing to cut, a null text counts as empty.
    """
    own = docs.select("doc_id", "text")
    marked = written(marks(own))
    # plain, as a way through Python that compresses a text costs more than shuffling it
    texts = own.select(*row_key("doc_id", "text"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = settled(lambda: repeated_paragraphs(marked, texts).groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.struct("line", "last", "comp"))).alias("lines")))
    hits = lines.join(settled(lambda: repeated_windows(marked, texts)), ["k1", "k2"], "full_outer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, cuts, words, comps, left = [], [], [], [], []
            for text, classes, places, whole in zip(*(b.column(c) for c in ("text", "lines", "places", "whole"))):
                text = text.as_py()
                classes = classes.as_py() or []
                spans = spans_to_cut(text, [(m["line"], m["last"]) for m in classes], places.as_py() or [], bool(whole.as_py()))
                kept, at = [], 0
                for x, y in spans:
                    kept.append(text[at:x])
                    at = y
                    if (not kept[-1] or kept[-1].endswith("\n")) and text[at : at + 1] == "\n":
                        at += 1
                counts.append(sum(bool(x.strip()) for x in text.split("\n")))
                cuts.append(len(spans))
                words.append(sum(len(text[x:y].split()) for x, y in spans))
                comps.append([m["comp"] for m in classes])
                left.append("".join([*kept, text[at:]]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(cuts, pa.int64()), pa.array(words, pa.int64()),
                 pa.array(comps, pa.list_(pa.int64())), pa.array(left, pa.string())],
                names=["doc_id", "n_paragraphs", "n_removed", "removed_words", "class_ids", "text"])

    full = texts.join(hits, ["k1", "k2"], "left").select("doc_id", "text", "lines", "places", "whole")
    return full.mapInArrow(run, "doc_id bigint, n_paragraphs bigint, n_removed bigint, removed_words bigint, class_ids array<bigint>, text string")

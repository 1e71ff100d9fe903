"""CSV files with line breaks inside quotes, read by many tasks.

Spark splits a text file at line ends, but whether a split begins inside a quoted cell depends on all that stands before it. A first
pass tells for every split how it would end if it began outside quotes, and inside; from these two answers a window over the splits of
a file (not over its lines) finds where each one begins. The second pass then cuts each split into records by itself. Records that
reach over the end of a split leave it as fragments, which are few, and are put together in file order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLOSED = re.compile(r'(?:[^"]++|"")*+"')
#: Records that a task gathers before they leave it.
FLUSH_RECORDS, FLUSH_CHARS = 20_000, 16 << 20


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside or outside a quoted cell ends inside one. Doubled quotes are text, as are quotes elsewhere than
    at the beginning of a cell; what follows a closing quote belongs to the cell up to the next comma."""
    at = 0
    while True:
        if inside:
            closed = _CLOSED.match(line, at)
            if closed is None:
                return True
            at = closed.end()
        elif at == 0 and line.startswith('"'):
            inside, at = True, 1
            continue
        begin = line.find(',"', at)
        if begin < 0:
            return False
        inside, at = True, begin + 2


#: The same as two regular expressions over whole lines: quoted text, what follows a closing quote (or begins a line) up to the next opening
#: one, and lines that end inside a cell.
_QUOTED = r'(?:[^"]|"")*'
_UNTIL = r'(?:(?:[^,"]|,+[^,"])(?:[^,]|,+[^,"])*)?,+"'
_STAYS = rf'^{_QUOTED}(?:"{_UNTIL}{_QUOTED})*$'
_OPENS = rf'^(?:"|{_UNTIL}){_QUOTED}(?:"{_UNTIL}{_QUOTED})*$'


def line_ends(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``ends_inside`` of many lines: whether each ends inside a cell if it begins outside, and if it begins inside."""
    outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(at):
        quoted = lines.take(pa.array(at))
        outside[at], inside[at] = (pc.match_substring_regex(quoted, p).to_numpy(zero_copy_only=False) for p in (_OPENS, _STAYS))
    return outside, inside


def states(outside: np.ndarray, inside: np.ndarray, begins: bool) -> np.ndarray:
    """Whether the text before each line, and at the end, is inside a cell. A line keeps the state, turns it round, or sets it: the last one
    that sets it counts, and how often it is turned round since."""
    n = len(outside)
    turned = np.concatenate([[0], np.cumsum(outside & ~inside)])
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(outside == inside, np.arange(n), -1))]) if n else np.array([-1])
    held = np.where(last >= 0, outside[last], begins) if n else np.array([begins])
    return held ^ ((turned - turned[last + 1]) % 2 == 1)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, start, split) of every line; the lines of a split stand in file order in one task. Files are told by a hash of their path."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return lines.select(F.make_valid_utf8("value").alias("value"), F.xxhash64("file_path").alias("file"), F.col("file_block_start").alias("start"),
                        F.xxhash64("file_path", "file_block_start").alias("split"))


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one split."""
    of = b.column("split").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    return (b.slice(x, y - x) for x, y in zip(cuts, cuts[1:]) if y > x)


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, split, begins, ends): whether each split begins and ends inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, outside, inside = None, False, True
        for b in batches:
            out = []
            for part in _parts(b):
                now = tuple(part.column(c)[0].as_py() for c in ("file", "start", "split"))
                if now != key:
                    if key is not None:
                        out.append((*key, outside, inside))
                    key, outside, inside = now, False, True
                ends = line_ends(part.column("value").cast(pa.string()))
                outside, inside = bool(states(*ends, outside)[-1]), bool(states(*ends, inside)[-1])
            yield batch(out)
        if key is not None:
            yield batch([(*key, outside, inside)])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=["file", "start", "split", "outside", "inside"])

    found = lines.mapInArrow(run, "file bigint, start bigint, split bigint, outside boolean, inside boolean")
    # splits compose as lines do (see ``states``)
    order = Window.partitionBy("file").orderBy("start")
    turns, sets = F.col("outside") & ~F.col("inside"), F.col("outside") == F.col("inside")
    counted = found.withColumn("turned", F.sum(turns.cast("int")).over(order))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select(
        "*", F.last(F.when(sets, F.struct("outside", "turned")), ignorenulls=True).over(before).alias("set"),
        F.lag("turned", 1, 0).over(order).alias("so_far"))
    odd = (F.col("so_far") - F.coalesce("set.turned", F.lit(0))) % 2 == 1
    begins = F.coalesce("set.outside", F.lit(False)) != odd
    return placed.select("file", "start", "split", begins.alias("begins"), F.when(begins, F.col("inside")).otherwise(F.col("outside")).alias("ends"))


def _joined(lines: pa.Array, ends: np.ndarray) -> pa.Array:
    """Records of which ``ends`` are the last lines, without the ``\\r`` of their line ends."""
    if len(ends) == ends[-1] + 1:
        records = lines.slice(0, len(ends))
    else:
        cuts = pa.array(np.concatenate([[0], ends + 1]), pa.int32())
        records = pc.binary_join(pa.ListArray.from_arrays(cuts, lines), "\n")
    returns = pc.ends_with(records, "\r")
    return pc.if_else(returns, pc.replace_substring_regex(records, "\r$", ""), records) if pc.any(returns).as_py() else records


def _pieces(batches: Iterator[pa.RecordBatch], begins: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple]:
    """(file, start, place, kind, value) of every split in order, or of those in ``wanted``; ``begins`` are the splits that begin inside quotes.

    A piece is an array of whole records without the empty ones (``records``), or a fragment: it ends the record that is open where its
    split begins (``head``), is all of its split (``middle``), or begins a record that its split does not end (``tail``). ``place`` is the
    number of records before it.
    """
    key, where, inside, in_head, held, n = None, None, False, False, [], 0
    for b in batches:
        for part in _parts(b):
            split = part.column("split")[0].as_py()
            if split != key:
                if held:
                    yield *where, n, "middle" if in_head else "tail", "\n".join(held)
                key, where = split, (part.column("file")[0].as_py(), part.column("start")[0].as_py())
                inside = in_head = _among(begins, split)
                held, n = [], 0
            if wanted is not None and not _among(wanted, split):
                continue
            lines = part.column("value").cast(pa.string())
            after = states(*line_ends(lines), inside)[1:]
            inside, ends = bool(after[-1]), np.flatnonzero(~after)
            if not len(ends):
                held += lines.to_pylist()
                continue
            records = _joined(lines, ends)
            if held or in_head:
                first = "\n".join([*held, records[0].as_py()])
                if in_head:
                    yield *where, n, "head", first
                else:
                    yield *where, n, "records", pa.array([first], pa.string())
                    n += 1
                records, in_head = records.slice(1), False
            held = lines.slice(int(ends[-1]) + 1).to_pylist()
            records = records.filter(pc.not_equal(records, ""))
            if len(records):
                yield *where, n, "records", records
                n += len(records)
    if held:
        yield *where, n, "middle" if in_head else "tail", "\n".join(held)


def _records(lines: DataFrame, begins: np.ndarray, header: bool) -> DataFrame:
    """(value): the records that begin and end in one split; with a header, the first of a file is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, size = [], 0, 0
        for _, start, place, kind, value in _pieces(batches, begins):
            if kind != "records":
                continue
            if header and not start and not place:
                value = value.slice(1)
            out.append(value)
            rows, size = rows + len(value), size + value.nbytes
            if rows >= FLUSH_RECORDS or size >= FLUSH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out)], names=["value"])
                out, rows, size = [], 0, 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(out)], names=["value"])

    return lines.mapInArrow(run, "value string")


def _fragments(lines: DataFrame, begins: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(file, start, place, kind, value): what the ends of splits cut off records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for piece in _pieces(batches, begins, wanted):
            if piece[3] != "records":
                out.append(piece)
                size += len(piece[4])
            if len(out) >= FLUSH_RECORDS or size >= FLUSH_CHARS:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "start", "place", "kind", "value"])

    return lines.mapInArrow(run, "file bigint, start bigint, place bigint, kind string, value string")


def _among(keys: np.ndarray, key: int) -> bool:
    at = np.searchsorted(keys, key)
    return bool(at < len(keys) and keys[at] == key)


def _put_together(fragments: DataFrame, header: bool) -> DataFrame:
    """(value) of the records that reach over ends of splits; one that no quote ends goes to the end of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, first = None, [], False
        for b in batches:
            out = []
            for at, start, place, kind, value in zip(*(b.column(c).to_pylist() for c in ("file", "start", "place", "kind", "value"))):
                if (at != file or kind == "tail") and held:
                    out += [] if first else ["\n".join(held)]
                    held = []
                if kind == "tail":
                    first = header and start == 0 and place == 0
                file = at
                held.append(value)
                if kind == "head":
                    out += [] if first else ["\n".join(held)]
                    held, first = [], False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if held and not first:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)], pa.string())], names=["value"])

    dealt = fragments.withColumn("rank", F.when(F.col("kind") == "tail", 1).otherwise(0))
    dealt = dealt.repartition("file").sortWithinPartitions("file", "start", "rank")
    return dealt.select("file", "start", "place", "kind", "value").mapInArrow(run, "value string")


def csv_records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """(value): the records of CSV files in no order, as they are written; empty records and, with ``header``, each file's first are
    left out.

    The driver gets eight bytes for each split that begins or ends inside quotes. Files are read twice, and a third time where records
    reach over ends of splits; they must not change meanwhile. Records end with ``\\n`` or ``\\r\\n``.
    """
    lines = _lines(spark, path)
    states = split_states(lines).filter("begins OR ends").select("split", "begins").toArrow()
    keys, begins = states.column("split").to_numpy(), states.column("begins").to_numpy(zero_copy_only=False).astype(bool)
    begins = np.sort(keys[begins])
    records = _records(lines, begins, header)
    if not len(keys):
        return records
    return records.unionByName(_put_together(_fragments(lines, begins, np.sort(keys)), header))

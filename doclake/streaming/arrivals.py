"""Notes of arriving files (st2): a task lists them, and the driver holds only the names of the notes.

Spark's own file source keeps every file it lists and has ever seen in the driver, and writes all of them into its log again and again. Here
a task walks the folder and writes the paths that are new as small tables, the notes; the stream reads one note for each batch, and its
tasks open the files. What is noted is known by the notes themselves: a listing that fails leaves none, and a note is read once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.sources import files as sf
from doclake.sources.objects import FLUSH_BYTES

#: Paths that leave a listing at a time.
FLUSH_PATHS = 10_000


def _hadoop(spark: SparkSession, path: str):
    """File system and qualified path of a place."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def walkable(spark: SparkSession, source: str, checkpoint: str) -> str | None:
    """The folder as Spark names it, where its tasks can walk it: a local or shared one whose files are all there is to tell what arrived.

    None for patterns, other file systems, folders with a log of their own and checkpoints that were begun without notes.
    """
    if any(c in source for c in "*?[]{}\\"):
        return None
    system, root = _hadoop(spark, source)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    own_log = system.exists(path(root, "_spark_metadata"))
    old_system, old = _hadoop(spark, checkpoint)
    begun = old_system.exists(path(old, "offsets")) and not old_system.exists(path(old, "arrivals"))
    if root.toUri().getScheme() != "file" or own_log or begun or not system.getFileStatus(root).isDirectory():
        return None
    return root.toString()


def is_hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def walk(root: str) -> Iterator[str]:
    """Paths of the files below a folder; folders are opened one by one and never held whole."""
    folders = [root]
    while folders:
        folder = folders.pop()
        with os.scandir(folder.removeprefix("file:")) as entries:
            for entry in entries:
                if is_hidden(entry.name):
                    continue
                path = f"{folder.rstrip('/')}/{entry.name}"
                if entry.is_dir():
                    folders.append(path)
                else:
                    yield path


def listed(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path) of the files below a folder, listed by a task; ``glob`` is matched with names as Hadoop does."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for path in walk(folder):
                    held.append(path)
                    if len(held) >= FLUSH_PATHS:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["path"])
                        held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["path"])

    paths = spark.range(0, 1, 1, 1).select(F.lit(root).alias("root")).mapInArrow(run, "path string")
    if glob is None:
        return paths
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    return paths.filter(F.regexp_extract("path", r"([^/]*)\z", 1).rlike(rf"(?s)\A(?:{pattern})\z"))


def note(spark: SparkSession, root: str, checkpoint: str, size: int, glob: str | None = None) -> str:
    """Note the files below ``root`` that no note has yet, at most ``size`` in one; returns the folder of the notes.

    The notes of a listing appear when their folder gets its name. Where that moves them one by one and breaks off, the others are
    listed again by the next run.
    """
    folder = f"{checkpoint.rstrip('/')}/arrivals"
    system, place = _hadoop(spark, folder)
    system.mkdirs(place)
    new = listed(spark, root, glob)
    if any(f.getPath().getName().startswith("listed-") for f in system.listStatus(place)):
        new = new.join(_notes(spark.read, folder), "path", "left_anti").repartition(1)
    name = uuid.uuid4().hex
    new.write.option("maxRecordsPerFile", size).parquet(f"{folder}/_new-{name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    made = path(place, f"_new-{name}")
    if spark.read.schema("path string").parquet(f"{folder}/_new-{name}").isEmpty():
        system.delete(made, True)
    elif not system.rename(made, path(place, f"listed-{name}")):
        raise OSError(f"{made} cannot be renamed")
    return folder


def _notes(reader, folder: str) -> DataFrame:
    return reader.schema("path string").option("recursiveFileLookup", True).parquet(folder)


def noted_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files (path, modificationTime, length, content) of the notes as a stream, those of one note in a batch; tasks read them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for path in batch.column(0).to_pylist():
                with open(path.removeprefix("file:"), "rb") as f:
                    content, changed = f.read(), os.fstat(f.fileno()).st_mtime_ns // 1000
                rows.append((path, changed, len(content), content))
                held += len(content)
                if held >= FLUSH_BYTES:
                    yield flushed(rows)
                    rows, held = [], 0
            if rows:
                yield flushed(rows)

    names, types = sf.FILE_SCHEMA.names, [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()]
    notes = _notes(spark.readStream.option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d"), folder)
    # a note is one file, whose rows one task would read
    return notes.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, sf.FILE_SCHEMA)

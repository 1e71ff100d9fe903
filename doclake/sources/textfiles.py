"""One file per document (s9): a data source whose tasks write into folders of their own and whose commit makes them visible.

A task writes its documents under ``path/<job>/files/<task>`` and, beside them, an index with the other columns of each document. The
job's commit is one small file, ``path/_commits/<job>.json``, that names the folders of the tasks that ended well; readers follow these
files alone. A task that fails deletes what it has written, a job that fails deletes the folders of its tasks, and folders of lost
attempts go with the commit: what is not committed was never there.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from doclake.sources import objects

FORMAT = "document_files"


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task that ended well, and its documents."""

    task: str
    documents: int


def safe_name(name: str | None) -> str:
    """A file name without separators or characters that file systems refuse; only its last hundred characters."""
    return re.sub(r"[^\w.\-]+", "_", name or "document")[-100:]


class DocumentFiles(DataSource):
    """Rows with ``name`` and ``body``: each body becomes a file; other columns go to the index."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> "FilesWriter":
        return FilesWriter(self.options["path"], overwrite)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = objects.file_system(self.path)
        task = uuid.uuid4().hex  # each attempt has a folder of its own
        folder, index = f"{base}/{self.job}/files/{task}", f"{base}/{self.job}/index/{task}.json"
        n = 0
        try:
            system.create_dir(folder, recursive=True)
            system.create_dir(f"{base}/{self.job}/index", recursive=True)
            with system.open_output_stream(index) as entries:
                for batch in iterator:
                    others = [c for c in batch.schema.names if c != "body"]
                    for name, body, row in zip(batch.column("name").to_pylist(), batch.column("body"), batch.select(others).to_pylist()):
                        file = f"{n:06d}-{safe_name(name)}"
                        with system.open_output_stream(f"{folder}/{file}") as out:
                            out.write((body.as_py() or "").encode("utf-8", "surrogatepass"))
                        entry = {k: v for k, v in row.items() if k != "name"} | {"name": name, "file": f"{self.job}/files/{task}/{file}"}
                        entries.write(json.dumps(entry, ensure_ascii=True, default=str).encode() + b"\n")
                        n += 1
        except BaseException:
            for gone in (lambda: system.delete_dir(folder), lambda: system.delete_file(index)):
                try:
                    gone()
                except OSError:
                    pass
            raise
        return Written(task, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = objects.file_system(self.path)
        done = {m.task: m.documents for m in messages if m is not None}
        older = committed(self.path) if self.overwrite else {}
        if done:
            for info in system.get_file_info(fs.FileSelector(f"{base}/{self.job}/files")):
                if info.base_name not in done:  # of an attempt that was lost
                    system.delete_dir(info.path)
        system.create_dir(f"{base}/_commits", recursive=True)
        with system.open_output_stream(f"{base}/_commits/{self.job}.json") as out:
            out.write(json.dumps({"tasks": done, "replaces": sorted(older)}).encode())
        for job in older:  # no reader follows them from here on
            system.delete_dir(f"{base}/{job}")
            system.delete_file(f"{base}/_commits/{job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = objects.file_system(self.path)
        if system.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.job}")


def committed(path: str) -> dict[str, dict[str, int]]:
    """Tasks and their documents of each job that is committed and not replaced."""
    system, base = objects.file_system(path)
    infos = system.get_file_info(fs.FileSelector(f"{base}/_commits", allow_not_found=True))
    found = {}
    for info in infos:
        with system.open_input_stream(info.path) as f:
            found[info.base_name.removesuffix(".json")] = json.loads(f.read())
    gone = {job for c in found.values() for job in c["replaces"]}
    return {job: c["tasks"] for job, c in found.items() if job not in gone}


def write_documents(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Each row of ``rows`` (name, body, …) as a file of its own under ``path``; all of them become visible at once."""
    rows.sparkSession.dataSource.register(DocumentFiles)
    rows.write.format(FORMAT).mode(mode).option("path", path).save()


def read_index(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """``columns`` (a DDL string), name and file of every committed document."""
    schema = f"{columns}, name string, file string"
    indexes = [f"{path.rstrip('/')}/{job}/index/{task}.json" for job, tasks in committed(path).items() for task, n in tasks.items() if n]
    return spark.read.schema(schema).json(indexes) if indexes else spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The index with ``body``, the text of each file, read by the tasks that hold its entry."""
    system_path = path.rstrip("/")
    store = objects.Store(location="{bucket}/{key}", read=lambda bucket, key, _: _file_bytes(f"{bucket}/{key}"))
    rows = objects.fetched(read_index(spark, path, columns), store, F.lit(system_path), F.col("file"))
    return rows.select("*", F.col("stored").cast("string").alias("body")).drop("stored", "object_error")


def _file_bytes(path: str) -> bytes:
    system, place = objects.file_system(path)
    with system.open_input_stream(place, compression=None) as f:
        return f.read()

"""Stored objects, read one by one by the task that holds the request for them.

Nothing is listed and nothing is joined: a request names its object, its task opens that object, and what goes wrong is told in the
request's own row. So only requested objects are read, and no object's bytes are shuffled.
"""

from __future__ import annotations

import errno
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of objects that are gathered before they leave a task.
FLUSH_BYTES = 32 << 20
_STORE_CODE, _STATUS = re.compile(r"AWS Error ([A-Z_]+)"), re.compile(r"HTTP status (\d{3})")
_BY_STATUS = {"301": "PermanentRedirect", "403": "AccessDenied", "404": "NoSuchKey", "503": "SlowDown"}


class ObjectError(Exception):
    """An object that cannot be read, with the error code of the store."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@lru_cache
def _opened(prefix: str, region: str | None) -> tuple[fs.FileSystem, str]:
    """File system of the fixed beginning of a location, and the path that it stands for."""
    scheme, _, rest = prefix.partition("://")
    if not rest and not prefix.endswith("://"):
        return fs.LocalFileSystem(), prefix.removeprefix("file:")
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    if scheme in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem(**({"region": region} if region else {})), rest
    return fs.FileSystem.from_uri(prefix)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a place that is given as a path or a URI."""
    system, place = _opened(path, None)
    return system, place.rstrip("/")


def error_code(error: Exception, bucket_there: Callable[[], bool]) -> str:
    """The store's code for what a read raised; local and distributed file systems get the codes of the same meaning."""
    if isinstance(error, ObjectError):
        return error.code
    named, status = _STORE_CODE.search(str(error)), _STATUS.search(str(error))
    if named and named[1] != "UNKNOWN":
        return "".join(w.capitalize() for w in named[1].split("_"))
    if status and status[1] in _BY_STATUS:
        return _BY_STATUS[status[1]]
    if isinstance(error, PermissionError):
        return "AccessDenied"
    if isinstance(error, (FileNotFoundError, IsADirectoryError, NotADirectoryError)):
        return "NoSuchKey" if bucket_there() else "NoSuchBucket"
    return errno.errorcode.get(getattr(error, "errno", None) or 0, type(error).__name__)


@dataclass(frozen=True)
class Store:
    """Where the objects of buckets are.

    ``location`` has {bucket} and then {key}: an object store, a distributed or a local file system. ``read`` replaces the way an object is
    read: a function of (bucket, key, region) that returns bytes or raises ``ObjectError`` with the store's code.
    """

    location: str = "s3://{bucket}/{key}"
    read: Callable[[str, str, str | None], bytes] | None = None

    def object_bytes(self, bucket: str, key: str, region: str | None) -> bytes:
        if self.read is not None:
            return self.read(bucket, key, region)
        prefix = self.location.split("{", 1)[0]
        system, base = _opened(prefix, region)
        key = key.lstrip("/")
        if ".." in [bucket, *key.split("/")]:
            raise ObjectError("NoSuchKey")
        whole = base + self.location[len(prefix):].format(bucket=bucket, key=key)
        try:
            with system.open_input_stream(whole, compression=None) as f:
                return f.read()
        except (OSError, pa.ArrowException) as e:
            if system.get_file_info(whole).type == fs.FileType.Directory:
                raise ObjectError("NoSuchKey") from None
            top = base + self.location[len(prefix):].split("{key}")[0].format(bucket=bucket).rstrip("/")
            raise ObjectError(error_code(e, lambda: system.get_file_info(top).type != fs.FileType.NotFound)) from None


def fetched(rows: DataFrame, store: Store, bucket: Column, key: Column, region: Column | None = None) -> DataFrame:
    """rows + ``stored`` (bytes of the object that bucket and key name) and ``object_error`` (its code where it cannot be read).

    Rows without a key have neither. Batches end where their objects come to FLUSH_BYTES, so a task holds no more than that and one
    object.
    """
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("stored", T.BinaryType()), T.StructField("object_error", T.StringType())])
    asked = rows.select("*", bucket.alias("__bucket"), key.alias("__key"), (F.lit(None).cast("string") if region is None else region).alias("__region"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, size, bodies, errors = 0, 0, [], []

            def flushed(stop: int) -> pa.RecordBatch:
                part = b.slice(start, stop - start)
                added = [pa.array(bodies, pa.binary()), pa.array(errors, pa.string())]
                return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *added], names=[*names, "stored", "object_error"])

            for i, (in_bucket, name, where) in enumerate(zip(*(b.column(c).to_pylist() for c in ("__bucket", "__key", "__region")))):
                body = code = None
                try:
                    body = store.object_bytes(in_bucket, name, where)
                except ObjectError as e:
                    code = e.code
                bodies.append(body)
                errors.append(code)
                size += len(body or b"")
                if size >= FLUSH_BYTES:
                    yield flushed(i + 1)
                    start, size, bodies, errors = i + 1, 0, [], []
            if start < len(b):
                yield flushed(len(b))

    hit = asked.filter(F.col("__bucket").isNotNull() & (F.coalesce("__key", F.lit("")) != "")).mapInArrow(run, schema)
    rest = asked.filter(F.col("__bucket").isNull() | (F.coalesce("__key", F.lit("")) == "")).select(
        *names, F.lit(None).cast("binary").alias("stored"), F.lit(None).cast("string").alias("object_error"))
    return hit.unionByName(rest)

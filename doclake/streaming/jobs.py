"""Stream jobs (``st*``): the batch operators over arriving requests and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclake.plans.process import outcomes
from doclake.sources import files as sf
from doclake.sources import requests as rq
from doclake.sources.objects import Store
from doclake.sources.registry import DEFAULT, Registry
from doclake.streaming import arrivals


def request_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, processed_at: str, registry: Registry = DEFAULT,
    files: DataFrame | None = None, store: Store | None = None,
) -> StreamingQuery:
    """st1: JSON lines of requests → results and rejects under ``target``; ``store`` or ``files`` (path, content) has stored objects.

    Every micro-batch is parsed once and written once, results and rejects beside each other, and is visible from the moment when its
    manifest is there. A batch that is run again after a failure replaces what it had written, or does nothing if it was visible.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id in visible_batches(spark, target):
            return
        done = outcomes(rq.scan_requests(batch), processed_at, registry, files, store)
        kind = F.when(F.col("reason").isNull(), "results").otherwise("rejects")
        done.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{target}/batches/batch={batch_id}")
        make_visible(spark, target, batch_id)

    return (
        spark.readStream.text(source).writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _manifests(spark: SparkSession, target: str):
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{target}/manifests")
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), folder


def visible_batches(spark: SparkSession, target: str) -> list[int]:
    """Batches whose manifest is there."""
    system, folder = _manifests(spark, target)
    return sorted(int(f.getPath().getName()) for f in system.listStatus(folder)) if system.exists(folder) else []


def make_visible(spark: SparkSession, target: str, batch_id: int) -> None:
    """The manifest of a batch: an empty file with its number, which appears in one step."""
    system, folder = _manifests(spark, target)
    system.mkdirs(folder)
    system.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, str(batch_id)), False).close()


def read_batches(spark: SparkSession, target: str, kind: str) -> DataFrame:
    """``results`` or ``rejects`` of all visible batches; there must be one."""
    batches = [f"{target}/batches/batch={b}" for b in visible_batches(spark, target)]
    return spark.read.option("basePath", f"{target}/batches").parquet(*batches).filter(F.col("kind") == kind).drop("kind", "batch")


#: Arriving files that one micro-batch takes, which bounds what the driver holds of them.
BATCH_FILES = 50_000
#: What opening a file counts as when files are packed into tasks: a thousand small ones share a task.
OPEN_COST = 128 << 10


def _of_small_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` that lists and reads many small files in few tasks.

    Every file of a batch is a path of its own. By default Spark lists such paths in up to 10,000 tasks and reads 32 of them in one.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST))
    return own


def arriving_files(spark: SparkSession, source: str, glob: str | None = None) -> DataFrame:
    """st2: new files of a directory as a stream of documents (text, or the reason why not)."""
    reader = (
        _of_small_files(spark).readStream.format("binaryFile").schema(sf.FILE_SCHEMA).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", BATCH_FILES)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return rq.decode_text(sf.with_names(reader.load(source)))


def file_stream(spark: SparkSession, source: str, target: str, checkpoint: str, glob: str | None = None) -> StreamingQuery:
    """st2: documents of arriving files appended to ``target``, each file once.

    New files of a local or shared folder are listed by a task and noted under ``checkpoint`` (``arrivals``), so the driver holds a name for
    each BATCH_FILES of them. Other sources, and checkpoints that were begun without notes, are listed by Spark, whose driver holds all files.
    """
    root = arrivals.walkable(spark, source, checkpoint)
    if root is None:
        found = arriving_files(spark, source, glob)
    else:
        noted = arrivals.note(spark, root, checkpoint, BATCH_FILES, glob)
        found = rq.decode_text(sf.with_names(arrivals.noted_files(spark, noted)))
    docs = found.select("path", "file_name", "ext", "length", "text", "reason")
    return (
        docs.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

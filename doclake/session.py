"""Session defaults shared by the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(app: str, cpus: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings a cluster job would also carry."""
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.doclake.spread", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))  # bounds batches of large texts
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column expression
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to Python workers that cannot import it by themselves; once for each Spark application.

    Nothing is sent where it is installed or on ``PYTHONPATH``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    on_path = any(os.path.abspath(p) == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    context = spark.sparkContext
    if on_path or "site-packages" in root or getattr(context, "_doclake_sent", False):
        return spark
    folder = tempfile.mkdtemp(prefix="doclake-")
    path = os.path.join(folder, "doclake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "doclake")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), root))
    context.addPyFile(path)
    context._doclake_sent = True
    return spark

"""Queries run from any working directory."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import ROOT, SF_DIR

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
e = importlib.util.module_from_spec(spec); spec.loader.exec_module(e)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", e.queries()["n2_tree_stats"](spark, sys.argv[2]).count())
"""


def test_query_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, SF_DIR], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS " in run.stdout, run.stderr[-2000:]

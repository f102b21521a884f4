"""Queries must not depend on the driver's working directory: run a fitted
model's forecasts from a process started elsewhere."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as E
n = E.queries()["forecast_all"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n)
spark.stop()
"""


def test_queries_run_outside_repo():
    with tempfile.TemporaryDirectory() as d:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=d, env=env, capture_output=True,
                           text=True, timeout=900)
    assert "ROWS" in r.stdout, r.stderr[-2000:]
    assert int(r.stdout.split("ROWS")[1].split()[0]) > 0

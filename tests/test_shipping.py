import os
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
print("ROWS", entry.queries()["declared_symbols"](spark, {DATA!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_workers_get_the_package_wherever_the_driver_starts(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in run.stdout, run.stderr[-2000:]

"""The package reaches Python workers without being installed there."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_with_python_workers_run_from_another_folder(tmp_path, sf):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
print("ROWS", entry.queries()["gram"](spark, {sf!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 30" in done.stdout, done.stderr[-2000:]


def test_written_tables_are_deleted_on_release(spark):
    from gamspark.session import _WRITTEN, materialise, release

    frame = materialise(spark.range(3))
    path = _WRITTEN[-1].removeprefix("file:")
    assert frame.count() == 3 and os.path.isdir(path)
    assert release(spark) >= 1 and not os.path.exists(path)

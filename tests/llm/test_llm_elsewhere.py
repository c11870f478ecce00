"""Executors that cannot import the package still run the operators and the pipeline."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in sorted(n for n in e.queries() if n.startswith("op") or n == "pipeline"):
    e.queries()[name](spark, {folder!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""


def test_from_another_folder(tmp_path, small):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    program = PROGRAM.format(repo=REPO, folder=small)
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]

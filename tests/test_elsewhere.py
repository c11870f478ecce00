"""Executors that cannot import the package still run its Python functions."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("json_flatten", "json_merge", "json_unflatten", "archive_members", "xml_json", "xml_nodes", "str_htmldec",
             "foreach_capture", "udf_group"):
    e.queries()[name](spark, {folder!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""


def test_from_another_folder(tmp_path, small):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(repo=REPO, folder=small)],
        cwd=tmp_path,
        env=env,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]

"""The package reaches Python workers that cannot import it from where they run."""

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["dense_topk"](spark, "/root/testdata/sf0.001").count(), entry.queries()["naive"](spark, "/root/testdata/sf0.001").count())
"""


def test_text_query_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = done.stdout.split("rows")[1].split()
    assert all(int(c) > 0 for c in counts)

import os
import subprocess
import sys
import tempfile
from pathlib import Path

SCRIPT = """
from pyspark.sql import SparkSession
from tessera.sources import scratch

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = scratch.shared_dir(spark)
assert first == scratch.shared_dir(spark)
assert scratch.stored(spark.range(5), "x").count() == 5
assert scratch.checkpointed(spark.range(5)).count() == 5
"""


def test_works_without_the_setting():
    """A session that nobody has configured, in a process of its own."""
    empty = tempfile.mkdtemp(prefix="spark-conf-")
    env = {**os.environ, "SPARK_CONF_DIR": empty, "PYTHONPATH": f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=180, check=False)
    assert done.returncode == 0, done.stderr[-2000:]

"""Shared storage and what a session keeps."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys, time
from pathlib import Path
from pyspark.sql import SparkSession
from skytile.session import release, stored

top = sys.argv[1]
conf = {"spark.master": "local-cluster[1,2,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{top}/shared", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
files = lambda: len(list(Path(top, "local").rglob("shuffle_*")))
a, b = spark.range(1000), spark.range(500, 1500)
out = stored(a.join(b, "id"))
before = files()
del a, b
release(spark)
time.sleep(3)
print("FILES", before, files(), flush=True)
spark.stop()
"""


def test_release_on_a_cluster_lets_go_of_the_last_jobs_shuffles(tmp_path):
    home = tmp_path / "home"
    for d in (home / "work", tmp_path / "local", tmp_path / "shared"):
        d.mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors write to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, capture_output=True, text=True, timeout=180)
    said = [line.split()[1:] for line in done.stdout.splitlines() if line.startswith("FILES")]
    assert said, done.stderr[-2000:]
    before, after = map(int, said[0])
    assert before > 0
    assert after == 0

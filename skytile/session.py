"""Session helpers: shipping this package to executors, shared scratch space, table access."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


#: Bytes of an Arrow batch that a Python worker gets, where the session asks for more; a larger row is a batch by itself.
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors once per application (``addPyFile``), and bound what its workers get at once."""
    sc = spark.sparkContext
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(bound)) > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    if getattr(sc, "_skytile_shipped", False):
        return spark
    target = os.path.join(tempfile.mkdtemp(prefix="skytile-"), "skytile_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(_ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("skytile", os.path.relpath(full, _ROOT)))
    sc.addPyFile(target)
    sc._skytile_shipped = True
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``, the storage shared by driver and executors.

    Where that setting is absent a local folder is chosen once, for a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = getattr(spark.sparkContext, "_skytile_scratch", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext._skytile_scratch = base
    return f"{base.rstrip('/')}/skytile-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared scratch space and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skytile_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these tables, which nothing reads any more."""
    for df in tables:
        jvm, context = df.sparkSession._jvm, df.sparkSession._jsc
        path = jvm.org.apache.hadoop.fs.Path(df._skytile_path)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver go of plans, broadcasts and shuffles of earlier jobs that nothing refers to any more.

    On a cluster the scheduler keeps the tasks of the last job, and with them the shuffles that they read, until it
    gets others; a small job takes their place first.
    """
    spark.range(0, 4, 1, 4).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys into as many partitions as the session shuffles to; small ones aren't joined, as Python work on them isn't small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def free_prefix(*tables: DataFrame, start: str = "own") -> str:
    """A prefix with which no column of these tables begins, for columns that a job adds for itself."""
    names = [c.lower() for df in tables for c in df.columns]
    prefix, n = f"{start}_", 0
    while any(c.startswith(prefix) for c in names):
        n += 1
        prefix = f"{start}{n}_"
    return prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

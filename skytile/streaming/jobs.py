"""Detection jobs as streams: requests to tile tasks, progress, windowed rates, scene results. Each works on a batch, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from skytile.operators.graph import scene_result
from skytile.operators.tiling import grid

BLOCK, BLOCK_GAP = 10240, 256
REQUEST = "job_id long, prefix string, ts timestamp"


def tasks(requests: DataFrame, rasters: DataFrame, block: int = BLOCK, gap: int = BLOCK_GAP) -> DataFrame:
    """A row for each block of each requested scene: stream-static join, then the closed-form grid."""
    j = requests.join(rasters.select("prefix", "image_id", "width", "height"), "prefix")
    g = grid(j, block, gap)
    return g.select("job_id", "ts", "image_id", F.col("tile_id").alias("block"), "x0", "y0", "w", "h")


def percent_after(i: Column, n: Column) -> Column:
    """Progress after block i (from 0) of n: the last of the i-th of n near-equal parts of 0..89."""
    return ((i + 1) * F.floor(F.lit(90) / n) + F.least(i + 1, F.lit(90) % n) - 1).cast("int")


def progress(done: DataFrame, totals: DataFrame, finished: DataFrame | None = None, delay: str = "2 hours") -> DataFrame:
    """Percent per job from finished blocks (job_id, block; as a stream with ts, too) and totals (job_id, n).

    A repeated block counts once: in a stream for ``delay``. Jobs with all blocks are at 95, those of ``finished`` (job_id) at 100.
    """
    if done.isStreaming:
        once = done.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "block"])
        c = once.groupBy("job_id").agg(F.count("*").alias("k"))
    else:
        c = done.groupBy("job_id").agg(F.count_distinct("block").alias("k"))
    c = c.join(totals, "job_id")
    percent = F.when(F.col("k") >= F.col("n"), 95).otherwise(percent_after(F.col("k") - 1, F.col("n")))
    if finished is not None:
        c = c.join(finished.select("job_id", F.lit(True).alias("sent")), "job_id", "left")
        percent = F.when(F.col("sent"), 100).otherwise(percent)
    return c.select("job_id", percent.cast("int").alias("percent"))


def monitor(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests and results in one feed."""
    a = requests.select("job_id", "ts", F.lit("request").alias("topic"), F.lit(None).cast("int").alias("percent"))
    b = results.select("job_id", "ts", F.lit("result").alias("topic"), F.col("percent").cast("int").alias("percent"))
    return a.unionByName(b)


def rates(results: DataFrame, how: str = "tumbling", size: str = "1 hour", slide: str = "15 minutes", gap: str = "10 minutes", delay: str = "2 hours") -> DataFrame:
    """Detections per job and event-time window; late rows within ``delay`` count, repeated events count once."""
    r = results
    if results.isStreaming:
        r = r.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    else:
        r = r.dropDuplicates(["event_id"])
    w = {"tumbling": lambda: F.window("ts", size), "sliding": lambda: F.window("ts", size, slide), "session": lambda: F.session_window("ts", gap)}[how]()
    out = r.groupBy("job_id", w.alias("w")).agg(F.sum("n_dets").alias("n_dets"), F.count("*").alias("n_blocks"))
    return out.select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_dets", "n_blocks")


def scene_results_to(path: str, totals: DataFrame):
    """A ``foreachBatch`` function: scenes are assembled below ``path``/scenes in the batch that brings their last block.

    For sources whose blocks come whole, all rows of a block in one batch; ``scenes.write_scenes`` takes rows in any order and keeps state
    instead of reading what came before.
    Rows are image_id, block and a detection, or nulls for a block without any; totals: image_id, n blocks. What came
    before is kept below ``path``/blocks, a folder for each batch, as are the results. A batch that is replayed
    writes its folders again, so nothing counts twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/blocks/batch_id={batch_id}")
        seen = spark.read.option("basePath", f"{path}/blocks").schema(StructType([*batch.schema, StructField("batch_id", IntegerType())])).parquet(f"{path}/blocks").where(F.col("batch_id") <= batch_id)
        first = seen.groupBy("image_id", "block").agg(F.min("batch_id").alias("batch_id"))
        whole = first.groupBy("image_id").agg(F.count("*").alias("k"), F.max("batch_id").alias("last")).join(totals, "image_id")
        ready = whole.where((F.col("k") >= F.col("n")) & (F.col("last") == batch_id)).select("image_id")
        dets = seen.where("det_id is not null").join(ready, "image_id", "left_semi").drop("batch_id", "block").dropDuplicates(["image_id", "det_id"])
        scene_result(dets).write.mode("overwrite").parquet(f"{path}/scenes/batch_id={batch_id}")

    return write

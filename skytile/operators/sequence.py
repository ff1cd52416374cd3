"""Running offsets, gaps and islands, histogram CDFs and histogram matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def running_offset(df: DataFrame, by: list[str], order: list[str], size: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def zero_islands(df: DataFrame, by: list[str], pos: str, flag: str) -> DataFrame:
    """For each run of zeros between ones: the positions of the one before and the one after."""
    ones = df.where(F.col(flag) == 1)
    w = Window.partitionBy(*by).orderBy("_row")
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(pos)))
    ones = numbered.where(F.col(flag) == 1).withColumn("after", F.lead(pos).over(w)).withColumn("_next", F.lead("_row").over(w))
    return ones.where(F.col("_next") - F.col("_row") > 1).select(*by, F.col(pos).alias("before"), "after")


def histogram(pixels: DataFrame, by: list[str]) -> DataFrame:
    return pixels.groupBy(*by, "val").agg(F.count("*").alias("n"))


def cdf(hist: DataFrame, by: list[str]) -> DataFrame:
    """Cumulative share of each value: at most 256 rows a group."""
    w = Window.partitionBy(*by)
    return hist.withColumn("cdf", F.sum("n").over(w.orderBy("val")) / F.sum("n").over(w))


def match_table(cdfs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, ref, val, matched): each source value's place on the reference's CDF, by linear interpolation.

    Below the first reference level the first value is taken, above the last the last, as interpolation does.
    """
    s = cdfs.select(F.col("image_id").alias("src"), "val", F.col("cdf").alias("q"))
    after = Window.partitionBy("image_id").orderBy("val")
    r = cdfs.withColumn("v1", F.lead("val").over(after)).withColumn("c1", F.lead("cdf").over(after)).select(F.col("image_id").alias("ref"), F.col("val").alias("v0"), F.col("cdf").alias("c0"), "v1", "c1", F.row_number().over(after).alias("k"))
    p = pairs.join(s, "src").join(r, "ref").where((F.col("q") >= F.col("c0")) & ((F.col("q") < F.col("c1")) | F.col("c1").isNull()) | ((F.col("k") == 1) & (F.col("q") < F.col("c0"))))
    inside = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("q") - F.col("c0")) / (F.col("c1") - F.col("c0"))
    return p.select("src", "ref", "val", F.when((F.col("q") < F.col("c0")) | F.col("c1").isNull(), F.col("v0").cast("double")).otherwise(inside).alias("matched"))


def match_tables(cdfs: DataFrame, pairs: DataFrame, by: list[str] = []) -> DataFrame:
    """(pair_id, by, lut): what each byte of a pair's source becomes when its histogram is matched to the reference's.

    cdfs: image_id, by (bands), val, cdf; pairs: pair_id, src, ref. Both lists of a pair lie in one order of shares; a source share takes the last
    reference value at or before it and goes on towards the next one in proportion. Values are rounded half to even; bytes that
    the source does not have become 0.
    """
    after = Window.partitionBy("image_id", *by).orderBy("val")
    known = cdfs.select("image_id", *by, "val", "cdf", F.lead("val").over(after).alias("v1"), F.lead("cdf").over(after).alias("c1"), F.first("val").over(after).alias("least"))
    asks = pairs.join(cdfs.withColumnRenamed("image_id", "src"), "src").select("pair_id", *by, F.col("cdf").alias("q"), F.lit(1).alias("side"), F.col("val").alias("own"), F.lit(None).alias("r"))
    gives = pairs.join(known.withColumnRenamed("image_id", "ref"), "ref").select("pair_id", *by, F.col("cdf").alias("q"), F.lit(0).alias("side"), F.lit(None).alias("own"), F.struct("val", "cdf", "v1", "c1").alias("r"), "least")
    merged = asks.unionByName(gives, allowMissingColumns=True)
    one = Window.partitionBy("pair_id", *by)
    along = one.orderBy("q", "side").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("r", F.last("r", ignorenulls=True).over(along)).withColumn("least", F.max("least").over(one)).where("side = 1")
    step = F.coalesce((F.col("r.v1") - F.col("r.val")) * (F.col("q") - F.col("r.cdf")) / (F.col("r.c1") - F.col("r.cdf")), F.lit(0.0))
    value = F.bround(F.when(F.col("r").isNull(), F.col("least")).otherwise(F.round(F.col("r.val") + step, 9)), 0).cast("int")
    table = merged.groupBy("pair_id", *by).agg(F.map_from_entries(F.collect_list(F.struct("own", value))).alias("m"))
    return table.select("pair_id", *by, F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.coalesce(F.col("m")[v], F.lit(0))).alias("lut"))

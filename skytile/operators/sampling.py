"""Reproducible samples and splits: every choice is an integer hash of keys, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skytile.functions.geo import clamp_window, hashed
from skytile.session import stored

M = 2147483647


def random_n(df: DataFrame, by: list[str], keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, those of smallest hash. Up to a thousand, Spark limits groups before the shuffle; beyond, they are numbered."""
    h = hashed(*[F.col(k) for k in keys], seed=seed)
    if n > 1000:
        return numbered(df, by, [h, *keys]).where(F.col("_r") <= n).drop("_r", "_n")
    w = Window.partitionBy(*by).orderBy("_h", *keys)
    return df.withColumn("_h", h).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_h", "_r")


def stratified(df: DataFrame, by: list[str], cls: str, keys: list[str], ratio: float, n: int = 10, seed: int = 0) -> DataFrame:
    """Per group and class with int(count * ratio) > 0, at most n rows."""
    counts = df.groupBy(*by, cls).agg(F.count("*").alias("_c")).where(F.floor(F.col("_c") * ratio) > 0).drop("_c")
    return random_n(df.join(counts, [*by, cls], "left_semi"), [*by, cls], keys, n, seed)


def bernoulli(df: DataFrame, keys: list[str], p: float, seed: int = 0) -> DataFrame:
    return df.where(hashed(*[F.col(k) for k in keys], seed=seed) < int(p * M))


def points_in_boxes(boxes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n integer points in each box, then distinct ones (image_id, x, y)."""
    t = boxes.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    at = lambda lo, hi, s: (F.col(lo) + hashed(F.col("box_id"), F.col("i"), seed=seed + s) % (F.col(hi) - F.col(lo) + 1)).cast("int")
    return t.select("image_id", at("xmin", "xmax", 1).alias("x"), at("ymin", "ymax", 2).alias("y")).distinct()


def dense_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """Running ids in the given order without gathering: range-partitioned sort, counts per partition, offsets."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("_m", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return rows.join(offsets, "_p").withColumn(name, F.col("_o") + F.col("_i") + start).drop("_m", "_p", "_i", "_o")


def random_pairs(ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n draws of two different rows of ``ids`` (id): drawn places in the dense order are joined back."""
    dense = stored(dense_ids(ids.select("id"), ["id"], "k", 0), "dense")
    size = dense.count()
    if size < 2:
        return dense.sparkSession.createDataFrame([], "draw long, id_a long, id_b long")
    d = dense.sparkSession.range(n).withColumnRenamed("id", "draw")
    a = hashed(F.col("draw"), seed=seed + 1) % size
    d = d.withColumn("ka", a).withColumn("kb", (a + 1 + hashed(F.col("draw"), seed=seed + 2) % (size - 1)) % size)
    look = lambda k, c: dense.select(F.col("k").alias(k), F.col("id").alias(c))
    return d.join(look("ka", "id_a"), "ka").join(look("kb", "id_b"), "kb").select("draw", "id_a", "id_b")


def numbered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """``df`` with its place in its group (``_r``, from 1) and the group's size (``_n``), however large the group.

    A range-partitioned sort puts a group's rows one after another, over several partitions if need be; their counts
    in the partitions before are added.
    """
    keys = [*[F.col(c) for c in by], *order]
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), "sorted").withColumn("_p", F.shiftright("_m", 33))
    parts = rows.groupBy(*by, "_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))  # a row per group and partition
    group = Window.partitionBy(*by)
    before = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_p").alias("_part"), "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(group).alias("_n"))
    same = F.col("_p") == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(parts, same).withColumn("_r", F.col("_m") - F.col("_first") + F.col("_o") + 1).select(*df.columns, "_r", "_n")


def _placed(df: DataFrame, by: list[str], keys: list[str], seed: int) -> DataFrame:
    return numbered(df, by, [hashed(*[F.col(k) for k in keys], seed=seed), *keys])


def split_by_class(df: DataFrame, by: list[str], keys: list[str], cuts: list[tuple[str, Column]], seed: int = 0) -> DataFrame:
    """``df`` with ``part``: in each class's hashed order, the first part whose bound (a column over _n) is not passed."""
    p = _placed(df, by, keys, seed)
    part = None
    for name, bound in cuts:
        part = F.when(F.col("_r") <= bound, name) if part is None else part.when(F.col("_r") <= bound, name)
    return p.withColumn("part", part).drop("_r", "_n")


def split_80_20(df, by, keys, seed=0):
    return split_by_class(df, by, keys, [("train", F.ceil(F.col("_n") * 8 / 10)), ("val", F.col("_n"))], seed)


def split_80_10_10(df, by, keys, seed=0):
    return split_by_class(df, by, keys, [("train", F.floor(F.col("_n") * 8 / 10)), ("val", F.floor(F.col("_n") * 9 / 10)), ("test", F.col("_n"))], seed)


def k_folds(df: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """``df`` with ``fold``: contiguous, the first n % k folds one row longer. Ids are dense, so no task holds all rows."""
    d = stored(dense_ids(df, order, "_id", 0), "dense")
    n = d.count()
    long, size = n % k, n // k
    fold = F.when(F.col("_id") < long * (size + 1), F.floor(F.col("_id") / (size + 1))).otherwise(long + F.floor((F.col("_id") - long * (size + 1)) / max(size, 1)))
    return d.withColumn("fold", fold.cast("int")).drop("_id")


def fold_members(folds: DataFrame, k: int = 5) -> DataFrame:
    """A row per fold and input row with ``role``: val in its own fold, train in all others."""
    return folds.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("role", F.when(F.col("run") == F.col("fold"), "val").otherwise("train"))


def spatial_cut(boxes: DataFrame) -> DataFrame:
    """Per scene: the axis of its longer side and the place of the 80 % cut between box centres; null with one box."""
    c = boxes.withColumn("xc", F.floor((F.col("xmin") + F.col("xmax")) / 2)).withColumn("yc", F.floor((F.col("ymin") + F.col("ymax")) / 2))
    axis = c.groupBy("image_id").agg((F.max("xmax") - F.min("xmin") >= F.max("ymax") - F.min("ymin")).alias("along_x"), F.count("*").alias("n"))
    v = c.join(axis, "image_id").withColumn("v", F.when(F.col("along_x"), F.col("xc")).otherwise(F.col("yc")))
    w = Window.partitionBy("image_id").orderBy("v", "box_id")
    v = v.withColumn("i", F.row_number().over(w) - 1).withColumn("next", F.lead("v").over(w))
    at = F.least(F.floor(F.col("n") * 8 / 10), F.col("n") - 2)
    cut = v.where(F.col("i") == at).select("image_id", F.floor((F.col("v") + F.col("next")) / 2).alias("cut"))
    return axis.join(cut, "image_id", "left").select("image_id", F.when(F.col("along_x"), "x").otherwise("y").alias("axis"), "cut")


def point_windows(points: DataFrame, halves: list[int] = [512, 1024, 2048], seed: int = 0) -> DataFrame:
    """Points (image_id, x, y, width, height, ..) with a window about each, ``halves`` drawn for either side, kept inside the raster: x0, y0, w, h."""
    options = F.array(*[F.lit(h) for h in halves])
    half = lambda s: F.get(options, (hashed(F.col("image_id"), F.col("x"), F.col("y"), seed=seed + s) % len(halves)).cast("int"))
    p = points.withColumn("ex", half(0)).withColumn("ey", half(1))
    w = clamp_window(F.col("x") - F.col("ex"), F.col("y") - F.col("ey"), 2 * F.col("ex"), 2 * F.col("ey"), F.col("width"), F.col("height"))
    return p.select(*points.columns, *[w[c].alias(c) for c in ("x0", "y0", "w", "h")])


def drawn_crops(boxes: DataFrame, times: int = 3, labels: int = 3, least: int = 600, most: int = 1024, seed: int = 0) -> DataFrame:
    """``times`` crops about each box of class up to ``labels``: (image_id, box_id, copy, x0, y0, w, h).

    A side is drawn between one and a half and two sides of the box, at least ``least`` and up to ``most``, and the box's place in
    it is drawn, too; crops start at 1 at the earliest and are cut at the raster's end. boxes carry width and height.
    """
    b = boxes.where(F.col("label") <= labels).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    draw = lambda s: hashed(F.col("box_id"), F.col("copy"), seed=seed + s)
    out = {}
    for k, (lo, hi, start, size, whole) in enumerate((("xmin", "xmax", "x0", "w", "width"), ("ymin", "ymax", "y0", "h", "height"))):
        side = F.col(hi) - F.col(lo)
        low, high = F.greatest(F.floor(side * 1.5), F.lit(least)), F.greatest(side * 2, F.lit(most))
        drawn = low + draw(2 * k) % (high - low)
        first = F.greatest(F.lit(1), F.col(lo) - draw(2 * k + 1) % (drawn - side))
        out[start], out[size] = first, F.least(drawn, F.col(whole) - first)
    return b.select("image_id", "box_id", "copy", *[c.cast("int").alias(n) for n, c in out.items()])

"""Tile grids from raster sizes: closed forms, a row per tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tiles_along(size: Column, sub: Column, stride: Column) -> Column:
    return F.when(size <= sub, F.lit(1)).otherwise(1 + F.ceil((size - sub) / stride)).cast("int")


def grid(rasters: DataFrame, subsize: int | Column = 1024, gap: int | Column = 256, shift_in: bool = False) -> DataFrame:
    """Overlapping tiles of each raster, columns first; the last is cut, or moved inside with ``shift_in``."""
    sub = F.lit(subsize) if isinstance(subsize, int) else subsize
    stride = sub - (F.lit(gap) if isinstance(gap, int) else gap)
    t = rasters.withColumn("ny", tiles_along(F.col("height"), sub, stride))
    t = t.withColumn("col", F.explode(F.sequence(F.lit(0), tiles_along(F.col("width"), sub, stride) - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    x0, y0 = (F.col("col") * stride), (F.col("row") * stride)
    if shift_in:
        x0, y0 = F.greatest(F.lit(0), F.least(x0, F.col("width") - sub)), F.greatest(F.lit(0), F.least(y0, F.col("height") - sub))
    t = t.withColumn("x0", x0.cast("int")).withColumn("y0", y0.cast("int"))
    w, h = F.least(sub, F.col("width") - F.col("x0")).cast("int"), F.least(sub, F.col("height") - F.col("y0")).cast("int")
    return t.withColumn("w", w).withColumn("h", h).withColumn("tile_id", (F.col("col") * F.col("ny") + F.col("row")).cast("int")).drop("ny")


def named_retile(rasters: DataFrame, size: int = 1024, overlap: int = 0) -> DataFrame:
    """Row-major tiles, numbered from 1 and named with as many digits as the largest number of a side has."""
    t = grid(rasters, size, overlap)
    stride = size - overlap
    nx, ny = tiles_along(F.col("width"), F.lit(size), F.lit(stride)), tiles_along(F.col("height"), F.lit(size), F.lit(stride))
    digits = F.length(F.greatest(nx, ny).cast("string"))
    number = lambda c: F.lpad((F.col(c) + 1).cast("string"), digits, F.lit("0"))
    return t.withColumn("name", F.concat_ws("_", "prefix", number("row"), number("col"))).withColumn("seq", F.col("row") * nx + F.col("col") + 1)


def multi_grid(rasters: DataFrame, sizes: list[tuple[int, float]], gaps: list[int]) -> DataFrame:
    """The grids of every (subsize, scale) with every gap: the few settings are exploded from an array."""
    settings = F.array(*[F.struct(F.lit(s).alias("subsize"), F.lit(float(k)).alias("scale"), F.lit(g).alias("gap")) for s, k in sizes for g in gaps])
    t = rasters.withColumn("s", F.explode(settings)).select("*", "s.*").drop("s")
    return grid(t, F.col("subsize"), F.col("gap"))


def pyramid(rasters: DataFrame, levels: int, size: int = 1024) -> DataFrame:
    """Tiles of each level; level k halves (rounding down) the size of level k-1 and doubles the pixel."""
    out = None
    for k in range(levels + 1):
        part = rasters.withColumn("level", F.lit(k)).withColumn("width", F.shiftright("width", k)).withColumn("height", F.shiftright("height", k)).withColumn("pixel", F.col("gt1") * (1 << k)).where("width > 0 and height > 0")
        part = grid(part, size, 0)
        out = part if out is None else out.unionByName(part)
    return out


def split_evenly(windows: DataFrame, part: int = 1024) -> DataFrame:
    """Each window in max(1, round(side / part)) near-equal parts a side (half to even); the first ones get one pixel more."""
    n = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) / part, 0).cast("int"))
    t = windows.withColumn("nx", n("w")).withColumn("ny", n("h"))
    t = t.withColumn("px", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("py", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    base = lambda c, k: F.floor(F.col(c) / F.col(k)).cast("int")
    start = lambda c, k, p: F.col(p) * base(c, k) + F.least(F.col(p), F.col(c) % F.col(k))
    size = lambda c, k, p: base(c, k) + F.when(F.col(p) < F.col(c) % F.col(k), 1).otherwise(0)
    return t.select("image_id", "win_id", "px", "py", (F.col("x0") + start("w", "nx", "px")).alias("x0"), (F.col("y0") + start("h", "ny", "py")).alias("y0"), size("w", "nx", "px").alias("w"), size("h", "ny", "py").alias("h"))


def to_scene(detections: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile detections in scene coordinates: the tile's origin is added. Join on (image_id, tile_id)."""
    # By shuffle at every size: exploded tiles are many more than the optimizer takes them for.
    j = detections.join(tiles.select("image_id", "tile_id", "x0", "y0").hint("merge"), ["image_id", "tile_id"])
    return j.select(*[(F.col(c) + F.col("x0" if c[0] == "x" else "y0")).alias(c) if c in ("xmin", "ymin", "xmax", "ymax") else F.col(c) for c in detections.columns])

"""Joins of boxes with boxes and tiles by grid cells of several sizes: equi-joins, no pair of far boxes is ever formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skytile.functions.geo import area, intersection, iou

BOX = ("xmin", "ymin", "xmax", "ymax")
#: Least cell side in pixels, about the size of a large box, so that most boxes cover few cells of one level.
CELL = 256


def _level(prefix: str, cell: float) -> Column:
    """The level (cells have 2 ** level pixels a side) on which a box, grown by one pixel, covers at most two cells a side."""
    side = lambda c: F.greatest(F.col(f"{prefix}{c}max") - F.col(f"{prefix}{c}min"), F.lit(0)) + 2
    return F.ceil(F.log2(F.greatest(side("x"), side("y"), F.lit(cell)).cast("double"))).cast("int")


def _posted(df: DataFrame, prefix: str, side: Column) -> DataFrame:
    """A row for each cell of this side that a box, grown by one pixel, covers."""
    at = lambda c: F.floor(c / side).cast("long")
    span = lambda c: F.explode(F.sequence(at(F.col(f"{prefix}{c}min")), at(F.greatest(F.col(f"{prefix}{c}max"), F.col(f"{prefix}{c}min")) + 1)))
    return df.withColumn("cx", span("x")).withColumn("cy", span("y"))


def _prefixed(df: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in by else F.col(c).alias(prefix + c) for c in df.columns])


def overlap_pairs(a: DataFrame, b: DataFrame, by: list[str] = ["image_id"], cell: int = CELL, inclusive: bool = True, levels: bool = False) -> DataFrame:
    """Pairs of boxes of a and b (columns prefixed a_ and b_) that overlap, with ``inter`` and ``iou``.

    A pair meets in each cell that both cover and is kept in the one that holds the corner of its intersection. With ``levels``, for boxes
    that may be much larger than a cell, a box is posted in cells of a level of its own size, so it covers at most four. A pair then meets on
    the level of its larger box, to which the smaller one goes up if the other table has boxes there: boxes of a on their own level meet all
    of b (tag 0), those that went up meet only boxes of b on their own level (tag 1). The levels in use, some twenty at most, are found first.
    """
    left, right = _prefixed(a, "a_", by), _prefixed(b, "b_", by)
    side, keys = F.lit(cell), [*by, "cx", "cy"]
    if levels:
        used = lambda df, p: df.agg(F.collect_set(_level(p, cell))).scalar()
        on_a, on_b, own = used(left, "a_"), used(right, "b_"), F.col("own")
        left = left.withColumn("own", _level("a_", cell)).withColumn("level", F.explode(F.array_union(F.array("own"), on_b))).where(F.col("level") >= own)
        left = left.withColumn("tag", F.when(F.col("level") == own, 0).otherwise(1)).drop("own")
        right = right.withColumn("own", _level("b_", cell)).withColumn("level", F.explode(F.array_union(F.array("own"), on_a))).where(F.col("level") >= own)
        right = right.withColumn("tag", F.explode(F.when((F.col("level") == own) & (F.array_min(on_a) < own), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("own")
        side, keys = F.pow(F.lit(2.0), F.col("level")), [*keys, "level", "tag"]
    # By shuffle at every size: the optimizer takes posted boxes and exploded tiles for as few as their source's rows and would broadcast them.
    pairs = _posted(left, "a_", side).join(_posted(right, "b_", side).hint("merge"), keys)
    owner = (F.col("cx") == F.floor(F.greatest("a_xmin", "b_xmin") / side)) & (F.col("cy") == F.floor(F.greatest("a_ymin", "b_ymin") / side))
    inter = intersection("a_", "b_", inclusive)
    return pairs.where(owner & (inter > 0)).drop("cx", "cy", *(["level", "tag"] if levels else [])).withColumn("inter", inter).withColumn("iou", iou("a_", "b_", inclusive))


def best_iou(a: DataFrame, b: DataFrame, keys: list[str], by: list[str] = ["image_id"], inclusive: bool = False) -> DataFrame:
    """``a`` with ``max_iou``, its largest overlap with any box of b (0 if none)."""
    found = overlap_pairs(a, b, by, inclusive=inclusive).groupBy(*by, *[F.col(f"a_{k}").alias(k) for k in keys]).agg(F.max("iou").alias("max_iou"))
    return a.join(found, [*by, *keys], "left").withColumn("max_iou", F.coalesce("max_iou", F.lit(0.0)))


def tile_boxes(tiles: DataFrame, boxes: DataFrame, keep: float = 0.7) -> DataFrame:
    """Boxes that touch tiles, shifted to the tile and clipped a pixel inside it, with ``kept`` (enough area left).

    tiles: image_id, tile_id, x0, y0, w, h; boxes: image_id, box_id, xmin, ymin, xmax, ymax, label.
    """
    t = tiles.select("image_id", "tile_id", "x0", "y0", "w", "h", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + F.col("w")).alias("xmax"), (F.col("y0") + F.col("h")).alias("ymax"))
    pairs = overlap_pairs(boxes.select("image_id", "box_id", *BOX, "label"), t, cell=1024).where("iou > 1e-8")
    shift = {c: (F.col(f"a_{c}") - F.col("b_x0" if c[0] == "x" else "b_y0")).cast("int") for c in BOX}
    s = pairs.select("image_id", F.col("b_tile_id").alias("tile_id"), F.col("a_box_id").alias("box_id"), F.col("a_label").alias("label"), F.col("b_w").alias("w"), F.col("b_h").alias("h"), *[v.alias("o_" + c) for c, v in shift.items()])
    s = s.select("*", F.greatest(F.lit(1), "o_xmin").alias("xmin"), F.greatest(F.lit(1), "o_ymin").alias("ymin"), F.least(F.col("o_xmax"), F.col("w") - 1).alias("xmax"), F.least(F.col("o_ymax"), F.col("h") - 1).alias("ymax"))
    full = (F.col("o_xmax") - F.col("o_xmin")) * (F.col("o_ymax") - F.col("o_ymin"))
    left = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return s.withColumn("kept", left >= F.lit(keep) * full).drop("o_xmin", "o_ymin", "o_xmax", "o_ymax")


def drop_touching_rejected(clipped: DataFrame, contain: bool = False) -> DataFrame:
    """Kept boxes of ``tile_boxes`` that overlap no rejected box of their tile (or, with ``contain``, lie in none)."""
    kept, gone = clipped.where("kept"), clipped.where("not kept")
    by = ["image_id", "tile_id"]
    hits = overlap_pairs(kept.select(*by, "box_id", *BOX), gone.select(*by, "box_id", *BOX), by)
    if contain:
        hits = hits.where("a_xmin >= b_xmin and a_ymin >= b_ymin and a_xmax <= b_xmax and a_ymax <= b_ymax")
    return kept.join(hits.select(*by, F.col("a_box_id").alias("box_id")).distinct(), [*by, "box_id"], "left_anti")


def covered_share(boxes: DataFrame, windows: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes more than ``least`` of whose area lies in a window, clipped to it. windows: image_id, win_id, x0, y0, w, h."""
    w = windows.select("image_id", "win_id", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + F.col("w")).alias("xmax"), (F.col("y0") + F.col("h")).alias("ymax"), "w", "h")
    pairs = overlap_pairs(boxes, w, cell=1024, inclusive=False)
    share = F.try_divide(F.col("inter").cast("double"), area("a_", False))
    clip = lambda c, side, size: F.greatest(F.lit(0), F.least(F.col(f"a_{c}") - F.col(f"b_{side}min"), F.col(f"b_{size}") - 1)).alias(c)
    return pairs.withColumn("share", share).where(F.col("share") > least).select("image_id", F.col("b_win_id").alias("win_id"), F.col("a_box_id").alias("box_id"), "share", clip("xmin", "x", "w"), clip("ymin", "y", "h"), clip("xmax", "x", "w"), clip("ymax", "y", "h"))


def fully_inside(boxes: DataFrame, windows: DataFrame) -> DataFrame:
    """Boxes that lie in a window as a whole, shifted to it."""
    w = windows.select("image_id", "win_id", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + F.col("w")).alias("xmax"), (F.col("y0") + F.col("h")).alias("ymax"))
    pairs = overlap_pairs(boxes, w, cell=1024)
    ok = "a_xmin >= b_xmin and a_xmin < a_xmax and a_xmax < b_xmax and a_ymin >= b_ymin and a_ymin < a_ymax and a_ymax < b_ymax"
    return pairs.where(ok).select("image_id", F.col("b_win_id").alias("win_id"), F.col("a_box_id").alias("box_id"), *[(F.col(f"a_{c}") - F.col(f"b_{c[0]}min")).alias(c) for c in BOX])


def windows_without_boxes(windows: DataFrame, boxes: DataFrame, most: float = 1e-6) -> DataFrame:
    """Windows whose largest inclusive overlap with any box is at most ``most``."""
    w = windows.select("image_id", "win_id", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + F.col("w")).alias("xmax"), (F.col("y0") + F.col("h")).alias("ymax"))
    hit = overlap_pairs(w, boxes.select("image_id", *BOX), cell=1024).where(F.col("iou") > most).select("image_id", F.col("a_win_id").alias("win_id")).distinct()
    return windows.join(hit, ["image_id", "win_id"], "left_anti")


def nearest_box(boxes: DataFrame) -> DataFrame:
    """Each box with its nearest other by centre distance, where that is less than three times the smaller width and height.

    No partner beyond three times a box's own smaller side can be accepted, so a box looks into the cells that reach that far, four at
    most, on the level whose side (a power of two) is at least twice as far; boxes are posted on the few levels that their image asks for.
    Pairs farther apart are dropped before the nearest are grouped.
    """
    c = boxes.select("image_id", "box_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("xc"), ((F.col("ymin") + F.col("ymax")) / 2).alias("yc"), (F.col("xmax") - F.col("xmin")).alias("bw"), (F.col("ymax") - F.col("ymin")).alias("bh"))
    reach = 3 * F.least("bw", "bh")
    asks = c.where(reach > 0).withColumn("level", (F.ceil(F.log2(reach.cast("double"))) + 1).cast("int")).withColumn("reach", reach)
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    around = lambda c: F.explode(F.sequence(cell(F.col(c) - F.col("reach")), cell(F.col(c) + F.col("reach"))))
    held = c.join(asks.select("image_id", "level").distinct(), "image_id").withColumn("cx", cell(F.col("xc"))).withColumn("cy", cell(F.col("yc")))
    keys = ["image_id", "level", "cx", "cy"]
    asks = asks.withColumn("cx", around("xc")).withColumn("cy", around("yc")).drop("reach")
    dx, dy = F.col("a_xc") - F.col("b_xc"), F.col("a_yc") - F.col("b_yc")
    pairs = _prefixed(asks, "a_", keys).join(_prefixed(held, "b_", keys).hint("merge"), keys).where("a_box_id <> b_box_id").withColumn("d2", dx * dx + dy * dy)
    pairs = pairs.where((F.sqrt("d2") < 3 * F.col("a_bw")) & (F.sqrt("d2") < 3 * F.col("a_bh")))
    near = (F.sqrt("d2") < 3 * F.col("b_bw")) & (F.sqrt("d2") < 3 * F.col("b_bh"))
    best = pairs.groupBy("image_id", F.col("a_box_id").alias("box_id")).agg(F.min(F.struct("d2", F.col("b_box_id").alias("near_id"), near.alias("ok"))).alias("m"))
    return best.where("m.ok").select("image_id", "box_id", "m.near_id", "m.d2")


def tiles_in_rectangle(tiles: DataFrame, rects: DataFrame) -> DataFrame:
    """Tiles that cross map rectangles, with the common window in tile pixels.

    tiles: tile_id, gt0, gt1, gt3, gt5, w, h; rects: rect_id, minx, miny, maxx, maxy. Cells are of map units.
    """
    t = tiles.select("tile_id", "gt0", "gt1", "gt3", "gt5", "w", "h", F.col("gt0").alias("minx"), (F.col("gt0") + F.col("gt1") * F.col("w")).alias("maxx"), (F.col("gt3") + F.col("gt5") * F.col("h")).alias("miny"), F.col("gt3").alias("maxy"))
    a = rects.select("rect_id", F.col("minx").alias("xmin"), F.col("miny").alias("ymin"), F.col("maxx").alias("xmax"), F.col("maxy").alias("ymax"), F.lit(0).alias("one"))
    b = t.select("tile_id", F.col("minx").alias("xmin"), F.col("miny").alias("ymin"), F.col("maxx").alias("xmax"), F.col("maxy").alias("ymax"), "gt0", "gt1", "gt3", "gt5", F.lit(0).alias("one"))
    p = overlap_pairs(a, b, ["one"], cell=4096, inclusive=False, levels=True)
    x0, x1, y0, y1 = F.greatest("a_xmin", "b_xmin"), F.least("a_xmax", "b_xmax"), F.greatest("a_ymin", "b_ymin"), F.least("a_ymax", "b_ymax")
    px = lambda v: ((v - F.col("b_gt0")) / F.col("b_gt1") + 0.5).cast("int")
    py = lambda v: ((v - F.col("b_gt3")) / F.col("b_gt5") + 0.5).cast("int")
    return p.select(F.col("a_rect_id").alias("rect_id"), F.col("b_tile_id").alias("tile_id"), px(x0).alias("x0"), py(y1).alias("y0"), (px(x1) - px(x0)).alias("w"), (py(y0) - py(y1)).alias("h"))


def segment_tiles(points: DataFrame, size: int = 2048) -> DataFrame:
    """Tiles that the segments of polylines cross. points: image_id, line_id, pos, x, y. Exact segment-rectangle test."""
    after = Window.partitionBy("image_id", "line_id").orderBy("pos")
    s = points.withColumn("x2", F.lead("x").over(after)).withColumn("y2", F.lead("y").over(after)).where("x2 is not null")
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size).cast("int"), F.floor(F.greatest(a, b) / size).cast("int"))
    t = s.withColumn("col", F.explode(span("x", "x2"))).withColumn("row", F.explode(span("y", "y2")))
    # Liang-Barsky: the part of the segment inside each pair of borders.
    lo, hi = F.lit(0.0), F.lit(1.0)
    ok: Column = F.lit(True)
    for p, d, k in (("x", "x2", "col"), ("y", "y2", "row")):
        delta, left, right = F.col(d) - F.col(p), F.col(k) * size - F.col(p), (F.col(k) + 1) * size - F.col(p)
        a, b = F.try_divide(left, delta), F.try_divide(right, delta)
        ok = ok & F.when(delta == 0, (left <= 0) & (right > 0)).otherwise(F.lit(True))
        lo = F.when(delta == 0, lo).otherwise(F.greatest(lo, F.least(a, b)))
        hi = F.when(delta == 0, hi).otherwise(F.least(hi, F.greatest(a, b)))
    return t.withColumn("t0", lo).withColumn("t1", hi).where(ok & (F.col("t0") <= F.col("t1"))).select("image_id", "line_id", "pos", "col", "row", "t0", "t1")

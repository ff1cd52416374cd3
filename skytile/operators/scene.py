"""Scenes made up from parts: split, draw, paste, merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skytile.functions.geo import hashed
from skytile.operators.pieces import array_of, mosaic, rows_of as pieces_rows, sampled, sent as pieces_sent
from skytile.operators.raster import composed, draw_lines, paste_plan
from skytile.session import ship, stored


def line_pixels(x1: float, y1: float, x2: float, y2: float, x0: int, y0: int, size: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, squared distance) of the pixels of a tile at (x0, y0) whose distance from a segment is at most ``reach``.

    The tile's columns (rows, for a steep segment) are walked along; in each, the few pixels about the line are measured.
    """
    steep = abs(y2 - y1) > abs(x2 - x1)
    u1, v1, u2, v2, u0, v0 = (y1, x1, y2, x2, y0, x0) if steep else (x1, y1, x2, y2, x0, y0)
    du, dv = u2 - u1, v2 - v1
    lo, hi = max(u0, int(np.ceil(min(u1, u2) - reach))), min(u0 + size - 1, int(np.floor(max(u1, u2) + reach)))
    u = np.arange(lo, hi + 1)
    slope = dv / du if du else 0.0
    middle = v1 + np.clip((u - u1) * slope, min(0.0, dv), max(0.0, dv))
    # Across the walk the line is as far from its neighbours as its slope makes it, at most by the root of two.
    far = int(np.ceil(reach * np.sqrt(1 + slope * slope))) + 2
    v = (np.floor(middle)[:, None] + np.arange(-far, far + 1)).astype(np.int64)
    u = np.broadcast_to(u[:, None], v.shape)
    own = (v >= v0) & (v < v0 + size)
    u, v = u[own], v[own]
    length = du * du + dv * dv
    t = np.clip(((u - u1) * du + (v - v1) * dv) / length, 0, 1) if length else 0.0
    d2 = np.round((u - u1 - t * du) ** 2 + (v - v1 - t * dv) ** 2, 9)
    hit = d2 <= reach * reach
    return (v[hit], u[hit], d2[hit]) if steep else (u[hit], v[hit], d2[hit])


def line_ends(points: DataFrame, size: int = 2048, thickness: float = 2.0) -> DataFrame:
    """For each tile that a polyline's pixels lie in, the leftmost and rightmost of them, in scene pixels: (image_id, line_id, col, row, x1, y1, x2, y2).

    A line's pixels are those within half its thickness of a segment. Of several leftmost or rightmost ones the one nearest to
    the line counts, then the uppermost. points: image_id, line_id, pos, x, y. Segments visit the tiles that their
    extent, grown by the thickness, covers; each tile is walked along by itself.
    """
    reach = thickness / 2
    after = Window.partitionBy("image_id", "line_id").orderBy("pos")
    s = points.withColumn("ex", F.lead("x").over(after)).withColumn("ey", F.lead("y").over(after)).where("ex is not null")
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - reach) / size).cast("int"), F.floor((F.greatest(a, b) + reach) / size).cast("int")))
    t = s.withColumn("col", span(F.col("x"), F.col("ex"))).withColumn("row", span(F.col("y"), F.col("ey")))

    @F.pandas_udf("hit boolean, fx long, fd double, fy long, lx long, ld double, ly long")
    def walk(x: pd.Series, y: pd.Series, ex: pd.Series, ey: pd.Series, c: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = []
        for x1, y1, x2, y2, cc, rr in zip(x, y, ex, ey, c, r):
            px, py, d2 = line_pixels(x1, y1, x2, y2, int(cc) * size, int(rr) * size, size, reach)
            a, b = (np.lexsort((py, d2, k))[0] if len(px) else None for k in (px, -px))
            out.append((False, 0, 0.0, 0, 0, 0.0, 0) if a is None else (True, px[a], d2[a], py[a], px[b], d2[b], py[b]))
        return pd.DataFrame(out, columns=["hit", "fx", "fd", "fy", "lx", "ld", "ly"])

    e = t.withColumn("e", walk(*[F.col(c).cast("double") for c in ("x", "y", "ex", "ey")], "col", "row")).where("e.hit")
    found = e.groupBy("image_id", "line_id", "col", "row").agg(F.min(F.struct("e.fx", "e.fd", "e.fy")).alias("a"), F.min(F.struct((-F.col("e.lx")).alias("lx"), "e.ld", "e.ly")).alias("b"))
    return found.select("image_id", "line_id", "col", "row", F.col("a.fx").alias("x1"), F.col("a.fy").alias("y1"), (-F.col("b.lx")).alias("x2"), F.col("b.ly").alias("y2"))


def synthetic_scene(tiles: DataFrame, points: DataFrame, foregrounds: DataFrame, size: int, out_size: int, seed: int = 0, most: int = 2, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Two mosaics of a scene whose tiles got lines and foregrounds: of all tiles, and of the touched ones alone.

    tiles: image_id, tile_id, col, row, x0, y0, w, h, bands, data (RGB) of a grid of ``size`` without overlap; points: the
    polylines, of which each image's first is drawn; foregrounds: fg_id (dense from 0), fw, fh, data (RGBA), of which
    up to ``most`` go on a touched tile. Mosaic tiles are of ``out_size`` and keep pixels that are zero as they were. Segments under ``least`` pixels are not drawn.
    """
    first = points.join(points.groupBy("image_id").agg(F.min("line_id").alias("line_id")), ["image_id", "line_id"])
    ship(tiles.sparkSession)
    seg = line_ends(first, size)
    place = tiles.select("image_id", "tile_id", "col", "row", "x0", "y0")
    own = seg.join(place, ["image_id", "col", "row"])
    shifted = own.select("image_id", "tile_id", *[(F.col(c) - F.col(c[0] + "0")).alias(c) for c in ("x1", "y1", "x2", "y2")])
    touched = tiles.join(shifted.select("image_id", "tile_id").distinct(), ["image_id", "tile_id"], "left_semi")
    drawn = stored(draw_lines(touched, shifted, least=least).withColumn("bg_id", F.monotonically_increasing_id()), "drawn")
    plan = paste_plan(drawn.select("bg_id", "w", "h"), foregrounds, most=most, seed=seed)
    done = stored(composed(drawn, foregrounds, plan).select("image_id", "tile_id", "x0", "y0", "w", "h", "bands", "data"), "composed")
    rest = tiles.join(done.select("image_id", "tile_id"), ["image_id", "tile_id"], "left_anti").select(*done.columns)
    merged = lambda t: mosaic(t.withColumn("order", F.col("tile_id")), out_size, nodata=0, by=["image_id"])
    return merged(done.unionByName(rest)), merged(done)


# ---- foregrounds placed on a mask -----------------------------------------------------------------------------

PLACED = "image_id long, tile_id int, slot int, fg_id long, x int, y int, fw int, fh int, angle double"


def turned_size(w: float, h: float, angle: float) -> tuple[int, int]:
    """Size of the box about a turned rectangle, in whole pixels."""
    c, s = abs(np.cos(angle)), abs(np.sin(angle))
    return int(np.ceil(w * c + h * s - 1e-6)), int(np.ceil(w * s + h * c - 1e-6))


def place_on_mask(mask: np.ndarray, angles: np.ndarray | None, sizes: list[tuple[int, int]], rng: np.random.Generator, tries: int = 10, gap: int = 5) -> list[tuple[int, int, int, int, int, float]]:
    """(slot, x, y, w, h, angle) of rectangles of these sizes about drawn non-zero pixels of a mask, turned by the angle there.

    A drawn pixel too near to the border is drawn again, up to ``tries`` times. A place that leaves the picture or touches an earlier one is given up; about
    an accepted one the mask is cleared, with a margin. A summed-area table tells at once whether a rectangle is free.
    """
    h, w = mask.shape
    free = mask != 0
    table = np.zeros((h + 1, w + 1), np.int64)
    out = []
    for slot, (fw, fh) in enumerate(sizes):
        at = np.flatnonzero(free)
        if not len(at):
            break
        margin = (max(fw, fh) // 2 + 10) // 2
        for _ in range(tries + 1):
            cy, cx = divmod(int(at[rng.integers(len(at))]), w)
            if min(cy, cx, h - cy, w - cx) >= margin and cy and cx:
                break
        else:
            continue
        angle = float(angles[cy, cx]) if angles is not None else 0.0
        tw, th = turned_size(fw, fh, angle)
        x, y = cx - tw // 2, cy - th // 2
        if x <= 0 or y <= 0 or x + tw >= w - 1 or y + th >= h - 1 or table[y + th, x + tw] - table[y, x + tw] - table[y + th, x] + table[y, x]:
            continue
        out.append((slot, x, y, tw, th, angle))
        taken = np.zeros((h, w), bool)
        taken[y : y + th, x : x + tw] = True
        table[1:, 1:] += taken.cumsum(0).cumsum(1)
        free[max(0, y - gap) : y + th + gap, max(0, x - gap) : x + tw + gap] = False
    return out


def masked_plan(tiles: DataFrame, foregrounds: DataFrame, count: int = 10, tries: int = 10, gap: int = 5, seed: int = 0) -> DataFrame:
    """Where drawn foregrounds go on the masks of tiles, see ``place_on_mask``: (image_id, tile_id, slot, fg_id, x, y, fw, fh, angle), sizes after turning.

    tiles: image_id, tile_id, w, h, data (one band), angles (32-bit floats in radians for each pixel, or null); foregrounds: fg_id (dense
    from 0), fw, fh. Only the sizes of a tile's ``count`` drawn foregrounds travel to it.
    """
    ship(tiles.sparkSession)
    n = foregrounds.count()
    if not n:
        return tiles.sparkSession.createDataFrame([], PLACED)
    slots = tiles.select("image_id", "tile_id").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    drawn = slots.withColumn("fg_id", hashed(F.col("image_id"), F.col("tile_id").cast("long"), F.col("slot").cast("long"), seed=seed) % n).join(foregrounds.select("fg_id", "fw", "fh"), "fg_id")
    asked = drawn.groupBy("image_id", "tile_id").agg(F.array_sort(F.collect_list(F.struct("slot", "fg_id", "fw", "fh"))).alias("fgs"))
    kinds = pa.schema([("image_id", pa.int64()), ("tile_id", pa.int32()), ("slot", pa.int32()), ("fg_id", pa.int64()), *[(c, pa.int32()) for c in ("x", "y", "fw", "fh")], ("angle", pa.float64())])

    def place(batches):
        def each():
            for r in pieces_rows(batches):
                mask = array_of(r["data"], r["h"], r["w"], 1)[..., 0]
                angles = None if r["angles"] is None else np.frombuffer(r["angles"], "<f4").reshape(r["h"], r["w"])
                rng = np.random.default_rng([seed, r["image_id"], r["tile_id"]])
                for slot, *rest in place_on_mask(mask, angles, [(f["fw"], f["fh"]) for f in r["fgs"]], rng, tries, gap):
                    yield (r["image_id"], r["tile_id"], slot, r["fgs"][slot]["fg_id"], *rest)

        yield from pieces_sent(each(), kinds)

    met = tiles.join(asked, ["image_id", "tile_id"])
    return met.select("image_id", F.col("tile_id").cast("int").alias("tile_id"), "w", "h", "data", "angles", "fgs").mapInArrow(place, PLACED)


def moved_boxes(plan: DataFrame, boxes: DataFrame, foregrounds: DataFrame) -> DataFrame:
    """(image_id, tile_id, slot, box_id, label, xmin.. ymax): the foregrounds' own boxes (fg_id, box_id, label, xmin..) at their turned places in the tile."""
    j = plan.join(foregrounds.select("fg_id", F.col("fw").alias("ow"), F.col("fh").alias("oh")), "fg_id").join(boxes, "fg_id")
    c, s = F.cos("angle"), F.sin("angle")
    corner = lambda x, y: (F.col(x) - F.col("ow") / 2, F.col(y) - F.col("oh") / 2)
    corners = [corner(x, y) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    xs = [F.round(u * c + v * s + F.col("fw") / 2, 6) for u, v in corners]
    ys = [F.round(-u * s + v * c + F.col("fh") / 2, 6) for u, v in corners]
    low = lambda v: F.greatest(F.lit(1), F.floor(F.least(*v))).cast("int")
    high = lambda v, size: F.least(F.col(size) - 1, F.ceil(F.greatest(*v))).cast("int")
    return j.select("image_id", "tile_id", "slot", "box_id", "label", (low(xs) + F.col("x")).alias("xmin"), (low(ys) + F.col("y")).alias("ymin"), (high(xs, "fw") + F.col("x")).alias("xmax"), (high(ys, "fh") + F.col("y")).alias("ymax"))


def turned_foregrounds(plan: DataFrame, foregrounds: DataFrame) -> DataFrame:
    """``plan`` with ``data``: each placement's foreground (RGBA), turned by its angle, transparent beyond its edges."""
    j = plan.join(foregrounds.select("fg_id", F.col("fw").alias("ow"), F.col("fh").alias("oh"), "data"), "fg_id")

    @F.pandas_udf("binary")
    def turn(data: pd.Series, ow: pd.Series, oh: pd.Series, w: pd.Series, h: pd.Series, angle: pd.Series) -> pd.Series:
        out = []
        for raw, a, b, tw, th, g in zip(data, ow, oh, w, h, angle):
            src = np.zeros((b + 2, a + 2, 4), np.uint8)
            src[1:-1, 1:-1] = array_of(raw, b, a, 4)
            u, v = np.meshgrid(np.arange(tw) + 0.5 - tw / 2, np.arange(th) + 0.5 - th / 2)
            x = np.clip(np.round(np.cos(g) * u - np.sin(g) * v + a / 2, 6) + 1, 0, a + 1.5)
            y = np.clip(np.round(np.sin(g) * u + np.cos(g) * v + b / 2, 6) + 1, 0, b + 1.5)
            out.append(sampled(src, x, y, "near").tobytes())
        return pd.Series(out)

    return j.withColumn("data", turn("data", "ow", "oh", "fw", "fh", "angle")).drop("ow", "oh")

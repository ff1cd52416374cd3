"""Pixel jobs. Spark moves windows, tiles and block keys; NumPy works on one tile at a time.

Pixels travel as ``blocks``: image_id, block_x, block_y, x0, y0, w, h, bands, data (row-major bytes, bands last).
Groups are tiles or windows, whose size is fixed by the grid, so no group grows with the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skytile.functions.geo import hashed, ring_box, wkt_ring
from skytile.operators.pieces import array_of, clip_area, clip_areas, crop_windows, mosaic, stacked  # noqa: F401
from skytile.operators.tiling import grid

STATS = "lo int, hi int, share0 double, share255 double, nonzero long, zero_pixels long, bright_pixels long, top_share double"


def tile_stats(data: Column, w: Column, h: Column, bands: Column) -> Column:
    """Statistics of a tile: band 0's range and shares, all-band zero and full pixels, share of the commonest value (254 and 255 as one)."""

    @F.pandas_udf(STATS)
    def stats(d: pd.Series, w: pd.Series, h: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for data, ww, hh, bb in zip(d, w, h, b):
            a = array_of(data, int(hh), int(ww), int(bb))
            v, s = a[..., 0].ravel(), a.astype(np.int32).sum(2)
            hist = np.bincount(np.minimum(v, 254), minlength=255)
            out.append((int(v.min()), int(v.max()), float((v == 0).mean()), float((v == 255).mean()), int((v != 0).sum()), int((s == 0).sum()), int((s == 255 * bb).sum()), float(hist.max() / len(v))))
        return pd.DataFrame(out, columns=[x.split()[0] for x in STATS.split(", ")])

    return stats(data, w, h, bands)


def pad_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """Tiles with zeros to the right and below, up to a square of ``size``."""

    def pad(a):
        out = np.zeros((size, size, a.shape[2]), np.uint8)
        out[: a.shape[0], : a.shape[1]] = a
        return out.tobytes()

    return tiles.withColumn("data", _mapped(pad)).withColumn("w", F.lit(size)).withColumn("h", F.lit(size))


def non_empty_tiles(rasters: DataFrame, blocks: DataFrame, block: int, subsize: int, gap: int) -> DataFrame:
    """The tiles of a grid whose first band is not constant, zero-padded to the grid's size, with their place x0, y0."""
    g = grid(rasters, subsize, gap)
    cut = crop_windows(g.withColumnRenamed("tile_id", "win_id"), blocks, block).withColumnRenamed("win_id", "tile_id")
    some = cut.withColumn("s", tile_stats(F.col("data"), F.col("w"), F.col("h"), F.col("bands"))).where("s.hi > s.lo").drop("s")
    return pad_tiles(some, subsize).join(g.select("image_id", F.col("tile_id").cast("long").alias("tile_id"), "x0", "y0"), ["image_id", "tile_id"])


def fill_polygon(mask: np.ndarray, xs: np.ndarray, ys: np.ndarray, value: int) -> None:
    """Even-odd scan-line fill, the outline included; coordinates are relative to the mask."""
    h, w = mask.shape
    top, bottom = max(0, int(np.ceil(ys.min()))), min(h - 1, int(np.floor(ys.max())))
    xs2, ys2 = np.roll(xs, -1), np.roll(ys, -1)
    if top <= bottom:
        y = np.arange(top, bottom + 1)[:, None]
        crosses = (ys <= y) != (ys2 <= y)
        with np.errstate(divide="ignore", invalid="ignore"):
            cuts = np.sort(np.where(crosses, xs + (y - ys) * (xs2 - xs) / (ys2 - ys), np.inf), axis=1)
        cuts = cuts[:, : int(crosses.sum(1).max()) // 2 * 2]
        rows = np.repeat(np.arange(len(y)), cuts.shape[1] // 2)
        starts, ends = cuts[:, ::2].ravel(), cuts[:, 1::2].ravel()
        flat = np.flatnonzero((ys == ys2) & (ys == np.floor(ys)) & (ys >= top) & (ys <= bottom))
        rows = np.concatenate([rows[np.isfinite(ends)], ys[flat].astype(np.int64) - top])
        starts, ends = np.concatenate([starts[np.isfinite(ends)], np.minimum(xs, xs2)[flat]]), np.concatenate([ends[np.isfinite(ends)], np.maximum(xs, xs2)[flat]])
        a = np.clip(np.ceil(starts), 0, w).astype(np.int64)
        b = np.clip(np.floor(ends) + 1, 0, w).astype(np.int64)
        some = a < b
        if some.any():
            lo, hi = int(a[some].min()), int(b[some].max())
            change = np.zeros((len(y), hi - lo + 1), np.int32)
            np.add.at(change, (rows[some], a[some] - lo), 1)
            np.add.at(change, (rows[some], b[some] - lo), -1)
            mask[top : bottom + 1, lo:hi][np.cumsum(change, axis=1)[:, :-1] > 0] = value
    inside = (xs >= 0) & (xs < w) & (ys >= 0) & (ys < h)
    mask[ys[inside].astype(np.int64), xs[inside].astype(np.int64)] = value


def rasterise(polys: DataFrame, tiles: DataFrame, tile: int, background: int = 0) -> DataFrame:
    """(image_id, tile_id, w, h, data): masks of tiles that polygons (image_id, poly_id, label, wkt) touch, higher labels last.

    tiles: image_id, tile_id, col, row, x0, y0, w, h of a grid without overlap whose side is ``tile``.
    """
    p = polys.withColumn("ring", wkt_ring(F.col("wkt")))
    box = ring_box(F.col("ring"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / tile).cast("int"), F.floor(hi / tile).cast("int")))
    p = p.withColumn("col", span(box["xmin"], box["xmax"])).withColumn("row", span(box["ymin"], box["ymax"]))
    p = p.select("image_id", "poly_id", "label", *[F.transform("ring", lambda v: v[c]).alias(c + "s") for c in "xy"], "col", "row")
    met = p.join(tiles.select("image_id", "tile_id", "col", "row", "x0", "y0", "w", "h"), ["image_id", "col", "row"])

    kinds = pa.schema([("image_id", pa.int64()), ("tile_id", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("data", pa.binary())])

    def draw(batches):
        """Tile after tile in their order, a few at a time."""
        done, now, mask = [], None, None
        for batch in batches:
            for image, tile_id, label, _, x0, y0, w, h, xs, ys in zip(*[c.to_pylist() for c in batch.columns]):
                if (image, tile_id) != now:
                    if now is not None:
                        done.append((*now, mask.shape[1], mask.shape[0], mask.tobytes()))
                    now, mask = (image, tile_id), np.full((h, w), background, np.uint8)
                    if len(done) >= 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kinds)], schema=kinds)
                        done = []
                fill_polygon(mask, np.array(xs) - x0, np.array(ys) - y0, label)
        if now is not None:
            done.append((*now, mask.shape[1], mask.shape[0], mask.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kinds)], schema=kinds)

    rows = met.select("image_id", "tile_id", "label", "poly_id", "x0", "y0", "w", "h", "xs", "ys").repartition("image_id", "tile_id")
    return rows.sortWithinPartitions("image_id", "tile_id", "label", "poly_id").mapInArrow(draw, "image_id long, tile_id int, w int, h int, data binary")


def background_windows(windows: DataFrame, boxes: DataFrame, regions: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """Windows (image_id, win_id, x0, y0, w, h) that touch no box and no region polygon, whose first band is not constant and at least half not zero.

    regions: image_id, poly_id, label, wkt; they are drawn into the windows that their extents meet.
    """
    from skytile.operators.spatial import overlap_pairs, windows_without_boxes

    free = windows_without_boxes(windows, boxes)
    p = regions.withColumn("ring", wkt_ring(F.col("wkt")))
    box = ring_box(F.col("ring"))
    extents = p.select("image_id", "poly_id", *[F.transform("ring", lambda v: v[c]).alias(c + "s") for c in "xy"], *[f(box[c]).cast("int").alias(c) for f, c in ((F.floor, "xmin"), (F.floor, "ymin"), (F.ceil, "xmax"), (F.ceil, "ymax"))])
    w = free.select("image_id", "win_id", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + F.col("w") - 1).alias("xmax"), (F.col("y0") + F.col("h") - 1).alias("ymax"))
    met = overlap_pairs(w, extents, cell=1024)

    @F.pandas_udf("boolean")
    def touches(xs: pd.Series, ys: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        out = []
        for x, y, a, b, c, d in zip(xs, ys, x0, y0, x1, y1):
            mask = np.zeros((int(d - b + 1), int(c - a + 1)), np.uint8)
            fill_polygon(mask, np.asarray(x) - a, np.asarray(y) - b, 1)
            out.append(bool(mask.any()))
        return pd.Series(out)

    hit = met.where(touches("b_xs", "b_ys", "a_xmin", "a_ymin", "a_xmax", "a_ymax")).select("image_id", F.col("a_win_id").alias("win_id")).distinct()
    clear = free.join(hit, ["image_id", "win_id"], "left_anti")
    s = crop_windows(clear, blocks, block).withColumn("s", tile_stats(F.col("data"), F.col("w"), F.col("h"), F.col("bands")))
    good = s.where("s.hi > s.lo and s.nonzero >= 0.5 * w * h").select("image_id", "win_id")
    return clear.join(good, ["image_id", "win_id"], "left_semi")


def parent_boxes(tiles: DataFrame, parts: DataFrame, grow: int = 5) -> DataFrame:
    """(image_id, tile_id, box, label 1) about the parts of a tile, grown and clipped, where all are of class 2, none constant and each more than half not zero.

    parts: image_id, tile_id, box_id, xmin.. (tile coordinates, ends excluded), label.
    """
    per = parts.groupBy("image_id", "tile_id").agg(F.every(F.col("label") == 2).alias("all2"), F.collect_list(F.struct("xmin", "ymin", "xmax", "ymax")).alias("parts"))

    @F.pandas_udf("boolean")
    def full(d: pd.Series, w: pd.Series, h: pd.Series, b: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for data, ww, hh, bb, ps in zip(d, w, h, b, own):
            a = array_of(data, int(hh), int(ww), int(bb))[..., 0]
            cuts = [a[max(0, p["ymin"]) : p["ymax"], max(0, p["xmin"]) : p["xmax"]] for p in ps]
            out.append(all(c.size and c.max() > c.min() and (c != 0).mean() > 0.5 for c in cuts))
        return pd.Series(out)

    j = tiles.join(per.where("all2"), ["image_id", "tile_id"]).where(full("data", "w", "h", "bands", "parts"))
    ends = {c: f(F.transform("parts", lambda p: p[c])) for c, f in (("xmin", F.array_min), ("ymin", F.array_min), ("xmax", F.array_max), ("ymax", F.array_max))}
    low = lambda c: F.greatest(F.lit(0), ends[c] - grow).alias(c)
    high = lambda c, size: F.least(F.col(size) - 1, ends[c] + grow).alias(c)
    return j.select("image_id", "tile_id", low("xmin"), low("ymin"), high("xmax", "w"), high("ymax", "h"), F.lit(1).alias("label"))


def fill_boxes(tiles: DataFrame, boxes: DataFrame, value: int) -> DataFrame:
    """Tiles (image_id, tile_id, w, h, bands, data) with their boxes (tile coordinates) set to a value: 0 blanks rejected regions, 1 on empty tiles makes box masks."""
    per = boxes.groupBy("image_id", "tile_id").agg(F.collect_list(F.struct("xmin", "ymin", "xmax", "ymax")).alias("boxes"))

    @F.pandas_udf("binary")
    def fill(d: pd.Series, w: pd.Series, h: pd.Series, b: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for data, ww, hh, bb, rects in zip(d, w, h, b, own):
            if rects is None or not len(rects):
                out.append(data)
                continue
            a = array_of(data, int(hh), int(ww), int(bb)).copy()
            for r in rects:
                a[max(0, int(r["ymin"])) : max(0, int(r["ymax"])), max(0, int(r["xmin"])) : max(0, int(r["xmax"]))] = value
            out.append(a.tobytes())
        return pd.Series(out)

    j = tiles.join(per, ["image_id", "tile_id"], "left")
    return j.withColumn("data", fill("data", "w", "h", "bands", "boxes")).drop("boxes")


def box_masks(tiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """Masks of tiles (image_id, tile_id, w, h): 1 inside their boxes (tile coordinates)."""
    empty = F.repeat(F.lit("00"), F.col("w") * F.col("h"))
    return fill_boxes(tiles.select("image_id", "tile_id", "w", "h").withColumn("bands", F.lit(1)).withColumn("data", F.unhex(empty)), boxes, 1)


def _mapped(f, out="binary"):
    @F.pandas_udf(out)
    def run(d: pd.Series, w: pd.Series, h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(array_of(x, int(hh), int(ww), int(bb))) for x, ww, hh, bb in zip(d, w, h, b)])

    return run("data", "w", "h", "bands")


def rotate_tiles(tiles: DataFrame, degrees: int) -> DataFrame:
    """Tiles turned by a right angle; boxes turn with ``geo.rotate_box``."""
    turned = tiles.withColumn("data", _mapped(lambda a: np.ascontiguousarray(np.rot90(a, degrees // 90)).tobytes()))
    return turned if degrees % 180 == 0 else turned.withColumn("_w", F.col("h")).withColumn("h", F.col("w")).withColumn("w", F.col("_w")).drop("_w")


def _cubic(n: int, factor: int) -> np.ndarray:
    """Weights (n // factor, n) of cubic convolution (coefficient -0.5), widened by the factor; borders are repeated."""
    out = np.zeros((n // factor, n))
    for i in range(n // factor):
        centre = (i + 0.5) * factor - 0.5
        at = np.arange(int(np.floor(centre - 2 * factor)) + 1, int(np.ceil(centre + 2 * factor)))
        t = np.abs((at - centre) / factor)
        k = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))
        np.add.at(out[i], np.clip(at, 0, n - 1), k / k.sum())
    return out


def downscale(tiles: DataFrame, factor: int, how: str = "near") -> DataFrame:
    """Tiles of size // factor, by nearest sample ("near"), area mean ("mean") or cubic convolution ("cubic")."""

    def near(a):
        return a[: a.shape[0] // factor * factor : factor, : a.shape[1] // factor * factor : factor].tobytes()

    def mean(a):
        h, w = a.shape[0] // factor, a.shape[1] // factor
        return np.rint(a[: h * factor, : w * factor].reshape(h, factor, w, factor, -1).mean((1, 3))).astype(np.uint8).tobytes()

    def cubic(a):
        down, across = _cubic(a.shape[0], factor), _cubic(a.shape[1], factor)
        return np.clip(np.rint(np.einsum("ij,jkb,lk->ilb", down, a.astype(float), across)), 0, 255).astype(np.uint8).tobytes()

    d = tiles.withColumn("data", _mapped({"near": near, "mean": mean, "cubic": cubic}[how]))
    return d.withColumn("w", F.floor(F.col("w") / factor).cast("int")).withColumn("h", F.floor(F.col("h") / factor).cast("int"))


def overlay(tiles: DataFrame, masks: DataFrame, palette: list[tuple[int, int, int]], alpha: float = 0.5) -> DataFrame:
    """Tiles blended with their masks' palette colours, truncated."""
    colours = np.array(palette, float)
    j = tiles.join(masks.select("image_id", "tile_id", F.col("data").alias("mask")), ["image_id", "tile_id"])

    @F.pandas_udf("binary")
    def blend(d: pd.Series, m: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([(array_of(x, int(hh), int(ww), 3) * (1 - alpha) + colours[np.frombuffer(y, np.uint8).reshape(int(hh), int(ww))] * alpha).astype(np.uint8).tobytes() for x, y, ww, hh in zip(d, m, w, h)])

    return j.withColumn("data", blend("data", "mask", "w", "h")).drop("mask")


def apply_tables(tiles: DataFrame, tables: DataFrame) -> DataFrame:
    """Band values looked up in a table of 256 entries per image (image_id, lut array<int>), as histogram matching gives."""
    j = tiles.join(tables, "image_id")

    @F.pandas_udf("binary")
    def look(d: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(lut, np.uint8)[np.frombuffer(x, np.uint8)].tobytes() for x, lut in zip(d, t)])

    return j.withColumn("data", look("data", "lut")).drop("lut")


def rotated_windows(pairs: DataFrame, degrees: Column, least: float = 0.5) -> DataFrame:
    """Boxes in turned windows. pairs: box xmin.. and window x0, y0, w, h; kept if the window's quad covers more than ``least`` of the box.

    The result's box is the extent of the box's corners in the turned frame, clipped to the window.
    """
    p = pairs.withColumn("deg", degrees.cast("double"))

    @F.pandas_udf("keep boolean, rxmin double, rymin double, rxmax double, rymax double")
    def turn(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, deg: pd.Series) -> pd.DataFrame:
        lo, hi, centre, half = np.stack([a, b], 1), np.stack([c, d], 1), np.stack([x + w / 2, y + h / 2], 1), np.stack([w, h], 1) / 2
        t = np.deg2rad(deg.to_numpy())
        m = np.stack([np.stack([np.cos(t), -np.sin(t)], 1), np.stack([np.sin(t), np.cos(t)], 1)], 1)
        corners = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]])
        quads = (corners * half[:, None]) @ m.transpose(0, 2, 1) + centre[:, None]
        size = (hi - lo).prod(1)
        share = np.where(size > 0, clip_areas(quads, np.concatenate([lo, hi], 1)) / np.maximum(size, 1), 0.0)
        own = np.where(corners[None] < 0, lo[:, None], hi[:, None])
        q = (own - centre[:, None]) @ m + half[:, None]
        first, last = (np.clip(v, 0, 2 * half - 1) for v in (q.min(1), q.max(1)))
        return pd.DataFrame({"keep": share > least, "rxmin": first[:, 0], "rymin": first[:, 1], "rxmax": last[:, 0], "rymax": last[:, 1]})

    return p.withColumn("t", turn("xmin", "ymin", "xmax", "ymax", "x0", "y0", "w", "h", "deg")).where("t.keep").select(*pairs.columns, "t.rxmin", "t.rymin", "t.rxmax", "t.rymax")


def paste_plan(backgrounds: DataFrame, foregrounds: DataFrame, most: int = 4, tries: int = 10, touch: int = 10, seed: int = 0) -> DataFrame:
    """Where 1 to ``most`` foregrounds go on each background (bg_id, w, h): up to ``tries`` hashed places each, accepted without overlap.

    foregrounds (fg_id, fw, fh) have dense fg_id from 0; each background draws its ids, which are joined back, so only sizes travel.
    """
    n = foregrounds.count()
    if not n:
        return backgrounds.sparkSession.createDataFrame([], "bg_id long, slot int, fg_id long, x int, y int, fw int, fh int")
    b = backgrounds.withColumn("k", 1 + hashed(F.col("bg_id"), seed=seed) % most).withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k")))).withColumn("fg_id", hashed(F.col("bg_id"), F.col("slot"), seed=seed + 1) % n)
    drawn = b.join(foregrounds.select("fg_id", "fw", "fh"), "fg_id")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = [], []
        for r in pdf.sort_values("slot").itertuples():
            rng = np.random.default_rng([seed, int(r.bg_id), int(r.slot)])
            if r.fw >= r.w or r.fh >= r.h:
                continue
            for _ in range(tries):
                x, y = int(rng.integers(0, r.w - r.fw)), int(rng.integers(0, r.h - r.fh))
                if all(min(x + r.fw, a + c) - max(x, a) < touch or min(y + r.fh, e + g) - max(y, e) < touch for a, e, c, g in taken):
                    taken.append((x, y, r.fw, r.fh))
                    out.append((r.bg_id, r.slot, r.fg_id, x, y, r.fw, r.fh))
                    break
        return pd.DataFrame(out, columns=["bg_id", "slot", "fg_id", "x", "y", "fw", "fh"])

    return drawn.groupBy("bg_id").applyInPandas(place, "bg_id long, slot int, fg_id long, x int, y int, fw int, fh int")


def composed(backgrounds: DataFrame, foregrounds: DataFrame, plan: DataFrame) -> DataFrame:
    """Backgrounds (bg_id, w, h, data RGB) with the planned foregrounds (fg_id, RGBA data) blended in by their alpha."""
    pieces = plan.join(foregrounds.select("fg_id", F.col("data").alias("fg")), "fg_id")
    per = pieces.groupBy("bg_id").agg(F.array_sort(F.collect_list(F.struct("slot", "x", "y", "fw", "fh", "fg"))).alias("pieces"))

    @F.pandas_udf("binary")
    def blend(d: pd.Series, w: pd.Series, h: pd.Series, ps: pd.Series) -> pd.Series:
        out = []
        for data, ww, hh, own in zip(d, w, h, ps):
            a = array_of(data, int(hh), int(ww), 3).astype(float)
            for p in own if own is not None else []:
                f = array_of(p["fg"], p["fh"], p["fw"], 4).astype(float)
                k = f[..., 3:] / 255
                s = (slice(p["y"], p["y"] + p["fh"]), slice(p["x"], p["x"] + p["fw"]))
                a[s] = a[s] * (1 - k) + f[..., :3] * k
            out.append(a.astype(np.uint8).tobytes())
        return pd.Series(out)

    return backgrounds.join(per, "bg_id", "left").withColumn("data", blend("data", "w", "h", "pieces")).drop("pieces")


def draw_lines(tiles: DataFrame, lines: DataFrame, colour: int = 200, thickness: int = 2, least: int = 30) -> DataFrame:
    """Tiles and their line masks with the segments of ``lines`` (image_id, tile_id, x1, y1, x2, y2) drawn; segments under ``least`` pixels are skipped."""
    long = lines.where((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2 >= least**2)
    per = long.groupBy("image_id", "tile_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("lines"))

    @F.pandas_udf("data binary, mask binary, drawn long")
    def draw(d: pd.Series, w: pd.Series, h: pd.Series, b: pd.Series, ls: pd.Series) -> pd.DataFrame:
        out = []
        for data, ww, hh, bb, own in zip(d, w, h, b, ls):
            a = array_of(data, int(hh), int(ww), int(bb)).copy()
            mask = np.zeros((int(hh), int(ww)), np.uint8)
            for s in own if own is not None else []:
                dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
                # Only pixels about the segment.
                x0, x1 = (int(np.clip(f(s["x1"], s["x2"]) + d, 0, ww)) for f, d in ((min, -thickness), (max, thickness + 1)))
                y0, y1 = (int(np.clip(f(s["y1"], s["y2"]) + d, 0, hh)) for f, d in ((min, -thickness), (max, thickness + 1)))
                yy, xx = np.mgrid[y0:y1, x0:x1]
                t = np.clip(((xx - s["x1"]) * dx + (yy - s["y1"]) * dy) / (dx * dx + dy * dy), 0, 1)
                mask[y0:y1, x0:x1][(xx - s["x1"] - t * dx) ** 2 + (yy - s["y1"] - t * dy) ** 2 <= (thickness / 2) ** 2] = 1
            a[mask == 1] = colour
            out.append((a.tobytes(), mask.tobytes(), int(mask.sum())))
        return pd.DataFrame(out, columns=["data", "mask", "drawn"])

    j = tiles.join(per, ["image_id", "tile_id"], "left").withColumn("r", draw("data", "w", "h", "bands", "lines"))
    return j.select(*[c for c in tiles.columns if c != "data"], "r.data", "r.mask", "r.drawn")


def random_lines(tiles: DataFrame, seed: int = 0, gap: int = 12) -> DataFrame:
    """2 to 4 lines across each tile by hashed places, each with a parallel neighbour on both sides: (image_id, tile_id, line, x1, y1, x2, y2)."""
    h = lambda k, n: hashed(F.col("image_id"), F.col("tile_id"), F.col("line"), seed=seed + k) % n
    n = 2 + hashed(F.col("image_id"), F.col("tile_id"), seed=seed) % 3
    t = tiles.select("image_id", "tile_id", "w", "h").withColumn("line", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    t = t.withColumn("y1", h(1, F.col("h"))).withColumn("y2", h(2, F.col("h"))).withColumn("side", F.explode(F.array(*[F.lit(k) for k in (-gap, 0, gap)])))
    return t.select("image_id", "tile_id", "line", F.lit(0).alias("x1"), (F.col("y1") + F.col("side")).cast("int").alias("y1"), (F.col("w") - 1).alias("x2"), (F.col("y2") + F.col("side")).cast("int").alias("y2"))


def with_lines(tiles: DataFrame, lines: DataFrame, colour: int = 200, thickness: int = 2) -> DataFrame:
    """Tiles with lines and their masks; those of which less than half a side is drawn are left out."""
    return draw_lines(tiles, lines, colour, thickness).where(F.col("drawn") >= F.col("w") / 2)


def with_alpha(images: DataFrame, masks: DataFrame) -> DataFrame:
    """RGBA foregrounds from images and masks paired by prefix."""
    j = images.join(masks.select("prefix", F.col("data").alias("alpha")), "prefix")

    @F.pandas_udf("binary")
    def join(d: pd.Series, m: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([np.dstack([array_of(x, int(hh), int(ww), 3), array_of(y, int(hh), int(ww), 1)]).tobytes() for x, y, ww, hh in zip(d, m, w, h)])

    return j.withColumn("data", join("data", "alpha", "w", "h")).withColumn("bands", F.lit(4)).drop("alpha")


def labelled_colours(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Distinct values of labelled pixels per scene, from pixel rows and mask rows that share image_id, x, y."""
    return pixels.join(masks.where("gt_label > 0").select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi").select("image_id", "val").distinct()


def palette(pixels: DataFrame, k: int = 20, seed: int = 7, channels: list[str] = ["val"]) -> DataFrame:
    """(cluster, centre array) of the pixels' k-means clusters that have a channel below 240; runs on counted colours, not on pixels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    counts = pixels.groupBy(*channels).agg(F.count("*").cast("double").alias("n"))
    data = VectorAssembler(inputCols=channels, outputCol="features").transform(counts.select(*[F.col(c).cast("double").alias(c) for c in channels], "n"))
    model = KMeans(k=k, seed=seed, weightCol="n").fit(data)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]  # k rows
    return pixels.sparkSession.createDataFrame(centres, "cluster int, centre array<double>").where(F.exists("centre", lambda x: x < 240))


def recoloured(pixels: DataFrame, centres: DataFrame, colours: list[list[int]], channels: list[str] = ["val"]) -> DataFrame:
    """``pixels`` with ``cluster``, the nearest centre (ties: the first), and ``colour``, that of the cluster in turn."""
    every = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("_centres")).withColumn("_k", F.lit(1)))  # a row of k centres
    far = lambda c: F.aggregate(F.zip_with(F.array(*[F.col(x).cast("double") for x in channels]), c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("_centres", lambda c: F.struct(far(c).alias("d"), c["cluster"].alias("cluster"))))
    table = F.array(*[F.array(*[F.lit(v) for v in c]) for c in colours])
    out = pixels.withColumn("_k", F.lit(1)).join(every, "_k").withColumn("cluster", best["cluster"]).drop("_centres", "_k")
    return out.withColumn("colour", F.get(table, F.col("cluster") % len(colours)))

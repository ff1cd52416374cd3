"""Pixels that move between tilings: windows over blocks, mosaics, pyramids and turned windows.

What is shuffled are the pieces that a target needs, cut where their source lies, never a whole source. Pixels travel
as in ``raster``: row-major bytes, bands last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skytile.operators.sequence import cdf, match_tables
from skytile.session import dealt, stored

#: Bytes of pieces that a task holds before it hands them on.
HELD_BYTES = 32 << 20
#: Windows that meet a block in one row.
WINDOWS = 1024


def array_of(data: bytes, h: int, w: int, bands: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, bands)


def rows_of(batches):
    """Rows of Arrow batches as dictionaries, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def sent(rows, schema: pa.Schema, limit: int = HELD_BYTES):
    """Rows (tuples) as Arrow batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes)) + 64
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


# ---- windows ------------------------------------------------------------------------------------------------


def window_pieces(windows: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """(image_id, win_id, ww, wh, px, py, pw, ph, bands, data): what each square block holds of each window, and its place there.

    A block is read once with the list of its windows, up to ``WINDOWS`` in a row, so that no block is copied for each window.
    """
    span = lambda lo, size: F.explode(F.sequence(F.floor(F.col(lo) / block).cast("int"), F.floor((F.col(lo) + F.col(size) - 1) / block).cast("int")))
    keyed = windows.where("w > 0 and h > 0").select("image_id", F.col("win_id").cast("long").alias("win_id"), *[F.col(c).cast("int").alias(n) for c, n in (("x0", "wx"), ("y0", "wy"), ("w", "ww"), ("h", "wh"))])
    keyed = keyed.withColumn("block_x", span("wx", "ww")).withColumn("block_y", span("wy", "wh"))
    key = ["image_id", "block_x", "block_y"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("win_id", "wx", "wy"))
    lists = keyed.withColumn("part", F.floor((place - 1) / WINDOWS)).groupBy(*key, "part").agg(F.collect_list(F.struct("win_id", "wx", "wy", "ww", "wh")).alias("wins"))
    kinds = pa.schema([("image_id", pa.int64()), ("win_id", pa.int64()), *[(c, pa.int32()) for c in ("ww", "wh", "px", "py", "pw", "ph", "bands")], ("data", pa.binary())])

    def cut(batches):
        def each():
            for r in rows_of(batches):
                a = array_of(r["data"], r["h"], r["w"], r["bands"])
                for v in r["wins"]:
                    x0, y0 = max(r["x0"], v["wx"]), max(r["y0"], v["wy"])
                    x1, y1 = min(r["x0"] + r["w"], v["wx"] + v["ww"]), min(r["y0"] + r["h"], v["wy"] + v["wh"])
                    if x0 < x1 and y0 < y1:
                        part = a[y0 - r["y0"] : y1 - r["y0"], x0 - r["x0"] : x1 - r["x0"]]
                        yield r["image_id"], v["win_id"], v["ww"], v["wh"], x0 - v["wx"], y0 - v["wy"], x1 - x0, y1 - y0, r["bands"], part.tobytes()

        yield from sent(each(), kinds)

    met = lists.join(blocks, key).select("image_id", "x0", "y0", "w", "h", "bands", "data", "wins")
    return met.mapInArrow(cut, "image_id long, win_id long, ww int, wh int, px int, py int, pw int, ph int, bands int, data binary")


def crop_windows(windows: DataFrame, blocks: DataFrame, block: int, pad_to: int | None = None, swap: bool = False) -> DataFrame:
    """(image_id, win_id, w, h, bands, data) of windows (image_id, win_id, x0, y0, w, h) cut from square blocks.

    Blocks meet the windows that they hold a part of, and only these parts are shuffled and pasted. Pixels that no
    block holds are zero; windows that no block touches are left out.
    """

    def paste(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        out = np.zeros((pad_to or int(r.wh), pad_to or int(r.ww), int(r.bands)), np.uint8)
        for p in pdf.itertuples():
            out[p.py : p.py + p.ph, p.px : p.px + p.pw] = array_of(p.data, p.ph, p.pw, p.bands)
        if swap:
            out = out[..., ::-1]
        return pd.DataFrame({"image_id": [r.image_id], "win_id": [r.win_id], "w": [out.shape[1]], "h": [out.shape[0]], "bands": [out.shape[2]], "data": [out.tobytes()]})

    return window_pieces(windows, blocks, block).groupBy("image_id", "win_id").applyInPandas(paste, "image_id long, win_id long, w int, h int, bands int, data binary")


# ---- mosaics --------------------------------------------------------------------------------------------------


class Canvas:
    """A rectangle of pixels with the order of the source that each value came from.

    Of the values put at a place the one of the greatest order stays, of equal orders the greatest value; values that are ``nodata`` never
    do. So putting is associative and commutative: pieces may be merged in any grouping.
    """

    NONE = np.iinfo(np.int64).min

    def __init__(self, h: int, w: int, bands: int, nodata: int | None):
        self.data, self.order, self.nodata = np.full((h, w, bands), nodata or 0, np.uint8), np.full((h, w, bands), self.NONE), nodata

    def put(self, x: int, y: int, data: np.ndarray, order: np.ndarray | int) -> None:
        at = (slice(y, y + data.shape[0]), slice(x, x + data.shape[1]))
        own, held = self.data[at], self.order[at]
        wins = (order > held) | ((order == held) & (held != self.NONE) & (data > own))
        if self.nodata is not None:
            wins &= data != self.nodata
        own[wins] = data[wins]
        held[wins] = np.broadcast_to(order, data.shape)[wins]


def merged_piece(parts: list[tuple], nodata: int | None) -> list[tuple]:
    """Pieces (x, y, data, orders, which) of one tile as one, where that is smaller; ``which`` tells each value's order, from 1, or is None."""
    bands = parts[0][2].shape[2]
    x0, y0 = min(p[0] for p in parts), min(p[1] for p in parts)
    x1, y1 = max(p[0] + p[2].shape[1] for p in parts), max(p[1] + p[2].shape[0] for p in parts)
    orders = sorted({o for p in parts for o in p[3]})
    if len(parts) < 2 or len(orders) > 255 or 2 * (x1 - x0) * (y1 - y0) * bands >= sum(p[2].size * (1 if p[4] is None else 2) for p in parts):
        return parts
    canvas = Canvas(y1 - y0, x1 - x0, bands, nodata)
    for x, y, data, own, which in parts:
        canvas.put(x - x0, y - y0, data, _orders(own, which))
    which = np.searchsorted(orders, canvas.order).astype(np.uint8) + 1
    which[canvas.order == Canvas.NONE] = 0
    return [(x0, y0, canvas.data, orders, which)]


def _orders(orders: list[int], which: np.ndarray | None) -> np.ndarray | int:
    return orders[0] if which is None else np.array([Canvas.NONE, *orders])[which]


def mosaic_pieces(sources: DataFrame, size: int, nodata: int | None = None, by: list[str] = [], held_bytes: int = HELD_BYTES) -> DataFrame:
    """(by, tx, ty, x, y, w, h, bands, orders, data, which): sources cut at square target tiles; overlapping parts of a task are merged."""
    fields = [(c, sources.schema[c].dataType.simpleString()) for c in by]
    spark_kinds = ", ".join([*(f"`{c}` {t}" for c, t in fields), "tx int, ty int, x int, y int, w int, h int, bands int, orders array<long>, data binary, which binary"])

    def cut(batches):
        kinds = None
        held: dict[tuple, list] = {}
        count = 0

        def all_held():
            for key, parts in held.items():
                for x, y, data, orders, which in merged_piece(parts, nodata):
                    yield (*key, x, y, data.shape[1], data.shape[0], data.shape[2], orders, data.tobytes(), None if which is None else which.tobytes())

        for batch in batches:
            if kinds is None:
                own = [batch.schema.field(c) for c in by]
                kinds = pa.schema([*own, *[(c, pa.int32()) for c in ("tx", "ty", "x", "y", "w", "h", "bands")], ("orders", pa.list_(pa.int64())), ("data", pa.binary()), ("which", pa.binary())])
            for r in rows_of([batch]):
                a = array_of(r["data"], r["h"], r["w"], r["bands"])
                for ty in range(r["y0"] // size, (r["y0"] + r["h"] - 1) // size + 1):
                    for tx in range(r["x0"] // size, (r["x0"] + r["w"] - 1) // size + 1):
                        x0, y0 = max(r["x0"], tx * size), max(r["y0"], ty * size)
                        x1, y1 = min(r["x0"] + r["w"], (tx + 1) * size), min(r["y0"] + r["h"], (ty + 1) * size)
                        part = a[y0 - r["y0"] : y1 - r["y0"], x0 - r["x0"] : x1 - r["x0"]]
                        held.setdefault((*(r[c] for c in by), tx, ty), []).append((x0 - tx * size, y0 - ty * size, part, [r["order"]], None))
                count += a.size
                if count >= held_bytes:
                    yield from sent(all_held(), kinds)
                    held, count = {}, 0
        if held:
            yield from sent(all_held(), kinds)

    own = sources.select(*by, F.col("order").cast("long").alias("order"), *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "w", "h", "bands")], "data").where("w > 0 and h > 0")
    return own.mapInArrow(cut, spark_kinds)


def mosaic(sources: DataFrame, size: int, nodata: int | None = None, by: list[str] = [], held_bytes: int = HELD_BYTES) -> DataFrame:
    """Square target tiles from placed sources (by, order, x0, y0, w, h, bands, data): the later source wins but for nodata values.

    Sources of one order that overlap leave the greater value. Tiles are filled from a sorted stream of pieces, so a task holds one tile.
    """
    pieces = mosaic_pieces(sources, size, nodata, by, held_bytes)
    key = [*by, "tx", "ty"]
    kinds = ", ".join([*(f"`{c}` {sources.schema[c].dataType.simpleString()}" for c in by), "tx int, ty int, w int, h int, bands int, data binary"])

    def fill(batches):
        schema = None

        def tiles():
            nonlocal schema
            now, canvas = None, None
            for batch in batches:
                if schema is None:
                    schema = pa.schema([*[batch.schema.field(c) for c in key], ("w", pa.int32()), ("h", pa.int32()), ("bands", pa.int32()), ("data", pa.binary())])
                for r in rows_of([batch]):
                    own = tuple(r[c] for c in key)
                    if own != now:
                        if canvas is not None:
                            yield (*now, size, size, canvas.data.shape[2], canvas.data.tobytes())
                        now, canvas = own, Canvas(size, size, r["bands"], nodata)
                    which = None if r["which"] is None else array_of(r["which"], r["h"], r["w"], r["bands"])
                    canvas.put(r["x"], r["y"], array_of(r["data"], r["h"], r["w"], r["bands"]), _orders(r["orders"], which))
            if canvas is not None:
                yield (*now, size, size, canvas.data.shape[2], canvas.data.tobytes())

        rows = tiles()
        for first in rows:  # the schema is known with the first row
            yield from sent((r for part in ([first], rows) for r in part), schema)

    return dealt(pieces, *key).sortWithinPartitions(*key).mapInArrow(fill, kinds)


def stacked(sources: DataFrame, size: int) -> DataFrame:
    """(tx, ty, band, w, h, bands, data): square target tiles for each source layer, the bands numbered from 0 by their order; sources have one band."""
    layers = sources.select(F.col("order").cast("long").alias("order")).distinct()
    band = F.row_number().over(Window.orderBy("order")) - 1  # a row for each layer
    return mosaic(sources.join(layers.withColumn("band", band), "order"), size, by=["band"])


# ---- pyramids -------------------------------------------------------------------------------------------------


def morton(x: Column, y: Column, bits: int = 24) -> Column:
    """The bits of two non-negative integers in turn, so that a quarter of a square, and its quarters, share the leading ones."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for c, k in ((x, 2 * i), (y, 2 * i + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def halved(a: np.ndarray, how: str) -> np.ndarray:
    """Half as many pixels a side, rounded down: means of four (half to even), or of each four the one below and to the right."""
    h, w = a.shape[0] // 2, a.shape[1] // 2
    four = a[: 2 * h, : 2 * w].reshape(h, 2, w, 2, a.shape[2])
    return np.rint(four.mean((1, 3))).astype(np.uint8) if how == "mean" else np.ascontiguousarray(four[:, 1, :, 1])


def pyramid_pixels(tiles: DataFrame, levels: int, size: int, how: str = "near") -> DataFrame:
    """(level, image_id, tx, ty, w, h, bands, data) of level 0 and ``levels`` more, each made from the one below.

    tiles: image_id, tx, ty, w, h, bands, data of a grid of ``size`` (even) without overlap. Each tile is halved where it lies; up to four
    of them, the children of a quadtree cell, meet and are pasted, so a level moves a quarter of the one below.
    """
    if size % 2:
        raise ValueError("tiles of an odd size do not halve into a grid")
    keep = ["image_id", "key", "w", "h", "bands", "data"]
    kinds = pa.schema([("image_id", pa.int64()), ("key", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("bands", pa.int32()), ("data", pa.binary())])
    spark_kinds = "image_id long, key long, w int, h int, bands int, data binary"

    def halve(batches):
        def each():
            for r in rows_of(batches):
                a = halved(array_of(r["data"], r["h"], r["w"], r["bands"]), how)
                if a.size:
                    yield r["image_id"], r["key"], a.shape[1], a.shape[0], r["bands"], a.tobytes()

        yield from sent(each(), kinds)

    def paste(pdf: pd.DataFrame) -> pd.DataFrame:
        place = [((k & 1) * (size // 2), (k >> 1 & 1) * (size // 2)) for k in pdf["key"].tolist()]
        w, h = max(x + n for (x, _), n in zip(place, pdf["w"])), max(y + n for (_, y), n in zip(place, pdf["h"]))
        out = np.zeros((h, w, int(pdf["bands"].iloc[0])), np.uint8)
        for (x, y), r in zip(place, pdf.itertuples()):
            out[y : y + r.h, x : x + r.w] = array_of(r.data, r.h, r.w, r.bands)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "key": [pdf["key"].iloc[0] >> 2], "w": [w], "h": [h], "bands": [out.shape[2]], "data": [out.tobytes()]})

    def even(axis: int) -> Column:
        return sum((F.shiftleft(F.shiftright("key", 2 * i + axis).bitwiseAND(F.lit(1).cast("long")), i) for i in range(24)), F.lit(0).cast("long")).cast("int")

    level = stored(tiles.select("image_id", morton(F.col("tx"), F.col("ty")).alias("key"), *keep[2:]), "level")
    out = None
    for k in range(levels + 1):
        if k:
            level = stored(level.mapInArrow(halve, spark_kinds).groupBy("image_id", F.shiftright("key", 2)).applyInPandas(lambda _, pdf: paste(pdf), spark_kinds), "level")
        part = level.select(F.lit(k).alias("level"), "image_id", even(0).alias("tx"), even(1).alias("ty"), *keep[2:])
        out = part if out is None else out.unionByName(part)
    return out


# ---- turned windows ---------------------------------------------------------------------------------------------


def turned_pixels(windows: DataFrame, blocks: DataFrame, block: int, how: str = "near") -> DataFrame:
    """(image_id, win_id, w, h, bands, data): windows (image_id, win_id, x0, y0, w, h, degrees) turned about their centres.

    A pixel shows what the scene has at its centre's place in the turned frame, the frame of ``raster.rotated_windows``: the nearest pixel or the
    bilinear mean (rounded half up) of four; places outside the scene's blocks are zero. The boxes about the turned windows are cut from the blocks first.
    """
    t = F.radians(F.col("degrees").cast("double"))
    cx, cy = F.col("x0") + F.col("w") / 2, F.col("y0") + F.col("h") / 2
    rx = (F.abs(F.cos(t)) * F.col("w") + F.abs(F.sin(t)) * F.col("h")) / 2
    ry = (F.abs(F.sin(t)) * F.col("w") + F.abs(F.cos(t)) * F.col("h")) / 2
    lo = lambda c, r: (F.floor(c - r) - 1).cast("int")
    hi = lambda c, r: (F.ceil(c + r) + 1).cast("int")
    about = windows.select("image_id", F.col("win_id").cast("long").alias("win_id"), lo(cx, rx).alias("ax"), lo(cy, ry).alias("ay"), hi(cx, rx).alias("bx"), hi(cy, ry).alias("by"), *[F.col(c).alias("t" + c) for c in ("x0", "y0", "w", "h")], F.col("degrees").cast("double").alias("degrees"))
    boxes = about.select("image_id", "win_id", F.col("ax").alias("x0"), F.col("ay").alias("y0"), (F.col("bx") - F.col("ax")).alias("w"), (F.col("by") - F.col("ay")).alias("h"))
    cut = crop_windows(boxes, blocks, block).join(about, ["image_id", "win_id"])
    kinds = pa.schema([("image_id", pa.int64()), ("win_id", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("bands", pa.int32()), ("data", pa.binary())])

    def turn(batches):
        def each():
            for r in rows_of(batches):
                a = array_of(r["data"], r["h"], r["w"], r["bands"])
                w, h, g = r["tw"], r["th"], np.deg2rad(r["degrees"])
                u, v = np.meshgrid(np.arange(w) + 0.5 - w / 2, np.arange(h) + 0.5 - h / 2)
                # Rounding drops the noise of sines, so that right angles hit pixel centres.
                x = np.round(r["tx0"] + w / 2 + np.cos(g) * u - np.sin(g) * v, 9) - r["ax"]
                y = np.round(r["ty0"] + h / 2 + np.sin(g) * u + np.cos(g) * v, 9) - r["ay"]
                out = sampled(a, x, y, how)
                yield r["image_id"], r["win_id"], w, h, r["bands"], out.tobytes()

        yield from sent(each(), kinds)

    return cut.mapInArrow(turn, "image_id long, win_id long, w int, h int, bands int, data binary")


def sampled(a: np.ndarray, x: np.ndarray, y: np.ndarray, how: str) -> np.ndarray:
    """Values at places (x, y), where pixel i reaches from i to i + 1; places lie inside by a pixel."""
    if how == "near":
        return a[np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)]
    x, y = x - 0.5, y - 0.5
    i, j = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = (x - i)[..., None], (y - j)[..., None]
    top = a[j, i] * (1 - fx) + a[j, i + 1] * fx
    low = a[j + 1, i] * (1 - fx) + a[j + 1, i + 1] * fx
    return np.floor(np.round(top * (1 - fy) + low * fy, 6) + 0.5).astype(np.uint8)


def clip_areas(quads: np.ndarray, rects: np.ndarray) -> np.ndarray:
    """Areas of convex polygons (n, corners, 2) inside rectangles (n, 4: xmin, ymin, xmax, ymax), all clipped at once.

    Each side adds at most one corner; a polygon with fewer repeats its last one, which adds no area.
    """
    n, p = len(quads), np.asarray(quads, np.float64)
    rects = np.asarray(rects, np.float64)
    alive = np.ones(n, bool)
    for axis, side, sign in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        before, bound = np.roll(p, 1, axis=1), rects[:, side, None]
        inside, was = sign * (p[..., axis] - bound) >= 0, sign * (before[..., axis] - bound) >= 0
        gap = np.where(p[..., axis] == before[..., axis], 1.0, p[..., axis] - before[..., axis])
        crossing = before + ((bound - before[..., axis]) / gap)[..., None] * (p - before)
        corners = np.stack([crossing, p], axis=2).reshape(n, -1, 2)
        kept = np.stack([inside != was, inside], axis=2).reshape(n, -1)
        count = kept.sum(1)
        alive &= count > 0
        width = max(int(count.max(initial=0)), 1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, :width]  # kept corners first, in their order
        at = np.minimum(np.arange(width)[None], np.maximum(count - 1, 0)[:, None])
        p = np.take_along_axis(corners, np.take_along_axis(order, at, 1)[..., None], 1)
    q = np.roll(p, -1, axis=1)
    return np.where(alive, np.abs((p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]).sum(1)) / 2, 0.0)


def clip_area(quad: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """Area of a convex polygon inside a rectangle."""
    return float(clip_areas(np.asarray(quad)[None], np.array([[x0, y0, x1, y1]]))[0])


# ---- histogram matching -----------------------------------------------------------------------------------------


def tile_histograms(tiles: DataFrame) -> DataFrame:
    """(image_id, band, val, n): how often each band of an image's tiles has each value; a task adds up its tiles first."""
    kinds = pa.schema([("image_id", pa.int64()), ("band", pa.int32()), ("val", pa.int32()), ("n", pa.int64())])

    def count(batches):
        def each():
            now, held = None, None
            for r in rows_of(batches):
                if (r["image_id"], r["bands"]) != now:
                    yield from counts_of(now, held)
                    now, held = (r["image_id"], r["bands"]), np.zeros((r["bands"], 256), np.int64)
                a = array_of(r["data"], r["h"], r["w"], r["bands"])
                for b in range(r["bands"]):
                    held[b] += np.bincount(a[..., b].ravel(), minlength=256)
            yield from counts_of(now, held)

        def counts_of(now, held):
            if held is not None:
                yield from ((now[0], int(b), int(v), int(held[b, v])) for b, v in zip(*np.nonzero(held)))

        yield from sent(each(), kinds)

    counted = tiles.select("image_id", "w", "h", "bands", "data").mapInArrow(count, "image_id long, band int, val int, n long")
    return counted.groupBy("image_id", "band", "val").agg(F.sum("n").alias("n"))


def matched_tiles(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, tile's columns): the tiles of each pair's source with every band's histogram matched to the reference's. pairs: pair_id, src, ref.

    Histograms become tables once; the pixels meet only their tables.
    """
    tables = match_tables(cdf(tile_histograms(tiles), ["image_id", "band"]), pairs, ["band"])
    luts = tables.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("band", "lut"))).alias("l")).select("pair_id", F.col("l.lut").alias("luts"))
    asked = pairs.select("pair_id", F.col("src").alias("image_id")).join(luts, "pair_id").join(tiles, "image_id")

    @F.pandas_udf("binary")
    def look(data: pd.Series, luts: pd.Series, bands: pd.Series) -> pd.Series:
        out = []
        for raw, lut, b in zip(data, luts, bands):
            table = np.stack([np.asarray(v) for v in lut]).astype(np.uint8)
            out.append(table[np.arange(int(b)), np.frombuffer(raw, np.uint8).reshape(-1, int(b))].tobytes())
        return pd.Series(out)

    return asked.withColumn("data", look("data", "luts", "bands")).select("pair_id", *tiles.columns)

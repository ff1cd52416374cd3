"""Queries of pixel jobs on tiles made from the pixel table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skytile.functions import geo
from skytile.operators import raster, sampling, scene, spatial, tiling
from skytile.plans.queries import CLIP, FLAG, H, WIN, WIN_SPARK, QUERIES, Tables, _blocks, _bytes, _lines, _r, _tiles, query
from skytile.plans.source_queries import sql_for
from skytile.session import ship

sql_for("d5_best_f1", FLAG + """, s as (select label, score, max(ctp)/(max(n_gt)+1e-16) r, max(ctp)::double/max(cn) p from cv group by 1, 2), g as (select label, i, 1 - i/999.0::double conf from (select distinct label from cv), range(0,1000) t(i)), sp as (select g.label, g.i, g.conf, coalesce(s.r, 0.0) r, coalesce(s.p, 1.0) p from g asof left join s on s.label = g.label and s.score >= g.conf), f1 as (select *, 2*p*r/(p+r+1e-16) f1 from sp), b as (select i from (select i, avg(f1) m from f1 group by 1) q order by m desc, i limit 1) select label, conf, p as "precision", r as recall, f1 from f1 where i = (select i from b)""")


def _total(col: str = "data") -> Column:
    @F.pandas_udf("long")
    def total(d: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(x, np.uint8).sum()) for x in d], dtype="int64")

    return total(col)


def _rgb(tiles: DataFrame) -> DataFrame:
    """Three bands: the value, half of it, and 255 less it."""

    @F.pandas_udf("binary")
    def three(d: pd.Series) -> pd.Series:
        return pd.Series([np.column_stack([a := np.frombuffer(x, np.uint8), a // 2, 255 - a]).tobytes() for x in d])

    return tiles.withColumn("data", three("data")).withColumn("bands", F.lit(3))


def _masks(t: Tables) -> DataFrame:
    """Tiles whose values are the pixels' labels, val % 5."""
    return raster._mapped(lambda a: (a % 5).tobytes())


@query("i2_non_empty_tiles", "with g as (select image_id, c.i col, r.i as row, h from (select image_id, max(y)+1 h from {pixels} group by 1) z, range(0,10) c(i), range(0,400) r(i) where c.i <= ceil((64-24)/16.0) and r.i <= greatest(0, ceil((h-24)/16.0))), p as (select g.image_id, cast(g.col*(1+greatest(0, ceil((h-24)/16.0)))+g.row as int) tile_id, min(val) lo, max(val) hi, sum(val) total from g join {pixels} x on x.image_id=g.image_id and x.x between g.col*16 and g.col*16+23 and x.y between g.row*16 and g.row*16+23 group by 1, 2) select image_id, tile_id, 24 w, 24 h, cast(total as bigint) total from p where hi > lo")
def _(t):
    """Tiles of 24 pixels, padded, of images whose pixels are not all alike there."""
    ship(t.spark)
    sizes = t.pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    got = raster.non_empty_tiles(sizes, _blocks(t, 16), 16, 24, 8)
    return got.select("image_id", F.col("tile_id").cast("int").alias("tile_id"), "w", "h", _total().alias("total"))


@query("j3_box_masks", "select p.image_id, count(*) covered from {pixels} p where exists (select 1 from {gt_boxes} b where b.image_id=p.image_id and p.x >= b.xmin % 50 and p.x < b.xmin % 50 + b.box_id % 13 and p.y >= b.ymin % 40 and p.y < b.ymin % 40 + b.box_id % 7) group by 1")
def _(t):
    ship(t.spark)
    boxes = t.gt_boxes.select("image_id", F.lit(0).alias("tile_id"), (F.col("xmin") % 50).alias("xmin"), (F.col("ymin") % 40).alias("ymin"), (F.col("xmin") % 50 + F.col("box_id") % 13).cast("int").alias("xmax"), (F.col("ymin") % 40 + F.col("box_id") % 7).cast("int").alias("ymax"))
    return raster.box_masks(_tiles(t), boxes).select("image_id", _total().alias("covered")).where("covered > 0")


@query("j5_turned_windows", "with w as (" + WIN + "), p as (select b.image_id, win_id, box_id, xmin-x0 a, ymin-y0 b, xmax-x0 c, ymax-y0 d, greatest(0, least(xmax, x0+64)-greatest(xmin, x0))*greatest(0, least(ymax, y0+64)-greatest(ymin, y0)) i, (xmax-xmin)*(ymax-ymin) s from w join {gt_boxes} b on b.image_id=w.image_id and b.xmin < x0+64 and b.xmax > x0 and b.ymin < y0+64 and b.ymax > y0) select image_id, win_id, box_id, least(greatest(b, 0), 63)::double rxmin, least(greatest(64-c, 0), 63)::double rymin, least(greatest(d, 0), 63)::double rxmax, least(greatest(64-a, 0), 63)::double rymax from p where i > 0.5*s")
def _(t):
    """Windows turned by a right angle, where SQL can follow; other angles are tested by sampling."""
    ship(t.spark)
    w = t.sql(WIN_SPARK)
    near = w.select("image_id", "win_id", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + 64).alias("xmax"), (F.col("y0") + 64).alias("ymax"))
    hits = spatial.overlap_pairs(t.gt_boxes.select("image_id", "box_id", *spatial.BOX), near, inclusive=False)
    pairs = hits.select("image_id", F.col("b_win_id").alias("win_id"), F.col("a_box_id").alias("box_id"), *[F.col(f"a_{c}").alias(c) for c in spatial.BOX], F.col("b_xmin").alias("x0"), F.col("b_ymin").alias("y0"), F.lit(64).alias("w"), F.lit(64).alias("h"))
    got = raster.rotated_windows(pairs, F.lit(90))
    return got.select("image_id", "win_id", "box_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("rxmin", "rymin", "rxmax", "rymax")])


@query("j10_overlay", "select image_id, cast(sum(trunc(val*0.5 + (val%5)*40*0.5) + trunc((val//2)*0.5 + (val%5)*10*0.5) + trunc((255-val)*0.5 + (255-(val%5)*20)*0.5)) as bigint) total from {pixels} group by 1")
def _(t):
    ship(t.spark)
    tiles = _rgb(_tiles(t))
    masks = _tiles(t).withColumn("data", _masks(t))
    return raster.overlay(tiles, masks, [(k * 40, k * 10, 255 - k * 20) for k in range(5)]).select("image_id", _total().alias("total"))


@query("j13_drawn_lines", "with l as (select image_id, 3 + image_id % 5 as k from (select distinct image_id from {pixels}) q) select image_id, cast(sum(case when (y = k and x between 4 and 51) or (abs(y-k) = 1 and x between 5 and 50) then 200 else val end) as bigint) total, count(*) filter (where (y = k and x between 4 and 51) or (abs(y-k) = 1 and x between 5 and 50)) drawn from {pixels} join l using (image_id) group by 1")
def _(t):
    """A line of 45 pixels and one too short to be drawn; tiles with less than half a side drawn are left out (none here)."""
    ship(t.spark)
    tiles = _tiles(t)
    at = (3 + F.col("image_id") % 5).cast("int")
    line = lambda a, b: tiles.select("image_id", "tile_id", F.lit(a).alias("x1"), at.alias("y1"), F.lit(b).alias("x2"), at.alias("y2"))
    return raster.with_lines(tiles, line(5, 50).unionByName(line(0, 20))).select("image_id", _total().alias("total"), "drawn")


@query("j13_random_lines")
def _(t):
    """2 to 4 lines with parallel neighbours on every tile; hashed places, see the test by pixels."""
    ship(t.spark)
    tiles = _tiles(t)
    return raster.with_lines(tiles, raster.random_lines(tiles)).select("image_id", "drawn", F.sha2("data", 256).alias("digest"))


@query("j14_alpha", "select image_id::varchar prefix, 4 bands, cast(sum(val + val//2 + 255-val + val%5) as bigint) total from {pixels} group by 1")
def _(t):
    ship(t.spark)
    named = _tiles(t).withColumn("prefix", F.col("image_id").cast("string"))
    got = raster.with_alpha(_rgb(named), named.withColumn("data", _masks(t)))
    return got.select("prefix", "bands", _total().alias("total"))


@query("j8_applied_tables", "select image_id, cast(sum((val*3 + image_id) % 256) as bigint) total from {pixels} group by 1")
def _(t):
    """Pixels looked up in a table for each image."""
    ship(t.spark)
    tables = t.pixels.select("image_id").distinct().withColumn("lut", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: ((v * 3 + F.col("image_id")) % 256).cast("int")))
    return raster.apply_tables(_tiles(t), tables).select("image_id", _total().alias("total"))


@query("j9_area_means", "with h as (select image_id, (max(y)+1)//4*4 hh from {pixels} group by 1) select image_id, cast(sum(m) as bigint) total from (select image_id, x//4 c, y//4 as r, round_even(avg(val), 0) m from {pixels} join h using (image_id) where y < hh group by 1, 2, 3) z group by 1")
def _(t):
    ship(t.spark)
    return raster.downscale(_tiles(t), 4, "mean").select("image_id", _total().alias("total"))


@query("j7_mosaic_tiles", "with s as (select image_id, x + 40*image_id x, y, val from {pixels} where val <> 0), w as (select x, y, arg_max(val, image_id) val from s group by 1, 2) select cast(x//128 as int) tx, cast(y//128 as int) ty, cast(sum(val) as bigint) total from w group by 1, 2")
def _(t):
    """Images side by side with overlap; later ones win but for zeros."""
    ship(t.spark)
    placed = _tiles(t).select(F.col("image_id").alias("order"), (40 * F.col("image_id")).cast("int").alias("x0"), F.lit(0).alias("y0"), "w", "h", "bands", "data")
    return raster.mosaic(placed, 128, nodata=0).select("tx", "ty", _total().alias("total")).where("total > 0")


@query("j7_separate_bands", "select cast(x//64 as int) tx, cast(y//64 as int) ty, image_id band, cast(sum(val) as bigint) total from {pixels} group by 1, 2, 3 having sum(val) > 0")
def _(t):
    """A band for each image, stacked in order."""
    ship(t.spark)
    placed = _tiles(t).select(F.col("image_id").alias("order"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), "w", "h", "bands", "data")
    return raster.stacked(placed, 64).select("tx", "ty", F.col("band").cast("long").alias("band"), _total().alias("total")).where("total > 0")


@query("j11_recoloured", "select image_id, cast(sum(case when val < 64 then 10 when val < 128 then 20 when val < 192 then 30 else 10 end) as bigint) total from {pixels} group by 1")
def _(t):
    """Pixels by their nearest of four centres and its palette colour in turn."""
    centres = t.spark.createDataFrame([(0, [31.5]), (1, [95.5]), (2, [159.5]), (3, [223.5])], "cluster int, centre array<double>")
    got = raster.recoloured(t.pixels, centres, [[10], [20], [30]])
    return got.groupBy("image_id").agg(F.sum(F.col("colour")[0].cast("long")).alias("total"))


@query("j12_composed")
def _(t):
    """Foregrounds blended into scenes at their planned places, and their boxes there; see the test by pixels."""
    ship(t.spark)
    bg = _rgb(_tiles(t)).withColumn("bg_id", F.col("image_id"))
    fg = t.spark.range(4).select(F.col("id").alias("fg_id"), F.lit(8).alias("fw"), F.lit(3).alias("fh"), F.unhex(F.repeat(F.lit("ff0080c0"), 24)).alias("data"))
    plan = raster.paste_plan(bg.select("bg_id", "w", "h"), fg, touch=1)
    return raster.composed(bg, fg, plan).select("bg_id", F.sha2("data", 256).alias("digest"))


@query("j17_synthetic_scene", "with p as (select image_id, x, y, x//16 c, y//16 r, val from {pixels}), l as (select p.*, case when (y = 3 and x between 8 and 52) or (abs(y-3) = 1 and x between 9 and 51) then 200 else val end v, r = 0 and c <= 3 as touched from p) select image_id, cast(sum(v) as bigint) whole, cast(sum(case when touched then v end) as bigint) touched from l group by 1")
def _(t):
    """Scenes cut into tiles, a line drawn through those it crosses, merged again: all tiles, and the touched ones. No foregrounds, where SQL can follow."""
    ship(t.spark)
    one = _tiles(t)

    @F.pandas_udf("binary")
    def three(d: pd.Series) -> pd.Series:
        return pd.Series([np.repeat(np.frombuffer(x, np.uint8), 3).tobytes() for x in d])

    one = one.withColumn("data", three("data")).withColumn("bands", F.lit(3))
    sizes = one.select("image_id", F.col("w").alias("width"), F.col("h").alias("height"))
    blocks = one.select("image_id", F.lit(0).alias("block_x"), F.lit(0).alias("block_y"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), "w", "h", "bands", "data")
    g = tiling.grid(sizes, 16, 0)
    cut = raster.crop_windows(g.withColumnRenamed("tile_id", "win_id"), blocks, 1 << 20).withColumnRenamed("win_id", "tile_id")
    tiles = cut.join(g.select("image_id", F.col("tile_id").cast("long").alias("tile_id"), "col", "row", "x0", "y0"), ["image_id", "tile_id"])
    ends = F.array(F.struct(F.lit(0).alias("pos"), F.lit(10.0).alias("x"), F.lit(3.0).alias("y")), F.struct(F.lit(1).alias("pos"), F.lit(50.0).alias("x"), F.lit(3.0).alias("y")))
    points = sizes.select("image_id", F.lit(1).alias("line_id"), F.inline(ends))
    none = t.spark.createDataFrame([], "fg_id long, fw int, fh int, data binary")
    whole, touched = scene.synthetic_scene(tiles, points, none, 16, 64, least=1)
    total = lambda m, name: m.groupBy("image_id").agg((F.sum(_total()) / 3).cast("long").alias(name))
    return total(whole, "whole").join(total(touched, "touched"), "image_id", "left")


# ---- completed forms of earlier queries ---------------------------------------------------------------------


@query("b15_tile_names", "select image_id, cast(w.row as int) as row, cast(c.col as int) col, prefix || '_' || w.row || '_' || c.col || '_1024' as name from {rasters}, range(0,10) c(col), range(0,10) w(row) where c.col <= ceil((width-1024)/768.0) and w.row <= ceil((height-1024)/768.0)")
def _(t):
    """Names of patches built, and their scene, row and column taken from the names again."""
    g = tiling.grid(t.rasters).select(geo.patch_name(F.col("prefix"), F.col("row"), F.col("col"), F.lit(1024)).alias("name"))
    p = geo.patch_parts(F.col("name"))
    return g.select("name", p["prefix"].alias("prefix"), p["row"].alias("row"), p["col"].alias("col")).join(t.rasters.select("prefix", "image_id"), "prefix").select("image_id", "row", "col", "name")


HP = H.format(k="poly_id")


@query("b17_expanded_windows", f"with p as (select image_id, box_id poly_id, xmin, ymin, xmax, ymax, width, height from {{polys}} q join {{gt_boxes}} b using (image_id) join {{rasters}} using (image_id) where b.box_id = q.poly_id), c as (select image_id, poly_id, width, height, cast(trunc((xmin*3+xmax*2+floor((xmin+xmax)/2))/6.0) as int) xc, cast(trunc((ymin*3+ymax*2+ymax+10)/6.0) as int) yc, xmax-xmin bw, ymax+10-ymin bh, {HP} h1, ((({HP} + 1) % 2147483647) * 48271 + 11) % 2147483647 h2 from p), s as (select *, case when bw + 2*bw*(0.5+(h1%1001)/1000.0*1.5) < 512 then 512 + h2 % 513 else trunc(bw + 2*bw*(0.5+(h1%1001)/1000.0*1.5)) end::int w0, case when bh + 2*bh*(0.5+(h2%1001)/1000.0*1.5) < 512 then 512 + h1 % 513 else trunc(bh + 2*bh*(0.5+(h2%1001)/1000.0*1.5)) end::int h0 from c), k as (select *, greatest(1, xc - w0//2) x0, greatest(1, yc - h0//2) y0 from s) select image_id, poly_id, cast(x0 as int) x0, cast(y0 as int) y0, cast(case when x0+w0 > width-1 then width-1-x0 else w0 end as int) w, cast(case when y0+h0 > height-1 then height-1-y0 else h0 end as int) h from k")
def _(t):
    """Windows about polygons, grown by a hashed half to two sizes on each side, small ones drawn anew, clamped to the raster."""
    p = t.polys.withColumn("ring", geo.wkt_ring(F.col("wkt"))).join(t.rasters.select("image_id", "width", "height"), "image_id")
    w = geo.expanded_window(F.col("ring"), F.col("width"), F.col("height"), F.col("poly_id"), seed=7)
    return p.select("image_id", "poly_id", *[w[c].alias(c) for c in ("x0", "y0", "w", "h")])


@query("c9_background_pixels", "with w as (select image_id, i win_id, cast((image_id*7+i*5) % 40 as int) x0, cast((image_id*3+i) % 4 as int) y0 from (select distinct image_id from {pixels}) q, range(0,20) t(i)), s as (select w.image_id, win_id, min(val) lo, max(val) hi, avg(case when val <> 0 then 1.0 else 0 end) nz from w join {pixels} p on p.image_id=w.image_id and p.x between x0 and x0+7 and p.y between y0 and y0+3 group by 1, 2) select image_id, win_id from w join s using (image_id, win_id) where hi > lo and nz >= 0.5 and not exists (select 1 from {gt_boxes} b where b.image_id=w.image_id and least(b.xmax, x0+8)-greatest(b.xmin, x0)+1 > 0 and least(b.ymax, y0+4)-greatest(b.ymin, y0)+1 > 0) and not (w.image_id % 2 = 0 and x0+8 > 20 and x0 < 31 and y0 < 2)")
def _(t):
    """Windows that touch no truth and no line region, whose pixels are not constant and at least half of them not zero."""
    ship(t.spark)
    images = t.pixels.select("image_id").distinct()
    w = images.withColumn("win_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).select("image_id", "win_id", ((F.col("image_id") * 7 + F.col("win_id") * 5) % 40).cast("int").alias("x0"), ((F.col("image_id") * 3 + F.col("win_id")) % 4).cast("int").alias("y0"), F.lit(8).alias("w"), F.lit(4).alias("h"))
    region = images.where("image_id % 2 = 0").select("image_id", F.lit(1).cast("long").alias("poly_id"), F.lit(1).alias("label"), F.lit("POLYGON ((20 0,30 0,30 1,20 1,20 0))").alias("wkt"))
    return raster.background_windows(w, t.gt_boxes, region, _blocks(t, 16), 16).select("image_id", "win_id")


@query("d17_parent_of_good_parts", "with b as (select image_id, box_id, cast(box_id % 300 as int) tile_id, cast((box_id*7) % 50 as int) x0, cast((box_id*3) % 5 as int) y0, label from {gt_boxes}), s as (select b.image_id, box_id, min(val) lo, max(val) hi, avg(case when val <> 0 then 1.0 else 0 end) nz from b join {pixels} p on p.image_id=b.image_id and p.x >= x0 and p.x < x0+9 and p.y >= y0 and p.y < y0+4 group by 1, 2), g as (select b.image_id, tile_id, bool_and(label = 2) all2, bool_and(coalesce(hi > lo and nz > 0.5, false)) good, min(x0) xmin, min(y0) ymin, max(x0+9) xmax, max(y0+4) ymax from b left join s using (image_id, box_id) group by 1, 2) select image_id, tile_id, greatest(0, xmin-5) xmin, greatest(0, ymin-5) ymin, least(63, xmax+5) xmax, least(h-1, ymax+5) ymax, 1 as label from g join (select image_id, cast(max(y)+1 as int) h from {pixels} group by 1) z using (image_id) where good and all2")
def _(t):
    """Per patch whose parts are all of class 2 and have content: the box about them, grown by five pixels and clipped. Each image is 300 patches' picture."""
    ship(t.spark)
    tiles = _tiles(t).withColumn("tile_id", F.explode(F.sequence(F.lit(0), F.lit(299))))
    parts = t.gt_boxes.select("image_id", (F.col("box_id") % 300).cast("int").alias("tile_id"), "box_id", ((F.col("box_id") * 7) % 50).cast("int").alias("xmin"), ((F.col("box_id") * 3) % 5).cast("int").alias("ymin"), "label")
    parts = parts.withColumn("xmax", F.col("xmin") + 9).withColumn("ymax", F.col("ymin") + 4)
    return raster.parent_boxes(tiles, parts).select("image_id", "tile_id", *spatial.BOX, "label")

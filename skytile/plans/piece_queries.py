"""Queries of pixels that move between tilings: pyramids, turned windows."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from skytile.operators import pieces, sampling, scene
from skytile.plans.queries import _blocks, _lines, _tiles, _with_raster, query
from skytile.session import ship


def weighted(data: str | Column, w: str | Column) -> Column:
    """Sum of a tile's values, each times 1 + (7 x + 3 y) % 5, so that places count."""

    @F.pandas_udf("long")
    def total(d: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for raw, width in zip(d, w):
            a = np.frombuffer(raw, np.uint8).reshape(-1, int(width)).astype(np.int64)
            y, x = np.indices(a.shape)
            out.append(int((a * (1 + (7 * x + 3 * y) % 5)).sum()))
        return pd.Series(out, dtype="int64")

    return total(data, w)


def _levels(value: str) -> str:
    """Levels 0 to 3 of the pixel table in tiles of 8; ``value`` makes a pixel from the four below."""
    up = lambda k: f"l{k} as (select {k} as level, image_id, x//2 as x, y//2 as y, {value} as val, w//2 as w, h//2 as h from l{k - 1} where x//2 < w//2 and y//2 < h//2 group by image_id, x//2, y//2, w, h)"
    return (
        "with l0 as (select 0 as level, image_id, x, y, val, w, h from {pixels} join (select image_id, max(x)+1 w, max(y)+1 h from {pixels} group by 1) s using (image_id)), "
        + ", ".join(up(k) for k in (1, 2, 3))
        + ", every as (" + " union all ".join(f"select * from l{k}" for k in range(4)) + ") select level, image_id, cast(x//8 as int) tx, cast(y//8 as int) ty, cast(max(x%8)+1 as int) w, cast(max(y%8)+1 as int) h, cast(sum(val*(1+(7*(x%8)+3*(y%8))%5)) as bigint) total from every group by level, image_id, x//8, y//8"
    )


def _pyramid(t, how: str):
    ship(t.spark)
    tiles = _blocks(t, 8).withColumnsRenamed({"block_x": "tx", "block_y": "ty"})
    return pieces.pyramid_pixels(tiles, 3, 8, how).select("level", "image_id", "tx", "ty", "w", "h", weighted("data", "w").alias("total"))


@query("i9_pyramid_means", _levels("cast(round_even(avg(val), 0) as int)"))
def _(t):
    """Each level's pixels are means of four of the level below."""
    return _pyramid(t, "mean")


@query("i9_pyramid_samples", _levels("max(case when x%2 = 1 and y%2 = 1 then val end)"))
def _(t):
    """Each level's pixels are the nearest of the level below."""
    return _pyramid(t, "near")


TURNED = """with w as (select image_id, i win_id, cast((image_id*7+i*5) % 40 as int) x0, cast((image_id*3+i*2) % 9 as int) y0, 12 + i % 3 as w, 9 as h, 90*(i % 4) as g from (select distinct image_id from {pixels}) q, range(0,8) t(i)),
c as (select w.*, u.i ui, v.i vi, ui + 0.5 - w/2.0 uu, vi + 0.5 - h/2.0 vv from w, range(0,14) u(i), range(0,9) v(i) where u.i < w),
s as (select *, cast(floor(x0 + w/2.0 + case g when 0 then uu when 90 then -vv when 180 then -uu else vv end) as int) px, cast(floor(y0 + h/2.0 + case g when 0 then vv when 90 then uu when 180 then -vv else -uu end) as int) py from c)
select s.image_id, s.win_id, cast(sum(coalesce(p.val, 0)*(1+(7*ui+3*vi)%5)) as bigint) total from s left join {pixels} p on p.image_id = s.image_id and p.x = px and p.y = py group by 1, 2"""


@query("j5_turned_pixels", TURNED)
def _(t):
    """Windows turned by right angles, where SQL can follow, their pixels taken over several blocks; other angles are tested against plain loops."""
    ship(t.spark)
    i = F.col("win_id")
    w = t.pixels.select("image_id").distinct().withColumn("win_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    w = w.select("image_id", "win_id", ((F.col("image_id") * 7 + i * 5) % 40).cast("int").alias("x0"), ((F.col("image_id") * 3 + i * 2) % 9).cast("int").alias("y0"), (12 + i % 3).cast("int").alias("w"), F.lit(9).alias("h"), (90 * (i % 4)).cast("double").alias("degrees"))
    return pieces.turned_pixels(w, _blocks(t, 16), 16).select("image_id", "win_id", weighted("data", "w").alias("total"))


LINE_PIXELS = """with l as (select image_id, box_id line_id, [xmin,xmax,xmax,floor((xmin+xmax)/2),xmin,xmin]::double[] x, [ymin,ymin,ymax,ymax+10,ymax,ymin]::double[] y from {gt_boxes} where box_id%20=0),
p as (select image_id, line_id, i pos, x[i+1] x, y[i+1] y from l, range(0,6) t(i)), s as (select *, lead(x) over w - x dx, lead(y) over w - y dy from p window w as (partition by image_id, line_id order by pos)),
n as (select *, greatest(abs(dx), abs(dy)) n from s where dx is not null),
c as (select distinct image_id, line_id, x, y, dx, dy, cast(floor(x+dx*i.i/greatest(n,1)+0.5) as int)+u.i px, cast(floor(y+dy*i.i/greatest(n,1)+0.5) as int)+v.i py from n, range(0,240) i(i), range(-2,3) u(i), range(-2,3) v(i) where i.i <= n),
t as (select *, case when dx*dx+dy*dy > 0 then least(1, greatest(0, ((px-x)*dx+(py-y)*dy)/(dx*dx+dy*dy))) else 0 end t from c),
d as (select image_id, line_id, px, py, min(round((px-x-t*dx)*(px-x-t*dx)+(py-y-t*dy)*(py-y-t*dy), 9)) d2 from t group by 1, 2, 3, 4),
h as (select *, cast(floor(px/512) as int) col, cast(floor(py/512) as int) as row from d where d2 <= 1),
a as (select * from h qualify row_number() over (partition by image_id, line_id, col, row order by px, d2, py) = 1), b as (select * from h qualify row_number() over (partition by image_id, line_id, col, row order by -px, d2, py) = 1)
select a.image_id, a.line_id, a.col, a.row, a.px x1, a.py y1, b.px x2, b.py y2 from a join b using (image_id, line_id, col, row)"""


@query("c19_line_pixels", LINE_PIXELS)
def _(t):
    """In each tile of 512 pixels that polylines of two pixels' thickness hit, the leftmost and rightmost hit pixel."""
    ship(t.spark)
    return scene.line_ends(_lines(t), 512)


MATCHED = """with h as (select image_id, val, count(*) n from {pixels} group by 1, 2), c as (select image_id, val, n, sum(n) over (partition by image_id order by val)/sum(n) over (partition by image_id) q from h),
d as (select image_id, row_number() over (order by image_id)-1 k, count(*) over () n from (select distinct image_id from {pixels}) z),
w as (select i draw, ((1 + i) % 2147483647 * 48271 + 11) % 2147483647 % (select count(distinct image_id) from {pixels}) ka, ((2 + i) % 2147483647 * 48271 + 11) % 2147483647 hb from range(0,5000) t(i)),
p as (select draw, a.image_id src, b.image_id ref from w join d a on a.k=w.ka join d b on b.k=(w.ka+1+hb%(a.n-1))%a.n),
r as (select image_id ref, val v0, q c0, lead(val) over w v1, lead(q) over w c1, row_number() over w k from c window w as (partition by image_id order by val)),
m as (select e.src, r.ref, s.val, s.n, cast(round_even(round(case when s.q < c0 or c1 is null then v0 else v0+(v1-v0)*(s.q-c0)/(c1-c0) end, 9), 0) as int) v from (select distinct src, ref from p) e join c s on s.image_id=e.src join r on r.ref=e.ref where (s.q >= c0 and (s.q < c1 or c1 is null)) or (k=1 and s.q < c0))
select draw, src image_id, cast(sum(n*v) as bigint) total from p join m using (src, ref) group by 1, 2"""


@query("j8_matched_pairs", MATCHED)
def _(t):
    """The pixels of 5000 drawn pairs of images, the first's histogram matched to the second's."""
    ship(t.spark)
    tiles = _blocks(t, 32)
    drawn = sampling.random_pairs(tiles.select(F.col("image_id").alias("id")).distinct(), 5000)
    got = pieces.matched_tiles(tiles, drawn.select(F.col("draw").alias("pair_id"), F.col("id_a").alias("src"), F.col("id_b").alias("ref")))

    @F.pandas_udf("long")
    def total(d: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(x, np.uint8).sum(dtype=np.int64)) for x in d], dtype="int64")

    return got.groupBy(F.col("pair_id").alias("draw"), "image_id").agg(F.sum(total("data")).alias("total"))


FG = "(select * from (values (0, 8, 4), (1, 6, 6), (2, 10, 3)) f(fg_id, fw, fh))"
ON_MASK = f"""with i as (select distinct image_id, 20 + image_id % 20 as cx, 10 as cy, ((((image_id*48271+11)%2147483647)*48271+11)%2147483647*48271+11)%2147483647 % 3 as fg_id from {{pixels}}),
p as (select image_id, fw, fh, cx - fw//2 as x, cy - fh//2 as y from i join {FG} using (fg_id)),
b as (select 1 as box_id, 3 as label, 1 as xmin, 1 as ymin, 90 as xmax, 90 as ymax union all select 2, 4, 2, 1, 4, 3)
select image_id, 0 as slot, box_id, label, cast(greatest(1, xmin)+x as int) xmin, cast(greatest(1, ymin)+y as int) ymin, cast(least(fw-1, xmax)+x as int) xmax, cast(least(fh-1, ymax)+y as int) ymax from p, b"""


@query("j12_boxes_on_masks", ON_MASK)
def _(t):
    """Foregrounds placed on masks of one pixel, where SQL can follow, and their boxes there; drawn places and turned ones are tested by pixels."""
    ship(t.spark)
    one = F.col("x").eqNullSafe((20 + F.col("image_id") % 20).cast("int")) & (F.col("y") == 10)
    marked = SimpleNamespace(pixels=t.pixels.withColumn("val", F.when(one, 1).otherwise(0)))
    tiles = _tiles(marked).withColumn("angles", F.lit(None).cast("binary"))
    fgs = t.spark.createDataFrame([(0, 8, 4), (1, 6, 6), (2, 10, 3)], "fg_id long, fw int, fh int")
    boxes = fgs.select("fg_id", F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("box_id", "label", "xmin", "ymin", "xmax", "ymax"), row)]) for row in ((1, 3, 1, 1, 90, 90), (2, 4, 2, 1, 4, 3))])))
    return scene.moved_boxes(scene.masked_plan(tiles, fgs), boxes, fgs).drop("tile_id")


def _h(seed: int, *parts: str) -> str:
    """SQL of ``geo.hashed``."""
    h = str(seed)
    for p in parts:
        h = f"((({h} + {p} % 2147483647) * 48271 + 11) % 2147483647)"
    return h


def _side(lo: str, hi: str, start: str, size: str, whole: str, k: int) -> str:
    side = f"({hi}-{lo})"
    low, high = f"greatest(cast(floor({side}*1.5) as bigint), 600)", f"greatest({side}*2, 1024)"
    drawn = f"({low} + {_h(2 * k, 'box_id', 'copy')} % ({high} - {low}))"
    return f"cast(greatest(1, {lo} - {_h(2 * k + 1, 'box_id', 'copy')} % ({drawn} - {side})) as int) {start}, {drawn} d{size}"


@query("i5_drawn_crops", f"with c as (select *, i as copy from {{gt_boxes}} join {{rasters}} using (image_id), range(0,3) t(i) where label <= 3), d as (select *, {_side('xmin', 'xmax', 'x0', 'w', 'width', 0)}, {_side('ymin', 'ymax', 'y0', 'h', 'height', 1)} from c) select image_id, box_id, cast(copy as int) as copy, x0, y0, cast(least(dw, width-x0) as int) w, cast(least(dh, height-y0) as int) h from d")
def _(t):
    """Three crops about each box of the first three classes, of drawn size and with the box at a drawn place."""
    return sampling.drawn_crops(_with_raster(t, t.gt_boxes))


@query("f8_point_windows", f"with p as (select image_id, cast((xmin+xmax)//2 as bigint) x, cast((ymin+ymax)//2 as bigint) y, width, height, box_id from {{gt_boxes}} join {{rasters}} using (image_id) where label in (2,4)), e as (select *, [512,1024,2048][1 + {_h(0, 'image_id', 'x', 'y')} % 3] ex, [512,1024,2048][1 + {_h(1, 'image_id', 'x', 'y')} % 3] ey from p), s as (select *, greatest(1, x-ex) x0, greatest(1, y-ey) y0 from e) select image_id, box_id, cast(x0 as int) x0, cast(y0 as int) y0, cast(case when x0+2*ex > width-1 then width-1-x0 else 2*ex end as int) w, cast(case when y0+2*ey > height-1 then height-1-y0 else 2*ey end as int) h from s")
def _(t):
    """Windows about the centres of boxes of two classes, half sides drawn from 512, 1024 and 2048."""
    middle = lambda c: F.floor((F.col(f"{c}min") + F.col(f"{c}max")) / 2).cast("long").alias(c)
    points = _with_raster(t, t.gt_boxes.where("label in (2, 4)")).select("image_id", "box_id", middle("x"), middle("y"), "width", "height")
    return sampling.point_windows(points).select("image_id", "box_id", "x0", "y0", "w", "h")

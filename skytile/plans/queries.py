"""One query per operator on the derived tables, most with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skytile.functions import geo
from skytile.operators import evaluate, graph, raster, sampling, sequence, spatial, tiling
from skytile.plans.fixtures import Tables, oracle
from skytile.session import release, ship, stored
from skytile.sources import annotations
from skytile.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}

A_GRID = "select r.image_id, c.col, w.row, c.col*768 x0, w.row*768 y0, least(1024, width-c.col*768) w, least(1024, height-w.row*768) h, c.col*(1+cast(ceil((height-1024)/768.0) as int))+w.row tile_id, width, height from {rasters} r, range(0,10) c(col), range(0,10) w(row) where c.col <= ceil((width-1024)/768.0) and w.row <= ceil((height-1024)/768.0)"
IOU = {
    "inc": ("greatest(0, least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin)+1)*greatest(0, least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin)+1)", "((a.xmax-a.xmin+1)*(a.ymax-a.ymin+1))", "((b.xmax-b.xmin+1)*(b.ymax-b.ymin+1))"),
    "con": ("greatest(0, least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin))*greatest(0, least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin))", "((a.xmax-a.xmin)*(a.ymax-a.ymin))", "((b.xmax-b.xmin)*(b.ymax-b.ymin))"),
}


def query(name: str, sql: str | None = None):
    def put(f):
        def run(spark, sf_dir):
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = oracle(sql)
        return f

    return put


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def _with_raster(t: Tables, df: DataFrame) -> DataFrame:
    return df.join(t.rasters, "image_id")


# ---- sources and sinks, scalar functions ----------------------------------------------------------------


@query("a6_wkt_polygons", "select image_id, poly_id, label, len(string_split(wkt, ',')) n_points, cast(split_part(replace(split_part(wkt, ',', 1), 'POLYGON ((', ''), ' ', 1) as double) x0, cast(replace(split_part(split_part(wkt, ',', -1), ' ', 2), '))', '') as double) y_last from {polys}")
def _(t):
    ring = geo.wkt_ring(F.col("wkt"))
    return t.polys.withColumn("ring", ring).select("image_id", "poly_id", "label", F.size("ring").cast("long").alias("n_points"), F.col("ring")[0]["x"].alias("x0"), F.element_at("ring", -1)["y"].alias("y_last"))


@query("a8_coco_annotations", "select box_id id, image_id, label category_id, cast((xmax-xmin)*(ymax-ymin) as int) area, 0 iscrowd, xmin bx, ymin b_y, xmax-xmin bw, ymax-ymin bh, xmax seg2, ymax seg5 from {gt_boxes}")
def _(t):
    a = annotations.coco_annotations(t.gt_boxes.withColumn("ann_id", F.col("box_id")))
    s = F.col("segmentation")[0]
    return a.select("id", "image_id", "category_id", "area", "iscrowd", F.col("bbox")[0].alias("bx"), F.col("bbox")[1].alias("b_y"), F.col("bbox")[2].alias("bw"), F.col("bbox")[3].alias("bh"), s[2].alias("seg2"), s[5].alias("seg5"))


@query("a9_yolo_lines", "select prefix || '_' || box_id file, label-1 cls, (xmin+xmax)/2.0/width xc, cast(ymax-ymin as double)/height h, 5 n_fields, true printed from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    """Written lines: number of fields, class, and whether the printed numbers are those of the box to six places."""
    b = _with_raster(t, t.gt_boxes).select(F.concat_ws("_", "prefix", "box_id").alias("file"), "label", "xmin", "ymin", "xmax", "ymax", F.col("width").alias("w"), F.col("height").alias("h"))
    b = b.withColumn("xc", (F.col("xmin") + F.col("xmax")) / 2 / F.col("w")).withColumn("bh", (F.col("ymax") - F.col("ymin")) / F.col("h"))
    lines = annotations.yolo_lines(b).join(b.select("file", "xc", "bh"), "file").withColumn("f", F.split("value", " "))
    ok = (F.abs(F.col("f")[1].cast("double") - F.col("xc")) < 1e-6) & (F.abs(F.col("f")[4].cast("double") - F.col("bh")) < 1e-6)
    return lines.select("file", F.col("f")[0].cast("int").alias("cls"), "xc", F.col("bh").alias("h"), F.size("f").alias("n_fields"), ok.alias("printed"))


@query("a10_roi_xml_regions", "select image_id, count(distinct label) n_regions, count(*) n_polygons from {gt_boxes} group by image_id")
def _(t):
    x = annotations.roi_xml(_with_raster(t, t.gt_boxes), ["large", "middle", "small", "insulator"])
    count = lambda s: (F.length("value") - F.length(F.replace("value", F.lit(s), F.lit("")))) / len(s)
    return x.select("image_id", count("<Region ").cast("long").alias("n_regions"), count("<Polygon>").cast("long").alias("n_polygons"))


@query("a11_map_geometry", "select image_id, box_id, label, printf('POLYGON ((%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f))', gt0+(xmin+.5)*gt1, gt3+(ymin+.5)*gt5, gt0+(xmax+.5)*gt1, gt3+(ymin+.5)*gt5, gt0+(xmax+.5)*gt1, gt3+(ymax+.5)*gt5, gt0+(xmin+.5)*gt1, gt3+(ymax+.5)*gt5, gt0+(xmin+.5)*gt1, gt3+(ymin+.5)*gt5) wkt, cast(0.999 as double) score from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    return annotations.map_geometry(_with_raster(t, t.gt_boxes)).withColumn("score", F.col("score").cast("double"))


@query("a12_polygons_per_class", "select case label when 1 then 'landslide' when 2 then 'water' when 3 then 'tree' end \"Class\", count(*) n, count(distinct image_id) scenes from {polys} where label <= 3 group by 1")
def _(t):
    named = t.polys.withColumn("class", F.element_at(F.array(*[F.lit(x) for x in ("landslide", "water", "tree", "other")]), F.col("label")))
    known = annotations.parse_wkt(named, {"landslide": 1, "water": 2, "tree": 3})
    return known.groupBy(F.col("class").alias("Class")).agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("scenes"))


@query("a16_raster_catalogue", "select prefix, gt0 ulx, gt3 uly, gt0+gt1*width lrx, gt3+gt5*height lry, bands from {rasters}")
def _(t):
    return t.rasters.select("prefix", F.col("gt0").alias("ulx"), F.col("gt3").alias("uly"), (F.col("gt0") + F.col("gt1") * F.col("width")).alias("lrx"), (F.col("gt3") + F.col("gt5") * F.col("height")).alias("lry"), "bands")


@query("a17_tile_index", f"with g as ({A_GRID}) select prefix || '_' || tile_id as name, printf('%f', gt0+x0*gt1) minx, printf('%f', gt0+x0*gt1+w*gt1) maxx, printf('%f', gt3+y0*gt5+h*gt5) miny, printf('%f', gt3+y0*gt5) maxy from g join {{rasters}} r using (image_id)")
def _(t):
    g = tiling.grid(t.rasters, 1024, 256).withColumn("name", F.concat_ws("_", "prefix", "tile_id"))
    return annotations.tile_index(g).drop("wkt")


@query("b1_map_to_pixel", "select image_id, box_id, cast(trunc((gt0+xmin*gt1-gt0)/gt1+.5) as int) px, cast(trunc((gt3+ymin*gt5-gt3)/gt5+.5) as int) py from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    b = _with_raster(t, t.gt_boxes)
    px, py = geo.map_to_pixel(F.col("gt0") + F.col("xmin") * F.col("gt1"), F.col("gt3") + F.col("ymin") * F.col("gt5"))
    return b.select("image_id", "box_id", px.alias("px"), py.alias("py"))


@query("b2_pixel_to_map", "select image_id, box_id, gt0+(xmin+.5)*gt1+(ymin+.5)*gt2 x0, gt3+(xmin+.5)*gt4+(ymin+.5)*gt5 y0, gt0+(xmax+.5)*gt1+(ymax+.5)*gt2 x2, gt3+(xmax+.5)*gt4+(ymax+.5)*gt5 y2, 5 n from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    ring = geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return _with_raster(t, t.gt_boxes).withColumn("r", ring).select("image_id", "box_id", F.col("r")[0]["x"].alias("x0"), F.col("r")[0]["y"].alias("y0"), F.col("r")[2]["x"].alias("x2"), F.col("r")[2]["y"].alias("y2"), F.size("r").alias("n"))


@query("b2_round_trip_shift", "select cast(count(*) as bigint) n, cast(sum(case when cast(trunc((gt0+(xmin+.5)*gt1-gt0)/gt1+.5) as int) = xmin+1 then 1 else 0 end) as bigint) moved from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    x, y = geo.pixel_to_map(F.col("xmin"), F.col("ymin"))
    px, _ = geo.map_to_pixel(x, y)
    return _with_raster(t, t.gt_boxes).select((px == F.col("xmin") + 1).cast("long").alias("m")).agg(F.count("*").alias("n"), F.sum("m").alias("moved"))


@query("b2_without_projection", "select image_id, box_id, label, printf('POLYGON ((%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f))', k*(gt0+(xmin+.5)*gt1), k*(gt3+(ymin+.5)*gt5), k*(gt0+(xmax+.5)*gt1), k*(gt3+(ymin+.5)*gt5), k*(gt0+(xmax+.5)*gt1), k*(gt3+(ymax+.5)*gt5), k*(gt0+(xmin+.5)*gt1), k*(gt3+(ymax+.5)*gt5), k*(gt0+(xmin+.5)*gt1), k*(gt3+(ymin+.5)*gt5)) wkt from (select *, case when is_invalid then cast(0.013888889 as double) else cast(1 as double) end k from {gt_boxes} join {rasters} using (image_id)) q")
def _(t):
    """Map geometry of scenes of which some have no projection."""
    return annotations.map_geometry(_with_raster(t, t.gt_boxes), ~F.col("is_invalid")).drop("score")


@query("b3_rebase", "select b.image_id, b.box_id, round(n.gt0+((r.gt0+(xmin+.5)*r.gt1-r.gt0)/r.gt1+.5)*n.gt1, 6) x, round(n.gt3+((r.gt3+(ymin+.5)*r.gt5-r.gt3)/r.gt5+.5)*n.gt5, 6) y from {gt_boxes} b join {rasters} r using (image_id) join (select image_id-1 image_id, gt0, gt1, gt3, gt5 from {rasters}) n using (image_id)")
def _(t):
    """Map coordinates of a scene rebuilt with the transform of another (the next one)."""
    other = t.rasters.select((F.col("image_id") - 1).alias("image_id"), *[F.col(f"gt{i}").alias(f"n{i}") for i in range(6)])
    b = _with_raster(t, t.gt_boxes).join(other, "image_id")
    x, y = geo.pixel_to_map(F.col("xmin"), F.col("ymin"))
    px, py = (x - F.col("gt0")) / F.col("gt1"), (y - F.col("gt3")) / F.col("gt5")
    nx, ny = geo.pixel_to_map(px, py, "n")
    return b.select("image_id", "box_id", _r(nx).alias("x"), _r(ny).alias("y"))


@query("b4_box_forms", "select image_id, box_id, (xmin+xmax)/2.0 xc, (ymin+ymax)/2.0 yc, xmax-xmin w, ymax-ymin h, cast(xmin as double) back_xmin, cast(ymax as double) back_ymax from {gt_boxes}")
def _(t):
    f = geo.xyxy_to_xywh(*[F.col(c) for c in spatial.BOX])
    back = geo.xywh_to_xyxy(f["xc"], f["yc"], f["w"], f["h"])
    return t.gt_boxes.select("image_id", "box_id", *[c.alias(k) for k, c in f.items()], back["xmin"].alias("back_xmin"), back["ymax"].alias("back_ymax"))


@query("b5_score_size_filter", "select image_id, det_id, score from {detections} where score > 0.1 and xmax-xmin > 10 and ymax-ymin > 10")
def _(t):
    return t.detections.where("score > 0.1 and xmax - xmin > 10 and ymax - ymin > 10").select("image_id", "det_id", "score")


@query("b6_size_range", "select image_id, box_id from {gt_boxes} where label = 3 and xmax-xmin between 10 and 800 and ymax-ymin between 10 and 800")
def _(t):
    return t.gt_boxes.where("label = 3 and xmax - xmin between 10 and 800 and ymax - ymin between 10 and 800").select("image_id", "box_id")


@query("b7_relative_size", "with m as (select image_id, least(avg(xmax-xmin), avg(ymax-ymin)) t from {detections} group by image_id) select image_id, det_id from {detections} join m using (image_id) where xmax-xmin > .25*t and ymax-ymin > .25*t and score > .15")
def _(t):
    return graph.relative_size(t.detections).where("score > 0.15").select("image_id", "det_id")


@query("b8_scene_filter", "select image_id, prefix from {rasters} where not contains(prefix, '7') and not is_invalid")
def _(t):
    bad = t.rasters.where("is_invalid").select("prefix")
    return t.rasters.where(~F.col("prefix").contains("7")).join(bad, "prefix", "left_anti").select("image_id", "prefix")


@query("b9_band_order", "select image_id, case when bgr then '3,2,1' else '1,2,3' end as bands_read from {rasters}")
def _(t):
    flags = t.rasters.where("bgr").select("prefix", F.lit(True).alias("swap"))
    return t.rasters.join(flags, "prefix", "left").select("image_id", F.when(F.col("swap"), "3,2,1").otherwise("1,2,3").alias("bands_read"))


@query("b10_label_remap", "select image_id, det_id, case label when 2 then 0 when 3 then 1 end label from {detections} where label > 1")
def _(t):
    m = F.create_map(F.lit(2), F.lit(0), F.lit(3), F.lit(1))
    return t.detections.where("label > 1").select("image_id", "det_id", m[F.col("label")].alias("label"))


@query("b11_clamped_windows", f"with g as ({A_GRID}) select image_id, cast(tile_id as int) tile_id, cast(greatest(1,x0) as int) x0, cast(greatest(1,y0) as int) y0, cast(case when greatest(1,x0)+w > width-1 then width-1-greatest(1,x0) else w end as int) w, cast(case when greatest(1,y0)+h > height-1 then height-1-greatest(1,y0) else h end as int) h from g")
def _(t):
    g = tiling.grid(t.rasters)
    c = geo.clamp_window(*[F.col(x) for x in ("x0", "y0", "w", "h", "width", "height")])
    return g.select("image_id", "tile_id", *[v.alias(k) for k, v in c.items()])


@query("b12_shifted_windows", "with a as (select image_id, box_id, width, height, (xmin+xmax)/2.0-512 x, (ymin+ymax)/2.0-512 y from {gt_boxes} join {rasters} using (image_id)), b as (select *, case when x+1024 > width then width-1024 else x end x1, case when y+1024 > height then height-1024 else y end y1 from a) select image_id, box_id, cast(trunc(case when x1<0 then 0 else x1 end) as int) x0, cast(trunc(case when y1<0 then 0 else y1 end) as int) y0 from b")
def _(t):
    b = _with_raster(t, t.gt_boxes)
    w = geo.shifted_window((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, F.lit(1024), F.col("width"), F.col("height"))
    return b.select("image_id", "box_id", w["x0"].alias("x0"), w["y0"].alias("y0"))


@query("b13_square_windows", "with a as (select image_id, box_id, width, height, (xmin+xmax)/2.0 xc, (ymin+ymax)/2.0 yc, (greatest(xmax-xmin, ymax-ymin)*1.3::double+32)/2 s from {gt_boxes} join {rasters} using (image_id)) select image_id, box_id, cast(trunc(greatest(0, xc-s)) as int) x0, cast(trunc(greatest(0, yc-s)) as int) y0, cast(trunc(least(width, xc+s)) as int) x1, cast(trunc(least(height, yc+s)) as int) y1 from a")
def _(t):
    b = _with_raster(t, t.gt_boxes)
    w = geo.square_window(*[F.col(c) for c in (*spatial.BOX, "width", "height")])
    return b.select("image_id", "box_id", *[v.alias(k) for k, v in w.items()])


@query("b14_window_filters", f"with g as ({A_GRID}) select image_id, cast(tile_id as int) tile_id from g where w >= 512 and h >= 512 and greatest(w,h) <= 1.5*least(w,h)")
def _(t):
    return tiling.grid(t.rasters).where("w >= 512 and h >= 512 and greatest(w, h) <= 1.5 * least(w, h)").select("image_id", "tile_id")


@query("b15_name_parts", "select c_custkey id, split_part(c_name, '#', 1) head, cast(split_part(c_name, '#', 2) as bigint) number from customer")
def _(t):
    parts = F.split("c_name", "#")
    return t.customer.select(F.col("c_custkey").alias("id"), parts[0].alias("head"), parts[1].cast("long").alias("number"))


@query("b16_quality_tag", "select r.image_id, case when gt5 < 0.5 and (coalesce(z,0) < 30 or coalesce(m,0) > 0) then 'high' else 'low' end quality from {rasters} r left join (select image_id, count(*) filter (where val=0) z, count(*) filter (where val=255) m from {pixels} group by image_id) s on s.image_id = r.image_id")
def _(t):
    s = t.pixels.groupBy("image_id").agg(F.count_if(F.col("val") == 0).alias("z"), F.count_if(F.col("val") == 255).alias("m"))
    good = (F.col("gt5") < 0.5) & ((F.coalesce("z", F.lit(0)) < 30) | (F.coalesce("m", F.lit(0)) > 0))
    return t.rasters.join(s, "image_id", "left").select("image_id", F.when(good, "high").otherwise("low").alias("quality"))


H = "((((7 + {k} % 2147483647) % 2147483647) * 48271 + 11) % 2147483647)"


@query("b17_polygon_windows", "with p as (select p.image_id, poly_id, cast(replace(split_part(wkt, ',', 1), 'POLYGON ((', '') as varchar) a, b.xmin, b.ymin, b.xmax, b.ymax from {polys} p join {gt_boxes} b on b.image_id=p.image_id and b.box_id=p.poly_id), c as (select image_id, poly_id, cast(trunc((xmin*3+xmax*2+floor((xmin+xmax)/2))/6.0) as int) xc, cast(trunc((ymin*3+ymax*2+ymax+10)/6.0) as int) yc, xmax-xmin w, ymax+10-ymin h from p) select image_id, poly_id, xc, yc, w, h from c")
def _(t):
    b = geo.ring_box(F.col("ring"))
    p = t.polys.withColumn("ring", geo.wkt_ring(F.col("wkt")))
    return p.select("image_id", "poly_id", geo.trunc(b["xc"]).alias("xc"), geo.trunc(b["yc"]).alias("yc"), (b["xmax"] - b["xmin"]).cast("int").alias("w"), (b["ymax"] - b["ymin"]).cast("int").alias("h"))


@query("b18_scale_by_size", f"select image_id, box_id, case when greatest(xmax-xmin, ymax-ymin)*16 > 2048 then 0.25+{H.format(k='box_id')} % 25 / 100.0 when greatest(xmax-xmin, ymax-ymin)*16 > 1024 then 0.40+{H.format(k='box_id')} % 35 / 100.0 else 0.80+{H.format(k='box_id')} % 20 / 100.0 end::double scale from {{gt_boxes}}")
def _(t):
    h = geo.hashed(F.col("box_id"), seed=7)
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) * 16
    return t.gt_boxes.select("image_id", "box_id", F.when(side > 2048, 0.25 + h % 25 / 100).when(side > 1024, 0.40 + h % 35 / 100).otherwise(0.80 + h % 20 / 100).cast("double").alias("scale"))


# ---- joins --------------------------------------------------------------------------------------------


CLIP = f"""g as ({A_GRID}), p as (select b.image_id, b.box_id, b.label, t.tile_id, t.w, t.h, b.xmin-t.x0 o1, b.ymin-t.y0 o2, b.xmax-t.x0 o3, b.ymax-t.y0 o4 from {{gt_boxes}} b join g t on b.image_id=t.image_id and least(b.xmax,t.x0+t.w)-greatest(b.xmin,t.x0)+1 > 0 and least(b.ymax,t.y0+t.h)-greatest(b.ymin,t.y0)+1 > 0), c as (select image_id, tile_id, box_id, label, greatest(1,o1) xmin, greatest(1,o2) ymin, least(o3,w-1) xmax, least(o4,h-1) ymax, o1, o2, o3, o4 from p), k as (select image_id, cast(tile_id as int) tile_id, box_id, label, cast(xmin as int) xmin, cast(ymin as int) ymin, cast(xmax as int) xmax, cast(ymax as int) ymax, (xmax-xmin)*(ymax-ymin) >= 0.7*((o3-o1)*(o4-o2)) kept from c)"""
TOUCH = "least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin)+1 > 0 and least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin)+1 > 0"


@query("c1_tile_boxes", f"with {CLIP} select * from k")
def _(t):
    return spatial.tile_boxes(tiling.grid(t.rasters), t.gt_boxes).select("image_id", "tile_id", "box_id", "label", *spatial.BOX, "kept")


def clipped(t: Tables) -> DataFrame:
    """Boxes clipped to the tiles of their scene, stored, as what drops some of them reads them several times."""
    k = stored(spatial.tile_boxes(tiling.grid(t.rasters), t.gt_boxes), "clipped")
    release(t.spark)  # the join's shuffles would keep their disk
    return k


@query("c2_without_rejected", f"with {CLIP} select image_id, tile_id, box_id from k a where kept and not exists (select 1 from k b where not b.kept and a.image_id=b.image_id and a.tile_id=b.tile_id and {TOUCH})")
def _(t):
    return spatial.drop_touching_rejected(clipped(t)).select("image_id", "tile_id", "box_id")


@query("c3_not_inside_rejected", f"with {CLIP} select image_id, tile_id, box_id from k a where kept and not exists (select 1 from k b where not b.kept and a.image_id=b.image_id and a.tile_id=b.tile_id and {TOUCH} and a.xmin >= b.xmin and a.ymin >= b.ymin and a.xmax <= b.xmax and a.ymax <= b.ymax) and exists (select 1 from k b where b.kept and b.label=3 and a.image_id=b.image_id and a.tile_id=b.tile_id)")
def _(t):
    k = clipped(t)
    wanted = k.where("kept and label = 3").select("image_id", "tile_id").distinct()
    return spatial.drop_touching_rejected(k, contain=True).join(wanted, ["image_id", "tile_id"], "left_semi").select("image_id", "tile_id", "box_id")


def _pairs_sql(kind: str, what: str) -> str:
    i, a, b = IOU[kind]
    return f"select a.image_id, a.det_id, b.box_id, {what.format(i=i, a=a, b=b)} from {{detections}} a join {{gt_boxes}} b on a.image_id=b.image_id and {i} > 0"


@query("c4_iou_continuous", _pairs_sql("con", "round(({i})::double/({a}+{b}-({i})), 9) iou"))
def _(t):
    return spatial.overlap_pairs(t.detections, t.gt_boxes, inclusive=False).select("image_id", F.col("a_det_id").alias("det_id"), F.col("b_box_id").alias("box_id"), _r("iou", 9).alias("iou"))


@query("c5_iou_inclusive", _pairs_sql("inc", "round(({i})::double/({a}+{b}-({i})), 9) iou"))
def _(t):
    return spatial.overlap_pairs(t.detections, t.gt_boxes).select("image_id", F.col("a_det_id").alias("det_id"), F.col("b_box_id").alias("box_id"), _r("iou", 9).alias("iou"))


@query("c6_intersection", _pairs_sql("inc", "cast({i} as bigint) as area"))
def _(t):
    return spatial.overlap_pairs(t.detections, t.gt_boxes).select("image_id", F.col("a_det_id").alias("det_id"), F.col("b_box_id").alias("box_id"), F.col("inter").cast("long").alias("area"))


@query("c7_covered_share", f"with g as ({A_GRID}), p as (select b.*, t.tile_id, t.x0, t.y0, t.w tw, t.h th, (greatest(0,least(b.xmax,t.x0+t.w)-greatest(b.xmin,t.x0))*greatest(0,least(b.ymax,t.y0+t.h)-greatest(b.ymin,t.y0)))::double/((b.xmax-b.xmin)*(b.ymax-b.ymin)) s from {{gt_boxes}} b join g t using (image_id)) select image_id, cast(tile_id as int) win_id, box_id, round(s, 9) \"share\", cast(greatest(0,least(xmin-x0,tw-1)) as int) xmin, cast(greatest(0,least(ymax-y0,th-1)) as int) ymax from p where s > .5")
def _(t):
    w = tiling.grid(t.rasters).withColumnRenamed("tile_id", "win_id")
    return spatial.covered_share(t.gt_boxes, w).select("image_id", "win_id", "box_id", _r("share", 9).alias("share"), "xmin", "ymax")


@query("c8_fully_inside", f"with g as ({A_GRID}) select b.image_id, cast(tile_id as int) win_id, box_id, cast(xmin-x0 as int) xmin, cast(ymin-y0 as int) ymin from {{gt_boxes}} b join g t using (image_id) where xmin>=x0 and xmin<xmax and xmax<x0+t.w and ymin>=y0 and ymin<ymax and ymax<y0+t.h")
def _(t):
    w = tiling.grid(t.rasters).withColumnRenamed("tile_id", "win_id")
    return spatial.fully_inside(t.gt_boxes, w).select("image_id", "win_id", "box_id", "xmin", "ymin")


WIN = "select image_id, i win_id, cast(((image_id*7919+i*104729) % (width-64)) as int) x0, cast(((image_id*6131+i*15485863) % (height-64)) as int) y0, 64 w, 64 h from {rasters}, range(0,50) t(i)"
WIN_SPARK = "select image_id, i win_id, cast(((image_id*7919+i*104729) % (width-64)) as int) x0, cast(((image_id*6131+i*15485863) % (height-64)) as int) y0, 64 w, 64 h from {rasters} lateral view explode(sequence(0L,49L)) t as i"


@query("c9_background_windows", f"with w as ({WIN}) select image_id, win_id from w where not exists (select 1 from {{gt_boxes}} b where b.image_id=w.image_id and least(b.xmax,x0+64)-greatest(b.xmin,x0)+1 > 0 and least(b.ymax,y0+64)-greatest(b.ymin,y0)+1 > 0)")
def _(t):
    return spatial.windows_without_boxes(t.sql(WIN_SPARK), t.gt_boxes).select("image_id", "win_id")


@query("c10_positive_negative", "with m as (select a.image_id, a.det_id, max((" + IOU["con"][0] + ")::double/(" + IOU["con"][1] + "+" + IOU["con"][2] + "-(" + IOU["con"][0] + "))) m from {detections} a join {gt_boxes} b on a.image_id=b.image_id and " + IOU["con"][0] + " > 0 group by all) select d.image_id, d.det_id, coalesce(m, 0) > .1 positive from {detections} d left join m on d.image_id=m.image_id and d.det_id=m.det_id")
def _(t):
    return spatial.best_iou(t.detections, t.gt_boxes, ["det_id"]).select("image_id", "det_id", (F.col("max_iou") > 0.1).alias("positive"))


@query("c11_scene_tp_table")
def _(t):
    """Truth, predictions (after suppression) and predictions that meet truth, per scene."""
    return evaluate.scene_tp_table(graph.nms(t.detections), t.gt_boxes)


@query("c11_scene_tp_table_raw", "with h as (select a.image_id, count(distinct a.det_id) n from {detections} a join {gt_boxes} b on a.image_id=b.image_id and a.label=2 and b.label=3 and " + IOU["con"][0] + " > 0 group by 1) select s.image_id, coalesce(g.n,0) num_gt, coalesce(p.n,0) num_pred, coalesce(h.n,0) num_tp from (select distinct image_id from {gt_boxes} where image_id in (select image_id from {detections})) s left join (select image_id, count(*) n from {gt_boxes} where label=3 group by 1) g using (image_id) left join (select image_id, count(*) n from {detections} where label=2 group by 1) p using (image_id) left join h using (image_id)")
def _(t):
    return evaluate.scene_tp_table(t.detections, t.gt_boxes)


MATCH = "i as (select a.image_id, a.det_id, b.box_id, (" + IOU["con"][0] + ")::double/(" + IOU["con"][1] + "+" + IOU["con"][2] + "-(" + IOU["con"][0] + ")) iou from {detections} a join {gt_boxes} b on a.image_id=b.image_id and " + IOU["con"][0] + " > 0), d1 as (select *, row_number() over (partition by image_id, det_id order by iou desc, box_id) r from i where iou > THR), mt as (select image_id, box_id, det_id, iou from (select *, row_number() over (partition by image_id, box_id order by iou desc, det_id) q from d1 where r=1) where q=1)"


@query("c12_greedy_matches", "with " + MATCH.replace("THR", "0.5") + " select image_id, box_id, det_id, round(iou, 9) iou from mt")
def _(t):
    return evaluate.greedy_matches(t.detections, t.gt_boxes, 0.5).select("image_id", "box_id", "det_id", _r("iou", 9).alias("iou"))


@query("c13_mask_pairs", "select g.image_id, count(*) n from (select image_id || '' prefix, image_id, x, y from {mask_pixels}) g join (select image_id || '_binary' prefix, x, y from {mask_pixels}) p on p.prefix = g.prefix || '_binary' and p.x = g.x and p.y = g.y group by 1")
def _(t):
    truth = t.mask_pixels.select("image_id", F.col("image_id").cast("string").alias("prefix"), "x", "y")
    pred = t.mask_pixels.select(F.regexp_replace(F.concat(F.col("image_id").cast("string"), F.lit("_binary")), "_binary$", "").alias("prefix"), "x", "y")
    return truth.join(pred, ["prefix", "x", "y"]).groupBy("image_id").agg(F.count("*").alias("n"))


@query("c14_relabel_from_review", "select b.image_id, b.box_id, case when r.cls is not null then r.cls when b.label=2 then 4 else b.label end label from {gt_boxes} b left join (select image_id, box_id, cast(1+box_id%3 as int) cls from {gt_boxes} where box_id%7=0) r on r.image_id=b.image_id and r.box_id=b.box_id")
def _(t):
    reviewed = t.gt_boxes.where("box_id % 7 = 0").select("image_id", "box_id", (1 + F.col("box_id") % 3).cast("int").alias("cls"))
    return t.gt_boxes.join(reviewed, ["image_id", "box_id"], "left").select("image_id", "box_id", F.coalesce("cls", F.when(F.col("label") == 2, 4).otherwise(F.col("label"))).alias("label"))


@query("c15_borrowed_metadata", "select s.image_id, s.prefix, r.prefix ref, r.gt0, r.gt1 from {rasters} s join {rasters} r on r.image_id = s.image_id - s.image_id % 5 + 1")
def _(t):
    ref = t.rasters.select(F.col("image_id").alias("ref_id"), F.col("prefix").alias("ref"), "gt0", "gt1")
    return t.rasters.select("image_id", "prefix", (F.col("image_id") - F.col("image_id") % 5 + 1).alias("ref_id")).join(ref, "ref_id").drop("ref_id")


@query("c16_nearest_box", "with c as (select image_id, box_id, (xmin+xmax)/2.0 xc, (ymin+ymax)/2.0 yc, xmax-xmin bw, ymax-ymin bh from {gt_boxes}), p as (select a.image_id, a.box_id, b.box_id near_id, (a.xc-b.xc)*(a.xc-b.xc)+(a.yc-b.yc)*(a.yc-b.yc) d2, least(a.bw,b.bw) mw, least(a.bh,b.bh) mh, row_number() over (partition by a.image_id, a.box_id order by (a.xc-b.xc)*(a.xc-b.xc)+(a.yc-b.yc)*(a.yc-b.yc), b.box_id) r from c a join c b on a.image_id=b.image_id and a.box_id<>b.box_id and abs(a.xc-b.xc) <= 600 and abs(a.yc-b.yc) <= 600) select image_id, box_id, near_id, cast(d2 as double) d2 from p where r=1 and sqrt(d2) < 3*mw and sqrt(d2) < 3*mh")
def _(t):
    return spatial.nearest_box(t.gt_boxes)


@query("c17_tiles_in_rectangle", "with t as (select image_id tile_id, gt0, gt1, gt3, gt5, gt0 minx, gt0+gt1*width maxx, gt3+gt5*height miny, gt3 maxy from {rasters}), r as (select image_id rect_id, gt0+500 x1, gt0+6000 x2, gt3-1500 y1, gt3-100 y2 from {rasters}), p as (select rect_id, tile_id, gt0, gt1, gt3, gt5, greatest(x1,minx) a, least(x2,maxx) b, greatest(y1,miny) c, least(y2,maxy) d from r join t on greatest(x1,minx) < least(x2,maxx) and greatest(y1,miny) < least(y2,maxy)) select rect_id, tile_id, cast(trunc((a-gt0)/gt1+.5) as int) x0, cast(trunc((d-gt3)/gt5+.5) as int) y0, cast(trunc((b-gt0)/gt1+.5) as int)-cast(trunc((a-gt0)/gt1+.5) as int) w, cast(trunc((c-gt3)/gt5+.5) as int)-cast(trunc((d-gt3)/gt5+.5) as int) h from p")
def _(t):
    tiles = t.rasters.select(F.col("image_id").alias("tile_id"), "gt0", "gt1", "gt3", "gt5", F.col("width").alias("w"), F.col("height").alias("h"))
    rects = t.rasters.select(F.col("image_id").alias("rect_id"), (F.col("gt0") + 500).alias("minx"), (F.col("gt0") + 6000).alias("maxx"), (F.col("gt3") - 1500).alias("miny"), (F.col("gt3") - 100).alias("maxy"))
    return spatial.tiles_in_rectangle(tiles, rects)


@query("c18_all_layers", "select image_id, prefix from {rasters} where image_id in (select image_id from {polys} group by 1 having count(distinct label) = 4)")
def _(t):
    full = t.polys.groupBy("image_id").agg(F.count_distinct("label").alias("k")).where("k = 4")
    return t.rasters.join(full, "image_id", "left_semi").select("image_id", "prefix")


def _lines(t):
    ring = geo.wkt_ring(F.col("wkt"))
    return t.polys.select("image_id", F.col("poly_id").alias("line_id"), F.posexplode(ring).alias("pos", "p")).select("image_id", "line_id", "pos", "p.x", "p.y")


@query("c19_segment_tiles", "with l as (select image_id, box_id line_id, [xmin,xmax,xmax,floor((xmin+xmax)/2),xmin,xmin]::double[] x, [ymin,ymin,ymax,ymax+10,ymax,ymin]::double[] y from {gt_boxes} where box_id%20=0), p as (select image_id, line_id, i pos, x[i+1] x, y[i+1] y from l, range(0,6) t(i)), s as (select *, lead(x) over w x2, lead(y) over w y2 from p window w as (partition by image_id, line_id order by pos)), c as (select s.*, c.i col, r.i as row from s, range(0,10) c(i), range(0,10) r(i) where x2 is not null and c.i between floor(least(x,x2)/512) and floor(greatest(x,x2)/512) and r.i between floor(least(y,y2)/512) and floor(greatest(y,y2)/512)), u as (select *, case when x2<>x then (col*512-x)/(x2-x) end ax, case when x2<>x then ((col+1)*512-x)/(x2-x) end bx, case when y2<>y then (row*512-y)/(y2-y) end ay, case when y2<>y then ((row+1)*512-y)/(y2-y) end b_y from c), v as (select *, greatest(0.0, least(ax,bx), least(ay,b_y)) t0, least(1.0, greatest(ax,bx), greatest(ay,b_y)) t1 from u where (x2<>x or (col*512<=x and (col+1)*512>x)) and (y2<>y or (row*512<=y and (row+1)*512>y))) select image_id, line_id, cast(pos as int) pos, cast(col as int) col, cast(row as int) as row, round(t0, 9) t0, round(t1, 9) t1 from v where t0 <= t1")
def _(t):
    """Tiles of 512 pixels that the segments of polylines cross."""
    return spatial.segment_tiles(_lines(t), 512).withColumn("t0", _r("t0", 9)).withColumn("t1", _r("t1", 9))


# ---- aggregations -------------------------------------------------------------------------------------


@query("d1_counts", "select image_id, label, count(*) n from {gt_boxes} group by rollup(image_id, label)")
def _(t):
    return t.gt_boxes.rollup("image_id", "label").agg(F.count("*").alias("n"))


@query("d2_class_weights", "with c as (select label, count(*) n from {gt_boxes} group by 1), s as (select sum(n) total from c) select image_id, box_id, round(cast(total as double)/n, 9) weight from {gt_boxes} join c using (label), s")
def _(t):
    counts = t.gt_boxes.groupBy("label").agg(F.count("*").alias("n"))
    shares = counts.withColumn("weight", F.sum("n").over(Window.partitionBy(F.lit(1))) / F.col("n"))  # a row per class
    return t.gt_boxes.join(shares, "label").select("image_id", "box_id", _r("weight", 9).alias("weight"))


FLAG = "with " + MATCH.replace("THR", "0.5") + ", f as (select d.image_id, d.det_id, d.label, d.score, case when g.label = d.label+1 then 1 else 0 end tp from {detections} d left join mt on mt.image_id=d.image_id and mt.det_id=d.det_id left join {gt_boxes} g on g.image_id=mt.image_id and g.box_id=mt.box_id), n as (select label-1 label, count(*) n_gt from {gt_boxes} group by 1), cv as (select label, image_id, det_id, score, tp, sum(tp) over w ctp, count(*) over w cn, n_gt from f join n using (label) window w as (partition by label order by score desc, det_id, image_id rows unbounded preceding))"


def _curve(t):
    return evaluate.pr_curve(evaluate.flagged(t.detections, t.gt_boxes, 0.5), t.gt_boxes)


@query("d3_pr_curve", FLAG + " select label, image_id, det_id, round(ctp/(n_gt+1e-16), 9) recall, round(ctp::double/cn, 9) as \"precision\" from cv")
def _(t):
    return _curve(t).select("label", "image_id", "det_id", _r("recall", 9).alias("recall"), _r("precision", 9).alias("precision"))


@query("d4_average_precision", FLAG + """, e as (select label, ctp/(n_gt+1e-16) r, max(ctp::double/cn) hi, min(ctp::double/cn) lo from cv group by 1, 2), x as (select label, r, max(hi) over (partition by label order by r rows between current row and unbounded following) first_p, greatest(lo, coalesce(max(hi) over (partition by label order by r rows between 1 following and unbounded following), 0)) last_p, max(r) over (partition by label) top from e), g as (select label, i/100.0::double q from (select distinct label from x), range(0,101) t(i)), l as (select g.label, g.q, max(x.r) r0 from g left join x on x.label=g.label and x.r <= g.q group by 1, 2), u as (select l.*, (select min(r) from x where x.label=l.label and x.r > l.q) r1, (select max(r) from x where x.label=l.label) top from l), v as (select u.label, u.q, case when u.q = u.r0 then a.last_p when u.r1 is null then case when u.q >= u.top+0.01 then 0 else a.last_p + (0-a.last_p)*(u.q-u.r0)/0.01 end when u.r0 is null then 1.0 + (b.first_p-1.0)*u.q/u.r1 else a.last_p + (b.first_p-a.last_p)*(u.q-u.r0)/(u.r1-u.r0) end p from u left join x a on a.label=u.label and a.r=u.r0 left join x b on b.label=u.label and b.r=u.r1), w as (select label, q, p, lead(p) over (partition by label order by q) p1 from v) select label, round(sum((p+p1)/2*0.01), 6) ap from w where p1 is not null group by 1""")
def _(t):
    return evaluate.average_precision(_curve(t), t.gt_boxes).select("label", _r("ap").alias("ap"))


@query("d5_best_f1")
def _(t):
    return evaluate.best_f1(_curve(t))


CM = "with dc as (select * from {detections} where score > 0.25), i as (select a.image_id, a.det_id, b.box_id, (" + IOU["con"][0] + ")::double/(" + IOU["con"][1] + "+" + IOU["con"][2] + "-(" + IOU["con"][0] + ")) iou from dc a join {gt_boxes} b on a.image_id=b.image_id and " + IOU["con"][0] + " > 0), d1 as (select *, row_number() over (partition by image_id, det_id order by iou desc, box_id) r from i where iou > 0.45), mt as (select image_id, box_id, det_id from (select *, row_number() over (partition by image_id, box_id order by iou desc, det_id) q from d1 where r=1) where q=1), cells as (select g.label-1 row_cls, d.label col_cls from mt join {detections} d on d.image_id=mt.image_id and d.det_id=mt.det_id join {gt_boxes} g on g.image_id=mt.image_id and g.box_id=mt.box_id union all select 4, label-1 from {gt_boxes} g where not exists (select 1 from mt where mt.image_id=g.image_id and mt.box_id=g.box_id) union all select label, 4 from dc d where not exists (select 1 from mt where mt.image_id=d.image_id and mt.det_id=d.det_id) and image_id in (select image_id from mt)), cm as (select row_cls, col_cls, count(*) n from cells group by 1, 2)"


@query("d6_confusion", CM + " select * from cm")
def _(t):
    return evaluate.confusion(t.detections, t.gt_boxes, 4)


@query("d7_confusion_shares", CM + " select row_cls, col_cls, case when n/(sum(n) over (partition by col_cls)+1e-6) >= .005 then round(n/(sum(n) over (partition by col_cls)+1e-6), 9) end \"share\" from cm")
def _(t):
    return evaluate.column_shares(evaluate.confusion(t.detections, t.gt_boxes, 4)).withColumn("share", _r("share", 9))


@query("d8_classifier_confusion", "select truth, pred, count(*) n, round(count(*)/sum(count(*)) over (partition by truth), 9) \"share\" from {cls_preds} group by 1, 2")
def _(t):
    return evaluate.classifier_confusion(t.cls_preds).withColumn("share", _r("share", 9))


@query("d8_classifier_report", "with c as (select distinct truth cls from {cls_preds} union select distinct pred from {cls_preds}), s as (select cls, count(*) filter (where truth=cls) support, count(*) filter (where pred=cls) predicted, count(*) filter (where truth=cls and pred=cls) hits from c, {cls_preds} group by 1), q as (select *, coalesce(hits/nullif(predicted,0), 0) p, coalesce(hits/nullif(support,0), 0) r from s) select cls, round(p, 9) as \"precision\", round(r, 9) recall, round(coalesce(2*p*r/nullif(p+r,0), 0), 9) f1, support, round(cast(sum(hits) over () as double)/sum(support) over (), 9) accuracy from q")
def _(t):
    r = evaluate.classifier_report(t.cls_preds)
    return r.select("cls", *[_r(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support", _r("accuracy", 9).alias("accuracy"))


@query("d9_polygon_boxes", "select p.image_id, poly_id, cast(b.xmin as double) xmin, cast(b.ymin as double) ymin, cast(b.xmax as double) xmax, cast(b.ymax+10 as double) ymax, round((b.xmin*3+b.xmax*2+floor((b.xmin+b.xmax)/2))/6.0, 6)::double xc from {polys} p join {gt_boxes} b on b.image_id=p.image_id and b.box_id=p.poly_id")
def _(t):
    b = geo.ring_box(F.col("ring"))
    p = t.polys.withColumn("ring", geo.wkt_ring(F.col("wkt")))
    return p.select("image_id", "poly_id", *[b[c].alias(c) for c in spatial.BOX], _r(b["xc"]).alias("xc"))


DICE = "with l as (select i label from range(1,5) t(i)), d as (select image_id, label, (2.0*count(*) filter (where gt_label=label and pred_label=label)+1e-4)/(count(*) filter (where gt_label=label)+count(*) filter (where pred_label=label)+1e-4) dice from {mask_pixels}, l group by 1, 2)"


@query("d10_dice", DICE + " select image_id, cast(label as int) label, round(dice, 9) dice from d")
def _(t):
    return evaluate.dice(t.mask_pixels, [1, 2, 3, 4]).withColumn("dice", _r("dice", 9))


@query("d10_mean_dice", DICE + " select cast(label as int) label, round(avg(dice), 9) dice, count(*) images from d where image_id in (select image_id from d where label in (1,2) and dice > .5 group by 1 having count(*)=2) group by 1")
def _(t):
    return evaluate.mean_dice(evaluate.dice(t.mask_pixels, [1, 2, 3, 4]), [1, 2]).withColumn("dice", _r("dice", 9))


@query("d11_tile_statistics", "select image_id, min(val) lo, max(val) hi, count(*) filter (where val=0)/count(*) share0, count(*) filter (where val=255)/count(*) share255, count(*) filter (where val<>0) nonzero from {pixels} group by 1")
def _(t):
    n = F.count("*")
    return t.pixels.groupBy("image_id").agg(F.min("val").alias("lo"), F.max("val").alias("hi"), (F.count_if(F.col("val") == 0) / n).alias("share0"), (F.count_if(F.col("val") == 255) / n).alias("share255"), F.count_if(F.col("val") != 0).alias("nonzero"))


@query("d12_mask_label_counts", "select image_id, x//16 tx, count(*) filter (where gt_label>0) labelled from {mask_pixels} group by 1, 2 having count(*) filter (where gt_label>0) >= 10")
def _(t):
    return t.mask_pixels.groupBy("image_id", F.floor(F.col("x") / 16).cast("int").alias("tx")).agg(F.count_if(F.col("gt_label") > 0).alias("labelled")).where("labelled >= 10")


@query("d13_dominant_share", "with h as (select image_id, least(val,254) v, count(*) n from {pixels} group by 1, 2) select image_id, cast(max(n) as double)/sum(n) top_share from h group by 1 having cast(max(n) as double)/sum(n) <= .5")
def _(t):
    h = t.pixels.groupBy("image_id", F.least("val", F.lit(254)).alias("v")).agg(F.count("*").alias("n"))
    return h.groupBy("image_id").agg((F.max("n") / F.sum("n")).alias("top_share")).where("top_share <= 0.5")


@query("d14_mosaic_extent", "select min(gt0) ulx, max(gt3) uly, max(gt0+gt1*width) lrx, min(gt3+gt5*height) lry, cast(trunc((max(gt0+gt1*width)-min(gt0))/min(gt1)+.5) as bigint) px_w, cast(trunc((max(gt3)-min(gt3+gt5*height))/min(gt1)+.5) as bigint) px_h from {rasters}")
def _(t):
    r = t.rasters.withColumn("lrx", F.col("gt0") + F.col("gt1") * F.col("width")).withColumn("lry", F.col("gt3") + F.col("gt5") * F.col("height"))
    e = r.agg(F.min("gt0").alias("ulx"), F.max("gt3").alias("uly"), F.max("lrx").alias("lrx"), F.min("lry").alias("lry"), F.min("gt1").alias("px"))
    return e.select("ulx", "uly", "lrx", "lry", ((F.col("lrx") - F.col("ulx")) / F.col("px") + 0.5).cast("long").alias("px_w"), ((F.col("uly") - F.col("lry")) / F.col("px") + 0.5).cast("long").alias("px_h"))


@query("d15_distinct_values", "select image_id, count(distinct val) n from {pixels} group by 1")
def _(t):
    colours = sampling.random_n(t.pixels.select("image_id", "val").distinct(), ["image_id"], ["val"], 100000)
    return colours.groupBy("image_id").agg(F.count("*").alias("n"))


@query("d16_size_range", f"with g as ({A_GRID}) select cast(min(least(w,h)) as int) short_side, cast(max(greatest(w,h)) as int) long_side from g")
def _(t):
    return tiling.grid(t.rasters).agg(F.min(F.least("w", "h")).alias("short_side"), F.max(F.greatest("w", "h")).alias("long_side"))


@query("d17_parent_box", f"with {CLIP} select image_id, tile_id, min(xmin)-5 xmin, min(ymin)-5 ymin, max(xmax)+5 xmax, max(ymax)+5 ymax from k where kept group by 1, 2 having bool_and(label=2)")
def _(t):
    k = spatial.tile_boxes(tiling.grid(t.rasters), t.gt_boxes).where("kept")
    g = k.groupBy("image_id", "tile_id").agg(F.every(F.col("label") == 2).alias("all2"), (F.min("xmin") - 5).alias("xmin"), (F.min("ymin") - 5).alias("ymin"), (F.max("xmax") + 5).alias("xmax"), (F.max("ymax") + 5).alias("ymax"))
    return g.where("all2").drop("all2")


@query("d18_label_mix", "select * from (select image_id, y, count(*) filter (where gt_label=1) n1, count(*) filter (where gt_label=2) n2, count(*) filter (where gt_label=3) n3, count(*) filter (where gt_label=4) n4 from {mask_pixels} group by 1, 2) where not (n2<5 and n4<5 and (n1<12 or n3<12)) and n1+n2+n3+n4 >= 12")
def _(t):
    n = t.mask_pixels.groupBy("image_id", "y").agg(*[F.count_if(F.col("gt_label") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    return n.where("not (n2 < 5 and n4 < 5 and (n1 < 12 or n3 < 12)) and n1 + n2 + n3 + n4 >= 12")


# ---- sequences, sorts, samples, sets, splits ----------------------------------------------------------------


@query("e1_running_offset", "select image_id, box_id, cast(coalesce(sum(xmax-xmin) over (partition by image_id order by box_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start from {gt_boxes}")
def _(t):
    b = t.gt_boxes.withColumn("w", F.col("xmax") - F.col("xmin"))
    return sequence.running_offset(b, ["image_id"], ["box_id"], "w").select("image_id", "box_id", "start")


@query("e2_zero_islands", "with s as (select job_id, event_id, n_dets%2 f, row_number() over (partition by job_id order by event_id) r from {tile_results}), o as (select job_id, event_id before, lead(event_id) over w after, r, lead(r) over w r1 from s where f=1 window w as (partition by job_id order by event_id)) select job_id, before, after from o where r1-r > 1")
def _(t):
    return sequence.zero_islands(t.tile_results.withColumn("f", F.col("n_dets") % 2), ["job_id"], "event_id", "f")


@query("e5_cdf", "select image_id, val, round(sum(count(*)) over (partition by image_id order by val)/sum(count(*)) over (partition by image_id), 9) cdf from {pixels} group by 1, 2")
def _(t):
    return sequence.cdf(sequence.histogram(t.pixels, ["image_id"]), ["image_id"]).select("image_id", "val", _r("cdf", 9).alias("cdf"))


@query("e6_dense_ids", "select image_id, box_id, row_number() over (order by image_id, box_id) id from {gt_boxes}")
def _(t):
    return sampling.dense_ids(t.gt_boxes.select("image_id", "box_id"), ["image_id", "box_id"])


@query("f1_natural_order", "select prefix, row_number() over (order by cast(regexp_extract(prefix, '([0-9]+)$', 1) as bigint)) place from (select concat('s', image_id) prefix from {rasters})")
def _(t):
    names = t.rasters.select(F.concat(F.lit("s"), "image_id").alias("prefix")).withColumn("k", geo.natural_key(F.col("prefix")))
    return sampling.dense_ids(names, ["k", "prefix"], "place").select("prefix", "place")


@query("f2_first_n", "select image_id, prefix from {rasters} order by image_id limit 10")
def _(t):
    return t.rasters.orderBy("image_id").limit(10).select("image_id", "prefix")


HB = "(((7 + box_id % 2147483647) % 2147483647) * 48271 + 11) % 2147483647"


@query("f3_random_n", f"select image_id, box_id from (select *, row_number() over (partition by image_id order by {HB}, box_id) r from {{gt_boxes}}) where r <= 100")
def _(t):
    return sampling.random_n(t.gt_boxes, ["image_id"], ["box_id"], 100, 7).select("image_id", "box_id")


@query("f4_stratified", f"with c as (select image_id, label from {{gt_boxes}} group by 1, 2 having floor(count(*)*0.05) > 0) select image_id, label, box_id from (select b.*, row_number() over (partition by image_id, label order by {HB}, box_id) r from {{gt_boxes}} b join c using (image_id, label)) where r <= 10")
def _(t):
    return sampling.stratified(t.gt_boxes, ["image_id"], "label", ["box_id"], 0.05, 10, 7).select("image_id", "label", "box_id")


@query("f5_points_in_boxes", "with p as (select image_id, xmin, ymin, xmax, ymax, ((((1 + box_id % 2147483647) % 2147483647 * 48271 + 11) % 2147483647 + i) % 2147483647 * 48271 + 11) % 2147483647 hx, ((((2 + box_id % 2147483647) % 2147483647 * 48271 + 11) % 2147483647 + i) % 2147483647 * 48271 + 11) % 2147483647 hy from {gt_boxes}, range(1,5) t(i)) select distinct image_id, cast(xmin + hx % (xmax-xmin+1) as int) x, cast(ymin + hy % (ymax-ymin+1) as int) y from p")
def _(t):
    return sampling.points_in_boxes(t.gt_boxes, 4)


@query("f6_bernoulli", f"select image_id, box_id from {{gt_boxes}} where {HB} < cast(trunc(0.1*2147483647) as bigint)")
def _(t):
    return sampling.bernoulli(t.gt_boxes, ["box_id"], 0.1, 7).select("image_id", "box_id")


@query("f7_random_pairs", "with d as (select image_id, row_number() over (order by image_id)-1 k, count(*) over () n from {rasters}), w as (select i draw, ((1 + i) % 2147483647 * 48271 + 11) % 2147483647 % (select count(*) from {rasters}) ka, ((2 + i) % 2147483647 * 48271 + 11) % 2147483647 hb from range(0,5000) t(i)) select draw, a.image_id id_a, b.image_id id_b from w join d a on a.k=w.ka join d b on b.k=(w.ka+1+hb%(a.n-1))%a.n")
def _(t):
    """5000 draws of two different images."""
    return sampling.random_pairs(t.rasters.select(F.col("image_id").alias("id")), 5000)


@query("f8_mixed_points", "with h as (select image_id, x, y, row_number() over (partition by image_id order by ((((0 + x::bigint) % 2147483647 * 48271 + 11) % 2147483647 + y) % 2147483647 * 48271 + 11) % 2147483647, x, y) r from {mask_pixels} where gt_label > 0), c as (select p.image_id, poly_id, cast(trunc((xmin*3+xmax*2+floor((xmin+xmax)/2))/6.0) as int) x, cast(trunc((ymin*3+ymax*2+ymax+10)/6.0) as int) y from {polys} p join {gt_boxes} b on b.image_id=p.image_id and b.box_id=p.poly_id where p.label in (2,4)) select image_id, x, y, 'pixel' kind from h where r <= 100 union all select image_id, x, y, 'centre' from c union all select image_id, cast(x + ((1 + poly_id % 2147483647) % 2147483647 * 48271 + 11) % 2147483647 % 65 - 32 as int), cast(y + ((2 + poly_id % 2147483647) % 2147483647 * 48271 + 11) % 2147483647 % 65 - 32 as int), 'jitter' from c")
def _(t):
    """Labelled pixels per block, centres of some polygons, and jittered centres."""
    px = sampling.random_n(t.mask_pixels.where("gt_label > 0"), ["image_id"], ["x", "y"], 100).select("image_id", "x", "y", F.lit("pixel").alias("kind"))
    b = geo.ring_box(geo.wkt_ring(F.col("wkt")))
    c = t.polys.where("label in (2, 4)").select("image_id", geo.trunc(b["xc"]).alias("x"), geo.trunc(b["yc"]).alias("y"), "poly_id")
    jit = lambda s: (geo.hashed(F.col("poly_id"), seed=s) % 65 - 32).cast("int")
    return px.unionByName(c.select("image_id", "x", "y", F.lit("centre").alias("kind"))).unionByName(c.select("image_id", (F.col("x") + jit(1)).alias("x"), (F.col("y") + jit(2)).alias("y"), F.lit("jitter").alias("kind")))


@query("g1_merged_truth")
def _(t):
    """Two truth sources united; boxes of a class that overlap by half count once."""
    a, b = t.gt_boxes.where("box_id % 3 < 2"), t.gt_boxes.where("box_id % 3 > 0").withColumn("box_id", -F.col("box_id"))
    both = a.unionByName(b).where("label in (1, 2, 3)").withColumn("score", F.lit(0.99))
    return graph.nms(both, 0.5, id_col="box_id").select("image_id", "label", "box_id")


@query("g2_name_difference", "select prefix from {rasters} where image_id not in (select image_id from {gt_boxes} where box_id % 5 = 0)")
def _(t):
    have = t.gt_boxes.where("box_id % 5 = 0").select("image_id")
    return t.rasters.join(have, "image_id", "left_anti").select("prefix")


@query("g3_distinct_points", "select distinct image_id, val from {pixels}")
def _(t):
    return t.pixels.select("image_id", "val").distinct()


@query("g4_fold_complement", "select image_id from {rasters} where image_id % 5 <> 2")
def _(t):
    val = t.rasters.where("image_id % 5 = 2").select("image_id")
    return t.rasters.select("image_id").join(val, "image_id", "left_anti")


@query("g5_candidates", "select image_id, det_id id, score from {detections} union all select image_id, box_id, 1.0 from {gt_boxes}")
def _(t):
    return t.detections.select("image_id", F.col("det_id").alias("id"), "score").unionByName(t.gt_boxes.select("image_id", F.col("box_id").alias("id"), F.lit(1.0).alias("score")))


@query("h1_split_80_20", f"with p as (select doc_id, truth, row_number() over (partition by truth order by (((7 + doc_id % 2147483647) % 2147483647) * 48271 + 11) % 2147483647, doc_id) r, count(*) over (partition by truth) n from {{cls_preds}}) select doc_id, truth, case when r <= ceil(n*8/10.0) then 'train' else 'val' end part from p")
def _(t):
    return sampling.split_80_20(t.cls_preds, ["truth"], ["doc_id"], 7).select("doc_id", "truth", "part")


@query("h2_split_80_10_10", f"with p as (select doc_id, truth, row_number() over (partition by truth order by (((7 + doc_id % 2147483647) % 2147483647) * 48271 + 11) % 2147483647, doc_id) r, count(*) over (partition by truth) n from {{cls_preds}}) select doc_id, truth, case when r <= floor(n*8/10.0) then 'train' when r <= floor(n*9/10.0) then 'val' else 'test' end part from p")
def _(t):
    return sampling.split_80_10_10(t.cls_preds, ["truth"], ["doc_id"], 7).select("doc_id", "truth", "part")


@query("h3_bernoulli_split", f"select image_id, box_id, case when {HB} < cast(trunc(0.8*2147483647) as bigint) then 'train' else 'val' end part from {{gt_boxes}}")
def _(t):
    return t.gt_boxes.select("image_id", "box_id", F.when(geo.hashed(F.col("box_id"), seed=7) < int(0.8 * sampling.M), "train").otherwise("val").alias("part"))


@query("h4_k_folds", "with d as (select image_id, row_number() over (order by image_id)-1 i, count(*) over () n from {rasters}) select image_id, cast(case when i < (n%5)*(n//5+1) then i//(n//5+1) else n%5 + (i-(n%5)*(n//5+1))//(n//5) end as int) fold from d")
def _(t):
    return sampling.k_folds(t.rasters.select("image_id"), ["image_id"], 5)


@query("h5_spatial_cut", "with a as (select image_id, max(xmax)-min(xmin) >= max(ymax)-min(ymin) ax, count(*) n from {gt_boxes} group by 1), v as (select b.image_id, box_id, n, ax, case when ax then floor((xmin+xmax)/2) else floor((ymin+ymax)/2) end v from {gt_boxes} b join a using (image_id)), o as (select *, row_number() over w - 1 i, lead(v) over w nx from v window w as (partition by image_id order by v, box_id)) select a.image_id, case when a.ax then 'x' else 'y' end axis, c.cut from a left join (select image_id, cast(floor((v+nx)/2) as bigint) cut from o where i = least(floor(n*8/10.0), n-2)) c using (image_id)")
def _(t):
    return sampling.spatial_cut(t.gt_boxes)


@query("h6_list_split", "select image_id, case when image_id % 10 = 3 then 'val' else 'train' end part from {rasters}")
def _(t):
    names = t.rasters.where("image_id % 10 = 3").select("prefix")
    val = t.rasters.join(names, "prefix", "left_semi").withColumn("part", F.lit("val"))
    return val.unionByName(t.rasters.join(names, "prefix", "left_anti").withColumn("part", F.lit("train"))).select("image_id", "part")


# ---- tiling, scenes, streams ----------------------------------------------------------------------------


@query("i1_grid", f"with g as ({A_GRID}) select image_id, cast(tile_id as int) tile_id, cast(x0 as int) x0, cast(y0 as int) y0, cast(w as int) w, cast(h as int) h from g")
def _(t):
    return tiling.grid(t.rasters).select("image_id", "tile_id", "x0", "y0", "w", "h")


@query("i3_named_retile", "select prefix || '_' || lpad((w.row+1)::varchar, length(greatest(ceil(width/1024.0), ceil(height/1024.0))::int::varchar)::int, '0') || '_' || lpad((c.col+1)::varchar, length(greatest(ceil(width/1024.0), ceil(height/1024.0))::int::varchar)::int, '0') as name, cast(w.row*ceil(width/1024.0)+c.col+1 as int) seq from {rasters}, range(0,8) c(col), range(0,8) w(row) where c.col < ceil(width/1024.0) and w.row < ceil(height/1024.0)")
def _(t):
    return tiling.named_retile(t.rasters).select("name", "seq")


@query("i4_multi_grid", "select image_id, s.size subsize, g.gap, count(*) tiles from {rasters}, (values (1024),(2048)) s(size), (values (128),(256)) g(gap), range(0,10) c(col), range(0,10) w(row) where c.col <= greatest(0, ceil((width-s.size)::double/(s.size-g.gap))) and w.row <= greatest(0, ceil((height-s.size)::double/(s.size-g.gap))) group by 1, 2, 3")
def _(t):
    return tiling.multi_grid(t.rasters, [(1024, 1.0), (2048, 0.5)], [128, 256]).groupBy("image_id", "subsize", "gap").agg(F.count("*").alias("tiles"))


@query("i5_jittered", "with p as (select image_id, box_id, i, xmin, ymin, width, height, case when i=0 then 0 else ((((3 + box_id % 2147483647) % 2147483647 * 48271 + 11) % 2147483647 + i) % 2147483647 * 48271 + 11) % 2147483647 % 101 - 50 end d from {gt_boxes} join {rasters} using (image_id), range(0,3) t(i)) select image_id, box_id, cast(i as int) copy, cast(greatest(1, xmin+d) as int) x0 from p")
def _(t):
    b = _with_raster(t, t.gt_boxes).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    d = F.when(F.col("copy") == 0, 0).otherwise(geo.hashed(F.col("box_id"), F.col("copy"), seed=3) % 101 - 50)
    w = geo.clamp_window(F.col("xmin") + d, F.col("ymin"), F.lit(256), F.lit(256), F.col("width"), F.col("height"))
    return b.select("image_id", "box_id", "copy", w["x0"].alias("x0"))


@query("i6_even_split", "with n as (select image_id, width, height, greatest(1, round_even(width/1024.0, 0)::int) nx, greatest(1, round_even(height/1024.0, 0)::int) ny from {rasters}) select image_id, cast(x.i as int) px, cast(y.i as int) py, cast(x.i*(width//nx)+least(x.i, width%nx) as int) x0, cast(width//nx + case when x.i < width%nx then 1 else 0 end as int) w, cast(height//ny + case when y.i < height%ny then 1 else 0 end as int) h from n, range(0,8) x(i), range(0,8) y(i) where x.i < nx and y.i < ny")
def _(t):
    w = t.rasters.select("image_id", F.lit(0).alias("win_id"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("w"), F.col("height").alias("h"))
    return tiling.split_evenly(w).select("image_id", "px", "py", "x0", "w", "h")


@query("i7_tile_to_scene", f"with {CLIP} select k.image_id, k.tile_id, box_id, cast(k.xmin+g.x0 as int) xmin, cast(k.ymax+g.y0 as int) ymax from k join g on g.image_id=k.image_id and g.tile_id=k.tile_id where kept")
def _(t):
    g = tiling.grid(t.rasters)
    return tiling.to_scene(spatial.tile_boxes(g, t.gt_boxes).where("kept"), g).select("image_id", "tile_id", "box_id", "xmin", "ymax")


@query("i8_shifted_grid", "select image_id, cast(c.col*896 as int) col0, cast(greatest(0, least(c.col*896, width-1024)) as int) x0, cast(greatest(0, least(w.row*896, height-1024)) as int) y0 from {rasters}, range(0,10) c(col), range(0,10) w(row) where c.col <= ceil((width-1024)/896.0) and w.row <= ceil((height-1024)/896.0)")
def _(t):
    return tiling.grid(t.rasters, 1024, 128, shift_in=True).select("image_id", (F.col("col") * 896).alias("col0"), "x0", "y0")


@query("i9_pyramid", "with l as (select image_id, k level, width >> k::int w0, height >> k::int h0 from {rasters}, range(0,4) t(k)) select image_id, cast(level as int) level, cast(ceil(w0/1024.0)*ceil(h0/1024.0) as bigint) tiles from l where w0 > 0 and h0 > 0")
def _(t):
    return tiling.pyramid(t.rasters, 3).groupBy("image_id", "level").agg(F.count("*").alias("tiles"))


@query("j6_rotated_boxes", "select image_id, box_id, ymin x90, width-xmax y90, width-xmax x180, height-ymax y180, height-ymax x270, xmin y270 from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    r = {d: geo.rotate_box(*[F.col(c) for c in (*spatial.BOX, "width", "height")], d) for d in (90, 180, 270)}
    return _with_raster(t, t.gt_boxes).select("image_id", "box_id", *[r[d][c].alias(f"{c[0]}{d}") for d in r for c in ("xmin", "ymin")])


@query("j7_mosaic_pixels", "select x, y, arg_max(val, image_id) val from {pixels} where val <> 0 group by 1, 2")
def _(t):
    return t.pixels.where("val <> 0").groupBy("x", "y").agg(F.max_by("val", "image_id").alias("val"))


@query("j8_histogram_match", "with h as (select image_id, val, count(*) n from {pixels} group by 1, 2), c as (select image_id, val, sum(n) over (partition by image_id order by val)/sum(n) over (partition by image_id) q from h), r as (select image_id ref, val v0, q c0, lead(val) over w v1, lead(q) over w c1, row_number() over w k from c window w as (partition by image_id order by val)) select p.image_id src, r.ref, s.val, round(case when s.q < c0 or c1 is null then v0 else v0+(v1-v0)*(s.q-c0)/(c1-c0) end, 6) matched from {rasters} p join c s on s.image_id=p.image_id join r on r.ref=p.image_id+1 where p.image_id < 19 and ((s.q >= c0 and (s.q < c1 or c1 is null)) or (k=1 and s.q < c0))")
def _(t):
    c = sequence.cdf(sequence.histogram(t.pixels, ["image_id"]), ["image_id"])
    pairs = t.rasters.where("image_id < 19").select(F.col("image_id").alias("src"), (F.col("image_id") + 1).alias("ref"))
    return sequence.match_table(c, pairs).withColumn("matched", _r("matched"))


@query("k1_nms")
def _(t):
    return graph.nms(t.detections).select("image_id", "label", "det_id", "score")


@query("k2_cluster_boxes")
def _(t):
    """All detections of class 2; the recursive SQL is too slow on whole tables, see the brute-force test."""
    return graph.cluster_boxes(t.detections.where("label = 2"))


@query("k3_scene_result")
def _(t):
    return graph.scene_result(t.detections)


@query("k4_truth_totals", "select label, count(*) n, count(distinct image_id) scenes from {gt_boxes} where label in (1,2,3) group by 1")
def _(t):
    return t.gt_boxes.where("label in (1, 2, 3)").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("scenes"))


@query("k5_misclassified", "select printf('%d_%d_%.2f', truth, doc_id, prob1) as name, truth, pred from {cls_preds} where truth <> pred")
def _(t):
    return t.cls_preds.where("truth <> pred").select(F.format_string("%d_%d_%.2f", "truth", "doc_id", "prob1").alias("name"), "truth", "pred")


@query("l1_tile_tasks", "select e.event_id job_id, r.image_id, 0 as block, 0 x0, 0 y0, width w, height h from {tile_results} e join {rasters} r on r.image_id = 1 + e.event_id % 50")
def _(t):
    req = t.tile_results.select(F.col("event_id").alias("job_id"), "ts", (1 + F.col("event_id") % 50).alias("k")).join(t.rasters.select(F.col("image_id").alias("k"), "prefix"), "k")
    return jobs.tasks(req, t.rasters).drop("ts")


@query("l2_progress", "with d as (select job_id, count(distinct block) k from {tile_results} group by 1) select job_id, cast(case when k >= 40 then 95 else k*(90//40) + least(k, 90%40) - 1 end as int) percent from d")
def _(t):
    totals = t.tile_results.select("job_id").distinct().withColumn("n", F.lit(40))
    return jobs.progress(t.tile_results, totals)


@query("l3_monitor", "select job_id, ts, 'request' topic, cast(null as int) percent from {tile_results} where block=0 union all select job_id, ts, 'result', n_dets from {tile_results}")
def _(t):
    return jobs.monitor(t.tile_results.where("block = 0"), t.tile_results.withColumn("percent", F.col("n_dets")))


@query("l4_tumbling_rates", "select job_id, time_bucket(interval '1 hour', ts) as start, cast(sum(n_dets) as bigint) n_dets, count(*) n_blocks from {tile_results} group by 1, 2")
def _(t):
    return jobs.rates(t.tile_results).drop("end")


@query("l4_session_rates", "with a as (select job_id, ts, n_dets, case when ts >= lag(ts) over w + interval '10 minutes' then 1 when lag(ts) over w is null then 1 else 0 end n from {tile_results} window w as (partition by job_id order by ts)), s as (select *, sum(n) over (partition by job_id order by ts rows unbounded preceding) g from a) select job_id, min(ts) as start, cast(sum(n_dets) as bigint) n_dets, count(*) n_blocks from s group by job_id, g")
def _(t):
    return jobs.rates(t.tile_results, "session").drop("end")


# ---- pixel jobs on tiles made from the pixel table --------------------------------------------------------


def _tiles(t: Tables) -> DataFrame:
    """One tile per image: the 64 columns of its pixel rows, in order."""
    rows = t.pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "val"))).alias("r"))
    text = F.array_join(F.transform("r", lambda p: F.lpad(F.hex(p["val"]), 2, "0")), "")
    one = rows.groupBy("image_id").agg(F.count("*").cast("int").alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", text.alias("s")))), lambda p: p["s"]), "").alias("s"))
    return one.select("image_id", F.lit(0).alias("tile_id"), F.lit(64).alias("w"), "h", F.lit(1).alias("bands"), F.unhex("s").alias("data"))


def _blocks(t: Tables, side: int) -> DataFrame:
    """The images of the pixel table in square blocks."""
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    rows = t.pixels.groupBy("image_id", at("x").alias("block_x"), at("y").alias("block_y"), "y").agg(F.array_sort(F.collect_list(F.struct("x", "val"))).alias("r"))
    text = F.array_join(F.transform("r", lambda p: F.lpad(F.hex(p["val"]), 2, "0")), "")
    one = rows.groupBy("image_id", "block_x", "block_y").agg(F.count("*").cast("int").alias("h"), F.max(F.size("r")).alias("w"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", text.alias("s")))), lambda p: p["s"]), "").alias("s"))
    return one.select("image_id", "block_x", "block_y", (F.col("block_x") * side).alias("x0"), (F.col("block_y") * side).alias("y0"), "w", "h", F.lit(1).alias("bands"), F.unhex("s").alias("data"))


def _bytes(col: str) -> Column:
    """Values of a binary column, as an array."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(col)), lambda i: F.conv(F.hex(F.substring(F.col(col), i, F.lit(1))), 16, 10).cast("int"))


@query("d11_tile_binary_statistics", "select image_id, min(val) lo, max(val) hi, count(*) filter (where val=0)/count(*) share0, count(*) filter (where val<>0) nonzero from {pixels} group by 1")
def _(t):
    ship(t.spark)
    s = _tiles(t).withColumn("s", raster.tile_stats(F.col("data"), F.col("w"), F.col("h"), F.col("bands")))
    return s.select("image_id", "s.lo", "s.hi", "s.share0", "s.nonzero")


@query("j1_cropped_windows", "select image_id, count(*) n, cast(sum(val) as bigint) total from {pixels} where x between 10 and 49 and y between 2 and 13 group by 1")
def _(t):
    ship(t.spark)
    blocks = _blocks(t, 16)
    win = t.pixels.select("image_id").distinct().select("image_id", F.lit(1).alias("win_id"), F.lit(10).alias("x0"), F.lit(2).alias("y0"), F.lit(40).alias("w"), F.lit(12).alias("h"))
    got = raster.crop_windows(win, blocks, 16).withColumn("v", F.explode(_bytes("data")))
    return got.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("j2_polygon_masks")
def _(t):
    ship(t.spark)
    m = raster.rasterise(t.polys, tiling.grid(t.rasters, 512, 0), 512)
    return m.select("image_id", "tile_id", "w", "h", F.sha2("data", 256).alias("digest"))


@query("j4_blanked_boxes", "select image_id, cast(sum(case when x between 5 and 19 and y between 3 and 9 then 0 else val end) as bigint) total from {pixels} group by 1")
def _(t):
    ship(t.spark)
    boxes = t.pixels.select("image_id").distinct().select("image_id", F.lit(0).alias("tile_id"), F.lit(5).alias("xmin"), F.lit(3).alias("ymin"), F.lit(20).alias("xmax"), F.lit(10).alias("ymax"))
    return raster.fill_boxes(_tiles(t), boxes, 0).withColumn("v", F.explode(_bytes("data"))).groupBy("image_id").agg(F.sum("v").alias("total"))


@query("j9_downscaled", "select image_id, cast(sum(val) as bigint) total from {pixels} join (select image_id, (max(y)+1)//4*4 hh from {pixels} group by 1) using (image_id) where x % 4 = 0 and y % 4 = 0 and y < hh group by 1")
def _(t):
    ship(t.spark)
    return raster.downscale(_tiles(t), 4).withColumn("v", F.explode(_bytes("data"))).groupBy("image_id").agg(F.sum("v").alias("total"))


@query("j11_palette")
def _(t):
    return raster.palette(t.pixels, 20)


@query("j12_paste_plan")
def _(t):
    ship(t.spark)
    bg = t.rasters.select(F.col("image_id").alias("bg_id"), F.col("width").alias("w"), F.col("height").alias("h"))
    fg = sampling.dense_ids(t.polys.select("poly_id"), ["poly_id"], "fg_id", 0).select("fg_id", (50 + F.col("fg_id") % 60).cast("int").alias("fw"), (40 + F.col("fg_id") % 70).cast("int").alias("fh"))
    return raster.paste_plan(bg, fg)


@query("j15_labelled_colours", "select distinct image_id, val from {mask_pixels} where gt_label > 0")
def _(t):
    return raster.labelled_colours(t.pixels, t.mask_pixels)


@query("j16_size_check", "select image_id, prefix from {rasters} where not (width = 4977 and height = 3613)")
def _(t):
    return t.rasters.where("not (width = 4977 and height = 3613)").select("image_id", "prefix")

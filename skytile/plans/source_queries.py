"""Queries of readers and writers: what is derived from the tables is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skytile.functions import geo
from skytile.operators import graph, sampling, spatial, tiling
from skytile.plans.queries import SQL, QUERIES, Tables, _r, _tiles, _with_raster, query
from skytile.session import scratch, ship, stored
from skytile.sources import annotations, images, sinks
from skytile.streaming import jobs, scenes

NAMES = ["1_large", "2_middle", "3_small", "4_insulator"]


def _roi(t: Tables, name: str) -> str:
    docs = annotations.roi_xml(_with_raster(t, t.gt_boxes), NAMES).join(t.rasters.select("image_id", "prefix"), "image_id")
    return annotations.write_by_prefix(docs, f"{scratch(t.spark)}/{name}")


@query("a1_roi_boxes", "select prefix, image_id, label, xmin+1 xmin, ymin+1 ymin, xmax+1 xmax, ymax+1 ymax from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    """Boxes written as map regions and read back in pixels, a pixel further (B2's round trip)."""
    rings = annotations.rings_to_pixels(annotations.read_roi_xml(t.spark, _roi(t, "roi")), t.rasters)
    return annotations.ring_boxes(rings).select("prefix", "image_id", "label", *spatial.BOX)


@query("a10_line_regions", "select prefix, label, 2 n_points, xmin+1 x0, ymin+1 y0, xmax+1 x1, ymax+1 y1 from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    """Lines written as line strings of regions and read back in pixels, a pixel further."""
    docs = annotations.roi_xml(_with_raster(t, t.gt_boxes), NAMES, is_line=True).join(t.rasters.select("image_id", "prefix"), "image_id")
    lines = annotations.read_roi_lines(t.spark, annotations.write_by_prefix(docs, f"{scratch(t.spark)}/lines"))
    lines = annotations.rings_to_pixels(lines, t.rasters)
    return lines.select("prefix", "label", F.size("ring").alias("n_points"), *[F.col("ring")[i][c].alias(f"{c}{i}") for i in (0, 1) for c in "xy"])


@query("a2_roi_polygons", "select prefix, label, 5 n_points, xmax+1 x1, ymin+1 y1, xmin+1 x3, ymax+1 y3, xmin+1 x4, ymin+1 y4 from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    rings = annotations.rings_to_pixels(annotations.read_roi_xml(t.spark, _roi(t, "roi")), t.rasters)
    return rings.select("prefix", "label", F.size("ring").alias("n_points"), *[F.col("ring")[i][c].alias(f"{c}{i}") for i in (1, 3, 4) for c in "xy"])


@query("a3_voc_boxes", "select prefix, 'c' || label as name, xmin, ymin, xmax, ymax from {gt_boxes} join {rasters} using (image_id) where box_id % 5 <> 0")
def _(t):
    """VOC documents in which every fifth object has no name; corners with fractions are cut to integers."""
    b = _with_raster(t, t.gt_boxes).withColumn("name", F.when(F.col("box_id") % 5 != 0, F.concat(F.lit("c"), "label"))).withColumn("file", F.concat("prefix", F.lit(".png")))
    b = b.select("image_id", "box_id", "file", "name", *[F.concat(F.col(c).cast("string"), F.lit(".7")).alias(c) for c in spatial.BOX])
    docs = annotations.voc_xml(b).join(t.rasters.select("image_id", "prefix"), "image_id")
    return annotations.read_voc_xml(t.spark, annotations.write_by_prefix(docs, f"{scratch(t.spark)}/voc"))


@query("a4_box_text", "select prefix, xmin::double xmin, ymin::double ymin, xmax::double xmax, ymax::double ymax, label::double as label from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    """Lines of boxes, a file for each scene whichever tasks hold its boxes, written and read back."""
    ship(t.spark)
    line = F.concat(F.concat_ws(" ", *spatial.BOX, "label"), F.lit("\n"))
    lines = _with_raster(t, t.gt_boxes).select(F.concat("prefix", F.lit(".txt")).alias("name"), F.lit(0).alias("position"), F.col("box_id").alias("sub"), line.alias("text"))
    got = annotations.read_box_text(t.spark, sinks.folders_of(sinks.write_texts(lines, f"{scratch(t.spark)}/text")))
    return got.select(F.regexp_replace("prefix", "%23", "#").alias("prefix"), *[F.col(c).cast("double").alias(c) for c in (*spatial.BOX, "label")])


@query("a5_scored_boxes", "select prefix, label, xmin+1 xmin, ymin+1 ymin, round((box_id % 1009)/1009.0, 6)::double score from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    """Documents and score files whose n-th score belongs to the document's n-th polygon."""
    scored = _with_raster(t, t.gt_boxes).withColumn("score", F.format_string("%.6f", (F.col("box_id") % 1009).cast("double") / 1009))
    files = scored.groupBy("prefix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "box_id", "score"))), lambda x: x["score"]), "\n").alias("value"))
    scores = annotations.read_scores(t.spark, annotations.write_by_prefix(files, f"{scratch(t.spark)}/scores"))
    rings = annotations.rings_to_pixels(annotations.read_roi_documents(t.spark, _roi(t, "roi")), t.rasters)
    return annotations.ring_boxes(annotations.with_scores(rings, scores)).select("prefix", "label", "xmin", "ymin", "score")


@query("a7_coco_boxes", "select prefix || '.jpg' file_name, box_id ann_id, label category_id, xmin::double xmin, ymin::double ymin, xmax::double xmax, ymax::double ymax from {gt_boxes} join {rasters} using (image_id)")
def _(t):
    """COCO documents, one an image, written and read back; boxes from corner and size to corners."""
    pics = t.rasters.select(F.col("image_id").alias("id"), F.concat("prefix", F.lit(".jpg")).alias("file_name"), "width", "height")
    anns = annotations.coco_annotations(t.gt_boxes.withColumn("ann_id", F.col("box_id")))
    kinds = t.spark.createDataFrame([(i, n, n) for i, n in enumerate(NAMES, 1)], "id int, name string, supercategory string")
    docs = annotations.coco_documents(pics, anns, kinds).join(t.rasters.select("image_id", "prefix"), "image_id")
    return annotations.read_coco(t.spark, annotations.write_by_prefix(docs, f"{scratch(t.spark)}/coco")).drop("image_id")


@query("a8_coco_tables", "select 'annotations' as name, count(*) n, cast(sum(box_id % 1000) as bigint) total from {gt_boxes} union all select 'images', count(*), cast(sum(image_id % 1000) as bigint) from {rasters}")
def _(t):
    """The tables of a COCO export written as JSON lines, counted after reading them again."""
    path = f"{scratch(t.spark)}/export"
    pics = t.rasters.select(F.col("image_id").alias("id"), F.concat("prefix", F.lit(".jpg")).alias("file_name"), "width", "height")
    kinds = t.spark.createDataFrame([(i, n) for i, n in enumerate(NAMES, 1)], "id int, name string")
    annotations.write_coco(pics, annotations.coco_annotations(t.gt_boxes.withColumn("ann_id", F.col("box_id"))), kinds, path)
    count = lambda name: t.spark.read.schema("id long").json(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("id").alias("n"), F.sum(F.col("id") % 1000).alias("total"))
    return count("annotations").unionByName(count("images"))


@query("a13_scene_list", "select prefix as name, row_number() over (order by image_id) as place from {rasters}")
def _(t):
    """A list with blanks and empty lines, in natural order."""
    path = f"{scratch(t.spark)}/list"
    t.rasters.select(F.concat(F.lit("  "), "prefix", F.lit(" \n ")).alias("value")).write.text(path)
    named = annotations.read_scene_list(t.spark, path).withColumn("key", geo.natural_key(F.col("name")))
    return sampling.dense_ids(named, ["key"], "place").select("name", "place")


def _pictures(t: Tables) -> DataFrame:
    return _tiles(t).withColumn("data", images.png(F.col("data"), F.col("w"), F.col("h"), F.col("bands")))


@query("a14_image_files", "select image_id::varchar prefix, 64 w, cast(max(y)+1 as int) h, 1 bands, cast(sum(val) as bigint) total from {pixels} group by image_id")
def _(t):
    """Pixel rows written as PNG files and read by the image source."""
    ship(t.spark)
    path = f"{scratch(t.spark)}/png"
    images.write_files(_pictures(t).select(F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "data"), path)
    got = images.read_images(t.spark, path)
    return got.select("prefix", "w", "h", "bands", F.aggregate(F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("a15_image_folders", "select 'k' || image_id % 3 as class, cast(image_id % 3 as int) class_index, image_id::varchar as name from {pixels} group by image_id")
def _(t):
    """PNG files in class folders; a class's index is its rank by name. A text file among them does not count."""
    ship(t.spark)
    path = f"{scratch(t.spark)}/classes"
    folder = F.concat(F.lit("k"), (F.col("image_id") % 3).cast("string"), F.lit("/"))
    files = _pictures(t).select(F.concat(folder, F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "data")
    images.write_files(files.unionByName(t.spark.createDataFrame([("k0/notes.txt", b"x")], "name string, data binary")), path)
    got = annotations.read_labelled_files(t.spark, path)
    return got.select("class", "class_index", annotations.base_name(F.col("path")).alias("name"))


# ---- suppression and what is made of it -------------------------------------------------------------------

INCLUSIVE = "(greatest(0, least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin)+1)*greatest(0, least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin)+1))"
SIZE = "(({0}.xmax-{0}.xmin+1)*({0}.ymax-{0}.ymin+1))"
OVERLAP = f"{INCLUSIVE}::double/({SIZE.format('a')}+{SIZE.format('b')}-{INCLUSIVE})"


def _greedy(source: str, threshold: float) -> str:
    """SQL parts that end in ``kept``: boxes of ``source`` (image_id, label, id, score, box) in rank order, each kept if no kept one overlaps it."""
    return f"""nb as (select *, row_number() over (partition by image_id, label order by score desc, id) i from ({source}) q),
ne as (select b.image_id, b.label, b.i, list(a.i) better from nb b join nb a on a.image_id=b.image_id and a.label=b.label and a.i < b.i and {OVERLAP} > {threshold} group by 1, 2, 3),
ns as (select nb.image_id, nb.label, nb.i, coalesce(ne.better, []) better from nb left join ne using (image_id, label, i)),
nr(image_id, label, i, kept) as (select image_id, label, i, [i] from ns where i = 1 union all select s.image_id, s.label, s.i, case when list_has_any(s.better, r.kept) then r.kept else list_append(r.kept, s.i) end from nr r join ns s on s.image_id=r.image_id and s.label=r.label and s.i = r.i+1),
nk as (select image_id, label, unnest(kept) i from (select *, row_number() over (partition by image_id, label order by i desc) q from nr) z where q = 1),
kept as (select nb.* from nb join nk using (image_id, label, i))"""


DETECTED = "select image_id, label, det_id id, score, xmin, ymin, xmax, ymax from {detections}"
TRUTH = "select image_id, label, box_id id, 0.99 score, xmin, ymin, xmax, ymax from {gt_boxes} where box_id % 3 < 2 and label in (1,2,3) union all select image_id, label, -box_id, 0.99, xmin, ymin, xmax, ymax from {gt_boxes} where box_id % 3 > 0 and label in (1,2,3)"


def sql_for(name: str, text: str) -> None:
    """SQL for a query that stands elsewhere."""
    from skytile.plans.fixtures import oracle

    assert name in QUERIES
    SQL[name] = oracle(text)


sql_for("k1_nms", f"with recursive {_greedy(DETECTED, 0.5)} select image_id, label, id det_id, score from kept")
sql_for("g1_merged_truth", f"with recursive {_greedy(TRUTH, 0.5)} select image_id, label, id box_id from kept")
sql_for("c11_scene_tp_table", f"with recursive {_greedy(DETECTED, 0.5)}, h as (select a.image_id, count(distinct a.id) n from kept a join {{gt_boxes}} b on a.image_id=b.image_id and a.label=2 and b.label=3 and least(a.xmax,b.xmax) > greatest(a.xmin,b.xmin) and least(a.ymax,b.ymax) > greatest(a.ymin,b.ymin) group by 1) select s.image_id, coalesce(g.n,0) num_gt, coalesce(p.n,0) num_pred, coalesce(h.n,0) num_tp from (select distinct image_id from {{gt_boxes}} where image_id in (select image_id from {{detections}})) s left join (select image_id, count(*) n from {{gt_boxes}} where label=3 group by 1) g using (image_id) left join (select image_id, count(*) n from kept where label=2 group by 1) p using (image_id) left join h using (image_id)")
CLUSTERS = """e as (select image_id, greatest(avg(xmax-xmin), avg(ymax-ymin))*1.5 eps from d group by 1), c as (select d.*, (xmin+xmax)/2.0 xc, (ymin+ymax)/2.0 yc, eps from d join e using (image_id)),
l as (select a.image_id, a.id a, b.id b from c a join c b on a.image_id=b.image_id and (a.xc-b.xc)*(a.xc-b.xc)+(a.yc-b.yc)*(a.yc-b.yc) <= a.eps*a.eps),
r(image_id, node, label) as (select image_id, id, id from d union select r.image_id, l.b, r.label from r join l on l.image_id=r.image_id and l.a=r.node),
m as (select image_id, node, min(label) label from r group by 1, 2), cl as (select m.image_id, m.label as cluster, min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax, max(score) score, count(*) members from m join d on d.image_id=m.image_id and d.id=m.node group by 1, 2)"""
sql_for("k2_cluster_boxes", "with recursive d as (select image_id, det_id id, xmin, ymin, xmax, ymax, score from {detections} where label = 2), " + CLUSTERS + " select * from cl")
BIG = DETECTED + " where xmax-xmin > 10 and ymax-ymin > 10"
sql_for("k3_scene_result", f"with recursive {_greedy(BIG, 0.5)}, d as (select * from kept where label = 2), " + CLUSTERS + ", t as (select image_id, least(avg(xmax-xmin), avg(ymax-ymin)) t from cl group by 1) select image_id, xmin, ymin, xmax, ymax, score, 0 as label from cl join t using (image_id) where xmax-xmin > 0.25*t and ymax-ymin > 0.25*t and score > 0.15 union all select image_id, xmin, ymin, xmax, ymax, score, 1 from kept where label = 3 and score > 0.5")


@query("k4_truth_cleanup", f"with recursive {_greedy(TRUTH, 0.5)} select prefix, label, xmin+1 xmin, ymin+1 ymin, xmax+1 xmax, ymax+1 ymax from kept join {{rasters}} using (image_id)")
def _(t):
    """Merged truth written as one ROI document a scene, as the clean-up job leaves it, and read back."""
    a, b = t.gt_boxes.where("box_id % 3 < 2"), t.gt_boxes.where("box_id % 3 > 0").withColumn("box_id", -F.col("box_id"))
    both = a.unionByName(b).where("label in (1, 2, 3)").withColumn("score", F.lit(0.99))
    clean = graph.nms(both, 0.5, id_col="box_id")
    docs = annotations.roi_xml(_with_raster(t, clean), NAMES).join(t.rasters.select("image_id", "prefix"), "image_id")
    rings = annotations.read_roi_xml(t.spark, annotations.write_by_prefix(docs, f"{scratch(t.spark)}/clean"))
    return annotations.ring_boxes(annotations.rings_to_pixels(rings, t.rasters)).select("prefix", "label", *spatial.BOX)


@query("l5_scenes_over_batches", SQL["k3_scene_result"])
def _(t):
    """Scenes assembled from a stream of four batches: blocks split between batches, rows that come again: what one batch gives."""
    ship(t.spark)
    path = scratch(t.spark)
    dets = t.detections.withColumn("block", F.pmod("det_id", F.lit(5)).cast("int"))
    # Every block of every scene reports, if only that it is empty.
    blocks = t.detections.select("image_id").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(4))))
    sizes = blocks.join(dets.groupBy("image_id", "block").agg(F.count("*").alias("block_dets")), ["image_id", "block"], "left").fillna(0, ["block_dets"])
    rows = stored(sizes.join(dets, ["image_id", "block"], "left"), "rows")
    half = F.pmod("det_id", F.lit(2))
    totals = blocks.groupBy("image_id").agg(F.count("*").alias("n"))
    for some in (F.expr("block in (0, 3)"), (F.col("block") == 1) & (half == 0), (F.col("block") < 2) | F.col("det_id").isNull(), F.expr("block in (2, 4, 1)")):
        rows.where(some).write.mode("append").parquet(f"{path}/in")
        # Each run goes on from the checkpoint of the one before.
        scenes.write_scenes(t.spark.readStream.schema(rows.schema).parquet(f"{path}/in"), totals, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return scenes.results(t.spark, f"{path}/out", "scenes").drop("batch_id")


@query("l4_sliding_rates", "select job_id, s.start, cast(sum(n_dets) as bigint) n_dets, count(*) n_blocks from (select job_id, n_dets, unnest([time_bucket(interval '15 minutes', ts), time_bucket(interval '15 minutes', ts) - interval '15 minutes', time_bucket(interval '15 minutes', ts) - interval '30 minutes', time_bucket(interval '15 minutes', ts) - interval '45 minutes']) as start from {tile_results}) s group by 1, 2")
def _(t):
    return jobs.rates(t.tile_results, "sliding").drop("end")

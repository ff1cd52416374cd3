"""Readers and writers of annotation files: ROI XML, VOC XML, box text, WKT, COCO, YOLO, CSV reports, image folders.

Every reader uses Spark's own sources, so files may lie in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skytile.functions.geo import box_ring, map_to_pixel, point, ring_wkt, wkt_ring

_LINES = "array<struct<Exterior:struct<LinearRing:struct<Coordinates:string>>>>"
ROI_SCHEMA = f"_name string, _color string, GeometryDef struct<CoordSysStr:string,Polygon:{_LINES},LineString:array<struct<Coordinates:string>>>"
ROI_FIELDS = ["_name:string", f"GeometryDef:struct<Polygon:{_LINES}>"]
VOC_SCHEMA = "filename string, object array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"
BOX_TEXT = "xmin float, ymin float, xmax float, ymax float, label float"


def base_name(path: Column) -> Column:
    # The last part first: a pattern over the whole path takes the square of its length, for every row.
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<!^)\.[^.]*$", "")


def _file_prefix(df: DataFrame) -> Column:
    """Whose file a row comes from: the ``prefix`` of a folder partitioned by it, else the file's base name."""
    return F.col("prefix").cast("string") if "prefix" in df.columns else base_name(F.input_file_name())


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _label(name: Column, labels: dict[str, int] | None) -> Column:
    first = F.element_at(F.split(name, "_"), 1)
    number = first.try_cast("double").cast("int")
    if not labels:
        return number
    return F.coalesce(number, F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[name])


def read_roi_xml(spark: SparkSession, path: str, labels: dict[str, int] | None = None) -> DataFrame:
    """(prefix, region, pos, label, ring): every polygon of every region in map coordinates."""
    r = spark.read.format("xml").option("rowTag", "Region").schema(ROI_SCHEMA).load(path)
    text = F.transform(F.coalesce("GeometryDef.Polygon", F.array().cast(_LINES)), lambda p: p["Exterior"]["LinearRing"]["Coordinates"])
    rows = r.select(_file_prefix(r).alias("prefix"), F.col("_name").alias("region"), F.posexplode(text).alias("pos", "text"))
    return _ringed(rows, labels)


def read_roi_lines(spark: SparkSession, path: str, labels: dict[str, int] | None = None) -> DataFrame:
    """As ``read_roi_xml``, for the line strings of the regions; ``ring`` is the line's points."""
    r = spark.read.format("xml").option("rowTag", "Region").schema(ROI_SCHEMA).load(path)
    text = F.transform(F.coalesce("GeometryDef.LineString", F.array().cast("array<struct<Coordinates:string>>")), lambda p: p["Coordinates"])
    return _ringed(r.select(_file_prefix(r).alias("prefix"), F.col("_name").alias("region"), F.posexplode(text).alias("pos", "text")), labels)


def read_roi_documents(spark: SparkSession, path: str, labels: dict[str, int] | None = None) -> DataFrame:
    """As ``read_roi_xml``, but ``pos`` counts the coordinate elements of a whole document, as score files do."""
    r = spark.read.format("xml").option("rowTag", "RegionsOfInterest").schema(f"Region array<struct<{', '.join(ROI_FIELDS)}>>").load(path)
    text = lambda g: F.transform(F.coalesce(g["GeometryDef"]["Polygon"], F.array().cast(_LINES)), lambda p: p["Exterior"]["LinearRing"]["Coordinates"])
    each = F.flatten(F.transform("Region", lambda g: F.transform(text(g), lambda x: F.struct(g["_name"].alias("region"), x.alias("text")))))
    rows = r.select(_file_prefix(r).alias("prefix"), F.posexplode(each).alias("pos", "e")).select("prefix", "e.region", "pos", "e.text")
    return _ringed(rows, labels)


def with_scores(rings: DataFrame, scores: DataFrame) -> DataFrame:
    """Rings of documents with the score of the same place in the side file, null where there is none."""
    return rings.join(scores, ["prefix", "pos"], "left")


def _ringed(rows: DataFrame, labels: dict[str, int] | None) -> DataFrame:
    v = F.filter(F.transform(F.split(F.trim("text"), r"\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    n = F.floor(F.size("v") / 2).cast("int")
    ring = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(F.get(F.col("v"), 2 * i), F.get(F.col("v"), 2 * i + 1))))
    return rows.withColumn("v", v).select("prefix", "region", "pos", _label(F.col("region"), labels).alias("label"), ring.alias("ring"))


def rings_to_pixels(rings: DataFrame, rasters: DataFrame) -> DataFrame:
    """Rings of (prefix, ...) in pixels of their raster."""
    j = rings.join(rasters.select("prefix", "image_id", *[f"gt{i}" for i in range(6)]), "prefix")
    to = lambda p: point(*map_to_pixel(p["x"], p["y"]))
    return j.withColumn("ring", F.transform("ring", to)).drop(*[f"gt{i}" for i in range(6)])


def ring_boxes(rings: DataFrame) -> DataFrame:
    """Boxes from the first and third point of each ring, as box regions write them."""
    at = lambda i, c: F.col("ring")[i][c].alias(("xmin", "ymin", "xmax", "ymax")[(0 if i == 0 else 2) + (c == "y")])
    return rings.select(*[c for c in rings.columns if c != "ring"], at(0, "x"), at(0, "y"), at(2, "x"), at(2, "y"))


def read_voc_xml(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, name, xmin, ymin, xmax, ymax); objects without a name are left out."""
    r = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).load(path)
    o = r.select(_file_prefix(r).alias("prefix"), F.explode("object").alias("o")).where("o.name is not null")
    return o.select("prefix", "o.name", *[F.col(f"o.bndbox.{c}").cast("double").cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def read_box_text(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.csv(path, sep=" ", schema=BOX_TEXT)
    return t.withColumn("prefix", _file_prefix(t))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, pos, score): the n-th line of a score file belongs to the n-th coordinate element."""
    t = spark.read.text(path, wholetext=True)
    t = t.select(_file_prefix(t).alias("prefix"), F.posexplode(F.split(_strip(F.col("value")), r"\s+")).alias("pos", "s"))
    return t.select("prefix", "pos", F.col("s").try_cast("double").alias("score"))


def parse_wkt(df: DataFrame, labels: dict[str, int], class_col: str = "class", wkt_col: str = "wkt") -> DataFrame:
    """Rows of known classes with ``label`` and ``ring``."""
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return df.withColumn("label", m[F.col(class_col)]).where("label is not null").withColumn("ring", wkt_ring(F.col(wkt_col)))


COCO_SCHEMA = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, categories array<struct<id:int,name:string,supercategory:string>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,area:bigint,iscrowd:int,bbox:array<double>,segmentation:array<array<double>>>>"


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, ann_id, category_id, xmin, ymin, xmax, ymax) of COCO documents."""
    d = spark.read.schema(COCO_SCHEMA).json(path, multiLine=True).withColumn("doc", F.input_file_name())
    images = d.select("doc", F.explode("images").alias("i")).select("doc", F.col("i.id").alias("image_id"), "i.file_name")
    b = F.col("a.bbox")
    anns = d.select("doc", F.explode("annotations").alias("a")).select("doc", "a.image_id", F.col("a.id").alias("ann_id"), "a.category_id", b[0].alias("xmin"), b[1].alias("ymin"), (b[0] + b[2]).alias("xmax"), (b[1] + b[3]).alias("ymax"))
    return anns.join(images, ["doc", "image_id"]).drop("doc")


def coco_annotations(boxes: DataFrame) -> DataFrame:
    """COCO annotation rows of boxes that carry ann_id and image_id: bbox xywh, rectangle segmentation, integer area."""
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    corners = F.array("xmin", "ymin", "xmax", "ymin", "xmax", "ymax", "xmin", "ymax")
    return boxes.select(F.col("ann_id").alias("id"), "image_id", F.col("label").alias("category_id"), (w * h).cast("int").alias("area"), F.lit(0).alias("iscrowd"), F.array("xmin", "ymin", w, h).alias("bbox"), F.array(corners).alias("segmentation"))


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """Three JSON-lines tables, written in parallel."""
    for name, df in (("images", images), ("annotations", annotations), ("categories", categories)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One nested document, for exports small enough for one row."""
    pack = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    one = lambda df, name: pack(df, name).withColumn("k", F.lit(1))
    d = one(images, "images").join(one(annotations, "annotations"), "k").join(one(categories, "categories"), "k")
    return d.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def coco_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(image_id, value): a COCO document for each image (id, ...), with its annotations and all categories."""
    pack = lambda df: F.array_sort(F.collect_list(F.struct(*df.columns)))
    own = annotations.groupBy("image_id").agg(pack(annotations).alias("annotations"))
    one = images.select(F.col("id").alias("image_id"), F.array(F.struct(*images.columns)).alias("images"))
    classes = categories.agg(pack(categories).alias("categories")).withColumn("k", F.lit(1))  # a row
    d = one.join(own, "image_id", "left").withColumn("k", F.lit(1)).join(classes, "k")
    return d.select("image_id", F.to_json(F.struct("images", F.coalesce("annotations", F.array().cast(own.schema["annotations"].dataType)).alias("annotations"), "categories")).alias("value"))


def voc_xml(boxes: DataFrame) -> DataFrame:
    """(image_id, value): a VOC document per image. boxes: image_id, box_id, file, name (null: an object without one), xmin.."""
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    corners = F.concat(*[tag(c, F.col(c).cast("string")) for c in ("xmin", "ymin", "xmax", "ymax")])
    item = tag("object", F.concat(F.coalesce(tag("name", F.col("name")), F.lit("")), tag("bndbox", corners)))
    per = boxes.groupBy("image_id", "file").agg(F.array_sort(F.collect_list(F.struct("box_id", item.alias("x")))).alias("s"))
    return per.select("image_id", tag("annotation", F.concat(tag("filename", F.col("file")), F.array_join(F.transform("s", lambda x: x["x"]), ""))).alias("value"))


def write_by_prefix(docs: DataFrame, path: str) -> str:
    """Write (prefix, value) as text in a folder for each prefix, which the readers know again."""
    docs.select("prefix", "value").write.partitionBy("prefix").text(path)
    return path


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """(file, value): a line per box, class from 0 and box relative to its tile. boxes: file, label, xmin.., w, h."""
    xc, yc = (F.col("xmin") + F.col("xmax")) / 2 / F.col("w"), (F.col("ymin") + F.col("ymax")) / 2 / F.col("h")
    bw, bh = (F.col("xmax") - F.col("xmin")) / F.col("w"), (F.col("ymax") - F.col("ymin")) / F.col("h")
    return boxes.select("file", F.format_string("%d %f %f %f %f", F.col("label") - 1, xc, yc, bw, bh).alias("value"))


def read_yolo(spark: SparkSession, path: str, size: int = 1024) -> DataFrame:
    """Boxes of YOLO lines in pixels of a square tile."""
    t = spark.read.csv(path, sep=" ", schema="cls int, xc double, yc double, w double, h double")
    t = t.withColumn("file", _file_prefix(t))
    px = {c: (F.col(c) * size).cast("int") for c in ("xc", "yc", "w", "h")}
    half = lambda c: F.floor(px[c] / 2).cast("int")
    return t.select("file", "cls", (px["xc"] - half("w")).alias("xmin"), (px["yc"] - half("h")).alias("ymin"), (px["xc"] + half("w")).alias("xmax"), (px["yc"] + half("h")).alias("ymax"))


def roi_xml(boxes: DataFrame, names: list[str], is_line: bool = False) -> DataFrame:
    """(image_id, value): an ROI document per image, a Region per class with any box. boxes carry gt0..gt5 and label from 1.

    With ``is_line`` a box is the line from its first to its last corner.
    """
    ring = box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    opening, closing = "<Polygon><Exterior><LinearRing><Coordinates>", "</Coordinates></LinearRing></Exterior></Polygon>"
    if is_line:
        ring, opening, closing = F.array(ring[0], ring[2]), "<LineString><Coordinates>", "</Coordinates></LineString>"
    text = F.array_join(F.transform(ring, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), " ")
    shape = F.concat(F.lit(opening), text, F.lit(closing))
    per = boxes.select("image_id", "label", F.struct("box_id", shape.alias("p")).alias("s")).groupBy("image_id", "label").agg(F.array_sort(F.collect_list("s")).alias("s"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("label"))
    region = F.concat(F.lit('<Region name="'), name, F.lit('"><GeometryDef>'), F.array_join(F.transform("s", lambda x: x["p"]), ""), F.lit("</GeometryDef></Region>"))
    doc = per.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label", region.alias("r")))).alias("r"))
    return doc.select("image_id", F.concat(F.lit("<RegionsOfInterest>"), F.array_join(F.transform("r", lambda x: x["r"]), ""), F.lit("</RegionsOfInterest>")).alias("value"))


#: Degrees of a pixel where a scene has no projection (fixed value).
NO_PROJECTION = 0.013888889


def map_geometry(boxes: DataFrame, projected: Column | None = None) -> DataFrame:
    """Boxes as map-coordinate WKT with their score (.999 where there is none); scenes that are not ``projected`` have scaled coordinates."""
    ring = box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    if projected is not None:
        ring = F.when(projected, ring).otherwise(F.transform(ring, lambda p: point(p["x"] * NO_PROJECTION, p["y"] * NO_PROJECTION)))
    score = F.col("score") if "score" in boxes.columns else F.lit(0.999)
    return boxes.select("image_id", "box_id", "label", ring_wkt(ring).alias("wkt"), F.coalesce(score, F.lit(0.999)).alias("score"))


def read_scene_list(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path).select(_strip(F.regexp_replace("value", "^﻿", "")).alias("name"))
    return t.where("name <> ''")


def tile_index(tiles: DataFrame) -> DataFrame:
    """basename;minx;maxx;miny;maxy lines' fields and the footprint. tiles: name, x0, y0, w, h, gt0, gt1, gt3, gt5."""
    minx, maxy = F.col("gt0") + F.col("x0") * F.col("gt1"), F.col("gt3") + F.col("y0") * F.col("gt5")
    maxx, miny = minx + F.col("w") * F.col("gt1"), maxy + F.col("h") * F.col("gt5")
    f = lambda c: F.format_string("%f", c)
    ring = F.array(point(minx, maxy), point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy))
    return tiles.select("name", f(minx).alias("minx"), f(maxx).alias("maxx"), f(miny).alias("miny"), f(maxy).alias("maxy"), ring_wkt(ring).alias("wkt"))


def read_labelled_files(spark: SparkSession, path: str) -> DataFrame:
    """``labelled_files`` of a folder of class folders; only the files' paths are read."""
    return labelled_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path"))


def labelled_files(files: DataFrame) -> DataFrame:
    """(path, class, class_index): class = folder, index = its rank among the folders' sorted names."""
    c = files.withColumn("class", F.element_at(F.split("path", "/"), -2)).where(F.lower("path").rlike(r"\.(jpe?g|png|bmp|tiff?)$"))
    names = c.select("class").distinct()
    ranks = names.agg(F.array_sort(F.collect_list("class")).alias("a")).select(F.posexplode("a").alias("class_index", "class"))  # a row per folder
    return c.join(ranks, "class").select("path", "class", "class_index")

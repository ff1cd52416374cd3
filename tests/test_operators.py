"""Hand-made cases and brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytile.functions import geo
from skytile.operators import evaluate, graph, raster, sampling, sequence, spatial, tiling
from skytile.sources import annotations
from skytile.streaming import jobs

BOXES = "image_id long, box_id long, xmin int, ymin int, xmax int, ymax int, label int"
DETS = "image_id long, det_id long, xmin int, ymin int, xmax int, ymax int, score double, label int"


def test_grid_cut_last(spark):
    r = spark.createDataFrame([(1, 2500, 1800), (2, 1000, 1000)], "image_id long, width int, height int")
    g = tiling.grid(r)
    one = [(x.x0, x.y0, x.w, x.h) for x in g.where("image_id = 1").orderBy("tile_id").collect()]
    assert [o[0] for o in one] == [0, 0, 0, 768, 768, 768, 1536, 1536, 1536] and one[-1] == (1536, 1536, 964, 264)
    assert [(x.x0, x.y0, x.w, x.h) for x in g.where("image_id = 2").collect()] == [(0, 0, 1000, 1000)]


def test_rotated_box(spark):
    one = spark.range(1)
    for d, want in ((90, (20, 50, 60, 90)), (180, (50, 140, 90, 180)), (270, (140, 10, 180, 50))):
        r = geo.rotate_box(*[F.lit(v) for v in (10, 20, 50, 60, 100, 200)], d)
        assert tuple(one.select(*[r[c] for c in ("xmin", "ymin", "xmax", "ymax")]).first()) == want


def test_iou_conventions(spark):
    a = spark.createDataFrame([(1, 1, 0, 0, 9, 9, 1)], BOXES)
    b = spark.createDataFrame([(1, 2, 5, 0, 14, 9, 1)], BOXES)
    assert spatial.overlap_pairs(a, b).first()["iou"] == pytest.approx(1 / 3)
    assert spatial.overlap_pairs(a, b, inclusive=False).first()["iou"] == pytest.approx(2 / 7)


def brute_nms(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        def iou(k):
            w, h = min(r[4], k[4]) - max(r[2], k[2]) + 1, min(r[5], k[5]) - max(r[3], k[3]) + 1
            i = max(0, w) * max(0, h)
            area = lambda b: (b[4] - b[2] + 1) * (b[5] - b[3] + 1)
            return i / (area(r) + area(k) - i)

        if all(iou(k) <= threshold for k in kept if (k[0], k[7]) == (r[0], r[7])):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


@pytest.mark.parametrize("seed", [0, 1])
def test_nms_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(300):
        x, y, w, h = rng.integers(0, 300), rng.integers(0, 300), rng.integers(10, 60), rng.integers(10, 60)
        rows.append((int(i % 2), i, int(x), int(y), int(x + w), int(y + h), float(rng.integers(0, 20)) / 20, int(i % 3 == 0)))
    got = {(r.image_id, r.det_id) for r in graph.nms(spark.createDataFrame(rows, DETS), 0.3).collect()}
    assert got == brute_nms(rows, 0.3)


def test_nms_chain_and_empty(spark):
    rows = [(1, 1, 0, 0, 99, 99, 0.9, 0), (1, 2, 30, 0, 129, 99, 0.8, 0), (1, 3, 60, 0, 159, 99, 0.7, 0)]
    assert {r.det_id for r in graph.nms(spark.createDataFrame(rows, DETS)).collect()} == {1, 3}
    assert graph.nms(spark.createDataFrame([], DETS)).count() == 0


def test_clusters_chain(spark):
    rows = [(1, i, i * 14, 0, i * 14 + 10, 10, 0.5 + i / 100, 2) for i in range(8)] + [(1, 99, 500, 500, 510, 510, 0.4, 2)]
    got = sorted((r.xmin, r.xmax, r.members) for r in graph.cluster_boxes(spark.createDataFrame(rows, DETS)).collect())
    assert got == [(0, 108, 8), (500, 510, 1)]


def test_average_precision_small():
    assert evaluate.interpolated_ap(np.array([1.0]), np.array([1.0])) == pytest.approx(0.995, abs=0.006)
    r, p = np.array([0.5, 0.5, 1.0]), np.array([1.0, 0.5, 2 / 3])
    # 1 up to a half (51 points, of which the last already is 2/3), then 2/3.
    assert evaluate.interpolated_ap(r, p) == pytest.approx(0.49 + (1 + 2 / 3) / 2 * 0.01 + 0.5 * 2 / 3, abs=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_average_precision_against_the_whole_curve(spark, seed):
    """The cut curve gives what all of its points give; running counts equal a plain loop, however the rows are dealt."""
    rng = np.random.default_rng(seed)
    n, n_gt = int(rng.integers(1, 3000)), int(rng.integers(1, 900))
    score = rng.integers(0, 50, n) / 50
    tp = (rng.random(n) < 0.3).astype(int)
    tp[np.cumsum(tp) > n_gt] = 0
    flags = spark.createDataFrame([(1, i, float(s), 0, int(t)) for i, (s, t) in enumerate(zip(score, tp))], "image_id long, det_id long, score double, label int, tp int").repartition(5)
    truth = spark.createDataFrame([(1, i, 1) for i in range(n_gt)] + [(1, -1, 2)], "image_id long, box_id long, label int")
    curve = evaluate.pr_curve(flags, truth)
    order = np.lexsort((np.arange(n), -score))
    hits = np.cumsum(tp[order])
    got = {r.det_id: (r.recall, r.precision) for r in curve.collect()}
    assert all(got[int(d)] == pytest.approx((h / n_gt, h / (i + 1))) for i, (d, h) in enumerate(zip(order, hits)))
    ap = {r.label: r.ap for r in evaluate.average_precision(curve, truth).collect()}
    assert ap == {0: pytest.approx(evaluate.interpolated_ap(hits / n_gt, hits / (np.arange(n) + 1)), abs=1e-9), 1: 0.0}


def test_best_f1_against_interpolation(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for label in (0, 1):
        n, n_gt = 400, 150
        score, tp = np.round(rng.random(n), 6), (rng.random(n) < 0.35).astype(int)
        rows += [(1, label * 1000 + i, float(s), label, int(t)) for i, (s, t) in enumerate(zip(score, tp))]
        o = np.argsort(-score, kind="stable")
        h = np.cumsum(tp[o])
        r, p, x = h / (n_gt + 1e-16), h / np.arange(1, n + 1), np.arange(1000) / 999
        # At a confidence: the last detection at or above it.
        k = np.searchsorted(-score[o], -(1 - x), "right")
        rr, pp = np.where(k > 0, r[k - 1], 0), np.where(k > 0, p[k - 1], 1)
        want.append((pp, rr, 2 * pp * rr / (pp + rr + 1e-16)))
    truth = spark.createDataFrame([(1, i, 1 + i % 2) for i in range(300)], "image_id long, box_id long, label int")
    flags = spark.createDataFrame(rows, "image_id long, det_id long, score double, label int, tp int")
    best = int(np.argmax((want[0][2] + want[1][2]) / 2))
    for r in evaluate.best_f1(evaluate.pr_curve(flags, truth)).collect():
        assert (r.precision, r.recall, r.f1) == pytest.approx(tuple(w[best] for w in want[r.label])) and r.conf == pytest.approx(1 - best / 999)


def test_unmatched_detections_only_count_in_images_with_a_match(spark):
    truth = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 1)], BOXES)
    dets = spark.createDataFrame([(1, 5, 100, 100, 110, 110, 0.9, 0)], DETS)
    assert [tuple(r) for r in evaluate.confusion(dets, truth, 4).collect()] == [(4, 0, 1)]


def test_islands(spark):
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 1, 0, 0, 1, 0, 1])], "k long, pos long, f int")
    assert sorted((r.before, r.after) for r in sequence.zero_islands(s, ["k"], "pos", "f").collect()) == [(1, 4), (4, 6)]


def test_folds_and_splits(spark):
    d = spark.range(12).withColumnRenamed("id", "image_id")
    sizes = [r["count"] for r in sampling.k_folds(d, ["image_id"], 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 3, 2, 2, 2]
    seven = spark.range(7).withColumn("c", F.lit(1))
    parts = {r["part"]: r["count"] for r in sampling.split_80_20(seven, ["c"], ["id"]).groupBy("part").count().collect()}
    assert parts == {"train": 6, "val": 1}


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_dense_ids_any_partitioning(spark, parts):
    d = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(parts)
    got = sampling.dense_ids(d, ["v"]).orderBy("v").collect()
    assert [r.id for r in got] == list(range(1, 1001))


def test_progress(spark):
    got = spark.range(4).select(jobs.percent_after(F.col("id"), F.lit(4)).alias("p"), "id").orderBy("id").collect()
    assert [r.p for r in got] == [22, 45, 67, 89]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", F.col("user_id").alias("job_id"), (F.col("event_id") % 40).cast("int").alias("block"), F.floor("value").cast("int").alias("n_dets"))
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.rates(stream, delay="3650 days").writeStream.outputMode("update").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("rates").groupBy("job_id", "start").agg(F.max("n_blocks").alias("n_blocks"))
    want = jobs.rates(src).select("job_id", "start", "n_blocks")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_scene_results_over_batches(spark, tmp_path):
    """A scene comes out once, in the batch of its last block, as if all of its rows had come at once; replays change nothing."""
    rows = [(i % 3, j, 100 * i + j, (x := (i * 37 + j * 91) % 400), (y := (i * 53 + j * 17) % 300), x + 40, y + 30, 0.5 + (i + j) % 5 / 10, 2 + (i + j) % 2) for i in range(60) for j in range(4)]
    schema = "image_id long, block int, " + DETS.removeprefix("image_id long, ")
    empty = (3, 0, *[None] * 7)
    totals = spark.createDataFrame([(0, 4), (1, 4), (2, 4), (3, 1), (4, 2)], "image_id long, n long")
    write = jobs.scene_results_to(str(tmp_path), totals)
    batches = [[r for r in rows if r[1] == 0 or (r[0] == 1 and r[1] < 3)], [r for r in rows if r[1] in (1, 2)] + [empty], [r for r in rows if r[1] == 3] + [r for r in rows if r[1] == 0]]
    for n in (0, 1, 1, 2, 0, 2):
        write(spark.createDataFrame(batches[n], schema), n)
    out = spark.read.parquet(str(tmp_path / "scenes"))
    whole = graph.scene_result(spark.createDataFrame([r for r in rows], schema).drop("block"))
    cols = whole.columns
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, whole.collect())) and out.select("batch_id").distinct().collect() == [(2,)]


def test_roi_xml_round_trip(spark, tmp_path):
    gt = {f"gt{i}": v for i, v in enumerate((100.0, 0.5, 0.0, 50.0, 0.0, -0.5))}
    b = spark.createDataFrame([(1, 1, 3, 4, 10, 20, 1), (1, 2, 30, 40, 60, 70, 2)], BOXES)
    for k, v in gt.items():
        b = b.withColumn(k, F.lit(v))
    annotations.roi_xml(b, ["1_tower", "2_insulator"]).select("value").coalesce(1).write.text(str(tmp_path / "s1.xml"))
    rings = annotations.read_roi_xml(spark, str(tmp_path / "s1.xml")).withColumn("prefix", F.lit("s1"))
    rasters = spark.createDataFrame([("s1", 1, *gt.values())], "prefix string, image_id long, " + ", ".join(f"{k} double" for k in gt))
    got = annotations.ring_boxes(annotations.rings_to_pixels(rings, rasters))
    assert sorted((r.label, r.xmin, r.ymin, r.xmax, r.ymax) for r in got.collect()) == [(1, 4, 5, 11, 21), (2, 31, 41, 61, 71)]


def test_voc_text_scores_yolo_coco(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><filename>a.png</filename><object><name>tower</name><bndbox><xmin>1.7</xmin><ymin>2</ymin><xmax>30</xmax><ymax>40</ymax></bndbox></object><object><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert [tuple(r) for r in annotations.read_voc_xml(spark, str(tmp_path / "a.xml")).collect()] == [("a", "tower", 1, 2, 30, 40)]
    (tmp_path / "b.txt").write_text("1 2 3 4 1\n5 6 7 8 2\n")
    assert annotations.read_box_text(spark, str(tmp_path / "b.txt")).count() == 2
    (tmp_path / "c.score").write_text("0.500000\n0.250000\n")
    assert [(r.pos, r.score) for r in annotations.read_scores(spark, str(tmp_path / "c.score")).collect()] == [(0, 0.5), (1, 0.25)]
    (tmp_path / "d.txt").write_text("0 0.5 0.5 0.25 0.125\n")
    assert tuple(annotations.read_yolo(spark, str(tmp_path / "d.txt")).first()) == ("d", 0, 384, 448, 640, 576)
    (tmp_path / "e.json").write_text('{"images":[{"id":1,"file_name":"x.jpg","width":9,"height":9}],"categories":[],"annotations":[{"id":7,"image_id":1,"category_id":2,"bbox":[1,2,3,4]}]}')
    r = annotations.read_coco(spark, str(tmp_path / "e.json")).first()
    assert (r.file_name, r.ann_id, r.xmin, r.ymax) == ("x.jpg", 7, 1.0, 6.0)


def test_labelled_files_and_scene_list(spark, tmp_path):
    f = spark.createDataFrame([("/d/b/1.jpg",), ("/d/a/2.png",), ("/d/a/3.txt",)], "path string")
    assert sorted((r["class"], r.class_index) for r in annotations.labelled_files(f).collect()) == [("a", 0), ("b", 1)]
    (tmp_path / "list.txt").write_text("﻿s10 \n\ns2\n", encoding="utf-8")
    assert [r.name for r in annotations.read_scene_list(spark, str(tmp_path / "list.txt")).orderBy(geo.natural_key(F.col("name"))).collect()] == ["s2", "s10"]


def _tile(a, i=1):
    return (i, 0, a.shape[1], a.shape[0], a.shape[2], bytearray(a.tobytes()))


TILE = "image_id long, tile_id int, w int, h int, bands int, data binary"


def test_four_turns_are_none(spark):
    a = np.random.default_rng(0).integers(0, 255, (6, 9, 3)).astype(np.uint8)
    t = spark.createDataFrame([_tile(a)], TILE)
    once = raster.rotate_tiles(t, 90).first()
    assert (once.w, once.h) == (6, 9) and bytes(once.data) == np.ascontiguousarray(np.rot90(a)).tobytes()
    for _ in range(4):
        t = raster.rotate_tiles(t, 90)
    assert bytes(t.first().data) == a.tobytes()


def test_mosaic_later_source_wins_but_for_nodata(spark):
    a, b = np.full((4, 4, 1), 5, np.uint8), np.full((4, 4, 1), 9, np.uint8)
    b[0, 0] = 0
    rows = [(1, 0, 0, 4, 4, 1, bytearray(a.tobytes())), (2, 2, 2, 4, 4, 1, bytearray(b.tobytes()))]
    m = raster.mosaic(spark.createDataFrame(rows, '`order` int, x0 int, y0 int, w int, h int, bands int, data binary'), 8, nodata=0).first()
    got = np.frombuffer(bytes(m.data), np.uint8).reshape(8, 8)
    assert got[2, 2] == 5 and got[3, 3] == 9 and got[1, 1] == 5 and got[7, 7] == 0


def test_polygon_fill_and_clip_area():
    mask = np.zeros((10, 10), np.uint8)
    raster.fill_polygon(mask, np.array([2, 7, 7, 2, 2]), np.array([3, 3, 6, 6, 3]), 1)
    assert mask.sum() == 24 and mask[3:7, 2:8].all()
    assert raster.clip_area(np.array([[0, 0], [4, 0], [4, 4], [0, 4]]), 2, 2, 6, 6) == pytest.approx(4)


def test_dice_of_hand_made_masks(spark):
    t = np.zeros((200, 200), int)
    p = t.copy()
    t[10:60, 10:60], p[20:60, 20:60] = 1, 1  # 2500 and 1600... overlap 1600
    p[60:85, 20:56] = 1  # 900 more
    rows = spark.createDataFrame([(1, int(a), int(b)) for a, b in zip(t.ravel(), p.ravel())], "image_id long, gt_label int, pred_label int")
    assert evaluate.dice(rows, [1]).first().dice == pytest.approx(0.64, abs=1e-6)


def test_paste_plan_without_overlap(spark):
    bg = spark.createDataFrame([(i, 300, 300) for i in range(20)], "bg_id long, w int, h int")
    fg = spark.createDataFrame([(i, 60, 50) for i in range(5)], "fg_id long, fw int, fh int")
    plan = raster.paste_plan(bg, fg).toPandas()
    for _, g in plan.groupby("bg_id"):
        g = list(g.itertuples())
        for i, a in enumerate(g):
            for b in g[:i]:
                assert min(a.x + a.fw, b.x + b.fw) - max(a.x, b.x) < 10 or min(a.y + a.fh, b.y + b.fh) - max(a.y, b.y) < 10


def brute_fill(h, w, xs, ys, value):
    """Scan line by scan line, edge by edge."""
    mask = np.zeros((h, w), np.uint8)
    n = len(xs)
    for y in range(h):
        cuts = []
        for i in range(n):
            x1, y1, x2, y2 = xs[i], ys[i], xs[(i + 1) % n], ys[(i + 1) % n]
            if (y1 <= y) != (y2 <= y):
                cuts.append(x1 + (y - y1) * (x2 - x1) / (y2 - y1))
            if y1 == y2 == y:
                for x in range(w):
                    if min(x1, x2) <= x <= max(x1, x2):
                        mask[y, x] = value
        cuts.sort()
        for a, b in zip(cuts[::2], cuts[1::2]):
            for x in range(w):
                if a <= x <= b:
                    mask[y, x] = value
    for x, y in zip(xs, ys):
        if 0 <= x < w and 0 <= y < h:
            mask[int(y), int(x)] = value
    return mask


@pytest.mark.parametrize("seed", range(60))
def test_polygon_fill_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 9))
    step = (1, 0.5, 0.01)[seed % 3]
    xs, ys = rng.integers(-10, 40, n) * step * 1.0, rng.integers(-10, 40, n) * step * 1.0
    mask = np.zeros((20, 30), np.uint8)
    raster.fill_polygon(mask, xs, ys, 3)
    assert (mask == brute_fill(20, 30, xs, ys, 3)).all()


def test_polygon_masks_of_tiles(spark):
    """Masks cut from tiles equal one mask drawn as a whole, higher labels last."""
    rng = np.random.default_rng(2)
    polys, whole = [], np.zeros((100, 90), np.uint8)
    for i in range(25):
        pts = rng.integers(0, 90, (int(rng.integers(3, 7)), 2))
        polys.append((1, i, 1 + i % 3, "POLYGON ((" + ",".join(f"{x} {y}" for x, y in [*pts, pts[0]]) + "))"))
    for _, _, label, wkt in sorted(polys, key=lambda p: (p[2], p[1])):
        pts = np.array([[float(v) for v in q.split()] for q in wkt[10:-2].split(",")])
        raster.fill_polygon(whole, pts[:, 0], pts[:, 1], label)
    tiles = tiling.grid(spark.createDataFrame([(1, 90, 100)], "image_id long, width int, height int"), 32, 0)
    got = raster.rasterise(spark.createDataFrame(polys, "image_id long, poly_id long, label int, wkt string"), tiles, 32).join(tiles.select("tile_id", "x0", "y0"), "tile_id").collect()
    for r in got:
        assert (np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w) == whole[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]).all()
    assert len(got) == 9


@pytest.mark.parametrize("largest", [30, 700])
def test_nearest_box_against_all_pairs(spark, largest):
    rng = np.random.default_rng(largest)
    rows = [(int(i % 2), i, (x := int(rng.integers(0, 7 * largest))), (y := int(rng.integers(0, 7 * largest))), x + int(rng.integers(0, largest)), y + int(rng.integers(0, largest)), 1) for i in range(150)]
    rows += [(0, 1000, 0, 0, 700, 700, 1), (0, 1001, 1500, 0, 2200, 700, 1)]
    got = {(r.image_id, r.box_id): (r.near_id, r.d2) for r in spatial.nearest_box(spark.createDataFrame(rows, BOXES)).collect()}
    want = {}
    for a in rows:
        d2, near, b = min((((a[2] + a[4] - b[2] - b[4]) / 2) ** 2 + ((a[3] + a[5] - b[3] - b[5]) / 2) ** 2, b[1], b) for b in rows if b[0] == a[0] and b[1] != a[1])
        if d2**0.5 < 3 * min(a[4] - a[2], b[4] - b[2]) and d2**0.5 < 3 * min(a[5] - a[3], b[5] - b[3]):
            want[a[0], a[1]] = (near, d2)
    assert got == want and got


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i % 2), i, (x := int(rng.integers(0, 500))), (y := int(rng.integers(0, 500))), x + int(rng.integers(5, 30)), y + int(rng.integers(5, 30)), float(rng.random()), 2) for i in range(160)]
    got = sorted(map(tuple, graph.cluster_boxes(spark.createDataFrame(rows, DETS)).collect()))
    want = []
    for image in (0, 1):
        own = [r for r in rows if r[0] == image]
        eps = 1.5 * max(np.mean([r[4] - r[2] for r in own]), np.mean([r[5] - r[3] for r in own]))
        label = {r[1]: r[1] for r in own}
        for _ in own:
            for a in own:
                for b in own:
                    if ((a[2] + a[4] - b[2] - b[4]) / 2) ** 2 + ((a[3] + a[5] - b[3] - b[5]) / 2) ** 2 <= eps**2:
                        label[a[1]] = label[b[1]] = min(label[a[1]], label[b[1]])
        for c in set(label.values()):
            m = [r for r in own if label[r[1]] == c]
            want.append((image, c, min(r[2] for r in m), min(r[3] for r in m), max(r[4] for r in m), max(r[5] for r in m), max(r[6] for r in m), len(m)))
    assert got == sorted(want)


def test_splits_of_one_large_class(spark):
    d = spark.range(5000).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.lit("a")).alias("c"), "id").repartition(9)
    got = sampling.numbered(d, ["c"], [geo.hashed(F.col("id")), "id"]).collect()
    for c, n in (("a", 4900), (None, 100)):
        own = [r for r in got if r.c == c]
        assert {r._n for r in own} == {n} and sorted(r._r for r in own) == list(range(1, n + 1))
    assert sampling.random_n(d.where("c is not null"), ["c"], ["id"], 1500).count() == 1500


def test_progress_of_batch_and_stream(spark, tmp_path):
    rows = [(j, b, "2024-01-01 00:00:00") for j in range(4) for b in range(j + 1)] * 2
    done = spark.createDataFrame(rows, "job_id long, block int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    totals = spark.createDataFrame([(j, 4) for j in range(4)], "job_id long, n long")
    want = [(0, 22), (1, 45), (2, 67), (3, 95)]
    assert sorted(map(tuple, jobs.progress(done, totals).collect())) == want
    assert (3, 100) in list(map(tuple, jobs.progress(done, totals, spark.createDataFrame([(3,)], "job_id long")).collect()))
    done.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(done.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.progress(stream, totals).writeStream.outputMode("update").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("progress").groupBy("job_id").agg(F.max("percent")).collect())) == want


def test_segment_tiles(spark):
    p = spark.createDataFrame([(1, 1, 0, 10.0, 10.0), (1, 1, 1, 130.0, 70.0)], "image_id long, line_id long, pos int, x double, y double")
    got = {(r.col, r.row) for r in spatial.segment_tiles(p, 64).collect()}
    assert got == {(0, 0), (1, 0), (1, 1), (2, 1)}


def test_six_places_round_the_exact_value(spark):
    """As C prints doubles, not their shortest decimals: near ties in both directions, exact ties, carries, signs."""
    rng = np.random.default_rng(5)
    near = [float(f"{w}.{n:06d}5") for w, n in zip(rng.integers(0, 5_000_000, 4000), rng.integers(0, 10**6, 4000))]
    exact = [k / 128 for k in range(1, 4000, 2)] + [0.9999996, 0.9999995, 12.9999999, 1e-9, 5e-7, 4.9999999e-7, 0.0, -0.0, 2.0**52 + 0.5, 3e15, 2.0**60, 1e-300]
    values = near + exact + [-v for v in near[:500] + exact] + rng.uniform(-4e8, 4e8, 2000).tolist()
    got = spark.createDataFrame([(values,)], "v array<double>").select(geo.six_places(F.col("v"))).first()[0]
    assert [(v, g) for v, g in zip(values, got) if g != "%.6f" % v] == []
    assert any(a != "%.6f" % v for v, a in zip(near, spark.createDataFrame([(v,) for v in near], "v double").select(F.format_string("%.6f", "v")).toPandas().iloc[:, 0]))
    ring = F.array(F.struct(F.lit(0.0078125).alias("x"), F.lit(near[0]).alias("y")))
    assert spark.range(1).select(geo.ring_wkt(ring)).first()[0] == "POLYGON ((0.007812 %.6f))" % near[0]

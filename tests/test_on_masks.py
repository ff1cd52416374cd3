"""Foregrounds on masks, by pixels; pixels of lines by distances."""

import numpy as np
from pyspark.sql import functions as F

from skytile.operators import raster, scene

MASKED = "image_id long, tile_id int, w int, h int, data binary, angles binary"


def test_places_boxes_and_pixels(spark):
    rng = np.random.default_rng(3)
    rows, masks = [], {}
    for t in range(6):
        mask = np.zeros((120, 160), np.uint8)
        mask[20:100, 30:130] = rng.random((80, 100)) < 0.05
        angle = np.full((120, 160), [0.0, np.pi / 2, 0.5, -1.0, np.pi, 2.0][t], np.float32)
        masks[t] = mask
        rows.append((1, t, 160, 120, bytearray(mask.tobytes()), bytearray(angle.astype("<f4").tobytes())))
    rows.append((1, 9, 160, 120, bytearray(120 * 160), None))
    fgs = []
    for i, (w, h) in enumerate([(20, 10), (14, 14), (9, 24)]):
        a = np.zeros((h, w, 4), np.uint8)
        a[2 : h - 2, 3 : w - 3] = 255  # all that is seen of it
        fgs.append((i, w, h, bytearray(a.tobytes())))
    tiles = spark.createDataFrame(rows, MASKED)
    fg = spark.createDataFrame(fgs, "fg_id long, fw int, fh int, data binary")
    boxes = spark.createDataFrame([(i, 7, 4, 3, 2, w - 3, h - 2) for i, w, h, _ in fgs], "fg_id long, box_id int, label int, xmin int, ymin int, xmax int, ymax int")
    plan = scene.masked_plan(tiles, fg, seed=5)
    placed = plan.collect()
    assert sorted(map(tuple, placed)) == sorted(map(tuple, scene.masked_plan(tiles.repartition(3), fg, seed=5).collect()))
    assert {p.tile_id for p in placed} == set(range(6)) and len(placed) > 15
    by_tile = {}
    for p in placed:
        assert 0 < p.x and 0 < p.y and p.x + p.fw < 159 and p.y + p.fh < 119 and masks[p.tile_id][p.y + p.fh // 2, p.x + p.fw // 2]
        for q in by_tile.setdefault(p.tile_id, []):
            assert p.x >= q.x + q.fw or q.x >= p.x + p.fw or p.y >= q.y + q.fh or q.y >= p.y + p.fh
        by_tile[p.tile_id].append(p)
    found = {(r.tile_id, r.slot): r for r in scene.moved_boxes(plan, boxes, fg).collect()}
    seen = 0
    for r in scene.turned_foregrounds(plan, fg).collect():
        a = np.frombuffer(bytes(r.data), np.uint8).reshape(r.fh, r.fw, 4)
        y, x = np.nonzero(a[..., 3])
        b = found[r.tile_id, r.slot]
        assert abs(r.x + x.min() - b.xmin) <= 1 and abs(r.x + x.max() + 1 - b.xmax) <= 1 and abs(r.y + y.min() - b.ymin) <= 1 and abs(r.y + y.max() + 1 - b.ymax) <= 1
        seen += 1
    assert seen == len(placed)
    # Blended into tiles, as placements of their own foregrounds.
    own = scene.turned_foregrounds(plan, fg).withColumn("bg_id", F.col("tile_id").cast("long")).withColumn("fg_id", F.col("tile_id") * 100 + F.col("slot"))
    bg = spark.createDataFrame([(t, 160, 120, bytearray(120 * 160 * 3)) for t in range(6)], "bg_id long, w int, h int, data binary")
    for r in raster.composed(bg, own.select("fg_id", "data"), own.select("bg_id", "slot", "fg_id", "x", "y", "fw", "fh")).collect():
        a = np.frombuffer(bytes(r.data), np.uint8).reshape(120, 160, 3)
        inside = np.zeros((120, 160), bool)
        for p in by_tile[r.bg_id]:
            inside[p.y : p.y + p.fh, p.x : p.x + p.fw] = True
        assert a.any() and not a[~inside].any()


def test_line_pixels_by_distance():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x1, y1, x2, y2 = rng.integers(-5, 40, 4).astype(float) if rng.random() < 0.7 else rng.uniform(-5, 40, 4)
        reach, x0, y0, size = float(rng.choice([0.5, 1, 2.5])), int(rng.integers(0, 10)), int(rng.integers(0, 10)), 24
        x, y, d2 = scene.line_pixels(x1, y1, x2, y2, x0, y0, size, reach)
        gy, gx = np.mgrid[y0 : y0 + size, x0 : x0 + size]
        length = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = np.clip(((gx - x1) * (x2 - x1) + (gy - y1) * (y2 - y1)) / length, 0, 1) if length else 0.0
        want = np.round((gx - x1 - t * (x2 - x1)) ** 2 + (gy - y1 - t * (y2 - y1)) ** 2, 9) <= reach * reach
        assert sorted(zip(x.tolist(), y.tolist())) == sorted(zip(gx[want].tolist(), gy[want].tolist()))

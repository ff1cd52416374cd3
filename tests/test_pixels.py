"""Pixel jobs against plain loops over pixels, and image files there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytile.operators import raster, scene, tiling
from skytile.session import scratch
from skytile.sources import images

TILE = "image_id long, tile_id int, w int, h int, bands int, data binary"


def tile(a, i=1, t=0):
    return (i, t, a.shape[1], a.shape[0], a.shape[2], bytearray(a.tobytes()))


def test_images_there_and_back(spark):
    rng = np.random.default_rng(1)
    pics = {f"p{i}": rng.integers(0, 256, (20 + i, 33, b), dtype=np.uint8) for i, b in enumerate((3, 1, 3))}
    rows = spark.createDataFrame([(n, a.shape[1], a.shape[0], a.shape[2], bytearray(a.tobytes())) for n, a in pics.items()], "name string, w int, h int, bands int, data binary")
    path = f"{scratch(spark)}/pics"
    files = rows.select(F.concat("name", F.lit(".png")).alias("name"), images.png(F.col("data"), F.col("w"), F.col("h"), F.col("bands")).alias("data"))
    images.write_files(files.unionByName(spark.createDataFrame([("broken.png", b"no image")], "name string, data binary")), path)
    got = images.read_images(spark, path)
    assert {r.prefix: bytes(r.data) for r in got.collect()} == {n: a.tobytes() for n, a in pics.items()}
    # Blocks of 16 pixels, from which windows are cut again.
    ids = spark.createDataFrame([(n, i) for i, n in enumerate(pics)], "prefix string, image_id long")
    blocks = images.as_blocks(got, ids, 16)
    win = spark.createDataFrame([(0, 7, 5, 3, 20, 15), (2, 8, 0, 0, 33, 22)], "image_id long, win_id long, x0 int, y0 int, w int, h int")
    cut = {r.win_id: bytes(r.data) for r in raster.crop_windows(win, blocks, 16).collect()}
    assert cut[7] == pics["p0"][3:18, 5:25].tobytes() and cut[8] == pics["p2"].tobytes()


def test_lines_against_distances(spark):
    rng = np.random.default_rng(3)
    tiles = [tile(rng.integers(0, 100, (40, 60, 3), dtype=np.uint8), 1, t) for t in range(5)]
    df = spark.createDataFrame(tiles, TILE)
    lines = raster.random_lines(df, seed=4)
    by_tile = {}
    for r in lines.collect():
        by_tile.setdefault(r.tile_id, {}).setdefault(r.line, []).append(r)
    assert all(2 <= len(ls) <= 4 and all(len(three) == 3 for three in ls.values()) for ls in by_tile.values()) and len(by_tile) == 5
    got = {r.tile_id: r for r in raster.draw_lines(df, lines).collect()}
    for _, t, w, h, _, data in tiles:
        yy, xx = np.mgrid[0:h, 0:w]
        mask = np.zeros((h, w), bool)
        for r in (r for three in by_tile[t].values() for r in three):
            d = np.array([r.x2 - r.x1, r.y2 - r.y1], float)
            k = np.clip(((xx - r.x1) * d[0] + (yy - r.y1) * d[1]) / (d @ d), 0, 1)
            mask |= (xx - r.x1 - k * d[0]) ** 2 + (yy - r.y1 - k * d[1]) ** 2 <= 1
        want = np.frombuffer(bytes(data), np.uint8).reshape(h, w, 3).copy()
        want[mask] = 200
        assert bytes(got[t].data) == want.tobytes() and got[t].drawn == mask.sum()


def test_composed_against_pixels(spark):
    rng = np.random.default_rng(5)
    bg = rng.integers(0, 256, (50, 70, 3), dtype=np.uint8)
    fg = [rng.integers(0, 256, (12, 20, 4), dtype=np.uint8), rng.integers(0, 256, (9, 11, 4), dtype=np.uint8)]
    b = spark.createDataFrame([(i, 70, 50, bytearray(bg.tobytes())) for i in range(4)], "bg_id long, w int, h int, data binary")
    f = spark.createDataFrame([(i, a.shape[1], a.shape[0], bytearray(a.tobytes())) for i, a in enumerate(fg)], "fg_id long, fw int, fh int, data binary")
    plan = raster.paste_plan(b.select("bg_id", "w", "h"), f)
    places = sorted(plan.collect(), key=lambda r: (r.bg_id, r.slot))
    assert places
    for r in raster.composed(b, f, plan).collect():
        want = bg.astype(float)
        for p in (p for p in places if p.bg_id == r.bg_id):
            a = fg[p.fg_id].astype(float)
            part = want[p.y : p.y + p.fh, p.x : p.x + p.fw]
            part[:] = part * (1 - a[..., 3:] / 255) + a[..., :3] * (a[..., 3:] / 255)
        assert bytes(r.data) == want.astype(np.uint8).tobytes()


@pytest.mark.parametrize("degrees", [30, 90, 137])
def test_turned_windows_by_sampling(spark, degrees):
    rng = np.random.default_rng(degrees)
    rows = [(i, int(x := rng.integers(0, 150)), int(y := rng.integers(0, 150)), int(x + rng.integers(5, 60)), int(y + rng.integers(5, 60)), 40, 50, 80, 60) for i in range(60)]
    df = spark.createDataFrame(rows, "box_id long, xmin int, ymin int, xmax int, ymax int, x0 int, y0 int, w int, h int")
    got = {r.box_id: r for r in raster.rotated_windows(df, F.lit(degrees)).collect()}
    t = np.deg2rad(degrees)
    for i, xmin, ymin, xmax, ymax, x0, y0, w, h in rows:
        # Points of the box in the turned frame: there the window is a rectangle.
        px, py = np.meshgrid(np.linspace(xmin, xmax, 201)[:-1] + (xmax - xmin) / 400, np.linspace(ymin, ymax, 201)[:-1] + (ymax - ymin) / 400)
        cx, cy = px - x0 - w / 2, py - y0 - h / 2
        u, v = cx * np.cos(t) + cy * np.sin(t) + w / 2, -cx * np.sin(t) + cy * np.cos(t) + h / 2
        share = ((u >= 0) & (u <= w) & (v >= 0) & (v <= h)).mean()
        if abs(share - 0.5) > 0.02:
            assert (i in got) == (share > 0.5)
        if i in got:
            assert abs(got[i].rxmin - np.clip(u.min(), 0, w - 1)) < 1 and abs(got[i].rymax - np.clip(v.max(), 0, h - 1)) < 1


@pytest.mark.parametrize("factor", [2, 3, 4])
def test_cubic_downscale(spark, factor):
    flat, ramp = np.full((24, 36, 3), 77, np.uint8), np.tile(np.arange(36, dtype=np.uint8)[None, :, None] * 5, (24, 1, 1))
    for a in (flat, ramp):
        r = raster.downscale(spark.createDataFrame([tile(a)], TILE), factor, "cubic").first()
        got = np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w, a.shape[2])
        assert got.shape[:2] == (24 // factor, 36 // factor)
        centres = (np.arange(r.w) + 0.5) * factor - 0.5
        want = np.full(r.w, 77) if a is flat else centres * 5
        assert (abs(got[:, 3:-3, 0] - want[3:-3]) <= 1).all()  # a ramp stays one, but for borders


def test_palette_of_colours(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[10, 10, 200], [200, 30, 30], [250, 250, 250]])
    rows = [tuple(int(v) for v in np.clip(centres[i % 3] + rng.integers(-4, 5, 3), 0, 255)) for i in range(600)]
    px = spark.createDataFrame(rows, "b int, g int, r int")
    found = raster.palette(px, 3, channels=["b", "g", "r"])
    assert sorted([round(v / 10) * 10 for v in r.centre] for r in found.collect()) == [[10, 10, 200], [200, 30, 30]]  # white is left out
    out = raster.recoloured(px, found, [[1, 2, 3], [4, 5, 6], [7, 8, 9]], ["b", "g", "r"]).where("g < 100").groupBy("cluster").agg(F.count_distinct("colour").alias("n"), F.max(F.abs(F.col("b") - 10)).alias("far")).collect()
    assert len(out) == 2 and all(r.n == 1 for r in out) and sorted(r.far < 9 for r in out) == [False, True]


def test_synthetic_scene(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(1, 190, (96, 96, 3), dtype=np.uint8)
    grid = tiling.grid(spark.createDataFrame([(1, 96, 96)], "image_id long, width int, height int"), 32, 0)
    tiles = spark.createDataFrame([(1, r.tile_id, r.col, r.row, r.x0, r.y0, 32, 32, 3, bytearray(np.ascontiguousarray(a[r.y0 : r.y0 + 32, r.x0 : r.x0 + 32]).tobytes())) for r in grid.collect()], "image_id long, tile_id int, col int, row int, x0 int, y0 int, w int, h int, bands int, data binary")
    points = spark.createDataFrame([(1, 1, 0, 2.0, 40.0), (1, 1, 1, 50.0, 40.0), (1, 2, 0, 0.0, 0.0), (1, 2, 1, 90.0, 90.0)], "image_id long, line_id long, pos int, x double, y double")
    fg = spark.createDataFrame([(0, 6, 5, bytearray(np.full((5, 6, 4), 255, np.uint8).tobytes()))], "fg_id long, fw int, fh int, data binary")
    whole, touched = scene.synthetic_scene(tiles, points, fg, 32, 96, least=1)
    w, t = (np.frombuffer(bytes(m.first().data), np.uint8).reshape(96, 96, 3) for m in (whole, touched))
    own = np.zeros((96, 96), bool)
    own[32:64, :64] = True  # the first polyline alone is drawn, in the two tiles that it crosses
    assert (w[~own] == a[~own]).all() and (t[~own] == 0).all() and (t[own] == w[own]).all()
    changed = (w != a).any(2)
    white, line = (w == 255).all(2), (w == 200).all(2)
    assert (changed == (white | line)).all() and 30 <= white.sum() <= 120 and line[40, 3:50].sum() + white[40, 3:50].sum() == 47


def test_background_and_parent_boxes(spark):
    a = np.zeros((20, 30, 1), np.uint8)
    a[:, :15, 0] = np.arange(1, 16)
    blocks = spark.createDataFrame([(1, 0, 0, 0, 0, 30, 20, 1, bytearray(a.tobytes()))], "image_id long, block_x int, block_y int, x0 int, y0 int, w int, h int, bands int, data binary")
    win = spark.createDataFrame([(1, i, x, y, 5, 5) for i, (x, y) in enumerate([(0, 0), (12, 0), (13, 8), (20, 0), (8, 14), (0, 14)])], "image_id long, win_id long, x0 int, y0 int, w int, h int")
    boxes = spark.createDataFrame([(1, 1, 0, 0, 3, 3)], "image_id long, box_id long, xmin int, ymin int, xmax int, ymax int")
    region = spark.createDataFrame([(1, 1, 1, "POLYGON ((9 16,11 16,11 18,9 16))")], "image_id long, poly_id long, label int, wkt string")
    got = {r.win_id for r in raster.background_windows(win, boxes, region, blocks, 64).collect()}
    assert got == {1, 5}  # 0 meets a box, 2 is mostly zero, 3 is constant, 4 meets the region
    t = spark.createDataFrame([tile(a)], TILE)
    parts = lambda *p: spark.createDataFrame([(1, 0, i, *b, 2) for i, b in enumerate(p)], "image_id long, tile_id int, box_id long, xmin int, ymin int, xmax int, ymax int, label int")
    one = raster.parent_boxes(t, parts((2, 3, 8, 9), (9, 12, 14, 19))).first()
    assert (one.xmin, one.ymin, one.xmax, one.ymax, one.label) == (0, 0, 19, 19, 1)
    assert raster.parent_boxes(t, parts((2, 3, 8, 9), (14, 3, 20, 9))).count() == 0

"""Pieces of pixels against plain loops: windows over blocks, mosaics, pyramids, turned windows, clipped areas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytile.operators import pieces, raster

BLOCK = "image_id long, block_x int, block_y int, x0 int, y0 int, w int, h int, bands int, data binary"
WIN = "image_id long, win_id long, x0 int, y0 int, w int, h int"
SOURCE = "`order` long, x0 int, y0 int, w int, h int, bands int, data binary"


def scene(seed, h, w, bands):
    return np.random.default_rng(seed).integers(0, 256, (h, w, bands), dtype=np.uint8)


def blocks_of(images, side):
    return [
        (i, x // side, y // side, x, y, (p := a[y : y + side, x : x + side]).shape[1], p.shape[0], a.shape[2], bytearray(p.tobytes()))
        for i, a in images.items() for y in range(0, a.shape[0], side) for x in range(0, a.shape[1], side)
    ]


def test_windows_take_only_their_pieces(spark):
    images = {0: scene(0, 70, 90, 3), 1: scene(1, 33, 40, 3)}
    blocks = spark.createDataFrame(blocks_of(images, 32), BLOCK)
    rng = np.random.default_rng(5)
    wins = [(int(i), n, int(rng.integers(-5, 60)), int(rng.integers(-5, 40)), int(rng.integers(1, 50)), int(rng.integers(1, 50))) for n, i in enumerate(rng.integers(0, 2, 60))]
    wins += [(0, 100, 0, 0, 90, 70), (0, 101, 5, 5, 0, 9), (7, 102, 0, 0, 5, 5), (0, 103, 500, 500, 5, 5)]
    df = spark.createDataFrame(wins, WIN)
    got = {r.win_id: r for r in raster.crop_windows(df, blocks, 32).collect()}
    seen = 0
    for i, n, x, y, w, h in wins:
        want = np.zeros((h, w, 3), np.uint8)
        for v in range(h):
            for u in range(w):
                if i in images and 0 <= y + v < images[i].shape[0] and 0 <= x + u < images[i].shape[1]:
                    want[v, u] = images[i][y + v, x + u]
        if n in got:
            assert bytes(got[n].data) == want.tobytes() and (got[n].w, got[n].h) == (w, h)
            seen += 1
        else:
            assert not want.any()
    assert seen > 40
    # What is shuffled are the windows' own pixels.
    moved = pieces.window_pieces(df, blocks, 32).agg(F.sum(F.octet_length("data"))).first()[0]
    assert moved <= sum(w * h * 3 for *_, w, h in wins)


def test_many_windows_of_one_block(spark, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOWS", 4)
    a = scene(2, 16, 16, 1)
    wins = [(0, n, n % 7, n % 5, 6, 6) for n in range(50)]
    got = {r.win_id: bytes(r.data) for r in raster.crop_windows(spark.createDataFrame(wins, WIN), spark.createDataFrame(blocks_of({0: a}, 16), BLOCK), 16, pad_to=8, swap=True).collect()}
    for _, n, x, y, w, h in wins:
        want = np.zeros((8, 8, 1), np.uint8)
        want[:6, :6] = a[y : y + 6, x : x + 6]
        assert got[n] == want.tobytes()


@pytest.mark.parametrize("nodata", [None, 0, 7])
@pytest.mark.parametrize("held", [1, 1 << 20])
def test_mosaic_in_any_grouping(spark, nodata, held):
    rng = np.random.default_rng(9)
    rows, want, size = [], {}, 16
    for order in rng.permutation(40).tolist():
        x, y, w, h = int(rng.integers(-10, 40)), int(rng.integers(-10, 40)), int(rng.integers(1, 30)), int(rng.integers(1, 30))
        a = rng.integers(0, 9, (h, w, 2), dtype=np.uint8)
        rows.append((order, x, y, w, h, 2, bytearray(a.tobytes())))
    for order, x, y, w, h, _, data in sorted(rows):
        a = np.frombuffer(bytes(data), np.uint8).reshape(h, w, 2)
        for v in range(h):
            for u in range(w):
                tile = want.setdefault(((x + u) // size, (y + v) // size), np.full((size, size, 2), nodata or 0, np.uint8))
                for b in range(2):
                    if a[v, u, b] != nodata:
                        tile[(y + v) % size, (x + u) % size, b] = a[v, u, b]
    df = spark.createDataFrame(rows, SOURCE).repartition(3)
    got = {(r.tx, r.ty): bytes(r.data) for r in pieces.mosaic(df, size, nodata, held_bytes=held).collect()}
    assert got == {k: v.tobytes() for k, v in want.items()}
    moved = pieces.mosaic_pieces(df, size, nodata, held_bytes=held).agg(F.sum(F.octet_length("data") + F.coalesce(F.octet_length("which"), F.lit(0)))).first()[0]
    assert moved <= sum(len(r[6]) for r in rows)


def test_mosaic_ties_and_layers(spark):
    a, b = np.full((4, 4, 1), 5, np.uint8), np.full((4, 4, 1), 9, np.uint8)
    rows = [(3, 0, 0, 4, 4, 1, bytearray(a.tobytes())), (3, 2, 2, 4, 4, 1, bytearray(b.tobytes())), (8, 1, 1, 4, 4, 1, bytearray(a.tobytes()))]
    m = np.frombuffer(bytes(pieces.mosaic(spark.createDataFrame(rows[:2], SOURCE), 8).first().data), np.uint8).reshape(8, 8)
    assert m[3, 3] == 9 and m[0, 0] == 5 and m[7, 7] == 0
    got = {r.band: np.frombuffer(bytes(r.data), np.uint8).reshape(8, 8) for r in pieces.stacked(spark.createDataFrame(rows, SOURCE), 8).collect()}
    assert sorted(got) == [0, 1] and got[0][5, 5] == 9 and got[1][5, 5] == 0 and got[1][1, 1] == 5
    assert pieces.mosaic(spark.createDataFrame([], SOURCE), 8).count() == 0


@pytest.mark.parametrize("how", ["mean", "near"])
def test_pyramid(spark, how):
    images = {0: scene(3, 53, 71, 3), 5: scene(4, 8, 9, 3)}
    tiles = spark.createDataFrame(blocks_of(images, 8), BLOCK).withColumnsRenamed({"block_x": "tx", "block_y": "ty"})
    got = {}
    for r in pieces.pyramid_pixels(tiles, 4, 8, how).collect():
        got[r.level, r.image_id, r.tx, r.ty] = np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w, r.bands)
    count = 0
    for i, a in images.items():
        for level in range(5):
            if level:
                h, w = a.shape[0] // 2, a.shape[1] // 2
                up = np.zeros((h, w, 3), np.uint8)
                for y in range(h):
                    for x in range(w):
                        four = a[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].astype(float)
                        up[y, x] = np.rint(four.mean((0, 1))) if how == "mean" else four[1, 1]
                a = up
            for y in range(0, a.shape[0], 8):
                for x in range(0, a.shape[1], 8):
                    assert (got[level, i, x // 8, y // 8] == a[y : y + 8, x : x + 8]).all()
                    count += 1
    assert count == len(got)


@pytest.mark.parametrize("how", ["near", "linear"])
@pytest.mark.parametrize("degrees", [0, 30, 90, 180, 270, 137.5])
def test_turned_pixels(spark, how, degrees):
    a = scene(6, 60, 80, 3)
    wins = [(0, 1, 20, 15, 24, 16, degrees), (0, 2, -3, 40, 21, 30, degrees)]
    df = spark.createDataFrame([(*w[:6], float(w[6])) for w in wins], WIN + ", degrees double")
    got = {r.win_id: np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w, 3) for r in pieces.turned_pixels(df, spark.createDataFrame(blocks_of({0: a}, 32), BLOCK), 32, how).collect()}
    at = lambda x, y: a[y, x].astype(float) if 0 <= x < 80 and 0 <= y < 60 else np.zeros(3)
    t = np.deg2rad(degrees)
    for _, n, x0, y0, w, h, _ in wins:
        for v in range(h):
            for u in range(w):
                p, q = u + 0.5 - w / 2, v + 0.5 - h / 2
                x, y = round(x0 + w / 2 + np.cos(t) * p - np.sin(t) * q, 9), round(y0 + h / 2 + np.sin(t) * p + np.cos(t) * q, 9)
                if how == "near":
                    want = at(int(np.floor(x)), int(np.floor(y)))
                else:
                    i, j = int(np.floor(x - 0.5)), int(np.floor(y - 0.5))
                    fx, fy = x - 0.5 - i, y - 0.5 - j
                    want = np.floor(np.round(at(i, j) * (1 - fx) * (1 - fy) + at(i + 1, j) * fx * (1 - fy) + at(i, j + 1) * (1 - fx) * fy + at(i + 1, j + 1) * fx * fy, 6) + 0.5)
                assert (got[n][v, u] == want).all()
    if degrees == 90:
        assert (got[1] == np.rot90(a[11:35, 24:40])).all()


def test_turned_boxes_and_pixels_share_a_frame(spark):
    """A bright box drawn into the scene is found at its own turned place."""
    a = np.zeros((100, 100, 1), np.uint8)
    a[40:52, 44:60] = 255
    df = spark.createDataFrame([(0, 1, 20, 20, 60, 60, 30.0)], WIN + ", degrees double")
    w = pieces.turned_pixels(df, spark.createDataFrame(blocks_of({0: a}, 64), BLOCK), 64).first()
    y, x = np.nonzero(np.frombuffer(bytes(w.data), np.uint8).reshape(60, 60))
    pairs = spark.createDataFrame([(44, 40, 60, 52, 20, 20, 60, 60)], "xmin int, ymin int, xmax int, ymax int, x0 int, y0 int, w int, h int")
    r = raster.rotated_windows(pairs, F.lit(30)).first()
    assert abs(x.min() - r.rxmin) < 1.5 and abs(x.max() + 1 - r.rxmax) < 1.5 and abs(y.min() - r.rymin) < 1.5 and abs(y.max() + 1 - r.rymax) < 1.5


def test_clipped_areas():
    rng = np.random.default_rng(1)
    quads, rects = [], []
    for _ in range(300):
        t, w, h = rng.uniform(0, 6), *rng.uniform(1, 20, 2)
        m = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        quads.append(np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2 @ m.T + rng.uniform(-10, 10, 2))
        x, y = rng.uniform(-10, 10, 2)
        rects.append([x, y, x + rng.uniform(0.5, 15), y + rng.uniform(0.5, 15)])
    got = pieces.clip_areas(np.array(quads), np.array(rects))
    for q, (x0, y0, x1, y1), area in zip(quads, rects, got):
        gx, gy = np.meshgrid(np.linspace(x0, x1, 121)[:-1] + (x1 - x0) / 240, np.linspace(y0, y1, 121)[:-1] + (y1 - y0) / 240)
        side = [(b[0] - a[0]) * (gy - a[1]) - (b[1] - a[1]) * (gx - a[0]) for a, b in zip(q, np.roll(q, -1, 0))]
        share = np.logical_or(np.all([s >= 0 for s in side], 0), np.all([s <= 0 for s in side], 0)).mean()
        assert abs(area - share * (x1 - x0) * (y1 - y0)) < 0.02 * (x1 - x0) * (y1 - y0) + 0.05
    assert pieces.clip_area(np.array([[0, 0], [4, 0], [4, 4], [0, 4]]), 2, 2, 6, 6) == 4 and pieces.clip_area(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), 5, 5, 6, 6) == 0


def test_matched_histograms(spark):
    images = {0: scene(7, 40, 50, 3) // 3, 1: scene(8, 30, 20, 3) // 2 + 100, 2: np.full((9, 9, 3), 77, np.uint8)}
    tiles = spark.createDataFrame(blocks_of(images, 16), BLOCK)
    pairs = [(10, 0, 1), (11, 1, 0), (12, 0, 2), (13, 2, 0), (14, 1, 1)]
    got = {(r.pair_id, r.block_x, r.block_y): bytes(r.data) for r in pieces.matched_tiles(tiles, spark.createDataFrame(pairs, "pair_id long, src long, ref long")).collect()}
    for pair, src, ref in pairs:
        want = np.zeros_like(images[src])
        for b in range(3):
            values, inverse, counts = np.unique(images[src][..., b], return_inverse=True, return_counts=True)
            ref_values, ref_counts = np.unique(images[ref][..., b], return_counts=True)
            q, c = np.cumsum(counts) / counts.sum(), np.cumsum(ref_counts) / ref_counts.sum()
            want[..., b] = np.rint(np.round(np.interp(q, c, ref_values), 9)).astype(np.uint8)[inverse].reshape(images[src].shape[:2])
        for _, bx, by, x, y, w, h, *_ in blocks_of({0: images[src]}, 16):
            assert got[pair, bx, by] == want[y : y + h, x : x + w].tobytes()

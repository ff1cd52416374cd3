"""Suppression, components and box joins of many sizes against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytile.operators import graph, spatial

DETS = "image_id long, det_id long, xmin int, ymin int, xmax int, ymax int, score double, label int"


def brute_nms(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        def iou(k):
            w, h = min(r[4], k[4]) - max(r[2], k[2]) + 1, min(r[5], k[5]) - max(r[3], k[3]) + 1
            area = lambda b: (b[4] - b[2] + 1) * (b[5] - b[3] + 1)
            i = max(0, w) * max(0, h)
            return i / (area(r) + area(k) - i)

        if all(iou(k) <= threshold for k in kept if (k[0], k[7]) == (r[0], r[7])):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


def test_long_chain(spark, monkeypatch):
    """5000 boxes, each of which overlaps the next better one: every other one stays."""
    rows = [(1, i, 3 * i, 0, 3 * i + 9, 9, 1 - i / 10000, 0) for i in range(5000)]
    stores = []
    monkeypatch.setattr(graph, "stored", lambda df, name="t", own=graph.stored: stores.append(name) or own(df, name))
    got = {r.det_id for r in graph.nms(spark.createDataFrame(rows, DETS), 0.4).collect()}
    assert got == set(range(0, 5000, 2)) and len(stores) < 20


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_suppression_in_cells(spark, most):
    rng = np.random.default_rng(most)
    rows = []
    for i in range(220):
        x, y, w, h = rng.integers(0, 300), rng.integers(0, 200), rng.integers(10, 80), rng.integers(10, 80)
        rows.append((int(i % 3 == 0), i, int(x), int(y), int(x + w), int(y + h), float(rng.integers(0, 9)) / 9, int(i % 2)))
    got = {(r.image_id, r.det_id) for r in graph.nms(spark.createDataFrame(rows, DETS), 0.2, most=most).collect()}
    assert got == brute_nms(rows, 0.2)


@pytest.mark.parametrize("most", [1, 10**6])
def test_components_of_groups(spark, most):
    rng = np.random.default_rng(2)
    edges = [(int(g), int(a), int(b)) for g, a, b in zip(rng.integers(0, 3, 80), rng.integers(0, 60, 80), rng.integers(60, 120, 80))] + [(9, 5, 4), (9, 4, 3)]
    label = {}
    for g, a, b in edges:
        for n in (a, b):
            label.setdefault((g, n), n)
    for _ in range(100):
        for g, a, b in edges:
            label[g, a] = label[g, b] = min(label[g, a], label[g, b])
    got = {(r.g, r.node): r.label for r in graph.group_components(spark.createDataFrame(edges, "g int, a long, b long"), ["g"], most).collect()}
    assert got == label


def test_boxes_of_all_sizes(spark):
    """Pairs of boxes from one pixel to 20,000 are those of all pairs, and a large box takes few rows."""
    rng = np.random.default_rng(7)

    def boxes(n, first):
        out = []
        for i in range(n):
            side = 2.0 ** rng.uniform(0, 14.3)
            x, y = rng.integers(-5000, 20000, 2)
            out.append((int(rng.integers(0, 2)), first + i, int(x), int(y), int(x + side), int(y + side * rng.uniform(0.2, 1))))
        return out

    kinds = "image_id long, id long, xmin int, ymin int, xmax int, ymax int"
    a, b = boxes(150, 0), boxes(150, 1000)
    got = sorted((r.a_id, r.b_id, r.inter) for r in spatial.overlap_pairs(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), levels=True).collect())
    want = []
    for p in a:
        for q in b:
            w, h = min(p[4], q[4]) - max(p[2], q[2]) + 1, min(p[5], q[5]) - max(p[3], q[3]) + 1
            if p[0] == q[0] and w > 0 and h > 0:
                want.append((p[1], q[1], w * h))
    assert got == sorted(want) and len(got) > 100
    large = spark.createDataFrame([(0, 1, 100, 100, 20100, 15100)], kinds).select(*[F.col(c).alias("a_" + c if c != "image_id" else c) for c in ("image_id", "id", *spatial.BOX)])
    assert spatial._posted(large, "a_", F.pow(F.lit(2.0), spatial._level("a_", 256))).count() <= 4

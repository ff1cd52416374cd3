"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytile.llm import negatives

LAST = 1 << 70


def brute(rows, is_anchor, k_pos, k_neg, low, high):
    out = []
    rows = [(d, l, v) for d, l, v in rows if l is not None and v is not None and all(x is not None for x in v)]
    key = lambda t: (-t[0], LAST if t[1] is None else t[1])
    for n, (a, la, va) in enumerate(rows):
        if not is_anchor(a):
            continue
        score = lambda v: sum(x * y for x, y in zip(va, v))
        others = [(score(v), d, l) for m, (d, l, v) in enumerate(rows) if m != n and len(v) == len(va)]
        for ps, pd_, _ in sorted([t for t in others if t[2] == la], key=key)[:k_pos]:
            near = sorted([t for t in others if t[2] != la and low * ps <= 100 * t[0] <= high * ps], key=key)[:k_neg]
            out += [(a, pd_, r, d, ps, s) for r, (s, d, _) in enumerate(near, 1)]
    return sorted(out, key=str)


def got(spark, rows, where, **how):
    df = spark.createDataFrame([(1, d, l, v, "s") for d, l, v in rows], "shard int, vec_id long, label string, v array<long>, block string")
    return sorted([tuple(r) for r in negatives.mine(df, df.where(where), **how).collect()], key=str)


def case(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(4)] + spread * rng.normal(size=dim)
        v *= rng.choice([0.2, 1, 1, 5])
        rows.append((i, str(rng.integers(3)) if rng.random() < 0.98 else None, [int(x) for x in np.floor(20 * v)]))
    rows += [(None, "1", rows[0][2]), (None, "2", rows[1][2]), (7, "1", None), (8, "1", [1, None]), (9, "0", []), (10, "1", []), (20, "0", [])]
    rows += [(1000 + i, "0" if i % 2 else "1", [3] * dim) for i in range(40)] + [(2000, "2", [0] * dim), (2010, "1", [0] * dim), (2010, "1", [0] * dim), (30, "2", [5, 6]), (40, "1", [5, 6]), (50, "2", [5, 6])]
    return rows + [rows[20], rows[20], rows[21]]


@pytest.mark.parametrize("seed,dim,spread,sizes", [(1, 8, 0.1, dict(shard_rows=64, anchor_rows=4, bucket_rows=8)), (2, 3, 1.0, {}), (3, 16, 0.5, dict(shard_rows=100, anchor_rows=1000, bucket_rows=16))])
def test_against_all_pairs(spark, seed, dim, spread, sizes):
    rows = case(seed, 250, dim, spread)
    want = brute(rows, lambda d: d is not None and d % 10 == 0, 5, 5, 80, 100)
    assert len(want) > 100
    assert got(spark, rows, "vec_id % 10 = 0", **sizes) == want


def test_other_numbers(spark):
    rows = case(5, 120, 6, 0.3)
    for k_pos, k_neg, low, high in [(1, 9, 50, 120), (3, 2, 0, 99), (500, 500, 80, 100)]:
        assert got(spark, rows, "vec_id % 20 = 0", positives=k_pos, negatives=k_neg, low=low, high=high) == brute(rows, lambda d: d is not None and d % 20 == 0, k_pos, k_neg, low, high)


def test_coordinates_prune_without_loss():
    """Ranges of focus coordinates leave few candidates of clustered rows and lose none."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(50, 16))
    vectors = np.floor(100 * (centres[rng.integers(50, size=4000)] + 0.05 * rng.normal(size=(4000, 16)))).astype(np.int64)
    shard = negatives.Shard(np.arange(4000), np.zeros(4000, np.int64), vectors)
    left = 0
    for a in range(0, 4000, 100):
        scores = vectors @ vectors[a]
        order = np.lexsort((np.arange(4000), -scores))[:5]
        low = int(scores[order[-1]])
        [(s, i)] = shard.first(vectors[a], 5, [(low, None)])
        assert i.tolist() == order.tolist() and s.tolist() == scores[order].tolist()
        q = vectors[a] / np.linalg.norm(vectors[a])
        for b in shard.buckets:
            at = b.candidates(q, np.argsort(-np.abs(q))[:6], low / (np.linalg.norm(vectors[a]) * b.longest))
            left += len(b.ids[at])
    assert left < 0.35 * 40 * 4000


def test_large_numbers_and_empty_tables(spark):
    big = 1 << 30
    rows = [(0, "a", [big, 1]), (1, "a", [big - 1, 7]), (2, "b", [big - 1, 6]), (3, "b", [big - 2, 5])]
    assert got(spark, rows, "vec_id = 0") == brute(rows, lambda d: d == 0, 5, 5, 80, 100)
    # Inner products that pass 64 bits: such rows take no part.
    assert got(spark, rows + [(4, "b", [1 << 62, 1])], "vec_id = 0") == brute(rows, lambda d: d == 0, 5, 5, 80, 100)
    assert got(spark, [], "vec_id = 0") == [] and got(spark, rows, "vec_id = 99") == []
    assert got(spark, [(0, "a", [1, 1])], "vec_id = 0") == []


def test_whole_numbers(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan"), 1.0],), ([float("inf")],), ([None, 1.0],), (None,), ([],)], "e array<float>")
    assert [r[0] for r in df.select(negatives.whole_numbers(F.col("e"))).collect()] == [[128, -1], None, None, None, None, []]

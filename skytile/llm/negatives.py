"""Hard negatives by length buckets and sorted coordinate lists.

Rows are (id, label, vector of integers); a row's score is its inner product with an anchor. An anchor's positives
are its first rows of the same label. Its negatives for a positive are the first rows of other labels whose
score lies in a window below the positive's. Higher scores come first, ties by smaller id.

1. Rows are dealt to shards and anchors to blocks, both of bounded size; each block meets each shard that can hold answers: for
   positives the shards of the anchor's label, for negatives all shards.
2. Inside a shard, rows are sorted by length and cut into buckets. A bucket whose longest row can't reach the score that is
   still needed ends the search, as all later ones are shorter.
3. A bucket keeps the values of its direction vectors sorted by coordinate. From the angle that the needed score leaves, each of the
   anchor's largest (focus) coordinates has a range of feasible values; the rows in the ranges of all of them are candidates.
4. Candidates are verified exactly, in integers; the k-th best score so far is the next one needed.

Rows with a null label or vector, or with a component that is null or not finite, take no part; so do rows whose inner products
could pass 64 bits (dimension times the largest squared component). Vectors of different lengths are never compared. Rows with a null id come after
all ids of the same score. Repeated rows are rows of their own; an anchor row is never its own positive, its copies are. Anchors that repeat
are answered one by one. Zero and empty vectors score 0. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skytile.session import ship, stored

SHARD_ROWS = 16384
ANCHOR_ROWS = 16384
BUCKET_ROWS = 2048
#: Focus coordinates of an anchor.
FOCUS = 6
#: Widens ranges and bounds, so that rounding never loses a row.
SLACK = 1e-9
#: Stands for a null id, so that it comes after all others.
NO_ID = (1 << 63) - 1


class Bucket:
    """Rows of similar length: integer vectors, and for each coordinate the rows in order of their directions' values."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.vectors, self.longest = ids, labels, vectors, float(lengths[0]) if len(lengths) else 0.0
        peak = int(np.abs(vectors).max(initial=0))
        # Sums below 2 ** 53 are exact in doubles, whose products are much faster.
        self.exact = vectors.astype(np.float64) if peak * peak * vectors.shape[1] < 1 << 53 else None
        self.peak, self._lengths, self._lists = peak, lengths, {}

    def scores(self, anchor: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        if self.exact is not None and self.peak * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53:
            return (self.exact[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[at] @ anchor

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, rows) of a coordinate in order of the values; made when first asked for."""
        if f not in self._lists:
            values = self.vectors[:, f] / np.maximum(self._lengths, 1e-300)
            order = np.argsort(values, kind="stable")
            self._lists[f] = (values[order], order)
        return self._lists[f]

    def candidates(self, direction: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | slice:
        """Rows whose direction may have this cosine with the anchor's: those in the feasible range of every focus coordinate."""
        angle = np.arccos(np.clip(cosine, -1, 1))
        parts = []
        for f in focus.tolist():
            own = np.arccos(np.clip(direction[f], -1, 1))
            values, rows = self.sorted_list(f)
            lo = np.searchsorted(values, np.cos(min(np.pi, own + angle)) - SLACK)
            hi = np.searchsorted(values, np.cos(max(0.0, own - angle)) + SLACK, "right")
            if hi - lo < len(values):
                parts.append(rows[lo:hi])
        if not parts:
            return slice(None)
        seen = np.zeros(len(self.ids), np.int64)
        for rows in parts:
            seen[rows] += 1
        return np.flatnonzero(seen == len(parts))


class Shard:
    """The rows of a shard in buckets, longest first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, bucket_rows: int = BUCKET_ROWS):
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        cuts = [order[i : i + bucket_rows] for i in range(0, len(order), bucket_rows)]
        self.buckets = [Bucket(ids[c], labels[c], vectors[c], lengths[c]) for c in cuts]

    def first(self, anchor: np.ndarray, k: int, windows: list[tuple[int | None, int | None]], without: object = None, focus: int = FOCUS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most score; None: open) the first k rows in it as (scores, ids), none of label ``without``."""
        length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        direction = anchor / length if length else anchor.astype(np.float64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        needed = [low for low, _ in windows]
        large = np.argsort(-np.abs(direction), kind="stable")[:focus]
        for bucket in self.buckets:
            least = None if None in needed else min(needed, default=None)
            at: np.ndarray | slice = slice(None)
            if least is not None and least > 0:
                reach = length * bucket.longest
                if reach * (1 + SLACK) < least:
                    break
                at = bucket.candidates(direction, large, least / reach * (1 - SLACK))
            scores, ids = bucket.scores(anchor, at), bucket.ids[at]
            ok = np.ones(len(ids), bool) if least is None else scores >= least
            if without is not None:
                ok &= bucket.labels[at] != without
            scores, ids = scores[ok], ids[ok]
            for w, (_, most) in enumerate(windows):
                own = np.ones(len(ids), bool) if needed[w] is None else scores >= needed[w]
                if most is not None:
                    own &= scores <= most
                if not own.any():
                    continue
                s, i = np.concatenate([best[w][0], scores[own]]), np.concatenate([best[w][1], ids[own]])
                top = np.lexsort((i, -s))[:k]
                best[w] = (s[top], i[top])
                if len(top) == k:
                    needed[w] = int(s[top[-1]])
        return best


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def usable(df: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(vec_id, label, v, dim) of the rows that take part. Vectors are arrays of whole numbers."""
    v = F.col(vec_col)
    peak = F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x.cast("decimal(20,0)")))), F.lit(0).cast("decimal(20,0)"))
    whole = F.forall(v, lambda x: x.isNotNull()) & (peak <= F.floor(F.sqrt(F.lit(2.0**63 * (1 - 1e-9)) / F.greatest(F.size(v), F.lit(1)))).cast("decimal(20,0)"))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"), whole.alias("whole"))
    return rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("whole")).select("vec_id", "label", "v", F.size("v").alias("dim"))


def _parts(rows: DataFrame, other: DataFrame, keys: list[str], rows_each: int, other_each: int) -> DataFrame:
    """(keys, shards, blocks): into how many parts the rows and the others of a key are dealt; a row per key."""
    count = lambda df, n, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    return count(rows, rows_each, "shards").join(count(other, other_each, "blocks"), keys)


def _met(rows: DataFrame, anchors: DataFrame, keys: list[str], shard_rows: int, anchor_rows: int):
    """Rows and anchors, grouped so that each block of anchors meets each shard of rows of the same keys."""
    parts = _parts(rows, anchors, keys, shard_rows, anchor_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(parts, keys).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")).withColumn("block", every("blocks"))
    right = anchors.join(parts, keys).withColumn("block", F.pmod(F.xxhash64("anchor"), F.col("blocks")).cast("int")).withColumn("shard", every("shards"))
    return left.drop("shards", "blocks").groupBy(*keys, "shard", "block").cogroup(right.drop("shards", "blocks").groupBy(*keys, "shard", "block"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.int64)


def positives_of(rows: DataFrame, anchors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(anchor, place, positive, positive_score): the first k other rows of each anchor's label."""

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            shard = Shard(a["vec_id"].to_numpy(), np.zeros(len(a), np.int64), _matrix(a["v"]), bucket_rows)
            for anchor, v in zip(b["anchor"].tolist(), _matrix(b["v"])):
                [(scores, ids)] = shard.first(v, k + 1, [(None, None)])  # one more: the anchor's own row
                out += [(anchor, i, s) for s, i in zip(scores.tolist(), ids.tolist())]
        return pd.DataFrame(out, columns=["anchor", "positive", "positive_score"])

    found = _met(rows, anchors, ["dim", "label"], shard_rows, anchor_rows).applyInPandas(search, "anchor long, positive long, positive_score long")
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    found = found.join(anchors.select("anchor", F.col("vec_id").alias("own_id"), own.alias("own_score")), "anchor")
    every = Window.partitionBy("anchor")
    ranked = found.withColumn("place", F.row_number().over(every.orderBy(F.desc("positive_score"), "positive")))
    itself = (F.col("positive") == F.col("own_id")) & (F.col("positive_score") == F.col("own_score"))
    ranked = ranked.where(F.col("place") <= k + 1).withColumn("itself", F.min(F.when(itself, F.col("place"))).over(every))
    ranked = ranked.where(~F.col("place").eqNullSafe(F.col("itself"))).withColumn("place", F.col("place") - F.when(F.col("place") > F.col("itself"), 1).otherwise(0))
    return ranked.where(F.col("place") <= k).select("anchor", "place", "positive", "positive_score")


def negatives_of(rows: DataFrame, anchors: DataFrame, k: int, low: int, high: int, shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(anchor, place, rank, negative, negative_score) of anchors with ``bounds``, the scores of their positives by place."""

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            codes, labels = pd.factorize(pd.concat([a["label"], b["label"]]))
            shard = Shard(a["vec_id"].to_numpy(), codes[: len(a)], _matrix(a["v"]), bucket_rows)
            for anchor, v, own, bounds in zip(b["anchor"].tolist(), _matrix(b["v"]), codes[len(a) :], b["bounds"]):
                windows = [window_of(int(s), low, high) for s in bounds]
                some = sorted({w for w in windows if w[0] <= w[1]})  # none for scores below zero
                if not some:
                    continue
                found = dict(zip(some, shard.first(v, k, some, own)))
                for place, w in enumerate(windows, 1):
                    out += [(anchor, place, i, s) for s, i in zip(*(x.tolist() for x in found[w]))] if w in found else []
        return pd.DataFrame(out, columns=["anchor", "place", "negative", "negative_score"])

    found = _met(rows, anchors.drop("vec_id"), ["dim"], shard_rows, anchor_rows).applyInPandas(search, "anchor long, place int, negative long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(df: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "v", **sizes: int) -> DataFrame:
    """Hard negatives of ``anchors``, which are rows of ``df``: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A negative's score is at least ``low`` and at most ``high`` per cent of the positive's.
    """
    ship(df.sparkSession)
    rows = stored(usable(df, id_col, label_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "rows")
    asked = stored(usable(anchors, id_col, label_col, vec_col).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    near = stored(positives_of(rows, asked, positives, **sizes), "positives")
    bounds = near.groupBy(F.col("anchor").alias("own")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("b"))
    held = asked.join(bounds, F.col("anchor") == F.col("own")).select("anchor", "vec_id", "label", "v", "dim", F.col("b.positive_score").alias("bounds"))
    far = negatives_of(rows, held, negatives, low, high, **sizes)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = far.join(near, ["anchor", "place"]).join(asked.select("anchor", named("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", named("positive").alias("positive_id"), "rank", named("negative").alias("negative_id"), "positive_score", "negative_score")


def whole_numbers(vec: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x); null where one is null or not finite, or the result passes 32 bits."""
    x = F.transform(vec.cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(x * scale)))
    return F.when(F.forall(x, lambda y: y.isNotNull()), x.cast("array<long>"))


def op12_lemp_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), whole_numbers(F.col("embedding")).alias("v"))
    return mine(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v, row_number() over () as n
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select a.n as an, a.vec_id as anchor_id, a.label = c.label as same, c.vec_id, list_inner_product(a.v, c.v)::bigint as score
  from r a join r c on len(a.v) = len(c.v) and a.n <> c.n where a.vec_id % 100 = 0
), p as (
  select *, row_number() over (partition by an order by score desc, vec_id) as place from s where same qualify place <= 5
), j as (
  select p.an, p.anchor_id, p.place, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.an, p.place order by s.score desc, s.vec_id) as rank
  from p join s on s.an = p.an and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score qualify rank <= 5
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from j"""

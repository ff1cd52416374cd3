"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each shard posts its vectors in the inverted files of these
pivots, ranks them for a query by the footrule distance of the two orders (a pivot missing from one
counts as last), and reranks the first ``candidates`` of them by exact Euclidean distance in double precision.

Rows are dealt to shards and queries to blocks, both of bounded size; each block meets each shard in one group and
leaves its ``k`` best there. Pivots are at most ``PIVOTS`` different vectors of a bounded sample of smallest hashes;
every row is indexed. Equal vectors are one entry of an index, so copies crowd nobody out.

Null vectors, zero vectors and those holding null or non-finite components take no part; vectors of
different lengths are never compared. A query is one row: all other rows are its candidates, those that share its id
or its vector too. Rows with a null id are found and rank after all ids of the same distance; repeated queries are
answered one by one. Ties go to the smaller id. Other columns are left out. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skytile.session import ship, stored

PIVOTS = 256
PREFIX = 128
SHARD_ROWS = 8192
QUERY_ROWS = 4096
#: Share of a shard that is reranked, and the least number.
CANDIDATES = (0.1, 256)
#: Stands for a null id inside the index, so that it comes after all others.
NO_ID = (1 << 63) - 1

NEAREST = "query long, vec_id long, score double"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull()).where(good).withColumn("dim", F.size("v"))


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The first ``prefix`` pivots of each vector, nearest first; ties to the earlier pivot."""
    d = (vectors * vectors).sum(1)[:, None] - 2 * (vectors @ pivots.T) + (pivots * pivots).sum(1)[None]
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


class Index:
    """Inverted files of a shard's distinct vectors: for each pivot its vectors and the pivot's place in their orders."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.vectors, entry = np.unique(vectors, axis=0, return_inverse=True)
        at = np.lexsort((ids, entry.ravel()))
        self.ids, self.first = ids[at], np.searchsorted(entry.ravel()[at], np.arange(len(self.vectors) + 1))
        own = orders(self.vectors, pivots, prefix)
        self.width = own.shape[1]
        self.row, self.place = np.divmod(np.argsort(own.ravel(), kind="stable"), self.width)
        self.bounds = np.searchsorted(np.sort(own.ravel()), np.arange(len(pivots) + 1))

    def credits(self, order: np.ndarray) -> np.ndarray:
        """Of each entry: a constant less the footrule distance of the two orders, summed over the pivots both hold."""
        spans = [slice(self.bounds[p], self.bounds[p + 1]) for p in order]
        rows = np.concatenate([self.row[s] for s in spans])
        credit = np.concatenate([np.minimum(self.width - self.place[s], self.width - i) for i, s in enumerate(spans)])
        return np.bincount(rows, credit, len(self.vectors))

    def nearest(self, own_id: int, vector: np.ndarray, order: np.ndarray, k: int, take: int) -> list[tuple[int, float]]:
        """The k nearest of the ``take`` entries ranked first, less the query's own row."""
        score = self.credits(order)
        found = np.argpartition(-score, take - 1)[:take]
        gap = self.vectors[found] - vector
        exact = np.sqrt((gap * gap).sum(1))
        near = np.argsort(exact, kind="stable")
        near = near[exact[near] <= exact[near[min(k, take - 1)]]]  # k + 1 entries and their ties hold the answers
        parts = []
        for e, far in zip(found[near].tolist(), exact[near].tolist()):
            ids = self.ids[self.first[e] : self.first[e + 1]]
            if far == 0 and (self.vectors[e] == vector).all() and (at := np.searchsorted(ids, own_id)) < len(ids) and ids[at] == own_id:
                ids = np.concatenate([ids[:at][:k], ids[at + 1 :][:k]])
            parts += [(far, i) for i in ids[:k].tolist()]
        return [(i, far) for far, i in sorted(parts)[:k]]


def search_shard(ids, vectors, query_ids, queries, pivots, k: int, prefix: int, share: float, least: int):
    """The k nearest of a shard to each query, by inverted files, footrule distance and exact rerank."""
    index = Index(ids, vectors, pivots, prefix)
    take = min(len(index.vectors), max(least, int(share * len(index.vectors)), 4 * k))
    asked = orders(queries, pivots, prefix)
    return [index.nearest(q, vector, order, k, take) for q, vector, order in zip(query_ids.tolist(), queries, asked)]


def pivots_of(rows: DataFrame, pivots: int, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """At most ``pivots`` different vectors of each length: those of smallest hash among a drawn share of bounded size.

    The share is five times as many rows as pivots (all, of a small table), and copies of a vector are drawn once.
    """
    h = F.xxhash64("v")
    share = F.lit(0.0)
    for d, n in sizes.items():
        share = F.when(F.col("dim") == d, F.lit(5 * pivots / n)).otherwise(share)
    drawn = rows.where(h / F.lit(float(1 << 64)) + 0.5 < share).select("dim", "v", h.alias("h")).distinct()
    out: dict[int, list] = {}
    for r in drawn.orderBy("dim", "h", "v").collect():  # about 5 * pivots rows a length
        out.setdefault(r["dim"], []).append(r["v"])
    return {d: np.array(v[:pivots]) for d, v in out.items()}


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, share: float = CANDIDATES[0], least: int = CANDIDATES[1]) -> DataFrame:
    """The k nearest rows of ``df`` found for each row of ``queries``, which are rows of ``df``."""
    rows = usable(df, id_col, vec_col)
    asked = stored(usable(queries, id_col, vec_col).withColumn("query", F.monotonically_increasing_id()), "queries")
    spark = df.sparkSession
    # A row per vector length.
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    counts = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_dim = pivots_of(rows, pivots, sizes)

    def parts(ns: dict, most: int):
        out = F.lit(1)
        for d, n in ns.items():
            out = F.when(F.col("dim") == d, max(1, -(-n // most))).otherwise(out)
        return out

    shards, blocks = parts(sizes, shard_rows), parts(counts, query_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    # Rows of one id or vector are dealt like others; equal rows of one id lie together, so that one of them can be left out.
    left = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), shards)).withColumn("block", every(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query"), blocks)).withColumn("shard", every(shards))

    def shard(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b) or int(a["dim"].iloc[0]) not in by_dim:
            return pd.DataFrame({"query": [], "vec_id": [], "score": []})
        found = search_shard(a["vec_id"].to_numpy(), np.stack(a["v"].to_list()), b["vec_id"].to_numpy(), np.stack(b["v"].to_list()), by_dim[int(a["dim"].iloc[0])], k, prefix, share, least)
        return pd.DataFrame([(q, i, s) for q, own in zip(b["query"].tolist(), found) for i, s in own], columns=["query", "vec_id", "score"])

    best = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(shard, NEAREST)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    top = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(asked.select("query", named("vec_id").alias("query_id")), "query").select("query_id", "rank", named("vec_id").alias("vec_id"), "score")


def op6_permutation_index(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))

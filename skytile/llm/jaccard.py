"""Exact n-gram Jaccard join of whole documents, as components of the links.

A document's set holds its distinct k-word shingles as hashes under a key drawn anew for each run; links are verified with a second
hash under another key, too, 128 bits in all, unless that is left out to save disk. Texts of the same words in the same order
(told by a 128-bit digest) form one class, which is joined once however many copies it has. Then:

1. Pruning. Linked sets share at least ``r`` of their few smallest hashes; sets that do not share that many with
   anybody are done. Only these few hashes move, not the sets, and a hash that several sets of a task have moves once.
2. Index. The sets that are left order their shingles from the rarest up and post a prefix. The lists are cut
   into blocks of set sizes and of positions, and a set visits only the blocks whose sizes and positions leave
   enough overlap possible; all others are skipped.
3. Answers. In each list the set with the foremost position is the pivot and every other set is compared with it. Sets
   found similar to the same pivot derive their component from its answer: no pair inside a component is
   looked at again, only pairs of different components are joined, verified exactly and added.

No list is gathered anywhere: lists are join keys, which Spark may split, counts are pre-aggregated in each task, and
what is emitted are pairs that pass the size and position bounds and lie in different components. Components come
from label passing on stored tables. Ties do not matter. Null or empty texts and texts without words have empty
sets, linked with nothing; rows with a null id link nothing and get a null component; repeated ids give a row
each, and their component is that of their own text. Very long texts are one set. Other columns are left out. Empty
tables give no rows.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skytile.llm import words as words_of
from skytile.operators.graph import components
from skytile.session import discard, free_prefix, release, ship, stored

SIZE_BLOCK = 1.1  # each block of set sizes reaches this much further than the one before
POSITION_BLOCK = 8
#: Share of a set whose smallest hashes are compared beyond those that similar sets may lack.
EXTRA = 0.08
BATCH_BYTES = 1 << 20
#: Hashes of a task that are counted together before they move.
BATCH_HASHES = 1 << 20

_M = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[bytes], k: int, seed: bytes = b"", table: np.ndarray | None = None) -> list[np.ndarray]:
    """The set of each text as ascending uint64 hashes under a key."""
    raw = _LOWER[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)]
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = words_of.keyed(words_of.padded(raw.tobytes()), starts, ends - starts, words_of.key_table(seed) if table is None else table, seed)
    n = len(words)
    lead = np.full(n, k, np.uint64)
    for i in range(k):
        lead[: max(0, n - i)] = words_of.mix(lead[: max(0, n - i)] * _M + words[i:])
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) + 1
    bounds = np.searchsorted(starts, at)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(lead[a : b - k + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = words_of.mix(h * _M + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(text: bytes) -> bytes:
    """Of the lower-cased words in their order."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _batches(batches):
    held, size = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            held.append(row)
            size += len(row[-1] or "")
            if size >= BATCH_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _lost(n, percent: int):
    """How many members a set of n may have that a similar set lacks."""
    return n * (100 - percent) // 100


def sets_of(docs: DataFrame, k: int, id_col: str, text_col: str, members=None, seeds: list[bytes] = [b""]) -> DataFrame:
    """doc_id, digest of the words, set size n and either a hash of the raw text or ``members`` of the set, for a second seed ``checks``, too."""
    names = ["text_md5"] if members is None else ["members", "checks"][: len(seeds)]
    kinds = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), *[(name, pa.binary() if members is None else pa.list_(pa.int64())) for name in names]])

    def run(batches):
        tables = [words_of.key_table(seed) for seed in seeds]
        for part in _batches(batches):
            texts = [(t or "").encode() for _, t in part]
            sets = [shingle_sets(texts, k, seed, table) for seed, table in zip(seeds, tables)]
            own = [[hashlib.md5(t).digest() for t in texts]] if members is None else [[members(s).view(np.int64) for s in each] for each in sets]
            cols = [[d for d, _ in part], [digest(t) for t in texts], [len(s) for s in sets[0]], *own]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)

    kind = "binary" if members is None else "array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id long, digest binary, n long, {', '.join(f'{name} {kind}' for name in names)}")


def shared_counts(sets: DataFrame) -> DataFrame:
    """node and m, how many of its members other nodes have, too; sets: node, members.

    A hash that several sets of a task's batch hold is settled there: each of them is credited, and one row stands
    for all of them outside. So the rows of a hot hash are at most one a batch.
    """
    kinds = pa.schema([("node", pa.int64()), ("h", pa.int64()), ("m", pa.int64())])

    def combine(batches):
        def flush(nodes, members):
            sizes = np.array([len(x) for x in members])
            owner, h = np.repeat(np.array(nodes, np.int64), sizes), np.concatenate(members)
            order = np.argsort(h, kind="stable")
            owner, h = owner[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(first, len(h)))
            one = first[size == 1]
            credited, m = np.unique(owner[np.repeat(size, size) > 1], return_counts=True)
            several, c = h[first[size > 1]], size[size > 1]
            node = pa.array(np.concatenate([owner[one], credited, np.zeros(len(several), np.int64)]), mask=np.repeat([False, True], [len(one) + len(credited), len(several)]))
            hs = pa.array(np.concatenate([h[one], np.zeros(len(credited), np.int64), several]), mask=np.repeat([False, True, False], [len(one), len(credited), len(several)]))
            return pa.RecordBatch.from_arrays([node, hs, pa.array(np.concatenate([np.ones(len(one), np.int64), m, c]))], schema=kinds)

        nodes, members, held = [], [], 0
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            for i, node in enumerate(batch.column(0).to_pylist()):
                nodes.append(node)
                members.append(flat[ends[i] : ends[i + 1]])
                held += len(members[-1])
                if held >= BATCH_HASHES:
                    yield flush(nodes, members)
                    nodes, members, held = [], [], 0
        if held:
            yield flush(nodes, members)

    rows = sets.select("node", "members").mapInArrow(combine, "node long, h long, m long")
    # Rows of credits have no hash; they are dealt by their node.
    rows = rows.withColumn("key", F.coalesce("h", "node"))
    counted = rows.withColumn("c", F.sum("m").over(Window.partitionBy("key", F.col("h").isNull())))
    return counted.where("node is not null and (h is null or c > 1)").groupBy("node").agg(F.sum("m").alias("m"))


def _need(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of linked sets of these sizes."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked: shingles count as common only as far as all their hashes say so."""
    hashes = [c for c in ("members", "checks") if c in sets.columns]
    left = sets.select(F.col("node").alias("a"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(hashes)])
    right = sets.select(F.col("node").alias("b"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(hashes)])
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    sizes = [F.size(F.array_intersect(f"x{i}", f"y{i}")).cast("long") for i in range(len(hashes))]
    common = sizes[0] if len(sizes) == 1 else F.least(*sizes)
    return both.withColumn("i", common).where(100 * F.col("i") >= percent * (F.size("x0") + F.size("y0") - F.col("i"))).select("a", "b")


def links(docs: DataFrame, k: int, percent: int, extra: float = EXTRA, id_col: str = "doc_id", text_col: str = "text", twice: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row (doc_id, digest, n, text_md5), the classes (digest, node, first_doc, n), and the label of every node with a link to another."""
    seeds = [os.urandom(32) for _ in range(2 if twice else 1)]
    rows = stored(sets_of(docs, k, id_col, text_col, seeds=seeds[:1]), "rows")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.min("n").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    least = F.ceil(percent * F.col("n") / F.lit(100)).cast("long")
    few = sets_of(docs, k, id_col, text_col, lambda s: s[: _lost(len(s), percent) + 1 + int(extra * len(s))], seeds[:1]).where("n > 0")
    # By shuffle at every size, here and below: classes and exploded sets grow with the table and are more than the optimizer takes
    # them for, so they are never broadcast.
    few = few.groupBy("digest").agg(F.first("members").alias("members")).join(classes.select("digest", "node").hint("merge"), "digest")
    asked = 1 + F.floor(F.lit(extra) * least)
    left = stored(shared_counts(few).join(classes.hint("merge"), "node").where(F.col("m") >= asked).select("node", "digest", "first_doc"), "left")
    del few
    release(docs.sparkSession)  # shuffles that are done would keep their disk

    ids = left.select(F.col("first_doc").alias("_first_doc")).distinct()
    some = docs.join(ids.hint("merge"), docs[id_col].cast("long") == ids["_first_doc"], "left_semi")
    sets = sets_of(some, k, id_col, text_col, lambda s: s, seeds).dropDuplicates(["digest"]).join(left.select("digest", "node").hint("merge"), "digest")
    sets = stored(sets.drop("digest", "doc_id"), "sets")
    discard(left)
    release(docs.sparkSession)

    members = sets.select("node", F.explode("members").alias("h"))
    counts = members.groupBy("h").agg(F.count("*").cast("int").alias("c")).where("c > 1")
    ordered = members.join(counts.hint("merge"), "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("o")).join(sets.select("node", "n").hint("merge"), "node")
    ordered = ordered.withColumn("alone", F.col("n") - F.size("o"))
    prefix = F.greatest(F.lit(0).cast("long"), F.col("n") - least + 1 - F.col("alone")).cast("int")
    index = ordered.select("node", "n", "alone", F.posexplode(F.slice("o", 1, prefix)).alias("p", "e")).where(prefix > 0)
    index = stored(index.select("node", "n", F.col("e.h").alias("h"), (F.col("alone") + F.col("p")).alias("p")), "index")

    del members, counts, ordered
    release(docs.sparkSession)

    # Pivots: each list's set of foremost position.
    heads = index.groupBy("h").agg(F.min(F.struct("p", "n", "node")).alias("r")).select("h", F.col("r.node").alias("b"), F.col("r.n").alias("m"), F.col("r.p").alias("q"))
    star = index.join(heads.hint("merge"), "h").where("node <> b").where(F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= _need(F.col("n"), F.col("m"), percent))
    found = stored(_verified(star.select(F.col("node").alias("a"), "b").distinct(), sets, percent), "star")
    labels = components(found, [])
    discard(found)
    release(docs.sparkSession)

    # Pairs of different components: a set visits the size and position blocks that can hold a partner.
    known = stored(index.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")), "index")
    discard(index)
    mixed = known.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
    open_lists = known.join(mixed.hint("merge"), "h", "left_semi")
    size_block = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(SIZE_BLOCK))).cast("int")
    held = open_lists.select("h", F.col("node").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("label").alias("label_b")).withColumn("size_block", size_block(F.col("m"))).withColumn("position_block", F.floor(F.col("q") / POSITION_BLOCK).cast("int"))
    top = F.floor(100 * F.col("n") / F.lit(percent))
    asks = open_lists.withColumn("size_block", F.explode(F.sequence(size_block(F.col("n")), size_block(top))))
    # A partner of size m >= n leaves at most m - need(n, m) positions before the first common shingle.
    asks = asks.withColumn("position_block", F.explode(F.sequence(F.lit(0), F.floor((top - _need(F.col("n"), top, percent) + 1) / POSITION_BLOCK).cast("int"))))
    pairs = asks.join(held.hint("merge"), ["h", "size_block", "position_block"]).where("label <> label_b and (n < m or n = m and node < b)")
    pairs = pairs.where(F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= _need(F.col("n"), F.col("m"), percent))
    more = _verified(pairs.select(F.col("node").alias("a"), "b").distinct(), sets, percent)
    every = stored(more.union(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))), "edges")
    discard(known, sets)
    release(docs.sparkSession)
    return rows, classes, components(every, [])


def labelled(docs: DataFrame, k: int = 5, percent: int = 80, extra: float = EXTRA, id_col: str = "doc_id", text_col: str = "text", twice: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest document id that links lead to), text_md5 and group of every row.

    Components of texts that share a document id may have one component_id, but not one group.
    """
    rows, classes, labels = links(docs, k, percent, extra, id_col, text_col, twice)
    nodes = classes.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = nodes.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named = nodes.join(firsts.hint("merge"), "label").select("digest", "component_id", "label")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(named.hint("merge"), "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "text_md5", F.col("label").alias("group"))


def join(docs: DataFrame, k: int = 5, percent: int = 80, extra: float = EXTRA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest document id that links lead to) of every row."""
    return labelled(docs, k, percent, extra, id_col, text_col).drop("text_md5", "group")


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80, extra: float = EXTRA, id_col: str = "doc_id", text_col: str = "text", twice: bool = False) -> DataFrame:
    """``docs`` with one row of each component: the smallest id's and, among its texts, that of the smallest digest.

    Rows without any word are components of their own, as are rows with a null id; equal rows count once. Links are verified
    with the run's own 64-bit hashes, or, ``twice``, with 128 bits, which takes more disk.
    """
    found = stored(labelled(docs, k, percent, extra, id_col, text_col, twice), "labelled")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    reps = found.where(~alone).groupBy("group").agg(F.min(F.struct("doc_id", "text_md5")).alias("r")).select("r.*")
    reps = reps.unionByName(found.where(alone).select("doc_id", "text_md5"))
    times = found.groupBy("doc_id", "text_md5").agg(F.count("*").alias("times"))
    p = free_prefix(docs, start="rep")
    reps, often = reps.distinct(), times.where("times > 1")
    met = reps.join(often, reps["doc_id"].eqNullSafe(often["doc_id"]) & (reps["text_md5"] == often["text_md5"]), "left")
    reps = stored(met.select(reps["doc_id"].alias(f"{p}id"), reps["text_md5"].alias(f"{p}md5"), F.coalesce("times", F.lit(1)).alias(f"{p}times")), "reps")
    discard(found)
    key = docs[id_col].cast("long").eqNullSafe(F.col(f"{p}id")) & (F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))) == F.col(f"{p}md5"))
    kept = lambda r: docs.join(r, key, "left_semi")
    many = reps.where(F.col(f"{p}times") > 1)
    once = kept(reps.where(F.col(f"{p}times") == 1))
    return once if many.isEmpty() else once.unionByName(kept(many).dropDuplicates([id_col, text_col]))


def op7_jaccard_components(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)

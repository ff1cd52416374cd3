"""Connected components and greedy suppression on edge tables.

Groups (scenes, classes) of up to ``EDGES`` edges are settled in one pass over their sorted edges; only larger ones take rounds of joins
on stored tables.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skytile.operators.spatial import BOX, overlap_pairs
from skytile.session import dealt, discard, ship, stored

#: Edges of a group that one task settles.
EDGES = 200_000


def _tuples(batches):
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _chunks(rows, schema: pa.Schema, n: int = 1 << 16):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _streamed(rows: DataFrame, by: list[str], order: list, settle, out: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """(by, out) of ``settle``, which gets the rows of one group after the other, in order, without the group's columns."""
    n, kinds = len(by), [(c, rows.schema[c].dataType.simpleString()) for c in by]

    def run(batches):
        schema = None

        def each():
            nonlocal schema
            def known():
                nonlocal schema
                for batch in batches:
                    if schema is None:
                        schema = pa.schema([*[batch.schema.field(c) for c in by], *[(c, t) for c, _, t in out]])
                    yield batch

            for group, own in groupby(_tuples(known()), key=lambda r: r[:n]):
                for row in settle(r[n:] for r in own):
                    yield (*group, *row)

        made = each()
        for first in made:
            yield from _chunks((r for part in ([first], made) for r in part), schema)

    ship(rows.sparkSession)
    return dealt(rows, *by).sortWithinPartitions(*by, *order).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*kinds, *[(c, t) for c, t, _ in out]]))


def _sizes(edges: DataFrame, by: list[str], most: int) -> DataFrame:
    """The groups of more than ``most`` edges, with their number."""
    return stored(edges.groupBy(*by).agg(F.count("*").alias("edges")).where(F.col("edges") > most), "large")


def group_components(edges: DataFrame, by: list[str], most: int = EDGES) -> DataFrame:
    """``components`` of each group: small groups in one pass each, larger ones by label passing."""
    edges = stored(edges.select(*by, "a", "b"), "edges")
    large = _sizes(edges, by, most)

    def settle(rows):
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in rows:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [(x, root(x)) for x in list(parent)]

    small = stored(_streamed(edges.join(large.select(*by), by, "left_anti"), by, [], settle, [("node", "long", pa.int64()), ("label", "long", pa.int64())]), "labels")
    if large.isEmpty():
        discard(edges)
        return small
    return small.unionByName(components(edges.join(large.select(*by), by, "left_semi"), by))


def components(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, label) for nodes of edges (by, a, b); the label is the smallest node of the component."""
    both = stored(edges.select(*by, F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(*by, "b", "a")).distinct(), "links")
    labels = stored(both.groupBy(*by, "node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(*by, F.col("node").alias("to"), "label").hint("merge"), [*by, "to"]).groupBy(*by, "node").agg(F.min("label").alias("heard"))
        near = labels.select(*by, "node", F.col("label").alias("old")).join(heard.hint("merge"), [*by, "node"]).select(*by, "node", "old", F.least("old", "heard").alias("label"))
        jump = labels.select(*by, F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(near.join(jump.hint("merge"), [*by, "label"], "left").select(*by, "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = not after.where("label <> old").isEmpty()
        discard(labels)
        labels = after
        if not changed:
            discard(both)
            return labels.select(*by, "node", "label")


def nms(boxes: DataFrame, threshold: float = 0.5, by: list[str] = ["image_id", "label"], id_col: str = "det_id", score_col: str = "score", most: int = EDGES) -> DataFrame:
    """Boxes kept by greedy suppression in each group: best score first (then smallest id), inclusive overlap above the threshold goes.

    Only overlapping pairs matter; they are found by a cell join and become edges from the better to the other box. A box goes if any better
    neighbour stays, so a group is settled by one pass over its edges in order of the lower box. Groups of more than
    ``most`` edges are cut into cells: each round settles in every cell the boxes that hang on boxes of the
    cell, or on those settled before, so there are as many rounds as cells that a chain of overlaps crosses.
    """
    narrow = boxes.select(*by, F.col(id_col).alias("node"), F.col(score_col).alias("s"), *BOX)
    pairs = overlap_pairs(narrow, narrow, by).where(F.col("iou") > threshold)
    better = (F.col("a_s") > F.col("b_s")) | ((F.col("a_s") == F.col("b_s")) & (F.col("a_node") < F.col("b_node")))
    edges = stored(pairs.where(better).select(*by, F.col("a_node").alias("hi"), F.col("b_node").alias("lo"), F.col("b_s").alias("s"), F.col("b_xmin").alias("x"), F.col("b_ymin").alias("y")), "edges")
    large = _sizes(edges, by, most)
    order = [F.desc("s"), "lo"]

    def settle(rows):
        """(hi, lo, s, known) in order of lo; known: whether a box of elsewhere stays, null if that is not settled. Boxes without edges to them stay."""
        kept: dict[int, bool | None] = {}
        for lo, own in groupby(rows, key=lambda r: r[1]):
            states = [kept.get(hi, known) for hi, _, _, known in own]
            kept[lo] = False if True in states else None if None in states else True
        return [(node, state) for node, state in kept.items() if state is not None]

    out = [("node", "long", pa.int64()), ("kept", "boolean", pa.bool_())]
    small = edges.join(large.select(*by), by, "left_anti").select(*by, "hi", "lo", "s", F.lit(True).alias("known"))
    gone = [stored(_streamed(small, by, order, settle, out).where("not kept").select(*by, "node"), "gone")]
    if not large.isEmpty():
        rest = edges.join(large, by)
        area = rest.groupBy(*by).agg(F.greatest(F.lit(1.0), F.sqrt((F.max("x") - F.min("x") + 1.0) * (F.max("y") - F.min("y") + 1.0) * most / F.first("edges"))).alias("side"))
        rest = stored(rest.join(area, by).select(*by, "hi", "lo", "s", F.floor(F.col("x") / F.col("side")).alias("cx"), F.floor(F.col("y") / F.col("side")).alias("cy")), "rest")
        # Boxes with no better neighbour stay from the start.
        lower = rest.select(*by, F.col("lo").alias("hi")).distinct()
        states = stored(rest.select(*by, "hi").distinct().join(lower, [*by, "hi"], "left_anti").select(*by, F.col("hi").alias("node"), F.lit(True).alias("kept")), "states")
        while not rest.isEmpty():
            known = states.select(*by, F.col("node").alias("hi"), F.col("kept").alias("known"))
            asked = rest.join(known, [*by, "hi"], "left").select(*by, "cx", "cy", "hi", "lo", "s", "known")
            found = stored(_streamed(asked, [*by, "cx", "cy"], order, settle, out).select(*by, "node", "kept"), "found")
            gone.append(found.where("not kept").select(*by, "node"))
            after = stored(rest.join(found.select(*by, F.col("node").alias("lo")), [*by, "lo"], "left_anti"), "rest")
            # Only what is left of the graph asks for states again.
            still = after.select(*by, F.col("hi").alias("node")).distinct()
            further = stored(states.unionByName(found).join(still, [*by, "node"], "left_semi"), "states")
            discard(rest, states)
            rest, states = after, further
    discard(edges)
    every = gone[0]
    for more in gone[1:]:
        every = every.unionByName(more)
    return boxes.join(every.withColumnRenamed("node", id_col), [*by, id_col], "left_anti")


def cluster_boxes(dets: DataFrame, factor: float = 1.5, id_col: str = "det_id") -> DataFrame:
    """Boxes whose centres chain within ``factor`` times the scene's larger mean side, merged: extremes and best score.

    Centres meet in cells whose side is that distance, which differs by scene.
    """
    eps = dets.groupBy("image_id").agg((F.greatest(F.avg(F.col("xmax") - F.col("xmin")), F.avg(F.col("ymax") - F.col("ymin"))) * factor).alias("eps"))
    c = dets.join(eps, "image_id").withColumn("xc", (F.col("xmin") + F.col("xmax")) / 2).withColumn("yc", (F.col("ymin") + F.col("ymax")) / 2)
    side = F.when(F.col("eps") > 0, F.col("eps")).otherwise(F.lit(1.0))
    c = c.withColumn("gx", F.floor(F.col("xc") / side)).withColumn("gy", F.floor(F.col("yc") / side)).select("image_id", F.col(id_col).alias("node"), "xc", "yc", "eps", "gx", "gy")
    c = stored(c, "centres")
    around = c.withColumn("gx", F.explode(F.sequence(F.col("gx") - 1, F.col("gx") + 1))).withColumn("gy", F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1)))
    other = c.select("image_id", "gx", "gy", F.col("node").alias("b"), F.col("xc").alias("xb"), F.col("yc").alias("yb"))
    d2 = (F.col("xc") - F.col("xb")) ** 2 + (F.col("yc") - F.col("yb")) ** 2
    edges = around.join(other, ["image_id", "gx", "gy"]).where((F.col("node") < F.col("b")) & (d2 <= F.col("eps") ** 2)).select("image_id", F.col("node").alias("a"), "b")
    labels = group_components(edges, ["image_id"])
    chained = labels.select("image_id", F.col("node").alias(id_col), F.col("label").alias("cluster"))
    named = dets.join(chained, ["image_id", id_col], "left").withColumn("cluster", F.coalesce("cluster", F.col(id_col)))
    return named.groupBy("image_id", "cluster").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.max("score").alias("score"), F.count("*").alias("members"))


def scene_result(dets: DataFrame) -> DataFrame:
    """Final boxes of each scene from its detections (labels 0 to 3): size filter, suppression, cluster merge of label 2, relative size, remap."""
    big = dets.where("xmax - xmin > 10 and ymax - ymin > 10")
    kept = stored(nms(big, 0.5), "kept")
    merged = cluster_boxes(kept.where("label = 2"))
    sized = relative_size(merged).where("score > 0.15").select("image_id", *BOX, "score", F.lit(0).alias("label"))
    others = kept.where("label = 3 and score > 0.5").select("image_id", *BOX, "score", F.lit(1).alias("label"))
    return sized.unionByName(others)


def relative_size(boxes: DataFrame, share: float = 0.25) -> DataFrame:
    """Boxes wider and higher than ``share`` of the smaller of the scene's mean width and mean height."""
    means = boxes.groupBy("image_id").agg(F.least(F.avg(F.col("xmax") - F.col("xmin")), F.avg(F.col("ymax") - F.col("ymin"))).alias("t"))
    return boxes.join(means, "image_id").where((F.col("xmax") - F.col("xmin") > share * F.col("t")) & (F.col("ymax") - F.col("ymin") > share * F.col("t"))).drop("t")

"""Predictions against truth: matching, curves, average precision, confusion matrices, Dice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skytile.operators.spatial import BOX, overlap_pairs
from skytile.session import release, stored

PRESENT = 1e-16


def greedy_matches(dets: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """One-to-one matches: each detection's best truth above the threshold, then each truth's best detection of those. Classes are ignored."""
    p = overlap_pairs(dets.select("image_id", "det_id", *BOX), truth.select("image_id", "box_id", *BOX), inclusive=False).where(F.col("iou") > threshold)
    p = p.select("image_id", F.col("a_det_id").alias("det_id"), F.col("b_box_id").alias("box_id"), "iou")
    best = p.groupBy("image_id", "det_id").agg(F.max(F.struct("iou", (-F.col("box_id")).alias("k"))).alias("m")).select("image_id", "det_id", (-F.col("m.k")).alias("box_id"), F.col("m.iou").alias("iou"))
    return best.groupBy("image_id", "box_id").agg(F.max(F.struct("iou", (-F.col("det_id")).alias("k"))).alias("m")).select("image_id", "box_id", (-F.col("m.k")).alias("det_id"), F.col("m.iou").alias("iou"))


def scene_tp_table(dets: DataFrame, truth: DataFrame, label: int = 3) -> DataFrame:
    """Per scene that has detections and truth: truth boxes, predictions and overlapping predictions of one class (truth numbering)."""
    t, d = truth.where(F.col("label") == label), dets.where(F.col("label") + 1 == label)
    hits = overlap_pairs(d.select("image_id", "det_id", *BOX), t.select("image_id", "box_id", *BOX), inclusive=False).select("image_id", F.col("a_det_id").alias("det_id")).distinct().groupBy("image_id").agg(F.count("*").alias("num_tp"))
    scenes = truth.select("image_id").distinct().join(dets.select("image_id").distinct(), "image_id")
    count = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    out = scenes.join(count(t, "num_gt"), "image_id", "left").join(count(d, "num_pred"), "image_id", "left").join(hits, "image_id", "left")
    return out.select("image_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("num_gt", "num_pred", "num_tp")])


def confusion(dets: DataFrame, truth: DataFrame, classes: int, conf: float = 0.25, iou: float = 0.45) -> DataFrame:
    """(row_cls, col_cls, n). Matched cells are (truth, detection), unmatched truth (background, truth), unmatched detections
    (detection, background), the last only in images with a match. Classes from 0; background is ``classes``."""
    d, t = dets.where(F.col("score") > conf), truth.withColumn("label", F.col("label") - 1)
    m = stored(greedy_matches(d, t, iou), "matches")  # read four times
    release(dets.sparkSession)  # the pairs' shuffles would keep their disk
    dl, tl = d.select("image_id", "det_id", F.col("label").alias("dl")), t.select("image_id", "box_id", F.col("label").alias("tl"))
    matched = m.join(dl, ["image_id", "det_id"]).join(tl, ["image_id", "box_id"]).select(F.col("tl").alias("row_cls"), F.col("dl").alias("col_cls"))
    lost = tl.join(m, ["image_id", "box_id"], "left_anti").select(F.lit(classes).alias("row_cls"), F.col("tl").alias("col_cls"))
    extra = dl.join(m, ["image_id", "det_id"], "left_anti").join(m.select("image_id").distinct(), "image_id", "left_semi").select(F.col("dl").alias("row_cls"), F.lit(classes).alias("col_cls"))
    return matched.union(lost).union(extra).groupBy("row_cls", "col_cls").agg(F.count("*").alias("n"))


def column_shares(cells: DataFrame) -> DataFrame:
    """Cells as shares of their column; below half a per cent null."""
    total = cells.groupBy("col_cls").agg(F.sum("n").alias("t"))
    share = F.col("n") / (F.col("t") + 1e-6)
    return cells.join(total, "col_cls").select("row_cls", "col_cls", F.when(share >= 0.005, share).alias("share"))


def running_counts(rows: DataFrame, key: str, score: str, ties: list[str], flag: str) -> DataFrame:
    """``rows`` with cum_tp and cum_n by falling score within a key, in two levels: a range-partitioned sort, whose
    partitions share a large class, with the sums of all partitions before, then rows inside a partition."""
    order = [F.col(key), F.col(score).desc(), *ties]
    r = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked").withColumn("_p", F.shiftright("_m", 33))
    sums = r.groupBy(key, "_p").agg(F.sum(flag).alias("tp"), F.count("*").alias("n"))  # a row per class and partition
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_p", F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("tp0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(key, "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    r = r.join(sums, [key, "_p"])
    return r.withColumn("cum_tp", F.col("tp0") + F.sum(flag).over(inside)).withColumn("cum_n", F.col("n0") + F.count("*").over(inside)).drop("tp0", "n0", "_p", "_m")


def flagged(dets: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """Detections with ``tp``: 1 where the detection's one-to-one match has its class (truth counts from 1)."""
    m = greedy_matches(dets, truth, threshold).join(truth.select("image_id", "box_id", F.col("label").alias("tl")), ["image_id", "box_id"])
    return dets.join(m.select("image_id", "det_id", "tl"), ["image_id", "det_id"], "left").withColumn("tp", F.when(F.col("tl") == F.col("label") + 1, 1).otherwise(0)).drop("tl")


def pr_curve(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, det_id, image_id, score, recall, precision) by falling score within a class."""
    n_gt = truth.groupBy((F.col("label") - 1).alias("label")).agg(F.count("*").alias("n_gt"))
    r = running_counts(flags, "label", "score", ["det_id", "image_id"], "tp").join(n_gt, "label")
    return r.select("label", "image_id", "det_id", "score", (F.col("cum_tp") / (F.col("n_gt") + PRESENT)).alias("recall"), (F.col("cum_tp") / F.col("cum_n")).alias("precision"))


def interpolated_ap(recall: np.ndarray, precision: np.ndarray) -> float:
    """Area under the 101-point interpolation of the precision envelope."""
    r, p = np.concatenate([[0.0], recall, [recall[-1] + 0.01]]), np.concatenate([[1.0], precision, [0.0]])
    p = np.maximum.accumulate(p[::-1])[::-1]
    x = np.linspace(0, 1, 101)
    return float(np.trapezoid(np.interp(x, r, p), x))


def average_precision(curve: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, ap) of every class with truth; 0 where there are no predictions.

    Between two of the 101 points of the interpolation only the first and the last recall matter, and the best
    precision: a class comes down to 102 rows at most, pre-aggregated in each task.
    """
    j = F.ceil(F.col("recall") * 100)
    # The first point at or beyond the recall, by comparing with the points themselves.
    step = F.when(F.col("recall") <= (j - 1) / 100.0, j - 1).when(F.col("recall") > j / 100.0, j + 1).otherwise(j)
    last = F.max(F.struct("recall", (-F.col("precision")).alias("np")))
    bins = curve.groupBy("label", step.alias("step")).agg(F.min("recall").alias("lo"), F.max("precision").alias("best"), last.alias("m")).select("label", "step", "lo", "best", F.col("m.recall").alias("hi"), (-F.col("m.np")).alias("last"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        best = pdf["best"].to_numpy()
        after = np.append(np.maximum.accumulate(best[::-1])[::-1], 0.0)
        r = np.column_stack([pdf["lo"], pdf["hi"]]).ravel()
        p = np.column_stack([after[:-1], np.maximum(pdf["last"], after[1:])]).ravel()
        return pd.DataFrame({"label": [int(pdf["label"].iloc[0])], "ap": [interpolated_ap(r, p)]})

    got = bins.groupBy("label").applyInPandas(one, "label int, ap double")
    classes = truth.select((F.col("label") - 1).alias("label")).distinct()
    return classes.join(got, "label", "left").select("label", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def best_f1(curve: DataFrame, points: int = 1000) -> DataFrame:
    """Precision, recall and F1 of each class at the confidence (of ``points`` in 0 to 1) with the best mean F1.

    A class's recall and precision at a confidence are those of its last detection at or above it; none: 0 and 1.
    """
    step = F.ceil((1 - F.col("score")) * (points - 1)).cast("int")  # the first point whose confidence is at most the score
    last = curve.withColumn("g", step).groupBy("label", "g").agg(F.max(F.struct("recall", (-F.col("precision")).alias("np"))).alias("m")).select("label", "g", F.col("m.recall").alias("recall"), (-F.col("m.np")).alias("precision"))
    grid = curve.select("label").distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    upto = Window.partitionBy("label").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(last, ["label", "g"], "left").withColumn("recall", F.coalesce(F.last("recall", True).over(upto), F.lit(0.0))).withColumn("precision", F.coalesce(F.last("precision", True).over(upto), F.lit(1.0)))
    full = full.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + PRESENT))
    means = full.groupBy("g").agg(F.avg("f1").alias("mf")).agg(F.max(F.struct("mf", (-F.col("g")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("g"))
    return full.join(F.broadcast(means), "g").select("label", (1 - F.col("g") / (points - 1)).alias("conf"), "precision", "recall", "f1")


def classifier_confusion(rows: DataFrame) -> DataFrame:
    cells = rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def classifier_report(rows: DataFrame) -> DataFrame:
    """Per class: precision, recall, F1, support, and the overall accuracy."""
    both = rows.select(F.explode(F.array(F.struct(F.col("truth").alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("truth") == F.col("pred")).cast("int").alias("hit"), F.lit(1).alias("row")), F.struct(F.col("pred").alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit"), F.lit(0).alias("row")))).alias("r")).select("r.*")
    sums = both.groupBy("cls").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hits"))
    total = Window.partitionBy(F.lit(1))  # a row per class
    s = sums.withColumn("accuracy", F.sum("hits").over(total) / F.sum("support").over(total))
    p, r = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return s.select("cls", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support", "accuracy")


def dice(pixels: DataFrame, labels: list[int], eps: float = 1e-4) -> DataFrame:
    """(image_id, label, dice) from pixel rows (image_id, gt_label, pred_label)."""
    wide = pixels.groupBy("image_id").agg(*[F.sum(((F.col("gt_label") == k) & (F.col("pred_label") == k)).cast("long")).alias(f"i{k}") for k in labels], *[F.sum((F.col("gt_label") == k).cast("long")).alias(f"t{k}") for k in labels], *[F.sum((F.col("pred_label") == k).cast("long")).alias(f"p{k}") for k in labels])
    rows = wide.select("image_id", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), ((2.0 * F.col(f"i{k}") + eps) / (F.col(f"t{k}") + F.col(f"p{k}") + eps)).alias("dice")) for k in labels])).alias("d"))
    return rows.select("image_id", "d.label", "d.dice")


def mean_dice(per_image: DataFrame, needed: list[int] = [1], least: float = 0.5) -> DataFrame:
    """Mean Dice per label over images whose Dice of every needed label is above ``least``."""
    good = per_image.where(F.col("label").isin(needed) & (F.col("dice") > least)).groupBy("image_id").agg(F.count("*").alias("k")).where(F.col("k") == len(needed)).select("image_id")
    return per_image.join(good, "image_id", "left_semi").groupBy("label").agg(F.avg("dice").alias("dice"), F.count("*").alias("images"))

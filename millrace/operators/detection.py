"""Evaluation of detected boxes: matching and average precision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import running_within, stored

#: The usual ladder of overlaps that a detection is held to.
LADDER = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of rows of boxes, as ``iou``: 0 where a corner is missing (masked) or both are empty; NaN counts as the largest."""
    missing = np.ma.getmaskarray(a).any(axis=1) | np.ma.getmaskarray(b).any(axis=1)
    a, b = np.ma.getdata(a), np.ma.getdata(b)
    with np.errstate(all="ignore"):
        side = lambda lo, hi: np.maximum(np.minimum(a[:, hi], b[:, hi]) - np.maximum(a[:, lo], b[:, lo]), 0.0)
        inner = side(0, 2) * side(1, 3)
        area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        both = area(a) + area(b) - inner
        out = np.where(both == 0, 0.0, inner / both)
    return np.where(missing, 0.0, np.where(np.isnan(out), np.inf, out))


def greedy(ps: np.ndarray, n_ps: np.ndarray, ts: np.ndarray, n_ts: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    """Whether each prediction finds a box, by threshold. Groups follow each other; the first predictions of all groups choose at once, then the second ones."""
    hit, taken = np.zeros((len(ps), len(thresholds)), bool), np.zeros((len(ts), len(thresholds)), bool)
    p0, t0 = np.cumsum(n_ps) - n_ps, np.cumsum(n_ts) - n_ts
    for turn in range(int(n_ps.max(initial=0))):
        some = np.flatnonzero((n_ps > turn) & (n_ts > 0))
        n, rows = n_ts[some], p0[some] + turn
        row = np.repeat(rows, n)
        box = np.arange(len(row)) + np.repeat(t0[some] - (np.cumsum(n) - n), n)
        o = overlaps(ps[row], ts[box])
        for k, threshold in enumerate(thresholds):
            at = np.flatnonzero((o >= threshold) & ~taken[box, k])
            if not len(at):
                continue
            first = np.flatnonzero(np.concatenate([[True], row[at][1:] != row[at][:-1]]))
            best = np.repeat(np.maximum.reduceat(o[at], first), np.diff(np.append(first, len(at))))
            won = np.minimum.reduceat(np.where(o[at] == best, at, len(o)), first)
            hit[row[won], k] = taken[box[won], k] = True
    return hit


def _corners(structs: pa.StructArray) -> np.ndarray:
    columns = [structs.field(f"c{i}") for i in range(4)]
    values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns], axis=1)
    return np.ma.array(values, mask=np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=1))


def _found(predictions: DataFrame, truths: DataFrame, thresholds: Sequence[float], most: int) -> DataFrame:
    """image, label, score, key and hits, an array with a value for each threshold; see ``matched``."""
    corners = [F.get("box", F.lit(i)).cast("double").alias(f"c{i}") for i in range(4)]
    best = Window.partitionBy("image", "label").orderBy(F.desc("score"), "key")
    usable = predictions.dropna(subset=["image", "label", "score", "box"])
    some = usable.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= most)
    asked = some.groupBy("image", "label").agg(F.sort_array(F.collect_list(F.struct("__n", "score", "key", *corners))).alias("ps"))
    there = truths.dropna(subset=["image", "label", "box"]).groupBy("image", "label").agg(F.sort_array(F.collect_list(F.struct(*corners))).alias("ts"))
    met = asked.join(there, ["image", "label"], "left").select("image", "label", "ps", "ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [pc.list_value_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ps", "ts")]
            ps, ts = batch.column("ps").flatten(), batch.column("ts").flatten()
            hit = greedy(_corners(ps), sizes[0], _corners(ts), sizes[1], thresholds)
            group = pa.array(np.repeat(np.arange(len(sizes[0])), sizes[0]))
            hits = pa.ListArray.from_arrays(pa.array((np.arange(len(hit) + 1) * len(thresholds)).astype(np.int32)), pa.array(hit.ravel()))
            columns = {"image": batch.column("image").take(group), "label": batch.column("label").take(group), "score": ps.field("score"), "key": ps.field("key"), "hits": hits}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = T.StructType([*some.select("image", "label", "score", "key").schema.fields, T.StructField("hits", T.ArrayType(T.BooleanType()))])
    return met.mapInArrow(run, schema)


def matched(predictions: DataFrame, truths: DataFrame, thresholds: Sequence[float], *, most: int = 100) -> DataFrame:
    """image, label, threshold, score, key and hit: whether a prediction finds a true box that is still free.

    predictions: image, label, score, key (unique), box (xmin, ymin, xmax, ymax); truths: image, label, box. Within an
    image and label, predictions choose in the order of score (ties: the smaller key) among the free boxes that they overlap by
    the threshold; the best overlap counts, ties go to the first box in order. The metric takes ``most`` predictions of an
    image and label, those of the best scores. Rows with a null image, label, score or box are left out. An image's boxes
    of one label are one task's work.
    """
    rows = _by_threshold(_found(predictions, truths, thresholds, most), thresholds, hit=lambda i: F.get("hits", F.lit(i)).cast("int"))
    return rows.select("image", "label", "threshold", "score", "key", "hit")


def _by_threshold(df: DataFrame, thresholds: Sequence[float], **values) -> DataFrame:
    """A row for each threshold, with ``values`` (by name, the column for the threshold's number)."""
    rows = [F.struct(F.lit(float(t)).alias("threshold"), *[c(i).alias(n) for n, c in values.items()]) for i, t in enumerate(thresholds)]
    return df.select("*", F.inline(F.array(*rows)))


def average_precision(predictions: DataFrame, truths: DataFrame, thresholds: Sequence[float] = LADDER, *, points: int | None = 101, most: int = 100) -> DataFrame:
    """label, threshold, truths, predictions, found and ap, for every label that has true boxes.

    The precision at a recall is the best at that recall or a larger one. ``points``: the mean of it at so many evenly
    spaced recalls from 0 to 1; None: its mean over all true boxes (0 for those never found), the area under its curve.
    Labels without predictions have an ap of 0; labels without true boxes don't appear. Recalls are compared as whole numbers.
    """
    hit = lambda i: F.get("hits", F.lit(i)).cast("long")
    precision = lambda i: F.col(f"found{i}") / F.col("place")
    numbers = range(len(thresholds))
    # A prediction is one row with its hits at all thresholds, as their order is the same.
    order = [F.desc("score"), F.col("image"), F.col("key")]
    curve = running_within(stored(_found(predictions, truths, thresholds, most), "hits"), ["label"], order, few=True, place=("sum", F.lit(1).cast("long")), **{f"found{i}": ("sum", hit(i)) for i in numbers})
    n = truths.dropna(subset=["image", "label", "box"]).groupBy("label").agg(F.count(F.lit(1)).alias("truths"))
    known = F.broadcast(stored(n, "truths"))
    if points is None:
        backwards = [F.col("score"), F.desc("image"), F.desc("key")]
        best = running_within(curve, ["label"], backwards, few=True, **{f"best{i}": ("max", precision(i)) for i in numbers})
        sums = [F.count(F.lit(1)).alias("predictions"), *[F.sum(hit(i)).alias(f"found{i}") for i in numbers], *[F.sum(F.when(hit(i) == 1, F.col(f"best{i}"))).alias(f"area{i}") for i in numbers]]
        reached = _by_threshold(best.groupBy("label").agg(*sums), thresholds, found=lambda i: F.col(f"found{i}"), area=lambda i: F.col(f"area{i}"))
        ap = known.join(reached, "label").select("label", "threshold", "predictions", "found", (F.col("area") / F.col("truths")).alias("ap"))
    else:
        # A point serves the recalls up to its own; a row per label, threshold and recall that some point reaches last.
        each = _by_threshold(curve.join(known, "label").select("label", "place", "truths", *[f"found{i}" for i in numbers]), thresholds, found=lambda i: F.col(f"found{i}"), p=precision)
        levels = each.groupBy("label", "threshold", F.expr(f"({points - 1} * found) div truths").alias("level")).agg(F.max("p").alias("p"), F.max("place").alias("predictions"), F.max("found").alias("found"))
        w = Window.partitionBy("label", "threshold").orderBy("level")
        served = F.col("level") - F.lag("level", 1, -1).over(w)
        best = F.max("p").over(w.rowsBetween(0, Window.unboundedFollowing))
        ap = levels.select("label", "threshold", "predictions", "found", (served * best).alias("s")).groupBy("label", "threshold").agg(F.max("predictions").alias("predictions"), F.max("found").alias("found"), (F.sum("s") / points).alias("ap"))
    every = known.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    out = every.join(ap, ["label", "threshold"], "left")
    return out.select("label", "threshold", "truths", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("predictions", "found")], F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_average_precision(per_label: DataFrame) -> DataFrame:
    """One row out of ``average_precision``: map over all, map_50, map_75 and mar, the mean share of true boxes found."""
    at = lambda t: F.avg(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap")))
    return per_label.agg(F.avg("ap").alias("map"), at(0.5).alias("map_50"), at(0.75).alias("map_75"), F.avg(F.col("found") / F.col("truths")).alias("mar"), F.countDistinct("label").alias("labels"))

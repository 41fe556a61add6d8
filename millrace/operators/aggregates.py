"""Metrics as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import if_small, running


def tally(label: Column, flag: Column) -> list[Column]:
    """Counts of the confusion matrix."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return [n((label == 1) & flag).alias("tp"), n((label == 0) & flag).alias("fp"), n((label == 1) & ~flag).alias("fn"), n((label == 0) & ~flag).alias("tn")]


def rates() -> dict[str, Column]:
    """Precision, recall, F1 and accuracy from tp, fp, fn and tn; 0 where nothing is there to divide by."""
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn), "accuracy": part(tp + tn, tp + fp + fn + tn)}


def classification_metrics(df: DataFrame, label: Column, flag: Column) -> DataFrame:
    return df.agg(*tally(label, flag)).withColumns(rates())


def threshold_sweep(df: DataFrame, label: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """Metrics at several thresholds in one pass; rows are multiplied by their number before partial aggregation."""
    each = df.select(label.alias("__y"), score.alias("__s"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return each.groupBy("threshold").agg(*tally(F.col("__y"), F.col("__s") >= F.col("threshold"))).withColumns(rates()).withColumn("flagged", F.col("tp") + F.col("fp"))


def auc_roc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """Area under the ROC curve with ties halved: one row, null where a class is absent.

    Rows are first counted by distinct score; a running total over those gives each score the negatives below it.
    """
    per = df.groupBy(score.alias("__s")).agg(F.sum((label == 1).cast("long")).alias("__p"), F.sum((label == 0).cast("long")).alias("__n"))
    below = running(per.filter("__s is not null"), [F.col("__s")], F.col("__n"), "__upto")
    wins = F.sum(F.col("__p") * (F.col("__upto") - F.col("__n") / 2))
    return below.agg(F.try_divide(wins, F.sum("__p").cast("double") * F.sum("__n")).alias("auc"))


def regression_metrics(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """MAE, MSE, RMSE, MAPE, MSPE and RSE in one pass; rows of truth 0 are left out of the relative ones."""
    e = guess - truth
    rel = F.when(truth != 0, e / truth)
    spread = F.regr_syy(truth, truth)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(rel)).alias("mape"), F.avg(rel * rel).alias("mspe"), F.sqrt(F.sum(e * e) / spread).alias("rse"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Counts of values and their shares of all rows. The total is one number, joined by broadcast."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("__all")))).withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def percentiles(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles of each group, interpolated: a column for each name in ``at``. Nulls are left out.

    Values are counted, running totals over the distinct ones give their ranks, and the ranks wanted pick the values.
    No group is gathered in one task.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__c"))
    upto = running(per, [F.col(group), F.col(value)], F.col("__c"), "__upto")
    sums = upto.groupBy(group).agg(F.min(F.col("__upto") - F.col("__c")).alias("__start"), F.sum("__c").alias("__n"))
    same = F.col(group).eqNullSafe(F.col("__group"))
    placed = upto.join(if_small(sums.withColumnRenamed(group, "__group")), same)
    first, end = F.col("__upto") - F.col("__c") - F.col("__start"), F.col("__upto") - F.col("__start")
    ends = []
    for name, p in at.items():
        place = F.lit(p) * (F.col("__n") - 1)
        for side, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            ends.append(F.max(F.when((first <= k) & (k < end), F.col(value))).alias(f"__{side}_{name}"))
    found = placed.groupBy(group).agg(F.first("__n").alias("__n"), *ends)
    share = {name: F.lit(p) * (F.col("__n") - 1) - F.floor(F.lit(p) * (F.col("__n") - 1)) for name, p in at.items()}
    return found.select(group, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * share[n]).alias(n) for n in at])


def profile(df: DataFrame, value: str) -> DataFrame:
    """Least, median, mean and largest value of a column: one row."""
    ends = df.agg(F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
    middle = percentiles(df.select(F.lit(1).alias("__one"), value), "__one", value, {"median": 0.5}).select("median")
    return ends.join(F.broadcast(middle), how="left")  # a row each


def average_precision(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """Mean over positives of the precision at their score: one row. Equal scores are one step."""
    per = df.groupBy((-score).alias("__s")).agg(F.sum((label == 1).cast("long")).alias("__p"), F.count(F.lit(1)).alias("__n"))
    steps = running(running(per.filter("__s is not null"), [F.col("__s")], F.col("__p"), "__tp"), [F.col("__s")], F.col("__n"), "__all")
    return steps.agg(F.try_divide(F.sum(F.col("__p") * F.col("__tp") / F.col("__all")), F.sum("__p")).alias("average_precision"))


def sketches(df: DataFrame, by: list[str], values: dict[str, Column], size: int = 12) -> DataFrame:
    """by and, for each value, a sketch of its distinct values (HyperLogLog of 2^size cells), to keep and to merge later."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(v, size).alias(n) for n, v in values.items()])


def merged(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by and, for each sketch, about how many distinct values the groups have together; the error is some 1.6 % for 2^12 cells, and none for few values. No rows are read again."""
    return df.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names])

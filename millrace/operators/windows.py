"""Time series: sliding windows, resampling, segments, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, if_small, ranked


def placed(df: DataFrame, series: str, order: list[str], name: str = "i") -> DataFrame:
    """Each row's place in its series, from 0. Places come from a global ranking, so a long series is no one task's work."""
    all_ = checkpointed(ranked(df, [F.col(series), *map(F.col, order)], "__place"))
    starts = all_.groupBy(series).agg(F.min("__place").alias("__start"))
    return all_.join(if_small(starts), series).withColumn(name, F.col("__place") - F.col("__start")).drop("__place", "__start")


def sliding_windows(df: DataFrame, series: str, order: list[str], value: str, past: int, horizon: int, stride: int, block: int = 1024) -> DataFrame:
    """series, start, past and future arrays for each full window whose start is a multiple of the stride.

    Rows go to the block of windows that starts at their place, and to those before it that reach them; a block's values
    are sorted once and windows are cut from them. So a row is copied 1 + window/block times at most, rounded up.
    """
    size = past + horizon
    step = stride * max(1, -(-block // stride))
    rows = placed(df.select(series, *order, value), series, order)
    first = F.greatest(F.floor((F.col("i") - (size - 1)) / step), F.lit(0))
    dealt = rows.withColumn("__block", F.explode(F.sequence(first, F.floor(F.col("i") / step))))
    # A row past the last window of a block is of no use there.
    dealt = dealt.filter(F.col("i") < F.col("__block") * step + step - stride + size)
    held = dealt.groupBy(series, "__block").agg(F.array_sort(F.collect_list(F.struct("i", value))).alias("__v"))
    last = (F.size("__v") - size) / stride
    cut = held.filter(F.size("__v") >= size).withColumn("__k", F.explode(F.sequence(F.lit(0), F.floor(last).cast("int"))))
    at = F.col("__k") * stride
    values = F.transform("__v", lambda x: x[value])
    return cut.filter(F.col("__k") * stride < step).select(series, (F.col("__block") * step + at).alias("start"), F.slice(values, at + 1, past).alias("past"), F.slice(values, at + 1 + past, horizon).alias("future"))


def time_split(start: Column, end: Column, cut: Column) -> Column:
    """train if a window ends by the cut, val if it starts from it, null if it straddles it."""
    return F.when(end <= cut, "train").when(start >= cut, "val")


def resample(df: DataFrame, at: str, value: str, minutes: int) -> DataFrame:
    """Mean of each stretch of time, with null where no row falls; one row per stretch from the first to the last."""
    slot = F.window(at, f"{minutes} minutes")["start"]
    means = df.groupBy(slot.alias("slot")).agg(F.avg(value).alias("mean"))
    ends = df.agg(F.min(slot.alias("s")).alias("lo"), F.max(slot).alias("hi"))
    grid = ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {minutes} minutes"))).alias("slot"))
    return grid.join(means, "slot", "left")


def segment_flags(df: DataFrame, series: str, order: list[str], by: list[str]) -> DataFrame:
    """``is_start``: true at a series' first row and where any of ``by`` changes. Each row meets the one before it by its place in a global order."""
    rows = checkpointed(ranked(df, [F.col(series), *map(F.col, order)], "__place"))
    before = rows.select((F.col("__place") + 1).alias("__place"), F.struct(series, *by).alias("__before"))
    return rows.join(before, "__place", "left").withColumn("is_start", ~F.col("__before").eqNullSafe(F.struct(series, *by))).drop("__place", "__before")


def encoder_decoder_windows(df: DataFrame, series: str, order: list[str], value: str, length: int, context: int, horizon: int, stride: int = 1, block: int = 1024) -> DataFrame:
    """series, start, x = [start, start + length) and y = [start + length - context, start + length + horizon); the last start is the last whose y is full."""
    w = sliding_windows(df, series, order, value, length, horizon, stride, block)
    return w.select(series, "start", F.col("past").alias("x"), F.concat(F.slice("past", length - context + 1, context) if context else F.array().cast(w.schema["past"].dataType), "future").alias("y"))


def z_scored(df: DataFrame, series: str, value: str, name: str = "z") -> DataFrame:
    """``name``: the value's distance from its series' mean in deviations (of the population); 0 in a series that does not vary."""
    per = df.groupBy(series).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"))
    return df.join(if_small(per), series, "left").withColumn(name, F.when(F.col("__std") > 0, (F.col(value) - F.col("__mean")) / F.col("__std")).otherwise(F.lit(0.0))).drop("__mean", "__std")

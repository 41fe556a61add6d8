"""Scaling and indexing of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, if_small, ranked


def standard_scaled(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, ddof: int = 0) -> DataFrame:
    """Columns less their mean, over their deviation, both of ``fit_on``; a constant column becomes 0."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    one = (fit_on or df).agg(*[F.struct(F.avg(c).alias("m"), std(c).alias("s")).alias(c) for c in columns]).first()  # a row of two numbers per column
    return df.withColumns({c: F.lit(0.0) if not one[c]["s"] else (F.col(c) - one[c]["m"]) / one[c]["s"] for c in columns})


def min_max_scaled(df: DataFrame, columns: list[str], least: float = 1e-8) -> DataFrame:
    """Columns to 0..1 over the whole table."""
    one = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).first()
    return df.withColumns({c: (F.col(c) - one[c]["lo"]) / ((one[c]["hi"] or 0) - (one[c]["lo"] or 0) + least) for c in columns})


def min_max_scaled_batches(df: DataFrame, columns: list[str], order: list[Column], size: int, least: float = 1e-8) -> DataFrame:
    """Columns to 0..1 within batches of ``size`` rows, with ``batch``: a batch is what stands at ``size`` places in a row in an order that ``order`` makes unique, so that it is the same in every run. Nulls stay; a constant batch becomes 0."""
    dealt = checkpointed(ranked(df, order, "__place").withColumn("batch", F.floor(F.col("__place") / size)).drop("__place"))
    ends = dealt.groupBy(F.col("batch").alias("__batch")).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}") + least) for c in columns}
    return dealt.join(if_small(ends), F.col("batch") == F.col("__batch")).withColumns(scaled).select(*df.columns, "batch")


def label_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: the place, from 0, of the row's value among the sorted distinct values; null for null."""
    values = ranked(df.select(column).filter(F.col(column).isNotNull()).distinct(), [F.col(column)], name)
    return df.join(if_small(values), column, "left")

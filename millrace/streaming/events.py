"""Event-time operators that read alike on streams and on tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def late(df: DataFrame, at: str, delay: str | None) -> DataFrame:
    return df.withWatermark(at, delay) if delay and df.isStreaming else df


def tumbling(df: DataFrame, at: str, length: str, keys: list[str], values: dict[str, Column], *, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Aggregates of windows of a length (sliding, if ``slide`` is given) and keys: window_start, keys, values."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return late(df, at, delay).groupBy(w.alias("w"), *keys).agg(*[c.alias(k) for k, c in values.items()]).select(F.col("w.start").alias("window_start"), *keys, *values)


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], values: dict[str, Column], *, delay: str | None = None) -> DataFrame:
    """Aggregates of sessions, which end where no event follows within the gap."""
    return late(df, at, delay).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*[c.alias(k) for k, c in values.items()]).select(F.col("w.start").alias("session_start"), *keys, *values)


def distinct_events(df: DataFrame, at: str, keys: list[str], *, delay: str) -> DataFrame:
    """Each key once; a stream forgets keys that are older than the delay."""
    return late(df, at, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take what the source has now through the stream to Parquet files and stop; a rerun goes on where it left off."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()



def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, n and total of all values of a key so far, whenever a trigger brings new ones (output mode ``update``). The state of a key is two numbers."""

    def add(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + int(batch["v"].notna().sum()), total + float(batch["v"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [names[0]], "n": [n], "total": [total]})

    kind = stream.schema[key].dataType.simpleString()
    plain = stream.select(key, F.col(value).cast("double").alias("v"))
    return plain.groupBy(key).applyInPandasWithState(add, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)

"""Functions of users over rows, batches, groups and columns: all on Arrow batches."""

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``function`` over batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(function, batches)

    return df.mapInPandas(run, schema)


def map_with(df: DataFrame, maker: Callable[..., Callable[[pd.DataFrame], pd.DataFrame]], settings: dict[str, Any], schema: str) -> DataFrame:
    """Batches of rows through an object that each task makes once, from settings that are sent once."""
    sent = df.sparkSession.sparkContext.broadcast(settings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = None
        for batch in batches:
            work = work or maker(**sent.value)
            yield work(batch)

    return df.mapInPandas(run, schema)


def flat_map(df: DataFrame, function: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Any number of rows for each row, as dicts."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([out for row in batch.to_dict("records") for out in function(row)], columns=names)

    return df.mapInPandas(run, schema)


def map_groups(df: DataFrame, by: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``function`` over the rows of each group as one table. A group is held by one task: group by what bounds it."""
    return df.groupBy(*by).applyInPandas(function, schema)


def arrow_function(function: Callable[[pa.Array], pa.Array], kind: str) -> Callable[..., Column]:
    """A function of a column from one of an Arrow array."""

    def run(values: pa.Array) -> pa.Array:
        return function(values)

    return F.arrow_udf(run, kind)


@dataclass
class Aggregate:
    """An aggregate of the user's own: a start, a step by a value, a merge of two states, and an end."""

    start: Callable[[], Any]
    step: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    end: Callable[[Any], float | None]


def aggregated(df: DataFrame, group: str, value: str, how: Aggregate, name: str, parts: int = 32) -> DataFrame:
    """``name``: the aggregate of each group's values, a double. Nulls are left out.

    Each task folds what it has of a group into one state, those states are merged in ``parts`` parts and then as one, so
    that no task sees a whole group.
    """

    def packed(states: dict, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(states), kind), pa.array([cloudpickle.dumps(s) for s in states.values()], pa.binary())], names=["g", "state"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for batch in batches:
            kind = batch.schema.field("g").type
            for g, x in zip(batch.column("g").to_pylist(), batch.column("x").to_pylist(), strict=True):
                states[g] = how.step(states[g] if g in states else how.start(), x)
            if len(states) > 10_000:
                yield packed(states, kind)
                states = {}
        if states:  # a task may have no rows at all
            yield packed(states, kind)

    def merged(rows: pa.Table) -> Any:
        state = how.start()
        for raw in rows.column("state").to_pylist():
            state = how.merge(state, cloudpickle.loads(raw))
        return state

    def some_of(rows: pa.Table) -> pa.Table:
        return pa.table({"g": rows.column("g").slice(0, 1), "state": pa.array([cloudpickle.dumps(merged(rows))], pa.binary())})

    def whole_of(rows: pa.Table) -> pa.Table:
        return pa.table({"g": rows.column("g").slice(0, 1), "v": pa.array([how.end(merged(rows))], pa.float64())})

    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), F.col(value).alias("x")).filter("x is not null")
    states = rows.mapInArrow(fold, f"g {kind}, state binary").withColumn("part", F.pmod(F.xxhash64("state"), F.lit(parts)))
    some = states.groupBy("g", "part").applyInArrow(some_of, f"g {kind}, state binary")
    whole = some.groupBy("g").applyInArrow(whole_of, f"g {kind}, v double")
    return whole.select(F.col("g").alias(group), F.col("v").alias(name))

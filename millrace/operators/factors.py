"""Factors of users and items by alternating least squares.

For fixed factors of one side, the best ones of the other solve a small system of equations for each user (or item). Its sums
are plain aggregates over the ratings, combined before they are shuffled, so that a user of very many ratings is a few
numbers from each task; the systems are then solved in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, if_small, stored


def first_factors(ids: Column, rank: int, seed: int) -> Column:
    """Factors from 0 to 1 over the root of the rank, by MD5 of seed, id and place: alike in every run and in other engines."""
    draw = lambda j: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ids.cast("string"), F.lit(f":{j}"))), 1, 8), 16, 10).cast("double")
    return F.array(*[(draw(j) + 1) / F.lit(4294967296.0 * rank**0.5) for j in range(rank)])


def solved(ratings: DataFrame, side: str, other: str, factors: DataFrame, rank: int, penalty: float) -> DataFrame:
    """side and f: the factors that fit the ratings best for the given ones of the other side (other, f), with a penalty on their squares times the number of ratings."""
    f = [F.get("f", j) for j in range(rank)]
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    sums = [F.sum(f[i] * f[j]).alias(f"p{i}_{j}") for i, j in pairs] + [F.sum(F.col("rating") * x).alias(f"r{i}") for i, x in enumerate(f)]
    met = ratings.join(if_small(factors), other).groupBy(side).agg(F.count(F.lit(1)).alias("n"), *sums)
    kind = ratings.schema[side].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.zeros((len(b), rank, rank))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = b.column(f"p{i}_{j}").to_numpy(zero_copy_only=False)
            n = b.column("n").to_numpy(zero_copy_only=False)
            a[:, np.arange(rank), np.arange(rank)] += penalty * n[:, None]
            y = np.stack([b.column(f"r{i}").to_numpy(zero_copy_only=False) for i in range(rank)], axis=1)
            x = np.linalg.solve(a, y[:, :, None])[:, :, 0] if len(b) else y
            yield pa.RecordBatch.from_arrays([b.column(side), pa.array(x.tolist(), pa.list_(pa.float64()))], names=[side, "f"])

    return met.mapInArrow(run, f"`{side}` {kind}, f array<double>")


def fit(ratings: DataFrame, *, rank: int = 8, rounds: int = 10, penalty: float = 0.1, seed: int = 0, user: str = "user", item: str = "item", rating: str = "rating") -> tuple[DataFrame, DataFrame]:
    """(user, f) and (item, f): factors whose products come near the ratings. penalty: above 0.

    Rows with a null or NaN are left out; pairs that repeat count each. Each half round is written, so that what is lost
    later costs a read. Without ratings both tables are empty.
    """
    own = ratings.select(F.col(user).alias(user), F.col(item).alias(item), F.col(rating).cast("double").alias("rating")).dropna()
    # Read by every half round. Rows of a user lie together, so that their sums are few before they are shuffled; a user of very many is dealt to several tasks.
    own = stored(own.hint("rebalance", user), "ratings")
    items = checkpointed(own.select(item).distinct().withColumn("f", first_factors(F.col(item), rank, seed)))
    users = None
    for _ in range(rounds):
        users = checkpointed(solved(own, user, item, items, rank, penalty))
        items = checkpointed(solved(own, item, user, users, rank, penalty))
    return (users if users is not None else own.select(user).distinct().withColumn("f", F.array().cast("array<double>"))), items


def predicted(pairs: DataFrame, users: DataFrame, items: DataFrame, *, user: str = "user", item: str = "item", unknown: float | None = None) -> DataFrame:
    """``pairs`` with ``predicted``; ``unknown`` where the user or the item has no factors."""
    u, i = users.select(F.col(user), F.col("f").alias("__u")), items.select(F.col(item), F.col("f").alias("__i"))
    dot = F.aggregate(F.zip_with("__u", "__i", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(if_small(u), user, "left").join(if_small(i), item, "left").withColumn("predicted", F.coalesce(dot, F.lit(unknown).cast("double"))).drop("__u", "__i")

"""Order, top-k, splits, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, if_small, ranked


def draw(key: Column, seed: int = 0) -> Column:
    """A hash of the key that orders rows at random, and alike in other engines: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def exact_split(df: DataFrame, key: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """``split``: the name of each row's part; parts have exact sizes, cut at floor(n * running fraction) of a random order."""
    n = df.count()
    placed = ranked(df.withColumn("__draw", draw(F.col(key), seed)), [F.col("__draw"), F.col(key)], "__place")
    out, upto, names = None, 0.0, list(fractions)
    for name in names[:-1]:
        upto += fractions[name]
        here = F.col("__place") < int(n * upto + 1e-9)
        out = F.when(here, name) if out is None else out.when(here, name)
    return placed.withColumn("split", F.lit(names[-1]) if out is None else out.otherwise(names[-1])).drop("__draw", "__place")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Up to n random rows of each group; Spark keeps n per group and task before it shuffles."""
    w = Window.partitionBy(group).orderBy("__draw", key)
    return df.withColumn("__draw", draw(F.col(key), seed)).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__draw", "__n")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a random order that the seed fixes, dealt by range."""
    return df.orderBy(draw(F.col(key), seed), key)


def shards(df: DataFrame, key: str, n: int) -> DataFrame:
    """``shard``: which of n disjoint parts a row belongs to."""
    return df.withColumn("shard", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n)).cast("int"))


def batched_by_length(df: DataFrame, length: Column, partitions: int) -> DataFrame:
    """Rows of like length side by side, for batches that pad little."""
    return df.withColumn("__len", length).repartitionByRange(partitions, "__len").sortWithinPartitions("__len").drop("__len")


def split_at(df: DataFrame, order: list[Column], cuts: list[int]) -> DataFrame:
    """``part``: how many of the cuts (places from 0 in the order) a row's place has reached."""
    placed = ranked(df, order, "__place")
    return placed.withColumn("part", sum(((F.col("__place") >= c).cast("int") for c in cuts), F.lit(0))).drop("__place")


def stratified_split(df: DataFrame, stratum: str, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """``split``: train for floor(n * fraction) rows of each stratum in a random order, test for the rest.

    Places within a stratum come from one global order, so that a large stratum is no one task's work.
    """
    placed = checkpointed(ranked(df.withColumn("__draw", draw(F.col(key), seed)), [F.col(stratum), F.col("__draw"), F.col(key)], "__place"))
    sums = placed.groupBy(F.col(stratum).alias("__stratum")).agg(F.min("__place").alias("__start"), F.count(F.lit(1)).alias("__n"))
    train = F.col("__place") - F.col("__start") < F.floor(F.col("__n") * fraction + 1e-9)
    return placed.join(if_small(sums), F.col(stratum).eqNullSafe(F.col("__stratum"))).withColumn("split", F.when(train, "train").otherwise("test")).drop("__draw", "__place", "__stratum", "__start", "__n")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n random rows, or all if there are fewer; each task keeps n."""
    return df.withColumn("__draw", draw(F.col(key), seed)).orderBy("__draw", key).limit(n).drop("__draw")

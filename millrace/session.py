"""Session and table helpers shared by the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a lookup table, by the optimizer's estimate, up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; very large where it knows nothing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is estimated small, else as it is, for a shuffled join."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where that is unset, a temporary one on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: smaller than a checkpoint, and columns and rows can be left out."""
    path = f"{shared_folder(df.sparkSession)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the running total of ``value`` in a global order.

    Rows are range-partitioned by ``order`` and summed within partitions; the totals of the partitions before (one
    number for each) are added by a broadcast join. No task sees more than its range. Ties in ``order`` are broken
    by nothing: make it unique where the total of each row matters.
    """
    from pyspark.sql import Window as W

    dealt = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__id": F.monotonically_increasing_id(), "__value": value}))
    placed = dealt.withColumn("__part", F.shiftright("__id", 33))
    sums = placed.groupBy("__part").agg(F.sum("__value").alias("__sum"))  # a row for each partition
    before = sums.select("__part", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum("__value").over(W.partitionBy("__part").orderBy("__id").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__id", "__value", "__part", "__own", "__before")


def running_within(df: DataFrame, keys: list[str], order: list[Column], *, few: bool = False, **values: tuple[str, Column]) -> DataFrame:
    """``df`` with running sums or maxima within each key, in an order that ``order`` makes unique.

    values: by name, ("sum" or "max", column). Rows are range-partitioned by keys and order, so that a large key takes
    several tasks; what the partitions before hold of a key is one row for each of them. ``few``: there are so few
    keys that these rows can be broadcast.
    """
    from pyspark.sql import Window as W

    whole = {"sum": F.sum, "max": F.max}
    by = [F.col(k) for k in keys] + order
    dealt = checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()))
    placed = dealt.withColumns({"__part": F.shiftright("__id", 33), **{f"__{n}": v for n, (_, v) in values.items()}})
    sums = placed.groupBy("__part", *keys).agg(*[whole[f](f"__{n}").alias(f"__all_{n}") for n, (f, _) in values.items()])
    behind = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("__part", *keys, *[whole[f](f"__all_{n}").over(behind).alias(f"__before_{n}") for n, (f, _) in values.items()]).select("__part", *[F.col(k).alias(f"__key_{k}") for k in keys], *[f"__before_{n}" for n in values])
    own = W.partitionBy("__part", *keys).orderBy("__id").rowsBetween(W.unboundedPreceding, 0)
    out = placed.withColumns({f"__own_{n}": whole[f](f"__{n}").over(own) for n, (f, _) in values.items()})
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    met = out.alias("o").join((F.broadcast if few else if_small)(before.withColumnRenamed("__part", "__at")), [F.col("__part") == F.col("__at"), *same])
    both = {n: F.col(f"__own_{n}") + F.coalesce(f"__before_{n}", F.lit(0)) if f == "sum" else F.greatest(f"__own_{n}", f"__before_{n}") for n, (f, _) in values.items()}
    return met.select("o.*", *[c.alias(n) for n, c in both.items()]).drop("__id", "__part", *[f"__{n}" for n in values], *[f"__own_{n}" for n in values])


def ranked(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 0, in a global order."""
    return running(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)

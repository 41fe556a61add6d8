"""What the corpus operators share: tables, shared folders, column names."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes that part words: blank and 0x09 to 0x0D. ``bytes.split()`` parts at just these.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage: an executor lost later costs a read and not the work before it.
    """
    path = f"{shared_folder(df.sparkSession)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._written_at = path
    return again


def tidy(spark: SparkSession) -> None:
    """After a step that shuffled the texts: let Spark's cleaner drop the shuffle files of finished jobs now. It does once the driver's JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def released(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose last reader has itself been written."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def chunks(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that make up about ``size`` bytes each."""
    lo = have = 0
    for i, t in enumerate(texts):
        have += len(t)
        if have >= size:
            yield lo, i + 1
            lo, have = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def fan_out(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session; the caller's setting, which follows the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, or others like them, that the table has no column of (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def named_apart(df: DataFrame, other: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with names that ``other`` has none of (in any case), and its columns by their old names."""
    new = dict(zip(df.columns, fresh(other, *[f"__{c}" for c in df.columns]), strict=True))
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), {c: F.col(f"`{n}`") for c, n in new.items()}


def with_new(df: DataFrame, **columns) -> DataFrame:
    """Add result columns. A column of the input with the same name (in any case) gives way."""
    gone = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone], *[c.alias(k) for k, c in columns.items()])

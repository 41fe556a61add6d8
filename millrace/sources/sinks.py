"""Writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_files(df: DataFrame, path: str, kind: str = "parquet", *, by: list[str] | None = None, mode: str = "error", rows_per_file: int | None = None, compression: str | None = None, single: bool = False) -> None:
    """Parquet, ORC, CSV or JSON files. ``by``: a folder per value; ``single``: one file, for small exports."""
    writer = (df.coalesce(1) if single else df).write.format(kind).mode(mode)
    if kind == "csv":
        writer = writer.option("header", True)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if compression:
        writer = writer.option("compression", compression)
    (writer.partitionBy(*by) if by else writer).save(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key. Of rows of ``new`` that share one, the largest counts."""
    rest = [c for c in new.columns if c != key]
    latest = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("__s")).select(key, *[F.col(f"__s.{c}").alias(c) for c in rest])
    return old.join(latest.select(key), key, "left_anti").unionByName(latest, allowMissingColumns=True)


def write_blobs(df: DataFrame, folder: str, name: str, content: str) -> None:
    """A file per row in a folder (a path or a URI that Arrow's file systems know) that all executors share; a retried task writes the same file again."""

    def run(rows: Iterator[Row]) -> None:
        import uuid

        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(inner, recursive=True)
        for r in rows:
            own = f"{inner}/.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as f:
                f.write(bytes(r[1] or b""))
            system.move(own, f"{inner}/{str(r[0]).rsplit('/', 1)[-1]}")

    df.select(name, content).foreachPartition(run)


def write_batches(df: DataFrame, maker: Callable[[], Callable[[list[Row]], None]], size: int = 1000) -> None:
    """Batches of rows through a writer that each task makes once, such as a client of a store outside. A retried task sends its batches again: let the writer upsert."""

    def run(rows: Iterator[Row]) -> None:
        from itertools import islice

        write = None
        while batch := list(islice(rows, size)):
            write = write or maker()
            write(batch)

    df.foreachPartition(run)

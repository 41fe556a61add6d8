"""A sink of batches that appear whole or not at all, on tables and streams.

Tasks write their rows into a folder of the job, which the driver makes beforehand; the driver's commit moves these files to the batch and names them in
the batch's manifest, which is put in place by one rename. Readers see files that a manifest names. A batch that has a manifest
is not written again, so a stream that repeats its last batch after a failure changes nothing. What a task that was
killed has left goes with the job's folder, on commit as on abort; one that is still running then finds no folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .recordings import system_of


@dataclass
class Staged(WriterCommitMessage):
    """A file that a task has written, or None where it had no rows."""

    name: str | None
    rows: int


class Store:
    """The folders of a sink: ``staged/<job>``, ``data/<batch>`` and ``commits/<batch>.json``."""

    def __init__(self, path: str, job: str = "") -> None:
        self.path, self.job = path.rstrip("/"), job

    def prepared(self) -> Store:
        system, folder = self.folder("staged", self.job)
        system.create_dir(folder, recursive=True)
        return self

    def folder(self, *names: str) -> tuple[fs.FileSystem, str]:
        system, inner = system_of(self.path)
        return system, "/".join([inner, *names])

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, folder = self.folder("staged", self.job)
        name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for b in batches:
                if not len(b):
                    continue
                if writer is None:
                    writer = pq.ParquetWriter(f"{folder}/{name}", b.schema, filesystem=system)
                writer.write_batch(b)
                rows += len(b)
        finally:
            if writer is not None:
                writer.close()
        return Staged(name if rows else None, rows)

    def committed(self, batch: str) -> bool:
        system, at = self.folder("commits", f"{batch}.json")
        return system.get_file_info(at).type == fs.FileType.File

    def commit(self, batch: str, messages: list[Staged | None], *, replaces: bool = False, last: bool = True) -> None:
        """last: the job has no further batches."""
        system, staged = self.folder("staged", self.job)
        if not self.committed(batch):
            _, data = self.folder("data", batch)
            if system.get_file_info(data).type != fs.FileType.NotFound:
                system.delete_dir(data)  # of a commit that did not come to its end
            system.create_dir(data, recursive=True)
            names = [m.name for m in messages if m is not None and m.name]
            for name in names:
                system.move(f"{staged}/{name}", f"{data}/{name}")
            _, commits = self.folder("commits")
            system.create_dir(commits, recursive=True)
            before = [m["batch"] for m in manifests(self.path)] if replaces else []
            with system.open_output_stream(f"{commits}/.{self.job}") as f:
                f.write(json.dumps({"batch": batch, "files": sorted(names), "rows": sum(m.rows for m in messages if m is not None), "replaces": before}).encode())
            system.move(f"{commits}/.{self.job}", f"{commits}/{batch}.json")
        if last:
            self.drop()
        else:
            system.delete_dir_contents(staged)

    def drop(self) -> None:
        system, staged = self.folder("staged", self.job)
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


class CommittedSink(DataSource):
    """``committed``: append or overwrite batches of a table, or of a stream.

    Options: path (a folder, as Arrow's file systems know it, that all executors share), batch (the name of a table's
    batch; without one each write is a batch of its own). A batch whose name is there already is left as it is.
    """

    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(Store(self.options["path"], uuid.uuid4().hex).prepared(), self.options.get("batch"), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        # A stream's writer is made anew for its commits; its checkpoint names its folder.
        own = hashlib.md5(self.options.get("checkpointLocation", "").encode()).hexdigest()
        return StreamWriter(Store(self.options["path"], f"stream-{own}").prepared())


class TableWriter(DataSourceArrowWriter):
    def __init__(self, store: Store, batch: str | None, overwrite: bool) -> None:
        self.store, self.batch, self.overwrite = store, batch or f"table-{store.job}", overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.store.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.store.commit(self.batch, messages, replaces=self.overwrite)

    def abort(self, messages: list[Staged | None]) -> None:
        self.store.drop()


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, store: Store) -> None:
        self.store = store

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.store.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.store.commit(f"stream-{batchId:012d}", messages, last=False)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.store.drop()


def manifests(path: str) -> list[dict]:
    """The manifests of the batches that count, oldest name first."""
    system, at = Store(path).folder("commits")
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    rows = []
    for f in sorted(found, key=lambda f: f.base_name):
        if f.base_name.endswith(".json"):
            with system.open_input_stream(f.path) as s:
                rows.append(json.loads(s.read()))
    gone = {b for r in rows for b in r["replaces"]}
    return [r for r in rows if r["batch"] not in gone]


def read_committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of all batches that are committed, with ``batch``; an empty table where there are none."""
    files = [f"{path.rstrip('/')}/data/{m['batch']}/{name}" for m in manifests(path) for name in m["files"]]
    if not files:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
    return spark.read.schema(schema).parquet(*files).withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/[^/]+$", 1))


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row of the batch of the largest name: batches as upserts. Of rows of a batch that share a key, the largest counts."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max(F.struct("batch", *rest)).alias("__s")).select(key, *[F.col(f"__s.{c}").alias(c) for c in rest], F.col("__s.batch").alias("batch"))

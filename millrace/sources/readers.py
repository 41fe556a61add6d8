"""Readers: thin settings over Spark's own sources, and formats that it lacks."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from itertools import zip_longest
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType


def read_files(spark: SparkSession, path: str, kind: str = "parquet", *, schema: StructType | str | None = None, columns: list[str] | None = None, paths: bool = False, suffix: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON lines or XML files, by path, directory or glob.

    ``columns`` and filters put on the result reach the scan; ``paths`` adds the file's path; ``suffix`` keeps files so named.
    """
    reader = spark.read.format(kind)
    if kind == "csv":
        options = {"header": True} | options
    if schema is not None:
        reader = reader.schema(schema)
    if suffix:
        options["pathGlobFilter"] = f"*{suffix}"
    df = reader.options(**options).load(path)
    picked = df.select(*columns) if columns else df
    return picked.withColumn("path", df["_metadata.file_path"]) if paths else picked


def where_partition(df: DataFrame, columns: list[str], keep: Callable[[dict], bool]) -> DataFrame:
    """Rows of the partitions whose values (``year=2024/month=05``) a function of Python keeps. Its answers become a filter on
    partition columns, so that files of other partitions are not read; the values, one row for each partition, come to the driver."""
    kept = [r for r in df.select(*columns).distinct().collect() if keep(r.asDict())]
    chosen = F.lit(False)
    for r in kept:
        one = F.lit(True)
        for c in columns:
            one = one & F.col(c).eqNullSafe(F.lit(r[c]))
        chosen = chosen | one
    return df.filter(chosen)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_binary(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """A row per file: bytes and path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select(F.col("content").alias("bytes"), "path")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (Spark's image source); files that can't be decoded go."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def from_items(spark: SparkSession, items: list) -> DataFrame:
    """Rows from dicts; other values come as column ``item``."""
    return spark.createDataFrame(items if items and isinstance(items[0], dict) else [(i,) for i in items], None if items and isinstance(items[0], dict) else ["item"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of FASTA files: sequence_id, organism_id (UNKNOWN where the header has none), description, sequence, length."""
    # A record begins with ">" at the start of a line; the first of a file keeps its sign.
    lines = spark.read.option("lineSep", "\n>").text(path)
    records = lines.select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.trim("value") != "")
    head = F.trim(F.regexp_replace(F.split("value", "\n", 2)[0], "\r", ""))
    body = F.regexp_replace(F.coalesce(F.get(F.split("value", "\n", 2), 1), F.lit("")), r"\s", "")
    name = F.split(head, r"\s+", 2)
    ids = F.split(name[0], r"\|")
    organism = F.coalesce(F.nullif(F.get(ids, 1), F.lit("")), F.lit("UNKNOWN"))
    return records.select(ids[0].alias("sequence_id"), organism.alias("organism_id"), F.coalesce(F.get(name, 1), F.lit("")).alias("description"), body.alias("sequence"), F.length(body).cast("int").alias("length"))


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """Annotations in Pascal VOC's XML, a file each: path, width, height, boxes (xmin, ymin, xmax, ymax) and labels."""
    return voc_boxes(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "xml").select("xml", F.col("_metadata.file_path").alias("path")), "xml")


_VOC = "struct<width: int, height: int, boxes: array<array<double>>, labels: array<string>>"


def _voc(xml: str | None) -> dict:
    """What an annotation holds; lists of corners are put side by side, the shorter ones filled up with nulls."""
    if xml is None:
        return {"width": None, "height": None, "boxes": None, "labels": None}
    root = ElementTree.fromstring(xml)
    if root.tag != "annotation":
        return {"width": 0, "height": 0, "boxes": [], "labels": []}

    def whole(path: str) -> int:
        try:
            found = float(root.findtext(path, "").strip())
        except ValueError:
            return 0
        return int(found) if abs(found) < 1 << 31 else 0

    ends = [[float(e.text) for e in root.iterfind(f"object/bndbox/{c}") if e.text] for c in ("xmin", "ymin", "xmax", "ymax")]
    return {"width": whole("size/width"), "height": whole("size/height"), "boxes": [list(b) for b in zip_longest(*ends)], "labels": [e.text for e in root.iterfind("object/name") if e.text]}


def voc_boxes(df: DataFrame, xml: str) -> DataFrame:
    """The table with an annotation's width, height, boxes and labels in place of its XML, which is parsed once."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_voc(t) for t in texts.to_pylist()], pa.struct([("width", pa.int32()), ("height", pa.int32()), ("boxes", pa.list_(pa.list_(pa.float64()))), ("labels", pa.list_(pa.string()))]))

    found = df.select(*[c for c in df.columns if c != xml], F.arrow_udf(run, _VOC)(xml).alias("__voc"))
    return found.select(*[c for c in df.columns if c != xml], *[F.col(f"__voc.{c}").alias(c) for c in ("width", "height", "boxes", "labels")])


def valid_images(df: DataFrame, content: str) -> DataFrame:
    """Rows whose bytes begin as a PNG, JPEG, GIF or BMP file; nulls and empty ones go."""
    head = F.hex(F.substring(content, 1, 4))
    return df.filter(F.coalesce(F.startswith(head, F.lit("89504E47")) | F.startswith(head, F.lit("FFD8FF")) | F.startswith(head, F.lit("47494638")) | F.startswith(head, F.lit("424D")), F.lit(False)))


class _Slice(InputPartition):
    def __init__(self, start: int, end: int, at: int) -> None:
        self.start, self.end, self.at = start, end, at


def opened(path: str):
    """A file to read bytes from, by a path or a URI that Arrow's file systems know."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


class SlicedFile(DataSource):
    """``sliced``: rows start <= index < end of a text file of one JSON object a line, a partition per slice of ``rows`` lines.

    Options: path, rows, start, end. For files that many tasks should read but that can't be split by bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "sliced"

    def schema(self) -> str:
        return "index long, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SlicedReader(self.options)


class _SlicedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.rows = options["path"], int(options.get("rows", 1000))
        self.start, self.end = int(options.get("start", 0)), int(options["end"]) if "end" in options else None

    def partitions(self) -> list[_Slice]:
        """Slices with the place in the file where each begins; the file is gone through once, line by line."""
        out, at, i = [], 0, 0
        with opened(self.path) as f:
            for line in io.BufferedReader(f):
                if self.end is not None and i >= self.end:
                    break
                if i >= self.start and (i - self.start) % self.rows == 0:
                    out.append(_Slice(i, i + self.rows, at))
                at += len(line)
                i += 1
        return [_Slice(p.start, min(p.end, i), p.at) for p in out]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        with opened(self.path) as f:
            f.seek(partition.at)
            for i, line in zip(range(partition.start, partition.end), io.BufferedReader(f), strict=False):
                yield i, line.decode("utf-8").rstrip("\n")


class _File(InputPartition):
    def __init__(self, path: str, place: int) -> None:
        self.path, self.place = path, place


class ShuffledFiles(DataSource):
    """``shuffled``: Parquet files under a folder, in a random order of files that the seed fixes; a partition is a file, and rows keep their order in it.

    Options: path, seed, columns (parted by commas; all without it). ``file_place`` is a file's place in the order, from 0.
    Files are put in order before anything is read, so that nothing is shuffled between tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "shuffled"

    def files(self) -> list[str]:
        path = self.options["path"]
        system, inner = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        found = [f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        seed = self.options.get("seed", "0")
        drawn = lambda f: hashlib.md5(f"{seed}:{f[len(inner) :]}".encode()).hexdigest()
        return sorted(found, key=lambda f: (drawn(f), f))

    def schema(self) -> StructType:
        first = next(iter(self.files()), None)
        known = from_arrow_schema(pq.read_schema(first, filesystem=self.system())) if first else StructType()
        wanted = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else known.names
        return StructType([*[known[c] for c in wanted], StructField("file_place", IntegerType())])

    def system(self) -> fs.FileSystem:
        path = self.options["path"]
        return fs.FileSystem.from_uri(path)[0] if ":/" in path else fs.LocalFileSystem()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ShuffledReader(self, schema)


class _ShuffledReader(DataSourceReader):
    def __init__(self, source: ShuffledFiles, schema: StructType) -> None:
        self.source, self.schema = source, schema

    def partitions(self) -> list[_File]:
        return [_File(f, i) for i, f in enumerate(self.source.files())]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        target = to_arrow_schema(self.schema)
        with self.source.system().open_input_file(partition.path) as f:
            for b in pq.ParquetFile(f).iter_batches(columns=self.schema.names[:-1]):
                own = [*[b.column(c) for c in self.schema.names[:-1]], pa.array([partition.place] * len(b), pa.int32())]
                yield pa.RecordBatch.from_arrays([c.cast(x.type) for c, x in zip(own, target, strict=True)], schema=target)


def shuffled_files(spark: SparkSession, path: str, *, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Rows of Parquet files, files in a random order; with ``file_place``. An empty folder has no columns but that."""
    spark.dataSource.register(ShuffledFiles)
    reader = spark.read.format("shuffled").option("path", path).option("seed", seed)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()

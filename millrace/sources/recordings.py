"""A source of recordings: rows by place, and segments that name the files they need, read by partitions planned from metadata alone.

A recording is a folder with ``segments`` (Parquet: segment, start, end, data, assets), where [start, end) are the places of a
segment's rows, ``data`` is the Parquet file that holds them and ``assets`` maps names (of cameras, say) to other files they need;
files are named from the folder. Rows have their place in the column ``index``. Planning reads ``segments`` only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

STRATEGIES = ("sequential", "segment", "file_group", "chain", "row_block")
#: Rows that are read into memory at a time.
BATCH = 65_536
#: Bytes of a group of rows in data files: what a segment's reader decodes at least.
ROW_GROUP = 1 << 20
#: Most partitions of a reader: beyond that, several that a strategy plans are read one after another in one.
PARTITIONS = 512
#: Rows of pieces that are handed over together.
TOGETHER = 8192


@dataclass(frozen=True)
class Segment:
    segment: int
    start: int
    end: int
    data: str
    assets: tuple[tuple[str, str], ...]

    @property
    def files(self) -> list[str]:
        return [f"data:{self.data}", *[f"{k}:{v}" for k, v in self.assets]]


@dataclass
class Stretch(InputPartition):
    """Rows of one recording: for each piece the segment, its data file and the places [start, end)."""

    dataset: int
    pieces: list[tuple[int, str, int, int]]

    def __init__(self, dataset: int, pieces: list[tuple[int, str, int, int]]) -> None:
        self.dataset, self.pieces = dataset, pieces


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def segments_of(root: str, assets: bool = True) -> list[Segment]:
    """The segments that have rows, by their places; without their assets where these are of no use."""
    system, inner = system_of(root)
    columns = ["segment", "start", "end", "data", *["assets"] * assets]
    own = ds.dataset(f"{inner}/segments", filesystem=system, format="parquet").to_table(columns=columns)
    segment, start, end, data = (own[c].to_pylist() for c in columns[:4])
    named = own["assets"].to_pylist() if assets else [None] * len(own)
    # A plan holds a file's name once.
    found = [Segment(s, a, z, sys.intern(d), tuple(sorted(n or []))) for s, a, z, d, n in zip(segment, start, end, data, named, strict=True) if z > a]
    return sorted(found, key=lambda s: (s.start, s.segment))


def grouped(segments: list[Segment], strategy: str) -> list[list[Segment]]:
    """Segments that one partition reads.

    sequential: all. segment: each for itself. file_group: those of the same files, which must follow each other, else
    an error. chain: those connected by shared files, through others too.
    """
    if strategy == "sequential":
        return [segments] if segments else []
    if strategy == "segment":
        return [[s] for s in segments]
    if strategy == "file_group":
        out: dict[tuple[str, ...], list[Segment]] = {}
        for s in segments:
            own = out.setdefault(tuple(s.files), [])
            if own and own[-1].end != s.start:
                raise ValueError(f"segment {s.segment} shares its files with {own[-1].segment}, which it does not follow; use chain or segment")
            own.append(s)
        return list(out.values())
    lead: dict[str, str] = {}

    def find(x: str) -> str:
        while lead.setdefault(x, x) != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    for s in segments:
        for f in s.files[1:]:
            lead[find(f)] = find(s.files[0])
    chains: dict[str, list[Segment]] = {}
    for s in segments:
        chains.setdefault(find(s.files[0]), []).append(s)
    return list(chains.values())


def planned(segments: list[Segment], strategy: str, rows: int | None, wanted: list[tuple[int, int]], only: set[int] | None) -> list[list[tuple[int, str, int, int]]]:
    """Pieces of each partition, of the wanted places and segments alone; partitions without any are left out."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; it is one of {', '.join(STRATEGIES)}")
    if strategy == "row_block" and not (rows and rows > 0):
        raise ValueError("row_block needs rows, a number above 0")

    def pieces(own: Iterable[Segment], lo: int | None = None, hi: int | None = None) -> list[tuple[int, str, int, int]]:
        out = []
        for s in own:
            if only is not None and s.segment not in only:
                continue
            for a, b in wanted:
                a, b = max(a, s.start, s.start if lo is None else lo), min(b, s.end, s.end if hi is None else hi)
                if a < b:
                    out.append((s.segment, s.data, a, b))
        return out

    if strategy != "row_block":
        parts = [pieces(own) for own in grouped(segments, strategy)]
    else:
        parts, end, at = [], max((s.end for s in segments), default=0), 0
        first = min((s.start for s in segments), default=0)
        for lo in range(first, end, rows):
            while at < len(segments) and segments[at].end <= lo:
                at += 1
            last = at
            while last < len(segments) and segments[last].start < lo + rows:
                last += 1
            parts.append(pieces(segments[at:last], lo, lo + rows))
    return [p for p in parts if p]


def in_turn(parts: list[list[tuple[int, str, int, int]]], most: int) -> list[list[tuple[int, str, int, int]]]:
    """At most so many partitions: where there are more, those that follow each other are joined to about equal numbers of rows."""
    if len(parts) <= most:
        return parts
    ends = np.cumsum([sum(hi - lo for _, _, lo, hi in p) for p in parts])
    out: dict[int, list[tuple[int, str, int, int]]] = {}
    for number, part in zip(((ends - 1) * most // ends[-1]).tolist(), parts, strict=True):
        out.setdefault(number, []).extend(part)
    return list(out.values())


class Recordings(DataSource):
    """``recordings``: dataset, segment, index and the columns of the data files.

    Options: path (several parted by commas; ``dataset`` is the number of each), strategy (``file_group``), rows (of a
    row_block), partitions (most of a recording, 512: beyond it, those that follow each other are read in turn by one). Conditions on dataset, segment and index leave files and partitions out before anything is read, where
    ``spark.sql.python.filterPushdown.enabled`` is on.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def roots(self) -> list[str]:
        return [p.strip().rstrip("/") for p in self.options["path"].split(",") if p.strip()]

    def schema(self) -> StructType:
        columns: list[StructField] | None = None
        for root in self.roots():
            first = next(iter(segments_of(root, False)), None)
            if first is None:
                continue
            system, inner = system_of(root)
            own = [f for f in from_arrow_schema(pq.read_schema(f"{inner}/{first.data}", filesystem=system)).fields if f.name not in ("dataset", "segment", "index")]
            if columns is not None and [(f.name, f.dataType) for f in own] != [(f.name, f.dataType) for f in columns]:
                raise ValueError(f"the columns of {root} differ from those of the first recording")
            columns = own
        return StructType([StructField("dataset", IntegerType()), StructField("segment", LongType()), StructField("index", LongType()), *(columns or [])])

    def reader(self, schema: StructType) -> RecordingsReader:
        return RecordingsReader(self.roots(), schema, self.options.get("strategy", "file_group"), int(self.options["rows"]) if "rows" in self.options else None, int(self.options.get("partitions", PARTITIONS)))


class RecordingsReader(DataSourceReader):
    def __init__(self, roots: list[str], schema: StructType, strategy: str, rows: int | None, most: int = PARTITIONS) -> None:
        self.roots, self.schema, self.strategy, self.rows, self.most = roots, schema, strategy, rows, most
        self.lo, self.hi = -(1 << 62), 1 << 62
        self.places: set[int] | None = None
        self.only: dict[str, set[int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions that planning takes over; the others go back to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("segment", "dataset", "index") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only.get(name, values) & values
            elif name == "index" and isinstance(f, GreaterThan):
                self.lo = max(self.lo, f.value + 1)
            elif name == "index" and isinstance(f, GreaterThanOrEqual):
                self.lo = max(self.lo, f.value)
            elif name == "index" and isinstance(f, LessThan):
                self.hi = min(self.hi, f.value)
            elif name == "index" and isinstance(f, LessThanOrEqual):
                self.hi = min(self.hi, f.value + 1)
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        wanted = [(max(i, self.lo), min(i + 1, self.hi)) for i in sorted(self.only["index"])] if "index" in self.only else [(self.lo, self.hi)]
        out = []
        for n, root in enumerate(self.roots):
            if "dataset" not in self.only or n in self.only["dataset"]:
                parts = planned(segments_of(root, self.strategy in ("file_group", "chain")), self.strategy, self.rows, wanted, self.only.get("segment"))
                out += [Stretch(n, p) for p in in_turn(parts, self.most)]
        return out

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a plan without partitions is read as one of no rows
            return
        system, inner = system_of(self.roots[partition.dataset])
        target = to_arrow_schema(self.schema)
        names = [f.name for f in self.schema.fields[3:]]
        own: dict[str, list[tuple[int, int]]] = {}
        for _, data, lo, hi in partition.pieces:
            own.setdefault(data, []).append((lo, hi))
        files = {data: Places(ds.dataset(f"{inner}/{data}", filesystem=system, format="parquet"), spans, names) for data, spans in own.items()}  # each file is opened once

        def together(held: list[tuple[int, pa.RecordBatch]]) -> pa.RecordBatch:
            b, rows = pa.concat_batches([b for _, b in held]), [len(b) for _, b in held]
            columns = [pa.array(np.full(len(b), partition.dataset, np.int32)), pa.array(np.repeat(np.array([s for s, _ in held], np.int64), rows)), *b.columns]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        held, rows, size = [], 0, 0
        for segment, data, lo, hi in partition.pieces:
            for b in files[data].between(lo, hi):
                if held and (rows + len(b) > TOGETHER or size + b.nbytes > ROW_GROUP):
                    yield together(held)
                    held, rows, size = [], 0, 0
                held.append((segment, b))
                rows, size = rows + len(b), size + b.nbytes
        if held:
            yield together(held)


class Places:
    """Rows of a data file by their places. Where the file and what is asked for are in order, as they are written, it is read once for all that is asked; else once for each stretch."""

    def __init__(self, file: ds.Dataset, spans: list[tuple[int, int]], names: list[str]) -> None:
        self.file, self.columns = file, ["index", *names]
        self.rest: pa.RecordBatch | None = None
        self.stream: Iterator[pa.RecordBatch] | None = None
        if len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and self.ordered(spans[0][0], spans[-1][1]):
            self.stream = self.batches(self.columns, spans[0][0], spans[-1][1])

    def batches(self, columns: list[str], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        place = ds.field("index")
        found = self.file.to_batches(columns=columns, filter=(place >= lo) & (place < hi), batch_size=BATCH, batch_readahead=2, fragment_readahead=1)
        return (b for b in found if len(b))

    def ordered(self, lo: int, hi: int) -> bool:
        last = lo
        for b in self.batches(["index"], lo, hi):
            at = b.column(0).to_numpy()
            if at[0] < last or (np.diff(at) < 0).any():
                return False
            last = at[-1]
        return True

    def between(self, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        if self.stream is None:
            yield from self.batches(self.columns, lo, hi)
            return
        while (rest := self.rest if self.rest is not None else next(self.stream, None)) is not None:
            a, z = np.searchsorted(rest.column(0).to_numpy(), [lo, hi])
            self.rest = rest.slice(z) if z < len(rest) else None
            if a < z:
                yield rest.slice(a, z - a)
            if self.rest is not None:
                return


def read_recordings(spark: SparkSession, paths: list[str], strategy: str = "file_group", rows: int | None = None) -> DataFrame:
    """The rows of recordings; partitions as the strategy plans them, with conditions pushed into the plan."""
    spark.dataSource.register(Recordings)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("recordings").option("path", ",".join(paths)).option("strategy", strategy)
    return (reader.option("rows", rows) if rows else reader).load()


def write_recording(df: DataFrame, path: str, segment: Column, assets: Column, *, files: int) -> None:
    """Write a table with ``index`` (unique places from 0 without gaps, segments one after another) as a recording of about ``files`` data files.

    A segment's rows go to one file. assets: a map of names to files, the same for all rows of a segment.
    """
    own = df.withColumns({"segment": segment.cast("long"), "__assets": assets, "file_number": F.pmod(segment.cast("long"), F.lit(files)).cast("int")})
    # Folders by the file's number; each holds one file, as all its rows come from one task.
    own.repartition(files, "file_number").sortWithinPartitions("file_number", "index").drop("__assets", "segment").write.option("parquet.block.size", ROW_GROUP).partitionBy("file_number").parquet(f"{path}/data")
    named = own.sparkSession.read.format("binaryFile").load(f"{path}/data").select(F.regexp_extract("path", r"(data/file_number=\d+/[^/]+)$", 1).alias("data"))
    named = named.withColumn("file_number", F.regexp_extract("data", r"file_number=(\d+)", 1).cast("int"))
    spans = own.groupBy("segment", "file_number").agg(F.min("index").alias("start"), (F.max("index") + 1).alias("end"), F.max(F.map_entries("__assets")).alias("__assets"))
    spans.join(named, "file_number").select("segment", "start", "end", "data", F.map_from_entries("__assets").alias("assets")).write.parquet(f"{path}/segments")

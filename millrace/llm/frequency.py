"""How often hashes occur in a corpus, counted without a row for each of them.

Texts are dealt to batches by their ids. A batch sends the distinct hashes of its texts as packed lists, one for
each bucket (a range of hashes), and each bucket tells every batch how often its hashes occur in all. A list
carries the low 32 bits of each hash, so that now and then a hash counts as one with another and seems more
frequent than it is; it never seems rarer. Hot hashes come once from a batch, however many texts hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a batch, up to 100 GB of texts; batches grow with the root of the size from there. Small tables are
#: dealt to so many batches, of so many bytes at least, so that there is work for several tasks.
BATCH_BYTES, FEW, LEAST_BYTES = 3 << 20, 64, 1 << 18
#: Hashes of a bucket, as counted in the batches' lists.
BUCKET_HASHES = 500_000

LISTS = "batch long, bucket int, tokens binary, at binary, counts binary"
CODES = "batch long, bucket int, codes binary"


def classed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text, and t1 and t2: 128 bits that stand for the text."""
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})


def classes(docs: DataFrame) -> DataFrame:
    """Of the texts of rows that have an id: t1, t2, the least and the largest id, and the bytes."""
    known = docs.filter("doc_id is not null and text is not null")
    return known.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.octet_length("text")).cast("long").alias("bytes"))


def batches_of(total_bytes: int, batch_bytes: int = BATCH_BYTES) -> int:
    size = batch_bytes * max(1.0, total_bytes / 1e11) ** 0.5
    return 1 + int(total_bytes / min(size, max(LEAST_BYTES, total_bytes / FEW)))


def buckets_of(hashes: int) -> int:
    return 1 + hashes // BUCKET_HASHES


def batch_of(n: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "t1"), F.lit(n)).alias("batch")


def cogrouped(texts: DataFrame, beside: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` over each batch of texts with the batch's rows of another table."""
    return texts.groupBy("batch").cogroup(beside.groupBy("batch")).applyInArrow(work, schema)


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array's bytes, up to each of ``ends`` (in items), as binary values."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(31)) * np.uint64(buckets)) >> np.uint64(32)


def distinct(h: np.ndarray, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, how often each comes, and the place of each input among them. With the number of each
    hash's text: 1 for hashes of one text, however often there, and 2 for others."""
    order = np.argsort(h)
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    first = np.flatnonzero(new)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    if text is not None and len(h):
        own = text[order]
        return s[first], 1 + (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)), place
    return s[first], np.diff(np.append(first, len(s))), place


def packed(batch: int, u: np.ndarray, counts: np.ndarray, buckets: int) -> dict[str, pa.Array]:
    """The columns of LISTS for the distinct hashes (63 bits, sorted) of a batch."""
    edges = np.searchsorted(bucket(u, buckets), np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edges))
    ends = edges[some + 1]
    often = np.flatnonzero(counts > 1)
    inside = (often - edges[np.searchsorted(edges, often, side="right") - 1]).astype(np.uint32)
    often_ends = np.searchsorted(often, ends)
    return {
        "batch": pa.array(np.full(len(some), batch, np.int64)),
        "bucket": pa.array(some.astype(np.int32)),
        "tokens": binaries((u & np.uint64(0xFFFFFFFF)).astype(np.uint32), ends),
        "at": binaries(inside, often_ends),
        "counts": binaries(counts[often].astype(np.uint32), often_ends),
    }


def coded(table: pa.Table) -> pa.Table:
    """Codes of all hashes of a bucket: 0 for one that occurs once, else eight times the binary logarithm of its count."""
    tokens = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("tokens")]
    sizes = np.array([len(x) for x in tokens])
    begin = np.cumsum(sizes) - sizes
    n = np.ones(int(sizes.sum()), np.int64)
    for lo, at, counts in zip(begin, table.column("at"), table.column("counts"), strict=True):
        n[lo + np.frombuffer(at.as_buffer(), np.uint32).astype(np.int64)] = np.frombuffer(counts.as_buffer(), np.uint32)
    x = (np.concatenate(tokens).astype(np.uint64) << np.uint64(32)) | np.arange(len(n), dtype=np.uint64)
    x.sort()
    order = (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same = x >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    totals = np.add.reduceat(n[order], first)
    code = np.where(totals > 1, np.minimum(255, 8 * np.log2(np.maximum(totals, 1))), 0).astype(np.uint8)
    out = np.empty(len(n), np.uint8)
    out[order] = np.repeat(code, np.diff(np.append(first, len(n))))
    some = np.flatnonzero(np.maximum.reduceat(out, begin))  # lists of hashes that occur once have nothing to tell
    rows = table.select(["batch", "bucket"]).take(pa.array(some))
    keep = np.repeat(np.isin(np.arange(len(sizes)), some), sizes)
    return rows.append_column("codes", binaries(out[keep], np.cumsum(sizes[some])))


def codes(lists: DataFrame) -> DataFrame:
    return lists.select("batch", "bucket", "tokens", "at", "counts").groupBy("bucket").applyInArrow(coded, CODES)


def unpacked(u: np.ndarray, buckets: int, rows: Iterable[tuple[int, bytes]]) -> np.ndarray:
    """The code of each of the distinct hashes of a batch, from what the buckets told."""
    edges = np.searchsorted(bucket(u, buckets), np.arange(buckets + 1))
    out = np.zeros(len(u), np.uint8)
    for b, raw in rows:
        out[edges[b] : edges[b + 1]] = np.frombuffer(raw, np.uint8)
    return out

"""Vectors of texts by hashing, without a model.

Words and pairs of neighbouring words are hashed, with a sign, to one of many slots; each slot is projected, with signs
of its own, to a few of the components. Cosines of the results follow those of the counts. Hashes are of MD5, so that
other engines get the same vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import checkpointed, if_small

SLOTS = 1 << 18
#: Hashes that a task keeps.
HASHES = 1 << 18


def md5_bits(value: str) -> int:
    """52 bits of the value's MD5."""
    return int.from_bytes(hashlib.md5(value.encode("utf-8", "surrogatepass")).digest()[:7], "big") >> 4


def counted(texts: list[list[str]], seed: int, known: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and counts of each text's words and pairs, without those that cancel out. known: hashes seen so far, as many as HASHES."""
    out = []
    for ws in texts:
        terms = ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]
        h = np.empty(len(terms), np.int64)
        for k, t in enumerate(terms):
            x = known.get(t)
            if x is None:
                if len(known) >= HASHES:
                    known.clear()
                x = known[t] = md5_bits(f"{seed}:{t}")
            h[k] = x
        slots, place = np.unique((h >> 1) % SLOTS, return_inverse=True)
        c = np.bincount(place, weights=1 - 2 * (h % 2), minlength=len(slots)).astype(np.int64)
        out.append((slots[c != 0], c[c != 0]))
    return out


def projected(slots: np.ndarray, c: np.ndarray, to: np.ndarray, dim: int) -> np.ndarray:
    """The vector of a text's slots; ``to`` has the hashes of each slot."""
    h = to[slots]
    w = np.sign(c) * np.log1p(np.abs(c).astype(np.float64))
    x = np.bincount(((h >> 1) % dim).ravel(), weights=(w[:, None] * (1 - 2 * (h % 2))).ravel(), minlength=dim)
    length = np.sqrt((x * x).sum())
    return x / length if length > 0 else np.zeros(dim)


def text_vectors(docs: DataFrame, *, key: str = "doc_id", text: str = "text", dim: int = 64, fan: int = 4, seed: int = 0) -> DataFrame:
    """key and vector: an array of ``dim`` numbers, of length 1 (all 0 for null texts and those without words).

    Counts enter by the logarithm of one more. Rows that share a key are one text: only these are shuffled, as counts by slot.
    The vectors of all others are made where their texts are read.
    """
    spark = docs.sparkSession
    to = spark.sparkContext.broadcast(np.array([[md5_bits(f"{seed}:{slot}:{j}") for j in range(fan)] for slot in range(SLOTS)], np.int64))
    own = docs.select(F.col(key).alias("__key"), words(F.lower(text)).alias("ws"))
    several = own.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("__key").alias("__several"))
    several = checkpointed(several)
    same = F.col("__key").eqNullSafe(F.col("__several"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            found = [projected(*sums, to.value, dim) for sums in counted(b.column("ws").to_pylist(), seed, known)]
            yield pa.RecordBatch.from_arrays([b.column("__key"), pa.array(found, pa.list_(pa.float64()))], names=["__key", "vector"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            found = counted(b.column("ws").to_pylist(), seed, known)
            row = pa.array(np.repeat(np.arange(len(b)), [len(s) for s, _ in found]))
            slots, c = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("__key").take(row), pa.array(slots), pa.array(c)], names=["__key", "slot", "c"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(np.array([x["slot"] for x in r], np.int64), np.array([x["c"] for x in r], np.int64)) for r in b.column("cs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__key"), pa.array([projected(*p, to.value, dim) for p in pairs], pa.list_(pa.float64()))], names=["__key", "vector"])

    kind = docs.schema[key].dataType.simpleString()
    single = own.join(if_small(several), same, "left_anti").mapInArrow(vectors, f"__key {kind}, vector array<double>")
    shared = own.join(if_small(several), same, "left_semi").select("__key", "ws")
    sums = shared.mapInArrow(counts, f"__key {kind}, slot long, c long").groupBy("__key", "slot").agg(F.sum("c").alias("c"))
    # Every such key, those without any word as well.
    per = sums.filter("c <> 0").groupBy("__key").agg(F.collect_list(F.struct("slot", "c")).alias("cs"))
    whole = several.join(per, same, "left").select(F.col("__several").alias("__key"), F.coalesce("cs", F.array().cast("array<struct<slot:bigint,c:bigint>>")).alias("cs"))
    return single.union(whole.mapInArrow(summed, f"__key {kind}, vector array<double>")).withColumnRenamed("__key", key)

"""Document fingerprints by MinHash, and near-copies by their bands.

A fingerprint holds, for each of 128 universal hash permutations, the least value over the text's five-word shingles,
cut to 16 bits after mixing; two fingerprints agree in about the share of places that the Jaccard similarity of the
sets is. Four places make a band; texts that agree in one of the 32 bands meet in Spark by a join on the band, and
Jaccard is verified on the whole shingle sets. A pair of similarity 0.8 agrees in no band once in 10^7 cases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import if_small
from . import jaccard
from .common import chunks, encoded, fan_out, released, tidy, written
from .frequency import classed
from .graph import components
from .shingles import PIECE, mixed, parity_maps, shingle_sets

SLOTS, BAND = 128, 4
#: Shingles that all permutations run over at a time, so that they stay in the processor's cache.
BLOCK = 1 << 14

_rng = np.random.default_rng(11)
_TIMES = _rng.integers(0, 2**64, SLOTS, dtype=np.uint64) | np.uint64(1)
_PLUS = _rng.integers(0, 2**64, SLOTS, dtype=np.uint64)
_NONE = np.uint64(2**64 - 1)

ROWS = "doc_id long, t1 long, t2 long, n_chars long, n long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part int, edge string, text string"


def least_values(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The least value of each permutation x -> a x + b modulo 2^64 over each set; sets are end to end, n their sizes."""
    out = np.full((len(n), SLOTS), _NONE)
    some = np.flatnonzero(n)
    begin = (np.cumsum(n) - n)[some]
    for lo in range(0, len(h), BLOCK):
        x = h[lo : lo + BLOCK]
        first, last = (int(np.searchsorted(begin, at, side="right")) for at in (lo, lo + len(x) - 1))
        sets = some[first - 1 : last]
        cuts = np.maximum(begin[first - 1 : last] - lo, 0)
        value = np.empty_like(x)
        for i in range(SLOTS):
            np.multiply(x, _TIMES[i], out=value)
            np.add(value, _PLUS[i], out=value)
            out[sets, i] = np.minimum(out[sets, i], np.minimum.reduceat(value, cuts))
    return out


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The places of each text's fingerprint, 16 bits each (all ones where the text has no words), and the sizes of the shingle sets."""
    parts = []
    for lo, hi in chunks(texts, PIECE):
        h, n = shingle_sets(texts[lo:hi])
        slots = (mixed(least_values(h, n)) & np.uint64(0xFFFF)).astype("<u2")
        slots[n == 0] = 0xFFFF
        parts.append((slots, n))
    if not parts:
        return np.zeros((0, SLOTS), "<u2"), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def likeness(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of places in which fingerprints agree, row by row: 1 for two texts without words, 0 where just one has none."""
    return np.where((n > 0) == (m > 0), (x == y).mean(axis=1), 0.0)


def edited(text: str, after: str) -> str:
    """The text with the last half of its code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compared(rows: list[tuple[int | None, int, int, str]], x: np.ndarray, n: np.ndarray, part: int) -> pa.RecordBatch:
    """ROWS of texts in order (doc_id, t1, t2, text) without the last, each compared with the one after it. x, n: their fingerprints."""
    upto = len(rows) - 1
    texts = [r[3] for r in rows]
    changed = [encoded(edited(a, b)) for a, b in zip(texts, texts[1:], strict=False)]
    y, m = fingerprints(changed)
    own, size = x[:upto], n[:upto]
    text = lambda values: pa.array(values, pa.binary())
    columns = [pa.array([r[c] for r in rows[:upto]], pa.int64()) for c in range(3)]
    columns += [pa.array([len(t) for t in texts[:upto]], pa.int64()), pa.array(size, pa.int64()), text([hashlib.sha256(t).digest() for t in changed])]
    columns += [text([r.tobytes() for r in own]), text([r.tobytes() for r in y]), pa.array(likeness(own, size, y, m)), pa.array(likeness(own, size, x[1:], n[1:]))]
    columns += [pa.array([part] * upto, pa.int32()), pa.nulls(upto, pa.string()), pa.nulls(upto, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])


def edge_rows(kept: list[tuple[str, tuple[int | None, int, int, str]]], part: int) -> pa.RecordBatch:
    names = [c.split()[0] for c in ROWS.split(", ")]
    own = [{"doc_id": r[0], "t1": r[1], "t2": r[2], "text": r[3], "part": part, "edge": edge} for edge, r in kept]
    types = {"edited_sha256": pa.binary(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(), "part": pa.int32(), "edge": pa.string(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in own], types.get(c, pa.int64())) for c in names], names=names)


def strings(b: pa.RecordBatch, *names: str) -> list[tuple]:
    return list(zip(*(b.column(c).to_pylist() for c in names), strict=True))


def marked(docs: DataFrame) -> DataFrame:
    """ROWS without edges: every text compared with its edited text and with the next in descending order of id.

    Texts are range-partitioned, each packed by itself, and read in order once; the first and last of each range are kept
    aside, and the last is compared with the first of the next range afterwards.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("t1"), F.col("t2"), F.col("place")]
    kinds = "doc_id long, t1 long, t2 long, place long, packed binary"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = pa.array([pack(encoded(t)) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], texts], names=[c.split()[0] for c in kinds.split(", ")])

    dealt = docs.select("doc_id", "t1", "t2", F.monotonically_increasing_id().alias("place"), "text").mapInArrow(packed, kinds)
    dealt = dealt.repartitionByRange(fan_out(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "t1", "t2", "packed", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        first = part = None
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            if not len(b):
                continue
            held += [(*own, unpack(text).decode("utf-8", "surrogatepass")) for *own, text in strings(b, "doc_id", "t1", "t2", "packed")]
            if first is None:
                first, part = held[0], b.column("part")[0].as_py()
            # Rows before the last have all they need; a text is compared with a bounded number of others at a time.
            data = [encoded(r[3]) for r in held]
            x, n = fingerprints(data)
            for lo, hi in chunks(data[:-1], PIECE):
                yield compared(held[lo : hi + 1], x[lo : hi + 1], n[lo : hi + 1], part)
            held = held[-1:]
        if first is not None:
            yield edge_rows([("first", first), ("last", held[0])], part)

    return dealt.mapInArrow(run, ROWS)


def joined_edges(rows: DataFrame) -> DataFrame:
    """ROWS of the last text of each range, compared with the first of the next range (of the last range: of the first)."""
    parts = rows.filter("edge = 'first'").select("part")  # a number for each range
    after = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next"))
    lasts = rows.filter("edge = 'last'").select("doc_id", "t1", "t2", "text", "part").join(F.broadcast(after), "part")
    firsts = rows.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *own, text, part, after in strings(b, "doc_id", "t1", "t2", "text", "part", "next_text"):
                yield compared([(*own, text), (None, 0, 0, after)], *fingerprints([encoded(text), encoded(after)]), part)

    return lasts.join(firsts, "next").select("doc_id", "t1", "t2", "text", "part", "next_text").mapInArrow(run, ROWS)


def bands(fingerprint: str = "fingerprint") -> list:
    """A hash for each band of a fingerprint."""
    size = 2 * BAND
    return [F.xxhash64(F.lit(j), F.substring(fingerprint, size * j + 1, size)) for j in range(SLOTS // BAND)]


def near_links(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect all documents of similar sets among those that agree in a band. rows: of ``marked``; docs: of ``classed``."""
    entries = rows.filter("n > 0 and doc_id is not null").select("doc_id", "t1", "t2", "n", F.explode(F.array(*bands())).alias("h"))
    several = written(entries.groupBy("h").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).filter("lo < hi").select("h"), "bands")
    met = entries.join(if_small(several), "h").groupBy("h", "t1", "t2", "n").agg(F.min("doc_id").alias("doc_id"))  # one of each text
    listed = written(met.groupBy("doc_id", "t1", "t2", "n").agg(F.collect_set("h").alias("hs")), "listed")  # at most a hash per band
    released(several)
    tidy(docs.sparkSession)
    asked = docs.filter("text is not null").join(if_small(listed.select("doc_id", "t1", "t2")), ["doc_id", "t1", "t2"]).dropDuplicates(["doc_id", "t1", "t2"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [encoded(t) for t in b.column("text").to_pylist()]
            maps = []
            for lo, hi in chunks(data, PIECE):
                h, n = shingle_sets(data[lo:hi])
                maps += [m.tobytes() for m in parity_maps(h, n)]
            yield b.append_column("bits", pa.array(maps, pa.binary()))

    texts = written(asked.select("doc_id", "t1", "t2", "text").mapInArrow(mapped, "doc_id long, t1 long, t2 long, text string, bits binary"), "texts")
    tidy(docs.sparkSession)
    heads = written(listed.join(texts.select("doc_id", "t1", "t2", "bits"), ["doc_id", "t1", "t2"]).select("doc_id", "n", "bits", "hs"), "heads")
    released(listed)
    tidy(docs.sparkSession)
    found = jaccard.links(heads, texts.select("doc_id", "text"), percent, by_twos=False)
    released(heads, texts)
    same = rows.filter("n > 0 and doc_id is not null").select("doc_id", "t1", "t2")
    ids = same.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    every = written(found.union(jaccard.to_least(same, ids)), "links")
    released(found)
    return every


def fingerprinted(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles and component_id, a row per row of ``docs``.

    The next document of a row is the one of the next smaller id (null ids come last, ties in the order of hashes of
    their texts; after the last row comes the first: a table of one row has itself). component_id is the smallest id
    reachable by texts that agree in a band and have a Jaccard similarity of ``percent`` in a hundred at least. A null text is
    an empty one. Texts without words have a fingerprint of their own, like each other and no others, and link with
    nothing; so does a null id. Texts are taken whole, each by one task; other columns are not read, whatever their
    names. An empty table gives an empty one.
    """
    plain = classed(docs, key, text)
    first = written(marked(plain), "fingerprints")
    tidy(docs.sparkSession)
    edges = written(joined_edges(first), "fingerprints")
    rows = first.filter("edge is null").union(edges)
    links = near_links(rows, plain, percent)
    joined = components(links).select(F.col("node").alias("doc_id"), "component")
    released(links)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    out = rows.join(if_small(joined), "doc_id", "left")
    return out.select("doc_id", "n_chars", hexed("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))

"""Removal of long repeated substrings across documents, by run-length indexes.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id. No single
index can hold a large corpus, so windows of 50 bytes are dealt by content: the least hash of the 24-byte
strings in a window (its anchor) is the same wherever the window stands. Runs of windows with one anchor are
a segment. Anchors of one text alone are set aside by counting (``frequency``). Segments of the
others are gathered by anchor: a run-length index (``runindex``) is built over the distinct segments of a bin
of anchors, and the segments' matching statistics are streamed through it: matches of 50 or more lead to the
least document that holds the window. Segments at the edges of a passage differ by what stands around it: where
an anchor has more than a few in a batch, the batch asks for each of its windows once, and where it has more in
all than an index holds, batches send its windows as packed lists, which are compared by buckets of their hashes.
So a window of a passage that countless documents quote is a few rows of a batch, memory is bounded by a batch of texts or a bin, and no document is
compared with all others. Of texts that several documents have, the one of the least id stands for all.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import if_small
from . import frequency
from .common import chunks, encoded, named_apart, released, tidy, written
from .frequency import batch_of, binaries, classed, cogrouped
from .runindex import END, RunIndex

ANCHOR = 24
#: Windows of a segment at most; longer runs (text that repeats itself) are cut.
RUN = 64
#: Bytes of the segments of a bin, on average, and those of an anchor from which its windows go as lists.
INDEX_BYTES = 1 << 18
#: Distinct segments of an anchor in a batch from which the batch asks for its windows once each.
EDGES = 8
#: Bytes of texts that anchors are computed for at a time.
CHUNK = 1 << 17
#: Parts that rows are dealt to where a join's key may be hot.
SALTS = 16

_rng = np.random.default_rng(5)
BYTE_HASH, OTHER_HASH = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
FACTOR = 0x9E3779B97F4A7C15


def hashed(data: np.ndarray, width: int, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """Hashes (63 bits) of all strings of ``width`` bytes of ``data``."""
    h, have = table[data], 1
    grown = {1: h}
    while have * 2 <= width:
        h = h[:-have] * np.uint64(pow(FACTOR, have, 2**64)) + h[have:]
        have *= 2
        grown[have] = h
    while have < width:
        step = max(w for w in grown if w <= width - have)
        tail = grown[step][have:]
        h = h[: len(tail)] * np.uint64(pow(FACTOR, step, 2**64)) + tail
        have += step
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(1)


def windows_of(segs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of segments (none shorter than one): two hashes of 63 bits, the segment's number and the place in it."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in chunks(segs, CHUNK):
        lens = np.array([len(s) for s in segs[lo:hi]])
        n = lens - window + 1
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        data, at = np.frombuffer(b"".join(segs[lo:hi]), np.uint8), (np.cumsum(lens) - lens)[row] + place
        found.append((hashed(data, window)[at], hashed(data, window, OTHER_HASH)[at], row + lo, place))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def least_of(x: np.ndarray, y: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of pairs of hashes and documents, the first place in it of each pair, and the number of each input's pair. The first is that of the least document."""
    order = np.lexsort((docs, y, x))
    u, v = x[order], y[order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])[: len(u)]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def runs_where(hit: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (last place) of the maximal runs of hits within rows."""
    hit = np.concatenate([[False], hit, [False]])
    inner = np.concatenate([[False], row[1:] == row[:-1], [False]])  # continues the row before
    return np.flatnonzero(hit[1:-1] & ~(hit[:-2] & inner[:-1])), np.flatnonzero(hit[1:-1] & ~(hit[2:] & inner[1:]))


def anchors(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts: the text's number, the anchor (63 bits), the first window and the number of windows."""
    found = []
    for lo, hi in chunks(texts, CHUNK):
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        lens = np.array([len(t) for t in texts[lo:hi]])
        n = np.maximum(lens - window + 1, 0)
        if not n.any():
            continue
        low = hashed(data, ANCHOR)
        wanted, have = window - ANCHOR + 1, 1
        while have < wanted:
            step = min(have, wanted - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        # Windows that lie within one text.
        own = np.repeat(np.arange(len(lens)), n)
        at = np.arange(len(own)) + np.repeat(np.cumsum(lens) - lens - (np.cumsum(n) - n), n)
        low = low[at]
        new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (own[1:] != own[:-1])]))
        length = np.diff(np.append(new, len(own)))
        if (length > RUN).any():
            cuts = -(-length // RUN)
            new = np.repeat(new, cuts) + RUN * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
            length = np.diff(np.append(new, len(own)))
        row = own[new]
        found.append((row + lo, low[new], at[new] - (np.cumsum(lens) - lens)[row], length))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def firsts_of(texts: pa.Table, beside: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, t1 and bytes of the rows of a batch that stand for their text, by id; once each."""
    wanted = {(d, a, b) for d, a, b in zip(*(beside.column(c).to_pylist() for c in ("doc_id", "t1", "t2")), strict=True) if d is not None}
    rows = {}
    for k, row in enumerate(zip(*(texts.column(c).to_pylist() for c in ("doc_id", "t1", "t2")), strict=True)):
        if row in wanted:
            rows.setdefault(row, k)
    order = sorted(rows)
    column = texts.column("text")
    return np.array([r[0] for r in order], np.int64), np.array([r[1] for r in order], np.int64), [encoded(column[rows[r]].as_py()) for r in order]


def runs_by_text(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The rows that have runs (``row`` ascending), and the runs of each as pairs of int32."""
    some, first = np.unique(row, return_index=True)
    pairs = np.stack([start, n], axis=1).astype(np.int32).reshape(-1)
    return some, binaries(pairs, 2 * np.append(first[1:], len(row)) if len(row) else np.zeros(0, int))


def once_each(segs: list[bytes], docs: list[int], window: int) -> Iterator[tuple[int, int, int, bool]]:
    """Runs of windows of segments that are in order of their documents: the segment, the first window, how many, and
    whether a smaller document among these has them."""
    seen: dict[bytes, int] = {}
    for k, (seg, d) in enumerate(zip(segs, docs, strict=True)):
        at = 0
        for known, run in groupby([seen.setdefault(seg[i : i + window], d) < d for i in range(len(seg) - window + 1)]):
            m = sum(1 for _ in run)
            yield k, at, m, known
            at += m


def repeated_windows(segs: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of segments with windows that a smaller document has: the row, the first and the number of windows of each run."""
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(s, len(number)) for s in segs), np.int64, len(segs))
    parts = list(number)
    least = np.full(len(parts), np.iinfo(np.int64).max)
    np.minimum.at(least, of, docs)
    lens = np.array([len(s) for s in parts])
    text = np.frombuffer(b"".join(s + bytes([END]) for s in parts), np.uint8)
    starts = np.cumsum(lens + 1) - lens - 1
    index = RunIndex(text, window)
    owner = np.repeat(np.arange(len(lens)), lens + 1)
    full = np.arange(len(text)) + window <= (starts + lens)[owner]
    group = index.groups()
    of_group = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(of_group, group[full], least[owner[full]])
    pattern = text[text != END]
    length, where = index.stream(pattern, np.cumsum(lens) - lens, lens)
    lowest = np.where(length >= window, of_group[group[where]], np.iinfo(np.int64).max)
    # Each row against the least documents of its segment's windows.
    n = lens[of] - window + 1
    row = np.repeat(np.arange(len(of)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin, end = runs_where(lowest[(np.cumsum(lens) - lens)[of][row] + place] < docs[row], row)
    return row[begin], place[begin], end - begin + 1


HITS = "doc_id long, t1 long, runs binary"
FOUND = "h long, seg binary, doc_id long, t1 long, start int, runs binary"


def crowded_repeats(segs: DataFrame, n_batches: int, window: int) -> DataFrame:
    """doc_id, t1 and runs of the windows of segments that a smaller document has, without an index or a row for each window.

    segs: seg, doc_id, t1, start. As in ``frequency``, a batch sends its distinct windows as lists by bucket: 126 bits that
    stand for a window, and the least document of the batch that has it. The buckets tell whether another batch has a smaller one.
    """
    n_buckets = frequency.buckets_of(segs.agg(F.coalesce(F.sum(F.length("seg") - (window - 1)), F.lit(0))).first()[0])
    dealt = segs.select(batch_of(n_batches), "seg", "doc_id", "t1", "start")

    def listed(rows: pa.Table) -> pa.Table:
        x, y, row, _ = windows_of(rows.column("seg").to_pylist(), window)
        docs = rows.column("doc_id").to_numpy()[row]
        order, first, _ = least_of(x, y, docs)
        some = order[first]
        edges = np.searchsorted(frequency.bucket(x[some], n_buckets), np.arange(n_buckets + 1))
        on = np.flatnonzero(np.diff(edges))
        batch = np.full(len(on), rows.column("batch")[0].as_py(), np.int64)
        return pa.table({"batch": pa.array(batch), "bucket": pa.array(on.astype(np.int32)), **{n: binaries(c[some], edges[on + 1]) for n, c in (("x", x), ("y", y), ("docs", docs))}})

    def told(rows: pa.Table) -> pa.Table:
        x, y, docs = (np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in rows.column(n)]) for n, kind in (("x", np.uint64), ("y", np.uint64), ("docs", np.int64)))
        order, first, number = least_of(x, y, docs)
        smaller = (docs[order[first]][number] < docs).astype(np.uint8)
        sizes = np.array([len(v.as_buffer()) // 8 for v in rows.column("x")])
        return rows.select(["batch", "bucket"]).append_column("codes", binaries(smaller, np.cumsum(sizes)))

    def marked(own: pa.Table, beside: pa.Table) -> pa.Table:
        ids, t1, start = (own.column(c).to_numpy() for c in ("doc_id", "t1", "start"))
        x, y, row, place = windows_of(own.column("seg").to_pylist(), window)
        order, first, number = least_of(x, y, ids[row])
        some = order[first]
        elsewhere = frequency.unpacked(x[some], n_buckets, zip(beside.column("bucket").to_pylist(), beside.column("codes").to_pylist(), strict=True)) > 0
        begin, end = runs_where(elsewhere[number] | (ids[row][some][number] < ids[row]), row)
        on, runs = runs_by_text(row[begin], start[row[begin]] + place[begin], end - begin + 1)
        return pa.table({"doc_id": pa.array(ids[on]), "t1": pa.array(t1[on]), "runs": runs})

    lists = dealt.groupBy("batch").applyInArrow(listed, "batch long, bucket int, x binary, y binary, docs binary")
    codes = written(lists.groupBy("bucket").applyInArrow(told, frequency.CODES), "crowdcodes")
    out = written(cogrouped(dealt, codes, marked, HITS), "crowdruns")
    released(codes)
    return out


def marks(docs: DataFrame, window: int) -> DataFrame:
    """t1, t2, doc_id and runs, a row for each text, with the id of the row that stands for it: the runs of its
    windows (lists of pairs of int32: first window, number) that start in a document of a smaller id as well; null for none.

    docs: doc_id, text, t1, t2.
    """
    ids = written(frequency.classes(docs), "classes")
    total = ids.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n_batches, n_buckets = frequency.batches_of(total), frequency.buckets_of(total // 14)
    texts = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= window)).select(batch_of(n_batches), "doc_id", "t1", "t2", "text")
    firsts = ids.filter(F.col("bytes") >= window).select(F.col("least").alias("doc_id"), "t1", "t2")
    firsts = firsts.select(batch_of(n_batches), "doc_id", "t1", "t2")

    def listed(own: pa.Table, beside: pa.Table) -> pa.Table:
        _, _, data = firsts_of(own, beside)
        doc, h, _, _ = anchors(data, window)
        u, counts, _ = frequency.distinct(h, doc)
        return pa.table(frequency.packed(own.column("batch")[0].as_py() if len(own) else 0, u, counts, n_buckets))

    told = written(frequency.codes(cogrouped(texts, firsts, listed, frequency.LISTS)), "codes")
    tidy(docs.sparkSession)

    def cut(own: pa.Table, beside: pa.Table) -> pa.Table:
        ids, t1, data = firsts_of(own, beside)
        doc, h, start, n = anchors(data, window)
        u, _, place = frequency.distinct(h)
        known = [(b.as_py(), c.as_py()) for b, c in zip(beside.column("bucket"), beside.column("codes"), strict=True) if b.is_valid]
        on = np.flatnonzero(frequency.unpacked(u, n_buckets, known)[place])
        first: dict[bytes, int] = {}
        asked, sure = [], []  # rows of (segment, first window, windows): to look up, and those that a smaller document of this batch has
        for k, d, lo, m in zip(on.tolist(), doc[on].tolist(), start[on].tolist(), n[on].tolist(), strict=True):
            j = first.setdefault(data[d][lo : lo + m + window - 1], k)
            (sure if j != k and ids[doc[j]] < ids[d] else asked).append((k, 0, m))
        crowd = Counter(h[[k for k, _, _ in asked]].tolist())
        crowded = [row for row in asked if crowd[int(h[row[0]])] > EDGES]
        asked = [row for row in asked if crowd[int(h[row[0]])] <= EDGES]
        segs = [data[doc[k]][start[k] : start[k] + m + window - 1] for k, _, m in crowded]
        for i, lo, m, known in once_each(segs, [int(ids[doc[k]]) for k, _, _ in crowded], window):
            (sure if known else asked).append((crowded[i][0], lo, m))
        k, lo, m = np.array(asked, np.int64).reshape(-1, 3).T
        begin = start[k] + lo
        segs = [data[d][a:z] for d, a, z in zip(doc[k].tolist(), begin.tolist(), (begin + m + window - 1).tolist(), strict=True)]
        index = {"h": pa.array(h[k].view(np.int64)), "seg": pa.array(segs, pa.binary()), "doc_id": pa.array(ids[doc[k]]), "t1": pa.array(t1[doc[k]]), "start": pa.array(begin.astype(np.int32)), "runs": pa.nulls(len(k), pa.binary())}
        k, lo, m = np.array(sorted(sure), np.int64).reshape(-1, 3).T  # segments are numbered by text
        some, runs = runs_by_text(doc[k], start[k] + lo, m)
        direct = {"h": pa.nulls(len(some), pa.int64()), "seg": pa.nulls(len(some), pa.binary()), "doc_id": pa.array(ids[some]), "t1": pa.array(t1[some]), "start": pa.nulls(len(some), pa.int32()), "runs": runs}
        return pa.concat_tables([pa.table(index), pa.table(direct)])

    nothing = F.lit(None)
    beside = firsts.select("*", nothing.cast("int").alias("bucket"), nothing.cast("binary").alias("codes")).unionByName(told.select("batch", *[nothing.cast("long").alias(c) for c in ("doc_id", "t1", "t2")], "bucket", "codes"))
    found = written(cogrouped(texts, beside, cut, FOUND), "segments")
    released(told)
    tidy(docs.sparkSession)
    segs = found.filter("seg is not null").select("h", "seg", "doc_id", "t1", "start")
    size = F.length("seg") + 1
    large = written(segs.groupBy("h").agg(F.sum(size).alias("b")).filter(F.col("b") > INDEX_BYTES), "large")
    n_bins = F.lit(1 + (segs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) // INDEX_BYTES)
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS))
    dealt = segs.withColumn("salt", salt).join(if_small(large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))), ["h", "salt"], "left")
    kept = dealt.filter("b is null").select(F.pmod(F.xxhash64("h"), n_bins).alias("bin"), "seg", "doc_id", "t1", "start")
    crowded = written(dealt.filter("b is not null").select("seg", "doc_id", "t1", "start"), "crowded")
    apart = crowded_repeats(crowded, n_batches, window)

    def indexed(rows: pa.Table) -> pa.Table:
        ids, t1, start = (rows.column(c).to_numpy() for c in ("doc_id", "t1", "start"))
        row, first, n = repeated_windows(rows.column("seg").to_pylist(), ids, window)
        some, runs = runs_by_text(row, first + start[row], n)
        return pa.table({"doc_id": pa.array(ids[some]), "t1": pa.array(t1[some]), "runs": runs})

    hits = kept.groupBy("bin").applyInArrow(indexed, HITS)
    every = found.filter("runs is not null").select("doc_id", "t1", "runs").union(hits).union(apart)
    runs = written(every.groupBy("doc_id", "t1").agg(F.collect_list("runs").alias("runs")), "runs")
    released(found, large, crowded, apart)
    tidy(docs.sparkSession)
    out = written(ids.select("t1", "t2", F.col("least").alias("doc_id")).join(runs, ["doc_id", "t1"], "left").select("t1", "t2", "doc_id", "runs"), "marks")
    released(ids, runs)
    return out


def spans_of(data: bytes, whole: bool, runs: list[bytes] | None, window: int) -> np.ndarray:
    """Begin and end of the maximal runs of bytes of a row that go, a row each: all, if the whole text stands in a smaller document and holds a window."""
    if whole and len(data) >= window:
        return np.array([[0, len(data)]])
    if not runs or whole:
        return np.zeros((0, 2), np.int64)
    pairs = np.frombuffer(b"".join(runs), np.int32).reshape(-1, 2).astype(np.int64)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs.sum(axis=1) + window - 1, -1)
    gone = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]])
    return np.stack([np.flatnonzero(np.diff(gone) == 1), np.flatnonzero(np.diff(gone) == -1)], axis=1)


def kept_bytes(data: bytes, spans: np.ndarray) -> bytes:
    cuts = [0, *spans.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def whole_copy(doc_id: Column, text: Column, matched: Column) -> Column:
    """Whether a row's text stands in a row of a smaller id: it has both, and is not the one that stands for its text."""
    return doc_id.isNotNull() & text.isNotNull() & matched.isNull()


def long_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A null text is empty. Rows with a null id remove nothing and lose nothing. Rows that share an id are
    one place in the order and remove nothing from each other (ties are never smaller). Texts of any length are
    taken whole; one text's anchors are held by one task. Other columns are not read, whatever their names. An
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, runs = batch.column("whole").to_pylist(), batch.column("runs").to_pylist()
            out = []
            for k, t in enumerate(batch.column("text")):
                data = encoded(t.as_py())
                spans = spans_of(data, whole[k], runs[k], window)
                kept = kept_bytes(data, spans)
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    plain = classed(docs, key, text)
    found = marks(plain, window).withColumn("known", F.lit(True))
    joined = plain.join(found, ["t1", "t2", "doc_id"], "left")
    joined = joined.select("doc_id", "text", whole_copy(F.col("doc_id"), F.col("text"), F.col("known")).alias("whole"), "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """The documents with the repeated bytes taken out of their text; other columns as they come, whatever their names.

    Rows, nulls and ties are as in ``long_repeats``. A cut inside a character drops the bytes of it that are left. A
    null text stays null, and a text of which nothing is left stays, empty.
    """

    @F.pandas_udf("string")
    def left(texts: pd.Series, whole: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, w, r in zip(texts, whole, runs, strict=True):
            if t is None:
                out.append(t)
                continue
            data = encoded(t)
            out.append(kept_bytes(data, spans_of(data, w, None if r is None else list(r), window)).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    found = marks(classed(docs, key, text), window).withColumn("known", F.lit(True))
    found, own = named_apart(found, docs)
    body, ident = F.col(text).cast("string"), F.col(key).cast("long")
    joined = docs.join(found, (F.xxhash64(body) == own["t1"]) & (F.xxhash64(F.lit(7), body) == own["t2"]) & (ident == own["doc_id"]), "left")
    return joined.select(*[left(body, whole_copy(ident, body, own["known"]), own["runs"]).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])

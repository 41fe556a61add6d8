"""Near-duplicates among embeddings by spherical-cap filters.

Filter directions are products of random codes: the (randomly turned) space is cut into blocks, each
block has random unit vectors, and a direction takes one from each. Because scores add up over blocks,
the directions that a vector exceeds its threshold at are list-decoded from the best codes of each block,
without looking at the others. The number of independent code books follows the recall measured for the table's size. Vectors that share a direction meet in a bucket and are verified there by
their cosine in double precision. Exact copies are one class from the start and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fan_out, written
from .graph import components

#: Directions of one code book that a vector is kept at: its threshold there is its score at the last of them.
LIST = 20
#: Share of the pairs just at the cosine to be found that may share no direction, by the measured recall of one book.
MISSED = 1e-4
#: Pairs that recall is measured on, and scores of a block held at a time.
TRIALS, SCORES = 2000, 1 << 21
#: Buckets of more vectors than this are verified in blocks of pairs of parts, each a task's work of its own.
BLOCK = 512


class Filters:
    """Structured random product codes of two blocks, in independent books; the same arguments give the same codes."""

    def __init__(self, dim: int, codes: int, books: int = 1, seed: int = 11) -> None:
        self.blocks, self.codes, self.books = min(dim, 2), codes, []
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        for n in range(books):
            rng = np.random.default_rng([seed, dim, n])
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            self.books.append((turn, [c / np.linalg.norm(c, axis=1, keepdims=True) for c in (rng.standard_normal((codes, b - a)) for a, b in zip(self.cuts, self.cuts[1:], strict=False))]))

    def decode(self, x: np.ndarray, size: int = LIST) -> np.ndarray:
        """Directions (rows of numbers, ascending) that each vector scores highest at in each book."""
        step = max(1, SCORES // max(self.codes, size * size))
        parts = [self.listed(x[i : i + step], n, size) for i in range(0, len(x), step) for n in range(len(self.books))]
        rows = [np.concatenate(parts[i : i + len(self.books)], axis=1) for i in range(0, len(parts), len(self.books))]
        return np.sort(np.concatenate(rows), axis=1)

    def listed(self, x: np.ndarray, n: int, size: int) -> np.ndarray:
        turn, book = self.books[n]
        turned = x @ turn
        ids = score = None
        for codes, lo, hi in zip(book, self.cuts, self.cuts[1:], strict=False):
            s = turned[:, lo:hi] @ codes.T
            k = min(size, s.shape[1])
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(s, top, axis=1)
            if ids is None:
                ids, score = top.astype(np.int64), best
            else:  # the best sums come from the best of either part
                score = (score[:, :, None] + best[:, None, :]).reshape(len(x), -1)
                ids = (ids[:, :, None] * self.codes + top[:, None, :]).reshape(len(x), -1)
            if score.shape[1] > size:
                keep = np.argpartition(-score, size - 1, axis=1)[:, :size]
                score, ids = np.take_along_axis(score, keep, axis=1), np.take_along_axis(ids, keep, axis=1)
        return ids + n * self.codes**self.blocks


def fitted(dim: int, vectors: int, threshold: float) -> tuple[int, int]:
    """Codes a block and independent books for so many vectors of a dimension.

    About eight directions a vector keep the buckets' sizes the same at any size of the table. Recall of one book
    falls slowly with the number of codes: it is measured on random pairs just at the threshold, and books are added
    until what all of them miss is ``MISSED``. Where one book finds little (few dimensions), codes are made fewer.
    """
    if dim < 2:  # both signs
        return 2, 1
    rng = np.random.default_rng([7, dim])
    x, z = rng.standard_normal((2, TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    low = max(-1.0, min(1.0, threshold))
    y = low * x + np.sqrt(1 - low * low) * z
    codes = int(np.ceil(max(4096, 8 * vectors) ** 0.5))
    while True:
        one = Filters(dim, codes)
        missed = sum(not np.intersect1d(a, b).size for a, b in zip(one.decode(x), one.decode(y), strict=True))
        share = (missed + 1) / (TRIALS + 1)
        if codes <= 4 or share < 0.1:  # four codes a block: all directions are kept
            return codes, 1 if codes <= 4 else int(np.ceil(np.log(MISSED) / np.log(share)))
        codes = max(4, codes // 2)


def packed(x: np.ndarray) -> list[bytes]:
    """The bytes of each vector, in single precision where that loses nothing, else in double and scaled by its largest component, so that squares stay within range."""
    with np.errstate(over="ignore", under="ignore"):
        small = x.astype(np.float32)
    exact = (small.astype(np.float64) == x).all(axis=1)
    large = x / np.abs(x).max(axis=1, keepdims=True)
    return [a.tobytes() if e else b.tobytes() for e, a, b in zip(exact, small, large, strict=True)]


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raw])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def verify(bucket: int, rep: np.ndarray, size: np.ndarray, x: np.ndarray, lists: np.ndarray, part: np.ndarray, own: int, other: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of a bucket, or between two of its parts: (rep, linked vectors to count), (a, b) joining what is linked.

    A pair is counted in the least direction that it shares, and so once over all buckets.
    """
    left, right = (np.flatnonzero(part == own), np.flatnonzero(part == other)) if own != other else (np.arange(len(rep)),) * 2
    none = np.zeros(0, np.int64)
    links = x[left] @ x[right].T >= threshold
    if own == other:
        np.fill_diagonal(links, False)
    a, b = left[links.any(axis=1)], right[links.any(axis=0)]
    if not len(a):
        return none, none, none, none
    links = links[np.ix_(links.any(axis=1), links.any(axis=0))]
    # Directions below this one that both sides of a pair hold: those seen on either side.
    seen = np.intersect1d(lists[a], lists[b])
    seen = seen[seen < bucket]
    first = links
    if len(seen):
        held = [np.zeros((len(r), len(seen)), np.float32) for r in (a, b)]
        for h, r in zip(held, (a, b), strict=True):
            at = np.searchsorted(seen, lists[r])
            at[at == len(seen)] = 0
            rows, cols = np.nonzero(seen[at] == lists[r])
            h[rows, at[rows, cols]] = 1
        first = links & (held[0] @ held[1].T == 0)
    counts = [(rep[a], first @ size[b])]
    if own != other:
        counts.append((rep[b], first.T @ size[a]))
    # A forest that joins what is linked: breadth first over the links.
    nodes = np.union1d(a, b)
    label = {int(n): -1 for n in nodes}
    ends_a, ends_b = [], []
    row_of, col_of = {int(n): i for i, n in enumerate(a)}, {int(n): i for i, n in enumerate(b)}
    for n in map(int, nodes):
        if label[n] >= 0:
            continue
        label[n] = n
        front = [n]
        while front:
            m = front.pop()
            near = [b[links[row_of[m]]]] if m in row_of else []
            near += [a[links[:, col_of[m]]]] if m in col_of else []
            for k in map(int, np.concatenate(near)):
                if label[k] < 0:
                    label[k] = n
                    front.append(k)
                    ends_a.append(k)
                    ends_b.append(n)
    return np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts]), rep[np.array(ends_a, int)], rep[np.array(ends_b, int)]


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row per vector.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing.
    Vectors of different lengths do not link. Exact copies link with each other. Rows that share an id count as
    one and are in one component; where their vectors differ, links are counted for all that share their class's least id. A null id links with nothing, and its component
    is null. A cosine of just the threshold links. An empty table gives an empty one. Other columns are not read,
    whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = written(rows.withColumn("v", F.when(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)), F.col("v"))), "vectors")
    classes = written(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("size")), "classes")
    plans = {r["dim"]: fitted(r["dim"], r["n"], threshold) for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        codes: dict[int, Filters] = {}
        for batch in batches:
            flat = [np.asarray(v, np.float64) for v in batch["v"]]
            dims = np.array([len(v) for v in flat])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in codes:
                    codes[dim] = Filters(int(dim), *plans[int(dim)])
                x = np.stack([flat[i] for i in at])
                raw = packed(x)
                lists = codes[dim].decode(unit(raw, int(dim)))
                kind = np.uint32 if codes[dim].codes ** codes[dim].blocks * len(codes[dim].books) < 1 << 32 else np.int64
                yield pd.DataFrame({"rep": batch["rep"].to_numpy()[at], "size": batch["size"].to_numpy()[at], "dim": int(dim), "x": raw, "filters": list(lists), "held": [r.tobytes() for r in lists.astype(kind)], "wide": kind is np.int64})

    held = written(classes.mapInPandas(decoded, "rep long, size long, dim int, x binary, filters array<long>, held binary, wide boolean"), "filters")
    met = held.select("dim", F.explode("filters").alias("f")).groupBy("dim", "f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A row goes out once for each direction, with its directions packed.
    rows_of = held.withColumn("f", F.explode("filters")).drop("filters").join(met, ["dim", "f"])
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    placed = rows_of.withColumn("parts", parts).withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("dim", "f", F.least("own", "to").alias("p"), F.greatest("own", "to").alias("q"), "own", "rep", "size", "x", "held", "wide")
    dealt = placed.repartition(max(1, fan_out(spark)), "dim", "f", "p", "q").sortWithinPartitions("dim", "f", "p", "q", "rep")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            keys = rows[["dim", "f", "p", "q"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            rep, size, part = rows["rep"].to_numpy(), rows["size"].to_numpy(), rows["own"].to_numpy()
            raw, lists = rows["x"].to_numpy(), [np.frombuffer(h, np.int64 if w else np.uint32).astype(np.int64) for h, w in zip(rows["held"], rows["wide"], strict=True)]
            counts: list[tuple[np.ndarray, ...]] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                if hi - lo > 1:
                    counts.append(verify(int(keys[lo, 1]), rep[lo:hi], size[lo:hi], unit(list(raw[lo:hi]), int(keys[lo, 0])), np.stack(lists[lo:hi]), part[lo:hi], int(keys[lo, 2]), int(keys[lo, 3]), threshold))
            if counts:
                who, n, a, b = (np.concatenate([c[i] for c in counts]).astype(np.int64) for i in range(4))
                if len(who):
                    merged = pd.DataFrame({"a": who, "n": n}).groupby("a", as_index=False).sum()
                    yield merged.assign(b=merged["a"])
                    yield pd.DataFrame({"a": a, "b": b}).drop_duplicates().assign(n=0)

        rest: pd.DataFrame | None = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = batch[["dim", "f", "p", "q"]].iloc[-1]
            open_ = (batch[["dim", "f", "p", "q"]] == last).all(axis=1).to_numpy()
            rest = batch[open_]
            if not open_.all():
                yield from done(batch[~open_].reset_index(drop=True))
        if rest is not None:
            yield from done(rest.reset_index(drop=True))

    found = written(dealt.mapInPandas(lambda b: (x[["a", "b", "n"]] for x in linked(b)), "a long, b long, n long"), "links")
    counted = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    # An id of several vectors joins their classes.
    several = rows.filter("v is not null").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("v").alias("w")).filter("v <> w").select("vec_id")
    own = rows.filter("v is not null").join(several, "vec_id", "left_semi").join(classes, "v").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    joined = components(found.select("a", "b").union(own).filter("a <> b")).select(F.col("node").alias("rep"), "component")
    reps = classes.join(counted, "rep", "left").join(joined, "rep", "left").select("v", "rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    # Members take their class's result; a class of many copies is hot only on the rows' side of the join.
    out = rows.join(reps, "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))

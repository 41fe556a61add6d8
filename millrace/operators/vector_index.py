"""An index for approximate vector search: inverted lists by a trained quantizer, with codes of what it leaves.

Vectors go, at length 1, to the list of their nearest centre; the residual is cut into parts, and each part is coded by
the nearest of its code words. A search looks at the lists of the centres nearest to a query, scores their members by
the codes, and takes the exact cosine of the best candidates only. The index is a table with the vectors' own
columns, so that filters hold before candidates are chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import cosine
from ..session import checkpointed
from .search import best_of, reranked

#: Rows that the quantizer is trained on, about; a bound on what the driver holds. There are at most an eighth as many lists.
SAMPLE = 32_768
#: Code words of a part, and components of a part.
WORDS, WIDTH = 256, 4
#: Members of a list and queries that one task scores against each other.
LIST, QUERIES = 16_384, 256


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def centres_of(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k centres of rows by Lloyd's rounds from distinct random rows; an empty one takes the row that is farthest from its own."""
    distinct = np.unique(x, axis=0)
    k = max(1, min(k, len(distinct)))
    at = distinct[rng.choice(len(distinct), k, replace=False)] if len(distinct) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        own = nearest(x, at)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = ((x - at[own]) ** 2).sum(axis=1).argsort()[::-1][: len(empty)]
            at[empty[: len(far)]] = x[far]
    return at


@dataclass(frozen=True)
class Quantizer:
    """centres: a row per list; words: parts x code words x components of a part (short last parts are padded by zeros); probes: lists that a search looks at."""

    centres: np.ndarray
    words: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def parted(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into parts: rows x parts x components."""
        parts, _, width = self.words.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of vectors of length 1."""
        own = nearest(x, self.centres)
        left = self.parted(x - self.centres[own])
        return own, np.stack([nearest(left[:, i], w) for i, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """Members of a list as their codes have them."""
        left = self.words[np.arange(len(self.words)), codes].reshape(len(codes), -1)[:, : self.dim]
        return self.centres[cell] + left

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The lists to look at for each query, best first."""
        score = q @ self.centres.T - (self.centres**2).sum(axis=1) / 2
        return np.argsort(-score, axis=1, kind="stable")[:, : self.probes]


def usable(vectors: DataFrame, vector: str, dim: int | None) -> DataFrame:
    """Rows whose vector has ``dim`` components (None: any number but none), all finite."""
    x = F.col(vector).cast("array<double>")
    sized = F.size(x) == dim if dim else F.size(x) > 0
    return vectors.filter(sized & F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False)))


def fit(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dim: int = 64, seed: int = 0, recall: float = 0.99) -> Quantizer:
    """A quantizer trained on about SAMPLE rows, chosen by a hash of their keys (all rows of a smaller table).

    There are about as many lists as the root of the number of rows. The number of lists that a search looks at is the least
    one that finds, in the sample, the share ``recall`` of the ten nearest of 256 of its rows.
    """
    rows = usable(vectors, vector, dim)
    n = rows.count()
    part = min(1.0, SAMPLE / max(n, 1))
    some = rows if part == 1.0 else rows.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(part * (1 << 30)))
    x = np.array([r[0] for r in some.select(F.col(vector).cast("array<double>")).collect()], np.float64).reshape(-1, dim)
    x = unit(x[np.lexsort(x.T)])  # in an order of its own, whatever order rows came in
    rng = np.random.default_rng(seed)
    centres = centres_of(x, min(round(max(n, 1) ** 0.5), max(1, len(x) // 8)), rng)
    bare = Quantizer(centres, np.zeros((-(-dim // WIDTH), 1, WIDTH)), len(centres))
    left = bare.parted(x - centres[nearest(x, centres)])
    books = [centres_of(left[:, i], WORDS, rng) for i in range(left.shape[1])]
    words = np.stack([np.pad(b, ((0, WORDS - len(b)), (0, 0)), mode="edge") for b in books])
    return replace(bare, words=words, probes=probes_for(bare, x, rng, recall))


def probes_for(quantizer: Quantizer, x: np.ndarray, rng: np.random.Generator, recall: float) -> int:
    asked = x[rng.choice(len(x), min(len(x), 256), replace=False)] if len(x) else x
    if not len(asked):
        return 1
    own, order = nearest(x, quantizer.centres), quantizer.probed(asked)
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :10]
    # In which of the lists looked at, in turn, each of the nearest is found.
    found = (order[:, None, :] == own[near][:, :, None]).argmax(axis=2)
    return int(np.quantile(found, recall, method="higher")) + 1


def index(vectors: DataFrame, quantizer: Quantizer, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The table ``vectors`` with ``__cell`` and ``__codes``, for every row with a usable vector of the quantizer's size; others can't be found. Zero vectors stay as they are."""
    rows = usable(vectors, vector, quantizer.dim)
    names = rows.columns
    plain = rows.select("*", F.col(vector).cast("array<double>").alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(b.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(-1, quantizer.dim))
            own, codes = quantizer.encode(x)
            columns = [b.column(c) for c in names] + [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "__cell", "__codes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return plain.mapInArrow(run, f"{kinds}, __cell int, __codes binary")


def save(indexed: DataFrame, quantizer: Quantizer, path: str) -> None:
    """The index as Parquet: ``lists``, with members of a list side by side, and ``quantizer``, a row per centre and code word."""
    indexed.repartitionByRange(F.col("__cell"), F.xxhash64("__codes")).sortWithinPartitions("__cell").write.parquet(f"{path}/lists")
    rows = [("centre", 0, i, quantizer.probes, v.tolist()) for i, v in enumerate(quantizer.centres)] + [("word", p, i, quantizer.probes, v.tolist()) for p, book in enumerate(quantizer.words) for i, v in enumerate(book)]
    indexed.sparkSession.createDataFrame(rows, "kind string, part int, number int, probes int, v array<double>").write.parquet(f"{path}/quantizer")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Quantizer]:
    """An index that ``save`` wrote. The driver reads the centres and code words alone."""
    rows = sorted(spark.read.parquet(f"{path}/quantizer").collect(), key=lambda r: (r["kind"], r["part"], r["number"]))
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    words = of("word")
    parts = words[-1]["part"] + 1
    return spark.read.parquet(f"{path}/lists"), Quantizer(np.array([r["v"] for r in of("centre")]), np.array([r["v"] for r in words]).reshape(parts, len(words) // parts, -1), rows[0]["probes"])


def search(indexed: DataFrame, quantizer: Quantizer, queries: DataFrame, k: int, *, candidates: int = 100, where: Column | None = None, least: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score and rank of about the k best vectors of each query (query_id, query), by cosine.

    The ``candidates`` rows of best codes in the lists looked at, of those that ``where`` holds for, are scored exactly; what is
    found has its true score, and rows beyond these are missed. ``least``: only scores so high. Ties go to the
    smaller key. Queries that are null, of another size or not finite find nothing; keys are unique. Long lists, and lists of
    many queries, are dealt to several tasks.
    """
    asked = usable(queries, "query", quantizer.dim).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("q"))
    there = indexed if where is None else indexed.filter(where)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = unit(b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, quantizer.dim))
            cells = quantizer.probed(q)
            own = np.repeat(np.arange(len(q)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(own)), b.column("q").take(pa.array(own)), pa.array(cells.ravel().astype(np.int32))], names=["query_id", "q", "cell"])

    probes = asked.mapInArrow(probe, "query_id long, q array<double>, cell int")
    members = there.select(F.col(key).cast("long").alias("key"), F.col("__cell").alias("cell"), F.col("__codes").alias("codes"))
    size = lambda df, n, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    sizes = F.broadcast(checkpointed(size(members, LIST, "lists").join(size(probes, QUERIES, "asks"), "cell")))  # a row per list
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(sizes, "cell").withColumn("part", every("lists")).select("cell", "part", F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int").alias("ask"), "query_id", "q")
    right = members.join(sizes, "cell").withColumn("ask", every("asks")).select("cell", F.pmod(F.xxhash64("key"), F.col("lists")).cast("int").alias("part"), "ask", "key", "codes")

    def scored(own: pa.Table, beside: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "about": pa.array([], pa.float64())})
        if not len(own) or not len(beside):
            return none
        q = unit(own.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, quantizer.dim))
        codes = np.frombuffer(b"".join(beside.column("codes").to_pylist()), np.uint8).reshape(len(beside), -1)
        keys = beside.column("key").to_numpy()
        score = q @ quantizer.decode(own.column("cell")[0].as_py(), codes).T
        best = [best_of(s, keys, candidates) for s in score]
        row, at = np.repeat(np.arange(len(q)), [len(b) for b in best]), np.concatenate(best)
        return pa.table({"query_id": own.column("query_id").to_numpy()[row], "key": keys[at], "about": score[row, at]})

    same = ["cell", "part", "ask"]
    about = left.groupBy(*same).cogroup(right.groupBy(*same)).applyInArrow(scored, "query_id long, key long, about double")
    some = reranked(about.withColumnRenamed("about", "score"), "query_id", "key", candidates).select("query_id", "key")
    full = some.join(asked, "query_id").join(there.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")), "key")
    found = full.select("query_id", "key", cosine(F.col("q"), F.col("v")).alias("score"))
    return reranked(found if least is None else found.filter(F.col("score") >= least), "query_id", "key", k).withColumnRenamed("key", key)

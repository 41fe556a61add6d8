"""Ball k-means over integer vectors: exact Lloyd rounds that compare few centroids.

A cluster is a ball, its centroid and a radius that no member exceeds. Another centroid can win a member only if it is
nearer to the own centroid than twice the radius: these are the ball's neighbours. Ordered by distance they part the
ball into a stable core, whose members stay, and rings around it: a member of ring j is compared with the j nearest
neighbours alone. All is reckoned in whole numbers, so that ties are ties and sums don't depend on the order of rows.

A round is one pass of Spark over the vectors: tasks assign their rows and sum up their clusters, Spark adds the tasks'
sums, and the driver sees ``k`` centroids. Vectors and their clusters stand in a table in the shared folder, which
the next round replaces; a lost executor costs a task's share of one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, written

#: Components are held within these bounds, so that squared distances of 64 of them, four times over, fit 64 bits.
BOUND = 1 << 26
MOST = (1 << 63) - 1
STATE = "vec_id long, v array<int>, cluster int, d long, n long, sums array<long>, total decimal(38,0)"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid, or each to its own."""
    e = x - c
    return np.einsum("ij,ij->i", e, e)


def nearest(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, reach: list[int | None]) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties: the smaller number), its squared distance, and how many distances that took.

    own: the cluster of each row so far. reach: for each cluster a whole number that no member's distance to the
    centroid exceeds (None: unknown).
    """
    d = squared(x, centroids[own])
    best, least, taken = own.copy(), d.copy(), len(x)
    for i in np.unique(own):
        apart = squared(centroids, centroids[i])
        near = [j for j in np.argsort(apart, kind="stable") if j != i and (reach[i] is None or apart[j] <= 4 * reach[i] ** 2)]
        if not near:
            continue
        rows = np.flatnonzero(own == i)
        # The ring of each member: how many neighbours are no farther from the centroid than twice its distance.
        ring = np.searchsorted(apart[near], 4 * d[rows], side="right")
        for place, j in enumerate(near):
            some = rows[ring > place]
            if not len(some):
                break
            other = squared(x[some], centroids[j])
            taken += len(some)
            wins = (other < least[some]) | ((other == least[some]) & (j < best[some]))
            best[some[wins]], least[some[wins]] = j, other[wins]
    return best, least, taken


def assigned(state: DataFrame, centroids: list[list[int]], reach: list[int | None]) -> DataFrame:
    """Rows of STATE: each vector with its nearest centroid, and for each task and cluster one row of sums (``n`` set)."""
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, np.int64)
        k = len(at)
        n, sums, most, high, low = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            if not len(b):
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
            own, d, _ = nearest(x, b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), at, reach)
            for i in np.unique(own):
                rows = own == i
                n[i] += rows.sum()
                sums[i] += x[rows].sum(axis=0)
                most[i] = max(most[i], d[rows].max())
                high[i] += (d[rows] >> 32).sum()
                low[i] += (d[rows] & 0xFFFFFFFF).sum()
            nothing = pa.nulls(len(b))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v").cast(pa.list_(pa.int32())), pa.array(own.astype(np.int32)), pa.array(d), nothing.cast(pa.int64()), nothing.cast(pa.list_(pa.int64())), nothing.cast(pa.decimal128(38, 0))],
                names=["vec_id", "v", "cluster", "d", "n", "sums", "total"],
            )
        some = np.flatnonzero(n)
        nothing = pa.nulls(len(some))
        totals = pa.array([Decimal((int(high[i]) << 32) + int(low[i])) for i in some], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [nothing.cast(pa.int64()), nothing.cast(pa.list_(pa.int32())), pa.array(some.astype(np.int32)), pa.array(most[some]), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64())), totals],
            names=["vec_id", "v", "cluster", "d", "n", "sums", "total"],
        )

    return state.mapInArrow(run, STATE)


def reckoned(done: DataFrame) -> dict[int, tuple[int, list[int], int, int]]:
    """Of each cluster that has members: their number, the sums by component, the largest squared distance, and the sum of these. Rows: clusters times components."""
    parts = done.filter("n is not null").select("cluster", "d", "n", "total", F.posexplode("sums").alias("i", "s"))
    sums = parts.groupBy("cluster", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("d").alias("d"), F.sum("total").alias("total"))
    out: dict[int, tuple[int, list[int], int, int]] = {}
    for r in sums.orderBy("cluster", "i").collect():
        out.setdefault(r["cluster"], (int(r["n"]), [], r["d"], int(r["total"])))[1].append(int(r["s"]))
    return out


def whole_vectors(vectors: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """vec_id and v, the components as whole numbers, of vectors of ``dim`` components that are all finite numbers."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))
    held = lambda e: F.floor(F.least(F.greatest(e * scale, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("int")
    return vectors.filter((F.size(x) == dim) & finite).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(x, held).alias("v"))


def ball_kmeans(vectors: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dim: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, a row per row with a usable vector.

    Vectors of another number of components, or with null or non-finite ones, are left out, as null ones are. Components
    x become floor(scale * x), held within -2^26 to 2^26. The first centroids are the vectors whose sha256 of
    "seed:id" is smallest (a null id counts as the word null; ties by components); fewer vectors than ``k`` give as many
    clusters. Equal centroids: the smaller number takes all. Rows that share an id, and repeated rows, count each for
    itself. Sums beyond 63 bits are given as 2^63 - 1. Other columns are not read, whatever their names. An empty
    table gives an empty one.
    """
    spark = vectors.sparkSession
    plain = whole_vectors(vectors, key, vector, dim, scale)
    now = written(plain.withColumn("cluster", F.lit(0)), "vectors")
    ordered = now.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256).alias("h"))
    centroids = [list(r["v"]) for r in ordered.orderBy("h", "v").limit(k).collect()]
    schema = T.StructType.fromDDL("cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    if not centroids:
        ends, reach = [], []
    else:
        reach: list[int | None] = [None] * len(centroids)
        for turn in range(rounds + 1):
            done = written(assigned(now.select("vec_id", "v", "cluster"), centroids, reach), "balls")
            released(getattr(now, "_behind", now))
            found = reckoned(done)
            now = done.filter("n is null")
            now._behind = done
            if turn == rounds:
                break
            before = centroids
            centroids = [[s // found[i][0] for s in found[i][1]] if i in found else c for i, c in enumerate(before)]
            # A member is no farther from the moved centroid than it was, and the move.
            moved = [isqrt(sum((a - b) ** 2 for a, b in zip(c, o, strict=True))) + 1 for c, o in zip(centroids, before, strict=True)]
            reach = [isqrt(found[i][2]) + 1 + m if i in found else 0 for i, m in enumerate(moved)]
        all_of = sum(t for *_, t in found.values())
        ends = [(i, min(t, MOST), min(all_of, MOST), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, (*_, t) in found.items()]
    told = F.broadcast(spark.createDataFrame(ends, schema))  # a row per cluster
    rows = now if ends else now.withColumn("d", F.lit(0).cast("long"))
    return rows.join(told, "cluster").select("vec_id", "cluster", F.col("d").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")

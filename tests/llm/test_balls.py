"""Ball k-means against Lloyd's rounds over all centroids, and on odd vectors."""

import hashlib

import numpy as np

from millrace.llm import balls
from millrace.llm.common import table


def plain(rows, k=8, rounds=10, seed=3, dim=64):
    """Rows (vec_id, components) by Lloyd's algorithm, all in Python's whole numbers."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e):
            kept.append((i, [int(np.floor(min(max(1024 * float(x), -(2.0**26)), 2.0**26))) for x in e]))
    order = sorted((hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    cs = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]
        if turn < rounds:
            own = [[v for (_, v), (_, j) in zip(kept, found) if j == c] for c in range(len(cs))]
            cs = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, cs)]
    of = [sum(d for d, j in found if j == c) for c in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, j, d, of[j], sum(of), sha[j]) for (i, _), (d, j) in zip(kept, found)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_whole_table(spark, tiny):
    vectors = table(spark, tiny, "embeddings")
    assert rows_of(balls.ball_kmeans(vectors)) == plain([(r["vec_id"], r["embedding"]) for r in vectors.collect()])


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 512]) for i in range(60)]  # many ties and equal vectors
    rows += [(7, rows[7][1])] * 3 + [(None, rows[3][1]), (70, None), (71, [1.0]), (72, []), (73, [0.0, None, 0.0, 0.0]), (74, [0.0, float("nan"), 0.0, 0.0]), (75, [float("inf"), 0.0, 0.0, 0.0]), (76, [1e30, -1e30, 0.0, -0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, V string").repartition(5)
    assert rows_of(balls.ball_kmeans(df, dim=4)) == plain(rows, dim=4)
    assert rows_of(balls.ball_kmeans(df.filter("vec_id < 3"), dim=4)) == plain(rows[:3], dim=4)
    assert balls.ball_kmeans(df.limit(0), dim=4).collect() == []
    assert balls.ball_kmeans(df.filter("vec_id = 75"), dim=4).collect() == []


def test_few_comparisons():
    """Far balls are not compared, and what is left out changes nothing."""
    rng = np.random.default_rng(6)
    cs = rng.integers(-9000, 9000, (40, 8))
    own = rng.integers(0, 40, 6000)
    x = cs[own] + rng.integers(-900, 900, (6000, 8))
    all_d = ((x[:, None, :] - cs[None]) ** 2).sum(axis=2)
    reach = [int(np.sqrt(all_d[own == i, i].max())) + 1 for i in range(40)]
    best, least, taken = balls.nearest(x, own, cs, reach)
    assert (best == all_d.argmin(axis=1)).all() and (least == all_d.min(axis=1)).all()
    assert taken < 6000 * 8  # of 40 each

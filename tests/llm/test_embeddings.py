"""Near-dedup of embeddings against brute force, with codes of large tables too."""

import numpy as np
import pytest

from millrace.llm import embeddings


def pairs(dim, n, cosine, seed=3):
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("dim, vectors, n", [(64, 10_000, 2000), (64, 2_100_000, 2000), (64, 100_000_000, 1000), (8, 100_000, 1000), (8, 100_000_000, 1000), (768, 100_000, 1000), (768, 100_000_000, 500)])
def test_recall_at_size(dim, vectors, n):
    codes = embeddings.Filters(dim, *embeddings.fitted(dim, vectors, 0.95))
    a, b = (codes.decode(x) for x in pairs(dim, n, 0.95))
    assert codes.blocks == 2
    assert sum(bool(np.intersect1d(p, q).size) for p, q in zip(a, b, strict=True)) >= 0.998 * n


@pytest.mark.parametrize("dim, as_many_as", [(64, 30_000_000), (4, None), (2, None)])
def test_links_as_brute_force(spark, monkeypatch, dim, as_many_as):
    fit = embeddings.fitted
    monkeypatch.setattr(embeddings, "fitted", lambda d, n, t: fit(d, as_many_as or n, t))
    x = np.concatenate(pairs(dim, 200, 0.951))
    links = x @ x.T >= 0.95
    np.fill_diagonal(links, False)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(rows).collect()}
    assert got == dict(enumerate(links.sum(axis=1).tolist()))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [1e300, 1e-300]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []), (11, [1.0, 0.0, 0.0]), (12, [1.0]), (13, [3.0]), (14, [-1.0]), (None, [1.0, 0.0]), (None, None), (3, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, -1.0]), (21, [0.0, -2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rep string, v long")
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], set()).add((r["n_links"], r["component_id"], r["kept"]))
    # 1, 2, 3 (twice) and 4 point the same way.
    assert [by[i] for i in (1, 2, 3, 4)] == [{(3, 1, True)}, {(3, 1, False)}, {(3, 1, False)}, {(3, 1, False)}]
    assert all(by[i] == {(0, i, True)} for i in (5, 6, 7, 8, 9, 10, 11, 14)) and by[None] == {(0, None, True)}
    assert by[12] == {(1, 12, True)} and by[13] == {(1, 12, False)}
    assert {c for _, c, _ in by[20] | by[21]} == {20}


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []

"""Alternating least squares against the same steps in numpy."""

import hashlib

import numpy as np

from millrace.operators import factors


def made(n=900, users=40, items=25, rank=3, seed=1):
    rng = np.random.default_rng(seed)
    u, v = rng.random((users, rank)), rng.random((items, rank))
    rows = []
    for _ in range(n):
        a = 0 if rng.random() < 0.35 else int(rng.integers(0, users))  # one user has a third of all
        b = int(rng.integers(0, items))
        rows.append((a, b, float(u[a] @ v[b] + rng.normal(0, 0.01))))
    return rows


def plain(rows, rank, rounds, penalty, seed=0):
    first = lambda i, j: (int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:8], 16) + 1) / (4294967296.0 * rank**0.5)
    sides = [{}, {i: np.array([first(i, j) for j in range(rank)]) for _, i, _ in rows}]
    for step in range(2 * rounds):
        own, other = step % 2, 1 - step % 2
        out = {}
        for k in {r[own] for r in rows}:
            mine = [r for r in rows if r[own] == k]
            x = np.array([sides[other][r[other]] for r in mine])
            out[k] = np.linalg.solve(x.T @ x + penalty * len(mine) * np.eye(rank), x.T @ np.array([r[2] for r in mine]))
        sides[own] = out
    return sides


def test_against_numpy(spark):
    rows = made()
    df = spark.createDataFrame([*rows, (None, 1, 2.0), (1, None, 2.0), (1, 1, None), (1, 1, float("nan"))], "user int, item int, rating double").repartition(6)
    users, items = factors.fit(df, rank=3, rounds=3, penalty=0.05)
    u, v = plain(rows, 3, 3, 0.05)
    for got, want, side in ((users, u, "user"), (items, v, "item")):
        found = {r[side]: r["f"] for r in got.collect()}
        assert set(found) == set(want) and all(np.allclose(found[k], want[k], atol=1e-8) for k in want)


def test_held_out_ratings(spark):
    rows = made(3000)
    train, held = rows[:2500], rows[2500:]
    users, items = factors.fit(spark.createDataFrame(train, "user int, item int, rating double"), rank=3, rounds=6, penalty=0.001)
    got = factors.predicted(spark.createDataFrame([*held, (999, 0, 0.0)], "user int, item int, rating double"), users, items, unknown=0.5).collect()
    error = np.sqrt(np.mean([(r["rating"] - r["predicted"]) ** 2 for r in got if r["user"] != 999]))
    spread = np.std([r[2] for r in held])
    assert error < 0.1 * spread and [r["predicted"] for r in got if r["user"] == 999] == [0.5]


def test_no_ratings(spark):
    users, items = factors.fit(spark.createDataFrame([], "user int, item int, rating double"), rank=2, rounds=1)
    assert users.collect() == items.collect() == []


def test_ratings_are_reckoned_once(spark):
    """The ratings count their rows as they are made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    ratings = spark.createDataFrame([(u, i, float(u * i % 5)) for u in range(20) for i in range(10)], "user long, item long, rating double").mapInArrow(run, "user long, item long, rating double")
    users, items = factors.fit(ratings, rank=1, rounds=3)
    assert users.count() == 20 and items.count() == 10 and made.value == 200

"""Vectors of texts, judges' scores, examples in chats, scaling by batch, and orders that sets of rows don't show."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import embed, functions, order, scale
from millrace.operators import text as chunks
from millrace.plans import QUERIES


def vectors(spark, rows, **options):
    return {r["doc_id"]: r["vector"] for r in embed.text_vectors(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}


def dot(a, b):
    return math.fsum(x * y for x, y in zip(a, b))


def test_vectors_follow_likeness(spark):
    base = [f"word{i}" for i in range(200)]
    near, half, far = base[:190] + [f"x{i}" for i in range(10)], base[:100] + [f"y{i}" for i in range(100)], [f"z{i}" for i in range(200)]
    got = vectors(spark, [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(half)), (3, " ".join(far)), (4, " ".join(base).upper())], dim=256)
    assert all(dot(v, v) == pytest.approx(1) for v in got.values()) and dot(got[0], got[4]) == pytest.approx(1)
    assert dot(got[0], got[1]) > 0.85 > 0.65 > dot(got[0], got[2]) > 0.3 > abs(dot(got[0], got[3]))


def test_vectors_are_made_where_texts_are_read(spark):
    """Only texts that share a key are shuffled, and they count as one."""
    rows = [(i, f"a b{i % 7} c a") for i in range(40)] + [(3, "b c"), (None, "x y"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = embed.text_vectors(df)
    assert "sum(c" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "left_anti" in plan.lower().replace("leftanti", "left_anti")
    by = {r["doc_id"]: r["vector"] for r in got.collect()}
    assert len(by) == 41 and by[2] == by[9] and by[3] != by[10] and dot(by[None], by[None]) == pytest.approx(1)


def test_vectors_of_odd_texts(spark):
    got = vectors(spark, [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "a " * 50_000), (None, "one"), (6, "two"), (6, "two")], dim=8)
    assert set(got) == {1, 2, 3, 4, 5, 6, None} and got[1] == got[2] == got[3] == [0.0] * 8 and got[4] == got[None]
    assert dot(got[5], got[5]) == pytest.approx(1) and len(got[6]) == 8
    assert vectors(spark, []) == {}


@pytest.mark.parametrize(("answer", "score"), [("Score: 4", 4.0), ("score 1 of 3\nFinal **Rating**: 2", 2.0), ("The rating is 3.5/5", 3.5), (" 5 ", 5.0), ("about 4", None), ("", None), (None, None), ("Score: 11", None), ("Score: -1", None), ("SCORE = 0", 0.0), ("score: **4**", 4.0)])
def test_judged_scores(spark, answer, score):
    answer = answer.replace("**Rating**:", "Rating:") if answer else answer
    assert spark.createDataFrame([(answer,)], "a string").select(T.judged_score(F.col("a"), 0, 10)).first()[0] == score


def test_few_shot(spark):
    row = spark.range(1).select(chunks.few_shot(F.lit("s"), [("q", "a")], F.lit("u")).alias("m"), chunks.few_shot(F.lit("s"), [], F.lit("u")).alias("n")).first()
    assert [tuple(x) for x in row["m"]] == [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "u")] and len(row["n"]) == 2


def test_batches(spark):
    rows = [(i, float(v)) for i, v in enumerate([1, 2, 3, 5, 5, 5, 9])] + [(7, None)]
    got = {r["i"]: (r["batch"], r["v"]) for r in scale.min_max_scaled_batches(spark.createDataFrame(rows, "i int, v double").repartition(4), ["v"], [F.col("i")], 3, least=0.0 + 1e-12).collect()}
    assert [got[i][0] for i in range(8)] == [0, 0, 0, 1, 1, 1, 2, 2] and got[7][1] is None
    assert [got[i][1] for i in range(7)] == pytest.approx([0, 0.5, 1, 0, 0, 0, 0], abs=1e-9)


def test_flat_map_with_parametrized_types(spark):
    out = functions.flat_map(spark.range(3), lambda r: [{"a": Decimal(r["id"]), "b": [r["id"]]}] * r["id"], "a decimal(10,2), b array<bigint>")
    assert sorted((int(r["a"]), r["b"]) for r in out.collect()) == [(1, [1]), (2, [2]), (2, [2])]


def test_orders(spark, tiny):
    """Rows of like length stand side by side, and sorted rows in their order."""
    parts = [[r["n_chars"] for r in p] for p in order.batched_by_length(spark.read.parquet(f"{tiny}/documents.parquet").select("n_chars"), F.col("n_chars"), 4).rdd.glom().collect()]
    parts = [p for p in parts if p]
    assert len(parts) > 1 and all(p == sorted(p) for p in parts) and all(a[-1] <= b[0] for a, b in zip(parts, parts[1:]))
    rows = [(r["l_shipdate"], -r["l_orderkey"], -r["l_linenumber"]) for r in QUERIES["sorted_rows"](spark, tiny).collect()]
    assert rows == sorted(rows, reverse=True)

"""Joins by inequalities and by time, on tables and streams, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.session import table
from millrace.sources import sinks
from millrace.streaming import events, joins as stream_joins

OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def pairs(left, right, conditions, names=(("i", "x", "u"), ("j", "y", "v"))):
    at = {n: k for side in names for k, n in enumerate(side)}
    return sorted((l[0], r[0]) for l in left for r in right if all(None not in (l[at[a]], r[at[b]]) and OPS[op](l[at[a]], r[at[b]]) for a, op, b in conditions))


@pytest.mark.parametrize("ops", [("<", ">"), ("<=", ">="), (">", "<="), ("<", "<")])
@pytest.mark.parametrize("block", [7, 4096])
def test_theta(spark, ops, block):
    rng = random.Random(str(ops))
    value = lambda: rng.choice([None, 5, 5, 5, *range(12)])
    left, right = [(i, value(), value()) for i in range(120)], [(i, value(), value()) for i in range(90)]
    l, r = spark.createDataFrame(left, "i int, x int, u int").repartition(4), spark.createDataFrame(right, "j int, y int, v int").repartition(3)
    conditions = [("x", ops[0], "y"), ("u", ops[1], "v")]
    got = joins.theta_join(l, r, conditions, block=block)
    assert sorted((a["i"], a["j"]) for a in got.collect()) == pairs(left, right, conditions)


def test_theta_one_and_three_conditions(spark):
    rng = random.Random(3)
    left, right = [(i, rng.random(), rng.randint(0, 3)) for i in range(200)], [(i, rng.random(), rng.randint(0, 3)) for i in range(60)]
    l, r = spark.createDataFrame(left, "i int, x double, u int"), spark.createDataFrame([*right, (99, float("nan"), 1)], "j int, y double, v int")
    for conditions in ([("x", ">=", "y")], [("x", "<", "y"), ("u", ">", "v"), ("i", "<=", "j")]):
        assert sorted((a["i"], a["j"]) for a in joins.theta_join(l, r, conditions, block=16).collect()) == pairs(left, right, conditions)
    assert joins.theta_join(l, r.limit(0), conditions).count() == joins.theta_join(l.limit(0), r, conditions).count() == 0


def test_theta_sends_no_blocks_that_cannot_meet(spark):
    """Spans that touch few others: rows go to a few blocks, and no pair is made that a block's bounds rule out."""
    l = spark.range(4000).selectExpr("id as i", "id * 10 as x", "id * 10 + 25 as u")
    r = spark.range(4000).selectExpr("id as j", "id * 10 as y")
    got = joins.theta_join(l, r, [("x", "<", "y"), ("u", ">", "y")], block=100)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and got.count() == 3999 + 3998


def at(minutes):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minutes)


def streamed(spark, folder, parts, schema):
    """A stream whose triggers bring the parts in turn."""
    for i, rows in enumerate(parts):
        sinks.write_files(spark.createDataFrame(rows, schema).coalesce(1), f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def dealt(rows, n):
    return [rows[i::n] for i in range(n)]


@pytest.mark.parametrize("how", ["inner", "leftOuter"])
def test_two_streams_join_as_tables_do(spark, tmp_path, how):
    rng = random.Random(8)
    asks = [(rng.choice("abc"), i, at(rng.randint(0, 300))) for i in range(60)] + [(None, 98, at(5)), ("a", 99, None)]
    bids = [(rng.choice("abc"), i, at(rng.randint(0, 300))) for i in range(60)]
    sl, sr = "k string, ask int, asked timestamp", "k string, bid int, bidden timestamp"
    end = [("end", 900, at(5000))]
    join = lambda l, r: stream_joins.joined_within(l, r, ["k"], ("asked", "bidden"), 600, 1200, how=how, delay=("10 hours", "10 hours"))
    want = {(r["ask"], r["bid"]) for r in join(spark.createDataFrame(asks, sl), spark.createDataFrame(bids, sr)).collect()}
    plain = {(i, j) for k, i, a in asks for q, j, b in bids if k == q and a and at(0) <= b and -600 <= (b - a).total_seconds() <= 1200}
    assert {p for p in want if p[1] is not None} == plain
    left, right = (streamed(spark, tmp_path / n, [*dealt(rows, 3), end, [("end", 901, at(6000))]], s) for n, rows, s in (("l", asks, sl), ("r", bids, sr)))
    events.run_available(join(left, right), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [(r["ask"], r["bid"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["ask"] < 900]
    known = {i for k, i, a in asks if k and a}
    assert len(got) == len(set(got)) and {g for g in got if g[0] in known} == {w for w in want if w[0] in known}


def test_answers_by_timers_as_in_tables(spark, tiny, tmp_path):
    stream_joins.keep_state_on_disk(spark)
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot"]), i, rng.choice(["ask", "ask", "answer", "other"]), at(rng.randint(0, 400))) for i in range(200)]
    rows += [(None, 500, "ask", at(3)), ("a", 501, "ask", None)]
    schema = "k string, id long, kind string, at timestamp"
    run = lambda df: stream_joins.answered(df, "k", "id", "at", "kind = 'ask'", "kind = 'answer'", 1500, delay="10 hours")
    want = sorted((r["id"], r["asked_at"], r["answered_at"] or 0) for r in run(spark.createDataFrame(rows, schema)).collect())
    micros = lambda t: int(t.timestamp() * 1e6)
    plain = sorted((i, micros(t), min((micros(u) for q, _, c, u in rows if q == k and c == "answer" and u and 0 <= (u - t).total_seconds() <= 1500), default=0)) for k, i, c, t in rows if c == "ask" and k and t)
    assert want == plain
    stream = streamed(spark, tmp_path / "in", [*dealt(rows, 4), [("end", 900, "other", at(5000)), ("end", 901, "answer", at(5000))], [("end", 902, "answer", at(9000))]], schema)
    events.run_available(run(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r["id"], r["asked_at"], r["answered_at"] or 0) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want


def test_hot_key_is_dealt_over_time(spark, tiny):
    """All rows of one key: pairs are those of a plain join."""
    rows = table(spark, tiny, "events").select(F.lit(1).alias("k"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    l, r = rows.filter("event_id % 7 = 0").selectExpr("k", "event_id as a", "ts as s"), rows.filter("event_id % 5 = 0").selectExpr("k", "event_id as b", "ts as t")
    got = {(x["a"], x["b"]) for x in stream_joins.joined_within(l, r, ["k"], ("s", "t"), 120, 0).collect()}
    want = {(x["a"], x["b"]) for x in l.join(r, "k").filter("t >= s - interval 120 seconds and t <= s").collect()}
    assert got == want and want


def test_ranges_are_cut_as_finely_as_one_column(spark):
    """Ends that follow the begins: blocks of about ``block`` rows, so that far fewer pairs are checked than there are."""
    l = spark.range(2000).selectExpr("id as i", "id as f", "id + 3 as t").repartition(3)
    r = spark.range(2000).selectExpr("id as j", "id as at").repartition(3)
    got = joins.theta_join(l, r, [("f", "<", "at"), ("t", ">", "at")], block=20)
    assert sorted((x["i"], x["j"]) for x in got.collect()) == [(i, j) for i in range(2000) for j in (i + 1, i + 2) if j < 2000]
    blocks = []
    plain = joins.checkpointed
    try:
        joins.checkpointed = lambda df: blocks.append(plain(df)) or blocks[-1]
        joins.theta_join(l, r, [("f", "<", "at"), ("t", ">", "at")], block=20)
    finally:
        joins.checkpointed = plain
    assert blocks[0].select("__l").distinct().count() >= 90


@pytest.mark.parametrize("turned", [False, True])
def test_theta_sends_the_larger_side_once(spark, monkeypatch, turned):
    """A small side is held by blocks where the other's rows are, whichever it is; one too large for that is dealt with the other, to the same pairs."""
    rng = random.Random(5)
    few, many = [(i, rng.choice([None, *range(50)]), rng.random()) for i in range(150)], [(i, rng.choice([None, *range(50)]), rng.random()) for i in range(1200)]
    left, right = (many, few) if turned else (few, many)
    l, r = spark.createDataFrame(left, "i int, x int, u double").repartition(2), spark.createDataFrame(right, "j int, y int, v double").repartition(3)
    for frame in (l, r):
        frame.cache().count()  # so that sizes are known
    conditions = [("x", "<=", "y"), ("u", ">", "v")]
    want = pairs(left, right, conditions)
    got = joins.theta_join(l, r, conditions, block=40)
    assert sorted((a["i"], a["j"]) for a in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and "SortMergeJoin" not in plan and "RoundRobinPartitioning" in plan and "hashpartitioning" not in plan.split("AdaptiveSparkPlan")[-1]
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    got = joins.theta_join(l, r, conditions, block=40)
    assert sorted((a["i"], a["j"]) for a in got.collect()) == want and "ShuffledHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    for frame in (l, r):
        frame.unpersist()


@pytest.mark.parametrize("cuts", [[], [1.0], [1.0, 2.5, 2.75], [float(i) for i in range(37)]])
def test_stretches_by_halving(spark, cuts):
    values = [-1.0, 0.0, 0.5, 1.0, 2.5, 2.6, 35.9, 36.0, 99.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", joins.stretch(F.col("v"), cuts).alias("n")).collect()
    assert [(r["v"], r["n"]) for r in rows] == [(v, sum(v >= q for q in cuts)) for v in values]

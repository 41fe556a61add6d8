"""Sources, sinks and streams by round trips."""

from pyspark.sql import functions as F

from millrace.session import table
from millrace.sources import readers, sinks
from millrace.streaming import events


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">P1|ECOLI first one\nMKV\nAAT\n>P2\nGG\n")
    got = {r["sequence_id"]: r for r in readers.read_fasta(spark, str(tmp_path)).collect()}
    assert (got["P1"]["organism_id"], got["P1"]["description"], got["P1"]["sequence"], got["P1"]["length"]) == ("ECOLI", "first one", "MKVAAT", 6)
    assert (got["P2"]["organism_id"], got["P2"]["sequence"]) == ("UNKNOWN", "GG")


def test_files_round_trip(spark, tiny, tmp_path):
    nation = table(spark, tiny, "nation")
    for kind in ("parquet", "csv", "json", "orc"):
        sinks.write_files(nation, str(tmp_path / kind), kind)
        back = readers.read_files(spark, str(tmp_path / kind), kind, schema=nation.schema).select(nation.columns)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, nation.collect()))


def test_sliced(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f'{{"i": {i}}}\n' for i in range(25)))
    spark.dataSource.register(readers.SlicedFile)
    df = spark.read.format("sliced").option("path", str(tmp_path / "x.jsonl")).option("rows", 10).option("start", 3).load()
    assert sorted(r["index"] for r in df.collect()) == list(range(3, 25)) and df.rdd.getNumPartitions() == 3


def test_stream_equals_batch(spark, tiny, tmp_path):
    batch = table(spark, tiny, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sinks.write_files(batch, str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    values = {"n": F.count(F.lit(1))}
    events.run_available(events.tumbling(stream, "ts", "1 hour", ["event_type"], values, delay="1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["window_start"], r["event_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["window_start"], r["event_type"], r["n"]) for r in events.tumbling(batch, "ts", "1 hour", ["event_type"], values).collect()}
    last = max(w for w, _, _ in want)
    assert got <= want and {w for w in want if (last - w[0]).total_seconds() > 7200} <= got


def test_state_over_several_triggers(spark, tiny, tmp_path):
    batch = table(spark, tiny, "events").select("event_type", "value")
    sinks.write_files(batch.repartition(3), str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    totals = events.running_totals(stream, "event_type", "value")
    totals.writeStream.outputMode("update").foreachBatch(lambda df, i: seen.append({r["event_type"]: (r["n"], round(r["total"], 6)) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for part in seen:
        last |= part
    assert len(seen) > 1 and last == {r["event_type"]: (r["n"], round(r["t"], 6)) for r in batch.groupBy("event_type").agg(F.count("value").alias("n"), F.sum("value").alias("t")).collect()}


def test_late_events_and_repeats_in_a_stream(spark, tmp_path):
    """A repeat within the delay comes once; an hour that the watermark has passed takes nothing more."""
    at = lambda s: f"2024-01-01 {s}"
    parts = [[("a", at("00:10:00")), ("a", at("00:10:00")), ("b", at("01:30:00"))], [("c", at("05:00:00"))], [("d", at("00:20:00")), ("c", at("05:00:00"))]]
    for i, rows in enumerate(parts):  # each run goes on where the one before left off
        sinks.write_files(spark.createDataFrame(rows, "k string, ts string").selectExpr("k", "cast(ts as timestamp) as ts").coalesce(1), str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in" / "*"))
        events.run_available(events.distinct_events(stream, "ts", ["k"], delay="1 hour"), str(tmp_path / "once"), str(tmp_path / "cp1"))
        events.run_available(events.tumbling(stream, "ts", "1 hour", [], {"n": F.count(F.lit(1))}, delay="1 hour"), str(tmp_path / "hours"), str(tmp_path / "cp2"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "once")).collect()) == ["a", "b", "c"]
    got = {r["window_start"].hour: r["n"] for r in spark.read.parquet(str(tmp_path / "hours")).collect()}
    assert got.get(0) == 2 and got.get(1) == 1

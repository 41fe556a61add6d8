"""Recordings by every strategy, sinks that commit, and files in a random order."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.sources import committed, readers, recordings, sinks


def made(root, segments, rows=10, name="x"):
    """A recording of segments (segment, data file, assets) of ``rows`` rows each; data files get their segments' rows."""
    os.makedirs(root / "data"), os.makedirs(root / "segments")
    files = {}
    for k, (_, data, _) in enumerate(segments):
        files.setdefault(data, []).extend(range(k * rows, (k + 1) * rows))
    for data, places in files.items():
        pq.write_table(pa.table({"index": pa.array(places, pa.int64()), name: [i * 1.5 for i in places]}), root / data, row_group_size=4)
    table = pa.table({"segment": [s for s, _, _ in segments], "start": [k * rows for k in range(len(segments))], "end": [(k + 1) * rows for k in range(len(segments))], "data": [d for _, d, _ in segments], "assets": pa.array([list(a.items()) for _, _, a in segments], pa.map_(pa.string(), pa.string()))})
    pq.write_table(table, root / "segments" / "s.parquet")
    return str(root)


SEGMENTS = [(0, "data/a", {"left": "l0", "right": "r0"}), (1, "data/a", {"left": "l0", "right": "r0"}), (2, "data/b", {"left": "l0", "right": "r1"}), (3, "data/c", {"left": "l2", "right": "r2"}), (4, "data/d", {"left": "l3", "right": "r1"})]


def partitions(df):
    """The places that each partition reads, in the order of the first."""
    parts = [[r["index"] for r in rows] for rows in df.rdd.glom().collect()]
    return sorted(p for p in parts if p)


def test_strategies(spark, tmp_path):
    root = made(tmp_path / "r", SEGMENTS)
    span = lambda *ks: [i for k in ks for i in range(k * 10, k * 10 + 10)]
    want = {"sequential": [span(0, 1, 2, 3, 4)], "segment": [span(k) for k in range(5)], "file_group": [span(0, 1), span(2), span(3), span(4)], "chain": [span(0, 1, 2, 4), span(3)], "row_block": [list(range(i, min(i + 14, 50))) for i in range(0, 50, 14)]}
    for strategy, parts in want.items():
        df = recordings.read_recordings(spark, [root], strategy, 14 if strategy == "row_block" else None)
        assert partitions(df) == parts
        assert sorted((r["dataset"], r["segment"], r["index"], r["x"]) for r in df.collect()) == [(0, i // 10, i, i * 1.5) for i in range(50)]


def test_a_file_is_read_once_for_all_segments(tmp_path, monkeypatch):
    """Segments that take turns between two files, one of them out of order."""
    root = made(tmp_path / "r", [(k, f"data/{'ab'[k % 2]}", {}) for k in range(20)])
    table = pq.read_table(tmp_path / "r" / "data" / "b")
    pq.write_table(table.take(list(range(len(table)))[::-1]), tmp_path / "r" / "data" / "b")
    scans, plain = [], recordings.Places.batches
    monkeypatch.setattr(recordings.Places, "batches", lambda self, columns, lo, hi: scans.append((lo, hi)) or plain(self, columns, lo, hi))
    source = recordings.Recordings({"path": root, "strategy": "sequential"})
    reader = source.reader(source.schema())
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(rows) == [(0, i // 10, i, i * 1.5) for i in range(200)] and [r[1] for r in rows] == sorted(r[1] for r in rows)
    assert scans.count((0, 190)) == 2 and scans.count((10, 200)) == 1 and len(scans) == 13


def test_many_segments_take_a_bounded_number_of_partitions(spark, tmp_path):
    """Beyond the bound, partitions that follow each other become one, of whole ones and in their order; rows are handed over together."""
    root = made(tmp_path / "r", [(k, f"data/{'abc'[k % 3]}", {"left": f"l{k // 2}"}) for k in range(600)], rows=3)
    for strategy, rows in (("segment", None), ("row_block", 2), ("chain", None), ("sequential", None)):
        source = recordings.Recordings({"path": root, "strategy": strategy} | ({"rows": str(rows)} if rows else {}))
        reader = source.reader(source.schema())
        parts, units = reader.partitions(), recordings.planned(recordings.segments_of(root), strategy, rows, [(0, 1800)], None)
        assert [x for p in parts for x in p.pieces] == [x for u in units for x in u] and len(parts) == min(len(units), recordings.PARTITIONS)
        firsts = {u[0] for u in units}
        assert all(p.pieces[0] in firsts for p in parts)
        got = [[tuple(r.values()) for b in reader.read(p) for r in b.to_pylist()] for p in parts]
        assert [r for rows in got for r in rows] == [(0, i // 3, i, i * 1.5) for i in range(1800)]
        assert all(len(list(reader.read(p))) == 1 for p in parts)
    few = recordings.read_recordings(spark, [root], "segment").sparkSession.read.format("recordings").option("path", root).option("strategy", "segment").option("partitions", 7).load()
    parts = partitions(few)
    assert len(parts) == 7 and [i for p in parts for i in p] == list(range(1800)) and all(len(p) % 3 == 0 and len(p) < 300 for p in parts)


def test_conditions_reach_the_plan(spark, tmp_path):
    roots = [made(tmp_path / "a", SEGMENTS), made(tmp_path / "b", SEGMENTS[:2])]
    df = recordings.read_recordings(spark, roots, "segment")
    one = df.filter("index >= 15 and index < 32 and dataset = 0")
    assert partitions(one) == [list(range(15, 20)), list(range(20, 30)), [30, 31]]
    assert partitions(df.filter("segment in (1, 3)")) == [list(range(10, 20)), list(range(10, 20)), list(range(30, 40))]
    assert partitions(df.filter("index in (3, 4, 47)")) == [[3, 4], [3, 4], [47]]
    assert partitions(df.filter("index > 3 and index <= 5 and x > 6.5 and dataset = 1")) == [[5]]  # what the plan can't take over, Spark filters
    assert df.filter("index < 0").count() == df.filter("segment = 1 and segment = 2").count() == 0
    assert df.filter("segment is null or x is null").count() == 0


def test_planning_reads_no_data(tmp_path):
    root = made(tmp_path / "r", SEGMENTS)
    for f in os.listdir(tmp_path / "r" / "data"):
        os.remove(tmp_path / "r" / "data" / f)
    segments = recordings.segments_of(root)
    assert [len(p) for p in recordings.planned(segments, "chain", None, [(0, 50)], None)] == [4, 1]


def test_odd_recordings(spark, tmp_path):
    apart = made(tmp_path / "apart", [SEGMENTS[0], SEGMENTS[2], (7, *SEGMENTS[0][1:])])
    with pytest.raises(ValueError, match="does not follow"):
        recordings.planned(recordings.segments_of(apart), "file_group", None, [(0, 99)], None)
    assert recordings.read_recordings(spark, [apart], "chain").count() == 30
    with pytest.raises(ValueError, match="row_block"):
        recordings.planned([], "row_block", None, [], None)
    with pytest.raises(ValueError, match="unknown"):
        recordings.planned([], "other", None, [], None)
    empty = made(tmp_path / "empty", [])
    assert recordings.read_recordings(spark, [empty]).count() == 0
    other = made(tmp_path / "other", SEGMENTS[:1], name="y")
    with pytest.raises(Exception, match="differ"):
        recordings.read_recordings(spark, [apart, other]).count()


SCHEMA = "id long, v string"


def write(df, path, batch=None, mode="append"):
    df.sparkSession.dataSource.register(committed.CommittedSink)
    writer = df.write.format("committed").option("path", str(path)).mode(mode)
    (writer.option("batch", batch) if batch else writer).save()


def rows_of(spark, path):
    return sorted((r["id"], r["v"]) for r in committed.read_committed(spark, str(path), SCHEMA).collect())


def test_batches_appear_once(spark, tmp_path):
    path = tmp_path / "s"
    assert rows_of(spark, path) == []
    a, b = spark.createDataFrame([(i, "a") for i in range(20)], SCHEMA).repartition(4), spark.createDataFrame([(i, "b") for i in range(15, 25)], SCHEMA)
    write(a, path, "1")
    write(b, path, "1")  # a repeat of a batch, whatever it brings
    assert rows_of(spark, path) == [(i, "a") for i in range(20)]
    write(b, path, "2")
    assert len(rows_of(spark, path)) == 30
    latest = committed.latest(committed.read_committed(spark, str(path), SCHEMA), "id")
    assert sorted((r["id"], r["v"]) for r in latest.collect()) == [(i, "a" if i < 15 else "b") for i in range(25)]
    write(a.filter("id < 2"), path, "3", mode="overwrite")
    assert rows_of(spark, path) == [(0, "a"), (1, "a")]
    write(a.limit(0), path, "4")
    assert rows_of(spark, path) == [(0, "a"), (1, "a")] and not os.listdir(path / "staged")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "s"
    df = spark.range(100).repartition(4).withColumn("v", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("x"))
    with pytest.raises(Exception, match="broken"):
        write(df, path, "1")
    assert rows_of(spark, path) == [] and committed.manifests(str(path)) == []
    assert not (path / "staged").exists() or not os.listdir(path / "staged")
    # A commit that stopped after it had moved files: the next attempt at the batch begins anew.
    os.makedirs(path / "data" / "1")
    (path / "data" / "1" / "left.parquet").write_bytes(b"half")
    write(df.filter("id < 5"), path, "1")
    assert rows_of(spark, path) == [(i, "x") for i in range(5)] and "left.parquet" not in os.listdir(path / "data" / "1")


def test_stream_repeats_its_last_batch(spark, tmp_path):
    spark.dataSource.register(committed.CommittedSink)
    for i in range(3):
        sinks.write_files(spark.createDataFrame([(10 * i + k, f"t{i}") for k in range(10)], SCHEMA).coalesce(1), str(tmp_path / "in" / f"{i}"))
    path, checkpoint = tmp_path / "s", tmp_path / "cp"

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        stream.writeStream.format("committed").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run()
    whole = rows_of(spark, path)
    assert [r[0] for r in whole] == list(range(30)) and len(committed.manifests(str(path))) == 3
    # The stream dies after the sink's commit and before its own: it repeats the batch on its return.
    for name in ("2", ".2.crc"):
        if (checkpoint / "commits" / name).exists():
            os.remove(checkpoint / "commits" / name)
    run()
    assert rows_of(spark, path) == whole


def test_files_in_a_random_order(spark, tmp_path):
    spark.range(60).repartitionByRange(6, "id").write.parquet(str(tmp_path / "f"))
    order = lambda seed: [r["first"] for r in readers.shuffled_files(spark, str(tmp_path / "f"), seed=seed).groupBy("file_place").agg(F.min("id").alias("first")).orderBy("file_place").collect()]
    assert sorted(order(1)) == [0, 10, 20, 30, 40, 50] and order(1) == order(1) and len({tuple(order(s)) for s in range(4)}) > 1
    df = readers.shuffled_files(spark, str(tmp_path / "f"), seed=1, columns=["id"])
    assert df.rdd.getNumPartitions() == 6 and "Exchange" not in df._jdf.queryExecution().toString()
    first = [r["id"] for r in df.collect()]
    assert [min(first[i : i + 10]) for i in range(0, 60, 10)] == order(1)


def test_plain_readers(spark, tmp_path):
    """Lines, bytes, items and files by suffix, and writers' modes and bounds."""
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    assert sorted(r["text"] for r in readers.read_lines(spark, str(tmp_path / "a.txt")).collect()) == ["one", "two"]
    got = readers.read_binary(spark, str(tmp_path), "bin").collect()
    assert [bytes(r["bytes"]) for r in got] == [b"\x00\x01"] and got[0]["path"].endswith("b.bin")
    assert sorted(r["item"] for r in readers.from_items(spark, [3, 1, 2]).collect()) == [1, 2, 3]
    for _ in range(2):
        sinks.write_files(spark.range(25), str(tmp_path / "p"), mode="overwrite", rows_per_file=10)
    counts = [pq.read_metadata(tmp_path / "p" / f).num_rows for f in os.listdir(tmp_path / "p") if f.endswith(".parquet")]
    assert sum(counts) == 25 and max(counts) <= 10
    sinks.write_files(spark.range(25).repartition(5), str(tmp_path / "j"), "json", single=True)
    assert len([f for f in os.listdir(tmp_path / "j") if f.endswith(".json")]) == 1
    os.rename(tmp_path / "p", tmp_path / "q")
    (tmp_path / "q" / "other.csv").write_text("id\n1\n")
    assert readers.read_files(spark, str(tmp_path / "q"), suffix="parquet").count() == 25

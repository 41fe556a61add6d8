"""Operators on cases that the test tables lack."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, functions, joins, windows
from millrace.operators import text as chunks
from millrace.plans import QUERIES
from millrace.sources import readers, sinks


def test_overlaps_of_ranges_of_any_length(spark):
    rng = random.Random(1)
    make = lambda n: [(i, rng.choice("ab"), x := rng.uniform(-50, 50), x + rng.choice([0.0, 0.01, 1.0, 30.0, 5000.0])) for i in range(n)]
    a, b = make(60), make(60)
    left, right = spark.createDataFrame(a, "i long, k string, f double, t double"), spark.createDataFrame(b, "j long, k string, g double, u double")
    got = sorted((r["i"], r["j"]) for r in joins.overlap_join(left, right, ["k"], ("f", "t"), ("g", "u"), 0.5).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])


def test_percentiles_with_nulls_and_ties(spark):
    rows = [("a", x) for x in (1.0, 2.0, 2.0, 10.0, None)] + [("b", 5.0), (None, 3.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["p50"], r["p75"]) for r in aggregates.percentiles(df, "g", "v", {"p50": 0.5, "p75": 0.75}).collect()}
    assert got == {"a": (2.0, 4.0), "b": (5.0, 5.0), None: (3.5, 3.75)}


def test_segments_with_null_values(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, None), ("s", 3, "x"), ("t", 1, "x"), ("t", 2, None)], "s string, o long, v string")
    got = {(r["s"], r["o"]): r["is_start"] for r in windows.segment_flags(df, "s", ["o"], ["v"]).collect()}
    assert got == {("s", 1): True, ("s", 2): False, ("s", 3): True, ("t", 1): True, ("t", 2): True}


def test_aggregate_of_ones_own_merges_all_states(spark):
    most = functions.Aggregate(set, lambda s, x: s | {x % 7}, lambda a, b: a | b, lambda s: float(len(s)))
    df = spark.range(200).selectExpr("id % 3 as g", "id as x").repartition(9)
    assert {r["g"]: r["n"] for r in functions.aggregated(df, "g", "x", most, "n", parts=4).collect()} == {0: 7.0, 1: 7.0, 2: 7.0}


def test_voc_is_parsed_once(spark):
    one = "<annotation><size><width>5.0</width></size><object><name>a</name><bndbox><xmin> 1 </xmin><ymin>2</ymin><xmax>3</xmax></bndbox></object></annotation>"
    df = readers.voc_boxes(spark.createDataFrame([(1, one), (2, "<other/>"), (3, None)], "i int, xml string"), "xml")
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(tuple(r) for r in df.collect()) == [(1, 5, 0, [[1.0, 2.0, 3.0, None]], ["a"]), (2, 0, 0, [], []), (3, None, None, None, None)]


@pytest.mark.parametrize(("kind", "g"), [("string", "a"), ("long", 5), ("date", datetime.date(2020, 1, 2))])
def test_aggregate_of_tasks_without_rows_and_null_groups(spark, kind, g):
    total = functions.Aggregate(float, lambda s, x: s + x, lambda a, b: a + b, lambda s: s)
    for rows in ([(g, 1.0), (g, 2.0)], [(None, 1.0), (g, 2.0), (None, 4.0), (g, None)], []):
        df = spark.createDataFrame(rows, f"g {kind}, x double").repartition(7)
        want = {k: sum(x for own, x in rows if own == k and x is not None) for k, _ in rows}
        assert {r["g"]: r["s"] for r in functions.aggregated(df, "g", "x", total, "s").collect()} == want


def test_sketch_is_not_kept_for_every_user(spark, tiny):
    plan = QUERIES["approx_distinct"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct" in plan and not re.search(r"keys=\[[^\]]*user_id[^\]]*\], functions=\[[^\n]*approx_count_distinct", plan)


def test_page_status(spark):
    df = spark.createDataFrame([(1, "<p>a  b</p><p> </p>"), (2, "%PDF-1.4"), (3, " "), (4, None)], "page_id long, html string")
    got = {r["page_id"]: (r["status"], r["blocks"]) for r in chunks.page_parts(df).collect()}
    assert got == {1: ("success", ["a b"]), 2: ("unsupported_format", []), 3: ("empty", []), 4: ("empty", [])}


def test_fasta_with_signs_in_descriptions(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">P1|ECOLI a > b\nMKV\n>P2\nGG\n")
    got = {r["sequence_id"]: r for r in readers.read_fasta(spark, str(tmp_path)).collect()}
    assert got["P1"]["description"] == "a > b" and got["P1"]["sequence"] == "MKV" and got["P2"]["sequence"] == "GG"


def test_voc_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><size><width>5</width><height>4</height></size><object><name>cat</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4.5</ymax></bndbox></object></annotation>")
    (tmp_path / "b.xml").write_text("<annotation><size><width>5</width><height>4</height></size></annotation>")
    got = {r["path"][-5:]: r for r in readers.read_voc(spark, str(tmp_path)).collect()}
    assert got["a.xml"]["boxes"] == [[1.0, 2.0, 3.0, 4.5]] and got["a.xml"]["labels"] == ["cat"] and got["b.xml"]["boxes"] == []


def test_slices_begin_at_their_place(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"lïne {i}\n" for i in range(10)), encoding="utf-8")
    spark.dataSource.register(readers.SlicedFile)
    df = spark.read.format("sliced").option("path", f"file://{tmp_path}/x.txt").option("rows", 3).option("start", 2).option("end", 9).load()
    assert sorted((r["index"], r["line"]) for r in df.collect()) == [(i, f"lïne {i}") for i in range(2, 9)]


def test_blobs_and_batches(spark, tmp_path):
    df = spark.createDataFrame([("a.bin", b"xy"), ("b.bin", None)], "name string, content binary")
    sinks.write_blobs(df, f"{tmp_path}/out", "name", "content")
    assert (tmp_path / "out" / "a.bin").read_bytes() == b"xy" and (tmp_path / "out" / "b.bin").read_bytes() == b""
    folder = str(tmp_path)

    def maker():
        def write(rows):
            for r in rows:
                with open(f"{folder}/{r['id']}.row", "w") as f:
                    f.write(str(len(rows)))

        return write

    sinks.write_batches(spark.range(7).repartition(1), maker, size=3)
    assert sorted(p.read_text() for p in tmp_path.glob("*.row")) == ["1", "3", "3", "3", "3", "3", "3"]


def test_gzipped_csv_with_other_marks_and_partitions(spark, tmp_path):
    import gzip

    for year in (2023, 2024):
        (tmp_path / f"year={year}").mkdir()
        with gzip.open(tmp_path / f"year={year}" / "x.csv.gz", "wb") as f:
            f.write("a;é\n1;x\n".encode("latin-1"))
    df = readers.read_files(spark, str(tmp_path), "csv", sep=";", encoding="ISO-8859-1", inferSchema=True)
    assert df.columns == ["a", "é", "year"] and [tuple(r) for r in df.filter(F.col("year") > 2023).collect()] == [(1, "x", 2024)]
    bare = readers.read_files(spark, str(tmp_path / "year=2023"), "csv", sep=";", header=False, encoding="ISO-8859-1", schema="p string, q string", paths=True)
    assert {r["p"] for r in bare.collect()} == {"a", "1"} and all(r["path"].endswith("x.csv.gz") for r in bare.collect())


def test_partitions_by_a_function(spark, tmp_path):
    df = spark.range(24).selectExpr("id", "2020 + id % 4 as year", "id % 3 as month")
    sinks.write_files(df, str(tmp_path / "p"), by=["year", "month"])
    kept = readers.where_partition(readers.read_files(spark, str(tmp_path / "p")), ["year", "month"], lambda v: (v["year"] * 12 + v["month"]) % 5 == 0)
    assert {r["id"] for r in kept.collect()} == {i for i in range(24) if ((2020 + i % 4) * 12 + i % 3) % 5 == 0}
    assert "PartitionFilters: [" in kept._jdf.queryExecution().toString()

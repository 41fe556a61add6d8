"""Queries that write the given tables to sources and sinks of the library and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..sources import committed, readers, recordings, sinks
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def _recording(spark: SparkSession, sf_dir: str) -> str:
    """The events as a recording: a segment per 250 of them, two cameras whose files several segments share."""
    path = _folder(spark, "recording")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), "user_id", "event_type", "value")
    segment = F.floor(F.col("index") / 250)
    camera = lambda n: F.concat(F.lit("camera/"), F.floor(segment / n).cast("string"), F.lit(".mp4"))
    recordings.write_recording(events, path, segment, F.create_map(F.lit("left"), camera(2), F.lit("right"), camera(3)), files=4)
    return path


@query("""
SELECT s.strategy, event_id // 250 AS segment, count(*) AS n, round(sum(value), 4) AS total, min(event_id) AS first FROM events, (SELECT unnest(['sequential', 'segment', 'chain', 'row_block']) AS strategy) s GROUP BY ALL
""")
def recordings_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's rows as each strategy reads them."""
    path = _recording(spark, sf_dir)
    out = None
    for strategy in ("sequential", "segment", "chain", "row_block"):
        rows = recordings.read_recordings(spark, [path], strategy, 700 if strategy == "row_block" else None)
        one = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("index").alias("first")).withColumn("strategy", F.lit(strategy))
        out = one if out is None else out.unionByName(one)
    return out.select("strategy", "segment", "n", "total", "first")


@query("SELECT CAST(d AS INTEGER) AS dataset, event_id // 250 AS segment, event_id AS index, event_type FROM events, unnest([0, 1]) AS u(d) WHERE event_id >= 620 AND event_id < 1411 AND event_id // 250 <> 4")
def recordings_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of rows of two recordings; the range is taken over by the plan of the partitions, the rest of the condition by Spark."""
    path = _recording(spark, sf_dir)
    rows = recordings.read_recordings(spark, [path, path], "segment")
    return rows.filter("index >= 620 and index < 1411 and segment <> 4").select("dataset", "segment", "index", "event_type")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS balance, CASE WHEN s_suppkey % 3 = 0 THEN 'b' ELSE 'a' END AS batch FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0")
def committed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches written as upserts, the second one twice: a batch that is there already is left as it is."""
    spark.dataSource.register(committed.CommittedSink)
    path, own = _folder(spark, "committed"), table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"))
    parts = (("a", own.filter("s_suppkey % 2 = 0")), ("b", own.filter("s_suppkey % 3 = 0").withColumn("balance", F.col("balance") + 1)), ("b", own))
    for name, rows in parts:
        rows.write.format("committed").option("path", path).option("batch", name).mode("append").save()
    return committed.latest(committed.read_committed(spark, path, own.schema), "s_suppkey").select("s_suppkey", "balance", "batch")


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 5 = 1")
def files_of_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through files of three formats, in files of bounded length, read back by their suffix with the given schema."""
    path, own = _folder(spark, "files"), table(spark, sf_dir, "part").filter("p_size % 5 = 1").select("p_partkey", "p_name")
    for i, kind in enumerate(("parquet", "json", "csv")):
        sinks.write_files(own.filter(F.col("p_partkey") % 3 == i), f"{path}/{kind}", kind, rows_per_file=100)
    back = [readers.read_files(spark, f"{path}/{kind}", kind, schema=own.schema, suffix=kind).select("p_partkey", "p_name") for kind in ("parquet", "json", "csv")]
    return back[0].union(back[1]).union(back[2])


@query("SELECT d, n, first FROM (SELECT doc_id % 4 AS d, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL)")
def shuffled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from a folder of files that are read in a seeded order."""
    path = _folder(spark, "shuffled")
    table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("d")).repartition(8).write.parquet(path)
    rows = readers.shuffled_files(spark, path, seed=3, columns=["doc_id", "d"])
    return rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).select("d", "n", "first")

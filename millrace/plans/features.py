"""Queries of features, splits, metrics, functions of users, and what remains of windows and joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import aggregates, embed, functions, joins, order, scale, search, splitter, windows
from ..operators import text as chunks
from ..session import running, table
from ..sources import readers
from ..streaming import events as streams
from ..streaming import joins as stream_joins
from .registry import query


@query("SELECT p.event_id, (SELECT min(epoch_us(c.ts)) FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND epoch_us(c.ts) >= epoch_us(p.ts) - 60000000) AS next_at FROM events p WHERE p.event_type = 'purchase'")
def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with the time of its user's first click from a minute before it on."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("at"))
    clicks = events.filter("event_type = 'click'").select("user_id", "at", F.col("at").alias("next_at"))
    return joins.asof_next(events.filter("event_type = 'purchase'").select("event_id", "user_id", "at"), clicks, "user_id", "at", ["next_at"], width=86_400e6, tolerance=60e6).select("event_id", "next_at")


@query("SELECT o.o_orderkey, coalesce(a.s_name, 'none') AS first_name, coalesce(b.s_name, 'none') AS second_name FROM orders o LEFT JOIN supplier a ON o.o_custkey = a.s_suppkey LEFT JOIN supplier b ON o.o_custkey + 1 = b.s_suppkey")
def double_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of pairs looked up twice in another, with defaults for the sides that are missing."""
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1).alias("b"))
    one = joins.lookup_join(pairs, names.toDF("a", "first_name"), "a", {"first_name": "none"})
    return joins.lookup_join(one, names.toDF("b", "second_name"), "b", {"second_name": "none"}).select("o_orderkey", "first_name", "second_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 < 3)")
def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run that had written three quarters of the orders still has to do."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return joins.not_done(orders, orders.filter("o_orderkey % 4 < 3"), "o_orderkey")


@query("SELECT event_id, value FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def incremental_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after the last run's time, a literal that reaches the scan."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts") - F.expr("interval 2 days")).first()[0]
    return events.filter(F.col("ts") > F.lit(last)).select("event_id", "value")


@query("SELECT c_custkey, split FROM (SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('8:' || CAST(c_custkey AS VARCHAR)), c_custkey) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM customer)")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.stratified_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 0.8, seed=8).select("c_custkey", "split")


@query("SELECT o_orderkey, CASE WHEN p < 100 THEN 0 WHEN p < 250 THEN 1 ELSE 2 END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)")
def split_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.split_at(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], [100, 250])


@query("SELECT c_custkey FROM customer ORDER BY md5('6:' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 40")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sample_rows(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 40, seed=6)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY md5('4:' || CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS place FROM supplier")
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import ranked

    rows = order.shuffled(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", seed=4)
    return ranked(rows, [order.draw(F.col("s_suppkey"), 4), F.col("s_suppkey")], "place")


@query("SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys, true AS disjoint FROM customer")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven shards of the customers: every row is in one."""
    dealt = order.shards(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7)
    per = dealt.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("s"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.max("s").eqNullSafe(F.lit(1)).alias("disjoint"))


@query("SELECT doc_id, n_chars FROM documents")
def batched_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.batched_by_length(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars"), 4)


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber")
def sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT min(l_quantity) AS lo, round(stddev_samp(l_quantity), 6) AS std, round(avg(e * e), 4) AS mse, round(avg((e / t) * (e / t)), 9) AS mspe FROM (SELECT l_quantity, l_extendedprice AS t, l_quantity * 1500 - l_extendedprice AS e FROM lineitem)")
def global_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    m = aggregates.regression_metrics(rows, F.col("l_extendedprice"), F.col("l_quantity") * 1500).select(F.round("mse", 4).alias("mse"), F.round("mspe", 9).alias("mspe"))
    return rows.agg(F.min("l_quantity").alias("lo"), F.round(F.stddev_samp("l_quantity"), 6).alias("std")).join(F.broadcast(m))  # a row each


@query("SELECT min(n_chars) AS least, round(median(n_chars), 4) AS median, round(avg(n_chars), 4) AS mean, max(n_chars) AS largest FROM documents")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = aggregates.profile(table(spark, sf_dir, "documents").select("n_chars"), "n_chars")
    return p.select("least", F.round("median", 4).alias("median"), F.round("mean", 4).alias("mean"), "largest")


@query("""
WITH f AS (SELECT l.toxic AS y, round((d.doc_id % 97) / 97.0::DOUBLE, 6) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
p AS (SELECT s, sum(y) AS p, count(*) AS n FROM f GROUP BY s),
c AS (SELECT s, p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM p)
SELECT round(sum(p * tp / seen::DOUBLE) / sum(p), 9) AS average_precision FROM c
""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("toxic", F.round(F.col("doc_id") % 97 / 97.0, 6).alias("s"))
    return aggregates.average_precision(rows, F.col("toxic"), F.col("s")).select(F.round("average_precision", 9).alias("average_precision"))


@query("SELECT event_type, round(sum(n) OVER (ORDER BY event_type) / sum(n) OVER ()::DOUBLE, 9) AS upto FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def cumulative_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running shares of the classes, in ranges of classes."""
    per = aggregates.shares(table(spark, sf_dir, "events").select("event_type"), "event_type").select("event_type", "n")
    upto = running(per, [F.col("event_type")], F.col("n"), "upto")
    return upto.join(F.broadcast(per.agg(F.sum("n").alias("total")))).select("event_type", F.round(F.col("upto") / F.col("total"), 9).alias("upto"))


@query("SELECT user_id, arg_min(event_type, ts_event) AS first_type, max(value) AS top_value, array_to_string(list_sort(list(event_id)), ',') AS ids FROM (SELECT *, (epoch_us(ts), event_id) AS ts_event FROM events) GROUP BY user_id")
def first_max_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    per = events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max("value").alias("top_value"), F.sort_array(F.collect_list("event_id")).alias("ids"))
    return per.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) = 1")
def argmax_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_per_key(table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_custkey"), "c_mktsegment", ["c_acctbal", "c_custkey"])


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quartile, round(percent_rank() OVER w, 9) AS percent, CAST(sum(1) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate)::BIGINT RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def rank_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of a customer's orders, and how many fall in the month before each."""
    own = W.partitionBy("o_custkey")
    w, price = own.orderBy("o_orderpriority"), own.orderBy("o_totalprice", "o_orderkey")
    month = own.orderBy(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).rangeBetween(-2592000, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(price).cast("long").alias("quartile"), F.round(F.percent_rank().over(w), 9).alias("percent"), F.sum(F.lit(1)).over(month).alias("recent"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
l AS (SELECT user_id, list(value ORDER BY i) AS v, any_value(n) AS n FROM r GROUP BY user_id)
SELECT user_id, CAST(s AS BIGINT) AS start, array_to_string(v[s + 1:s + 8], ',') AS x, array_to_string(v[s + 7:s + 11], ',') AS y FROM l, unnest(range(0, n - 10, 3)) AS t(s)
""")
def encoder_decoder_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.encoder_decoder_windows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 8, 2, 3, 3, block=64)
    return w.select("user_id", "start", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("x", "y")])


@query("SELECT event_id, CASE WHEN ts + INTERVAL 1 HOUR <= c THEN 'train' WHEN ts >= c THEN 'val' END AS split FROM events, (SELECT min(ts) + INTERVAL 3 DAY AS c FROM events)")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that end by the cut train, those from it on validate, those across it are dropped (null)."""
    events = table(spark, sf_dir, "events")
    cut = F.lit(events.agg(F.min("ts") + F.expr("interval 3 days")).first()[0])
    return events.select("event_id", windows.time_split(F.col("ts"), F.col("ts") + F.expr("interval 1 hour"), cut).alias("split"))


@query("SELECT event_id, round(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END, 6) AS z FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS s FROM events)")
def zscore_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.z_scored(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value").select("event_id", F.round("z", 6).alias("z"))


@query("SELECT window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts)]) AS window_start FROM events) GROUP BY 1")
def sliding_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", [], {"n": F.count(F.lit(1))}, slide="15 minutes")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.distinct_events(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), "ts", ["user_id", "event_type"], delay="1 hour").select("user_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / ((SELECT max(l_quantity) - min(l_quantity) FROM lineitem) + 1e-8), 6) AS l_quantity FROM lineitem")
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return scale.min_max_scaled(rows, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query("""
WITH t AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders, t
""")
def fitted_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scaler fitted on the training rows alone, then an index of labels."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    scaled = scale.standard_scaled(rows, ["o_totalprice"], fit_on=rows.filter("o_orderkey % 5 <> 0"))
    return scale.label_index(scaled, "o_orderpriority", "label").select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), "label")


@query("SELECT o_orderkey, CASE WHEN s > 0.8 THEN 'high' WHEN s > 0.5 THEN 'medium' ELSE 'low' END AS tier, s > 0.5 AND p > 50 AS passes FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS s, o_custkey % 97 AS p FROM orders)")
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure, plddt = F.col("o_orderkey") % 101 / 100.0, F.col("o_custkey") % 97
    return table(spark, sf_dir, "orders").select("o_orderkey", N.confidence_tier(sure).alias("tier"), N.passes(sure, plddt).alias("passes"))


@query("""
SELECT page_id, regexp_extract(name, '(\\.[^.]+)$', 1) AS suffix, regexp_extract(url, '^(.*)/', 1) AS parent, name, CAST(len(list_filter(string_split_regex(plain, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words,
  round(coalesce(length(regexp_replace(url, '[a-zA-Z0-9]', '', 'g')) / nullif(length(url), 0)::DOUBLE, 0), 9) AS outside
FROM (SELECT *, string_split(url, '/')[-1] AS name, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM pages)
""")
def path_and_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.path_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", parts["suffix"].alias("suffix"), parts["parent"].alias("parent"), parts["name"].alias("name"), T.word_count(F.regexp_replace("html", "<[^>]+>", " ")).alias("n_words"), F.round(T.fraction_outside(F.col("url"), "a-zA-Z0-9"), 9).alias("outside"))


@query("""
SELECT p_partkey, regexp_extract(tail, '^(.+?)\\((.+)\\)$', 1) AS name, regexp_extract(tail, '^(.+?)\\((.+)\\)$', 2) AS arguments, array_to_string(regexp_extract_all(p_type || '[x] ' || p_brand || '[y]', '(\\w+)\\[', 1), ',') AS names
FROM (SELECT *, p_brand || '(' || p_name || ', ' || CAST(p_size AS VARCHAR) || ')' AS tail FROM part)
""")
def parsed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    said = T.filled("Input: x Output: {b}({n}, {s})", b=F.col("p_brand"), n=F.col("p_name"), s=F.col("p_size"))
    call = T.parsed_call(said)
    return part.select("p_partkey", call["name"].alias("name"), call["arguments"].alias("arguments"), F.array_join(T.bracketed_names(F.concat("p_type", F.lit("[x] "), "p_brand", F.lit("[y]"))), ",").alias("names"))


@query("SELECT doc_id, score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS rating, '[' || array_to_string(list_filter([CASE WHEN n_chars < 100 THEN '\"short\"' END, CASE WHEN source = 'web' THEN '\"web\"' END], lambda x: x IS NOT NULL), ',') || ']' AS issues FROM (SELECT *, CAST(n_chars / 1e6 > 0.01 AS INT) + CAST(n_chars > 100 AS INT) + CAST(source <> 'general' AS INT) + CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 20 AS INT) AS score FROM documents)")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = T.quality_score(F.col("n_chars") / 1e6, F.col("n_chars"), F.col("source"), T.word_count(F.col("text")))
    return docs.select("doc_id", score.alias("score"), T.quality_rating(score).alias("rating"), T.issues({"short": F.col("n_chars") < 100, "web": F.col("source") == "web"}).alias("issues"))


@query("SELECT doc_id, i AS chunk_index, array_to_string(w[i * 50 + 1:i * 50 + 50], ' ') AS chunk FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), unnest(range(0, CAST(ceil(len(w) / 50.0) AS BIGINT))) AS t(i)")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_words(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 50).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


@query("""
WITH l AS (SELECT doc_id, i, trim(string_split(text, chr(10))[i]) AS t FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
s AS (SELECT doc_id, i, j, string_split_regex(replace(replace(replace(t, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10))[j] AS t FROM l, unnest(range(1, 1 + len(string_split_regex(replace(replace(replace(t, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10))))) AS u(j) WHERE length(t) > 400),
p AS (SELECT t FROM l WHERE length(t) <= 400 UNION ALL SELECT trim(t) FROM s WHERE length(t) <= 400 UNION ALL SELECT substr(t, k * 400 + 1, 400) FROM s, unnest(range(0, 1 + (length(t) - 1) // 400)) AS u(k) WHERE length(t) > 400)
SELECT count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS total, CAST(max(length(t)) AS BIGINT) AS longest FROM p WHERE trim(t) <> ''
""")
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "documents").select(F.explode(chunks.split_recursively(F.col("text"), 400)).alias("t"))
    return pieces.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("total"), F.max(F.length("t")).cast("long").alias("longest"))


@query("""
WITH b AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)\\b[^>]*>([^<]*)', 1), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM pages)
SELECT page_id, 'success' AS status, blocks[i] AS block FROM b, unnest(range(1, len(blocks) + 1)) AS u(i)
""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages, a row each."""
    return chunks.page_parts(table(spark, sf_dir, "pages")).select("page_id", "status", F.explode("blocks").alias("block"))


@query("SELECT s_suppkey, 'first ' || s_name AS a, 'second ' || CAST(s_nationkey AS VARCHAR) AS b FROM supplier")
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sections of pages made of the suppliers, one within the other."""
    made = table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("url"), F.concat(F.lit('<h1>x</h1><section id="a">first '), "s_name", F.lit('<section id="b">second '), "s_nationkey", F.lit("</section></section><p>y</p>")).alias("html"))
    found = chunks.sections(made).select(F.substring_index("source", "#", 1).alias("url"), F.substring_index("source", "#", -1).alias("id"), "text")
    per = found.groupBy("url").agg(F.max(F.when(F.col("id") == "a", F.col("text"))).alias("a"), F.max(F.when(F.col("id") == "b", F.col("text"))).alias("b"))
    return per.select(F.substring("url", 2, 20).cast("long").alias("s_suppkey"), "a", "b")


@query("""
WITH g AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id)
SELECT conv_id, len(ms) AS n, ms[1].role AS first_role, list_filter(ms, lambda m: m.role = 'user')[1].text AS asked, ms[-1].text AS answer FROM g WHERE NOT coalesce(contains(ms[3].text, 'e'), false)
""")
def chat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose third message does not hold a string, split by role, without collecting any."""
    place, said = F.struct("turn", "role", "text"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    users = F.when(F.col("role") == "user", place)
    per = table(spark, sf_dir, "conversations").withColumn("i", said).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.min(users).alias("user"), F.max(place).alias("last"), F.max(F.when(F.col("i") == 3, F.col("text"))).alias("third"))
    kept = per.filter(~F.coalesce(F.contains("third", F.lit("e")), F.lit(False)))
    return kept.select("conv_id", "n", F.col("first.role").alias("first_role"), F.col("user.text").alias("asked"), F.col("last.text").alias("answer"))


@query("SELECT c_custkey, '[{\"role\":\"system\",\"content\":\"Help.\"},{\"role\":\"user\",\"content\":\"' || c_name || '\"},{\"role\":\"assistant\",\"content\":\"' || c_mktsegment || '\"}]' AS messages FROM customer")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(chunks.messages(F.lit("Help."), F.col("c_name"), F.col("c_mktsegment"))).alias("messages"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strptime(strftime(o_orderdate, '%Y-%m'), '%Y-%m') AS month FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd").alias("day"), F.to_timestamp_ntz(F.concat(F.date_format(at, "yyyy-MM"), F.lit("-01")), F.lit("yyyy-MM-dd")).alias("month"))


@query("SELECT p_partkey, '{\"a\":' || CAST(p_size AS VARCHAR) || ',\"b\":' || CAST(100 - p_size AS VARCHAR) || '}' AS shares, round((p_size / 255.0::DOUBLE - 0.5) / 0.5, 9) AS pixel, round(p_retailprice * (1 - 0.05), 6) AS price, round(p_size / 100.0::DOUBLE + 0.05, 9) AS iv FROM part")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map of classes to shares, pixel scaling, option shocks."""
    iv, price = N.shocked(F.col("p_size") / 100.0, F.col("p_retailprice"), 0.05)
    pixel = N.scaled_pixels(F.array("p_size"))[0]
    shares = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.col("p_size"), 100 - F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(shares).alias("shares"), F.round(pixel, 9).alias("pixel"), F.round(price, 6).alias("price"), F.round(iv, 9).alias("iv"))


@query("SELECT count(*) AS n, max(len(string_split(text, ' '))) AS longest FROM documents WHERE text IS NOT NULL")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").dropna(subset=["text"]).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("text", " ", -1))).cast("long").alias("longest"))


@query("""
WITH g AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS a, list(event_type ORDER BY event_type, event_id) AS b FROM events GROUP BY user_id)
SELECT count(*) AS n, CAST(sum(CAST(list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS BIGINT)) AS BIGINT) AS same_set, CAST(sum(CAST(a = b AS BIGINT)) AS BIGINT) AS same_list, CAST(sum(CAST(a[1] = b[1] AS BIGINT)) AS BIGINT) / count(*)::DOUBLE AS exact_match FROM g
""")
def array_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays alike as sets, alike as lists, and how often their first elements match."""
    of = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "event_type"))), lambda s: s["event_type"])
    g = table(spark, sf_dir, "events").withColumn("kind", F.col("event_type")).groupBy("user_id").agg(of("ts", "event_id").alias("a"), of("kind", "event_id").alias("b"))
    yes = lambda c: F.sum(c.cast("long"))
    return g.agg(F.count(F.lit(1)).alias("n"), yes(N.same_elements(F.col("a"), F.col("b"))).alias("same_set"), yes(F.col("a") == F.col("b")).alias("same_list"), F.avg((F.get("a", 0) == F.get("b", 0)).cast("double")).alias("exact_match"))


_BOX = "[{s}::DOUBLE, {s}::DOUBLE, {s} + 10::DOUBLE, {s} + 20::DOUBLE]"


@query("SELECT p_partkey, round(i / (400 - i), 9) AS iou FROM (SELECT p_partkey, greatest(10 - abs(p_size - p_size // 2), 0) * greatest(20 - abs(p_size - p_size // 2), 0)::DOUBLE AS i FROM part)")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda c: [c.cast("double"), c.cast("double"), c + 10.0, c + 20.0]
    return table(spark, sf_dir, "part").select("p_partkey", F.round(N.iou(box(F.col("p_size")), box(F.floor(F.col("p_size") / 2))), 9).alias("iou"))


@query("SELECT p_partkey, 500 AS width, 400 AS height, p_brand AS label, (p_size + 1.5)::DOUBLE AS xmin, (p_size + 40)::DOUBLE AS ymax, 2 AS n FROM part")
def voc_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and labels out of annotations in XML made of the parts."""
    one = "<object><name>{b}</name><bndbox><xmin>{x}</xmin><ymin>2</ymin><xmax>90</xmax><ymax>{y}</ymax></bndbox></object>"
    xml = T.filled(f"<annotation><size><width>500</width><height>400</height></size>{one}{one}</annotation>", b=F.col("p_brand"), x=F.col("p_size") + 1.5, y=F.col("p_size") + 40)
    found = readers.voc_boxes(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), "xml")
    box = F.get("boxes", 1)
    return found.select("p_partkey", "width", "height", F.get("labels", 1).alias("label"), F.get(box, 0).alias("xmin"), F.get(box, 3).alias("ymax"), F.size("boxes").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0")
def valid_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose bytes begin as an image does; empty and other bytes go."""
    head = F.when(F.col("p_size") % 4 == 0, F.unhex(F.lit("89504E470D0A"))).when(F.col("p_size") % 2 == 0, F.unhex(F.lit("FFD8FFE000"))).when(F.col("p_size") % 3 == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.lit("00010203")))
    return readers.valid_images(table(spark, sf_dir, "part").select("p_partkey", head.alias("bytes")), "bytes").select("p_partkey")


@query("SELECT event_type, count(*) AS n, round(regr_slope(value, event_id), 9) AS slope FROM events GROUP BY event_type")
def map_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of each day and type's rows as a pandas table: sums that are then put together to a slope for each type."""

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].astype(float), rows["y"]
        return pd.DataFrame({"event_type": rows["event_type"].iloc[:1], "n": len(rows), "sx": x.sum(), "sy": y.sum(), "sxx": (x * x).sum(), "sxy": (x * y).sum()})

    events = table(spark, sf_dir, "events").select("event_type", F.pmod("event_id", F.lit(64)).alias("part"), F.col("event_id").alias("x"), F.col("value").alias("y"))
    parts = functions.map_groups(events, ["event_type", "part"], sums, "event_type string, n long, sx double, sy double, sxx double, sxy double")
    per = parts.groupBy("event_type").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    return per.select("event_type", "n", F.round((n * F.col("sxy") - sx * sy) / (n * F.col("sxx") - sx * sx), 9).alias("slope"))


@query("SELECT event_type, round(exp(avg(ln(1 + abs(value)))) - 1, 6) AS mean FROM events GROUP BY event_type")
def custom_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of the user's own: a start, a step, a merge and an end, combined before the shuffle."""
    import math

    mean = functions.Aggregate(lambda: (0.0, 0), lambda s, x: (s[0] + math.log1p(abs(x)), s[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: math.expm1(s[0] / s[1]) if s[1] else None)
    return functions.aggregated(table(spark, sf_dir, "events"), "event_type", "value", mean, "mean").withColumn("mean", F.round("mean", 6))


@query("SELECT p_partkey, upper(p_name) || '!' AS loud, p_size * 2 + 1 AS twice FROM part")
def expression_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of columns over Arrow arrays."""
    import pyarrow.compute as pc

    loud = functions.arrow_function(lambda a: pc.binary_join_element_wise(pc.utf8_upper(a), "!", ""), "string")
    twice = functions.arrow_function(lambda a: pc.add(pc.multiply(a, 2), 1), "int")
    return table(spark, sf_dir, "part").select("p_partkey", loud("p_name").alias("loud"), twice("p_size").alias("twice"))


@query("SELECT p_partkey, w AS word FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) WHERE w <> ''")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that gives any number of rows for each row."""
    return functions.flat_map(table(spark, sf_dir, "part").select("p_partkey", "p_type"), lambda row: ({"p_partkey": row["p_partkey"], "word": w} for w in row["p_type"].split(" ") if w), "p_partkey long, word string")


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.04 * l_quantity - 6 * l_discount - 0.5))), 6) AS score FROM lineitem")
def batch_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scored by a model object that is sent once and set up once by each task."""
    import numpy as np

    class Model:
        def __init__(self, weights: list[float], bias: float) -> None:
            self.weights, self.bias = np.array(weights), bias

        def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
            z = batch[["l_quantity", "l_discount"]].to_numpy() @ self.weights + self.bias
            return batch[["l_orderkey", "l_linenumber"]].assign(score=1 / (1 + np.exp(-z)))

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    scored = functions.map_with(rows, Model, {"weights": [0.04, -6.0], "bias": -0.5}, "l_orderkey long, l_linenumber int, score double")
    return scored.withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, round(0.6 * (p_size / 50.0::DOUBLE) + 0.4 * (p_retailprice / 2000.0::DOUBLE), 3) AS score FROM part WHERE p_size >= 5 AND p_size <= 45 AND p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 5)")
def weighted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that match in their fields, by a weighted score."""
    part = table(spark, sf_dir, "part")
    few = [r[0] for r in part.select("p_brand").distinct().orderBy("p_brand").limit(5).collect()]
    kept = part.filter((F.col("p_size") >= 5) & (F.col("p_size") <= 45) & F.col("p_brand").isin(few))
    return kept.select("p_partkey", F.round(0.6 * (F.col("p_size") / 50.0) + 0.4 * (F.col("p_retailprice") / 2000.0), 3).alias("score")).orderBy(F.desc("score"), "p_partkey")


_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)"


@query(f"WITH {_V}, s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def factor_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten items of the largest inner product with each user's factors."""
    v = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    users = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.knn(v, users, 10, cosine=False).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"""
WITH {_V}, s AS (SELECT q.vec_id AS query_id, q.label AS own, v.vec_id, v.label, list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)) AS score FROM v q, v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, round(0.7 * score + CASE WHEN label = own THEN 0.3 ELSE 0 END, 6) AS again FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20)
SELECT query_id, vec_id, again AS score FROM r WHERE label <= 7 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY again DESC, vec_id) <= 3
""")
def retrieve_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty by cosine, scored again with their label, filtered after that, and the best three."""
    v = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    asked = v.filter("vec_id % 50 = 0")
    near = search.knn(v, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 20)
    labels = v.select("vec_id", "label")
    both = near.join(labels, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    again = F.round(0.7 * F.col("score") + F.when(F.col("label") == F.col("own"), 0.3).otherwise(0.0), 6)
    return search.reranked(both.filter("label <= 7").withColumn("score", again), "query_id", "vec_id", 3).select("query_id", "vec_id", "score")


@query("""
SELECT c.event_id AS click_id, p.event_id AS purchase_id, date_diff('microsecond', c.ts, p.ts) AS apart FROM events c JOIN events p
ON c.user_id = p.user_id AND p.ts >= c.ts - INTERVAL 30 MINUTE AND p.ts <= c.ts + INTERVAL 60 MINUTE WHERE c.event_type = 'click' AND p.event_type = 'purchase'
""")
def joined_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with their user's purchases from half an hour before to an hour after."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    side = lambda kind, id, at: events.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(id), F.col("ts").alias(at))
    found = stream_joins.joined_within(side("click", "click_id", "clicked"), side("purchase", "purchase_id", "bought"), ["user_id"], ("clicked", "bought"), 1800, 3600)
    return found.select("click_id", "purchase_id", (F.unix_micros("bought") - F.unix_micros("clicked")).alias("apart"))


@query("""
SELECT v.event_id AS id, epoch_us(v.ts) AS asked_at, (SELECT min(epoch_us(p.ts)) FROM events p WHERE p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR) AS answered_at
FROM events v WHERE v.event_type = 'view'
""")
def answered_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view with its user's first purchase within two hours, if there is one."""
    return stream_joins.answered(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", "event_type = 'view'", "event_type = 'purchase'", 7200)


def split_sql(size: int, overlap: int, measure: str, where: str = "true") -> str:
    """Recursive splitting level by level, then packing part by part. measure: the size of the text ``t`` in SQL."""

    def level(n: int, separator: str, of: str) -> str:
        parts = f"string_split(t, {separator})" if separator else "string_split(t, '')"
        front = f"CASE WHEN i > 1 THEN {separator} ELSE '' END || " if separator else ""
        return f"""p{n} AS MATERIALIZED (
  SELECT doc_id, path AS parent, list_append(path, i) AS path, i, t, {measure} AS n FROM (
    SELECT doc_id, path, i, {front}{parts}[i] AS t FROM {of}, unnest(range(1, len({parts}) + 1)) AS u(i)
  ) WHERE t <> ''
)"""

    large = lambda n: f"(SELECT doc_id, path, t FROM p{n} WHERE n >= {size})"
    return f"""
WITH RECURSIVE p0 AS (SELECT doc_id, []::BIGINT[] AS path, text AS t FROM documents WHERE text IS NOT NULL AND {where}),
{level(1, "chr(10) || chr(10)", "p0")}, {level(2, "chr(10)", large(1))}, {level(3, "' '", large(2))}, {level(4, "", large(3))},
small AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, parent ORDER BY i) AS run FROM (
    SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4
  ) WHERE n < {size}
),
g AS MATERIALIZED (SELECT doc_id, parent, run, min(path) AS first, list(t ORDER BY i) AS ts, list(n ORDER BY i) AS ns FROM small GROUP BY ALL),
c AS MATERIALIZED (SELECT *, list_transform(range(0, len(ns) + 1), lambda k: coalesce(list_sum(ns[1:k]), 0)) AS upto FROM g),
w AS (
  SELECT doc_id, parent, run, first, ts, ns, upto, CAST(1 AS BIGINT) AS s, CAST(1 AS BIGINT) AS k, NULL::VARCHAR AS chunk, CAST(0 AS BIGINT) AS since FROM c
  UNION ALL
  SELECT doc_id, parent, run, first, ts, ns, upto,
    CASE WHEN full_ THEN list_filter(range(s, k + 1), lambda x: upto[k] - upto[x] <= {overlap} AND (upto[k + 1] - upto[x] <= {size} OR x = k))[1] ELSE s END, k + 1,
    CASE WHEN full_ OR k > len(ns) THEN array_to_string(ts[s:k - 1], '') END, s
  FROM (SELECT *, k <= len(ns) AND s < k AND upto[k + 1] - upto[s] > {size} AS full_ FROM w WHERE k <= len(ns) + 1)
),
chunks AS (SELECT doc_id, first, since, k, regexp_replace(chunk, '^\\s+|\\s+$', '', 'g') AS chunk FROM w WHERE chunk IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first, since, k) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, chunk FROM chunks WHERE chunk <> ''
"""


@query(split_sql(400, 50, "length(t)"))
def recursive_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of up to 400 characters that overlap by up to 50."""
    return splitter.split(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 400, 50).drop("text")


_WORDS = "len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> ''))"


@query(split_sql(42, 0, _WORDS.format(t="t"), f"{_WORDS.format(t='text')} * 1.2 BETWEEN 20 AND 4000"))
def recursive_word_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of up to 42 words, of texts of 20 to 4,000 tokens at 1.2 a word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return splitter.split(docs, "text", 42, by_words=True, limits=(20, 4000), weight=1.2).drop("text")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) // 500 AS batch FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, batch, round((l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w + 1e-8), 6) AS l_quantity FROM r WINDOW w AS (PARTITION BY batch)
""")
def min_max_scaled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities scaled within batches of 500 rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    by = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return scale.min_max_scaled_batches(rows, ["l_quantity"], by, 500).select("l_orderkey", "l_linenumber", "l_partkey", "batch", F.round("l_quantity", 6).alias("l_quantity"))


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS t FROM w),
h AS (SELECT doc_id, CAST('0x' || substr(md5('0:' || t), 1, 13) AS BIGINT) AS h FROM t),
c AS (SELECT doc_id, (h // 2) % 262144 AS slot, CAST(sum(1 - 2 * (h % 2)) AS BIGINT) AS c FROM h GROUP BY ALL HAVING sum(1 - 2 * (h % 2)) <> 0),
p AS (SELECT doc_id, sign(c) * ln(1 + abs(c)::DOUBLE) AS w, CAST('0x' || substr(md5('0:' || slot || ':' || j), 1, 13) AS BIGINT) AS h FROM c, unnest(range(0, 4)) AS u(j)),
x AS (SELECT doc_id, (h // 2) % 64 AS i, sum(w * (1 - 2 * (h % 2))) AS x FROM p GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(u.i AS INTEGER) AS i, round(coalesce(x.x / nullif(n.n, 0), 0), 5) AS x FROM (SELECT DISTINCT doc_id FROM documents) d, unnest(range(0, 64)) AS u(i)
LEFT JOIN x ON x.doc_id = d.doc_id AND x.i = u.i LEFT JOIN n ON n.doc_id = d.doc_id
""")
def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of every document, a row for each component."""
    vectors = embed.text_vectors(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return vectors.select("doc_id", F.posexplode("vector").alias("i", "x")).select("doc_id", "i", F.round("x", 5).alias("x"))


@query("""
SELECT c_custkey, score FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE (c_custkey % 6)::DOUBLE END AS score FROM customer) WHERE score >= 3
""")
def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores out of judges' answers in several forms, made of the customers; those of 3 and above stay."""
    k = F.col("c_custkey")
    n = (k % 6).cast("string")
    answer = F.when(k % 4 == 0, F.concat(F.lit("Clear speech, score of others was 9. Score: "), n)).when(k % 4 == 1, F.concat(F.lit("**Rating is** fine.\nFinal rating: **"), n, F.lit("**/5"))).when(k % 4 == 2, F.concat(F.lit(" "), n, F.lit(".0\n"))).otherwise("no idea, maybe 4")
    return table(spark, sf_dir, "customer").select("c_custkey", T.judged_score(answer, 0, 5).alias("score")).filter("score >= 3")


@query("SELECT s_suppkey, '[{\"role\":\"system\",\"content\":\"Help.\"},{\"role\":\"user\",\"content\":\"1+1\"},{\"role\":\"assistant\",\"content\":\"2\"},{\"role\":\"user\",\"content\":\"2+3\"},{\"role\":\"assistant\",\"content\":\"5\"},{\"role\":\"user\",\"content\":\"' || s_name || '\"}]' AS messages FROM supplier")
def few_shot_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = chunks.few_shot(F.lit("Help."), [("1+1", "2"), ("2+3", "5")], F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(ms).alias("messages"))


@query("SELECT date_trunc('day', ts) AS day, count(DISTINCT user_id % 40) AS users, count(DISTINCT event_type) AS types FROM events GROUP BY 1")
def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of each day out of sketches of its hours: few enough for sketches to be exact."""
    hours = aggregates.sketches(table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts")), ["hour"], {"users": F.col("user_id") % 40, "types": F.col("event_type")})
    days = aggregates.merged(hours.withColumn("day", F.date_trunc("day", "hour")), ["day"], ["users", "types"])
    return days.select("day", "users", "types")

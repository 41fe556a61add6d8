"""Queries of lookups, joins, sets, aggregates and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import aggregates, joins, order, scale, windows
from ..operators import text as chunks
from ..session import table
from ..sources.sinks import upserted
from ..streaming import events as streams
from .registry import query

# Codes of order priorities and shares of risk by status.
PRIORITY_CODE = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
STATUS_RISK = {"F": 0.4, "O": 0.1}


def user_store(orders: DataFrame) -> DataFrame:
    """What is known of each customer: mean, deviation and number of orders, kinds of priority."""
    return orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("user_avg"), F.stddev_samp("o_totalprice").alias("user_std"), F.count(F.lit(1)).alias("user_n"), F.count_distinct("o_orderpriority").alias("user_kinds"))


@query("""
WITH u AS (SELECT o_custkey, avg(o_totalprice) AS user_avg, stddev_samp(o_totalprice) AS user_std, count(*) AS user_n FROM orders GROUP BY o_custkey),
m AS (SELECT o_orderpriority, avg(o_totalprice) AS kind_avg, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS kind_rate FROM orders GROUP BY o_orderpriority),
j AS (
  SELECT o.*, coalesce(user_avg, 0) AS ua, coalesce(user_std, 0) AS us, coalesce(user_n, 0) AS un, coalesce(kind_avg, 0) AS ka, coalesce(kind_rate, 0) AS kr
  FROM orders o LEFT JOIN u ON o.o_custkey = u.o_custkey LEFT JOIN m ON o.o_orderpriority = m.o_orderpriority
),
f AS (
  SELECT o_orderkey, ln(1 + o_totalprice) AS amount_log, (o_totalprice - ua) / greatest(us, 1e-6::DOUBLE) AS amount_z, o_totalprice / greatest(ka, 1.0::DOUBLE) AS amount_ratio,
    o_totalprice % 1.0 < 0.01 AS is_round, CAST(hour(o_orderdate) AS BIGINT) AS hour, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS weekday, hour(o_orderdate) BETWEEN 1 AND 5 AS off_hours,
    CAST(coalesce(map_extract_value(MAP {'1-URGENT': 1, '2-HIGH': 2, '3-MEDIUM': 3, '4-NOT SPECIFIED': 4, '5-LOW': 5}, o_orderpriority), 0) AS BIGINT) AS priority_code,
    CASE o_orderstatus WHEN 'F' THEN 0.4 WHEN 'O' THEN 0.1 ELSE 0.15 END::DOUBLE AS status_risk, un, kr, us FROM j
),
s AS (SELECT *, 1 / (1 + exp(-(0.8 * least(greatest(amount_z, -5), 5) + 2 * status_risk + amount_ratio - 2.5 - 0.01 * un))) AS score FROM f WHERE amount_z IS NOT NULL)
SELECT o_orderkey, round(amount_log, 4) AS amount_log, is_round, hour, weekday, off_hours, priority_code, status_risk, un AS user_n, round(kr, 4) AS kind_rate, round(score, 4) AS score,
  CASE WHEN score > 0.8 THEN 'critical' WHEN score > 0.5 THEN 'high' WHEN score > 0.1 THEN 'medium' ELSE 'low' END AS risk_tier, score > 0.8 AS should_alert
FROM s WHERE us > 0
""")
def lookup_join_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders scored by features of themselves, their customer and their priority."""
    orders = table(spark, sf_dir, "orders")
    kinds = orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("kind_avg"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("kind_rate"))
    j = joins.lookup_join(orders, user_store(orders), "o_custkey", {"user_avg": 0.0, "user_std": 0.0, "user_n": 0})
    j = joins.lookup_join(j, kinds, "o_orderpriority", {"kind_avg": 0.0, "kind_rate": 0.0})
    price = F.col("o_totalprice")
    f = j.filter("user_std > 0").select(
        "o_orderkey", F.log1p(price).alias("amount_log"), N.z_score(price, F.col("user_avg"), F.col("user_std")).alias("amount_z"), (price / F.greatest("kind_avg", F.lit(1.0))).alias("amount_ratio"),
        (price % 1.0 < 0.01).alias("is_round"), F.hour("o_orderdate").cast("long").alias("hour"), N.monday_zero(F.col("o_orderdate")).cast("long").alias("weekday"), N.off_hours(F.col("o_orderdate")).alias("off_hours"),
        N.lookup(F.col("o_orderpriority"), PRIORITY_CODE, 0).cast("long").alias("priority_code"), N.lookup(F.col("o_orderstatus"), STATUS_RISK, 0.15).alias("status_risk"), "user_n", "kind_rate",
    )
    z = F.least(F.greatest("amount_z", F.lit(-5.0)), F.lit(5.0))
    s = f.withColumn("score", 1 / (1 + F.exp(-(0.8 * z + 2 * F.col("status_risk") + F.col("amount_ratio") - 2.5 - 0.01 * F.col("user_n")))))
    rounded = {c: F.round(c, 4) for c in ("amount_log", "kind_rate", "score")}
    return s.withColumns({"risk_tier": N.risk_tier(F.col("score")), "should_alert": F.col("score") > 0.8}).withColumns(rounded).drop("amount_z", "amount_ratio")


@query("SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*)) AS user_avg, round(stddev_samp(o_totalprice), 4) AS user_std, count(*) AS user_n, count(DISTINCT o_orderpriority) AS user_kinds FROM orders GROUP BY o_custkey")
def feature_store_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cents = orders.groupBy("o_custkey").agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / (100 * F.count(F.lit(1)))).alias("user_avg"))
    return user_store(orders).drop("user_avg").withColumn("user_std", F.round("user_std", 4)).join(cents, "o_custkey")


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'Unknown') AS nation, coalesce(r_name, 'Unknown') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_join_default_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").filter("n_nationkey < 20").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dim = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return joins.lookup_join(table(spark, sf_dir, "supplier"), dim, "s_nationkey", {"nation": "Unknown", "region": "Unknown"}).select("s_suppkey", "s_name", "nation", "region")


@query("SELECT l_orderkey, l_linenumber, 'Describe ' || p_name || ' by ' || p_brand || ' for ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS prompt FROM lineitem JOIN part ON l_partkey = p_partkey")
def inner_join_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", T.filled("Describe {name} by {brand} for {n}", name=F.col("p_name"), brand=F.col("p_brand"), n=F.col("l_quantity").cast("long")).alias("prompt"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, n_customers, n_suppliers FROM (SELECT c_nationkey, count(*) AS n_customers FROM customer WHERE c_acctbal > 0 GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c_nationkey = s_nationkey")
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return c.join(s, "nationkey", "full")


@query("""
WITH a AS (SELECT event_id, user_id, epoch(ts) AS a0, epoch(ts) + 3600 AS a1 FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
b AS (SELECT event_id AS other_id, user_id, epoch(ts) AS b0, epoch(ts) + 1800 AS b1 FROM events WHERE event_type = (SELECT max(event_type) FROM events))
SELECT event_id, other_id FROM a JOIN b ON a.user_id = b.user_id AND a0 < b1 AND b0 < a1
""")
def range_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    a = events.filter(F.col("event_type") == ends["lo"]).select("event_id", "user_id", at.alias("a0"), (at + 3600).alias("a1"))
    b = events.filter(F.col("event_type") == ends["hi"]).select(F.col("event_id").alias("other_id"), "user_id", at.alias("b0"), (at + 1800).alias("b1"))
    return joins.overlap_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 3600.0).select("event_id", "other_id")


@query("""
WITH r AS (SELECT user_id, ts, max(value) AS last_value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, r.last_value FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts
""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the value of its user's last purchase."""
    events = table(spark, sf_dir, "events")
    right = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return joins.asof_join(events.select("event_id", "user_id", "ts"), right, "user_id", "ts", ["last_value"], F.date_trunc("day", "ts")).select("event_id", "last_value")


@query("SELECT 0 AS dataset_index, n_name AS name, n_regionkey AS key FROM nation UNION ALL SELECT 1, r_name, NULL FROM region")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.union_all(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("key")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'click'")
def intersect_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'purchase'").select("user_id").intersect(e.filter("event_type = 'click'").select("user_id"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_custkey"))


@query("""
SELECT p.position, s_suppkey, p_partkey FROM (SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS position, s_suppkey FROM supplier) s
JOIN (SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS position, p_partkey FROM part) p ON s.position = p.position
""")
def zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return joins.zip_rows(s, p, [F.col("s_acctbal"), F.col("s_suppkey")], [F.col("p_retailprice"), F.col("p_partkey")]).select("position", "s_suppkey", "p_partkey")


@query("SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_per_key(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"])


@query("""
WITH new AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 5 = 0)
SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM new) UNION ALL SELECT * FROM new
""")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "supplier")
    new = old.filter("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1).unionByName(old.filter("s_suppkey % 5 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))
    return upserted(old, new, "s_suppkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, max(l_discount) AS max_discount, min(l_tax) AS min_tax, round(stddev_samp(l_quantity), 6) AS std_qty FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def group_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= date '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.max("l_discount").alias("max_discount"), F.min("l_tax").alias("min_tax"), F.round(F.stddev_samp("l_quantity"), 6).alias("std_qty"))


@query("SELECT event_type, count(*) AS n, count(*) / (SELECT count(*) FROM events)::DOUBLE AS share FROM events GROUP BY 1")
def value_counts_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.shares(table(spark, sf_dir, "events").select("event_type"), "event_type")


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::BIGINT AS g1, grouping(l_linestatus)::BIGINT AS g2, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.percentiles(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


@query("SELECT event_type, true AS close FROM events GROUP BY event_type")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch's count of users is within a tenth of the exact one."""
    # Beside a distinct count, the sketch would be kept for every user of a type; of rows that are distinct it is the same.
    users = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    per = users.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.count("user_id").alias("exact"))
    return per.select("event_type", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


_FLAGGED = "SELECT l.toxic AS y, (d.doc_id % 97) / 97.0::DOUBLE AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select(F.col("toxic").alias("y"), (F.col("doc_id") % 97 / 97.0).alias("s"))


_RATES = "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0) AS accuracy"
_TALLY = "count(*) FILTER (y = 1 AND s >= {t}) AS tp, count(*) FILTER (y = 0 AND s >= {t}) AS fp, count(*) FILTER (y = 1 AND s < {t}) AS fn, count(*) FILTER (y = 0 AND s < {t}) AS tn"


@query(f"SELECT *, {_RATES} FROM (SELECT {_TALLY.format(t=0.5)} FROM ({_FLAGGED}))")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.classification_metrics(_scored(spark, sf_dir), F.col("y"), F.col("s") >= 0.5)


@query(f"SELECT *, {_RATES}, tp + fp AS flagged FROM (SELECT t AS threshold, {_TALLY.format(t='t')} FROM ({_FLAGGED}), (SELECT unnest([0.1, 0.3, 0.5, 0.8]::DOUBLE[]) AS t) GROUP BY t)")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.threshold_sweep(_scored(spark, sf_dir), F.col("y"), F.col("s"), [0.1, 0.3, 0.5, 0.8])


@query(f"WITH f AS ({_FLAGGED}), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM f) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE, 9) AS auc FROM r")
def auc_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.auc_roc(_scored(spark, sf_dir), F.col("y"), F.col("s")).select(F.round("auc", 9).alias("auc"))


@query("SELECT round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e / t)), 9) AS mape, round(sqrt(sum(e * e) / (var_pop(t) * count(*))), 9) AS rse FROM (SELECT l_extendedprice AS t, l_quantity * 1500 - l_extendedprice AS e FROM lineitem)")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = aggregates.regression_metrics(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1500)
    return m.select(F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("mape", 9).alias("mape"), F.round("rse", 9).alias("rse"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS label FROM events")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.label_index(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "label").select("event_id", "label")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem")
def standard_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return scale.standard_scaled(rows, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('3:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN p < floor(n * 0.7 + 1e-9) THEN 'train' WHEN p < floor(n * 0.85 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM r
""")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.7, "val": 0.15, "test": 0.15}, seed=3)


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('5:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS n FROM customer) WHERE n <= 20")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sample_per_group(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 20, seed=5)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
w AS (SELECT user_id, i AS start, list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v FROM r)
SELECT user_id, start, array_to_string(v[1:12], ',') AS past, array_to_string(v[13:16], ',') AS future FROM w WHERE start % 4 = 0 AND len(v) = 16
""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.sliding_windows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 12, 4, 4, block=64)
    return w.select("user_id", "start", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("past", "future")])


@query("""
WITH m AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS slot, avg(value) AS mean FROM events GROUP BY 1)
SELECT g.slot, round(mean, 6) AS mean FROM (SELECT unnest(generate_series((SELECT min(slot) FROM m), (SELECT max(slot) FROM m), INTERVAL 30 MINUTE)) AS slot) g LEFT JOIN m ON g.slot = m.slot
""")
def resample_half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.resample(table(spark, sf_dir, "events"), "ts", "value", 30).withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, (lag(event_type) OVER w) IS DISTINCT FROM event_type AS is_start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def segment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.segment_flags(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "is_start")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 6)})


@query("""
WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], {"n": F.count(F.lit(1))})


@query("""
SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(k + 1 AS BIGINT) AS total_chunks, substr(text, CAST(i * 1350 + 1 AS BIGINT), 1500) AS chunk
FROM (SELECT doc_id, text, CASE WHEN length(text) <= 1500 THEN 0 ELSE CAST(ceil((length(text) - 1500) / 1350.0) AS BIGINT) END AS k FROM documents WHERE length(text) > 0), unnest(range(0, k + 1)) AS t(i)
""")
def chunk_fixed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks.chunk_fixed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "chunk")


@query("""
SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS cleaned, sha256(text) AS content_id,
  CASE WHEN regexp_matches(lower(text), 'urgent|critical|deadline') THEN 'high' WHEN regexp_matches(lower(text), 'important|quarterly|annual') THEN 'medium' ELSE 'low' END AS priority,
  substr('Source: ' || source || ' Text: ' || text, 1, 2048) AS labelled,
  CASE WHEN n_chars <= 128 THEN 128 WHEN n_chars <= 256 THEN 256 WHEN n_chars <= 512 THEN 512 WHEN n_chars <= 1024 THEN 1024 ELSE 0 END AS bucket
FROM documents
""")
def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(text).alias("cleaned"), T.content_id(text).alias("content_id"), T.priority(text).alias("priority"), T.labelled({"Source": F.col("source"), "Text": text}).alias("labelled"), N.length_bucket(F.col("n_chars")).alias("bucket"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain, string_split(url, '/')[-1] AS last_part FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"), T.after_last(F.col("url"), "/").alias("last_part"))


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sections(table(spark, sf_dir, "pages"))


@query("""
SELECT a.s_suppkey AS a, b.c_custkey AS b FROM supplier a JOIN customer b ON a.s_acctbal < b.c_acctbal AND a.s_nationkey > b.c_nationkey WHERE a.s_suppkey % 10 = 0
""")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth supplier with the customers of a larger balance and a smaller nation: two inequalities and no equality."""
    a = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("a"), "s_acctbal", "s_nationkey")
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b"), "c_acctbal", "c_nationkey")
    return joins.theta_join(a, b, [("s_acctbal", "<", "c_acctbal"), ("s_nationkey", ">", "c_nationkey")]).select("a", "b")


@query("""
SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.ts < b.ts AND a.ts + INTERVAL 3 SECOND > b.ts WHERE a.event_type = 'error' AND b.event_type = 'purchase'
""")
def theta_join_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with the purchases of any user less than three seconds after."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    a = events.filter("event_type = 'error'").select(F.col("event_id").alias("a"), F.col("at").alias("a_at"), (F.col("at") + 3_000_000).alias("a_end"))
    b = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("at").alias("b_at"))
    return joins.theta_join(a, b, [("a_at", "<", "b_at"), ("a_end", ">", "b_at")]).select("a", "b")

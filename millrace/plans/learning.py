"""Queries that evaluate, index and fit: detections, approximate search, factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection, factors, vector_index
from ..session import checkpointed, stored, table
from .registry import query


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predicted and true boxes out of order lines: an order is an image; a sixth of the boxes is missed, a ninth predicted twice, all are shifted."""
    x, y = F.col("l_linenumber") * 7 % 10 * 6.0, F.col("l_quantity")
    wide, high = F.col("l_partkey") % 10 + 20.0, F.col("l_suppkey") % 7 + 20.0
    at = lambda dx: F.array(x + dx, y + dx / 2, x + wide, y + high)
    lines = table(spark, sf_dir, "lineitem").withColumns({"image": F.col("l_orderkey"), "label": (F.col("l_suppkey") % 5).cast("int"), "key": F.round(F.col("l_extendedprice") * 100).cast("long") * 2})
    truths = lines.select("image", "label", at(F.lit(0.0)).alias("box"))
    shift = F.round(F.col("l_extendedprice")).cast("long") % 13 / 2.0
    first = lines.filter("l_partkey % 6 <> 0").select("image", "label", F.col("l_discount").alias("score"), "key", at(shift).alias("box"))
    second = lines.filter("l_partkey % 9 = 0").select("image", "label", F.col("l_tax").alias("score"), (F.col("key") + 1).alias("key"), at(shift / 3).alias("box"))
    return first.union(second), truths


_DETECTED = """
WITH RECURSIVE lines AS (
  SELECT l_orderkey AS image, CAST(l_suppkey % 5 AS INTEGER) AS label, CAST(round(l_extendedprice * 100) AS BIGINT) * 2 AS key, l_partkey, l_discount, l_tax, CAST(round(l_extendedprice) AS BIGINT) % 13 / 2.0::DOUBLE AS s,
    (l_linenumber * 7 % 10 * 6)::DOUBLE AS x, l_quantity AS y, (l_partkey % 10 + 20)::DOUBLE AS w, (l_suppkey % 7 + 20)::DOUBLE AS h FROM lineitem
),
t AS (SELECT image, label, x AS x0, y AS y0, x + w AS x1, y + h AS y1, row_number() OVER (PARTITION BY image, label ORDER BY x, y, x + w, y + h) AS i FROM lines),
p AS (
  SELECT image, label, l_discount AS score, key, x + s AS x0, y + s / 2 AS y0, x + w AS x1, y + h AS y1 FROM lines WHERE l_partkey % 6 <> 0
  UNION ALL SELECT image, label, l_tax, key + 1, x + s / 3, y + s / 3 / 2, x + w, y + h FROM lines WHERE l_partkey % 9 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY score DESC, key) AS n FROM p),
cut AS (SELECT image, label, key, n, score, i, greatest(least(a.x1, t.x1) - greatest(a.x0, t.x0), 0) * greatest(least(a.y1, t.y1) - greatest(a.y0, t.y0), 0) AS o, (a.x1 - a.x0) * (a.y1 - a.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) AS areas FROM ranked a LEFT JOIN t USING (image, label)),
cand AS (SELECT image, label, key, n, score, list({'o': coalesce(o / nullif(areas - o, 0), 0), 'i': i} ORDER BY coalesce(o / nullif(areas - o, 0), 0) DESC, i) FILTER (WHERE i IS NOT NULL) AS cs FROM cut GROUP BY ALL),
ladder AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS threshold),
m AS (
  SELECT image, label, threshold, CAST(0 AS BIGINT) AS n, []::BIGINT[] AS used, NULL::BIGINT AS got FROM (SELECT DISTINCT image, label FROM p), ladder
  UNION ALL
  SELECT image, label, threshold, n, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, got FROM (
    SELECT m.image, m.label, m.threshold, c.n, m.used, list_filter(c.cs, lambda x: x.o >= m.threshold AND NOT list_contains(m.used, x.i))[1].i AS got
    FROM m JOIN cand c ON c.image = m.image AND c.label = m.label AND c.n = m.n + 1
  )
),
hits AS (SELECT m.image, m.label, threshold, score, key, CASE WHEN got IS NULL THEN 0 ELSE 1 END AS hit FROM m JOIN cand c ON c.image = m.image AND c.label = m.label AND c.n = m.n),
total AS (SELECT label, count(*) AS truths FROM t GROUP BY label),
curve AS (
  SELECT label, threshold, hit, truths, row_number() OVER w AS place, sum(hit) OVER (w ROWS UNBOUNDED PRECEDING) AS found FROM hits JOIN total USING (label) WINDOW w AS (PARTITION BY label, threshold ORDER BY score DESC, image, key)
),
env AS (
  SELECT label, threshold, hit, truths, found, max(found / place::DOUBLE) OVER (PARTITION BY label, threshold ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM curve
),
area AS (SELECT label, threshold, CAST(max(truths) AS BIGINT) AS truths, count(*) AS predictions, CAST(sum(hit) AS BIGINT) AS found, sum(CASE WHEN hit = 1 THEN p ELSE 0 END) / max(truths) AS area FROM env GROUP BY ALL),
points AS (SELECT label, threshold, k, max(CASE WHEN 100 * found >= k * truths THEN p ELSE 0 END) AS p FROM env, unnest(range(0, 101)) AS u(k) GROUP BY ALL),
ap AS (SELECT label, threshold, sum(p) / 101 AS ap FROM points GROUP BY ALL)
"""


@query(_DETECTED + "SELECT label, threshold, truths, predictions, found, round(ap, 7) AS ap FROM area JOIN ap USING (label, threshold)")
def detection_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of each label at each overlap, by 101 recalls."""
    return detection.average_precision(*_boxes(spark, sf_dir)).withColumn("ap", F.round("ap", 7))


@query(_DETECTED + "SELECT label, threshold, found, round(area, 7) AS area FROM area WHERE threshold IN (0.5, 0.75)")
def detection_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area under the curve of each label at two overlaps."""
    found = detection.average_precision(*_boxes(spark, sf_dir), [0.5, 0.75], points=None)
    return found.select("label", "threshold", "found", F.round("ap", 7).alias("area"))


@query(_DETECTED + "SELECT round(avg(ap), 7) AS map, round(avg(CASE WHEN threshold = 0.5 THEN ap END), 7) AS map_50, round(avg(CASE WHEN threshold = 0.75 THEN ap END), 7) AS map_75, round(avg(found / truths::DOUBLE), 7) AS mar, count(DISTINCT label) AS labels FROM area JOIN ap USING (label, threshold)")
def detection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection.mean_average_precision(detection.average_precision(*_boxes(spark, sf_dir)))
    return found.select(*[F.round(c, 7).alias(c) for c in ("map", "map_50", "map_75", "mar")], "labels")


_COS = "list_inner_product(q.e, v.e) / nullif(sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)), 0)"
_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)"


def _searched(spark: SparkSession, sf_dir: str, k: int, **options) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    quantizer = vector_index.fit(vectors)
    queries = vectors.filter("vec_id % 50 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = vector_index.search(checkpointed(vector_index.index(vectors, quantizer)), quantizer, queries, k, **options)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the ten best vectors of every row whose id is divisible by 50, by the index. Its recall is measured in the tests; where a least score leaves the near ones alone, see below, it is whole on the test tables."""
    return _searched(spark, sf_dir, 10)


@query(f"WITH {_V}, s AS (SELECT q.vec_id AS query_id, v.vec_id, coalesce({_COS}, 0) AS score FROM v q, v WHERE q.vec_id % 50 = 0 AND v.label < 5) SELECT query_id, vec_id, round(score, 6) AS score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s WHERE score >= 0.9) WHERE n <= 5")
def indexed_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among some labels, with a least score."""
    return _searched(spark, sf_dir, 5, candidates=100, where=F.col("label") < 5, least=0.9)


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' mean quantities of each supplier's goods; every seventh order is held out."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    own = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"), F.col("l_quantity").alias("rating"), (F.col("o_orderkey") % 7 == 0).alias("held"))
    return own.groupBy("user", "item", "held").agg(F.avg("rating").alias("rating"))


def factor_sql(rounds: int, penalty: float) -> str:
    """Alternating least squares of one factor, round by round."""
    half = "{t}{r} AS MATERIALIZED (SELECT {a}, sum(rating * f) / (sum(f * f) + {p} * count(*)) AS f FROM train JOIN {o} USING ({b}) GROUP BY {a})"
    steps = []
    for r in range(1, rounds + 1):
        steps += [half.format(t="u", r=r, a='"user"', b="item", o=f"i{r - 1}", p=penalty), half.format(t="i", r=r, a="item", b='"user"', o=f"u{r}", p=penalty)]
    return f"""
WITH ratings AS MATERIALIZED (
  SELECT o_custkey AS "user", l_suppkey AS item, o_orderkey % 7 = 0 AS held, avg(l_quantity) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
),
train AS MATERIALIZED (SELECT * FROM ratings WHERE NOT held),
i0 AS MATERIALIZED (SELECT item, (CAST('0x' || substr(md5('0:' || item || ':0'), 1, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE AS f FROM (SELECT DISTINCT item FROM train)),
{", ".join(steps)}
SELECT "user", item, round(u.f * i.f, 4) AS predicted FROM ratings LEFT JOIN u{rounds} u USING ("user") LEFT JOIN i{rounds} i USING (item) WHERE held
"""


@query(factor_sql(3, 0.1))
def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the held-out ratings by factors of one number each, which SQL can follow."""
    ratings = stored(_ratings(spark, sf_dir), "ratings")
    users, items = factors.fit(ratings.filter("not held"), rank=1, rounds=3)
    return factors.predicted(ratings.filter("held").select("user", "item"), users, items).select("user", "item", F.round("predicted", 4).alias("predicted"))

"""Queries of vector and lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import search
from ..session import table
from .registry import query

_COS = "list_inner_product(q.e, v.e) / nullif(sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)), 0)"
_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)"


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vec_id % 50 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"WITH {_V}, s AS (SELECT q.vec_id AS query_id, v.vec_id, coalesce({_COS}, 0) AS score FROM v q, v WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, round(score, 6) AS score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 10")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors by cosine for every row whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return search.knn(vectors, _queries(vectors), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_V}, s AS (SELECT q.vec_id AS query_id, v.vec_id, coalesce({_COS}, 0) AS score FROM v q, v WHERE q.vec_id % 50 = 0 AND v.label < 5) SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s WHERE score >= 0.2) WHERE n <= 5")
def knn_prefilter_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search.knn(vectors.filter("label < 5"), _queries(vectors), 5, least=0.2).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_V} SELECT q.vec_id AS a, v.vec_id AS b, round(coalesce({_COS}, 0), 6) AS similarity FROM v q JOIN v ON v.vec_id = q.vec_id + 1")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and the next: a table of pairs joined twice."""
    v = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(N.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("""
WITH a AS (SELECT p_brand AS name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 100),
b AS (SELECT p_brand AS name, row_number() OVER (ORDER BY p_size, p_partkey) AS r FROM part QUALIFY r <= 100),
u AS (SELECT name, max(1.0::DOUBLE / (r + 1)) AS s FROM a GROUP BY name UNION ALL SELECT name, max(1.0::DOUBLE / (r + 10)) FROM b GROUP BY name)
SELECT name, round(sum(s), 9) AS score FROM u GROUP BY name
""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), "p_retailprice", "p_size")

    def best(*by):
        return part.orderBy(*by).limit(100).withColumn("rank", F.row_number().over(W.orderBy(*by)))  # of a hundred rows

    fused = search.rank_fusion([(best(F.desc("p_retailprice"), "p_partkey"), 1), (best("p_size", "p_partkey"), 10)], "name")
    return fused.select("name", F.round("score", 9).alias("score"))


@query("""
WITH o AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM o),
c AS (SELECT doc_id, len AS n, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS w FROM o) GROUP BY 1, 2, 3),
d AS (SELECT w, count(*) AS df FROM c GROUP BY w),
s AS (SELECT q.doc_id AS query_id, c.doc_id, round(sum(ln(1 + (t.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * c.tf * 2.2::DOUBLE / (c.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * c.n / t.mean))), 9) AS score FROM c q JOIN c ON q.w = c.w JOIN d ON d.w = c.w, t WHERE q.doc_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM s) WHERE n <= 10
""")
def lexical_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for every row whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return search.bm25(docs, queries, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))

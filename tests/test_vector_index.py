"""The vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import search, vector_index
from millrace.session import table

ROWS = "vec_id long, embedding array<double>, kind string"


def ids(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    return {q: sorted(rows) for q, rows in out.items()}


def recall(got, exact):
    return sum(len({i for _, i, _ in got.get(q, [])} & {i for _, i, _ in rows}) for q, rows in exact.items()) / sum(map(len, exact.values()))


def asked(vectors, every):
    return vectors.filter(f"vec_id % {every} = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@pytest.fixture(scope="module")
def built(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    quantizer = vector_index.fit(vectors)
    return vectors, quantizer, vector_index.index(vectors, quantizer).cache()


def test_recall_on_the_whole_table(built):
    vectors, quantizer, indexed = built
    exact = ids(search.knn(vectors, asked(vectors, 10), 10))
    got = ids(vector_index.search(indexed, quantizer, asked(vectors, 10), 10))
    assert recall(got, exact) >= 0.95
    true = {(q, i): s for q, rows in exact.items() for _, i, s in rows}
    assert all(true.get((q, i), s) == s for q, rows in got.items() for _, i, s in rows)  # scores are exact
    assert 1 < quantizer.probes <= len(quantizer.centres)


def test_dealing_changes_nothing(built, monkeypatch):
    vectors, quantizer, indexed = built
    whole = ids(vector_index.search(indexed, quantizer, asked(vectors, 40), 5))
    monkeypatch.setattr(vector_index, "LIST", 20)
    monkeypatch.setattr(vector_index, "QUERIES", 3)
    assert ids(vector_index.search(indexed, quantizer, asked(vectors, 40), 5)) == whole


def test_filter_holds_before_candidates(built):
    vectors, quantizer, indexed = built
    few = F.col("label") == 3
    exact = ids(search.knn(vectors.filter(few), asked(vectors, 40), 5))
    got = ids(vector_index.search(indexed, quantizer, asked(vectors, 40), 5, where=few, candidates=20))
    assert recall(got, exact) >= 0.8 and {i for rows in got.values() for _, i, _ in rows} <= {r[0] for r in vectors.filter(few).select("vec_id").collect()}
    strict = vector_index.search(indexed, quantizer, asked(vectors, 40), 5, least=0.5).collect()
    assert strict and all(r["score"] >= 0.5 for r in strict)


def test_saved_and_loaded(spark, built, tmp_path):
    vectors, quantizer, indexed = built
    vector_index.save(indexed, quantizer, str(tmp_path / "i"))
    again, same = vector_index.load(spark, str(tmp_path / "i"))
    assert same.probes == quantizer.probes and np.array_equal(same.centres, quantizer.centres) and np.array_equal(same.words, quantizer.words)
    assert ids(vector_index.search(again, same, asked(vectors, 100), 5)) == ids(vector_index.search(indexed, quantizer, asked(vectors, 100), 5))


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist(), "x") for i in range(120)] + [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0], "copy") for i in range(60)]
    rows += [(300, None, "x"), (301, [], "x"), (302, [1.0], "x"), (303, [float("nan")] * 6, "x"), (304, [0.0] * 6, "x"), (305, [None, 1.0, 0.0, 0.0, 0.0, 0.0], "x")]
    vectors = spark.createDataFrame(rows, ROWS)
    quantizer = vector_index.fit(vectors, dim=6, recall=1.0)
    indexed = vector_index.index(vectors, quantizer)
    assert indexed.count() == 181  # all but those that are null, of another length or not finite
    queries = spark.createDataFrame([(1, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]), (2, None), (3, [1.0]), (4, rows[7][1])], "query_id long, query array<double>")
    got = ids(vector_index.search(indexed, quantizer, queries, 4))
    assert [i for _, i, _ in got[1]] == [200, 201, 202, 203] and got[4][0][1] == 7 and set(got) == {1, 4}
    none = vectors.limit(0)
    empty = vector_index.fit(none, dim=6)
    assert vector_index.search(vector_index.index(none, empty), empty, queries, 4).collect() == []

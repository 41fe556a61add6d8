"""Cutoffs of the quality rules in small strata."""

import numpy as np

from millrace.llm import quality

SCORED = "doc_id long, lang string, base_failed boolean, symbol_ratio double, dup_line_ratio double, repeat_ratio double, long_words double"


def test_small_stratum_gets_cutoffs(spark):
    rows = [(i, "en" if i < 300 else "es", False, 0.0, 0.0, 0.0, 5.0) for i in range(600)] + [(i, "fr", False, 0.0, 0.0, 0.0, 5.0) for i in range(600, 800)]
    labels = spark.createDataFrame([(i, 1) for i in range(800)], "doc_id long, quality int")
    got = {r["stratum"]: r for r in quality.cutoffs(spark.createDataFrame(rows, SCORED), labels).collect()}
    for lang in ("en", "es"):
        assert got[lang]["max_symbol_ratio"] == 0.02 and got[lang]["max_dup_line_ratio"] is not None
    assert all(got["fr"][f"max_{m}"] is None for m in quality.GRID)  # 200 good documents do not show a rate below 2 %


def test_repeated_rows_prove_nothing(spark):
    """Bounds are of documents: thirty of them give no cutoff, however often each stands there, and the strictest of an id's texts counts."""
    once = [(i, "en", False, 0.0, 0.0, 0.0, 5.0) for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] * 3, "doc_id long, quality int")
    for times in (1, 10):
        got = quality.cutoffs(spark.createDataFrame(once * times, SCORED), labels).first()
        assert all(got[f"max_{m}"] is None for m in quality.GRID)
    many = [(i, "en", False, 0.0, 0.0, 0.0, 5.0) for i in range(300)] + [(i, "en", False, 9.0, 0.0, 0.0, 5.0) for i in range(20)]
    known = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    assert all(quality.cutoffs(spark.createDataFrame(many, SCORED), known).first()[f"max_{m}"] is None for m in quality.GRID)


def test_joint_rejections_stay_within_the_limit(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "en", False, *(float(v) for v in rng.exponential([0.05, 0.05, 0.05, 2.0]))) for i in range(3000)]
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    got = quality.cutoffs(spark.createDataFrame(rows, SCORED), labels).first()
    rejected = sum(any(v > got[f"max_{m}"] for m, v in zip(quality.GRID, r[3:], strict=True)) for r in rows)
    assert 0 < rejected <= 0.02 * len(rows)
    assert quality.upper_bound(rejected, len(rows), 0.05) <= 0.02


def test_path_is_nested():
    assert all(b[m] <= a[m] for a, b in zip(quality.PATH, quality.PATH[1:]) for m in quality.GRID)


def test_exact_binomial_bounds():
    """Known one-sided bounds of Clopper and Pearson."""
    import math

    import pytest

    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.upper_bound(1, 10, 0.05) == pytest.approx(0.394163, abs=1e-5)
    assert quality.upper_bound(5, 5, 0.05) == quality.upper_bound(0, 0, 0.05) == 1.0
    p = quality.upper_bound(7, 60, 0.01)  # just there seven or fewer have that probability
    assert sum(math.comb(60, k) * p**k * (1 - p) ** (60 - k) for k in range(8)) == pytest.approx(0.01, rel=1e-6)


def test_statistics_by_brute_force(spark, tiny):
    import re

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = {}
        for t in triples:
            count[t] = count.get(t, 0) + 1
        covered = {i + k for i, t in enumerate(triples) if count[t] > 1 for k in range(3)}
        return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    got = {r["doc_id"]: tuple(r)[2:7] for r in quality.stats(docs).collect()}
    assert got == {r["doc_id"]: plain(r["text"]) for r in docs.collect()}

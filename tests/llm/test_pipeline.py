"""The pipeline's stages, each on its predecessor's rows, against plain reckonings; odd rows, empty tables, clashing names."""

import pytest
from test_operators import brute_join
from test_suffixes import brute

import corpus_pipeline
from millrace.llm import jaccard, mixing, suffixes, toxicity
from millrace.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tiny):
    docs = table(spark, tiny, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        assert docs.columns == COLUMNS
        docs = stage(spark, docs, tiny).cache()
        kept.append(docs)
    rows = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in kept[:4]]
    # 1: what the operator predicts toxic is gone.
    toxic = {r["doc_id"] for r in toxicity.toxicity(kept[0], table(spark, tiny, "labels")).collect() if r["predicted"]}
    assert rows[1] == {i: t for i, t in rows[0].items() if i not in toxic}
    # 2: of each group of similar texts, the least id.
    assert rows[2] == {i: rows[1][i] for i, _, c in brute_join(list(rows[1].items())) if i == c}
    # 3: strings of 50 bytes that a smaller id has are gone.
    removed = {i: n for i, _, n, _, _ in brute(list(rows[2].items()))}
    for i, t in rows[2].items():
        left = len((rows[3][i] or "").encode())
        assert left <= len((t or "").encode()) - removed[i] <= left + 6 * max(1, removed[i])  # a cut inside a character drops its other bytes
        if not removed[i]:
            assert rows[3][i] == t
    # 4: as often as the operator says; 5: a row for each, without loss.
    copies = {r["doc_id"]: r["n_copies"] for r in mixing.mix(kept[3], seed=corpus_pipeline.MIX_SEED).collect()}
    got = {}
    for r in kept[4].select("doc_id").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == copies
    assert kept[5].count() == kept[4].count() and kept[5].filter("not lossless").count() == 0


def odd(spark):
    same = "one and the same text of some words that several rows have, long enough for a window of bytes"
    rows = [(1, same, "en", "a", 95), (2, same, "en", "a", 95), (2, same, "en", "a", 95), (None, same, "en", None, 95), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t", "en", "b", 2), (6, "x" * 300_000, "en", "b", 300_000), (7, "\U0001f600 é ▁", "de", "b", 5), (7, "\U0001f600 é ▁", "de", "b", 5)]
    return spark.createDataFrame(rows, DOCS)


def test_odd_rows(spark, tiny):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, tiny).cache()
        if name == "ngram_jaccard_join":
            # Of the copies the least id stays, and the row without an id; both rows of 7; all without words.
            assert sorted(r["doc_id"] or 0 for r in after.collect()) == [0, 1, 3, 4, 5, 6, 7, 7]
        elif name in ("toxicity", "suffix_array_dedup"):
            assert after.count() == docs.count()
        if name == "suffix_array_dedup":
            got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
            assert got[3] == (None, None) and got[4] == ("", 0) and got[6] == ("x" * 300_000, 300_000) and got[None][1] == len(got[None][0])
        docs = after
    assert docs.filter("not lossless").count() == 0


def test_all_stages_on_an_empty_table(spark, tiny):
    docs = odd(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
        assert docs.collect() == []


@pytest.mark.parametrize("names", ["__rate __source __Salt __own_salt", "__doc_id __known __t1 __t2 __runs", "n_copies_ copy_ __gone __labelled"])
def test_clashing_names(spark, tiny, names):
    docs = odd(spark)
    for k, n in enumerate(names.split()):
        docs = docs.selectExpr("*", f"{k} as `{n}`")
    for change in (lambda d: toxicity.clean(d, table(spark, tiny, "labels")), jaccard.one_of_each, suffixes.without_repeats, lambda d: mixing.mix(d, seed=3).select(*d.columns)):
        after = change(docs)
        assert after.columns == docs.columns
        assert {tuple(r[n] for n in names.split()) for r in after.collect()} == {tuple(range(len(names.split())))}


def test_mixing_keeps_what_it_should(spark):
    docs = odd(spark)
    rows = mixing.mix(docs, {"a": 1.0, "b": 2.0}, rows_out=40, seed=2).collect()
    assert {r["source"] for r in rows} == {"a", "b"}
    per = {}
    for r in rows:
        per.setdefault((r["doc_id"], r["text"]), []).append((r["copy"], r["n_copies"]))
    for (i, _), found in per.items():
        n, times = found[0][1], 2 if i in (2, 7) else 1  # repeated rows share their draw, and all copies stay
        assert sorted(found) == sorted([(k, n) for k in range(1, n + 1)] * times)

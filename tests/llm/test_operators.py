"""The corpus operators against brute force, SQL, round trips and held-out accuracy, and on odd rows."""

import numpy as np
import pytest
from oracle import connect, differing

from millrace.llm import chat, html, jaccard, mixing, pieces, quality, queries, toxicity, urls
from millrace.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "word", "en", None, 4), (3, "word", "en", None, 4), (4, "x" * 60000, "en", "b", 60000), (None, "some text of no id", "en", "b", 18), (5, "a b " * 20000, "en", "b", 80000), (6, "▁ \U0001f600 \t\n", "en", "b", 6)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tiny, name):
    assert differing(queries.queries()[name](spark, tiny), connect(tiny), queries.oracle_sql()[name]) == ""


def shingles(text, k=5):
    w = bytes((text or "").encode()).lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_join(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def test_join_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text")
    got = sorted(tuple(r) for r in jaccard.similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_join([tuple(r) for r in docs.collect()])


def test_join_planted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(6):
        text = list(rng.choice(words, 60))
        for copy in range(8):
            own = list(text)
            for at in rng.integers(0, 60, copy // 2):
                own[at] = str(rng.choice(words))
            rows.append((len(rows), " ".join(own)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "ONE  two"), (104, "one two three")]
    got = sorted(tuple(r) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_join(rows)


def test_pieces_round_trip(spark, tiny):
    docs = table(spark, tiny, "documents")
    got = pieces.segment(docs, seed=4).collect()
    assert len(got) == docs.count() and all(r["lossless"] for r in got)
    again = pieces.segment(docs.repartition(7), seed=4).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == sorted((r["doc_id"], tuple(r["ids"])) for r in again)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).filter("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert len(got) > 50 and right / len(got) >= 0.9


def test_rates_of_mixing(spark):
    docs = spark.createDataFrame([(i, "t", "en", "big" if i % 10 else "small", 1) for i in range(4000)], DOCS)
    got = {r["source"]: r["count"] for r in mixing.mix(docs, {"big": 1.0, "small": 1.0}, seed=1).groupBy("source").count().collect()}
    assert abs(got["big"] - 2000) < 250 and abs(got["small"] - 2000) < 400


def test_odd_documents(spark, tiny):
    docs, labels = odd_docs(spark), table(spark, tiny, "labels")
    n = docs.count()
    assert toxicity.toxicity(docs, labels).count() == n
    assert all(r["lossless"] for r in pieces.segment(docs).collect())
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and got[5]["n_repeat_words"] == 40000 and got[5]["base_failed"]
    assert mixing.mix(docs, seed=2).count() >= 0
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs).collect()}[2] == 2


def test_empty_tables(spark, tiny):
    docs = odd_docs(spark).limit(0)
    labels, pages, talk = (table(spark, tiny, t).limit(0) for t in ("labels", "pages", "conversations"))
    for df in (toxicity.toxicity(docs, labels), pieces.segment(docs), quality.quality(docs, labels), mixing.mix(docs), jaccard.similar_documents(docs), html.extract(pages), urls.judge(pages), chat.perspectives(talk)):
        assert df.collect() == []


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (3, "http://A.example.COM/en/7?x", "<p>One &amp;\n two"), (4, "http://www.x.net/de/1#f", "<div><script>x</script>")], "page_id long, url string, html string")
    text = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert text[1]["text"] == "" and text[1]["n_chars"] == 0 and text[4]["text"] == ""
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert got[1]["host"] == "" and got[2]["path"] == ""
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (got[4]["rule"], got[4]["verdict"]) == ("net/de/", "allow")


def test_join_at_its_border(spark):
    """Nine shingles each, eight alike, ten in all: just 0.8. Of eight, seven and nine: below. Within 50 words, one changed word links and two don't."""
    words = lambda n, p: [f"{p}{i}" for i in range(n)]
    with_ = lambda ws, *at: " ".join("other" if i in at else w for i, w in enumerate(ws))
    a, b, c = words(13, "a"), words(12, "b"), words(50, "c")
    rows = [(1, with_(a)), (2, with_(a, 12)), (3, with_(b)), (4, with_(b, 11)), (5, with_(c)), (6, with_(c, 20)), (7, with_(c, 10, 40))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_join(rows)


def test_join_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (3, text), (None, text), (9, "quite another text of some seven words"), (9, text), (10, "quite another text of some seven words"), (11, " "), (12, " "), (13, None)]
    got = sorted((tuple(r) for r in jaccard.similar_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(5, 26, 3), (5, 26, 3), (3, 26, 3), (None, 26, None), (9, 3, 3), (9, 26, 3), (10, 3, 3), (11, 0, 11), (12, 0, 12), (13, 0, 13)], key=str)


def test_join_of_one_shingle_sets(spark):
    """Equal sets of one shingle are linked, also where very many others hold that shingle; and a hub of least id."""
    rows = [(i, f"a b c d e f{i}") for i in range(200)] + [(500, "a b c d e"), (501, "A  b c d e"), (502, "a b c d\te"), (503, "other five words are here"), (504, "Other five words are here")]
    hub = [f"h{i}" for i in range(60)]
    rows += [(600 + i, " ".join(hub[:30] + ([] if i == 0 else [f"n{i}"]) + hub[30:])) for i in range(300)]
    got = sorted(tuple(r) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_join(rows)

"""URL filters: Viterbi against all cuts, Bayes on held-out URLs, hosts of many rows, odd URLs."""

import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import urls
from millrace.llm.common import table


def all_cuts(name):
    for k in range(len(name)):
        for at in itertools.combinations(range(1, len(name)), k):
            yield [name[a:b] for a, b in zip([0, *at], [*at, len(name)])]


def test_viterbi_against_all_cuts():
    rng = random.Random(3)
    for _ in range(200):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(5)}
        total = float(sum(counts.values()) + 10)
        logs = {w: math.log(c / total) for w, c in counts.items()}
        name = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        worth = lambda cut: sum(max(logs.get(w, -math.inf), math.log(10 / total) - len(w) * math.log(10)) for w in cut)
        got = urls.segmented(name, logs, total)
        assert "".join(got) == name and abs(worth(got) - max(map(worth, all_cuts(name)))) < 1e-9


def test_held_out_urls(spark, tiny):
    """Trained on three of four labelled URLs, tested on the rest, each in turn."""
    pages = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", F.lit(None).cast("string").alias("url"), "html")
    rows = [line.split() for line in open(urls.LABELLED, encoding="utf-8")]
    own = spark.createDataFrame([(10_000 + i, u, None) for i, (_, u) in enumerate(rows)], "page_id long, url string, html string")
    right = 0
    for fold in range(4):
        taught = spark.createDataFrame([(u, y) for i, (y, u) in enumerate(rows) if i % 4 != fold], "url string, label string")
        got = urls.judge(pages.union(own), [], labelled=taught).filter("page_id >= 10000").collect()
        right += sum(r["verdict"] == rows[r["page_id"] - 10_000][0] for r in got if (r["page_id"] - 10_000) % 4 == fold)
    assert right / len(rows) >= 0.85


def test_rows_of_a_hot_host_and_odd_urls(spark, monkeypatch):
    monkeypatch.setattr(urls, "HOT_ROWS", 3)
    rows = [(i, f"http://www.cheap-casino.com/p/{i}", None, 1) for i in range(20)] + [(20, None, None, 1), (21, "no scheme", "<p>x</p>", 1), (21, "no scheme", "<p>x</p>", 1), (22, "HTTP://A.NET", "", 1), (23, "http://" + "garden" * 3000 + ".net/x", None, 1), (24, "://", None, 1), (None, "http://b.org/es/", None, 1)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, words int")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["words"] == ["www", "cheap", "casino", "com", "p"] and by[i]["verdict"] == "block" for i in range(20))
    assert by[20]["host"] == by[21]["host"] == by[24]["host"] == "" and by[20]["words"] == [] and by[20]["verdict"] == "allow"
    assert by[22]["host"] == "a.net" and by[23]["words"] == ["garden"] * 3000 + ["net", "x"]
    assert (by[None]["rule"], by[None]["verdict"]) == ("org/es/", "block")


def test_long_names_of_random_letters(spark, monkeypatch):
    """A name is segmented whole, whatever stretches it is looked up by."""
    rng = np.random.default_rng(4)
    name = "".join(chr(97 + x) for x in rng.integers(0, 26, 200_000))
    pages = spark.createDataFrame([(1, f"http://{name}.net/x", None), (2, "http://cheapcasinobonus.com/", "<p>cheap bonus</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["words"] for r in urls.judge(pages).collect()}
    assert "".join(got[1]) == name + "netx"
    monkeypatch.setattr(urls, "STRETCH", 7)
    few = {r["page_id"]: r["words"] for r in urls.judge(pages.withColumn("url", F.substring("url", 1, 3000))).collect()}
    monkeypatch.setattr(urls, "STRETCH", 5000)
    assert few == {r["page_id"]: r["words"] for r in urls.judge(pages.withColumn("url", F.substring("url", 1, 3000))).collect()}


def test_host_path_and_rule_of_the_whole_table(spark, tiny):
    """Against a plain reckoning of the contract."""
    pages = table(spark, tiny, "pages").select("page_id", "url", "html")
    odd = ["", "x", "http://", "://A.b?c/d", "http://EXAMPLE.com/en/7?x", "ftp://a.example.com#/en/7", "http://net/de/", "http://x.example.net/de/8/9", "http://notexample.net/de/8", "http://a.org/es", "http://a.org/es/#"]
    every = pages.unionByName(spark.createDataFrame([(-i, u, None) for i, u in enumerate(odd, 1)], pages.schema)).collect()

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h) + len(p), h + p) for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None

    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(spark.createDataFrame(every, pages.schema)).collect()}
    assert got == {r["page_id"]: plain(r["url"]) for r in every}


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []

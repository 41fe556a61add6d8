"""Main text of pages: marginals against enumeration, hand-labelled pages, and odd ones."""

import itertools
import math
import time

import pytest

from millrace.llm import html

MODEL = html.trained()


@pytest.mark.parametrize("page", ["<p>one two three</p>", "<body><nav><a href=/>x</a></nav><article><p>a b c d e</p></article></body>", "<div>some<ul><li>x</li></ul></div><footer>y</footer>"])
def test_marginals_by_enumeration(page):
    nodes = html.in_order(html.parse(page))
    place = {id(n): i for i, n in enumerate(nodes)}
    local = [MODEL.potential(f) for f in html.features(nodes)]
    mass = [0.0] * len(nodes)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        if labels[0]:
            continue  # the root is not content
        x = sum(p[y] for p, y in zip(local, labels))
        for i, n in enumerate(nodes[1:], 1):
            above = labels[place[id(n.parent)]]
            x += next(MODEL.pair[above, k] for k in MODEL.kinds(n) if (above, k) in MODEL.pair)[labels[i]]
        weight = math.exp(x)
        total += weight
        for i, y in enumerate(labels):
            mass[i] += weight * y
    assert MODEL.marginals(nodes) == pytest.approx([m / total for m in mass], abs=1e-9)


LONG = "a sentence of the article that goes on for a while, as they do, until it comes to an end at last. " * 3
PAGES = {
    # Labelled by hand: what is kept, a block a line.
    f"<html><body><p>{LONG}</p></body></html>": [LONG],
    f"<html><body><div>{LONG}</div></body></html>": [LONG],
    "<p>short one</p>": ["short one"],
    "Hello there <p>this is it</p> and more": ["Hello there", "this is it", "and more"],
    "no tags &amp; all\n\t here": ["no tags & all here"],
    "<html><head><title>x y</title></head><body>Short direct text.</body></html>": ["Short direct text."],
    f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>B</a></li></ul></nav><article><h1>Title</h1><p>{LONG}<p>Second</p><ul><li>x</li><li>y z</li></ul></article><footer>&copy; us</footer></body>": ["Title", LONG, "Second", "x", "y z"],
    f"<body><header><a href=/>Site</a></header><main><h2>T</h2><p>{LONG}</p><aside class=sidebar><p>look here too</p></aside></main><section class=comments><div class=comment><p>{LONG}</p></div></section></body>": ["T", LONG],
    f"<body><div class='cookie notice'><p>We use cookies</p><button>OK</button></div><div class=content><h1>T</h1><p>{LONG}</p><form class=newsletter><p>mail</p><input></form><p>End</p></div></body>": ["T", LONG, "End"],
    f"<body><div class=ad>Buy now</div><article><p>{LONG}</p><svg><path d=x><p>{LONG}</p></article><footer>f</footer></body>": [LONG, LONG],
    f"<article><p>{LONG}</p><object><object>inner</object>outer</object><noscript>plain</noscript><p>z</p></article>": [LONG, "inner", "outer", "plain", "z"],
    f"<html><head><title>never closed</head><body><article><p>{LONG}</p></article></body></html>": [LONG],
    f"<article><p>{LONG}</p><script>var a = '<p>no</p>';</script><style>p {{}}</style><svg/><p>a<b>b</b>c<br>d</p></article>": [LONG, "abc d"],
    f"<article><h1>T<p>{LONG}<b>bold<p>next</b> one</article>": ["T", f"{LONG}bold", "next one"],
}


@pytest.mark.parametrize("page", PAGES)
def test_hand_labelled_pages(page):
    assert html.main_text(page, MODEL) == "\n".join(" ".join(x.split()) for x in PAGES[page])


@pytest.mark.parametrize("odd", [lambda n: "<div>" * n + "</p>" * n, lambda n: "<div>" * n + "</div></b>" * n, lambda n: "<svg/>" * n, lambda n: "<b>" * n + "<hr>" * n, lambda n: "<a " * n + "'", lambda n: "<title>" * n, lambda n: "<p><button>" + "<b>" * n + "<hr>" * n, lambda n: "<li><b>" * n])
def test_time_is_linear(odd):
    began = time.process_time()
    html.main_text(odd(20000), MODEL)
    assert time.process_time() - began < 8


def test_whole_table(spark, tiny):
    """The test tables' pages hold their main text in an article element without anything else."""
    import html as entities
    import re

    rows = html.extract(spark.read.parquet(f"{tiny}/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]] or "", re.S)
        blocks = re.split(r"</?(?:p|h1|ul|ol|li)\b[^>]*>", inner[1].replace("<br>", " ")) if inner else []
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


def test_other_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)], key=str)

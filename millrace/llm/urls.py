"""URL filters: fixed rules first, else naive Bayes over segmented words of host and path.

Concatenated names are split by a unigram Viterbi search: of all ways to cut a name into words, the likeliest
under word counts. The counts are those of the words of all pages, over a few fixed ones: the parts of each
distinct name are joined with the counted words, so that a name brings its own small dictionary and no lexicon
is sent around. Multinomial naive Bayes, trained on labelled URLs segmented alike, then scores the words.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import if_small
from .common import released, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, start of the path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Labelled URLs, a verdict and a URL on each line; ``judge`` takes others as a table.
LABELLED = os.path.join(os.path.dirname(__file__), "labelled_urls.txt")
# Common words besides those of the pages.
WORDS = """
the and of to in a is for on with by at from my your our new best top big home house web site page online free world time day man city news book books
game games car phone mobile net work life love food water fire sun moon star blue red green black white gold king queen land park street market farm win winner
hot live video videos sex adult bet betting poker casino slots bonus jackpot loan loans cash money pill pills drug meds viagra cheap discount buy track tracker pixel
click clicks link links ads banner spam torrent crack keygen warez virus download login verify replica outlet report daily local weather science journal university
library school history museum cooking recipes garden travel guide music film reviews health software source project blog photo family football store bank jobs
questions company product event government law research paper club hospital forum review
""".split()
#: How often a fixed word counts, in millionths of all words (and 20 times at least).
FIXED_SHARE = 2000
#: Letters of a word of the lexicon at most. Runs of letters that are no word are of any length.
LONGEST = 32
#: Letters of a name whose substrings are looked up together.
STRETCH = 512
#: Names of so many rows are dealt to several tasks where they meet their words.
HOT_ROWS = 2000
LETTERS = r"\p{L}+"


def host_of(url: Column) -> Column:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    return F.when(has, F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """Path: what follows the host up to "?", "#" or the end; empty without "://"."""
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    return F.when(has, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], part: int) -> Column:
    """The longest fitting rule, or its verdict (``part`` 0): null where none fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == r[1]) | F.endswith(host, F.lit("." + r[1]))) & F.startswith(path, F.lit(r[2]))
        out = F.when(fits, F.lit(r[0] if part == 0 else r[1] + r[2])).otherwise(out)
    return out


def segmented(name: str, logs: dict[str, float], total: float) -> list[str]:
    """The likeliest cut of a name into words, ``logs`` being those of the words' probabilities. A run of n letters that
    is no word has probability 10 / (N 10^n), N being the total of all counts. Of equal cuts, the one whose last word is longest."""
    base, letter = math.log(10 / total), math.log(10)
    longest = max(map(len, logs), default=0)
    best, cut = [0.0], [0]
    unknown, since = -math.inf, 0  # the best cut that ends in a run that is no word, and where that run begins
    for end in range(1, len(name) + 1):
        fresh = best[end - 1] + base
        if fresh > unknown:
            unknown, since = fresh, end - 1
        unknown -= letter
        score, begin = unknown, since
        for k in range(max(0, end - longest), end):
            known = logs.get(name[k:end])
            if known is not None and (best[k] + known > score or (best[k] + known == score and k < begin)):
                score, begin = best[k] + known, k
        best.append(score)
        cut.append(begin)
    out, end = [], len(name)
    while end:
        out.append(name[cut[end] : end])
        end = cut[end]
    return out[::-1]


class NaiveBayes:
    """Multinomial, with add-one smoothing; words of neither class count for nothing. ``prior``: the share of URLs to block that is expected; 0.25 did best on held-out URLs."""

    def __init__(self, block: list[list[str]], allow: list[list[str]], prior: float = 0.25) -> None:
        counts = [Counter(w for x in texts for w in x) for texts in (block, allow)]
        known = {*counts[0], *counts[1]}
        self.odds = {w: math.log((counts[0][w] + 1) / (counts[0].total() + len(known))) - math.log((counts[1][w] + 1) / (counts[1].total() + len(known))) for w in known}
        self.prior = math.log(prior / (1 - prior))

    def score(self, words: list[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.prior + math.fsum(self.odds.get(w, 0.0) for w in words)))))


def labelled_urls(pages: DataFrame) -> DataFrame:
    """The labelled URLs that come with the module: url, label."""
    with open(LABELLED, encoding="utf-8") as f:
        rows = [tuple(reversed(line.split())) for line in f if line.strip()]
    return pages.sparkSession.createDataFrame(rows, "url string, label string")


def names_in(host: Column, path: Column) -> Column:
    """The runs of letters of host and path, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", host, path)), F.lit(f"({LETTERS})"))


def word_counts(pages: DataFrame, html: str) -> DataFrame:
    """(w, c): words of the text of all pages outside of tags, of LONGEST letters at most, and how often they occur."""
    text = F.regexp_replace(F.col(html).cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", " ")
    said = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({LETTERS})"))).alias("w"))
    return said.filter(F.length("w") <= LONGEST).groupBy("w").agg(F.count(F.lit(1)).alias("c"))


def segments(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names, by Viterbi over the counts (w, c)."""
    fixed = counts.sparkSession.createDataFrame([(w,) for w in sorted({*WORDS}) if len(w) > 1], "w string")
    total = float(counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    weight = max(20.0, total * FIXED_SHARE / 1e6)
    total += weight * len({*WORDS})
    every = counts.select("w", F.col("c").cast("double").alias("c")).union(fixed.select("w", F.lit(weight))).groupBy("w").agg(F.sum("c").alias("c"))

    # Names are numbered, and long ones looked up by overlapping stretches, so that a row is a number and a word.
    numbered = written(names.select("name", F.monotonically_increasing_id().alias("id")), "numbered")
    stretch = F.substring("name", F.col("k") * STRETCH + 1, F.lit(STRETCH + LONGEST - 1))
    stretches = numbered.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.length("name") - 1) / STRETCH).cast("int")))).select("id", stretch.alias("s"))
    starts = stretches.select("id", "s", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("i"))
    words_at = F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("s") - F.col("i") + 1)), lambda n: F.substring(F.col("s"), F.col("i"), n))
    parts = starts.select("id", F.explode(words_at).alias("w")).distinct()
    own = parts.join(every, "w").groupBy("id").agg(F.collect_list(F.struct("w", "c")).alias("known"))

    @F.pandas_udf("array<string>")
    def cut(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([segmented(x, {} if k is None else {e["w"]: math.log(e["c"] / total) for e in k}, total) for x, k in zip(name, known, strict=True)])

    return numbered.join(own, "id", "left").select("name", cut("name", "known").alias("words"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, *, labelled: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, words and score of every row.

    ``labelled``: url and label (block or allow) to train on; by default those of LABELLED. They come to the driver, so
    there should be thousands at most. A null URL, or one without "://", has empty host and path, fits no rule and
    has the prior for a score (allowed). Null html has no words to count. Long names are segmented whole. Repeated
    rows are judged alike; an empty table gives an empty one; columns other than the three are not read, whatever their names.
    """
    own = RULES if rules is None else rules
    known = labelled_urls(pages) if labelled is None else labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("string").alias("label"))
    plain = pages.select(F.col(key).alias("page_id"), host_of(F.col(url).cast("string")).alias("host"), path_of(F.col(url).cast("string")).alias("path"))
    taught = known.filter("url is not null and label in ('block', 'allow')").select("label", names_in(host_of(F.col("url")), path_of(F.col("url"))).alias("names"))
    pairs = plain.select("host", "path").distinct().select("host", "path", names_in(F.col("host"), F.col("path")).alias("names"))
    placed = written(pairs.select("host", "path", F.posexplode("names").alias("at", "name")), "names")
    names = placed.groupBy("name").agg(F.count(F.lit(1)).alias("rows")).unionByName(taught.select(F.explode("names").alias("name"), F.lit(0).cast("long").alias("rows"))).groupBy("name").agg(F.sum("rows").alias("rows"))
    names = written(names, "distinct")
    counts = written(word_counts(pages, html), "counts")
    cut = written(segments(names.select("name"), counts), "segments")
    released(counts)
    # The labelled URLs, a few words each, come to the driver.
    lessons = taught.select("label", F.monotonically_increasing_id().alias("id"), F.explode("names").alias("name")).join(cut, "name").groupBy("id", "label").agg(F.flatten(F.collect_list("words")).alias("words")).collect()
    bayes = NaiveBayes([r["words"] for r in lessons if r["label"] == "block"], [r["words"] for r in lessons if r["label"] == "allow"])

    @F.pandas_udf("double")
    def score(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in words:
            yield batch.map(lambda x: bayes.score([] if x is None else list(x))).astype("float64")

    # Names of many URLs are dealt to several tasks.
    parts = F.ceil(F.col("rows") / HOT_ROWS).cast("int")
    hot = written(names.filter(F.col("rows") > HOT_ROWS).select("name", parts.alias("parts")), "hot")
    share = F.pmod(F.xxhash64("host", "path"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = placed.join(if_small(hot), "name", "left").select("host", "path", "at", "name", share.alias("part"))
    spread = cut.join(if_small(hot), "name", "left").select("name", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "words")
    said = dealt.join(spread, ["name", "part"]).groupBy("host", "path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])).alias("words"))
    said = written(said, "words")
    released(placed, names, cut, hot)
    found = plain.join(said, ["host", "path"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))).withColumn("score", score("words"))
    host, path = F.col("host"), F.col("path")
    by_method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule_of(host, path, own, 1).alias("rule"), F.coalesce(rule_of(host, path, own, 0), by_method).alias("verdict"), "words", "score")

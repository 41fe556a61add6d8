"""Phrases against counting them all."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from millrace.llm import phrases

ROWS = "doc_id long, text string, lang string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, p), a in cand.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in cand.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed, n, words=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Äx", "你", "\U0001f600"]
    parts = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ", " ; "]
    return [("".join(rng.choice(vocabulary).upper() * 1 + rng.choice(parts[:3] if rng.random() < 0.8 else parts) if rng.random() < 0.3 else rng.choice(vocabulary) + " " for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize("least", [1, 2, 7])
def test_against_counting(spark, monkeypatch, least):
    monkeypatch.setattr(phrases.frequency, "LEAST_BYTES", 500)
    rows = made(least, 60) + [(None, "en"), ("", None), ("one", "en"), (" . ", "en"), ("a b c d " * 40, "en")]
    df = spark.createDataFrame([(i, *r, 3) for i, r in enumerate(rows)], ROWS + ", N long").repartition(6)
    assert rows_of(phrases.collocations(df, least=least)) == plain(rows, least)
    assert rows_of(phrases.collocations(df, least=least, top=5)) == plain(rows, least, 5)


def test_repeated_rows_and_long_texts(spark):
    rows = [("the same row again, the same row", "en")] * 40 + [("x y " * 50000, "fr")]
    df = spark.createDataFrame([(None, *r) for r in rows], ROWS)
    assert rows_of(phrases.collocations(df)) == plain(rows, 30)
    assert phrases.collocations(df.limit(0)).collect() == []


def test_lists_are_frequencies():
    """A list's length is the phrase's frequency; no phrase crosses a piece."""
    lists = phrases.Lists(phrases.Tokens([b"a b a b. a b", b"b a"], ["en", "en"]))
    assert sorted(lists.counted()[1].tolist()) == [4, 4]
    lists.extend()
    assert sorted(lists.counted()[1].tolist()) == [2, 3]
    lists.extend()
    assert sorted(lists.counted()[1].tolist()) == [1, 1]


def test_empty_batch():
    own = pa.table({"batch": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    beside = pa.table({"level": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "codes": pa.array([], pa.binary())})
    assert [phrases.sent(own, beside, k, 30, 1).num_rows for k in (1, 2, 3, 4)] == [0, 0, 0, 0]


def test_large_numbers(spark):
    """Scores are exact beyond 64 bits."""
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", "x", big), ("en", "y", big - 7), ("en", "x y", big - 9)], "lang string, phrase string, c long")
    candidates = spark.createDataFrame([("en", 2, "x y", big - 9)], "lang string, words int, phrase string, a long")
    assert phrases.cuts(candidates, counts).first()["score"] == 2000000 * (big - 9) // (2 * big - 7)

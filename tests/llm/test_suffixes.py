"""The removal of long repeats against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import suffixes
from millrace.llm.common import table

SCHEMA = "doc_id long, text string"


def brute(rows, window=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - window + 1):
                w = t[k : k + window]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for k in range(len(t) - window + 1):
                if least[t[k : k + window]] < i:
                    gone[k : k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in suffixes.long_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text")
    assert found(docs) == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_repeats(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(7, "ab" * 200), (61, "ab" * 150), (None, rows[3][1]), (62, None), (63, ""), (2, rows[2][1]), (64, "x" * 49), (65, "x" * 50), (66, "x" * 51)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_anchor_of_many_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "INDEX_BYTES", 300)
    core = "the very same sentence stands in all of these documents, word by word, to its end"
    rows = [(i, f"{i * 7919:09d} {core} {i * 104729:09d}") for i in range(40)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_texts_keep_other_columns(spark):
    same = "0123456789" * 8
    df = spark.createDataFrame([(1, same, "a", 5), (2, "head " + same, "b", 6), (3, None, "c", 7)], "doc_id long, text string, t1 string, least int")
    got = {r["doc_id"]: r for r in suffixes.without_repeats(df).collect()}
    assert got[1]["text"] == same and got[2]["text"] == "head " and got[3]["text"] is None
    assert got[2]["t1"] == "b" and got[2]["least"] == 6


def test_empty(spark):
    assert suffixes.long_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shared_strings_shorter_than_a_window(spark):
    """Anchors meet, and no window does."""
    core = "this string of thirty-six bytes is.."
    rows = [(i, f"{i}{'abc'[i] * 30}{core}{'xyz'[i] * 30}") for i in range(3)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_many_batches(spark, monkeypatch):
    from millrace.llm import frequency

    monkeypatch.setattr(frequency, "BATCH_BYTES", 2000)
    monkeypatch.setattr(frequency, "BUCKET_HASHES", 100)
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdef ") for _ in range(90)) for _ in range(5)]
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(40)) + rng.choice(passages)[: rng.randint(40, 90)] + "".join(rng.choice("abcdef ") for _ in range(70))) for i in range(120)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_clashing_names_and_a_null_key(spark):
    same = "0123456789" * 8
    df = spark.createDataFrame([(1, same, 1, 1, "r"), (2, same, 2, 2, "s"), (None, same, 3, 3, "t")], "doc_id long, text string, __t1 long, __known long, __RUNS string")
    got = {r["doc_id"]: r for r in suffixes.without_repeats(df).collect()}
    assert got[1]["text"] == same and got[2]["text"] == "" and got[None]["text"] == same and got[2]["__RUNS"] == "s" and got[2]["__known"] == 2


def test_windows_of_a_hot_passage_go_once_a_batch(spark, monkeypatch):
    """A third of all documents quote a passage, each with other text around it."""
    from collections import Counter

    from millrace.llm import frequency

    monkeypatch.setattr(frequency, "LEAST_BYTES", 20_000)
    monkeypatch.setattr(frequency, "FEW", 4)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    core = noise(120)
    rows = [(i, noise(60) + (core if i % 3 == 0 else noise(40)) + noise(60)) for i in range(600)]
    sent, real = [], suffixes.written

    def watched(df, name):
        out = real(df, name)
        if name == "segments":
            sent.extend(bytes(r["seg"]) for r in out.filter("seg is not null").collect())
        return out

    monkeypatch.setattr(suffixes, "written", watched)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    batches = frequency.batches_of(sum(len(t) for _, t in rows))
    times = Counter(s[i : i + 50] for s in sent for i in range(len(s) - 49))
    assert batches > 3 and 1 < max(times.values()) <= suffixes.EDGES * batches < 200


def test_windows_of_a_hot_anchor_make_no_rows(spark, monkeypatch):
    """Many documents quote a passage, each with other text around it: no row is made for each of its windows."""
    from millrace.llm import frequency

    monkeypatch.setattr(frequency, "LEAST_BYTES", 20_000)
    monkeypatch.setattr(frequency, "FEW", 4)
    monkeypatch.setattr(frequency, "BUCKET_HASHES", 5_000)
    monkeypatch.setattr(suffixes, "INDEX_BYTES", 4_000)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    core = noise(90)
    rows = [(i // 2, noise(60) + core + (core[:55] if i % 50 == 0 else "") + noise(60)) for i in range(500)]
    plans, large, real = [], [], suffixes.written

    def watched(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = real(df, name)
        if name == "large":
            large.extend(out.collect())
        return out

    monkeypatch.setattr(suffixes, "written", watched)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert large and not any("length(seg" in line for p in plans for line in p.splitlines() if "Generate" in line)


def test_windows_of_segments():
    x, y, row, place = suffixes.windows_of([b"abcdef", b"bcde", b"abcde"], 4)
    assert list(zip(row.tolist(), place.tolist())) == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1)]
    for h in (x, y):
        assert h[0] == h[4] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 3
    order, first, number = suffixes.least_of(x, y, np.array([5, 5, 5, 4, 3, 3]))
    assert order[first][number].tolist() == [4, 5, 2, 5, 4, 5]

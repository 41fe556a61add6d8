"""Fingerprints against a plain reckoning, and near-copies against brute force."""

import hashlib

import numpy as np
from test_operators import brute_join, shingles

from millrace.llm import minhash
from millrace.llm.common import encoded, table

ROWS = "doc_id long, text string"


def plain_fingerprint(text):
    """Each permutation over each shingle's hash, all at once."""
    h, n = minhash.shingle_sets([encoded(text)])
    if not n[0]:
        return b"\xff" * 2 * minhash.SLOTS
    least = [(h * a + b).min() for a, b in zip(minhash._TIMES, minhash._PLUS)]
    return (minhash.mixed(np.array(least, np.uint64)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def test_permutations_are_exact():
    """Modulo 2^64, in Python's whole numbers, across blocks and sets."""
    h = np.random.default_rng(3).integers(0, 2**63, 40000, dtype=np.uint64)
    n = np.array([0, 5, 0, 20000, 1, 19994, 0])
    got = minhash.least_values(h, n)
    ends = np.cumsum(n)
    for i in (0, 77, 127):
        want = [min([(int(minhash._TIMES[i]) * int(x) + int(minhash._PLUS[i])) % 2**64 for x in h[e - k : e]], default=2**64 - 1) for e, k in zip(ends, n)]
        assert got[:, i].tolist() == want


def alike(a, b, x, y):
    if bool(shingles(x)) != bool(shingles(y)):
        return 0.0
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def plain(rows):
    """(doc_id, n_chars, sha, fingerprints, likenesses) of rows of distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        e = minhash.edited(t, after)
        f, g, h = plain_fingerprint(t), plain_fingerprint(e), plain_fingerprint(after)
        out.append((i, len(t), hashlib.sha256(encoded(e)).hexdigest(), f.hex(), g.hex(), alike(f, g, t, e), alike(f, h, t, after)))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect())


def test_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text")
    got = minhash.fingerprinted(docs).cache()
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(got) == plain(rows)
    components = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect())
    assert components == brute_join(rows)


def test_edited_text():
    assert minhash.edited("", "abc") == "" and minhash.edited("a", "bc") == "a" and minhash.edited("abcde", "xyz") == "abcxy"
    assert minhash.edited("abcdef", "x") == "abcx" and minhash.edited("a\U0001f600bé", "€") == "a\U0001f600€"


def test_likeness_follows_jaccard():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(4000)]
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        cut = int(900 * share)
        a, b = " ".join(words[:900]), " ".join([*words[:cut], *rng.permutation(words[1000:1900])[: 900 - cut]])
        x, n = minhash.fingerprints([a.encode(), b.encode()])
        true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert abs(float(minhash.likeness(x[:1], n[:1], x[1:], n[1:])[0]) - true) < 0.15


def test_odd_documents(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(9, None), (8, ""), (7, " \t"), (6, "one two"), (5, "ONE two"), (4, text), (3, text.upper()), (2, text + " more"), (1, "x" * 300000), (0, "a b " * 30000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], ROWS + ", n long, Part string")
    found = minhash.fingerprinted(df).cache()
    assert rows_of(found) == plain(rows)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}
    one = spark.createDataFrame([(4, "abcdef")], ROWS)
    assert rows_of(minhash.fingerprinted(one)) == plain([(4, "abcdef")])
    assert minhash.fingerprinted(df.limit(0)).collect() == []
    again = spark.createDataFrame([(3, text), (3, text), (3, "other"), (None, text), (None, None)], ROWS)
    assert minhash.fingerprinted(again).count() == 5


def test_many_near_copies(spark):
    """A third of all rows in one group of copies and near copies."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        own = list(base) if i % 3 == 0 else [f"v{x}" for x in rng.integers(0, 10**6, 60)]
        if i % 6 == 0:
            own[int(rng.integers(0, 80))] = f"u{i}"
        rows.append((i, " ".join(own)))
    got = minhash.fingerprinted(spark.createDataFrame(rows, ROWS))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_join(rows)

"""Shingle sets against a plain reckoning, and shingle counts against counting them all."""

import random

import numpy as np
import pyarrow as pa

from millrace.llm import frequency, shingles


def plain(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_sets(monkeypatch):
    monkeypatch.setattr(shingles, "PIECE", 300)
    rng = random.Random(4)
    texts = [b"", b" \t\n", b"one", b"one TWO", b"two one", b"\xc3\x89 a b c D e", b"a" * 900, b" lead and trail \x0b"]
    texts += [b" ".join(rng.choice([b"aa", b"B", b"c", b"dd-d", b"\xe4\xbd\xa0"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    h, n = shingles.shingle_sets(texts)
    ends = np.cumsum(n)
    sets = [h[e - k : e] for e, k in zip(ends, n)]
    assert [len(plain(t)) for t in texts] == n.tolist()
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)
    for i, a in enumerate(texts):
        for j in range(i):
            assert len(plain(a) & plain(texts[j])) == len(np.intersect1d(sets[i], sets[j]))


def test_parity_maps():
    h, n = shingles.shingle_sets([b"a b c d e f g", b"", b"a b c d e f h"])
    maps = np.unpackbits(shingles.parity_maps(h, n), axis=1).sum(axis=1)
    assert maps.tolist() == [3, 0, 3]


def test_codes_of_many_lists():
    rng = np.random.default_rng(2)
    batches = [rng.integers(0, 2**63, 400, dtype=np.uint64) >> np.uint64(54) << np.uint64(54) for _ in range(6)]
    lists, own = [], []
    for b, x in enumerate(batches):
        u, counts, place = frequency.distinct(x)
        assert (u[place] == x).all()
        own.append(u)
        # The low bits are what lists carry.
        lists.append(pa.table(frequency.packed(b, u | (u >> np.uint64(40)), counts, 7)))
    every = pa.concat_tables(lists)
    told = [frequency.coded(every.filter(pa.compute.equal(every["bucket"], b))) for b in range(7) if pa.compute.any(pa.compute.equal(every["bucket"], b)).as_py()]
    rows = pa.concat_tables(told).to_pylist()
    values, totals = np.unique(np.concatenate(batches), return_counts=True)
    for b, u in enumerate(own):
        got = frequency.unpacked(u | (u >> np.uint64(40)), 7, [(r["bucket"], r["codes"]) for r in rows if r["batch"] == b])
        want = np.array([totals[np.searchsorted(values, x)] for x in u])
        assert ((got == 0) == (want == 1)).all() and (got[want > 1] == (8 * np.log2(want[want > 1])).astype(int)).all()

"""Sampled segmentations against the distribution over all of them."""

import math

import numpy as np

from millrace.llm import pieces


def model():
    plain = {"▁": -2.0, "a": -1.5, "b": -2.5, "c": -2.0, "ab": -2.2, "bc": -1.9, "abc": -3.5, "▁a": -2.7, "▁ab": -3.1}
    texts = [*plain, *[""] * 256]
    weights = np.array([*plain.values(), *[-6.0] * 256])
    return pieces.Pieces(texts, weights, np.arange(len(plain), len(plain) + 256, dtype=np.int32)), plain


def segmentations(text, plain):
    if not text:
        yield (), 0.0
    for n in range(1, len(text) + 1):
        if text[:n] in plain:
            for rest, w in segmentations(text[n:], plain):
                yield (text[:n], *rest), plain[text[:n]] + w


def test_sampled_as_often_as_enumerated():
    own, plain = model()
    lattice = pieces.Lattice(own)
    text, n = "abcab", 20_000
    every = dict(segmentations("▁" + text, plain))
    mass = sum(map(math.exp, every.values()))
    got: dict = {}
    for ids in pieces.encode(lattice, [text] * n, pieces.mixed(np.arange(n, dtype=np.uint64)), 5):
        cut = tuple(own.texts[i] for i in ids)
        got[cut] = got.get(cut, 0) + 1
    assert set(got) <= set(every)
    for cut, w in every.items():
        p = math.exp(w) / mass
        assert abs(got.get(cut, 0) - n * p) <= 5 * math.sqrt(n * p) + 2


def test_characters_without_a_piece_become_bytes():
    own, _ = model()
    lattice = pieces.Lattice(own)
    for text in ("aéb", "▁a b", "\U0001f600", "   ", "x" * 50):
        (ids,) = pieces.encode(lattice, [text], np.array([7], np.uint64), 1)
        assert pieces.decode(lattice, ids) == text

"""Sets of word shingles as sorted 63-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import chunks

WORDS = 5
#: Bits of the parity map of a set: bit i says whether an odd number of hashes falls on i.
BITS = 1024
#: Bytes that words are hashed over at a time.
PIECE = 1 << 17

_rng = np.random.default_rng(8)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0xD1342543DE82EF95
_PLACES = _rng.integers(0, 2**64, WORDS + 1, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n - 1 modulo 2^64, and their inverses."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 4096)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(b))])) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixing hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, parting: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and begins of the words of bytes that end with a space; A-Z count as a-z. parting: of each byte, whether it parts words."""
    space = parting[raw]
    hashes, begins = [], []
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + PIECE)
        hi += int(np.argmax(space[hi - 1 :]))  # pieces end with a space
        own = space[lo:hi]
        edge = np.flatnonzero(own[1:] != own[:-1]) + 1
        if not own[0]:
            edge = np.concatenate([[0], edge])
        begin, end = edge[::2], edge[1::2]
        if len(begin):
            power, inverse = powers(hi - lo)
            total = np.cumsum(_BYTES[raw[lo:hi]] * power[: hi - lo])
            before = np.where(begin > 0, total[begin - 1], np.uint64(0))
            hashes.append(mixed((total[end - 1] - before) * inverse[begin]))
            begins.append(begin + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins)


def _sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    w, begins = word_hashes(raw)
    lens = np.array([len(t) + 1 for t in texts])
    n = np.diff(np.searchsorted(begins, np.concatenate([[0], np.cumsum(lens)])))
    first = np.cumsum(n) - n
    sizes = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    own = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(own)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    h = np.zeros(len(w), np.uint64)
    for i in range(words):  # over the ends of texts as well; those places are not taken
        h[: max(0, len(w) - i)] += w[i:] * _PLACES[i]
    h = h[at]
    for k in np.flatnonzero((n > 0) & (n < words)):
        part = np.append(w[first[k] : first[k] + n[k]], np.uint64(n[k])) * _PLACES[[*range(n[k]), words]]
        h[np.searchsorted(own, k)] = part.sum(dtype=np.uint64)
    h = mixed(h) >> np.uint64(1)
    ends = np.cumsum(sizes).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        h[a:b].sort()
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])[: len(h)]
    return h[new], np.bincount(own[new], minlength=len(texts))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``words``-word shingles of each text, end to end, and how many each has.

    A-Z count as a-z; a text of fewer words is one shingle, one without words has none.
    """
    parts = [_sets(texts[lo:hi], words) for lo, hi in chunks(texts, PIECE)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def parity_maps(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parity map of each set, a row of bytes each."""
    out = np.empty((len(sizes), BITS // 8), np.uint8)
    ends = np.cumsum(sizes)
    for lo in range(0, len(sizes), 256):
        some = sizes[lo : lo + 256]
        own = h[ends[lo] - sizes[lo] : ends[lo + len(some) - 1]]
        cell = np.repeat(np.arange(len(some)), some) * BITS + (own & np.uint64(BITS - 1)).astype(np.int64)
        out[lo : lo + len(some)] = np.packbits((np.bincount(cell, minlength=len(some) * BITS) & 1).astype(np.uint8).reshape(len(some), BITS), axis=1)
    return out


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least size of the intersection of sets of n and m for a similarity of ``percent`` in a hundred."""
    return -(-percent * (n + m) // (100 + percent))

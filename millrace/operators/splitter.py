"""Recursive splitting of texts into chunks that are merged up to a size and overlap.

A text is parted at the first separator of a list that it has; parts that are too long are parted at the next one, the last
of which is every character. Neighbouring parts are packed into a chunk as long as they fit, and a chunk begins
with the last parts of the one before it, as many as the overlap takes. Separators stay at the front of the part that
follows. Parts and chunks are stretches of the text, so nothing is copied until a chunk is done, and time is linear in the text.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

SEPARATORS = ("\n\n", "\n", " ", "")


def parted(text: str, lo: int, hi: int, separator: str) -> list[tuple[int, int]]:
    """Stretches of text[lo:hi] that begin with the separator, but for what comes before the first one; without a separator, each character."""
    if separator == "":
        return [(i, i + 1) for i in range(lo, hi)]
    at = [lo]
    i = text.find(separator, lo, hi)
    while i >= 0:
        if i > at[-1]:
            at.append(i)
        i = text.find(separator, i + len(separator), hi)
    return list(zip(at, [*at[1:], hi], strict=True))


def packed(parts: list[tuple[int, int]], sizes: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Stretches of consecutive parts, filled up to ``size``, that take over up to ``overlap`` from the one before."""
    own: deque[tuple[int, int, int]] = deque()
    total = 0
    for (lo, hi), n in zip(parts, sizes, strict=True):
        if total + n > size and own:
            yield own[0][0], own[-1][1]
            while own and (total > overlap or (total + n > size and total > 0)):
                total -= own.popleft()[2]
        own.append((lo, hi, n))
        total += n
    if own:
        yield own[0][0], own[-1][1]


def stretches(text: str, size: int, overlap: int, separators: Sequence[str], measure: Callable[[str], int], lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int]]:
    """Begin and end of each chunk of text[lo:hi], with its white space."""
    hi = len(text) if hi is None else hi
    here = next((i for i, s in enumerate(separators) if s == "" or text.find(s, lo, hi) >= 0), len(separators) - 1)
    separator, rest = separators[here], separators[here + 1 :]
    parts: list[tuple[int, int]] = []
    sizes: list[int] = []
    for a, b in parted(text, lo, hi, separator):
        n = measure(text[a:b])
        if n < size:
            parts.append((a, b))
            sizes.append(n)
            continue
        yield from packed(parts, sizes, size, overlap)
        parts, sizes = [], []
        if rest and separator != "":
            yield from stretches(text, size, overlap, rest, measure, a, b)
        else:
            yield a, b
    yield from packed(parts, sizes, size, overlap)


def pieces(text: str, size: int, overlap: int = 0, separators: Sequence[str] = SEPARATORS, by_words: bool = False) -> list[str]:
    """The chunks of a text, without white space around them; those of white space alone are left out."""
    measure = (lambda t: len(t.split())) if by_words else len
    return [c for c in (text[a:b].strip() for a, b in stretches(text, size, overlap, separators, measure)) if c]


def chunked(df: DataFrame, text: str, chunks: Callable[[str], list[str]]) -> DataFrame:
    """``df`` with chunk_index, total_chunks and chunk, a row for each chunk of each text.

    Only texts go to Python and only chunks come back; a text is not copied to each of its chunks unless the caller keeps the column.
    """
    names = [c for c in df.columns if c not in ("chunk_index", "total_chunks", "chunk")]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array((chunks(t.as_py()) for t in texts), pa.list_(pa.string()))

    own = df.filter(F.col(text).isNotNull()).select(*names, F.arrow_udf(run, "array<string>")(text).alias("__chunks")).withColumn("total_chunks", F.size("__chunks"))
    each = own.select(*names, "total_chunks", F.posexplode("__chunks").alias("chunk_index", "chunk"))
    return each.select(*names, "chunk_index", "total_chunks", "chunk")


def split(df: DataFrame, text: str, size: int, overlap: int = 0, *, separators: Sequence[str] = SEPARATORS, by_words: bool = False, limits: tuple[float, float] | None = None, weight: float = 1.0) -> DataFrame:
    """``df`` with chunk_index, total_chunks and chunk, a row per chunk.

    Sizes are in characters or, ``by_words``, in words. A chunk is no longer than ``size``, unless a part without any
    separator left is. limits: only texts whose number of words times ``weight`` lies within. Null and blank texts, and
    empty ones, have no chunk. Columns of the same names give way.
    """
    if overlap >= size:
        raise ValueError("the overlap has to be smaller than the size")
    if limits:
        n = F.size(words(F.col(text))) * F.lit(weight)
        df = df.filter((n >= limits[0]) & (n <= limits[1]))
    return chunked(df, text, lambda t: pieces(t, size, overlap, separators, by_words))


def split_at(df: DataFrame, text: str, size: int, overlap: int = 0, *, separator: str = "\n\n") -> DataFrame:
    """The same at one separator only, which counts where it joins parts: parts that are longer than ``size`` are chunks of their own."""
    gap = len(separator)

    def chunks(t: str) -> list[str]:
        ends = [m.start() for m in re.finditer(re.escape(separator), t)]
        out: list[tuple[int, int]] = []
        own: deque[tuple[int, int]] = deque()
        total = 0
        for a, b in zip([0, *[e + gap for e in ends]], [*ends, len(t)], strict=True):
            if a == b:
                continue
            if own and total + gap + b - a > size:
                out.append((own[0][0], own[-1][1]))
                while own and (total > overlap or (total + gap + b - a > size and total > 0)):
                    lo, hi = own.popleft()
                    total -= hi - lo + (gap if own else 0)
            total += b - a + (gap if own else 0)
            own.append((a, b))
        if own:
            out.append((own[0][0], own[-1][1]))
        return [c for c in (t[a:b].strip() for a, b in out) if c]

    return chunked(df, text, chunks)

"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (3 to 5 code points, lower-cased) that a whole text holds, hashed to a
fixed number of slots and counted once. Each is scaled by the log of the ratio of its smoothed
shares among toxic and clean texts; logistic regression over the scaled features gives the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Slots of the hashed features: the model is so many float32 (2 MB), whatever the input.
SLOTS = 1 << 19
ORDERS = (3, 4, 5)
#: Bound of the labelled sample by class.
SAMPLE = {1: 3000, 0: 5000}
#: Slots that training keeps at most: those that tell the classes apart best (by the likelihood ratio). Others weigh nothing.
KEPT = 15_000
SAMPLE_PARTS = 12


def features(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Sorted slots of the text's n-grams. ``seen``: SLOTS false booleans, given back as such."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < ORDERS[0]:
        return np.zeros(0, np.int64)
    h = codes.copy()
    for n in range(2, ORDERS[-1] + 1):
        if len(codes) < n:
            break
        h = h[:-1] * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h += codes[n - 1 :]
        if n in ORDERS:
            seen[((h * np.uint32(0x9E3779B1)) ^ np.uint32(n)) >> np.uint32(13)] = True
    slots = np.flatnonzero(seen)
    seen[slots] = False
    return slots


@dataclass
class Model:
    weights: np.ndarray  # of each slot, the log-count ratio included
    bias: float

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[slots].sum(dtype=np.float64), -30, 30))))


def held_out(key):
    """Whether a document is held out: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def log_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, alpha: float = 1.0) -> np.ndarray:
    """Naive Bayes log-count ratio of slots, from the (weighted) numbers of texts of each class that hold them."""
    return np.log((toxic + alpha) / (n_toxic + 2 * alpha)) - np.log((clean + alpha) / (n_clean + 2 * alpha))


def fit(slots: list[np.ndarray], ratio: np.ndarray, toxic: np.ndarray, weight: np.ndarray, *, l2: float = 2e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; feature values are the log-count ratios of the slots a
    text holds (``slots`` index ``ratio``). Gives weights with the ratios multiplied in, and the bias."""
    at = np.concatenate(slots).astype(np.int32)
    ends = np.cumsum([len(x) for x in slots])
    blocks = [(i, min(i + 512, len(slots))) for i in range(0, len(slots), 512)]

    def sums(values: np.ndarray) -> np.ndarray:
        """Of each text, the sum over its slots."""
        out = np.zeros(len(slots))
        for lo, hi in blocks:
            begin = int(ends[lo] - len(slots[lo]))
            upto = np.concatenate([[0.0], np.cumsum(values[at[begin : int(ends[hi - 1])]])])
            own = ends[lo:hi] - begin
            out[lo:hi] = upto[own] - upto[np.concatenate([[0], own[:-1]])]
        return out

    def spread(values: np.ndarray) -> np.ndarray:
        """Of each slot, the sum over the texts that hold it."""
        out = np.zeros(len(ratio))
        for lo, hi in blocks:
            begin = int(ends[lo] - len(slots[lo]))
            out += np.bincount(at[begin : int(ends[hi - 1])], weights=np.repeat(values[lo:hi], [len(x) for x in slots[lo:hi]]), minlength=len(ratio))
        return out

    squares = sums(ratio * ratio)
    norm = float(np.sqrt(np.median(squares[squares > 0]))) if (squares > 0).any() else 1.0
    unit = ratio / norm
    y, w = toxic.astype(float), weight / weight.sum()
    step = 1.0 / (0.25 * ((w * squares).sum() / norm**2 + 1) + l2)
    b = look_b = float(np.log((w * y).sum() / (w * (1 - y)).sum()))
    v = look_v = np.zeros(len(ratio))
    for k in range(rounds):
        z = look_b + sums(unit * look_v)
        g = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        new_v = look_v - step * (unit * spread(g) + l2 * look_v)
        new_b = look_b - step * g.sum()
        m = k / (k + 3)
        look_v, look_b, v, b = new_v + m * (new_v - v), new_b + m * (new_b - b), new_v, new_b
    return v * ratio / norm, float(b)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: dict[int, int] | None = None, kept: int = KEPT) -> Model:
    """Fit on labelled rows that are not held out.

    Where a class has more rows than ``sample`` allows, those least in hash order are taken and
    weighted up to the class's size. Documents labelled both ways or with a null label are left out.
    What comes to the driver is bounded by the sample and ``kept``. The same rows give the same model.
    """
    limits = sample or SAMPLE
    known = labels.filter(~held_out(F.col(key)) & F.col(label).isin(0, 1)).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("most")).filter("y = most and doc_id is not null").drop("most")
    sizes = {int(r["y"]): r["count"] for r in known.groupBy("y").count().collect()}
    order = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    cut = F.lit(0)
    for y, n in sizes.items():
        cut = F.when(F.col("y") == y, F.lit(int((1 << 30) * min(1.0, limits[y] / n)))).otherwise(cut)
    chosen = known.filter(order < cut).select("doc_id", F.col("y").cast("int").alias("y"))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Bounded by the sample: of rows that share a labelled id, the one of the least text.
    rows = written(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).repartition(SAMPLE_PARTS, "doc_id"), "labelled")
    taken = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    if len(taken) < 2:  # one class or none: the bias says what there is to say
        return Model(np.zeros(SLOTS, np.float32), 10.0 if 1 in taken else -10.0)
    scale = {y: sizes[y] / taken[y] for y in taken}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(SLOTS, bool), np.zeros((2, SLOTS), np.int32)
        for batch in batches:
            for y, t in zip(batch["y"], batch["text"], strict=True):
                n[y, features(t, seen)] += 1
        used = np.flatnonzero(n.any(axis=0))
        yield pd.DataFrame({"slot": used, "clean": n[0, used], "toxic": n[1, used]})

    counts = rows.mapInPandas(count, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    a, b = F.col("t") / taken[1], F.col("c") / taken[0]  # shares of the classes' texts that hold the slot
    both = (F.col("t") + F.col("c")) / (taken[0] + taken[1])
    part = lambda n, p: F.when(n > 0, n * F.ln(p / both)).otherwise(0.0)
    rest = lambda n, m, p: F.when((m - n > 0) & (both < 1), (m - n) * F.ln((1 - p) / (1 - both))).otherwise(0.0)
    gain = part(F.col("t"), a) + part(F.col("c"), b) + rest(F.col("t"), taken[1], a) + rest(F.col("c"), taken[0], b)
    best = sorted((r["slot"], r["c"], r["t"]) for r in counts.orderBy(F.desc(gain), "slot").limit(kept).collect())
    index = np.full(SLOTS, -1, np.int32)
    index[[s for s, _, _ in best]] = np.arange(len(best))
    ratio = log_ratio(np.array([t for _, _, t in best]) * scale[1], np.array([c for _, c, _ in best]) * scale[0], sizes[1], sizes[0])
    sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(index.tobytes(), 1))

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = np.frombuffer(zlib.decompress(sent.value), np.int32), np.zeros(SLOTS, bool)
        for batch in batches:
            found = [own[features(t, seen)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "slots": [x[x >= 0].tobytes() for x in found]})

    got = sorted((r["doc_id"], r["y"], bytes(r["slots"])) for r in rows.mapInPandas(present, "doc_id long, y int, slots binary").collect())
    y = np.array([g[1] for g in got])
    own, bias = fit([np.frombuffer(g[2], np.int32) for g in got], ratio, y, np.array([scale[int(k)] for k in y]))
    weights = np.zeros(SLOTS, np.float32)
    weights[[s for s, _, _ in best]] = own
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null text scores as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast((zlib.compress(model.weights.tobytes(), 1), model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, bias = sent.value
        own = Model(np.frombuffer(zlib.decompress(packed), np.float32), bias)
        seen = np.zeros(SLOTS, bool)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [own.score(features(t, seen)) for t in batch["text"]]})

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = plain.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3, sample: dict[int, int] | None = None) -> DataFrame:
    """Train and score: a row per row of ``docs``, whole texts, repeated rows alike.

    A null id is held out from nothing and scored; without usable labels all score near 0. An empty table gives an
    empty one. Other columns are not read, whatever their names.
    """
    return score(docs, train(docs, labels, key=key, text=text, sample=sample), key=key, text=text, threshold=threshold)


def clean(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that are not predicted toxic, with their columns, whatever those are named."""
    model = train(docs, labels, text=text)
    sent = docs.sparkSession.sparkContext.broadcast((zlib.compress(model.weights.tobytes(), 1), model.bias))

    @F.pandas_udf("boolean")
    def is_clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packed, bias = sent.value
        own = Model(np.frombuffer(zlib.decompress(packed), np.float32), bias)
        seen = np.zeros(SLOTS, bool)
        for batch in texts:
            yield pd.Series([own.score(features(t, seen)) < threshold for t in batch], dtype=bool)

    return docs.filter(is_clean(F.col(text).cast("string")))

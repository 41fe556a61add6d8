"""Quality rules whose cutoffs are set by risk control.

Base rules drop texts that are too short or repeat themselves. Beyond them, cutoffs on four
ratios are chosen per stratum (language). They are tightened together along one fixed path: a
labelled holdout counts how many good documents each step would reject, the exact
(Clopper-Pearson) binomial bound turns the count into an upper bound on the false-rejection
rate, and the last step before the first whose bound exceeds the limit is taken. Steps tested in
a fixed sequence need no correction; Bonferroni's over strata makes all bounds hold at once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, written

SYMBOLS = "#*$%&|<>"
#: Fixed grid of cutoffs by ratio, from the strictest to the mildest; a document is rejected above its cutoff.
GRID = {
    "symbol_ratio": [round(0.02 * 1.25**i, 4) for i in range(24)],
    "dup_line_ratio": [round(0.02 * i, 4) for i in range(1, 41)],
    "repeat_ratio": [round(0.02 * i, 4) for i in range(1, 26)],
    "long_words": [round(5.0 + 0.5 * i, 4) for i in range(30)],
}
#: Joint cutoffs, each step at least as strict as the one before in every ratio.
STEPS = 40
PATH = [{m: grid[round((len(grid) - 1) * (STEPS - i) / STEPS)] for m, grid in GRID.items()} for i in range(STEPS + 1)]
STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of one text; null: zeros."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if len(words) >= 4:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        if len(known) < len(words):
            pair = ids[:-1] * len(known) + ids[1:]
            _, pair = np.unique(pair, return_inverse=True)
            _, at, n = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
            starts = np.flatnonzero(n[at] > 1)
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[starts + k] = True
            repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def stats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The base statistics of every whole text, a row per input row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([text_stats(x) for x in batch["text"]], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"], dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"])
            out.insert(1, "lang", batch["lang"])
            yield out

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(stratum).cast("string").alias("lang"))
    return plain.mapInPandas(run, STATS)


def with_ratios(df: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    return df.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
    })


def upper_bound(rejected: int, of: int, risk: float) -> float:
    """The exact binomial upper bound: the largest rate at which ``rejected`` or fewer of ``of`` still have probability ``risk``."""
    if of <= 0 or rejected >= of:
        return 1.0
    i = np.arange(rejected + 1)
    choose = np.array([math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) for k in i])

    def log_cdf(p: float) -> float:
        terms = choose + i * math.log(p) + (of - i) * math.log1p(-p)
        top = terms.max()
        return top + math.log(np.exp(terms - top).sum())

    low, high = rejected / of, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 0 < mid < 1 and log_cdf(mid) > math.log(risk):
            low = mid
        else:
            high = mid
    return high


def cutoffs(scored: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", limit: float = 0.02, risk: float = 0.05) -> DataFrame:
    """Per stratum (null: its own) the chosen cutoff of each ratio, null where not even the mildest step is safe enough.

    ``limit`` bounds the false-rejection rate of a stratum by all ratios together; ``risk`` is
    the probability that any stratum's bound fails. Good documents that base rules reject take no part.
    A document counts once, whatever its rows and labels: one labelled both ways as good, one of several texts by the strictest.
    """
    good = labels.filter(F.col(label) == 1).select(F.col(key).cast("long").alias("doc_id")).distinct()
    held = scored.filter("not base_failed").join(good, "doc_id", "left_semi")
    steps = [functools.reduce(Column.__or__, [F.col(m) > F.lit(c) for m, c in step.items()]) for step in PATH]
    # The bounds are of independent draws: a document counts once in a stratum, however many rows it has, by the strictest of them.
    once = held.groupBy("lang", "doc_id").agg(*[F.max(over.cast("long")).alias(f"over{i}") for i, over in enumerate(steps)])
    counts = F.array(*[F.sum(f"over{i}") for i in range(len(steps))]).alias("rejected")
    # The count of strata is needed for the correction; a row per stratum.
    table = written(once.groupBy("lang").agg(F.count(F.lit(1)).alias("n_good"), counts), "holdout")
    each = risk / max(1, table.count())

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                picked = dict.fromkeys(GRID)
                for step, n in zip(PATH, row.rejected, strict=True):
                    if upper_bound(int(n), int(row.n_good), each) > limit:
                        break
                    picked = step
                rows.append({"stratum": row.lang, **{f"max_{m}": picked[m] for m in GRID}})
            yield pd.DataFrame(rows, columns=["stratum", *[f"max_{m}" for m in GRID]]).astype({f"max_{m}": "float64" for m in GRID})

    return table.mapInPandas(choose, "stratum string, " + ", ".join(f"max_{m} double" for m in GRID))


def quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", limit: float = 0.02, risk: float = 0.05) -> DataFrame:
    """Statistics and verdict of every document.

    A null or empty text has no words and fails the base rules. Strata without labels, or with
    too few for a safe cutoff, are judged by the base rules alone. Repeated rows are judged alike;
    an empty table gives an empty one; other columns of ``docs`` are not read.
    """
    scored = with_ratios(written(stats(docs, key=key, text=text, stratum=stratum), "stats"))
    chosen = cutoffs(scored, labels, label=label, limit=limit, risk=risk)
    judged = scored.join(chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    over = F.lit(False)
    for m in GRID:
        over = over | F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~(F.col("base_failed") | over)).alias("kept"), *[f"max_{m}" for m in GRID])

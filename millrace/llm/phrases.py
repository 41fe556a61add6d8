"""Phrase collocations by vertical positional inverted lists.

A phrase's list holds the positions at which it occurs, so its length is the phrase's frequency. Lists of longer
phrases come from those of shorter ones: the positions of a frequent phrase are merge-joined with the postings of
frequent words one place behind its end. Positions leave a gap between pieces, so that no phrase crosses one.

Texts are dealt to batches of some MB, and a batch builds the lists of its texts. What is frequent in the whole corpus
is told level by level: each batch sends its distinct phrases of a length as packed hashes, and buckets of hashes
answer (``frequency``); an answer may take a phrase for frequent that isn't, never the other way. Phrases that pass are
then counted by their words, exactly, with a row for each batch and phrase.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import frequency
from .common import encoded, released, tidy, written
from .shingles import mixed, word_hashes

LONGEST = 4
#: Bytes of text in a batch (see ``frequency``): a phrase is sent once from each batch that has it, so these are larger.
BATCH_BYTES = 12 << 20
#: Parts that each language's phrases are ranked in before the best of the parts are ranked together.
SALTS = 64

_PIECES = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"] + [*range(0x0A, 0x0E)])
_PARTING = _PIECES | np.isin(np.arange(256), [0x20, 0x09])
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What a batch sends: packed hashes (``frequency.LISTS``), or phrases with their words, and the words of each language.
SENT = frequency.LISTS + ", lang string, words int, phrase string, c long"


class Tokens:
    """The words of some texts: hashes that tell languages apart, and positions with a gap between pieces."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        joined = b"\n".join(texts) + b"\n" if texts else b""
        raw = self.bytes = np.frombuffer(joined, np.uint8)
        self.lower = joined.lower()
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        if not len(raw):
            self.words, self.begins, self.ends, self.position, self.lang = np.zeros(0, np.uint64), *[np.zeros(0, np.int64) for _ in range(4)]
            return
        words, self.begins = word_hashes(raw, _PARTING)
        parting = _PARTING[raw]
        self.ends = np.flatnonzero(parting[1:] & ~parting[:-1]) + 1
        piece = np.cumsum(_PIECES[raw])[self.begins] if len(words) else self.begins
        self.position = np.arange(len(words)) + LONGEST * piece
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.begins, side="right")
        self.lang = np.array([number[x] for x in langs])[text] if len(words) else self.begins
        of_lang = word_hashes(np.frombuffer(b"".join(x.encode("utf-8", "surrogatepass").hex().encode() + b"- " for x in self.langs), np.uint8))[0]
        self.words = mixed(words + of_lang[self.lang] * _STEP) if len(words) else words

    def phrases(self, at: np.ndarray, k: int) -> list[str]:
        """The k words from each of some words on, in lower case (A-Z), with blanks between."""
        plain = np.full(len(at), True)  # one blank between words already
        for j in range(k - 1):
            end = self.ends[at + j]
            plain &= (self.begins[at + j + 1] == end + 1) & (self.bytes[end] == 0x20)
        lower = self.lower
        out = [lower[b:e] for b, e in zip(self.begins[at].tolist(), self.ends[at + k - 1].tolist(), strict=True)]
        for i in np.flatnonzero(~plain).tolist():
            w = at[i]
            out[i] = b" ".join(lower[b:e] for b, e in zip(self.begins[w : w + k], self.ends[w : w + k], strict=True))
        return [x.decode("utf-8", "surrogatepass") for x in out]


class Lists:
    """Inverted lists of phrases of k words: the words at which they occur, ascending, and what phrase each is of."""

    def __init__(self, tokens: Tokens) -> None:
        self.tokens, self.k, self.at, self.key = tokens, 1, np.arange(len(tokens.words)), tokens.words
        self.postings = self.at

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct phrases (63 bits), the lengths of their lists, and of each occurrence the place of its phrase."""
        return frequency.distinct(self.key >> np.uint64(1))

    def kept(self, which: np.ndarray) -> None:
        """Only the lists of some phrases stay; of words, these are the postings that phrases are extended by."""
        self.at, self.key = self.at[which], self.key[which]
        if self.k == 1:
            self.postings = self.at

    def extend(self) -> None:
        """Lists of phrases of one more word, whose first and last k words both have lists."""
        position = self.tokens.position
        behind, there = position[self.at] + self.k, position[self.postings]
        place = np.minimum(np.searchsorted(there, behind), max(len(there) - 1, 0))
        meets = there[place] == behind if len(there) else np.zeros(len(behind), bool)
        listed = np.zeros(len(position) + 1, bool)
        listed[self.at] = True
        meets &= listed[self.at + 1]
        self.key = mixed(self.key[meets] * _STEP + self.tokens.words[self.postings[place[meets]]])
        self.at, self.k = self.at[meets], self.k + 1


def least_code(least: int) -> int:
    """The code of ``frequency`` that phrases of at least so many occurrences have at least."""
    return int(8 * np.log2(least)) if least > 1 else 0


def sent(own: pa.Table, beside: pa.Table, level: int, least: int, buckets: int) -> pa.Table:
    """A batch's rows of SENT. Up to level 3: packed lists of its distinct phrases of ``level`` words. At the last level: its
    phrases and words that may be frequent. own: batch, lang, text; beside: batch, level, bucket, codes of the levels below."""
    tokens = Tokens([encoded(t) for t in own.column("text").to_pylist()], own.column("lang").to_pylist())
    lists = Lists(tokens)
    batch = own.column("batch")[0].as_py() if len(own) else 0
    told: dict[int, list[tuple[int, bytes]]] = {}
    for k, b, c in zip(*(beside.column(c) for c in ("level", "bucket", "codes")), strict=True):
        told.setdefault(k.as_py(), []).append((b.as_py(), c.as_py()))
    rows: dict[str, list] = {"lang": [], "words": [], "phrase": [], "c": []}

    def emit(u: np.ndarray, counts: np.ndarray, place: np.ndarray) -> None:
        first = np.zeros(len(u), np.int64)
        first[place[::-1]] = lists.at[::-1]
        rows["lang"] += [tokens.langs[i] for i in tokens.lang[first]]
        rows["words"] += [lists.k] * len(u)
        rows["phrase"] += tokens.phrases(first, lists.k)
        rows["c"] += counts.tolist()

    for k in range(1, level + 1):
        if k > 1:
            lists.extend()
        u, counts, place = lists.counted()
        if k == level:
            break
        code = frequency.unpacked(u, buckets, told.get(k, []))
        some = code >= least_code(least)
        lists.kept(some[place])
        if level == LONGEST:
            emit(*lists.counted())
    if level < LONGEST:
        out = frequency.packed(batch, u, counts, buckets)
        n = len(out["batch"])
        return pa.table({**out, "lang": pa.nulls(n, pa.string()), "words": pa.nulls(n, pa.int32()), "phrase": pa.nulls(n, pa.string()), "c": pa.nulls(n, pa.int64())})
    emit(u, counts, place)
    per = np.bincount(tokens.lang, minlength=len(tokens.langs))
    rows = {"lang": rows["lang"] + tokens.langs, "words": rows["words"] + [0] * len(per), "phrase": rows["phrase"] + [None] * len(per), "c": rows["c"] + per.tolist()}
    n = len(rows["c"])
    return pa.table({"batch": pa.array(np.full(n, batch, np.int64)), "bucket": pa.nulls(n, pa.int32()), **{c: pa.nulls(n, pa.binary()) for c in ("tokens", "at", "counts")}, "lang": pa.array(rows["lang"], pa.string()), "words": pa.array(rows["words"], pa.int32()), "phrase": pa.array(rows["phrase"], pa.string()), "c": pa.array(rows["c"], pa.int64())})


def level_work(level: int, least: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda own, beside: sent(own, beside, level, least, buckets)


def counted(docs: DataFrame, least: int) -> DataFrame:
    """lang, words, phrase and c, exactly: of the phrases of 1 to 4 words, all that occur ``least`` times in their language; words 0: its number of words. docs: lang, text."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_batches, buckets = frequency.batches_of(total, BATCH_BYTES), frequency.buckets_of(total // 6)
    # Rows are dealt by their place, which is written down once, so that repeated rows fill no batch and all levels see the same batches.
    dealt = written(docs.withColumn("__place", F.monotonically_increasing_id()).select(F.pmod(F.xxhash64("__place"), F.lit(n_batches)).alias("batch"), "lang", "text"), "texts")
    nothing = docs.sparkSession.createDataFrame([], "level int, " + frequency.CODES)
    told = nothing
    for level in range(1, LONGEST + 1):
        lists = written(frequency.cogrouped(dealt, told, level_work(level, least, buckets), SENT), "lists")
        tidy(docs.sparkSession)
        if level < LONGEST:
            codes = written(frequency.codes(lists), "codes").select(F.lit(level).alias("level"), "batch", "bucket", "codes")
            released(lists)
            told = told.union(codes)
            tidy(docs.sparkSession)
    found = written(lists.groupBy("lang", "words", "phrase").agg(F.sum("c").alias("c")).filter((F.col("words") == 0) | (F.col("c") >= least)), "phrases")
    released(lists, dealt)
    return found


def cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a and the lowest-scoring cut's l, r and score (ties: the shortest first part)."""
    words = F.split("phrase", " ")
    parts = candidates.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = parts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("c").alias(name))
    met = parts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    return best.select("lang", "phrase", "a", "s.l", "s.r", "s.score")


def within_longer(candidates: DataFrame) -> DataFrame:
    """lang, phrase and longest: of each phrase of two words or more inside a longer candidate, the most occurrences of one that holds it."""
    w = F.split("phrase", " ")
    longer = candidates.filter("words > 2").select("lang", "a", w.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    inner = longer.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    return inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase")).agg(F.max("a").alias("longest"))


def collocations(docs: DataFrame, *, least: int = 30, within: int = 80, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: of each language the ``top`` phrases of 2 to 4 words.

    A-Z count as a-z; the bytes .,;:!? and 0x0A to 0x0D part pieces, blanks and tabs words; other white space is part
    of a word. A null lang is the language ``und``, an empty one is one of its own; a null text is empty. Phrases occur ``least`` times
    at least. One goes if a longer candidate holds it and has ``within`` in a hundred of its occurrences. Order: score
    and a descending, then the phrase by its bytes. Repeated rows count each. Texts are taken whole, each by one task;
    other columns are not read, whatever their names. An empty table gives an empty one.
    """
    plain = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    found = counted(plain, least)
    counts = found.filter("words > 0").select("lang", "phrase", "c")
    candidates = found.filter("words > 1").select("lang", "words", "phrase", F.col("c").alias("a"))
    held = within_longer(candidates)
    gone = candidates.join(held, ["lang", "phrase"]).filter(F.expr(f"cast(100 as decimal(3,0)) * cast(longest as decimal(20,0)) >= cast({within} as decimal(3,0)) * cast(a as decimal(20,0))")).select("lang", "phrase")
    left = candidates.join(gone, ["lang", "phrase"], "left_anti")
    scored = cuts(left, counts)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = found.filter("words = 0").select("lang", F.col("c").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

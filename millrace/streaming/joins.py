"""Joins of two streams by time, and answers awaited with timers; both read alike on tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.joins import asof_next

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Timers and lists of state need the RocksDB state store; it is set for the session's streams to come."""
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def seconds(at: str):
    return F.unix_micros(F.col(at).cast("timestamp")) / 1e6


def joined_within(left: DataFrame, right: DataFrame, on: list[str], at: tuple[str, str], before: float, after: float, *, how: str = "inner", delay: tuple[str, str] = ("0 seconds", "0 seconds")) -> DataFrame:
    """Pairs of rows alike in ``on`` where the right one's time is from ``before`` seconds before to ``after`` seconds after the left one's, ends included.

    Each stream has its own delay, behind which rows are late; state goes when the slower of the two watermarks passes. Other
    columns need different names on both sides. how: inner, or leftOuter (rows that found nothing come, with nulls, when nothing can come any
    more). In an inner join, rows are dealt by slots of time as well, so that a hot key takes several tasks: a right row has one
    slot, a left row those that its span touches, two or three. Null keys and times join with nothing.
    """
    lat, rat = at
    marked = lambda df, c, d: df.withWatermark(c, d) if df.isStreaming else df
    l, r = marked(left, lat, delay[0]).alias("l"), marked(right, rat, delay[1]).alias("r")
    span = lambda s: F.expr(f"INTERVAL {s} SECOND")
    fits = (F.col(f"r.{rat}") >= F.col(f"l.{lat}") - span(before)) & (F.col(f"r.{rat}") <= F.col(f"l.{lat}") + span(after))
    if how == "inner":
        width = max(before + after, 1.0)
        slots = F.sequence(F.floor((seconds(lat) - before) / width), F.floor((seconds(lat) + after) / width))
        l, r = l.withColumn("__slot", F.explode(slots)).alias("l"), r.withColumn("__slot", F.floor(seconds(rat) / width)).alias("r")
        fits &= F.col("l.__slot") == F.col("r.__slot")
    for c in on:
        fits &= F.col(f"l.{c}") == F.col(f"r.{c}")
    rest = [c for c in right.columns if c not in on]
    return l.join(r, fits, how).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in rest])


class Awaited(StatefulProcessor):
    """Of each key the questions that are open and the answers that may still serve one.

    A question is decided by a timer, when the watermark has passed its end: all answers in time are there by then,
    in whatever order they came. Then it goes from the state, and so do answers that are older than every open question and than
    the watermark, since no later question can have them.
    """

    def __init__(self, within: int) -> None:
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getListState("asked", "id long, at long")
        self.answers = handle.getListState("answers", "at long")

    def due(self, at: int) -> int:
        """The millisecond in which a question's end has passed."""
        return (at + self.within) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            if r["asks"]:
                self.asked.appendValue((r["id"], r["at"]))
                self.handle.registerTimer(self.due(r["at"]))
            else:
                self.answers.appendValue((r["at"],))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        asked = [tuple(a) for a in self.asked.get()] if self.asked.exists() else []
        answers = sorted(a[0] for a in self.answers.get()) if self.answers.exists() else []
        done, open_ = [a for a in asked if self.due(a[1]) <= now], [a for a in asked if self.due(a[1]) > now]
        first = min([a[1] for a in open_] + [timerValues.getCurrentWatermarkInMs() * 1000])
        for state, kept in ((self.asked, open_), (self.answers, [(a,) for a in answers if a >= first])):
            state.clear()
            if kept:
                state.put(kept)
        for i, at in done:
            yield Row(id=i, asked_at=at, answered_at=next((a for a in answers if at <= a <= at + self.within), None))

    def close(self) -> None:
        pass


def answered(events: DataFrame, key: str, id: str, at: str, asks: str, answers: str, within: float, *, delay: str = "0 seconds") -> DataFrame:
    """id, asked_at and answered_at (microseconds), a row per question: the first answer of its key from its own time to ``within`` seconds later, or null.

    asks, answers: conditions in SQL; a row for which both hold counts as a question. A stream gives a question's row once its time is over and
    ``delay`` has passed (output mode append; ``keep_state_on_disk`` first); rows that come later are left out. Null keys
    and times are left out. On a table this is an as-of join, which deals a hot key over slots of time.
    """
    sql = f"CASE WHEN {asks} THEN true WHEN {answers} THEN false END"
    rows = events.withColumn("asks", F.expr(sql)).filter(F.col("asks").isNotNull() & F.col(key).isNotNull() & F.col(at).isNotNull())
    micros = int(within * 1_000_000)
    if events.isStreaming:
        own = rows.withWatermark(at, delay).select(F.col(key).alias("key"), F.col(id).cast("long").alias("id"), F.unix_micros(at).alias("at"), "asks", F.col(at).alias("__time"))
        return own.groupBy("key").transformWithState(Awaited(micros), "id long, asked_at long, answered_at long", "append", "eventTime")
    own = rows.select(F.col(key).alias("key"), F.col(id).cast("long").alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), "asks")
    later = own.filter("not asks").select("key", "at", F.col("at").alias("answered_at"))
    found = asof_next(own.filter("asks").select("key", "id", "at"), later, "key", "at", ["answered_at"], width=max(micros, 1_000_000) * 16)
    return found.select("id", F.col("at").alias("asked_at"), F.when(F.col("answered_at") <= F.col("at") + micros, F.col("answered_at")).alias("answered_at"))

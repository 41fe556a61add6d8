"""Chat formatting by rotation of perspective.

Every participant of a conversation is the assistant once: that speaker's turns are rendered
as the assistant's, all others' as named users', and the mask covers the assistant's turns
alone. Roles named ``system`` hold no speaker; their turns stay system turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import if_small, ranked, running_within
from .common import written

#: Turns that one row may hold besides a carried system turn: longer dialogues continue in further parts, so that no group is unbounded.
PART_TURNS = 1024


def plainly(said: Column) -> Column:
    """Text that can't be taken for a marker: its "<|" are parted."""
    return F.replace(said, F.lit("<|"), F.lit("< |"))


def parts_of(rows: DataFrame, message: Column, system: str, part_turns: int) -> DataFrame:
    """conv_id, part, ms and speaker of long conversations, dealt by the place of each row."""
    # The last key parts rows that are alike, so that even these are dealt to several tasks.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("__tie")]
    placed = written(ranked(rows.withColumn("__tie", F.monotonically_increasing_id()), order).drop("__tie"), "placed")
    starts = written(placed.groupBy(F.col("conv_id").alias("id")).agg(F.min("position").alias("start")), "starts")
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    dealt = placed.join(if_small(starts), same).select("conv_id", F.floor((F.col("position") - F.col("start")) / F.lit(part_turns)).cast("long").alias("part"), "role", message)
    dealt = written(dealt, "dealt")
    own = dealt.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("m")).alias("own"))
    # The system turn in force where a part begins is the last one before it: a row for each part.
    last = dealt.groupBy("conv_id", "part").agg(F.max(F.when(F.col("role") == system, F.col("m"))).alias("last"))
    told = running_within(last, ["conv_id"], [F.col("part")], told=("max", F.col("last"))).select(F.col("conv_id").alias("id"), (F.col("part") + 1).alias("next"), "told")
    told = written(told.filter("told is not null"), "told")
    whole = own.join(if_small(told), same & (F.col("part") == F.col("next")), "left").select("conv_id", "part", F.when(F.col("told").isNull(), F.col("own")).otherwise(F.concat(F.array("told"), "own")).alias("ms"))
    who = written(dealt.filter(F.col("role") != system).select(F.col("conv_id").alias("id"), F.col("role").alias("speaker")).distinct(), "speakers")
    return whole.join(if_small(who), same).select("conv_id", "part", "ms", "speaker")


def perspectives(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system", part_turns: int = PART_TURNS) -> DataFrame:
    """A row for each conversation, part and speaker.

    Columns: conv_id, part (place of the turn in its conversation over ``part_turns``, so that 0 is all of a shorter
    one), speaker, n_messages, n_trained, rendered, mask (array of 0 and 1 per message) and spans
    ("begin-end" of each trained content in code points of ``rendered``, joined by commas, end
    exclusive). Null turns come first. Null roles are a speaker named "unknown", null texts are empty. Turns with
    the same number keep the order of role, then text; repeated rows all stay. Every speaker of the conversation has
    a rendering of each part, silent there or not. A part after the first begins with the system turn in force, the
    last one of the parts before it, which counts as its message and moves its spans; earlier ones are in their own parts alone.
    "<|" in texts and roles becomes "< |", and a line break in a role a blank, so that only the rendering's own markers are such.
    Long texts stay whole; other columns are not read, whatever their names.
    A conversation of system turns alone has no speaker and gives no row; an empty table none.
    """
    plain = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        plainly(F.translate(F.coalesce(F.col(role).cast("string"), F.lit("unknown")), "\n", " ")).alias("role"),
        plainly(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
    )
    message = F.struct("turn", "role", "text").alias("m")
    # Conversations of several parts: at most a row for each ``part_turns`` rows of the table.
    long = written(plain.groupBy("conv_id").count().filter(F.col("count") > part_turns).select(F.col("conv_id").alias("id")), "long")
    split = not long.isEmpty()
    short = plain.join(if_small(long), F.col("conv_id").eqNullSafe(F.col("id")), "left_anti") if split else plain
    grouped = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("ms"))
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("ms", lambda m: m["role"]), lambda r: r != system)))
    seen = grouped.select("conv_id", F.lit(0).cast("long").alias("part"), "ms", F.explode(speakers).alias("speaker"))
    if split:
        seen = seen.unionByName(parts_of(plain.join(if_small(long), F.col("conv_id").eqNullSafe(F.col("id")), "left_semi"), message, system, part_turns))

    def head(m: Column) -> Column:
        who = F.when(m["role"] == system, F.lit("system")).when(m["role"] == F.col("speaker"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), m["role"]))
        return F.concat(F.lit("<|im_start|>"), who, F.lit("\n"))

    shown = seen.withColumn("parts", F.transform("ms", lambda m: F.struct(head(m).alias("head"), m["text"].alias("body"), ((m["role"] == F.col("speaker")) & (m["role"] != system)).cast("int").alias("own"))))
    tail = "<|im_end|>\n"
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(tail)).alias("at"),
            F.when(p["own"] == 1, F.array_append(a["out"], F.concat_ws("-", a["at"] + F.length(p["head"]), a["at"] + F.length(p["head"]) + F.length(p["body"])))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.array_join(a["out"], ","),
    )
    return shown.select(
        "conv_id",
        "part",
        "speaker",
        F.size("parts").cast("long").alias("n_messages"),
        F.aggregate("parts", F.lit(0), lambda a, p: a + p["own"]).cast("long").alias("n_trained"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("rendered"),
        F.transform("parts", lambda p: p["own"]).alias("mask"),
        spans.alias("spans"),
    )

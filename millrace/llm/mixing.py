"""Mixing of sources to target weights by Poisson replication.

Each document gets a count drawn from a Poisson distribution whose mean is its source's
target repetition rate. The draw inverts the distribution at a point that a hash of seed
and document id gives, so a rerun or a retried task draws the same. Each document is then
exploded by its count, and the copies are dealt to partitions and ordered by another hash.

All of it is DataFrame work. The rates have a row per source; that table is broadcast only
after its rows have been counted and found few, and is else joined by a salted shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named_apart, with_new

#: Up to so many sources (below 2 MB of rates) the table of rates is broadcast.
BROADCAST_SOURCES = 10_000
#: Parts that a hot source is split into where the rates are joined by shuffle.
SALTS = 64


def hash_unit(*parts: Column) -> Column:
    """A point in [0, 1) from a hash: the first 13 hex digits (52 bits) of the MD5 of the joined parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least n whose distribution function exceeds ``u``; 0 where the rate is null or not above 0.

    Terms are carried as logarithms, so large rates do not underflow. The steps reach 12 standard
    deviations and 30 terms beyond the mean, past which a double holds no more mass.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-rate).alias("logp"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n")),
        lambda a, k: F.struct(
            (a["logp"] + F.ln(rate) - F.ln(k)).alias("logp"),
            (a["cdf"] + F.exp(a["logp"] + F.ln(rate) - F.ln(k))).alias("cdf"),
            (a["n"] + (a["cdf"] <= u).cast("int")).alias("n"),
        ),
        lambda a: a["n"],
    )
    return F.when(rate > 0, drawn).otherwise(F.lit(0))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, rows_out: float | None, source: str = "source") -> DataFrame:
    """Mean repetitions per source: share of the target times rows wanted, over rows there are.

    ``weights``: source to weight, to be scaled to sum 1; sources not named get none. None: the
    same weight for every source of the input. Null sources form a source of their own, which
    takes part under the key None. ``rows_out``: expected rows of the result; None: as many as come in.
    """
    per = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("__rows"))
    if weights is None:
        weighted = per.withColumn("__weight", F.lit(1.0))
    else:
        spark = docs.sparkSession
        named = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__name string, __weight double")
        weighted = per.join(named, F.col("__source").cast("string").eqNullSafe(F.col("__name")), "left").drop("__name")
        weighted = weighted.withColumn("__weight", F.greatest(F.coalesce("__weight", F.lit(0.0)), F.lit(0.0)))
    total = weighted.agg(F.sum("__rows").alias("rows"), F.sum("__weight").alias("weights")).first()
    wanted = float(total["rows"] or 0) if rows_out is None else float(rows_out)
    if not total["weights"]:
        return weighted.select("__source", F.lit(0.0).alias("__rate"))
    return weighted.select("__source", (F.col("__weight") / F.lit(float(total["weights"])) * F.lit(wanted) / F.col("__rows")).alias("__rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, rows_out: float | None = None, seed: int = 0, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Documents repeated to the target weights and shuffled globally.

    Adds ``n_copies`` (the document's count), ``copy`` (1 to the count) and ``shuffle_key``
    (the place in the global order: rows are dealt by it and sorted by it in their partition).
    Input columns of those names give way. An empty table gives an empty one; null or empty
    texts are copied like others; a null key draws as the text "null" does; rows that share a
    key share their draw, and their copies all stay. Other columns may have any names.
    """
    rates, own = named_apart(source_rates(docs, weights, rows_out, source), docs)
    same = F.col(source).eqNullSafe(own["__source"])
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rated = docs.join(F.broadcast(rates), same, "inner")
    else:
        mine, other = fresh(rates.join(docs.limit(0)), "__own_salt", "__salt")
        spread = rates.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = docs.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(SALTS))).join(spread, same & (F.col(mine) == F.col(other)), "inner")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_copies", "copy", "shuffle_key")]
    drawn = poisson_inverse(hash_unit(F.lit(seed), F.lit("count"), F.col(key)), own["__rate"])
    counted = rated.select(*kept, drawn.alias("n_copies")).filter("n_copies > 0")
    copies = with_new(counted, copy=F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    placed = with_new(copies, shuffle_key=F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy"))))
    return placed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")

"""Columns over numbers, times, maps and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, table: dict, default) -> Column:
    """The value of a small fixed table, or the default."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def tier(value: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that the value is above, cuts from high to low; ``rest`` below all and for nulls."""
    out = None
    for cut, name in cuts:
        out = F.when(value > cut, name) if out is None else out.when(value > cut, name)
    return F.lit(rest) if out is None else out.otherwise(rest)


def risk_tier(score: Column) -> Column:
    return tier(score, [(0.8, "critical"), (0.5, "high"), (0.1, "medium")], "low")


def confidence_tier(score: Column) -> Column:
    return tier(score, [(0.8, "high"), (0.5, "medium")], "low")


def length_bucket(length: Column) -> Column:
    """128, 256, 512 or 1024: the least that holds the length; 0 above all."""
    return F.when(length <= 128, 128).when(length <= 256, 256).when(length <= 512, 512).when(length <= 1024, 1024).otherwise(0)


def monday_zero(ts: Column) -> Column:
    """Day of the week, Monday 0."""
    return F.weekday(ts)


def off_hours(ts: Column) -> Column:
    return F.hour(ts).between(1, 5)


def z_score(value: Column, mean: Column, std: Column, least: float = 1e-6) -> Column:
    """Distance from the mean in deviations; a missing deviation counts as 1 and none as ``least``."""
    return (value - F.coalesce(mean, F.lit(0.0))) / F.greatest(F.coalesce(std, F.lit(1.0)), F.lit(least))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where either vector is zero or missing."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalized(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes given as xmin, ymin, xmax, ymax."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    inner = side(0, 2) * side(1, 3)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(inner, area(a) + area(b) - inner), F.lit(0.0))


def scaled_pixels(values: Column, mean: float = 0.5, std: float = 0.5) -> Column:
    """Bytes of an image as (x / 255 - mean) / std."""
    return F.transform(values, lambda x: (x / 255.0 - mean) / std)


def shocked(volatility: Column, price: Column, shock: float) -> tuple[Column, Column]:
    """Implied volatility up by a shock and price down by that share."""
    return volatility + shock, price * (1 - shock)


def passes(confidence: Column, plddt: Column, least: float = 0.5, least_plddt: float = 50.0) -> Column:
    """Whether a predicted structure is sure enough in both respects."""
    return F.coalesce((confidence > least) & (plddt > least_plddt), F.lit(False))


def same_elements(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, in any order and number."""
    return F.coalesce((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0), F.lit(False))

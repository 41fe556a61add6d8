"""Columns over text: cleaning, counts, filled forms, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that raise a document's priority.
URGENT = ("urgent", "critical", "deadline")
IMPORTANT = ("important", "quarterly", "annual")


def clean(text: Column) -> Column:
    """Lower case, white space collapsed to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def strip_tags(markup: Column) -> Column:
    """Markup without its tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, r"<[^>]+>", " "), r"\s+", " "))


def words(text: Column) -> Column:
    """The words of a text, parted at white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def labelled(parts: dict[str, Column], length: int = 2048) -> Column:
    """``Label: value`` parts joined by blanks and cut to a length; null parts count as empty."""
    return F.substring(F.concat_ws(" ", *[F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in parts.items()]), 1, length)


def contains_any(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of some plain strings."""
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(F.lower(text), F.lit(k))
    return F.coalesce(found, F.lit(False))


def priority(text: Column) -> Column:
    return F.when(contains_any(text, URGENT), "high").when(contains_any(text, IMPORTANT), "medium").otherwise("low")


def after_last(text: Column, mark: str) -> Column:
    """What follows the last ``mark``; the whole text where there is none."""
    return F.substring_index(text, mark, -1)


def parsed_call(text: Column) -> Column:
    """A call ``name(arguments)`` after the last ``Output: `` as a struct of both; nulls where it has another form."""
    tail = after_last(text, "Output: ")
    pattern = r"^(.+?)\((.+)\)$"
    fits = tail.rlike(pattern)
    return F.struct(F.when(fits, F.regexp_extract(tail, pattern, 1)).alias("name"), F.when(fits, F.regexp_extract(tail, pattern, 2)).alias("arguments"))


def bracketed_names(text: Column) -> Column:
    """All words that an opening bracket follows."""
    return F.regexp_extract_all(text, F.lit(r"(\w+)\["), 1)


def fraction_outside(text: Column, allowed: str) -> Column:
    """Share of the characters that are not in the class ``allowed``; 0 for an empty text."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, f"[{allowed}]", "")), F.length(text)), F.lit(0.0))


def content_id(text: Column) -> Column:
    return F.sha2(text, 256)


def filled(form: str, **values: Column) -> Column:
    """A form with ``{name}`` places filled by columns; null values count as empty."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(form):
        parts += [F.lit(literal)] if literal else []
        parts += [F.coalesce(values[name].cast("string"), F.lit(""))] if name else []
    return F.concat(*parts) if parts else F.lit("")


def path_parts(path: Column) -> dict[str, Column]:
    """Name, suffix (with its dot; empty if there is none) and parent folder of a path."""
    name = F.substring_index(path, "/", -1)
    return {"name": name, "suffix": F.regexp_extract(name, r"(\.[^.]+)$", 1), "parent": F.regexp_extract(path, r"^(.*)/", 1)}


def quality_score(size_mb: Column, length: Column, category: Column, n_words: Column) -> Column:
    """0 to 4: a point each for a size above 0.01, a length above 100, a category that is not general, more than 20 words."""
    point = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return point(size_mb > 0.01) + point(length > 100) + point(category != "general") + point(n_words > 20)


def quality_rating(score: Column) -> Column:
    return F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")


def issues(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, as a JSON list."""
    return F.to_json(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull()))


def judged_score(answer: Column, least: float = 0.0, most: float = 10.0) -> Column:
    """The score in a judge's answer: the number after the last "score" or "rating" (any case; ``Score: 4``, ``rating is 3.5/5``), else the answer itself if it is a number; null where there is none or it lies outside of the bounds."""
    number = r"(-?\d+(?:\.\d+)?)"
    said = F.regexp_extract_all(F.lower(answer), F.lit(rf"(?:score|rating)(?:\s+is)?\s*[:=]?\s*\**\s*{number}"), 1)
    alone = F.regexp_extract(F.trim(answer), rf"^{number}$", 1)
    value = F.coalesce(F.get(said, F.size(said) - 1), F.nullif(alone, F.lit(""))).try_cast("double")
    return F.when(value.between(least, most), value)

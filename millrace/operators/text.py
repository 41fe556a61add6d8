"""Chunking, chat messages, sections of pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def chunk_fixed(df: DataFrame, text: str, size: int = 1500, overlap: int = 150) -> DataFrame:
    """Chunks of ``size`` characters that overlap; the last is the first to reach the text's end. Null and empty texts have none."""
    step = size - overlap
    n = F.length(text)
    more = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    each = df.filter(n > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), more)))
    return each.withColumns({"total_chunks": more + 1, "chunk": F.substring(F.col(text), F.col("chunk_index") * step + 1, F.lit(size))})


def chunk_words(df: DataFrame, text: str, size: int) -> DataFrame:
    """Chunks of ``size`` words joined by blanks."""
    own = df.withColumn("__w", words(F.col(text))).filter(F.size("__w") > 0)
    each = own.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.floor((F.size("__w") - 1) / size).cast("int"))))
    return each.withColumn("chunk", F.concat_ws(" ", F.slice("__w", F.col("chunk_index") * size + 1, size))).drop("__w")


def messages(system: Column, user: Column, assistant: Column) -> Column:
    """A chat of three messages as an array of role and content."""
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))])


def few_shot(system: Column, examples: list[tuple[str, str]], user: Column) -> Column:
    """A chat that shows examples (question, answer) before it asks: the system's message, both sides of each example, the user's message."""
    said = [("system", system), *[(r, F.lit(t)) for q, a in examples for r, t in (("user", q), ("assistant", a))], ("user", user)]
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in said])


def split_recursively(text: Column, size: int) -> Column:
    """Pieces of at most ``size`` characters: paragraphs where they fit, else their sentences, else stretches of that size. Blank pieces are left out."""
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / size).cast("int")), lambda k: F.substring(t, k * size + 1, F.lit(size)))
    whole = lambda t: F.array(F.trim(t))
    sentences = lambda t: F.flatten(F.transform(F.split(F.trim(t), r"(?<=[.!?]) "), lambda x: F.when(F.length(x) <= size, whole(x)).otherwise(cut(x))))
    parts = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.when(F.length(F.trim(x)) <= size, whole(x)).otherwise(sentences(x))))
    return F.filter(parts, lambda x: F.trim(x) != "")


class _Sections(HTMLParser):
    """Text of each element with an id that stands in ``<section>``, without that of sections inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str | None, list[str]]] = []
        self.done: list[tuple[str, str]] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.skip += tag in ("script", "style")
        if tag == "section":
            self.open.append((dict(attrs).get("id"), []))

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag == "section" and self.open:
            name, parts = self.open.pop()
            if name:
                self.done.append((name, " ".join("".join(parts).split())))

    def handle_data(self, data: str) -> None:
        if self.open and not self.skip:
            self.open[-1][1].append(data)


def sections(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """source (url#id) and text of every section of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for u, h in zip(batch["u"], batch["h"], strict=True):
                p = _Sections()
                p.feed(h or "")
                p.close()
                out += [(f"{u or ''}#{name}", text) for name, text in p.done]
            yield pd.DataFrame(out, columns=["source", "text"])

    return pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, "source string, text string")


def page_parts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, status and blocks of each page: ``success`` with the texts of its headings and paragraphs, ``empty`` for no content, ``unsupported_format`` for what is no markup."""
    body = F.col(html).cast("string")
    inner = F.regexp_extract_all(body, F.lit(r"(?is)<(?:h[1-6]|p|li)\b[^>]*>([^<]*)"), 1)
    blocks = F.filter(F.transform(inner, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    status = F.when(F.coalesce(F.trim(body), F.lit("")) == "", "empty").when(~body.rlike("<[a-zA-Z!]"), "unsupported_format").otherwise("success")
    return pages.select(key, status.alias("status"), F.when(status == "success", blocks).otherwise(F.array().cast("array<string>")).alias("blocks"))

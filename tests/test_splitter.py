"""Recursive splitting against a plain recursion over strings."""

import random

import pytest

from millrace.operators import splitter

PARTS = ("\n\n", "\n", " ", "")


def plain_parts(text, separator):
    if separator == "":
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *[separator + r for r in rest]] if p]


def plain_merge(parts, size, overlap, measure):
    done, own = [], []
    for p in parts:
        if sum(map(measure, own)) + measure(p) > size and own:
            done.append("".join(own))
            while sum(map(measure, own)) > overlap or (sum(map(measure, own)) + measure(p) > size and sum(map(measure, own)) > 0):
                own = own[1:]
        own = [*own, p]
    return [*done, "".join(own)] if own else done


def plain(text, separators, size, overlap, measure):
    separator = next((s for s in separators if s == "" or s in text), separators[-1])
    rest = separators[separators.index(separator) + 1 :]
    out, good = [], []
    for p in plain_parts(text, separator):
        if measure(p) < size:
            good.append(p)
            continue
        out += plain_merge(good, size, overlap, measure)
        good = []
        out += plain(p, rest, size, overlap, measure) if rest else [p]
    return [*out, *plain_merge(good, size, overlap, measure)]


def made(rng):
    return "".join(rng.choice(["a", "bb", "ccc é", "dddddddd", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "😀", "x" * rng.randint(1, 40)]) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize(("size", "overlap", "by_words"), [(10, 0, False), (10, 4, False), (25, 20, False), (3, 0, True), (5, 2, True), (1, 0, False)])
def test_against_plain(size, overlap, by_words):
    rng = random.Random(size)
    measure = (lambda t: len(t.split())) if by_words else len
    for _ in range(150):
        text = made(rng)
        want = [c for c in (c.strip() for c in plain(text, list(PARTS), size, overlap, measure)) if c]
        assert splitter.pieces(text, size, overlap, by_words=by_words) == want
        if not by_words:
            assert all(len(c) <= size for c in want)
        if not overlap:
            assert "".join("".join(want).split()) == "".join(text.split())


def test_other_separators_and_one_separator(spark):
    assert splitter.pieces("aa. bb. cc", 5, 0, (". ", "")) == ["aa", ". bb", ". cc"]
    df = spark.createDataFrame([(1, "aa\n\nbb\n\ncc\n\ndddddddddd\n\n\n\nee"), (2, None), (3, ""), (4, "\n\n \n\n")], "id int, text string")
    got = [(r["id"], r["chunk_index"], r["total_chunks"], r["chunk"]) for r in splitter.split_at(df, "text", 8, 4).collect()]
    assert got == [(1, 0, 4, "aa\n\nbb"), (1, 1, 4, "bb\n\ncc"), (1, 2, 4, "dddddddddd"), (1, 3, 4, "ee")]


def test_rows(spark):
    rows = [(1, "one two three " * 30, 5), (2, None, 5), (3, "", 5), (4, " \n ", 5), (5, "word", 5), (6, "y" * 100_000, 5), (6, "w " * 100_000, 5)]
    df = spark.createDataFrame(rows, "id int, text string, chunk int").repartition(3)
    got = splitter.split(df, "text", 100, 20)
    assert got.columns == ["id", "text", "chunk_index", "total_chunks", "chunk"]
    per = {}
    for r in got.collect():
        per.setdefault((r["id"], r["text"]), []).append((r["chunk_index"], r["total_chunks"], r["chunk"]))
    assert {i for i, _ in per} == {1, 5, 6} and per[5, "word"] == [(0, 1, "word")]
    for (_, text), own in per.items():
        assert [k for k, _, _ in sorted(own)] == list(range(len(own))) and {n for _, n, _ in own} == {len(own)}
        assert [c for _, _, c in sorted(own)] == splitter.pieces(text, 100, 20)
    few = splitter.split(df, "text", 50, by_words=True, limits=(20, 4000), weight=1.2)
    assert {r["id"] for r in few.collect()} == {1}
    assert splitter.split(df.limit(0), "text", 10).collect() == []
    with pytest.raises(ValueError):
        splitter.split(df, "text", 10, 10)


def test_a_long_text_is_not_copied_to_each_of_its_chunks(spark):
    df = spark.createDataFrame([(1, "some word " * 100_000)], "id int, text string")
    assert splitter.split(df, "text", 100).drop("text").count() == 10_000

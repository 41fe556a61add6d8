"""N-gram Jaccard join by token-combination prefixes.

Sets of word shingles are joined by prefix filtering. All sets are put in one order of shingles, rare
ones first (``frequency``); two sets of similarity t or more then share a shingle among the first
|x| - ceil(t|x|) + 1 of either, and share two among the first |x| - ceil(t|x|) + 2. On these extended prefixes,
shingles of a rare class are indexed one by one and shingles of the frequent class in combinations of two: a
pair shares either a rare shingle, or two frequent ones. Candidates are verified on the whole sets.

Copies of a text are one class from the start. Classes that are joined already are not paired again: each class
is first compared with one likely partner from its lists, twice at most, and what is left between components is then
searched exhaustively. So a group of thousands of near copies costs about a comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import if_small
from . import frequency
from .common import encoded, fan_out, named_apart, released, tidy, written
from .frequency import batch_of, classed, cogrouped
from .graph import components
from .shingles import least_overlap, parity_maps, shingle_sets

#: Entries of a shingle in the index from which it is of the frequent class: so many, and so many more for each
#: shingle of its documents' prefixes, since combinations cost rows by the square of these.
FREQUENT, FREQUENT_BY_PREFIX = 64, 16
#: Rows that are compared at once within an entry list; longer lists are cut into parts, compared pair by pair of parts.
BLOCK = 2048
#: Pairs with one document that a task verifies; pairs with a document of more are dealt to several.
PAIRS = 128
#: Most rounds of comparing each class with one likely partner.
ROUNDS = 2
SALTS = 16


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the extended prefix of a set of n: n - ceil(t n) + 2, n at most."""
    return np.minimum(n, n + percent * -n // 100 + 2)


def firsts_of(texts: pa.Table, beside: pa.Table) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """doc_id, t1, t2 and bytes of the rows of a batch that stand for their text, in order; once each."""
    wanted = {r for r in zip(*(beside.column(c).to_pylist() for c in ("doc_id", "t1", "t2")), strict=True) if r[0] is not None}
    rows: dict[tuple[int, int, int], int] = {}
    for k, row in enumerate(zip(*(texts.column(c).to_pylist() for c in ("doc_id", "t1", "t2")), strict=True)):
        if row in wanted:
            rows.setdefault(row, k)
    order = sorted(rows)
    return order, [encoded(texts.column("text")[rows[r]].as_py()) for r in order]


def prefixes(docs: DataFrame, ids: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n) of every row, and doc_id, t1, t2, n, bits and hs: the shingles that the extended prefix of a text
    shares with others, of texts that have any. docs: doc_id, text, t1, t2; ids: their classes."""
    total = ids.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n_batches, n_buckets = frequency.batches_of(total), frequency.buckets_of(total // 6)
    texts = docs.select(batch_of(n_batches), "doc_id", "t1", "t2", "text")
    firsts = ids.select(F.col("least").alias("doc_id"), "t1", "t2")
    firsts = firsts.select(batch_of(n_batches), "doc_id", "t1", "t2")

    def listed(own: pa.Table, beside: pa.Table) -> pa.Table:
        keys = list(zip(*(own.column(c).to_pylist() for c in ("t1", "t2")), strict=True))
        place = {k: i for i, k in reversed(list(enumerate(keys)))}
        distinct = sorted(place, key=place.__getitem__)
        h, sizes = shingle_sets([encoded(own.column("text")[place[k]].as_py()) for k in distinct])
        size_of = dict(zip(distinct, sizes.tolist(), strict=True))
        order, _ = firsts_of(own, beside)
        stands = {r[1:] for r in order}
        u, counts, _ = frequency.distinct(h[np.repeat([k in stands for k in distinct], sizes)] if len(h) else h)
        lists = pa.table(frequency.packed(own.column("batch")[0].as_py() if len(own) else 0, u, counts, n_buckets))
        rows = pa.table({"doc_id": own.column("doc_id"), "n": pa.array([size_of[k] for k in keys], pa.int64())})
        return pa.concat_tables([rows, lists], promote_options="default").select(["doc_id", "n", "batch", "bucket", "tokens", "at", "counts"])

    first = written(cogrouped(texts, firsts, listed, "doc_id long, n long, " + frequency.LISTS), "lists")
    tidy(docs.sparkSession)
    told = written(frequency.codes(first.filter("bucket is not null")), "codes")
    sizes = written(first.filter("bucket is null").select("doc_id", "n"), "sizes")
    released(first)
    tidy(docs.sparkSession)

    def ordered(own: pa.Table, beside: pa.Table) -> pa.Table:
        order, data = firsts_of(own, beside)
        h, n = shingle_sets(data)
        u, _, place = frequency.distinct(h)
        known = [(b.as_py(), c.as_py()) for b, c in zip(beside.column("bucket"), beside.column("codes"), strict=True) if b.is_valid]
        code = frequency.unpacked(u, n_buckets, known)[place]
        row = np.repeat(np.arange(len(n)), n)
        on = np.flatnonzero(code)
        # Shingles of one document alone come first in its prefix; nothing can meet there.
        shared = np.bincount(row[on], minlength=len(n))
        room = np.minimum(np.maximum(prefix_size(n, percent) - (n - shared), 0), shared)
        on = on[np.lexsort((h[on], code[on], row[on]))]
        begin = np.cumsum(shared) - shared
        taken = on[np.arange(len(on)) - begin[row[on]] < room[row[on]]]
        some = np.flatnonzero(room)
        ends = np.cumsum(n)
        flat = np.concatenate([h[ends[k] - n[k] : ends[k]] for k in some]) if len(some) else h[:0]
        bits = parity_maps(flat, n[some]) if len(some) else np.zeros((0, 128), np.uint8)
        columns = [pa.array([order[k][c] for k in some], pa.int64()) for c in range(3)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(room[some])]).astype(np.int32))
        return pa.table([*columns, pa.array(n[some], pa.int64()), frequency.binaries(bits, np.arange(1, len(some) + 1) * bits.shape[1]), pa.ListArray.from_arrays(offsets, pa.array(h[taken].view(np.int64)))], names=["doc_id", "t1", "t2", "n", "bits", "hs"])

    nothing = F.lit(None)
    beside = firsts.select("*", nothing.cast("int").alias("bucket"), nothing.cast("binary").alias("codes")).unionByName(told.select("batch", *[nothing.cast("long").alias(c) for c in ("doc_id", "t1", "t2")], "bucket", "codes"))
    known = texts.filter("doc_id is not null and text is not null")
    heads = written(cogrouped(known, beside, ordered, "doc_id long, t1 long, t2 long, n long, bits binary, hs array<long>"), "prefixes")
    released(told)
    tidy(docs.sparkSession)
    return sizes, heads


def similar(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough. texts: doc_id, text; a document may have several."""
    two = pairs
    for own, other in (("a", "b"), ("b", "a")):
        # Either side may hold a document of very many pairs: its text goes to several tasks.
        many = written(pairs.groupBy(own).agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts")).filter("parts > 1"), "many")
        parts = F.coalesce("parts", F.lit(1))
        two = two.join(if_small(many), own, "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
        dealt = texts.join(if_small(many.withColumnRenamed(own, "doc_id")), "doc_id", "left").select(F.col("doc_id").alias(own), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("text").alias(f"text_{own}"))
        two = two.join(dealt, [own, "part"]).drop("part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                number: dict[str, int] = {}
                x, y = ([number.setdefault(t, len(number)) for t in some[c]] for c in ("text_a", "text_b"))
                h, n = shingle_sets([encoded(t) for t in number])
                ends = np.cumsum(n)
                keep = []
                for i, j in zip(x, y, strict=True):
                    a, b = h[ends[i] - n[i] : ends[i]], h[ends[j] - n[j] : ends[j]]
                    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
                yield some.loc[np.array(keep, bool), ["a", "b"]]

    return two.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long").distinct()


def survivors(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that meet in a list of the index, are of different components, and whose sizes and parity maps
    allow the similarity. entries: k1, k2 (the list), doc, n, comp, bits. Parity maps that differ in d bits mean
    that the sets differ in d shingles at least, so no similar pair is lost."""
    per = entries.groupBy("k1", "k2", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = per.groupBy("k1", "k2").agg(F.sum("c").alias("m"), F.max(F.struct("c", F.col("comp").alias("main"))).alias("s")).filter("s.c < m").select("k1", "k2", (F.col("m") - F.col("s.c")).alias("others"), F.col("s.c").alias("mains"), "s.main")
    met = entries.join(sizes, ["k1", "k2"])
    # Rows of a list's largest component go to one part each; the others meet each of these parts, and each other.
    in_main = F.col("comp") == F.col("main")
    main_parts, parts = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("mains", "others"))
    own = F.pmod(F.xxhash64("doc"), F.when(in_main, main_parts).otherwise(parts)).cast("int")
    places = lambda n: F.sequence(F.lit(0), n - 1)
    met = met.withColumns({"own": own, "in_main": in_main})
    to_main = F.transform(F.when(F.col("in_main"), F.array("own")).otherwise(places(main_parts)), lambda k: F.struct((-1 - k).alias("p"), F.lit(0).alias("q")))
    to_others = F.transform(F.when(F.col("in_main"), F.array().cast("array<int>")).otherwise(places(parts)), lambda k: F.struct(F.least("own", k).alias("p"), F.greatest("own", k).alias("q")))
    placed = met.withColumn("to", F.explode(F.concat(to_main, to_others)))
    placed = placed.select("k1", "k2", "to.p", "to.q", F.when(F.col("to.p") < 0, F.when(F.col("in_main"), 0).otherwise(1)).otherwise(F.col("own")).alias("own"), "doc", "n", "comp", "bits")
    keys = ["k1", "k2", "p", "q"]
    dealt = placed.repartition(fan_out(entries.sparkSession), *keys).sortWithinPartitions(*keys)

    def pairs_of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        k = rows[keys].to_numpy()
        doc, n, comp, own = (rows[c].to_numpy() for c in ("doc", "n", "comp", "own"))
        bits = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(len(rows), -1)
        cuts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(rows)]])
        after = np.repeat(cuts[1:], np.diff(cuts)) - 1 - np.arange(len(rows))  # rows of the same list that follow
        within = k[:, 2] == k[:, 3]  # else rows of two sides, or parts, are compared with each other alone
        done = np.cumsum(after)
        out = []
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] - after[lo] + 500_000, side="right")))
            some = after[lo:hi]
            x = np.repeat(np.arange(lo, hi), some)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some)
            fits = (comp[x] != comp[y]) & (within[x] | (own[x] != own[y])) & (doc[x] != doc[y])
            fits &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[fits], y[fits]
            for at in range(0, len(x), 65536):
                i, j = x[at : at + 65536], y[at : at + 65536]
                differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                ok = (n[i] + n[j] - differ) // 2 >= least_overlap(n[i], n[j], percent)
                out.append(np.stack([np.minimum(doc[i[ok]], doc[j[ok]]), np.maximum(doc[i[ok]], doc[j[ok]])]))
            lo = hi
        if out:
            both = np.unique(np.concatenate(out, axis=1), axis=1)
            yield pd.DataFrame({"a": both[0], "b": both[1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            open_ = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
            rest = batch[open_].reset_index(drop=True)
            if not open_.all():
                yield from pairs_of(batch[~open_].reset_index(drop=True))
        if rest is not None and len(rest):
            yield from pairs_of(rest)

    return dealt.mapInPandas(run, "a long, b long").distinct()


def to_least(docs: DataFrame, classes: DataFrame, keys: tuple[str, ...] = ("t1", "t2")) -> DataFrame:
    """(a, b): each document and the least one of its class, where these differ. docs: doc_id and the keys; classes: the
    keys, least and most. Hot classes are dealt to several tasks."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    several = classes.filter("most > least").select(*keys, "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = docs.select("doc_id", *keys, salt.alias("salt"))
    return own.join(several, [*keys, "salt"]).filter("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))


def links(heads: DataFrame, texts: DataFrame, percent: int, by_twos: bool = True) -> DataFrame:
    """Pairs (a, b) of similar documents that connect all that are similar. heads: of ``prefixes``; texts: doc_id, text of
    those. by_twos: similar documents of two shingles or more share two of their hashes ``hs``, or a rare one."""
    every = heads.select(F.col("doc_id").alias("doc"), "n", F.explode("hs").alias("h"))
    # Sets of one shingle are similar only to their like, and share just that one.
    lone = F.lit(by_twos) & (F.col("n") == 1)
    ones, entries = every.filter(lone).select(F.col("doc").alias("doc_id"), "h"), every.filter(~lone)
    all_links = written(to_least(ones, ones.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), ("h",)), "links")
    lists = entries.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    now = written(entries.join(lists, "h").select("h", "doc", "n", F.col("doc").alias("comp")), "index")
    for turn in range(ROUNDS):
        order = F.xxhash64("doc", F.lit(turn)) if turn else F.col("doc")
        leaders = now.groupBy("h").agg(F.min(F.struct(order.alias("o"), F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))).alias("s")).select("h", "s.b", "s.n_b", "s.comp_b")
        near = now.join(leaders, "h").filter((F.col("comp") != F.col("comp_b")) & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")))
        votes = near.groupBy(F.col("doc").alias("a"), "b").agg(F.count(F.lit(1)).alias("votes"))
        best = written(votes.groupBy("a").agg(F.max(F.struct("votes", F.struct(-F.col("b")).alias("r"), "b")).alias("s")).select("a", "s.b"), "asked")
        found = written(similar(best, texts, percent), "found")
        released(best)
        tidy(heads.sparkSession)
        if not found.head(1):
            released(found)
            break
        # Components so far, and the lists that still hold several.
        known = found.union(all_links)
        joined = written(components(known).select(F.col("node").alias("doc"), F.col("component").alias("joined")), "joined")
        kept = written(known, "links")
        released(found, all_links)
        all_links = kept
        labelled = now.select("h", "doc", "n").join(if_small(joined), "doc", "left").select("h", "doc", "n", F.coalesce("joined", "doc").alias("comp"))
        several = labelled.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
        after = written(labelled.join(several, "h"), "index")
        released(now, joined)
        now = after
        tidy(heads.sparkSession)
    # What is left between components, exhaustively: rare shingles by themselves, frequent ones by twos.
    sizes = now.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.avg(F.col("n") * (100 - percent) / 100).alias("mean"))
    bits = heads.select(F.col("doc_id").alias("doc"), "n", "bits").dropDuplicates(["doc", "n", "bits"])
    full = written(now.join(sizes, "h").join(bits, ["doc", "n"]).select("h", "doc", "n", "comp", "bits", (F.lit(by_twos) & (F.col("m") > FREQUENT + FREQUENT_BY_PREFIX * F.col("mean"))).alias("frequent")), "entries")
    released(now)
    single = full.filter("not frequent").select(F.col("h").alias("k1"), F.lit(-1).cast("long").alias("k2"), "doc", "n", "comp", "bits")
    hot = full.filter("frequent").groupBy("doc", "n", "comp", "bits").agg(F.array_sort(F.collect_set("h")).alias("hs")).filter(F.size("hs") > 1)
    first = hot.select("doc", "n", "comp", "bits", "hs", F.posexplode("hs").alias("i", "k1"))
    double = first.select("k1", F.explode(F.slice("hs", F.col("i") + 2, F.size("hs"))).alias("k2"), "doc", "n", "comp", "bits")
    left = written(survivors(single.unionByName(double), percent), "pairs")
    released(full)
    tidy(heads.sparkSession)
    found = similar(left, texts, percent)
    out = written(found.union(all_links), "links")
    released(left, all_links)
    return out


def copies(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b): each document and the least one of its text, where these differ and the text has words."""
    own = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select("doc_id", "t1", "t2")
    return to_least(own, ids)


def similar_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, a row per row of ``docs``.

    Documents without words, and a null id, link with nothing. Rows that share an id are one document of several
    texts: what any of them links to is linked, and each keeps its own n_shingles. Equal sets are linked. Documents of fewer than
    five words have one shingle, all their words. A similarity of just ``percent`` in a hundred links. Texts of any
    length are taken whole, one text's shingles by one task; other columns are not read, whatever their names.
    An empty table gives an empty one.
    """
    plain = classed(docs, key, text)
    ids = written(frequency.classes(plain), "classes")
    sizes, heads = prefixes(plain, ids, percent)
    asked = plain.join(heads.select("doc_id", "t1", "t2"), ["doc_id", "t1", "t2"]).dropDuplicates(["doc_id", "t1", "t2"])
    texts = written(asked.select("doc_id", "text"), "texts")
    found = links(heads, texts, percent)
    released(heads, texts)
    every = written(found.union(copies(plain, ids)), "links")
    released(found, ids)
    joined = components(every).select(F.col("node").alias("doc_id"), "component")
    return sizes.join(joined, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The documents without those that are linked to one of a smaller id; columns as they come, whatever their names.

    Null ids, and texts without words, stay. Rows that share an id stay or go together.
    """
    found = similar_documents(docs, key=key, text=text, percent=percent).filter("doc_id <> component_id").select("doc_id").distinct()
    gone, own = named_apart(found, docs)
    return docs.join(gone, F.col(key).cast("long") == own["doc_id"], "left_anti")

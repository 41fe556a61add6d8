"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

The pieces of a public model span a lattice over each text. A forward pass sums the weights of
all segmentations up to every position; a backward pass draws one segmentation from that
distribution. Random numbers are hashes of seed, row key and position, so the same row gives the
same pieces in any partition and on any retry. Decoding joins the pieces and is lossless.

The lattice falls apart where no piece can span (before blanks, around characters that are in no
longer piece), so forward passes are done once per distinct unit of a batch, many units at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = 0x2581  # stands for a blank in pieces
OWN_BLANK = np.uint32(0x80000000 | BLANK)  # that character itself, in a text
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points handled at a time in a worker; a longer text is a batch of its own.
CHUNK = 1_000_000


@dataclass
class Pieces:
    """A vocabulary: texts of pieces, their log weights, ids of the 256 byte pieces."""

    texts: list[str]
    weights: np.ndarray
    byte_ids: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL, flatness: float = 1.0) -> Pieces:
        """Read a SentencePiece model. BPE scores are ranks; a piece of rank r weighs -ln(r + 2), as word counts
        fall by Zipf's law, divided by ``flatness`` (above 1: more even sampling). Unigram scores are log weights already."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        score = np.array([m.get_score(i) for i in range(n)])
        byte_ids = np.full(256, -1, np.int32)
        texts = []
        plain = np.zeros(n, bool)
        for i in range(n):
            if m.is_byte(i):
                byte_ids[int(m.id_to_piece(i)[1:-1], 16)] = i
            plain[i] = not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
            texts.append(m.id_to_piece(i) if plain[i] else "")
        ranked = bool(np.all(score[plain] == np.round(score[plain])))
        weights = (-np.log(2.0 - score) if ranked else score).astype(np.float64)
        weights[~plain] = weights[plain].min() - 1.0
        return cls(texts, weights / flatness, byte_ids)


class Lattice:
    """What sampling needs of a vocabulary, built once in each worker."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces.texts))
        by_hash: dict[int, int] = {}
        begins: set[int] = set()  # hashes of what longer pieces begin with
        spanning: set[int] = set()
        self.inner_blank = False
        for i, t in enumerate(pieces.texts):
            if t:
                h = 0
                for c in t:
                    begins.add(h)
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                by_hash[h] = i
                if len(t) > 1:
                    spanning.update(map(ord, t))
                    self.inner_blank |= chr(BLANK) in t.lstrip(chr(BLANK))
        if len(by_hash) != sum(map(bool, pieces.texts)):
            raise ValueError("two pieces of this vocabulary share a hash")
        raw = np.array(sorted({*by_hash, *begins}), np.uint64)
        order = np.argsort(mixed(raw))
        self.hashes = mixed(raw)[order]
        self.ids = np.array([by_hash.get(int(h), -1) for h in raw], np.int32)[order]
        self.begins = np.array([int(h) in begins for h in raw])[order]
        slots = 1 << 20
        # A table over the top bits of the sorted hashes.
        self.slot = np.searchsorted(self.hashes, np.arange(slots + 1, dtype=np.float64) * 2.0**44).astype(np.int64)
        self.deepest = int(np.diff(self.slot).max())
        self.spanning = np.zeros(0x110001, bool)
        self.spanning[sorted(spanning)] = True
        self.codes = np.concatenate([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in pieces.texts] or [np.zeros(0, np.uint32)])
        self.lens = np.array([len(t) for t in pieces.texts], np.int64)
        self.offs = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.byte_of = np.full(len(pieces.texts), -1, np.int64)
        for b, i in enumerate(pieces.byte_ids):
            if i >= 0:
                self.byte_of[i] = b
        self.byte_weight = float(pieces.weights[pieces.byte_ids[0]])

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By hash of their characters: ids of pieces, -1 where there is none, and whether longer pieces begin so."""
        h = mixed(h)
        at = self.slot[(h >> np.uint64(44)).astype(np.int64)]
        ids, longer = np.full(len(h), -1, np.int32), np.zeros(len(h), bool)
        for k in range(self.deepest):
            j = np.minimum(at + k, len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[j] == h)
            ids[hit], longer[hit] = self.ids[j[hit]], self.begins[j[hit]]
        return ids, longer


def utf8_len(codes: np.ndarray) -> np.ndarray:
    c = codes & np.uint32(0x7FFFFFFF)
    return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixing hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encode_codes(lattice: Lattice, codes: np.ndarray, doc: np.ndarray, key: np.ndarray, first: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample pieces of some texts. codes: their code points, end to end, blanks as BLANK; doc: the text of each code
    point; key: a 64-bit hash per text; first: where each text begins. Gives the ids in order and the text of each."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    blank = codes == BLANK
    joins = np.zeros(n, bool)  # may a piece reach from the character before?
    plain = np.minimum(codes, np.uint32(0x110000))
    spans = lattice.spanning[plain]
    joins[1:] = spans[1:] & spans[:-1] & (doc[1:] == doc[:-1])
    if not lattice.inner_blank:
        joins[1:] &= ~blank[1:] | blank[:-1]
    starts = np.flatnonzero(~joins)
    length = np.diff(np.append(starts, n))
    # Units alike by a 64-bit hash of their characters and places are sampled from one lattice; "lossless" would show a collision.
    place = np.arange(n) - np.repeat(starts, length)
    salt = mixed(np.arange(int(length.max()) + 1, dtype=np.uint64) + np.uint64(99))
    one = mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt[place])
    whole = np.add.reduceat(one, starts) + length.astype(np.uint64)
    _, sample, unit = np.unique(whole, return_index=True, return_inverse=True)
    order = np.argsort(-length[sample], kind="stable")
    sample = sample[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    unit = rank[unit]
    u_len = length[sample]
    u_off = np.concatenate([[0], np.cumsum(u_len)])
    total = int(u_off[-1])
    chars = codes[np.repeat(starts[sample] - u_off[:-1], u_len) + np.arange(total)]
    k_of = np.repeat(np.arange(len(u_len)), u_len)
    j_of = np.arange(total) - u_off[k_of]
    left = u_len[k_of] - j_of  # characters from here to the unit's end
    # Nodes stand by their depth in the unit, then by unit; units by falling length, so those of a depth are its first ones.
    alive = np.searchsorted(-u_len, -np.arange(int(u_len[0]) + 1), side="right")
    level = np.concatenate([[0], np.cumsum(alive)])
    ends, froms, ids, weights = [], [], [], []
    h = np.zeros(total, np.uint64)
    at = np.arange(total)
    for m in range(1, lattice.longest + 1):
        at = at[left[at] >= m]
        if not len(at):
            break
        h[at] = h[at] * np.uint64(0x9E3779B97F4A7C15) + chars[at + m - 1].astype(np.uint64) + np.uint64(1)
        found, longer = lattice.lookup(h[at])
        if m == 1:
            lost = found < 0  # no piece: the bytes of the character
            edge = np.where(lost, lattice.byte_weight * utf8_len(chars), lattice.pieces.weights[np.maximum(found, 0)])
            here, found_kept = at, found
        else:
            keep = found >= 0
            here, found_kept = at[keep], found[keep]
            edge = lattice.pieces.weights[found_kept]
        froms.append(level[j_of[here]] + k_of[here])
        ends.append(level[j_of[here] + m] + k_of[here])
        ids.append(found_kept)
        weights.append(edge)
        at = at[longer]
    ends, froms, ids, weights = map(np.concatenate, (ends, froms, ids, weights))
    order = np.argsort(ends, kind="stable")
    froms, ids, weights = froms[order], ids[order], weights[order]
    e_off = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=int(level[-1])))])
    alpha = np.zeros(int(level[-1]))
    upto = np.ones(len(order))  # of each edge, the share of its node's mass up to it
    for t in range(1, len(alive)):
        lo, hi = e_off[level[t]], e_off[level[t + 1]]
        cuts = e_off[level[t] : level[t + 1]] - lo
        many = np.diff(np.append(cuts, hi - lo))
        cand = alpha[froms[lo:hi]] + weights[lo:hi]
        top = np.maximum.reduceat(cand, cuts)
        mass = np.exp(cand - np.repeat(top, many))
        sums = np.add.reduceat(mass, cuts)
        alpha[level[t] : level[t + 1]] = top + np.log(sums)
        run = np.cumsum(mass)
        upto[lo:hi] = (run - np.repeat(run[cuts] - mass[cuts], many)) / np.repeat(sums, many)
    last = e_off[1:] - 1
    depth = np.repeat(np.arange(len(alive)), alive)
    # Backward: all units of the texts at once, one piece a step.
    x = level[length] + unit
    at = starts + 0  # where each unit begins in the texts
    row = mixed(key + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))[doc[starts]]
    count = (starts - first[doc[starts]]).astype(np.uint64)  # with the depth, the counter of random numbers
    out = np.full(n, -1, np.int32)
    while len(x):
        u = (mixed(row + count + depth[x].astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        e = e_off[x]
        todo = np.flatnonzero((upto[e] <= u) & (e < last[x]))
        while len(todo):
            e[todo] += 1
            todo = todo[(upto[e[todo]] <= u[todo]) & (e[todo] < last[x[todo]])]
        x = froms[e]
        d = depth[x]
        out[at + d] = np.where(ids[e] >= 0, ids[e], -2)
        on = np.flatnonzero(d)
        x, at, row, count = x[on], at[on], row[on], count[on]
    put = np.flatnonzero(out != -1)
    got = out[put]
    many = np.where(got >= 0, 1, utf8_len(codes[put]))
    final = np.repeat(got, many)
    owner = np.repeat(doc[put], many)
    if (got < 0).any():
        offs = np.cumsum(many) - many
        for k in np.flatnonzero(got < 0):
            raw = chr(int(codes[put[k]] & np.uint32(0x7FFFFFFF))).encode("utf-8", "surrogatepass")
            final[offs[k] : offs[k] + many[k]] = lattice.pieces.byte_ids[list(raw)]
    return final, owner


def to_codes(text: str) -> np.ndarray:
    """Code points with a blank put before, blanks as BLANK and that character itself as OWN_BLANK."""
    codes = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[codes == BLANK] = OWN_BLANK
    codes[codes == 32] = BLANK
    return codes


def encode(lattice: Lattice, texts: list[str], keys: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Sampled ids of each text; an empty text has none."""
    own = [to_codes(t) if t else np.zeros(0, np.uint32) for t in texts]
    sizes = np.array([len(c) for c in own], np.int64)
    codes = np.concatenate(own) if own else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(own)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if own else sizes
    ids, owner = encode_codes(lattice, codes, doc, keys.astype(np.uint64), first, seed)
    return np.split(ids, np.searchsorted(owner, np.arange(1, len(own)))) if own else []


def decode(lattice: Lattice, ids: np.ndarray) -> str:
    """The text of some ids: pieces joined, byte pieces as UTF-8, blanks restored, the blank put before taken off."""
    ids = np.asarray(ids, np.int64)
    if not len(ids):
        return ""
    byte = lattice.byte_of[ids]
    edges = np.flatnonzero(np.diff((byte >= 0).astype(np.int8))) + 1
    out = []
    for part in np.split(np.arange(len(ids)), edges):
        if byte[part[0]] >= 0:
            out.append(bytes(byte[part].tolist()).decode("utf-8", "surrogatepass"))
        else:
            out.append("".join([lattice.pieces.texts[i] for i in ids[part].tolist()]).replace(chr(BLANK), " "))
    return "".join(out)[1:]


def segment(docs: DataFrame, pieces: Pieces | None = None, *, key: str = "doc_id", text: str = "text", seed: int = 0, also: tuple[str, ...] = ()) -> DataFrame:
    """Every whole text as sampled pieces.

    Columns: doc_id, the columns named in ``also``, ids, n_pieces, n_chars_decoded and lossless (whether
    decoding the ids gave the text back). Null and empty texts have no ids and are lossless. Rows that
    share a key and a text get the same pieces; a null key counts as key -1. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(pieces or Pieces.load()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pickle.loads(sent.value))
        for batch in batches:
            lens = batch.column("__text").cast(pa.large_string()).to_numpy(zero_copy_only=False)
            sizes = np.cumsum([0 if t is None else len(t) + 1 for t in lens])
            at = 0
            while at < len(lens):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, side="right")))
                texts = [t or "" for t in lens[at:end]]
                keys = np.array([-1 if k is None else k for k in batch.column("__key")[at:end].to_pylist()], np.int64)
                ids = encode(lattice, texts, mixed(keys.view(np.uint64)), seed)
                back = [decode(lattice, x) for x in ids]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[at:end] for c in ("doc_id", *also)], pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(np.diff(offsets)), pa.array([len(b) for b in back], pa.int32()), pa.array([a == b for a, b in zip(texts, back, strict=True)])],
                    names=["doc_id", *also, "ids", "n_pieces", "n_chars_decoded", "lossless"],
                )
                at = end

    plain = docs.select(F.col(key).alias("doc_id"), *also, F.col(key).cast("long").alias("__key"), F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[: 1 + len(also)])
    return plain.mapInArrow(run, f"{fields}, ids array<int>, n_pieces int, n_chars_decoded int, lossless boolean")

"""A run-length index of a text: its Burrows-Wheeler transform kept as runs, with text positions sampled at run ends.

Patterns are streamed through it from right to left. While the wanted character continues the run that the
state stands in, the state follows it; else it jumps to the nearest run of that character on either side,
whose sampled position tells how far the match still holds. This gives, for each position of a pattern, the
length of the longest match that starts there (its matching statistics) and a place where the match stands.
The text is made of parts, each closed by END; suffixes are ordered up to the end of their part. Lengths are counted
up to ``order``.
"""

from __future__ import annotations

import numpy as np

END = 0xFF  # never a byte of UTF-8; parts of the text end with it


def words(text: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes from there as a big-endian number; END beyond the end."""
    t = np.concatenate([text, np.full(8, END, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(t, 8)[: len(text)].copy().view(">u8")[:, 0].astype(np.uint64) if len(text) else np.zeros(0, np.uint64)


class RunIndex:
    def __init__(self, text: np.ndarray, order: int) -> None:
        n = len(text)
        self.text, self.order = text, order
        self.words = words(text)
        # Ranks of suffixes by their first 8, 16, ... bytes up to their part's end; alike up to there, by place.
        ends = np.flatnonzero(text == END)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1  # bytes up to the part's end, it included
        keep = np.minimum(left, 8).astype(np.uint64)
        cut = self.words | np.where(keep < 8, (np.uint64(1) << (np.uint64(8) * (np.uint64(8) - keep) % np.uint64(64))) - np.uint64(1), np.uint64(0))
        order = np.argsort(cut)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], cut[order][1:] != cut[order][:-1]]))
        bits = n.bit_length()
        width = 8
        while True:
            second = np.zeros(n, np.int64)
            on = np.flatnonzero(left > width)
            second[on] = rank[on + width] + 1
            if 3 * bits < 64:  # both ranks and the place in one number
                key = np.sort((rank << (2 * bits)) | (second << bits) | np.arange(n))
                rows, key = key & ((1 << bits) - 1), key >> bits
            else:
                rows = np.lexsort((second, rank))
                key = rank[rows] * (n + 1) + second[rows]
            rank[rows] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            width *= 2
            if width >= int(left.max()) or rank[rows[-1]] == n - 1:
                break
        self.rows = rows
        before = text[rows - 1]  # the text's last byte is END, so that the wrap is one
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_start = starts
        self.run_byte = before[starts].astype(np.int64)
        run_len = np.diff(np.append(starts, n))
        self.first_sample = rows[starts]
        self.last_sample = rows[starts + run_len - 1]
        counts = np.bincount(text, minlength=256)
        base = np.concatenate([[0], np.cumsum(counts)[:-1]])
        # Of each run: where its first byte goes to by the LF mapping.
        by_byte = np.argsort(self.run_byte, kind="stable")
        gone = np.cumsum(run_len[by_byte]) - run_len[by_byte]
        first_of = np.concatenate([[0], np.cumsum(np.bincount(self.run_byte, weights=run_len, minlength=256))[:-1]]).astype(np.int64)
        self.to = np.empty(len(starts), np.int64)
        self.to[by_byte] = base[self.run_byte[by_byte]] + gone - first_of[self.run_byte[by_byte]]
        self.run_len = run_len
        self.run_of = np.repeat(np.arange(len(starts), dtype=np.int32), run_len)
        self.by_byte = by_byte
        self.by_key = self.run_byte[by_byte] * (len(starts) + 1) + by_byte

    def groups(self) -> np.ndarray:
        """A number for each place of the text: the same for places whose first ``order`` bytes are the same."""
        prior, here = self.rows[:-1], self.rows[1:]
        new = np.zeros(len(here), bool)
        for step in [*range(0, self.order - 7, 8), *([self.order - 8] if self.order % 8 and self.order > 8 else [])]:
            x, y = np.minimum(prior + step, len(self.text) - 1), np.minimum(here + step, len(self.text) - 1)
            new |= self.words[x] != self.words[y]
        out = np.empty(len(self.rows), np.int64)
        out[self.rows] = np.concatenate([[0], np.cumsum(new)])
        return out

    def shared(self, at: np.ndarray, pattern_words: np.ndarray, place: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How many bytes agree between the text from ``at`` and the pattern from ``place``, up to ``stop`` and the order."""
        out = np.zeros(len(at), np.int64)
        on = np.arange(len(at))
        for step in range(0, self.order, 8):
            x, y = at[on] + step, place[on] + step
            ok = (x < len(self.text)) & (y < len(pattern_words))
            on, x, y = on[ok], x[ok], y[ok]
            differ = self.words[x] ^ pattern_words[y]
            same = differ == 0
            rest = differ[~same]
            # Leading zero bytes, from the place of the highest bit.
            high = np.floor(np.log2(np.maximum(rest >> np.uint64(11), np.uint64(1)).astype(np.float64))).astype(np.int64) + 11
            lead = np.where(rest >> np.uint64(11) > 0, (63 - high) // 8, 6 + (rest < 256).astype(np.int64))
            out[on[~same]] = step + lead
            out[on[same]] = step + 8
            on = on[same]
            if not len(on):
                break
        return np.minimum(np.minimum(out, stop - place), self.order)

    def stream(self, pattern: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of patterns laid end to end: at each place the length (up to the order) and a position in the text."""
        pw = words(pattern)
        length, where = np.zeros(len(pattern), np.int64), np.zeros(len(pattern), np.int64)
        order = np.argsort(-lens, kind="stable")
        ends = (starts + lens)[order]
        lens = lens[order]
        row = np.zeros(len(order), np.int64)
        size = np.zeros(len(order), np.int64)
        spot = np.full(len(order), self.first_sample[0])
        n_runs = len(self.run_start)
        for t in range(1, int(lens[0]) + 1 if len(lens) else 1):
            live = int(np.searchsorted(-lens, -t, side="right"))
            place = ends[:live] - t
            c = pattern[place].astype(np.int64)
            r, s, p = row[:live], size[:live], spot[:live]
            run = self.run_of[r]
            goes = self.run_byte[run] == c
            new_row = self.to[run] + (r - self.run_start[run])
            new_size, new_spot = np.minimum(s + 1, self.order), p - 1
            off = np.flatnonzero(~goes)
            if len(off):
                k = np.searchsorted(self.by_key, c[off] * (n_runs + 1) + run[off])
                prev, nxt = np.maximum(k - 1, 0), np.minimum(k, n_runs - 1)
                prev_run, next_run = self.by_byte[prev], self.by_byte[nxt]
                has_prev = (k > 0) & (self.run_byte[prev_run] == c[off])
                has_next = (k < n_runs) & (self.run_byte[next_run] == c[off])
                up = np.where(has_prev, self.shared(self.last_sample[prev_run], pw, place[off] + 1, ends[off]), -1)
                down = np.where(has_next, self.shared(self.first_sample[next_run], pw, place[off] + 1, ends[off]), -1)
                use_up = up >= down
                best = np.maximum(up, down)
                chosen = np.where(use_up, prev_run, next_run)
                new_row[off] = np.where(best >= 0, self.to[chosen] + np.where(use_up, self.run_len[chosen] - 1, 0), 0)
                new_size[off] = np.minimum(best + 1, self.order)
                new_spot[off] = np.where(best < 0, self.first_sample[0], np.where(use_up, self.last_sample[chosen], self.first_sample[chosen]) - 1)
            row[:live], size[:live], spot[:live] = new_row, new_size, new_spot
            length[place], where[place] = new_size, new_spot
        return length, where

"""A run-length index over a set of byte strings: run-compressed Burrows-Wheeler transform with sampled run ends.

The strings are joined with an end symbol below all bytes and their suffixes sorted by prefix doubling. The transform
is kept as runs: symbol, first row, and how many times the symbol stands before the run. A step from a row to the row
of the suffix one symbol longer (LF) needs nothing else.

All strings stream through the index from their ends at once. Where a row stands inside a run, both its neighbours
are preceded by the same symbol, so the longer suffix matches a neighbour one symbol further than this one does. Only
at the ends of runs, as few as the text is repetitive, are suffixes compared; those lengths are the samples.
"""

from __future__ import annotations

import numpy as np

#: Symbols that the first sort takes at once: nine bits each in one 63-bit number.
FIRST = 7
LEAP = 56


class RunLengthIndex:
    """``longest``: for each position of the joined strings, the longest match with any other position, within its string."""

    def __init__(self, strings: list[bytes]):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(strings) else np.empty(0, np.int64)
        self.lengths = lengths
        symbols = np.zeros(int((lengths + 1).sum()), np.int64)
        keep = np.ones(len(symbols), bool)
        keep[self.begins + lengths] = False
        symbols[keep] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        self.symbols = symbols
        #: symbols before the end of the own string
        self.remaining = np.repeat(self.begins + lengths, lengths + 1) - np.arange(len(symbols))
        self._sort(int(lengths.max(initial=0)) + 1)
        self._runs()

    def _ahead(self, x: np.ndarray, by: int) -> np.ndarray:
        n = len(x)
        return np.concatenate((x[by:], np.zeros(min(by, n), x.dtype))) if by < n else np.zeros(n, x.dtype)

    def _sort(self, depth: int) -> None:
        """``order``: the suffixes' places by rank; each round sorts only those that are not yet told apart."""
        s, n = self.symbols, len(self.symbols)
        two = s << 9 | self._ahead(s, 1)
        four = two << 18 | self._ahead(two, 2)
        self.seven = four << 27 | self._ahead(four, 4) >> 9
        short = np.flatnonzero(self.remaining < FIRST)  # what follows a string's end does not count
        self.seven[short] &= -1 << 9 * (FIRST - self.remaining[short])
        self.order = np.argsort(self.seven)
        self.leap = np.arange(n)
        key, rank, width = self.seven[self.order], np.empty(n, np.int64), FIRST
        rows = np.arange(n)  # those still in groups of several, with their keys
        while n:
            first = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.maximum.accumulate(np.where(first, rows, 0))
            rank[self.order[rows]] = group
            left = ~(first & np.concatenate((first[1:], [True])))
            rows = rows[left]
            if width >= depth or not len(rows):
                break
            own = self.order[rows]
            far = np.minimum(own + width, n - 1)
            key = group[left] << 32 | np.where(self.remaining[own] >= width, rank[far] + 1, 0)
            by_key = np.argsort(key)
            self.order[rows], key = own[by_key], key[by_key]
            width *= 2
            if width == LEAP:
                # equal ranks: ``LEAP`` equal symbols, kept for comparisons
                fresh = np.concatenate(([True], key[1:] != key[:-1]))
                self.leap = rank.copy()
                self.leap[self.order[rows]] = np.maximum.accumulate(np.where(fresh, rows, 0))
        # suffixes that are equal to their strings' ends go by their places, as those one symbol longer then do
        if n and len(rows):
            self.order[rows] = self.order[rows][np.lexsort((self.order[rows], rank[self.order[rows]]))]
        self.rank = rank
        self.rank[self.order] = np.arange(n)

    def _runs(self) -> None:
        n = len(self.order)
        self.longest = np.zeros(n, np.int64)
        if not n:
            return
        before = np.concatenate(([0], self.symbols[:-1]))[self.order]
        first = np.concatenate(([True], before[1:] != before[:-1]))
        self.run_rows = np.flatnonzero(first)
        self.run_symbols = before[self.run_rows]
        run_lengths = np.diff(np.concatenate((self.run_rows, [n])))
        by_symbol = np.argsort(self.run_symbols, kind="stable")
        ahead = np.cumsum(run_lengths[by_symbol]) - run_lengths[by_symbol]
        #: how far a step takes a run's rows: past the suffixes with a smaller symbol and those of this symbol's earlier runs
        self.run_offsets = np.empty(len(self.run_rows), np.int64)
        self.run_offsets[by_symbol] = ahead
        self.run_offsets -= self.run_rows
        self.run_of = (np.cumsum(first) - 1).astype(np.int32)
        self.samples = self._sampled(first)
        self._stream()

    def _sampled(self, first: np.ndarray) -> dict[str, np.ndarray]:
        """The longest match, with either neighbour, of the suffixes at the ends of runs."""
        n, end = len(self.order), self.begins + self.lengths
        last = np.concatenate((first[1:], [True]))
        ends = first | last
        # of the suffixes with those rows and the one symbol more, and of each string's empty suffix
        wanted = np.zeros(n, bool)
        wanted[self.lf(np.flatnonzero(ends))] = wanted[self.rank[end]] = True
        rows = np.flatnonzero(wanted)
        best = np.zeros(len(rows), np.int64)
        at = self.order[rows]
        most = self.remaining[at]
        for by in (-1, 1):
            ok = np.flatnonzero((rows + by >= 0) & (rows + by < n))
            other = self.order[rows[ok] + by]
            best[ok] = np.maximum(best[ok], np.minimum(self.common(at[ok], other), np.minimum(most[ok], self.remaining[other])))
        return {"rows": rows, "lengths": best}

    def lf(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer."""
        return self.run_offsets[self.run_of[rows]] + rows

    def _stream(self) -> None:
        """Each string from its end: a sampled row has its length, any other one what the row before has, and one."""
        order = np.argsort(-self.lengths, kind="stable")
        place = (self.begins + self.lengths)[order]
        rows = self.rank[place]
        running = np.searchsorted(-self.lengths[order], -np.arange(1, int(self.lengths.max(initial=0)) + 1), side="right")
        sampled = np.full(len(self.order), -1, np.int64)
        sampled[self.samples["rows"]] = self.samples["lengths"]
        held = sampled[rows]
        self.longest[place] = held
        for n in running.tolist():
            rows, held, place = self.lf(rows[:n]), held[:n] + 1, place[:n] - 1
            new = sampled[rows]
            held = np.where(new >= 0, new, held)
            self.longest[place] = held

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b; what follows a string's end is for the caller to cut."""
        n, out, live = len(self.symbols), np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            live = live[(x < n) & (y < n) & (self.leap[np.minimum(x, n - 1)] == self.leap[np.minimum(y, n - 1)])]
            out[live] += LEAP
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = (x < n) & (y < n)
            differ = np.where(inside, self.seven[np.minimum(x, n - 1)] ^ self.seven[np.minimum(y, n - 1)], 1 << 62)
            same = differ == 0
            # nine bits a symbol, the first one highest; both halves are exact as floats
            high, low = differ >> 27, differ & ((1 << 27) - 1)
            top = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 27, np.frexp(low.astype(np.float64))[1])
            out[live] += np.where(same, FIRST, (63 - top) // 9)
            live = live[same]
        return out

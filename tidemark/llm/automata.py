"""Count transducers: deterministic acyclic automata over words whose states carry the count of the phrase that leads there.

States lie in layers, one for each phrase length; layer 0 holds the languages. A state is (parent, label, weight), and
states of a layer ascend by (parent, label), as they come out of sorted n-grams.
"""

from __future__ import annotations

import pickle

import numpy as np
import zstandard

#: A language and five words.
DEPTH = 6


def sort_order(windows: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Order of the rows, by ``first`` before all columns; several columns are compared as one number where they fit."""
    keys: list[np.ndarray] = [] if first is None else [first.astype(np.int64)]
    bits = [max(1, int(c.max(initial=0)).bit_length()) for c in windows.T]
    key, used = None, 0
    for column, b in zip(windows.T, bits, strict=True):
        if key is None or used + b > 63:
            if key is not None:
                keys.append(key)
            key, used = column.astype(np.int64), b
        else:
            key, used = key << b | column, used + b
    keys.append(key)
    return np.lexsort(keys[::-1])


def distinct(windows: np.ndarray, counts: np.ndarray, *more: np.ndarray):
    """Sorted rows once each, with the sum of their counts; of ``more`` each first value."""
    if not len(windows):
        return (windows, counts, *more)
    new = np.concatenate(([True], (windows[1:] != windows[:-1]).any(1)))
    at = np.flatnonzero(new)
    return (windows[at], np.add.reduceat(counts, at), *(m[at] for m in more))


class CountAutomaton:
    def __init__(self, langs: list[str], words: list[str], layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """Labels count from 1; ``words[0]`` stands for none."""
        self.langs, self.words, self.layers = langs, words, layers

    @classmethod
    def build(cls, langs: list[str], words: list[str], windows: np.ndarray, counts: np.ndarray, sums: bool = True) -> CountAutomaton:
        """From sorted distinct rows (language, words..., 0 where a row has ended), one after the other.

        With ``sums`` a state's weight is the sum over all rows through it, else the count of the row that ends there.
        """
        layers, index = [], np.zeros(len(windows), np.int64)
        new = np.zeros(len(windows), bool)
        new[:1] = True
        for d in range(windows.shape[1]):
            label = windows[:, d]
            new[1:] |= label[1:] != label[:-1]
            alive = label > 0
            at = np.flatnonzero(new & alive)
            state = np.cumsum(new & alive) - 1
            if sums:
                weight = np.bincount(state[alive], counts[alive], len(at)).astype(np.int64) if counts.sum() < 2**52 else cls._exact(state[alive], counts[alive], len(at))
            else:
                ends = alive & (windows[:, d + 1] == 0 if d + 1 < windows.shape[1] else True)
                weight = np.zeros(len(at), np.int64)
                weight[state[ends]] = counts[ends]
            layers.append((index[at], label[at].astype(np.int64), weight))
            index = state
        return cls(langs, words, layers)

    @staticmethod
    def _exact(state: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.add.at(out, state, counts)
        return out

    @classmethod
    def of_phrases(cls, phrases: list[tuple[str, str, int]], sums: bool = False) -> CountAutomaton:
        """From (language, words joined by spaces, count)."""
        langs, words = sorted({x[0] for x in phrases}), [""] + sorted({w for x in phrases for w in x[1].split(" ") if w})
        lang_of, word_of = {x: k + 1 for k, x in enumerate(langs)}, {w: k for k, w in enumerate(words)}
        windows = np.zeros((len(phrases), DEPTH), np.int64)
        for k, (lang, phrase, _) in enumerate(phrases):
            path = [lang_of[lang], *(word_of[w] for w in phrase.split(" ") if w)]
            windows[k, : len(path)] = path
        order = sort_order(windows)
        return cls.build(langs, words, windows[order], np.array([x[2] for x in phrases], np.int64)[order], sums)

    def paths(self, depth: int, states: np.ndarray) -> np.ndarray:
        """Labels from the first layer to these states of layer ``depth``."""
        out = np.zeros((len(states), DEPTH), np.int64)
        for d in range(depth, -1, -1):
            parent, label, _ = self.layers[d]
            out[:, d] = label[states]
            states = parent[states]
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams it was built from, and their counts: what a state has beyond its children."""
        windows, counts = [], []
        for d, (_, label, weight) in enumerate(self.layers):
            own = weight.copy()
            if d + 1 < len(self.layers):
                parent, _, below = self.layers[d + 1]
                np.subtract.at(own, parent, below)
            at = np.flatnonzero(own > 0)
            windows.append(self.paths(d, at))
            counts.append(own[at])
        return np.concatenate(windows), np.concatenate(counts)

    @classmethod
    def union(cls, parts: list[CountAutomaton]) -> CountAutomaton:
        """Counts of equal phrases add up."""
        lang_of: dict[str, int] = {}
        word_of: dict[str, int] = {"": 0}
        windows, counts = [], []
        for part in parts:
            w, c = part.rows()
            langs = np.array([0] + [lang_of.setdefault(x, len(lang_of) + 1) for x in part.langs], np.int64)
            labels = np.array([word_of.setdefault(x, len(word_of)) for x in part.words], np.int64)
            windows.append(np.column_stack((langs[w[:, 0]], labels[w[:, 1:]])))
            counts.append(c)
        both, n = np.concatenate(windows), np.concatenate(counts)
        order = sort_order(both)
        return cls.build(list(lang_of), list(word_of), *distinct(both[order], n[order]))

    def phrase(self, path: np.ndarray) -> tuple[str, str]:
        return self.langs[path[0] - 1], " ".join([self.words[x] for x in path[1:] if x])

    def lookup(self, paths: list[tuple[str, str]]) -> np.ndarray:
        """Composition with an acceptor of (language, phrase) paths: their weights, 0 where there is no such state."""
        lang_of, word_of = {x: k + 1 for k, x in enumerate(self.langs)}, {w: k for k, w in enumerate(self.words)}
        split = [[lang_of.get(lang, -1), *(word_of.get(w, -1) for w in phrase.split(" ") if w)] for lang, phrase in paths]
        out, state = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
        lengths = np.array([len(p) for p in split], np.int64)
        asked = np.zeros((len(paths), DEPTH), np.int64)
        for k, p in enumerate(split):
            asked[k, : len(p)] = p
        base = max(len(self.words), len(self.langs) + 1) + 1
        for d, (parent, label, weight) in enumerate(self.layers):
            key, want = parent * base + label, state * base + asked[:, d]
            at = np.searchsorted(key, want)
            found = (lengths > d) & (asked[:, d] > 0) & (at < len(key))
            found[found] = key[at[found]] == want[found]
            done = found & (lengths == d + 1)
            out[done] = weight[at[done]]
            lengths = np.where(found, lengths, 0)
            state = np.where(found, at, 0)
        return out

    def to_bytes(self) -> bytes:
        arrays = []
        for parent, label, weight in self.layers:
            for x in (np.diff(parent, prepend=0), np.diff(label, prepend=0), weight):
                small = x.astype(np.int32) if len(x) == 0 or abs(x).max() < 2**31 else x
                arrays.append((small.dtype.str, small.view(np.uint8).reshape(-1, small.itemsize).T.tobytes()))
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((self.langs, "\n".join(self.words), arrays)))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountAutomaton:
        langs, words, arrays = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
        flat = []
        for kind, planes in arrays:
            size = np.dtype(kind).itemsize
            flat.append(np.frombuffer(np.frombuffer(planes, np.uint8).reshape(size, -1).T.tobytes(), kind).astype(np.int64))
        layers = [(np.cumsum(flat[k]), np.cumsum(flat[k + 1]), flat[k + 2]) for k in range(0, len(flat), 3)]
        return cls(langs, words.split("\n"), layers)

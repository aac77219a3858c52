"""A small gated recurrent network with a class-factored softmax, in numpy: truncated backpropagation and batched scoring.

A symbol's probability is that of its class times that of its place within the class, both given the state.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass(frozen=True)
class Layout:
    """Classes of symbols: the first one holds one symbol, then ``shared`` of ``places`` symbols each, then single ones."""

    classes: int
    shared: int
    places: int

    @property
    def symbols(self) -> int:
        return self.classes + self.shared * (self.places - 1)

    @property
    def start(self) -> int:
        """Stands before a document's first symbol."""
        return self.symbols

    def class_and_place(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each symbol; symbols are numbered by class and place."""
        sizes = np.ones(self.classes, np.int64)
        sizes[1 : 1 + self.shared] = self.places
        first = np.cumsum(sizes) - sizes
        classes = np.repeat(np.arange(self.classes), sizes)
        return classes, np.arange(self.symbols) - first[classes]


@dataclass
class Gru:
    """``embed`` (symbols + 1, 3 hidden): what the symbol before adds to the gates; ``words``, ``word_bias``: the places."""

    embed: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def new(cls, layout: Layout, counts: np.ndarray, hidden: int, seed: int = 7) -> Gru:
        """Small random weights; the biases give each symbol its share in ``counts``."""
        r = np.random.default_rng(seed)
        f = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        classes, places = layout.class_and_place()
        of_class = np.bincount(classes, counts, layout.classes) + 1.0
        in_class = np.ones((layout.shared, layout.places))
        own = (classes >= 1) & (classes <= layout.shared)
        in_class[classes[own] - 1, places[own]] += counts[own]
        return cls(
            f(layout.symbols + 1, 3 * hidden),
            f(hidden, 3 * hidden),
            f(hidden, layout.classes),
            np.log(of_class / of_class.sum()).astype(np.float32),
            f(layout.shared, layout.places, hidden),
            np.log(in_class / in_class.sum(axis=1, keepdims=True)).astype(np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def unflat(self, values: np.ndarray) -> Gru:
        out, at = [], 0
        for p in self.parameters():
            out.append(values[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Gru(*out)

    def step(self, before: np.ndarray, h: np.ndarray) -> tuple:
        """The new state and what the backward pass needs."""
        n = h.shape[1]
        x, g = self.embed[before], h @ self.recur
        gates = _sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
        r, z = gates[:, :n], gates[:, n:]
        c = np.tanh(x[:, 2 * n :] + r * g[:, 2 * n :])
        return c + z * (h - c), (r, z, c, g[:, 2 * n :])

    def log_probabilities(self, h: np.ndarray) -> np.ndarray:
        """Of the classes."""
        s = h @ self.out + self.bias
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    def place_scores(self, h: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Scores of the places in the given shared classes (from 0), one row for each state."""
        return np.matmul(self.words[shared], h[:, :, None])[:, :, 0] + self.word_bias[shared]


class Trainer:
    """Adam on windows of ``window`` steps over lanes of documents.

    The state goes on from window to window and begins anew with each document; gradients stop at a window's beginning.
    """

    def __init__(self, net: Gru, layout: Layout, window: int = 16):
        self.net, self.layout, self.window = net, layout, window
        self.classes, self.places = layout.class_and_place()
        self.momentum = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
        self.at = 0

    def run(self, documents: list[np.ndarray], lanes: int, rate: float) -> None:
        """One pass over the documents, each lane taking the next one when it is through, longest first."""
        documents = sorted((d for d in documents if len(d)), key=len, reverse=True)
        if not documents:
            return
        start, lanes = self.layout.start, min(lanes, len(documents))
        streams: list[list[np.ndarray]] = [[] for _ in range(lanes)]
        held = np.zeros(lanes, np.int64)
        for d in documents:
            k = int(held.argmin())
            streams[k].append(d)
            held[k] += len(d)
        steps = int(held.max())
        before, target = np.full((steps, lanes), start), np.full((steps, lanes), -1)
        for k, mine in enumerate(streams):
            target[: held[k], k] = np.concatenate(mine)
            before[: held[k], k] = np.concatenate([np.concatenate(([start], d[:-1])) for d in mine])
        h = np.zeros((lanes, self.net.recur.shape[0]), np.float32)
        for first in range(0, steps, self.window):
            grads, h = self.gradients(before[first : first + self.window], target[first : first + self.window], h)
            self.at += 1
            pace = rate * np.sqrt(1 - 0.999**self.at) / (1 - 0.9**self.at)
            for p, g, (m, v) in zip(self.net.parameters(), grads, self.momentum, strict=True):
                np.clip(g, -1, 1, out=g)
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(p.dtype)

    def gradients(self, before: np.ndarray, target: np.ndarray, h: np.ndarray):
        """Gradients of the mean loss over one window, and the state at its end."""
        net, start, shared = self.net, self.layout.start, self.layout.shared
        n, kept = h.shape[1], []
        d_embed, d_recur, d_out, d_bias, d_words, d_word_bias = (np.zeros_like(p) for p in net.parameters())
        share = np.float32(1 / max(1, int((target >= 0).sum())))
        for b, t in zip(before, target, strict=True):
            old = np.where((b == start)[:, None], np.float32(0), h)
            h, inner = net.step(b, old)
            there = t >= 0
            of_class, of_place = self.classes[np.maximum(t, 0)], self.places[np.maximum(t, 0)]
            p = np.exp(net.log_probabilities(h))
            p[np.arange(len(t)), of_class] -= 1
            p *= there[:, None] * share
            who = np.flatnonzero(there & (of_class >= 1) & (of_class <= shared))
            k = of_class[who] - 1
            q = net.place_scores(h[who], k)
            q = np.exp(q - q.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(who)), of_place[who]] -= 1
            q *= share
            kept.append((b, old, h, inner, p, who, k, q))
        back = np.zeros_like(h)
        for b, old, new, (r, z, c, gc), p, who, k, q in reversed(kept):
            d_out += new.T @ p
            d_bias += p.sum(axis=0)
            dh = p @ net.out.T + back
            if len(who):
                np.add.at(d_words, k, q[:, :, None] * new[who][:, None, :])
                np.add.at(d_word_bias, k, q)
                dh[who] += np.einsum("np,nph->nh", q, net.words[k])
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (old - c) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            dx = np.concatenate((dr, dz, dc), axis=1)
            dg = np.concatenate((dr, dz, dc * r), axis=1)
            np.add.at(d_embed, b, dx)
            d_recur += old.T @ dg
            back = dg @ net.recur.T + dh * z
            back[b == start] = 0
        return [d_embed, d_recur, d_out, d_bias, d_words, d_word_bias], h


def log10_likelihoods(net: Gru, layout: Layout, symbols: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document, the sum over its symbols of log10 P(symbol | what came before).

    Documents go in step, longest first, so that those still running are a prefix; each one's state is carried from
    its first symbol to its last.
    """
    classes, places = layout.class_and_place()
    order = np.argsort(-lengths, kind="stable")
    begin, length = begins[order], lengths[order]
    total = np.zeros(len(order))
    h = np.zeros((len(order), net.recur.shape[0]), np.float32)
    before = np.full(len(order), layout.start)
    running = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
    for t, n in enumerate(running.tolist()):
        h, _ = net.step(before[:n], h[:n])
        now = symbols[begin[:n] + t]
        of_class = classes[now]
        s = h @ net.out
        s += net.bias
        picked = s[np.arange(n), of_class]
        np.exp(s, out=s)  # the weights are small enough to do without a shift
        total[:n] += picked - np.log(s.sum(axis=1))
        who = np.flatnonzero((of_class >= 1) & (of_class <= layout.shared))
        if len(who):
            q = net.place_scores(h[who], of_class[who] - 1)
            picked = q[np.arange(len(who)), places[now[who]]]
            total[who] += picked - np.log(np.exp(q).sum(axis=1))
        before = now
    out = np.empty(len(order))
    out[order] = total / np.log(10)
    return out

"""Boosted trees by histograms, with signs that a feature's effect is held to.

Features are cut into bins at quantile edges once, and rows are packed into blocks of bytes, a line for each feature. A level of a
round is one pass: every task adds up residuals by (model, node, feature, bin), Spark adds up the tasks' sums, and the driver
chooses splits from that table, whose size depends on the trees and the bins alone. All models over one table (the folds of a
cross-fit, a baseline on fewer features) grow in the same passes. Blocks hold the residuals of all models; a round's trees are taken
off them in the next round's first pass, and every ``KEEP`` rounds they are written, so that what a lost block costs is bounded.

Signs: a split whose values run against its feature's sign is refused, and the values below it are held to
either side of the middle of its two values, so that no later split can cross it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.sources.shared import shared_dir, written

BINS = 64
KEEP = 50
#: Bytes of sums that the driver takes at once.
AT_ONCE = 16_000_000


@dataclass
class Tree:
    """Node k is a leaf with ``value[k]`` where ``feature[k]`` is -1; else bins up to ``cut[k]`` go to ``left[k]``, others to the next node."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    count: list[int] = field(default_factory=lambda: [0])

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf; ``x`` has a line of bins for each feature."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        own, n = np.arange(len(feature)), x.shape[1]
        depth = np.zeros(len(feature), int)
        for k in own[feature >= 0]:  # a node comes before those below it
            depth[left[k] : left[k] + 2] = depth[k] + 1
        # a leaf leads to itself
        start, cut, left = np.where(feature < 0, 0, feature * n), np.where(feature < 0, 2**30, cut), np.where(feature < 0, own, left)
        flat, row, node = x.ravel(), np.arange(n), np.zeros(n, np.int64)
        for _ in range(depth.max()):
            node = left.take(node) + (flat.take(start.take(node) + row) > cut.take(node))
        return node

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        return self.nodes(np.ascontiguousarray(bins.T))

    def score(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.node_of(bins)]


@dataclass
class Boosted:
    """Sum of a base value and of trees over binned features."""

    features: tuple[str, ...]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def score(self, values: np.ndarray) -> np.ndarray:
        return self.score_bins(np.ascontiguousarray(binned(values, self.edges).T))

    def score_bins(self, bins: np.ndarray) -> np.ndarray:
        """``bins``: a line for each feature."""
        out = np.full(bins.shape[1], self.base)
        for tree in self.trees:
            out += np.array(tree.value)[tree.nodes(bins)]
        return out

    def column(self, values: str | None = None) -> Column:
        """The prediction from the features' columns, or from one column with an array of their values."""
        model = self

        def run(values: pa.Array) -> pa.Array:
            return pa.array(model.score(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(model.features))), pa.float64())

        return F.arrow_udf(run, DoubleType())(F.col(values) if values else vector(self.features))

    def states(self, changes: Sequence[dict[str, Column]]) -> Column:
        """The predictions of a row with each of the ``changes`` in place of its own values; it goes to Python once, with the new values beside it."""
        model = self
        at = [(k, model.features.index(f)) for k, change in enumerate(changes) for f in change if f in model.features]
        new = [known(c) for change in changes for f, c in change.items() if f in model.features] or [F.lit(0.0)]
        n, wide = len(changes), len(new)

        def run(values: pa.Array, changed: pa.Array) -> pa.Array:
            own, to = (v.flatten().to_numpy(zero_copy_only=False).reshape(-1, w) for v, w in ((values, len(model.features)), (changed, wide)))
            bins = np.ascontiguousarray(binned(own, model.edges).T)
            out = np.empty((len(own), n))
            for k in range(n):
                x = bins.copy()
                for j, (state, f) in enumerate(at):
                    if state == k:
                        x[f] = binned(to[:, [j]], [model.edges[f]])[:, 0]
                out[:, k] = model.score_bins(x)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n), pa.int32()), pa.array(out.ravel()))

        return F.arrow_udf(run, ArrayType(DoubleType()))(vector(model.features), F.array(*new))


def known(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(float("nan")))


def vector(features: Sequence[str]) -> Column:
    return F.array(*(known(F.col(f)) for f in features))


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin 0 is for unknown values; bin k has what is over k - 1 edges."""
    out = np.zeros(values.shape, np.int16)
    for k, e in enumerate(edges):
        known = ~np.isnan(values[:, k])
        out[known, k] = np.searchsorted(e, values[known, k], side="left") + 1
    return out


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Inner edges between bins, one pass for all features."""
    at = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    found = df.agg(*(F.percentile_approx(F.col(f).cast("double"), at, 100 * bins).alias(f"e{k}") for k, f in enumerate(features))).first()
    return [np.unique(np.array(found[f"e{k}"] or [], float)) for k in range(len(features))]


@dataclass(frozen=True)
class Growth:
    rounds: int = 250
    rate: float = 0.05
    leaves: int = 24
    depth: int = 6
    least: int = 60
    penalty: float = 1.0


def best_split(n: np.ndarray, g: np.ndarray, usable: np.ndarray, signs: np.ndarray, low: float, high: float, growth: Growth):
    """(gain, feature, cut, left value, right value, left n, right n) of a node's histograms (feature x bin), or None.

    Of equal gains the first feature and the lowest cut count.
    """
    left_n, left_g = n.cumsum(1)[:, :-1], g.cumsum(1)[:, :-1]
    all_n, all_g = n.sum(1, keepdims=True), g.sum(1, keepdims=True)
    right_n, right_g = all_n - left_n, all_g - left_g
    value = lambda s, m: np.clip(s / (m + growth.penalty), low, high)
    vl, vr = value(left_g, left_n), value(right_g, right_n)
    loss = lambda s, m, v: -2 * v * s + (m + growth.penalty) * v * v
    gain = loss(all_g, all_n, value(all_g, all_n)) - loss(left_g, left_n, vl) - loss(right_g, right_n, vr)
    sign = signs[:, None]
    ok = usable[:, None] & (left_n >= growth.least) & (right_n >= growth.least) & ((vr - vl) * sign >= 0) & (gain > 1e-9 * max(1.0, float(abs(all_g).max())))
    if not ok.any():
        return None
    f, cut = np.unravel_index(int(np.where(ok, gain, -np.inf).argmax()), gain.shape)
    return float(gain[f, cut]), int(f), int(cut), float(vl[f, cut]), float(vr[f, cut]), int(left_n[f, cut]), int(right_n[f, cut])


#: (bins, a line for each feature; fold; residuals, a line for each model) of some rows.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def start_blocks(data: DataFrame, width: int, hidden: Sequence[int]) -> tuple[list[float], RDD]:
    """(each model's base value, the blocks with what it leaves). ``hidden``: the fold that each model must not see."""

    def parts(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(row.x, np.uint8 if len(row.x) * 8 == width * len(row.y) else np.uint16).reshape(width, -1), np.frombuffer(row.fold, np.int32), np.frombuffer(row.y)

    def sums(rows: Iterator) -> Iterator[tuple[int, np.ndarray]]:
        for _, fold, y in map(parts, rows):
            for f in np.unique(fold):
                yield int(f), np.array([(fold == f).sum(), y[fold == f].sum(), 1 / len(np.unique(fold))])

    of = data.rdd.mapPartitions(sums).reduceByKey(np.add, 1).collectAsMap()
    blocks = round(sum(s[2] for s in of.values()))
    seen = [sum((s for f, s in of.items() if f != h), np.zeros(3)) for h in hidden]
    bases = [float(s / max(1, n)) for n, s, _ in seen]

    def block(row) -> Block:
        x, fold, y = parts(row)
        return x, fold, y - np.array(bases)[:, None]

    # packed rows are so small that a scan has them in a few partitions
    spread = max(data.rdd.getNumPartitions(), data.sparkSession.sparkContext.defaultParallelism)
    return bases, data.repartition(max(1, min(blocks, spread))).rdd.map(block)


def advanced(trees: Sequence[Tree]):
    """Takes a round's trees off the residuals."""

    def run(block: Block) -> Block:
        x, fold, left = block
        return x, fold, np.stack([r - np.array(tree.value)[tree.nodes(x)] for tree, r in zip(trees, left, strict=True)])

    return run


def histograms(trees: Sequence[Tree], open_nodes: Sequence[Sequence[int]], models: Sequence[tuple[int, np.ndarray]], most: int):
    """A task's (model, its open nodes' numbers of rows and sums of residuals by node, feature and bin)."""
    slots = []
    for tree, nodes in zip(trees, open_nodes, strict=True):
        slot = np.full(len(tree.value), len(nodes))  # rows of other nodes and of the hidden fold go to one more, which is dropped
        slot[list(nodes)] = np.arange(len(nodes))
        slots.append(slot * most)

    def run(blocks: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        sums = {k: np.zeros((2, len(models[k][1]), (len(nodes) + 1) * most)) for k, nodes in enumerate(open_nodes) if nodes}
        for x, fold, left in blocks:
            for k, found in sums.items():
                hidden, usable = models[k]
                at = slots[k].take(trees[k].nodes(x))
                at[fold == hidden] = found.shape[2] - most
                for f in np.flatnonzero(usable):
                    bins = at + x[f]
                    found[0, f] += np.bincount(bins, minlength=found.shape[2])
                    found[1, f] += np.bincount(bins, left[k], minlength=found.shape[2])
        for k, found in sums.items():
            yield k, found[:, :, :-most]

    return run


def added_up(parts: RDD, size: int) -> dict[int, np.ndarray]:
    """The tasks' sums of each model; a task gives ``size`` bytes. Few of them are added up in the driver, more of them before."""
    if parts.getNumPartitions() * size > AT_ONCE:
        parts = parts.reduceByKey(np.add, 8)
    out: dict[int, np.ndarray] = {}
    for k, found in parts.collect():
        out[k] = out[k] + found if k in out else found
    return out


def grow(data: DataFrame, edges: list[np.ndarray], models: Sequence[tuple[int, np.ndarray]], signs: np.ndarray, growth: Growth) -> tuple[list[float], list[list[Tree]]]:
    """(bases, trees) of every model. ``data``: ``binned_rows``; a model is (the fold it must not see, its features)."""
    width, most, m = len(edges), max((len(e) for e in edges), default=0) + 2, len(models)
    spark = data.sparkSession
    bases, held = start_blocks(data, width, [fold for fold, _ in models])
    first = [int(np.flatnonzero(usable)[0]) for _, usable in models]
    done: list[list[Tree]] = [[] for _ in models]
    for turn in range(growth.rounds):
        before = held
        if turn:
            held = held.map(advanced([trees[-1] for trees in done]))
        held.persist(StorageLevel.MEMORY_AND_DISK)
        trees = [Tree() for _ in models]
        bounds = [{0: (-np.inf, np.inf)} for _ in models]
        for level in range(growth.depth):
            # a tree with all its leaves asks for nothing
            bounds = [b if growth.leaves > t.feature.count(-1) else {} for b, t in zip(bounds, trees, strict=True)]
            if not any(bounds):
                break
            sums = added_up(held.mapPartitions(histograms(trees, [list(b) for b in bounds], models, most)), sum(map(len, bounds)) * 16 * width * most)
            if not level and before is not held:
                before.unpersist()
            for k, tree in enumerate(trees):
                if not bounds[k]:
                    continue
                n, g = sums[k].reshape(2, width, -1, most).swapaxes(1, 2) if k in sums else np.zeros((2, len(bounds[k]), width, most))
                if level == 0:
                    tree.count[0] = int(n[0, first[k]].sum())
                    tree.value[0] = float(g[0, first[k]].sum() / (tree.count[0] + growth.penalty) * growth.rate)
                found = {}
                for at, (node, (low, high)) in enumerate(bounds[k].items()):
                    if split := best_split(n[at], g[at], models[k][1], signs, low, high, growth):
                        found[node] = split
                room = growth.leaves - tree.feature.count(-1)
                nexts = {}
                for node, (_, f, cut, vl, vr, nl, nr) in sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[: max(0, room)]:
                    low, high = bounds[k][node]
                    tree.feature[node], tree.cut[node], tree.left[node] = f, cut, len(tree.value)
                    tree.feature += [-1, -1]
                    tree.cut += [0, 0]
                    tree.left += [0, 0]
                    tree.value += [vl * growth.rate, vr * growth.rate]
                    tree.count += [nl, nr]
                    mid = (vl + vr) / 2
                    a, b = ((low, high), (low, high)) if not signs[f] else ((low, mid), (mid, high)) if signs[f] > 0 else ((mid, high), (low, mid))
                    nexts[tree.left[node]], nexts[tree.left[node] + 1] = a, b
                bounds[k] = nexts
        for k, tree in enumerate(trees):
            done[k].append(tree)
        if turn % KEEP == KEEP - 1 and turn + 1 < growth.rounds:
            path = f"{shared_dir(spark)}/boosting-{uuid.uuid4().hex}"
            held.saveAsPickleFile(path, 1)
            held.unpersist()
            held = spark.sparkContext.pickleFile(path)
    held.unpersist()
    return bases, done


def binned_rows(df: DataFrame, edges: list[np.ndarray], features: Sequence[str], target: str, fold: str | None = None) -> DataFrame:
    """(x, fold, y), written: the bytes of a batch of rows' bins, folds and targets; rows without a target do not count."""
    fold_of = F.col(fold).cast("int") if fold else F.lit(0)
    kind = np.uint8 if max((len(e) for e in edges), default=0) < 255 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = binned(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features)), edges).T.astype(kind, "C")
                y, of = (batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in ((1, float), (2, np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, of, y)], names=["x", "fold", "y"])

    use = df.where(F.col(target).isNotNull()).select(vector(features), F.col(target).cast("double"), fold_of)
    return written(use.mapInArrow(run, "x binary, fold binary, y binary"), "binned")


def sign_vector(features: Sequence[str], signs: dict[str, int]) -> np.ndarray:
    return np.array([signs.get(f, 0) for f in features])


def fit(df: DataFrame, features: Sequence[str], target: str, signs: dict[str, int] | None = None, growth: Growth = Growth(), edges: list[np.ndarray] | None = None) -> Boosted:
    """One model over all rows with a target."""
    edges = quantile_edges(df, features) if edges is None else edges
    data = binned_rows(df, edges, features, target)
    bases, trees = grow(data, edges, [(-1, np.ones(len(features), bool))], sign_vector(features, signs or {}), growth)
    return Boosted(tuple(features), edges, bases[0], trees[0])


def cross_fit(
    dealt: DataFrame, features: Sequence[str], target: str, k: int, signs: dict[str, int] | None = None, growth: Growth = Growth(), baseline: Sequence[str] = ()
) -> tuple[Boosted, list[Boosted], list[Boosted]]:
    """(the model of all rows, the models that did not see each fold, the same on the ``baseline`` features alone), grown together.

    ``dealt`` has a column ``fold``.
    """
    edges = quantile_edges(dealt, features)
    data = binned_rows(dealt, edges, features, target, "fold")
    every, few = np.ones(len(features), bool), np.array([f in baseline for f in features])
    wanted = [(-1, every)] + [(fold, every) for fold in range(k)] + ([(fold, few) for fold in range(k)] if baseline else [])
    bases, trees = grow(data, edges, wanted, sign_vector(features, signs or {}), growth)
    made = [Boosted(tuple(features), edges, b, t) for b, t in zip(bases, trees, strict=True)]
    return made[0], made[1 : k + 1], made[k + 1 :]


def by_fold(models: Sequence[Boosted]) -> Column:
    """Each row's prediction by the model that did not see its ``fold``."""

    def run(values: pa.Array, folds: pa.Array) -> pa.Array:
        x, fold = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(models[0].features)), folds.to_numpy(zero_copy_only=False)
        out = np.zeros(len(fold))
        for k, model in enumerate(models):
            mine = fold == k
            out[mine] = model.score(x[mine])
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, DoubleType())(vector(models[0].features), F.col("fold"))

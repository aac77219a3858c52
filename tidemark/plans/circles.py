"""Where the next circle, or the last one, falls: candidates, raster features, cross-fitted map memory, and a ladder of models.

A state is one circle change with its candidates, packed into one row: the truth first, then the candidates. All models (rungs and
folds) are fitted together; a Newton step is one pass in which tasks add up gradients and Hessians, whose size depends on the
number of features alone. Land, heights and memory are rasters over the map: their size is bounded by its area.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window

from tidemark.functions import stats as T
from tidemark.operators.spatial import land_map
from tidemark.sources.shared import written

#: Cells in cm, candidates, the share of a forecast's best part, blur in cells, the disc's share and margin.
CELL, N_DISK, N_RING, N_END, TOP, SIGMA, END_SHARE, END_MARGIN, FOLDS, PENALTY = 2500.0, 200, 72, 250, 0.25, 6.0, 0.975, 1.05, 5, 2.0
MOST_CELLS = 4_000_000
GOLDEN = float(np.pi * (3 - np.sqrt(5)))
HISTORY = ("turn1", "turn1sq", "turn2", "drift", "home")
RUNGS = {
    "one_step": ("edge", "edge2", "turn1", "turn1sq", "inward", "centre", "on_land", "land", "height"),
    "history": ("edge", "edge2", *HISTORY, "inward", "centre", "on_land", "land", "height"),
    "memory": ("edge", "edge2", *HISTORY, "inward", "centre", "on_land", "land", "height", "prior"),
    "shuffled": ("edge", "edge2", *(f"s_{h}" for h in HISTORY), "inward", "centre", "on_land", "land", "height"),
}
END_RUNGS = {"rules": ("dist", "dist2"), "full": ("dist", "dist2", "turn1", "drift", "home", "inward", "centre", "on_land", "land", "height", "prior")}
STATE = ["match_id", "phase"]


# ---- the map ----------------------------------------------------------------------------------------------------


@dataclass
class Raster:
    """Land and known heights by cell, with sums along each row of cells."""

    x0: int
    y0: int
    land: np.ndarray
    height: np.ndarray

    def __post_init__(self):
        along = lambda a: np.concatenate((np.zeros((len(a), 1)), np.cumsum(a, 1)), 1)
        known = ~np.isnan(self.height)
        self.sums = [along(self.land.astype(float)), along(np.nan_to_num(self.height)), along(known.astype(float))]
        j, i = np.nonzero(self.land)
        self.cx, self.cy = ((i.mean() + self.x0 + 0.5) * CELL, (j.mean() + self.y0 + 0.5) * CELL) if len(i) else (0.0, 0.0)

    def cell(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.floor(x / CELL).astype(np.int64) - self.x0, np.floor(y / CELL).astype(np.int64) - self.y0
        return i, j, (i >= 0) & (j >= 0) & (i < self.land.shape[1]) & (j < self.land.shape[0])

    def on_land(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i, j, ok = self.cell(x, y)
        out = np.zeros(len(x))
        out[ok] = self.land[j[ok], i[ok]]
        return out

    def disk(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of land, mean known height) of the cells whose row's middle line has them within ``r``: two lookups for each row of a disk."""
        cells, land, high, known = (np.zeros(len(x)) for _ in range(4))
        first, last = np.floor((y - r) / CELL).astype(np.int64), np.floor((y + r) / CELL).astype(np.int64)
        for k in range(int((last - first).max(initial=-1)) + 1):
            row = first + k
            up = (row + 0.5) * CELL - y
            use = (row <= last) & (np.abs(up) <= r)
            w = np.sqrt(np.maximum(r * r - up * up, 0.0))
            a, b = np.floor((x - w) / CELL).astype(np.int64), np.floor((x + w) / CELL).astype(np.int64) + 1
            cells += np.where(use, b - a, 0)
            j = row - self.y0
            use &= (j >= 0) & (j < self.land.shape[0])
            j = np.clip(j, 0, self.land.shape[0] - 1)
            a, b = (np.clip(c - self.x0, 0, self.land.shape[1]) for c in (a, b))
            for total, s in zip((land, high, known), self.sums, strict=True):
                total += np.where(use, s[j, b] - s[j, a], 0.0)
        return land / np.maximum(cells, 1), np.where(known > 0, high / np.maximum(known, 1), np.nan)


def raster(ground: DataFrame) -> Raster:
    """From cells (cx, cy, ground): land is the closed mask. The map's cells come to the driver; over ``MOST_CELLS`` is an error."""
    cells = land_map(ground).join(ground, ["cx", "cy"], "left").select("cx", "cy", "ground").toPandas()
    if not len(cells):
        return Raster(0, 0, np.zeros((1, 1), bool), np.full((1, 1), np.nan))
    x0, y0 = int(cells["cx"].min()), int(cells["cy"].min())
    shape = int(cells["cy"].max()) - y0 + 1, int(cells["cx"].max()) - x0 + 1
    if shape[0] * shape[1] > MOST_CELLS:
        raise ValueError(f"a map of {shape[0]} x {shape[1]} cells: are its positions right?")
    land, height = np.zeros(shape, bool), np.full(shape, np.nan)
    at = (cells["cy"].to_numpy() - y0, cells["cx"].to_numpy() - x0)
    land[at], height[at] = True, cells["ground"].to_numpy(float)
    return Raster(x0, y0, land, height)


def blurred(grid: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian blur along both axes, mirrored at the edges."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(grid, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], "symmetric")
        grid = np.apply_along_axis(np.convolve, axis, padded, kernel, "valid")
    return grid


# ---- states and candidates --------------------------------------------------------------------------------------


def histories(pulls: DataFrame) -> DataFrame:
    """Each circle change after the first, with what was known before it: the circles before and the pulls between them."""
    p = pulls.where("next_x is not null and next_y is not null and next_r is not null")
    by = Window.partitionBy("match_id").orderBy("phase")
    last = F.last(F.struct("next_x", "next_y", "next_r", "phase")).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lag = lambda c, k: F.lag(c, k).over(by)
    h = p.select(
        *STATE, F.when(F.col("kind") == "moving", "moving").otherwise("shrinking").alias("kind") if "kind" in p.columns else F.lit("shrinking").alias("kind"),
        "next_x", "next_y", "next_r", (F.row_number().over(by) - 1).alias("k"), lag("next_x", 1).alias("cx"), lag("next_y", 1).alias("cy"), lag("next_r", 1).alias("cr"), lag("next_x", 2).alias("c2x"), lag("next_y", 2).alias("c2y"),
        lag("next_x", 3).alias("c3x"), lag("next_y", 3).alias("c3y"), F.first("next_x").over(by).alias("fx"), F.first("next_y").over(by).alias("fy"), lag("phase", 1).alias("now"), last.alias("last"),
    )
    h = h.withColumns({"p1x": F.col("cx") - F.col("c2x"), "p1y": F.col("cy") - F.col("c2y"), "p2x": F.col("c2x") - F.col("c3x"), "p2y": F.col("c2y") - F.col("c3y")})
    drift = F.when(F.col("k") >= 2, F.col("cx") - F.col("fx")), F.when(F.col("k") >= 2, F.col("cy") - F.col("fy"))
    return h.where("k >= 1").withColumns({"dx": drift[0], "dy": drift[1], "hx": F.col("fx") - F.col("cx"), "hy": F.col("fy") - F.col("cy")}).drop("c2x", "c2y", "c3x", "c3y", "fx", "fy")


def with_donors(h: DataFrame, seed: int = 7) -> DataFrame:
    """Beside each state's history that of another state of the same number, the next one by a keyed hash (its own if there is no other)."""
    most = h.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    share = F.pmod(F.xxhash64("match_id", F.lit(seed)), F.lit(max(1, most // 1000)))  # about a thousand to a ring
    key = F.struct(F.xxhash64("match_id", "k", F.lit(seed + 1)).alias("h"), F.col("match_id").alias("m"))
    ring = Window.partitionBy("k", "_share").orderBy("_key")
    own = F.struct("p1x", "p1y", "p2x", "p2y", "dx", "dy", "hx", "hy")
    first = F.first(own).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return h.withColumns({"_share": share, "_key": key}).withColumn("s", F.coalesce(F.lead(own).over(ring), first)).drop("_share", "_key")


def candidates(h: DataFrame, disk: int = N_DISK, ring: int = N_RING) -> DataFrame:
    """Each state's true centre (alt 0) and its candidates, evenly spread: over the allowed disk for a shrinking circle (a
    sunflower's seeds), at the true distance all around otherwise."""
    n = F.when(F.col("kind") == "shrinking", disk).otherwise(ring)
    c = h.withColumn("alt", F.explode(F.sequence(F.lit(0), n)))
    i = F.col("alt") - F.lit(0.5)
    away = F.sqrt((F.col("next_x") - F.col("cx")) * (F.col("next_x") - F.col("cx")) + (F.col("next_y") - F.col("cy")) * (F.col("next_y") - F.col("cy")))
    rho = F.when(F.col("kind") == "shrinking", F.greatest(F.col("cr") - F.col("next_r"), F.lit(1.0)) * F.sqrt(i / disk)).otherwise(away)
    angle = F.when(F.col("kind") == "shrinking", i * GOLDEN).otherwise(i * (2 * np.pi) / ring)
    at = lambda true, centre, f: F.when(F.col("alt") == 0, F.col(true)).otherwise(F.col(centre) + rho * f(angle))
    return c.withColumns({"px": at("next_x", "cx", F.cos), "py": at("next_y", "cy", F.sin)})


def end_candidates(h: DataFrame, n: int = N_END) -> DataFrame:
    """M-09: states whose truth is the match's last centre, with candidates over a disc that holds it in 97.5 % of the states of the same phase."""
    e = h.where("k >= 2").withColumns({"next_x": F.col("last.next_x"), "next_y": F.col("last.next_y"), "next_r": F.col("last.next_r"), "kind": F.lit("end")})
    e = e.withColumn("far", F.sqrt((F.col("next_x") - F.col("cx")) * (F.col("next_x") - F.col("cx")) + (F.col("next_y") - F.col("cy")) * (F.col("next_y") - F.col("cy"))))
    radius = e.groupBy("now").agg((F.percentile("far", F.lit(END_SHARE)) * END_MARGIN).alias("reach"))
    e = e.join(radius, "now").withColumn("alt", F.explode(F.sequence(F.lit(0), F.lit(n))))
    i = F.col("alt") - F.lit(0.5)
    rho, angle = F.greatest("reach", F.lit(1.0)) * F.sqrt(i / n), i * GOLDEN
    at = lambda true, centre, f: F.when(F.col("alt") == 0, F.col(true)).otherwise(F.col(centre) + rho * f(angle))
    return e.withColumns({"px": at("next_x", "cx", F.cos), "py": at("next_y", "cy", F.sin)})


def _cos(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine between two directions, 0 where one of them has no length or is unknown."""
    return F.coalesce(F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)), F.lit(0.0))


def features(cand: DataFrame, land: Raster) -> DataFrame:
    """M-06: the thirteen features but ``prior``, and the history's five with the donor's history (``s_``). Height is held against the candidates' mean."""
    vx, vy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    dist, cr = F.sqrt(vx * vx + vy * vy), F.greatest("cr", F.lit(1.0))
    tx, ty = F.lit(land.cx) - F.col("cx"), F.lit(land.cy) - F.col("cy")
    hypot = lambda a, b: F.sqrt(a * a + b * b)
    kind = StructType([StructField(n, DoubleType()) for n in ("on_land", "land", "height")])

    def over(x: pd.Series, y: pd.Series, r: pd.Series) -> pd.DataFrame:
        a, b, c = (v.to_numpy(float) for v in (x, y, r))
        share, high = land.disk(a, b, c)
        return pd.DataFrame({"on_land": land.on_land(a, b), "land": share, "height": high / 1000})

    over.__annotations__ = {"x": pd.Series, "y": pd.Series, "r": pd.Series, "return": pd.DataFrame}
    edge = F.when(F.col("kind") == "shrinking", F.least(dist / F.greatest(F.col("cr") - F.col("next_r"), F.lit(1.0)), F.lit(1.5))).otherwise(0.0)
    c = cand.withColumn("_m", F.pandas_udf(over, kind)("px", "py", "next_r"))
    own = {f: F.col(f) for f in ("p1x", "p1y", "p2x", "p2y", "dx", "dy", "hx", "hy")}
    other = {f: F.col(f"s.{f}") for f in own}

    def history(h: dict[str, Column], name: str) -> dict[str, Column]:
        turn = _cos(vx, vy, h["p1x"], h["p1y"])
        home = (hypot(vx - h["hx"], vy - h["hy"]) - hypot(h["hx"], h["hy"])) / cr
        return {f"{name}turn1": turn, f"{name}turn1sq": turn * turn, f"{name}turn2": _cos(vx, vy, h["p2x"], h["p2y"]), f"{name}drift": _cos(vx, vy, h["dx"], h["dy"]), f"{name}home": home}

    c = c.withColumns(
        {
            "edge": edge, "edge2": edge * edge, **history(own, ""), **history(other, "s_"), "inward": _cos(vx, vy, tx, ty), "centre": (hypot(F.col("px") - land.cx, F.col("py") - land.cy) - hypot(tx, ty)) / cr,
            **({"dist": dist / F.greatest("reach", F.lit(1.0)), "dist2": (dist / F.greatest("reach", F.lit(1.0))) ** 2} if "reach" in cand.columns else {}),
        }
    )
    mean = F.avg(F.when(F.col("alt") > 0, F.nanvl("_m.height", F.lit(None).cast("double")))).over(Window.partitionBy(*STATE))
    return c.withColumns({"on_land": F.col("_m.on_land"), "land": F.col("_m.land"), "height": F.coalesce(F.nanvl("_m.height", F.lit(None).cast("double")) - mean, F.lit(0.0))}).drop("_m")


# ---- map memory -------------------------------------------------------------------------------------------------


def memory(centres: DataFrame, land: Raster, folds: int) -> dict:
    """Blurred counts of centres on the map: {(fold, half, old, zone): grid}. ``centres``: fold, half, old, zone, x, y."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    rows = centres.groupBy("fold", "half", "old", "zone", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n")).toPandas()
    out = {}
    for key, part in rows.groupby(["fold", "half", "old", "zone"]):
        grid = np.zeros(land.land.shape)
        i, j = part["cx"].to_numpy() - land.x0, part["cy"].to_numpy() - land.y0
        ok = (i >= 0) & (j >= 0) & (i < grid.shape[1]) & (j < grid.shape[0])
        np.add.at(grid, (j[ok], i[ok]), part["n"].to_numpy(float)[ok])
        out[tuple(int(k) for k in key)] = blurred(grid).astype(np.float32)
    return out


def known_density(grids: dict, zone: int, own: tuple[int, int, int], model: int, folds: int, held: dict) -> np.ndarray | None:
    """Log density on the map, from the matches a model may know: not its fold (or only old ones, model ``folds``), and for a
    state it learns from only the other half of these. ``held`` keeps those found so far: a few for each zone and model."""
    fold, half, old = own
    learns = old == 1 if model == folds else fold != model
    key = zone, model, half if learns else None
    if key not in held:
        use = [g for (f, h, o, z), g in grids.items() if z == zone and (o == 1 if model == folds else f != model) and not (learns and h == half)]
        grid = np.sum(use, axis=0) if use else None
        held[key] = None if grid is None else np.log(grid / max(grid.sum(), 1e-9) + 1e-7)
    return held[key]


def prior(grids: dict, land: Raster, zone: int, own: tuple[int, int, int], model: int, folds: int, x: np.ndarray, y: np.ndarray, held: dict | None = None) -> np.ndarray:
    """Log density at points, less its mean over the candidates."""
    density = known_density(grids, zone, own, model, folds, {} if held is None else held)
    if density is None:
        return np.zeros(len(x))
    i, j, _ = land.cell(x, y)
    at = density[np.clip(j, 0, density.shape[0] - 1), np.clip(i, 0, density.shape[1] - 1)]
    return at - at[1:].mean()


# ---- fitting all models together --------------------------------------------------------------------------------


def packed(cand: DataFrame, names: Sequence[str], grids: dict, land: Raster, folds: int, zone_of: str) -> DataFrame:
    """One row for each state: x has its rows of features, the truth first; the last folds + 1 columns are each model's prior."""
    each = F.struct("alt", F.array(*(F.col(n).cast("double") for n in names), F.col("px"), F.col("py")).alias("v"))
    s = cand.groupBy(*STATE, "kind", "fold", "half", "old", F.col(zone_of).cast("long").alias("zone")).agg(F.sort_array(F.collect_list(each)).alias("rows"))
    s = s.select(*STATE, "kind", "fold", "half", "old", "zone", F.size("rows").alias("n"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("v"))
    width = len(names) + 2
    schema = pa.schema([("x", pa.list_(pa.float64())), ("at", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            xs, ats = [], []
            own = zip(*(batch.column(c).to_pylist() for c in ("fold", "half", "old")), strict=True)
            for v, zone, o in zip(batch.column("v"), batch.column("zone").to_pylist(), own, strict=True):
                a = v.values.to_numpy(zero_copy_only=False).reshape(-1, width)
                priors = [prior(grids, land, zone, o, m, folds, a[:, -2], a[:, -1], held) for m in range(folds + 1)]
                xs.append(np.column_stack((a[:, :-2], *priors)).ravel())
                ats.append(a[:, -2:].ravel())
            keep = [batch.column(c) for c in (*STATE, "kind", "fold", "old", "n")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(xs, schema.field(0).type), pa.array(ats, schema.field(1).type)], names=[*STATE, "kind", "fold", "old", "n", "x", "at"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select(*STATE, "kind", "fold", "old", "n").schema) + ", x array<double>, at array<double>"
    return written(s.mapInArrow(run, ddl), "states")


@dataclass(frozen=True)
class Model:
    """A rung and the fold it must not see; fold ``folds`` knows the old matches only."""

    rung: str
    fold: int
    columns: tuple[int, ...]


def models_of(rungs: dict[str, Sequence[str]], names: Sequence[str], folds: int, fresh: bool = True) -> list[Model]:
    return [Model(r, f, tuple(len(names) + f if n == "prior" else list(names).index(n) for n in use)) for r, use in rungs.items() for f in range(folds + fresh)]


def _states(batch: pa.RecordBatch) -> Iterator[tuple]:
    for row in zip(batch.column("kind").to_pylist(), batch.column("fold").to_pylist(), batch.column("old").to_pylist(), batch.column("n").to_pylist(), batch.column("x"), strict=True):
        yield (*row[:3], row[4].values.to_numpy(zero_copy_only=False).reshape(row[3], -1))


def _learns(m: Model, fold: int, old: int, folds: int) -> bool:
    return old == 1 if m.fold == folds else fold != m.fold


#: States of one kind and size that are taken together.
TOGETHER = 128


def _alike(batch: pa.RecordBatch, width: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, folds, old, x as states x rows x features) of states with as many rows, ``TOGETHER`` at most."""
    kind, fold, old, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "fold", "old", "n"))
    for which in np.unique(kind):
        for size in np.unique(n[kind == which]):
            alike = np.flatnonzero((kind == which) & (n == size))
            for k in range(0, len(alike), TOGETHER):
                at = alike[k : k + TOGETHER]
                yield which, fold[at], old[at], batch.column("x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size, width)


def summed_derivatives(x: np.ndarray, w: np.ndarray, learns: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, gradient, negative Hessian) of the first rows' choice among all rows, over the states that count."""
    u = x @ w
    u -= u.max(1, keepdims=True)
    p = np.exp(u)
    total = p.sum(1)
    p *= (learns / total)[:, None]
    weighted = x * p[:, :, None]
    mean = weighted.sum(1)
    d = x.shape[2]
    return float(learns @ (u[:, 0] - np.log(total))), learns @ x[:, 0] - mean.sum(0), weighted.reshape(-1, d).T @ x.reshape(-1, d) - mean.T @ mean


def derivatives(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The same of one state."""
    return summed_derivatives(x[None], w, np.ones(1))


def fit(states: DataFrame, models: Sequence[Model], kinds: Sequence[str], folds: int, penalty: float = PENALTY, steps: int = 15):
    """(scales, weights of each model and kind): Newton steps with half of the step wherever the likelihood fell."""
    width = states.select(F.size("x") / F.col("n")).first()
    if width is None:
        return np.zeros((2, 0)), {}
    width = int(width[0])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a, b = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            for *_, x in _states(batch):
                n, a, b = n + len(x) - 1, a + x[1:].sum(0), b + (x[1:] ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([a.tolist()]), pa.array([b.tolist()])], names=["n", "a", "b"])

    parts = states.mapInArrow(moments, "n long, a array<double>, b array<double>").select("n", F.posexplode(F.arrays_zip("a", "b")).alias("k", "s"))
    m = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s.a").alias("a"), F.sum("s.b").alias("b")).orderBy("k").toPandas()
    mean = (m["a"] / m["n"].clip(lower=1)).to_numpy()
    scale = np.array([mean, np.sqrt(np.maximum(m["b"] / m["n"].clip(lower=1) - mean**2, 0)) + 1e-6])
    keys = [(i, k) for i in range(len(models)) for k in kinds]
    weights = {key: np.zeros(len(models[key[0]].columns)) for key in keys}
    best: dict = {}

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for kind, fold, old, x in _alike(batch, width):
                z, chosen = (x - scale[0]) / scale[1], {}
                for i, model in enumerate(models):
                    learns = (old == 1 if model.fold == folds else fold != model.fold).astype(float)
                    if (i, kind) in weights and learns.any():
                        if model.columns not in chosen:  # the folds of a rung read the same columns
                            chosen[model.columns] = np.ascontiguousarray(z[:, :, model.columns])
                        ll, g, h = summed_derivatives(chosen[model.columns], weights[i, kind], learns)
                        s = sums.setdefault((i, kind), [0.0, np.zeros(len(g)), np.zeros(h.shape)])
                        s[0], s[1], s[2] = s[0] + ll, s[1] + g, s[2] + h
        rows = [(i, kind, k, v) for (i, kind), (ll, g, h) in sums.items() for k, v in enumerate(np.concatenate(([ll], g, h.ravel())))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=["model", "kind", "k", "v"])

    for _ in range(steps):
        got = states.mapInArrow(derived, "model long, kind string, k long, v double").groupBy("model", "kind", "k").agg(F.sum("v").alias("v")).toPandas()
        moved = 0.0
        for key, part in got.groupby(["model", "kind"]):
            v = part.sort_values("k")["v"].to_numpy()
            w = weights[key]
            d = len(w)
            gain = v[0] - penalty / 2 * w @ w
            if key in best and gain < best[key][0] - 1e-9:  # went too far
                weights[key] = (w + best[key][1]) / 2
                moved = 1.0
                continue
            best[key] = (gain, w)
            step = np.linalg.solve(v[1 + d :].reshape(d, d) + penalty * np.eye(d), v[1 : 1 + d] - penalty * w)
            weights[key] = w + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-5:
            break
    return scale, weights


def judged(states: DataFrame, models: Sequence[Model], scale: np.ndarray, weights: dict, folds: int) -> DataFrame:
    """M-07: (rung, test, match_id, phase, kind, beaten, top_quarter, bits, error_m) of every state by the models that did not learn from it.

    ``test`` is fold or fresh; ``error_m`` is the distance from the best candidate to the truth.
    """
    ddl = f"rung string, test string, match_id {dict(states.dtypes)['match_id']}, phase {dict(states.dtypes)['phase']}, kind string, beaten double, top_quarter boolean, bits double, error_m double"
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for match, phase, at, (kind, fold, old, x) in zip(batch.column("match_id").to_pylist(), batch.column("phase").to_pylist(), batch.column("at"), _states(batch), strict=True):
                z, place = (x - scale[0]) / scale[1], at.values.to_numpy(zero_copy_only=False).reshape(-1, 2)
                for i, m in enumerate(models):
                    if (i, kind) not in weights or _learns(m, fold, old, folds):
                        continue
                    u = z[:, m.columns] @ weights[i, kind]
                    beaten = float(((u[1:] < u[0]).sum() + 0.5 * (u[1:] == u[0]).sum()) / max(1, len(u) - 1))
                    log = u[0] - u.max() - np.log(np.exp(u - u.max()).sum())
                    miss = place[1 + int(u[1:].argmax())] - place[0]
                    out.append((m.rung, "fresh" if m.fold == folds else "fold", match, phase, kind, beaten, beaten >= 1 - TOP, float((log + np.log(len(u))) / np.log(2)), float(np.hypot(*miss) / 100)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return states.mapInArrow(run, ddl)


def _dealt(h: DataFrame, matches: DataFrame, folds: int, seed: int) -> DataFrame:
    """With ``fold``, ``half`` and ``old`` (not of the newest fifth by date) of each match."""
    m = T.folds(matches.select("match_id", F.coalesce(F.unix_date(F.col("match_date").try_cast("date")), F.lit(0)).alias("_date")), "match_id", folds, seed)
    cut = m.agg(F.expr("percentile_disc(0.8) within group (order by _date)").alias("_cut"))
    m = m.crossJoin(F.broadcast(cut)).select("match_id", "fold", F.pmod(F.xxhash64("match_id", F.lit(seed + 5)), F.lit(2)).cast("int").alias("half"), (F.col("_date") < F.col("_cut")).cast("int").alias("old"))
    return h.join(m, "match_id")


@dataclass(frozen=True)
class Fitted:
    """States with candidates, and the models fitted to them; ``judge`` holds each state against the models that did not learn from it."""

    states: DataFrame
    models: list[Model]
    scale: np.ndarray
    weights: dict
    folds: int

    def judge(self) -> DataFrame:
        return judged(self.states, self.models, self.scale, self.weights, self.folds)

    def inside(self, rung: str, spots: DataFrame) -> DataFrame:
        """(match_id, phase, id, p_in): the chance that a spot lies in the coming circle, by the rung's model that never saw the match.

        ``spots``: match_id, phase, id, x, y and next_r, at most a lobby's players to a state. Spots without a state are left out;
        one without a place has no chance (null).
        """
        own = {m.fold: (i, m) for i, m in enumerate(self.models) if m.rung == rung}
        scale, weights = self.scale, self.weights
        each = F.collect_list(F.struct("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("spots")
        held = spots.groupBy(*STATE).agg(F.max("next_r").cast("double").alias("next_r"), each)
        kinds = dict(self.states.dtypes)
        of_state = f"match_id {kinds['match_id']}, phase {kinds['phase']}"

        def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for kind, fold, _, x in _states(batch):
                    i, m = own[fold]
                    u = ((x[1:] - scale[0]) / scale[1])[:, m.columns] @ weights[i, kind]
                    p = np.exp(u - u.max())
                    found.append(p / p.sum())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in STATE), pa.array(found, pa.list_(pa.float64())), batch.column("at")], names=[*STATE, "p", "at"])

        # the candidates' chances and places meet the spots, their features stay behind
        both = self.states.mapInArrow(chances, f"{of_state}, p array<double>, at array<double>").join(held, STATE)
        ddl = f"{of_state}, id {dict(spots.dtypes)['id']}, p_in double"
        schema = to_arrow_schema(_parse_datatype_string(ddl))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                rest = (batch.column(c).to_pylist() for c in (*STATE, "next_r", "spots"))
                for match, phase, r, there, chance, at in zip(*rest, batch.column("p"), batch.column("at"), strict=True):
                    p, place = chance.values.to_numpy(zero_copy_only=False), at.values.to_numpy(zero_copy_only=False).reshape(-1, 2)[1:]
                    for s in there:
                        known = s["x"] is not None and s["y"] is not None
                        out.append((match, phase, s["id"], float(p[np.hypot(place[:, 0] - s["x"], place[:, 1] - s["y"]) <= r].sum()) if known else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        return both.mapInArrow(run, ddl)


def best_rung(results: DataFrame) -> str:
    """The rung with the most bits out of fold; without any state the first one. The control is none."""
    rungs = [r for r in RUNGS if r != "shuffled"]
    top = results.where((F.col("test") == "fold") & F.col("rung").isin(rungs)).groupBy("rung").agg(F.avg("bits").alias("bits")).orderBy(F.desc("bits"), "rung").first()
    return top.rung if top else rungs[0]


def fitted_ladder(pulls: DataFrame, matches: DataFrame, land: Raster, folds: int = FOLDS, seed: int = 7, disk: int = N_DISK, ring: int = N_RING) -> Fitted:
    """M-08: every rung, and the control with histories from other matches, for every fold and for the old matches."""
    h = written(_dealt(with_donors(histories(pulls), seed), matches, folds, seed), "histories")
    names = sorted({n for use in RUNGS.values() for n in use if n != "prior"})
    grids = memory(h.select("fold", "half", "old", F.col("phase").cast("long").alias("zone"), F.col("next_x").alias("x"), F.col("next_y").alias("y")), land, folds)
    states = packed(features(candidates(h, disk, ring), land), names, grids, land, folds, "phase")
    models = models_of(RUNGS, names, folds)
    return Fitted(states, models, *fit(states, models, ("shrinking", "moving"), folds), folds)


def ladder(pulls: DataFrame, matches: DataFrame, land: Raster, folds: int = FOLDS, seed: int = 7, disk: int = N_DISK, ring: int = N_RING) -> DataFrame:
    """M-08: the rungs, and the control, out of fold and on the newest matches."""
    return fitted_ladder(pulls, matches, land, folds, seed, disk, ring).judge()


def endgame(pulls: DataFrame, matches: DataFrame, land: Raster, folds: int = FOLDS, seed: int = 11, n: int = N_END) -> DataFrame:
    """M-09: the last centre forecast from every phase, by the game's distances alone and in full; ``error_m`` of the best guess."""
    h = written(_dealt(with_donors(histories(pulls), seed), matches, folds, seed), "histories")
    names = sorted({f for use in END_RUNGS.values() for f in use if f != "prior"})
    last = h.where("phase = last.phase").select("fold", "half", "old", F.lit(0).cast("long").alias("zone"), F.col("next_x").alias("x"), F.col("next_y").alias("y"))
    grids = memory(last, land, folds)
    cand = features(end_candidates(h, n), land).withColumn("zone", F.lit(0))
    states = packed(cand, names, grids, land, folds, "zone")
    models = models_of(END_RUNGS, names, folds, fresh=False)
    scale, weights = fit(states, models, ("end",), folds)
    return judged(states, models, scale, weights, folds)


def ladder_table(results: DataFrame) -> DataFrame:
    return results.groupBy("rung", "test").agg(F.count("*").alias("n"), F.avg("beaten").alias("beaten"), F.avg(F.col("top_quarter").cast("double")).alias("top_quarter"), F.avg("bits").alias("bits"), F.avg("error_m").alias("error_m"))

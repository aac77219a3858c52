"""Neighbours within a group, nearest of a small table, counts on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.geometry import CM


def neighbour_pairs(points: DataFrame, group: Sequence[str], ident: str, radius_m: float, team: str | None = None) -> DataFrame:
    """(group, ident, other, dist_m) of points of one group at most ``radius_m`` apart, of other teams where given.

    Points meet through grid cells as wide as the radius, each one going to its own cell and to four of those around it, so
    that a crowded group costs its close pairs only; each pair found gives both of its rows. Null positions have no neighbours.
    """
    cell = radius_m * CM
    use = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*group, ident, "x", "y", *([team] if team else []))
    cx, cy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    # of two cells side by side, one looks into the other
    around = [F.struct((cx + i).alias("cx"), (cy + j).alias("cy"), F.lit((i, j) == (0, 0)).alias("own")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))]
    a = use.withColumn("_to", F.explode(F.array(*around))).withColumns({"_cx": F.col("_to.cx"), "_cy": F.col("_to.cy"), "_own": F.col("_to.own")}).drop("_to")
    b = use.select(
        *group, cx.alias("_cx"), cy.alias("_cy"), F.col(ident).alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"),
        *([F.col(team).alias("_team")] if team else []),
    )
    dist = F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2) / CM
    # by sorting: packed pairs and cells look small enough to go through the driver
    met = a.join(b.hint("merge"), [*group, "_cx", "_cy"]).withColumn("dist_m", dist).where((F.col("dist_m") <= radius_m) & F.when(F.col("_own"), F.col(ident) < F.col("other")).otherwise(F.col(ident) != F.col("other")))
    if team:
        met = met.where(~F.col(team).eqNullSafe(F.col("_team")))
    sides = F.explode(F.array(F.struct(F.col(ident).alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col(ident).alias("b"))))
    return met.select(*group, "dist_m", sides.alias("_s")).select(*group, F.col("_s.a").alias(ident), F.col("_s.b").alias("other"), "dist_m")


def neighbour_counts(points: DataFrame, group: Sequence[str], ident: str, radii_m: Sequence[float], team: str | None = None) -> DataFrame:
    """Each point with ``near_{r}`` for each radius and ``nearest_m`` among those in the largest; zero and null without any."""
    pairs = neighbour_pairs(points, group, ident, max(radii_m), team)
    found = pairs.groupBy(*group, ident).agg(
        *(F.count_if(F.col("dist_m") <= r).alias(f"near_{int(r)}") for r in radii_m), F.min("dist_m").alias("nearest_m")
    )
    return points.join(found.hint("merge"), [*group, ident], "left").fillna(0, subset=[f"near_{int(r)}" for r in radii_m])


#: A grid of places is halved until it has about as many cells as places, at most so often.
MOST_HALVINGS = 12


def place_cells(places: DataFrame, limit_m: float) -> tuple[DataFrame, int]:
    """((cx, cy, name, px, py): the places that may be the nearest of some point in a cell, of ``limit_m`` / 2 ** halvings; halvings).

    Cells are halved from the limit's width on. A half keeps a place of its whole cell if that one's nearest edge is no
    farther away than the farthest corner is from some other place, and within the limit; a cell keeps a dozen, however many
    places there are.
    """
    cell = limit_m * CM
    own = places.where("x is not null and y is not null").groupBy(F.col("x").alias("px"), F.col("y").alias("py")).agg(F.min("name").alias("name"))
    grid = lambda c, side: F.floor(F.col(c) / side)
    n, occupied = own.agg(F.count("*"), F.approx_count_distinct(F.struct(grid("px", cell), grid("py", cell)))).first()
    halvings = 0
    while halvings < MOST_HALVINGS and occupied * 4**halvings < n:
        halvings += 1
    around = lambda steps: F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps)))

    def kept(df: DataFrame, side: float) -> DataFrame:
        """Of the places beside a cell those that can be nearest somewhere in it; equally far ones stay."""
        lo = lambda c: F.col(c) * F.lit(side)
        off = lambda c, p: F.greatest(lo(c) - F.col(p), F.col(p) - lo(c) - side, F.lit(0.0))
        far = lambda c, p: F.greatest(F.abs(lo(c) - F.col(p)), F.abs(lo(c) + side - F.col(p)))
        root = lambda f: F.sqrt(f("cx", "px") ** 2 + f("cy", "py") ** 2)
        bound = F.min(root(far)).over(Window.partitionBy("cx", "cy"))
        near = df.withColumn("_near", root(off)).where(F.col("_near") <= cell * (1 + 1e-9))
        return near.withColumn("_bound", bound).where(F.col("_near") <= F.col("_bound") * (1 + 1e-9) + 1e-6).drop("_near", "_bound")

    held = own.select("name", "px", "py", around((-1, 0, 1)).alias("_o")).select((grid("px", cell) + F.col("_o.i")).alias("cx"), (grid("py", cell) + F.col("_o.j")).alias("cy"), "name", "px", "py")
    held = kept(held, cell)
    for k in range(1, halvings + 1):
        held = held.select(around((0, 1)).alias("_o"), "*").select((2 * F.col("cx") + F.col("_o.i")).alias("cx"), (2 * F.col("cy") + F.col("_o.j")).alias("cy"), "name", "px", "py")
        held = kept(held, cell / 2**k)
    return held, halvings


def nearest_place(points: DataFrame, places: DataFrame, limit_m: float, otherwise: str = "Unnamed area") -> DataFrame:
    """Each point with the nearest place's name and distance within the limit; ties go to the smaller name.

    A point looks up the few places that may be the nearest in its cell (``place_cells``).
    """
    held, halvings = place_cells(places, limit_m)
    side = limit_m * CM / 2**halvings
    held = held.groupBy(F.col("cx").alias("_cx"), F.col("cy").alias("_cy")).agg(F.collect_list(F.struct("name", "px", "py")).alias("_places"))

    def d(p: Column) -> Column:
        return F.sqrt((F.col("x") - p["px"]) ** 2 + (F.col("y") - p["py"]) ** 2) / CM

    best = F.array_min(F.transform("_places", lambda p: F.struct(d(p).alias("m"), p["name"].alias("name"))))
    met = (F.col("_cx") == F.floor(F.col("x") / side)) & (F.col("_cy") == F.floor(F.col("y") / side))
    out = points.join(held, met, "left").withColumn("_best", best)
    near = F.col("_best.m") <= limit_m
    return out.select(
        *points.columns,
        F.coalesce(F.when(near, F.col("_best.name")), F.lit(otherwise)).alias("place"),
        F.when(near, F.col("_best.m")).alias("place_m"),
    )


def grid_density(points: DataFrame, cell_m: float, least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    cell = cell_m * CM
    return (
        points.where("x is not null and y is not null")
        .groupBy(*by, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )


def land_map(cells: DataFrame, rounds: int = 2) -> DataFrame:
    """(cx, cy, known) of a land mask closed by ``rounds`` dilations and as many erosions of 3 x 3 cells, with the mask itself."""
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    mask = cells.select("cx", "cy").distinct()
    grown = mask
    step = lambda df: df.select("cx", "cy", around.alias("_o")).select(
        (F.col("cx") + F.col("_o.i")).alias("cx"), (F.col("cy") + F.col("_o.j")).alias("cy")
    )
    for _ in range(rounds):
        grown = step(grown).distinct()
    for _ in range(rounds):
        grown = step(grown).groupBy("cx", "cy").count().where("count = 9").select("cx", "cy")
    known = mask.withColumn("known", F.lit(True))
    return grown.unionByName(mask).distinct().join(known, ["cx", "cy"], "left").fillna(False, subset=["known"])


def blurred_density(cells: DataFrame, sigma: float = 6.0, reach: int = 24, floor: float = 1e-7) -> DataFrame:
    """Log of the Gaussian-blurred share of ``n`` in each cell, one axis after the other."""
    import math

    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    kernel = F.explode(
        F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in zip(range(-reach, reach + 1), weights, strict=True)))
    )
    out = cells.select("cx", "cy", F.col("n").cast("double").alias("n"))
    for axis, other in (("cx", "cy"), ("cy", "cx")):
        out = (
            out.select("cx", "cy", "n", kernel.alias("_k"))
            .groupBy((F.col(axis) + F.col("_k.k")).alias(axis), other)
            .agg(F.sum(F.col("n") * F.col("_k.w")).alias("n"))
        )
    mass = cells.agg(F.sum("n").cast("double").alias("_mass"))
    return out.crossJoin(F.broadcast(mass)).select("cx", "cy", F.log(F.col("n") / F.col("_mass") + floor).alias("log_density"))

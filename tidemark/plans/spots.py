"""Spots to hold: how many rotating enemies a spot can tag on its outward side, how dangerous it is, and the best one.

A spot on a grid is met from the samples: each one names the rows and columns of the grid within its reach, and what they see of
a team at one height is added up before their own height is looked up. Any other spot meets samples through a grid of cells a third of the tagging range wide. Of the 49 cells around it, it reads those that its
outward half reaches into and those within the dangerous distance, never the samples behind it or out of range. Counts are kept
by the samples' team, so that each team's own view is the total without its own part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geometry as G
from tidemark.plans import detect as D
from tidemark.sources.shared import written

CM = G.CM
#: Metres, cm/s, cm, spots along a side, and the phases in which bases are built.
DANGER_M, RUN_SPEED, HIGH_GROUND, FACING, GRID, GRID_INSIDE, PHASES, LEAST_HOLD_S = 30.0, 250.0, 1500.0, 0.3, 28, 0.92, (2, 5), 10.0
LANE_STEP_CM, LANE_DEPTH, LANE_GRID, LANE_INSIDE, LANE_BAND_M, NEARLY = 1000.0, 0.15, 30, 0.9, (20.0, 80.0), 0.9
LAND_CELL_CM, LAND_LEAST, LAND_QUANTILE, LAND_SPEED = 2500.0, 2, 0.2, 300.0
RINGS = 3
KEY = ["match_id", "phase"]


def holds(t: D.Tables, phases: tuple[int, int] = PHASES) -> DataFrame:
    """Each phase's hold: from its circle's appearance to the start of its shrink."""
    appear = F.lag("finish_shrink_t").over(Window.partitionBy("match_id").orderBy("phase"))
    z = t.zones.withColumn("appear", appear).where((F.col("start_shrink_t") - F.col("appear") >= LEAST_HOLD_S) & F.col("phase").between(*phases))
    return z.select(*KEY, F.col("next_x").alias("zx"), F.col("next_y").alias("zy"), F.col("next_r").alias("zr"), "appear", F.col("start_shrink_t").alias("until"))


def with_velocity(positions: DataFrame) -> DataFrame:
    """``vx`` and ``vy`` in cm/s, from the sample before where the table has none; unknown is 0."""
    if {"vx", "vy"} <= set(positions.columns):
        return positions.fillna(0.0, subset=["vx", "vy"])
    by = Window.partitionBy("match_id", "id").orderBy("t")
    speed = lambda c: F.coalesce(F.try_divide(F.col(c) - F.lag(c).over(by), F.col("t") - F.lag("t").over(by)), F.lit(0.0))
    return positions.withColumns({"vx": speed("x"), "vy": speed("y")})


def hold_samples(t: D.Tables, hold: DataFrame) -> DataFrame:
    """Samples of living humans within each hold, with ``rotating``: running, and outside the next circle or heading into it."""
    own = D.humans(t).select("match_id", "id", "team_index", "death_t")
    p = with_velocity(t.positions).drop("team_index").join(own, ["match_id", "id"]).where("death_t is null or t < death_t")
    s = p.join(hold, "match_id").where("t between appear and until")
    cx, cy = F.col("zx") - F.col("x"), F.col("zy") - F.col("y")
    far, speed = F.sqrt(cx * cx + cy * cy), F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    heading = (F.col("vx") * cx + F.col("vy") * cy) / (speed * far + 1e-9) > 0.5
    return s.select(*KEY, "team_index", "x", "y", "z", ((speed >= RUN_SPEED) & ((far > F.col("zr")) | heading)).alias("rotating"), F.lit(True).alias("dangerous"))


def ground(t: D.Tables) -> DataFrame:
    """(cx, cy, ground): the lower heights of 25 m cells before the first shrink, where two samples or more stood or walked."""
    first = t.zones.groupBy("match_id").agg(F.min("start_shrink_t").alias("_first"))
    p = t.positions.join(first, "match_id").where("t < _first")
    if t.landings is not None:
        p = p.join(t.landings.select("match_id", "id", "land_t"), ["match_id", "id"]).where("t >= land_t")
    if "vz" in t.positions.columns:
        p = p.where(F.abs(F.coalesce("vz", F.lit(0.0))) < LAND_SPEED)
    cell = lambda c: F.floor(F.col(c) / LAND_CELL_CM)
    return p.groupBy(cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n"), F.percentile("z", F.lit(LAND_QUANTILE)).alias("ground")).where(F.col("n") >= LAND_LEAST).drop("n")


def grid_spots(hold: DataFrame, side: int = GRID, inside: float = GRID_INSIDE) -> DataFrame:
    """Spots on a square grid over each next circle, numbered row by row."""
    at = lambda k: F.lit(-1.0) + F.lit(2.0) * k / F.lit(float(side - 1))
    s = hold.withColumn("spot", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
    gx, gy = at(F.col("spot") % side), at(F.floor(F.col("spot") / side))
    s = s.where(gx * gx + gy * gy <= inside)
    return s.select(*KEY, F.col("spot").cast("long").alias("spot"), (F.col("zx") + gx * F.col("zr")).alias("x"), (F.col("zy") + gy * F.col("zr")).alias("y"), "zx", "zy")


def at_ground(spots: DataFrame, land: DataFrame, own: Column | None = None) -> DataFrame:
    """Spots with height ``z``: the ground's; the median of their circle's where unknown, 0 if all are; no lower than ``own``."""
    cell = lambda c: F.floor(F.col(c) / LAND_CELL_CM)
    s = spots.withColumns({"cx": cell("x"), "cy": cell("y")}).join(land, ["cx", "cy"], "left").drop("cx", "cy")
    usual = s.groupBy(*KEY).agg(F.median("ground").alias("_usual"))
    z = F.coalesce("ground", "_usual", F.lit(0.0))
    return s.join(usual, KEY).withColumn("z", z if own is None else F.greatest(z, own)).drop("ground", "_usual")


def spot_counts(spots: DataFrame, samples: DataFrame, low: float, high: float) -> DataFrame:
    """(match_id, phase, spot, team_index, tag, danger): what each spot sees of each team, where it sees any of it."""
    side = high * CM / RINGS
    ox, oy = F.col("x") - F.col("zx"), F.col("y") - F.col("zy")

    def reads(c: Column) -> Column:
        """Whether a spot has to read a cell: near enough, and not all of it behind."""
        bx, by = (F.floor(F.col("x") / side) + c["i"]) * side, (F.floor(F.col("y") / side) + c["j"]) * side
        dx, dy = F.greatest(bx - F.col("x"), F.col("x") - bx - side, F.lit(0.0)), F.greatest(by - F.col("y"), F.col("y") - by - side, F.lit(0.0))
        ahead = F.greatest((bx - F.col("x")) * ox, (bx + side - F.col("x")) * ox) + F.greatest((by - F.col("y")) * oy, (by + side - F.col("y")) * oy)
        far = F.sqrt(dx * dx + dy * dy) / CM
        return (far <= DANGER_M) | ((far <= high) & (ahead > 0))

    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-RINGS, RINGS + 1) for j in range(-RINGS, RINGS + 1)))
    a = spots.withColumn("_c", F.explode(F.filter(around, reads)))
    a = a.select("*", (F.floor(F.col("x") / side) + F.col("_c.i")).alias("_cx"), (F.floor(F.col("y") / side) + F.col("_c.j")).alias("_cy")).drop("_c", *(["team_index"] if "team_index" in spots.columns else []))
    b = samples.where("rotating or dangerous").select(*KEY, "team_index", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez"), "rotating", "dangerous", F.floor(F.col("x") / side).alias("_cx"), F.floor(F.col("y") / side).alias("_cy"))
    m = a.join(b, [*KEY, "_cx", "_cy"])
    dx, dy = F.col("ex") - F.col("x"), F.col("ey") - F.col("y")
    d = F.sqrt(dx * dx + dy * dy) / CM
    facing = (dx * ox + dy * oy) / (d * 100 * (F.sqrt(ox * ox + oy * oy) + 1e-9) + 1e-9) > FACING
    seen = F.col("rotating") & (d >= low) & (d <= high) & facing
    worth = F.when(seen, F.when(F.col("z") - F.col("ez") >= HIGH_GROUND, 2).otherwise(1)).otherwise(0)
    risk = F.when(F.col("dangerous") & (d < DANGER_M), 1).otherwise(0)
    return m.groupBy(*KEY, "spot", "team_index").agg(F.sum(worth).alias("tag"), F.sum(risk).alias("danger")).where("tag > 0 or danger > 0")


def grid_counts(zone: DataFrame, spots: DataFrame, samples: DataFrame, low: float, high: float, side: int = GRID, inside: float = GRID_INSIDE) -> DataFrame:
    """``spot_counts`` of ``grid_spots(zone, side, inside)``; ``spots`` has their heights (match_id, phase, spot, z)."""
    reach = F.when(F.col("rotating"), F.lit(max(high, DANGER_M) * CM)).otherwise(F.lit(DANGER_M * CM))
    s = samples.where("rotating or dangerous").select(*KEY, "team_index", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez"), "rotating", "dangerous")
    s = s.where("ex is not null and ey is not null").join(zone.select(*KEY, "zx", "zy", "zr"), KEY)
    # one more on either side; what is too far goes by its distance
    place = lambda e, z, sign: F.try_divide((F.col(e) - F.col(z) + F.col("zr") + sign * reach) * (side - 1), 2 * F.col("zr"))
    for name, e, z in (("_i", "ex", "zx"), ("_j", "ey", "zy")):
        first = F.greatest(F.coalesce(F.floor(place(e, z, -1)), F.lit(0)), F.lit(0))
        last = F.least(F.coalesce(F.ceil(place(e, z, 1)), F.lit(side - 1)), F.lit(side - 1))
        s = s.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn(name, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    at = lambda k: F.lit(-1.0) + F.lit(2.0) * F.col(k) / F.lit(float(side - 1))
    s = s.withColumns({"gx": at("_i"), "gy": at("_j")}).where(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") <= inside)
    s = s.withColumns({"x": F.col("zx") + F.col("gx") * F.col("zr"), "y": F.col("zy") + F.col("gy") * F.col("zr")})
    ox, oy, dx, dy = F.col("x") - F.col("zx"), F.col("y") - F.col("zy"), F.col("ex") - F.col("x"), F.col("ey") - F.col("y")
    s = s.withColumn("d", F.sqrt(dx * dx + dy * dy) / CM)
    facing = (dx * ox + dy * oy) / (F.col("d") * 100 * (F.sqrt(ox * ox + oy * oy) + 1e-9) + 1e-9) > FACING
    s = s.select(
        *KEY, (F.col("_j") * side + F.col("_i")).cast("long").alias("spot"), "team_index", "ez",
        F.when(F.col("rotating") & (F.col("d") >= low) & (F.col("d") <= high) & facing, 1).otherwise(0).alias("seen"), F.when(F.col("dangerous") & (F.col("d") < DANGER_M), 1).otherwise(0).alias("risk"),
    ).where("seen > 0 or risk > 0")
    g = s.groupBy(*KEY, "spot", "team_index", "ez").agg(F.sum("seen").alias("seen"), F.sum("risk").alias("risk"))
    worth = F.when(F.col("z") - F.col("ez") >= HIGH_GROUND, 2).otherwise(1) * F.col("seen")
    return g.join(spots.select(*KEY, "spot", "z"), [*KEY, "spot"]).groupBy(*KEY, "spot", "team_index").agg(F.sum(worth).alias("tag"), F.sum("risk").alias("danger"))


def without_own(spots: DataFrame, counts: DataFrame, teams: DataFrame, scored: bool = False) -> DataFrame:
    """Each team of a circle with each of its spots, and what the spot sees of all the others; ``scored``: only spots that can tag any team."""
    # a spot's teams are those of one match: they stay with it, and no pair of spot and team is shuffled
    part = F.when(F.col("team_index").isNotNull(), F.struct(F.col("team_index").cast("long").alias("k"), F.struct("tag", "danger").alias("v")))
    total = counts.groupBy(*KEY, "spot").agg(F.sum("tag").alias("_t"), F.sum("danger").alias("_d"), F.map_from_entries(F.collect_list(part)).alias("_own"))
    s = spots.join(total.where("_t > 0") if scored else total, [*KEY, "spot"], "inner" if scored else "left").join(teams, KEY)
    s = s.withColumn("_o", F.try_element_at("_own", F.col("team_index").cast("long")))
    less = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
    return s.withColumns({"tag": less("_t", "_o.tag"), "danger": less("_d", "_o.danger")}).drop("_t", "_d", "_o", "_own")


def base_audit(t: D.Tables, low: float, high: float) -> DataFrame:
    """D-22: each team's base in each hold, and the best spot that is no more dangerous (five samples at least are allowed).

    (match_id, phase, team_index, base_tag, base_danger, best_spot, best_tag, best_m); of equal spots the first one.
    """
    hold = holds(t)
    samples = written(hold_samples(t, hold), "held")
    centre = hold.select(*KEY, "zx", "zy")
    bases = samples.groupBy(*KEY, "team_index").agg(*(F.median(c).alias(c) for c in "xyz")).join(centre, KEY)
    land = ground(t)
    grid = grid_spots(hold)
    # a base's number follows the grid's
    number = F.lit(GRID * GRID).cast("long") + F.col("team_index")
    both = grid.withColumn("own", F.lit(None).cast("double")).withColumn("team_index", F.lit(None).cast("long")).unionByName(
        bases.select(*KEY, number.alias("spot"), "x", "y", "zx", "zy", F.col("z").alias("own"), F.col("team_index").cast("long").alias("team_index"))
    )
    placed = written(at_ground(both, land, F.col("own")), "placed")
    at_base = spot_counts(placed.where("team_index is not null"), samples, low, high)
    counts = written(grid_counts(hold, placed.where("team_index is null"), samples, low, high).unionByName(at_base), "counts")
    own = placed.where("team_index is not null").select(*KEY, "spot", "team_index", "x", "y")
    other = counts.withColumnRenamed("team_index", "_team")
    seen = own.join(other, [*KEY, "spot"], "left").where(F.col("_team").isNull() | (F.col("_team") != F.col("team_index"))).groupBy(*KEY, "team_index").agg(F.sum("tag").alias("base_tag"), F.sum("danger").alias("base_danger"))
    base = own.drop("spot").withColumnsRenamed({"x": "bx", "y": "by"}).join(seen, [*KEY, "team_index"], "left").fillna(0, subset=["base_tag", "base_danger"])
    free = without_own(grid, counts, base).where(F.col("danger") <= F.greatest("base_danger", F.lit(5)))
    away = G.distance_m(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    best = free.groupBy(*KEY, "team_index").agg(F.max(F.struct("tag", (-F.col("spot")).alias("first"), away.alias("away"))).alias("b"))
    return base.join(best, [*KEY, "team_index"], "left").select(
        *KEY, "team_index", "base_tag", "base_danger", (-F.col("b.first")).alias("best_spot"), F.col("b.tag").alias("best_tag"), F.col("b.away").alias("best_m")
    )


def lane_points(teams: DataFrame) -> DataFrame:
    """D-23: straight ways from teams outside the next circle to a little inside its edge, a point every 10 m, two at least.

    ``teams``: match_id, phase, team_index, x, y, z, next_x, next_y, next_r.
    """
    dx, dy = F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")
    t = teams.withColumn("_d", F.sqrt(dx * dx + dy * dy)).where("_d > next_r").withColumn("_entry", F.col("_d") - F.col("next_r"))
    t = t.withColumn("_n", F.greatest(F.lit(2), F.floor(F.col("_entry") / LANE_STEP_CM).cast("int"))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    f = F.col("_k") / (F.col("_n") - 1).cast("double")
    s = F.col("_entry") * f + F.col("next_r") * LANE_DEPTH * f
    return t.select(*KEY, "team_index", F.col("_k").cast("long").alias("point"), (F.col("x") + dx / F.col("_d") * s).alias("x"), (F.col("y") + dy / F.col("_d") * s).alias("y"), "z")


def surge_bases(teams: DataFrame, land: DataFrame, band: tuple[float, float] = LANE_BAND_M) -> DataFrame:
    """D-23: each team's spot in the next circle that faces the other teams' ways in, with none of them within 30 m.

    Of the spots with at least 90 % of the best score the nearest to the team; the first one of equals; none without a score.
    """
    teams = written(teams, "teams")
    zone = teams.groupBy(*KEY).agg(*(F.first(c).alias(n) for c, n in (("next_x", "zx"), ("next_y", "zy"), ("next_r", "zr"))))
    spots = written(at_ground(grid_spots(zone, LANE_GRID, LANE_INSIDE), land), "spots")
    lanes = lane_points(teams).select(*KEY, "team_index", "x", "y", "z", F.lit(True).alias("rotating"), F.lit(False).alias("dangerous"))
    centres = teams.select(*KEY, "team_index", "x", "y", "z", F.lit(False).alias("rotating"), F.lit(True).alias("dangerous"))
    counts = grid_counts(zone, spots, lanes.unionByName(centres), *band, LANE_GRID, LANE_INSIDE)
    usual = spots.groupBy(*KEY).agg(F.median("z").alias("usual_z"))
    own = teams.select(*KEY, "team_index", F.col("x").alias("tx"), F.col("y").alias("ty"))
    seen = without_own(spots, counts, own, scored=True).where("danger = 0 and tag > 0").withColumn("away", G.distance_m(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")))
    # the nearest spot of each score is all that is needed of it
    each = seen.groupBy(*KEY, "team_index", "tag").agg(F.min(F.struct("away", "spot", "x", "y", "z")).alias("s"))
    top = F.max("tag").over(Window.partitionBy(*KEY, "team_index"))
    best = each.withColumn("_top", top).where(F.col("tag") >= NEARLY * F.col("_top")).groupBy(*KEY, "team_index").agg(F.min(F.struct(F.col("s.away").alias("away"), F.col("s.spot").alias("spot"), F.col("s.z").alias("z"), "tag")).alias("b"))
    return best.join(usual, KEY).select(*KEY, "team_index", F.col("b.spot").alias("spot"), F.col("b.tag").alias("score"), F.col("b.away").alias("away_m"), ((F.col("b.z") - F.col("usual_z")) / CM).alias("height_m"))

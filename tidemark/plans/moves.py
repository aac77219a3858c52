"""Team moves: who watches a team on its way in, what it can know, its way in, its drop spot and its habits.

Each function works on all matches and teams at once; a team's own page is a filter on the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geometry as G
from tidemark.functions import stats as T
from tidemark.operators import ranks as R
from tidemark.operators.asof import asof_join, running_totals
from tidemark.operators.spatial import neighbour_pairs
from tidemark.plans import detect as D

CM = G.CM
#: Metres and seconds of the rules below.
LOOK_M, NEW_ATTACKER_S, NEXT_S = 120.0, 30.0, 10.0
TAG_LEAST_M, TAG_MOST_M, TAG_WIDTH_M, TAG_ROWS, TAG_USUAL_M = 20.0, 250.0, 30.0, 30, (30.0, 120.0)
ROUTE_M, ENTRY_DEPTH, ENTRY_TURN_DEG, ENTRY_EXTRA_M = 60.0, 0.92, tuple(range(-70, 71, 10)), 120.0
MOVED_M, HUNT_DAMAGE, EARLY_S = 80.0, 25.0, 20.0


def points_within(points: DataFrame, others: DataFrame, group: Sequence[str], radius_m: float) -> DataFrame:
    """Each point (x, y) with the others (ox, oy) of its group at most ``radius_m`` away, as ``dist_m``; by grid cells."""
    cell = radius_m * CM
    at = lambda c, i: F.floor(F.col(c) / cell) + i
    around = F.explode(F.array(*(F.struct(at("x", i).alias("cx"), at("y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = points.where("x is not null and y is not null").withColumn("_cell", around)
    b = others.withColumn("_cell", F.struct(at("ox", 0).alias("cx"), at("oy", 0).alias("cy")))
    met = a.join(b, [*group, "_cell"]).drop("_cell").withColumn("dist_m", G.distance_m(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))
    return met.where(F.col("dist_m") <= radius_m)


def members_at(t: D.Tables, moments: DataFrame) -> DataFrame:
    """Living humans with their last position at each moment (match_id, t and any more columns)."""
    alive = moments.join(D.humans(t).select("match_id", "id", "team_index", "death_t", "final"), "match_id").where("death_t is null or death_t > t")
    return asof_join(alive, t.positions, ["match_id", "id"], ["x", "y", "z"], right_time="t").drop("t_matched")


def shrink_moments(t: D.Tables) -> DataFrame:
    """The moments at which circles begin to shrink."""
    return t.zones.select("match_id", "phase", F.col("start_shrink_t").alias("t"), "next_x", "next_y", "next_r")


def team_moments(t: D.Tables, moments: DataFrame) -> DataFrame:
    """Living teams at each moment: members, centre, distance outside the next circle and finish."""
    m = members_at(t, moments)
    g = m.groupBy("match_id", "phase", "t", "team_index").agg(
        F.count("*").alias("members"), *(F.avg(c).alias(c) for c in "xyz"), F.min("final").alias("final"), *(F.first(c).alias(c) for c in ("next_x", "next_y", "next_r"))
    )
    out = G.distance_m(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y")) - F.col("next_r") / CM
    return g.withColumn("outside_m", F.greatest(out, F.lit(0.0)))


def lookers(teams: DataFrame, look_m: float = LOOK_M) -> DataFrame:
    """D-16: the teams with ``lookers``: enemy teams inside the next circle at most ``look_m`` away."""
    key = ["match_id", "t"]
    inside = teams.where("outside_m <= 0").select(*key, F.col("team_index").alias("other"))
    near = neighbour_pairs(teams, key, "team_index", look_m).join(inside, [*key, "other"]).groupBy(*key, "team_index").agg(F.count("*").alias("lookers"))
    return teams.join(near, [*key, "team_index"], "left").fillna(0, subset=["lookers"])


def new_attacks(hits: DataFrame, gap_s: float = NEW_ATTACKER_S) -> DataFrame:
    """Hits between two teams with none of that pair in the ``gap_s`` before."""
    pair = Window.partitionBy("match_id", "attacker_team", "target_team").orderBy("t")
    since = F.col("t") - F.lag("t").over(pair)
    return hits.withColumn("_since", since).where("_since is null or _since > {}".format(gap_s)).drop("_since")


def exposures(t: D.Tables, teams: DataFrame) -> DataFrame:
    """D-16: each team-moment with its lookers, state, and whether a new attacker hits it in the next ten seconds."""
    team = ["match_id", "team_index"]
    fresh = new_attacks(D.player_hits(t)).select("match_id", F.col("target_team").alias("team_index"), "t")
    g = running_totals(lookers(teams), fresh, team, {"_n0": F.lit(1.0)}).withColumn("_at", F.col("t") + NEXT_S)
    g = running_totals(g, fresh.withColumnRenamed("t", "_at"), team, {"_n1": F.lit(1.0)}, time="_at")
    stage = F.when(F.col("phase") <= 3, "1-3").when(F.col("phase") <= 5, "4-5").otherwise("6+")
    return g.withColumns({"hit": F.col("_n1") > F.col("_n0"), "action": F.when(F.col("outside_m") > 0, "rotate").otherwise("hold"), "stage": stage}).drop("_n0", "_n1", "_at")


def live_states(t: D.Tables, moments: DataFrame, perceive_m: float = 150.0, close_m: float = 50.0, cut_off: float = 0.0) -> DataFrame:
    """D-17: what each living team can know: enemy teams near, close and set up inside, their height over it, and its
    place in net damage against the cut-off."""
    teams = team_moments(t, moments)
    seen = members_at(t, moments).select(
        "match_id", "t", F.col("team_index").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"),
        (F.sqrt((F.col("x") - F.col("next_x")) ** 2 + (F.col("y") - F.col("next_y")) ** 2) <= F.col("next_r")).alias("in_next"),
    )
    key = ["match_id", "t", "team_index"]
    met = points_within(teams, seen, ["match_id", "t"], perceive_m).where("other <> team_index")
    n = met.groupBy(*key).agg(
        F.countDistinct("other").alias("seen"), F.countDistinct(F.when(F.col("dist_m") <= close_m, F.col("other"))).alias("seen_close"),
        F.countDistinct(F.when(F.col("in_next"), F.col("other"))).alias("seen_inside"), ((F.avg("oz") - F.first("z")) / CM).alias("seen_above"),
    )
    g = teams.join(n, key, "left").fillna(0, subset=["seen", "seen_close", "seen_inside"]).fillna(0.0, subset=["seen_above"])
    hits = D.player_hits(t)
    team = ["match_id", "team_index"]
    g = running_totals(g, hits.withColumnRenamed("attacker_team", "team_index"), team, {"_d": F.col("amount")})
    g = running_totals(g, hits.withColumnRenamed("target_team", "team_index"), team, {"_k": F.col("amount")})
    return g.withColumn("net", F.round(F.col("_d") - F.col("_k"), 6)).withColumn("surge_margin", R.percent_rank_average("net", ["match_id", "t"]) - cut_off).drop("_d", "_k")


def tag_range(exchanges: DataFrame, phases: tuple[int, int] = (2, 5)) -> DataFrame:
    """D-21: one row (n, low, high): where the middle 60 % of one-sided exchanges happen, within fixed bounds."""
    one = exchanges.where(F.col("one_sided") & F.col("phase").between(*phases) & F.col("dist_m").isNotNull())
    s = one.agg(F.count("*").alias("n"), F.percentile("dist_m", F.lit(0.2)).alias("_lo"), F.percentile("dist_m", F.lit(0.8)).alias("_hi"))
    enough = F.col("n") >= TAG_ROWS
    return s.select(
        "n", F.when(enough, F.greatest(F.lit(TAG_LEAST_M), "_lo")).otherwise(TAG_USUAL_M[0]).alias("low"),
        F.when(enough, F.least(F.lit(TAG_MOST_M), F.greatest(F.col("_hi"), F.col("_lo") + TAG_WIDTH_M))).otherwise(TAG_USUAL_M[1]).alias("high"),
    )


def loot_convergence(t: D.Tables, window_s: float = 180.0, before_s: float = 90.0) -> DataFrame:
    """D-36: (zone, best_early, worst_early, gap, closed): the best rarity in hand before each zone, of those who looted
    best and worst early; closed from a gap of at most 15 % of the first one, or 0.1."""
    from tidemark.functions.scalar import rarity_rank

    early = D.loot_per_player(t, window_s).where("best_rarity is not null")
    early = early.withColumn("_e", R.percent_rank_average("best_rarity", ["match_id"])).select("match_id", "id", F.when(F.col("_e") > 2 / 3, "best").when(F.col("_e") <= 1 / 3, "worst").alias("_g")).where("_g is not null")
    zone = t.zones.select("match_id", (F.col("phase") + 1).alias("zone"), F.col("finish_shrink_t").alias("_at"))
    held = t.weapons_held.where("category = 'weapon'").select("match_id", "id", "t", rarity_rank(F.col("rarity")).alias("_r")).join(early, ["match_id", "id"])
    # a match has few zones
    best = held.join(zone, "match_id").where((F.col("t") >= F.col("_at") - before_s) & (F.col("t") <= F.col("_at"))).groupBy("zone", "_g", "match_id", "id").agg(F.max("_r").alias("_r"))
    c = best.groupBy("zone").agg(F.avg(F.when(F.col("_g") == "best", F.col("_r"))).alias("best_early"), F.avg(F.when(F.col("_g") == "worst", F.col("_r"))).alias("worst_early"))
    c = c.withColumn("gap", F.col("best_early") - F.col("worst_early"))
    first = F.first("gap", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("zone").rowsBetween(Window.unboundedPreceding, 0))  # a row for each zone
    return c.withColumn("closed", (F.col("gap") <= 0.15 * F.greatest(first, F.lit(1e-9))) | (F.col("gap") <= 0.1))


def endings(t: D.Tables, fights: DataFrame) -> DataFrame:
    """D-38: each team that went out: when, in which zone, its last fight's opponent, third party and both sides' health."""
    out = D.humans(t).groupBy("match_id", "team_index").agg(F.when(F.count("death_t") == F.count("*"), F.max("death_t")).alias("out_t"), F.min("final").alias("final")).where("out_t is not null and final > 1")
    out = asof_join(out, t.zones.select("match_id", "phase", "finish_shrink_t"), ["match_id"], ["phase"], time="out_t", right_time="finish_shrink_t", how="left").drop("finish_shrink_t_matched")
    side = lambda mine, theirs: F.struct(F.col(mine).alias("team_index"), F.col(theirs).alias("opponent"), F.col(f"hp_{mine}").alias("health"), F.col(f"hp_{theirs}").alias("their_health"))
    f = fights.select("match_id", "t0", "third_party", "fight", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("_s")).select("match_id", "t0", "third_party", "fight", "_s.*")
    last = asof_join(out.withColumn("_by", F.col("out_t") + 1), f, ["match_id", "team_index"], ["opponent", "third_party", "health", "their_health"], time="_by", right_time="t0", how="left")
    return last.select("match_id", "team_index", "out_t", "final", (F.coalesce("phase", F.lit(0)) + 1).alias("zone"), "opponent", "third_party", "health", "their_health")


def score_bands(scored: DataFrame, group: Sequence[str], score: str, ident: str, top: float = 0.25) -> DataFrame:
    """D-40: ``band`` of each row of a group: the most likely quarter, the next one, the rest."""
    by = Window.partitionBy(*group)
    place, n = F.row_number().over(by.orderBy(F.desc(score), ident)), F.count("*").over(by)
    first = F.greatest(F.lit(1), F.floor(n * top))
    return scored.withColumn("band", F.when(place <= first, "top quarter").when(place <= F.floor(n * 0.5), "next quarter").otherwise("rest"))


def inside_chance(spots: DataFrame, candidates: DataFrame, group: Sequence[str], radius: str) -> DataFrame:
    """D-39: each spot (x, y) with ``chance``: the candidates' weight (cx, cy, weight) whose circle of its ``radius`` holds the spot.

    A group has a bounded number of candidates, a parameter of the forecast.
    """
    total = candidates.groupBy(*group).agg(F.sum("weight").alias("_all"))
    met = spots.join(candidates, list(group)).where(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2) <= F.col(radius))
    mass = met.groupBy(*spots.columns).agg(F.sum("weight").alias("_in"))
    return spots.join(mass.select(*group, "x", "y", "_in").distinct(), [*group, "x", "y"], "left").join(total, list(group), "left").withColumn("chance", F.try_divide(F.coalesce("_in", F.lit(0.0)), "_all")).drop("_in", "_all")


def rotation_plans(t: D.Tables, speed_m_s: float = 5.5, ahead: DataFrame | None = None) -> DataFrame:
    """D-24: each living team at each circle's reveal: distance, travel, when to leave, traffic on the straight way in and
    at its entry, and the least crowded entry within the turns and the detour allowed.

    ``ahead``: (phase, delay_s) of rotators that came ahead. A group is a match's living teams, a few dozen.
    """
    by = Window.partitionBy("match_id").orderBy("phase")
    z = t.zones.select("match_id", "phase", F.lag("finish_shrink_t").over(by).alias("t"), "next_x", "next_y", "next_r", "finish_shrink_t").where("t is not null and next_x is not null")
    m = team_moments(t, z.drop("finish_shrink_t")).join(z.select("match_id", "phase", "finish_shrink_t"), ["match_id", "phase"])
    dx, dy = F.col("x") - F.col("next_x"), F.col("y") - F.col("next_y")
    reach = F.col("next_r") * ENTRY_DEPTH
    entry = F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), (F.col("next_x") + F.cos(F.atan2(dy, dx) + F.radians(F.lit(float(k)))) * reach).alias("ex"), (F.col("next_y") + F.sin(F.atan2(dy, dx) + F.radians(F.lit(float(k)))) * reach).alias("ey")) for k in ENTRY_TURN_DEG)))
    ways = m.where("outside_m > 0").select("match_id", "phase", "team_index", "x", "y", "outside_m", entry.alias("_e")).select("*", "_e.*").drop("_e")
    others = m.select("match_id", "phase", F.col("team_index").alias("_o"), F.col("x").alias("_ox"), F.col("y").alias("_oy"))
    met = ways.join(others, ["match_id", "phase"]).where("_o <> team_index")
    on_route = G.off_segment_m(F.col("_ox"), F.col("_oy"), F.col("x"), F.col("y"), F.col("ex"), F.col("ey")) <= ROUTE_M
    at_entry = G.distance_m(F.col("_ox"), F.col("_oy"), F.col("ex"), F.col("ey")) <= ROUTE_M
    key = ["match_id", "phase", "team_index"]
    n = met.groupBy(*key, "turn").agg(F.count_if(on_route).alias("on_route"), F.count_if(at_entry).alias("at_entry"))
    n = ways.join(n, [*key, "turn"], "left").fillna(0, subset=["on_route", "at_entry"])
    n = n.withColumns({"traffic": F.col("on_route") + F.col("at_entry"), "extra_m": G.distance_m(F.col("x"), F.col("y"), F.col("ex"), F.col("ey")) - F.col("outside_m")})
    best = n.where(F.col("extra_m") <= ENTRY_EXTRA_M).groupBy(*key).agg(F.min(F.struct("traffic", F.abs("turn").alias("by"), "turn")).alias("_b"))
    straight = n.where("turn = 0").select(*key, "on_route", "at_entry")
    plan = m.join(straight, key, "left").join(best.select(*key, F.col("_b.turn").alias("alt_turn"), F.col("_b.traffic").alias("alt_traffic")), key, "left")
    better = F.coalesce(F.col("alt_traffic") < F.col("on_route") + F.col("at_entry"), F.lit(False))
    plan = plan.withColumns(
        {"alt_turn": F.when(better, F.col("alt_turn")), "alt_traffic": F.when(better, F.col("alt_traffic")), "travel_s": F.col("outside_m") / speed_m_s}
    ).withColumn("latest_t", F.col("finish_shrink_t") - F.col("travel_s"))
    if ahead is not None:
        plan = plan.join(F.broadcast(ahead.select("phase", F.col("delay_s").alias("_delay"))), "phase", "left")  # one row for each phase
    else:
        plan = plan.withColumn("_delay", F.lit(None).cast("double"))
    leave = F.when(F.col("outside_m") > 0, F.least(F.coalesce(F.col("t") + F.col("_delay"), F.col("latest_t")), F.col("latest_t")))
    return plan.withColumn("leave_by", leave).drop("_delay", "next_x", "next_y", "next_r")


def usual_spots(landings: DataFrame, who: Sequence[str]) -> DataFrame:
    """D-33 in part: each team's most frequent named place (ties: the smaller name) with its games there and in all, and
    the middle of its landings."""
    named = landings.where("poi is not null").groupBy(*who, "poi").agg(F.countDistinct("match_id").alias("_n"))
    spot = named.groupBy(*who).agg(F.min(F.struct((-F.col("_n")).alias("_m"), "poi")).alias("_s")).select(*who, F.col("_s.poi").alias("spot"), (-F.col("_s._m")).alias("games_there"))
    all_ = landings.groupBy(*who).agg(F.countDistinct("match_id").alias("games"), F.median("land_x").alias("mid_x"), F.median("land_y").alias("mid_y"))
    return all_.join(spot, list(who), "left")


def regulars(landings: DataFrame, spots: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """D-41: for each team's ``spot`` the ``most`` other players who land there most, with shared games and how often each side went out at once.

    ``landings``: match_id, id (the account), team_index, poi, off_spawn; ``spots``: team_index, spot.
    """
    own = landings.join(spots.select("team_index", "spot"), "team_index").where(F.col("poi") == F.col("spot")).groupBy("team_index", "match_id").agg(F.max(F.coalesce("off_spawn", F.lit(False)).cast("int")).alias("_we"))
    there = landings.select("match_id", "id", F.col("team_index").alias("_other"), F.col("poi").alias("spot"), F.coalesce("off_spawn", F.lit(False)).cast("int").alias("_they"))
    met = spots.select("team_index", "spot").join(there, "spot").where("_other <> team_index").join(own, ["team_index", "match_id"], "left")
    shared = F.col("_we").isNotNull()
    per = met.groupBy("team_index", "spot", "id").agg(
        F.countDistinct("match_id").alias("games"), F.countDistinct(F.when(shared, F.col("match_id"))).alias("shared"),
        F.countDistinct(F.when(F.col("_we") == 1, F.col("match_id"))).alias("team_out"), F.countDistinct(F.when(shared & (F.col("_they") == 1), F.col("match_id"))).alias("they_out"),
    ).where(F.col("games") >= least)
    place = F.row_number().over(Window.partitionBy("team_index").orderBy(F.desc("games"), F.desc("shared"), "id"))
    return per.withColumn("place", place).where(F.col("place") <= most)


def backup_spots(landings: DataFrame, points: DataFrame, spots: DataFrame, least: int = 10, most: int = 5) -> DataFrame:
    """D-42: for each team the places less contested than its own, with at least ``least`` team-games, best points first."""
    teams = landings.where("poi is not null").groupBy("match_id", "poi", "team_index").agg(F.median("land_x").alias("x"), F.median("land_y").alias("y"))
    teams = teams.withColumn("_n", F.count("*").over(Window.partitionBy("match_id", "poi"))).join(points.select("match_id", "team_index", "points"), ["match_id", "team_index"], "left")
    place = teams.groupBy("poi").agg(F.count("*").alias("team_games"), F.avg((F.col("_n") > 1).cast("double")).alias("contested"), F.avg("points").alias("points"), F.median("x").alias("x"), F.median("y").alias("y"))
    own = spots.join(place.select(F.col("poi").alias("spot"), F.col("contested").alias("_c"), F.col("x").alias("_x"), F.col("y").alias("_y")), "spot").select("team_index", "spot", "_c", "_x", "_y")
    # places are few, teams' own ones fewer: met by the condition alone, the better of the two sides broadcast by its size
    met = own.join(place.where(F.col("team_games") >= least), (F.col("contested") < F.col("_c")) & (F.col("poi") != F.col("spot")))
    met = met.withColumn("km", F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2) / 100_000)
    order = F.row_number().over(Window.partitionBy("team_index").orderBy(F.desc("points"), "poi"))
    return met.withColumn("place", order).where(F.col("place") <= most).select("team_index", "spot", "poi", "team_games", "contested", "points", "km", "place")


def habits(applications: DataFrame, least: int = 2, least_players: int = 5, alpha: float = 0.05) -> DataFrame:
    """D-45: for each rule what the same players gain by following it, whether that is proven, and for each team how often it
    broke it and what mending it is worth. ``applications``: rule, id, team_index, followed, ahead (share of rivals ahead)."""
    side = lambda yes: F.col("followed") if yes else ~F.col("followed")
    own = applications.groupBy("rule", "id").agg(
        *(F.avg(F.when(side(y), F.col("ahead"))).alias(f"m{int(y)}") for y in (True, False)), *(F.count_if(side(y)).alias(f"n{int(y)}") for y in (True, False))
    ).where((F.col("n1") >= least) & (F.col("n0") >= least)).withColumn("gap", F.col("m1") - F.col("m0"))
    tested = T.t_test(own, ["rule"], "gap", 0.0).select("rule", F.col("n").alias("players"), (-100 * F.col("mean")).alias("gain"), "p").where(F.col("players") >= least_players)
    proven = F.coalesce((F.col("p") < alpha) & (F.col("gain") > 0), F.lit(False))
    team = applications.groupBy("rule", "team_index").agg(F.avg((~F.col("followed")).cast("double")).alias("broke"), F.count("*").alias("n"))
    return team.join(tested, "rule").withColumn("backed", proven).withColumn("priority", F.when(proven, F.col("gain") * F.col("broke")).otherwise(-1.0))


def crowd(actions: DataFrame, situation: Sequence[str], action: str = "action") -> DataFrame:
    """D-27: for each team-game and situation the share of each action in all other games. ``actions``: match_id, team_index, the situation's columns and the action."""
    mine = actions.groupBy("match_id", "team_index", *situation, action).agg(F.count("*").alias("_mine"))
    field = actions.groupBy(*situation, action).agg(F.count("*").alias("_all"))
    game = actions.groupBy("match_id", "team_index", *situation).agg(F.count("*").alias("_n"))
    total = actions.groupBy(*situation).agg(F.count("*").alias("_of"))
    each = game.join(total, list(situation)).join(field, list(situation)).join(mine, ["match_id", "team_index", *situation, action], "left")
    left = F.col("_of") - F.col("_n")
    return each.select("match_id", "team_index", *situation, action, left.alias("others"), F.try_divide(F.col("_all") - F.coalesce("_mine", F.lit(0)), left).alias("share"))


def plan_check(plan: DataFrame, event: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """D-46: each measure before and at the event, for each team: (by, measure, plan, event, change)."""
    long = lambda df, name: df.select(*by, *(F.col(m).cast("double").alias(m) for m in measures)).unpivot(list(by), list(measures), "measure", name)
    both = long(plan, "plan").join(long(event, "event"), [*by, "measure"], "full")
    return both.withColumn("change", F.col("event") - F.col("plan"))


def approaches(t: D.Tables, checks: DataFrame) -> DataFrame:
    """D-47 in part: how each living player came to a check: stayed, with or without hunting, in early or late, and how far from the centre.

    ``checks``: match_id, phase, appear, t (the check) and the next circle.
    """
    a = members_at(t, checks).drop("z")
    a = asof_join(a, t.positions, ["match_id", "id"], ["x", "y"], time="appear", right_time="t", prefix="first_").drop("first_t_matched")
    hits = D.player_hits(t).select("match_id", F.col("attacker_id").alias("id"), "t", "amount")
    a = running_totals(a, hits, ["match_id", "id"], {"_d1": F.col("amount")})
    a = running_totals(a, hits.withColumnRenamed("t", "appear"), ["match_id", "id"], {"_d0": F.col("amount")}, time="appear", inclusive=False)
    inside = t.positions.select("match_id", "id", F.col("t").alias("_in_t"), F.col("x").alias("_ix"), F.col("y").alias("_iy")).join(checks, "match_id")
    inside = inside.where((F.col("_in_t") >= F.col("appear")) & (F.col("_in_t") <= F.col("t")) & (F.sqrt((F.col("_ix") - F.col("next_x")) ** 2 + (F.col("_iy") - F.col("next_y")) ** 2) <= F.col("next_r")))
    first_in = inside.groupBy("match_id", "id", "phase").agg(F.min("_in_t").alias("t_in"))
    a = a.join(first_in, ["match_id", "id", "phase"], "left")
    dealt = F.col("_d1") - F.col("_d0")
    moved = G.distance_m(F.col("x"), F.col("y"), F.col("first_x"), F.col("first_y"))
    how: Column = F.when(moved < MOVED_M, F.when(dealt >= HUNT_DAMAGE, "stayed and hunted").otherwise("stayed")).when(F.col("t_in") <= F.col("t") - EARLY_S, "in early").otherwise("late or outside")
    radial = F.sqrt((F.col("x") - F.col("next_x")) ** 2 + (F.col("y") - F.col("next_y")) ** 2) / F.col("next_r")
    spot = F.when(radial <= 0.5, "deep").when(radial <= 0.85, "inside").when(radial <= 1.0, "edge").when(radial <= 1.25, "just outside").otherwise("far outside")
    return a.select("match_id", "phase", "id", "team_index", "final", dealt.alias("dealt"), moved.alias("moved_m"), how.alias("approach"), spot.alias("spot"))


def top_teams(games: DataFrame, who: str, minimums: Sequence[int] = tuple(range(8, 1, -1)), least_teams: int = 10, share: float = 0.1, least_top: int = 3) -> DataFrame:
    """D-30: teams by points per game, ``top`` for the best share, ``least_top`` at least; the minimum of games is the first that leaves
    ``least_teams`` teams, else the last. Of equal teams the smaller one comes first."""
    per = games.groupBy(who).agg(F.avg("points").alias("ppg"), F.count("*").alias("games"))
    counts = per.agg(*(F.count_if(F.col("games") >= k).alias(f"_n{k}") for k in minimums))
    chosen = F.lit(minimums[-1])
    for k in reversed(minimums[:-1]):
        chosen = F.when(F.col(f"_n{k}") >= least_teams, k).otherwise(chosen)
    kept = per.crossJoin(F.broadcast(counts.select(chosen.alias("minimum")))).where(F.col("games") >= F.col("minimum"))
    tied = R.summed_below(kept.groupBy("ppg").agg(F.count("*").alias("_n")), [], "ppg", ["_n"]).select(
        F.col("ppg").alias("_ppg"), (F.col("all__n") - F.col("below__n") - F.col("_n")).alias("_above"), F.greatest(F.lit(least_top), F.ceil(F.col("all__n") * share)).alias("_k")
    )
    place = F.col("_above") + F.row_number().over(Window.partitionBy("ppg").orderBy(who))
    return kept.join(tied, F.col("ppg") == F.col("_ppg")).select(who, "ppg", "games", "minimum", (place <= F.col("_k")).alias("top"))


def game_risks(t: D.Tables) -> DataFrame:
    """D-37: per team-game its risks: (flags, n_flags), each named once, in this order.

    Contested drop, off spawn (the landings), behind (a rotation), edge (over three quarters of the circle's radius from its
    centre when it appears, phase 5 on), storm (50 damage or more in a phase), low ground (lowest third of the teams when the circle appears, phase 6 on).
    """
    appear = F.lag("finish_shrink_t").over(Window.partitionBy("match_id").orderBy("phase"))
    moments = t.zones.withColumn("t", appear).where("t is not null").select("match_id", "phase", "t", "cur_x", "cur_y", "cur_r")
    team = ["match_id", "team_index"]
    at = members_at(t, moments).groupBy(*team, "phase").agg(*(F.avg(c).alias(c) for c in "xyz"), *(F.first(c).alias(c) for c in ("cur_x", "cur_y", "cur_r")))
    off = F.try_divide(G.distance_m(F.col("x"), F.col("y"), F.col("cur_x"), F.col("cur_y")) * CM, "cur_r")
    rank = R.percent_rank_average("z", ["match_id", "phase"])
    seen = at.select(*team, "phase", ((F.col("phase") >= 5) & (off > 0.75)).alias("edge"), ((F.col("phase") >= 6) & (rank < 1 / 3)).alias("low"))
    seen = seen.groupBy(*team).agg(F.bool_or("edge").alias("edge"), F.bool_or("low").alias("low_ground"))
    log = D.damage_causes(t)[0].where("cause = 'storm'").join(D.humans(t).select("match_id", "id", "team_index"), ["match_id", "id"])
    log = asof_join(log, moments.select("match_id", "phase", F.col("t").alias("appear")), ["match_id"], ["phase"], right_time="appear", how="left")
    storm = log.groupBy(*team, "phase").agg(F.sum("lost").alias("_lost")).groupBy(*team).agg((F.max("_lost") >= 50).alias("storm"))
    behind = D.rotations(t).groupBy(*team).agg(F.bool_or(F.col("timing") == "Behind").alias("behind"))
    base = D.humans(t).groupBy(*team).agg(F.min("final").alias("final"))
    found = base.join(seen, team, "left").join(storm, team, "left").join(behind, team, "left")
    names = ["behind", "edge", "storm", "low_ground"]
    if t.landings is not None:
        drop = t.landings.join(D.humans(t).select("match_id", "id", F.col("team_index").alias("_team")), ["match_id", "id"])
        drop = drop.groupBy("match_id", F.col("_team").alias("team_index")).agg(F.bool_or(F.col("opp_150m") > 0).alias("contested"), F.bool_or("off_spawn").alias("off_spawn"))
        found, names = found.join(drop, team, "left"), ["contested", "off_spawn", *names]
    flags = F.array_compact(F.array(*(F.when(F.col(c), c) for c in names)))
    return found.select(*team, "final", flags.alias("flags"), F.size(flags).alias("n_flags"))


#: Half width and step in centimetres of the passes over candidate centres, coarse to fine (fixed values).
CENTRE_PASSES = ((90_000.0, 7_500.0), (9_000.0, 1_500.0), (1_500.0, 250.0))


def first_centres(t: D.Tables, passes: Sequence[tuple[float, float]] = CENTRE_PASSES, least: int = 20, follow_s: float = 2.5, least_score: float = 0.6) -> DataFrame:
    """D-18: (match_id, cur_x, cur_y, score): where the first circle's unknown centre is, by the damage outside it.

    Living humans' samples during the first shrink are damaged, where an unexplained drop follows within ``follow_s``, or
    not; the centre chosen is the one whose moving circle tells the two apart best (mean of both sides' right shares), the
    first such in the grid's order. Each pass looks around the centre before it, the first around the next circle's.
    """
    z = t.zones.where("phase = 1").select("match_id", "cur_r", "next_x", "next_y", "next_r", "start_shrink_t", "finish_shrink_t")
    hits = t.damage.select("match_id", F.col("target_id").alias("id"), F.col("t").alias("r_t"))
    from tidemark.operators.interval import interval_join

    drops = interval_join(D.health_drops(t), hits, ["match_id", "id"], 1.5, 0.5, how="left_anti").select("match_id", "id", F.col("t").alias("drop_t"), F.lit(1).alias("one"))
    drops = drops.join(z.select("match_id", "start_shrink_t", "finish_shrink_t"), "match_id").where("drop_t >= start_shrink_t and drop_t <= finish_shrink_t + 5").select("match_id", "id", "drop_t", "one")
    alive = D.humans(t).select("match_id", "id", "death_t")
    s = t.positions.select("match_id", "id", "t", "x", "y").join(alive, ["match_id", "id"]).join(z, "match_id").where("t >= start_shrink_t and t <= finish_shrink_t and (death_t is null or t < death_t - 1)")
    s = asof_join(s, drops, ["match_id", "id"], ["one"], right_time="drop_t", how="left", direction="forward", tolerance=follow_s)
    f = G.progress(F.col("t"), F.col("start_shrink_t"), F.col("finish_shrink_t"))
    s = s.select("match_id", "x", "y", f.alias("f"), F.col("one").isNotNull().alias("hurt"), (F.col("cur_r") + f * (F.col("next_r") - F.col("cur_r"))).alias("r"))
    enough = s.groupBy("match_id").agg(F.count_if("hurt").alias("_a"), F.count_if(~F.col("hurt")).alias("_b")).where((F.col("_a") >= least) & (F.col("_b") >= least)).select("match_id")
    centre = z.join(enough, "match_id", "left_semi").withColumns({"bx": F.col("next_x"), "by": F.col("next_y")})
    for span, step in passes:
        n = int(2 * span // step)
        grid = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.col(c) - span + k * step))
        cand = centre.select("match_id", "cur_r", "next_x", "next_y", "next_r", "bx", "by", grid("bx").alias("cx")).select("*", grid("by").alias("cy"))
        cand = cand.where(F.sqrt((F.col("cx") - F.col("next_x")) ** 2 + (F.col("cy") - F.col("next_y")) ** 2) + F.col("next_r") <= F.col("cur_r"))
        met = s.join(cand.select("match_id", "cx", "cy", "next_x", "next_y"), "match_id")  # the grid has a fixed size
        mx, my = G.moving(F.col("cx"), F.col("next_x"), F.col("f")), G.moving(F.col("cy"), F.col("next_y"), F.col("f"))
        out = (F.sqrt((F.col("x") - mx) ** 2 + (F.col("y") - my) ** 2) > F.col("r")).cast("double")
        score = (F.avg(F.when(F.col("hurt"), out)) + F.avg(F.when(~F.col("hurt"), 1 - out))) / 2
        best = met.groupBy("match_id", "cx", "cy").agg(F.round(score, 9).alias("score"))
        best = best.groupBy("match_id").agg(F.min(F.struct((-F.col("score")).alias("m"), "cx", "cy")).alias("_b"))
        centre = centre.drop("bx", "by", "score").join(best.select("match_id", F.col("_b.cx").alias("bx"), F.col("_b.cy").alias("by"), (-F.col("_b.m")).alias("score")), "match_id")
    return centre.where(F.col("score") > least_score).select("match_id", F.col("bx").alias("cur_x"), F.col("by").alias("cur_y"), "score")

"""Detectors that many studies share, over all selected matches at once.

``Tables`` holds the frames they read; a dataset's catalog and the arena view both fill it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geometry as G
from tidemark.functions import points as P
from tidemark.functions import scalar as S
from tidemark.functions import stats as T
from tidemark.operators import aggregates as A
from tidemark.operators import ranks as R
from tidemark.operators import selection as L
from tidemark.operators import sessions as W
from tidemark.operators.asof import asof_join, running_totals
from tidemark.operators.interval import time_grid, window_sums
from tidemark.operators.spatial import neighbour_counts
from tidemark.sources.shared import grown


@dataclass(frozen=True)
class Tables:
    """``freshness``: the ages in seconds that an as-of position may have; wide where samples are sparse."""

    matches: DataFrame
    players: DataFrame
    zones: DataFrame
    positions: DataFrame
    kills: DataFrame
    health: DataFrame
    damage: DataFrame
    landings: DataFrame | None = None
    weapons_held: DataFrame | None = None
    chests: DataFrame | None = None
    pickups: DataFrame | None = None
    freshness: float = 2.0

    def chosen(self, selection: DataFrame) -> Tables:
        """The same for the selected matches."""
        keep = {k: L.chosen(v, selection) for k, v in vars(self).items() if isinstance(v, DataFrame)}
        return Tables(**keep, freshness=self.freshness)


ZONE = ["phase", "cur_x", "cur_y", "cur_r", "next_x", "next_y", "next_r", "start_shrink_t", "finish_shrink_t"]


def _phase(df: DataFrame) -> dict[str, Column]:
    return {k: F.col(k) for k in ("cur_x", "cur_y", "cur_r", "next_x", "next_y", "next_r")} | {"start": F.col("start_shrink_t"), "finish": F.col("finish_shrink_t")}


def final(players: DataFrame) -> Column:
    return F.coalesce("team_placement", "placement") if "team_placement" in players.columns else F.col("placement")


def humans(t: Tables) -> DataFrame:
    return L.humans(t.players).withColumn("final", final(t.players))


def player_hits(t: Tables) -> DataFrame:
    """D-01."""
    own = L.humans(t.players).select("match_id", "id", "team_index")
    d = t.damage.where("target_kind = 'player'") if "target_kind" in t.damage.columns else t.damage
    h = d.join(own.withColumnsRenamed({"id": "attacker_id", "team_index": "attacker_team"}), ["match_id", "attacker_id"])
    h = h.join(own.withColumnsRenamed({"id": "target_id", "team_index": "target_team"}), ["match_id", "target_id"])
    return h.where(L.opponents(F.col("attacker_team"), F.col("target_team"))).select("match_id", "t", "attacker_id", "target_id", "attacker_team", "target_team", "amount")


def health_drops(t: Tables) -> DataFrame:
    by = Window.partitionBy("match_id", "id").orderBy("t")
    hp = F.coalesce("health", F.lit(0.0)) + F.coalesce("shield", F.lit(0.0))
    d = t.health.select("match_id", "id", "t", hp.alias("hp"), F.lag(hp).over(by).alias("before"))
    return d.withColumn("lost", F.col("before") - F.col("hp")).where("lost > 0.5").select("match_id", "id", "t", "lost")


def unexplained_drops(t: Tables) -> DataFrame:
    """D-02: drops that no hit explains, with phase and whether they were outside the moving circle.

    Health, hits and positions are one table that goes through one window over the player: what a change was before it, whether a
    hit is at most 1.5 s before or 0.5 s after it, and the last position.
    """
    who = ["match_id", "id"]
    known = lambda df: df.where("match_id is not null and id is not null and t is not null")
    hp = F.coalesce("health", F.lit(0.0)) + F.coalesce("shield", F.lit(0.0))
    rows = t.health.select(*who, "t", F.lit(1).alias("_side"), hp.alias("hp"))
    rows = rows.unionByName(known(t.damage.select("match_id", F.col("target_id").alias("id"), "t")).select("*", F.lit(0).alias("_side"), F.lit(True).alias("_hit")), allowMissingColumns=True)
    rows = rows.unionByName(known(t.positions.select(*who, "t", "x", "y")).select(*who, "t", F.lit(0).alias("_side"), F.struct("x", "y").alias("_at")), allowMissingColumns=True)
    by = Window.partitionBy(*who).orderBy("t", "_side", "_at")
    hits = F.expr("count(_hit) over (partition by match_id, id order by t range between 1.5d preceding and 0.5d following)")
    u = rows.select(
        *who, "t", "hp", F.last("hp", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_at", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("_at"), hits.alias("_hits"),
    )
    u = u.withColumn("lost", F.col("_before") - F.col("hp")).where("lost > 0.5 and _hits = 0").select(*who, "t", "lost", F.col("_at.x").alias("x"), F.col("_at.y").alias("y"))
    u = asof_join(u, t.zones, ["match_id"], ZONE, right_time="start_shrink_t", how="left")
    return u.withColumn("in_storm", G.storm_margin(F.col("x"), F.col("y"), F.col("t"), _phase(u)) < 0).select("match_id", "id", "t", "lost", "phase", "in_storm")


def player_phases(t: Tables) -> DataFrame:
    """D-03: each tracked player in each phase from its reveal to its end."""
    by = Window.partitionBy("match_id").orderBy("phase")
    z = t.zones.select("match_id", *ZONE, F.lag("finish_shrink_t").over(by).alias("reveal_t")).where(
        "reveal_t is not null and cur_x is not null and start_shrink_t >= reveal_t and finish_shrink_t > start_shrink_t"
    )
    pull = F.sqrt((F.col("next_x") - F.col("cur_x")) ** 2 + (F.col("next_y") - F.col("cur_y")) ** 2)
    z = z.withColumns({"moving": pull > F.col("cur_r") - F.col("next_r") + 100, "outside_all": pull >= F.col("cur_r") + F.col("next_r")})
    s = t.positions.select("match_id", "id", "t", "x", "y").join(z, "match_id").where("t >= reveal_t and t <= finish_shrink_t")
    d = G.distance_m(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y"))
    first = F.first("_d").over(Window.partitionBy("match_id", "phase", "id").orderBy("t"))
    s = s.withColumns({"_d": d, "_storm": G.storm_margin(F.col("x"), F.col("y"), F.col("t"), _phase(s)) < 0}).withColumn("_d0", first)
    r = F.col("next_r") / 100
    left = F.col("_d") <= F.col("_d0") - F.greatest(F.lit(50.0), 0.25 * (F.col("_d0") - r))
    constant = ["reveal_t", "start_shrink_t", "finish_shrink_t", "moving", "outside_all", "cur_r", "next_r"]
    return s.groupBy("match_id", "phase", "id").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"), F.min_by("x", "t").alias("x0"), F.min_by("y", "t").alias("y0"),
        F.any_value("_d0").alias("reveal_m"), *(F.any_value(c).alias(c) for c in constant),
        F.min(F.when(F.col("_d") <= r, F.col("t"))).alias("entry_t"), F.min(F.when(left, F.col("t"))).alias("depart_t"), F.count_if("_storm").alias("storm_n"),
    )


def phase_kind() -> Column:
    wait = F.col("start_shrink_t") - F.col("reveal_t")
    return F.when(~F.col("moving"), "Shrinking").when(wait <= 1, "Moving").when(F.col("outside_all"), "Shifted").otherwise("50/50")


def rotations(t: Tables, least: int = 6, seen_s: float | None = None) -> DataFrame:
    """D-04: players outside the next circle at its reveal: when they leave and arrive, against those with as far to go."""
    own = humans(t).select("match_id", "id", "team_index", "death_t", "final", "pr_rank")
    r = player_phases(t).join(own, ["match_id", "id"]).withColumn("kind", phase_kind())
    seen = seen_s if seen_s is not None else max(5.0, t.freshness)
    there = r.where((F.col("first_t") - F.col("reveal_t") <= seen) & (F.col("death_t").isNull() | (F.col("death_t") >= F.col("reveal_t"))))
    there = grown(there, "there")  # neighbours read it three times
    pts = there.withColumnsRenamed({"x0": "x", "y0": "y"})
    there = neighbour_counts(pts, ["match_id", "phase"], "id", [100]).withColumnsRenamed({"x": "x0", "y": "y0", "near_100": "neighbours_100m"}).drop("nearest_m")
    there = there.withColumn("outside_m", F.col("reveal_m") - F.col("next_r") / 100)
    rot = there.where("outside_m > 0 and (death_t is null or death_t >= start_shrink_t)")
    w, group = Window.partitionBy("match_id", "phase"), ["match_id", "phase"]
    step = F.least((F.col("last_t") - F.col("first_t")) / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(5.0))
    rot = rot.withColumns(
        {
            "arrival_s": F.col("entry_t") - F.col("start_shrink_t"), "depart_s": F.col("depart_t") - F.col("reveal_t"), "storm_s": F.col("storm_n") * step,
            "died_in_shrink": F.coalesce(F.col("death_t").between(F.col("start_shrink_t"), F.col("finish_shrink_t") + 1), F.lit(False)),
            "lag_s": F.col("entry_t") - F.min("entry_t").over(w), "arrival_rank": R.percent_rank_nulls_last("entry_t", group), "rotators": F.count("*").over(w),
        }
    )
    rot = rot.withColumn("residual_s", R.residual("arrival_s", "outside_m", group))
    share = R.percent_rank_average("residual_s", group)
    return rot.withColumn("timing", F.when(F.col("rotators") >= least, R.thirds(share, ("Ahead", "Typical", "Behind")))).where("final is not null")


def team_snapshots(t: Tables) -> DataFrame:
    """D-05: each living team's mean height at a shrink's start, its percent rank in the lobby and its tier."""
    s = t.zones.select("match_id", "phase", F.col("start_shrink_t").alias("at")).join(humans(t).select("match_id", "id", "team_index", "death_t", "final"), "match_id").where("death_t is null or death_t > at")
    j = asof_join(s, t.positions, ["match_id", "id"], ["z"], time="at", right_time="t")
    h = j.groupBy("match_id", "phase", "team_index").agg((F.avg("z") / 100).alias("height_m"), F.min("final").alias("final"), F.count("*").alias("members"))
    share = R.percent_rank_average("height_m", ["match_id", "phase"])
    return h.withColumn("height_rank", share).withColumn("tier", R.thirds(share, ("Low", "Middle", "High")))


def kill_fights(t: Tables, age_s: float = 3.0) -> DataFrame:
    """D-06: the finisher's height over the victim, both seen at most ``age_s`` before."""
    k = t.kills.where("finisher_id <> victim_id").select("match_id", "t", "victim_id", "finisher_id")
    a = asof_join(k.withColumn("id", F.col("finisher_id")), t.positions, ["match_id", "id"], ["x", "y", "z"], tolerance=age_s, prefix="w_")
    b = asof_join(a.withColumn("id", F.col("victim_id")), t.positions, ["match_id", "id"], ["x", "y", "z"], tolerance=age_s, prefix="l_")
    b = asof_join(b, t.zones.select("match_id", "phase", "start_shrink_t"), ["match_id"], ["phase"], right_time="start_shrink_t", how="left")
    return b.select(
        "match_id", "t", "victim_id", "finisher_id", F.coalesce("phase", F.lit(0)).alias("phase"), ((F.col("w_z") - F.col("l_z")) / 100).alias("above_m"),
        G.distance_m(F.col("w_x"), F.col("w_y"), F.col("l_x"), F.col("l_y")).alias("dist_m"),
    )


def fights(t: Tables, gap_s: float = 15.0, least_hits: int = 3, after_s: float = 60.0) -> DataFrame:
    """D-07: sessions of hits between two teams, with who began, who lost a player, health before and a third party."""
    h = player_hits(t).withColumns({"a": F.least("attacker_team", "target_team"), "b": F.greatest("attacker_team", "target_team")})
    h = W.gap_sessions(h, ["match_id", "a", "b"], "t", gap_s, "fight")
    key = ["match_id", "a", "b", "fight"]
    f = h.groupBy(*key).agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("hits"), F.min_by("attacker_team", F.struct("t", "attacker_id", "target_id")).alias("first"),
        F.coalesce(F.sum(F.when(F.col("attacker_team") == F.col("a"), F.col("amount"))), F.lit(0.0)).alias("damage_a"),
        F.coalesce(F.sum(F.when(F.col("attacker_team") == F.col("b"), F.col("amount"))), F.lit(0.0)).alias("damage_b"),
    )
    dead = humans(t).where("death_t is not null").select("match_id", F.col("team_index").alias("_team"), "death_t")
    d = f.select(*key, "t0", "t1").join(dead, "match_id").where("_team = a or _team = b")
    during, after = F.col("death_t").between(F.col("t0"), F.col("t1") + 5), (F.col("death_t") > F.col("t1")) & (F.col("death_t") <= F.col("t1") + after_s)
    side = lambda c, s: F.max((c & (F.col("_team") == F.col(s))).cast("int"))
    lost = d.groupBy(*key).agg(side(during, "a").alias("_la"), side(during, "b").alias("_lb"), side(after, "a").alias("_aa"), side(after, "b").alias("_ab"))
    third = (
        f.select(*key, "t0", "t1").join(player_hits(t).select("match_id", "t", "attacker_team", "target_team"), "match_id")
        .where("t between t0 and t1 and (target_team = a or target_team = b) and attacker_team <> a and attacker_team <> b")
        .select(*key).distinct().withColumn("third_party", F.lit(True))
    )
    f = f.join(lost, key, "left").fillna(0, subset=["_la", "_lb", "_aa", "_ab"]).join(third, key, "left").fillna(False, subset=["third_party"])
    f = f.withColumn("winner", F.when((F.col("_la") == 1) & (F.col("_lb") == 0), F.col("b")).when((F.col("_lb") == 1) & (F.col("_la") == 0), F.col("a")))
    f = f.where(F.col("winner").isNotNull() | (F.col("hits") >= least_hits))
    hp = t.health.select("match_id", "id", "t", (F.coalesce("health", F.lit(0.0)) + F.coalesce("shield", F.lit(0.0))).alias("hp"))
    for s in "ab":
        members = humans(t).select("match_id", F.col("team_index").alias(s), "id")
        probe = f.select(*key, (F.col("t0") - 1).alias("_t")).join(members, ["match_id", s])
        before = asof_join(probe, hp, ["match_id", "id"], ["hp"], time="_t", right_time="t").groupBy(*key).agg(F.avg("hp").alias(f"hp_{s}"))
        f = f.join(before, key, "left")
    f = asof_join(f, t.zones.select("match_id", "phase", "start_shrink_t"), ["match_id"], ["phase"], time="t0", right_time="start_shrink_t", how="left").drop("start_shrink_t_matched")
    gap, won_a = F.col("hp_a") - F.col("hp_b"), F.col("winner") == F.col("a")
    return f.withColumns(
        {
            "phase": F.coalesce("phase", F.lit(0)), "hp_gap": gap, "first_won": F.col("winner") == F.col("first"),
            "healthier_won": F.when(F.col("winner").isNotNull() & gap.isNotNull() & (gap != 0), F.when(gap > 0, won_a).otherwise(~won_a)),
            "winner_died": F.when(F.col("winner").isNotNull(), F.when(won_a, F.col("_aa") == 1).otherwise(F.col("_ab") == 1)),
        }
    ).drop("_la", "_lb", "_aa", "_ab")


#: Height over the other side and range of an exchange, in metres (fixed values).
HEIGHT_EDGES, HEIGHT_LABELS = (-1e9, -15.0, -5.0, 5.0, 15.0, 1e9), ("15 m below", "5-15 m below", "level", "5-15 m above", "15 m above")
RANGE_EDGES, RANGE_LABELS = (0.0, 20.0, 60.0, 1e9), ("close", "mid", "long")


def exchanges(t: Tables, gap_s: float = 15.0) -> DataFrame:
    """D-08: sessions of hits with both positions known, one row for each side."""
    h = player_hits(t)
    a = asof_join(h.withColumn("id", F.col("attacker_id")), t.positions, ["match_id", "id"], ["x", "y", "z"], tolerance=t.freshness, prefix="a_")
    b = asof_join(a.withColumn("id", F.col("target_id")), t.positions, ["match_id", "id"], ["x", "y", "z"], tolerance=t.freshness, prefix="b_")
    b = asof_join(b, t.zones.select("match_id", "phase", "start_shrink_t"), ["match_id"], ["phase"], right_time="start_shrink_t", how="left")
    b = b.withColumns({"s1": F.least("attacker_team", "target_team"), "s2": F.greatest("attacker_team", "target_team"), "above": (F.col("a_z") - F.col("b_z")) / 100, "dist": G.distance_m(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))})
    b = W.gap_sessions(b, ["match_id", "s1", "s2"], "t", gap_s, "exchange")
    sides = b.withColumn("side", F.explode(F.array("s1", "s2")))
    mine = F.col("attacker_team") == F.col("side")
    out = sides.groupBy("match_id", "s1", "s2", "exchange", "side").agg(
        F.min(F.coalesce("phase", F.lit(0))).alias("phase"), F.coalesce(F.sum(F.when(mine, F.col("amount"))), F.lit(0.0)).alias("dealt"), F.coalesce(F.sum(F.when(~mine, F.col("amount"))), F.lit(0.0)).alias("taken"),
        F.avg(F.when(mine, F.col("above")).otherwise(-F.col("above"))).alias("above_m"), F.median("dist").alias("dist_m"), F.count("*").alias("hits"),
    )
    return out.withColumns(
        {"height": S.bands(F.col("above_m"), HEIGHT_EDGES, HEIGHT_LABELS), "range": S.bands(F.col("dist_m"), RANGE_EDGES, RANGE_LABELS, right=False), "one_sided": (F.col("dealt") > 0) & (F.col("taken") == 0)}
    )


def surge_episodes(t: Tables, gap_s: float = 10.0, drops: DataFrame | None = None, hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """D-09: (episodes; one row for each player alive then, with whether they were hit and what they had dealt before).

    ``drops`` and ``hits``: the unexplained drops and the players' hits, where they are written already.
    """
    inside = (unexplained_drops(t) if drops is None else drops).where("not in_storm and phase is not null")
    ticks = inside.withColumn("_tick", W.rhythm("t", "id", "match_id")).where("_tick").select("match_id", "id", F.rint("t").alias("sec"), "lost", "phase")
    ticks = grown(ticks, "ticks")  # episodes and the players hit in them
    per_sec = ticks.groupBy("match_id", "sec").agg(F.countDistinct("id").alias("players"), F.median("lost").alias("lost"), F.max("phase").alias("phase"))
    per_sec = W.gap_sessions(per_sec, ["match_id"], "sec", gap_s, "episode")
    ep = per_sec.groupBy("match_id", "episode").agg(F.min("sec").alias("t0"), F.max("sec").alias("t1"), F.count("*").alias("ticks"), F.max("phase").alias("phase"), F.median("lost").alias("per_tick"))
    hit = ticks.join(per_sec.select("match_id", "sec", "episode"), ["match_id", "sec"]).select("match_id", "episode", "id").distinct().withColumn("surged", F.lit(True))
    alive = ep.select("match_id", "episode", F.col("t0").alias("t")).join(humans(t).select("match_id", "id", "team_index", "death_t", "final", "pr_rank"), "match_id").where("death_t is null or death_t > t")
    alive = alive.join(hit.hint("merge"), ["match_id", "episode", "id"], "left").fillna(False, subset=["surged"])
    before = alive.withColumn("t", F.col("t") - 1e-6)
    per = running_totals(before, (player_hits(t) if hits is None else hits).withColumn("id", F.col("attacker_id")), ["match_id", "id"], {"dealt": F.col("amount")}).withColumn("t", F.col("t") + 1e-6)
    return ep, per


def surge_rule(t: Tables, tie: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """D-10: (mean separation of each window, measure and level with the chosen one marked; players with its score and rank).

    A candidate's separation is the chance that a player who was not hit has the higher score. Team net damage in the
    zone, the published rule, wins within ``tie`` of the best.
    """
    hits = grown(player_hits(t), "hits")
    ep, per = (grown(x, "surge") for x in surge_episodes(t, hits=hits))
    by = Window.partitionBy("match_id").orderBy("episode")
    reveal = t.zones.select("match_id", (F.col("phase") + 1).alias("phase"), F.col("finish_shrink_t").alias("reveal"))
    ep = ep.join(reveal, ["match_id", "phase"], "left").withColumn("prev", F.lag("t1").over(by))
    far = F.lit(-1e9)
    starts = {"match": far, "zone": F.coalesce("reveal", far), "prev": F.coalesce("prev", far), "60": F.col("t0") - 60, "120": F.col("t0") - 120, "180": F.col("t0") - 180}
    own = ["match_id", "episode"]
    # an episode meets its match's hits once, every window is a sum of its own over them
    h = ep.select(*own, "t0", *(v.cast("double").alias(f"since_{k}") for k, v in starts.items())).join(hits.select("match_id", "t", "attacker_id", "target_id", "attacker_team", "target_team", "amount"), "match_id").where("t < t0")
    side = lambda level, who, gave: F.struct(F.lit(level).alias("level"), F.col(who).cast("bigint").alias("who"), F.lit(gave).alias("gave"))
    both = F.explode(F.array(side("player", "attacker_id", True), side("player", "target_id", False), side("team", "attacker_team", True), side("team", "target_team", False)))
    of = lambda k, gave: F.sum(F.when((F.col("gave") == gave) & (F.col("t") >= F.col(f"since_{k}")), F.col("amount")))
    sums = h.select("*", both.alias("_b")).select("*", "_b.*").groupBy(*own, "level", "who").agg(*(of(k, gave).alias(f"{n}_{k}") for k in starts for n, gave in (("dealt", True), ("taken", False))))
    who = F.explode(F.array(F.struct(F.lit("player").alias("level"), F.col("id").cast("bigint").alias("who")), F.struct(F.lit("team").alias("level"), F.col("team_index").cast("bigint").alias("who"))))
    rows = per.select(*own, "id", "team_index", "surged", "final", "pr_rank", who.alias("_w")).select("*", "_w.*").drop("_w").join(sums, [*own, "level", "who"], "left")
    got = {k: [F.coalesce(f"{n}_{k}", F.lit(0.0)) for n in ("dealt", "taken")] for k in starts}
    score = lambda k, m: F.struct(F.lit(k).alias("window"), F.lit(m).alias("measure"), (got[k][0] if m == "dealt" else got[k][0] - got[k][1]).alias("score"))
    scores = F.explode(F.array(*(score(k, m) for k in starts for m in ("dealt", "net"))))
    scored = rows.select(*own, "id", "team_index", "surged", "final", "pr_rank", "level", "who", scores.alias("_m")).select("*", "_m.*").drop("_m")
    cand = ["window", "measure", "level"]
    # a group is an episode's players
    auc = T.auc(scored.withColumn("_safe", ~F.col("surged")), [*own, *cand], "_safe", "score", small=True).where("n_pos >= 2 and n_neg >= 2")
    mean = auc.groupBy(*cand).agg(F.avg("auc").alias("auc"), F.count("*").alias("episodes"))
    all_ = Window.partitionBy(F.lit(0))  # at most 24 candidates
    published = (F.col("measure") == "net") & (F.col("level") == "team")
    wins = F.coalesce(F.max(F.when(published, F.col("auc"))).over(all_) >= F.max("auc").over(all_) - tie, F.lit(False))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc((wins & published).cast("int")), F.desc("auc"), *cand)
    mean = mean.withColumn("chosen", F.row_number().over(order) == 1)
    best = scored.join(F.broadcast(mean.where("chosen").select(*cand)), cand, "left_semi")
    return mean, best.withColumn("rank", R.percent_rank_min("score", ["match_id", "episode"]))


def team_zones(t: Tables, least_wait_s: float = 20.0, far_m: float = 50.0, look_m: float = 150.0, drops: DataFrame | None = None, per: DataFrame | None = None) -> DataFrame:
    """D-11: teams well outside a circle that waits: how they approached, who watched their way in, what it cost.

    ``drops`` and ``per``: the unexplained drops and the surge's players, where they are written already.
    """
    drops = grown(unexplained_drops(t), "drops") if drops is None else drops
    hits = grown(player_hits(t), "hits")
    per = surge_episodes(t, drops=drops, hits=hits)[1] if per is None else per
    by = Window.partitionBy("match_id").orderBy("phase")
    first = t.matches.select("match_id", "safe_zones_start_t") if "safe_zones_start_t" in t.matches.columns else t.matches.select("match_id", F.lit(None).cast("double").alias("safe_zones_start_t"))
    w = t.zones.select("match_id", *ZONE, F.lag("finish_shrink_t").over(by).alias("_r"), F.coalesce(F.lag("finish_shrink_t", 2).over(by), F.lit(0.0)).alias("prev")).join(first, "match_id", "left")
    w = w.withColumn("reveal", F.coalesce("_r", "safe_zones_start_t")).where((F.col("start_shrink_t") - F.col("reveal") >= least_wait_s) & F.col("next_x").isNotNull()).withColumn("mid", (F.col("reveal") + F.col("start_shrink_t")) / 2)
    a = w.join(humans(t).select("match_id", "id", "team_index", "death_t", "final"), "match_id").where("death_t is null or death_t > reveal").withColumn("t_mid", F.least("mid", F.coalesce(F.col("death_t") - 0.5, F.col("mid"))))
    a = asof_join(a, t.positions, ["match_id", "id"], ["x", "y"], time="reveal", right_time="t", prefix="a_").drop("a_t_matched")
    a = asof_join(a, t.positions, ["match_id", "id"], ["x", "y"], time="t_mid", right_time="t", prefix="b_").drop("b_t_matched")
    key = ["match_id", "phase", "team_index"]
    zone = ["reveal", "prev", "start_shrink_t", "finish_shrink_t", "next_x", "next_y", "next_r"]
    g = a.groupBy(*key).agg(
        *(F.avg(c).alias(c) for c in ("a_x", "a_y", "b_x", "b_y")), F.count("*").alias("members"), F.min("final").alias("final"),
        F.when(F.count("death_t") == F.count("*"), F.max("death_t")).alias("last_death"), *(F.any_value(c).alias(c) for c in zone),
    )
    out = lambda x, y: F.greatest(G.distance_m(F.col(x), F.col(y), F.col("next_x"), F.col("next_y")) - F.col("next_r") / 100, F.lit(0.0))
    ex, ey = G.way_in(F.col("a_x"), F.col("a_y"), F.col("next_x"), F.col("next_y"), F.col("next_r"))
    g = g.withColumns({"dist_m": out("a_x", "a_y"), "dist_mid_m": out("b_x", "b_y"), "_ex": ex, "_ey": ey})
    watch = g.where("dist_m <= 0").select("match_id", "phase", F.col("team_index").alias("_team"), F.col("a_x").alias("_wx"), F.col("a_y").alias("_wy"))
    look = g.join(watch.hint("merge"), ["match_id", "phase"]).where((F.col("_team") != F.col("team_index")) & (G.distance_m(F.col("_ex"), F.col("_ey"), F.col("_wx"), F.col("_wy")) <= look_m)).groupBy(*key).agg(F.count("*").alias("lookers"))
    g = g.join(look.hint("merge"), key, "left").fillna(0, subset=["lookers"]).drop("_ex", "_ey")
    mine = F.explode(F.array(F.struct(F.col("attacker_team").alias("team_index"), F.col("amount").alias("d"), F.lit(0.0).alias("k")), F.struct(F.col("target_team").alias("team_index"), F.lit(0.0).alias("d"), F.col("amount").alias("k"))))
    h = hits.select("match_id", F.col("t").alias("r_t"), mine.alias("_m")).select("match_id", "r_t", "_m.*").withColumn("net_amount", F.col("d") - F.col("k"))
    storm = drops.where("in_storm").join(humans(t).select("match_id", "id", "team_index"), ["match_id", "id"]).select("match_id", "team_index", F.col("t").alias("r_t"), "lost")
    hit = per.where("surged").select("match_id", "team_index", F.col("t").alias("r_t"), F.lit(1.0).alias("one")).distinct()
    facts = h.unionByName(storm, allowMissingColumns=True).unionByName(hit, allowMissingColumns=True)
    f = lambda c: F.col(c)
    wait, zone = (f("reveal"), f("start_shrink_t")), (f("reveal"), f("finish_shrink_t"))
    spans = {"net_prev": (f("prev"), f("reveal")), "net": zone, "dealt": zone, "taken": zone, "taken_wait": wait, "storm": zone, "surge_hits": (f("reveal"), f("finish_shrink_t") + 1)}
    of = {"net_prev": "net_amount", "net": "net_amount", "dealt": "d", "taken": "k", "taken_wait": "k", "storm": "lost", "surge_hits": "one"}
    g = window_sums(g, facts, ["match_id", "team_index"], spans, of, key)
    half = F.median("net_prev").over(Window.partitionBy("match_id", "phase"))
    closed = F.try_divide(F.col("dist_m") - F.col("dist_mid_m"), "dist_m")
    return g.withColumns(
        {
            "surge_half": F.when(F.col("net_prev") <= half, "Bottom half").otherwise("Top half"), "surged": F.col("surge_hits") > 0,
            "out": F.coalesce(F.col("last_death") <= F.col("finish_shrink_t"), F.lit(False)),
            "approach": F.when((F.col("dist_mid_m") <= 0) | (closed >= 0.5), "rotated").when(closed < 0.2, "stayed").otherwise("between"),
        }
    ).withColumn("safe_alive", ~F.col("surged") & ~F.col("out")).where(F.col("dist_m") >= far_m)


def loot_per_player(t: Tables, window_s: float = 120.0) -> DataFrame:
    """D-12: what each landed player found within ``window_s`` of landing."""
    land = t.landings.select("match_id", "id", "land_t", "poi", "final", "death_t", "opp_150m", "pr_rank").where("final is not null")
    key = ["match_id", "id"]

    def since(events: DataFrame, who: str, at: str, *more: str) -> DataFrame:
        e = events.where(F.col(who).isNotNull() & F.col(at).isNotNull()).select("match_id", F.col(who).alias("id"), F.col(at).alias("_t"), *more)
        return e.join(land.select(*key, "land_t"), key).withColumn("since", F.col("_t") - F.col("land_t")).where(F.col("since").between(-5, window_s))

    chest = since(t.chests, "searched_by", "t").groupBy(*key).agg(F.min("since").alias("first_chest_s"), F.count("*").alias("chests"))
    item = since(t.pickups, "picked_by", "picked_t", "category").groupBy(*key).agg(
        F.count("*").alias("items"), F.count_if(F.col("category") == "weapon").alias("weapons"), F.count_if(F.col("category") == "heal/shield").alias("heals")
    )
    held = since(t.weapons_held.where("category = 'weapon'"), "id", "t", "weapon", "rarity")
    held = held.withColumns({"_c": S.weapon_class(F.col("weapon")), "_r": S.rarity_rank(F.col("rarity"))}).groupBy(*key).agg(
        F.max("_r").alias("best_rarity"), A.has_all("_c", ["assault rifle", "shotgun"]).alias("ar_and_shotgun")
    )
    out = land.join(chest, key, "left").join(item, key, "left").join(held, key, "left")
    return out.fillna(0, subset=["chests", "items", "weapons", "heals"]).fillna(False, subset=["ar_and_shotgun"]).withColumn("survived", F.col("death_t").isNull() | (F.col("death_t") > F.col("land_t") + window_s))


def pulls(t: Tables, bus: DataFrame | None = None, rms_cm: float = 10_000.0) -> DataFrame:
    """D-13: each pull's direction, its turn from the one before and, where the route is trusted, against the bus."""
    from tidemark.sources.documents import zone_features

    z = zone_features(t.zones)
    by = Window.partitionBy("match_id").orderBy("phase")
    z = z.withColumn("turn_deg", G.turn(F.lag("angle_deg").over(by), F.col("angle_deg")))
    if bus is None:
        return z.withColumn("bus_deg", F.lit(None).cast("double"))
    known = bus.where((F.col("bus_source") == "aircraft") | ((F.col("fit_rms") <= rms_cm) & F.col("direction_known"))).select("match_id", F.col("bearing_deg").alias("_b"))
    return z.join(known, "match_id", "left").withColumn("bus_deg", G.turn(F.col("_b"), F.col("angle_deg"))).drop("_b")


def _steps(t: Tables) -> DataFrame:
    by = Window.partitionBy("match_id").orderBy("phase")
    z = t.zones.select("match_id", *ZONE, F.lag("finish_shrink_t").over(by).alias("prev_finish"))
    return z.where("prev_finish is not null and cur_x is not null and finish_shrink_t > start_shrink_t")


def _members(t: Tables, step_s: float, hp: bool = False) -> DataFrame:
    """Living players every ``step_s``; only the phase's number goes with them, its circle is joined to the teams.

    With ``hp`` also their last known health: positions and changes of health go through the same window.
    """
    # steps count from the reveal, not from zero
    z = _steps(t).withColumns({"_b": F.lit(0.0), "_e": F.floor("finish_shrink_t") - F.ceil("prev_finish").cast("double")})
    grid = time_grid(z, "_b", "_e", step_s, "_s").withColumn("t", F.ceil("prev_finish") + F.col("_s"))
    own = humans(t).select("match_id", "id", "team_index", "death_t", F.col("final").alias("placement"))
    a = grid.select("match_id", "phase", "t").join(own, "match_id").where("death_t is null or death_t > t").drop("death_t")
    if not hp:
        return asof_join(a, t.positions, ["match_id", "id"], ["x", "y", "z"]).drop("t_matched")
    who = ["match_id", "id"]
    known = lambda df: df.where("match_id is not null and id is not null and t is not null")
    rows = a.select(*who, "t", F.lit(1).alias("_side"), F.struct(*a.columns).alias("_own"))
    rows = rows.unionByName(known(t.positions.select(*who, "t", "x", "y", "z")).select(*who, "t", F.lit(0).alias("_side"), F.struct("x", "y", "z").alias("_at")), allowMissingColumns=True)
    total = F.coalesce("health", F.lit(0.0)) + F.coalesce("shield", F.lit(0.0))
    rows = rows.unionByName(known(t.health.select(*who, "t", total.alias("_hp"))).select(*who, "t", F.lit(0).alias("_side"), "_hp"), allowMissingColumns=True)
    upto = Window.partitionBy(*who).orderBy("t", "_side", "_at", "_hp").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("_own", *(F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("_at", "_hp"))).where("_own is not null and _at is not null")
    return found.select("_own.*", *(F.col(f"_at.{c}").alias(c) for c in "xyz"), F.col("_hp").alias("hp"))


def places_of_teams(t: Tables, step_s: float = 10.0, members: DataFrame | None = None) -> DataFrame:
    """Each living team every ``step_s``, with its mean place against the circle and the lobby (D-15 without what it was through)."""
    if members is None:
        key = ["match_id", "t", "team_index"]
        members = _members(t, step_s).groupBy(*key).agg(*(F.avg(c).alias(c) for c in "xyz"), F.any_value("phase").alias("phase"))
    moment = ["match_id", "t"]
    off = F.try_divide(G.distance_m(F.col("x"), F.col("y"), F.col("cur_x"), F.col("cur_y")) * 100, "cur_r")
    return members.join(_steps(t), ["match_id", "phase"]).withColumns({"off_centre": off, "height_rank": R.percent_rank_average("z", moment)})


def snapshots(t: Tables, step_s: float = 10.0, scheme: DataFrame | None = None, near_m: tuple[int, int] = (50, 150)) -> DataFrame:
    """D-15: every living team every ``step_s`` from the second circle's reveal on, with what a player could know and the points still to come."""
    z = _steps(t)
    a = _members(t, step_s, hp=True)
    key = ["match_id", "t", "team_index"]
    g = a.groupBy(*key).agg(F.count("*").alias("members"), *(F.avg(c).alias(c) for c in ("hp", "x", "y", "z")), F.min("placement").alias("placement"), F.any_value("phase").alias("phase"))
    g = grown(g, "moments")
    usual = g.agg(F.median("hp").alias("_usual"))  # of unknown health nothing better is known
    d = G.distance_m(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y"))
    moment = ["match_id", "t"]
    g = places_of_teams(t, step_s, g)
    g = g.withColumns(
        {
            "teams_alive": F.count("*").over(Window.partitionBy(*moment)), "progress": (F.col("t") - F.col("prev_finish")) / (F.col("finish_shrink_t") - F.col("prev_finish")),
            "outside_m": F.greatest(d - F.col("next_r") / 100, F.lit(0.0)), "storm_m": F.greatest(-G.storm_margin(F.col("x"), F.col("y"), F.col("t"), _phase(g)), F.lit(0.0)),
        }
    )
    g = neighbour_counts(g, moment, "team_index", list(near_m)).withColumnsRenamed({f"near_{near_m[0]}": "enemies_50", f"near_{near_m[1]}": "enemies_150"}).drop("nearest_m")
    hits = player_hits(t)
    down = ~F.coalesce(F.col("downed"), F.lit(False)) if "downed" in t.kills.columns else F.lit(True)
    sides = L.humans(t.players).select("match_id", "id", "team_index")
    k = t.kills.where(down).join(t.players.select("match_id", F.col("id").alias("finisher_id"), "team_index"), ["match_id", "finisher_id"])
    k = k.join(sides.withColumnsRenamed({"id": "victim_id", "team_index": "_v"}), ["match_id", "victim_id"]).where(L.opponents(F.col("team_index"), F.col("_v")))
    team = ["match_id", "team_index"]
    none = F.lit(None).cast("double")
    side = lambda who, taken, dealt: F.struct(F.col(who).alias("team_index"), taken.alias("taken"), dealt.alias("dealt"))
    amount = F.col("amount").cast("double")
    facts = hits.select("match_id", "t", F.explode(F.array(side("target_team", amount, none), side("attacker_team", none, amount))).alias("_s")).select("match_id", "_s.team_index", "t", "_s.taken", "_s.dealt", none.alias("kill"))
    facts = facts.unionByName(k.select("match_id", "team_index", "t", none.alias("taken"), none.alias("dealt"), F.lit(1.0).alias("kill")))
    # running totals at the moment, ten seconds before and at the reveal give every interval's sum; the moments go through one window
    of = {"_k1": F.col("taken"), "_d1": F.col("dealt"), "kills": F.col("kill")}
    total = k.groupBy(*team).agg(F.count("*").alias("_all"))
    skill = L.humans(t.players).groupBy(*team).agg(A.geometric_mean(F.col("pr_rank")).alias("skill"))
    reveals = skill.join(total, team, "left").join(z.select("match_id", F.col("prev_finish").alias("t")).distinct(), "match_id")
    own = g.columns
    asked = g.withColumn("_reveal", F.lit(False)).unionByName(reveals.withColumn("_reveal", F.lit(True)), allowMissingColumns=True)
    known = grown(running_totals(asked, facts, team, of, ago={"_k0": ("_k1", 10)}), "totals")
    g = known.where("not _reveal").select(*own, *of, "_k0")
    reveals = known.where("_reveal").select(*reveals.columns, F.col("_k1").alias("_k2"), F.col("_d1").alias("_d2")).withColumnRenamed("t", "prev_finish")
    g = g.join(reveals, [*team, "prev_finish"], "left").fillna(0.0, subset=["_k2", "_d2"]).fillna(0, subset=["_all"])
    g = g.withColumns({"hit_10s": F.col("_k1") - F.col("_k0"), "net": F.col("_d1") - F.col("_d2") - F.col("_k1") + F.col("_k2")}).drop("_k0", "_k1", "_k2", "_d1", "_d2")
    g = g.withColumn("surge_rank", R.percent_rank_average("net", moment))
    scheme = scheme if scheme is not None else P.scheme(t.players.sparkSession, P.DUOS)
    g = P.scored(g.withColumn("_to_come", F.greatest(F.col("_all") - F.col("kills"), F.lit(0.0))), scheme, "placement", "_to_come").withColumnRenamed("points", "future_pts").drop("_all", "_to_come")
    lobby = L.humans(t.players).groupBy("match_id").agg(F.median(F.coalesce("pr_rank", F.lit(100_000.0))).alias("lobby_skill"))
    g = g.crossJoin(F.broadcast(usual)).withColumn("hp", F.coalesce("hp", "_usual", F.lit(100.0))).join(lobby, "match_id", "left")
    return g.select(
        *team, "placement", "t", "members", "hp", "x", "y", "z", *ZONE, "prev_finish", "teams_alive", "progress", "outside_m", "storm_m", "off_centre", "height_rank",
        "enemies_50", "enemies_150", "hit_10s", "net", "surge_rank", "kills", "future_pts", "skill", "lobby_skill",
    )


def damage_causes(t: Tables, before_s: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """D-25: (every drop as hit, storm, surge or other; each death's last damage within ``before_s``)."""
    u = unexplained_drops(t).withColumn("_tick", W.rhythm("t", "id", "match_id"))
    u = u.select("match_id", "id", "t", "lost", F.when(F.col("in_storm"), "storm").when(F.col("_tick"), "surge").otherwise("other").alias("cause"), F.lit(None).cast("bigint").alias("by"))
    h = player_hits(t).select("match_id", F.col("target_id").alias("id"), "t", F.col("amount").alias("lost"), F.lit("hit").alias("cause"), F.col("attacker_id").cast("bigint").alias("by"))
    log = u.unionByName(h)
    dead = humans(t).where("death_t is not null").select("match_id", "id", "death_t")
    killer = asof_join(dead, log, ["match_id", "id"], ["cause", "by"], time="death_t", right_time="t", how="left", tolerance=before_s)
    return log, killer


def evidence_spacing(t: Tables) -> DataFrame:
    """D-28 in part: how far a team's members are from their centre at each shrink's start, and where they finish."""
    s = t.zones.select("match_id", "phase", F.col("start_shrink_t").alias("at")).join(humans(t).select("match_id", "id", "team_index", "death_t", "final"), "match_id").where("death_t is null or death_t > at")
    j = asof_join(s, t.positions, ["match_id", "id"], ["x", "y"], time="at", right_time="t")
    w = Window.partitionBy("match_id", "phase", "team_index")
    j = j.withColumn("_d", G.distance_m(F.col("x"), F.col("y"), F.avg("x").over(w), F.avg("y").over(w)))
    return j.groupBy("match_id", "phase", "team_index").agg(F.avg("_d").alias("spacing_m"), F.min("final").alias("final"), F.count("*").alias("members")).where("members > 1")


def lobby_groups(matches: DataFrame) -> DataFrame:
    """D-34: the strongest third by strength against the rest; all one group where under half are rated."""
    s = matches.agg(F.percentile("lobby_strength", F.lit(2 / 3)).alias("_p"), (F.count("lobby_strength") / F.count("*")).alias("_r"))
    return matches.crossJoin(F.broadcast(s)).select("match_id", F.when(F.col("_r") < 0.5, "all").when(F.col("lobby_strength") >= F.col("_p"), "strongest third").otherwise("rest").alias("lobby"))


def alive_by_phase(t: Tables) -> DataFrame:
    """D-35."""
    by = Window.partitionBy("match_id").orderBy("phase")
    z = t.zones.select("match_id", "phase", F.coalesce(F.lag("finish_shrink_t").over(by), F.lit(0.0)).alias("reveal"))
    return z.join(humans(t), "match_id").groupBy("match_id", "phase").agg(F.count_if(F.col("death_t").isNull() | (F.col("death_t") > F.col("reveal"))).alias("alive"))

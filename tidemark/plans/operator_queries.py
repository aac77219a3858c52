"""Operator queries over the given tables, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
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
from tidemark.operators.asof import asof_join, fresh, running_totals
from tidemark.operators.interval import interval_join, time_grid, window_sums, within_phase
from tidemark.operators.spatial import grid_density, nearest_place, neighbour_counts
from tidemark.sources.arena import ARENA_SQL, Arena

QUERIES, ORACLES = {}, {}


def registered(name: str, sql: str | None = None, arena: bool = True):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Arena(spark, sf_dir))
        if sql:
            # one query says its next row from the last one
            ORACLES[name] = f"WITH {'RECURSIVE ' if sql.startswith('k(') else ''}{ARENA_SQL}{', ' if sql.lstrip()[:6].upper() != 'SELECT' else ' '}{sql}" if arena else sql
        return f

    return add


def r6(c, name: str, digits: int = 6):
    """Rounded for comparison; no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, digits) + 0.0).alias(name)


PHASE_COLUMNS = ["phase", "cur_x", "cur_y", "cur_r", "next_x", "next_y", "next_r", "start_shrink_t", "finish_shrink_t"]
MARGIN = """(cur_r + (next_r - cur_r) * f) / 100 - sqrt(pow(x - (cur_x + (next_x - cur_x) * f), 2) + pow(y - (cur_y + (next_y - cur_y) * f), 2)) / 100"""
SHARE_OF_MOVE = "least(greatest((t - start_shrink_t) / (finish_shrink_t - start_shrink_t), 0), 1)"


def margin(df: DataFrame):
    phase = {k: F.col(k) for k in ("cur_x", "cur_y", "cur_r", "next_x", "next_y", "next_r")}
    return G.storm_margin(F.col("x"), F.col("y"), F.col("t"), phase | {"start": F.col("start_shrink_t"), "finish": F.col("finish_shrink_t")})


# ---- joins ------------------------------------------------------------------------------------------------------


@registered(
    "study_eliminations",
    f"""k AS (SELECT kills.*, p.* EXCLUDE (match_id), {SHARE_OF_MOVE} AS f FROM kills ASOF JOIN phases p
      ON kills.match_id = p.match_id AND kills.t >= p.start_shrink_t)
    SELECT phase, count(*) AS n, round(avg(CASE WHEN {MARGIN} < 0 THEN 1.0 ELSE 0.0 END), 6) AS outside,
      round(median(sqrt(pow(x - next_x, 2) + pow(y - next_y, 2)) / 100), 4) AS median_m FROM k GROUP BY phase""",
)
def eliminations(a: Arena) -> DataFrame:
    """K-06, J-01, X-01, X-02, G-11: where eliminations fall against the closing circle."""
    k = asof_join(a.kills, a.phases, ["match_id"], PHASE_COLUMNS, right_time="start_shrink_t")
    k = k.withColumn("_out", margin(k) < 0).withColumn("_d", G.distance_m(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y")))
    return k.groupBy("phase").agg(F.count("*").alias("n"), r6(A.share(F.col("_out")), "outside"), r6(F.median("_d"), "median_m", 4))


@registered(
    "asof_left_fresh",
    """j AS (SELECT h.match_id, h.attacker_id, h.t, c.health, c.t AS seen FROM hits h ASOF LEFT JOIN changes c
      ON h.match_id = c.match_id AND h.target_id = c.id AND h.t >= c.t)
    SELECT match_id, count(*) AS n, count(seen) AS known, count(*) FILTER (t - seen <= 30) AS fresh, round(sum(health) FILTER (t - seen <= 30), 4) AS health FROM j GROUP BY match_id""",
)
def asof_left(a: Arena) -> DataFrame:
    """J-02, J-03: target's health at a hit, kept without one, and how many are fresh."""
    left = a.hits.select("match_id", F.col("target_id").alias("id"), "attacker_id", "t", "l_orderkey", "l_linenumber")
    j = asof_join(left, a.changes, ["match_id", "id"], ["health"], how="left")
    ok = F.col("t") - F.col("t_matched") <= 30
    return j.groupBy("match_id").agg(
        F.count("*").alias("n"), F.count("t_matched").alias("known"), F.count_if(ok).alias("fresh"), r6(F.sum(F.when(ok, F.col("health"))), "health", 4)
    )


@registered(
    "asof_tolerance_both_ways",
    """b AS (SELECT s.match_id, s.id, s.t, p.z AS back_z, p.t AS back_t FROM changes s ASOF LEFT JOIN tracks p ON s.match_id = p.match_id AND s.id = p.id AND s.t >= p.t),
    f AS (SELECT s.match_id, s.id, s.t, p.z AS next_z, p.t AS next_t FROM changes s ASOF LEFT JOIN tracks p ON s.match_id = p.match_id AND s.id = p.id AND s.t <= p.t)
    SELECT b.match_id, count(*) AS n, count(back_z) FILTER (b.t - back_t <= 1.5) AS back, count(next_z) FILTER (next_t - f.t <= 2.5) AS ahead,
      round(sum(back_z) FILTER (b.t - back_t <= 1.5), 4) AS back_z, round(sum(next_z) FILTER (next_t - f.t <= 2.5), 4) AS next_z
    FROM b JOIN f USING (match_id, id, t) GROUP BY b.match_id""",
)
def asof_both(a: Arena) -> DataFrame:
    """J-04, J-05: nearest position before (1.5 s) and after (2.5 s) each change."""
    j = asof_join(a.changes.select("match_id", "id", "t"), a.tracks, ["match_id", "id"], ["z"], how="left", tolerance=1.5, prefix="back_")
    j = asof_join(j, a.tracks, ["match_id", "id"], ["z"], how="left", direction="forward", tolerance=2.5, prefix="next_")
    return j.groupBy("match_id").agg(
        F.count("*").alias("n"), F.count("back_z").alias("back"), F.count("next_z").alias("ahead"), r6(F.sum("back_z"), "back_z", 4), r6(F.sum("next_z"), "next_z", 4)
    )


@registered(
    "asof_chained",
    """s AS (SELECT m.match_id, m.phase, e.id, m.start_shrink_t, m.finish_shrink_t FROM phases m JOIN players e USING (match_id)),
    a AS (SELECT s.*, p.x AS x0, p.y AS y0 FROM s ASOF JOIN tracks p ON s.match_id = p.match_id AND s.id = p.id AND s.start_shrink_t >= p.t),
    b AS (SELECT a.*, p.x AS x1, p.y AS y1 FROM a ASOF JOIN tracks p ON a.match_id = p.match_id AND a.id = p.id AND a.finish_shrink_t >= p.t)
    SELECT phase, count(*) AS n, round(avg(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) / 100), 4) AS moved_m FROM b GROUP BY phase""",
)
def asof_chained(a: Arena) -> DataFrame:
    """J-06: position at the start and at the end of each shrink."""
    s = a.phases.select("match_id", "phase", "start_shrink_t", "finish_shrink_t").join(a.players.select("match_id", "id"), "match_id")
    one = asof_join(s, a.tracks, ["match_id", "id"], ["x", "y"], time="start_shrink_t", right_time="t", prefix="a_")
    two = asof_join(one, a.tracks, ["match_id", "id"], ["x", "y"], time="finish_shrink_t", right_time="t", prefix="b_")
    d = G.distance_m(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    return two.groupBy("phase").agg(F.count("*").alias("n"), r6(F.avg(d), "moved_m", 4))


DROPS_SQL = """d AS (SELECT *, h0 - hs AS lost FROM (SELECT match_id, id, t, health + shield AS hs, lag(health + shield) OVER (PARTITION BY match_id, id ORDER BY t) AS h0 FROM changes) WHERE h0 - hs > 0.5),
    u AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.match_id = d.match_id AND h.target_id = d.id AND h.t BETWEEN d.t - 1.5 AND d.t + 0.5))"""


def drops(a: Arena) -> DataFrame:
    by = Window.partitionBy("match_id", "id").orderBy("t")
    both = F.col("health") + F.col("shield")
    d = a.changes.select("match_id", "id", "t", both.alias("hs"), F.lag(both).over(by).alias("h0"))
    return d.withColumn("lost", F.col("h0") - F.col("hs")).where("lost > 0.5")


def target_hits(a: Arena) -> DataFrame:
    return a.hits.select("match_id", F.col("target_id").alias("id"), F.col("t").alias("r_t"), "amount")


@registered(
    "interval_explained_drops",
    """d AS (SELECT *, h0 - hs AS lost FROM (SELECT match_id, id, t, health + shield AS hs, lag(health + shield) OVER (PARTITION BY match_id, id ORDER BY t) AS h0 FROM changes) WHERE h0 - hs > 0.5)
    SELECT d.match_id, count(*) AS pairs, round(sum(lost), 4) AS lost, round(sum(amount), 4) AS amount FROM d JOIN hits h ON h.match_id = d.match_id AND h.target_id = d.id AND h.t BETWEEN d.t - 1.5 AND d.t + 0.5 GROUP BY d.match_id""",
)
def explained(a: Arena) -> DataFrame:
    """J-07: hits within [t - 1.5, t + 0.5] of a health drop."""
    j = interval_join(drops(a), target_hits(a), ["match_id", "id"], 1.5, 0.5)
    return j.groupBy("match_id").agg(F.count("*").alias("pairs"), r6(F.sum("lost"), "lost", 4), r6(F.sum("amount"), "amount", 4))


def unexplained_drops(a: Arena) -> DataFrame:
    """D-02: drops without a hit, in or out of the moving circle, with the phase."""
    u = interval_join(drops(a), target_hits(a), ["match_id", "id"], 1.5, 0.5, how="left_anti")
    u = asof_join(u, a.tracks, ["match_id", "id"], ["x", "y"], how="left")
    u = asof_join(u, a.phases, ["match_id"], PHASE_COLUMNS, right_time="start_shrink_t", how="left")
    return u.withColumn("outside", margin(u) < 0)


@registered(
    "detect_unexplained_drops",
    f"""{DROPS_SQL},
    p AS (SELECT u.match_id, u.id, u.t, u.lost, k.x, k.y FROM u ASOF LEFT JOIN tracks k ON u.match_id = k.match_id AND u.id = k.id AND u.t >= k.t),
    q AS (SELECT p.*, z.* EXCLUDE (match_id), {SHARE_OF_MOVE} AS f FROM p ASOF LEFT JOIN phases z ON p.match_id = z.match_id AND p.t >= z.start_shrink_t)
    SELECT phase, count(*) AS n, round(sum(lost), 4) AS lost, count(*) FILTER ({MARGIN} < 0) AS outside FROM q GROUP BY phase""",
)
def detect_drops(a: Arena) -> DataFrame:
    u = unexplained_drops(a)
    return u.groupBy("phase").agg(F.count("*").alias("n"), r6(F.sum("lost"), "lost", 4), F.count_if(F.col("outside")).alias("outside"))


@registered(
    "samples_in_phase",
    f"""s AS (SELECT k.match_id, k.id, k.t, k.x, k.y, p.* EXCLUDE (match_id), {SHARE_OF_MOVE} AS f FROM tracks k JOIN phases p ON k.match_id = p.match_id AND k.t BETWEEN p.start_shrink_t - 65 AND p.finish_shrink_t)
    SELECT phase, count(*) AS n, count(DISTINCT (match_id, id)) AS players, count(*) FILTER ({MARGIN} < 0) AS outside, round(avg({MARGIN}), 4) AS margin_m FROM s GROUP BY phase""",
)
def storm_samples(a: Arena) -> DataFrame:
    """J-09, D-14: samples inside a phase, with their margin to the moving edge."""
    p = a.phases.withColumn("reveal_t", F.col("start_shrink_t") - 65)
    s = within_phase(a.tracks, p, "reveal_t", "finish_shrink_t")
    s = s.withColumn("margin", margin(s))
    return s.groupBy("phase").agg(
        F.count("*").alias("n"), F.countDistinct("match_id", "id").alias("players"), F.count_if(F.col("margin") < 0).alias("outside"), r6(F.avg("margin"), "margin_m", 4)
    )


@registered(
    "interval_sums",
    """s AS (SELECT p.match_id, p.phase, e.id, p.start_shrink_t AS t FROM phases p JOIN players e USING (match_id)),
    d AS (SELECT s.match_id, s.phase, s.id, coalesce(sum(amount) FILTER (h.t > s.t - 10 AND h.t <= s.t), 0) AS last10,
      coalesce(sum(amount) FILTER (h.t > s.t - 110 AND h.t <= s.t), 0) AS zone FROM s LEFT JOIN hits h ON h.match_id = s.match_id AND h.attacker_id = s.id AND h.t > s.t - 110 AND h.t <= s.t GROUP BY ALL)
    SELECT phase, count(*) AS n, round(sum(last10), 4) AS last10, round(sum(zone), 4) AS zone, count(*) FILTER (zone > 0) AS active FROM d GROUP BY phase""",
)
def interval_sums(a: Arena) -> DataFrame:
    """J-10: damage in the last 10 s and in the last zone, at each shrink start."""
    s = a.phases.select("match_id", "phase", F.col("start_shrink_t").alias("t")).join(a.players.select("match_id", "id"), "match_id")
    h = a.hits.select("match_id", F.col("attacker_id").alias("id"), F.col("t").alias("r_t"), "amount")
    spans = {"last10": (F.col("t") - 10, F.col("t")), "zone": (F.col("t") - 110, F.col("t"))}
    d = window_sums(s, h, ["match_id", "id"], spans, "amount", ["match_id", "phase", "id"])
    return d.groupBy("phase").agg(F.count("*").alias("n"), r6(F.sum("last10"), "last10", 4), r6(F.sum("zone"), "zone", 4), F.count_if(F.col("zone") > 0).alias("active"))


@registered(
    "net_damage_series",
    """g AS (SELECT match_id, id, CAST(k * 5 AS DOUBLE) AS t FROM players, range(0, 240) AS r(k) WHERE k % 12 = 0),
    d AS (SELECT g.match_id, g.id, g.t, coalesce(sum(amount), 0) AS dealt FROM g LEFT JOIN hits h ON h.match_id = g.match_id AND h.attacker_id = g.id AND h.t <= g.t GROUP BY ALL),
    k AS (SELECT g.match_id, g.id, g.t, coalesce(sum(amount), 0) AS taken FROM g LEFT JOIN hits h ON h.match_id = g.match_id AND h.target_id = g.id AND h.t <= g.t GROUP BY ALL)
    SELECT t, count(*) AS n, round(sum(dealt - taken), 4) AS net, round(max(dealt - taken), 4) AS best FROM d JOIN k USING (match_id, id, t) GROUP BY t""",
)
def net_series(a: Arena) -> DataFrame:
    """J-10 by running totals, D-26: net damage so far on a time grid."""
    spans = a.players.select("match_id", "id", F.lit(0.0).alias("b"), F.lit(1200.0).alias("e"))
    g = time_grid(spans, "b", "e", 60.0).select("match_id", "id", "t")
    dealt = running_totals(g, a.hits.withColumn("id", F.col("attacker_id")), ["match_id", "id"], {"dealt": F.col("amount")})
    both = running_totals(dealt, a.hits.withColumn("id", F.col("target_id")), ["match_id", "id"], {"taken": F.col("amount")})
    net = F.col("dealt") - F.col("taken")
    return both.groupBy("t").agg(F.count("*").alias("n"), r6(F.sum(net), "net", 4), r6(F.max(net), "best", 4))


@registered(
    "hit_within_next",
    """SELECT h.match_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM hits g WHERE g.match_id = h.match_id AND g.attacker_id = h.target_id AND g.t > h.t AND g.t <= h.t + 10)) AS answered
    FROM hits h GROUP BY h.match_id""",
)
def answered(a: Arena) -> DataFrame:
    """J-11: whether the target hits anyone within the next 10 s."""
    h = a.hits.withColumn("id", F.col("target_id"))
    g = a.hits.select("match_id", F.col("attacker_id").alias("id"), F.col("t").alias("r_t")).withColumn("r_t", F.col("r_t") - 1e-9)
    yes = interval_join(h, g, ["match_id", "id"], 0.0, 10.0, how="left_semi").groupBy("match_id").agg(F.count("*").alias("answered"))
    return a.hits.groupBy("match_id").agg(F.count("*").alias("n")).join(yes, "match_id", "left").fillna(0, subset=["answered"])


POSITIONS_SQL = """s AS (SELECT m.match_id, m.phase, e.id, e.team_index, m.start_shrink_t, m.next_x, m.next_y, m.next_r, e.placement FROM phases m JOIN players e USING (match_id)),
    a AS (SELECT s.*, p.x, p.y, p.z, p.t AS seen FROM s ASOF JOIN tracks p ON s.match_id = p.match_id AND s.id = p.id AND s.start_shrink_t >= p.t)"""


def positions_at_shrink(a: Arena, limit: float | None = None) -> DataFrame:
    s = a.phases.select("match_id", "phase", "start_shrink_t", "next_x", "next_y", "next_r").join(a.players.select("match_id", "id", "team_index", "placement"), "match_id")
    j = asof_join(s, a.tracks, ["match_id", "id"], ["x", "y", "z"], time="start_shrink_t", right_time="t")
    return fresh(j, limit, "start_shrink_t") if limit else j


@registered(
    "neighbours_within",
    f"""{POSITIONS_SQL},
    n AS (SELECT a.match_id, a.phase, a.id, count(b.id) FILTER (d <= 150) AS n150, count(b.id) FILTER (d <= 300) AS n300, min(d) AS near FROM a LEFT JOIN LATERAL (
      SELECT b.id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 100 AS d FROM a b WHERE b.match_id = a.match_id AND b.phase = a.phase AND b.team_index <> a.team_index
      AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 100 <= 300) b ON true GROUP BY ALL)
    SELECT phase, count(*) AS n, CAST(sum(n150) AS BIGINT) AS near_150, CAST(sum(n300) AS BIGINT) AS near_300, round(avg(near), 4) AS nearest_m FROM n GROUP BY phase""",
)
def neighbours(a: Arena) -> DataFrame:
    """J-14, B-12: opponents within 150 and 300 m at each shrink start, and the nearest."""
    n = neighbour_counts(positions_at_shrink(a), ["match_id", "phase"], "id", [150, 300], "team_index")
    return n.groupBy("phase").agg(F.count("*").alias("n"), F.sum("near_150").alias("near_150"), F.sum("near_300").alias("near_300"), r6(F.avg("nearest_m"), "nearest_m", 4))


@registered(
    "nearest_place",
    f"""{POSITIONS_SQL}, pl AS (SELECT 'P' || s_suppkey AS name, CAST((s_suppkey * 7919) % 240001 - 120000 AS DOUBLE) AS px, CAST((s_suppkey * 104729) % 240001 - 120000 AS DOUBLE) AS py FROM supplier),
    d AS (SELECT a.match_id, a.id, a.phase, arg_min(name, (sqrt(pow(x - px, 2) + pow(y - py, 2)) / 100, name)) AS name, min(sqrt(pow(x - px, 2) + pow(y - py, 2)) / 100) AS m FROM a, pl GROUP BY ALL)
    SELECT CASE WHEN m <= 400 THEN name ELSE 'Unnamed area' END AS place, count(*) AS n, round(avg(CASE WHEN m <= 400 THEN m END), 4) AS place_m FROM d GROUP BY 1""",
)
def places(a: Arena) -> DataFrame:
    """J-15: nearest place within 400 m."""
    pl = a.table("supplier").select(
        F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("name"),
        F.expr("cast((s_suppkey * 7919) % 240001 - 120000 as double)").alias("x"), F.expr("cast((s_suppkey * 104729) % 240001 - 120000 as double)").alias("y"),
    )
    return nearest_place(positions_at_shrink(a), pl, 400.0).groupBy("place").agg(F.count("*").alias("n"), r6(F.avg("place_m"), "place_m", 4))


@registered(
    "phase_at_time",
    """SELECT coalesce((SELECT max(phase) FROM phases p WHERE p.match_id = k.match_id AND p.finish_shrink_t <= k.t), 0) + 1 AS phase, count(*) AS n FROM kills k GROUP BY 1""",
)
def phase_at_time(a: Arena) -> DataFrame:
    """J-16: the number after the last phase that was over, as an as-of join."""
    j = asof_join(a.kills, a.phases, ["match_id"], ["phase"], right_time="finish_shrink_t", how="left")
    return j.groupBy((F.coalesce("phase", F.lit(0)) + 1).alias("phase")).agg(F.count("*").alias("n"))


@registered(
    "time_grid_panel",
    """g AS (SELECT p.match_id, p.phase, CAST(k * 10 AS DOUBLE) AS t FROM phases p, range(0, 200) AS r(k) WHERE k * 10 >= p.start_shrink_t - 65 AND k * 10 < p.finish_shrink_t)
    SELECT phase, count(*) AS n, count(*) FILTER (e.placement <= 10) AS top FROM g JOIN players e ON e.match_id = g.match_id AND (e.death_t IS NULL OR e.death_t > g.t) GROUP BY phase""",
)
def grid_panel(a: Arena) -> DataFrame:
    """J-17: a row every 10 s of each phase for each player still alive."""
    spans = a.phases.select("match_id", "phase", (F.col("start_shrink_t") - 65).alias("b"), F.col("finish_shrink_t").alias("e"))
    g = time_grid(spans, "b", "e", 10.0).join(a.players, "match_id").where("death_t is null or death_t > t")
    return g.groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("placement") <= 10).alias("top"))


@registered(
    "height_of_both_sides",
    f"""{POSITIONS_SQL}, th AS (SELECT match_id, phase, team_index, avg(z) / 100 AS h FROM a GROUP BY ALL),
    f AS (SELECT DISTINCT h.match_id, CAST(floor(h.t / 110) AS BIGINT) AS phase, h.attacker_id // 3 AS ta, h.target_id // 3 AS tb FROM hits h WHERE h.attacker_id // 3 <> h.target_id // 3)
    SELECT f.phase, count(*) AS n, round(avg(a1.h - b1.h), 6) AS gap_m, round(avg(CASE WHEN a1.h > b1.h THEN 1.0 ELSE 0.0 END), 6) AS higher
    FROM f JOIN th a1 ON a1.match_id = f.match_id AND a1.phase = f.phase AND a1.team_index = f.ta JOIN th b1 ON b1.match_id = f.match_id AND b1.phase = f.phase AND b1.team_index = f.tb GROUP BY f.phase""",
)
def both_sides(a: Arena) -> DataFrame:
    """J-18: attacking and attacked team's mean height at the phase's start."""
    h = positions_at_shrink(a).groupBy("match_id", "phase", "team_index").agg((F.avg("z") / 100).alias("h"))
    f = a.hits.select(
        "match_id", F.floor(F.col("t") / 110).alias("phase"), F.floor(F.col("attacker_id") / 3).alias("ta"), F.floor(F.col("target_id") / 3).alias("tb")
    ).where("ta <> tb").distinct()
    one = f.join(h.withColumnsRenamed({"team_index": "ta", "h": "ha"}), ["match_id", "phase", "ta"])
    two = one.join(h.withColumnsRenamed({"team_index": "tb", "h": "hb"}), ["match_id", "phase", "tb"])
    return two.groupBy("phase").agg(F.count("*").alias("n"), r6(F.avg(F.col("ha") - F.col("hb")), "gap_m"), r6(A.share(F.col("ha") > F.col("hb")), "higher"))


@registered(
    "survived_next_phase",
    """s AS (SELECT DISTINCT p.match_id, p.phase, e.team_index FROM phases p JOIN players e ON e.match_id = p.match_id AND (e.death_t IS NULL OR e.death_t > p.start_shrink_t))
    SELECT phase, count(*) AS teams, count(*) FILTER (EXISTS (SELECT 1 FROM s n WHERE n.match_id = s.match_id AND n.team_index = s.team_index AND n.phase = s.phase + 1)) AS survived FROM s GROUP BY phase""",
)
def survived(a: Arena) -> DataFrame:
    """J-19: teams that are there again in the next phase, by lead."""
    s = a.phases.join(a.players, "match_id").where("death_t is null or death_t > start_shrink_t").select("match_id", "team_index", "phase").distinct()
    next_ = F.lead("phase").over(Window.partitionBy("match_id", "team_index").orderBy("phase"))
    return s.withColumn("_n", next_).groupBy("phase").agg(F.count("*").alias("teams"), F.count_if(F.col("_n") == F.col("phase") + 1).alias("survived"))


# ---- selections -------------------------------------------------------------------------------------------------


@registered(
    "selection_filters",
    """sel AS (SELECT match_id FROM matches WHERE lobby_strength >= 0.2 AND TRY_CAST(match_date AS DATE) >= DATE '2024-02-01' AND season IN ('v30', 'v31') AND lower(playlist) LIKE '%duos%' AND is_server_replay)
    SELECT match_id, count(*) AS samples, max(t) AS last_t FROM tracks WHERE match_id IN (SELECT match_id FROM sel) GROUP BY match_id""",
)
def selection_filters(a: Arena) -> DataFrame:
    """F-01, F-02, J-12: samples of the selected matches."""
    sel = L.select(a.matches, L.Filters(min_strength=0.2, date_from="2024-02-01", seasons=("v30", "v31"), playlist="DUOS", server_only=True))
    return L.chosen(a.tracks, sel).groupBy("match_id").agg(F.count("*").alias("samples"), F.max("t").alias("last_t"))


@registered(
    "selection_facets",
    """SELECT facet, value, count(*) AS n FROM (SELECT 'season' AS facet, season AS value FROM matches UNION ALL SELECT 'region', region FROM matches
      UNION ALL SELECT 'event_window_id', event_window_id FROM matches UNION ALL SELECT 'playlist', playlist FROM matches) GROUP BY ALL""",
)
def selection_facets(a: Arena) -> DataFrame:
    """F-03."""
    return L.facets(a.matches)


@registered(
    "selection_summary",
    """SELECT count(*) AS n, CAST(min(TRY_CAST(match_date AS DATE)) AS VARCHAR) AS first, CAST(max(TRY_CAST(match_date AS DATE)) AS VARCHAR) AS last, count(lobby_strength) AS rated,
      string_agg(DISTINCT season, ',' ORDER BY season) AS seasons, string_agg(DISTINCT region, ',' ORDER BY region) AS regions, round(median(lobby_strength), 6) AS strength FROM matches""",
)
def selection_summary(a: Arena) -> DataFrame:
    """F-03, D-48."""
    s = L.summary(a.matches)
    return s.select("n", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "rated", "seasons", "regions", r6("strength", "strength"))


@registered(
    "match_list",
    """SELECT match_id, match_date, round(length_s, 1) AS length_s, round(lobby_strength, 3) AS lobby_strength FROM matches ORDER BY TRY_CAST(match_date AS DATE) DESC NULLS LAST, match_id LIMIT 10""",
)
def match_list(a: Arena) -> DataFrame:
    """F-04, O-02."""
    return L.latest(a.matches, 10).select("match_id", "match_date", F.round("length_s", 1).alias("length_s"), F.round("lobby_strength", 3).alias("lobby_strength"))


@registered(
    "selection_overlap",
    """a AS (SELECT match_id FROM matches WHERE season IN ('v30', 'v31')), b AS (SELECT match_id FROM matches WHERE region IN ('EU', 'BR'))
    SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (match_id)) AS shared, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b""",
)
def selection_overlap(a: Arena) -> DataFrame:
    """F-05, U-02."""
    return L.overlap(L.select(a.matches, L.Filters(seasons=("v30", "v31"))), L.select(a.matches, L.Filters(regions=("EU", "BR"))))


@registered(
    "history_and_event",
    """SELECT CASE WHEN TRY_CAST(match_date AS DATE) < DATE '2024-04-01' THEN 'history' ELSE 'event' END AS side, count(*) AS matches, CAST(sum(n_players) AS BIGINT) AS players FROM matches WHERE TRY_CAST(match_date AS DATE) IS NOT NULL GROUP BY 1""",
)
def history(a: Arena) -> DataFrame:
    """F-06, U-01."""
    before, after = L.split_at(a.matches, "2024-04-01")
    both = before.withColumn("side", F.lit("history")).unionByName(after.withColumn("side", F.lit("event")))
    return both.groupBy("side").agg(F.count("*").alias("matches"), F.sum("n_players").alias("players"))


@registered(
    "hits_between_humans",
    """SELECT h.match_id, count(*) AS hits, round(sum(amount), 4) AS amount, count(*) FILTER (a.pr_rank IS NOT NULL) AS by_ranked FROM hits h
      JOIN players a ON a.match_id = h.match_id AND a.id = h.attacker_id JOIN players b ON b.match_id = h.match_id AND b.id = h.target_id
    WHERE NOT coalesce(a.is_bot, false) AND NOT coalesce(b.is_bot, false) AND a.team_index IS DISTINCT FROM b.team_index GROUP BY h.match_id""",
)
def human_hits(a: Arena) -> DataFrame:
    """D-01, F-07, F-10, J-13."""
    h = player_hits(a)
    return h.groupBy("match_id").agg(F.count("*").alias("hits"), r6(F.sum("amount"), "amount", 4), F.count("attacker_rank").alias("by_ranked"))


def player_hits(a: Arena) -> DataFrame:
    """D-01: hits between humans of different teams, with both teams."""
    own = L.humans(a.players)
    one = own.select("match_id", F.col("id").alias("attacker_id"), F.col("team_index").alias("attacker_team"), F.col("pr_rank").alias("attacker_rank"))
    two = own.select("match_id", F.col("id").alias("target_id"), F.col("team_index").alias("target_team"))
    h = a.hits.join(one, ["match_id", "attacker_id"]).join(two, ["match_id", "target_id"])
    return h.where(L.opponents(F.col("attacker_team"), F.col("target_team")))


@registered(
    "team_search",
    """n AS (SELECT c_custkey, c_custkey % 24 AS match_id, c_custkey % 20 AS team_index, lower(c_name) AS name FROM customer),
    f AS (SELECT match_id, team_index, count(DISTINCT frag) AS fragments FROM n, (VALUES ('01'), ('23'), ('77')) AS v(frag) WHERE contains(name, frag) GROUP BY ALL HAVING count(DISTINCT frag) >= 2)
    SELECT match_id, team_index, fragments FROM f QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY fragments DESC, team_index) = 1""",
)
def team_search(a: Arena) -> DataFrame:
    """F-11: the team with most of the typed fragments in each match."""
    n = a.table("customer").select((F.col("c_custkey") % 24).alias("match_id"), (F.col("c_custkey") % 20).alias("team_index"), F.col("c_name").alias("name"))
    return L.find_team(n, "01, 23, 77")


@registered(
    "team_list",
    """g AS (SELECT match_id, team_index, string_agg(CAST(id AS VARCHAR), '+' ORDER BY CAST(id AS VARCHAR)) AS team, min(placement) AS placement, CAST(sum(kills) AS BIGINT) AS kills FROM players GROUP BY ALL),
    pts AS (SELECT g.*, greatest(52 - 2 * placement, 0) + 4 * kills AS points FROM g)
    SELECT team, count(*) AS games, count(*) FILTER (placement = 1) AS wins, round(avg(placement), 6) AS placement, CAST(sum(points) AS BIGINT) AS points FROM pts GROUP BY team""",
)
def team_list(a: Arena) -> DataFrame:
    """F-12, F-13, G-08, B-10, X-13: every team with games, wins, points and mean placement."""
    table = P.scheme(a.spark, [50 - 2 * k for k in range(26)])
    games = P.scored(L.team_games(a.players, "id"), table)
    return L.list_teams(games).select("team", "games", "wins", r6("placement", "placement"), F.col("points").cast("bigint").alias("points"))


@registered(
    "track_thinning",
    """SELECT match_id, count(*) AS every_third FROM (SELECT *, row_number() OVER (PARTITION BY match_id, id ORDER BY t) - 1 AS n FROM tracks) WHERE n % 3 = 0 GROUP BY match_id""",
)
def thinning(a: Arena) -> DataFrame:
    """F-15."""
    return W.strided(a.tracks, ["match_id", "id"], ["t"], 3).groupBy("match_id").agg(F.count("*").alias("every_third"))


@registered(
    "sample_bins",
    """SELECT match_id, count(*) AS kept, round(sum(t), 4) AS t FROM (SELECT * FROM tracks QUALIFY row_number() OVER (PARTITION BY match_id, id, floor(t / 60) ORDER BY t) = 1) GROUP BY match_id""",
)
def sample_bins(a: Arena) -> DataFrame:
    """S-17 in bins."""
    return W.thinned(a.tracks, ["match_id", "id"], "t", 60.0).groupBy("match_id").agg(F.count("*").alias("kept"), r6(F.sum("t"), "t", 4))


@registered(
    "sample_greedy",
    """k(match_id, id, t) AS (SELECT match_id, id, min(t) FROM tracks GROUP BY ALL UNION ALL SELECT k.match_id, k.id, min(x.t) FROM k JOIN tracks x ON x.match_id = k.match_id AND x.id = k.id AND x.t - k.t >= 60 GROUP BY k.match_id, k.id, k.t)
    SELECT match_id, id, team_index, t, x, y, z FROM k JOIN tracks USING (match_id, id, t)""",
)
def sample_greedy(a: Arena) -> DataFrame:
    """S-17 exact: the next kept sample is the first at least a minute after the last kept."""
    return W.thinned(a.tracks, ["match_id", "id"], "t", 60.0, exact=True)


@registered(
    "held_changes",
    """SELECT match_id, count(*) AS changes FROM (SELECT match_id, id, t, health, row_number() OVER w AS n, lag(health) OVER w AS before FROM changes WINDOW w AS (PARTITION BY match_id, id ORDER BY t))
    WHERE n = 1 OR health IS DISTINCT FROM before GROUP BY match_id""",
)
def held_changes(a: Arena) -> DataFrame:
    """S-18: a row only where the value differs from the one before."""
    return W.changes_only(a.changes, ["match_id", "id"], ["t"], "health").groupBy("match_id").agg(F.count("*").alias("changes"))


# ---- aggregates -------------------------------------------------------------------------------------------------


@registered(
    "shares_and_quantiles",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS high, round(median(l_quantity), 6) AS q50,
      round(quantile_cont(l_quantity, 0.975), 6) AS q975, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS iqr, round(sum(l_extendedprice) FILTER (l_tax > 0.04) / sum(l_extendedprice), 6) AS taxed,
      mode(l_linenumber ORDER BY l_linenumber) AS usual FROM lineitem GROUP BY ALL""",
    arena=False,
)
def quantiles(a: Arena) -> DataFrame:
    """G-01, G-02, G-05, G-06, G-11, G-12."""
    li = a.table("lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r6(A.share(F.col("l_discount") > 0.05), "high"), r6(F.median("l_quantity"), "q50"),
        *(r6(c, n) for c, n in ((F.percentile("l_quantity", F.lit(0.975)), "q975"), (F.percentile("l_quantity", F.lit(0.75)) - F.percentile("l_quantity", F.lit(0.25)), "iqr"))),
        r6(A.ratio_of_sums(F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice")), F.col("l_extendedprice")), "taxed"),
        A.mode("l_linenumber").alias("usual"),
    )


@registered(
    "extremes_by_order",
    """SELECT match_id, id, arg_min(x, t) AS first_x, arg_max(y, t) AS last_y, count(DISTINCT floor(z / 500)) AS floors FROM tracks GROUP BY ALL HAVING count(*) >= 5""",
)
def extremes(a: Arena) -> DataFrame:
    """G-03, G-04, G-07."""
    return a.tracks.groupBy("match_id", "id").agg(
        F.min_by("x", "t").alias("first_x"), F.max_by("y", "t").alias("last_y"), F.countDistinct(F.floor(F.col("z") / 500)).alias("floors"), F.count("*").alias("_n")
    ).where("_n >= 5").drop("_n")


@registered(
    "pivoted_types",
    """SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
      bool_or(event_type = 'view') AND bool_or(event_type = 'purchase') AS has_both FROM events GROUP BY user_id""",
    arena=False,
)
def pivoted(a: Arena) -> DataFrame:
    """G-09, G-10: counts side by side, and whether a user has both kinds."""
    e = a.table("events")
    wide = e.groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count().fillna(0)
    return wide.join(e.groupBy("user_id").agg(A.has_all("event_type", ["view", "purchase"]).alias("has_both")), "user_id")


@registered(
    "team_skill",
    """SELECT match_id, team_index, round(exp(avg(ln(least(greatest(coalesce(pr_rank, 100000), 1), 100000)))), 4) AS skill, round(avg(CASE WHEN pr_rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS covered FROM players GROUP BY ALL""",
)
def team_skill(a: Arena) -> DataFrame:
    """G-13."""
    return a.players.groupBy("match_id", "team_index").agg(r6(A.geometric_mean(F.col("pr_rank")), "skill", 4), r6(A.share(F.col("pr_rank").isNotNull()), "covered"))


@registered(
    "gap_of_means",
    """SELECT c_nationkey AS nation, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_with, count(*) FILTER (c_mktsegment <> 'BUILDING') AS n_without,
      round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') - avg(c_acctbal) FILTER (c_mktsegment <> 'BUILDING'), 4) AS gap FROM customer GROUP BY 1
      HAVING count(*) FILTER (c_mktsegment = 'BUILDING') >= 3 AND count(*) FILTER (c_mktsegment <> 'BUILDING') >= 3""",
    arena=False,
)
def gap(a: Arena) -> DataFrame:
    """G-14."""
    c = a.table("customer").withColumn("nation", F.col("c_nationkey"))
    return A.gap_of_means(c, ["nation"], F.col("c_mktsegment") == "BUILDING", "c_acctbal").select("nation", "n_with", "n_without", r6("gap", "gap", 4))


@registered(
    "like_for_like",
    """s AS (SELECT o_orderpriority AS p, c_nationkey AS nation, o_orderdate >= TIMESTAMP '1995-01-01' AS late, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
    d AS (SELECT nation, p, avg(v) FILTER (late) - avg(v) FILTER (NOT late) AS gap FROM s GROUP BY ALL HAVING count(*) FILTER (late) > 0 AND count(*) FILTER (NOT late) > 0)
    SELECT count(*) AS n, round(avg(gap), 4) AS mean, round(avg(gap) / (stddev_samp(gap) / sqrt(count(*))), 6) AS t FROM d""",
)
def like(a: Arena) -> DataFrame:
    """G-16, ST-06."""
    s = a.table("orders").join(a.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = s.withColumn("late", F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    d = A.like_for_like(s, ["c_nationkey", "o_orderpriority"], F.col("late"), "o_totalprice")
    return T.t_test(d, [], "gap").select("n", r6("mean", "mean", 4), r6("t", "t"))


@registered(
    "value_shares",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2",
    arena=False,
)
def value_shares(a: Arena) -> DataFrame:
    """G-15."""
    v = A.value_shares(a.table("orders"), ["o_orderstatus"], "o_orderpriority")
    return v.select("o_orderstatus", "o_orderpriority", "n", r6("share", "share"))


@registered(
    "grid_density",
    "SELECT CAST(floor(x / 20000) AS BIGINT) AS cx, CAST(floor(y / 20000) AS BIGINT) AS cy, count(*) AS n FROM tracks GROUP BY ALL HAVING count(*) >= 3",
)
def density(a: Arena) -> DataFrame:
    """G-17."""
    return grid_density(a.tracks, 200.0, 3)


@registered(
    "repeated_spots",
    "SELECT x, y, count(DISTINCT match_id) AS n FROM (SELECT match_id, round(x / 1000, 0) AS x, round(y / 1000, 0) AS y FROM kills) GROUP BY ALL HAVING count(DISTINCT match_id) > 1",
)
def spots(a: Arena) -> DataFrame:
    """G-18."""
    return A.repeated_spots(a.kills.withColumn("x", F.col("x") / 1000).withColumn("y", F.col("y") / 1000), [], ["x", "y"])


@registered(
    "histograms",
    """SELECT least(greatest(CAST(floor((((degrees(atan2(y, x)) % 360) + 360) % 360) * 24 / 360) AS INTEGER), 0), 23) AS sector, count(*) AS n,
      CAST(sum(least(greatest(floor(t * 10 / 1200), 0), 9)) AS BIGINT) AS bins FROM kills GROUP BY 1""",
)
def histograms(a: Arena) -> DataFrame:
    """G-19, X-03: polar and plain histogram bins."""
    k = a.kills.select(A.histogram(G.bearing(F.col("x"), F.col("y")), 0.0, 360.0, 24).alias("sector"), A.histogram(F.col("t"), 0.0, 1200.0, 10).alias("b"))
    return k.groupBy("sector").agg(F.count("*").alias("n"), F.sum("b").alias("bins"))


# ---- ranks and windows ------------------------------------------------------------------------------------------


@registered(
    "percent_ranks",
    """r AS (SELECT *, CASE WHEN pr_rank IS NOT NULL THEN (rank() OVER (PARTITION BY match_id ORDER BY pr_rank NULLS LAST) + (count(pr_rank) OVER (PARTITION BY match_id, pr_rank) - 1) / 2) / count(pr_rank) OVER (PARTITION BY match_id) END AS avg_rank,
      CASE WHEN pr_rank IS NOT NULL THEN rank() OVER (PARTITION BY match_id ORDER BY pr_rank NULLS LAST) / count(pr_rank) OVER (PARTITION BY match_id) END AS min_rank,
      (rank() OVER (PARTITION BY match_id ORDER BY pr_rank NULLS LAST) + (count(*) OVER (PARTITION BY match_id, pr_rank) - 1) / 2) / count(*) OVER (PARTITION BY match_id) AS last_rank FROM players)
    SELECT match_id, id, round(avg_rank, 6) AS avg_rank, round(min_rank, 6) AS min_rank, round(last_rank, 6) AS last_rank, CASE WHEN avg_rank <= 1.0 / 3 THEN 'low' WHEN avg_rank <= 2.0 / 3 THEN 'middle' WHEN avg_rank IS NOT NULL THEN 'high' END AS third FROM r""",
)
def percent_ranks(a: Arena) -> DataFrame:
    """W-04, W-05, W-14."""
    avg = R.percent_rank_average("pr_rank", ["match_id"])
    return a.players.select(
        "match_id", "id", r6(avg, "avg_rank"), r6(R.percent_rank_min("pr_rank", ["match_id"]), "min_rank"), r6(R.percent_rank_nulls_last("pr_rank", ["match_id"]), "last_rank"), R.thirds(avg).alias("third")
    )


@registered(
    "standardised_in_group",
    """SELECT match_id, id, round(coalesce((value - avg(value) OVER w) / stddev_samp(value) OVER w, 0), 6) AS z, round(value - (regr_intercept(value, kills) OVER w + regr_slope(value, kills) OVER w * kills), 1) AS residual FROM players WINDOW w AS (PARTITION BY match_id)""",
)
def standardised(a: Arena) -> DataFrame:
    """W-06, W-12, W-13."""
    return a.players.select("match_id", "id", r6(R.z_score("value", ["match_id"]), "z"), r6(R.residual("value", "kills", ["match_id"]), "residual", 1))


@registered(
    "gap_sessions",
    """n AS (SELECT match_id, attacker_id, t, CASE WHEN t - lag(t) OVER w > 15 THEN 1 ELSE 0 END AS new FROM hits WINDOW w AS (PARTITION BY match_id, attacker_id ORDER BY t)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY match_id, attacker_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM n)
    SELECT match_id, attacker_id, CAST(max(session) + 1 AS BIGINT) AS sessions, count(*) AS hits FROM s GROUP BY ALL""",
)
def sessions(a: Arena) -> DataFrame:
    """W-09."""
    s = W.gap_sessions(a.hits, ["match_id", "attacker_id"], "t", 15.0)
    return s.groupBy("match_id", "attacker_id").agg((F.max("session") + 1).alias("sessions"), F.count("*").alias("hits"))


@registered(
    "equal_runs",
    """c AS (SELECT user_id, ts, event_id, event_type, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c),
    l AS (SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL)
    SELECT event_type, count(*) AS runs, max(n) AS longest FROM l GROUP BY event_type""".replace("c AS", "WITH c AS", 1),
    arena=False,
)
def equal_runs(a: Arena) -> DataFrame:
    """W-10."""
    r = W.runs(a.table("events"), ["user_id"], ["ts", "event_id"], "event_type")
    lengths = r.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))
    return lengths.groupBy("event_type").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@registered(
    "holds_for_rows",
    """h AS (SELECT match_id, id, t, min(CASE WHEN z < 2000 THEN 1 ELSE 0 END) OVER w AS ok, count(*) OVER w AS n FROM tracks WINDOW w AS (PARTITION BY match_id, id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT match_id, count(*) AS starts, min(t) AS first_t FROM h WHERE ok = 1 AND n = 3 GROUP BY match_id""",
)
def holds(a: Arena) -> DataFrame:
    """W-11."""
    s = a.tracks.withColumn("_ok", W.holds_for(F.col("z") < 2000, 3, ["match_id", "id"], ["t"])).where("_ok")
    return s.groupBy("match_id").agg(F.count("*").alias("starts"), F.min("t").alias("first_t"))


@registered(
    "fresh_attackers",
    """SELECT match_id, count(*) FILTER (since IS NULL OR since > 30) AS fresh, count(*) AS hits FROM (SELECT match_id, t - lag(t) OVER (PARTITION BY match_id, attacker_id, target_id ORDER BY t) AS since FROM hits) GROUP BY match_id""",
)
def fresh_attackers(a: Arena) -> DataFrame:
    """W-15, W-01."""
    h = a.hits.withColumn("_f", W.fresh_pairs(a.hits, ["match_id", "attacker_id", "target_id"], "t", 30.0))
    return h.groupBy("match_id").agg(F.count_if("_f").alias("fresh"), F.count("*").alias("hits"))


@registered(
    "rhythm_ticks",
    f"""{DROPS_SQL}, g AS (SELECT match_id, id, t, t - lag(t) OVER w AS back, lead(t) OVER w - t AS ahead FROM u WINDOW w AS (PARTITION BY match_id, id ORDER BY t)),
    c AS (SELECT match_id, round_even(t, 0) AS s, count(DISTINCT id) AS n FROM u GROUP BY ALL)
    SELECT g.match_id, count(*) AS drops, count(*) FILTER (coalesce(back BETWEEN 3 AND 7, false) OR coalesce(ahead BETWEEN 3 AND 7, false) OR c.n >= 3) AS ticks FROM g JOIN c ON c.match_id = g.match_id AND c.s = round_even(g.t, 0) GROUP BY g.match_id""",
)
def ticks(a: Arena) -> DataFrame:
    """W-16, X-09."""
    u = unexplained_drops(a)
    u = u.withColumn("_tick", W.rhythm("t", "id", "match_id"))
    return u.groupBy("match_id").agg(F.count("*").alias("drops"), F.count_if("_tick").alias("ticks"))


@registered(
    "running_and_filled",
    """f AS (SELECT match_id, id, t, sum(health) OVER w AS total, last_value(CASE WHEN shield > 50 THEN shield END IGNORE NULLS) OVER w AS filled, first_value(health) OVER (PARTITION BY match_id, id ORDER BY t) AS first_health FROM changes
      WINDOW w AS (PARTITION BY match_id, id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT match_id, round(sum(total), 4) AS total, round(sum(filled), 4) AS filled, round(sum(first_health), 4) AS first_health FROM f GROUP BY match_id""",
)
def running(a: Arena) -> DataFrame:
    """W-02, W-07, W-08."""
    by = Window.partitionBy("match_id", "id").orderBy("t")
    c = a.changes.withColumn("_s", F.when(F.col("shield") > 50, F.col("shield")))
    f = c.select(
        "match_id", F.sum("health").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), W.forward_fill("_s", ["match_id", "id"], ["t"]).alias("filled"), F.first("health").over(by).alias("fh")
    )
    return f.groupBy("match_id").agg(r6(F.sum("total"), "total", 4), r6(F.sum("filled"), "filled", 4), r6(F.sum("fh"), "first_health", 4))


@registered(
    "bands_and_bins",
    """SELECT CASE WHEN o_totalprice > 0 AND o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'middle' WHEN o_totalprice <= 1000000 THEN 'high' END AS right_closed,
      CASE WHEN o_totalprice >= 0 AND o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 WHEN o_totalprice < 1000000 THEN 2 END AS left_closed, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""",
    arena=False,
)
def banded(a: Arena) -> DataFrame:
    """O-05."""
    edges, labels, x = [0, 50000, 150000, 1000000], ["low", "middle", "high"], F.col("o_totalprice")
    return a.table("orders").groupBy(S.bands(x, edges, labels).alias("right_closed"), S.band_number(x, edges, right=False).alias("left_closed")).agg(
        F.count("*").alias("n"), r6(F.sum("o_totalprice"), "total", 2)
    )


@registered(
    "equal_count_bins",
    """n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY value, id) AS k, count(*) OVER (PARTITION BY match_id) AS n FROM players)
    SELECT match_id, CAST(greatest(ceil((k - 1) * 5 / (n - 1)), 1) AS INTEGER) AS bin, count(*) AS players, round(avg(placement), 6) AS placement FROM n GROUP BY ALL""",
)
def equal_bins(a: Arena) -> DataFrame:
    """O-06."""
    w = Window.partitionBy("match_id")
    k, n = F.row_number().over(w.orderBy("value", "id")), F.count("*").over(w)
    return a.players.withColumn("bin", S.equal_bins(k, n, 5)).groupBy("match_id", "bin").agg(F.count("*").alias("players"), r6(F.avg("placement"), "placement"))


@registered(
    "first_and_last_rows",
    """SELECT match_id, id, t, x FROM tracks QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY t DESC, id) <= 3""",
)
def last_rows(a: Arena) -> DataFrame:
    """O-01, O-03, W-03."""
    return R.first_rows(a.tracks.select("match_id", "id", "t", "x"), ["match_id"], [F.desc("t"), F.asc("id")], 3)


@registered("hashed_sample")
def sampled(a: Arena) -> DataFrame:
    """O-04: the same rows each time, by a hash of the keys."""
    return A.hashed_sample(a.table("orders"), ["o_orderkey"], 500)


# ---- scalar helpers ---------------------------------------------------------------------------------------------


@registered(
    "zone_features",
    """z AS (SELECT match_id, phase, cur_r, next_r, next_x - cur_x AS dx, next_y - cur_y AS dy, start_shrink_t - coalesce(lag(finish_shrink_t) OVER (PARTITION BY match_id ORDER BY phase), 0) AS wait FROM phases)
    SELECT match_id, phase, round(sqrt(dx * dx + dy * dy) / 100, 4) AS dist_m, round(next_r / cur_r, 6) AS shrink_ratio, round(((degrees(atan2(dy, dx)) % 360) + 360) % 360, 6) AS angle_deg, round(wait, 4) AS wait_s FROM z""",
)
def zones(a: Arena) -> DataFrame:
    """B-06 in part, X-01, X-03."""
    by = Window.partitionBy("match_id").orderBy("phase")
    dx, dy = F.col("next_x") - F.col("cur_x"), F.col("next_y") - F.col("cur_y")
    return a.phases.select(
        "match_id", "phase", r6(F.sqrt(dx * dx + dy * dy) / 100, "dist_m", 4), r6(F.col("next_r") / F.col("cur_r"), "shrink_ratio"), r6(G.bearing(dx, dy), "angle_deg"),
        r6(F.col("start_shrink_t") - F.coalesce(F.lag("finish_shrink_t").over(by), F.lit(0.0)), "wait_s", 4),
    )


@registered(
    "line_and_segment",
    """p AS (SELECT match_id, id, t, x, y, 100000.0 AS bx, 50000.0 AS bty, greatest(0, least(1, ((x + 100000) * 200000 + (y + 50000) * 100000) / (200000.0 * 200000 + 100000.0 * 100000))) AS k FROM tracks)
    SELECT match_id, round(avg(abs(200000.0 * (-50000 - y) - (-100000 - x) * 100000.0) / sqrt(200000.0 * 200000 + 100000.0 * 100000) / 100), 4) AS line_m,
      round(avg(sqrt(pow(x - (-100000 + 200000 * k), 2) + pow(y - (-50000 + 100000 * k), 2)) / 100), 4) AS segment_m FROM p GROUP BY match_id""",
)
def segments(a: Arena) -> DataFrame:
    """X-05."""
    ends = [F.lit(v) for v in (-100000.0, -50000.0, 100000.0, 50000.0)]
    return a.tracks.groupBy("match_id").agg(r6(F.avg(G.off_line_m(F.col("x"), F.col("y"), *ends)), "line_m", 4), r6(F.avg(G.off_segment_m(F.col("x"), F.col("y"), *ends)), "segment_m", 4))


@registered(
    "relations",
    """c AS (SELECT p.match_id, k.x, k.y, (p.next_x * k.x + p.next_y * k.y) / (sqrt(p.next_x * p.next_x + p.next_y * p.next_y) * sqrt(k.x * k.x + k.y * k.y)) AS cos FROM kills k JOIN phases p ON p.match_id = k.match_id AND p.phase = 3)
    SELECT CASE WHEN cos >= 0.5 THEN 'toward' WHEN cos <= -0.5 THEN 'away' ELSE 'sideways' END AS relation, count(*) AS n, round(avg(cos), 6) AS cos FROM c GROUP BY 1""",
)
def relations(a: Arena) -> DataFrame:
    """X-06, X-08."""
    p = a.phases.where("phase = 3").select("match_id", "next_x", "next_y")
    c = a.kills.join(p, "match_id").withColumn("cos", G.cosine(F.col("next_x"), F.col("next_y"), F.col("x"), F.col("y")))
    return c.groupBy(G.relation(F.col("cos")).alias("relation")).agg(F.count("*").alias("n"), r6(F.avg("cos"), "cos"))


@registered(
    "weekly_counts",
    "SELECT CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week, count(*) AS n FROM orders GROUP BY 1",
    arena=False,
)
def weekly(a: Arena) -> DataFrame:
    """X-11."""
    return a.table("orders").groupBy(S.week(F.col("o_orderdate")).cast("string").alias("week")).agg(F.count("*").alias("n"))


@registered(
    "clock_strings",
    "SELECT match_id, CAST(floor(max(t) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(max(t)) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS last_clock FROM tracks GROUP BY match_id",
)
def clocks(a: Arena) -> DataFrame:
    """X-12."""
    return a.tracks.groupBy("match_id").agg(S.clock(F.max("t")).alias("last_clock"))


@registered(
    "points_by_player",
    "SELECT match_id, id, CASE WHEN placement <= 50 THEN 51 - placement ELSE 0 END + kills * 4 AS points FROM players",
)
def points_by_player(a: Arena) -> DataFrame:
    """X-13."""
    return P.scored(a.players, P.scheme(a.spark, P.SOLOS)).select("match_id", "id", "points")


# ---- statistics -------------------------------------------------------------------------------------------------


@registered(
    "rayleigh_statistic",
    """h AS (SELECT event_type, radians(hour(ts) * 15.0) AS x FROM events),
    s AS (SELECT event_type, count(*) AS n, avg(cos(x)) AS c, avg(sin(x)) AS s FROM h GROUP BY 1)
    SELECT event_type, n, round(sqrt(c * c + s * s), 6) AS r, round(((degrees(atan2(s, c)) % 360) + 360) % 360, 4) AS mean_deg FROM s""".replace("h AS", "WITH h AS", 1),
    arena=False,
)
def rayleigh_statistic(a: Arena) -> DataFrame:
    """ST-01, ST-02."""
    e = a.table("events").withColumn("deg", F.hour("ts") * 15.0)
    return T.rayleigh(e, ["event_type"], "deg").select("event_type", "n", r6("r", "r"), r6("mean_deg", "mean_deg", 4))


@registered(
    "ks_uniform_distance",
    """u AS (SELECT event_type, hour(ts) / 24.0 + minute(ts) / 1440.0 + second(ts) / 86400.0 AS u FROM events),
    r AS (SELECT event_type, u, row_number() OVER (PARTITION BY event_type ORDER BY u) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM u)
    SELECT event_type, count(*) AS n, round(max(greatest(i / n - u, u - (i - 1) / n)), 6) AS d FROM r GROUP BY event_type""".replace("u AS", "WITH u AS", 1),
    arena=False,
)
def ks_distance(a: Arena) -> DataFrame:
    """ST-03."""
    u = F.hour("ts") / 24.0 + F.minute("ts") / 1440.0 + F.second("ts") / 86400.0
    return T.ks_uniform(a.table("events").withColumn("u", u), ["event_type"], "u").select("event_type", "n", r6("d", "d"))


@registered(
    "t_statistic",
    "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(*))), 6) AS t FROM customer GROUP BY 1",
    arena=False,
)
def t_statistic(a: Arena) -> DataFrame:
    """ST-04."""
    return T.t_test(a.table("customer"), ["c_mktsegment"], "c_acctbal", 4500.0).select("c_mktsegment", "n", r6("mean", "mean", 4), r6("t", "t"))


@registered(
    "ks_two_sample_distance",
    """s AS (SELECT o_orderpriority AS p, o_totalprice AS x, o_orderstatus = 'F' AS a FROM orders),
    g AS (SELECT p, x, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM s GROUP BY ALL),
    c AS (SELECT p, abs(sum(na) OVER w / sum(na) OVER (PARTITION BY p) - sum(nb) OVER w / sum(nb) OVER (PARTITION BY p)) AS gap, na, nb FROM g WINDOW w AS (PARTITION BY p ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT p AS priority, CAST(sum(na) AS BIGINT) AS n_a, CAST(sum(nb) AS BIGINT) AS n_b, round(max(gap), 6) AS d FROM c GROUP BY p""".replace("s AS", "WITH s AS", 1),
    arena=False,
)
def ks_two(a: Arena) -> DataFrame:
    """ST-05."""
    o = a.table("orders").select(F.col("o_orderpriority").alias("priority"), "o_totalprice", (F.col("o_orderstatus") == "F").alias("a"))
    return T.ks_two_sample(o, ["priority"], "a", "o_totalprice").select("priority", "n_a", "n_b", r6("d", "d"))


@registered(
    "spearman_rho",
    """r AS (SELECT match_id, rank() OVER (PARTITION BY match_id ORDER BY value) + (count(*) OVER (PARTITION BY match_id, value) - 1) / 2 AS a,
      rank() OVER (PARTITION BY match_id ORDER BY kills) + (count(*) OVER (PARTITION BY match_id, kills) - 1) / 2 AS b FROM players)
    SELECT match_id, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY match_id HAVING count(*) >= 4""",
)
def spearman_rho(a: Arena) -> DataFrame:
    """ST-07."""
    return T.spearman(a.players, ["match_id"], "value", "kills").where("n >= 4").select("match_id", "n", r6("rho", "rho"))


@registered(
    "mann_whitney_u",
    """s AS (SELECT c_mktsegment AS g, c_nationkey < 12 AS a, c_acctbal AS x FROM customer),
    r AS (SELECT g, a, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS r FROM s),
    u AS (SELECT g, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, sum(r) FILTER (a) AS ra FROM r GROUP BY g)
    SELECT g AS segment, n_a, n_b, round(ra - n_a * (n_a + 1) / 2, 4) AS u, round(2 * (ra - n_a * (n_a + 1) / 2) / (n_a * n_b) - 1, 6) AS effect FROM u""".replace("s AS", "WITH s AS", 1),
    arena=False,
)
def mann_whitney_u(a: Arena) -> DataFrame:
    """ST-09."""
    c = a.table("customer").select(F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") < 12).alias("a"), "c_acctbal")
    return T.mann_whitney(c, ["segment"], "a", "c_acctbal").select("segment", "n_a", "n_b", r6("u", "u", 4), r6("effect", "effect"))


@registered(
    "auc_of_quality",
    """s AS (SELECT lang, quality = 1 AS a, n_chars AS x FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
    r AS (SELECT lang, a, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2 AS r FROM s)
    SELECT lang, count(*) FILTER (a) AS n_pos, count(*) FILTER (NOT a) AS n_neg, round((sum(r) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2) / (count(*) FILTER (a) * count(*) FILTER (NOT a)), 6) AS auc FROM r GROUP BY lang""".replace("s AS", "WITH s AS", 1),
    arena=False,
)
def auc_of_quality(a: Arena) -> DataFrame:
    """ST-12."""
    s = a.table("labels").join(a.table("documents").select("doc_id", "lang", "n_chars"), "doc_id").where("quality is not null")
    return T.auc(s.withColumn("a", F.col("quality") == 1), ["lang"], "a", "n_chars").select("lang", "n_pos", "n_neg", r6("auc", "auc"))


@registered("test_p_values")
def p_values(a: Arena) -> DataFrame:
    """p-values of ST-01, 03, 04, 05, 09, 10 and 11 in one long table."""
    seg = a.table("customer").withColumn("a", F.col("c_nationkey") < 12)
    long = lambda df, key, test: df.select(F.lit(test).alias("test"), F.col(key).alias("of"), "p")
    e = a.table("events").withColumn("deg", F.hour("ts") * 15.0).withColumn("u", F.hour("ts") / 24.0)
    mw = T.mann_whitney(seg, ["c_mktsegment"], "a", "c_acctbal")
    parts = [
        long(T.rayleigh(e, ["event_type"], "deg"), "event_type", "rayleigh"),
        long(T.ks_uniform(e, ["event_type"], "u"), "event_type", "ks uniform"),
        long(T.t_test(seg, ["c_mktsegment"], "c_acctbal", 4500.0), "c_mktsegment", "t"),
        long(T.ks_two_sample(seg, ["c_mktsegment"], "a", "c_acctbal"), "c_mktsegment", "ks two-sample"),
        long(mw, "c_mktsegment", "mann-whitney"),
        long(T.binomial(seg, ["c_mktsegment"], F.col("c_acctbal") > 4500), "c_mktsegment", "binomial"),
        T.stouffer(mw.withColumn("half", F.col("p") / 2), [], "half").select(F.lit("stouffer").alias("test"), F.lit("all").alias("of"), "p"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("strength", S.strength(F.col("p")))


@registered("circular_permutation")
def permutation(a: Arena) -> DataFrame:
    """ST-08 on the pulls of two seasons, by phase."""
    dx, dy = F.col("next_x") - F.col("cur_x"), F.col("next_y") - F.col("cur_y")
    p = a.phases.join(a.matches.select("match_id", "season"), "match_id").where("season in ('v30', 'v31')")
    p = p.select("phase", (F.col("season") == "v30").alias("a"), G.bearing(dx, dy).alias("deg"))
    return T.circular_permutation(p, ["phase"], "a", "deg", 500)


@registered("ridge_out_of_fold")
def ridge_query(a: Arena) -> DataFrame:
    """ST-13, ST-14, ST-15, M-11 in part: kills and skill on placement, out of fold."""
    p = a.players.withColumn("skill", F.coalesce(F.log("pr_rank"), F.lit(11.5))).withColumn("y", F.col("placement").cast("double")).withColumn("k", F.col("kills").cast("double"))
    out = T.ridge_out_of_fold(p, "match_id", ["skill", "k"], "y")
    return out.groupBy("fold").agg(F.count("*").alias("n"), T.r_squared("y", "predicted").alias("r2"))


@registered(
    "bot_flags_agree",
    """t AS (SELECT match_id, team_index, count(*) AS n, count(DISTINCT is_bot) AS d FROM players GROUP BY ALL HAVING count(*) > 1)
    SELECT count(*) AS teams, round(avg(CASE WHEN d = 1 THEN 1.0 ELSE 0.0 END), 6) AS together FROM t""",
)
def agree(a: Arena) -> DataFrame:
    """ST-17."""
    return T.agreement(a.players, ["match_id"], "team_index", "is_bot").select("teams", r6("together", "together"))

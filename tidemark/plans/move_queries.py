"""Queries of the team moves over the arena, and more detectors and studies with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import points as P
from tidemark.plans import detect as D
from tidemark.plans import models as M
from tidemark.plans import moves as V
from tidemark.plans import studies as K
from tidemark.plans.operator_queries import MARGIN, r6
from tidemark.plans.source_queries import registered as _registered
from tidemark.plans.study_queries import HITS_SQL, ROTATIONS_SQL, SURGE_SQL
from tidemark.sources.arena import Arena

QUERIES, ORACLES = {}, {}


def registered(name: str, sql: str):
    """As in the sources' queries, kept in this module's own tables."""
    from tidemark.plans import source_queries as S

    def add(f):
        _registered(name, sql)(f)
        QUERIES[name], ORACLES[name] = S.QUERIES.pop(name), S.ORACLES.pop(name)
        return f

    return add


MEMBERS_SQL = """me AS (SELECT s.*, p.x, p.y, p.z FROM (SELECT m.match_id, m.phase, m.start_shrink_t AS at_t, next_x, next_y, next_r, e.id, e.team_index, e.placement FROM phases m JOIN players e USING (match_id)
      WHERE NOT e.is_bot AND (e.death_t IS NULL OR e.death_t > m.start_shrink_t)) s ASOF JOIN tracks p ON s.match_id = p.match_id AND s.id = p.id AND s.at_t >= p.t)"""
TEAMS_SQL = f"""{MEMBERS_SQL}, tc AS (SELECT match_id, phase, at_t, team_index, count(*) AS members, avg(x) AS x, avg(y) AS y, avg(z) AS z, min(placement) AS final, any_value(next_x) AS next_x, any_value(next_y) AS next_y, any_value(next_r) AS next_r FROM me GROUP BY ALL),
    tm AS (SELECT *, greatest(sqrt(pow(x - next_x, 2) + pow(y - next_y, 2)) / 100 - next_r / 100, 0) AS outside_m FROM tc)"""


@registered(
    "team_exposures",
    f"""{HITS_SQL}, {TEAMS_SQL}, fr AS (SELECT * FROM (SELECT *, t - lag(t) OVER (PARTITION BY match_id, ta, tb ORDER BY t) AS since FROM ph) WHERE since IS NULL OR since > 30),
    lo AS (SELECT a.match_id, a.phase, a.team_index, count(b.team_index) AS lookers FROM tm a LEFT JOIN tm b ON b.match_id = a.match_id AND b.phase = a.phase AND b.team_index <> a.team_index AND b.outside_m <= 0 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 100 <= 120 GROUP BY ALL),
    ex AS (SELECT tm.*, lookers, EXISTS (SELECT 1 FROM fr WHERE fr.match_id = tm.match_id AND fr.tb = tm.team_index AND fr.t > at_t AND fr.t <= at_t + 10) AS hit FROM tm JOIN lo USING (match_id, phase, team_index))
    SELECT CASE WHEN phase <= 3 THEN '1-3' WHEN phase <= 5 THEN '4-5' ELSE '6+' END AS stage, CASE WHEN outside_m > 0 THEN 'rotate' ELSE 'hold' END AS action, CAST(least(lookers, 2) AS BIGINT) AS lookers, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS p, round(1 - pow(1 - avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 2), 6) AS p_two
    FROM ex GROUP BY ALL HAVING count(*) >= 30""",
)
def team_exposures(a: Arena) -> DataFrame:
    """D-16, M-04: who watches a team, and how often a new attacker hits it in the next ten seconds."""
    t = a.tables()
    risk = M.hit_risk(V.exposures(t, V.team_moments(t, V.shrink_moments(t))))
    return risk.select("stage", "action", F.col("lookers").cast("bigint").alias("lookers"), "n", r6("p", "p"), r6("p_two", "p_two"))


@registered(
    "live_team_states",
    f"""{HITS_SQL}, {TEAMS_SQL}, mt AS (SELECT tm.match_id, tm.phase, tm.team_index, tm.z AS own_z, me.team_index AS o, me.z, sqrt(pow(tm.x - me.x, 2) + pow(tm.y - me.y, 2)) / 100 AS d, sqrt(pow(me.x - me.next_x, 2) + pow(me.y - me.next_y, 2)) <= me.next_r AS i
      FROM tm JOIN me ON me.match_id = tm.match_id AND me.phase = tm.phase AND me.team_index <> tm.team_index),
    se AS (SELECT match_id, phase, team_index, count(DISTINCT o) AS seen, count(DISTINCT CASE WHEN d <= 50 THEN o END) AS close, count(DISTINCT CASE WHEN i THEN o END) AS ins, (avg(z) - any_value(own_z)) / 100 AS above FROM mt WHERE d <= 150 GROUP BY ALL),
    ne AS (SELECT tm.match_id, tm.phase, tm.team_index, coalesce((SELECT sum(amount) FROM ph WHERE ph.match_id = tm.match_id AND ph.ta = tm.team_index AND ph.t <= at_t), 0) - coalesce((SELECT sum(amount) FROM ph WHERE ph.match_id = tm.match_id AND ph.tb = tm.team_index AND ph.t <= at_t), 0) AS net FROM tm),
    ra AS (SELECT *, (rank() OVER (PARTITION BY match_id, phase ORDER BY net) + (count(*) OVER (PARTITION BY match_id, phase, net) - 1) / 2) / count(*) OVER (PARTITION BY match_id, phase) AS share FROM ne)
    SELECT phase, count(*) AS teams, CAST(coalesce(sum(seen), 0) AS BIGINT) AS seen, CAST(coalesce(sum(close), 0) AS BIGINT) AS seen_close, CAST(coalesce(sum(ins), 0) AS BIGINT) AS seen_inside, round(avg(coalesce(above, 0)), 4) + 0.0 AS seen_above, round(avg(share - 0.25), 6) AS surge_margin
    FROM tm LEFT JOIN se USING (match_id, phase, team_index) JOIN ra USING (match_id, phase, team_index) GROUP BY phase""",
)
def live_team_states(a: Arena) -> DataFrame:
    """D-17."""
    t = a.tables()
    s = V.live_states(t, V.shrink_moments(t), cut_off=0.25)
    return s.groupBy("phase").agg(
        F.count("*").alias("teams"), F.sum("seen").alias("seen"), F.sum("seen_close").alias("seen_close"), F.sum("seen_inside").alias("seen_inside"), r6(F.avg("seen_above"), "seen_above", 4), r6(F.avg("surge_margin"), "surge_margin")
    )


_EXCHANGES_SQL = f"""{HITS_SQL}, a AS (SELECT ph.*, p.x AS ax, p.y AS ay, p.t AS at_t FROM ph ASOF JOIN tracks p ON ph.match_id = p.match_id AND ph.attacker_id = p.id AND ph.t >= p.t),
    b AS (SELECT a.*, p.x AS bx, p.y AS bty, p.t AS bt FROM a ASOF JOIN tracks p ON a.match_id = p.match_id AND a.target_id = p.id AND a.t >= p.t),
    bz AS (SELECT b.*, coalesce(z.phase, 0) AS phase FROM b ASOF LEFT JOIN phases z ON b.match_id = z.match_id AND b.t >= z.start_shrink_t),
    n AS (SELECT *, least(ta, tb) AS s1, greatest(ta, tb) AS s2, t - lag(t) OVER (PARTITION BY match_id, least(ta, tb), greatest(ta, tb) ORDER BY t) AS since FROM bz WHERE t - at_t <= 60 AND t - bt <= 60),
    s AS (SELECT *, sum(CASE WHEN since > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, s1, s2 ORDER BY t) AS ex FROM n),
    e AS (SELECT match_id, s1, s2, ex, side, min(phase) AS phase, sum(CASE WHEN ta = side THEN amount ELSE 0 END) AS dealt, sum(CASE WHEN ta <> side THEN amount ELSE 0 END) AS taken,
      median(sqrt(pow(ax - bx, 2) + pow(ay - bty, 2)) / 100) AS dist FROM (SELECT *, unnest([s1, s2]) AS side FROM s) GROUP BY ALL)"""


@registered(
    "tag_ranges",
    f"""{_EXCHANGES_SQL}, q AS (SELECT count(*) AS n, quantile_cont(dist, 0.2) AS lo, quantile_cont(dist, 0.8) AS hi FROM e WHERE dealt > 0 AND taken = 0 AND phase BETWEEN 2 AND 5)
    SELECT n, round(CASE WHEN n >= 30 THEN greatest(20, lo) ELSE 30 END, 4) AS low, round(CASE WHEN n >= 30 THEN least(250, greatest(hi, lo + 30)) ELSE 120 END, 4) AS high FROM q""",
)
def tag_ranges(a: Arena) -> DataFrame:
    """D-21."""
    return V.tag_range(D.exchanges(a.tables())).select("n", r6("low", "low", 4), r6("high", "high", 4))


@registered(
    "loot_convergence",
    """la AS (SELECT match_id, id, min(t) AS land_t FROM tracks GROUP BY ALL), he AS (SELECT match_id, id, t, [1, 3, 5][l_partkey % 3 + 1] AS r FROM raw WHERE l_linenumber <= 2),
    b AS (SELECT match_id, id, max(r) AS r FROM he JOIN la USING (match_id, id) WHERE t - land_t BETWEEN -5 AND 180 GROUP BY ALL),
    k AS (SELECT *, (rank() OVER (PARTITION BY match_id ORDER BY r) + (count(*) OVER (PARTITION BY match_id, r) - 1) / 2) / count(*) OVER (PARTITION BY match_id) AS e FROM b),
    g AS (SELECT match_id, id, e > 2.0 / 3 AS best FROM k WHERE e > 2.0 / 3 OR e <= 1.0 / 3),
    w AS (SELECT phase + 1 AS zone, best, match_id, id, max(r) AS r FROM he JOIN g USING (match_id, id) JOIN phases USING (match_id) WHERE t BETWEEN finish_shrink_t - 90 AND finish_shrink_t GROUP BY ALL),
    c AS (SELECT zone, avg(r) FILTER (best) AS be, avg(r) FILTER (NOT best) AS wo FROM w GROUP BY ALL),
    f AS (SELECT *, be - wo AS gap, first_value(be - wo IGNORE NULLS) OVER (ORDER BY zone) AS g0 FROM c)
    SELECT zone, round(be, 6) AS best_early, round(wo, 6) AS worst_early, round(gap, 6) + 0.0 AS gap, gap <= 0.15 * greatest(g0, 1e-9) OR gap <= 0.1 AS closed FROM f""",
)
def loot_convergence(a: Arena) -> DataFrame:
    """D-36."""
    c = V.loot_convergence(a.tables())
    return c.select("zone", r6("best_early", "best_early"), r6("worst_early", "worst_early"), r6("gap", "gap"), "closed")


@registered(
    "team_endings",
    f"""{HITS_SQL}, n AS (SELECT *, least(ta, tb) AS a, greatest(ta, tb) AS b, t - lag(t) OVER (PARTITION BY match_id, least(ta, tb), greatest(ta, tb) ORDER BY t) AS since FROM ph),
    s AS (SELECT *, sum(CASE WHEN since > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, a, b ORDER BY t) AS fight FROM n),
    f AS (SELECT match_id, a, b, fight, min(t) AS t0, max(t) AS t1, count(*) AS hits FROM s GROUP BY ALL),
    d AS (SELECT match_id, team_index, death_t FROM players WHERE NOT is_bot AND death_t IS NOT NULL),
    w AS (SELECT f.*, EXISTS (SELECT 1 FROM d WHERE d.match_id = f.match_id AND d.team_index = f.a AND d.death_t BETWEEN t0 AND t1 + 5) AS la,
      EXISTS (SELECT 1 FROM d WHERE d.match_id = f.match_id AND d.team_index = f.b AND d.death_t BETWEEN t0 AND t1 + 5) AS lb FROM f),
    k AS (SELECT match_id, t0, unnest([a, b]) AS team_index FROM w WHERE hits >= 3 OR la <> lb),
    o AS (SELECT match_id, team_index, max(death_t) AS out_t, min(placement) AS final FROM players WHERE NOT is_bot GROUP BY ALL HAVING count(death_t) = count(*) AND min(placement) > 1)
    SELECT coalesce((SELECT max(phase) FROM phases p WHERE p.match_id = o.match_id AND p.finish_shrink_t <= out_t), 0) + 1 AS zone, count(*) AS teams,
      count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE k.match_id = o.match_id AND k.team_index = o.team_index AND k.t0 <= out_t + 1)) AS fought FROM o GROUP BY 1""",
)
def team_endings(a: Arena) -> DataFrame:
    """D-38."""
    t = a.tables()
    return V.endings(t, D.fights(t)).groupBy("zone").agg(F.count("*").alias("teams"), F.count("opponent").alias("fought"))


@registered(
    "score_bands",
    """p AS (SELECT match_id, id, row_number() OVER (PARTITION BY match_id ORDER BY value DESC, id) AS k, count(*) OVER (PARTITION BY match_id) AS n FROM players)
    SELECT match_id, CASE WHEN k <= greatest(1, floor(n * 0.25)) THEN 'top quarter' WHEN k <= floor(n * 0.5) THEN 'next quarter' ELSE 'rest' END AS band, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM p GROUP BY ALL""",
)
def score_bands(a: Arena) -> DataFrame:
    """D-40."""
    return V.score_bands(a.players, ["match_id"], "value", "id").groupBy("match_id", "band").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@registered(
    "inside_chances",
    f"""{TEAMS_SQL}, c AS (SELECT a.match_id, a.phase, a.team_index, sum(b.members) FILTER (sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= b.next_r) / sum(b.members) AS chance FROM tm a JOIN tm b ON a.match_id = b.match_id AND a.phase = b.phase GROUP BY ALL)
    SELECT phase, count(*) AS n, round(avg(chance), 6) AS chance FROM c GROUP BY phase""",
)
def inside_chances(a: Arena) -> DataFrame:
    """D-39: the weight of candidate centres, here the teams', whose circle holds a spot."""
    t = a.tables()
    m = V.team_moments(t, V.shrink_moments(t))
    cand = m.select("match_id", "phase", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("members").cast("double").alias("weight"), "next_r")
    got = V.inside_chance(m.select("match_id", "phase", "team_index", "x", "y"), cand, ["match_id", "phase"], "next_r")
    return got.groupBy("phase").agg(F.count("*").alias("n"), r6(F.avg("chance"), "chance"))


_REVEAL_SQL = TEAMS_SQL.replace("m.start_shrink_t AS at_t", "m.at_t").replace("FROM phases m JOIN players e", "FROM (SELECT * FROM (SELECT *, lag(finish_shrink_t) OVER (PARTITION BY match_id ORDER BY phase) AS at_t FROM phases) WHERE at_t IS NOT NULL) m JOIN players e").replace("e.death_t > m.start_shrink_t", "e.death_t > m.at_t")


@registered(
    "rotation_plans",
    f"""{_REVEAL_SQL}, ang AS (SELECT match_id, phase, team_index, x, y, outside_m, turn, next_x + cos(atan2(y - next_y, x - next_x) + radians(turn)) * next_r * 0.92 AS ex, next_y + sin(atan2(y - next_y, x - next_x) + radians(turn)) * next_r * 0.92 AS ey
      FROM tm, (SELECT unnest(range(-70, 71, 10)) AS turn) WHERE outside_m > 0),
    tr AS (SELECT g.match_id, g.phase, g.team_index, turn, any_value(sqrt(pow(g.x - ex, 2) + pow(g.y - ey, 2)) / 100 - g.outside_m) AS extra,
      count(*) FILTER (o.team_index <> g.team_index AND sqrt(pow(o.x - (g.x + (ex - g.x) * k), 2) + pow(o.y - (g.y + (ey - g.y) * k), 2)) / 100 <= 60) AS on_route,
      count(*) FILTER (o.team_index <> g.team_index AND sqrt(pow(o.x - ex, 2) + pow(o.y - ey, 2)) / 100 <= 60) AS at_entry
      FROM ang g JOIN tm o ON o.match_id = g.match_id AND o.phase = g.phase, LATERAL (SELECT greatest(0, least(1, ((o.x - g.x) * (ex - g.x) + (o.y - g.y) * (ey - g.y)) / (pow(ex - g.x, 2) + pow(ey - g.y, 2)))) AS k) GROUP BY ALL),
    st AS (SELECT match_id, phase, team_index, on_route, at_entry FROM tr WHERE turn = 0),
    al AS (SELECT match_id, phase, team_index, min(on_route + at_entry) AS traffic FROM tr WHERE extra <= 120 GROUP BY ALL)
    SELECT phase, count(*) AS teams, count(*) FILTER (outside_m > 0) AS outside, round(avg(outside_m / 5.5), 4) AS travel_s, CAST(coalesce(sum(on_route), 0) AS BIGINT) AS on_route, CAST(coalesce(sum(at_entry), 0) AS BIGINT) AS at_entry,
      count(*) FILTER (traffic < on_route + at_entry) AS better, round(avg(CASE WHEN outside_m > 0 THEN f.finish_shrink_t - outside_m / 5.5 END), 4) AS leave_by
    FROM tm JOIN (SELECT match_id, phase, finish_shrink_t FROM phases) f USING (match_id, phase) LEFT JOIN st USING (match_id, phase, team_index) LEFT JOIN al USING (match_id, phase, team_index) GROUP BY phase""",
)
def rotation_plans(a: Arena) -> DataFrame:
    """D-24, K-27: every team's way into every circle."""
    p = V.rotation_plans(a.tables())
    return p.groupBy("phase").agg(
        F.count("*").alias("teams"), F.count_if(F.col("outside_m") > 0).alias("outside"), r6(F.avg("travel_s"), "travel_s", 4), F.coalesce(F.sum("on_route"), F.lit(0)).alias("on_route"),
        F.coalesce(F.sum("at_entry"), F.lit(0)).alias("at_entry"), F.count("alt_turn").alias("better"), r6(F.avg("leave_by"), "leave_by", 4),
    )


#: Landings with a named place by fixed arithmetic, so that spots repeat.
_SPOTS_SQL = """ld AS (SELECT match_id, id, team_index, 'P' || ((team_index * 3 + match_id % (2 + team_index % 4)) % 17) AS poi, CAST(id * 1000 + match_id AS DOUBLE) AS land_x, CAST(id * 500 AS DOUBLE) AS land_y, (id + match_id) % 5 = 0 AS off_spawn, placement, kills FROM players),
    tn AS (SELECT team_index, poi, count(DISTINCT match_id) AS n FROM ld GROUP BY ALL), sp AS (SELECT team_index, arg_min(poi, (-n, poi)) AS spot, max(n) AS there FROM tn GROUP BY ALL)"""


def _landings(a: Arena) -> DataFrame:
    place = (F.col("team_index") * 3 + F.col("match_id") % (2 + F.col("team_index") % 4)) % 17
    return a.players.select(
        "match_id", "id", "team_index", F.concat(F.lit("P"), place.cast("string")).alias("poi"), (F.col("id") * 1000 + F.col("match_id")).cast("double").alias("land_x"), (F.col("id") * 500).cast("double").alias("land_y"),
        ((F.col("id") + F.col("match_id")) % 5 == 0).alias("off_spawn"), "placement", "kills",
    )


@registered("usual_spots", f"{_SPOTS_SQL} SELECT team_index, spot, there AS games_there, count(DISTINCT match_id) AS games, median(land_x) AS mid_x, median(land_y) AS mid_y FROM ld JOIN sp USING (team_index) GROUP BY ALL")
def usual_spots(a: Arena) -> DataFrame:
    """D-33."""
    return V.usual_spots(_landings(a), ["team_index"])


@registered(
    "spot_regulars",
    f"""{_SPOTS_SQL}, ow AS (SELECT l.team_index, l.match_id, max(CASE WHEN off_spawn THEN 1 ELSE 0 END) AS we FROM ld l JOIN sp s ON s.team_index = l.team_index AND s.spot = l.poi GROUP BY ALL),
    me AS (SELECT s.team_index, s.spot, l.id, l.match_id, l.off_spawn, we FROM sp s JOIN ld l ON l.poi = s.spot AND l.team_index <> s.team_index LEFT JOIN ow ON ow.team_index = s.team_index AND ow.match_id = l.match_id),
    pe AS (SELECT team_index, spot, id, count(DISTINCT match_id) AS games, count(DISTINCT CASE WHEN we IS NOT NULL THEN match_id END) AS shared, count(DISTINCT CASE WHEN we = 1 THEN match_id END) AS team_out, count(DISTINCT CASE WHEN we IS NOT NULL AND off_spawn THEN match_id END) AS they_out FROM me GROUP BY ALL HAVING count(DISTINCT match_id) >= 3)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY team_index ORDER BY games DESC, shared DESC, id) AS INT) AS place FROM pe) WHERE place <= 8""",
)
def spot_regulars(a: Arena) -> DataFrame:
    """D-41."""
    land = _landings(a)
    return V.regulars(land, V.usual_spots(land, ["team_index"]))


@registered(
    "backup_spots",
    f"""{_SPOTS_SQL}, te AS (SELECT match_id, poi, team_index, median(land_x) AS x, median(land_y) AS y FROM ld GROUP BY ALL),
    po AS (SELECT match_id, team_index, max(CASE WHEN placement <= 50 THEN 51 - placement ELSE 0 END + kills * 4) AS points FROM players GROUP BY ALL),
    pl AS (SELECT poi, count(*) AS team_games, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END) AS contested, avg(points) AS points, median(x) AS x, median(y) AS y FROM (SELECT *, count(*) OVER (PARTITION BY match_id, poi) AS n FROM te) JOIN po USING (match_id, team_index) GROUP BY ALL),
    me AS (SELECT s.team_index, s.spot, b.*, sqrt(pow(b.x - o.x, 2) + pow(b.y - o.y, 2)) / 100000 AS km FROM sp s JOIN pl o ON o.poi = s.spot JOIN pl b ON b.contested < o.contested AND b.poi <> s.spot WHERE b.team_games >= 10)
    SELECT team_index, spot, poi, team_games, round(contested, 6) AS contested, round(points, 6) AS points, round(km, 6) AS km, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY team_index ORDER BY points DESC, poi) AS INT) AS place FROM me) WHERE place <= 5""",
)
def backup_spots(a: Arena) -> DataFrame:
    """D-42."""
    land = _landings(a)
    points = P.scored(a.players, P.scheme(a.spark, P.SOLOS)).groupBy("match_id", "team_index").agg(F.max("points").alias("points"))
    b = V.backup_spots(land, points, V.usual_spots(land, ["team_index"]))
    return b.select("team_index", "spot", "poi", "team_games", r6("contested", "contested"), r6("points", "points"), r6("km", "km"), "place")


@registered(
    "team_habits",
    """ap AS (SELECT unnest(['clean drop', 'many eliminations']) AS rule, id, team_index, match_id, placement, unnest([(id + match_id) % 5 <> 0, kills >= 12]) AS followed,
      (rank() OVER (PARTITION BY match_id ORDER BY placement) + (count(*) OVER (PARTITION BY match_id, placement) - 1) / 2) / count(*) OVER (PARTITION BY match_id) AS ahead FROM players),
    ow AS (SELECT rule, id, avg(ahead) FILTER (followed) - avg(ahead) FILTER (NOT followed) AS gap FROM ap GROUP BY ALL HAVING count(*) FILTER (followed) >= 2 AND count(*) FILTER (NOT followed) >= 2),
    te AS (SELECT rule, count(*) AS players, -100 * avg(gap) AS gain FROM ow GROUP BY ALL HAVING count(*) >= 5)
    SELECT rule, team_index, count(*) AS n, round(avg(CASE WHEN followed THEN 0.0 ELSE 1 END), 6) AS broke, players, round(gain, 6) AS gain FROM ap JOIN te USING (rule) GROUP BY ALL""",
)
def team_habits(a: Arena) -> DataFrame:
    """D-45."""
    from tidemark.operators.ranks import percent_rank_average

    p = a.players.withColumn("ahead", percent_rank_average("placement", ["match_id"]))
    rule = F.explode(F.array(F.struct(F.lit("clean drop").alias("rule"), ((F.col("id") + F.col("match_id")) % 5 != 0).alias("followed")), F.struct(F.lit("many eliminations").alias("rule"), (F.col("kills") >= 12).alias("followed"))))
    h = V.habits(p.select("match_id", "id", "team_index", "ahead", rule.alias("_r")).select("*", "_r.*"))
    return h.select("rule", "team_index", "n", r6("broke", "broke"), F.col("players").cast("bigint").alias("players"), r6("gain", "gain"))


@registered(
    "crowd_actions",
    f"""{TEAMS_SQL}, ac AS (SELECT match_id, team_index, phase, members, CASE WHEN outside_m > 0 THEN 'rotate' ELSE 'hold' END AS action FROM tm),
    g AS (SELECT match_id, team_index, phase, members, count(*) AS n FROM ac GROUP BY ALL), o AS (SELECT phase, members, count(*) AS total FROM ac GROUP BY ALL), f AS (SELECT phase, members, action, count(*) AS every FROM ac GROUP BY ALL),
    m AS (SELECT match_id, team_index, phase, members, action, count(*) AS mine FROM ac GROUP BY ALL)
    SELECT match_id, team_index, phase, members, action, total - n AS others, round((every - coalesce(mine, 0)) / nullif(total - n, 0), 6) AS share FROM g JOIN o USING (phase, members) JOIN f USING (phase, members) LEFT JOIN m USING (match_id, team_index, phase, members, action)""",
)
def crowd_actions(a: Arena) -> DataFrame:
    """D-27, K-28: what the rest of the field does in a team's situation."""
    t = a.tables()
    m = V.team_moments(t, V.shrink_moments(t)).withColumn("action", F.when(F.col("outside_m") > 0, "rotate").otherwise("hold"))
    c = V.crowd(m.select("match_id", "team_index", "phase", "members", "action"), ["phase", "members"])
    return c.select("match_id", "team_index", "phase", "members", "action", "others", r6("share", "share"))


@registered(
    "plan_checks",
    """p AS (SELECT team_index, avg(placement) FILTER (match_id % 3 <> 0) AS p1, avg(placement) FILTER (match_id % 3 = 0) AS e1, avg(kills) FILTER (match_id % 3 <> 0) AS p2, avg(kills) FILTER (match_id % 3 = 0) AS e2 FROM players GROUP BY ALL)
    SELECT team_index, 'placement' AS measure, round(p1, 6) AS plan, round(e1, 6) AS event, round(e1 - p1, 6) + 0.0 AS change FROM p UNION ALL SELECT team_index, 'kills', round(p2, 6), round(e2, 6), round(e2 - p2, 6) + 0.0 FROM p""",
)
def plan_checks(a: Arena) -> DataFrame:
    """D-46."""
    mean = lambda when: a.players.where(when).groupBy("team_index").agg(F.avg("placement").alias("placement"), F.avg("kills").alias("kills"))
    c = V.plan_check(mean("match_id % 3 <> 0"), mean("match_id % 3 = 0"), ["team_index"], ["placement", "kills"])
    return c.select("team_index", "measure", r6("plan", "plan"), r6("event", "event"), r6("change", "change"))


@registered(
    "check_approaches",
    f"""{HITS_SQL}, {MEMBERS_SQL}, ap AS (SELECT match_id, phase, lag(finish_shrink_t) OVER (PARTITION BY match_id ORDER BY phase) AS appear FROM phases),
    m AS (SELECT me.*, appear FROM me JOIN ap USING (match_id, phase) WHERE appear IS NOT NULL), b AS (SELECT m.*, p.x AS fx, p.y AS fy FROM m ASOF JOIN tracks p ON m.match_id = p.match_id AND m.id = p.id AND m.appear >= p.t),
    d AS (SELECT b.*, coalesce((SELECT sum(amount) FROM ph WHERE ph.match_id = b.match_id AND ph.attacker_id = b.id AND ph.t BETWEEN appear AND at_t), 0) AS dealt,
      (SELECT min(t) FROM tracks k WHERE k.match_id = b.match_id AND k.id = b.id AND k.t BETWEEN appear AND at_t AND sqrt(pow(k.x - next_x, 2) + pow(k.y - next_y, 2)) <= next_r) AS t_in, sqrt(pow(x - fx, 2) + pow(y - fy, 2)) / 100 AS moved, sqrt(pow(x - next_x, 2) + pow(y - next_y, 2)) / next_r AS radial FROM b)
    SELECT CASE WHEN moved < 80 THEN CASE WHEN dealt >= 25 THEN 'stayed and hunted' ELSE 'stayed' END WHEN t_in <= at_t - 20 THEN 'in early' ELSE 'late or outside' END AS approach,
      CASE WHEN radial <= 0.5 THEN 'deep' WHEN radial <= 0.85 THEN 'inside' WHEN radial <= 1 THEN 'edge' WHEN radial <= 1.25 THEN 'just outside' ELSE 'far outside' END AS spot, count(*) AS n, round(sum(dealt), 4) AS dealt FROM d GROUP BY ALL""",
)
def check_approaches(a: Arena) -> DataFrame:
    """D-47."""
    t = a.tables()
    by = Window.partitionBy("match_id").orderBy("phase")
    c = t.zones.select("match_id", "phase", F.lag("finish_shrink_t").over(by).alias("appear"), F.col("start_shrink_t").alias("t"), "next_x", "next_y", "next_r").where("appear is not null")
    return V.approaches(t, c).groupBy("approach", "spot").agg(F.count("*").alias("n"), r6(F.sum("dealt"), "dealt", 4))


@registered(
    "best_teams",
    """g AS (SELECT id % 20 AS team, CASE WHEN placement <= 50 THEN 51 - placement ELSE 0 END + kills * 4 AS points FROM players WHERE (id + match_id) % 3 = 0),
    p AS (SELECT team, avg(points) AS ppg, count(*) AS games FROM g GROUP BY ALL), c AS (SELECT CASE WHEN count(*) FILTER (games >= 30) >= 10 THEN 30 WHEN count(*) FILTER (games >= 20) >= 10 THEN 20 ELSE 1 END AS minimum FROM p),
    k AS (SELECT p.*, minimum FROM p, c WHERE games >= minimum)
    SELECT team, round(ppg, 6) AS ppg, games, minimum, row_number() OVER (ORDER BY ppg DESC, team) <= (SELECT greatest(3, ceil(count(*) * 0.1)) FROM k) AS top FROM k""",
)
def best_teams(a: Arena) -> DataFrame:
    """D-30."""
    g = P.scored(a.players.where("(id + match_id) % 3 = 0"), P.scheme(a.spark, P.SOLOS)).select((F.col("id") % 20).alias("team"), "points")
    return V.top_teams(g, "team", (30, 20, 1)).select("team", r6("ppg", "ppg"), "games", "minimum", "top")


@registered(
    "first_centres",
    """d AS (SELECT match_id, id, t AS drop_t FROM (SELECT match_id, id, t, health + shield AS hs, lag(health + shield) OVER (PARTITION BY match_id, id ORDER BY t) AS h0 FROM changes) q WHERE h0 - hs > 0.5
      AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.match_id = q.match_id AND h.target_id = q.id AND h.t BETWEEN q.t - 1.5 AND q.t + 0.5)),
    z AS (SELECT * FROM phases WHERE phase = 1), dz AS (SELECT d.* FROM d JOIN z USING (match_id) WHERE drop_t BETWEEN start_shrink_t AND finish_shrink_t + 5),
    s AS (SELECT k.match_id, k.x, k.y, z.next_x, z.next_y, (k.t - start_shrink_t) / (finish_shrink_t - start_shrink_t) AS f, EXISTS (SELECT 1 FROM dz WHERE dz.match_id = k.match_id AND dz.id = k.id AND dz.drop_t >= k.t AND dz.drop_t - k.t <= 30) AS hurt, cur_r + (k.t - start_shrink_t) / (finish_shrink_t - start_shrink_t) * (next_r - cur_r) AS r
      FROM tracks k JOIN players p USING (match_id, id) JOIN z USING (match_id) WHERE NOT is_bot AND k.t BETWEEN start_shrink_t AND finish_shrink_t AND (death_t IS NULL OR k.t < death_t - 1)),
    en AS (SELECT match_id FROM s GROUP BY ALL HAVING count(*) FILTER (hurt) >= 5 AND count(*) FILTER (NOT hurt) >= 5),
    c AS (SELECT match_id, next_x - 90000 + i * 15000 AS cx, next_y - 90000 + j * 15000 AS cy, cur_r, next_x, next_y, next_r FROM z JOIN en USING (match_id), (SELECT unnest(range(0, 13)) AS i), (SELECT unnest(range(0, 13)) AS j)),
    v AS (SELECT s.match_id, cx, cy, hurt, CASE WHEN sqrt(pow(s.x - (cx + (s.next_x - cx) * f), 2) + pow(s.y - (cy + (s.next_y - cy) * f), 2)) > r THEN 1.0 ELSE 0 END AS o FROM s JOIN c USING (match_id) WHERE sqrt(pow(cx - c.next_x, 2) + pow(cy - c.next_y, 2)) + c.next_r <= c.cur_r),
    b AS (SELECT match_id, cx, cy, round((avg(o) FILTER (hurt) + avg(1 - o) FILTER (NOT hurt)) / 2, 9) AS score FROM v GROUP BY ALL)
    SELECT match_id, arg_min(cx, (-score, cx, cy)) AS cur_x, arg_min(cy, (-score, cx, cy)) AS cur_y, max(score) AS score FROM b GROUP BY match_id HAVING max(score) > 0.5""",
)
def first_centres(a: Arena) -> DataFrame:
    """D-18, one pass over a coarse grid."""
    return V.first_centres(a.tables(), ((90_000.0, 15_000.0),), least=5, follow_s=30.0, least_score=0.5)


# ---- tables of studies ------------------------------------------------------------------------------------------


def _table(a: Arena, study: str, name: str) -> DataFrame:
    return K.run_study(study, K.Context(a.tables()))[name]


@registered(
    "gameplan_leave_by",
    f"""{ROTATIONS_SQL}, sp AS (SELECT phase, median(outside_m / (entry - depart)) AS speed, median(start_t - reveal_t) AS wait_s FROM rt WHERE entry > depart GROUP BY ALL)
    SELECT phase, round(speed, 4) AS speed, round(wait_s, 4) AS wait_s, distance_m, round(wait_s - distance_m / speed, 4) + 0.0 AS leave_by_s FROM (SELECT *, CAST(unnest([50, 100, 200, 400]) AS DOUBLE) AS distance_m FROM sp)""",
)
def leave_by(a: Arena) -> DataFrame:
    """K-29, D-43: the latest time to leave by phase and distance."""
    t = _table(a, "gameplan", "table:leave_by")
    return t.select("phase", r6("speed", "speed", 4), r6("wait_s", "wait_s", 4), "distance_m", r6("leave_by_s", "leave_by_s", 4))


@registered(
    "room_damage_log",
    f"""{SURGE_SQL}, {HITS_SQL}, al AS (SELECT match_id, id, t, lost, {MARGIN} < 0 AS storm, round_even(t, 0) AS sec, t - lag(t) OVER w AS back, lead(t) OVER w - t AS ahead FROM uz WINDOW w AS (PARTITION BY match_id, id ORDER BY t)),
    tg AS (SELECT match_id, sec, count(DISTINCT id) AS n FROM al GROUP BY ALL)
    SELECT match_id, id, t, CAST(lost AS DOUBLE) AS lost, CASE WHEN storm THEN 'storm' WHEN coalesce(back BETWEEN 3 AND 7, false) OR coalesce(ahead BETWEEN 3 AND 7, false) OR n >= 3 THEN 'surge' ELSE 'other' END AS cause, CAST(NULL AS BIGINT) AS "by" FROM al JOIN tg USING (match_id, sec)
    UNION ALL SELECT match_id, target_id, t, CAST(amount AS DOUBLE), 'hit', attacker_id FROM ph""",
)
def damage_log(a: Arena) -> DataFrame:
    """K-28, D-25: every loss of health with its cause."""
    return _table(a, "match_room", "table:damage")


@registered(
    "zone_shapes",
    """f AS (SELECT *, sqrt(pow(next_x - cur_x, 2) + pow(next_y - cur_y, 2)) AS dist, round(start_shrink_t - lag(finish_shrink_t) OVER (PARTITION BY match_id ORDER BY phase), 1) AS wait FROM phases),
    k AS (SELECT *, CASE WHEN dist <= (cur_r - next_r) * 1.01 + 1 THEN 'shrinking' WHEN coalesce(wait, 99) <= 1 THEN 'moving' WHEN dist < cur_r + next_r THEN '50/50' ELSE 'shifted' END AS zone_type FROM f),
    n AS (SELECT phase, zone_type, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT phase, arg_min(zone_type, (-n, zone_type)) AS zone_type, max(n) / sum(n) AS share FROM n GROUP BY ALL)
    SELECT phase, round(median(wait), 4) AS wait_s, round(median(next_r / cur_r), 6) AS shrink_ratio, round(quantile_cont(dist / cur_r, 0.75) - quantile_cont(dist / cur_r, 0.25), 6) AS spread, stddev_samp(dist) < 100 AS fixed_distance, any_value(m.zone_type) AS zone_type, round(any_value(share), 6) AS share
    FROM k JOIN m USING (phase) GROUP BY phase""",
)
def zone_shapes(a: Arena) -> DataFrame:
    """K-03: what each phase looks like."""
    t = _table(a, "zone_geometry", "table:phases")
    return t.select("phase", r6("wait_s", "wait_s", 4), r6("shrink_ratio", "shrink_ratio"), r6("spread", "spread"), "fixed_distance", "zone_type", r6("share", "share"))


@registered(
    "endgame_survival",
    """s AS (SELECT m.match_id, m.phase, e.id, e.team_index, m.start_shrink_t AS at_t, e.placement FROM phases m JOIN players e USING (match_id) WHERE NOT e.is_bot AND (e.death_t IS NULL OR e.death_t > m.start_shrink_t)),
    a AS (SELECT s.*, p.z FROM s ASOF JOIN tracks p ON s.match_id = p.match_id AND s.id = p.id AND s.at_t >= p.t),
    h AS (SELECT match_id, phase, team_index, round(avg(z) / 100, 9) AS height FROM a GROUP BY ALL),
    r AS (SELECT *, (rank() OVER (PARTITION BY match_id, phase ORDER BY height) + (count(*) OVER (PARTITION BY match_id, phase, height) - 1) / 2) / count(*) OVER (PARTITION BY match_id, phase) AS share FROM h),
    l AS (SELECT *, coalesce(lead(phase) OVER (PARTITION BY match_id, team_index ORDER BY phase) = phase + 1, false) AS survived FROM r WHERE phase >= 6)
    SELECT phase, CASE WHEN share <= 1.0 / 3 THEN 'Low' WHEN share <= 2.0 / 3 THEN 'Middle' ELSE 'High' END AS tier, count(*) AS n, round(avg(CASE WHEN survived THEN 1.0 ELSE 0 END), 6) AS survived FROM l GROUP BY ALL""",
)
def endgame_survival(a: Arena) -> DataFrame:
    """K-16, J-19: who is still there in the next late zone, by height."""
    return _table(a, "endgame_height", "table:survival").select("phase", "tier", "n", r6("survived", "survived"))

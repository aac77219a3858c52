"""Queries of the spots to hold, with SQL that pairs every spot with every sample of its circle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import moves as V
from tidemark.plans import spots as P
from tidemark.plans.move_queries import TEAMS_SQL
from tidemark.plans.operator_queries import r6
from tidemark.sources.arena import ARENA_SQL, Arena

QUERIES, ORACLES = {}, {}


def registered(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Arena(spark, sf_dir))
        ORACLES[name] = f"WITH {ARENA_SQL}, {sql}"
        return f

    return add


def _grid_sql(side: int, inside: float) -> str:
    return f"""gr AS (SELECT spot, -1.0::DOUBLE + 2.0::DOUBLE * (spot % {side}) / {side - 1}.0::DOUBLE AS gx, -1.0::DOUBLE + 2.0::DOUBLE * (spot // {side}) / {side - 1}.0::DOUBLE AS gy FROM (SELECT unnest(range(0, {side * side})) AS spot)),
    sp AS (SELECT match_id, phase, spot, zx + gx * zr AS x, zy + gy * zr AS y, zx, zy FROM ho, gr WHERE gx * gx + gy * gy <= {inside})"""


LAND_SQL = """ld AS (SELECT floor(x / 2500) AS cx, floor(y / 2500) AS cy, quantile_cont(z, 0.2) AS ground FROM tracks JOIN (SELECT match_id, id, min(t) AS land_t FROM tracks GROUP BY ALL) USING (match_id, id) WHERE t >= land_t AND t < 110 GROUP BY ALL HAVING count(*) >= 2)"""
PAIR_SQL = """sqrt(pow(e.x - s.x, 2) + pow(e.y - s.y, 2)) / 100 AS d, ((e.x - s.x) * (s.x - zx) + (e.y - s.y) * (s.y - zy)) / (sqrt(pow(e.x - s.x, 2) + pow(e.y - s.y, 2)) / 100 * 100 * (sqrt(pow(s.x - zx, 2) + pow(s.y - zy, 2)) + 1e-9) + 1e-9) > 0.3 AS facing, s.z - e.z >= 1500 AS high"""


@registered(
    "surge_base_audit",
    f"""ho AS (SELECT * FROM (SELECT match_id, phase, next_x AS zx, next_y AS zy, next_r AS zr, lag(finish_shrink_t) OVER (PARTITION BY match_id ORDER BY phase) AS appear, start_shrink_t AS until FROM phases) WHERE until - appear >= 10 AND phase BETWEEN 2 AND 5),
    ve AS (SELECT *, coalesce((x - lag(x) OVER w) / (t - lag(t) OVER w), 0) AS vx, coalesce((y - lag(y) OVER w) / (t - lag(t) OVER w), 0) AS vy FROM tracks WINDOW w AS (PARTITION BY match_id, id ORDER BY t)),
    sm AS (SELECT h.match_id, h.phase, p.team_index, v.x, v.y, v.z, sqrt(vx * vx + vy * vy) >= 250 AND (sqrt(pow(zx - v.x, 2) + pow(zy - v.y, 2)) > zr OR (vx * (zx - v.x) + vy * (zy - v.y)) / (sqrt(vx * vx + vy * vy) * sqrt(pow(zx - v.x, 2) + pow(zy - v.y, 2)) + 1e-9) > 0.5) AS rotating
      FROM ho h JOIN ve v ON v.match_id = h.match_id AND v.t BETWEEN appear AND until JOIN players p ON p.match_id = v.match_id AND p.id = v.id WHERE NOT p.is_bot AND (p.death_t IS NULL OR v.t < p.death_t)),
    {LAND_SQL}, {_grid_sql(28, 0.92)},
    ba AS (SELECT match_id, phase, team_index, median(x) AS x, median(y) AS y, median(z) AS own, any_value(zx) AS zx, any_value(zy) AS zy FROM sm JOIN ho USING (match_id, phase) GROUP BY ALL),
    al AS (SELECT match_id, phase, spot, NULL AS team_index, x, y, zx, zy, NULL AS own FROM sp UNION ALL SELECT match_id, phase, 784 + team_index, team_index, x, y, zx, zy, own FROM ba),
    gd AS (SELECT al.*, ground FROM al LEFT JOIN ld ON ld.cx = floor(x / 2500) AND ld.cy = floor(y / 2500)),
    us AS (SELECT match_id, phase, median(ground) AS usual FROM gd GROUP BY ALL),
    pl AS (SELECT gd.*, CASE WHEN own IS NULL THEN coalesce(ground, usual, 0) ELSE greatest(coalesce(ground, usual, 0), own) END AS z FROM gd JOIN us USING (match_id, phase)),
    pr AS (SELECT s.match_id, s.phase, s.spot, s.team_index, e.team_index AS other, rotating, {PAIR_SQL} FROM pl s JOIN sm e ON e.match_id = s.match_id AND e.phase = s.phase),
    ct AS (SELECT match_id, phase, spot, team_index, other, sum(CASE WHEN rotating AND facing AND d BETWEEN 20 AND 250 THEN CASE WHEN high THEN 2 ELSE 1 END ELSE 0 END) AS tag, sum(CASE WHEN d < 30 THEN 1 ELSE 0 END) AS danger FROM pr GROUP BY ALL),
    bs AS (SELECT match_id, phase, team_index, coalesce(sum(tag) FILTER (other <> team_index), 0) AS base_tag, coalesce(sum(danger) FILTER (other <> team_index), 0) AS base_danger FROM ct WHERE team_index IS NOT NULL GROUP BY ALL),
    tt AS (SELECT match_id, phase, spot, sum(tag) AS tag, sum(danger) AS danger FROM ct WHERE team_index IS NULL GROUP BY ALL),
    op AS (SELECT b.*, sp.spot, sp.x, sp.y, coalesce(tt.tag, 0) - coalesce(o.tag, 0) AS tag, coalesce(tt.danger, 0) - coalesce(o.danger, 0) AS danger FROM bs b JOIN sp USING (match_id, phase) LEFT JOIN tt USING (match_id, phase, spot)
      LEFT JOIN ct o ON o.team_index IS NULL AND o.match_id = b.match_id AND o.phase = b.phase AND o.spot = sp.spot AND o.other = b.team_index),
    be AS (SELECT match_id, phase, team_index, spot, tag, x, y FROM op WHERE danger <= greatest(base_danger, 5) QUALIFY row_number() OVER (PARTITION BY match_id, phase, team_index ORDER BY tag DESC, spot) = 1)
    SELECT match_id, phase, team_index, CAST(base_tag AS BIGINT) AS base_tag, CAST(base_danger AS BIGINT) AS base_danger, spot AS best_spot, CAST(tag AS BIGINT) AS best_tag, round(sqrt(pow(be.x - ba.x, 2) + pow(be.y - ba.y, 2)) / 100, 4) AS best_m
    FROM bs LEFT JOIN be USING (match_id, phase, team_index) JOIN ba USING (match_id, phase, team_index)""",
)
def surge_base_audit(a: Arena) -> DataFrame:
    """D-22: bases and better spots in every hold of phases 2 to 5."""
    found = P.base_audit(a.tables(), 20.0, 250.0)
    return found.select("match_id", "phase", "team_index", "base_tag", "base_danger", "best_spot", "best_tag", r6("best_m", "best_m", 4))


LANES_SQL = f"""{TEAMS_SQL}, tw AS (SELECT * FROM tm WHERE phase BETWEEN 2 AND 5),
    en AS (SELECT *, sqrt(pow(next_x - x, 2) + pow(next_y - y, 2)) AS d FROM tw), ln AS (SELECT *, d - next_r AS entry, greatest(2, CAST(floor((d - next_r) / 1000) AS INT)) AS n FROM en WHERE d > next_r),
    lk AS (SELECT *, unnest(range(0, n)) AS k FROM ln),
    la AS (SELECT match_id, phase, team_index, k AS point, x + (next_x - x) / d * (entry * (k / (n - 1)::DOUBLE) + next_r * 0.15 * (k / (n - 1)::DOUBLE)) AS x, y + (next_y - y) / d * (entry * (k / (n - 1)::DOUBLE) + next_r * 0.15 * (k / (n - 1)::DOUBLE)) AS y, z FROM lk)"""


def _teams(a: Arena) -> tuple:
    t = a.tables()
    return t, V.team_moments(t, V.shrink_moments(t).where("phase between 2 and 5"))


@registered("lane_points", f"{LANES_SQL} SELECT match_id, phase, team_index, count(*) AS points, round(min(x), 2) AS low_x, round(max(x), 2) AS high_x, round(sum(y), 1) + 0.0 AS sum_y FROM la GROUP BY ALL")
def lanes(a: Arena) -> DataFrame:
    """D-23: the ways in of all teams outside, phases 2 to 5."""
    p = P.lane_points(_teams(a)[1])
    return p.groupBy("match_id", "phase", "team_index").agg(F.count("*").alias("points"), F.round(F.min("x"), 2).alias("low_x"), F.round(F.max("x"), 2).alias("high_x"), (F.round(F.sum("y"), 1) + 0.0).alias("sum_y"))


@registered(
    "surge_bases",
    f"""{LANES_SQL}, ho AS (SELECT match_id, phase, any_value(next_x) AS zx, any_value(next_y) AS zy, any_value(next_r) AS zr FROM tw GROUP BY ALL), {LAND_SQL}, {_grid_sql(30, 0.9)},
    gd AS (SELECT sp.*, ground FROM sp LEFT JOIN ld ON ld.cx = floor(x / 2500) AND ld.cy = floor(y / 2500)), us AS (SELECT match_id, phase, median(ground) AS usual FROM gd GROUP BY ALL),
    pl AS (SELECT gd.*, coalesce(ground, usual, 0) AS z FROM gd JOIN us USING (match_id, phase)), mz AS (SELECT match_id, phase, median(z) AS usual_z FROM pl GROUP BY ALL),
    sc AS (SELECT match_id, phase, spot, other, sum(CASE WHEN facing AND d BETWEEN 20 AND 80 THEN CASE WHEN high THEN 2 ELSE 1 END ELSE 0 END) AS tag FROM (SELECT s.match_id, s.phase, s.spot, e.team_index AS other, {PAIR_SQL} FROM pl s JOIN la e ON e.match_id = s.match_id AND e.phase = s.phase AND abs(e.x - s.x) <= 8001 AND abs(e.y - s.y) <= 8001) GROUP BY ALL),
    dg AS (SELECT DISTINCT s.match_id, s.phase, s.spot, e.team_index AS other FROM pl s JOIN tw e ON e.match_id = s.match_id AND e.phase = s.phase WHERE sqrt(pow(e.x - s.x, 2) + pow(e.y - s.y, 2)) / 100 < 30),
    tt AS (SELECT match_id, phase, spot, sum(tag) AS tag FROM sc GROUP BY ALL), dd AS (SELECT match_id, phase, spot, count(*) AS n FROM dg GROUP BY ALL),
    op AS (SELECT t.match_id, t.phase, t.team_index, p.spot, p.z, tt.tag - coalesce(o.tag, 0) AS tag, sqrt(pow(p.x - t.x, 2) + pow(p.y - t.y, 2)) / 100 AS away FROM tw t JOIN pl p USING (match_id, phase) JOIN tt USING (match_id, phase, spot) LEFT JOIN dd USING (match_id, phase, spot)
      LEFT JOIN sc o ON o.match_id = t.match_id AND o.phase = t.phase AND o.spot = p.spot AND o.other = t.team_index LEFT JOIN dg g ON g.match_id = t.match_id AND g.phase = t.phase AND g.spot = p.spot AND g.other = t.team_index
      WHERE coalesce(dd.n, 0) - CASE WHEN g.spot IS NULL THEN 0 ELSE 1 END = 0 AND tt.tag - coalesce(o.tag, 0) > 0),
    be AS (SELECT * FROM (SELECT *, max(tag) OVER (PARTITION BY match_id, phase, team_index) AS top FROM op) WHERE tag >= 0.9 * top QUALIFY row_number() OVER (PARTITION BY match_id, phase, team_index ORDER BY away, spot) = 1)
    SELECT match_id, phase, team_index, spot, CAST(tag AS BIGINT) AS score, round(away, 4) AS away_m, round((z - usual_z) / 100, 4) + 0.0 AS height_m FROM be JOIN mz USING (match_id, phase)""",
)
def bases(a: Arena) -> DataFrame:
    """D-23: every team's best spot against the ways in that it can foresee, phases 2 to 5."""
    t, teams = _teams(a)
    found = P.surge_bases(teams, P.ground(t))
    return found.select("match_id", "phase", "team_index", "spot", "score", r6("away_m", "away_m", 4), r6("height_m", "height_m", 4))

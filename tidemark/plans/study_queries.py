"""Detectors, models and studies over the arena view of the given tables; SQL where one statement can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import boosting as B
from tidemark.functions import stats as T
from tidemark.operators import aggregates as A
from tidemark.operators import selection as L
from tidemark.operators.spatial import blurred_density, grid_density, land_map
from tidemark.plans import detect as D
from tidemark.plans import models as M
from tidemark.plans import moves as V
from tidemark.plans import rules, value_studies  # noqa: F401  register their studies
from tidemark.plans import studies as K
from tidemark.plans.operator_queries import DROPS_SQL, MARGIN, SHARE_OF_MOVE, r6
from tidemark.sources.arena import ARENA_SQL, Arena
from tidemark.sources.shared import written

QUERIES, ORACLES = {}, {}


def registered(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Arena(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {ARENA_SQL}, {sql}"
        return f

    return add


HITS_SQL = """ph AS (SELECT h.match_id, h.t, h.attacker_id, h.target_id, h.amount, a.team_index AS ta, b.team_index AS tb FROM hits h
    JOIN players a ON a.match_id = h.match_id AND a.id = h.attacker_id JOIN players b ON b.match_id = h.match_id AND b.id = h.target_id
    WHERE NOT a.is_bot AND NOT b.is_bot AND a.team_index <> b.team_index)"""


@registered(
    "detect_player_phases",
    f"""z AS (SELECT p.*, lag(finish_shrink_t) OVER (PARTITION BY match_id ORDER BY phase) AS reveal_t FROM phases p),
    s AS (SELECT k.id, k.t, k.x, k.y, z.*, {SHARE_OF_MOVE} AS f, sqrt(pow(x - next_x, 2) + pow(y - next_y, 2)) / 100 AS d FROM z JOIN tracks k ON k.match_id = z.match_id AND k.t BETWEEN z.reveal_t AND z.finish_shrink_t WHERE reveal_t IS NOT NULL),
    q AS (SELECT *, {MARGIN} < 0 AS storm, first_value(d) OVER (PARTITION BY match_id, phase, id ORDER BY t) AS d0 FROM s),
    g AS (SELECT match_id, phase, id, count(*) AS n, any_value(d0) AS d0, min(t) FILTER (d <= next_r / 100) AS entry, min(t) FILTER (d <= d0 - greatest(50, 0.25 * (d0 - next_r / 100))) AS depart, count(*) FILTER (storm) AS storm_n FROM q GROUP BY ALL)
    SELECT phase, count(*) AS players, CAST(sum(n) AS BIGINT) AS samples, round(avg(d0), 4) AS reveal_m, count(entry) AS entered, count(depart) AS departed, CAST(sum(storm_n) AS BIGINT) AS storm_n FROM g GROUP BY phase""",
)
def phases(a: Arena) -> DataFrame:
    """D-03."""
    p = D.player_phases(a.tables())
    return p.groupBy("phase").agg(
        F.count("*").alias("players"), F.sum("n").alias("samples"), r6(F.avg("reveal_m"), "reveal_m", 4), F.count("entry_t").alias("entered"), F.count("depart_t").alias("departed"), F.sum("storm_n").alias("storm_n")
    )


@registered(
    "detect_standing",
    """s AS (SELECT m.match_id, m.phase, e.id, e.team_index, m.start_shrink_t AS at_t, e.placement FROM phases m JOIN players e USING (match_id) WHERE NOT e.is_bot AND (e.death_t IS NULL OR e.death_t > m.start_shrink_t)),
    a AS (SELECT s.*, p.z FROM s ASOF JOIN tracks p ON s.match_id = p.match_id AND s.id = p.id AND s.at_t >= p.t),
    h AS (SELECT match_id, phase, team_index, round(avg(z) / 100, 9) AS height, min(placement) AS final FROM a GROUP BY ALL),
    r AS (SELECT *, (rank() OVER (PARTITION BY match_id, phase ORDER BY height) + (count(*) OVER (PARTITION BY match_id, phase, height) - 1) / 2) / count(*) OVER (PARTITION BY match_id, phase) AS share FROM h)
    SELECT phase, CASE WHEN share <= 1.0 / 3 THEN 'Low' WHEN share <= 2.0 / 3 THEN 'Middle' ELSE 'High' END AS tier, count(*) AS n, round(avg(final), 6) AS final FROM r GROUP BY ALL""",
)
def standing(a: Arena) -> DataFrame:
    """D-05."""
    return D.team_snapshots(a.tables()).groupBy("phase", "tier").agg(F.count("*").alias("n"), r6(F.avg("final"), "final"))


@registered(
    "detect_kill_fights",
    """k AS (SELECT * FROM kills WHERE victim_id <> finisher_id),
    a AS (SELECT k.*, p.z AS wz, p.t AS wt FROM k ASOF LEFT JOIN tracks p ON k.match_id = p.match_id AND k.finisher_id = p.id AND k.t >= p.t),
    b AS (SELECT a.*, p.z AS lz, p.t AS lt FROM a ASOF LEFT JOIN tracks p ON a.match_id = p.match_id AND a.victim_id = p.id AND a.t >= p.t)
    SELECT match_id, count(*) AS n, round(avg((wz - lz) / 100), 4) AS above_m FROM b WHERE t - wt <= 30 AND t - lt <= 30 GROUP BY match_id""",
)
def kill_fights(a: Arena) -> DataFrame:
    """D-06."""
    k = D.kill_fights(a.tables(), 30.0)
    return k.groupBy("match_id").agg(F.count("*").alias("n"), r6(F.avg("above_m"), "above_m", 4))


@registered(
    "detect_fights",
    f"""{HITS_SQL}, n AS (SELECT *, least(ta, tb) AS a, greatest(ta, tb) AS b, t - lag(t) OVER (PARTITION BY match_id, least(ta, tb), greatest(ta, tb) ORDER BY t) AS since FROM ph),
    s AS (SELECT *, sum(CASE WHEN since > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, a, b ORDER BY t) AS fight FROM n),
    f AS (SELECT match_id, a, b, fight, min(t) AS t0, max(t) AS t1, count(*) AS hits, sum(amount) FILTER (ta = a) AS da, sum(amount) FILTER (ta = b) AS db FROM s GROUP BY ALL),
    d AS (SELECT match_id, team_index, death_t FROM players WHERE NOT is_bot AND death_t IS NOT NULL),
    w AS (SELECT f.*, EXISTS (SELECT 1 FROM d WHERE d.match_id = f.match_id AND d.team_index = f.a AND d.death_t BETWEEN t0 AND t1 + 5) AS la,
      EXISTS (SELECT 1 FROM d WHERE d.match_id = f.match_id AND d.team_index = f.b AND d.death_t BETWEEN t0 AND t1 + 5) AS lb FROM f)
    SELECT match_id, count(*) AS fights, count(*) FILTER (la <> lb) AS decided, CAST(sum(hits) AS BIGINT) AS hits, round(sum(coalesce(da, 0) + coalesce(db, 0)), 4) AS damage FROM w WHERE hits >= 3 OR la <> lb GROUP BY match_id""",
)
def fights(a: Arena) -> DataFrame:
    """D-07."""
    f = D.fights(a.tables())
    return f.groupBy("match_id").agg(F.count("*").alias("fights"), F.count("winner").alias("decided"), F.sum("hits").alias("hits"), r6(F.sum(F.col("damage_a") + F.col("damage_b")), "damage", 4))


@registered(
    "detect_exchanges",
    f"""{HITS_SQL}, a AS (SELECT ph.*, p.x AS ax, p.y AS ay, p.z AS az, p.t AS at_t FROM ph ASOF JOIN tracks p ON ph.match_id = p.match_id AND ph.attacker_id = p.id AND ph.t >= p.t),
    b AS (SELECT a.*, p.x AS bx, p.y AS bty, p.z AS bz, p.t AS bt FROM a ASOF JOIN tracks p ON a.match_id = p.match_id AND a.target_id = p.id AND a.t >= p.t),
    n AS (SELECT *, least(ta, tb) AS s1, greatest(ta, tb) AS s2, t - lag(t) OVER (PARTITION BY match_id, least(ta, tb), greatest(ta, tb) ORDER BY t) AS since FROM b WHERE t - at_t <= 60 AND t - bt <= 60),
    s AS (SELECT *, sum(CASE WHEN since > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, s1, s2 ORDER BY t) AS ex FROM n),
    e AS (SELECT match_id, s1, s2, ex, side, sum(CASE WHEN ta = side THEN amount ELSE 0 END) AS dealt, sum(CASE WHEN ta <> side THEN amount ELSE 0 END) AS taken,
      avg(CASE WHEN ta = side THEN (az - bz) / 100 ELSE (bz - az) / 100 END) AS above FROM (SELECT *, unnest([s1, s2]) AS side FROM s) GROUP BY ALL)
    SELECT match_id, count(*) AS sides, round(sum(dealt), 4) AS dealt, round(sum(taken), 4) AS taken, count(*) FILTER (dealt > 0 AND taken = 0) AS one_sided, count(*) FILTER (above > 5) AS above FROM e GROUP BY match_id""",
)
def exchanges(a: Arena) -> DataFrame:
    """D-08."""
    e = D.exchanges(a.tables())
    return e.groupBy("match_id").agg(F.count("*").alias("sides"), r6(F.sum("dealt"), "dealt", 4), r6(F.sum("taken"), "taken", 4), F.count_if("one_sided").alias("one_sided"), F.count_if(F.col("above_m") > 5).alias("above"))


SURGE_SQL = f"""{DROPS_SQL.replace('FROM changes)', 'FROM changes)')},
    up AS (SELECT u.match_id, u.id, u.t, u.lost, k.x, k.y FROM u ASOF LEFT JOIN tracks k ON u.match_id = k.match_id AND u.id = k.id AND u.t >= k.t),
    uz AS (SELECT up.*, z.* EXCLUDE (match_id), {SHARE_OF_MOVE} AS f FROM up ASOF LEFT JOIN phases z ON up.match_id = z.match_id AND up.t >= z.start_shrink_t),
    ins AS (SELECT match_id, id, t, lost, phase, round_even(t, 0) AS sec FROM uz WHERE NOT ({MARGIN} < 0) AND phase IS NOT NULL),
    rh AS (SELECT *, t - lag(t) OVER w AS back, lead(t) OVER w - t AS ahead FROM ins WINDOW w AS (PARTITION BY match_id, id ORDER BY t)),
    cr AS (SELECT match_id, sec, count(DISTINCT id) AS n FROM ins GROUP BY ALL),
    ti AS (SELECT rh.* FROM rh JOIN cr USING (match_id, sec) WHERE coalesce(back BETWEEN 3 AND 7, false) OR coalesce(ahead BETWEEN 3 AND 7, false) OR n >= 3),
    se AS (SELECT match_id, sec, max(phase) AS phase FROM ti GROUP BY ALL),
    sn AS (SELECT *, sum(CASE WHEN since > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY sec) AS episode FROM (SELECT *, sec - lag(sec) OVER (PARTITION BY match_id ORDER BY sec) AS since FROM se)),
    ep AS (SELECT match_id, episode, min(sec) AS t0, max(sec) AS t1, count(*) AS ticks, max(phase) AS phase FROM sn GROUP BY ALL)"""


@registered(
    "detect_surge_episodes",
    f"""{SURGE_SQL}, hit AS (SELECT DISTINCT ti.match_id, sn.episode, ti.id FROM ti JOIN sn USING (match_id, sec)),
    al AS (SELECT ep.match_id, ep.episode, ep.phase, p.id, hit.id IS NOT NULL AS surged FROM ep JOIN players p ON p.match_id = ep.match_id AND NOT p.is_bot AND (p.death_t IS NULL OR p.death_t > ep.t0) LEFT JOIN hit ON hit.match_id = ep.match_id AND hit.episode = ep.episode AND hit.id = p.id)
    SELECT phase, count(DISTINCT (match_id, episode)) AS episodes, count(*) AS alive, count(*) FILTER (surged) AS surged FROM al GROUP BY phase""",
)
def surge(a: Arena) -> DataFrame:
    """D-09, W-09, W-16."""
    ep, per = D.surge_episodes(a.tables())
    return per.join(ep.select("match_id", "episode", "phase"), ["match_id", "episode"]).groupBy("phase").agg(F.countDistinct("match_id", "episode").alias("episodes"), F.count("*").alias("alive"), F.count_if("surged").alias("surged"))


@registered(
    "detect_alive_by_phase",
    """z AS (SELECT match_id, phase, coalesce(lag(finish_shrink_t) OVER (PARTITION BY match_id ORDER BY phase), 0) AS reveal FROM phases)
    SELECT z.match_id, z.phase, count(*) FILTER (p.death_t IS NULL OR p.death_t > z.reveal) AS alive FROM z JOIN players p ON p.match_id = z.match_id AND NOT p.is_bot GROUP BY ALL""",
)
def alive(a: Arena) -> DataFrame:
    """D-35."""
    return D.alive_by_phase(a.tables())


@registered(
    "detect_lobby_groups",
    """s AS (SELECT quantile_cont(lobby_strength, 2.0 / 3) AS p, count(lobby_strength) / count(*) AS r FROM matches)
    SELECT match_id, CASE WHEN r < 0.5 THEN 'all' WHEN lobby_strength >= p THEN 'strongest third' ELSE 'rest' END AS lobby FROM matches, s""",
)
def lobby(a: Arena) -> DataFrame:
    """D-34."""
    return D.lobby_groups(a.matches)


@registered(
    "detect_spacing",
    """s AS (SELECT m.match_id, m.phase, e.id, e.team_index, m.start_shrink_t AS at_t, e.placement FROM phases m JOIN players e USING (match_id) WHERE NOT e.is_bot AND (e.death_t IS NULL OR e.death_t > m.start_shrink_t)),
    a AS (SELECT s.*, p.x, p.y FROM s ASOF JOIN tracks p ON s.match_id = p.match_id AND s.id = p.id AND s.at_t >= p.t),
    d AS (SELECT *, sqrt(pow(x - avg(x) OVER w, 2) + pow(y - avg(y) OVER w, 2)) / 100 AS d FROM a WINDOW w AS (PARTITION BY match_id, phase, team_index)),
    g AS (SELECT match_id, phase, team_index, avg(d) AS spacing, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1)
    SELECT phase, count(*) AS teams, round(avg(spacing), 4) AS spacing_m FROM g GROUP BY phase""",
)
def spacing(a: Arena) -> DataFrame:
    """D-28."""
    return D.evidence_spacing(a.tables()).groupBy("phase").agg(F.count("*").alias("teams"), r6(F.avg("spacing_m"), "spacing_m", 4))


ROTATIONS_SQL = f"""z AS (SELECT p.*, lag(finish_shrink_t) OVER (PARTITION BY match_id ORDER BY phase) AS reveal_t, sqrt(pow(next_x - cur_x, 2) + pow(next_y - cur_y, 2)) AS pull FROM phases p),
    s AS (SELECT k.id, k.t, k.x, k.y, z.*, {SHARE_OF_MOVE} AS f, sqrt(pow(x - next_x, 2) + pow(y - next_y, 2)) / 100 AS d FROM z JOIN tracks k ON k.match_id = z.match_id AND k.t BETWEEN z.reveal_t AND z.finish_shrink_t WHERE reveal_t IS NOT NULL),
    q AS (SELECT *, {MARGIN} < 0 AS storm, first_value(d) OVER (PARTITION BY match_id, phase, id ORDER BY t) AS d0 FROM s),
    g AS (SELECT match_id, phase, id, count(*) AS n, min(t) AS first_t, max(t) AS last_t, any_value(d0) AS d0, any_value(reveal_t) AS reveal_t, any_value(start_shrink_t) AS start_t, any_value(finish_shrink_t) AS finish_t, any_value(next_r) AS next_r, any_value(cur_r) AS cur_r, any_value(pull) AS pull,
      min(t) FILTER (d <= next_r / 100) AS entry, min(t) FILTER (d <= d0 - greatest(50, 0.25 * (d0 - next_r / 100))) AS depart, count(*) FILTER (storm) AS storm_n FROM q GROUP BY ALL),
    ro AS (SELECT g.*, p.team_index, p.death_t, p.placement AS final, d0 - next_r / 100 AS outside_m, entry - start_t AS arrival, storm_n * least((last_t - first_t) / greatest(n - 1, 1), 5) AS storm_s,
      CASE WHEN pull <= cur_r - next_r + 100 THEN 'Shrinking' WHEN start_t - reveal_t <= 1 THEN 'Moving' WHEN pull >= cur_r + next_r THEN 'Shifted' ELSE '50/50' END AS kind
      FROM g JOIN players p USING (match_id, id) WHERE NOT is_bot AND first_t - reveal_t <= 60 AND d0 - next_r / 100 > 0 AND (death_t IS NULL OR death_t >= start_t)),
    ln AS (SELECT *, count(*) OVER w AS rotators, var_pop(CASE WHEN arrival IS NOT NULL THEN outside_m END) OVER w AS vx, covar_pop(arrival, outside_m) OVER w AS cv, avg(arrival) OVER w AS my, avg(CASE WHEN arrival IS NOT NULL THEN outside_m END) OVER w AS mx, median(arrival) OVER w AS med FROM ro WINDOW w AS (PARTITION BY match_id, phase)),
    re AS (SELECT *, CASE WHEN arrival IS NULL THEN 'infinity'::DOUBLE ELSE arrival - CASE WHEN coalesce(vx, 0) < 1e-12 THEN med ELSE my + cv / vx * (outside_m - mx) END END AS residual FROM ln),
    sh AS (SELECT *, (rank() OVER (PARTITION BY match_id, phase ORDER BY residual) + (count(*) OVER (PARTITION BY match_id, phase, residual) - 1) / 2) / count(*) OVER (PARTITION BY match_id, phase) AS share FROM re),
    rt AS (SELECT *, CASE WHEN rotators >= 6 THEN CASE WHEN share <= 1.0 / 3 THEN 'Ahead' WHEN share <= 2.0 / 3 THEN 'Typical' ELSE 'Behind' END END AS timing FROM sh)"""


@registered("detect_rotations", f"{ROTATIONS_SQL} SELECT phase, kind, timing, count(*) AS n, round(avg(outside_m), 4) AS outside_m, round(avg(storm_s), 4) AS storm_s, round(avg(final), 6) AS final FROM rt GROUP BY ALL")
def rotations(a: Arena) -> DataFrame:
    """D-04, W-05, W-13, W-14."""
    return D.rotations(a.tables()).groupBy("phase", "kind", "timing").agg(F.count("*").alias("n"), r6(F.avg("outside_m"), "outside_m", 4), r6(F.avg("storm_s"), "storm_s", 4), r6(F.avg("final"), "final"))


@registered("detect_surge_rule")
def rule(a: Arena) -> DataFrame:
    """D-10."""
    return D.surge_rule(a.tables())[0]


@registered(
    "detect_team_zones",
    f"""{SURGE_SQL}, {HITS_SQL}, w AS (SELECT *, (reveal + start_shrink_t) / 2 AS mid FROM (SELECT *, lag(finish_shrink_t) OVER v AS reveal, coalesce(lag(finish_shrink_t, 2) OVER v, 0) AS prev FROM phases WINDOW v AS (PARTITION BY match_id ORDER BY phase)) WHERE start_shrink_t - reveal >= 20),
    a0 AS (SELECT w.*, e.id, e.team_index, least(mid, coalesce(death_t - 0.5, mid)) AS t_mid FROM w JOIN players e ON e.match_id = w.match_id AND NOT e.is_bot AND (death_t IS NULL OR death_t > reveal)),
    a1 AS (SELECT a0.*, k.x AS ax, k.y AS ay FROM a0 ASOF JOIN tracks k ON a0.match_id = k.match_id AND a0.id = k.id AND a0.reveal >= k.t), a2 AS (SELECT a1.*, k.x AS bx, k.y AS bty FROM a1 ASOF JOIN tracks k ON a1.match_id = k.match_id AND a1.id = k.id AND a1.t_mid >= k.t),
    g AS (SELECT match_id, phase, team_index, avg(ax) AS ax, avg(ay) AS ay, avg(bx) AS bx, avg(bty) AS bty, any_value(prev) AS prev, any_value(reveal) AS reveal, any_value(finish_shrink_t) AS finish_t, any_value(next_x) AS nx, any_value(next_y) AS ny, any_value(next_r) AS nr FROM a2 GROUP BY ALL),
    h AS (SELECT *, greatest(sqrt(pow(ax - nx, 2) + pow(ay - ny, 2)) / 100 - nr / 100, 0) AS dist, greatest(sqrt(pow(bx - nx, 2) + pow(bty - ny, 2)) / 100 - nr / 100, 0) AS dist_mid, least(nr / nullif(sqrt(pow(ax - nx, 2) + pow(ay - ny, 2)), 0), 1) AS k FROM g),
    lo AS (SELECT h.match_id, h.phase, h.team_index, count(*) AS lookers FROM h JOIN h i ON i.match_id = h.match_id AND i.phase = h.phase AND i.team_index <> h.team_index AND i.dist <= 0
      AND sqrt(pow(h.nx + (h.ax - h.nx) * h.k - i.ax, 2) + pow(h.ny + (h.ay - h.ny) * h.k - i.ay, 2)) / 100 <= 150 GROUP BY ALL),
    nt AS (SELECT match_id, t, ta AS team_index, amount AS v FROM ph UNION ALL SELECT match_id, t, tb, -amount FROM ph),
    st AS (SELECT uz.match_id, uz.t, p.team_index, lost FROM uz JOIN players p ON p.match_id = uz.match_id AND p.id = uz.id AND NOT p.is_bot WHERE {MARGIN} < 0),
    su AS (SELECT h.*, coalesce((SELECT sum(v) FROM nt WHERE nt.match_id = h.match_id AND nt.team_index = h.team_index AND nt.t > prev AND nt.t <= reveal), 0) AS net_prev, coalesce((SELECT sum(v) FROM nt WHERE nt.match_id = h.match_id AND nt.team_index = h.team_index AND nt.t > reveal AND nt.t <= finish_t), 0) AS net,
      coalesce((SELECT sum(lost) FROM st WHERE st.match_id = h.match_id AND st.team_index = h.team_index AND st.t > reveal AND st.t <= finish_t), 0) AS storm FROM h),
    hf AS (SELECT *, net_prev <= median(net_prev) OVER (PARTITION BY match_id, phase) AS low FROM su)
    SELECT phase, CASE WHEN dist_mid <= 0 OR (dist - dist_mid) / dist >= 0.5 THEN 'rotated' WHEN (dist - dist_mid) / dist < 0.2 THEN 'stayed' ELSE 'between' END AS approach, CASE WHEN low THEN 'Bottom half' ELSE 'Top half' END AS surge_half,
      count(*) AS n, round(avg(net), 4) + 0.0 AS net, round(avg(storm), 4) + 0.0 AS storm, CAST(sum(coalesce(lookers, 0)) AS BIGINT) AS lookers FROM hf LEFT JOIN lo USING (match_id, phase, team_index) WHERE dist >= 50 GROUP BY ALL""",
)
def team_zones(a: Arena) -> DataFrame:
    """D-11."""
    z = D.team_zones(a.tables())
    return z.groupBy("phase", "approach", "surge_half").agg(F.count("*").alias("n"), r6(F.avg("net"), "net", 4), r6(F.avg("storm"), "storm", 4), F.sum("lookers").alias("lookers"))


@registered(
    "detect_loot",
    """la AS (SELECT match_id, id, min(t) AS land_t FROM tracks GROUP BY ALL), ev AS (SELECT match_id, id, t - land_t AS since, l_linenumber AS k, l_partkey % 3 AS c FROM raw JOIN la USING (match_id, id) WHERE t - land_t BETWEEN -5 AND 300),
    p AS (SELECT la.match_id, la.id, land_t, min(since) FILTER (k = 3) AS first_chest_s, count(*) FILTER (k = 3) AS chests, count(*) FILTER (k >= 4) AS items, count(*) FILTER (k >= 5) AS weapons, count(*) FILTER (k = 4) AS heals,
      max(CASE WHEN k <= 2 THEN [1, 3, 5][c + 1] END) AS best, count(DISTINCT CASE WHEN k <= 2 AND c < 2 THEN c END) = 2 AS both_ FROM la LEFT JOIN ev USING (match_id, id) GROUP BY ALL)
    SELECT match_id, count(*) AS n, round(avg(first_chest_s), 4) AS first_chest_s, CAST(sum(chests) AS BIGINT) AS chests, CAST(sum(items) AS BIGINT) AS items, CAST(sum(weapons) AS BIGINT) AS weapons, CAST(sum(heals) AS BIGINT) AS heals,
      round(avg(best), 6) AS best_rarity, count(*) FILTER (both_) AS ar_and_shotgun, count(*) FILTER (death_t IS NULL OR death_t > land_t + 300) AS survived FROM p JOIN players USING (match_id, id) GROUP BY match_id""",
)
def loot(a: Arena) -> DataFrame:
    """D-12, G-10, B-17, B-18."""
    d = D.loot_per_player(a.tables(), 300.0)
    return d.groupBy("match_id").agg(
        F.count("*").alias("n"), r6(F.avg("first_chest_s"), "first_chest_s", 4), *(F.sum(c).alias(c) for c in ("chests", "items", "weapons", "heals")), r6(F.avg("best_rarity"), "best_rarity"),
        F.count_if("ar_and_shotgun").alias("ar_and_shotgun"), F.count_if("survived").alias("survived"),
    )


@registered("detect_snapshots")
def snapshots(a: Arena) -> DataFrame:
    """D-15, J-17."""
    return D.snapshots(a.tables(), 60.0)


@registered(
    "detect_damage_causes",
    f"""{SURGE_SQL}, {HITS_SQL}, al AS (SELECT match_id, id, t, {MARGIN} < 0 AS storm, round_even(t, 0) AS sec, t - lag(t) OVER w AS back, lead(t) OVER w - t AS ahead FROM uz WINDOW w AS (PARTITION BY match_id, id ORDER BY t)),
    tg AS (SELECT match_id, sec, count(DISTINCT id) AS n FROM al GROUP BY ALL),
    cs AS (SELECT match_id, CASE WHEN storm THEN 'storm' WHEN coalesce(back BETWEEN 3 AND 7, false) OR coalesce(ahead BETWEEN 3 AND 7, false) OR n >= 3 THEN 'surge' ELSE 'other' END AS cause FROM al JOIN tg USING (match_id, sec) UNION ALL SELECT match_id, 'hit' FROM ph), cn AS (SELECT match_id, cause, count(*) AS n FROM cs GROUP BY ALL)
    SELECT match_id, cause, n, round(n / sum(n) OVER (PARTITION BY match_id), 6) AS share FROM cn""",
)
def causes(a: Arena) -> DataFrame:
    """D-25."""
    return A.value_shares(D.damage_causes(a.tables())[0], ["match_id"], "cause").withColumn("share", F.round("share", 6))


@registered("detect_risks")
def risks(a: Arena) -> DataFrame:
    """D-37."""
    return V.game_risks(a.tables()).select("match_id", "team_index", "final", F.array_join("flags", ",").alias("flags"), "n_flags")


@registered(
    "map_density",
    """c AS (SELECT CAST(floor(x / 5000) AS BIGINT) AS cx, CAST(floor(y / 5000) AS BIGINT) AS cy, count(*) AS n FROM tracks GROUP BY ALL),
    five AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)), gr AS (SELECT DISTINCT cx + i AS cx, cy + j AS cy FROM c, five),
    er AS (SELECT cx, cy FROM (SELECT cx + i AS cx, cy + j AS cy FROM gr, five) GROUP BY ALL HAVING count(*) = 25), ma AS (SELECT cx, cy FROM er UNION SELECT cx, cy FROM c),
    ke AS (SELECT i, exp(-0.5 * pow(i / 3.0, 2)) AS w FROM (SELECT unnest(range(-9, 10)) AS i)), kn AS (SELECT i, w / (SELECT sum(w) FROM ke) AS w FROM ke),
    bl AS (SELECT cx + a.i AS cx, cy + b.i AS cy, sum(n * a.w * b.w) AS n FROM c, kn a, kn b GROUP BY ALL)
    SELECT ma.cx, ma.cy, c.n IS NOT NULL AS known, round(ln(bl.n / (SELECT sum(n) FROM c) + 1e-7), 6) AS log_density FROM ma LEFT JOIN c USING (cx, cy) LEFT JOIN bl USING (cx, cy)""",
)
def density(a: Arena) -> DataFrame:
    """D-19, D-20: a closed land mask, and the blurred log density of samples on it."""
    cells = grid_density(a.tracks, 50.0, 1)
    return land_map(cells).join(blurred_density(cells, 3.0, 9), ["cx", "cy"], "left").withColumn("log_density", F.round("log_density", 6))


#: Fewer rounds than the operator's 250 for three queries of trees (told in the README); folds are its own six.
SHORT = B.Growth(rounds=12, rate=0.3, depth=4)


@registered("model_expected_points")
def points(a: Arena) -> DataFrame:
    """M-01, ST-15: boosted trees out of fold, held against the clock-and-skill baseline."""
    snaps = written(D.snapshots(a.tables(), 60.0), "snapshots")
    return M.expected_points(snaps, growth=SHORT)[1]


@registered("model_action_prices")
def prices(a: Arena) -> DataFrame:
    """M-03, M-10: what each action is worth in each situation."""
    snaps = written(M.known_skill(D.snapshots(a.tables(), 60.0)), "snapshots")
    model = B.fit(snaps, M.EXPECTED_POINTS_FEATURES, "future_pts", M.SIGNS)
    return M.priced_actions(model, snaps).groupBy("best").agg(F.count("*").alias("n"), F.avg("stake").alias("stake"))


@registered("model_sign_breaches")
def breaches(a: Arena) -> DataFrame:
    """M-01: for each feature with a sign, the rows where a step in it moves the prediction the wrong way: none may."""
    snaps = written(M.known_skill(D.snapshots(a.tables(), 60.0)), "snapshots")
    model = B.fit(snaps, M.EXPECTED_POINTS_FEATURES, "future_pts", M.SIGNS, SHORT)
    return M.sign_breaches(model, snaps)


@registered(
    "model_fight_odds",
    f"""{HITS_SQL}, n AS (SELECT *, least(ta, tb) AS a, greatest(ta, tb) AS b, t - lag(t) OVER (PARTITION BY match_id, least(ta, tb), greatest(ta, tb) ORDER BY t) AS since FROM ph),
    s AS (SELECT *, sum(CASE WHEN since > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, a, b ORDER BY t) AS fight FROM n),
    f AS (SELECT match_id, a, b, fight, min(t) AS t0, max(t) AS t1, arg_min(ta, (t, attacker_id, target_id)) AS first FROM s GROUP BY ALL),
    d AS (SELECT match_id, team_index, death_t FROM players WHERE NOT is_bot AND death_t IS NOT NULL),
    w AS (SELECT f.*, EXISTS (SELECT 1 FROM d WHERE d.match_id = f.match_id AND d.team_index = f.a AND d.death_t BETWEEN t0 AND t1 + 5) AS la,
      EXISTS (SELECT 1 FROM d WHERE d.match_id = f.match_id AND d.team_index = f.b AND d.death_t BETWEEN t0 AND t1 + 5) AS lb FROM f),
    pr AS (SELECT w.match_id, a, b, fight, p.team_index, p.id, t0 - 1 AS at_t FROM w JOIN players p ON p.match_id = w.match_id AND (p.team_index = a OR p.team_index = b) AND NOT p.is_bot WHERE la <> lb),
    hp AS (SELECT pr.match_id, a, b, fight, avg(health + shield) FILTER (team_index = a) AS ha, avg(health + shield) FILTER (team_index = b) AS hb FROM pr ASOF JOIN changes c ON pr.match_id = c.match_id AND pr.id = c.id AND pr.at_t >= c.t GROUP BY ALL),
    o AS (SELECT CASE WHEN first = w.a THEN ha ELSE hb END AS own, (CASE WHEN la THEN w.b ELSE w.a END) = first AS won FROM w LEFT JOIN hp USING (match_id, a, b, fight) WHERE la <> lb)
    SELECT CASE WHEN own > 175 THEN 'full' WHEN own > 125 THEN 'high' WHEN own > 75 THEN 'mid' WHEN own > 0 THEN 'low' END AS health, count(*) AS n, round(avg(CASE WHEN won THEN 1.0 ELSE 0 END), 6) AS won FROM o GROUP BY 1""",
)
def odds(a: Arena) -> DataFrame:
    """M-05."""
    return M.fight_odds(D.fights(a.tables())).withColumn("won", F.round("won", 6))


@registered("model_zone_forecast")
def forecast(a: Arena) -> DataFrame:
    """M-06, M-07, M-08: where the next circle falls, judged out of fold."""
    return M.forecast(D.pulls(a.tables()), n=30, k=2)


#: Fewer rounds than the studies' own.
STUDY_PARAMS = {"expected_points": {"growth": SHORT}}
#: Studies whose query returns every row of every frame.
WHOLE = ("expected_points",)


def all_frames(found: dict[str, DataFrame]) -> DataFrame:
    """(frame, row): all rows of all frames of a study, each as JSON."""
    out = None
    for name, df in found.items():
        one = df.select(F.lit(name).alias("frame"), F.to_json(F.struct("*")).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def _study(name: str):
    def run(a: Arena) -> DataFrame:
        t = a.tables()
        context = K.Context(t)
        if K.STUDIES[name].needs_compare:
            sides = (L.Filters(seasons=("v30", "v31")), L.Filters(seasons=("v31", "v32")))
            context = K.Context(t.chosen(L.select(a.matches, sides[0])), {"rounds": 200}, t.chosen(L.select(a.matches, sides[1])))
        context.params = STUDY_PARAMS.get(name, {}) | context.params
        found = K.run_study(name, context)
        if name in WHOLE:
            return all_frames(found)
        if "tests" in found:
            return found["tests"]
        return found.get("metrics") or next(iter(found.values()))

    run.__doc__ = f"The study {name}."
    return run


#: SQL of the studies whose result has no p-values.
STUDY_SQL = {
    "overview": """m AS (SELECT count(*) AS a, count(DISTINCT season) AS b, count(DISTINCT region) AS c, avg(CASE WHEN is_server_replay THEN 1.0 ELSE 0 END) AS d, median(lobby_strength) AS e FROM matches), p AS (SELECT avg(n) AS f FROM (SELECT match_id, max(phase) AS n FROM phases GROUP BY ALL))
    SELECT unnest(['matches', 'seasons', 'regions', 'server', 'strength', 'phases']) AS label, unnest([CAST(a AS DOUBLE), b, c, d, e, f]) AS value FROM m, p""",
    "match_map": "SELECT match_id, id, t, x, y FROM (SELECT *, row_number() OVER (PARTITION BY match_id, id ORDER BY t) - 1 AS n FROM tracks) WHERE n % 4 = 0",
}

for _name in K.STUDIES:
    if _name != "eliminations":  # registered with its SQL among the operators
        _sql = STUDY_SQL.get(_name)
        registered(f"study_{_name}")(_study(_name))
        if _sql:
            ORACLES[f"study_{_name}"] = f"WITH {ARENA_SQL}{' ' if _sql.startswith('SELECT') else ', '}{_sql}"


@registered("findings_sheet")
def sheet(a: Arena) -> DataFrame:
    """S-15: every study of one selection in one long sheet."""
    return K.findings(K.Context(a.tables()))


@registered("conclusion")
def concluded(a: Arena) -> DataFrame:
    """ST-16."""
    found = K.run_study("zone_randomness", K.Context(a.tables()))
    return T.conclusion(found["tests"], a.matches)

"""Queries of the circle forecasts; the features have SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import circles as C
from tidemark.plans import detect as D
from tidemark.plans import spots as P
from tidemark.plans.operator_queries import r6
from tidemark.plans.spot_queries import LAND_SQL
from tidemark.sources.arena import ARENA_SQL, Arena

QUERIES, ORACLES = {}, {}
NAMES = ("edge", "edge2", *C.HISTORY, "inward", "centre", "on_land", "land", "height")


def registered(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Arena(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {ARENA_SQL}, {sql}"
        return f

    return add


def _cos_sql(ax: str, ay: str, bx: str, by: str) -> str:
    length = f"(sqrt(({ax}) * ({ax}) + ({ay}) * ({ay})) * sqrt(({bx}) * ({bx}) + ({by}) * ({by})))"
    return f"coalesce(CASE WHEN {length} = 0 THEN NULL ELSE (({ax}) * ({bx}) + ({ay}) * ({by})) / {length} END, 0)"


@registered(
    "circle_features",
    f"""{LAND_SQL}, five AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)), gw AS (SELECT DISTINCT cx + i AS cx, cy + j AS cy FROM ld, five),
    er AS (SELECT cx, cy FROM (SELECT cx + i AS cx, cy + j AS cy FROM gw, five) GROUP BY ALL HAVING count(*) = 25), ma AS (SELECT cx, cy FROM er UNION SELECT cx, cy FROM ld), ce AS (SELECT ma.cx, ma.cy, ground FROM ma LEFT JOIN ld USING (cx, cy)),
    mi AS (SELECT (avg(cx) + 0.5) * 2500 AS mx, (avg(cy) + 0.5) * 2500 AS my FROM ma),
    hi AS (SELECT match_id, phase, CASE WHEN phase <= 5 THEN 'shrinking' ELSE 'moving' END AS kind, next_x, next_y, next_r, row_number() OVER w - 1 AS k, lag(next_x) OVER w AS cx, lag(next_y) OVER w AS cy, lag(next_r) OVER w AS cr,
      lag(next_x, 2) OVER w AS c2x, lag(next_y, 2) OVER w AS c2y, lag(next_x, 3) OVER w AS c3x, lag(next_y, 3) OVER w AS c3y, first_value(next_x) OVER w AS fx, first_value(next_y) OVER w AS fy FROM phases WINDOW w AS (PARTITION BY match_id ORDER BY phase)),
    ca AS (SELECT *, unnest(range(0, CASE WHEN kind = 'shrinking' THEN 25 ELSE 13 END)) AS alt FROM hi WHERE k >= 1),
    po AS (SELECT *, CASE WHEN alt = 0 THEN next_x ELSE cx + CASE WHEN kind = 'shrinking' THEN greatest(cr - next_r, 1) * sqrt((alt - 0.5) / 24) * cos((alt - 0.5) * {C.GOLDEN!r}) ELSE sqrt(pow(next_x - cx, 2) + pow(next_y - cy, 2)) * cos((alt - 0.5) * 2 * pi() / 12) END END AS px,
      CASE WHEN alt = 0 THEN next_y ELSE cy + CASE WHEN kind = 'shrinking' THEN greatest(cr - next_r, 1) * sqrt((alt - 0.5) / 24) * sin((alt - 0.5) * {C.GOLDEN!r}) ELSE sqrt(pow(next_x - cx, 2) + pow(next_y - cy, 2)) * sin((alt - 0.5) * 2 * pi() / 12) END END AS py FROM ca),
    rw AS (SELECT match_id, phase, alt, px, py, next_r, unnest(range(CAST(floor((py - next_r) / 2500) AS BIGINT), CAST(floor((py + next_r) / 2500) AS BIGINT) + 1)) AS row FROM po),
    sp AS (SELECT match_id, phase, alt, row, floor((px - sqrt(next_r * next_r - pow((row + 0.5) * 2500 - py, 2))) / 2500) AS a, floor((px + sqrt(next_r * next_r - pow((row + 0.5) * 2500 - py, 2))) / 2500) AS b FROM rw WHERE abs((row + 0.5) * 2500 - py) <= next_r),
    al AS (SELECT match_id, phase, alt, sum(b + 1 - a) AS cells FROM sp GROUP BY ALL),
    dk AS (SELECT match_id, phase, alt, count(*) AS land, avg(ground) / 1000 AS high FROM sp JOIN ce ON ce.cy = sp.row AND ce.cx BETWEEN a AND b GROUP BY ALL),
    fe AS (SELECT po.*, px - po.cx AS vx, py - po.cy AS vy, mx - po.cx AS tx, my - po.cy AS ty, coalesce(dk.land, 0) / cells AS land, high, CASE WHEN ma.cx IS NULL THEN 0 ELSE 1 END AS on_land,
      CASE WHEN kind = 'shrinking' THEN least(sqrt(pow(px - po.cx, 2) + pow(py - po.cy, 2)) / greatest(cr - next_r, 1), 1.5) ELSE 0 END AS edge, mx, my
      FROM po JOIN al USING (match_id, phase, alt) LEFT JOIN dk USING (match_id, phase, alt) LEFT JOIN ma ON ma.cx = floor(px / 2500) AND ma.cy = floor(py / 2500), mi),
    ff AS (SELECT phase, alt, edge, edge * edge AS edge2, {_cos_sql("vx", "vy", "cx - c2x", "cy - c2y")} AS turn1, {_cos_sql("vx", "vy", "c2x - c3x", "c2y - c3y")} AS turn2, CASE WHEN k >= 2 THEN {_cos_sql("vx", "vy", "cx - fx", "cy - fy")} ELSE 0 END AS drift,
      (sqrt(pow(px - fx, 2) + pow(py - fy, 2)) - sqrt(pow(fx - cx, 2) + pow(fy - cy, 2))) / greatest(cr, 1) AS home, {_cos_sql("vx", "vy", "tx", "ty")} AS inward, (sqrt(pow(px - mx, 2) + pow(py - my, 2)) - sqrt(tx * tx + ty * ty)) / greatest(cr, 1) AS centre,
      on_land, land, coalesce(high - avg(high) FILTER (alt > 0) OVER (PARTITION BY match_id, phase), 0) AS height FROM fe)
    SELECT phase, alt > 0 AS candidate, count(*) AS n, {", ".join(f"round(avg({'turn1 * turn1' if n == 'turn1sq' else n}), 6) + 0.0 AS {n}" for n in NAMES)} FROM ff GROUP BY ALL""",
)
def features(a: Arena) -> DataFrame:
    """M-06: features of the truths and of evenly spread candidates, mean by phase."""
    pulls = a.phases.withColumn("kind", F.when(F.col("phase") <= 5, "shrinking").otherwise("moving"))
    land = C.raster(P.ground(a.tables()))
    f = C.features(C.candidates(C.with_donors(C.histories(pulls)), 24, 12), land)
    return f.groupBy("phase", (F.col("alt") > 0).alias("candidate")).agg(F.count("*").alias("n"), *(F.avg(n).alias(n) for n in NAMES)).select("phase", "candidate", "n", *(r6(n, n) for n in NAMES))


def _inputs(a: Arena) -> tuple:
    t = a.tables()
    return D.pulls(t), t.matches, C.raster(P.ground(t))


@registered("zone_ladder")
def ladder(a: Arena) -> DataFrame:
    """M-08: every rung and the shuffled control, out of fold and on the newest matches, with all candidates and folds."""
    return C.ladder_table(C.ladder(*_inputs(a)))


@registered("endgame_forecast")
def endgame(a: Arena) -> DataFrame:
    """M-09: the last centre forecast from each phase, and how far the best guess is off."""
    e = C.endgame(*_inputs(a))
    return e.groupBy("rung", "phase").agg(F.count("*").alias("n"), F.avg("beaten").alias("beaten"), F.avg(F.col("top_quarter").cast("double")).alias("top_quarter"), F.avg("bits").alias("bits"), F.median("error_m").alias("error_m"))

"""Team moves on rows made by hand, and operators whose work must not grow faster than their rows."""

import time

from pyspark.sql import functions as F

from tidemark.functions import stats as T
from tidemark.operators.asof import asof_join
from tidemark.operators.interval import interval_join, window_sums
from tidemark.plans import moves as V


def test_points_within_and_score_bands(spark):
    p = spark.createDataFrame([(1, "a", 0.0, 0.0), (1, "b", 9_900.0, 0.0), (2, "a", 0.0, 0.0), (1, "c", None, 0.0)], "g int, k string, x double, y double")
    o = spark.createDataFrame([(1, 7, 5_000.0, 0.0), (1, 8, 20_000.0, 0.0), (2, 9, 0.0, 100_000.0)], "g int, v int, ox double, oy double")
    assert sorted((r.k, r.v, r.dist_m) for r in V.points_within(p, o, ["g"], 60.0).collect()) == [("a", 7, 50.0), ("b", 7, 49.0)]
    s = spark.createDataFrame([(1, k, float(k)) for k in range(8)] + [(2, 0, 1.0)], "g int, k int, s double")
    bands = {(r.g, r.k): r.band for r in V.score_bands(s, ["g"], "s", "k").collect()}
    assert [bands[1, k] for k in (7, 6, 5, 4, 3, 0)] == ["top quarter"] * 2 + ["next quarter"] * 2 + ["rest"] * 2 and bands[2, 0] == "top quarter"


def test_crowd_leaves_the_own_game_out(spark):
    a = spark.createDataFrame([(1, 1, "s", "hold"), (1, 1, "s", "hold"), (2, 1, "s", "rotate"), (3, 2, "s", "hold"), (4, 2, "z", "hold")], "match_id int, team_index int, situation string, action string")
    got = {(r.match_id, r.action): (r.others, r.share) for r in V.crowd(a, ["situation"]).where("situation = 's'").collect()}
    assert got == {(1, "hold"): (2, 0.5), (1, "rotate"): (2, 0.5), (2, "hold"): (3, 1.0), (2, "rotate"): (3, 0.0), (3, "hold"): (3, 2 / 3), (3, "rotate"): (3, 1 / 3)}


def test_habits_and_regulars(spark):
    rows = [("r", i, i % 2, bool(m % 2), (0.2 if m % 2 else 0.6) + 0.01 * i) for i in range(6) for m in range(4)]
    h = {r.team_index: r for r in V.habits(spark.createDataFrame(rows, "rule string, id int, team_index int, followed boolean, ahead double")).collect()}
    assert h[0].backed and abs(h[0].gain - 40) < 1e-6 and h[0].broke == 0.5 and abs(h[0].priority - 20) < 1e-6
    land = [(m, 1, 1, "P", m == 0) for m in range(4)] + [(m, 2, 2, "P", True) for m in range(3)] + [(9, 2, 2, "P", False), (1, 3, 3, "Q", False)]
    land = spark.createDataFrame(land, "match_id int, id int, team_index int, poi string, off_spawn boolean").withColumns({"land_x": F.lit(0.0), "land_y": F.lit(0.0)})
    spots = V.usual_spots(land, ["team_index"])
    got = [tuple(r) for r in V.regulars(land, spots.where("team_index = 1")).collect()]
    assert got == [(1, "P", 2, 4, 3, 1, 3, 1)]


def test_top_teams_step_the_minimum_down(spark):
    g = spark.createDataFrame([(t, float(t)) for t in range(12) for _ in range(1 + t % 3)], "team int, points double")
    rows = V.top_teams(g, "team", (3, 2, 1), least_teams=6).collect()
    assert {r.minimum for r in rows} == {2} and len(rows) == 8 and sorted(r.team for r in rows if r.top) == [8, 10, 11]


def test_windows_keep_pace_with_their_rows(spark):
    """One hot key: a frame that grows to the end, or all pairs of a key, would take minutes."""
    n = 60_000
    left = spark.range(n).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("t"), "id")
    right = left.select("k", (F.col("t") + 0.5).alias("r_t"), F.lit(1.0).alias("v"))
    began = time.perf_counter()
    ahead = asof_join(left, right, ["k"], ["v"], right_time="r_t", how="left", direction="forward", tolerance=0.6)
    assert ahead.where("v = 1").count() == n
    sums = window_sums(left, right, ["k"], {"s": (F.col("t") - 10, F.col("t"))}, "v", ["id"])
    assert sums.where("s = 10").count() == n - 10 and sums.agg(F.sum("s")).first()[0] == 10 * (n - 10) + 45
    assert interval_join(left, right, ["k"], 0.4, 0.4, how="left_anti").count() == n
    assert interval_join(left, right, ["k"], 0.0, 0.5, how="left_semi").count() == n
    assert time.perf_counter() - began < 90


def test_fold_sizes_differ_by_one_at_most(spark):
    rows = spark.range(1003).select((F.col("id") % 501).alias("unit"))
    sizes = [r["count"] for r in T.folds(rows, "unit", 4).select("unit", "fold").distinct().groupBy("fold").count().collect()]
    assert sum(sizes) == 501 and max(sizes) - min(sizes) <= 1 and len(sizes) == 4

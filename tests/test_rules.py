"""Rules, scores, behaviours and the forecast's chance of a spot: planted effects, and brute force on small rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.plans import circles as C
from tidemark.plans import detect as D
from tidemark.plans import rules as U


def small_tables(spark, **more):
    """One match of four players in two teams and ten zones on one spot; player 9 is a bot."""
    players = [("m", i, i // 2, 4 - i, 10.0 + 100 * i if i < 3 else None, 100.0, i == 9, 0) for i in (0, 1, 2, 3)] + [("m", 9, 4, 5, None, None, True, 0)]
    zones = [("m", k, 0.0, 0.0, 10_000.0 - 500 * k, 0.0, 0.0, 9_500.0 - 500 * k, 100.0 * k, 100.0 * k + 50) for k in range(1, 11)]
    places = [("m", i, float(t), 1000.0 * i * i, 0.0, 100.0 * i) for i in (0, 1, 2, 3, 9) for t in range(0, 1100, 50)]
    make = spark.createDataFrame
    kills = make([("m", 0, 3, 10.0, False), ("m", 1, 3, 110.0, False), ("m", 2, 3, 900.0, True)], "match_id string, victim_id int, finisher_id int, t double, downed boolean")
    none = make([], "match_id string, id int, t double, health double, shield double")
    hits = make([], "match_id string, t double, attacker_id int, target_id int, amount double")
    given = {
        "matches": make([("m", "2024-01-01")], "match_id string, match_date string"),
        "players": make(players, "match_id string, id int, team_index int, placement int, death_t double, pr_rank double, is_bot boolean, kills int"),
        "zones": make(zones, "match_id string, phase int, cur_x double, cur_y double, cur_r double, next_x double, next_y double, next_r double, start_shrink_t double, finish_shrink_t double"),
        "positions": make(places, "match_id string, id int, t double, x double, y double, z double"),
        "kills": kills, "health": none, "damage": hits,
        "landings": make([("m", 0, 0, 0.0, 0.0, 0, None), ("m", 1, 0, 0.0, 0.0, 2, True), ("m", 2, 1, 20_000.0, 0.0, None, False), ("m", 3, 1, 24_000.0, 0.0, 0, False)], "match_id string, id int, team_index int, land_x double, land_y double, opp_150m int, off_spawn boolean"),
    }
    return D.Tables(**{**given, **more})


def test_rules_are_judged_at_their_moment(spark):
    t = small_tables(spark)
    rotations = spark.createDataFrame([("m", i, p, timing, 4 - i) for p in (3, 6, 9) for i, timing in ((1, "Behind"), (2, "Ahead"), (3, None))], "match_id string, id int, phase int, timing string, final int")
    inside = spark.createDataFrame([("m", 2, 1, 0.81), ("m", 2, 2, 0.79), ("m", 2, 3, None), ("m", 5, 3, 1.0)], "match_id string, phase int, id int, p_in double")
    got = U.applications(t, rotations, D.team_snapshots(t), inside).toPandas()
    rows = {(r.rule, r.zone, r.id): (r.followed, round(r.ahead, 4)) for r in got.itertuples()}
    assert {k[2]: v for k, v in rows.items() if k[0] == "drop"} == {0: (True, 1.0), 1: (False, 0.75), 2: (False, 0.5), 3: (True, 0.25)}
    # player 1 dies at 110, before zone 2 appears at 150; player 3's chance is unknown
    assert {k: v for k, v in rows.items() if k[0] == "early_zone"} == {("early_zone", 2, 2): (False, 1.0)}
    # only player 3 is left; (9000 cm from the centre, the circle's half is 3750 and less)
    assert {k: v for k, v in rows.items() if k[0] == "centre"} == {("centre", z, 3): (False, 1.0) for z in range(5, 12)}
    assert {k[1:]: v for k, v in rows.items() if k[0] == "rotation_early"} == {(3, 1): (False, 1.0), (3, 2): (True, 0.5)}
    assert {k[1:]: v for k, v in rows.items() if k[0] == "rotation_late"} == {(6, 1): (False, 1.0), (6, 2): (True, 0.5)}
    # the living team alone is not its own lowest third; both members have its rank
    assert {k[1:]: v for k, v in rows.items() if k[0] == "height"} == {(z, i): (True, 1.0) for z in range(6, 11) for i in (2, 3)}
    late = U.rule_scores(t, U.applications(t, rotations, D.team_snapshots(t)), *U.SCORES["late game"]).collect()
    assert [(r.id, r.n, round(r.share, 6), r.ahead) for r in late] == [(3, 12, round(5 / 12, 6), 1.0)]
    assert U.applications(small_tables(spark, zones=t.zones.where("false"), positions=t.positions.where("false"), landings=None), rotations.where("false"), D.team_snapshots(t).where("false"), inside).count() == 0


def test_behaviours_of_a_team_game(spark):
    t = small_tables(spark)
    land = {r.team_index: (r.contested, r.off_spawn) for r in U.landing_habits(t).collect()}
    assert land == {0: (1.0, 1.0), 1: (1.0, 0.0)}  # 220 m apart
    e = {r.team_index: (r.elims_early, r.elims_late) for r in U.elimination_habits(t).collect()}
    # team 0 is out at 110 s; team 1 has two until 350 s, the third was only downed, and lives from 550 to 1050
    assert e[0] == (0.0, None) and abs(e[1][0] - 2 / (350 / 60)) < 1e-9 and e[1][1] == 0.0
    z = spark.createDataFrame([("m", 1, 2, "stayed", 5.0), ("m", 1, 3, "rotated", 0.0), ("m", 1, 4, "between", 9.0), ("m", 1, 6, "stayed", 9.0)], "match_id string, team_index int, phase int, approach string, storm double")
    r = U.zone_habits(z).first()
    assert (r.stayed_13, r.stayed_45, r.in_storm) == (0.5, None, 0.5)
    rot = spark.createDataFrame([("m", 0, 3, 10.0), ("m", 1, 3, 20.0), ("m", 2, 3, 90.0), ("m", 0, 7, 5.0), ("m", 0, 4, None)], "match_id string, team_index int, phase int, depart_s double")
    assert {r.team_index: r.rot_vs_field for r in U.timing_habits(rot).collect()} == {0: -10.0, 1: 0.0, 2: 70.0}
    per = spark.createDataFrame([("m", 0, 1, True), ("m", 0, 1, False), ("m", 0, 2, False), ("m", 1, 2, False)], "match_id string, team_index int, episode int, surged boolean")
    assert {r.team_index: r.surged for r in U.surge_habits(per).collect()} == {0: 0.5, 1: 0.0}


def test_the_same_team_with_and_without(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"match_id": np.arange(400), "team": np.arange(400) % 20, "contested": rng.integers(0, 2, 400).astype(float), "height": rng.uniform(0, 1, 400)})
    d["points"] = 10 * d["contested"] + d["team"]  # a planted effect, each team with its own level
    long = spark.createDataFrame(d.melt(["match_id", "team", "points"], ["contested", "height"], "behaviour", "value"))
    got = {(r.behaviour, r.team): r.gap for r in U.same_team(long).collect()}
    assert {round(v, 9) for k, v in got.items() if k[0] == "contested"} == {10.0}
    for team, g in d.groupby("team"):
        hi = g["height"] > g["height"].median()
        assert abs(got["height", team] - (g.loc[hi, "points"].mean() - g.loc[~hi, "points"].mean())) < 1e-9
    assert U.same_team(long.where("match_id < 60")).count() == 0  # three games each
    words = spark.createDataFrame([(0.01, 0.01, 9, 1.0, 2.0, 0.4), (0.01, 0.01, 9, 1.0, -2.0, 0.4), (0.01, None, None, -1.0, None, 0.4), (None, 0.01, 9, None, 2.0, 0.4), (None, 0.01, 9, None, -2.0, 0.6), (0.2, 0.01, 4, 1.0, 2.0, 0.4)], "a double, b double, n int, c double, d double, e double")
    say = words.select(U.verdict(F.col("a"), F.col("b"), F.col("n"), F.col("c"), F.col("d"), F.col("e"), F.lit(True)).alias("v"))
    assert [r.v for r in say.collect()] == ["copy this: do more", "mixed", "top teams' habit: less", "underused", "overused", "no clear difference"]


def test_chance_of_a_spot_by_brute_force(spark):
    rng = np.random.default_rng(5)
    names, folds = ["edge", "inward"], 2
    models = C.models_of({"one_step": ("edge", "inward")}, names, folds)
    weights = {(i, k): rng.normal(size=2) for i in range(len(models)) for k in ("shrinking", "moving")}
    scale, rows, want = np.array([np.zeros(4 + 1), np.ones(4 + 1)]), [], {}
    spots = []
    for m in range(6):
        x, at, fold, kind = rng.normal(size=(31, 5)), rng.uniform(-1000, 1000, (31, 2)), m % 2, ("shrinking", "moving")[m % 3 == 0]
        rows.append((m, 2, kind, fold, 1, 31, x.ravel().tolist(), at.ravel().tolist()))
        i = next(k for k, mo in enumerate(models) if mo.fold == fold)
        u = x[1:, :2] @ weights[i, kind]
        p = np.exp(u) / np.exp(u).sum()
        for who in range(4):
            sx, sy = rng.uniform(-1000, 1000, 2)
            spots.append((m, 2, who, float(sx), float(sy), 600.0))
            want[m, who] = p[np.hypot(at[1:, 0] - sx, at[1:, 1] - sy) <= 600].sum()
    spots.append((0, 2, 9, None, None, 600.0))
    spots.append((0, 3, 1, 0.0, 0.0, 600.0))  # no state
    states = spark.createDataFrame(rows, "match_id long, phase int, kind string, fold int, old int, n int, x array<double>, at array<double>")
    fitted = C.Fitted(states, models, scale, weights, folds)
    got = {(r.match_id, r.id): r.p_in for r in fitted.inside("one_step", spark.createDataFrame(spots, "match_id long, phase int, id int, x double, y double, next_r double")).collect()}
    assert got.pop((0, 9)) is None and set(got) == set(want)
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())

"""Boosted trees, spots, circle forecasts and ranks of one hot group: planted effects, and brute force on small rows."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import boosting as B
from tidemark.functions import stats as T
from tidemark.plans import circles as C
from tidemark.plans import models as M
from tidemark.plans import spots as P


def test_trees_find_the_rule_and_keep_their_signs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = 2 * x[:, 0] - np.abs(x[:, 1]) + rng.normal(size=4000) * 0.3
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(5)
    df = df.withColumn("a", F.when(F.col("c") < 2.5, F.col("a")))  # some unknown
    model = B.fit(df, ["a", "b", "c"], "y", {"a": 1, "b": -1}, B.Growth(rounds=8, rate=0.4, depth=4))
    assert 1 - ((y - model.score(x)) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.75
    for f, sign in ((0, 1), (1, -1)):
        steps = []
        for q in np.linspace(-3, 3, 41):
            moved = x[:300].copy()
            moved[:, f] = q
            steps.append(model.score(moved))
        assert (np.diff(steps, axis=0) * sign >= -1e-9).all()
    got = df.select(model.column().alias("p"), "a", "b", "c").toPandas()
    assert np.allclose(got["p"], model.score(got[["a", "b", "c"]].to_numpy(float)))


def test_cross_fit_and_effects_of_a_linear_target(spark):
    rng = np.random.default_rng(1)
    n = 6000
    d = pd.DataFrame({f: rng.uniform(0, 1, n) for f in M.EXPECTED_POINTS_FEATURES})
    d["hp"], d["members"], d["match_id"] = rng.uniform(0, 200, n), rng.integers(1, 3, n), np.arange(n) % 12
    d["future_pts"] = 0.1 * d["hp"] + 6.0 * d["members"]
    snaps = spark.createDataFrame(d).repartition(4)
    growth = B.Growth(rounds=12, rate=0.5, depth=4)
    model, judged, parts = M.expected_points_model(snaps, k=2, growth=growth)
    r = M.model_check(judged).first()
    assert r.n == n and r.r2 > 0.97 and r.r2_over_baseline > 0.97 and len(parts) == 2
    e = {r.label: r.points for r in M.marginal_effects(model, snaps.where("hp < 150"), M.endgame_effects()).collect()}
    assert abs(e["+50 health and shield"] - 5) < 0.25 and abs(e["teammate alive"] - 6) < 0.3 and abs(e["high ground"]) < 0.1
    assert {r.breaches for r in M.sign_breaches(model, snaps).collect()} == {0}
    one = {f: 0.5 for f in M.EXPECTED_POINTS_FEATURES} | {"hp": 50.0, "members": 2.0, "kills": 1.0}
    got = {r.label: r for r in M.swap_drivers(model, spark, one, one | {"hp": 150.0, "kills": 2.0}).collect()}
    assert set(got) == {"total", "hp", "kills"} and abs(got["hp"].points - 10) < 1 and abs(got["total"].points - 14) < 1.5


def test_spots_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    s = [(1, 2, k, *rng.uniform(-9000, 9000, 2).tolist(), float(rng.choice([0, 2000]))) for k in range(40)]
    e = [(1, 2, int(rng.integers(0, 3)), *rng.uniform(-12000, 12000, 2).tolist(), float(rng.choice([0, 500])), bool(rng.random() < 0.7), bool(rng.random() < 0.5)) for _ in range(300)]
    spots = spark.createDataFrame([(*r, 100.0, -50.0) for r in s], "match_id long, phase long, spot long, x double, y double, z double, zx double, zy double")
    samples = spark.createDataFrame(e, "match_id long, phase long, team_index long, x double, y double, z double, rotating boolean, dangerous boolean")
    want = {}
    for _, _, k, x, y, z in s:
        for _, _, team, a, b, c, rotating, dangerous in e:
            d, ox, oy = math.hypot(a - x, b - y) / 100, x - 100, y + 50
            facing = ((a - x) * ox + (b - y) * oy) / (d * 100 * math.hypot(ox, oy) + 1e-9) > 0.3
            tag = (1 + (z - c >= 1500)) if rotating and facing and 20 <= d <= 90 else 0
            t = want.setdefault((k, team), [0, 0])
            t[0], t[1] = t[0] + tag, t[1] + (dangerous and d < 30)
    got = {(r.spot, r.team_index): [r.tag, r.danger] for r in P.spot_counts(spots, samples, 20.0, 90.0).collect()}
    assert got == {k: v for k, v in want.items() if any(v)} and len(got) > 50
    assert P.spot_counts(spots, samples.limit(0), 20.0, 90.0).count() == 0


def test_spots_on_a_grid_as_by_their_cells(spark):
    rng = np.random.default_rng(8)
    zone = spark.createDataFrame([(1, 2, 500.0, -300.0, 9000.0), (1, 3, 0.0, 0.0, 0.0), (2, 2, -40000.0, 0.0, 30000.0)], "match_id long, phase long, zx double, zy double, zr double")
    e = [(int(rng.integers(1, 3)), int(rng.integers(2, 4)), int(rng.integers(0, 4)) if k % 9 else None, *rng.uniform(-50000 if k % 2 else -12000, 12000, 2).tolist(), float(rng.choice([0, 500])), bool(rng.random() < 0.7), bool(rng.random() < 0.5)) for k in range(600)]
    samples = spark.createDataFrame([*e, (1, 2, 1, None, 0.0, 0.0, True, True)], "match_id long, phase long, team_index long, x double, y double, z double, rotating boolean, dangerous boolean")
    spots = P.grid_spots(zone, 11, 0.9).withColumn("z", (F.col("spot") % 3 * 1000).cast("double"))
    rows = lambda df: sorted(map(str, df.select("match_id", "phase", "spot", "team_index", "tag", "danger").collect()))
    want = rows(P.spot_counts(spots, samples, 20.0, 90.0))
    assert rows(P.grid_counts(zone, spots, samples, 20.0, 90.0, 11, 0.9)) == want and len(want) > 100
    joins = P.without_own(spots, P.spot_counts(spots, samples, 20.0, 90.0), spark.createDataFrame([(1, 2, 0), (1, 2, 3)], "match_id long, phase long, team_index long"))
    own = {(r.spot, r.team_index): r.tag for r in joins.collect()}
    seen = {(r.spot, r.team_index): r.tag for r in P.spot_counts(spots, samples, 20.0, 90.0).where("match_id = 1 and phase = 2").collect()}
    assert own and all(v == sum(n for (s, team), n in seen.items() if s == spot and team != t) for (spot, t), v in own.items())


def test_map_memory_is_added_up_once():
    rng = np.random.default_rng(4)
    grids = {(f, h, o, z): rng.random((12, 10)).astype(np.float32) for f in range(3) for h in (0, 1) for o in (0, 1) for z in (2, 3)}
    land, held = C.Raster(-3, -2, np.ones((12, 10), bool), np.zeros((12, 10))), {}
    x, y = rng.uniform(-9e4, 25e4, 40), rng.uniform(-9e4, 25e4, 40)
    for _ in range(20):
        zone, model, fold, half, old = int(rng.integers(2, 5)), int(rng.integers(0, 4)), int(rng.integers(0, 3)), int(rng.integers(0, 2)), int(rng.integers(0, 2))
        learns = old == 1 if model == 3 else fold != model
        use = [g for (f, h, o, z), g in grids.items() if z == zone and (o == 1 if model == 3 else f != model) and not (learns and h == half)]
        got = C.prior(grids, land, zone, (fold, half, old), model, 3, x, y, held)
        i, j = np.clip(np.floor(x / C.CELL).astype(int) + 3, 0, 9), np.clip(np.floor(y / C.CELL).astype(int) + 2, 0, 11)
        at = np.log(np.sum(use, axis=0)[j, i] / np.sum(use) + 1e-7) if use else np.zeros(40)
        assert np.allclose(got, at - at[1:].mean() if use else at, atol=1e-5)
    assert 1 < len(held) <= 3 * 4 * 3


def test_lanes_begin_at_the_team_and_end_inside(spark):
    teams = spark.createDataFrame([(1, 3, 7, 10_000.0, 0.0, 5.0, 0.0, 0.0, 4000.0), (1, 3, 8, 100.0, 0.0, 5.0, 0.0, 0.0, 4000.0)], "match_id long, phase long, team_index long, x double, y double, z double, next_x double, next_y double, next_r double")
    got = [(r.team_index, r.point, round(r.x, 3)) for r in P.lane_points(teams).orderBy("point").collect()]
    assert got[0] == (7, 0, 10_000.0) and got[-1] == (7, 5, round(10_000 - 6000 - 600, 3)) and len(got) == 6


def pulls_of(spark, persistent, matches=40, phases=7):
    rng = np.random.default_rng(5)
    rows = []
    for m in range(matches):
        x, y = rng.uniform(-60_000, 60_000, 2).tolist()
        r, angle = 100_000.0, rng.uniform(0, 2 * math.pi)
        for p in range(1, phases + 1):
            nr = r * 0.7
            angle = angle + rng.normal(0, 0.4) if persistent else rng.uniform(0, 2 * math.pi)
            d = (r - nr) * math.sqrt(rng.random())
            x, y = float(x + d * math.cos(angle)), float(y + d * math.sin(angle))
            rows.append((m, p, "shrinking", x, y, nr))
            r = nr
    pulls = spark.createDataFrame(rows, "match_id long, phase long, kind string, next_x double, next_y double, next_r double")
    dates = spark.createDataFrame([(m, f"2024-01-{1 + m % 28:02d}") for m in range(matches)], "match_id long, match_date string")
    return pulls, dates


def test_ladder_finds_a_planted_rule_and_nothing_in_chance(spark):
    land = C.raster(spark.createDataFrame([(i, j, 100.0) for i in range(-40, 40) for j in range(-40, 40)], "cx long, cy long, ground double"))
    hits = {}
    for persistent in (False, True):
        found = C.ladder(*pulls_of(spark, persistent), land, folds=3, disk=60, ring=24)
        hits[persistent] = {(r.rung, r.test): r for r in C.ladder_table(found).collect()}
    chance, rule = hits[False], hits[True]
    assert max(chance[r, "fold"].top_quarter for r in C.RUNGS) <= 0.36 and max(chance[r, "fold"].bits for r in C.RUNGS) < 0.05
    assert rule["one_step", "fold"].top_quarter >= 0.55 and rule["one_step", "fresh"].bits > 0.3
    assert rule["shuffled", "fold"].top_quarter < rule["history", "fold"].top_quarter - 0.15


def test_endgame_finds_where_matches_end(spark):
    land = C.raster(spark.createDataFrame([(i, j, 100.0) for i in range(-40, 40) for j in range(-40, 40)], "cx long, cy long, ground double"))
    rng = np.random.default_rng(2)
    rows = [(m, p, "shrinking", float(5000 * rng.normal() + (30_000 if p == 5 else -20_000 + 2000 * p)), float(3000 * rng.normal()), 50_000.0 / p) for m in range(30) for p in range(1, 6)]
    pulls = spark.createDataFrame(rows, "match_id long, phase long, kind string, next_x double, next_y double, next_r double")
    found = C.endgame(pulls, pulls_of(spark, True, 30)[1], land, folds=3, n=80)
    got = {r.rung: r for r in C.ladder_table(found).collect()}
    assert got["full"].n == 90 and got["full"].bits > got["rules"].bits + 0.5 and got["full"].top_quarter > 0.7 and got["full"].error_m < 250


def test_gradient_of_the_choice_model():
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(9, 4)), rng.normal(size=4)
    _, g, h = C.derivatives(x, w)
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        up, down = C.derivatives(x, w + step), C.derivatives(x, w - step)
        assert abs((up[0] - down[0]) / 2e-6 - g[k]) < 1e-6 and np.allclose(-(up[1] - down[1]) / 2e-6, h[k], atol=1e-6)


def test_disk_means_by_row_sums():
    rng = np.random.default_rng(6)
    high = np.where(rng.random((30, 20)) < 0.6, rng.uniform(0, 50, (30, 20)), np.nan)
    land = C.Raster(-7, 4, ~np.isnan(high), high)
    x, y, r = rng.uniform(-30_000, 50_000, 50), rng.uniform(0, 90_000, 50), rng.uniform(500, 20_000, 50)
    share, mean = land.disk(x, y, r)
    for k in range(50):
        inside, cells = [], 0
        for j in range(int((y[k] - r[k]) // C.CELL), int((y[k] + r[k]) // C.CELL) + 1):
            up = (j + 0.5) * C.CELL - y[k]
            if abs(up) <= r[k]:
                w = math.sqrt(r[k] ** 2 - up**2)
                for i in range(int((x[k] - w) // C.CELL), int((x[k] + w) // C.CELL) + 1):
                    cells += 1
                    if 0 <= j - 4 < 30 and 0 <= i + 7 < 20 and land.land[j - 4, i + 7]:
                        inside.append(high[j - 4, i + 7])
        assert abs(share[k] - len(inside) / max(cells, 1)) < 1e-9 and (abs(mean[k] - np.mean(inside)) < 1e-9 if inside else np.isnan(mean[k]))


def test_ranks_of_one_group_in_eight_partitions(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 60, 500), rng.integers(5, 65, 700)
    rows = [(None, True, float(v)) for v in a] + [(None, False, float(v)) for v in b] + [(1, True, None), (1, True, 2.0), (1, False, 2.0)]
    df = spark.createDataFrame(rows, "g int, side boolean, x double").repartition(8)
    got = {r.g: r for r in T.mann_whitney(df, ["g"], "side", "x").collect()}
    u = sum(0.5 * (v == w) + (v > w) for v in a for w in b)
    assert got[None].u == u and (got[None].n_a, got[None].n_b) == (500, 700) and got[1].u == 0.5
    assert abs({r.g: r.auc for r in T.auc(df, ["g"], "side", "x").collect()}[None] - u / 350_000) < 1e-12
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in range(66))
    assert abs({r.g: r.d for r in T.ks_two_sample(df, ["g"], "side", "x").collect()}[None] - d) < 1e-12
    assert abs(T.mann_whitney(df.drop("g"), [], "side", "x").first().u - u) < 600
    plan = T.mann_whitney(df, ["g"], "side", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "Window [" in line)


def test_blocks_hold_residuals_and_states_go_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 2))
    y = 3 * x[:, 0] + rng.normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})).repartition(3)
    growth = B.Growth(rounds=5, rate=0.4, depth=3)
    model = B.fit(df, ["a", "b"], "y", {}, growth)
    monkeypatch.setattr(B, "KEEP", 2)  # written and read again between the rounds
    again = B.fit(df, ["a", "b"], "y", {}, growth)
    assert [(t.feature, t.cut, t.count) for t in again.trees] == [(t.feature, t.cut, t.count) for t in model.trees]
    left, values = y - model.base, model.trees[0].node_of(B.binned(x, model.edges))  # the first tree's leaves by brute force
    for leaf in np.unique(values):
        mine = left[values == leaf]
        assert model.trees[0].count[leaf] == len(mine) and abs(model.trees[0].value[leaf] - 0.4 * mine.sum() / (len(mine) + 1)) < 1e-9
    got = df.select("a", "b", model.states([{}, {"a": F.lit(2.0)}, {"b": F.lit(None).cast("double"), "other": F.lit(1.0)}]).alias("p")).toPandas()
    own = got[["a", "b"]].to_numpy()
    for k, at in enumerate((own, np.column_stack((np.full(3000, 2.0), own[:, 1])), np.column_stack((own[:, 0], np.full(3000, np.nan))))):
        assert np.allclose([p[k] for p in got["p"]], model.score(at))


def test_prices_and_sheet_take_the_whole_growth(spark, monkeypatch):
    from tidemark.plans import studies as K
    from tidemark.plans import study_queries as Q

    seen = {}
    monkeypatch.setattr(Q.B, "fit", lambda df, features, target, signs=None, growth=B.Growth(), edges=None: seen.update(growth=growth) or B.Boosted(tuple(features), [np.zeros(0)] * len(features), 0.0, []))
    monkeypatch.setattr(Q.K, "findings", lambda context, *more: seen.update(params=context.params))
    Q.QUERIES["model_action_prices"](spark, "/root/testdata/sf0.001")
    Q.QUERIES["findings_sheet"](spark, "/root/testdata/sf0.001")
    assert seen["growth"] == B.Growth() and not seen["params"] and "expected_points" in K.STUDIES


def test_states_together_as_one_by_one():
    rng = np.random.default_rng(9)
    x, w, learns = rng.normal(size=(7, 11, 3)), rng.normal(size=3), np.array([1.0, 0, 1, 1, 0, 1, 1])
    ll, g, h = C.summed_derivatives(x, w, learns)
    want = [0.0, np.zeros(3), np.zeros((3, 3))]
    for s in x[learns > 0]:
        p = np.exp(s @ w) / np.exp(s @ w).sum()
        mean = p @ s
        for k, v in enumerate((math.log(p[0]), s[0] - mean, sum(q * np.outer(r - mean, r - mean) for q, r in zip(p, s, strict=True)))):
            want[k] = want[k] + v
    assert abs(ll - want[0]) < 1e-9 and np.allclose(g, want[1]) and np.allclose(h, want[2])

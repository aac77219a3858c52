"""Steps that many queries share: the same rows as by brute force, and no work done twice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import boosting as B
from tidemark.functions import stats as T
from tidemark.operators.interval import window_sums
from tidemark.plans import detect as D
from tidemark.plans import models as M
from tidemark.plans import studies as K

HEALTH = "match_id long, id long, t double, health double, shield double"
HITS = "match_id long, t double, attacker_id long, target_id long, amount double"
PLACES = "match_id long, id long, t double, x double, y double, z double"
ZONES = "match_id long, phase long, cur_x double, cur_y double, cur_r double, next_x double, next_y double, next_r double, start_shrink_t double, finish_shrink_t double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    at = lambda: rng.randrange(0, 2400) / 4
    health = {(m, i, at()): (float(rng.randrange(100)), None if rng.random() < 0.1 else float(rng.randrange(50))) for m in range(3) for i in range(9) for _ in range(60)}
    hits = [(rng.randrange(3), at(), rng.randrange(9), rng.randrange(9), float(rng.randrange(1, 40))) for _ in range(400)]
    places = {(m, i, at()): (rng.uniform(-9e4, 9e4), rng.uniform(-9e4, 9e4), 0.0) for m in range(3) for i in range(9) for _ in range(30)}
    zones = [(m, p, 0.0, 0.0, 90_000.0 / p, 100.0 * p, 0.0, 80_000.0 / p, 100.0 * p, 100.0 * p + 50) for m in range(3) for p in range(1, 6)]
    players = [(m, i, i // 3, i + 1, 2, None if i == 0 else 550.0 - i, 10.0 * i + 1, False) for m in range(3) for i in range(9)]
    frame = spark.createDataFrame
    t = D.Tables(
        matches=frame([(m,) for m in range(3)], "match_id long"),
        players=frame(players, "match_id long, id long, team_index long, placement long, kills long, death_t double, pr_rank double, is_bot boolean"),
        zones=frame(zones, ZONES), positions=frame([(*k, *v) for k, v in places.items()], PLACES), kills=None,
        health=frame([(*k, *v) for k, v in health.items()], HEALTH), damage=frame(hits, HITS), freshness=60.0,
    )
    return t, health, hits, places


def test_unexplained_drops_in_one_window_as_by_hand(tables):
    t, health, hits, places = tables
    want, last = {}, {}
    for (m, i, at), (h, s) in sorted(health.items()):
        hp = h + (s or 0.0)
        lost = last.get((m, i), hp) - hp
        last[m, i] = hp
        if lost > 0.5 and not any(a == m and b == i and at - 1.5 <= u <= at + 0.5 for a, u, _, b, _ in hits):
            want[m, i, at] = lost
    got = D.unexplained_drops(t)
    assert {(r.match_id, r.id, r.t): r.lost for r in got.collect()} == want and 100 < len(want) < len(health) / 2
    # one exchange by player and one by match; it was one for each lookup
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 2


def test_rotators_are_found_once_for_all_that_reads_them(tables):
    assert any("/there-" in f for f in D.rotations(tables[0]).inputFiles())


def test_a_gameplan_runs_no_detector_that_its_frame_does_not_need(tables, monkeypatch):
    def none(*_, **__):
        raise AssertionError("the surge was asked for")

    monkeypatch.setattr(D, "surge_episodes", none)
    found = K.run_study("gameplan", K.Context(tables[0]))
    assert list(found) == ["table:leave_by", "table:late", "table:surge_line", "table:exchange"] and "tests" not in found
    assert found["table:leave_by"].columns[0] == "phase" and found["table:leave_by"].count() % 4 == 0
    with pytest.raises(AssertionError):
        found["table:surge_line"]


def test_ranks_of_many_small_groups_as_of_few_large_ones(spark):
    df = spark.range(600).select((F.col("id") % 7).alias("g"), (F.col("id") * 31 % 5 < 2).alias("side"), F.expr("cast(id * 17 % 23 as double)").alias("x"))
    df = df.withColumn("x", F.when(F.col("x") != 3, F.col("x"))).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    for f in (T.auc, T.mann_whitney):
        want, got = (sorted(map(str, f(df, ["g"], "side", "x", **k).collect())) for k in ({}, {"small": True}))
        assert want == got and len(got) == 7
    assert "percentile_approx" not in T.auc(df, ["g"], "side", "x", small=True)._jdf.queryExecution().optimizedPlan().toString()


def test_surge_rule_by_hand(spark, tables):
    mean, best = D.surge_rule(tables[0])
    ep, per = D.surge_episodes(tables[0])
    starts = {r.episode: r for r in ep.where("match_id = 1").collect()}
    hits = [r for r in D.player_hits(tables[0]).where("match_id = 1").collect()]
    rows = per.where("match_id = 1").collect()
    aucs = []
    for e in starts:
        dealt = {r.id: sum(h.amount for h in hits if h.attacker_id == r.id and starts[e].t0 - 120 <= h.t < starts[e].t0) for r in rows if r.episode == e}
        hit = {r.id: r.surged for r in rows if r.episode == e}
        a, b = [dealt[i] for i in hit if not hit[i]], [dealt[i] for i in hit if hit[i]]
        if len(a) >= 2 and len(b) >= 2:
            aucs.append(sum((x > y) + (x == y) / 2 for x in a for y in b) / len(a) / len(b))
    one = D.Tables(**{k: v.where("match_id = 1") if hasattr(v, "where") else v for k, v in vars(tables[0]).items()})
    got = D.surge_rule(one)[0].where("window = '120' and measure = 'dealt' and level = 'player'").first()
    assert got.episodes == len(aucs) > 0 and abs(got.auc - sum(aucs) / len(aucs)) < 1e-12
    assert mean.where("chosen").count() == 1 and best.count() > 0


def test_spans_of_several_values_in_one_pass(spark):
    left = spark.createDataFrame([(1, k, float(3 * k), None if k == 4 else float(5 * k)) for k in range(9)], "g int, id int, a double, b double")
    facts = spark.range(60).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("r_t"), (F.col("id") * 3 % 7).cast("double").alias("u"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("v"))
    spans = {"p": (F.col("a"), F.col("b")), "q": (F.col("a"), F.col("b")), "r": (F.col("b"), F.col("a"))}
    both = window_sums(left, facts, ["g"], spans, {"p": "u", "q": "v", "r": "u"}, ["id"])
    got = {r.id: (r.p, r.q, r.r) for r in both.collect()}
    of = lambda lo, hi, f: sum(f(t) for t in range(60) if lo < t <= hi)
    for k in range(9):
        a, b = 3.0 * k, 5.0 * k
        want = (0.0, 0.0, 0.0) if k == 4 else (of(a, b, lambda t: t * 3 % 7), of(a, b, lambda t: t if t % 2 == 0 else 0), 0.0)
        assert got[k] == want
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_all_rungs_and_folds_of_a_forecast_are_fitted_together(spark):
    rng = np.random.default_rng(4)
    rows = [(s, s % 3, a, *rng.normal(size=2).tolist()) for s in range(60) for a in range(4 + s % 2)]
    df = spark.createDataFrame(rows, "match_id int, fold int, alt_id int, a double, b double").withColumn("phase", F.lit(2))
    states = M.packed_states(df, ["a", "b"])
    models = [(0, [0]), (1, [0, 1])]
    for (fold, columns), got in zip(models, M.conditional_logits(states, 2, models), strict=True):
        slope = -0.1 * got
        for s in range(60):
            if s % 3 != fold:
                x = np.array([r[3:] for r in rows if r[0] == s])[:, columns]
                p = np.exp(x @ got)
                slope += x[0] - p / p.sum() @ x
        assert np.abs(slope).max() < 1e-6
    w = {("r", k): np.array([1.0, -0.5]) for k in range(3)}
    for r in M.ranked_truths(states, 2, {"r": [0, 1]}, w).collect():
        u = np.array([x[3] - 0.5 * x[4] for x in rows if x[0] == r.match_id])
        assert abs(r.beaten - (u[1:] < u[0]).mean()) < 1e-12 and abs(r.bits - (np.log(np.exp(u[0]) / np.exp(u).sum()) + np.log(len(u))) / np.log(2)) < 1e-9


def test_actions_are_priced_and_breaches_counted_without_meeting_again(spark):
    names = ("outside_m", "storm_m", "hp", "enemies_50", "kills")
    tree = B.Tree([2, -1, -1], [1, 0, 0], [1, 0, 0], [0.0, 1.0, 5.0], [2, 1, 1])
    model = B.Boosted(names, [np.array([100.0])] * 5, 2.0, [tree])
    df = spark.createDataFrame([(1, float(k), 0, 10.0, 0.0, 60.0 * k, 2, 1) for k in range(4)], "match_id int, t double, team_index int, outside_m double, storm_m double, hp double, enemies_50 long, kills long")
    priced = M.priced_actions(model, df)
    got = {r.t: (r.hold, r.heal, r.best, r.stake) for r in priced.collect()}
    assert got == {0.0: (3.0, 7.0, "heal", 4.0), 1.0: (3.0, 7.0, "heal", 4.0), 2.0: (7.0, 7.0, "hold", 0.0), 3.0: (7.0, 7.0, "hold", 0.0)}
    assert "Exchange" not in priced._jdf.queryExecution().executedPlan().toString()
    counted = M.sign_breaches(model, df)
    assert {(r.feature, r.n, r.breaches) for r in counted.collect()} == {(f, 4, 0) for f in names if M.SIGNS.get(f)}
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_snapshots_pass_over_a_teams_facts_once(tables):
    t = tables[0]
    kills = t.damage.limit(0).select("match_id", "t", F.col("target_id").alias("victim_id"), F.col("attacker_id").alias("finisher_id"))
    s = D.snapshots(D.Tables(**vars(t) | {"kills": kills}), 30.0)
    assert any("/totals-" in f for f in s.inputFiles()) and s.count() > 50
    last = {(m, i): [] for m in range(3) for i in range(9)}
    for (m, i, at), (h, x) in tables[1].items():
        last[m, i].append((at, h + (x or 0.0)))
    alone = D._members(t, 30.0, hp=True).collect()
    assert {(r.match_id, r.id, r.t): r.hp for r in alone} == {(r.match_id, r.id, r.t): max((v for v in last[r.match_id, r.id] if v[0] <= r.t), default=(0, None))[1] for r in alone} and alone


def test_grown_tables_are_not_broadcast(spark, tiny):
    from tidemark.sources.arena import Arena
    from tidemark.sources.shared import grown

    big = spark.range(1000).select((F.col("id") % 50).alias("match_id"), F.col("id").alias("x"))
    kept = grown(big.groupBy("match_id").agg(F.max("x").alias("m")), "kept").where("m > 3").withColumn("n", F.col("m") + 1)
    met = big.join(kept, "match_id")
    assert met.agg(F.sum("n")).first()[0] == sum(20 * (950 + k + 1) for k in range(50))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    t = Arena(spark, tiny).tables()
    zones = t.positions.join(t.zones.select("match_id", "phase"), "match_id")
    assert "Broadcast" not in zones._jdf.queryExecution().executedPlan().toString()

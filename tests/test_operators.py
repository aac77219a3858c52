"""Operators on rows made by hand, with the numbers that they must give."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import points as P
from tidemark.functions import scalar as S
from tidemark.functions import stats as T
from tidemark.operators import aggregates as A
from tidemark.operators import ranks as R
from tidemark.operators import selection as L
from tidemark.operators import sessions as W
from tidemark.operators.asof import asof_join, running_totals
from tidemark.operators.interval import interval_join, time_grid, window_sums
from tidemark.operators.spatial import land_map, nearest_place, neighbour_counts, neighbour_pairs, place_cells


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_asof_directions_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("b", 9.0), (None, 5.0), ("a", None)], "k string, t double")
    right = spark.createDataFrame([("a", 2.0, 20), ("a", 5.0, 50), ("a", 5.0, 51), ("b", 12.0, 120), (None, 1.0, 1), ("a", None, 7)], "k string, t double, v int")
    back = asof_join(left, right, ["k"], ["v"], how="left")
    assert values(back, "k", "t", "v") == sorted([("a", 5.0, 51), ("a", 1.0, None), ("b", 9.0, None), (None, 5.0, None), ("a", None, None)], key=str)
    ahead = asof_join(left, right, ["k"], ["v"], how="left", direction="forward", tolerance=2.0)
    assert values(ahead, "k", "t", "v") == sorted([("a", 5.0, 50), ("a", 1.0, 20), ("b", 9.0, None), (None, 5.0, None), ("a", None, None)], key=str)
    assert asof_join(left, right, ["k"], ["v"]).count() == 1
    assert asof_join(left.limit(0), right, ["k"], ["v"]).count() == 0


def test_running_totals_and_window_sums(spark):
    left = spark.createDataFrame([("a", 3.0), ("a", 10.0), ("b", 1.0)], "k string, t double")
    facts = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 7.0), ("a", 11.0, 100.0)], "k string, t double, v double")
    assert values(running_totals(left, facts, ["k"], {"s": F.col("v")}), "k", "t", "s") == [("a", 10.0, 12.0), ("a", 3.0, 12.0), ("b", 1.0, 0.0)]
    got = window_sums(left, facts.withColumnRenamed("t", "r_t"), ["k"], {"w": (F.col("t") - 5, F.col("t"))}, "v", ["k", "t"])
    assert values(got, "k", "t", "w") == [("a", 10.0, 0.0), ("a", 3.0, 12.0), ("b", 1.0, 0.0)]


def test_interval_join_is_closed_on_both_ends(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 10.0)], "k int, t double")
    right = spark.createDataFrame([(1, 8.5), (1, 10.5), (1, 8.49), (1, 10.51)], "k int, r_t double")
    assert values(interval_join(left, right, ["k"], 1.5, 0.5), "r_t") == [(10.5,), (8.5,)]
    assert values(interval_join(left, right, ["k"], 1.5, 0.5, how="left_anti"), "k") == [(2,)]
    assert values(interval_join(left, right, ["k"], 1.5, 0.5, how="left_semi"), "k") == [(1,)]


def test_time_grid_leaves_out_its_end(spark):
    spans = spark.createDataFrame([(1, 5.0, 30.0), (2, 21.0, 29.0)], "k int, b double, e double")
    assert values(time_grid(spans, "b", "e", 10.0), "k", "t") == [(1, 10.0), (1, 20.0)]


def test_neighbours_cross_grid_cells(spark):
    pts = spark.createDataFrame([(1, "a", 1, -10.0, 0.0), (1, "b", 2, 10.0, 0.0), (1, "c", 1, 0.0, 14_900.0), (2, "d", 9, 0.0, 0.0), (1, "e", 3, None, 0.0)], "m int, id string, team int, x double, y double")
    n = neighbour_counts(pts, ["m"], "id", [1, 150], "team")
    assert values(n, "id", "near_1", "near_150") == [("a", 1, 1), ("b", 1, 2), ("c", 0, 1), ("d", 0, 0), ("e", 0, 0)]


def test_nearest_place(spark):
    places = spark.createDataFrame([("P", 0.0, 0.0), ("Q", 100_000.0, 0.0)], "name string, x double, y double")
    pts = spark.createDataFrame([(1, 1_000.0, 0.0), (2, 50_000.0, 0.0)], "id int, x double, y double")
    assert values(nearest_place(pts, places, 400.0), "id", "place", "place_m") == [(1, "P", 10.0), (2, "Unnamed area", None)]


def test_ranks(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 10.0), (1, 30.0), (1, None)], "g int, x double")
    got = df.select("x", R.percent_rank_average("x", ["g"]).alias("a"), R.percent_rank_min("x", ["g"]).alias("m"), R.percent_rank_nulls_last("x", ["g"]).alias("l"))
    assert sorted(got.collect(), key=str) == sorted([(10.0, 0.5, 1 / 3, 0.375), (10.0, 0.5, 1 / 3, 0.375), (30.0, 1.0, 1.0, 0.75), (None, None, None, 1.0)], key=str)
    flat = spark.createDataFrame([(1, 2.0, 5.0), (1, 4.0, 5.0), (1, None, 5.0)], "g int, y double, x double")
    assert values(flat.select(R.residual("y", "x", ["g"]).alias("r")), "r") == [(-1.0,), (1.0,), (math.inf,)]


def test_sessions_runs_and_rhythm(spark):
    t = spark.createDataFrame([(1, 0.0), (1, 15.0), (1, 30.1)], "k int, t double")
    assert values(W.gap_sessions(t, ["k"], "t", 15.0), "t", "session") == [(0.0, 0), (15.0, 0), (30.1, 1)]
    r = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k int, t int, v string")
    assert values(W.runs(r, ["k"], ["t"], "v"), "t", "run") == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)]
    ticks = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 5.0), ("b", 1, 0.0), ("b", 1, 1.0), ("c", 1, 7.0), ("d", 1, 50.0), ("d", 2, 50.2), ("d", 3, 49.8)], "m string, id int, t double")
    got = ticks.withColumn("y", W.rhythm("t", "id", "m"))
    assert values(got, "m", "t", "y") == sorted([("a", 0.0, True), ("a", 5.0, True), ("b", 0.0, False), ("b", 1.0, False), ("c", 7.0, False), ("d", 50.0, True), ("d", 50.2, True), ("d", 49.8, True)], key=str)
    s = spark.createDataFrame([(1, float(k)) for k in (0, 4, 9, 10, 14, 21)], "k int, t double")
    assert values(W.thinned(s, ["k"], "t", 10.0, exact=True), "t") == [(0.0,), (10.0,), (21.0,)]
    assert values(W.changes_only(r, ["k"], ["t"], "v"), "t") == [(1,), (3,), (5,)]


def test_exact_thinning_takes_many_players_at_once(spark):
    rows = [(k, float(t)) for k in [None, *range(40)] for t in (0, 30, 61, 61, 100, 121)] + [(7, None)]
    kept = W.thinned(spark.createDataFrame(rows, "k int, t double"), ["k"], "t", 60.0, exact=True)
    assert values(kept, "k", "t") == sorted(((k, t) for k in [None, *range(40)] for t in (0.0, 61.0, 121.0)), key=str)
    assert "FlatMapGroups" not in kept._jdf.queryExecution().executedPlan().toString()  # no call of Python for each player


def test_like_for_like_takes_only_strata_with_both(spark):
    rows = [(1, True, 1.0), (1, False, 5.0), (2, True, 2.0), (2, False, 6.0), (3, True, 0.0), (3, False, 4.0), (4, True, 99.0)]
    d = A.like_for_like(spark.createDataFrame(rows, "s int, a boolean, v double"), ["s"], F.col("a"), "v")
    assert (d.count(), d.agg(F.avg("gap")).first()[0]) == (3, -4.0)


def test_geometry(spark):
    one = spark.range(1)
    c = lambda x: F.lit(float(x))
    row = one.select(
        G.distance_m(c(0), c(0), c(300), c(400)).alias("d"), G.progress(c(5), c(0), c(10)).alias("f"), G.bearing(c(0), c(-1)).alias("b"), G.turn(c(350), c(10)).alias("t"),
        G.off_segment_m(c(0), c(100), c(100), c(0), c(200), c(0)).alias("s"), G.overlap_share(c(0), c(10), c(5)).alias("in"), G.overlap_share(c(15), c(10), c(5)).alias("apart"), G.overlap_share(c(10), c(10), c(10)).alias("half"),
        G.way_in(c(10), c(0), c(0), c(0), c(5))[0].alias("w"), G.relation(G.cosine(c(1), c(0), c(-1), c(0))).alias("r"),
    ).first()
    assert row == (5.0, 0.5, 270.0, 20.0, pytest.approx(math.sqrt(2)), 1.0, 0.0, 0.391, 5.0, "away")


def test_labels(spark):
    df = spark.createDataFrame([("/Game/W/WID_Shotgun_Standard_Athena_UC_Ore_T03.WID_Shotgun_Standard_Athena_UC_Ore_T03",), ("WID_Assault_AutoHigh_Athena_SR_Ore_T03",), ("AmmoDataShells",), ("Athena_Medkit_T02",), ("",)], "p string")
    got = df.select(S.item_category(F.col("p")).alias("c"), S.item_rarity(F.col("p")).alias("r"), S.weapon_class(S.item_name(F.col("p"))).alias("w"), S.readable_weapon(S.item_name(F.col("p"))).alias("n")).collect()
    assert got == [("weapon", "uncommon", "shotgun", "Shotgun Standard"), ("weapon", "legendary", "assault rifle", "Assault AutoHigh"), ("ammo", None, "other weapon", "AmmoDataShells"), ("heal/shield", "uncommon", "other weapon", "Medkit"), (None, None, None, None)]
    more = spark.range(1).select(S.season(F.lit("++X+Release-32.10")).alias("s"), S.season(F.lit("main")).alias("m"), S.clock_seconds(F.lit("02:05")).alias("c"), S.clock(F.lit(125.9)).alias("k"), S.build_material(F.lit("PBWA_S1_Floor")).alias("b"), S.strength(F.lit(0.0005)).alias("p"))
    assert more.first() == ("v32.10", "main", 125.0, "2:05", "stone", "strong")


def test_points(spark):
    table = P.scheme(spark, P.DUOS)
    games = spark.createDataFrame([(1, 1, 3), (2, 20, 0), (3, 30, 2)], "g int, placement long, kills long")
    assert values(P.scored(games, table), "g", "points") == [(1, 77), (2, 12), (3, 8)]
    assert P.problems(table).count() == 0
    rows = lambda *x: spark.createDataFrame([(a, b, 4) for a, b in x], "place long, points long, elimination long")
    assert values(P.problems(rows((1, 5), (3, 2))), "problem") == [("gap",)] and values(P.problems(rows((1, 5), (2, 7))), "problem") == [("rises",)] and values(P.problems(rows((2, 5))), "problem") == [("not from 1st",)]
    step = {(r["first"], r["last"]): (r.step, r.places_per_elimination) for r in P.exchange(table).collect()}
    assert any(first <= 8 and last >= 25 and v == (2, 2.0) for (first, last), v in step.items())


def test_statistics_against_known_values(spark):
    x = spark.createDataFrame([(v,) for v in (5.1, 4.9, 5.6, 5.8, 6.0)], "x double")
    r = T.t_test(x, [], "x", 5.0).first()
    assert (r.n, round(r.t, 4), round(r.p, 4)) == (5, 2.3041, 0.0826)
    same = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double")
    assert T.t_test(same, [], "x", 0.0).first().p == 0.0 and T.t_test(same.limit(2), [], "x").first().p is None
    assert T.binomial_two_sided(8, 10) == pytest.approx(0.109375) and T.kolmogorov_exact(0.3, 10) == pytest.approx(0.2704, abs=2e-3)
    mw = T.mann_whitney(spark.createDataFrame([(True, 1.0), (True, 2.0), (True, 3.0), (False, 4.0), (False, 5.0)], "a boolean, x double"), [], "a", "x").first()
    assert (mw.u, mw.effect) == (0.0, -1.0)
    sep = lambda rows: T.auc(spark.createDataFrame(rows, "safe boolean, s double"), [], "safe", "s").first().auc
    assert sep([(True, 50.0), (True, 80.0), (False, 0.0), (False, 10.0)]) == 1.0 and sep([(True, 5.0), (True, 5.0), (False, 5.0), (False, 5.0)]) == 0.5
    ks = T.ks_two_sample(spark.createDataFrame([(True, float(i)) for i in range(10)] + [(False, float(i + 20)) for i in range(10)], "a boolean, x double"), [], "a", "x").first()
    assert ks.d == 1.0 and ks.p < 0.001
    teams = spark.createDataFrame([(1, "a", True), (1, "a", True), (1, "b", True), (1, "b", False), (1, "c", True)], "e int, team string, f boolean")
    assert T.agreement(teams, ["e"], "team", "f").first().together == 0.5
    assert T.rayleigh(spark.createDataFrame([(float(d),) for d in (10, 12, 8, 11, 9, 10)], "d double"), [], "d").first().p < 0.01


def test_item_words_are_looked_for_in_a_name_worked_out_once(spark):
    paths = ("/Game/x/WID_Assault_Auto_Athena_SR_T03.WID_Assault_Auto_Athena_SR_T03", "Athena_Bandage", "a/Foo_T02", "Foo_T09", "Foo_T0", "x/", "", None)
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.item_category(F.col("p")).alias("c"), S.item_rarity(F.col("p")).alias("r"))
    assert [(r.c, r.r) for r in got.collect()] == [("weapon", "legendary"), ("heal/shield", None), ("other", "uncommon"), ("other", None), ("other", None), ("other", None), (None, None), (None, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4  # two in a name, for either column


def test_permutation_sees_different_directions(spark):
    rows = [(True, 10.0 + k) for k in range(12)] + [(False, 190.0 + k) for k in range(12)]
    assert T.circular_permutation(spark.createDataFrame(rows, "a boolean, d double"), [], "a", "d", 200).first().p < 0.02


def test_permutation_adds_up_rounds_without_ordering_them(spark):
    """The same as ordering every round whole, groups without a name or a side included, and few of the dealt rows are shuffled."""
    rows = [(g, k % 3 == 0, float((k * k * 7 + k) % 360)) for g in ("x", None) for k in range(600)] + [("one", True, 5.0), ("one", True, 9.0), ("y", True, None)]
    df, rounds = spark.createDataFrame(rows, "g string, a boolean, d double"), 60
    written_rows = lambda: sum(spark.sparkContext._jsc.sc().statusStore().stageList(*every).apply(i).shuffleWriteRecords() for i in range(spark.sparkContext._jsc.sc().statusStore().stageList(*every).size()))
    every = (None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0), None)
    before = written_rows()
    got = {r.g: (r.distance, r.p) for r in T.circular_permutation(df, ["g"], "a", "d", rounds).collect()}
    assert written_rows() - before < 1200 * rounds / 2
    assert set(got) == {"x", None, "one"} and got["one"] == (None, None)
    own = sorted((math.cos(math.radians(d)), math.sin(math.radians(d)), a) for g, a, d in rows if g == "x")
    cells = spark.range(1, len(own) + 1).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(1, rounds + 1).select(F.col("id").cast("int").alias("r")))
    hashes = {(r.r, r.i): r.h for r in cells.select("r", "i", F.xxhash64("r", "i", F.lit(0)).alias("h")).collect()}
    m = sum(a for _, _, a in own)
    mean = lambda rows, c: sum(v[c] for v in rows) / len(rows)
    gap = lambda yes, no: math.hypot(mean(yes, 0) - mean(no, 0), mean(yes, 1) - mean(no, 1))
    seen = gap([v for v in own if v[2]], [v for v in own if not v[2]])
    k = 0
    for r in range(1, rounds + 1):
        order = [own[i - 1] for i in sorted(range(1, len(own) + 1), key=lambda i: (hashes[r, i], i))]
        k += gap(order[:m], order[m:]) >= seen - 1e-12
    assert all(got[g] == (pytest.approx(seen), (k + 1) / (rounds + 1)) for g in ("x", None))


def test_ridge_recovers_weights(spark):
    rows = [(float(k % 7), float(k % 5), 3.0 * (k % 7) - 2.0 * (k % 5) + 1.0) for k in range(200)]
    w, b = T.ridge(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y", 1e-6)
    assert w == pytest.approx([3.0, -2.0], abs=1e-4) and b == pytest.approx(1.0, abs=1e-3)


def test_geometric_skill(spark):
    p = spark.createDataFrame([(1, 100.0), (1, 10_000.0), (2, None), (2, 400.0)], "team int, pr_rank double")
    got = p.groupBy("team").agg(A.geometric_mean(F.col("pr_rank")).alias("s"))
    assert values(got, "team", "s") == [(1, pytest.approx(1000.0)), (2, pytest.approx(math.sqrt(100_000 * 400)))]


def test_land_map_closes_holes(spark):
    cells = spark.createDataFrame([(x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)], "cx long, cy long")
    got = {(r.cx, r.cy): r.known for r in land_map(cells).collect()}
    assert got[(2, 2)] is False and len(got) == 25


def test_selection(spark):
    m = spark.createDataFrame([("a", "2024-01-05", "v1", "EU", "w1", "Trios", True, 0.5), ("b", "bad", "v1", "EU", "w2", "Solo", None, None), ("c", None, "v2", "NA", "w1", "trios cup", True, 0.1)], "match_id string, match_date string, season string, region string, event_window_id string, playlist string, is_server_replay boolean, lobby_strength double")
    pick = lambda **f: values(L.select(m, L.Filters(**f)), "match_id")
    assert pick(playlist="TRIOS") == [("a",), ("c",)] and pick(server_only=True, min_strength=0.2) == [("a",)] and pick(date_from="2024-01-01") == [("a",)]
    assert L.overlap(m.where("season = 'v1'"), m.where("event_window_id = 'w1'")).first() == (2, 2, 1, 1)
    people = spark.createDataFrame([("x", 1, "Alpha"), ("x", 1, "Beta"), ("x", 2, "alphabet")], "match_id string, team_index long, name string")
    assert values(L.find_team(people, "alpha, beta"), "team_index", "fragments") == [(1, 2)]
    assert L.find_team(people, " , ").count() == 0


def test_nearest_place_of_crowded_places_looks_at_few_of_each(spark):
    """A cell of the limit's width held every place in reach; now a point meets a bounded number of them, with the same result."""
    n, limit = 3000, 400.0
    at = F.expr("cast((id * 7919) % 240001 - 120000 as double)").alias("x"), F.expr("cast((id * 104729) % 240001 - 120000 as double)").alias("y")
    own = spark.range(n).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"), *at)
    # two names in one spot, one without a position and one far from all others
    extra = spark.createDataFrame([("A", 5.0, 5.0), ("B", 5.0, 5.0), ("C", None, 1.0), ("Z", 900_000.0, 900_000.0)], "name string, x double, y double")
    places = own.unionByName(extra)
    points = spark.range(300).select("id", F.expr("cast((id * 15485863) % 300001 - 150000 as double)").alias("x"), F.expr("cast((id * 6101) % 300001 - 150000 as double)").alias("y"))
    points = points.unionByName(spark.createDataFrame([(1000, 5.0, 5.0), (1001, 890_000.0, 900_000.0), (1002, None, 2.0)], "id long, x double, y double"))
    d = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2) / 100
    brute = points.alias("a").join(places.alias("b"), d <= limit, "left").groupBy("a.id").agg(F.min(F.when(d.isNotNull(), F.struct(d.alias("m"), F.col("b.name").alias("name")))).alias("b"))
    want = {r.id: (r.b["name"], r.b["m"]) if r.b else ("Unnamed area", None) for r in brute.collect()}
    assert {r.id: (r.place, r.place_m) for r in nearest_place(points, places, limit).collect()} == want
    held, _ = place_cells(places, limit)
    assert held.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] < 64


def test_neighbour_pairs_send_a_point_to_five_cells_at_most_and_lose_none(spark):
    points = spark.range(240).select((F.col("id") % 2).alias("g"), "id", F.expr("cast((id * 7919) % 4001 - 2000 as double)").alias("x"), F.expr("cast((id * 104729) % 3001 - 1500 as double)").alias("y"), (F.col("id") % 5).alias("team"))
    b = points.select("g", F.col("id").alias("other"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("team").alias("w"))
    near = F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2) / 100 <= 3.0
    want = sorted((r.g, r.id, r.other) for r in points.join(b, "g").where(near & (F.col("id") != F.col("other")) & (F.col("team") != F.col("w"))).collect())
    pairs = neighbour_pairs(points, ["g"], "id", 3.0, "team")
    assert sorted((r.g, r.id, r.other) for r in pairs.collect()) == want and want
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("named_struct(cx") <= 5


def test_running_totals_some_seconds_ago(spark):
    facts = spark.createDataFrame([("a", 1.0, 2.0), ("a", 5.0, 3.0), ("a", 15.0, 7.0), ("b", 5.0, 11.0)], "k string, t double, v double")
    probes = spark.createDataFrame([("a", 15.0), ("a", 14.9), ("a", 11.0), ("a", 0.0), ("c", 3.0)], "k string, t double")
    found = running_totals(probes, facts, ["k"], {"now": F.col("v")}, ago={"before": ("now", 10)})
    assert {(r.k, r.t): (r.now, r.before) for r in found.collect()} == {("a", 15.0): (12.0, 5.0), ("a", 14.9): (5.0, 2.0), ("a", 11.0): (5.0, 2.0), ("a", 0.0): (0.0, 0.0), ("c", 3.0): (0.0, 0.0)}

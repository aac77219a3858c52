"""Documents into tables, incremental builds, leaderboards and the catalog."""

import json

from pyspark.sql import functions as F

from tidemark.plans import detect as D
from tidemark.plans import models as M
from tidemark.plans import studies as K
from tidemark.sources import checks, documents, leaderboards
from tidemark.sources.arena import Arena
from tidemark.sources.catalog import Catalog
from tidemark.streaming import incremental


def document(match_id="m1"):
    zones = [
        {"seq": 0, "radius": 1500.0, "next_center": None, "next_radius": 0},
        {"seq": 1, "radius": 0, "next_center": [100.0, 0.0, 0.0], "next_radius": 1000.0, "start_shrink_t": 100.0, "finish_shrink_t": 140.0},
        {"seq": 2, "radius": 0, "next_center": [100.2, 0.1, 0.0], "next_radius": 1000.1, "start_shrink_t": 100.0, "finish_shrink_t": 140.0},
        {"seq": 3, "radius": 0, "next_center": [300.0, 0.0, 0.0], "next_radius": 600.0, "start_shrink_t": 200.0, "finish_shrink_t": 240.0},
        {"seq": 4, "last_center": [310.0, 0.0, 0.0], "last_radius": 590.0, "next_center": [2000.0, 0.0, 0.0], "next_radius": 500.0, "start_shrink_t": 240.5, "finish_shrink_t": 260.0},
    ]
    players = [{"id": k, "player_id": f"ACC{k}", "name": f"N{k}", "is_bot": k == 9, "team_index": k // 2, "placement": None if k < 2 else k, "kills": k, "death_t": None if k == 0 else 100.0 + k, "death_location": [1.0, 2.0, 3.0]} for k in range(4)]
    rows = []
    for k in range(4):
        rows += [[k, 5.0, 1000.0 * k, 0.0, 90_000.0, None, None, -2000.0, False, False, True, k // 2], [k, 10.0, 1000.0 * k, 50.0, 20_000.0, None, None, -100.0, False, False, False, k // 2]]
        rows += [[k, 11.0 + s, 1000.0 * k, 50.0, 20_000.0, None, None, 0.0, False, False, False, k // 2] for s in range(2)] + [[k, 300.0, 0.0, 0.0, 100.0, None, None, 0.0, False, False, False, k // 2]] * (k == 0)
    return {
        "schema": "1", "match_id": match_id, "source_file": "f", "replay": {"length_ms": 60000, "branch": "++X+Release-32.10", "timestamp": "2024-03-01T10:00:00"}, "game": {"playlist": "Duos", "match_end_t": 300.0},
        "bus": [{"start": [0.0, 0.0, 0.0], "yaw": 0.0}, {"start": [-100.0, 50.0, 0.0], "yaw": 90.0, "speed": 10.0, "flight_start_time": 0.0, "flight_end_time": 20.0, "drop_start_time": 2.0, "drop_end_time": 18.0}],
        "zones": zones, "players": players, "teams": [{"team_index": 0, "placement": 1, "team_kills": 1, "player_ids": [0, 1]}],
        "positions": {"columns": ["id", "t", "x", "y", "z", "vx", "vy", "vz", "in_storm", "dbno", "skydiving", "team_index"], "rows": rows},
        "kill_feed": [{"t": 20.0, "victim_id": 3, "finisher_id": 2, "downed": False, "location": [1.0, 2.0, 3.0]}], "eliminations": [{"time": "01:05", "eliminated": "ACC3", "eliminator": "ACC2", "knocked": False}],
        "events": {"health": {"columns": ["t", "id", "health"], "rows": [[1.5, 2, 90], [2.5, 2, "bad"]]}},
    }


def read(spark, tmp_path, *docs):
    for d in docs:
        (tmp_path / f"{d['match_id']}.json").write_text(json.dumps(d))
    return documents.read_documents(spark, str(tmp_path))


def test_tables_of_a_document(spark, tmp_path):
    docs = read(spark, tmp_path, document()).cache()
    m = documents.matches(docs).first()
    assert (m.season, m.n_players, m.n_humans, m.n_teams, m.length_s) == ("v32.10", 4, 4, 2, 60.0)
    z = documents.zone_phases(docs).orderBy("phase").collect()
    assert [(r.phase, r.cur_x, r.cur_r, r.next_x, r.next_r) for r in z] == [(1, None, 1500.0, 100.0, 1000.0), (2, 100.0, 1000.0, 300.0, 600.0), (3, 310.0, 590.0, 2000.0, 500.0)]
    f = documents.zone_features(documents.zone_phases(docs)).orderBy("phase").collect()
    assert [(r.phase, r.kind, r.zone_type, r.u) for r in f] == [(2, "shrinking", "shrinking", 0.25), (3, "moving", "moving", None)]
    e = documents.eliminations(docs).first()
    assert (e.time_s, e.eliminated) == (65.0, "acc3")
    b = documents.aircraft_bus(docs).first()
    assert (b.bearing_deg, round(b.end_y), round(b.drop_end_y), b.start_x) == (90.0, 250, 230, -100.0)
    h = documents.unpacked(docs, "events.health", "health").orderBy("t").collect()
    assert [(r.t, r.id, r.health, r.shield) for r in h] == [(1.5, 2, 90.0, None), (2.5, 2, None, None)]
    pos = documents.unpacked(docs, "positions", "positions")
    p = documents.inferred_winners(documents.players(docs), pos, documents.matches(docs))
    assert {r.id: (r.placement, r.placement_inferred) for r in p.collect()}[0] == (1, True)
    own = documents.team_placements(p).withColumn("pr_rank", F.lit(500.0))
    land = documents.landings(pos, own, documents.aircraft_bus(docs).select("match_id", "flight_start_t", "start_x", "start_y", "bearing_deg", "bus_source"), documents.zone_phases(docs), documents.kills(docs)).collect()
    assert {r.id: (r.land_t, r.opp_150m, r.opp_top1000_300m) for r in land} == {k: (10.0, 2, 2) for k in range(4)}
    assert {r.id: r.early_kills for r in land} == {0: 0, 1: 0, 2: 1, 3: 0}
    found = checks.checks(documents.matches(docs), p, documents.teams(docs), documents.zone_phases(docs).withColumn("cur_r", F.coalesce("cur_r", F.lit(1e9))), pos, documents.aircraft_bus(docs))
    assert found.count() == 12 and checks.worst(found).count() == 1


def test_derived_bus(spark):
    rows = [("m", k, float(k), 1000.0 * k, 1000.0 * k, True) for k in range(8)]
    b = documents.derived_bus(spark.createDataFrame(rows, "match_id string, id long, t double, x double, y double, skydiving boolean")).first()
    assert (b.bus_source, round(b.bearing_deg, 3), b.n_points, round(b.fit_rms, 6), b.direction_known) == ("derived_skydive", 45.0, 8, 0.0, True)
    few = documents.derived_bus(spark.createDataFrame(rows[:4], "match_id string, id long, t double, x double, y double, skydiving boolean")).first()
    assert (few.bus_source, few.bearing_deg) == ("none", None)


def test_health_slots_and_rebuild(spark):
    hits = spark.createDataFrame([("m", 7, float(10 * k), k % 2 == 0, "player") for k in range(1, 9)], "match_id string, target_id long, t double, shield_hit boolean, target_kind string")
    rows = [("m", 0.0, 7, h, 100.0) for h in (1, 2, 3)]
    for k in range(1, 9):
        rows += [("m", 10.0 * k + 0.5, 7, 1 if k % 2 else 2, 100.0 - 5 * k), ("m", 10.0 * k + 0.5, 7, 3, 100.0)]
    attributes = spark.createDataFrame(rows, "match_id string, t double, id long, handle long, value double")
    slots = documents.health_slots(attributes, hits)
    assert {(r.shield_hit, r.handle) for r in slots.collect()} == {(False, 1), (True, 2)}
    last = documents.rebuilt_health(attributes, slots).orderBy(F.desc("t")).first()
    assert (last.health, last.shield) == (65.0, 60.0)


def test_nearest_actor(spark):
    ev = spark.createDataFrame([("m", 1, 10.0, 0.0, 0.0, 0.0), ("m", 2, 99.0, 0.0, 0.0, 0.0)], "match_id string, ev int, t double, x double, y double, z double")
    pos = spark.createDataFrame([("m", 5, 9.0, 100.0, 0.0, 0.0), ("m", 6, 9.5, 50.0, 0.0, 0.0), ("m", 7, 9.9, 10.0, 0.0, 0.0)], "match_id string, id long, t double, x double, y double, z double")
    pl = spark.createDataFrame([("m", 5, False, None), ("m", 6, False, None), ("m", 7, True, None)], "match_id string, id long, is_bot boolean, death_t double")
    assert {r.ev: r.actor for r in documents.nearest_actor(ev, pos, pl, ["ev"], "t").collect()} == {1: 6, 2: None}


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    assert c.table("health").count() == 0
    c.write("health", spark.createDataFrame([("m", 1.0, 2, float("nan"))], "match_id string, t double, id long, health double"))
    row = Catalog(spark, str(tmp_path)).table("health").first()
    assert (row.match_id, row.health, row.shield) == ("m", None, None)


def test_incremental(spark, tmp_path):
    (tmp_path / "in").mkdir()
    read(spark, tmp_path / "in", document("a"), document("b"))
    now = incremental.listed(spark, str(tmp_path / "in"), "v1")
    built = now.where(F.col("file").contains("a.json")).unionByName(spark.createDataFrame([("file:/gone.json", "k")], "file string, key string"))
    todo, gone = incremental.changes(now, built)
    assert (todo.count(), gone.count()) == (1, 1) and incremental.changes(incremental.listed(spark, str(tmp_path / "in"), "v2"), built)[0].count() == 2
    seen = []
    build = lambda batch: seen.extend(r.match_id for r in documents.matches(batch).collect())
    for expected in (["a", "b"], ["a", "b"]):
        incremental.stream_documents(spark, str(tmp_path / "in"), str(tmp_path / "cp"), build).awaitTermination()
        assert sorted(seen) == expected
    old = spark.createDataFrame([("a", 1), ("c", 1)], "match_id string, v int")
    new = incremental.replace_matches(old, spark.createDataFrame([("a", 2)], "match_id string, v int"), spark.createDataFrame([("c",)], "match_id string"))
    assert [tuple(r) for r in new.collect()] == [("a", 2)]


def test_leaderboards(spark):
    page = [{"event_window_id": "w", "region": "EU", "entries": [{"rank": 1, "points": 9.0, "accounts": ["A", "b"], "sessions": [{"session_id": "s1", "end_time": "2024-01-02T03:00"}]}, {"rank": 2, "points": 7.0, "accounts": ["a"], "sessions": [{"session_id": "s1", "end_time": "2024-01-02T04:00"}]}]}]
    pages = spark.read.schema(leaderboards.PAGE).json(spark.sparkContext.parallelize([json.dumps(p) for p in page]))
    assert {(r.account_id, r.rank) for r in leaderboards.best_ranks(pages).collect()} == {("a", 1), ("b", 1)}
    m = leaderboards.found_matches(pages).first()
    assert (m.match_id, m.teams, m.session_date) == ("s1", 2, "2024-01-02")
    seen = spark.createDataFrame([("x", "A"), ("x", "b"), ("y", "c"), ("z", "a")], "match_id string, account_id string")
    ranks = spark.createDataFrame([("a", 10.0), ("b", 5000.0)], "account_id string, pr_rank double")
    plan = leaderboards.collection_plan(seen, ranks, spark.createDataFrame([("z",)], "match_id string"))
    assert [tuple(r) for r in plan.collect()] == [("x", 1, 2, 2), ("y", 0, 0, 1)]


def test_detectors_on_the_arena(spark, tiny):
    t = Arena(spark, tiny).tables()
    f = D.fights(t).collect()
    assert all(r.winner in (None, r.a, r.b) for r in f)
    e = D.exchanges(t).groupBy("match_id", "s1", "s2", "exchange").agg(F.sum("dealt").alias("d"), F.sum("taken").alias("k"), F.count("*").alias("n"))
    assert e.where("abs(d - k) > 1e-6 or n <> 2").count() == 0
    snaps = D.snapshots(t, 120.0)
    assert snaps.where("outside_m < 0 or storm_m < 0 or teams_alive < 1 or future_pts < 0").count() == 0 and snaps.groupBy("match_id", "t", "team_index").count().where("count > 1").count() == 0


def test_forecast_finds_a_habit(spark):
    rows = []
    for m in range(24):
        rows += [(m, p, float(1000 * p), 0.0, 10_000.0, float(1000 * (p + 1)), 0.0, 9_000.0 - 10, float(p * 100), float(p * 100 + 40)) for p in range(1, 5)]
    zones = spark.createDataFrame(rows, "match_id long, phase long, cur_x double, cur_y double, cur_r double, next_x double, next_y double, next_r double, start_shrink_t double, finish_shrink_t double")
    from tidemark.sources.documents import zone_features

    got = {r.rung: r.bits for r in M.forecast(zone_features(zones), n=20, k=2).groupBy("rung").agg(F.avg("bits").alias("bits")).collect()}
    assert got["memory"] > 0.5 and got["memory"] >= got["one_step"] - 0.2


def test_studies_do_not_fail_on_the_arena(spark, tiny):
    c = K.Context(Arena(spark, tiny).tables())
    sheet = K.findings(c, ("overview", "zone_check", "height")).collect()
    assert {r.kind for r in sheet} <= {"test", "metric"} and len(sheet) > 5

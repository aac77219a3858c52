"""Parsed match documents into typed tables, all matches at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geometry as G
from tidemark.functions import scalar as S
from tidemark.functions.stats import circular_mean  # noqa: F401  (part of the public surface)
from tidemark.operators.asof import asof_join
from tidemark.operators.spatial import nearest_place, neighbour_pairs
from tidemark.sources.schema import DOCUMENT, schema

ISLAND_HALF_CM = 135_000.0
STILL_CM_S = 300.0
DESCENT_CM = 5_000.0
STILL_SAMPLES = 3
OFF_SPAWN_S = 120.0
EARLY_KILL_S = 180.0
PLACE_M = 400.0


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON file."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True)


def unpacked(docs: DataFrame, packed: str, name: str) -> DataFrame:
    """Rows of a column-packed table, cast to the declared types; a column the file lacks is null."""
    table = F.col(packed)
    rows = docs.select("match_id", table["columns"].alias("_c"), F.explode(table["rows"]).alias("_r"))

    def value(field) -> Column:
        at = F.array_position("_c", F.lit(field.name))
        return F.when(at > 0, F.get("_r", (at - 1).cast("int"))).try_cast(field.dataType).alias(field.name)

    return rows.select("match_id", *(value(f) for f in schema(name) if f.name != "match_id"))


def _at(v: str, k: int) -> Column:
    return F.get(F.col(v), F.lit(k))


def matches(docs: DataFrame, ids: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """``ids`` has what the match list knows, ``meta`` fallback values from the replay's own file."""
    humans = F.filter("players", lambda p: ~F.coalesce(p["is_bot"], F.lit(False)))
    m = docs.select(
        "match_id", "source_file",
        (F.col("replay.length_ms") / 1000.0).alias("length_s"), S.season(F.col("replay.branch")).alias("season"), F.col("replay.branch").alias("branch"),
        *(F.col(f"replay.{c}").alias(c) for c in ("network_version", "changelist", "engine_network_version", "is_encrypted")),
        F.col("replay.timestamp").alias("replay_timestamp"), F.col("replay.platform").alias("recorded_on"),
        *(F.col(f"game.{c}").alias(c) for c in ("playlist", "tournament_round", "max_players", "aircraft_start_t", "safe_zones_start_t", "match_end_t", "winning_team")),
        F.coalesce(F.size("players"), F.lit(0)).cast("bigint").alias("n_players"),
        F.coalesce(F.size(humans), F.lit(0)).cast("bigint").alias("n_humans"),
        F.size(F.array_distinct(F.array_compact(F.transform(humans, lambda p: p["team_index"])))).cast("bigint").alias("n_teams"),
    )
    if meta is not None:
        m = m.join(meta.select("match_id", F.col("network_version").alias("_nv"), F.col("changelist").alias("_cl")), "match_id", "left")
        m = m.withColumn("network_version", F.coalesce("network_version", "_nv")).withColumn("changelist", F.coalesce("changelist", "_cl")).drop("_nv", "_cl")
    return with_list(m, ids) if ids is not None else m


def with_list(m: DataFrame, ids: DataFrame) -> DataFrame:
    """Tournament fields of the match list take precedence; the date is the session's, else the match's own."""
    fields = ("event_window_id", "region", "session_date", "is_server_replay")
    known = ids.select("match_id", *(F.col(c).alias(f"_{c}") for c in fields))
    out = m.join(known, "match_id", "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"_{c}", c) if c in m.columns else F.col(f"_{c}")).drop(f"_{c}")
    own = F.col("match_date") if "match_date" in m.columns else F.substring("replay_timestamp", 1, 10)
    return out.withColumn("match_date", F.coalesce("session_date", own))


def players(docs: DataFrame) -> DataFrame:
    p = docs.select("match_id", F.explode("players").alias("_p")).select("match_id", "_p.*")
    return p.select(
        "match_id", "id", F.lower("player_id").alias("player_id"), "name", "is_bot", "team_index", "placement", "kills", "team_kills", "death_t", "death_cause",
        *(_at("death_location", k).alias(f"death_{c}") for k, c in enumerate("xyz")), "disconnected", "platform", F.col("location_samples_raw").alias("raw_location_samples"),
    )


def teams(docs: DataFrame) -> DataFrame:
    t = docs.select("match_id", F.explode("teams").alias("_t")).select("match_id", "_t.*")
    return t.select(
        "match_id", "team_index", "placement", "team_kills", F.size("player_ids").cast("bigint").alias("n_players"),
        F.array_join(F.col("player_ids").cast("array<string>"), ",").alias("player_ids"),
    )


def kills(docs: DataFrame) -> DataFrame:
    k = docs.select("match_id", F.explode("kill_feed").alias("_k")).select("match_id", "_k.*")
    return k.select("match_id", "t", "victim_id", "finisher_id", "downed", "revived", "distance", "death_cause", *(_at("location", i).alias(c) for i, c in enumerate("xyz")))


def eliminations(docs: DataFrame) -> DataFrame:
    e = docs.select("match_id", F.explode("eliminations").alias("_e")).select("match_id", "_e.*")
    return e.select("match_id", S.clock_seconds(F.col("time")).alias("time_s"), F.lower("eliminated").alias("eliminated"), F.lower("eliminator").alias("eliminator"), "knocked", "gun_type")


def zone_phases(docs: DataFrame) -> DataFrame:
    """One row for each new next circle, numbered from 1. The current circle is the snapshot's last one, else the one before."""
    z = docs.select("match_id", F.posexplode("zones").alias("_i", "_z")).select("match_id", "_i", "_z.*")
    nr, lr, r = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("next_radius", "last_radius", "radius"))
    usable = F.coalesce(F.size("next_center") > 0, F.lit(False)) & (nr > 0)
    key = [F.rint(_at("next_center", 0)), F.rint(_at("next_center", 1)), F.rint(nr)]
    first = F.row_number().over(Window.partitionBy("match_id", usable, *key).orderBy("_i")) == 1
    z = z.withColumn("_usable", usable).withColumn("_kept", usable & first)
    # what later rows fall back on: a kept circle, or a snapshot without one that knows a radius
    known = F.when(F.col("_kept"), nr).when(~F.col("_usable"), F.coalesce(F.when(nr > 0, nr), F.when(r > 0, r)))
    before = Window.partitionBy("match_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    z = z.withColumn("_radius", F.last(known, ignorenulls=True).over(before))
    z = z.withColumn("_centre", F.last(F.when(F.col("_kept"), F.col("next_center")), ignorenulls=True).over(before)).where("_kept")
    own = F.coalesce(F.size("last_center") > 0, F.lit(False)) & (lr > 0)
    radius = F.when(own, lr).otherwise(F.coalesce(F.when(r > 0, r), F.col("_radius")))
    centre = lambda k: F.when(own, _at("last_center", k)).otherwise(_at("_centre", k))
    return z.select(
        "match_id", F.row_number().over(Window.partitionBy("match_id").orderBy("_i")).cast("bigint").alias("phase"),
        centre(0).alias("cur_x"), centre(1).alias("cur_y"), F.when(radius > 0, radius).alias("cur_r"),
        _at("next_center", 0).alias("next_x"), _at("next_center", 1).alias("next_y"), nr.alias("next_r"), "start_shrink_t", "finish_shrink_t",
    )


def zone_features(zones: DataFrame) -> DataFrame:
    """Geometry of each pull: offsets, ratios, kind, u (uniform for a uniform pull), bearing, wait, overlap and type."""
    dx, dy = F.col("next_x") - F.col("cur_x"), F.col("next_y") - F.col("cur_y")
    by = Window.partitionBy("match_id").orderBy("phase")
    z = zones.withColumns({"dx": dx, "dy": dy, "dist": F.sqrt(dx * dx + dy * dy), "allowed": F.col("cur_r") - F.col("next_r")})
    shrinking = F.col("dist") <= F.col("allowed") * 1.01 + 1
    wait = F.round(F.col("start_shrink_t") - F.lag("finish_shrink_t").over(by), 1)
    z = z.withColumns(
        {
            "offset_ratio": F.try_divide("dist", "cur_r"), "shrink_ratio": F.try_divide("next_r", "cur_r"),
            "kind": F.when(F.coalesce(shrinking, F.lit(False)), "shrinking").otherwise("moving"), "angle_deg": G.bearing(F.col("dx"), F.col("dy")),
            "wait_s": wait, "overlap": G.overlap_share(F.col("dist"), F.col("cur_r"), F.col("next_r")),
        }
    )
    share = F.least(F.try_divide("dist", "allowed"), F.lit(1.0))
    kind = (
        F.when(F.col("kind") == "shrinking", "shrinking").when(F.coalesce("wait_s", F.lit(99.0)) <= 1, "moving")
        .when(F.col("dist") < F.col("cur_r") + F.col("next_r"), "50/50").otherwise("shifted")
    )
    return z.withColumn("u", F.when(F.col("kind") == "shrinking", share * share)).withColumn("zone_type", kind).where("dist is not null and cur_r is not null")


def aircraft_bus(docs: DataFrame) -> DataFrame:
    """The route from the first aircraft with a start off the origin and a bearing."""
    b = docs.select("match_id", F.posexplode("bus").alias("_i", "_b")).select("match_id", "_i", "_b.*")
    b = b.where("yaw is not null and (abs(start[0]) > 0 or abs(start[1]) > 0)")
    b = b.withColumn("_n", F.row_number().over(Window.partitionBy("match_id").orderBy("_i"))).where("_n = 1")
    bearing = F.pmod(F.col("yaw"), F.lit(360.0))
    speed = F.coalesce("speed", F.lit(0.0))
    t0 = F.col("flight_start_time")
    lasted = F.coalesce(F.when(F.col("flight_end_time") != 0, F.col("flight_end_time") - t0), "time_till_flight_end", F.lit(0.0))
    along = lambda k, s: _at("start", k) + (F.cos if k == 0 else F.sin)(F.radians(bearing)) * speed * s
    drops = (speed > 0) & t0.isNotNull() & (F.col("drop_start_time") != 0) & (F.col("drop_end_time") != 0)
    return b.select(
        "match_id", F.lit("aircraft").alias("bus_source"), _at("start", 0).alias("start_x"), _at("start", 1).alias("start_y"),
        *(F.when((speed > 0) & (lasted > 0), along(k, lasted)).alias(f"end_{c}") for k, c in enumerate("xy")),
        bearing.alias("bearing_deg"), F.when(speed > 0, speed).alias("speed"),
        *(F.when(drops, along(k, F.col(f"drop_{w}_time") - t0)).alias(f"drop_{w}_{c}") for w in ("start", "end") for k, c in enumerate("xy")),
        t0.alias("flight_start_t"), F.col("drop_start_time").alias("drop_start_t"), F.col("drop_end_time").alias("drop_end_t"),
        F.lit(None).cast("bigint").alias("n_points"), F.lit(0.0).alias("fit_rms"), F.lit(True).alias("direction_known"),
    )


def derived_bus(positions: DataFrame, least: int = 5) -> DataFrame:
    """The principal axis of the players' first skydiving samples, run in the direction in which later players jump."""
    by = Window.partitionBy("match_id", "id").orderBy("t")
    sky = positions.where("skydiving and x is not null and y is not null").withColumn("_n", F.row_number().over(by)).where("_n = 1")
    fit = sky.groupBy("match_id").agg(
        F.count("*").alias("n_points"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"),
        F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_c"),
    ).withColumn("_a", 0.5 * F.atan2(2 * F.col("_c"), F.col("_vx") - F.col("_vy")))
    ux, uy = F.cos("_a"), F.sin("_a")
    along = (F.col("x") - F.col("_mx")) * ux + (F.col("y") - F.col("_my")) * uy
    across = (F.col("y") - F.col("_my")) * ux - (F.col("x") - F.col("_mx")) * uy
    p = sky.select("match_id", "t", "x", "y").join(fit, "match_id").withColumns({"_p": along, "_q": across})
    s = p.groupBy("match_id", "n_points", "_mx", "_my", "_a").agg(
        F.min("_p").alias("_lo"), F.max("_p").alias("_hi"), F.sqrt(F.avg(F.col("_q") ** 2)).alias("fit_rms"), F.covar_pop("_p", "t").alias("_ct"), F.stddev_pop("t").alias("_st")
    )
    known = (F.col("_st") > 0) & (F.abs("_ct") > 1e-9)
    sign = F.when(known & (F.col("_ct") < 0), -1.0).otherwise(1.0)
    from_ = F.when(sign < 0, F.col("_hi")).otherwise(F.col("_lo"))
    to = F.when(sign < 0, F.col("_lo")).otherwise(F.col("_hi"))
    enough = F.col("n_points") >= least
    return s.select(
        "match_id", F.when(enough, "derived_skydive").otherwise("none").alias("bus_source"),
        *(F.when(enough, F.col(f"_m{c}") + u * e).alias(f"{n}_{c}") for n, e in (("start", from_), ("end", to)) for c, u in (("x", ux), ("y", uy))),
        F.when(enough, G.bearing(sign * ux, sign * uy)).alias("bearing_deg"), "n_points", F.when(enough, F.col("fit_rms")).alias("fit_rms"), (enough & known).alias("direction_known"),
    )


def bus(docs: DataFrame, positions: DataFrame) -> DataFrame:
    flown = aircraft_bus(docs)
    rest = derived_bus(positions.join(flown.select("match_id"), "match_id", "left_anti"))
    return flown.unionByName(rest, allowMissingColumns=True)


def inferred_winners(players_: DataFrame, positions: DataFrame, matches_: DataFrame) -> DataFrame:
    """``placement`` 1 and ``placement_inferred`` for the one human still there at the end of a match without a winner."""
    last = positions.groupBy("match_id", "id").agg(F.max("t").alias("_seen"))
    over = Window.partitionBy("match_id")
    p = players_.join(last, ["match_id", "id"], "left").join(matches_.select("match_id", F.col("match_end_t").alias("_end")), "match_id", "left")
    end = F.greatest(F.max("_seen").over(over), F.col("_end"))
    human = ~F.coalesce(F.col("is_bot"), F.lit(False))
    p = p.withColumn("_e", end).withColumn("_won", F.max(F.when(human & (F.col("placement") == 1), 1).otherwise(0)).over(over))
    there = human & F.col("placement").isNull() & (F.col("death_t").isNull() | (F.col("death_t") >= F.col("_e") - 5)) & F.coalesce(F.col("_seen") >= F.col("_e") - 30, F.lit(False))
    p = p.withColumn("_there", there).withColumn("_n", F.count_if("_there").over(over))
    new = (F.col("_won") == 0) & F.col("_there") & (F.col("_n") == 1)
    return p.withColumn("placement_inferred", F.coalesce(new, F.lit(False))).withColumn("placement", F.when(F.col("placement_inferred"), 1).otherwise(F.col("placement")).cast("bigint")).drop("_seen", "_end", "_e", "_won", "_there", "_n")


def team_placements(players_: DataFrame) -> DataFrame:
    """``team_placement``: the best placement of the team's members."""
    best = F.min("placement").over(Window.partitionBy("match_id", "team_index"))
    return players_.withColumn("team_placement", F.when(F.col("team_index").isNotNull(), best).otherwise(F.col("placement")))


def landings(positions: DataFrame, players_: DataFrame, bus_: DataFrame, zones: DataFrame, kills_: DataFrame, matches_: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Where each human lands, who lands near, and what follows."""
    key = ["match_id", "id"]
    off = (F.abs("x") > ISLAND_HALF_CM) | (F.abs("y") > ISLAND_HALF_CM)
    p = positions.where("t is not null and x is not null and y is not null and z is not null").join(bus_.select("match_id", "flight_start_t"), "match_id", "left")
    p = p.withColumn("_off", off).withColumn("_left", F.max(F.when(F.col("_off"), F.col("t"))).over(Window.partitionBy(*key)))
    start = F.greatest("flight_start_t", "_left")
    p = p.where(~F.col("_off") & (start.isNull() | (F.col("t") > start)))
    by = Window.partitionBy(*key).orderBy("t")
    derived = F.try_divide(F.col("z") - F.lag("z").over(by), F.col("t") - F.lag("t").over(by))
    p = p.withColumn("_vz", F.coalesce("vz", derived)).withColumn("_z0", F.first("z").over(by)).withColumn("_t0", F.first("t").over(by))
    still = F.lit(True)
    for k in range(STILL_SAMPLES):
        still = still & F.coalesce(F.abs(F.lead("_vz", k).over(by) if k else F.col("_vz")) < STILL_CM_S, F.lit(False))
    down = p.withColumn("_ok", still & (F.col("z") < F.col("_z0") - DESCENT_CM)).where("_ok")
    land = down.groupBy(*key).agg(F.min("t").alias("land_t"), *(F.min_by(c, "t").alias(f"land_{c}") for c in "xyz"), F.min("_t0").alias("jump_t"))
    land = land.withColumn("glide_s", F.col("land_t") - F.col("jump_t"))
    own = players_.where(~F.coalesce("is_bot", F.lit(False))).select(*key, "team_index", "death_t", "placement", "kills", "team_placement", "pr_rank")
    land = land.join(own, key)
    # contest
    pts = land.select("match_id", "id", "team_index", F.col("land_x").alias("x"), F.col("land_y").alias("y"))
    strong = land.select("match_id", F.col("id").alias("other"), (F.coalesce("pr_rank", F.lit(1e9)) <= 1000).alias("_strong"))
    near = neighbour_pairs(pts, ["match_id"], "id", 300.0, "team_index").join(strong, ["match_id", "other"])
    met = near.groupBy(*key).agg(F.count_if(F.col("dist_m") <= 150).alias("opp_150m"), F.count("*").alias("opp_300m"), F.count_if("_strong").alias("opp_top1000_300m"))
    a = pts.withColumnsRenamed({"x": "_x", "y": "_y", "id": "_id", "team_index": "_team"})
    closest = pts.join(a, "match_id").where("team_index <> _team").groupBy(*key).agg(F.min(G.distance_m(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))).alias("nearest_opp_m"))
    land = land.join(met, key, "left").fillna(0, subset=["opp_150m", "opp_300m", "opp_top1000_300m"]).join(closest, key, "left")
    # route and circles
    b = bus_.select("match_id", "start_x", "start_y", "bearing_deg", (F.col("bus_source") == "aircraft").alias("_flown"))
    dx, dy = F.col("land_x") - F.col("start_x"), F.col("land_y") - F.col("start_y")
    ux, uy = F.cos(F.radians("bearing_deg")), F.sin(F.radians("bearing_deg"))
    land = land.join(b, "match_id", "left").withColumns(
        {"bus_offset_m": F.when(F.col("_flown"), F.abs(dx * uy - dy * ux) / 100), "bus_along_m": F.when(F.col("_flown"), (dx * ux + dy * uy) / 100)}
    ).drop("start_x", "start_y", "bearing_deg", "_flown")
    for phase in (1, 2):
        c = zones.where(F.col("phase") == phase).groupBy("match_id").agg(*(F.first(f"next_{k}").alias(f"_{k}") for k in "xyr"))
        d = G.distance_m(F.col("land_x"), F.col("land_y"), F.col("_x"), F.col("_y")) - F.col("_r") / 100
        land = land.join(c, "match_id", "left").withColumn(f"outside_zone{phase}_m", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))).drop("_x", "_y", "_r")
    # places of the newest season's map
    if places is not None and matches_ is not None:
        newest = matches_.agg(F.max("season").alias("_new"))
        season = matches_.select("match_id", "season").crossJoin(F.broadcast(newest)).select("match_id", (F.col("season") == F.col("_new")).alias("_now"))
        named = nearest_place(land.select("match_id", "id", F.col("land_x").alias("x"), F.col("land_y").alias("y")), places, PLACE_M).select(*key, "place", "place_m")
        land = land.join(named, key, "left").join(season, "match_id", "left")
        land = land.withColumn("poi", F.when(F.col("_now"), F.col("place"))).withColumn("poi_m", F.when(F.col("_now"), F.col("place_m"))).drop("place", "place_m", "_now")
    else:
        land = land.withColumns({"poi": F.lit(None).cast("string"), "poi_m": F.lit(None).cast("double")})
    # what came next
    early = kills_.where("finisher_id <> victim_id").select("match_id", F.col("finisher_id").alias("id"), F.col("t").alias("_kt"))
    early = early.join(land.select(*key, "land_t"), key).where(F.col("_kt") <= F.col("land_t") + EARLY_KILL_S).groupBy(*key).agg(F.count("*").alias("early_kills"))
    return land.join(early, key, "left").fillna(0, subset=["early_kills"]).withColumns(
        {"off_spawn": F.coalesce(F.col("death_t") - F.col("land_t") <= OFF_SPAWN_S, F.lit(False)), "final": F.coalesce("team_placement", "placement")}
    )


def rated_players(players_: DataFrame, rankings: DataFrame | None, ranks: DataFrame | None, matches_: DataFrame) -> DataFrame:
    """pr_rank and pr_score by account, and leaderboard rank and points by account and window."""
    p = players_.drop("pr_rank", "pr_score", "leaderboard_rank", "leaderboard_points")
    if rankings is not None:
        p = p.join(rankings.withColumnRenamed("account_id", "player_id"), "player_id", "left")
    if ranks is not None:
        windows = matches_.select("match_id", "event_window_id")
        r = ranks.select("event_window_id", F.col("account_id").alias("player_id"), F.col("rank").alias("leaderboard_rank"), F.col("points").alias("leaderboard_points"))
        p = p.join(windows, "match_id", "left").join(r, ["event_window_id", "player_id"], "left").drop("event_window_id")
    return p


def lobby_strength(players_: DataFrame) -> DataFrame:
    """Per match the shares of ranked players of either kind, and the strength with its source."""
    p = players_.where(~F.coalesce("is_bot", F.lit(False)))
    share = lambda c, most=None: F.avg((F.col(c).isNotNull() if most is None else F.coalesce(F.col(c) <= most, F.lit(False))).cast("double"))
    s = p.groupBy("match_id").agg(
        share("pr_rank", 1000).alias("lobby_pr_top1000"), share("pr_rank").alias("lobby_pr_share"), F.avg("pr_score").alias("lobby_pr_mean"),
        F.count("leaderboard_rank").alias("lobby_ranked"), *(share("leaderboard_rank", n).alias(f"lobby_top{n}") for n in (100, 500, 1000)), F.median("leaderboard_rank").alias("lobby_median_rank"),
    )
    by_pr = F.when(F.col("lobby_pr_share") > 0, F.col("lobby_pr_top1000"))
    by_board = F.when(F.col("lobby_ranked") > 0, F.col("lobby_top1000"))
    return s.withColumn("lobby_strength", F.coalesce(by_pr, by_board)).withColumn(
        "lobby_strength_source", F.when(by_pr.isNotNull(), "power_rankings").when(by_board.isNotNull(), "leaderboard")
    )


def health_slots(attributes: DataFrame, hits: DataFrame, least_rate: float = 0.5) -> DataFrame:
    """(match_id, shield_hit, handle): the slot that drops most often around a player's hits of that kind.

    A slot drops at a hit where its value one second after is below that 0.05 s before.
    """
    h = hits.where("target_kind = 'player'").select("match_id", F.col("target_id").alias("id"), "t", F.coalesce("shield_hit", F.lit(False)).alias("shield_hit"))
    slots = attributes.select("match_id", "handle").distinct()
    probe = h.join(slots, "match_id").withColumns({"_a": F.col("t") - 0.05, "_b": F.col("t") + 1.0})
    keys = ["match_id", "id", "handle"]
    one = asof_join(probe, attributes, keys, ["value"], time="_a", right_time="t", how="left", prefix="a_")
    two = asof_join(one, attributes, keys, ["value"], time="_b", right_time="t", how="left", prefix="b_")
    rate = F.avg(F.when(F.col("a_value").isNotNull() & F.col("b_value").isNotNull(), (F.col("b_value") < F.col("a_value")).cast("double")))
    rates = two.groupBy("match_id", "shield_hit", "handle").agg(rate.alias("rate"), F.count("a_value").alias("n")).where(F.col("rate") >= least_rate)
    by = Window.partitionBy("match_id", "shield_hit").orderBy(F.desc("rate"), F.desc("n"), "handle")
    return rates.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("match_id", "shield_hit", "handle", "rate")


def rebuilt_health(attributes: DataFrame, slots: DataFrame) -> DataFrame:
    """(match_id, t, id, health, shield) from the chosen slots, each carried forward; slot 0 is health where none was found."""
    chosen = slots.select("match_id", "handle", F.when(F.col("shield_hit"), "shield").otherwise("health").alias("_of"))
    lacking = attributes.select("match_id").distinct().join(chosen.where("_of = 'health'").select("match_id"), "match_id", "left_anti")
    chosen = chosen.unionByName(lacking.select("match_id", F.lit(0).cast("bigint").alias("handle"), F.lit("health").alias("_of")))
    wide = attributes.join(chosen, ["match_id", "handle"]).groupBy("match_id", "id", "t").pivot("_of", ["health", "shield"]).agg(F.max("value"))
    by = Window.partitionBy("match_id", "id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    held = lambda c: F.last(c, ignorenulls=True).over(by)
    return wide.select("match_id", "t", "id", *(F.when(held(c) < 0, 0.0).otherwise(held(c)).alias(c) for c in ("health", "shield")))


def nearest_actor(events: DataFrame, positions: DataFrame, players_: DataFrame, ident: list[str], time: str, age_s: float = 3.0, reach_m: float = 3.0) -> DataFrame:
    """The events with ``actor``: the living human nearest to them, seen at most ``age_s`` before and within reach."""
    alive = players_.where(~F.coalesce("is_bot", F.lit(False))).select("match_id", "id", "death_t")
    probe = events.select("match_id", *ident, F.col(time).alias("_t"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
    each = probe.join(alive, "match_id").where("death_t is null or death_t > _t")
    seen = asof_join(each, positions, ["match_id", "id"], ["x", "y", "z"], time="_t", right_time="t", tolerance=age_s)
    d2 = (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 + (F.col("z") - F.col("_z")) ** 2
    best = seen.where(d2 <= (reach_m * 100) ** 2).groupBy("match_id", *ident).agg(F.min_by("id", F.struct(d2.alias("d"), "id")).alias("actor"))
    return events.join(best, ["match_id", *ident], "left")


def located(events: DataFrame, positions: DataFrame, actor: str = "searched_by") -> DataFrame:
    """Events without a place get their actor's last position."""
    lacking = events.withColumn("id", F.col(actor))
    j = asof_join(lacking, positions.select("match_id", "id", "t", *(F.col(c).alias(f"_{c}") for c in "xyz")), ["match_id", "id"], ["_x", "_y", "_z"], how="left")
    return j.select(*(F.coalesce(c, f"_{c}").alias(c) if c in ("x", "y", "z") else F.col(c) for c in events.columns))


def classified(events: DataFrame, item: str) -> DataFrame:
    return events.withColumns({"category": S.item_category(F.col(item)), "rarity": S.item_rarity(F.col(item))})

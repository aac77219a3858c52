"""Queries of the sources: documents, leaderboards, checks and labels over the given tables, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import points as P
from tidemark.functions import scalar as S
from tidemark.functions import stats as T
from tidemark.operators import selection as L
from tidemark.plans import detect as D
from tidemark.plans.operator_queries import MARGIN, r6
from tidemark.plans.study_queries import SURGE_SQL
from tidemark.sources import catalog, checks, documents, leaderboards
from tidemark.sources.arena import ARENA_SQL, Arena

QUERIES, ORACLES = {}, {}


def registered(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Arena(spark, sf_dir))
        ORACLES[name] = f"WITH {ARENA_SQL}{'' if sql.lstrip()[:6].upper() == 'SELECT' else ', '}{sql}"
        return f

    return add


def one_of(values, number: str):
    """The value that a row's number picks."""
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(number) % len(values) + 1).cast("int"))


def sql_one_of(values, number: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({number}) % {len(values)} + 1]"


# ---- labels -----------------------------------------------------------------------------------------------------

ITEMS = (
    "/Items/WID_Shotgun_Auto_Athena_UC_Ore_T02.WID_Shotgun_Auto_Athena_UC_Ore_T02", "/Items/Ammo/AmmoDataShells", "WID_Assault_Suppressed_Athena_SR_Ore_T03", "/Items/Shields",
    "WoodItemData", "/Items/WID_Harvest_Pickaxe_T01", "BuildingItemData_Wall", "WID_Sniper_Heavy_Athena_VR", "AGID_Chug_Splash", "MyWid_Thing", "WID_Launcher_Rocket_Athena_R_T04", "Keycard_T05", "WID_Pistol_SMG_Athena_C",
)
BRANCHES = ("++x+Release-30.10", "++x+Release-31.40-CL", "Main", "Release-", "++x+Release-9.0")
KINDS = ("PBWA_W1_Solid_C", "PBWA_S1_Floor", "PBWA_M1_Stair", "PBWA_X1", "Wall")


def _first_word_sql(name: str, table, otherwise: str) -> str:
    test = lambda w: f"starts_with(lower({name}), '{w[1:]}')" if w.startswith("^") else f"contains(lower({name}), '{w}')"
    return "CASE " + " ".join(f"WHEN {test(w)} THEN '{label}'" for w, label in table) + f" ELSE {otherwise} END"


@registered(
    "item_labels",
    f"""i AS (SELECT {sql_one_of(ITEMS, 'l_partkey')} AS item FROM lineitem), n AS (SELECT item, split_part(split_part(item, '/', -1), '.', -1) AS name FROM i),
    c AS (SELECT item, name, {_first_word_sql('name', S.CATEGORIES, "'other'")} AS category, coalesce({_first_word_sql("(name || '_')", S.RARITY_MARKS, 'NULL')},
      [{', '.join(repr(r) for r in S.RARITIES)}][try_cast(nullif(regexp_extract(lower(name), '_t0?([1-5])\\b', 1), '') AS INT)]) AS rarity,
      {_first_word_sql('item', S.WEAPON_CLASSES, "'other weapon'")} AS weapon_class FROM n)
    SELECT item, category, rarity, weapon_class, list_position([{', '.join(repr(r) for r in S.RARITIES)}], rarity) AS rank, count(*) AS n FROM c GROUP BY ALL""",
)
def item_labels(a: Arena) -> DataFrame:
    """B-17, B-18, X-16: an item's category, rarity, rank and weapon class from its path."""
    # an item's words are looked for once, not in every row that names it
    i = documents.classified(a.table("lineitem").groupBy(one_of(ITEMS, "l_partkey").alias("item")).agg(F.count("*").alias("n")), "item")
    i = i.withColumns({"weapon_class": S.weapon_class(F.col("item")), "rank": S.rarity_rank(F.col("rarity"))})
    return i.select("item", "category", "rarity", "weapon_class", "rank", "n")


@registered(
    "readable_weapons",
    f"""w AS (SELECT {sql_one_of(tuple(x for x in ITEMS if x.startswith('WID')), 'l_partkey')} AS weapon FROM lineitem)
    SELECT weapon, coalesce(nullif(array_to_string(list_filter(string_split(weapon, '_'), lambda x: length(x) > 0 AND x NOT IN ({', '.join(repr(x) for x in S.WEAPON_ID_PARTS)}) AND NOT starts_with(x, 'T0'))[1:3], ' '), ''), weapon) AS name, count(*) AS n FROM w GROUP BY ALL""",
)
def readable_weapons(a: Arena) -> DataFrame:
    """B-19."""
    w = a.table("lineitem").select(one_of(tuple(x for x in ITEMS if x.startswith("WID")), "l_partkey").alias("weapon"))
    return w.groupBy("weapon", S.readable_weapon(F.col("weapon")).alias("name")).agg(F.count("*").alias("n"))


@registered(
    "builds_and_targets",
    f"""b AS (SELECT {sql_one_of(KINDS, 'l_suppkey')} AS kind, CASE WHEN l_partkey % 3 < 2 THEN l_partkey % 3 = 0 END AS is_player, CASE WHEN l_orderkey % 3 < 2 THEN l_orderkey % 3 = 0 END AS is_build FROM lineitem)
    SELECT CASE regexp_extract(kind, 'PBWA_([WSM])[0-9]', 1) WHEN 'W' THEN 'wood' WHEN 'S' THEN 'stone' WHEN 'M' THEN 'metal' END AS material,
      CASE WHEN is_player THEN 'player' WHEN is_build THEN 'build' ELSE 'object' END AS target, count(*) AS n FROM b GROUP BY ALL""",
)
def builds_and_targets(a: Arena) -> DataFrame:
    """B-20, B-25."""
    some = lambda c: F.when(F.col(c) % 3 < 2, F.col(c) % 3 == 0)
    b = a.table("lineitem").select(S.build_material(one_of(KINDS, "l_suppkey")).alias("material"), S.target_kind(some("l_partkey"), some("l_orderkey")).alias("target"))
    return b.groupBy("material", "target").agg(F.count("*").alias("n"))


@registered(
    "season_labels",
    f"""b AS (SELECT {sql_one_of(BRANCHES, 'o_custkey')} AS branch FROM orders)
    SELECT branch, coalesce('v' || nullif(regexp_extract(branch, 'Release-([0-9]+\\.[0-9]+)', 1), ''), branch) AS season, count(*) AS n FROM b GROUP BY ALL""",
)
def season_labels(a: Arena) -> DataFrame:
    """B-02."""
    b = a.table("orders").select(one_of(BRANCHES, "o_custkey").alias("branch"))
    return b.groupBy("branch", S.season(F.col("branch")).alias("season")).agg(F.count("*").alias("n"))


@registered(
    "evidence_words",
    """p AS (SELECT CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_custkey % 700 AS DOUBLE) / 10000 END AS p, CAST(o_orderkey % 11 AS DOUBLE) / 10 - 0.5 AS effect FROM orders)
    SELECT CASE WHEN p < 0.001 THEN 'strong' WHEN p < 0.01 THEN 'clear' WHEN p < 0.05 THEN 'weak' ELSE 'none' END AS strength,
      CASE WHEN p IS NULL THEN 'Too few' WHEN p < 0.05 AND abs(effect) >= 0.3 THEN 'Divergent' WHEN p < 0.05 THEN 'Slight' ELSE 'Similar' END AS verdict, count(*) AS n FROM p GROUP BY ALL""",
)
def evidence_words(a: Arena) -> DataFrame:
    """X-17."""
    p = a.table("orders").select(
        F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_custkey") % 700).cast("double") / 10000).alias("p"), ((F.col("o_orderkey") % 11).cast("double") / 10 - 0.5).alias("effect")
    )
    return p.groupBy(S.strength(F.col("p")).alias("strength"), S.verdict(F.col("p"), F.col("effect")).alias("verdict")).agg(F.count("*").alias("n"))


# ---- geometry ---------------------------------------------------------------------------------------------------


@registered(
    "circle_overlaps",
    """z AS (SELECT match_id, phase, cur_r AS a, next_r AS b, sqrt(pow(next_x - cur_x, 2) + pow(next_y - cur_y, 2)) AS d FROM phases)
    SELECT match_id, phase, round(CASE WHEN d >= a + b THEN 0 WHEN d <= abs(a - b) THEN 1 ELSE
      (b * b * acos((d * d + b * b - a * a) / (2 * d * b)) + a * a * acos((d * d + a * a - b * b) / (2 * d * a)) - sqrt((-d + a + b) * (d + a - b) * (d - a + b) * (d + a + b)) / 2)
      / (pi() * least(a, b) * least(a, b)) END, 3) AS overlap FROM z""",
)
def circle_overlaps(a: Arena) -> DataFrame:
    """B-05."""
    d = F.sqrt((F.col("next_x") - F.col("cur_x")) ** 2 + (F.col("next_y") - F.col("cur_y")) ** 2)
    return a.phases.select("match_id", "phase", G.overlap_share(d, F.col("cur_r"), F.col("next_r")).alias("overlap"))


@registered(
    "pull_frames",
    """z AS (SELECT match_id, phase, next_x - cur_x AS dx, next_y - cur_y AS dy, cur_r FROM phases),
    w AS (SELECT *, lag(atan2(dy, dx)) OVER (PARTITION BY match_id ORDER BY phase) AS b FROM z)
    SELECT phase, count(b) AS n, round(avg((dx * cos(b) + dy * sin(b)) / cur_r), 6) + 0.0 AS along, round(avg((dy * cos(b) - dx * sin(b)) / cur_r), 6) + 0.0 AS across FROM w GROUP BY phase""",
)
def pull_frames(a: Arena) -> DataFrame:
    """X-04: each pull in the frame of the one before, by radius."""
    from pyspark.sql.window import Window

    z = a.phases.select("match_id", "phase", (F.col("next_x") - F.col("cur_x")).alias("dx"), (F.col("next_y") - F.col("cur_y")).alias("dy"), "cur_r")
    z = z.withColumn("b", F.lag(G.bearing(F.col("dx"), F.col("dy"))).over(Window.partitionBy("match_id").orderBy("phase")))
    along, across = G.rotated(F.col("dx"), F.col("dy"), F.col("b"))
    return z.groupBy("phase").agg(F.count("b").alias("n"), r6(F.avg(along / F.col("cur_r")), "along"), r6(F.avg(across / F.col("cur_r")), "across"))


@registered(
    "ways_in",
    """k AS (SELECT k.match_id, k.x, k.y, p.next_x AS cx, p.next_y AS cy, p.next_r AS r, sqrt(pow(k.x - p.next_x, 2) + pow(k.y - p.next_y, 2)) AS d FROM kills k JOIN phases p ON p.match_id = k.match_id AND p.phase = 2),
    e AS (SELECT *, CASE WHEN d > r THEN r / d ELSE 1 END AS s FROM k)
    SELECT match_id, count(*) AS n, count(*) FILTER (s < 1) AS outside, round(avg(sqrt(pow(x - (cx + (x - cx) * s), 2) + pow(y - (cy + (y - cy) * s), 2)) / 100), 4) AS way_m FROM e GROUP BY match_id""",
)
def ways_in(a: Arena) -> DataFrame:
    """X-07: the nearest point of a circle's edge."""
    k = a.kills.join(a.phases.where("phase = 2").select("match_id", "next_x", "next_y", "next_r"), "match_id")
    ex, ey = G.way_in(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y"), F.col("next_r"))
    k = k.withColumn("m", G.distance_m(F.col("x"), F.col("y"), ex, ey))
    return k.groupBy("match_id").agg(F.count("*").alias("n"), F.count_if(F.sqrt((F.col("x") - F.col("next_x")) ** 2 + (F.col("y") - F.col("next_y")) ** 2) > F.col("next_r")).alias("outside"), r6(F.avg("m"), "way_m", 4))


@registered(
    "pull_features",
    """z AS (SELECT *, next_x - cur_x AS dx, next_y - cur_y AS dy, sqrt(pow(next_x - cur_x, 2) + pow(next_y - cur_y, 2)) AS dist, cur_r - next_r AS allowed,
      round(start_shrink_t - lag(finish_shrink_t) OVER (PARTITION BY match_id ORDER BY phase), 1) AS wait FROM phases),
    k AS (SELECT *, CASE WHEN dist <= allowed * 1.01 + 1 THEN 'shrinking' ELSE 'moving' END AS kind FROM z)
    SELECT match_id, phase, round(dx, 2) + 0.0 AS dx, round(dy, 2) + 0.0 AS dy, round(dist, 2) AS dist, round(dist / cur_r, 6) AS offset_ratio, round(next_r / cur_r, 6) AS shrink_ratio, round(allowed, 2) AS allowed, kind,
      round(CASE WHEN kind = 'shrinking' THEN pow(least(dist / allowed, 1), 2) END, 6) AS u, round(((degrees(atan2(dy, dx)) % 360) + 360) % 360, 6) AS angle_deg, wait AS wait_s,
      CASE WHEN kind = 'shrinking' THEN 'shrinking' WHEN coalesce(wait, 99) <= 1 THEN 'moving' WHEN dist < cur_r + next_r THEN '50/50' ELSE 'shifted' END AS zone_type FROM k""",
)
def pull_features(a: Arena) -> DataFrame:
    """B-06, D-13."""
    p = D.pulls(a.tables())
    return p.select(
        "match_id", "phase", r6("dx", "dx", 2), r6("dy", "dy", 2), r6("dist", "dist", 2), r6("offset_ratio", "offset_ratio"), r6("shrink_ratio", "shrink_ratio"), r6("allowed", "allowed", 2), "kind",
        r6("u", "u"), r6("angle_deg", "angle_deg"), "wait_s", "zone_type",
    )


# ---- schemes ----------------------------------------------------------------------------------------------------

_SCHEME_SQL = """s AS (SELECT row_number() OVER (ORDER BY n DESC, k) + (CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) * 0 AS place, CAST(n AS BIGINT) - 20 AS points, 4 AS elimination FROM (SELECT c_nationkey AS k, count(*) // 10 * 10 AS n FROM customer GROUP BY 1))"""


def _scheme(a: Arena) -> DataFrame:
    """A scheme of points by place: nations by their customers, in tens."""
    n = a.table("customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.floor(F.count("*") / 10) * 10).alias("n"))  # one row for each nation
    from pyspark.sql.window import Window

    return n.select(F.row_number().over(Window.orderBy(F.desc("n"), "k")).cast("bigint").alias("place"), (F.col("n") - 20).alias("points"), F.lit(4).alias("elimination"))


@registered(
    "scheme_problems",
    f"""{_SCHEME_SQL}, o AS (SELECT place + CASE WHEN place > 5 THEN 1 ELSE 0 END AS place, CASE WHEN place = 3 THEN points + 50 ELSE points END AS points FROM s),
    l AS (SELECT *, lag(place) OVER (ORDER BY place) AS p, lag(points) OVER (ORDER BY place) AS v FROM o)
    SELECT DISTINCT unnest(list_filter([CASE WHEN p IS NULL AND place <> 1 THEN 'not from 1st' END, CASE WHEN place - p <> 1 THEN 'gap' END, CASE WHEN points > v THEN 'rises' END, CASE WHEN points < 0 THEN 'negative' END], lambda x: x IS NOT NULL)) AS problem FROM l""",
)
def scheme_problems(a: Arena) -> DataFrame:
    """X-14."""
    s = _scheme(a)
    place, points = F.col("place"), F.col("points")
    return P.problems(s.select((place + F.when(place > 5, 1).otherwise(0)).alias("place"), F.when(place == 3, points + 50).otherwise(points).alias("points"), "elimination"))


@registered(
    "place_exchange",
    f"""{_SCHEME_SQL}, d AS (SELECT place, elimination, points - coalesce(lead(points) OVER (ORDER BY place), 0) AS step FROM s),
    r AS (SELECT *, sum(CASE WHEN step = q THEN 0 ELSE 1 END) OVER (ORDER BY place) AS run FROM (SELECT *, coalesce(lag(step) OVER (ORDER BY place), -1) AS q FROM d))
    SELECT step, min(place) AS first, max(place) + 1 AS last, round(4.0 / nullif(step, 0), 6) AS places_per_elimination FROM r GROUP BY run, step""",
)
def place_exchange(a: Arena) -> DataFrame:
    """X-15."""
    return P.exchange(_scheme(a)).select("step", "first", "last", r6("places_per_elimination", "places_per_elimination"))


# ---- documents --------------------------------------------------------------------------------------------------


def match_documents(a: Arena) -> DataFrame:
    """Parsed match documents of the arena: one nested row for each match."""
    p = a.players.groupBy("match_id").agg(
        F.collect_list(
            F.struct(
                "id", F.concat(F.lit("ACC"), F.col("id").cast("string")).alias("player_id"), F.lit(None).cast("string").alias("name"), "is_bot", "team_index", "placement", "kills", F.lit(None).cast("bigint").alias("team_kills"), "death_t",
                F.lit(None).cast("int").alias("death_cause"), F.array(F.col("id") * 1.0, F.col("id") * 2.0, F.lit(0.0)).alias("death_location"), F.lit(False).alias("disconnected"), F.lit("pc").alias("platform"), F.lit(1).cast("bigint").alias("location_samples_raw"),
            )
        ).alias("players")
    )
    # each circle is seen twice, and once more without a next one
    seen = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    z = a.phases.withColumn("_k", seen).withColumn("_none", F.col("_k") == 2)
    known = lambda c, then: F.when(~F.col("_none"), then).alias(c)
    z = z.select(
        "match_id",
        F.struct(
            (F.col("phase") * 3 + F.col("_k")).alias("seq"), F.col("cur_r").alias("radius"), "start_shrink_t", "finish_shrink_t",
            known("last_center", F.when(F.col("phase") % 2 == 1, F.array("cur_x", "cur_y"))), known("last_radius", F.when(F.col("phase") % 2 == 1, F.col("cur_r"))),
            known("next_center", F.array("next_x", "next_y")), known("next_radius", F.col("next_r")),
        ).alias("_z"),
    )
    z = z.groupBy("match_id").agg(F.array_sort(F.collect_list("_z")).alias("zones"))
    k = a.kills.groupBy("match_id").agg(
        F.collect_list(
            F.struct("t", "victim_id", "finisher_id", F.lit(False).alias("downed"), F.lit(False).alias("revived"), F.lit(1.0).alias("distance"), F.lit(0).alias("death_cause"), F.array("x", "y", F.col("z").cast("double")).alias("location"))
        ).alias("kill_feed"),
        F.collect_list(
            F.struct(S.clock(F.col("t")).alias("time"), F.concat(F.lit("ACC"), F.col("victim_id").cast("string")).alias("eliminated"), F.concat(F.lit("ACC"), F.col("finisher_id").cast("string")).alias("eliminator"), F.lit(False).alias("knocked"), F.lit(0).alias("gun_type"))
        ).alias("eliminations"),
    )
    t = a.players.groupBy("match_id", "team_index").agg(F.min("placement").alias("placement"), F.sum("kills").alias("team_kills"), F.array_sort(F.collect_list("id")).alias("player_ids"))
    t = t.groupBy("match_id").agg(F.collect_list(F.struct("team_index", "placement", "team_kills", "player_ids")).alias("teams"))
    bus = F.when(
        F.col("match_id") % 3 != 0,
        F.array(
            F.struct(
                F.array(F.col("match_id") * -1000.0, F.lit(50000.0)).alias("start"), (F.col("match_id") * 15.0 - 90.0).alias("yaw"), F.lit(7500.0).alias("speed"), F.lit(30.0).alias("time_till_flight_end"),
                F.lit(10.0).alias("flight_start_time"), F.lit(0.0).alias("flight_end_time"), F.lit(15.0).alias("drop_start_time"), F.lit(35.0).alias("drop_end_time"),
            )
        ),
    )
    m = a.matches.select(
        "match_id", F.concat(F.lit("m"), F.col("match_id").cast("string"), F.lit(".json")).alias("source_file"),
        F.struct(
            (F.col("length_s") * 1000).cast("bigint").alias("length_ms"), F.lit(19).cast("bigint").alias("network_version"), F.lit(None).cast("bigint").alias("changelist"), F.lit(None).cast("bigint").alias("engine_network_version"),
            F.lit(False).alias("is_encrypted"), F.concat(F.lit("++x+Release-"), F.substring("season", 2, 9), F.lit(".10")).alias("branch"), F.concat("match_date", F.lit("T10:00:00")).alias("timestamp"), F.lit("srv").alias("platform"),
        ).alias("replay"),
        F.struct(
            "playlist", F.lit(1).alias("tournament_round"), F.lit(60).alias("max_players"), F.lit(10.0).alias("aircraft_start_t"), F.lit(60.0).alias("safe_zones_start_t"), F.col("length_s").alias("match_end_t"), F.lit(None).cast("bigint").alias("winning_team")
        ).alias("game"),
        bus.alias("bus"),
    )
    return m.join(p, "match_id").join(z, "match_id").join(k, "match_id", "left").join(t, "match_id")


@registered(
    "document_matches",
    """p AS (SELECT match_id, count(*) AS n_players, count(*) FILTER (NOT is_bot) AS n_humans, count(DISTINCT team_index) FILTER (NOT is_bot) AS n_teams FROM players GROUP BY ALL),
    l AS (SELECT match_id, 'w' || match_id AS w, CASE WHEN match_id % 3 = 0 THEN '2024-02-0' || (match_id % 9 + 1) END AS d FROM matches WHERE match_id % 2 = 0)
    SELECT match_id, p.n_players, n_humans, n_teams, season || '.10' AS season, round(length_s, 3) AS length_s, CAST(19 AS BIGINT) AS network_version, match_id * 10 AS changelist, w AS event_window_id, coalesce(d, match_date) AS match_date
    FROM matches JOIN p USING (match_id) LEFT JOIN l USING (match_id)""",
)
def document_matches(a: Arena) -> DataFrame:
    """B-01, B-02, S-06, S-10: match rows from documents, fallback values and the match list."""
    meta = a.matches.select("match_id", F.lit(7).cast("bigint").alias("network_version"), (F.col("match_id") * 10).alias("changelist"))
    ids = a.matches.where("match_id % 2 = 0").select(
        "match_id", F.concat(F.lit("w"), F.col("match_id").cast("string")).alias("event_window_id"), F.lit("EU").alias("region"),
        F.when(F.col("match_id") % 3 == 0, F.concat(F.lit("2024-02-0"), (F.col("match_id") % 9 + 1).cast("string"))).alias("session_date"), F.lit(True).alias("is_server_replay"),
    )
    m = documents.matches(match_documents(a), ids, meta)
    return m.select("match_id", "n_players", "n_humans", "n_teams", "season", r6("length_s", "length_s", 3), "network_version", "changelist", "event_window_id", "match_date")


@registered(
    "document_rows",
    """e AS (SELECT match_id, count(*) AS kills, round(sum(x), 2) AS kill_x, count(*) FILTER (victim_id = finisher_id) AS own, CAST(sum(floor(t)) AS DOUBLE) AS clock_s FROM kills GROUP BY ALL),
    p AS (SELECT match_id, count(DISTINCT 'acc' || id) AS accounts, CAST(sum(id) AS DOUBLE) AS death_x, count(death_t) AS deaths FROM players GROUP BY ALL),
    t AS (SELECT match_id, count(*) AS teams, max(n) AS largest, CAST(sum(k) AS BIGINT) AS team_kills FROM (SELECT match_id, team_index, count(*) AS n, sum(kills) AS k FROM players GROUP BY ALL) GROUP BY ALL)
    SELECT * FROM e JOIN p USING (match_id) JOIN t USING (match_id)""",
)
def document_rows(a: Arena) -> DataFrame:
    """B-03: kills, eliminations, players and teams from the documents' arrays."""
    docs = match_documents(a)
    k = documents.kills(docs).groupBy("match_id").agg(F.count("*").alias("kills"), r6(F.sum("x"), "kill_x", 2), F.count_if(F.col("victim_id") == F.col("finisher_id")).alias("own"))
    e = documents.eliminations(docs).groupBy("match_id").agg(F.sum("time_s").alias("clock_s"))
    p = documents.players(docs).where("player_id = lower(player_id)").groupBy("match_id").agg(F.countDistinct("player_id").alias("accounts"), F.sum("death_x").alias("death_x"), F.count("death_t").alias("deaths"))
    t = documents.teams(docs).groupBy("match_id").agg(F.count("*").alias("teams"), F.max("n_players").alias("largest"), F.sum("team_kills").alias("team_kills"))
    return k.join(e, "match_id").join(p, "match_id").join(t, "match_id")


@registered(
    "document_zones",
    """SELECT match_id, phase, CASE WHEN phase = 1 THEN 0.0 ELSE cur_x END AS cur_x, CASE WHEN phase = 1 THEN 0.0 ELSE cur_y END AS cur_y, cur_r, next_x, next_y, next_r, start_shrink_t, finish_shrink_t FROM phases""",
)
def document_zones(a: Arena) -> DataFrame:
    """B-04: phases from repeated snapshots, the current circle from the snapshot or the one before."""
    return documents.zone_phases(match_documents(a))


@registered(
    "aircraft_routes",
    """b AS (SELECT match_id, match_id * -1000.0::DOUBLE AS sx, 50000.0::DOUBLE AS sy, ((match_id * 15 - 90) % 360 + 360) % 360 AS deg FROM matches WHERE match_id % 3 <> 0)
    SELECT match_id, CAST(deg AS DOUBLE) AS bearing_deg, round(sx + cos(radians(deg)) * 7500 * 30, 2) + 0.0 AS end_x, round(sy + sin(radians(deg)) * 7500 * 30, 2) + 0.0 AS end_y,
      round(sx + cos(radians(deg)) * 7500 * 5, 2) + 0.0 AS drop_start_x, round(sy + sin(radians(deg)) * 7500 * 25, 2) + 0.0 AS drop_end_y FROM b""",
)
def aircraft_routes(a: Arena) -> DataFrame:
    """B-07."""
    b = documents.aircraft_bus(match_documents(a))
    return b.select("match_id", "bearing_deg", *(r6(c, c, 2) for c in ("end_x", "end_y", "drop_start_x", "drop_end_y")))


@registered(
    "derived_routes",
    """s AS (SELECT match_id, id, min(t) AS t, arg_min(x, t) AS x, arg_min(y, t) AS y FROM tracks WHERE t < 600 GROUP BY ALL),
    f AS (SELECT match_id, count(*) AS n_points, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM s GROUP BY ALL HAVING count(*) >= 5),
    p AS (SELECT s.match_id, s.t, n_points, a, (x - mx) * cos(a) + (y - my) * sin(a) AS p, (y - my) * cos(a) - (x - mx) * sin(a) AS q FROM s JOIN f USING (match_id)),
    g AS (SELECT match_id, n_points, a, sqrt(avg(q * q)) AS rms, covar_pop(p, t) AS ct, stddev_pop(t) AS st FROM p GROUP BY ALL)
    SELECT match_id, n_points, round(rms, 2) AS fit_rms, st > 0 AND abs(ct) > 1e-9 AS direction_known, round(((degrees(atan2(CASE WHEN ct < 0 THEN -sin(a) ELSE sin(a) END, CASE WHEN ct < 0 THEN -cos(a) ELSE cos(a) END)) % 360) + 360) % 360, 6) AS bearing_deg FROM g""",
)
def derived_routes(a: Arena) -> DataFrame:
    """B-08."""
    b = documents.derived_bus(a.tracks.withColumn("skydiving", F.col("t") < 600))
    return b.where("bus_source <> 'none'").select("match_id", "n_points", r6("fit_rms", "fit_rms", 2), "direction_known", r6("bearing_deg", "bearing_deg"))


@registered(
    "inferred_winners",
    """p AS (SELECT match_id, id, is_bot, CASE WHEN placement > 1 OR match_id % 4 = 0 THEN placement END AS placement, CASE WHEN match_id % 5 = 0 THEN NULL ELSE death_t END AS death_t FROM players),
    s AS (SELECT match_id, id, max(t) AS seen FROM tracks GROUP BY ALL),
    e AS (SELECT p.*, seen, greatest(max(seen) OVER (PARTITION BY match_id), length_s) AS e FROM p LEFT JOIN s USING (match_id, id) JOIN matches USING (match_id)),
    h AS (SELECT *, NOT is_bot AND placement IS NULL AND (death_t IS NULL OR death_t >= e - 5) AND coalesce(seen >= e - 30, false) AS here, max(CASE WHEN NOT is_bot AND placement = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id) AS won FROM e)
    SELECT match_id, id, CAST(1 AS BIGINT) AS placement FROM (SELECT *, count(*) FILTER (here) OVER (PARTITION BY match_id) AS n FROM h) WHERE here AND n = 1 AND won = 0""",
)
def inferred_winners(a: Arena) -> DataFrame:
    """B-09."""
    p = a.players.withColumn("placement", F.when((F.col("placement") > 1) | (F.col("match_id") % 4 == 0), F.col("placement"))).withColumn("death_t", F.when(F.col("match_id") % 5 != 0, F.col("death_t")))
    found = documents.inferred_winners(p, a.tracks, a.matches.select("match_id", F.col("length_s").alias("match_end_t")))
    return found.where("placement_inferred").select("match_id", "id", "placement")


@registered(
    "lobby_strengths",
    """r AS (SELECT id, CASE WHEN id % 3 > 0 THEN CAST(id * 61 % 1500 + 1 AS DOUBLE) END AS pr, CASE WHEN id % 3 > 0 THEN CAST(id * 7 AS DOUBLE) END AS score FROM (SELECT DISTINCT id FROM players)),
    p AS (SELECT match_id, CASE WHEN match_id % 4 > 0 THEN pr END AS pr, CASE WHEN match_id % 4 > 0 THEN score END AS score, CASE WHEN id % 2 = 0 THEN CAST(id * 41 + match_id % 5 AS DOUBLE) END AS lr FROM players JOIN r USING (id) WHERE NOT is_bot),
    s AS (SELECT match_id, avg(CASE WHEN pr <= 1000 THEN 1.0 ELSE 0 END) AS top, avg(CASE WHEN pr IS NOT NULL THEN 1.0 ELSE 0 END) AS share, avg(score) AS mean, count(lr) AS ranked, avg(CASE WHEN lr <= 1000 THEN 1.0 ELSE 0 END) AS board, avg(CASE WHEN lr <= 100 THEN 1.0 ELSE 0 END) AS top100, median(lr) AS med FROM p GROUP BY ALL)
    SELECT match_id, round(top, 6) AS lobby_pr_top1000, round(share, 6) AS lobby_pr_share, round(mean, 6) AS lobby_pr_mean, ranked AS lobby_ranked, round(top100, 6) AS lobby_top100, med AS lobby_median_rank,
      round(coalesce(CASE WHEN share > 0 THEN top END, CASE WHEN ranked > 0 THEN board END), 6) AS lobby_strength, CASE WHEN share > 0 THEN 'power_rankings' WHEN ranked > 0 THEN 'leaderboard' END AS lobby_strength_source FROM s""",
)
def lobby_strengths(a: Arena) -> DataFrame:
    """B-15, B-16: players rated by account and window, and what that makes of their lobby."""
    p = a.players.withColumn("player_id", F.concat(F.lit("acc"), F.col("id").cast("string"), F.when(F.col("match_id") % 4 == 0, "-x").otherwise("")))
    accounts = a.players.select("id").distinct().where("id % 3 > 0")
    rankings = accounts.select(F.concat(F.lit("acc"), F.col("id").cast("string")).alias("account_id"), (F.col("id") * 61 % 1500 + 1).cast("double").alias("pr_rank"), (F.col("id") * 7).cast("double").alias("pr_score"))
    matches = a.matches.select("match_id", F.concat(F.lit("w"), (F.col("match_id") % 5).cast("string")).alias("event_window_id"))
    named = p.join(matches, "match_id").where("id % 2 = 0")
    ranks = named.groupBy("event_window_id", F.col("player_id").alias("account_id"), "id").agg(F.min(F.col("id") * 41 + F.col("match_id") % 5).cast("double").alias("rank")).withColumn("points", F.lit(1.0))
    s = documents.lobby_strength(documents.rated_players(p, rankings, ranks, matches))
    six = ("lobby_pr_top1000", "lobby_pr_share", "lobby_pr_mean", "lobby_top100", "lobby_strength")
    return s.select("match_id", *(r6(c, c) for c in six), "lobby_ranked", "lobby_median_rank", "lobby_strength_source")


@registered(
    "landing_points",
    """b AS (SELECT *, z * 4.0 AS zz FROM tracks WHERE abs(x) <= 135000 AND abs(y) <= 135000 AND t > 10),
    v AS (SELECT *, (zz - lag(zz) OVER w) / (t - lag(t) OVER w) AS vz, first_value(zz) OVER w AS z0, first_value(t) OVER w AS t0 FROM b WINDOW w AS (PARTITION BY match_id, id ORDER BY t)),
    l AS (SELECT *, abs(vz) < 300 AND abs(lead(vz) OVER w) < 300 AND abs(lead(vz, 2) OVER w) < 300 AND zz < z0 - 5000 AS ok FROM v WINDOW w AS (PARTITION BY match_id, id ORDER BY t)),
    g AS (SELECT match_id, id, min(t) AS land_t, arg_min(x, t) AS land_x, arg_min(y, t) AS land_y, min(t0) AS jump_t FROM l WHERE ok GROUP BY ALL),
    o AS (SELECT g.*, p.team_index, p.death_t, p.placement FROM g JOIN players p USING (match_id, id) WHERE NOT p.is_bot),
    z AS (SELECT match_id, phase, next_x, next_y, next_r FROM phases WHERE phase <= 2),
    k AS (SELECT o.match_id, o.id, count(*) AS n FROM o JOIN kills ON kills.match_id = o.match_id AND finisher_id = o.id AND victim_id <> finisher_id AND kills.t <= land_t + 180 GROUP BY ALL)
    SELECT o.match_id, count(*) AS n, round(avg(land_t), 4) AS land_t, round(avg(land_t - jump_t), 4) AS glide_s, round(avg(greatest(sqrt(pow(land_x - z.next_x, 2) + pow(land_y - z.next_y, 2)) / 100 - z.next_r / 100, 0)), 4) AS outside_m,
      count(*) FILTER (death_t - land_t <= 120) AS off_spawn, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS early_kills,
      round(avg(abs((land_x - o.match_id * -1000.0) * sin(radians(o.match_id * 15.0 - 90)) - (land_y - 50000) * cos(radians(o.match_id * 15.0 - 90))) / 100) FILTER (o.match_id % 3 <> 0), 4) AS bus_offset_m
    FROM o JOIN z ON z.match_id = o.match_id AND z.phase = 2 LEFT JOIN k ON k.match_id = o.match_id AND k.id = o.id GROUP BY o.match_id""",
)
def landing_points(a: Arena) -> DataFrame:
    """B-11, B-13, B-14: where players come to rest, how far from the route and circle, and what follows."""
    tracks = a.tracks.withColumn("z", F.col("z").cast("double") * 4).withColumn("vz", F.lit(None).cast("double"))
    flown = documents.aircraft_bus(match_documents(a))
    bus = flown.unionByName(a.matches.where("match_id % 3 = 0").select("match_id", F.lit("none").alias("bus_source"), F.lit(10.0).alias("flight_start_t")), allowMissingColumns=True)
    players = documents.team_placements(a.players)
    land = documents.landings(tracks, players, bus, a.phases, a.kills)
    return land.groupBy("match_id").agg(
        F.count("*").alias("n"), r6(F.avg("land_t"), "land_t", 4), r6(F.avg("glide_s"), "glide_s", 4), r6(F.avg("outside_zone2_m"), "outside_m", 4), F.count_if("off_spawn").alias("off_spawn"), F.sum("early_kills").alias("early_kills"),
        r6(F.avg("bus_offset_m"), "bus_offset_m", 4),
    )


@registered(
    "health_rebuilt",
    """w AS (SELECT match_id, id, t, health, shield FROM changes)
    SELECT match_id, count(*) AS n, round(avg(health), 6) AS health, round(avg(s), 6) AS shield FROM (SELECT *, last_value(CASE WHEN CAST(floor(t) AS BIGINT) % 2 = 0 THEN shield END IGNORE NULLS) OVER (PARTITION BY match_id, id ORDER BY t) AS s FROM w) GROUP BY ALL""",
)
def health_rebuilt(a: Arena) -> DataFrame:
    """B-22: two slots of an attribute table back to health and shield, each carried forward."""
    c = a.changes
    slot = lambda df, handle, value: df.select("match_id", "t", "id", F.lit(handle).cast("bigint").alias("handle"), F.col(value).alias("value"))
    attributes = slot(c, 0, "health").unionByName(slot(c.where("cast(t as bigint) % 2 = 0"), 4, "shield")).unionByName(slot(c, 9, "t"))
    slots = a.matches.select("match_id", F.lit(True).alias("shield_hit"), F.lit(4).cast("bigint").alias("handle"))
    return documents.rebuilt_health(attributes, slots).groupBy("match_id").agg(F.count("*").alias("n"), r6(F.avg("health"), "health"), r6(F.avg("shield"), "shield"))


@registered(
    "placed_by_actor",
    """k AS (SELECT match_id, victim_id, t, l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN x END AS x FROM kills)
    SELECT k.match_id, count(*) AS n, count(coalesce(k.x, p.x)) AS placed, round(avg(coalesce(k.x, p.x)), 4) + 0.0 AS x FROM k ASOF LEFT JOIN tracks p ON k.match_id = p.match_id AND k.victim_id = p.id AND k.t >= p.t GROUP BY k.match_id""",
)
def placed_by_actor(a: Arena) -> DataFrame:
    """B-24: events without a place get their actor's last position."""
    k = a.kills.withColumn("x", F.when(F.col("l_orderkey") % 2 == 0, F.col("x")))
    found = documents.located(k, a.tracks, "victim_id")
    return found.groupBy("match_id").agg(F.count("*").alias("n"), F.count("x").alias("placed"), r6(F.avg("x"), "x", 4))


# ---- leaderboards and checks ------------------------------------------------------------------------------------


def _pages(a: Arena) -> DataFrame:
    """Leaderboard pages from orders: an order is an entry of two accounts with one session."""
    o = a.table("orders")
    entry = F.struct(
        (F.col("o_custkey") % 200 + 1).alias("rank"), F.col("o_orderkey").cast("double").alias("points"),
        F.array(F.concat(F.lit("A"), (F.col("o_custkey") % 150).cast("string")), F.concat(F.lit("a"), (F.col("o_orderkey") % 170).cast("string"))).alias("accounts"),
        F.array(F.struct(F.concat(F.lit("s"), (F.col("o_orderkey") % 300).cast("string")).alias("session_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("end_time"))).alias("sessions"),
    )
    return o.groupBy(F.concat(F.lit("w"), (F.col("o_orderkey") % 6).cast("string")).alias("event_window_id"), (F.col("o_orderkey") % 40).alias("_page")).agg(F.collect_list(entry).alias("entries")).select(
        "event_window_id", F.lit("EU").alias("region"), "entries"
    )


_ENTRIES_SQL = """e AS (SELECT 'w' || (o_orderkey % 6) AS w, o_custkey % 200 + 1 AS rank, CAST(o_orderkey AS DOUBLE) AS points, 'a' || (o_custkey % 150) AS a1, 'A' || (o_custkey % 150) AS r1, 'a' || (o_orderkey % 170) AS a2, 's' || (o_orderkey % 300) AS s, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)"""


@registered("leaderboard_ranks", f"{_ENTRIES_SQL} SELECT w AS event_window_id, account AS account_id, min(rank) AS rank FROM (SELECT w, unnest([a1, a2]) AS account, rank FROM e) GROUP BY ALL")
def leaderboard_ranks(a: Arena) -> DataFrame:
    """S-12: the best entry of each account in each window."""
    return leaderboards.best_ranks(_pages(a)).select("event_window_id", "account_id", "rank")


@registered(
    "leaderboard_matches",
    f"{_ENTRIES_SQL} SELECT s AS match_id, w AS event_window_id, max(d) AS session_date, count(DISTINCT rank) AS teams, CAST(len(list_distinct(flatten(list([r1, a2])))) AS BIGINT) AS seen FROM e GROUP BY ALL",
)
def leaderboard_matches(a: Arena) -> DataFrame:
    """S-12: matches that entries name, with their teams and seen accounts."""
    return leaderboards.found_matches(_pages(a)).select("match_id", "event_window_id", "session_date", "teams", F.size("seen").cast("bigint").alias("seen"))


@registered(
    "collection_plan",
    f"""{_ENTRIES_SQL}, n AS (SELECT DISTINCT s, unnest([a1, a2]) AS a FROM e), r AS (SELECT 'a' || s_suppkey AS a, CAST(s_suppkey * 97 % 3000 AS DOUBLE) AS pr FROM supplier)
    SELECT s AS match_id, count(*) FILTER (pr <= 1000) AS strong, count(pr) AS ranked, count(*) AS seen FROM n LEFT JOIN r USING (a) WHERE s NOT IN (SELECT 's' || match_id FROM matches) GROUP BY s HAVING count(*) >= 10""",
)
def collection_plan(a: Arena) -> DataFrame:
    """S-11."""
    seen = leaderboards.found_matches(_pages(a)).select("match_id", F.explode("seen").alias("account_id"))
    rankings = a.table("supplier").select(F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("account_id"), (F.col("s_suppkey") * 97 % 3000).cast("double").alias("pr_rank"))
    done = a.matches.select(F.concat(F.lit("s"), F.col("match_id").cast("string")).alias("match_id"))
    return leaderboards.collection_plan(seen, rankings, done, least=10)


_TOURNAMENTS_SQL = """t AS (SELECT 'w' || (c_custkey % 40) AS w, c_mktsegment || ' cup ' || (c_custkey % 9) AS name, '20' || lpad(CAST(c_custkey % 25 AS VARCHAR), 2, '0') || '-03-01' AS e, CASE WHEN c_nationkey < 12 THEN 'EU' ELSE 'NAC' END AS region FROM customer)"""


def _tournaments(a: Arena) -> DataFrame:
    return a.table("customer").select(
        F.concat(F.lit("w"), (F.col("c_custkey") % 40).cast("string")).alias("event_window_id"), F.concat("c_mktsegment", F.lit(" cup "), (F.col("c_custkey") % 9).cast("string")).alias("name"),
        F.concat(F.lit("20"), F.lpad((F.col("c_custkey") % 25).cast("string"), 2, "0"), F.lit("-03-01")).alias("end_time"), F.when(F.col("c_nationkey") < 12, "EU").otherwise("NAC").alias("region"),
    )


@registered(
    "tournament_windows",
    f"""{_TOURNAMENTS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY e DESC, name) AS n FROM t WHERE e >= '2010-01-01' AND region = 'EU' AND (contains(lower(name), 'build') OR contains(lower(name), 'auto')) AND NOT contains(lower(name), 'cup 3')),
    l AS (SELECT DISTINCT 'w' || (o_orderkey % 40) AS w, o_orderkey % 500 AS m FROM orders),
    s AS (SELECT w, count(*) AS collected, count(*) FILTER (m % 3 = 0) AS downloaded, count(*) FILTER (m % 5 = 0) AS processed FROM l GROUP BY ALL)
    SELECT w AS event_window_id, name, e AS end_time, region, coalesce(collected, 0) AS collected, coalesce(downloaded, 0) AS downloaded, coalesce(processed, 0) AS processed FROM c LEFT JOIN s USING (w) WHERE n = 1""",
)
def tournament_windows(a: Arena) -> DataFrame:
    """S-13: windows by date, words and region, with how far their matches are."""
    w = leaderboards.windows(_tournaments(a), "2010-01-01", ("Build", "auto"), ("cup 3",), "EU")
    listed = a.table("orders").select(F.concat(F.lit("w"), (F.col("o_orderkey") % 40).cast("string")).alias("event_window_id"), (F.col("o_orderkey") % 500).alias("match_id")).distinct()
    ids = listed.select("match_id").distinct()
    return leaderboards.progress(w, listed, ids.where("match_id % 3 = 0"), ids.where("match_id % 5 = 0"))


@registered(
    "pipeline_status",
    """l AS (SELECT DISTINCT o_custkey AS m FROM orders)
    SELECT (SELECT count(*) FROM l) AS collected, (SELECT count(*) FROM l WHERE m % 3 <> 0 AND m % 5 <> 0) AS waiting, (SELECT count(*) FROM l WHERE m % 5 = 0) AS in_tables""",
)
def pipeline_status(a: Arena) -> DataFrame:
    """S-14."""
    listed = a.table("orders").select(F.col("o_custkey").alias("match_id"))
    return leaderboards.status(listed, listed.where("match_id % 3 = 0"), listed.where("match_id % 5 = 0"))


_CHECKS_SQL = """hu AS (SELECT match_id, count(*) AS n, count(*) FILTER (placement IS NULL) AS unplaced, count(*) FILTER (placement = 1) AS winners FROM pn WHERE NOT is_bot GROUP BY ALL),
    zo AS (SELECT match_id, count(*) AS n, count(*) FILTER (next_r > cur_r) AS grows, count(*) FILTER (late) AS late FROM (SELECT *, start_shrink_t < lag(finish_shrink_t) OVER (PARTITION BY match_id ORDER BY phase) AS late FROM phases) GROUP BY ALL),
    sg AS (SELECT match_id, max(gap) AS gap FROM (SELECT match_id, id, t - lag(t) OVER (PARTITION BY match_id, id ORDER BY t) AS gap FROM tracks) JOIN (SELECT match_id, id FROM players WHERE NOT is_bot) USING (match_id, id) GROUP BY ALL),
    st AS (SELECT match_id, 'zones' AS chk, CASE WHEN n = 0 THEN 'fail' WHEN n < 8 THEN 'warn' ELSE 'ok' END AS status FROM zo UNION ALL SELECT match_id, 'radii shrink', CASE WHEN grows > 0 THEN 'fail' ELSE 'ok' END FROM zo UNION ALL
      SELECT match_id, 'zone order', CASE WHEN late > 0 THEN 'fail' ELSE 'ok' END FROM zo UNION ALL SELECT match_id, 'placements', CASE WHEN unplaced > n / 2 THEN 'fail' WHEN unplaced > 0 THEN 'warn' ELSE 'ok' END FROM hu UNION ALL
      SELECT match_id, 'winner', CASE WHEN winners = 0 THEN 'warn' ELSE 'ok' END FROM hu UNION ALL SELECT match_id, 'sample gaps', CASE WHEN gap > 60 THEN 'warn' ELSE 'ok' END FROM sg UNION ALL
      SELECT match_id, 'bus', CASE WHEN match_id % 3 = 0 THEN 'warn' ELSE 'ok' END FROM matches UNION ALL SELECT match_id, 'season', 'ok' FROM matches)"""
_PLACED_SQL = "pn AS (SELECT match_id, id, is_bot, CASE WHEN match_id % 6 > 0 OR placement > 20 THEN placement END AS placement FROM players)"


def _checks(a: Arena) -> DataFrame:
    players = a.players.withColumn("placement", F.when((F.col("match_id") % 6 > 0) | (F.col("placement") > 20), F.col("placement"))).withColumn("disconnected", F.lit(False))
    teams = a.players.select("match_id", "team_index").distinct()
    bus = documents.aircraft_bus(match_documents(a))
    found = checks.checks(a.matches, players, teams, a.phases, a.tracks, bus)
    return found.where(F.col("check").isin("zones", "radii shrink", "zone order", "placements", "winner", "sample gaps", "bus", "season"))


@registered("quality_checks", f"{_PLACED_SQL}, {_CHECKS_SQL} SELECT chk AS \"check\", status, count(*) AS n FROM st GROUP BY ALL")
def quality_checks(a: Arena) -> DataFrame:
    """V-01."""
    return _checks(a).groupBy("check", "status").agg(F.count("*").alias("n"))


@registered(
    "quality_summary",
    f"{_PLACED_SQL}, {_CHECKS_SQL}, wo AS (SELECT match_id, max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS s FROM st GROUP BY ALL) SELECT ['ok', 'warn', 'fail'][s + 1] AS status, count(*) AS matches, (SELECT count(DISTINCT season) > 1 FROM matches) AS mixed_seasons FROM wo GROUP BY ALL",
)
def quality_summary(a: Arena) -> DataFrame:
    """V-02."""
    return checks.run_summary(_checks(a), a.matches)


@registered(
    "null_hygiene",
    "d AS (SELECT match_id, CASE WHEN id % 4 > 0 THEN pr_rank END AS v FROM players) SELECT match_id, count(v) AS n, round(avg(v), 6) AS mean FROM d GROUP BY ALL",
)
def null_hygiene(a: Arena) -> DataFrame:
    """F-14: a number that is none reads as null, and averages leave it out."""
    p = a.players.select("match_id", F.when(F.col("id") % 4 > 0, F.col("pr_rank")).otherwise(F.lit(float("nan"))).alias("v"))
    return catalog.no_nan(p).groupBy("match_id").agg(F.count("v").alias("n"), r6(F.avg("v"), "mean"))


# ---- detectors --------------------------------------------------------------------------------------------------


@registered(
    "detect_unexplained_drops",
    f"{SURGE_SQL} SELECT phase, count(*) AS n, count(*) FILTER ({MARGIN} < 0) AS in_storm, round(sum(lost), 4) AS lost FROM uz GROUP BY phase",
)
def unexplained(a: Arena) -> DataFrame:
    """D-02."""
    return D.unexplained_drops(a.tables()).groupBy("phase").agg(F.count("*").alias("n"), F.count_if("in_storm").alias("in_storm"), r6(F.sum("lost"), "lost", 4))


@registered("optional_tables", "SELECT (SELECT count(*) FROM kills JOIN matches USING (match_id) WHERE season = 'v30') > 0 AS kills, (SELECT count(*) FROM hits JOIN matches USING (match_id) WHERE season = 'v99') > 0 AS hits")
def optional_tables(a: Arena) -> DataFrame:
    """F-08: whether an optional table has rows in the selection."""
    has = lambda t, season: t.join(L.select(a.matches, L.Filters(seasons=(season,))).select("match_id"), "match_id", "left_semi").limit(1).agg((F.count("*") > 0).alias("_h"))
    return has(a.kills, "v30").select(F.col("_h").alias("kills")).crossJoin(has(a.hits, "v99").select(F.col("_h").alias("hits")))


@registered(
    "joint_binomial",
    """b AS (SELECT c_mktsegment AS seg, count(*) AS n, count(*) FILTER (c_acctbal > 4700) AS k FROM customer GROUP BY ALL),
    q AS (SELECT seg, n, k, i, exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + n * ln(0.5)) AS p FROM b, LATERAL (SELECT unnest(range(0, n + 1)) AS i))
    SELECT seg, n, k, round(least(sum(p) FILTER (p <= own * (1 + 1e-7)), 1), 6) AS p FROM (SELECT *, max(CASE WHEN i = k THEN p END) OVER (PARTITION BY seg) AS own FROM q) GROUP BY ALL""",
)
def joint_binomial(a: Arena) -> DataFrame:
    """ST-11: the exact two-sided binomial test."""
    t = T.binomial(a.table("customer"), ["c_mktsegment"], F.col("c_acctbal") > 4700)
    return t.select(F.col("c_mktsegment").alias("seg"), "n", "k", r6("p", "p"))

"""Match telemetry derived from the given sales tables by fixed arithmetic, so that every operator runs on them.

Lineitem rows become position samples, hits, health changes and eliminations of matches with 60 players each, one for about 2,500 rows, 24 at least;
the same arithmetic is written once as DataFrame operations and once as SQL (``ARENA_SQL``) for the cross-check.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Radii of a circle and the next one, by phase, in centimetres (fixed values).
RADII = (
    (1, 150000, 100000), (2, 100000, 60000), (3, 60000, 42500), (4, 42500, 32000), (5, 32000, 26500),
    (6, 26500, 20500), (7, 20500, 14000), (8, 14000, 11500), (9, 11500, 8500), (10, 8500, 5000),
)
LEAST_MATCHES = 24
ROWS_OF_MATCH = 2500
PLAYERS = 60


@dataclass
class Arena:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_matches(self) -> int:
        return max(LEAST_MATCHES, self.table("lineitem").count() // ROWS_OF_MATCH)

    @cached_property
    def raw(self) -> DataFrame:
        t = F.expr("cast((l_orderkey * 131 + l_partkey * 17 + l_linenumber * 29) % 12000 as double) / cast(10 as double)")
        return self.table("lineitem").select(
            (F.col("l_orderkey") % self.n_matches).alias("match_id"),
            (F.col("l_suppkey") % PLAYERS).alias("id"),
            t.alias("t"),
            F.expr("cast(((l_partkey * 7919 + l_linenumber * 104729) % 240001) - 120000 as double)").alias("x"),
            F.expr("cast(((l_orderkey * 6101 + l_suppkey * 15485863) % 240001) - 120000 as double)").alias("y"),
            (F.col("l_quantity") * 60).alias("z"),
            (F.col("l_partkey") % PLAYERS).alias("target_id"),
            "l_linenumber",
            "l_returnflag",
            F.col("l_quantity").cast("double").alias("l_quantity"),
            F.col("l_extendedprice").cast("double").alias("l_extendedprice"),
            "l_orderkey",
            "l_partkey",
        )

    @cached_property
    def tracks(self) -> DataFrame:
        return self.raw.groupBy("match_id", "id", F.floor(F.col("id") / 3).alias("team_index"), "t").agg(
            F.max("x").alias("x"), F.max("y").alias("y"), F.max("z").alias("z")
        )

    @cached_property
    def phases(self) -> DataFrame:
        """All matches of the table with the ten phases."""
        radii = F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(float(a)).alias("cur_r"), F.lit(float(b)).alias("next_r")) for p, a, b in RADII)))
        m = self.raw.select("match_id").distinct().select("match_id", radii.alias("_r")).select("match_id", "_r.*")
        m = m.withColumn("next_x", F.expr("(((match_id * 7919 + phase * 104729) % 2001) - 1000) * cast(40 as double)"))
        m = m.withColumn("next_y", F.expr("(((match_id * 6101 + phase * 15485863) % 2001) - 1000) * cast(40 as double)"))
        by = Window.partitionBy("match_id").orderBy("phase")
        return m.select(
            "*",
            F.coalesce(F.lag("next_x").over(by), F.lit(0.0)).alias("cur_x"),
            F.coalesce(F.lag("next_y").over(by), F.lit(0.0)).alias("cur_y"),
            (F.col("phase") * 110.0).alias("start_shrink_t"),
            (F.col("phase") * 110.0 + 45.0).alias("finish_shrink_t"),
        )

    @cached_property
    def kills(self) -> DataFrame:
        return self.raw.where("l_returnflag = 'R'").select(
            "match_id", F.col("id").alias("victim_id"), F.col("target_id").alias("finisher_id"), "t", "x", "y", "z", "l_orderkey", "l_linenumber"
        )

    @cached_property
    def hits(self) -> DataFrame:
        return self.raw.where("l_linenumber >= 5 and id <> target_id").select(
            "match_id", F.col("id").alias("attacker_id"), "target_id", "t", F.col("l_quantity").alias("amount"), "x", "y", "z", "l_orderkey", "l_linenumber"
        )

    @cached_property
    def changes(self) -> DataFrame:
        return (
            self.raw.where("l_linenumber <= 4")
            .groupBy("match_id", "id", "t")
            .agg(
                F.max(F.expr("(l_partkey * 37 + l_linenumber * 11) % 101")).cast("double").alias("health"),
                F.max(F.expr("(l_orderkey * 13) % 101")).cast("double").alias("shield"),
            )
        )

    @cached_property
    def players(self) -> DataFrame:
        """Players with team, placement by their summed price, eliminations and death time (placement 1 never dies)."""
        total = self.raw.groupBy("match_id", "id").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.count_if(F.col("l_returnflag") == "A").alias("kills"))
        place = F.rank().over(Window.partitionBy("match_id").orderBy(F.desc("value"), "id"))
        return total.select(
            "match_id", "id", F.floor(F.col("id") / 3).alias("team_index"), place.cast("bigint").alias("placement"), "kills", "value",
            F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 1000 + 1).cast("double")).alias("pr_rank"), (F.col("id") % 11 == 0).alias("is_bot"),
        ).withColumn("death_t", F.when(F.col("placement") > 1, 1200.0 - F.col("placement") * 18.0))

    @cached_property
    def matches(self) -> DataFrame:
        m = self.raw.groupBy("match_id").agg(F.countDistinct("id").alias("n_players"), F.max("t").alias("length_s"))
        return m.select(
            "match_id", "n_players", "length_s",
            F.concat(F.lit("v"), (F.col("match_id") % 3 + 30).cast("string")).alias("season"),
            F.element_at(F.array(F.lit("EU"), F.lit("NAC"), F.lit("BR"), F.lit("ASIA")), (F.col("match_id") % 4 + 1).cast("int")).alias("region"),
            F.concat(F.lit("window_"), (F.col("match_id") % 5).cast("string")).alias("event_window_id"),
            F.concat(F.lit("2024-0"), (F.col("match_id") % 6 + 1).cast("string"), F.lit("-1"), (F.col("match_id") % 9).cast("string")).alias("match_date"),
            F.when(F.col("match_id") % 2 == 0, "Playlist_Showdown_Duos").otherwise("Playlist_Trios").alias("playlist"),
            (F.col("match_id") % 8 != 0).alias("is_server_replay"),
            F.when(F.col("match_id") % 6 != 5, (F.col("match_id") * 7 % 10).cast("double") / 10).alias("lobby_strength"),
        )

    @cached_property
    def landings(self) -> DataFrame:
        """Each player's first sample as their landing, with opponents near and the nearest place."""
        from tidemark.operators.spatial import nearest_place, neighbour_counts

        first = self.tracks.groupBy("match_id", "id").agg(F.min("t").alias("land_t"), *(F.min_by(c, "t").alias(c) for c in "xyz"))
        own = self.players.select("match_id", "id", "team_index", "placement", "pr_rank", "death_t", "kills")
        pts = neighbour_counts(first.join(own.hint("merge"), ["match_id", "id"]), ["match_id"], "id", [150, 300], "team_index")
        places = self.table("supplier").select(
            F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("name"),
            F.expr("cast((s_suppkey * 7919) % 240001 - 120000 as double)").alias("x"), F.expr("cast((s_suppkey * 104729) % 240001 - 120000 as double)").alias("y"),
        )
        named = nearest_place(pts, places, 800.0)
        return named.select(
            "match_id", "id", "land_t", F.col("x").alias("land_x"), F.col("y").alias("land_y"), "team_index", "death_t", "placement", F.col("placement").alias("final"), "kills", "pr_rank",
            F.col("near_150").alias("opp_150m"), F.col("near_300").alias("opp_300m"), (F.col("near_300") % 3).alias("opp_top1000_300m"), F.col("nearest_m").alias("nearest_opp_m"),
            (F.abs("x") / 100).alias("bus_offset_m"), (F.abs("y") / 100).alias("outside_zone2_m"), F.col("place").alias("poi"), (F.col("death_t") - F.col("land_t") <= 300).alias("off_spawn"),
        )

    def tables(self, freshness: float = 60.0):
        """The frames that the detectors read. Samples are half a minute apart here, so ages may be wide.

        Players and zones, a few rows of a match, are met by every step of a detector: they are written once.
        """
        from tidemark.plans.detect import Tables
        from tidemark.sources.shared import grown

        item = F.concat(F.lit("WID_"), F.element_at(F.array(F.lit("Shotgun"), F.lit("Assault"), F.lit("SMG")), (F.col("l_partkey") % 3 + 1).cast("int")), F.lit("_Athena_"), F.element_at(F.array(F.lit("C"), F.lit("R"), F.lit("SR")), (F.col("l_partkey") % 3 + 1).cast("int")))
        items = self.raw.select("match_id", "id", "t", "l_linenumber", item.alias("item"))
        from tidemark.functions.scalar import item_category, item_rarity

        held = items.where("l_linenumber <= 2").select("match_id", "t", "id", F.col("item").alias("weapon"), item_category(F.col("item")).alias("category"), item_rarity(F.col("item")).alias("rarity"))
        return Tables(
            matches=self.matches, players=grown(self.players, "players"), zones=grown(self.phases, "zones"), positions=self.tracks, kills=self.kills, health=self.changes, damage=self.hits, landings=self.landings, weapons_held=held,
            chests=items.where("l_linenumber = 3").select("match_id", "t", F.col("id").alias("searched_by")),
            pickups=items.where("l_linenumber >= 4").select("match_id", F.col("id").alias("picked_by"), F.col("t").alias("picked_t"), F.when(F.col("l_linenumber") == 4, "heal/shield").otherwise("weapon").alias("category")),
            freshness=freshness,
        )


ARENA_SQL = """
raw AS (SELECT l_orderkey % (SELECT greatest(24, count(*) // 2500) FROM lineitem) AS match_id, l_suppkey % 60 AS id,
  CAST((l_orderkey * 131 + l_partkey * 17 + l_linenumber * 29) % 12000 AS DOUBLE) / CAST(10 AS DOUBLE) AS t,
  CAST(((l_partkey * 7919 + l_linenumber * 104729) % 240001) - 120000 AS DOUBLE) AS x,
  CAST(((l_orderkey * 6101 + l_suppkey * 15485863) % 240001) - 120000 AS DOUBLE) AS y,
  l_quantity * 60 AS z, l_partkey % 60 AS target_id, l_linenumber, l_returnflag, l_quantity, l_extendedprice, l_orderkey, l_partkey
  FROM lineitem),
tracks AS (SELECT match_id, id, CAST(floor(id / 3) AS BIGINT) AS team_index, t, max(x) AS x, max(y) AS y, max(z) AS z FROM raw GROUP BY ALL),
phases AS (SELECT *, coalesce(lag(next_x) OVER w, 0.0) AS cur_x, coalesce(lag(next_y) OVER w, 0.0) AS cur_y,
    phase * 110.0::DOUBLE AS start_shrink_t, phase * 110.0::DOUBLE + 45 AS finish_shrink_t FROM (
  SELECT match_id, phase, cur_r::DOUBLE AS cur_r, next_r::DOUBLE AS next_r,
    (((match_id * 7919 + phase * 104729) % 2001) - 1000) * 40.0::DOUBLE AS next_x,
    (((match_id * 6101 + phase * 15485863) % 2001) - 1000) * 40.0::DOUBLE AS next_y
  FROM (SELECT DISTINCT match_id FROM raw), (VALUES (1,150000,100000),(2,100000,60000),(3,60000,42500),(4,42500,32000),(5,32000,26500),
    (6,26500,20500),(7,20500,14000),(8,14000,11500),(9,11500,8500),(10,8500,5000)) AS r(phase, cur_r, next_r))
  WINDOW w AS (PARTITION BY match_id ORDER BY phase)),
kills AS (SELECT match_id, id AS victim_id, target_id AS finisher_id, t, x, y, z, l_orderkey, l_linenumber FROM raw WHERE l_returnflag = 'R'),
hits AS (SELECT match_id, id AS attacker_id, target_id, t, l_quantity AS amount, x, y, z, l_orderkey, l_linenumber FROM raw
  WHERE l_linenumber >= 5 AND id <> target_id),
changes AS (SELECT match_id, id, t, CAST(max((l_partkey * 37 + l_linenumber * 11) % 101) AS DOUBLE) AS health,
  CAST(max((l_orderkey * 13) % 101) AS DOUBLE) AS shield FROM raw WHERE l_linenumber <= 4 GROUP BY ALL),
players AS (SELECT *, CASE WHEN placement > 1 THEN 1200.0::DOUBLE - placement * 18 END AS death_t FROM (
  SELECT match_id, id, CAST(floor(id / 3) AS BIGINT) AS team_index, rank() OVER (PARTITION BY match_id ORDER BY value DESC, id) AS placement,
    kills, value, CASE WHEN id % 7 <> 0 THEN CAST(id * 37 % 1000 + 1 AS DOUBLE) END AS pr_rank, id % 11 = 0 AS is_bot
  FROM (SELECT match_id, id, round(sum(l_extendedprice), 2) AS value, count(*) FILTER (l_returnflag = 'A') AS kills FROM raw GROUP BY ALL))),
matches AS (SELECT match_id, n_players, length_s, 'v' || (match_id % 3 + 30) AS season,
  ['EU', 'NAC', 'BR', 'ASIA'][match_id % 4 + 1] AS region, 'window_' || (match_id % 5) AS event_window_id,
  '2024-0' || (match_id % 6 + 1) || '-1' || (match_id % 9) AS match_date,
  CASE WHEN match_id % 2 = 0 THEN 'Playlist_Showdown_Duos' ELSE 'Playlist_Trios' END AS playlist, match_id % 8 <> 0 AS is_server_replay,
  CASE WHEN match_id % 6 <> 5 THEN CAST(match_id * 7 % 10 AS DOUBLE) / 10 END AS lobby_strength
  FROM (SELECT match_id, count(DISTINCT id) AS n_players, max(t) AS length_s FROM raw GROUP BY ALL))
"""

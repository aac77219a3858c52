"""Checks of the built tables: (match_id, check, status, value), and what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITY = {"ok": 0, "warn": 1, "fail": 2}


def _check(df: DataFrame, name: str, value, bad, warn=None) -> DataFrame:
    status = F.when(bad, "fail")
    if warn is not None:
        status = status.when(warn, "warn")
    return df.select("match_id", F.lit(name).alias("check"), status.otherwise("ok").alias("status"), value.cast("double").alias("value"))


def checks(matches: DataFrame, players: DataFrame, teams: DataFrame, zones: DataFrame, positions: DataFrame, bus: DataFrame) -> DataFrame:
    all_ = matches.select("match_id")
    c = F.col
    by = Window.partitionBy("match_id").orderBy("phase")
    humans = players.where(~F.coalesce("is_bot", F.lit(False)))
    z = all_.join(
        zones.withColumn("_grows", c("next_r") > c("cur_r")).withColumn("_late", c("start_shrink_t") < F.lag("finish_shrink_t").over(by)).groupBy("match_id").agg(
            F.count("*").alias("n"), F.count_if("_grows").alias("grows"), F.count_if("_late").alias("late")
        ), "match_id", "left",
    ).fillna(0)
    connected = ~F.coalesce(c("disconnected"), F.lit(False))
    per_team = humans.groupBy("match_id", "team_index").agg(F.countDistinct(F.when(connected, c("placement"))).alias("d"))
    agree = all_.join(per_team.groupBy("match_id").agg(F.count_if(c("d") > 1).alias("n")), "match_id", "left").fillna(0)
    p = all_.join(humans.groupBy("match_id").agg(F.count("*").alias("n"), F.count_if(c("placement").isNull()).alias("unplaced"), F.count_if(c("placement") == 1).alias("winners")), "match_id", "left").fillna(0)
    t = all_.join(teams.groupBy("match_id").agg(F.count("*").alias("n")), "match_id", "left").fillna(0)
    step = c("t") - F.lag("t").over(Window.partitionBy("match_id", "id").orderBy("t"))
    track = positions.withColumn("_step", step).groupBy("match_id", "id").agg(F.max("t").alias("last"), F.max("_step").alias("gap"))
    seen = humans.join(track, ["match_id", "id"], "left").withColumn("covered", F.coalesce(c("last") >= F.coalesce(c("death_t"), c("last")) - 30, F.lit(False)))
    s = all_.join(seen.groupBy("match_id").agg(F.avg(c("covered").cast("double")).alias("share"), F.max("gap").alias("gap"), F.count_if(c("last").isNull()).alias("missing")), "match_id", "left").fillna(0)
    b = all_.join(bus.select("match_id", "bus_source", "fit_rms"), "match_id", "left")
    parts = [
        _check(z, "zones", c("n"), c("n") == 0, c("n") < 8), _check(z, "radii shrink", c("grows"), c("grows") > 0), _check(z, "zone order", c("late"), c("late") > 0),
        _check(t, "teams", c("n"), c("n") == 0), _check(p, "placements", c("unplaced"), c("unplaced") > c("n") / 2, c("unplaced") > 0),
        _check(agree, "teammates agree", c("n"), F.lit(False), c("n") > 0), _check(p, "winner", c("winners"), F.lit(False), c("winners") == 0),
        _check(s, "tracks", c("share"), c("share") < 0.5, c("share") < 0.9), _check(s, "sample gaps", c("gap"), F.lit(False), c("gap") > 60), _check(s, "missing tracks", c("missing"), F.lit(False), c("missing") > 0),
        _check(b, "bus", c("fit_rms"), F.lit(False), F.coalesce(c("bus_source"), F.lit("none")) == "none"),
        _check(matches, "season", c("season").isNotNull().cast("int"), F.lit(False), c("season").isNull()),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def worst(found: DataFrame) -> DataFrame:
    severity = F.lit(0)
    for name, k in SEVERITY.items():
        severity = F.when(F.col("status") == name, k).otherwise(severity)
    names = F.array(*map(F.lit, SEVERITY))
    return found.groupBy("match_id").agg(F.max(severity).alias("_s")).select("match_id", F.get(names, F.col("_s")).alias("status"))


def run_summary(found: DataFrame, matches: DataFrame) -> DataFrame:
    mixed = matches.agg((F.countDistinct("season") > 1).alias("mixed_seasons"))
    return worst(found).groupBy("status").agg(F.count("*").alias("matches")).crossJoin(F.broadcast(mixed))

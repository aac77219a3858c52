"""Landed leaderboard pages and tournament lists into rankings, match lists and collection plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A landed page of a leaderboard.
PAGE = (
    "event_window_id string, region string, entries array<struct<rank:bigint,points:double,accounts:array<string>,"
    "sessions:array<struct<session_id:string,end_time:string>>>>"
)


def best_ranks(pages: DataFrame) -> DataFrame:
    """(event_window_id, account_id, rank, points): the best entry of each account in each window."""
    e = pages.select("event_window_id", F.explode("entries").alias("_e")).select("event_window_id", "_e.rank", "_e.points", F.explode("_e.accounts").alias("account_id"))
    best = e.where("account_id is not null").groupBy("event_window_id", F.lower("account_id").alias("account_id")).agg(F.min_by(F.struct("rank", "points"), F.col("rank")).alias("_b"))
    return best.select("event_window_id", "account_id", "_b.rank", "_b.points")


def found_matches(pages: DataFrame) -> DataFrame:
    """(match_id, event_window_id, region, session_date, teams, seen): matches that the entries' sessions name."""
    e = pages.select("event_window_id", "region", F.explode("entries").alias("_e")).select(
        "event_window_id", "region", "_e.rank", F.explode("_e.sessions").alias("_s"), F.col("_e.accounts").alias("_a")
    )
    seen = e.groupBy(F.col("_s.session_id").alias("match_id"), "event_window_id", "region").agg(
        F.max(F.substring("_s.end_time", 1, 10)).alias("session_date"), F.countDistinct("rank").alias("teams"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_a")))).alias("seen")
    )
    return seen


def replace_windows(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """Whole windows are replaced by what was read anew."""
    return table.join(fresh.select("event_window_id").distinct(), "event_window_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def collection_plan(seen: DataFrame, rankings: DataFrame, done: DataFrame, least: int = 1, limit: int | None = None, strong: float = 1000.0) -> DataFrame:
    """Matches still to collect with counts of their seen players, strongest first."""
    known = rankings.select(F.lower("account_id").alias("account_id"), "pr_rank")
    counts = (
        seen.select("match_id", F.lower("account_id").alias("account_id")).distinct().join(known, "account_id", "left")
        .groupBy("match_id").agg(F.count_if(F.col("pr_rank") <= strong).alias("strong"), F.count("pr_rank").alias("ranked"), F.count("*").alias("seen"))
    )
    plan = counts.join(done.select("match_id"), "match_id", "left_anti").where(F.col("seen") >= least)
    plan = plan.orderBy(F.desc("strong"), F.desc("ranked"), F.desc("seen"), "match_id")
    return plan.limit(limit) if limit else plan


def windows(tournaments: DataFrame, since: str, include: Sequence[str] = (), exclude: Sequence[str] = (), region: str | None = None) -> DataFrame:
    """Windows that ended on or after the date, by words in their name; one row for each window."""
    name, ok = F.lower("name"), F.col("end_time").try_cast("date") >= F.lit(since).try_cast("date")
    for words, keep in ((include, True), (exclude, False)):
        if words:
            hit = F.lit(False)
            for w in words:
                hit = hit | name.contains(w.lower())
            ok = ok & (hit if keep else ~hit)
    if region:
        ok = ok & (F.col("region") == region)
    by = Window.partitionBy("event_window_id").orderBy(F.desc("end_time"), "name")
    return tournaments.where(ok).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def progress(windows_: DataFrame, listed: DataFrame, raw: DataFrame, built: DataFrame) -> DataFrame:
    """Each window's matches listed, downloaded and in the tables, latest first."""
    flags = listed.select("event_window_id", "match_id").join(raw.select("match_id", F.lit(1).alias("_r")), "match_id", "left").join(built.select("match_id", F.lit(1).alias("_b")), "match_id", "left")
    n = flags.groupBy("event_window_id").agg(F.count("*").alias("collected"), F.count("_r").alias("downloaded"), F.count("_b").alias("processed"))
    return windows_.join(n, "event_window_id", "left").fillna(0, subset=["collected", "downloaded", "processed"]).orderBy(F.desc("end_time"), "event_window_id")


def status(listed: DataFrame, raw: DataFrame, built: DataFrame) -> DataFrame:
    """One row: matches listed, those with neither raw file nor tables, and those in the tables."""
    known = raw.select("match_id").unionByName(built.select("match_id")).distinct()
    waiting = listed.select("match_id").distinct().join(known, "match_id", "left_anti").agg(F.count("*").alias("waiting"))
    return listed.agg(F.countDistinct("match_id").alias("collected")).crossJoin(waiting).crossJoin(built.agg(F.countDistinct("match_id").alias("in_tables")))

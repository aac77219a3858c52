"""Selections of matches: filters, facets, lists, comparisons and team look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A selection of at most so many matches is broadcast.
MOST_BROADCAST = 200_000


@dataclass(frozen=True)
class Filters:
    min_strength: float | None = None
    date_from: str | None = None
    date_to: str | None = None
    seasons: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    windows: tuple[str, ...] = ()
    playlist: str | None = None
    server_only: bool = False

    def where(self) -> Column:
        ok, date = F.lit(True), F.col("match_date").try_cast("date")
        if self.min_strength is not None:
            ok = ok & (F.col("lobby_strength") >= self.min_strength)
        if self.date_from:
            ok = ok & (date >= F.lit(self.date_from).try_cast("date"))
        if self.date_to:
            ok = ok & (date <= F.lit(self.date_to).try_cast("date"))
        for column, values in (("season", self.seasons), ("region", self.regions), ("event_window_id", self.windows)):
            if values:
                ok = ok & F.col(column).isin(*values)
        if self.playlist:
            ok = ok & F.lower("playlist").contains(self.playlist.lower())
        if self.server_only:
            ok = ok & F.coalesce(F.col("is_server_replay"), F.lit(False))
        return ok


def select(matches: DataFrame, filters: Filters) -> DataFrame:
    """(match_id) of the matches that pass."""
    return matches.where(filters.where()).select("match_id").distinct()


def chosen(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows of the selected matches. The selection is broadcast only where a count shows that it is small."""
    small = selection.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(selection) if small else selection, "match_id", "left_semi")


def facets(matches: DataFrame, columns: Sequence[str] = ("season", "region", "event_window_id", "playlist")) -> DataFrame:
    """(facet, value, n) of each column in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns)))
    return matches.select(pairs.alias("_f")).select("_f.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def summary(matches: DataFrame) -> DataFrame:
    """One row about a selection: dates, counts, seasons, regions, strength."""
    date = F.col("match_date").try_cast("date")
    return matches.agg(
        F.count("*").alias("n"), F.min(date).alias("first"), F.max(date).alias("last"), F.count("lobby_strength").alias("rated"),
        F.array_join(F.array_sort(F.collect_set("season")), ",").alias("seasons"), F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"),
        F.median("lobby_strength").alias("strength"),
    )


def latest(matches: DataFrame, n: int) -> DataFrame:
    return matches.orderBy(F.col("match_date").try_cast("date").desc_nulls_last(), "match_id").limit(n)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes, shared matches, and those of b alone."""
    sides = a.select("match_id", F.lit(1).alias("a")).join(b.select("match_id", F.lit(1).alias("b")), "match_id", "full")
    return sides.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("a").isNull()).alias("only_b"))


def only_b(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.select("match_id").subtract(a.select("match_id"))


def split_at(matches: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """Strictly before the date, and on or after it; matches without a date are in neither."""
    d, at = F.col("match_date").try_cast("date"), F.lit(date).try_cast("date")
    return matches.where(d < at), matches.where(d >= at)


def humans(players: DataFrame) -> DataFrame:
    return players.where(~F.coalesce("is_bot", F.lit(False)))


def opponents(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def ranked(players: DataFrame, yes: bool = True) -> DataFrame:
    return players.where(F.col("pr_rank").isNotNull() if yes else F.col("pr_rank").isNull())


def has_rows(rows: DataFrame, selection: DataFrame) -> bool:
    """Whether an optional table has anything for the selection."""
    return not rows.join(selection, "match_id", "left_semi").isEmpty()


def find_team(players: DataFrame, typed: str, name: str = "name") -> DataFrame:
    """(match_id, team_index, fragments): in each match the team with most of the typed fragments, two at least if several were typed."""
    fragments = sorted({f.strip().lower() for f in typed.split(",") if f.strip()})
    if not fragments:
        return players.select("match_id", "team_index", F.lit(0).cast("bigint").alias("fragments")).limit(0)
    hit = F.explode(F.array(*map(F.lit, fragments)))
    found = (
        players.select("match_id", "team_index", F.lower(name).alias("_n"), hit.alias("_f"))
        .where(F.col("_n").contains(F.col("_f")))
        .groupBy("match_id", "team_index")
        .agg(F.countDistinct("_f").alias("fragments"))
        .where(F.col("fragments") >= min(2, len(fragments)))
    )
    first = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("fragments"), "team_index"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def team_games(players: DataFrame, account: str = "player_id") -> DataFrame:
    """(match_id, team_index, team, placement, kills): a team is its accounts, sorted and joined."""
    return players.groupBy("match_id", "team_index").agg(
        F.array_join(F.sort_array(F.collect_list(F.col(account).cast("string"))), "+").alias("team"),
        F.min("placement").alias("placement"), F.sum("kills").alias("kills"),
    )


def list_teams(games: DataFrame) -> DataFrame:
    """Each team's games, wins, mean placement and, where the games have them, points and usual drop."""
    more = [F.sum("points").alias("points")] if "points" in games.columns else []
    more += [F.mode("drop", True).alias("drop")] if "drop" in games.columns else []
    return games.groupBy("team").agg(F.count("*").alias("games"), F.count_if(F.col("placement") == 1).alias("wins"), F.avg("placement").alias("placement"), *more)


def numbered_games(games: DataFrame, start: str = "replay_timestamp") -> DataFrame:
    """A team's games in time order, from 1; games without a readable time go last."""
    at = F.try_to_timestamp(F.col(start)).asc_nulls_last()
    return games.withColumn("game", F.row_number().over(Window.partitionBy("team").orderBy(at, "match_id")))

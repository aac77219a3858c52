"""Sessions, runs and rhythms over a time order."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gap_sessions(df: DataFrame, keys: Sequence[str], time: str, gap: float, name: str = "session") -> DataFrame:
    """Numbers from 0 within the keys; a new one where more than ``gap`` lies since the row before. Null times stay null."""
    by = Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_first())
    new = F.when(F.col(time) - F.lag(time).over(by) > gap, 1).otherwise(0)
    started = df.withColumn("_new", new)
    number = F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return started.withColumn(name, F.when(F.col(time).isNotNull(), number)).drop("_new")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, gap: tuple[str, float] | None = None, name: str = "run") -> DataFrame:
    """Numbers from 0 for stretches of one value; with ``gap`` a stretch also ends where that column jumps by more."""
    by = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(by) == 1
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(by))
    if gap:
        changed = changed | F.coalesce(F.col(gap[0]) - F.lag(gap[0]).over(by) > gap[1], F.lit(False))
    marked = df.withColumn("_new", F.when(first, 0).otherwise(changed.cast("int")))
    return marked.withColumn(name, F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def holds_for(condition: Column, rows: int, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Whether the condition holds on this row and the ``rows - 1`` after it, all of which exist."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, rows - 1)
    return (F.min(F.coalesce(condition, F.lit(False)).cast("int")).over(by) == 1) & (F.count(F.lit(1)).over(by) == rows)


def changes_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before; the first row stays."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_before", F.lag(F.struct(F.col(value))).over(by))
        .where(F.col("_before").isNull() | ~F.col("_before")[value].eqNullSafe(F.col(value)))
        .drop("_before")
    )


def forward_fill(value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(by)


def fresh_pairs(hits: DataFrame, keys: Sequence[str], time: str, quiet: float) -> Column:
    """Whether the pair named by the keys has not met in the last ``quiet`` seconds."""
    by = Window.partitionBy(*keys).orderBy(time)
    since = F.col(time) - F.lag(time).over(by)
    return since.isNull() | (since > quiet)


def rhythm(time: str, ident: str, match: str, low: float = 3.0, high: float = 7.0, together: int = 3) -> Column:
    """Ticks: the player's event before or after is ``low`` to ``high`` s away, or several players share the rounded second."""
    by = Window.partitionBy(match, ident).orderBy(time)
    back = F.col(time) - F.lag(time).over(by)
    ahead = F.lead(time).over(by) - F.col(time)
    same = F.size(F.collect_set(ident).over(Window.partitionBy(match, F.rint(time))))
    return F.coalesce(back.between(low, high), F.lit(False)) | F.coalesce(ahead.between(low, high), F.lit(False)) | (same >= together)


def thinned(df: DataFrame, keys: Sequence[str], time: str, seconds: float, exact: bool = False) -> DataFrame:
    """At most one row for each ``seconds``: of each bin the first or, ``exact``, each next row that far from the last kept.

    The exact form needs what it kept so far: one function goes through all players of a partition, each in time order.
    """
    if not exact:
        bins = Window.partitionBy(*keys, F.floor(F.col(time) / seconds)).orderBy(time)
        return df.withColumn("_n", F.row_number().over(bins)).where("_n = 1").drop("_n")

    def greedy(batches):
        last = float("-inf")
        for batch in batches:
            kept = []
            plain = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_first", time))
            for first, t in zip(*plain, strict=True):
                if first:
                    last = float("-inf")
                keep = t - last >= seconds
                kept.append(keep)
                if keep:
                    last = t
            yield batch.drop_columns(["_first"]).filter(pa.array(kept, pa.bool_()))

    # the window leaves each player's rows together and in time order
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(time))
    return df.where(F.col(time).isNotNull()).withColumn("_first", place == 1).mapInArrow(greedy, df.schema)


def strided(df: DataFrame, keys: Sequence[str], order: Sequence[str], stride: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place - 1).where(F.col("_n") % stride == 0).drop("_n")

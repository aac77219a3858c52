"""Grouped measures with the support, tie and null rules of the studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(condition: Column, least: int = 1) -> Column:
    """Share of rows where the condition holds, of those where it is known; null under ``least`` of them."""
    n = F.count(condition)
    return F.when(n >= least, F.avg(condition.cast("double")))


def mode(x: str) -> Column:
    """Smallest of the most frequent values."""
    return F.mode(x, True)


def mode_share(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    n = df.where(F.col(x).isNotNull()).groupBy(*group, x).agg(F.count("*").alias("_n"))
    return n.groupBy(*group).agg(
        F.max_by(x, F.struct("_n", -F.col(x) if dict(df.dtypes)[x] in ("int", "bigint", "double") else F.lit(0))).alias("mode"),
        (F.max("_n") / F.sum("_n")).alias("mode_share"),
    )


def quantiles(x: str, points: dict[str, float]) -> list[Column]:
    return [F.percentile(x, F.lit(p)).alias(n) for n, p in points.items()]


def ratio_of_sums(a: Column, b: Column) -> Column:
    return F.try_divide(F.sum(a), F.sum(b))


def geometric_mean(x: Column, missing: float = 100_000.0, low: float = 1.0) -> Column:
    return F.exp(F.avg(F.log(F.least(F.greatest(F.coalesce(x, F.lit(missing)), F.lit(low)), F.lit(missing)))))


def joined_names(x: str, separator: str = "+") -> Column:
    return F.array_join(F.sort_array(F.collect_list(x)), separator)


def has_all(x: str, wanted: Sequence[str]) -> Column:
    held = F.lit(True)
    for w in wanted:
        held = held & (F.max(F.when(F.col(x) == w, 1).otherwise(0)) == 1)
    return held


def gap_of_means(df: DataFrame, group: Sequence[str], side: Column, value: str, least: int = 3) -> DataFrame:
    """Per group the mean where ``side`` less the mean where not; only with ``least`` values on either."""
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    return (
        df.groupBy(*group)
        .agg(F.avg(a).alias("_a"), F.avg(b).alias("_b"), F.count(a).alias("n_with"), F.count(b).alias("n_without"))
        .where((F.col("n_with") >= least) & (F.col("n_without") >= least))
        .select(*group, "n_with", "n_without", (F.col("_a") - F.col("_b")).alias("gap"))
    )


def like_for_like(df: DataFrame, strata: Sequence[str], side: Column, value: str) -> DataFrame:
    """Per stratum that has both sides the difference of means; callers average or test the differences."""
    return gap_of_means(df, strata, side, value, 1)


def value_shares(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    n = df.groupBy(*group, x).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def repeated_spots(df: DataFrame, by: Sequence[str], where: Sequence[str], digits: int = 0, of: str = "match_id") -> DataFrame:
    """Rounded positions that more than one match has."""
    spot = [F.round(F.col(c), digits).alias(c) for c in where]
    return df.groupBy(*by, *spot).agg(F.countDistinct(of).alias("n")).where("n > 1")


def histogram(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0, values outside in the end bins; null for null."""
    k = F.floor((x - low) * bins / (high - low))
    return F.when(x.isNotNull(), F.least(F.greatest(k, F.lit(0)), F.lit(bins - 1)).cast("int"))


def group_value(agg: Column, group: Sequence[str]) -> Column:
    return agg.over(Window.partitionBy(*group))


def hashed_sample(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The same at most ``n`` rows each time, by a hash of the keys."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)

"""Ranks within a group, with the ties and null rules that the studies need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def average_rank(x: str | Column, group: Sequence[str]) -> Column:
    """1 to n with ties sharing their mean; null for null."""
    x = _col(x)
    ordered = Window.partitionBy(*group).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(Window.partitionBy(*group, x))
    return F.when(x.isNotNull(), F.rank().over(ordered) + (ties - 1) / 2)


def summed_below(steps: DataFrame, group: Sequence[str], x: str, sums: Sequence[str], parts: int = 64) -> DataFrame:
    """``below_{c}`` (the sum of ``c`` over smaller ``x`` of the group) and ``all_{c}``, for rows with distinct (group, x).

    A group may hold most rows, so that no window covers one: its values are dealt to ``parts`` ranges at approximate quantiles,
    running sums are taken within a range, and the ranges' totals, ``parts`` rows a group, give what lies below each range.
    """
    keys = [f"_g{k}" for k in range(len(group))]

    def meet(df: DataFrame, small: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        on = F.lit(True)
        for g, k in zip((*group, *more), (*keys, *(f"{m}2" for m in more)), strict=True):
            on = on & F.col(g).eqNullSafe(F.col(k))
        return df.join(small, on).drop(*keys, *(f"{m}2" for m in more)) if group or more else df.crossJoin(F.broadcast(small))

    named = [F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]
    edges = steps.groupBy(*named).agg(F.percentile_approx(F.col(x).cast("double"), F.array(*(F.lit(k / parts) for k in range(1, parts))), 10_000).alias("_edges"))
    s = meet(steps, edges).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(x)))).drop("_edges")
    per = s.groupBy(*named, F.col("_range").alias("_range2")).agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    of_group = Window.partitionBy(*keys)
    earlier = of_group.orderBy("_range2").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_range2", *(F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums), *(F.sum(f"_t_{c}").over(of_group).alias(f"all_{c}") for c in sums))
    within = Window.partitionBy(*group, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    s = meet(s, per, ["_range"])
    return s.withColumns({f"below_{c}": F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).drop("_range", *(f"_o_{c}" for c in sums))


def percent_rank_average(x: str | Column, group: Sequence[str]) -> Column:
    """Average rank over the number of values that are not null."""
    x = _col(x)
    return F.try_divide(average_rank(x, group), F.count(x).over(Window.partitionBy(*group)))


def percent_rank_min(x: str | Column, group: Sequence[str]) -> Column:
    """Smallest rank of the ties over the number of values that are not null."""
    x = _col(x)
    return F.when(x.isNotNull(), F.try_divide(F.rank().over(Window.partitionBy(*group).orderBy(x.asc_nulls_last())), F.count(x).over(Window.partitionBy(*group))))


def percent_rank_nulls_last(x: str | Column, group: Sequence[str]) -> Column:
    """Average rank with nulls as one last tie, over all rows."""
    x = _col(x)
    ordered = Window.partitionBy(*group).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, x))
    return (F.rank().over(ordered) + (ties - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy(*group))


def thirds(share: Column, labels: Sequence[str] = ("low", "middle", "high")) -> Column:
    return F.when(share <= 1 / 3, labels[0]).when(share <= 2 / 3, labels[1]).when(share.isNotNull(), labels[2])


def z_score(x: str | Column, group: Sequence[str]) -> Column:
    """Deviations from the group's mean; zero for null, and where the group does not vary."""
    x, w = _col(x), Window.partitionBy(*group)
    return F.coalesce((x - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)), F.lit(0.0))


def residual(y: str | Column, x: str | Column, group: Sequence[str]) -> Column:
    """y less its line on x in the group; less the group's median where x does not vary; infinite where y is missing."""
    y, x, w = _col(y), _col(x), Window.partitionBy(*group)
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(True))
    fx, fy = F.when(both, x), F.when(both, y)
    slope = F.try_divide(F.covar_pop(fy, fx).over(w), F.var_pop(fx).over(w))
    line = F.avg(fy).over(w) + slope * (x - F.avg(fx).over(w))
    flat = F.coalesce(F.var_pop(fx).over(w), F.lit(0.0)) < 1e-12
    expected = F.when(flat | line.isNull(), F.median(y).over(w)).otherwise(line)
    return F.when(y.isNull(), F.lit(float("inf"))).otherwise(y - expected)


def first_rows(df, group: Sequence[str], order: Sequence[Column], n: int = 1):
    """The first ``n`` rows of each group; ties by the whole row, so that the choice does not depend on the layout."""
    total = [*order, *(F.col(c) for c in df.columns if not dict(df.dtypes)[c].startswith("map"))]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*total))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")

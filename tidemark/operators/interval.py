"""Interval joins on time, cut into bins so that they are equi-joins with a bounded fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import running_totals


def interval_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], before: float, after: float, time: str = "t", right_time: str = "r_t", how: str = "inner"
) -> DataFrame:
    """Pairs with ``right_time`` in [time - before, time + after]. Right columns must not repeat left ones but the keys.

    Bins are as wide as the interval, so that a left row meets at most two of them.
    """
    width = before + after if before + after > 0 else 1.0
    bins = F.array_distinct(
        F.array(F.floor((F.col(time) - before) / width), F.floor((F.col(time) + after) / width))
    )
    near = (F.col(right_time) >= F.col(time) - before) & (F.col(right_time) <= F.col(time) + after)
    if how in ("left_semi", "left_anti"):
        # whether the keys' running number of facts grows over the interval: one pass, no pairs
        counted = right.select(*keys, F.col(right_time).cast("double").alias("_at"))
        probe = left.withColumns({"_low": F.col(time).cast("double") - before, "_at": F.col(time).cast("double") + after})
        upto = running_totals(probe, counted, keys, {"_n1": F.lit(1.0)}, time="_at")
        since = running_totals(upto.withColumn("_at", F.col("_low")), counted, keys, {"_n0": F.lit(1.0)}, time="_at", inclusive=False)
        met = F.coalesce(F.col("_n1") > F.col("_n0"), F.lit(False)) & F.col(time).isNotNull()
        for k in keys:
            met = met & F.col(k).isNotNull()
        return since.where(met if how == "left_semi" else ~met).select(*left.columns)
    a = left.withColumn("_bin", F.explode_outer(bins))
    b = right.withColumn("_bin", F.floor(F.col(right_time) / width))
    return a.join(b, [*keys, "_bin"]).where(near).drop("_bin")


def window_sums(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spans: dict[str, tuple[Column, Column]], value: str | dict[str, str], ident: Sequence[str], right_time: str = "r_t"
) -> DataFrame:
    """For each left row (told apart by ``ident``) the sum of ``value``, or of each span's own, over each named span (after, up to], zero without any.

    A span's sum is the difference of two running totals; all ends of all spans go through one window over the keys, equal ones once.
    """
    of = value if isinstance(value, dict) else dict.fromkeys(spans, value)
    values = list(dict.fromkeys(of[n] for n in spans))
    columns = list({str(at): at for span in spans.values() for at in span}.values())
    place = {str(at): k for k, at in enumerate(columns)}
    ends = [F.struct(F.lit(k).alias("end"), at.cast("double").alias("_at")) for k, at in enumerate(columns)]
    probes = left.select(*dict.fromkeys((*keys, *ident)), F.explode(F.array(*ends)).alias("_e")).select("*", "_e.*").drop("_e")
    totals = running_totals(probes, right.select(*keys, F.col(right_time).alias("_at"), *values), keys, {f"_sum_{v}": F.col(v) for v in values}, time="_at")
    when = lambda at: F.max(F.when(F.col("end") == place[str(at)], F.col("_at")))
    until = lambda at, v: F.max(F.when(F.col("end") == place[str(at)], F.col(f"_sum_{v}")))
    # not where one of a span's ends is unknown
    sums = totals.groupBy(*ident).agg(*(F.when(when(b) > when(a), until(b, of[n]) - until(a, of[n])).alias(n) for n, (a, b) in spans.items()))
    return left.join(sums.hint("merge"), list(ident), "left").fillna(0.0, subset=list(spans))


def within_phase(samples: DataFrame, phases: DataFrame, begin: str, end: str, keys: Sequence[str] = ("match_id",), time: str = "t") -> DataFrame:
    """Samples with each phase of their match whose [begin, end] holds their time. A match has few phases."""
    return samples.join(phases, list(keys)).where((F.col(time) >= F.col(begin)) & (F.col(time) <= F.col(end)))


def time_grid(spans: DataFrame, begin: str, end: str, step: float, name: str = "t") -> DataFrame:
    """One row for each multiple of ``step`` in [begin, end); spans without one give none."""
    first, last = F.ceil(F.col(begin) / step), F.ceil(F.col(end) / step) - 1
    return (
        spans.withColumn("_first", first)
        .withColumn("_last", last)
        .where("_first <= _last")
        .withColumn("_k", F.explode(F.sequence("_first", "_last")))
        .withColumn(name, F.col("_k") * F.lit(float(step)))
        .drop("_first", "_last", "_k")
    )

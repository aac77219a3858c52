"""As-of joins: each left row with the latest (or next) right row of its keys.

Both sides are unioned and one window over the keys, sorted by time, carries the right row as a struct; the shuffle
is on the keys alone and several lookups with the same keys can share it. Ties in time count as known: a right row
at the left row's time matches in both directions; of right rows with one time the greatest value wins backward and
the smallest forward, in the order of the given value columns. Null times or keys match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    time: str = "t",
    right_time: str | None = None,
    how: str = "inner",
    direction: str = "backward",
    tolerance: float | None = None,
    prefix: str = "",
) -> DataFrame:
    """The left columns, the right ``values`` and the matched time as ``{prefix}{right_time}_matched``."""
    right_time = right_time or time
    back = direction == "backward"
    named = [f"{prefix}{v}" for v in values]
    matched = f"{prefix}{right_time}_matched"
    own = F.struct(*(F.col(c) for c in left.columns)).alias("_left")
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    known = F.struct(F.col(right_time).alias(matched), *(F.col(v).alias(n) for v, n in zip(values, named, strict=True)))
    order = F.lit(1 if back else 0).alias("_side")
    probes = left.select(*key, F.col(time).cast("double").alias("_t"), order, own)
    usable = F.col(right_time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    facts = right.where(usable).select(
        *key, F.col(right_time).cast("double").alias("_t"), F.lit(0 if back else 1).alias("_side"), known.alias("_right")
    )
    both = probes.unionByName(facts, allowMissingColumns=True)
    # a frame that only grows: forward, the rows go from the latest to the earliest
    order = [F.asc(c) if back else F.desc(c) for c in ("_t", "_side", "_right")]
    by = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy(*order)
    found = F.last("_right", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    hit = both.withColumn("_found", found).where(F.col("_left").isNotNull())
    ok = F.col("_t").isNotNull() & F.col("_found").isNotNull()
    if tolerance is not None:
        ok = ok & (F.abs(F.col("_t") - F.col("_found")[matched]) <= tolerance)
    out = hit.select(
        *(F.col("_left")[c].alias(c) for c in left.columns),
        *(F.when(ok, F.col("_found")[n]).alias(n) for n in [*named, matched]),
    )
    return out.where(F.col(matched).isNotNull()) if how == "inner" else out


def fresh(joined: DataFrame, limit: float, time: str = "t", matched: str = "t_matched") -> DataFrame:
    """Only matches no older than the limit."""
    return joined.where(F.abs(F.col(time) - F.col(matched)) <= limit)


def running_totals(
    left: DataFrame, facts: DataFrame, keys: Sequence[str], sums: dict[str, Column], time: str = "t", inclusive: bool = True, ago: dict[str, tuple[str, int]] | None = None
) -> DataFrame:
    """Left rows with the running totals of their keys' facts up to their time, and at it: two of them make any interval's sum.

    Not ``inclusive``: facts at the time itself do not count. ``ago``: {name: (one of the sums, seconds)}, its total so long before.
    """
    ago = ago or {}
    by = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_t", "_side")
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    probes = left.select(*key, F.col(time).cast("double").alias("_t"), F.lit(1 if inclusive else -1).alias("_side"), F.struct(*left.columns).alias("_left"))
    rows = facts.select(
        *key, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_side"), *(c.cast("double").alias(f"_s_{n}") for n, c in sums.items())
    )
    both = probes.unionByName(rows, allowMissingColumns=True)
    total = both.select(
        "_left",
        *(
            F.coalesce(F.sum(f"_s_{n}").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias(n)
            for n in sums
        ),
        *(
            F.coalesce(F.sum(f"_s_{n}").over(Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_t").rangeBetween(Window.unboundedPreceding, -seconds)), F.lit(0.0)).alias(name)
            for name, (n, seconds) in ago.items()
        ),
    )
    return total.where(F.col("_left").isNotNull()).select(*(F.col("_left")[c].alias(c) for c in left.columns), *sums, *ago)

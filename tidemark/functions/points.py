"""Scoring schemes: points by place and by elimination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points by place of the two usual formats and by elimination (fixed values).
DUOS = (65, 56, 52, 48, 44, 40, 38, 36, 34, 32, 30, 28, 26, 24, 22, 20, 18, 16, 14, 12, 10, 8, 6, 4, 2)
SOLOS = tuple(range(50, 0, -1))
ELIMINATION = 4


def scheme(spark: SparkSession, points: Sequence[int], elimination: int = ELIMINATION) -> DataFrame:
    rows = [(k + 1, int(p), elimination) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, "place long, points long, elimination long")


def scored(games: DataFrame, table: DataFrame, place: str = "placement", kills: str = "kills") -> DataFrame:
    """The games with ``points``; places beyond the table have none for placing."""
    own = table.agg(F.max("elimination").alias("_e"))
    found = games.join(F.broadcast(table.select(F.col("place").alias(place), F.col("points").alias("_p"))), place, "left").crossJoin(F.broadcast(own))
    return found.withColumn("points", F.coalesce("_p", F.lit(0)) + F.coalesce(F.col(kills), F.lit(0)) * F.coalesce("_e", F.lit(0))).drop("_p", "_e")


def problems(table: DataFrame) -> DataFrame:
    """(problem) of a scheme: not from 1st, gaps, rising, negative; no row for a sound one. A scheme is one small table."""
    by = Window.orderBy("place")
    steps = table.select("place", "points", F.lag("place").over(by).alias("_p"), F.lag("points").over(by).alias("_v"))
    found = F.array_compact(
        F.array(
            F.when(F.col("_p").isNull() & (F.col("place") != 1), "not from 1st"),
            F.when(F.col("place") - F.col("_p") != 1, "gap"),
            F.when(F.col("points") > F.col("_v"), "rises"),
            F.when(F.col("points") < 0, "negative"),
        )
    )
    return steps.select(F.explode(found).alias("problem")).distinct()


def exchange(table: DataFrame) -> DataFrame:
    """Stretches of places where one place is worth the same: (first, last, step, places_per_elimination)."""
    by = Window.orderBy("place")
    steps = table.select("place", "elimination", (F.col("points") - F.coalesce(F.lead("points").over(by), F.lit(0))).alias("step"))
    new = (F.col("step") != F.coalesce(F.lag("step").over(by), F.lit(-1))).cast("int")
    return (
        steps.withColumn("_new", new)
        .withColumn("_run", F.sum("_new").over(by))
        .groupBy("_run", "step")
        .agg(F.min("place").alias("first"), (F.max("place") + 1).alias("last"), F.try_divide(F.max("elimination").cast("double"), F.first("step")).alias("places_per_elimination"))
        .drop("_run")
    )

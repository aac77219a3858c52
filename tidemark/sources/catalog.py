"""Reading and writing the tables of a dataset folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType
from pyspark.sql.window import Window

from tidemark.sources.schema import NAMES, schema

DATASETS = ("real", "local", "demo")


def no_nan(df: DataFrame) -> DataFrame:
    """Null instead of NaN, so that averages leave it out."""
    return df.select(
        *(
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
            for f in df.schema.fields
        )
    )


@dataclass(frozen=True)
class Catalog:
    """The 17 tables below ``base``/tables. A missing one is empty, with its declared columns."""

    spark: SparkSession
    base: str

    def path(self, name: str) -> str:
        return f"{self.base}/tables/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        declared = schema(name)
        try:
            found = self.spark.read.option("mergeSchema", True).parquet(self.path(name))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], declared)
        have = set(found.columns)
        return no_nan(
            found.select(*((F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in declared))
        )

    def views(self) -> None:
        for name in NAMES:
            self.table(name).createOrReplaceTempView(name)

    def write(self, name: str, df: DataFrame, format: str = "parquet") -> None:
        """Declared columns only; Parquet is laid out by season where the table has one."""
        have = set(df.columns)
        out = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name)))
        writer = out.write.mode("overwrite")
        if format == "csv":
            writer.option("header", True).csv(f"{self.base}/tables/{name}.csv")
        else:
            writer.parquet(self.path(name))


def available(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, matches) of the datasets below ``root``."""
    rows = [(d, Catalog(spark, f"{root}/{d}").table("matches")) for d in DATASETS]
    out = None
    for d, m in rows:
        one = m.agg(F.lit(d).alias("dataset"), F.count("*").alias("matches"))
        out = one if out is None else out.unionByName(one)
    return out.select("dataset", "matches")


def csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A side input with a header; lines that begin with # are comments, every field is a string first."""
    names = [c.strip().split(" ") for c in columns.split(",")]
    raw = spark.read.csv(path, header=True, comment="#", inferSchema=False)
    have = set(raw.columns)
    return raw.select(*((F.col(n).try_cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in names))


def first_per(df: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    by = Window.partitionBy(key).orderBy(*(order or tuple(c for c in df.columns if c != key)))
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def match_ids(spark: SparkSession, path: str) -> DataFrame:
    return first_per(csv(spark, path, "match_id string, event_window_id string, region string, session_date string, is_server_replay boolean, source string"), "match_id")


def power_rankings(spark: SparkSession, path: str) -> DataFrame:
    ranks = csv(spark, path, "account_id string, pr_rank double, pr_score double")
    return first_per(ranks.withColumn("account_id", F.lower("account_id")).where("account_id is not null"), "account_id", ("pr_rank",))


def player_ranks(spark: SparkSession, path: str) -> DataFrame:
    ranks = csv(spark, path, "event_window_id string, account_id string, rank double, points double")
    by = Window.partitionBy("event_window_id", "account_id").orderBy("rank")
    return ranks.withColumn("account_id", F.lower("account_id")).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")

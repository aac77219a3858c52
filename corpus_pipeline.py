"""A corpus pipeline of five stages; each one works on all that the one before it kept.

``run`` applies them to ``documents``; a cluster writes each stage's rows as Parquet and reads them for the next.
All stages but the last return all columns of their input, with their types.

Defined results: null and empty texts are not toxic, not contaminated and without secrets, and are near copies of each
other; null ids come first; of rows that repeat id and text one stays; columns may have any name or type, maps too; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, packing, secrets, simhash, toxicity
from tidemark.llm.common import materialise, table


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table has not got, whatever the case of its letters."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the rejecting one. The dictionaries are trained on all of ``documents``."""
    model = toxicity.fit(*toxicity.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    score = free_name(docs, "toxicity")
    return toxicity.scored(docs, model, score).where(F.col(score) < toxicity.REJECT).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest id, of rows that share it the smallest text's hash.

    Of rows that repeat both, the one whose JSON comes first stays. The rows travel as one column, so that no name clashes.
    """
    key = F.xxhash64("text").alias("key")
    groups = simhash.near_duplicates(docs.select("doc_id", "text", key), keep=("key",))
    counted = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    chosen = counted.groupBy("root").agg(F.min(F.struct("doc_id", "key", "n")).alias("first"))
    kept = materialise(
        chosen.select(F.col("first.doc_id").alias("kept_id"), F.col("first.key").alias("kept_key"), F.col("first.n").alias("n")), "kept"
    )
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), key)

    def of(part: DataFrame) -> DataFrame:
        return rows.join(part, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")

    repeated = of(kept.where("n > 1")).groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return of(kept.where("n = 1")).select("row").unionByName(repeated.select("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in the place of each secret."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs


#: Compression, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

"""Line dedup: levelled sorted runs of line hashes; each new batch merge-anti-joins the runs and adds its own.

A line's key is the line without white space at its ends, A-Z lower-cased. ``LineRuns`` holds every key of at least
``MIN_CHARS`` code points once, as the 128-bit hash of the key, in runs: bucketed and sorted tables, so that a batch
meets them in merge joins without moving them. Keys that no run holds become the batch's own run; the others become a
repeat of a known key. When a level has ``FAN`` runs, they are merged into one run of the next level. The totals of
a key are those of its one run entry and of its repeats.

Hot lines: a task first sums up its own lines (partial aggregation), so a key reaches a run once a batch however
often it stands. When lines meet the repeated keys, those that hold at least one in ``HEAVY`` of all line places, at
most ``HEAVY`` keys therefore, are broadcast; the others are joined by a shuffle. Keys travel, texts are shuffled once.

Defined results: null and empty texts are one empty line; a document is a row, and rows that share an id count each
and keep a line together where that id is the largest that holds it; a null id is smaller than any other; an empty
table gives no rows; extra columns are left behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, shared_dir, table, texts

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FAN = 2
HEAVY = 4096
STEP = 1024

#: White space as the contract has it: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def keys_of(column: pa.Array, least: int) -> tuple[pa.Array, pa.Array, list[bytes]]:
    """All lines of a column of texts, the row of each, and the hash of each line's key; b"" where the key is short."""
    lists = pc.split_pattern(column, "\n")
    lines, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=SPACE))
    long = pc.greater_equal(pc.utf8_length(keys), least)
    digest = xxhash.xxh3_128_digest
    hashes = [digest(k) if ok else b"" for k, ok in zip(keys.cast(pa.binary()).to_pylist(), long.to_pylist(), strict=True)]
    return lines, rows, hashes


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and key, once for each row and key of at least ``min_chars`` code points."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary"
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                _, rows, hashes = keys_of(part.column(1), min_chars)
                held = sorted({(r, h) for r, h in zip(rows.to_pylist(), hashes, strict=True) if h})
                ids = part.column(0).take(pa.array([r for r, _ in held], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([h for _, h in held], pa.binary())], schema=schema)

    return texts(docs).mapInArrow(scan, ddl)


class LineRuns:
    """Runs of (key, n, last), each key in one run only, and the repeats of known keys in later batches."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{shared_dir(spark)}/{self.name}"
        self.levels: list[list[str]] = [[]]
        self.repeats: list[DataFrame] = []
        self.made: list[str] = []

    def _written(self, df: DataFrame, *parts: str) -> str:
        name = f"{self.name}_{len(self.made)}"
        writer = df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{len(self.made)}")
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
        self.made.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self._read(name) for level in self.levels for name in level]

    def _read(self, name: str) -> DataFrame:
        df = self.spark.table(name)
        return df.where("not known").drop("known") if "known" in df.columns else df

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes in a batch of (doc_id, key); returns (key, n, last) of the keys that are new with it."""
        own = batch.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        own = own.repartition(self.buckets, "key")
        known = F.lit(False)
        for k, run in enumerate(self.runs()):
            own = own.join(run.select("key", F.lit(True).alias(f"in_{k}")).hint("merge"), "key", "left")
            known = known | F.coalesce(F.col(f"in_{k}"), F.lit(False))
        name = self._written(own.select("key", "n", "last", known.alias("known")), "known")
        self.repeats.append(self.spark.table(name).where("known").drop("known"))
        fresh = self._read(name)
        self.levels[0].append(name)
        self._compact()
        return fresh

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fan:
                break
            merged = self._read(level[0])
            for name in level[1:]:
                merged = merged.unionByName(self._read(name))
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._written(merged.repartition(self.buckets, "key")))
            self.levels[k] = []

    def totals(self, least: int = 1) -> DataFrame:
        """(key, n, last) of every key with at least ``least`` documents."""
        again = None
        for df in self.repeats:
            again = df if again is None else again.unionByName(df)
        if again is None:
            return self.spark.createDataFrame([], "key binary, n long, last long")
        again = again.groupBy("key").agg(F.sum("n").alias("more"), F.max("last").alias("later"))
        out = None
        for run in self.runs():
            both = run.join(again.hint("merge"), "key", "left").select(
                "key", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last")
            )
            out = both if out is None else out.unionByName(both)
        return out.where(F.col("n") >= least)

    def close(self) -> None:
        """Forgets the tables' names; the files stay in the shared folder, where frames may still read them."""
        for name in self.made:
            self.spark.sql(f"drop table if exists {name}")
        self.made = []


def repeated_lines(keys: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(key, n, last), written, of the keys of at least ``min_docs`` rows; ``keys`` goes in by batches of ids."""
    runs = LineRuns(keys.sparkSession)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for k in range(batches):
        runs.add(keys.where(part == k))
    out = materialise(runs.totals(min_docs), "repeated")
    runs.close()
    return out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, text (what stays of it), n_lines, n_dropped; a row for each row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    keys = materialise(line_keys(docs, min_chars), "lines")
    repeated = repeated_lines(keys, min_docs, batches)
    places = keys.count()
    heavy = F.col("n") * HEAVY >= places  # at most HEAVY keys: their places are all places at most
    met = keys.join(F.broadcast(repeated.where(heavy).select("key", "last", F.lit(True).alias("heavy"))), "key", "left")
    light = met.where("heavy is null").select("doc_id", "key").join(repeated.where(~heavy).select("key", "last"), "key")
    gone = met.where("heavy").select("doc_id", "key", "last").unionByName(light.select("doc_id", "key", "last"))
    gone = gone.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("key").alias("gone"))

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_dropped long"
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                drop = [set(x or ()) for x in part.column(2).to_pylist()]
                lines, rows, hashes = keys_of(part.column(1), min_chars)
                kept: list[list[str]] = [[] for _ in drop]
                total = [0] * len(drop)
                for line, row, key in zip(lines.to_pylist(), rows.to_pylist(), hashes, strict=True):
                    total[row] += 1
                    if key not in drop[row]:
                        kept[row].append(line)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(["\n".join(x) for x in kept]).cast(schema.field(1).type), pa.array(total, pa.int64()),
                     pa.array([n - len(x) for n, x in zip(total, kept, strict=True)], pa.int64())],
                    schema=schema,
                )

    held = texts(docs).join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return held.select("doc_id", "text", "gone").mapInArrow(cut, ddl)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(dedup_lines(table(spark, sf_dir, "documents")))


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.last AS dropped
  FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

"""SimHash near-duplicates: covering bit masks find every pair within the radius, components come from a join loop.

Fingerprint: the majority bits of the 64-bit XXH64 values (seed 42) of all word shingles of a text. Two
fingerprints link at ``RADIUS`` or fewer differing bits.

Covering masks: give each bit i a vector m(i) of RADIUS + 1 bits; for each vector v other than 0 the mask holds the
bits with odd <m(i), v>. At most RADIUS differing bits put RADIUS equations on RADIUS + 1 unknowns, so some v has
<m(i), v> even for each of them: under that mask the pair is equal. 31 tables of 32 bits miss no pair.

Only distinct fingerprints enter the tables. A bucket becomes a star for each of its own components, not all its
pairs; a bucket above ``BUCKET`` goes, whole, through the masks of the bits that are still free, which halve each
time, so that no task holds an unbounded group. Stars are joined up by alternating large-star and small-star steps
whose minima are pre-aggregated; each step is written to the shared folder, which cuts lineage.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows each get their
component; null ids are ignored by the minimum (a component of null ids alone has a null id); an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, rows_of, table

RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET = 20_000
ALL_BITS = (1 << 64) - 1

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str, width: int = SHINGLE) -> list[int]:
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return []
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return [h(line, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [h(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)]


def fingerprint(text: str) -> int:
    """Bit 1 where over half of the shingles' hashes, repeats included, have it."""
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, and fp (the 64 bits as a signed long)."""
    ddl = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)) + ", fp long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            fps = np.array([fingerprint(t) for t in rows["text"]], "<u8").view("<i8")
            kept = [pa.array(rows[f.name], f.type) for f in schema if f.name != "fp"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps)], schema=schema)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep).mapInArrow(run, ddl)


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The masks over the given bit numbers, as 64-bit patterns; every vector is given out equally often."""
    vectors = 1 << (radius + 1)
    given = {b: (k * 11 + 7) % vectors for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (given[b] & v).bit_count() & 1) for v in range(1, vectors)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spread(rows: DataFrame, known: int | None) -> DataFrame:
    """(mask, key, fp) for each covering mask over the bits outside ``known``; one row for each table."""
    free = [b for b in range(64) if not known >> b & 1]
    masks = sorted({known | m for m in covering_masks(free)})
    tables = F.array(*(F.lit(_signed(m)) for m in masks))
    return rows.select("fp", F.explode(tables).alias("mask")).select(
        "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp"
    )


def distance(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Differing bits; numpy counts those of a signed number's absolute value, so the sign is taken away first."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def stars(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(fp, smallest fp of its component) for the components of distinct fingerprints; the smallest ones left out."""
    left, out = np.sort(fps), []
    while len(left) > 1:
        front, left, reached = left[:1], left[1:], []
        root = int(front[0])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for f in front:
                near |= distance(left, f) <= radius
            front, left = left[near], left[~near]
            reached.append(front)
        out += [(int(f), root) for part in reached for f in part]
    return out


def _link_buckets(bucket: int):
    schema = pa.schema([("mask", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (mask, key): stars (mask null), or (mask, fp, null) for buckets too large for one task."""
        held = [np.empty(0, np.int64)] * 3
        passing = None  # the (mask, key) of a large bucket whose rows go on

        def emit(mask, a, b):
            return pa.RecordBatch.from_arrays([pa.array(mask, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        def linked(mask, key, fp):
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            begin, end = np.r_[0, cut], np.r_[cut, len(fp)]
            size = end - begin
            two = begin[size == 2]
            near = two[distance(fp[two], fp[two + 1]) <= RADIUS]
            a, b = [np.maximum(fp[near], fp[near + 1])], [np.minimum(fp[near], fp[near + 1])]
            for i, j in zip(begin[size > 2].tolist(), end[size > 2].tolist(), strict=True):
                if found := stars(fp[i:j]):
                    pairs = np.array(found, np.int64)
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            return emit([None] * len(a), a, b)

        for batch in batches:
            mask, key, fp = (c.to_numpy() for c in batch.columns)
            if passing is not None:
                n = int(np.argmin(np.r_[(mask == passing[0]) & (key == passing[1]), False]))
                if n:
                    yield emit(mask[:n], fp[:n], [None] * n)
                mask, key, fp = mask[n:], key[n:], fp[n:]
                if not len(fp):
                    continue
                passing = None
            mask, key, fp = (np.concatenate(x) for x in zip(held, (mask, key, fp), strict=True))
            # the last bucket may go on in the next batch
            same = (mask == mask[-1]) & (key == key[-1])
            n = int(np.argmax(same))
            if n:
                yield linked(mask[:n], key[:n], fp[:n])
            held = [mask[n:], key[n:], fp[n:]]
            if len(held[0]) > bucket:
                passing = (held[0][0], held[1][0])
                yield emit(held[0], held[2], [None] * len(held[0]))
                held = [np.empty(0, np.int64)] * 3
        if len(held[0]):
            yield linked(*held)

    return run


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a > b: links whose components are those of all pairs of distinct ``fp`` within the radius."""
    out, waiting, known_sets = None, fps, [0]
    while known_sets:
        parts = None
        for known in known_sets:
            rows = waiting if out is None else waiting.where(F.col("mask") == _signed(known)).select(F.col("a").alias("fp")).distinct()
            spread = _spread(rows.select("fp"), known)
            parts = spread if parts is None else parts.unionByName(spread)
        dealt = parts.repartition("mask", "key").sortWithinPartitions("mask", "key")
        step = materialise(dealt.mapInArrow(_link_buckets(bucket), "mask long, a long, b long"), "simhash-links")
        found = step.where(F.col("b").isNotNull()).select("a", "b").distinct()
        out = found if out is None else out.unionByName(found)
        # at most one row for each mask; the masks are few
        large = [r.mask for r in step.where(F.col("b").isNull()).select("mask").distinct().collect()]
        known_sets, waiting = [m & ALL_BITS for m in large], step.where(F.col("b").isNull())
    return out


def components(edges: DataFrame) -> DataFrame:
    """(v, root): each vertex that has a link, and the smallest vertex of its component."""

    def with_minimum(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(low, "u")

    def state(pairs: DataFrame) -> tuple:
        r = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    pairs = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    while (now := state(pairs)) != before:
        before = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_minimum(large)
        pairs = materialise(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "edges",
        )
    return pairs.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v"), F.col("v").alias("root")).distinct()
    )


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, fp, root (its component's smallest fingerprint), component_id (smallest doc_id reachable)."""
    own = materialise(fingerprints(docs, keep), "fingerprints")
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(own.select("fp").distinct()))
    known = first.join(roots, first.fp == roots.v, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = known.join(lowest, "root").select("fp", "root", "component_id")
    return own.join(of_fp, "fp").select("doc_id", *keep, "fp", "root", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")

"""Removal of repeated passages: every byte covered by a ``SPAN``-byte string that also starts anywhere else.

Where two such strings are equal, so are their anchors, the smallest hashed ``GRAM``-byte string in each. The
windows of a text that share an anchor form one record; equal records on different places settle each other by
their hash, within a task first and then by a sort on the anchor. Only where an anchor has different records are
their bytes needed: one copy of each such record goes, dealt out by anchor, into run-length indexes of bounded size,
whose matching statistics mark the windows that other records share.

Hot passages: equal records collapse inside each task before any shuffle, and an anchor enters an index with
distinct records only. An anchor whose distinct records exceed ``GROUP_BYTES`` is settled without an index, by
grouping its windows' hashes in Spark.

Defined results: null and empty texts have no bytes; matches never cross texts; repeated rows, with the same id or
not, are copies of each other; texts under ``SPAN`` bytes keep all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, rows_of, table, texts
from tidemark.llm.runindex import RunLengthIndex

SPAN = 200
GRAM = 32
CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
GROUP_BYTES = 8 << 20

_RANDOM = np.random.default_rng(20240229)
_BYTE_HASH = _RANDOM.integers(0, 1 << 63, 256, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 62, 16, np.uint64) * np.uint64(2) + np.uint64(1)
#: A hash's low bits give way to its place, so that the smallest also says where it is; the leftmost of equals wins.
_PLACE = np.uint64((1 << 30) - 1)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all ``width``-byte strings, by doubling."""
    powers = {1: _BYTE_HASH[data]}
    size, k = 1, 0
    while size * 2 <= width:
        powers[size * 2] = powers[size][:-size] * _ODD[k] + powers[size][size:] if len(powers[size]) > size else powers[size][:0]
        size, k = size * 2, k + 1
    out, done = powers[size], size
    for part in sorted(powers, reverse=True)[1:]:
        if done + part <= width:
            n = len(data) - done - part + 1
            out = out[:n] * _ODD[8 + part.bit_length()] + powers[part][done : done + n] if n > 0 else out[:0]
            done += part
    out = out ^ (out >> np.uint64(29))
    out = out * _ODD[7]
    return out ^ (out >> np.uint64(32))


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - size : width - size + n])


def records(data: bytes, begins: np.ndarray, lengths: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(anchor hash, record hash, text number, first window, last window, anchor's place) of each run of windows.

    Places count from the text's own beginning.
    """
    long = np.flatnonzero(lengths >= span)
    if not len(long):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    grams = rolling(np.frombuffer(data, np.uint8), gram)
    least = least_of(grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64), span - gram + 1)
    counts = lengths[long] - span + 1
    owner = np.repeat(long, counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    anchor = (least[starts] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, last = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]
    anchor, owner = anchor[new], owner[new]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    whole = np.array(
        [digest(view[a : b + span], p - a) for a, b, p in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)],
        np.uint64,
    ).view(np.int64)
    at = begins[owner]
    return grams[anchor].view(np.int64), whole, owner, first - at, last - at, anchor - at


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted union of (start, end) rows; touching ones join."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return list(zip(spans[new, 0].tolist(), reach[np.concatenate((new[1:], [len(spans)])) - 1].tolist(), strict=True))


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _find_records(ddl: str, span: int):
    schema = _schema(ddl)

    def chunk(ids, keys, data) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        begins = np.cumsum(lengths) - lengths
        anchor, whole, owner, first, last, place = records(b"".join(data), begins, lengths, span)
        order = np.lexsort((whole, anchor))
        a, w = anchor[order], whole[order]
        same = (a[1:] == a[:-1]) & (w[1:] == w[:-1])
        lead = order[np.concatenate(([True], ~same))] if len(order) else order  # one of each
        again = np.zeros(len(order), bool)
        if len(order):
            again[order[1:][same]] = again[order[:-1][same]] = True
        # what is settled here goes on as few, joined spans
        spans: list[tuple[int, int, int]] = []
        hit = np.flatnonzero(again)
        if len(hit):
            cut = np.flatnonzero(np.diff(owner[hit])) + 1
            for part in np.split(hit, cut):
                spans += [(int(owner[part[0]]), s, e) for s, e in merged(np.stack((first[part], last[part] + span), 1))]
        t = np.array([s[0] for s in spans], np.int64)
        s_, e_ = (np.array([s[k] for s in spans], np.int64) for k in (1, 2))
        owner_all = np.concatenate((owner[lead], t))
        spread = np.array([keys[k] for k in t.tolist()], np.int64) + s_
        columns = [
            np.concatenate((np.zeros(len(lead), bool), np.ones(len(t), bool))),
            np.concatenate((anchor[lead], spread)),
            np.concatenate((whole[lead], spread)),
            [ids[k] for k in owner_all.tolist()],
            [keys[k] for k in owner_all.tolist()],
            np.concatenate((first[lead], s_)),
            np.concatenate((last[lead] + span, e_)),
            np.concatenate((again[lead], np.ones(len(t), bool))),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, data, held = [], [], [], 0
        for rows in rows_of(batches, 128):
            for doc_id, key, text in zip(rows["doc_id"], rows["key"], rows["text"], strict=True):
                ids.append(doc_id)
                keys.append(key)
                data.append(text.encode("utf-8", "replace"))
                held += len(data[-1])
                if held >= CHUNK_BYTES:
                    yield chunk(ids, keys, data)
                    ids, keys, data, held = [], [], [], 0
        if data:
            yield chunk(ids, keys, data)

    return run


def _cut_records(ddl: str):
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 128):
            out: list[list] = [[] for _ in schema]
            for doc_id, key, text, wanted in zip(rows["doc_id"], rows["key"], rows["text"], rows["wanted"], strict=True):
                data = text.encode("utf-8", "replace")
                for w in wanted:
                    values = (w["anchor"], doc_id, key, w["start"], w["settled"], data[w["start"] : w["end"]])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _index_records(ddl: str, span: int, block_bytes: int, group_bytes: int):
    """Rows sorted by anchor: (doc_id, key, start, end) of what an index marks, or one row for each window of a large anchor."""
    schema = _schema(ddl)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def marked(held: list[tuple]) -> list[tuple]:
        index = RunLengthIndex([r[-1] for r in held])
        shared = index.longest >= span
        out = []
        for begin, (_, doc_id, key, start, settled, data) in zip(index.begins.tolist(), held, strict=True):
            if not settled:
                hits = np.flatnonzero(shared[begin : begin + len(data)])
                out += [(doc_id, key, start + s, start + e, None, None) for s, e in merged(np.stack((hits, hits + span), 1))]
        return out

    def windows(row: tuple) -> list[tuple]:
        anchor, doc_id, key, start, _, data = row
        hashes = rolling(np.frombuffer(data, np.uint8), span).view(np.int64).tolist()
        return [(doc_id, key, start + k, start + k + span, anchor, h) for k, h in enumerate(hashes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole anchors, then those of the current one
        closed = size = closed_size = 0
        passing = None
        for rows in rows_of(batches, 256):
            for row in zip(*rows.values(), strict=True):
                if row[0] == passing:
                    yield batch(windows(row))
                    continue
                passing = None
                if held and row[0] != held[-1][0]:
                    closed, closed_size = len(held), size
                    if size >= block_bytes:
                        yield batch(marked(held))
                        held, closed, size, closed_size = [], 0, 0, 0
                held.append(row)
                size += len(row[-1])
                if size - closed_size > group_bytes:
                    passing = row[0]
                    for large in held[closed:]:
                        yield batch(windows(large))
                    held, size = held[:closed], closed_size
        if held:
            yield batch(marked(held))

    return run


def _remove(ddl: str):
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 256):
            out: list[list] = [[] for _ in schema]
            for doc_id, text, spans in zip(rows["doc_id"], rows["text"], rows["spans"], strict=True):
                data = text.encode("utf-8", "replace")
                removed = merged(np.array([(s["start"], s["end"]) for s in spans or ()], np.int64).reshape(-1, 2))
                kept, at = [], 0
                for s, e in removed:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                values = (doc_id, len(data), removed, b"".join(kept))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            out[2] = [[{"start": s, "end": e} for s, e in r] for r in out[2]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def repeated_spans(docs: DataFrame, span: int = SPAN, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, key, start, end): parts, maybe overlapping, whose union is what repeats in the text of that id and key."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = keyed(docs)
    found = own.mapInArrow(
        _find_records(
            f"done boolean, anchor long, whole long, doc_id {id_type}, key long, start int, end int, settled boolean", span
        ),
        f"done boolean, anchor long, whole long, doc_id {id_type}, key long, start int, end int, settled boolean",
    )
    of_anchor = Window.partitionBy("anchor", "done")
    by_record = of_anchor.orderBy("whole")
    judged = materialise(
        found.select(
            "*",
            F.lag("whole").over(by_record).alias("before"),
            F.lead("whole").over(by_record).alias("after"),
            (F.min("whole").over(of_anchor) < F.max("whole").over(of_anchor)).alias("several"),
        )
        .select(
            "anchor",
            "doc_id",
            "key",
            "start",
            "end",
            (
                F.col("settled")
                | F.coalesce(F.col("before") == F.col("whole"), F.lit(False))
                | F.coalesce(F.col("after") == F.col("whole"), F.lit(False))
            ).alias("settled"),
            # one copy of each record, where its anchor has others
            (F.col("several") & ~F.col("done") & ~F.col("before").eqNullSafe(F.col("whole"))).alias("wanted"),
        )
        .where("settled or wanted"),
        "passages",
    )
    wanted = (
        judged.where("wanted")
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("anchor", "start", "end", "settled")).alias("wanted"))
    )
    cut = f"anchor long, doc_id {id_type}, key long, start int, settled boolean, data binary"
    marks = f"doc_id {id_type}, key long, start int, end int, anchor long, hash long"
    contents = joined(own, wanted, "inner").select("doc_id", "key", "text", "wanted").mapInArrow(_cut_records(cut), cut)
    indexed = materialise(
        contents.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_index_records(marks, span, block_bytes, group_bytes), marks),
        "passage-marks",
    )
    of_large = indexed.where(F.col("hash").isNotNull())
    shared = of_large.groupBy("anchor", "hash").count().where("count > 1").select("anchor", "hash")
    part = ["doc_id", "key", "start", "end"]
    return (
        judged.where("settled")
        .select(part)
        .unionByName(indexed.where(F.col("hash").isNull()).select(part))
        .unionByName(of_large.join(shared, ["anchor", "hash"], "left_semi").select(part))
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text) and text: the first two tell rows apart even where ids repeat."""
    return texts(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")


def joined(own: DataFrame, parts: DataFrame, how: str) -> DataFrame:
    """Texts with what is known for their id (null ids too) and key."""
    parts = parts.withColumnRenamed("doc_id", "part_id").withColumnRenamed("key", "part_key")
    return own.join(parts, (F.col("key") == F.col("part_key")) & F.col("doc_id").eqNullSafe(F.col("part_id")), how)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, removed (maximal spans, in bytes), kept (the remaining bytes)."""
    spans = (
        repeated_spans(docs, **options)
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # those of repeated rows once
    )
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, removed array<struct<start:int,end:int>>, kept binary"
    return joined(keyed(docs), spans, "left").select("doc_id", "text", "spans").mapInArrow(_remove(ddl), ddl)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(without_repeats(table(spark, sf_dir, "documents")))

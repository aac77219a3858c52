"""Benchmark decontamination: one Aho-Corasick automaton over the items' normalised word windows.

A text is lower-cased (A-Z) and cut into words of digits, letters and anything beyond ASCII. Every window of
``window`` consecutive item words is one pattern; an item of fewer words, but not none, is one pattern itself.
Each text passes once through the automaton, as its words joined by single spaces, and every occurrence is mapped
back to word numbers and to offsets in the original text.

The automaton's letters are numbers of item words, two letters a word, which takes a few times less memory than the
words' own letters. It holds the items, never the documents: at most ``BLOCK_BYTES`` of item text, about 130 times as
much in memory, once for each Python worker. A larger benchmark needs one more narrow pass over the texts for each
block, written before the next one, and no shuffle.

Defined results: a null or empty text has no words and no hits; repeated rows each get their own result; a null
item id is written as the empty string; items that share an id count once; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, rows_of, table, texts

WINDOW = 10
BLOCK_BYTES = 1 << 20

#: A-Z to a-z, word bytes as they are, all else to a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")
_SCANNED = "doc_id {id}, n_words long, words array<struct<first:int,last:int>>, items array<string>, text string"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


class Items:
    """The automaton over the items' windows."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.codes: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item_id, text in items:
            words = [self.codes.setdefault(w, self._code(len(self.codes))) for w in words_of(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault("".join(words[i : i + window]), set()).add(item_id)
        self.automaton = ahocorasick.Automaton() if owners else None
        for w, ids in owners.items():
            self.automaton.add_word(w, (len(w) // 2, tuple(ids)))
        if owners:
            self.automaton.make_automaton()

    @staticmethod
    def _code(number: int) -> str:
        """A first letter and a second one of different alphabets, so that no match begins within a word."""
        high, low = divmod(number, 1024)
        return chr(0x10000 + high) + chr(0x1000 + low)

    def occurrences(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of hit word numbers (last one included), and the items that occur."""
        if not self.automaton or not words:
            return [], set()
        code = self.codes.get
        hits = list(self.automaton.iter("".join([code(w, "..") for w in words])))
        merged: list[list[int]] = []
        ids: set[str] = set()
        for a, b in sorted((end // 2 - n + 1, end // 2) for end, (n, _) in hits):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for _, (_, names) in hits:
            ids.update(names)
        return [(a, b) for a, b in merged], ids


_HELD: dict[str, Items] = {}


def held_items(key: str, items: list[tuple[str, str]], window: int) -> Items:
    """The block's automaton; a worker holds that of one block at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Items(items, window)
    return _HELD[key]


def _scan(items: list[tuple[str, str]], window: int, schema: pa.Schema, keep_text: bool):
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_items(key, items, window)
        for rows in rows_of(batches):
            n_words, ranges, names = [], [], []
            for text, had, ids in zip(rows["text"], rows["words"], rows["items"], strict=True):
                words = words_of(text)
                n_words.append(len(words))
                now, new = held.occurrences(words)
                ranges.append(had + [{"first": a, "last": b} for a, b in now])
                names.append(sorted({*ids, *new}))
            found = {"doc_id": rows["doc_id"], "n_words": n_words, "words": ranges, "items": names}
            yield pa.RecordBatch.from_pydict(found | {"text": rows["text"] if keep_text else [None] * len(n_words)}, schema=schema)

    return scan


def item_blocks(benchmark: DataFrame, block_bytes: int, window: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The items in blocks of a bounded size, each with whether it is the last; read one partition at a time.

    An item longer than a block comes in parts that share ``window - 1`` words.
    """
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).distinct()

    def parts() -> Iterator[tuple[str, str]]:
        for row in rows.toLocalIterator():
            if len(row.text) <= block_bytes:
                yield row.item_id, row.text
                continue
            words = [m[0] for m in _WORD.finditer(row.text)]
            step = max(window, block_bytes // 8)
            for k in range(0, max(1, len(words) - window + 1), step):
                yield row.item_id, " ".join(words[k : k + step + window - 1])

    block, held = [], 0
    for item_id, text in parts():
        size = len(text.encode("utf-8", "replace"))
        if block and held + size > block_bytes:
            yield block, False
            block, held = [], 0
        block.append((item_id, text))
        held += size
    yield block, True


def scan_for_items(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_words, words (ranges of hit word numbers, maybe overlapping), items (sorted ids)."""
    ddl = _SCANNED.format(id=docs.schema["doc_id"].dataType.simpleString())
    out = texts(docs).select(
        "doc_id",
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("words"),
        F.expr("cast(array() as array<string>)").alias("items"),
        "text",
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out.schema)
    for block, last in item_blocks(benchmark, block_bytes, window):
        out = out.mapInArrow(_scan(block, window, schema, not last), ddl)
        if not last:
            out = materialise(out, "scanned")
    return out.drop("text")


def hit_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point offsets (end exclusive) in the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b][1]) for a, b in ranges]


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    scanned = scan_for_items(docs, benchmark, **options)
    # overlapping ranges can only come from different blocks of items; count each word once
    covered = F.aggregate(
        F.array_sort("words"),
        F.expr("named_struct('n', 0L, 'to', -1)"),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(s["to"], r["first"] - 1))).alias("n"),
            F.greatest(s["to"], r["last"]).alias("to"),
        ),
        lambda s: s["n"],
    )
    return scanned.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all their columns, whose text has no word of an item's window."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, text_at = to_arrow_schema(docs.schema), docs.columns.index("text")

    def keep(items: list[tuple[str, str]]):
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = held_items(key, items, window)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ok = pa.array([not held.occurrences(words_of(t or ""))[0] for t in part.column(text_at).to_pylist()], pa.bool_())
                    columns = [c.filter(ok).cast(f.type) for c, f in zip(part.columns, schema, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        return run

    for block, last in item_blocks(benchmark, block_bytes, window):
        docs = docs.mapInArrow(keep(block), docs.schema)
        if not last:
            docs = materialise(docs, "clean")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, least(len(w), 10) AS n, w FROM (
    SELECT item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
pats AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
wins AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM pats) WHERE len(w) >= n)),
hits AS (SELECT r, i, wins.n, item_id FROM wins JOIN pats USING (n, s)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

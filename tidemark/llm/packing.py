"""Packing token streams into training sequences by order-preserving dynamic programming.

The documents of one input partition form a token stream in their given order. Cuts may fall at document ends, at
sentence ends or, at a higher price, on a fixed grid of token positions. The program minimises padding plus the
price of the cuts: the cost of a sequence from cut i to cut j is ``window - (p_j - p_i)`` plus the price of j, so
``best[j] = window - p_j + price_j + min(best[i] + p_i)`` over the cuts at most ``window`` back, and the running
minimum is kept in a monotone queue. A sequence whose length is a power of two needs no padding; the last tokens of
a partition may therefore end in a few such sequences.

Narrow: each partition packs its own rows, a bounded number of tokens at a time, and what a flush leaves uncut
begins the next one. Sequence ids carry the partition number, so that a task run again gives the same ids.

Defined results: a null or empty text is the end id alone; ids may be null or repeat, each row is packed once;
an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of, table, texts

WINDOW = 4096
END_ID = 2
SENTENCE_PRICE = 4
CUT_PRICE = 48
GRID = 256
BLOCK_TOKENS = 1 << 19
CACHE_WORDS = 500_000

#: A lower-case word that every Unicode version and normal form leaves as it is, and marks that end it; the vocabulary
#: splits between the two. An apostrophe may begin a suffix, so it is not among the marks.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Controls that ``str.split`` takes for white space and the tokenizer does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_STRINGS = re.compile(rf"(?:\S|[{_SEPARATORS}])+")


def strings_of(text: str) -> list[str]:
    """The strings between what the tokenizer takes for white space."""
    return _STRINGS.findall(text) if any(c in text for c in _SEPARATORS) else text.split()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class TokenCache(dict):
    """Ids, as little-endian 32-bit bytes, of each string between white space; the tokenizer sees a string once.

    The vocabulary's own splitting never joins across white space, so the ids of a text are those of its strings.
    A plain word goes straight to the vocabulary's merges; anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.most = self.tokenizer.model, most
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.plain: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def __missing__(self, string: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ascii_ = string.isascii()
        parts = _PLAIN.fullmatch(string.lower() if ascii_ else string)
        if parts:
            word, marks = parts.groups()
            ids = self.plain.get(word) or self.word(word, ascii_)
            if marks:
                ids += self.marks.get(marks) or self.marked(marks)
        else:
            ids = self.whole(string)
        self[string] = ids
        return ids

    def word(self, word: str, ascii_: bool) -> bytes:
        if len(self.plain) >= self.most:
            self.plain.clear()
        spelled = word if ascii_ else word.encode().decode("latin-1").translate(self.letters)
        found = self.model.tokenize(spelled)
        ids = self.plain[word] = pack_ids(f"<{len(found)}I", *[t.id for t in found])
        return ids

    def marked(self, marks: str) -> bytes:
        if len(self.marks) >= self.most:
            self.marks.clear()
        ids = self.marks[marks] = self.whole(marks)
        return ids

    def whole(self, string: str) -> bytes:
        return np.array(self.tokenizer.encode(string, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, strings_of(text)))


_CACHES: dict[str, TokenCache] = {}


def token_cache(path: str) -> TokenCache:
    """One cache for each worker process."""
    if path not in _CACHES:
        _CACHES[path] = TokenCache(path)
    return _CACHES[path]


def cuts_of(ends: np.ndarray, sentences: np.ndarray, total: int, window: int, final: bool) -> list[int]:
    """The chosen cut positions, ascending, without 0. Not final: the last one leaves the rest for later."""
    price = np.full(total + 1, -1, np.int64)
    price[GRID::GRID] = CUT_PRICE
    price[sentences] = SENTENCE_PRICE
    price[ends] = 0
    price[0] = 0
    if final:
        price[total] = 0
    at = np.flatnonzero(price >= 0)
    p, extra = at.tolist(), price[at].tolist()
    best, back = [0.0] * len(p), [0] * len(p)
    queue = deque([(0.0, 0)])
    for j in range(1, len(p)):
        pj = p[j]
        while p[queue[0][1]] < pj - window:
            queue.popleft()
        low, i = queue[0]
        best[j], back[j] = low + window - pj + extra[j], i
        value = best[j] + pj
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    last = len(p) - 1
    tail: list[int] = []
    if final:
        # end in powers of two where their cuts cost less than padding
        cost, _, i = min(
            (best[i] + CUT_PRICE * ((total - p[i]).bit_count() - 1), -i, i)
            for i in range(len(p) - 1)
            if total - p[i] <= window
        ) if len(p) > 1 else (float("inf"), 0, 0)
        if cost < best[last]:
            last, rest, pos = i, total - p[i], p[i]
            for k in reversed(range(rest.bit_length())):
                if rest >> k & 1:
                    pos += 1 << k
                    tail.append(pos)
    else:
        last = queue[0][1]
    chosen = []
    while last > 0:
        chosen.append(p[last])
        last = back[last]
    return chosen[::-1] + tail


class Packer:
    """Packs a stream of (doc_id, ids as bytes); holds one block of tokens and its documents' places."""

    def __init__(self, window: int, stops: np.ndarray, first_sequence: int, with_ids: bool):
        self.window, self.stops, self.with_ids = window, stops, with_ids
        self.sequence = first_sequence
        self.parts: list[bytes] = []
        self.docs: list[tuple[object, int, int]] = []  # id, begin, tokens; begin may be before this block
        self.held = 0

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id, self.held, n))
        self.parts.append(ids)
        self.held += n

    def flush(self, final: bool) -> Iterator[tuple]:
        if not self.held:
            return
        raw = b"".join(self.parts)
        ids = np.frombuffer(raw, "<u4")
        ends = np.array([b + n for _, b, n in self.docs], np.int64)
        sentences = np.flatnonzero(np.isin(ids, self.stops)) + 1
        cuts = cuts_of(ends, sentences, len(ids), self.window, final)
        if not cuts:
            return
        done, k, at = cuts[-1], 0, 0
        for cut in cuts:
            begin = at
            while at < cut:
                doc_id, b, n = self.docs[k]
                to = min(cut, b + n)
                piece = raw[4 * at : 4 * to]
                yield (doc_id, at - b, to - at, zlib.crc32(piece), n, self.sequence, at - begin) + (
                    (np.frombuffer(piece, "<u4").astype(np.int64),) if self.with_ids else ()
                )
                at = to
                if at == b + n:
                    k += 1
            self.sequence += 1
        self.docs = [(d, b - done, n) for d, b, n in self.docs[k:]]
        self.parts, self.held = [raw[4 * done :]], len(ids) - done


_PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = _PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()) + ", ids array<long>" * with_ids
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = token_cache(tokenizer_path)
        stops = np.unique([np.frombuffer(cache.whole(c), "<u4")[-1] for c in ".!?"])
        end = np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        packer = Packer(window, stops, (context.partitionId() if context else 0) << 33, with_ids)

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            rows = list(packer.flush(final))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )

        for rows in rows_of(batches, 64):
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                packer.add(doc_id, cache.ids(text) + end)
                if packer.held >= BLOCK_TOKENS:
                    yield from out(False)
        yield from out(True)

    return texts(docs).mapInArrow(run, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Tokens, sequences and padding of a packing."""
    length = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(window - F.col("n"))
    return length.agg(F.sum("n").alias("tokens"), F.count("*").alias("sequences"), F.sum(pad).alias("padding"))

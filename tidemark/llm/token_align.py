"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often their ids meet.

Both tokenizers read a space and the text. Byte offsets where tokens of both end cut the tokens into groups; all pairs of
a group are links. A ``Fragment`` is what a stretch of tokens says: an open prefix (up to its first common end), closed
groups, an open suffix (after its last one). ``compose`` is associative: the left one's suffix and the right one's
prefix are aligned again, whatever closes there is closed for good. So texts over ``LONG`` characters are cut into chunks
at offsets that are safe for each tokenizer by itself, their fragments are made by different tasks, and a tree of
compositions, ``FAN`` fragments at a time, joins them. Shorter texts are cut where white space begins, safe for both;
each worker keeps the fragments of the strings it has met.

Counts: a block of texts holds each of its id pairs once, with the number of its texts that link it. Only these go to
the sums, and only these are answered; a very common pair is one row a block. Texts go through Python once. Pairs, units and
texts are rows of their own: a block as one row made Spark's readers, sorts and lists hold many blocks at once.

Defined results: texts that are null, empty or not spelled alike by both (U+2581 in a text) have no tokens: zeros and an
empty digest; every row counts as a text of its own, repeated ids or not; ids may be null; an empty table gives no rows;
extra columns are left behind. A stretch without any safe offset, one unbroken run of letters, is one chunk however long.
"""

from __future__ import annotations

import gc
import hashlib
import os
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, rows_of, table, texts

LONG = 100_000
CHUNK = 32_768
FAN = 8
BLOCK_ROWS = 4096
BLOCK_UNITS = 150_000
TOGETHER = 512
SLICE, TEXTS = 50_000, 500
CACHED = 60_000

_GAP = re.compile(r"\s[ \n]")
_BEGIN = re.compile(r"(?<=\S)(?=[ \n])")
#: The first tokenizer's pre-tokens (fixed value).
_PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the first tokenizer's pre-tokens end whatever stands around: a run of letters or digits ends, or white space begins.
_SAFE_A = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=\S)(?=\s)")


def units_of(text: str) -> list[str]:
    """A space and the text, cut before each run of white space that begins with a space or a line feed."""
    if "\x01" in text or text[0] in " \n" or _GAP.search(text):
        return _BEGIN.split(" " + text)
    return (" " + text.replace(" ", "\x01 ").replace("\n", "\x01\n")).split("\x01")


class Tokenizers:
    """Ids of both, and how many bytes each id spells; ``b`` reads a string as it stands, without the space that the model puts in front."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.lengths = [len(self.a.id_to_token(k) or "") for k in range(self.a.get_vocab_size())]
        self.short = self._ranked(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.vocab_size()
        pieces = [self.b.id_to_piece(k) for k in range(size)]
        self.spelled = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.b_lengths = [len(x) for x in self.spelled]
        self.array_a, self.array_b = np.array(self.lengths, np.int64), np.array(self.b_lengths, np.int64)
        self.odd = {k for k in range(size) if self.b.is_unknown(k) or self.b.is_control(k)}
        #: each id as it is told, with the mark that follows it: place 3 id + 0, 1 or 2
        self.told = [f"{k}{m}" for k in range(max(len(self.lengths), size)) for m in ",|;"]
        usual = [p for k, p in enumerate(pieces) if not self.b.is_byte(k) and k not in self.odd]
        #: neighbours that some piece holds: merges never cross any others
        self.inside = {p[k : k + 2].replace("▁", " ") for p in usual for k in range(len(p) - 1)}
        if any("\n" in p for p in usual):
            raise ValueError("a piece holds a line feed; it cannot set strings apart")

    def _ranked(self, path_a: str):
        """The same file read as ranks, much quicker for short strings, where its ids follow its merges; else None."""
        import json

        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # letters that stand for bytes: printable Latin-1 for itself, the others from U+0100 on in order
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in set(own)]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
        if any(vocab.get(x + y) != 256 + k for k, (x, y) in enumerate(merges)) or sorted(vocab.get(c, -1) for c in byte_of) != list(range(256)):
            return None
        special = {t["id"] for t in json.loads(self.a.to_str())["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i not in special}
        return tiktoken.Encoding("ranks", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def read_a(self, strings: list[str]) -> list[list[int]]:
        """Strings of the letters below U+0250 through the ranks, all others through the tokenizer itself."""
        if self.short is None or len(strings) == 1:
            return [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]
        short, out, others = self.short.encode_ordinary, [], []
        for k, s in enumerate(strings):
            if s.isascii() or max(s) < "\u0250":
                out.append(short(s))
            else:
                out.append([])
                others.append(k)
        for k, e in zip(others, self.a.encode_batch_fast([strings[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def read_b(self, strings: list[str]) -> list[tuple[list[int], bool]]:
        """Also whether the pieces spell the string."""
        out = []
        read = self.b.encode(["\n" + s for s in strings], num_threads=1)
        for ids in read:
            del ids[:2]  # the model's space and the line feed, which no piece joins to anything
        for k in range(0, len(strings), TOGETHER):
            some, ids = strings[k : k + TOGETHER], read[k : k + TOGETHER]
            if self._spells("".join(some), list(chain.from_iterable(ids))) and self._fit(some, ids):
                out += [(x, True) for x in ids]
            else:
                out += [(x, self._spells(s, x)) for s, x in zip(some, ids, strict=True)]
        return out

    def _spells(self, string: str, ids: list[int]) -> bool:
        return b"".join(map(self.spelled.__getitem__, ids)) == string.encode() and self.odd.isdisjoint(ids)

    def _fit(self, strings: list[str], ids: list[list[int]]) -> bool:
        """Whether each string's pieces have as many bytes as it has; where all pieces in a row spell all strings, each then spells its own."""
        ends = np.cumsum(self.array_b[np.fromiter(chain.from_iterable(ids), np.int64)])
        last = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        sizes = [len(s) if s.isascii() else len(s.encode()) for s in strings]
        return bool((np.concatenate(([0], ends))[last] == np.cumsum(sizes)).all())

    def safe_a(self, text: str, at: int) -> int:
        m = _SAFE_A.search(text, at) if 0 < at < len(text) else None
        return m.start() if m else (len(text) if at else 0)

    def safe_b(self, text: str, at: int) -> int:
        while 0 < at < len(text) and text[at - 1 : at + 1] in self.inside:
            at += 1
        return min(at, len(text))


Open = tuple[list[int], list[int], list[int], list[int]]  # ids and ends of one side, ids and ends of the other


@dataclass
class Closed:
    """What closed groups leave behind."""

    parts: list[str] = field(default_factory=list)
    groups: int = 0
    links: int = 0
    pairs: Counter = field(default_factory=Counter)

    def close(self, a: list[int], b: list[int]) -> None:
        self.parts.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        self.groups += 1
        self.links += len(a) * len(b)
        if len(a) == len(b) == 1:
            self.pairs[a[0] << 16 | b[0]] += 1
        else:
            right = Counter(b).items()
            for x, n in Counter(a).items():
                for y, m in right:
                    self.pairs[x << 16 | y] += n * m

    def add(self, other: Closed) -> None:
        self.parts += other.parts
        self.groups += other.groups
        self.links += other.links
        self.pairs.update(other.pairs)


@dataclass
class Fragment:
    """Open prefix, closed groups, open suffix. Without a common end (``cut``) all is prefix."""

    head: Open
    closed: Closed
    tail: Open
    cut: bool
    ok: bool = True

    @staticmethod
    def of(tokens: Open, ok: bool = True) -> Fragment:
        a, ea, b, eb = tokens
        common = set(ea) & set(eb)
        if not common:
            return Fragment(tokens, Closed(), ([], [], [], []), False, ok)
        closed, i, j, head = Closed(), 0, 0, None
        for x, end in enumerate(ea):
            if end not in common:
                continue
            y = eb.index(end, j)
            if head is None:
                head = (a[: x + 1], ea[: x + 1], b[: y + 1], eb[: y + 1])
            else:
                closed.close(a[i : x + 1], b[j : y + 1])
            i, j = x + 1, y + 1
        return Fragment(head, closed, (a[i:], ea[i:], b[j:], eb[j:]), True, ok)

    def compose(self, other: Fragment) -> Fragment:
        left = self.tail if self.cut else self.head
        mid = Fragment.of(tuple(x + y for x, y in zip(left, other.head, strict=True)))
        closed = Closed()
        if self.cut:
            closed.add(self.closed)
            if mid.cut:
                closed.close(mid.head[0], mid.head[2])
        closed.add(mid.closed)
        closed.add(other.closed)
        tail = other.tail if other.cut else mid.tail if mid.cut else mid.head
        head = self.head if self.cut else mid.head
        cut = self.cut or mid.cut
        return Fragment(head, closed, tail if cut else ([], [], [], []), cut, self.ok and other.ok)

    def whole(self) -> Closed:
        """The groups of a text whose only fragment this is."""
        out = Closed()
        out.close(self.head[0], self.head[2])
        out.add(self.closed)
        return out


_ONES: dict[int, bytes] = {}


def ones(k: int) -> bytes:
    """``k`` times the number 1, the same object each time."""
    if k not in _ONES:
        _ONES[k] = np.ones(k, np.int64).tobytes()
    return _ONES[k]


def closed_units(a: list[list[int]], b: list[list[int]], lengths_a: np.ndarray, lengths_b: np.ndarray, told: list[str]) -> list[tuple]:
    """What ``Fragment.of(...).whole()`` says of strings that both have read in full, all strings at once.

    (groups, n_a, n_b, n_groups, n_links, pairs, their numbers), the last two as bytes of 64-bit numbers; a pair may stand more than once.
    """
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    ids_a, ids_b = np.fromiter(chain.from_iterable(a), np.int64, int(na.sum())), np.fromiter(chain.from_iterable(b), np.int64, int(nb.sum()))
    # the strings stand one after the other, and both spell all of each: ends of strings are common ends
    ends_a, ends_b = np.cumsum(lengths_a[ids_a]), np.cumsum(lengths_b[ids_b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    size_a, size_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    first_b = np.cumsum(size_b) - size_b
    many = size_b[group_a]
    codes = np.repeat(ids_a, many) << 16 | ids_b[np.repeat(first_b[group_a] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    # the text of the groups: ids with the mark that follows them, sides of a group one after the other
    last = lambda g: np.append(np.diff(g) > 0, True)
    order = np.lexsort((np.repeat((0, 1), (len(ids_a), len(ids_b))), np.concatenate((group_a, group_b))))
    mark = np.concatenate((np.where(last(group_a), 1, 0), np.where(last(group_b), 2, 0)))
    said = list(map(told.__getitem__, (np.concatenate((ids_a, ids_b)) * 3 + mark)[order].tolist()))
    at = lambda n: np.concatenate(([0], np.cumsum(n))).tolist()
    stop_a = np.cumsum(na) - 1
    groups = np.diff(np.concatenate(([0], group_a[stop_a] + 1)))
    links = np.diff(np.concatenate(([0], np.cumsum(size_a * size_b)[group_a[stop_a]])))
    raw = codes.astype(np.int64).tobytes()
    return [
        ("".join(said[x0:x1])[:-1], n, m, g, k, raw[8 * y0 : 8 * y1], ones(k))
        for x0, x1, y0, y1, n, m, g, k in zip(*(lambda x, y: (x[:-1], x[1:], y[:-1], y[1:]))(at(na + nb), at(links)), na.tolist(), nb.tolist(), groups.tolist(), links.tolist(), strict=True)
    ]


def joined_unit(x: tuple, y: tuple) -> tuple:
    """Two strings' closed groups as one string's."""
    return f"{x[0]};{y[0]}", x[1] + y[1], x[2] + y[2], x[3] + y[3], x[4] + y[4], x[5] + y[5], x[6] + y[6]


class Units:
    """The closed groups of the strings met so far, by number. None where the two spell differently."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.keep([], [])

    def keep(self, names: list[str], rows: list[tuple | None]) -> None:
        """From now on these alone."""
        self.names, self.rows, self.said = names, rows, [r and r[0] for r in rows]
        self.number = {s: k for k, s in enumerate(names)}

    def add(self, names: list[str], rows: list[tuple | None]) -> None:
        self.number.update(zip(names, range(len(self.rows), len(self.rows) + len(names)), strict=True))
        self.names += names
        self.rows += rows
        self.said += [r and r[0] for r in rows]

    def learn(self, strings: set[str]) -> None:
        t, number = self.tokenizers, self.number
        new = strings.difference(number)
        # a mark behind a letter: both read it apart where no piece holds the two
        marked = [s for s in new if len(s) > 2 and s[-1] in ",.;:!?" and s[-2].isalpha() and s[-2:] not in t.inside]
        whole = new.difference(marked) | {s[:-1] for s in marked}.difference(number) | {s[-1] for s in marked}.difference(number)
        todo = list(whole)
        a, b = t.read_a(todo), t.read_b(todo)
        good = [k for k, (_, ok) in enumerate(b) if ok]
        rows: list[tuple | None] = [None] * len(todo)
        if good:
            made = closed_units([a[k] for k in good], [b[k][0] for k in good], t.array_a, t.array_b, t.told)
            for k, row in zip(good, made, strict=True):
                rows[k] = row
        self.add(todo, rows)
        both = [(self.rows[number[s[:-1]]], self.rows[number[s[-1]]]) for s in marked]
        self.add(marked, [joined_unit(x, y) if x and y else None for x, y in both])

    def forget(self, block: Block) -> None:
        """Keeps what at least two of a block's texts have."""
        used, n = np.unique(np.concatenate(block.bags), return_counts=True)
        kept = used[n > 1].tolist()
        self.keep([self.names[k] for k in kept], [self.rows[k] for k in kept])


_HELD: dict[tuple[str, str], Units] = {}


def units_for(path_a: str, path_b: str) -> Units:
    """One for each worker process."""
    if (path_a, path_b) not in _HELD:
        _HELD[path_a, path_b] = Units(Tokenizers(path_a, path_b))
    return _HELD[path_a, path_b]


def let_go() -> None:
    """Tokenizers and strings of this worker process, once the texts are read."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


#: A row for each pair of a block, one for its units, one for each text. No column is a list: a reader of Spark's holds 4096 rows at once.
_BLOCK = """block long, code long, docs int, at int, unit_ptr binary, unit_pair binary, unit_n binary,
doc_id {id}, n_a long, n_b long, n_groups long, n_links long, digest string, doc_unit binary, doc_n binary"""


class Block:
    """Texts as bags of units, units as bags of id pairs, and in how many of the texts each pair is linked."""

    def __init__(self, rows: list[tuple | None]):
        self.rows = rows
        self.docs: list[tuple] = []  # id and digest
        self.bags: list[np.ndarray] = []  # numbers of the units, a text after the other
        self.counts: list[np.ndarray] = []
        self.size = 0

    def doc(self, doc_id, digest: str, units: list[int]) -> None:
        bag, n = np.unique(np.array(units, np.int64), return_counts=True)
        self.docs.append((doc_id, digest))
        self.bags.append(bag)
        self.counts.append(n)
        self.size += len(bag)

    def batches(self, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Its pairs by their numbers, the units as places of pairs, the texts as places of units."""
        none = [np.empty(0, np.int64)]
        used, bags = np.unique(np.concatenate(self.bags or none), return_inverse=True)
        numbers = np.concatenate(self.counts or none)
        units = [self.rows[k] for k in used.tolist()]
        lengths = np.array([len(u[5]) // 8 for u in units], np.int64)
        ptr = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        codes, times = (np.frombuffer(b"".join([u[k] for u in units]), np.int64) for k in (5, 6))
        pairs, at = np.unique(codes, return_inverse=True)
        doc_ptr = np.concatenate(([0], np.cumsum([len(u) for u in self.bags]))).astype(np.int64)
        held = np.zeros(len(pairs), np.int64)
        for first in range(0, len(self.docs), 64):  # which texts of these have which pairs
            ends = doc_ptr[first : first + 65]
            part = bags[ends[0] : ends[-1]]
            many = lengths[part]
            places = np.repeat(ptr[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            seen = np.zeros((len(ends) - 1, len(pairs)), bool)
            seen[np.repeat(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), many), at[places]] = True
            held += seen.sum(0)
        own = np.array([u[1:5] for u in units], np.int64).reshape(-1, 4)
        sums = [np.diff(np.concatenate(([0], np.cumsum(own[bags, k] * numbers)))[doc_ptr]) for k in range(4)]
        packed = lambda values: np.asarray(values).astype(np.int32).tobytes()
        for first in range(0, len(pairs), SLICE):
            part = pairs[first : first + SLICE]
            yield _batch({"block": np.full(len(part), block), "code": part, "docs": held[first : first + SLICE]}, schema)
        yield _batch({"block": [block], "at": [-1], "unit_ptr": [packed(ptr)], "unit_pair": [packed(at)], "unit_n": [packed(times)]}, schema)
        for first in range(0, len(self.docs), TEXTS):
            docs, last = self.docs[first : first + TEXTS], min(len(self.docs), first + TEXTS)
            cuts = list(zip(doc_ptr[first:last], doc_ptr[first + 1 : last + 1], strict=True))
            yield _batch(
                {"block": np.full(len(docs), block), "at": np.arange(first, last), "doc_id": [d for d, _ in docs], "digest": [x for _, x in docs]}
                | {k: sums[i][first:last] for i, k in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                | {"doc_unit": [packed(bags[a:b]) for a, b in cuts], "doc_n": [packed(numbers[a:b]) for a, b in cuts]},
                schema,
            )


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of these columns; the others are null."""
    n = len(next(iter(columns.values())))
    column = lambda value, kind: pa.array(value).cast(kind) if isinstance(value, np.ndarray) else pa.array(value, kind)
    return pa.RecordBatch.from_arrays([column(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _row(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return _batch({k: [row[k]] for k in schema.names}, schema)


def short_blocks(docs: DataFrame, path_a: str, path_b: str, id_type: str) -> DataFrame:
    """Blocks of whole texts."""
    ddl = _BLOCK.format(id=id_type)
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = units_for(path_a, path_b)
        place = TaskContext.get().partitionId() << 33
        block = Block(cache.rows)
        for rows in rows_of(batches, 64):
            split = [units_of(t) if t else [] for t in rows["text"]]
            cache.learn(set().union(*split))
            number, said = cache.number.__getitem__, cache.said.__getitem__
            for doc_id, strings in zip(rows["doc_id"], split, strict=True):
                units = list(map(number, strings))
                found = list(map(said, units))
                if not found or None in found:
                    block.doc(doc_id, "", [])
                else:
                    block.doc(doc_id, hashlib.sha256(";".join(found).encode()).hexdigest(), units)
            if block.size >= BLOCK_UNITS or len(block.docs) >= BLOCK_ROWS:
                yield from block.batches(place, schema)
                if len(cache.rows) > CACHED:
                    cache.forget(block)
                block, place = Block(cache.rows), place + 1
        if block.docs:
            yield from block.batches(place, schema)

    return docs.mapInArrow(run, ddl)


def chunks(docs: DataFrame, path_a: str, path_b: str, id_type: str, chunk: int = CHUNK) -> DataFrame:
    """(doc, part, doc_id, string, bounds): part k has the first tokenizer's tokens between two offsets safe for it, and likewise."""
    ddl = f"doc long, part long, doc_id {id_type}, string string, at array<long>"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = units_for(path_a, path_b).tokenizers
        number = TaskContext.get().partitionId() << 33
        for rows in rows_of(batches, 1):
            text, doc_id = " " + rows["text"][0], rows["doc_id"][0]
            a = b = base_a = base_b = 0
            part = 0
            while a < len(text) or b < len(text):
                to = (part + 1) * chunk
                next_a = max(a, tokenizers.safe_a(text, min(to, len(text))))
                next_b = max(b, tokenizers.safe_b(text, min(to, len(text))))
                low = min(a, b)
                row = {"doc": number, "part": part, "doc_id": doc_id, "string": text[low : max(next_a, next_b)],
                       "at": [a - low, next_a - low, base_a, b - low, next_b - low, base_b]}
                yield _row(row, schema)
                base_a += len(text[a:next_a].encode())
                base_b += len(text[b:next_b].encode())
                a, b, part = next_a, next_b, part + 1
            number += 1

    return docs.mapInArrow(run, ddl)


_FRAGMENT = "doc long, part long, doc_id {id}, n_a long, n_b long, fragment binary"


def fragments(parts: DataFrame, path_a: str, path_b: str, id_type: str) -> DataFrame:
    ddl = _FRAGMENT.format(id=id_type)
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = units_for(path_a, path_b).tokenizers
        for rows in rows_of(batches, 1):
            row = {k: v[0] for k, v in rows.items()}
            a0, a1, base_a, b0, b1, base_b = row["at"]
            a = tokenizers.read_a([row["string"][a0:a1]])[0]
            b, ok = tokenizers.read_b([row["string"][b0:b1]])[0]
            ends = [list(accumulate((of[k] for k in ids), initial=base))[1:] for ids, of, base in ((a, tokenizers.lengths, base_a), (b, tokenizers.b_lengths, base_b))]
            made = Fragment.of((a, ends[0], b, ends[1]), ok)
            yield _row(row | {"n_a": len(a), "n_b": len(b), "fragment": pack_fragment(made)}, schema)

    return parts.mapInArrow(run, ddl)


def pack_fragment(fragment: Fragment) -> bytes:
    return zlib.compress(pickle.dumps(fragment), 1)


def unpack_fragment(raw: bytes) -> Fragment:
    return pickle.loads(zlib.decompress(raw))


def composed(parts: DataFrame, id_type: str, fan: int = FAN) -> DataFrame:
    """One round of the tree: ``fan`` neighbours become one fragment."""
    ddl = _FRAGMENT.format(id=id_type)
    schema = _schema(ddl)

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        out = unpack_fragment(rows[0]["fragment"])
        for r in rows[1:]:
            out = out.compose(unpack_fragment(r["fragment"]))
        row = {**rows[0], "n_a": sum(r["n_a"] for r in rows), "n_b": sum(r["n_b"] for r in rows), "fragment": pack_fragment(out)}
        row["part"] = rows[0]["part"] // fan
        return pa.Table.from_batches([_row(row, schema)])

    return parts.groupBy("doc", F.floor(F.col("part") / fan).alias("upper")).applyInArrow(run, ddl)


def long_blocks(docs: DataFrame, path_a: str, path_b: str, id_type: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Blocks of one text each, from the fragments of its chunks."""
    parts = chunks(docs, path_a, path_b, id_type, chunk).repartition(F.col("doc"), F.col("part"))
    made = materialise(fragments(parts, path_a, path_b, id_type), "fragments")
    last = made.agg(F.max("part")).first()[0] or 0
    if last > 0:
        while last > 0:
            made, last = composed(made, id_type, fan), last // fan
        made = materialise(made, "composed")  # else a task would hold two workers at once, the composing one and the next

    ddl = _BLOCK.format(id=id_type)
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 1):
            row = {k: v[0] for k, v in rows.items()}
            fragment = unpack_fragment(row["fragment"])
            if fragment.ok:
                got = fragment.whole()
                digest = hashlib.sha256(";".join(got.parts).encode()).hexdigest()
                unit = ("", row["n_a"], row["n_b"], got.groups, got.links, *(np.fromiter(x, np.int64, len(got.pairs)).tobytes() for x in (got.pairs, got.pairs.values())))
                block = Block([unit])
                block.doc(row["doc_id"], digest, [0])
            else:
                block = Block([])
                block.doc(row["doc_id"], "", [])
            yield from block.batches(-1 - row["doc"], schema)

    return made.mapInArrow(run, ddl)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, n, best): id pairs, first id << 16 | second, in how many texts they are linked, and whether that is the first id's most."""
    counts = blocks.where("code is not null").groupBy("code").agg(F.sum("docs").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("code", 16)))  # at most as many rows as the second vocabulary has ids
    return counts.select("code", "n", (F.col("n") == most).alias("best"))


def _summed(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[ptr])


def _answered(schema: pa.Schema):
    """Rows by block: its pairs' counts in order, its units, its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        block, counts, sums = None, [], None
        for batch in batches:
            blocks, at = batch.column("block").to_numpy(), batch.column("at").fill_null(-2).to_numpy()
            kind = np.minimum(at, 0)
            new = (np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kind) != 0)) + 1).tolist()
            for a, b in zip([0, *new], [*new, len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, counts, sums = blocks[a], [], None
                rows = batch.slice(a, b - a)
                if kind[a] == -2:
                    counts.append([rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("n", "best")])
                    continue
                held = lambda name: np.frombuffer(b"".join(rows.column(name).to_pylist()), np.int32).astype(np.int64)  # noqa: B023, E731
                if kind[a] == -1:
                    pair, times, ptr = held("unit_pair"), held("unit_n"), held("unit_ptr")
                    sums = [_summed(np.concatenate(x)[pair] * times, ptr) for x in zip(*counts, strict=True)] if counts else [np.zeros(0, np.int64)] * 2
                    counts = []
                    continue
                unit, times = held("doc_unit"), held("doc_n")
                ptr = np.cumsum([0, *(len(x) // 4 for x in rows.column("doc_unit").to_pylist())])
                n, best = (pa.array(_summed(x[unit] * times, ptr)) for x in sums)
                own = [rows.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*own, best, n, rows.column("digest")], schema=schema)

    return run


def align(docs: DataFrame, path_a: str, path_b: str, long: int = LONG, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; a row for each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = texts(docs)
    is_long = F.char_length("text") > long
    blocks = materialise(
        short_blocks(held.where(~is_long), path_a, path_b, id_type).unionByName(long_blocks(held.where(is_long), path_a, path_b, id_type, chunk, fan)),
        "aligned",
    )
    answers = blocks.where("code is not null").select("block", "code").join(pair_counts(blocks), "code")
    both = answers.unionByName(blocks.where("code is null").drop("docs"), allowMissingColumns=True)
    ddl = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    # a block's codes are in order, so that the k-th count is that of its k-th pair
    rows = both.repartition("block").sortWithinPartitions("block", F.asc_nulls_last("code"), "at").drop("code")
    return rows.mapInArrow(_answered(_schema(ddl)), ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))

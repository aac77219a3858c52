"""Language-model scores of whole documents: corpus counts, and a gated recurrent network with a class-factored softmax.

A token's probability is P(its class | all tokens before) times P(token | class). The network gives the first factor,
and for the frequent words, which share classes, the second one too. Any other token's class holds all tokens with
its first two bytes; there the second factor is the token's smoothed count among those of its class, from every
document that may be learned from.

What is gathered grows with the corpus. Counts cover all learnable documents, and all of them give the classes and train the
network: each task goes on from the same first weights with its own documents, and the weights are averaged by the tasks'
tokens, ``ROUNDS`` times. The first weights, a start for the tasks alone, are fitted on at most ``SEED_TEXTS`` pieces.

No task or driver holds the vocabulary. One pass cuts the texts into blocks; it scores each text's symbols and
writes the block's distinct tokens (as 64-bit hashes with their counts) and, for each text, which of them it has how
often. The hashes' counts are added up and joined back to each block's own tokens, in one shuffle by block.

Defined results: null and empty texts consist of the end token; repeated rows count as often as they stand there;
a null id is its empty text's checksum; with nothing to learn from, each token's base probability is 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_mod, materialise, rows_of, table, texts
from tidemark.llm.gru import Gru, Layout, Trainer, log10_likelihoods

ROUNDS = 1
SEED_TEXTS = 600
PIECE = 2000  # tokens of a training piece; a long text is trained on in several
LANES = 128
LAYOUT = Layout(classes=64, shared=15, places=16)
HIDDEN = 16
RARE = 20_000  # a word of fewer than one in so many tokens of a task is not counted for the classes
BLOCK_BYTES = 12 << 20
END = b""  # no word is empty

CLASS_OF, _ = LAYOUT.class_and_place()
FIRST_PREFIX = 1 + LAYOUT.shared
CLASSES = LAYOUT.classes


def tokens_of(text: str) -> list[bytes]:
    words = text.encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


@dataclass(frozen=True)
class SymbolMap:
    """0: the end; then the frequent words by their counts; then the first two bytes; the last symbol takes the rest."""

    words: dict[bytes, int]
    prefixes: dict[bytes, int]

    def of(self, token: bytes) -> int:
        own = self.words.get(token)
        return self.prefixes.get(token[:2], LAYOUT.symbols - 1) if own is None else own

    @classmethod
    def learn(cls, words: dict[bytes, int], prefixes: dict[bytes, int]) -> SymbolMap:
        by_count = lambda c: [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]
        most = LAYOUT.shared * LAYOUT.places
        own = {END: 0} | {w: 1 + k for k, w in enumerate(by_count(words)[:most])}
        left = Counter(prefixes)
        for w in own:
            left[w[:2]] -= words.get(w, 0)
        return cls(own, {p: 1 + most + k for k, p in enumerate(by_count(left)[: LAYOUT.symbols - 2 - most])})


@dataclass(frozen=True)
class Model:
    symbols: SymbolMap
    net: Gru


def learnable():
    return crc32_mod("doc_id", 7) != 2


def training_texts(docs: DataFrame) -> DataFrame:
    """All rows that may be learned from."""
    return texts(docs).where(learnable()).select("text")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of two bytes, all of them, and words that are not rare within the task: (is_word, string, n)."""
    words: Counter = Counter()
    for rows in rows_of(batches, 128):
        for text in rows["text"]:
            words.update(text.encode("utf-8", "replace").lower().split())
    prefixes: Counter = Counter()
    for w, n in words.items():
        prefixes[w[:2]] += n
    least = words.total() / RARE
    found = [(True, w, n) for w, n in words.items() if n >= least] + [(False, p, n) for p, n in prefixes.items()]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.bool_(), pa.binary(), pa.int64()), strict=True)], ["is_word", "string", "n"])


def learn_symbols(train: DataFrame) -> tuple[SymbolMap, np.ndarray]:
    """The symbols and their counts; the driver gets the frequent words and at most 65,793 prefixes."""
    counts = train.mapInArrow(_count_words, "is_word boolean, string binary, n long").groupBy("is_word", "string").agg(F.sum("n").alias("n"))
    words = counts.where("is_word").orderBy(F.desc("n"), "string").limit(LAYOUT.shared * LAYOUT.places).collect()
    prefixes = counts.where("not is_word").collect()
    held = {bytes(r.string): r.n for r in words}
    symbols = SymbolMap.learn(held, {bytes(r.string): r.n for r in prefixes})
    frequency = np.zeros(LAYOUT.symbols)
    for w, n in held.items():
        frequency[symbols.of(w)] += n
    for r in prefixes:
        frequency[symbols.prefixes.get(bytes(r.string), LAYOUT.symbols - 1)] += r.n
    for w, n in held.items():
        frequency[symbols.prefixes.get(w[:2], LAYOUT.symbols - 1)] -= n
    return symbols, np.maximum(frequency, 0)


def pieces_of(text: str, symbols: SymbolMap) -> list[np.ndarray]:
    tokens = tokens_of(text)
    coded = np.fromiter(map(symbols.of, tokens), np.int64, len(tokens))
    return [coded[k : k + PIECE] for k in range(0, len(coded), PIECE)]


def _train_on(model: Model, rate: float):
    """Goes on from the model's weights with the task's own documents; (place, value * tokens, tokens) of each weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen, held, size = Trainer(model.net.unflat(model.net.flat()), LAYOUT), 0, [], 0
        for rows in rows_of(batches, 128):
            for text in rows["text"]:
                new = pieces_of(text, model.symbols)
                held += new
                size += sum(map(len, new))
                if size >= 1 << 18:
                    trainer.run(held, LANES, rate)
                    seen, held, size = seen + size, [], 0
        trainer.run(held, LANES, rate)
        seen += size
        if seen:
            values = trainer.net.flat().astype(float)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * seen), pa.array(np.full(len(values), float(seen)))],
                ["place", "value", "tokens"],
            )

    return run


def fit(docs: DataFrame) -> Model:
    """Symbols and weights from all documents that may be learned from."""
    train = training_texts(docs)
    symbols, frequency = learn_symbols(train)
    net = Gru.new(LAYOUT, frequency, HIDDEN)
    seed = train.orderBy(F.xxhash64("text")).select(F.substring("text", 1, 20_000).alias("text")).limit(SEED_TEXTS).toLocalIterator()
    pieces = [p for row in seed for p in pieces_of(row.text, symbols)[:1]]
    trainer = Trainer(net, LAYOUT)
    for k in range(3):
        trainer.run(pieces, 64, 0.01 * 0.5**k)
    model = Model(symbols, net)
    for k in range(ROUNDS):
        sums = train.mapInArrow(_train_on(model, 0.004 * 0.5**k), "place int, value double, tokens double")
        means = sums.groupBy("place").agg((F.sum("value") / F.sum("tokens")).alias("value")).toPandas()  # one row for each weight
        if len(means):
            model = Model(symbols, net.unflat(means.sort_values("place")["value"].to_numpy()))
    return model


class _Numbers(dict):
    """A number for each new token."""

    def __missing__(self, token: bytes) -> int:
        self[token] = number = len(self)
        return number


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


#: No column is a list: Spark measures a batch with each row that it adds, and a list column from its beginning.
_BLOCKS = (
    "block long, number int, hash long, learned long, class int, "
    "doc_id {id}, held_out boolean, n_tokens long, net_score double, class_counts binary, which binary, often binary"
)


def _cut_blocks(model: Model, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def batch(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 24

        def close(ids, learns, coded, numbers) -> Iterator[pa.RecordBatch]:
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            flat, begins = np.concatenate(coded), np.cumsum(lengths) - lengths
            tokens = list(numbers)
            symbols = np.fromiter(map(model.symbols.of, tokens), np.int16, len(tokens))
            score = log10_likelihoods(model.net, LAYOUT, symbols[flat], begins, lengths)
            of_token = CLASS_OF[symbols].astype(np.int16)
            classes = of_token[flat]
            learned = np.bincount(flat[np.repeat(np.array(learns, bool), lengths)], minlength=len(tokens))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)).view(np.int64)
            for at in range(0, len(tokens), 50_000):
                to = min(len(tokens), at + 50_000)
                yield batch(
                    {"block": np.full(to - at, block), "number": np.arange(at, to), "hash": hashes[at:to], "learned": learned[at:to], "class": of_token[at:to]}
                )
            for at in range(0, len(ids), 500):
                part = range(at, min(len(ids), at + 500))
                which, often, counts = [], [], []
                for k in part:
                    own = flat[begins[k] : begins[k] + lengths[k]]
                    numbers_, n = np.unique(own, return_counts=True)
                    which.append(_pack(np.diff(numbers_, prepend=0)))
                    often.append(_pack(n))
                    counts.append(np.bincount(classes[begins[k] : begins[k] + lengths[k]], minlength=CLASSES))
                yield batch(
                    {
                        "block": [block] * len(part),
                        "doc_id": [ids[k] for k in part],
                        "held_out": [not learns[k] for k in part],
                        "n_tokens": lengths[at : part.stop],
                        "net_score": score[at : part.stop],
                        "class_counts": [_pack(c) for c in counts],
                        "which": which,
                        "often": often,
                    }
                )

        ids, learns, coded, numbers, held = [], [], [], _Numbers(), 0
        for rows in rows_of(batches, 128):
            for doc_id, learns_, text in zip(rows["doc_id"], rows["learns"], rows["text"], strict=True):
                tokens = tokens_of(text)
                ids.append(doc_id)
                learns.append(learns_)
                coded.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield from close(ids, learns, coded, numbers)
                    ids, learns, coded, numbers, held, block = [], [], [], _Numbers(), 0, block + 1
        if ids:
            yield from close(ids, learns, coded, numbers)

    return run


_COUNTED = (
    "doc_id {id}, held_out boolean, n_tokens long, n_known long, log_counts double, log_rare double, net_score double, "
    "class_counts array<int>, class int, class_tokens long, class_types long"
)


def _count_blocks(ddl: str):
    """Rows sorted by block, tokens before texts; also the totals of the tokens that this task saw first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, CLASSES), np.int64)
        block, parts, counts, logs, rare = None, [], None, None, None
        for arrow in batches:
            blocks = arrow.column("block").to_numpy()
            is_doc = arrow.column("number").is_null().to_numpy(zero_copy_only=False)
            new = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, parts, counts = blocks[a], [], None
                rows = arrow.slice(a, b - a)
                if not is_doc[a]:
                    number, count, kind, first = (
                        rows.column(c).to_numpy(zero_copy_only=False) for c in ("number", "count", "class", "first")
                    )
                    parts.append((number.astype(np.int64), count.astype(np.int64), kind.astype(np.int64)))
                    own, known = first.astype(bool), count > 0
                    totals[0] += np.bincount(kind[own].astype(np.int64), count[own], CLASSES).astype(np.int64)
                    totals[1] += np.bincount(kind[own & known].astype(np.int64), minlength=CLASSES)
                    continue
                if counts is None:
                    number, count, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
                    counts = np.zeros(int(number.max()) + 1, np.int64)
                    counts[number] = count
                    logs = np.log10(counts + 1.0)
                    rare = logs.copy()
                    rare[number[kind < FIRST_PREFIX]] = 0
                docs = rows.to_pydict()
                known, log_counts, log_rare = [], [], []
                for which, often in zip(docs["which"], docs["often"], strict=True):
                    at, n = np.cumsum(_unpack(which)), _unpack(often)
                    known.append(int(n[counts[at] > 0].sum()))
                    log_counts.append(float(logs[at] @ n))
                    log_rare.append(float(rare[at] @ n))
                columns = {k: docs[k] for k in ("doc_id", "held_out", "n_tokens", "net_score", "class_counts")}
                columns["class_counts"] = [_unpack(c).tolist() for c in docs["class_counts"]]
                columns |= {"n_known": known, "log_counts": log_counts, "log_rare": log_rare}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(b - a, f.type) for f in schema], schema=schema
                )
        columns = {"class": np.arange(CLASSES), "class_tokens": totals[0], "class_types": totals[1]}
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(CLASSES, f.type) for f in schema], schema=schema
        )

    return run


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model = model or fit(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = _BLOCKS.format(id=id_type)
    own = texts(docs).select("doc_id", "text", learnable().alias("learns"))
    cut = materialise(own.mapInArrow(_cut_blocks(model, blocks), blocks), "lm-blocks")
    tokens = cut.where(F.col("number").isNotNull())
    # blocks of frequent tokens are as many as the corpus has: added up before the shuffle, then joined
    corpus = tokens.groupBy("hash").agg(F.sum("learned").alias("count"), F.min("block").alias("first_block"))
    counted = tokens.select("block", "number", "class", "hash").join(corpus, "hash").select(
        "block", "number", "class", "count", (F.col("block") == F.col("first_block")).alias("first")
    )
    of_docs = cut.where(F.col("number").isNull()).select(
        "block", "doc_id", "held_out", "n_tokens", "net_score", "class_counts", "which", "often"
    )
    both = counted.unionByName(of_docs, allowMissingColumns=True).withColumn("place", 2 * F.col("block") + F.col("number").isNull().cast("long"))
    ddl = _COUNTED.format(id=id_type)
    met = materialise(
        both.repartition("block").sortWithinPartitions("place").drop("place").mapInArrow(_count_blocks(ddl), ddl), "lm-counts"
    )
    totals = {  # one row for each class
        r["class"]: (r.tokens, r.types)
        for r in met.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.sum("class_tokens").alias("tokens"), F.sum("class_types").alias("types"))
        .collect()
    }
    tokens, types = (sum(t[k] for t in totals.values()) for k in (0, 1))
    # of the end and the frequent words the network gives the whole probability
    in_class = [float(np.log10(sum(totals.get(c, (0, 0))) + 1)) if c >= FIRST_PREFIX else 0.0 for c in range(CLASSES)]
    below = F.aggregate(
        F.zip_with("class_counts", F.array(*map(F.lit, in_class)), lambda n, d: n * d),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    return met.where(F.col("class").isNull()).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1)))).alias("base_score"),
        (F.col("net_score") + F.col("log_rare") - below).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

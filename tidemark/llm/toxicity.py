"""Toxicity by compression distance: which of two trained zstandard dictionaries shortens a text's windows more.

One dictionary is trained by zstandard's trainer on ordinary texts. The other one is trained on the stretches of
toxic texts whose ``GRAM``-byte strings the ordinary texts hardly have: toxic prose is ordinary prose for the most
part, and a dictionary trained on all of it would differ from the ordinary one by chance alone. Both have the same
length. Near copies are left out of the sample, so that a copied text does not speak twice.

A window is a word, written ``REPEATS`` times, so that a frame pays for its sequences; its distance is its length under
the ordinary dictionary less that under the toxic one, and each worker measures a word once while it holds it. A
text's score is a logistic function of how many of its windows reach each threshold, in all and beyond what chance
gives an ordinary text of its length; chance and weights are calibrated on a third of the sample that trained no
dictionary.

Narrow over the scored texts; the sample has at most ``sample`` texts and ``SAMPLE_CHARS`` characters of each class, one
text for each id.

Defined results: null and empty texts get the score of a text without windows; repeated rows each get theirs; a null
id is its empty text's checksum; without labelled texts of both classes every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_mod, table

SAMPLE = 3000
SAMPLE_CHARS = 24_000_000
MOST_TEXT_CHARS = 1_000_000
GRAM = 6
RATIO = 4.0
EVIDENCE = 25.0
DICTIONARY_BYTES = 512
SEGMENT = 16
REPEATS = 4
THRESHOLDS = (1, 2, 3, 4, 6)
REJECT = 0.7
CACHE_WORDS = 500_000
LEVEL = dict(level=8, min_match=6, window_log=15, chain_log=13, hash_log=12)

_EDGES = ".,;:!?|%$&*#\"'()[]"
#: What stands between a trained dictionary's tables and its content: the three first repeat offsets.
_OFFSETS = b"".join(k.to_bytes(4, "little") for k in (1, 4, 8))


def spaced(word: str) -> bytes:
    return f" {word.strip(_EDGES)} ".encode("utf-8", "replace")


def windows_of(text: str) -> set[bytes]:
    """The distinct words, lower-case and without marks at their edges, with a space on both sides."""
    return {spaced(w) for w in text.lower().split()}


def without_copies(sample: Iterable[str], least_hashes: int = 16) -> list[str]:
    """Texts that share fewer than a quarter of their smallest three-word hashes with the earlier ones."""
    seen: set[int] = set()
    out = []
    for text in sample:
        words = text.split()
        hashes = sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})
        hashes = hashes[:least_hashes]
        if 4 * sum(h in seen for h in hashes) <= len(hashes):
            out.append(text)
        seen.update(hashes)
    return out


def grams_of(windows: Iterable[bytes]) -> np.ndarray:
    """The distinct ``GRAM``-byte strings, as numbers."""
    found = {w[i : i + GRAM] for w in windows for i in range(len(w) - GRAM + 1)}
    return np.array(sorted(int.from_bytes(g, "big") for g in found), np.int64)


def evidence(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """G statistic of a in n texts against b in m."""

    def log_likelihood(k: np.ndarray, of: int, p: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(p, 1e-12)), 0) + np.where(k < of, (of - k) * np.log1p(-np.minimum(p, 1 - 1e-12)), 0)

    a, b = a.astype(float), b.astype(float)
    p = (a + b) / (n + m)
    return 2 * (log_likelihood(a, n, a / n) + log_likelihood(b, m, b / m) - log_likelihood(a, n, p) - log_likelihood(b, m, p))


def apart(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> set[bytes]:
    """``GRAM``-byte strings that toxic texts have ``RATIO`` times as often as ordinary ones, beyond chance."""
    counts = lambda texts: np.unique(np.concatenate([grams_of(t) for t in texts]), return_counts=True)
    (own, a), (other, b) = counts(toxic), counts(ordinary)
    at = np.minimum(np.searchsorted(other, own), max(0, len(other) - 1))
    met = np.where(other[at] == own, b[at], 0) if len(other) else np.zeros(len(own), np.int64)
    n, m = len(toxic), len(ordinary)
    found = own[(a * m >= RATIO * n * met) & (evidence(a, n, met, m) >= EVIDENCE)]
    return {int(g).to_bytes(GRAM, "big") for g in found}


def stretches(windows: set[bytes], grams: set[bytes]) -> bytes:
    """The parts of the windows that the given strings cover, one after another."""
    out = []
    for w in sorted(windows):
        covered = -1
        for i in range(len(w) - GRAM + 1):
            if w[i : i + GRAM] in grams:
                out.append(w[max(i, covered) : i + GRAM])
                covered = i + GRAM
    return b"".join(out)


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Content of at most ``size`` bytes that zstandard's trainer chooses; empty where the samples are too few for it."""
    try:
        # the trainer does not count a sample's last bytes; 1,024 are room for its tables
        whole = zstandard.train_dictionary(size + 1024, [s + b" " * 8 for s in samples if s], k=SEGMENT, d=GRAM, f=20, accel=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""
    return whole[whole.index(_OFFSETS) + len(_OFFSETS) :][-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of equal length, trained on texts of either class."""
    ours, theirs = [windows_of(t) for t in toxic], [windows_of(t) for t in ordinary]
    grams = apart(ours, theirs)
    contents = trained([stretches(w, grams) for w in ours]), trained([b"".join(sorted(w)) for w in theirs])
    width = 8 + max(map(len, contents))  # a dictionary of fewer bytes than 8 is refused
    return contents[0].rjust(width), contents[1].rjust(width)


class Distance(dict):
    """Of each word as it stands in a text: its window's length under the ordinary dictionary less that under the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = (self._frame(x).compress for x in (toxic, ordinary))

    @staticmethod
    def _frame(content: bytes) -> zstandard.ZstdCompressor:
        options = dict(LEVEL)
        params = zstandard.ZstdCompressionParameters.from_level(
            options.pop("level"),
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            **options,
        )
        primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=primed, compression_params=params)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        window = spaced(word) * REPEATS
        self[word] = d = len(self.ordinary(window)) - len(self.toxic(window))
        return d

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass(frozen=True)
class Model:
    """``chance``: the share of ordinary windows that reach each of the ``THRESHOLDS``."""

    toxic: bytes
    ordinary: bytes
    chance: tuple[float, ...]
    weights: tuple[float, ...]

    def features(self, distances: np.ndarray) -> list[float]:
        n = len(distances)
        out = [1.0, min(float(distances.max(initial=0)), 12.0)]
        for least, chance in zip(THRESHOLDS, self.chance, strict=True):
            far = int((distances >= least).sum())
            out += [math.log1p(far), min(10.0, max(0.0, far - chance * n) / math.sqrt(0.5 + chance * n))]
        return out

    def score(self, distances: np.ndarray) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(distances), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Newton steps of a lightly penalised logistic regression; x has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], odds: float | None = None) -> Model | None:
    """None without texts of both classes. Every third text calibrates, the others train the dictionaries.

    ``odds``: toxic to ordinary among all labelled rows, where the sample has another ratio.
    """
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)
    if len(toxic) < 6 or len(ordinary) < 6:
        return None
    make = lambda x: [t for i, t in enumerate(x) if i % 3]
    content = dictionaries(make(toxic), make(ordinary))
    distance = Distance(*content)
    held = [(distance.of(t), y) for x, y in ((toxic[::3], 1), (ordinary[::3], 0)) for t in x]
    y = np.array([y for _, y in held], float)
    plain = np.concatenate([d for d, label in held if not label])
    chance = tuple(float((1 + (plain >= t).sum()) / (1 + len(plain))) for t in THRESHOLDS)
    model = Model(*content, chance, ())
    weights = logistic(np.array([model.features(d) for d, _ in held]), y)
    if odds:
        weights[0] += math.log(odds * (1 - y).sum() / y.sum())
    return Model(*content, chance, tuple(map(float, weights)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[str], float]:
    """At most ``sample`` texts of each class, the first by a hash of their id, and the classes' odds in all labels.

    Rows that are held out never take part. Of rows that share an id the smallest text counts; texts longer than
    ``MOST_TEXT_CHARS`` are not learned from, and a class ends at ``SAMPLE_CHARS``.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", 3) != 1))
    order = (F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"))
    n = marked.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()

    def of_class(y: int) -> list[str]:
        ids = F.broadcast(marked.where(F.col("toxic") == y).select("doc_id").distinct().orderBy(*order).limit(sample))  # at most ``sample`` ids
        rows = docs.select("doc_id", "text").where(F.char_length("text") <= MOST_TEXT_CHARS).join(ids, "doc_id")
        out, left = [], SAMPLE_CHARS
        for row in rows.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(*order).toLocalIterator():
            left -= len(row.text)
            if left < 0:
                break
            out.append(row.text)
        return out

    return of_class(1), of_class(0), (n[0] + 0.5) / (n[1] + 0.5)


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """The same rows and columns with the score, from 0 to 1, as ``name``; a column of that name gives way."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(name)
    out = docs.limit(0).withColumn(name, F.lit(0.0)).schema
    schema, text_at = to_arrow_schema(out), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.toxic, model.ordinary) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [model.score(distance.of(t or "")) if model else 0.0 for t in part.column(text_at).to_pylist()]
                columns = [c.cast(f.type) for c, f in zip(part.columns, schema, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], schema=schema)

    return docs.mapInArrow(run, out)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = scored(docs.select("doc_id", "text"), fit(*labelled_sample(docs, labels, sample)))
    return found.select(
        "doc_id",
        (crc32_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

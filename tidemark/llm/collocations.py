"""Phrase collocation mining with weighted acyclic automata, exact over all texts.

A task reads its texts as bytes, takes the window of up to five words at every word, sorts the windows of some million words
and builds count transducers from them, one for each prefix range. The ranges partition the order of windows by hashed
words so that each has about ``RANGE`` windows, whatever word or pair is common: an order-preserving position of every
window is thinned out evenly in the tasks, and its quantiles are the ranges' borders. A range's transducers are united and their
weights added. Phrases under the least count go, except those whose windows lie in more than one range, few for each
border; these are added up afterwards.

Then the counts of a candidate's parts are looked up: the candidates' parts, an acceptor, are composed with the transducer of
counts. Phrases with at least one in ``HEAVY`` of all words, at most 6 * ``HEAVY``, are in a transducer that every task has;
all other parts go by hash to the transducer that holds them, each asked for by at most a ``HEAVY``-th of the candidates' words.

Defined results: null and empty texts have no words; a null lang is ``und``; repeated rows count as often as they stand;
ids are not read; an empty table gives no rows; extra columns are left behind. Words split at U+0020 and U+0009 only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.automata import DEPTH, CountAutomaton, distinct, sort_order
from tidemark.llm.common import materialise, rows_of, table

LEAST = 100
TOP = 2000
PERCENT = 100
RANGE = 1 << 20
FLUSH = 1 << 20
BLOCK_BYTES = 2 << 20
THIN = 4096
HEAVY = 4096
LOOKUPS = 200_000

_BREAKS = ".,;:!?\x0a\x0b\x0c\x0d"
_BREAK = re.compile(r"[.,;:!?\x0a-\x0d]")
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in _BREAKS]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(11)
_VALUES = _RANDOM.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bits of a window's position that each word has.
_BITS = (24, 16, 12, 6, 5)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))


class Words:
    """Splits texts into words, all at once: hashes, pieces and places of the words of a block of texts."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def of(self, texts: list[str]):
        """(lower-cased bytes, starts, ends, piece numbers, text numbers, two hashes) of the words."""
        raw = "\n".join(texts).encode("utf-8", "replace") + b"\n"
        data = _LOWER[np.frombuffer(raw, np.uint8)]
        if len(self.up) < len(data) + 1:
            most = len(data) + len(data) // 8 + 1  # blocks are about as long as one another
            self.up, self.down = _powers(_BASE, most), _powers(_INVERSE, most)
        kind = _KIND[data]
        word = np.concatenate(([0], kind == 0, [0])).astype(np.int8)
        edge = np.diff(word)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        pieces = np.cumsum(kind == 2)[starts]
        owners = np.searchsorted(np.cumsum([len(t.encode("utf-8", "replace")) + 1 for t in texts]), starts, side="right")
        hashes = []
        for values in _VALUES:
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * self.up[: len(data)])))
            h = (total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            hashes.append(h ^ (h >> np.uint64(29)))
        return data.tobytes(), starts, ends, pieces, owners, hashes


def windows_of(labels: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """A row of up to five labels at every word, 0 beyond the piece's end."""
    out = np.zeros((len(labels), DEPTH - 1), labels.dtype)
    for k in range(min(DEPTH - 1, len(labels))):
        same = pieces[k:] == pieces[: len(pieces) - k]
        out[: len(labels) - k, k] = np.where(same, labels[k:], 0)
    return out


def lang_hash(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(lang))


def positions(langs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where windows lie in the order of hashed words: 63 bits. ``hashes``: a column for each word, 0 for none."""
    first = (hashes[:, 0] ^ langs) * np.uint64(0xD6E8FEB86659FD93)
    out = first >> np.uint64(64 - _BITS[0])
    for k, bits in enumerate(_BITS[1:], 1):
        out = out << np.uint64(bits) | hashes[:, k] >> np.uint64(64 - bits)
    return out.astype(np.int64)


def parts_of(text: str, most: int = BLOCK_BYTES) -> Iterator[str]:
    """A text, cut at breaks into parts of about ``most`` characters."""
    at = 0
    while len(text) - at > most and (m := _BREAK.search(text, at + most)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
    """Languages and texts, or parts of texts, by the block."""
    langs, held, size = [], [], 0
    for rows in rows_of(batches, 64):
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            for part in parts_of(text):
                langs.append(lang)
                held.append(part)
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield langs, held
                    langs, held, size = [], [], 0
    if held:
        yield langs, held


def phrases_in(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def borders(docs: DataFrame, size: int = RANGE) -> np.ndarray:
    """Borders of the prefix ranges: quantiles of all windows' positions."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        kept, n = [], 0

        def out() -> pa.RecordBatch:
            at = np.sort(np.concatenate(kept))[THIN // 2 :: THIN]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["at"])

        for langs, texts in blocks_of(batches):
            _, _, _, pieces, owners, (h, _) = words.of(texts)
            hashed = {x: lang_hash(x) for x in set(langs)}
            kept.append(positions(np.array([hashed[x] for x in langs], np.uint64)[owners], windows_of(h, pieces)))
            n += len(h)
            if n >= FLUSH:
                yield out()
                kept, n = [], 0
        if n:
            yield out()

    thinned = docs.mapInArrow(thin, "at long")
    thinned = materialise(thinned, "positions")
    ranges = max(1, -(-thinned.count() * THIN // size))
    if ranges == 1:
        return np.empty(0, np.int64)
    wanted = [k / ranges for k in range(1, ranges)]
    found = thinned.agg(F.percentile_approx("at", wanted, max(10_000, 20 * ranges)).alias("at")).first()["at"]
    return np.unique(np.array(found, np.int64))


def shard_automata(docs: DataFrame, at: np.ndarray) -> DataFrame:
    """(range, automaton): the count transducers of each task's sorted windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        word_of: dict[bytes, int] = {b"": 0}
        lang_of: dict[str, int] = {}
        rows: list[np.ndarray] = []
        places: list[np.ndarray] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            windows, place = np.concatenate(rows), np.concatenate(places)
            rows.clear()  # only one copy of the windows beside their sorted ones
            places.clear()
            order = sort_order(windows, place)
            windows, counts, place = distinct(windows[order], np.ones(len(order), np.int64), place[order])
            langs, spelled = list(lang_of), [w.decode("utf-8", "replace") for w in word_of]
            cuts = np.concatenate((np.flatnonzero(np.diff(place, prepend=-1)), [len(place)]))
            ids, blobs = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = windows[a:b]
                used, own = np.unique(np.concatenate((np.zeros(1, part.dtype), part[:, 1:].ravel())), return_inverse=True)
                own = np.column_stack((part[:, 0], own[1:].reshape(-1, DEPTH - 1)))
                ids.append(int(place[a]))
                blobs.append(CountAutomaton.build(langs, [spelled[w] for w in used], own, counts[a:b]).to_bytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "automaton"])

        for langs, texts in blocks_of(batches):
            data, starts, ends, pieces, owners, (h, second) = words.of(texts)
            if not len(h):
                continue
            _, first, label = np.unique(h, return_index=True, return_inverse=True)
            if (second[first][label] != second).any():  # words that agree in one hash but not in both
                _, first, label = np.unique(np.column_stack((h, second)), axis=0, return_index=True, return_inverse=True)
            own = np.array([word_of.setdefault(data[a:b], len(word_of)) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int32)
            hashed = {x: lang_hash(x) for x in set(langs)}
            named = np.array([lang_of.setdefault(x, len(lang_of) + 1) for x in langs], np.int32)
            place = positions(np.array([hashed[x] for x in langs], np.uint64)[owners], windows_of(h, pieces))
            places.append(np.searchsorted(at, place, side="right").astype(np.int32))
            rows.append(np.column_stack((named[owners], windows_of(own[label.ravel()], pieces))))
            n += len(h)
            if n >= FLUSH:
                yield from out()
                word_of, lang_of, rows, places, n = {b"": 0}, {}, [], [], 0
        if n:
            yield from out()

    return docs.mapInArrow(run, "range long, automaton binary")


_COUNTS = "lang string, phrase string, k long, f long"


def united(shards: DataFrame, at: np.ndarray, least: int) -> DataFrame:
    """(lang, phrase, k, f) by range: phrases of at least ``least``, and any that other ranges have as well; k 0 is the language."""
    hashing = Words()

    def run(group: pa.Table) -> pa.Table:
        own = group["range"][0].as_py()
        low = int(at[own - 1]) if own else -1
        high = int(at[own]) if own < len(at) else 1 << 63
        whole = CountAutomaton.union([CountAutomaton.from_bytes(b) for b in group["automaton"].to_pylist()])
        h = np.zeros(len(whole.words), np.uint64)
        if len(whole.words) > 1:
            # words may hold no break, but the first split at white space is the same one
            h[1:] = hashing.of(whole.words[1:])[5][0]
        langs = np.array([0] + [lang_hash(x) for x in whole.langs], np.uint64)
        found: list[tuple[str, str, int, int]] = []
        for d, (_, _, weight) in enumerate(whole.layers):
            states = np.arange(len(weight))
            if d:
                paths = whole.paths(d, states) if len(states) else np.zeros((0, DEPTH), np.int64)
                place = positions(langs[paths[:, 0]], h[paths[:, 1:]])
                free = sum(_BITS[d:])
                begin = place >> free << free
                inside = (begin >= low) & ((begin | (1 << free) - 1) < high)
                keep = (weight >= least) | ~inside
                states, paths = states[keep], paths[keep]
            else:
                paths = whole.paths(0, states)
            found += [(*whole.phrase(p), d, int(w)) for p, w in zip(paths, weight[states], strict=True)]
        return pa.table({k: [x[i] for x in found] for i, k in enumerate(("lang", "phrase", "k", "f"))},
                        schema=pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int64()), ("f", pa.int64())]))

    every = shards.groupBy("range").applyInArrow(run, _COUNTS)
    return every.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))


def slots_of(phrase: str) -> list[str]:
    """The empty phrase, which counts the language's words, then both parts of each cut."""
    words = phrase.split(" ")
    return [""] + [" ".join(x) for k in range(1, len(words)) for x in (words[:k], words[k:])]


def part_counts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, slot, f): the counts of all parts of the candidates."""
    total = counts.where("k = 0").agg(F.sum("f")).first()[0] or 0
    heavy = CountAutomaton.of_phrases([(r.lang, r.phrase, r.f) for r in counts.where(F.col("f") * HEAVY >= total).select("lang", "phrase", "f").collect()])
    asked = "lang string, phrase string, a long, slot long, part string, f long"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 4096):
            out = [
                (lang, phrase, a, slot, part)
                for lang, phrase, a in zip(rows["lang"], rows["phrase"], rows["a"], strict=True)
                for slot, part in enumerate(slots_of(phrase))
            ]
            f = heavy.lookup([(x[0], x[4]) for x in out])
            columns = [list(c) for c in zip(*out, strict=True)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)] + [pa.array(f, pa.int64(), mask=f == 0)],
                names=["lang", "phrase", "a", "slot", "part", "f"],
            )

    def answer(lookups: pa.Table, held: pa.Table) -> pa.Table:
        automaton = CountAutomaton.of_phrases(list(zip(held["lang"].to_pylist(), held["phrase"].to_pylist(), held["f"].to_pylist(), strict=True)))
        f = automaton.lookup(list(zip(lookups["lang"].to_pylist(), lookups["part"].to_pylist(), strict=True)))
        return lookups.select(["lang", "phrase", "a", "slot"]).append_column("f", pa.array(f, pa.int64()))

    every = materialise(candidates.select("lang", "phrase", "a").mapInArrow(ask, asked), "parts")
    buckets = max(1, -(-every.where("f is null").count() // LOOKUPS))
    to = lambda part: F.pmod(F.xxhash64("lang", part), F.lit(buckets)).alias("bucket")
    light = every.where("f is null").select("lang", "phrase", "a", "slot", "part", to("part")).groupBy("bucket")
    held = counts.where(F.col("f") * HEAVY < total).select("lang", "phrase", "f", to("phrase")).groupBy("bucket")
    found = light.cogroup(held).applyInArrow(answer, "lang string, phrase string, a long, slot long, f long")
    return every.where("f is not null").select("lang", "phrase", "a", "slot", "f").unionByName(found)


def best_cuts(parts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) with the lowest-scoring cut of each candidate, in exact integers."""
    kinds = "lang string, phrase string, a long, l long, r long, n long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 4096):
            out = []
            for lang, phrase, a, slots in zip(rows["lang"], rows["phrase"], rows["a"], rows["slots"], strict=True):
                f = {s["slot"]: s["f"] for s in slots}
                n, cuts = f[0], len(f) // 2
                score, k = min((1000 * a * n // (f[2 * k - 1] * f[2 * k]), k) for k in range(1, cuts + 1))
                out.append((lang, phrase, a, f[2 * k - 1], f[2 * k], n, score))
            columns = [list(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(columns)], names=["lang", "phrase", "a", "l", "r", "n", "score"]
            )

    return parts.groupBy("lang", "phrase", "a").agg(F.collect_list(F.struct("slot", "f")).alias("slots")).mapInArrow(run, kinds)


def phrase_counts(docs: DataFrame, least: int = LEAST, size: int = RANGE) -> DataFrame:
    """(lang, phrase, k, f), written: every phrase of 1 to 5 words with at least ``least`` occurrences; k 0 counts a language's words."""
    held = phrases_in(docs)
    at = borders(held, size)
    return materialise(united(shard_automata(held, at), at, least), "counts")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP, size: int = RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    counts = phrase_counts(docs, least, size)
    every = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"))
    # a longer phrase around this one is at most as frequent as one that is a single word longer
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))
    longer = every.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("more"))
    kept = every.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("more") < percent * F.col("a"), F.lit(True)))
    scored = best_cuts(part_counts(kept, counts))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: its first ones of each share, then the first of these
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("share", share).withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS pos FROM worded WHERE len(w) > 0
), grams AS (
  SELECT lang, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS phrase
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE pos + k - 1 <= len(w)
), counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2
), inner_of AS (
  SELECT lang, array_to_string(list_slice(w, s, s + j - 1), ' ') AS phrase, a
  FROM candidates, (SELECT unnest([2, 3, 4]) AS j), (SELECT unnest([1, 2, 3, 4]) AS s) WHERE j < k AND s + j - 1 <= k
), longest AS (
  SELECT lang, phrase, max(a) AS more FROM inner_of GROUP BY lang, phrase
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN longest o ON c.lang = o.lang AND c.phrase = o.phrase
  WHERE o.more IS NULL OR 100 * o.more < 100 * c.a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM kept c, (SELECT unnest([1, 2, 3, 4]) AS j), counted x, counted y, totals t
  WHERE j < c.k AND x.lang = c.lang AND y.lang = c.lang AND t.lang = c.lang
    AND x.phrase = array_to_string(list_slice(c.w, 1, j), ' ') AND y.phrase = array_to_string(list_slice(c.w, j + 1, c.k), ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000
"""

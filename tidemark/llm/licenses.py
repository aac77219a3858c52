"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are cut into the words of the decontamination scan and five-word shingles (fewer words: the
whole sequence). For each template size, windows a quarter longer than the template overlap so that any stretch of
its length lies wholly in one of them. A stretch with ``CONTAINED`` of a template's shingles then gives its window a
similarity of at least 0.8 / (1.25 + 0.2) = 0.55, and ``BANDS`` bands of ``ROWS`` rows miss it with a probability of
(1 - 0.55 ** 2) ** 32, about 1e-5. Windows without any template's shingle have similarity zero with all of them and
need no signature.

Narrow; the templates are a parameter of at most ``MOST_TEMPLATE_BYTES``, checked when the scan is set up.

Defined results: null and empty texts match nothing; repeated rows each get their own result; ids may be null;
without templates nothing matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of, table, texts
from tidemark.llm.decontaminate import words_of

SHINGLE = 5
CONTAINED = 0.8
BANDS, ROWS = 32, 2
MOST_TEMPLATE_BYTES = 16 << 20
CACHE_WORDS = 500_000

#: Public licence notices and lines (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("MIT-line", "Released under the MIT License."),
    (
        "MIT-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "BSD-notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "MPL-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
    ),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("All-rights-reserved", "All rights reserved."),
)

_RANDOM = np.random.default_rng(5)
_A = _RANDOM.integers(0, 1 << 62, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 62, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """A word's 64-bit hash; each worker hashes a word once while it holds it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: _Hashes, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the ``width``-word strings in their order; of the whole sequence if it is shorter; none without words."""
    x = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(x):
        return x
    width = min(width, len(x))
    n = len(x) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * _ODD[k] + x[k : k + n]
    return out ^ (out >> np.uint64(32))


def signature(h: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation, in bands."""
    mixed = h[:, None] * _A + _B
    mixed ^= mixed >> np.uint64(29)
    return mixed.min(axis=0).reshape(BANDS, ROWS)


class Templates:
    """The bands of the templates, by their number of shingles."""

    def __init__(self, templates: tuple[tuple[str, str], ...], hashes: _Hashes):
        self.hashes = hashes
        self.own, self.names, self.words = [], [], []
        self.bands: dict[tuple[int, int, bytes], list[int]] = {}
        for name, text in templates:
            words = words_of(text)
            h = np.unique(shingles(words, hashes))
            if not len(h):
                continue
            k, n = len(self.own), max(1, len(words) - SHINGLE + 1)
            self.own.append(h)
            self.names.append(name)
            self.words.append((len(words), n))
            for band, rows in enumerate(signature(h)):
                self.bands.setdefault((n, band, rows.tobytes()), []).append(k)
        self.sizes = sorted(set(self.words))
        self.all = np.unique(np.concatenate(self.own)) if self.own else np.empty(0, np.uint64)

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(name, first word, end) of each stretch whose windows contain a template, by place and name."""
        found: dict[int, list[list[int]]] = {}
        for width in sorted({min(SHINGLE, w) for w, _ in self.sizes}):
            h = shingles(words, self.hashes, width) if len(words) >= width else np.empty(0, np.uint64)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(self.all, h), len(self.all) - 1)
            hits = np.flatnonzero(self.all[at] == h)
            if not len(hits):
                continue
            for n in sorted({n for w, n in self.sizes if min(SHINGLE, w) == width}):
                stride = max(1, n // 4)
                span = n + stride - 1
                starts = {s for p in hits.tolist() for s in range(max(0, -((span - 1 - p) // stride) * stride), p + 1, stride)}
                for s in sorted(starts):
                    window = h[s : s + span]
                    near = {k for b, rows in enumerate(signature(window)) for k in self.bands.get((n, b, rows.tobytes()), ())}
                    for k in near:
                        shared = np.flatnonzero(np.isin(window, self.own[k]))
                        if len(np.unique(window[shared])) >= CONTAINED * len(self.own[k]):
                            first, end = s + int(shared[0]), s + int(shared[-1]) + width
                            runs = found.setdefault(k, [])
                            if runs and first < runs[-1][1]:
                                runs[-1][1] = max(runs[-1][1], end)
                            else:
                                runs.append([first, end])
        return sorted(((self.names[k], a, b) for k, runs in found.items() for a, b in runs), key=lambda m: (m[1], m[0]))


_FOUND = "array<struct<license:string,first:int,end:int>>"


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, found: array of (license, first word, end) by place and name."""
    if sum(len(t.encode()) for _, t in templates) > MOST_TEMPLATE_BYTES:
        raise ValueError("more template text than each task may hold; scan in several calls")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found {_FOUND}"
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Templates(templates, _Hashes())
        for rows in rows_of(batches):
            found = [
                [{"license": k, "first": a, "end": b} for k, a, b in held.matches(words_of(t))] for t in rows["text"]
            ]
            yield pa.RecordBatch.from_pydict({"doc_id": rows["doc_id"], "found": found}, schema=schema)

    return texts(docs).mapInArrow(run, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.array_distinct("found.license"))
    return licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.array_join(
            F.transform("found", lambda m: F.concat_ws(":", m["license"], m["first"].cast("string"), m["end"].cast("string"))), ","
        ).alias("spans"),
    )

"""Line dedup, token alignment and collocations: brute force, and the cases that their docstrings define."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import collocations, line_dedup, token_align
from tidemark.llm.automata import CountAutomaton, distinct, sort_order

SPACE = " \t\n\x0b\x0c\r"
KINDS = "doc_id long, text string, lang string, key long, n long, last long, block long, phrase string, at long, range long, n_lines string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null and repeated ids, copies, one long text, other columns with the operators' own names."""
    line = "  A Line of more than forty code points, which many texts Hold \t"
    long = "\n".join(f"word{k % 977} and x{k % 31}, «ça» {line if k % 500 == 0 else k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, f"short\n{line}\n{line.strip()}"), (5, long), (6, long), (6, long), (None, line), (None, None), (7, f"{line}\nx"), (8, "a▁b")]
    return spark.createDataFrame([(d, t, "en" if d else None, *(None,) * 8) for d, t in rows], KINDS)


# line dedup


def lines_by_hand(rows, least=40, docs=5):
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: low(line.strip(SPACE))
    held, last = Counter(), {}
    for d, lines in split:
        for k in {key(x) for x in lines}:
            held[k] += 1
            last[k] = d if last.get(k) is None else last[k] if d is None else max(d, last[k])
    out = []
    for d, lines in split:
        kept = [x for x in lines if not (len(key(x)) >= least and held[key(x)] >= docs and d != last[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_against_brute_force(docs, odd):
    for df in (docs, odd, odd.limit(0)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = sorted((tuple(r) for r in line_dedup.digest(line_dedup.dedup_lines(df)).collect()), key=str)
        assert got == lines_by_hand(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(odd, min_docs=3).collect() if r.doc_id}
    assert got[2].n_lines == 1 and got[1].text == "" and got[7].n_dropped == 0 and got[4].text == "short"


def test_runs_hold_each_key_once(spark):
    runs = line_dedup.LineRuns(spark, buckets=3, fan=2)
    want = defaultdict(list)
    for k in range(5):
        rows = [(d, bytes([d * j % 13])) for d in range(k * 10, k * 10 + 10) for j in (1, 2)]
        rows = sorted(set(rows)) + [(None, b"none")]
        for d, key in rows:
            want[key].append(d)
        fresh = {bytes(r.key) for r in runs.add(spark.createDataFrame(rows, "doc_id long, key binary")).collect()}
        assert fresh == {x for x, ids in want.items() if len(ids) == sum(key == x for _, key in rows)}
        assert [len(level) < 2 for level in runs.levels] == [True] * len(runs.levels)
        keys = [bytes(r.key) for run in runs.runs() for r in run.collect()]
        assert len(keys) == len(set(keys)) == len(want)
    totals = {bytes(r.key): (r.n, r["last"]) for r in runs.totals(3).collect()}
    assert totals == {x: (len(i), max((y for y in i if y is not None), default=None)) for x, i in want.items() if len(i) >= 3}
    runs.close()


def test_hot_line_stays_in_one_document(spark):
    line = "the same notice stands in every document of this table, word by word"
    df = spark.range(3000).selectExpr("id as doc_id", f"concat('own ', id, '\n{line}') as text").repartition(7)
    got = line_dedup.dedup_lines(df).where("n_dropped = 0").collect()
    assert [r.doc_id for r in got] == [2999]


# token alignment


@pytest.fixture(scope="module")
def paths():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def aligned_by_hand(rows, paths):
    """Whole texts through both tokenizers, by the contract's words."""
    tokenizers = token_align.Tokenizers(*paths)
    held = []
    for doc_id, text in rows:
        groups, na, nb = [], 0, 0
        if text:
            a = tokenizers.a.encode(" " + text, add_special_tokens=False)
            ends = [tokenizers.lengths[i] for i in a.ids]
            b = tokenizers.b.encode(text)
            if b"".join(tokenizers.spelled[i] for i in b) == (" " + text).encode():
                na, nb = len(a.ids), len(b)
                ea, eb = [sum(ends[: k + 1]) for k in range(na)], [0] * nb
                for k, i in enumerate(b):
                    eb[k] = (eb[k - 1] if k else 0) + len(tokenizers.spelled[i])
                at = 0
                for end in sorted(set(ea) & set(eb)):
                    groups.append(([i for i, e in zip(a.ids, ea, strict=True) if at < e <= end], [i for i, e in zip(b, eb, strict=True) if at < e <= end]))
                    at = end
        held.append((doc_id, na, nb, groups))
    counts = Counter(p for *_, groups in held for p in {(x, y) for g, h in groups for x in g for y in h})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, na, nb, groups in held:
        links = [(x, y) for g, h in groups for x in g for y in h]
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc_id, na, nb, len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


HARD = ["<|endoftext|> <s>", "  two  spaces \n\n lines\n", "　wide gap \t tab", "日本語の文章です。" * 40, "x" * 300, "don't  we'll 'tis", "\x01 a\x00b", "a▁b", " ", "\n", "é‍👩‍👩‍👧 end "]


def test_alignment_against_brute_force(spark, docs, odd, paths):
    rows = [(r.doc_id, (r.text or "")[:1500]) for r in docs.limit(40).collect()] + list(enumerate(HARD, 10_000)) + [(None, None), (None, "x y"), (5, "x y"), (5, "x y")]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, code int, block string").repartition(3)
    want = aligned_by_hand(rows, paths)
    assert sorted((tuple(r) for r in token_align.align(df, *paths).collect()), key=str) == want
    in_chunks = token_align.align(df, *paths, long=20, chunk=16, fan=2)
    assert sorted((tuple(r) for r in in_chunks.collect()), key=str) == want
    assert token_align.align(df.limit(0), *paths).collect() == []
    by_id = defaultdict(list)
    for r in token_align.align(odd, *paths).collect():
        by_id[r.doc_id].append(r)
    assert sum(map(len, by_id.values())) == odd.count() and by_id[8][0].n_a == 0 == by_id[1][0].n_links and by_id[8][0].groups_sha256 == ""
    assert by_id[5][0][1:] == by_id[6][0][1:] == by_id[6][1][1:] and by_id[5][0].n_a > 100_000


def test_alignment_blocks_are_flat_rows(docs, paths):
    held = token_align.texts(docs)
    blocks = token_align.short_blocks(held, *paths, "bigint")
    assert not [f.name for f in blocks.schema if "array" in f.dataType.simpleString()]
    rows = blocks.select("block", "code", "at", "doc_id").collect()
    pairs = [(r.block, r.code) for r in rows if r.code is not None]
    assert len(pairs) == len(set(pairs)) > len({b for b, _ in pairs})
    assert sorted(r.doc_id for r in rows if r["at"] is not None and r["at"] >= 0) == sorted(r.doc_id for r in held.collect())



@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30), st.data())
def test_fragments_are_a_monoid(a, b, data):
    """However the two token streams are cut and the fragments grouped, the whole is the same."""
    b.append(max(1, sum(a) - sum(b)))
    a.append(max(1, sum(b) - sum(a)))
    ends = lambda x: [sum(x[: k + 1]) for k in range(len(x))]
    ea, eb = ends(a), ends(b)
    ids = list(range(100))
    n = data.draw(st.integers(1, 5))
    cuts_a = [0, *sorted(data.draw(st.lists(st.integers(0, len(a)), min_size=n, max_size=n))), len(a)]
    cuts_b = [0, *sorted(data.draw(st.lists(st.integers(0, len(b)), min_size=n, max_size=n))), len(b)]
    parts = [token_align.Fragment.of((ids[x0:x1], ea[x0:x1], ids[y0:y1], eb[y0:y1])) for x0, x1, y0, y1 in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])]
    whole = token_align.Fragment.of((ids[: len(a)], ea, ids[: len(b)], eb)).whole()

    def tree(parts):
        if len(parts) == 1:
            return parts[0]
        k = data.draw(st.integers(1, len(parts) - 1))
        return tree(parts[:k]).compose(tree(parts[k:]))

    got = tree(parts).whole()
    assert (got.parts, got.groups, got.links, got.pairs) == (whole.parts, whole.groups, whole.links, whole.pairs)


# collocations


def phrases_by_hand(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i:j]) for p, a in cand.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and a >= f[(p[0], *p[i:j])]}
    out = defaultdict(list)
    for p, a in cand.items():
        if p not in gone:
            score, k = min((1000 * a * n[p[0]] // (f[p[:k]] * f[(p[0], *p[k:])]), k) for k in range(2, len(p)))
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[:k]], f[(p[0], *p[k:])]))
    return sorted((lang, r, p.decode(), -a, lf, rf, n[lang], -s) for lang, x in out.items() for r, (s, a, p, lf, rf) in enumerate(sorted(x)[:top], 1))


def test_collocations_against_brute_force(docs, odd, spark):
    hot = spark.createDataFrame([(k, f"New York is number{k % 40} again; new york\u0085x Été, the end of a b c d e f", ("en", None, "a\nb")[k % 3]) for k in range(400)], "doc_id long, text string, lang string")
    for df, least, top, size in ((docs, 8, 50, 5000), (odd, 100, 2000, 1 << 20), (hot.repartition(6), 5, 30, 4096), (docs.limit(0), 2, 5, 10)):
        rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
        got = sorted(tuple(r) for r in collocations.collocations(df, least, 100, top, size).collect())
        assert got == phrases_by_hand(rows, least, top)


def test_light_parts_go_to_their_transducer(spark, docs, monkeypatch):
    monkeypatch.setattr(collocations, "HEAVY", 3)
    monkeypatch.setattr(collocations, "LOOKUPS", 50)
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = sorted(tuple(r) for r in collocations.collocations(docs, 8, 100, 50).collect())
    assert got == phrases_by_hand(rows, 8, 50)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=5), min_size=1, max_size=60), st.integers(1, 4))
def test_automata_union_and_lookup(phrases, parts):
    def made(rows):
        import numpy as np

        windows = np.array([[1] + ["abcd".index(x) + 1 for x in p] + [0] * (5 - len(p)) for p in rows])
        order = sort_order(windows)
        return CountAutomaton.build(["en"], ["", *"abcd"], *distinct(windows[order], np.ones(len(rows), np.int64)))

    shards = [made(phrases[k::parts]) for k in range(parts) if phrases[k::parts]]
    whole = CountAutomaton.union([CountAutomaton.from_bytes(x.to_bytes()) for x in shards])
    asked = [("en", " ".join(p[:k])) for p in phrases for k in range(len(p) + 1)] + [("en", "a z"), ("de", "a"), ("en", "d d d d d")]
    want = [sum(lang == "en" and p[: len(x.split())] == x.split() for p in phrases) for lang, x in asked]
    assert whole.lookup(asked).tolist() == want

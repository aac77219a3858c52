"""Secret scan: fixed patterns, and strings in a sensitive context that no dictionary explains.

Patterns (leftmost, non-overlapping for each kind): an assignment to a secret's name, an access key id, a long hex
run. Beyond them, every string in the context of a sensitive word (what follows it on its line and the next few, and
the whole body of a private key) is a candidate; its novelty is the number of bytes it adds to the zstandard frame of
its surroundings without its other copies, primed with a dictionary of common identifiers, per byte of its own. Words
and names are cheap there; a random key is not, and is reported as ``novel``.

Narrow: one pass over the texts. Offsets are code points, end exclusive.

Defined results: null and empty texts have no findings; repeated rows each get their own; ids may be null.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of, table, texts

KINDS = ("assign", "access", "hex", "novel")
MIN_NOVELTY = 0.75
CONTEXT = 160
CONTEXT_LINES = 3
AROUND = 400

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_SENSITIVE = re.compile(r"passw|passphrase|secret|token|key|auth|bearer|credential|private|signature", re.A | re.I)
_BEGIN = re.compile(r"-----BEGIN( [A-Z0-9 ]*)-----")
#: Lower-case letters alone: a rare compound word costs a frame as much as chance letters do, so none is a candidate.
_WORDS = re.compile(r"[a-z+/_=~-]+")
#: A string of 16 characters or more with a digit.
_CODED = re.compile(r"(?<![A-Za-z0-9+/_=~-])(?=[A-Za-z+/_=~-]*[0-9])[A-Za-z0-9+/_=~-]{16,}")
#: A whole string of 16 characters or more.
_STRING = re.compile(r"(?<![A-Za-z0-9+/_=~-])[A-Za-z0-9+/_=~-]{16,}")

#: Words that code and configuration use all the time; raw zstandard dictionary content.
IDENTIFIERS = " ".join(
    """
    access account action address admin algorithm allow amount api app application args array async attribute auth
    authorization await backend base64 batch begin bind boolean bucket buffer build bytes cache callback certificate
    channel class client cluster code column command commit config configuration connect connection const constructor
    container content context controller cookie copy count create credential current cursor data database date debug
    decode default define delete dependency deploy description device dict digest directory disable document domain
    double download driver dump element email enable encode encrypt endpoint entity entry enum environment error event
    example exception execute expire export extends false field file filter final float folder format from function
    generate get group handler hash header host html http https identifier image implements import include index info
    init input insert instance int integer interface internal item iterator javascript json kernel key label lambda
    language layer layout length level library limit line list listener load local location lock logger login long
    main manager map master match memory message metadata method middleware migration mode model module mutex name
    namespace native network node none null number object offset operation option order output override owner package
    page parameter params parent parse partition password path payload pending permission platform plugin policy pool
    port position postgres prefix primary print private process producer production profile project property protected
    protocol provider proxy public publish python query queue random range read record redirect redis reference region
    register release remote remove render replace replica repository request require reset resource response result
    return role root route router runtime sample schedule schema scope script search secret section security select
    sequence server service session setting shard shared signature size socket source spark stage staging start state
    static status storage store stream string struct style subject submit subscribe success super switch sync system
    table target task template temp tenant test text thread throw time timeout timestamp title token topic total trace
    transaction transform true type undefined unique update upload uri url user username utf8 uuid validate value
    variable version view virtual void volume wait warning web webhook window worker workspace wrapper write yaml zone
    abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 your_api_key_here changeme placeholder xxxxxxxxxxxxxxxx
    """.split()
)


class Novelty:
    """Bytes that a string adds to its surroundings' frame, per byte of its own."""

    def __init__(self, dictionary: str = IDENTIFIERS, level: int = 9):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.frame = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False)

    def of(self, text: str, start: int, end: int, around: int = AROUND) -> float:
        own = text[start:end]
        reach = around + len(own) - 1  # copies that the edges cut go as well
        # nor do other strings with digits explain this one: a list of keys would lend each its letters' code
        before = _CODED.sub(" ", text[max(0, start - reach) : start].replace(own, " ")[-around:])
        after = _CODED.sub(" ", text[end : end + reach].replace(own, " ")[:around])
        with_own = len(self.frame.compress((before + own + after).encode("utf-8", "replace")))
        without = len(self.frame.compress((before + after).encode("utf-8", "replace")))
        return (with_own - without) / len(own.encode("utf-8", "replace"))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind as listed."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def bodies_of(text: str) -> list[tuple[int, int]]:
    """Ranges between the first and last line of private keys."""
    if "PRIVATE KEY" not in text:
        return []
    ends = [m.start() for m in re.finditer("-----END", text)] + [len(text)]
    begins = [m.end() for m in _BEGIN.finditer(text) if " PRIVATE KEY" in m[1]]
    # of begin lines without an end between them one body is enough
    bodies = {ends[bisect_left(ends, a)]: a for a in reversed(begins)}
    return sorted((a, b) for b, a in bodies.items())


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending ranges that do not meet, with the same union."""
    out: list[tuple[int, int]] = []
    for begin, stop in sorted(ranges):
        if out and begin <= out[-1][1]:
            begin, stop = out[-1][0], max(out.pop()[1], stop)
        out.append((begin, stop))
    return out


def contexts_of(text: str, bodies: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where candidates may begin, as ascending ranges that do not meet."""
    ranges = list(bodies)
    for m in _SENSITIVE.finditer(text):
        begin = stop = m.end()
        for _ in range(CONTEXT_LINES + 1):
            stop = text.find("\n", stop, begin + CONTEXT) + 1
            if not stop:
                stop = begin + CONTEXT
                break
        ranges.append((begin, stop))
    return merged(ranges)


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty, least: float = MIN_NOVELTY):
    """(start, end, kind, novelty) of the incompressible strings in a sensitive context outside ``taken``."""
    found, bodies = [], bodies_of(text)
    if not (contexts := contexts_of(text, bodies)):
        return found
    held = merged([(s, e) for s, e, _ in taken])
    held_ends, body_ends = [e for _, e in held], [b for _, b in bodies]
    for at, stop in contexts:
        # 15 characters more, so that a string that begins within the range is seen
        while m := _STRING.search(text, at, min(len(text), stop + 15)):
            start, end = _STRING.match(text, m.start()).span()
            at = end
            k = bisect_right(held_ends, start)
            if k < len(held) and held[k][0] < end:
                continue
            own = text[start:end]
            if _WORDS.fullmatch(own):
                continue
            k = bisect_right(body_ends, start)
            body = bodies[k] if k < len(bodies) and bodies[k][0] <= start else None
            if body:  # the body's other lines are no surroundings: they would lend their letters' code
                before = text[max(0, body[0] - AROUND) : body[0]]
                score = novelty.of(before + own + text[body[1] : body[1] + AROUND], len(before), len(before) + len(own))
            else:
                score = novelty.of(text, start, end)
            if score >= least:
                found.append((start, end, "novel", score))
    return found


def findings_of(text: str, novelty: Novelty, least: float = MIN_NOVELTY) -> list[tuple[int, int, str, float]]:
    base = base_spans(text)
    return sorted(
        [(s, e, k, 1.0) for s, e, k in base] + novel_spans(text, base, novelty, least),
        key=lambda s: (s[0], KINDS.index(s[2])),
    )


_FINDING = "array<struct<kind:string,start:int,end:int,novelty:double>>"


def secrets(docs: DataFrame, least: float = MIN_NOVELTY) -> DataFrame:
    """doc_id, findings: array of (kind, start, end, novelty) by start, then kind; fixed patterns have novelty 1."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, findings {_FINDING}"
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for rows in rows_of(batches):
            found = [
                [{"kind": k, "start": s, "end": e, "novelty": x} for s, e, k, x in findings_of(t, novelty, least)]
                for t in rows["text"]
            ]
            yield pa.RecordBatch.from_pydict({"doc_id": rows["doc_id"], "findings": found}, schema=schema)

    return texts(docs).mapInArrow(scan, ddl)


def redact(docs: DataFrame, mark: str = "<secret>", least: float = MIN_NOVELTY) -> DataFrame:
    """The same rows and columns; each finding in ``text`` gives way to ``mark`` and ``n_chars`` follows. Null stays null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, ddl = to_arrow_schema(docs.schema), docs.schema
    text_at = docs.columns.index("text")

    def clean(text: str | None, novelty: Novelty) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, end, _, _ in findings_of(text, novelty, least):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:] if out else text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts_ = pa.array([clean(t, novelty) for t in part.column(text_at).to_pylist()], schema.field(text_at).type)
                yield pa.RecordBatch.from_arrays(
                    [texts_ if k == text_at else c.cast(schema.field(k).type) for k, c in enumerate(part.columns)], schema=schema
                )

    out = docs.mapInArrow(scan, ddl)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def _joined(findings: Column) -> Column:
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ","
    )


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda f: f["kind"] != "novel")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secrets(table(spark, sf_dir, "documents")))

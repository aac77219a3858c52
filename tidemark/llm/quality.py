"""Quality rules: one table of thresholds, compiled into one Spark projection without user functions.

Words are runs of anything but ASCII white space. Repeated five-word windows are found by sorting, within the row,
64-bit window hashes whose low bits hold the window's place; neighbours that agree are compared word by word. A row
where two different windows agree sorts the windows themselves instead.

Narrow and inside the JVM. Defined results: a null or empty text has no words, fails the base rule and is not kept;
repeated rows each get their own result; ids may be null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, texts

WHITE = " \t\n\u000b\f\r"
_WHITE_CLASS = r"[ \t\n\x0B\f\r]"
SPAN = 5

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they "
    "you were their one all we can her has there been if more when will would who so no "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous "
    "comme mais on tout y aux cette ses être fait elle deux même si leur "
    "el los del y las por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre "
    "también me hasta hay donde quien desde todo nos durante uno ni contra otros ese eso ante ellos e esto"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, f"{_WHITE_CLASS}+"))


def window_hash(hashes: Column, at: Column, span: int) -> Column:
    """A hash of the ``span`` words' hashes from a place on."""
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(span)))


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """How many words stand in a ``span``-word window that the text has twice or more."""

    def packed(n: Column, bits: Column) -> Column:
        return let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda hs: F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), n - span),
                    lambda i: F.call_function(
                        "shiftleft",
                        F.call_function("shiftright", window_hash(hs, i, span), bits),
                        bits,
                    ).bitwiseOR(i.cast("long")),
                )
            ),
        )

    def starts(order: Column, n: Column, bits: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        place = lambda x: x.bitwiseAND(low).cast("int")
        prefix = lambda x: F.call_function("shiftright", x, bits)
        window = lambda x: F.slice(words, place(x) + 1, F.lit(span))
        agree = lambda x, y: F.coalesce(prefix(x) == prefix(y), F.lit(False))
        found = F.transform(
            order,
            lambda x, k: F.when(
                agree(x, F.get(order, k + 1)), F.when(window(x) == window(F.get(order, k + 1)), place(x)).otherwise(-2)
            ).otherwise(F.when(agree(x, F.get(order, k - 1)) & (window(x) == window(F.get(order, k - 1))), place(x)).otherwise(-1)),
        )
        return let(found, lambda f: F.when(F.array_contains(f, -2), exact(n)).otherwise(F.sort_array(F.filter(f, lambda s: s >= 0))))

    def exact(n: Column) -> Column:
        """Starts of repeated windows by sorting the windows."""
        windows = F.sort_array(
            F.transform(F.sequence(F.lit(0), n - span), lambda i: F.struct(F.slice(words, i + 1, F.lit(span)).alias("w"), i.alias("i")))
        )
        return let(
            windows,
            lambda all_: F.sort_array(
                F.transform(
                    F.filter(all_, lambda x, k: F.coalesce(x["w"] == F.get(all_, k + 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(all_, k - 1)["w"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(begin: Column) -> Column:
        return F.aggregate(
            begin,
            F.expr("named_struct('n', 0L, 'to', 0)"),
            lambda a, s: F.struct(
                (a["n"] + s + span - F.greatest(a["to"], s)).alias("n"), (s + span).alias("to")
            ),
            lambda a: a["n"],
        )

    n = F.size(words)
    bits = F.length(F.bin(n))
    return F.when(n <= span, F.lit(0).cast("long")).otherwise(
        let(packed(n, bits), lambda order: covered(starts(order, n, bits)))
    )


def duplicate_lines(lines: Column) -> Column:
    with_word = F.filter(lines, lambda line: F.btrim(line, F.lit(WHITE)) != "")
    return let(with_word, lambda kept: (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use, one projection over each text."""
    lines = F.split("text", "\n")
    stops = F.array(*map(F.lit, sorted(set(STOP_WORDS))))
    bare = F.col("text")
    for c in WHITE:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return (
        texts(docs)
        .select("doc_id", "text", words_of(F.col("text")).alias("words"))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.char_length(bare).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            duplicate_lines(lines).alias("n_dup_lines"),
            let(F.col("words"), lambda w: repeated_words(w)).alias("n_repeat_words"),
            F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
            F.size(F.array_intersect(F.split(F.lower("text"), r"[^\p{L}]+"), stops)).cast("long").alias("n_stop_words"),
            F.regexp_count("text", F.lit(r"(?m)(\.\.\.|…)[ \t]*$")).cast("long").alias("n_open_lines"),
            F.regexp_count("text", F.lit(r"(?m)^[ \t]*[-*•] ")).cast("long").alias("n_list_lines"),
            F.regexp_count("text", F.lit("!!|\\?\\?")).cast("long").alias("n_shouts"),
        )
    )


#: (name, value, least, most): a text is kept if each value that it has lies within its bounds.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean word length", "word_chars / n_words", 1.5, 20.0),
    ("symbols to words", "n_symbols / n_words", None, 0.25),
    ("repeated lines", "n_dup_lines / n_lines", None, 0.5),
    ("distinct stop words, of at most two", "least(n_stop_words, 2) / 2", 0.5, None),
    ("lines that trail off", "n_open_lines / n_lines", None, 0.5),
    ("list lines", "n_list_lines / n_lines", None, 0.9),
    ("shouts to words", "n_shouts / n_words", None, 0.25),
)
BASE_RULE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def compiled(rules=RULES) -> Column:
    """The table as one condition; a value that is null, as with no words, passes."""
    ok = F.lit(True)
    for _, value, least, most in rules:
        x = F.expr("try_divide({}, {})".format(*value.split(" / ")))
        for bound, test in ((least, x.__ge__), (most, x.__le__)):
            if bound is not None:
                ok = ok & F.coalesce(test(F.lit(bound)), F.lit(True))
    return ok


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measures with base_failed and kept."""
    return (
        measures(docs)
        .withColumn("base_failed", F.expr(BASE_RULE))
        .withColumn("kept", ~F.col("base_failed") & compiled(rules))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = (
    r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
wins AS (
  SELECT r, i, w[i:i + 4] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM cut WHERE len(w) >= 5)),
again AS (SELECT r, i FROM wins JOIN (SELECT r, s FROM wins GROUP BY r, s HAVING count(*) > 1) USING (r, s)),
spans AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM again) GROUP BY r),
counts AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(string_split(t, chr(10))) AS n_lines,
         len(list_intersect(list_distinct(regexp_split_to_array(lower(t), '[^\p{L}]+')), [STOPS])) AS n_stop_words,
         len(regexp_extract_all(t, '(?m)(\.\.\.|…)[ \t]*$')) AS n_open_lines,
         len(regexp_extract_all(t, '(?m)^[ \t]*[-*•] ')) AS n_list_lines,
         len(regexp_extract_all(t, '!!|\?\?')) AS n_shouts
  FROM cut LEFT JOIN spans USING (r)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND RULES AS kept
FROM failed
"""
).replace("STOPS", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))).replace(
    "RULES",
    " AND ".join(
        f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0) {test} {bound}, true)"
        for _, value, least, most in RULES
        for a, b in [value.split(" / ")]
        for bound, test in ((least, ">="), (most, "<="))
        if bound is not None
    ),
)

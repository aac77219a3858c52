"""Chat formatting: tool calls and their results linked, ordered, validated and written as canonical JSON.

Calls and results are rows; a hash join on the identifier links them. Calls may wait for others: a call's level is
one more than that of the last call it waits for. Calls that wait for one other form chains, whose levels come from
pointer doubling, so that a chain of n calls takes log n joins. Calls that wait for several are placed round by round
over the chains, contracted, between them. What waits for itself, or for such a call, gets no level and goes last.

Arguments are JSON. They are parsed into variants, held against a table of fields, which is compiled into one
projection, and written with sorted keys and without blanks. Only DataFrame operations take part.

A table of turns without explicit calls is read as traffic with two tools, ``reply`` and, for several lines,
``draft``: a user's turn is a call, the assistant's turns after it are its results, and a call waits for the one
before it in its conversation. Turns are numbered by ranges of rows, so that one conversation may hold any share of
the table; the output has one row for each call, never one for a whole conversation.

Defined results: repeated rows count once; null text is a missing argument; null conversations form one conversation,
apart from that of an empty name; an assistant's turn before any user's is an orphan; of several results the first
counts and the others are told; arguments that are no JSON are not valid and are written as a string; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, table


@dataclass(frozen=True)
class Field:
    """A field of a tool's arguments: its JSON type, required or not, with bounds of the value or of its length."""

    name: str
    kind: str
    required: bool = True
    least: int | None = None
    most: int | None = None


#: tool -> its fields
SCHEMAS: dict[str, tuple[Field, ...]] = {
    "reply": (Field("text", "string", True, 1, 200_000), Field("turn", "integer", True, 0, None)),
    "draft": (
        Field("lines", "integer", True, 2, 1_000),
        Field("text", "string", True, 3, 200_000),
        Field("turn", "integer", True, 0, None),
    ),
}

#: JSON type -> (what a variant's own schema begins with, the type to read it as)
_KINDS = {
    "string": (("STRING",), "string"),
    "integer": (("BIGINT",), "bigint"),
    "number": (("BIGINT", "DECIMAL", "DOUBLE"), "double"),
    "boolean": (("BOOLEAN",), "boolean"),
    "array": (("ARRAY",), "array<variant>"),
    "object": (("OBJECT",), "map<string,variant>"),
}


def valid(tool: Column, arguments: Column, schemas: dict[str, tuple[Field, ...]] = SCHEMAS) -> Column:
    """Whether arguments, a variant, satisfy their tool's fields; an unknown tool's never do."""
    ok = F.lit(False)
    for name, fields in schemas.items():
        fits = F.startswith(F.schema_of_variant(arguments), F.lit("OBJECT"))
        for field in fields:
            path = f"$['{field.name}']"
            begins, read_as = _KINDS[field.kind]
            own = F.try_variant_get(arguments, path, "variant")
            value = F.try_variant_get(arguments, path, read_as)
            size = {"string": F.char_length, "array": F.size, "object": F.size}.get(field.kind, lambda x: x)(value)
            good = F.lit(False)
            for begin in begins:
                good = good | F.startswith(F.schema_of_variant(own), F.lit(begin))
            for bound, test in ((field.least, size.__ge__), (field.most, size.__le__)):
                good = good & test(bound) if bound is not None else good
            fits = fits & F.coalesce(good if field.required else own.isNull() | good, F.lit(False))
        ok = F.when(tool == name, fits).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys and no blanks; what is no JSON, or too large to parse, as a JSON string."""
    quoted = F.to_json(F.array(arguments))
    return F.coalesce(
        F.to_json(F.try_parse_json(arguments)), F.when(arguments.isNotNull(), quoted.substr(F.lit(2), F.length(quoted) - 2)), F.lit("null")
    )


def _chains(single: DataFrame) -> DataFrame:
    """(call_id, on) to (call_id, head, steps): the first call up the chain that is not in ``single``; none for cycles."""
    heads = single.select(F.col("call_id").alias("head"), F.col("on").alias("next"))
    state = materialise(
        single.join(heads.select("head", F.lit(True).alias("goes_on")), single["on"] == F.col("head"), "left").select(
            "call_id", F.col("on").alias("head"), F.lit(1).cast("long").alias("steps"), F.col("goes_on").isNull().alias("done")
        ),
        "chains",
    )
    for _ in range(1 + math.ceil(math.log2(1 + state.count()))):
        if state.where("not done").isEmpty():
            break
        ahead = state.select(
            F.col("call_id").alias("at"), F.col("head").alias("far"), F.col("steps").alias("more"), F.col("done").alias("ends")
        )
        moved = state.where("not done").join(ahead, F.col("head") == F.col("at"))
        state = materialise(
            state.where("done").unionByName(
                moved.select("call_id", F.col("far").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"))
            ),
            "chains",
        )
    return state.where("done").select("call_id", "head", "steps")


def _merges(pairs: DataFrame, chains: DataFrame, roots: DataFrame) -> DataFrame:
    """(call_id, level) of the calls that wait for several, where all they wait for has a level."""
    edges = pairs.join(chains.select(F.col("call_id").alias("on"), "head", "steps"), "on", "left").select(
        "call_id", F.coalesce("head", "on").alias("head"), F.coalesce("steps", F.lit(0)).cast("long").alias("steps"), F.lit(None).cast("long").alias("level")
    )
    edges = materialise(edges, "merges")
    placed, out = roots.select(F.col("call_id").alias("id"), F.lit(0).cast("long").alias("known")), None
    while True:
        met = materialise(
            edges.join(placed, F.col("head") == F.col("id"), "left").select(
                "call_id", "head", "steps", F.coalesce("level", F.col("known") + F.col("steps") + 1).alias("level")
            ),
            "merges",
        )
        judged = met.groupBy("call_id").agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        new = materialise(judged.where("open = 0").select("call_id", "level"), "placed")
        if new.isEmpty():
            return out if out is not None else new
        out = new if out is None else out.unionByName(new)
        edges = materialise(met.join(new.select("call_id"), "call_id", "left_anti"), "merges")
        placed = new.select(F.col("call_id").alias("id"), F.col("level").alias("known"))


def levels(calls: DataFrame, waits: DataFrame) -> DataFrame:
    """(call_id, level) of the calls given by ``call_id``; ``waits`` has (call_id, on). Unknown calls are not waited for."""
    calls = calls.select("call_id").distinct()
    waits = waits.join(calls, "call_id", "left_semi").join(calls.select(F.col("call_id").alias("on")), "on", "left_semi").distinct()
    waits = materialise(waits.select("call_id", "on"), "waits")
    several = materialise(waits.groupBy("call_id").count().where("count > 1").select("call_id"), "several")
    roots = calls.join(waits.select("call_id"), "call_id", "left_anti")
    chains = _chains(waits.join(several, "call_id", "left_anti"))
    known = roots.select("call_id", F.lit(0).cast("long").alias("level"))
    if not several.isEmpty():
        known = materialise(known, "roots")
        known = known.unionByName(_merges(waits.join(several, "call_id", "left_semi"), chains, known))
    on_chains = chains.join(known.select(F.col("call_id").alias("head"), "level"), "head").select(
        "call_id", (F.col("level") + F.col("steps")).alias("level")
    )
    return calls.join(known.unionByName(on_chains), "call_id", "left")


def numbered(turns: DataFrame) -> DataFrame:
    """The distinct turns with ``at``, their place in the conversation from 1; ``of`` and ``before``: the place of the
    last user's turn up to here, and before here.

    Rows are dealt by ranges of (conversation, turn, role, text) and numbered within each range; a range then gets
    what the ranges before it hold of its first conversation.
    """
    order = ["turn", "role", "text"]
    ranged = materialise(
        turns.select("conv_id", *order).distinct().repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns"
    )
    here = Window.partitionBy("part", "conv_id").orderBy(*order)
    local = ranged.withColumn("n", F.row_number().over(here)).withColumn("user_n", F.when(F.col("role") == "user", F.col("n")))
    to_here = Window.partitionBy("part", "conv_id").orderBy("n")
    local = local.withColumn("of_n", F.last("user_n", ignorenulls=True).over(to_here.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "before_n", F.last("user_n", ignorenulls=True).over(to_here.rowsBetween(Window.unboundedPreceding, -1))
    )
    sums = ranged.groupBy("part", "conv_id").agg(F.count("*").alias("rows"))
    users = local.groupBy("part", "conv_id").agg(F.max("user_n").alias("last_user"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range and conversation
    held = (
        sums.join(users.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), "last_user"), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")))
        .withColumn("base", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .withColumn("carried", F.last(F.col("base") + F.col("last_user"), ignorenulls=True).over(earlier))
        .select("p", "c", "base", "carried")
    )
    place = lambda n: F.coalesce(F.col(n) + F.col("base"), "carried")
    return local.join(held, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", *order, (F.col("n") + F.col("base")).alias("at"), place("of_n").alias("of"), place("before_n").alias("before")
    )


def call_name(at: Column) -> Column:
    """``c<conversation>-<place>``; a null conversation's begin with the hyphen."""
    return F.concat(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")), F.lit("-"), at.cast("string"))


def traffic(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls (conv_id, at, call_id, tool, arguments), results (conv_id, at, call_id, content) and waits (call_id, on)."""
    marked = materialise(numbered(turns).where(F.col("role").isin("user", "assistant")), "turns")
    users = marked.where("role = 'user'")
    lines = F.size(F.split("text", "\n"))
    draft = F.coalesce(lines > 1, F.lit(False))
    calls = users.select(
        "conv_id",
        "at",
        call_name(F.col("at")).alias("call_id"),
        F.when(draft, "draft").otherwise("reply").alias("tool"),
        F.when(draft, F.to_json(F.struct("turn", "text", lines.alias("lines")))).otherwise(F.to_json(F.struct("turn", "text"))).alias("arguments"),
    )
    results = marked.where("role = 'assistant'").select(
        "conv_id", "at", F.when(F.col("of").isNotNull(), call_name(F.col("of"))).alias("call_id"), F.col("text").alias("content")
    )
    waits = users.where("before is not null").select(call_name(F.col("at")).alias("call_id"), call_name(F.col("before")).alias("on"))
    return calls, results, waits


def linked(calls: DataFrame, results: DataFrame, waits: DataFrame, schemas: dict[str, tuple[Field, ...]] = SCHEMAS) -> DataFrame:
    """Each call with its level, validity, first result and number of results; and each orphan result, without a call."""
    first = results.where("call_id is not null").groupBy("call_id").agg(
        F.min_by("content", "at").alias("content"), F.count("*").alias("n_results")
    )
    of_calls = (
        calls.join(levels(calls, waits), "call_id", "left")
        .join(first, "call_id", "left")
        .select(
            "conv_id", "at", "call_id", "level", "tool", "arguments", "content",
            F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
            valid(F.col("tool"), F.try_parse_json("arguments"), schemas).alias("valid"),
        )
    )
    orphans = results.join(calls.select("call_id"), "call_id", "left_anti").select("conv_id", "at", "content")
    return of_calls.unionByName(orphans, allowMissingColumns=True)


def lines(turns: DataFrame) -> DataFrame:
    """One row for each call or orphan result: conv_id, at, call_id, tool, level, valid, n_results and its canonical JSON.

    In each conversation the order is by level, those without one last, then by place.
    """
    rows = linked(*traffic(turns))
    rest = F.to_json(
        F.struct(
            F.col("call_id").alias("id"), "level", F.col("content").alias("result"), F.col("n_results").alias("results"), "tool", "valid"
        ),
        {"ignoreNullFields": "false"},
    )
    is_call = F.col("call_id").isNotNull()
    return rows.select(
        "conv_id", "at", "call_id", "tool", "level", "valid", "n_results",
        F.when(is_call, F.concat(F.lit('{"arguments":'), canonical(F.col("arguments")), F.lit(","), rest.substr(F.lit(2), F.length(rest))))
        .otherwise(F.to_json(F.struct(F.col("content").alias("orphan")), {"ignoreNullFields": "false"})).alias("json"),
    )


def conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation with a call or result: its numbers of calls, linked and valid ones and orphans, and its last level."""
    is_call = F.col("call_id").isNotNull()
    return linked(*traffic(turns)).groupBy("conv_id").agg(
        F.count_if(is_call).alias("n_calls"),
        F.count_if(is_call & (F.col("n_results") > 0)).alias("n_linked"),
        F.count_if(is_call & F.col("valid")).alias("n_valid"),
        F.count_if(~is_call).alias("n_orphans"),
        F.max("level").alias("last_level"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(table(spark, sf_dir, "conversations"))
    return found.withColumn("json_sha256", F.sha2("json", 256)).drop("json")


ORACLE = """
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
marked AS (
  SELECT *, max(CASE WHEN role = 'user' THEN pos END) OVER w AS owner,
         count(CASE WHEN role = 'user' THEN 1 END) OVER w AS k,
         coalesce('c' || CAST(conv_id AS VARCHAR), '') || '-' || pos AS id,
         len(string_split(text, chr(10))) AS n_lines
  FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
firsts AS (
  SELECT conv_id, owner, arg_min(text, pos) AS content, count(*) AS n_results
  FROM marked WHERE role = 'assistant' AND owner IS NOT NULL GROUP BY ALL),
calls AS (
  SELECT u.*, content, coalesce(n_results, 0) AS n_results, CASE WHEN n_lines > 1 THEN 'draft' ELSE 'reply' END AS tool,
         coalesce(length(text) BETWEEN 1 AND 200000 AND turn >= 0 AND (n_lines = 1 OR length(text) >= 3 AND n_lines <= 1000), false) AS valid
  FROM marked u LEFT JOIN firsts f ON u.conv_id IS NOT DISTINCT FROM f.conv_id AND u.pos = f.owner WHERE u.role = 'user')
SELECT conv_id, CAST(pos AS BIGINT) AS at, id AS call_id, tool, CAST(k - 1 AS BIGINT) AS level, valid, CAST(n_results AS BIGINT) AS n_results,
       sha256(CAST(json_object(
         'arguments', CASE WHEN tool = 'draft' THEN json_object('lines', n_lines, 'text', text, 'turn', turn)
                           ELSE json_object('text', text, 'turn', turn) END,
         'id', id, 'level', k - 1, 'result', content, 'results', n_results, 'tool', tool, 'valid', valid) AS VARCHAR)) AS json_sha256
FROM calls
UNION ALL
SELECT conv_id, pos, NULL, NULL, NULL, NULL, NULL, sha256(CAST(json_object('orphan', text) AS VARCHAR))
FROM marked WHERE role = 'assistant' AND owner IS NULL
"""

"""Queries of the models: boosted trees, and what they say of actions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import boosting as B
from tidemark.sources.arena import Arena

QUERIES, ORACLES = {}, {}


def registered(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Arena(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- monotone trees ---------------------------------------------------------------------------------------------

TREE_FEATURES = ("quantity", "discount", "line")
TREE_SIGNS = {"quantity": 1, "discount": -1, "line": 1}


def _trees_sql(rounds: int = 2, rate: float = 0.5, least: int = 60) -> str:
    """Two levels a round, each a split of every open node by the summed gain of clipped values."""
    signs = "CASE f WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 1 END"
    parts = [
        """r AS MATERIALIZED (SELECT row_number() OVER () AS i, CAST(l_quantity AS INT) AS b0, CAST(round(l_discount * 100) AS INT) + 1 AS b1, CAST(l_linenumber AS INT) AS b2, l_extendedprice AS y FROM lineitem)""",
        "s0 AS MATERIALIZED (SELECT *, (SELECT avg(y) FROM r) AS s FROM r)",
    ]
    for k in range(1, rounds + 1):
        parts.append(f"n{k}_0 AS MATERIALIZED (SELECT *, 1 AS node FROM s{k - 1})")
        parts.append(f"b{k}_0 AS MATERIALIZED (SELECT 1 AS node, -1e300 AS low, 1e300 AS high, sum(y - s) / (count(*) + 1) AS v, count(*) AS n FROM n{k}_0)")
        for d in (0, 1):
            parts.append(
                f"""h{k}_{d} AS (SELECT node, f, b, count(*) AS n, sum(y - s) AS g FROM (SELECT node, y, s, unnest([0, 1, 2]) AS f, unnest([b0, b1, b2]) AS b FROM n{k}_{d}) GROUP BY ALL),
    c{k}_{d} AS (SELECT node, f, b, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(n) OVER (PARTITION BY node, f) AS nn, sum(g) OVER (PARTITION BY node, f) AS gg FROM h{k}_{d} WINDOW w AS (PARTITION BY node, f ORDER BY b)),
    v{k}_{d} AS (SELECT c.*, low, high, least(greatest(gl / (nl + 1), low), high) AS vl, least(greatest((gg - gl) / (nn - nl + 1), low), high) AS vr, least(greatest(gg / (nn + 1), low), high) AS vv FROM c{k}_{d} c JOIN b{k}_{d} USING (node)),
    p{k}_{d} AS MATERIALIZED (SELECT * FROM (SELECT *, (-2 * vv * gg + (nn + 1) * vv * vv) - (-2 * vl * gl + (nl + 1) * vl * vl) - (-2 * vr * (gg - gl) + (nn - nl + 1) * vr * vr) AS gain FROM v{k}_{d}
      WHERE nl >= {least} AND nn - nl >= {least} AND (vr - vl) * ({signs}) >= 0) WHERE gain > 1e-9 * greatest(1.0, abs(gg)) QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1),
    n{k}_{d + 1} AS MATERIALIZED (SELECT n.* EXCLUDE (node), CASE WHEN p.node IS NULL THEN n.node ELSE 2 * n.node + CASE WHEN CASE f WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END > b THEN 1 ELSE 0 END END AS node FROM n{k}_{d} n LEFT JOIN p{k}_{d} p USING (node)),
    b{k}_{d + 1} AS MATERIALIZED (SELECT 2 * node AS node, CASE WHEN {signs} > 0 THEN low ELSE (vl + vr) / 2 END AS low, CASE WHEN {signs} > 0 THEN (vl + vr) / 2 ELSE high END AS high, vl AS v, nl AS n FROM p{k}_{d}
      UNION ALL SELECT 2 * node + 1, CASE WHEN {signs} > 0 THEN (vl + vr) / 2 ELSE low END, CASE WHEN {signs} > 0 THEN high ELSE (vl + vr) / 2 END, vr, nn - nl FROM p{k}_{d}{f' UNION ALL SELECT b.* FROM b{k}_1 b ANTI JOIN p{k}_1 p USING (node)' if d else ''})"""
            )
        parts.append(f"s{k} AS MATERIALIZED (SELECT n.* EXCLUDE (node, s), s + {rate} * v AS s FROM n{k}_2 n JOIN b{k}_2 USING (node))")
    rows = " UNION ALL ".join(
        f"""SELECT {k} AS round, CAST(node AS BIGINT) AS node, CAST(f AS BIGINT) AS feature, CAST(b AS BIGINT) AS cut, CAST(nn AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS value FROM (SELECT * FROM p{k}_0 UNION ALL SELECT * FROM p{k}_1)
    UNION ALL SELECT {k}, CAST(node AS BIGINT), -1, 0, CAST(n AS BIGINT), round({rate} * v, 3) + 0.0 FROM b{k}_2"""
        for k in range(1, rounds + 1)
    )
    return f"WITH {', '.join(parts)} SELECT CAST(round AS BIGINT) AS round, node, CAST(feature AS BIGINT) AS feature, CAST(cut AS BIGINT) AS cut, n, value FROM ({rows})"


def tree_rows(trees: list[B.Tree]) -> list[tuple]:
    """(round, node, feature, cut, n, value) with a node's children at twice its number and one more; leaves have feature -1."""
    out = []
    for k, tree in enumerate(trees, 1):
        stack = [(0, 1)]
        while stack:
            at, number = stack.pop()
            f = tree.feature[at]
            if f >= 0:
                out.append((k, number, f, tree.cut[at], tree.count[at], None))
                stack += [(tree.left[at], 2 * number), (tree.left[at] + 1, 2 * number + 1)]
            else:
                out.append((k, number, -1, 0, tree.count[at], round(tree.value[at], 3) + 0.0))
    return out


@registered("monotone_trees", _trees_sql())
def monotone_trees(a: Arena) -> DataFrame:
    """M-01's trees: two rounds of depth two on the prices of lineitem, with a sign on each feature."""
    df = a.table("lineitem").select(
        F.col("l_quantity").alias("quantity"), F.round(F.col("l_discount") * 100).alias("discount"), F.col("l_linenumber").cast("double").alias("line"), F.col("l_extendedprice").alias("price")
    )
    edges = [np.arange(1.0, 50), np.arange(0.0, 10), np.arange(1.0, 7)]
    model = B.fit(df, TREE_FEATURES, "price", TREE_SIGNS, B.Growth(rounds=2, rate=0.5, leaves=4, depth=2), edges)
    return a.spark.createDataFrame(tree_rows(model.trees), "round long, node long, feature long, cut long, n long, value double")

"""Models: expected points, fight and hit odds, and where the next circle falls."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import boosting as B
from tidemark.functions import geometry as G
from tidemark.functions import stats as T
from tidemark.sources.shared import written

EXPECTED_POINTS_FEATURES = (
    "phase", "progress", "teams_alive", "members", "hp", "outside_m", "storm_m", "off_centre", "height_rank", "enemies_50", "enemies_150", "hit_10s", "surge_rank", "kills", "skill", "lobby_skill",
)
CLOCK_AND_SKILL = ("phase", "teams_alive", "skill", "lobby_skill")
#: Directions known from the game (fixed values): more is never worse (1) or never better (-1).
SIGNS = {
    "hp": 1, "members": 1, "kills": 1, "outside_m": -1, "storm_m": -1, "hit_10s": -1, "teams_alive": -1, "seen_close": -1, "surge_margin": 1, "enemies_50": -1, "skill": -1,
}


# ---- expected points --------------------------------------------------------------------------------------------


def known_skill(df: DataFrame) -> DataFrame:
    """Unranked teams and lobbies count as rank 100,000."""
    return df.withColumns({c: F.coalesce(c, F.lit(100_000.0)) for c in ("skill", "lobby_skill") if c in df.columns})


def expected_points_model(snapshots: DataFrame, features: Sequence[str] = EXPECTED_POINTS_FEATURES, k: int = 6, growth: B.Growth = B.Growth(), seed: int = 3):
    """(model of all snapshots, the snapshots with ``fold``, ``predicted`` and ``baseline``, both out of fold): trees held to ``SIGNS``.

    The baseline knows the clock and both sides' skill, so what the model adds is the situation's.
    """
    dealt = T.folds(known_skill(snapshots), "match_id", k, seed)
    full, parts, base = B.cross_fit(dealt, features, "future_pts", k, SIGNS, growth, [f for f in CLOCK_AND_SKILL if f in features])
    return full, dealt.withColumns({"predicted": B.by_fold(parts), "baseline": B.by_fold(base)}), parts


def model_check(judged: DataFrame) -> DataFrame:
    """ST-15: n, R2 and R2 over the baseline."""
    return judged.agg(F.count("*").alias("n"), T.r_squared("future_pts", "predicted").alias("r2"), T.r_squared("future_pts", "predicted", "baseline").alias("r2_over_baseline"))


def expected_points(snapshots: DataFrame, k: int = 6, growth: B.Growth = B.Growth()) -> tuple[DataFrame, DataFrame]:
    """M-01: (out-of-fold predictions; their R2 and that against the clock-and-skill baseline)."""
    _, judged, _ = expected_points_model(snapshots, k=k, growth=growth)
    return judged, model_check(judged)


def predict(model: B.Boosted, df: DataFrame, name: str = "predicted") -> DataFrame:
    return df.withColumn(name, model.column())


def sign_breaches(model: B.Boosted, df: DataFrame, step: float = 0.1) -> DataFrame:
    """For each feature with a sign the share of rows where a step, small or to the next integer, moves the prediction the other way."""
    names = [f for f in model.features if SIGNS.get(f)]
    up = {f: F.col(f) + F.greatest(step * F.abs(f), F.lit(1.0)) for f in names}
    moved = df.select(model.states([{}, *({f: up[f]} for f in names)]).alias("_p"))
    sums = moved.agg(F.count("*").alias("n"), *(F.sum(((F.col("_p")[k + 1] - F.col("_p")[0]) * SIGNS[f] < -1e-9).cast("bigint")).alias(f"b{k}") for k, f in enumerate(names)))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col("n").alias("n"), F.col(f"b{k}").alias("breaches")) for k, f in enumerate(names))))
    return sums.select(each.alias("_e")).select("_e.*")


def priced_actions(model: B.Boosted, df: DataFrame) -> DataFrame:
    """M-03, M-10: every situation as it is and under each action, priced in one pass; the best action and what it is worth.

    Hold leaves it; rotate moves the team inside; heal restores its health; win removes the nearest enemies.
    """
    states = {
        "hold": {}, "rotate": {"outside_m": F.lit(0.0), "storm_m": F.lit(0.0)}, "heal": {"hp": F.greatest("hp", F.lit(150.0))},
        "win": {"enemies_50": F.lit(0).cast("bigint"), "kills": F.col("kills") + 1},
    }
    priced = df.select("match_id", "t", "team_index", model.states(list(states.values())).alias("_p"))
    priced = priced.select("match_id", "t", "team_index", *(F.col("_p")[k].alias(name) for k, name in enumerate(states)))
    best = F.greatest(*states)
    choice = F.lit(None).cast("string")
    for name in reversed(list(states)):
        choice = F.when(F.col(name) == best, name).otherwise(choice)
    return priced.withColumns({"best": choice, "stake": best - F.least(*states)})


def swap_drivers(model: B.Boosted, spark, one: dict, other: dict, banked: float = 4.0) -> DataFrame:
    """M-10: two situations given by hand, priced, and what each differing feature alone moves: (label, one, other, points).

    Row ``total`` has both totals with ``banked`` points for each elimination made; the others the change from the first.
    """
    rows = [("one", one), ("other", other)] + [(f, one | {f: other[f]}) for f in model.features if one[f] != other[f]]
    names = ", ".join(f"{f} double" for f in model.features)
    df = spark.createDataFrame([(label, *(float(x[f]) for f in model.features)) for label, x in rows], f"label string, {names}")
    priced = predict(model, df, "worth")
    sides = priced.where("label in ('one', 'other')").agg(
        *(F.max(F.when(F.col("label") == side, F.col("worth"))).alias(side) for side in ("one", "other")),
        *(F.max(F.when(F.col("label") == side, F.col("worth") + banked * F.col("kills"))).alias(f"{side}_total") for side in ("one", "other")),
    )
    total = sides.select(F.lit("total").alias("label"), F.col("one_total").alias("one"), F.col("other_total").alias("other"), (F.col("other_total") - F.col("one_total")).alias("points"))
    own = F.element_at(F.create_map(*(F.lit(x) for f in model.features for x in (f, float(one[f])))), F.col("label"))
    new = F.element_at(F.create_map(*(F.lit(x) for f in model.features for x in (f, float(other[f])))), F.col("label"))
    each = priced.where("label not in ('one', 'other')").crossJoin(F.broadcast(sides)).select("label", own.alias("one"), new.alias("other"), (F.col("worth") - F.col("one")).alias("points"))
    return total.unionByName(each)


def endgame_effects() -> dict[str, tuple[dict, dict]]:
    """What a change is worth: features set on one side and on the other (fixed values)."""
    set_to = lambda **x: {k: F.lit(float(v)) for k, v in x.items()}
    return {
        "+50 health and shield": ({"hp": F.least(F.col("hp") + 50, F.lit(200.0))}, {}),
        "inside the next zone instead of outside": (set_to(outside_m=0), {"outside_m": F.greatest("outside_m", F.lit(100.0))}),
        "out of the storm": (set_to(storm_m=0), {"storm_m": F.greatest("storm_m", F.lit(50.0))}),
        "one more enemy team within 50 m": ({"enemies_50": F.col("enemies_50") + 1}, {}),
        "teammate alive": (set_to(members=2), set_to(members=1)),
        "top of the lobby in net damage": (set_to(surge_rank=1), set_to(surge_rank=0)),
        "high ground": (set_to(height_rank=0.9), set_to(height_rank=0.1)),
        "centre of the zone": (set_to(off_centre=0.2), set_to(off_centre=0.95)),
        "just took 50 damage": (set_to(hit_10s=50), set_to(hit_10s=0)),
        "stronger team": (set_to(skill=200), set_to(skill=5000)),
    }


def marginal_effects(model: B.Boosted, df: DataFrame, effects: dict[str, tuple[dict, dict]]) -> DataFrame:
    """M-10: (label, n, points): the mean change of the prediction, each effect alone, over all rows in one pass.

    An effect counts only if the model reads a feature that it changes.
    """
    use = {k: v for k, v in effects.items() if set(model.features) & (set(v[0]) | set(v[1]))}
    if not use:
        return df.sparkSession.createDataFrame([], "label string, n long, points double")
    priced = df.select(model.states([side for both in use.values() for side in both]).alias("_p"))
    sums = priced.agg(F.count("*").alias("n"), *(F.avg(F.col("_p")[2 * k] - F.col("_p")[2 * k + 1]).alias(f"d{k}") for k in range(len(use)))).where("n > 0")
    each = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.col("n").alias("n"), F.col(f"d{k}").alias("points")) for k, label in enumerate(use))))
    return sums.select(each.alias("_e")).select("_e.*")


def hit_risk(exposures: DataFrame, least: int = 30) -> DataFrame:
    """M-04: chance of a new attacker by stage, action and lookers, and of at least one in two such spells."""
    g = exposures.groupBy("stage", "action", F.least("lookers", F.lit(2)).alias("lookers")).agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("p"))
    return g.where(F.col("n") >= least).withColumn("p_two", 1 - (1 - F.col("p")) ** 2)


def fight_odds(fights: DataFrame) -> DataFrame:
    """M-05: how often the side that begins a decided fight wins it, by its own health going in."""
    from tidemark.functions.scalar import bands

    own = F.when(F.col("first") == F.col("a"), F.col("hp_a")).otherwise(F.col("hp_b"))
    f = fights.where("winner is not null").withColumn("health", bands(own, [0, 75, 125, 175, 1e9], ["low", "mid", "high", "full"]))
    return f.groupBy("health").agg(F.count("*").alias("n"), F.avg((F.col("winner") == F.col("first")).cast("double")).alias("won"))


def surged_share(per: DataFrame, default: float = 0.25) -> DataFrame:
    """M-05: one row, the median over surge episodes of the share of players surged; ``default`` without episodes."""
    each = per.groupBy("match_id", "episode").agg(F.avg(F.col("surged").cast("double")).alias("_s"))
    return each.agg(F.coalesce(F.median("_s"), F.lit(default)).alias("cut_off"))


# ---- next circle ------------------------------------------------------------------------------------------------

CIRCLE_FEATURES = ("edge", "edge2", "toward_origin", "turn_cos", "turn_sin")


def candidates(pulls: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """M-06: each pull's true next centre (alternative 0) and ``n`` others, drawn by hashes: anywhere in the allowed disk
    for a shrinking circle, on a ring of the usual distance otherwise."""
    p = pulls.where("dist is not null and cur_r > 0").withColumn("state_id", F.concat_ws("-", F.col("match_id").cast("string"), F.col("phase").cast("string")))
    alt = p.withColumn("alt_id", F.explode(F.sequence(F.lit(0), F.lit(n))))
    unit = lambda salt: F.pmod(F.xxhash64("state_id", "alt_id", F.lit(seed + salt)), F.lit(1 << 30)) / float(1 << 30)
    angle = 2 * np.pi * unit(1)
    r = F.when(F.col("kind") == "shrinking", F.col("allowed") * F.sqrt(unit(2))).otherwise(F.col("dist") * (0.9 + 0.2 * unit(2)))
    true = F.col("alt_id") == 0
    cx = F.when(true, F.col("next_x")).otherwise(F.col("cur_x") + r * F.cos(angle))
    cy = F.when(true, F.col("next_y")).otherwise(F.col("cur_y") + r * F.sin(angle))
    return alt.withColumns({"cx": cx, "cy": cy, "is_true": true})


def with_before(pulls: DataFrame) -> DataFrame:
    """Each pull with the direction of the one before it, ``_before``."""
    return pulls.withColumn("_before", F.lag("angle_deg").over(Window.partitionBy("match_id").orderBy("phase")))


def circle_features(cand: DataFrame, pulls: DataFrame) -> DataFrame:
    """Features that the geometry of the game gives: place in the disk, pull to the map's middle, turn from the last pull."""
    c = cand if "_before" in cand.columns else cand.join(with_before(pulls).select("match_id", "phase", "_before"), ["match_id", "phase"], "left")
    dx, dy = F.col("cx") - F.col("cur_x"), F.col("cy") - F.col("cur_y")
    share = F.least(F.try_divide(F.sqrt(dx * dx + dy * dy), F.greatest("allowed", "dist")), F.lit(1.0))
    turn = F.radians(G.bearing(dx, dy) - F.col("_before"))
    return c.withColumns(
        {
            "edge": F.coalesce(share, F.lit(0.0)), "edge2": F.coalesce(share * share, F.lit(0.0)),
            "toward_origin": F.coalesce(G.cosine(dx, dy, -F.col("cur_x"), -F.col("cur_y")), F.lit(0.0)),
            "turn_cos": F.coalesce(F.cos(turn), F.lit(0.0)), "turn_sin": F.coalesce(F.sin(turn), F.lit(0.0)),
        }
    ).drop("_before")


def packed_states(choices: DataFrame, features: Sequence[str]) -> DataFrame:
    """(match_id, phase, fold, n, x), written: a choice's alternatives in one list of their features, the truth first."""
    row = F.struct("alt_id", F.array(*(F.col(f).cast("double") for f in features)).alias("f"))
    lists = choices.groupBy("match_id", "phase", "fold").agg(F.sort_array(F.collect_list(row)).alias("_r"))  # as many as a choice has alternatives
    flat = F.flatten(F.transform("_r", lambda r: r["f"]))
    return written(lists.select("match_id", "phase", "fold", F.size("_r").alias("n"), flat.alias("x")), "states")


def _by_size(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows, their features as rows x alternatives x features) of each number of alternatives."""
    n = batch.column("n").to_numpy(zero_copy_only=False)
    for size in np.unique(n):
        at = np.flatnonzero(n == size)
        yield at, batch.column("x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size, width)


def _utility(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    u = np.zeros(x.shape[:2])
    for k, v in enumerate(w):
        u += x[:, :, k] * v
    return u


def conditional_logits(states: DataFrame, width: int, models: Sequence[tuple[int, Sequence[int]]], penalty: float = 0.1, steps: int = 12) -> list[np.ndarray]:
    """Weights of each model, (the fold it must not see, its columns), by Newton steps: one pass over the states for all models.

    Every task adds up gradients and Hessians, whose size depends on the number of features alone.
    """
    weights = [np.zeros(len(columns)) for _, columns in models]
    going = set(range(len(models)))

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros(len(weights[m]) * (len(weights[m]) + 1)) for m in going}
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for at, x in _by_size(batch, width):
                for m in going:
                    mine = x[fold[at] != models[m][0]][:, :, list(models[m][1])]
                    u = _utility(mine, weights[m])
                    p = np.exp(u - u.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    mean = np.einsum("sa,sak->sk", p, mine)
                    h = np.einsum("sai,saj->ij", mine * p[:, :, None], mine) - mean.T @ mean
                    sums[m] += np.concatenate(((mine[:, 0] - mean).sum(0), h.ravel()))
        rows = [(m, k, v) for m, found in sums.items() for k, v in enumerate(found)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["model", "k", "v"])

    for _ in range(steps):
        got = states.mapInArrow(derived, "model long, k long, v double").groupBy("model", "k").agg(F.sum("v").alias("v")).toPandas()
        for m, part in got.groupby("model"):
            v, w = part.sort_values("k")["v"].to_numpy(), weights[m]
            d = len(w)
            step = np.linalg.solve(v[d:].reshape(d, d) + penalty * np.eye(d), v[:d] - penalty * w)
            weights[m] = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                going.discard(m)
        if not len(got) or not going:
            break
    return weights


def ranked_truths(states: DataFrame, width: int, rungs: dict[str, Sequence[int]], weights: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """M-07: per rung and state the share of candidates that the truth beats (ties half), whether it is in the best quarter, and bits
    gained over a blind guess, by the weights that did not see the state's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for at, x in _by_size(batch, width):
                for name, columns in rungs.items():
                    u = np.zeros(x.shape[:2])
                    for k in np.unique(fold[at]):
                        mine = fold[at] == k
                        u[mine] = _utility(x[mine][:, :, list(columns)], weights[name, int(k)])
                    n = u.shape[1]
                    below, ties = (u < u[:, :1]).sum(1), (u == u[:, :1]).sum(1)
                    beaten = (below + (ties - 1) / 2) / (n - 1) if n > 1 else np.full(len(u), np.nan)
                    most = u.max(1)
                    bits = (u[:, 0] - most - np.log(np.exp(u - most[:, None]).sum(1)) + np.log(n)) / np.log(2)
                    keys = [batch.column(c).take(pa.array(at)) for c in ("match_id", "phase")]
                    known = pa.array(beaten, mask=np.isnan(beaten))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), *keys, known, pa.array(beaten >= 0.75, mask=np.isnan(beaten)), pa.array(bits)], names=["rung", "match_id", "phase", "beaten", "top_quarter", "bits"])

    of = {f.name: f.dataType.simpleString() for f in states.schema}
    return states.mapInArrow(run, f"rung string, match_id {of['match_id']}, phase {of['phase']}, beaten double, top_quarter boolean, bits double")


def forecast(pulls: DataFrame, rungs: dict[str, Sequence[str]] | None = None, n: int = 60, k: int = 3) -> DataFrame:
    """M-08: each rung of features fitted on the other folds' matches and judged on its own; all rungs and folds in the same passes."""
    rungs = rungs or {"one_step": CIRCLE_FEATURES[:3], "memory": CIRCLE_FEATURES}
    names = list(dict.fromkeys(f for use in rungs.values() for f in use))
    states = packed_states(T.folds(circle_features(candidates(with_before(pulls), n), pulls), "match_id", k), names)
    columns = {rung: [names.index(f) for f in use] for rung, use in rungs.items()}
    keys = [(rung, fold) for rung in rungs for fold in range(k)]
    weights = dict(zip(keys, conditional_logits(states, len(names), [(fold, columns[rung]) for rung, fold in keys]), strict=True))
    out = ranked_truths(states, len(names), columns, weights)
    return out.groupBy("rung", "phase").agg(F.count("*").alias("n"), F.avg("beaten").alias("beaten"), F.avg(F.col("top_quarter").cast("double")).alias("top_quarter"), F.avg("bits").alias("bits"))

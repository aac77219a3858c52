"""Studies of what situations, actions and circles are worth: built on the models, registered beside the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import boosting as B
from tidemark.functions import scalar as S
from tidemark.functions import stats as T
from tidemark.operators import aggregates as A
from tidemark.plans import circles as C
from tidemark.plans import detect as D
from tidemark.plans import models as M
from tidemark.plans import moves as V
from tidemark.plans import spots as Q
from tidemark.plans.studies import Context, Param, mean_test, metrics, study
from tidemark.sources.shared import written

#: Two situations to compare, unless others are given (fixed values).
ROTATE_NOW = {
    "teams_alive": 20, "phase": 7, "progress": 0.3, "members": 2, "hp": 120, "outside_m": 0, "storm_m": 0, "off_centre": 0.6, "height_rank": 0.5, "enemies_50": 0,
    "enemies_150": 2, "hit_10s": 0, "surge_rank": 0.5, "kills": 2, "skill": 500, "lobby_skill": 2000,
}
HEAL_FIRST = ROTATE_NOW | {"progress": 0.7, "hp": 200, "outside_m": 60, "off_centre": 0.9}
TEAMS_LEFT = ([0, 5, 10, 15, 20, 25, 30, 40, 1000], ["1-5", "6-10", "11-15", "16-20", "21-25", "26-30", "31-40", "41+"])


def by_teams_left(snapshots: DataFrame, paid: int, least: int = 30) -> DataFrame:
    """(situation, left, n, points, paid): points still to come and the share that finishes in the points, by teams left.

    Good: inside the next circle with three quarters of full health; bad: outside it with under half. Shares of under ``least`` rows are null.
    """
    full = snapshots.agg(F.coalesce(F.percentile("hp", F.lit(0.99)), F.lit(200.0)).alias("_full"))
    s = snapshots.crossJoin(F.broadcast(full)).withColumn("left", S.bands(F.col("teams_alive"), *TEAMS_LEFT))
    good = (F.col("outside_m") == 0) & (F.col("hp") >= F.round(0.75 * F.col("_full")))
    bad = (F.col("outside_m") > 0) & (F.col("hp") < F.round(0.5 * F.col("_full")))
    s = s.withColumn("situation", F.explode(F.array_compact(F.array(F.lit("everyone"), F.when(good, "good"), F.when(bad, "bad")))))
    enough = F.count("*") >= least
    return s.groupBy("situation", "left").agg(F.count("*").alias("n"), F.when(enough, F.avg("future_pts")).alias("points"), F.when(enough, F.avg((F.col("placement") <= paid).cast("double"))).alias("paid"))


def risk_by_zone(exposures: DataFrame) -> DataFrame:
    """(zones, action, n, hit): how often a team is hit by a new one within ten seconds."""
    zones = S.bands(F.col("phase"), [0, 4, 6, 8, 99], ["2-4", "5-6", "7-8", "9+"])
    return exposures.groupBy(zones.alias("zones"), "action").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("hit"))


@study("expected_points", Param("one", "plans", ROTATE_NOW), Param("other", "plans", HEAL_FIRST), Param("growth", "growth", B.Growth()), Param("folds", "number", 6), min_matches=6)
def expected_points(c: Context):
    """K-22: what any moment is worth, what each change is worth in the endgame, the risk of moving, and two plans compared."""
    snaps = M.known_skill(c.snapshots)
    model, judged, _ = M.expected_points_model(snaps, k=c.params["folds"], growth=c.params["growth"])
    judged = written(judged.select("future_pts", "predicted", "baseline"), "judged")  # the check and the calibration
    check = M.model_check(judged)
    ranked = c.tables.players.where(~F.coalesce("is_bot", F.lit(False)))
    long = check.select(F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(k).cast("double").alias("value")) for k in ("n", "r2", "r2_over_baseline")))).alias("m")).select("m.*")
    moments = V.team_moments(c.tables, V.shrink_moments(c.tables))
    _, per = c.surge
    quarters = S.bands(F.percent_rank().over(D.Window.partitionBy("match_id", "episode").orderBy("dealt")), [-0.001, 0.25, 0.5, 0.75, 1.0001], ["bottom quarter", "second", "third", "top quarter"])
    return {
        "metrics": long.unionByName(metrics(ranked, skill_known=A.share(F.col("pr_rank").isNotNull()))),
        "table:plans": M.swap_drivers(model, snaps.sparkSession, {**ROTATE_NOW, **c.params["one"]}, {**HEAL_FIRST, **c.params["other"]}),
        "table:teams_left": by_teams_left(snaps, 25),
        "table:effects": M.marginal_effects(model, snaps.where("phase between 6 and 9"), M.endgame_effects()),
        "table:hit_risk": risk_by_zone(V.exposures(c.tables, moments)),
        "table:surge": per.withColumn("score", quarters).groupBy("score").agg(F.count("*").alias("n"), F.avg(F.col("surged").cast("double")).alias("surged")),
        "table:calibration": T.calibration(judged, "future_pts", "predicted"),
        "table:signs": M.sign_breaches(model, snaps),
    }


@study("zone_forecast", Param("folds", "number", C.FOLDS), Param("disk", "number", C.N_DISK), Param("ring", "number", C.N_RING), Param("end", "number", C.N_END), min_matches=6)
def zone_forecast(c: Context):
    """K-19: how well the next circle and the last one can be foreseen, rung by rung, against other matches' histories."""
    pulls, matches, land = D.pulls(c.tables), c.tables.matches, C.raster(Q.ground(c.tables))
    steps = C.ladder(pulls, matches, land, c.params["folds"], disk=c.params["disk"], ring=c.params["ring"])
    end = C.endgame(pulls, matches, land, c.params["folds"], n=c.params["end"])
    by_match = steps.where("test = 'fold'").groupBy("rung", "match_id").agg(F.avg("bits").alias("bits"), F.avg(F.col("top_quarter").cast("double")).alias("hit"))
    gain = mean_test(by_match, "bits over the rules", "bits", group=("rung",)).unionByName(mean_test(by_match, "in the best quarter", "hit", C.TOP, group=("rung",)))
    return {
        "tests": gain,
        "table:ladder": C.ladder_table(steps),
        "table:zones": steps.where("test = 'fold'").groupBy("rung", "phase", "kind").agg(F.count("*").alias("n"), F.avg(F.col("top_quarter").cast("double")).alias("top_quarter"), F.avg("bits").alias("bits")),
        "table:endgame": end.groupBy("rung", "phase").agg(F.count("*").alias("n"), F.avg(F.col("top_quarter").cast("double")).alias("top_quarter"), F.avg("bits").alias("bits"), F.median("error_m").alias("error_m")),
    }

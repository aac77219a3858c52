"""The registered studies: a function of (Context) to named frames; metrics and tests in long form, tables beside them.

A study's ``tests`` has (label, n, effect, p); the registry runs any number of them over one selection, and a failing
one is told, not fatal.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geometry as G
from tidemark.functions import points as P
from tidemark.functions import scalar as S
from tidemark.functions import stats as T
from tidemark.operators import aggregates as A
from tidemark.operators import ranks as R
from tidemark.operators import sessions as W
from tidemark.operators.asof import asof_join
from tidemark.plans import detect as D
from tidemark.plans import moves as V
from tidemark.sources.shared import grown, shared_dir


@dataclass(frozen=True)
class Param:
    name: str
    kind: str = "number"
    default: object = None
    options: tuple = ()


@dataclass
class Context:
    """The selected tables and the parameters; heavy detectors run once and are written to the shared folder."""

    tables: D.Tables
    params: dict = field(default_factory=dict)
    compare: D.Tables | None = None
    bus: DataFrame | None = None

    def _kept(self, df: DataFrame) -> DataFrame:
        return grown(df, "detected")

    @cached_property
    def rotations(self) -> DataFrame:
        return self._kept(D.rotations(self.tables))

    @cached_property
    def fights(self) -> DataFrame:
        return self._kept(D.fights(self.tables))

    @cached_property
    def standing(self) -> DataFrame:
        return self._kept(D.team_snapshots(self.tables))

    @cached_property
    def drops(self) -> DataFrame:
        return self._kept(D.unexplained_drops(self.tables))

    @cached_property
    def surge(self) -> tuple[DataFrame, DataFrame]:
        ep, per = D.surge_episodes(self.tables, drops=self.drops)
        return self._kept(ep), self._kept(per)

    @cached_property
    def snapshots(self) -> DataFrame:
        return self._kept(D.snapshots(self.tables))

    @cached_property
    def zones_outside(self) -> DataFrame:
        return self._kept(D.team_zones(self.tables, drops=self.drops, per=self.surge[1]))

    def detect(self, *names: str) -> None:
        """Runs detectors side by side, those that many studies share if none is named, so that copies of this context have them."""
        names = names or ("rotations", "fights", "standing", "surge", "snapshots", "zones_outside")
        if "zones_outside" in names:  # before the others: the way into it goes through these two
            self.surge  # noqa: B018
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(lambda name: getattr(self, name), names))


class Frames(Mapping):
    """A study's frames, each made when it is first read: detectors that only other frames need are not run."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __contains__(self, name: object) -> bool:
        return name in self.makers

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


@dataclass(frozen=True)
class Study:
    id: str
    run: Callable[[Context], Mapping[str, DataFrame]]
    params: tuple[Param, ...] = ()
    needs_compare: bool = False
    min_matches: int = 1


STUDIES: dict[str, Study] = {}


def study(id: str, *params: Param, needs_compare: bool = False, min_matches: int = 1):
    def add(f):
        STUDIES[id] = Study(id, f, params, needs_compare, min_matches)
        return f

    return add


def run_study(id: str, context: Context) -> Mapping[str, DataFrame]:
    s = STUDIES[id]
    given, context = context.params, copy.copy(context)
    context.params = {p.name: p.default for p in s.params} | given
    if s.needs_compare and context.compare is None:
        raise ValueError(f"{id} compares two selections")
    if context.tables.matches.limit(s.min_matches).count() < s.min_matches:
        return {"status": context.tables.matches.sparkSession.createDataFrame([("too few matches",)], "status string")}
    return s.run(context)


# ---- helpers ----------------------------------------------------------------------------------------------------


def tests(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mean_test(df: DataFrame, label: str | Column, x: str, mu: float = 0.0, group: tuple[str, ...] = ()) -> DataFrame:
    """One value for each match (or other unit): its mean, and whether it differs from ``mu``."""
    t = T.t_test(df, list(group), x, mu)
    name = F.concat_ws(" ", F.lit(label), *(F.col(g).cast("string") for g in group)) if isinstance(label, str) else label
    return t.select(name.alias("label"), F.col("n").cast("bigint").alias("n"), F.col("mean").alias("effect"), "p")


def rho_test(df: DataFrame, label: str, x: str, y: str, unit: tuple[str, ...] = ("match_id",), least: int = 4) -> DataFrame:
    """Spearman's rho for each match, and whether the matches' mean differs from none."""
    return mean_test(T.spearman(df, list(unit), x, y, least).where("rho is not null"), label, "rho")


def gap_test(df: DataFrame, label: str, side: Column, x: str, least: int = 3) -> DataFrame:
    return mean_test(A.gap_of_means(df, ["match_id"], side, x, least), label, "gap")


def metrics(df: DataFrame, **values: Column) -> DataFrame:
    """(label, value) of aggregates over one pass."""
    one = df.agg(*(c.cast("double").alias(k) for k, c in values.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(k).alias("value")) for k in values))).alias("_m")).select("_m.*")


# ---- studies ----------------------------------------------------------------------------------------------------


@study("overview")
def overview(c: Context):
    """K-01."""
    m = c.tables.matches
    weeks = m.groupBy(S.week(F.col("match_date").try_cast("date")).alias("week"), "season").agg(F.count("*").alias("matches"))
    phases = c.tables.zones.groupBy("match_id").agg(F.max("phase").alias("phases"))
    table = m.groupBy("season", "region").agg(F.count("*").alias("matches"), F.median("lobby_strength").alias("strength"))
    head = metrics(
        m, matches=F.count("*"), seasons=F.countDistinct("season"), regions=F.countDistinct("region"), server=A.share(F.coalesce(F.col("is_server_replay"), F.lit(False))), strength=F.median("lobby_strength")
    )
    return {"metrics": head.unionByName(metrics(phases, phases=F.avg("phases"))), "table:weeks": weeks, "table:season_region": table}


@study("zone_randomness", Param("alpha", default=0.05))
def zone_randomness(c: Context):
    """K-02, V-03: are the pulls' distances uniform in the allowed disk and their directions free of any habit?"""
    p = D.pulls(c.tables, c.bus)
    u = T.ks_uniform(p.where("u is not null"), ["phase"], "u").select(F.concat(F.lit("distance, zone "), F.col("phase").cast("string")).alias("label"), F.col("n").cast("bigint").alias("n"), F.col("d").alias("effect"), "p")
    d = T.rayleigh(p, ["phase"], "angle_deg").select(F.concat(F.lit("direction, zone "), F.col("phase").cast("string")).alias("label"), F.col("n").cast("bigint").alias("n"), F.col("r").alias("effect"), "p")
    per_match = p.where("turn_deg is not null").groupBy("match_id").agg(T.circular_mean("turn_deg").alias("turn_deg"))
    turn = T.rayleigh(per_match, [], "turn_deg").select(F.lit("turn from the pull before").alias("label"), F.col("n").cast("bigint").alias("n"), F.col("r").alias("effect"), "p")
    bus = T.rayleigh(p.where("phase = 1 and bus_deg is not null"), [], "bus_deg", axial=True).select(F.lit("first pull against the bus line").alias("label"), F.col("n").cast("bigint").alias("n"), F.col("r").alias("effect"), "p")
    table = p.groupBy("phase").agg(F.count("*").alias("n"), F.avg("u").alias("mean_u"), F.avg("dist").alias("mean_dist"))
    return {"tests": tests(u, d, turn, bus), "table:phases": table}


@study("zone_geometry")
def zone_geometry(c: Context):
    """K-03: what each phase looks like, and the pulls seen from the one before."""
    p = D.pulls(c.tables)
    kinds = A.mode_share(p, ["phase"], "zone_type").withColumnsRenamed({"mode": "zone_type", "mode_share": "share"})
    q = p.groupBy("phase").agg(
        F.median("wait_s").alias("wait_s"), F.median("overlap").alias("overlap"), F.median("shrink_ratio").alias("shrink_ratio"),
        (F.percentile("offset_ratio", F.lit(0.75)) - F.percentile("offset_ratio", F.lit(0.25))).alias("spread"), (F.stddev_samp("dist") < 100).alias("fixed_distance"),
    )
    before = F.lag("angle_deg").over(Window.partitionBy("match_id").orderBy("phase"))
    rx, ry = G.rotated(F.col("dx"), F.col("dy"), before)
    turned = p.select("match_id", "phase", (rx / F.col("cur_r")).alias("along"), (ry / F.col("cur_r")).alias("across")).where("along is not null")
    last = R.first_rows(p.select("match_id", "phase", "next_x", "next_y"), ["match_id"], [F.desc("phase")])
    runs = W.runs(p.select("match_id", "phase", "zone_type"), ["match_id"], ["phase"], "zone_type").groupBy("match_id", "run", "zone_type").agg(F.min("phase").alias("first"), F.max("phase").alias("last"))
    return {"table:phases": q.join(kinds, "phase"), "table:turned": turned, "table:final_centres": last, "table:rule_runs": runs.groupBy("zone_type", "first", "last").agg(F.count("*").alias("matches"))}


@study("compare_periods", Param("rounds", default=1000), needs_compare=True)
def compare_periods(c: Context):
    """K-04: pulls of two selections; matches in both are told."""
    both = D.pulls(c.tables).withColumn("a", F.lit(True)).unionByName(D.pulls(c.compare).withColumn("a", F.lit(False)))
    ks = T.ks_two_sample(both, ["phase"], "a", "offset_ratio").select(F.concat(F.lit("distance, zone "), F.col("phase").cast("string")).alias("label"), (F.col("n_a") + F.col("n_b")).alias("n"), F.col("d").alias("effect"), "p")
    d = T.circular_permutation(both, ["phase"], "a", "angle_deg", int(c.params["rounds"])).join(both.groupBy("phase").agg(F.count("*").alias("n")), "phase")
    d = d.select(F.concat(F.lit("direction, zone "), F.col("phase").cast("string")).alias("label"), "n", F.col("distance").alias("effect"), "p")
    from tidemark.operators.selection import overlap

    return {"tests": tests(ks, d), "table:overlap": overlap(c.tables.matches, c.compare.matches)}


@study("positioning")
def positioning(c: Context):
    """K-05: being near the next circle at a shrink's start, and the finish."""
    t = c.tables
    s = t.zones.select("match_id", "phase", F.col("start_shrink_t").alias("at"), "next_x", "next_y", "next_r").join(D.humans(t).select("match_id", "id", "death_t", "final"), "match_id").where("death_t is null or death_t > at")
    j = asof_join(s, t.positions, ["match_id", "id"], ["x", "y"], time="at", right_time="t", tolerance=max(10.0, t.freshness))
    j = j.withColumn("radii", G.distance_m(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y")) * 100 / F.col("next_r")).withColumn("rank", R.percent_rank_average("final", ["match_id", "phase"]))
    j = j.withColumn("band", S.bands(F.col("radii"), [-1, 0.5, 1.0, 1.5, 2.0, 3.0, 1e9], ["deep inside", "inside", "near edge", "outside", "well outside", "far outside"]))
    by_phase = T.spearman(j, ["match_id", "phase"], "radii", "final").where("rho is not null")
    return {"tests": tests(rho_test(j, "distance and finish", "radii", "final"), mean_test(by_phase, "distance and finish, zone", "rho", group=("phase",))), "table:bands": j.groupBy("phase", "band").agg(F.count("*").alias("n"), F.avg("rank").alias("rivals_ahead"))}


@study("eliminations")
def eliminations(c: Context):
    """K-06."""
    k = asof_join(c.tables.kills, c.tables.zones, ["match_id"], D.ZONE, right_time="start_shrink_t")
    phase = {n: F.col(n) for n in ("cur_x", "cur_y", "cur_r", "next_x", "next_y", "next_r")} | {"start": F.col("start_shrink_t"), "finish": F.col("finish_shrink_t")}
    k = k.withColumn("margin", G.storm_margin(F.col("x"), F.col("y"), F.col("t"), phase)).where("margin is not null")
    return {"table:phases": k.groupBy("phase").agg(F.count("*").alias("n"), A.share(F.col("margin") < 0).alias("outside"), F.median("margin").alias("margin_m"))}


@study("height")
def height(c: Context):
    """K-07: the higher player's wins, and a team's standing against its finish."""
    k = D.kill_fights(c.tables, max(3.0, c.tables.freshness)).where("above_m is not null and above_m <> 0").withColumn("higher", F.col("above_m") > 0)
    per = k.groupBy("match_id").agg(A.share(F.col("higher")).alias("share"), F.count("*").alias("n")).where("n >= 5")
    b = T.binomial(k, ["phase"], F.col("higher")).select(F.concat(F.lit("higher wins, zone "), F.col("phase").cast("string")).alias("label"), "n", (F.col("k") / F.col("n")).alias("effect"), "p")
    s = c.standing
    return {"tests": tests(mean_test(per, "higher player wins", "share", 0.5), b, rho_test(s, "height and finish", "height_rank", "final")), "table:tiers": s.groupBy("phase", "tier").agg(F.count("*").alias("n"), F.avg("final").alias("final"))}


@study("rotation")
def rotation(c: Context):
    """K-08: when rotators arrive, and their finish; overall, by kind of zone and by skill."""
    r = c.rotations.where("timing is not null")
    die = F.col("died_in_shrink").cast("double")
    ends = r.where("timing <> 'Typical'").withColumn("died", die)
    by_kind = T.spearman(r, ["match_id", "kind"], "residual_s", "final", 5).where("rho is not null")
    parts = [
        rho_test(r.where("residual_s < double('infinity')"), "arrival and finish", "residual_s", "final"), gap_test(ends, "behind against ahead: eliminated", F.col("timing") == "Behind", "died"),
        rho_test(r, "distance and finish", "outside_m", "final"), mean_test(by_kind, "arrival and finish,", "rho", group=("kind",)),
        rho_test(r.where("pr_rank is not null and residual_s < double('infinity')"), "arrival and finish, ranked players", "residual_s", "final"),
    ]
    table = r.groupBy("phase", "kind", "timing").agg(F.count("*").alias("n"), F.avg("final").alias("final"), A.share(F.col("died_in_shrink"), 10).alias("died"), F.median("storm_s").alias("storm_s"), F.median("neighbours_100m").alias("neighbours"))
    return {"tests": tests(*parts), "table:timing": table}


@study("drops")
def drops(c: Context):
    """K-09: contested landings, early exits and the finish."""
    d = c.tables.landings.withColumn("out", F.coalesce(F.col("off_spawn"), F.lit(False)).cast("double"))
    skill = F.coalesce(F.log("pr_rank"), F.lit(11.5))
    d = d.withColumn("skill", skill)
    adjusted = d.withColumn("adjusted", F.col("final") - F.avg("final").over(Window.partitionBy("match_id")))
    spots = adjusted.where("poi is not null").groupBy("poi").agg(F.count("*").alias("n"), F.avg("final").alias("final"), F.avg("adjusted").alias("adjusted"), F.avg("opp_150m").alias("opponents"), A.share(F.col("off_spawn")).alias("off_spawn")).where("n >= 8")
    parts = [
        gap_test(d, "contested against alone: out at once", F.col("opp_150m") > 0, "out"), rho_test(d, "opponents and finish", "opp_300m", "final"),
        rho_test(d, "metres outside zone 2 and finish", "outside_zone2_m", "final"), rho_test(d, "strong opponents and finish", "opp_top1000_300m", "final"), rho_test(d, "metres from the bus and opponents", "bus_offset_m", "opp_300m"),
    ]
    return {"tests": tests(*parts), "table:spots": spots}


@study("divergence", needs_compare=True)
def divergence(c: Context):
    """K-10: per-match measures of two selections, compared one by one."""

    def measures(t: D.Tables) -> DataFrame:
        rot = D.rotations(t).groupBy("match_id").agg(F.avg("outside_m").alias("outside_m"), F.avg("storm_s").alias("storm_s"), F.avg("depart_s").alias("depart_s"), F.avg(F.col("died_in_shrink").cast("double")).alias("died_in_shrink"))
        pull = D.pulls(t).groupBy("match_id").agg(F.avg("u").alias("pull_u"), F.avg("offset_ratio").alias("pull_ratio"), F.avg("wait_s").alias("wait_s"), F.max("phase").cast("double").alias("phases"))
        kill = t.kills.groupBy("match_id").agg(F.count("*").cast("double").alias("eliminations"), F.median("t").alias("median_elimination_t"))
        player = D.humans(t).groupBy("match_id").agg(F.count("*").cast("double").alias("players"), F.countDistinct("team_index").cast("double").alias("teams"), F.avg(F.col("pr_rank").isNotNull().cast("double")).alias("ranked"))
        hit = D.player_hits(t).groupBy("match_id").agg(F.sum("amount").alias("damage"), F.count("*").cast("double").alias("hits"))
        wide = t.matches.select("match_id")
        for part in (rot, pull, kill, player, hit):
            wide = wide.join(part, "match_id", "left")
        names = [n for n in wide.columns if n != "match_id"]
        return wide.unpivot("match_id", names, "measure", "value")

    both = measures(c.tables).withColumn("a", F.lit(True)).unionByName(measures(c.compare).withColumn("a", F.lit(False)))
    mw = T.mann_whitney(both, ["measure"], "a", "value")
    table = mw.withColumn("verdict", S.verdict(F.when((F.col("n_a") >= 4) & (F.col("n_b") >= 4), F.col("p")), F.col("effect")))
    return {"tests": mw.select(F.col("measure").alias("label"), (F.col("n_a") + F.col("n_b")).alias("n"), "effect", "p"), "table:measures": table}


@study("loot", Param("window_s", default=120.0))
def loot(c: Context):
    """K-11: early loot and the finish."""
    d = D.loot_per_player(c.tables, float(c.params["window_s"])).where("survived")
    parts = [rho_test(d, f"{k} and finish", k, "final") for k in ("chests", "items", "weapons", "heals", "best_rarity", "first_chest_s")]
    parts.append(gap_test(d, "rifle and shotgun against not", F.col("ar_and_shotgun"), "final"))
    spots = d.where("poi is not null").groupBy("poi").agg(F.count("*").alias("n"), F.avg("items").alias("items"), F.avg("chests").alias("chests"), F.avg("final").alias("final")).where("n >= 8")
    return {"tests": tests(*parts), "table:spots": spots, "table:rarity": d.groupBy("best_rarity").agg(F.count("*").alias("n"), F.avg("final").alias("final"))}


@study("fights")
def fights(c: Context):
    """K-12: health, first shot and third parties in decided fights."""
    f = c.fights.where("winner is not null")
    share = lambda x: f.where(f"{x} is not null").groupBy("match_id").agg(A.share(F.col(x)).alias("share"), F.count("*").alias("n")).where("n >= 3")
    cost = f.withColumn("died", F.col("winner_died").cast("double"))
    bands = f.where("hp_gap is not null").withColumn("band", S.bands(F.abs("hp_gap"), [0, 25, 50, 100, 1e9], ["under 25", "25-50", "50-100", "over 100"]))
    parts = [mean_test(share("healthier_won"), "healthier side wins", "share", 0.5), mean_test(share("first_won"), "first to hit wins", "share", 0.5), gap_test(cost, "winner dies within a minute: third party against none", F.col("third_party"), "died", 2)]
    table = f.groupBy("phase").agg(F.count("*").alias("n"), A.share(F.col("healthier_won")).alias("healthier_won"), A.share(F.col("first_won")).alias("first_won"), A.share(F.col("third_party")).alias("third_party"))
    return {"tests": tests(*parts), "table:phases": table, "table:gaps": bands.groupBy("band").agg(F.count("*").alias("n"), A.share(F.col("healthier_won"), 5).alias("healthier_won"))}


@study("surge")
def surge(c: Context):
    """K-13: who a surge hits."""
    ep, per = c.surge
    mw = T.mann_whitney(per, ["match_id", "episode"], "surged", "dealt", small=True).where("n_a >= 2 and n_b >= 2 and p is not null")
    one_sided = mw.withColumn("half", F.when(F.col("effect") < 0, F.col("p") / 2).otherwise(1 - F.col("p") / 2))
    joint = T.stouffer(one_sided, [], "half").select(F.lit("players hit had dealt less").alias("label"), F.col("n").cast("bigint").alias("n"), F.col("z").alias("effect"), "p")
    table = ep.groupBy("phase").agg(F.count("*").alias("episodes"), F.avg("ticks").alias("ticks"), F.avg("per_tick").alias("per_tick"))
    rank = per.withColumn("quarter", F.least(F.floor(R.percent_rank_average("dealt", ["match_id", "episode"]) * 4), F.lit(3)))
    return {"tests": tests(joint, gap_test(per, "hit against not: finish", F.col("surged"), "final", 2)), "table:phases": table, "table:quarters": rank.groupBy("quarter").agg(F.count("*").alias("n"), A.share(F.col("surged")).alias("hit"))}


@study("surge_study")
def surge_study(c: Context):
    """K-14 in part: which rule separates best, how together teams are hit, and who is at risk."""
    mean, per = D.surge_rule(c.tables)
    together = T.agreement(per, ["match_id", "episode"], "team_index", "surged")
    profile = per.withColumn("band", S.bands(F.col("rank"), [0, 0.1, 0.25, 0.5, 0.9, 1.0], ["lowest tenth", "to a quarter", "to half", "to nine tenths", "top tenth"]))
    return {"table:rule": mean, "table:together": together, "table:bands": profile.groupBy("band").agg(F.count("*").alias("n"), A.share(F.col("surged")).alias("hit"), F.avg("final").alias("final"))}


@study("storm_hunt")
def storm_hunt(c: Context):
    """K-15: staying outside against rotating, like for like."""
    z = c.zones_outside.where("approach <> 'between'")
    z = c._kept(z.withColumn("far", S.bands(F.col("dist_m"), [-1, 300, 1e9], ["to 300", "over 300"])))
    parts = []
    for x in ("dealt", "taken", "net", "storm", "final"):
        parts.append(mean_test(A.like_for_like(z.withColumn(x, F.col(x).cast("double")), ["match_id", "phase", "far", "surge_half"], F.col("approach") == "stayed", x), f"stayed against rotated: {x}", "gap"))
    for x in ("surged", "out", "safe_alive"):
        parts.append(mean_test(A.like_for_like(z.withColumn(x, F.col(x).cast("double")), ["match_id", "phase", "far", "surge_half"], F.col("approach") == "stayed", x), f"stayed against rotated: {x}", "gap"))
    table = z.groupBy("phase", "approach", "surge_half").agg(F.count("*").alias("n"), F.avg("net").alias("net"), F.avg("storm").alias("storm"), A.share(F.col("out")).alias("out"), F.avg("lookers").alias("lookers"))
    spray = z.withColumn("lookers", F.least("lookers", F.lit(3))).groupBy("lookers", "approach").agg(F.count("*").alias("n"), F.avg("taken_wait").alias("taken_wait"))
    return {"tests": tests(*parts), "table:zones": table, "table:lookers": spray}


@study("endgame_height")
def endgame_height(c: Context):
    """K-16: height from the sixth zone on, the paths teams take, and who survives."""
    s = c.standing.where("phase >= 6")
    by = Window.partitionBy("match_id", "team_index").orderBy("phase")
    s = s.withColumn("survived", F.coalesce(F.lead("phase").over(by) == F.col("phase") + 1, F.lit(False)))
    tiers = F.sort_array(F.collect_list(F.struct("phase", "tier")))
    path = s.groupBy("match_id", "team_index").agg(tiers.alias("_t"), F.min("final").alias("final"), F.count("*").alias("n")).where("n >= 2")
    first, last = F.element_at("_t", 1)["tier"], F.element_at("_t", -1)["tier"]
    all_high = F.forall("_t", lambda x: x["tier"] == "High")
    all_low = F.forall("_t", lambda x: x["tier"] == "Low")
    kind = F.when(all_high, "held").when(all_low, "low").when((last == "High") & (first != "High"), "climbed").when((first == "High") & (last != "High"), "dropped").otherwise("mixed")
    path = path.withColumn("path", kind)
    return {"tests": tests(rho_test(s, "late height and finish", "height_rank", "final")), "table:paths": path.groupBy("path").agg(F.count("*").alias("n"), F.avg("final").alias("final")), "table:survival": s.groupBy("phase", "tier").agg(F.count("*").alias("n"), A.share(F.col("survived")).alias("survived"))}


@study("height_damage")
def height_damage(c: Context):
    """K-17: damage dealt for each point taken, by height and range."""
    e = D.exchanges(c.tables).where("phase >= 4")
    e = e.withColumn("trade", F.try_divide(F.col("dealt") - F.col("taken"), F.col("dealt") + F.col("taken")))
    table = e.groupBy("height", "range").agg(F.count("*").alias("n"), A.ratio_of_sums(F.col("dealt"), F.col("taken")).alias("ratio"), A.share(F.col("one_sided"), 10).alias("one_sided"))
    by_range = T.spearman(e, ["match_id", "range"], "above_m", "trade").where("rho is not null")
    return {"tests": tests(mean_test(by_range, "height and trade,", "rho", group=("range",))), "table:bands": table}


@study("zone_check")
def zone_check(c: Context):
    """K-18: do the circles agree with themselves and with the storm's damage?"""
    t = c.tables
    by = Window.partitionBy("match_id").orderBy("phase")
    z = t.zones.withColumn("gap_m", G.distance_m(F.lag("next_x").over(by), F.lag("next_y").over(by), F.col("cur_x"), F.col("cur_y"))).withColumn("ordered", F.coalesce(F.col("start_shrink_t") >= F.lag("finish_shrink_t").over(by), F.lit(True)))
    u = D.unexplained_drops(t).where("phase is not null")
    agree = u.groupBy("match_id").agg(F.count("*").alias("drops"), A.share(F.col("in_storm")).alias("storm_share"))
    last = R.first_rows(t.zones.select("match_id", "phase", "next_x", "next_y", "next_r"), ["match_id"], [F.desc("phase")])
    won = D.humans(t).where("final = 1").select("match_id", "id").join(last, "match_id")
    spot = t.positions.groupBy("match_id", "id").agg(F.max_by("x", "t").alias("x"), F.max_by("y", "t").alias("y"))
    near = won.join(spot, ["match_id", "id"]).groupBy("match_id").agg(F.min(G.distance_m(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y")) - F.col("next_r") / 100).alias("winner_outside_m"))
    per = z.groupBy("match_id").agg(F.max("gap_m").alias("largest_gap_m"), F.count_if(~F.col("ordered")).alias("out_of_order")).join(agree, "match_id", "left").join(near, "match_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("largest_gap_m") > 1, "gap"), F.when(F.col("out_of_order") > 0, "order"), F.when(F.col("winner_outside_m") > 25, "winner outside")))
    return {"table:matches": per.withColumn("flags", F.array_join(flags, ",")), "metrics": metrics(per, continuous=A.share(F.coalesce(F.col("largest_gap_m") <= 1, F.lit(True))), in_order=A.share(F.col("out_of_order") == 0))}


@study("decides")
def decides(c: Context):
    """K-21, M-11: which groups of factors tell the finish, out of fold."""
    t = c.tables
    own = D.humans(t).select("match_id", "id", "final", F.coalesce(F.log("pr_rank"), F.lit(None)).alias("skill"), F.col("kills").cast("double").alias("kills"))
    rot = c.rotations.groupBy("match_id", "id").agg(F.avg("outside_m").alias("outside_m"), F.avg("arrival_rank").alias("arrival"), F.avg("storm_s").alias("storm_s"))
    hit = D.player_hits(t).groupBy("match_id", F.col("attacker_id").alias("id")).agg(F.sum("amount").alias("dealt"))
    d = own.join(rot, ["match_id", "id"], "left").join(hit, ["match_id", "id"], "left")
    groups = {"skill": ["skill"], "rotation": ["outside_m", "arrival", "storm_s"], "fighting": ["kills", "dealt"]}
    names = [n for g in groups.values() for n in g]
    d = d.select("match_id", "id", *(R.z_score(n, ["match_id"]).alias(n) for n in names), R.z_score("final", ["match_id"]).alias("y")).persist()
    out = None
    for label, features in (*groups.items(), ("all", names)):
        r2 = T.ridge_out_of_fold(d, "match_id", features, "y").agg(F.lit(label).alias("factors"), F.count("*").alias("n"), T.r_squared("y", "predicted").alias("r2"))
        out = r2 if out is None else out.unionByName(r2)
    lobby = D.alive_by_phase(t).join(D.lobby_groups(t.matches), "match_id").groupBy("lobby", "phase").agg(F.avg("alive").alias("alive"))
    return {"table:factors": out, "table:alive": lobby}


@study("audit")
def audit(c: Context):
    """K-24 in part: every team's game by game: points, risks, numbered in time order."""
    from tidemark.operators.selection import numbered_games, team_games

    t = c.tables
    account = "player_id" if "player_id" in t.players.columns else "id"
    games = P.scored(team_games(D.humans(t), account), P.scheme(t.players.sparkSession, P.DUOS))
    start = t.matches.select("match_id", F.col("match_date").alias("replay_timestamp"))
    games = numbered_games(games.join(start, "match_id", "left")).join(V.game_risks(t).drop("final"), ["match_id", "team_index"], "left")
    return {"table:games": games.withColumn("flags", F.array_join("flags", ","))}


@study("match_map")
def match_map(c: Context):
    """K-27 in part: thinned tracks, and eliminations with both teams."""
    t = c.tables
    team = t.players.select("match_id", "id", "team_index")
    k = t.kills.join(team.withColumnsRenamed({"id": "victim_id", "team_index": "victim_team"}), ["match_id", "victim_id"], "left").join(team.withColumnsRenamed({"id": "finisher_id", "team_index": "finisher_team"}), ["match_id", "finisher_id"], "left")
    return {"table:tracks": W.strided(t.positions, ["match_id", "id"], ["t"], 4).select("match_id", "id", "t", "x", "y"), "table:kills": k.select("match_id", "t", "victim_id", "victim_team", "finisher_id", "finisher_team", "x", "y")}


@study("match_room")
def match_room(c: Context):
    """K-28 in part: the log of damage with its causes, and what ended each player."""
    log, killer = D.damage_causes(c.tables)
    return {"table:damage": log, "table:deaths": killer, "table:causes": A.value_shares(log, ["match_id"], "cause")}


@study("gameplan")
def gameplan(c: Context):
    """K-29, D-43, D-44, X-15 in part: the latest time to leave, the surge line, and what a place is worth."""
    def leave_by() -> DataFrame:
        r = c.rotations.where("entry_t is not null and depart_t is not null and entry_t > depart_t")
        speed = r.groupBy("phase").agg(F.median(F.try_divide("outside_m", F.col("entry_t") - F.col("depart_t"))).alias("speed"), F.median(F.col("start_shrink_t") - F.col("reveal_t")).alias("wait_s"))
        return speed.withColumn("distance_m", F.explode(F.array(*(F.lit(float(d)) for d in (50, 100, 200, 400))))).withColumn("leave_by_s", F.col("wait_s") - F.try_divide("distance_m", "speed"))

    def late() -> DataFrame:
        speed = leave_by().groupBy("phase").agg(F.first("speed").alias("speed"))
        r = c.rotations.join(speed, "phase").withColumn("late", F.col("depart_s") > F.col("start_shrink_t") - F.col("reveal_t") - F.try_divide("outside_m", "speed"))
        return r.groupBy("phase", "late").agg(F.count("*").alias("n"), A.share(F.col("storm_n") > 0).alias("storm"))

    def surge_line() -> DataFrame:
        ep, per = c.surge
        first = R.first_rows(ep, ["match_id", "phase"], [F.asc("t0")]).select("match_id", "episode", F.col("phase").alias("zone"))
        return per.join(first, ["match_id", "episode"]).groupBy("zone").agg(F.median("dealt").alias("median"), F.percentile("dealt", F.lit(0.8)).alias("p80"), F.count("*").alias("n"))

    exchange = lambda: P.exchange(P.scheme(c.tables.players.sparkSession, P.DUOS))
    return Frames({"table:leave_by": leave_by, "table:late": late, "table:surge_line": surge_line, "table:exchange": exchange})


# ---- all studies of one selection -------------------------------------------------------------------------------


SHEET = "study string, kind string, label string, value double, n bigint, p double, strength string"
#: Team studies first.
FIRST = ("audit", "field", "gameplan")


def findings(context: Context, ids: tuple[str, ...] | None = None, at_once: int = 6) -> DataFrame:
    """S-15: one long sheet (study, kind, label, value, n, p, strength); a failing study has one row that says so.

    For all studies the shared detectors are written first. Then each study's tests and metrics are one job, ``at_once`` of them at a time,
    which writes its rows to the shared folder; the sheet is what lies there.
    """
    spark = context.tables.matches.sparkSession
    if ids is None:
        context.detect()
    folder = f"{shared_dir(spark)}/findings-{uuid.uuid4().hex}"
    order = [i for i in FIRST if i in STUDIES] + [i for i in STUDIES if i not in FIRST]
    use = [i for i in order if (not ids or i in ids) and not (STUDIES[i].needs_compare and context.compare is None)]
    none = F.lit(None)

    def rows(i: str) -> DataFrame:
        out = None
        found = run_study(i, context)
        for name in found:
            if name == "tests":
                one = found[name].select(F.lit("test").alias("kind"), "label", F.col("effect").cast("double").alias("value"), F.col("n").cast("bigint").alias("n"), F.col("p").cast("double").alias("p"), S.strength(F.col("p")).alias("strength"))
            elif name == "metrics":
                one = found[name].select(F.lit("metric").alias("kind"), "label", F.col("value").cast("double").alias("value"), none.cast("bigint").alias("n"), none.cast("double").alias("p"), none.cast("string").alias("strength"))
            else:
                continue
            out = one if out is None else out.unionByName(one)
        return spark.createDataFrame([], SHEET) if out is None else out.select(F.lit(i).alias("study"), *(f.name for f in out.schema))

    def write(i: str) -> None:
        try:
            rows(i).write.parquet(f"{folder}/{i}")
        except Exception as e:  # one study's failure is a finding, not the run's end
            spark.createDataFrame([(i, "failed", str(e)[:200], None, None, None, None)], SHEET).write.mode("overwrite").parquet(f"{folder}/{i}")

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(write, use))
    return spark.read.schema(SHEET).parquet(*(f"{folder}/{i}" for i in use)) if use else spark.createDataFrame([], SHEET)

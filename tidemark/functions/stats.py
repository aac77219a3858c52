"""Statistics: Spark gathers what a test needs, closed forms and small Arrow functions give the p-value of each group.

Every function takes a frame and group columns and returns one row for each group. No value is collected. Nulls do
not count. Constants never raise: a test without enough or varying values has a null p.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tidemark.operators.ranks import average_rank, summed_below
from tidemark.sources.shared import written

#: A permutation's rows are added up by so many bits of their hash.
HASH_BITS = 5

# ---- distribution functions, on plain numbers ------------------------------------------------------------------


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_exact(d: float, n: int) -> float:
    """P(D >= d) of n uniform values: the matrix form of Marsaglia, Tsang and Wang."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    a = np.zeros((m, m))
    for i in range(m):
        for j in range(m):
            a[i, j] = 0.0 if i - j + 1 < 0 else 1.0
    for i in range(m):
        a[i, 0] -= h ** (i + 1)
        a[m - 1, i] -= h ** (m - i)
    a[m - 1, 0] += (2 * h - 1) ** m if 2 * h - 1 > 0 else 0.0
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                a[i, j] /= math.factorial(i - j + 1)
    power, scale, e, b, eb = n, np.eye(m), 0, a, 0
    while power:
        if power & 1:
            scale, e = scale @ b, e + eb
        b, eb = b @ b, 2 * eb
        if b[k - 1, k - 1] > 1e140:
            b, eb = b * 1e-140, eb + 140
        power >>= 1
    s = scale[k - 1, k - 1]
    for i in range(1, n + 1):
        s *= i / n
        if s < 1e-140:
            s, e = s * 1e140, e - 140
    return min(1.0, max(0.0, 1 - s * 10.0**e))


def kolmogorov_limit(x: float) -> float:
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_p(d: float, n: float) -> float:
    return kolmogorov_exact(d, int(n)) if n == int(n) and n <= 140 else kolmogorov_limit(d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)))


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Sum of all outcomes no likelier than k."""
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(n + 1)]
    return min(1.0, sum(math.exp(x) for x in log if x <= log[k] + 1e-7))


def _per_row(f, n_args: int):
    """A double from doubles, null where any is null."""

    def run(*columns: pd.Series) -> pd.Series:
        out = [None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns, strict=True)]
        return pd.Series(out, dtype="float64")

    # an Arrow function needs a fixed signature
    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf({1: one, 2: two, 3: three}[n_args], DoubleType())


t_p = _per_row(t_two_sided, 2)
normal_p = _per_row(normal_two_sided, 1)
ks_p_of = _per_row(ks_p, 2)
binomial_p = _per_row(lambda k, n, p: binomial_two_sided(int(k), int(n), p), 3)
normal_quantile = _per_row(lambda p: NormalDist().inv_cdf(min(max(p, 1e-300), 1 - 1e-16)), 1)

# ---- circular ---------------------------------------------------------------------------------------------------


def circular_mean(degrees: str | Column, axial: bool = False) -> Column:
    """Mean direction of an aggregation, 0 to 360 (0 to 180 for axes)."""
    x = F.radians((F.col(degrees) if isinstance(degrees, str) else degrees) * (2 if axial else 1))
    mean = F.pmod(F.degrees(F.atan2(F.avg(F.sin(x)), F.avg(F.cos(x)))), F.lit(360.0))
    return mean / 2 if axial else mean


def rayleigh(df: DataFrame, group: Sequence[str], degrees: str, axial: bool = False) -> DataFrame:
    """n, r (length of the mean vector), mean_deg and p by the four-term expansion, within 0 and 1."""
    x = F.radians(F.col(degrees) * (2 if axial else 1))
    stats = df.where(F.col(degrees).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(F.cos(x)).alias("_c"), F.avg(F.sin(x)).alias("_s"), circular_mean(degrees, axial).alias("mean_deg")
    )
    n, r = F.col("n"), F.sqrt(F.col("_c") ** 2 + F.col("_s") ** 2)
    z = n * r * r
    p = F.exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4) / (288 * n * n))
    return stats.select(*group, "n", r.alias("r"), "mean_deg", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))


# ---- one and two samples ----------------------------------------------------------------------------------------


def ks_uniform(df: DataFrame, group: Sequence[str], u: str) -> DataFrame:
    """n, d and p against the uniform distribution on 0 to 1. Equal values are added up first; no group is one task's."""
    steps = df.where(F.col(u).isNotNull()).groupBy(*group, F.col(u).alias("_u")).agg(F.count("*").alias("_n"))
    s = summed_below(steps, group, "_u", ["_n"])
    gap = F.greatest((F.col("below__n") + F.col("_n")) / F.col("all__n") - F.col("_u"), F.col("_u") - F.col("below__n") / F.col("all__n"))
    out = s.groupBy(*group).agg(F.sum("_n").alias("n"), F.max(gap).alias("d"))
    return out.withColumn("p", ks_p_of(F.col("d"), F.col("n").cast("double")))


def _sided(df: DataFrame, group: Sequence[str], side: str, x: str) -> DataFrame:
    """Distinct values of each group with ``_a`` and ``_b``, the rows of either side, and what lies below them."""
    use = df.where(F.col(x).isNotNull() & F.col(side).isNotNull())
    steps = use.groupBy(*group, F.col(x).alias("_x")).agg(F.count_if(F.col(side)).alias("_a"), F.count_if(~F.col(side)).alias("_b"))
    return summed_below(steps, group, "_x", ["_a", "_b"])


def ks_two_sample(df: DataFrame, group: Sequence[str], side: str, x: str) -> DataFrame:
    """n_a, n_b, d and p for the rows where ``side`` is true and false."""
    share = lambda c: F.try_divide(F.col(f"below_{c}") + F.col(c), F.col(f"all_{c}"))
    out = _sided(df, group, side, x).withColumn("_gap", F.abs(share("_a") - share("_b"))).groupBy(*group).agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.max("_gap").alias("d")
    )
    size = F.try_divide(F.col("n_a") * F.col("n_b"), F.col("n_a") + F.col("n_b"))
    return out.withColumn("p", ks_p_of(F.col("d"), F.when(size > 0, size + 1e-9)))


def t_test(df: DataFrame, group: Sequence[str], x: str, mu: float = 0.0) -> DataFrame:
    """n, mean, t and p; without spread p is 0 where three or more values all differ from mu, and null below three."""
    s = df.groupBy(*group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_sd"))
    t = F.try_divide(F.col("mean") - mu, F.col("_sd") / F.sqrt("n"))
    spread = F.coalesce(F.col("_sd") > 1e-12, F.lit(False))
    p = t_p(F.when(spread & (F.col("n") >= 3), t), (F.col("n") - 1).cast("double"))
    flat = F.when((F.col("n") >= 3) & ~spread, F.when(F.abs(F.col("mean") - mu) > 1e-12, 0.0).otherwise(1.0))
    return s.select(*group, "n", "mean", F.when(spread, t).alias("t"), F.coalesce(p, flat).alias("p"))


def effect_test(df: DataFrame, units: Sequence[str], effect: Column, group: Sequence[str] = (), mu: float = 0.0) -> DataFrame:
    """One effect for each unit, as a match, then a t-test over the units."""
    per_unit = df.groupBy(*units, *[g for g in group if g not in units]).agg(effect.alias("effect"))
    return t_test(per_unit.where("effect is not null"), group, "effect", mu)


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str, least: int = 4) -> DataFrame:
    """n and rho of the pairs without nulls; null for fewer than ``least`` or a constant side."""
    use = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = use.select(*group, average_rank(x, group).alias("_rx"), average_rank(y, group).alias("_ry"))
    out = ranked.groupBy(*group).agg(
        F.count("*").alias("n"), F.covar_pop("_rx", "_ry").alias("_c"), F.var_pop("_rx").alias("_vx"), F.var_pop("_ry").alias("_vy")
    ).withColumn("_r", F.try_divide("_c", F.sqrt(F.col("_vx") * F.col("_vy"))))
    ok = (F.col("n") >= least) & (F.col("_vx") > 0) & (F.col("_vy") > 0)
    return out.select(*group, "n", F.when(ok, F.col("_r")).alias("rho"))


def _rank_sums(df: DataFrame, group: Sequence[str], side: str, x: str, small: bool = False) -> DataFrame:
    """n_a, n_b, the true side's sum of average ranks ``_ra``, and ``_t``, the sum of n^3 - n over ties.

    ``small``: groups are many and of bounded size, so that each is one window, without ranges of values.
    """
    if small:
        use = df.where(F.col(side).isNotNull() & F.col(x).isNotNull()).select(*group, F.col(side).alias("_s"), F.col(x).alias("_x"))
        by = Window.partitionBy(*group).orderBy("_x")
        upto, below = F.count("*").over(by), F.rank().over(by) - 1  # of equal values all are counted
        ranked = use.select(*group, "_s", ((upto + below + 1) / 2).alias("_r"), (upto - below).alias("_n"))
        return ranked.groupBy(*group).agg(
            F.count_if("_s").alias("n_a"), F.count_if(~F.col("_s")).alias("n_b"), F.sum(F.when(F.col("_s"), F.col("_r"))).alias("_ra"), F.sum(F.col("_n") * F.col("_n") - 1).alias("_t")
        )
    n = F.col("_a") + F.col("_b")
    rank = F.col("below__a") + F.col("below__b") + (n + 1) / 2
    return _sided(df, group, side, x).groupBy(*group).agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.when(F.col("_a") > 0, F.col("_a") * rank)).alias("_ra"), F.sum(n * (n * n - 1)).alias("_t")
    )


def mann_whitney(df: DataFrame, group: Sequence[str], side: str, x: str, small: bool = False) -> DataFrame:
    """n_a, n_b, u of the true side, effect (rank-biserial) and the normal p with ties and continuity. ``small``: as for ``auc``."""
    s = _rank_sums(df, group, side, x, small)
    a, b = F.col("n_a"), F.col("n_b")
    n = a + b
    u = F.col("_ra") - a * (a + 1) / 2
    variance = a * b / 12.0 * ((n + 1) - F.coalesce(F.try_divide(F.col("_t").cast("double"), n * (n - 1)), F.lit(0.0)))
    z = F.try_divide(F.greatest(F.abs(u - a * b / 2) - 0.5, F.lit(0.0)), F.sqrt(variance))
    ok = (a > 0) & (b > 0) & (variance > 0)
    return s.select(*group, "n_a", "n_b", F.when((a > 0) & (b > 0), u).alias("u"), F.try_divide(2 * u, a * b).alias("_e"), F.when(ok, z).alias("_z")).select(
        *group, "n_a", "n_b", "u", (F.col("_e") - 1).alias("effect"), normal_p("_z").alias("p")
    )


def auc(df: DataFrame, group: Sequence[str], positive: str, score: str, small: bool = False) -> DataFrame:
    """Chance that a positive has the higher score, ties half. ``small``: many groups, each of bounded size."""
    s = _rank_sums(df, group, positive, score, small).withColumnsRenamed({"n_a": "n_pos", "n_b": "n_neg"})
    value = F.try_divide(F.col("_ra") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg"))
    return s.select(*group, "n_pos", "n_neg", value.alias("auc"))


def stouffer(df: DataFrame, group: Sequence[str], p: str) -> DataFrame:
    """Joint z and one-sided p of one-sided p-values."""
    z = df.where(F.col(p).isNotNull()).withColumn("_z", normal_quantile(1 - F.col(p)))
    out = z.groupBy(*group).agg(F.count("*").alias("n"), (F.sum("_z") / F.sqrt(F.count("*"))).alias("z"))
    return out.withColumn("p", F.when(F.col("z") >= 0, normal_p("z") / 2).otherwise(1 - normal_p("z") / 2))


def binomial(df: DataFrame, group: Sequence[str], success: Column, p: float = 0.5) -> DataFrame:
    s = df.where(success.isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.count_if(success).alias("k"))
    return s.withColumn("p", binomial_p(F.col("k").cast("double"), F.col("n").cast("double"), F.lit(p)))


def circular_permutation(df: DataFrame, group: Sequence[str], side: str, degrees: str, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """Whether two sides have different mean directions: side labels dealt anew ``rounds`` times by a hash, add-one p.

    The statistic is the distance of the sides' mean vectors; each round orders a group's rows by a hash and labels
    as many of them as the true side has. A round is never sorted: its rows are added up by slices of the hash, whole slices
    go to one side, and of the one slice with the last labelled row alone the rows are put in order.
    """
    keys = [f"_g{k}" for k in range(len(group))]
    named = [F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]
    use = df.where(F.col(degrees).isNotNull() & F.col(side).isNotNull()).select(
        *named, F.cos(F.radians(degrees)).alias("_c"), F.sin(F.radians(degrees)).alias("_s"), F.col(side).alias("_a")
    )
    by = Window.partitionBy(*keys)
    sized = use.select("*", F.count_if("_a").over(by).alias("_m"), F.row_number().over(by.orderBy("_c", "_s", "_a")).alias("_i"))
    # few rows become many: they are dealt out before
    sized = written(sized.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "dealt")
    place = F.xxhash64("_round", "_i", F.lit(seed))
    slice_ = F.shiftright(place, 64 - HASH_BITS)
    sums = [F.count("*").alias("_n"), F.sum("_c").alias("_c"), F.sum("_s").alias("_s")]
    dealt = sized.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds)))).where("_round > 0")
    per = written(dealt.groupBy(*keys, "_round", slice_.alias("_slice")).agg(*sums, F.max("_m").alias("_m")), "slices")
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_round").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_left", F.col("_m") - below)
    whole = per.where("_left <= 0 or _left >= _n").select(*keys, "_round", (F.col("_left") > 0).alias("_b"), "_n", "_c", "_s")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of a with the one small row of b for their group."""
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        return a.alias("a").join(F.broadcast(b).alias("b"), on, "left").select("a.*", *(F.col(f"b.{c}") for c in b.columns if c not in keys))

    cuts = per.where("_left > 0 and _left < _n").groupBy(*keys).agg(F.collect_list(F.struct("_round", "_slice", "_left")).alias("_cuts"))
    cut = met(sized, cuts).select(*keys, "_c", "_s", "_i", F.inline("_cuts")).where(F.col("_slice") == slice_)
    last = F.row_number().over(Window.partitionBy(*keys, "_round").orderBy(place, "_i")) <= F.col("_left")
    parts = whole.unionByName(cut.select(*keys, "_round", last.alias("_b"), F.lit(1).alias("_n"), "_c", "_s"))

    def distance(yes: Column, n: Column) -> Column:
        gap = lambda c: F.try_divide(F.sum(F.when(yes, F.col(c))), F.sum(F.when(yes, n))) - F.try_divide(F.sum(F.when(~yes, F.col(c))), F.sum(F.when(~yes, n)))
        return F.sqrt(gap("_c") ** 2 + gap("_s") ** 2)

    seen = sized.groupBy(*keys).agg(distance(F.col("_a"), F.lit(1)).alias("distance"))
    each = parts.groupBy(*keys, "_round").agg(distance(F.col("_b"), F.col("_n")).alias("_d"))
    k = met(each, seen).groupBy(*keys).agg(F.count_if(F.col("_d") >= F.col("distance") - 1e-12).alias("_k"))
    p = F.when(F.col("distance").isNotNull(), (F.coalesce("_k", F.lit(0)) + 1) / F.lit(rounds + 1.0))
    return met(seen, k).select(*(F.col(k).alias(g) for g, k in zip(group, keys, strict=True)), "distance", p.alias("p"))


# ---- models' helpers --------------------------------------------------------------------------------------------


def folds(df: DataFrame, unit: str, k: int, seed: int = 0) -> DataFrame:
    """``fold`` from 0 for each unit, all of a unit's rows in one fold; sizes differ by one at most."""
    # places in hash order: within one of 1,024 hash buckets, plus what the buckets before it hold
    units = df.select(unit).distinct().withColumn("_h", F.xxhash64(unit, F.lit(seed))).withColumn("_b", F.shiftrightunsigned("_h", 54))
    sizes = units.groupBy("_b").count()  # at most 1,024 rows
    before = sizes.select("_b", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", unit)) - 1 + F.col("_before")
    dealt = units.join(F.broadcast(before), "_b").select(unit, (place % k).cast("int").alias("fold"))
    return df.join(dealt, unit)


def ridge(df: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept: Spark sums the products, numpy solves the small system. Rows with nulls do not count."""
    use = df.select(*features, target).dropna()
    names = [*features, target]
    sums = use.agg(
        F.count("*").alias("n"),
        *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)),
        *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j),
    ).first()
    k, n = len(features), sums["n"]
    if not n:
        return np.zeros(k), 0.0
    c = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) * n
    w = np.linalg.solve(c[:k, :k] + penalty * np.eye(k), c[:k, k])
    means = np.array([sums[f"m{i}"] for i in range(k + 1)])
    return w, float(means[k] - w @ means[:k])


def linear(features: Sequence[str], weights: np.ndarray, intercept: float) -> Column:
    out = F.lit(float(intercept))
    for f, w in zip(features, weights, strict=True):
        out = out + F.col(f) * F.lit(float(w))
    return out


def ridge_out_of_fold(df: DataFrame, unit: str, features: Sequence[str], target: str, k: int = 5, penalty: float = 1.0) -> DataFrame:
    """The rows with ``predicted``, each by the model of the other folds. One small aggregate for each fold."""
    dealt = folds(df, unit, k)
    out = F.lit(None).cast("double")
    for fold in range(k):
        w, b = ridge(dealt.where(F.col("fold") != fold), features, target, penalty)
        out = F.when(F.col("fold") == fold, linear(features, w, b)).otherwise(out)
    return dealt.withColumn("predicted", out)


def r_squared(y: str, predicted: str, baseline: str | None = None) -> Column:
    """One less the squared error over that of the mean, or of another prediction."""
    y_, p = F.col(y), F.col(predicted)
    ok = y_.isNotNull() & p.isNotNull()
    error = F.sum(F.when(ok, (y_ - p) ** 2))
    base = F.sum(F.when(ok, (y_ - F.col(baseline)) ** 2)) if baseline else F.var_pop(F.when(ok, y_)) * F.count(F.when(ok, F.lit(1)))
    return 1 - F.try_divide(error, base)


def calibration(df: DataFrame, y: str, predicted: str, bins: int = 10) -> DataFrame:
    """Mean prediction and outcome of equal-count bins of the prediction."""
    # percentile edges instead of a global row number: no single-partition sort of all rows
    edges = df.agg(F.percentile(predicted, F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("_e"))
    placed = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(predicted))))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg(predicted).alias("predicted"), F.avg(y).alias("seen"))


def agreement(df: DataFrame, episode: Sequence[str], team: str, flag: str) -> DataFrame:
    """Share of teams of two or more whose members all have the same flag."""
    teams = df.groupBy(*episode, team).agg(F.count("*").alias("_n"), F.countDistinct(flag).alias("_d")).where("_n > 1")
    return teams.agg(F.count("*").alias("teams"), F.avg((F.col("_d") == 1).cast("double")).alias("together"))


def conclusion(tests: DataFrame, matches: DataFrame, alpha: float = 0.05, least: int = 20) -> DataFrame:
    """One row: the strongest test, the reliability checks of the selection, and found, none, insufficient or descriptive."""
    checks = matches.agg(
        F.count("*").alias("n_matches"),
        (F.countDistinct("season") <= 1).alias("one_season"),
        (F.avg(F.coalesce("is_server_replay", F.lit(False)).cast("double")) >= 0.95).alias("server"),
        (F.coalesce(F.median("lobby_strength"), F.lit(0.0)) >= 0.5).alias("strong_lobbies"),
    )
    seen = tests.agg(F.count("p").alias("n_tests"), F.min("p").alias("best_p"), F.min_by("label", F.coalesce("p", F.lit(2.0))).alias("best"))
    status = (
        F.when(F.col("n_tests") == 0, "descriptive")
        .when(F.col("n_matches") < least, "insufficient")
        .when(F.col("best_p") < alpha, "found")
        .otherwise("none")
    )
    return checks.crossJoin(seen).withColumn("status", status)

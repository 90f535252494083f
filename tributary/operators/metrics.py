"""Metrics that compare two measurements, ground truth and simulation.

Both are tables of key columns and ``value``.  ``group`` names keys that part
the result (nodes or communities): the same plan serves one comparison or
one for each key of the ground truth.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keys_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "value"]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def join(gt: DataFrame, sim: DataFrame, how: str = "inner", fill: float | str = 0, group: list[str] | None = None) -> DataFrame:
    """keys, value_gt, value_sim; missing values get ``fill`` or, with "ffill", the last one before in order of the keys (of the group)."""
    keys = keys_of(gt)
    both = gt.withColumnRenamed("value", "value_gt").join(sim.withColumnRenamed("value", "value_sim"), keys, how)
    if fill == "ffill":
        own = W.partitionBy(*(group or [])).orderBy(*[k for k in keys if k not in (group or [])]).rowsBetween(W.unboundedPreceding, 0)
        return both.select(*keys, *[F.last(c, ignorenulls=True).over(own).alias(c) for c in ("value_gt", "value_sim")])
    return both.select(*keys, *[F.coalesce(c, F.lit(fill)).cast("double").alias(c) for c in ("value_gt", "value_sim")])


def _by(df: DataFrame, group: list[str] | None):
    return df.groupBy(*(group or []))


def absolute_difference(gt: DataFrame, sim: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _pair(gt, sim, keys).select(*(keys or []), F.abs(F.col("s") - F.col("g")).cast("double").alias("value"))


def absolute_percentage_error(gt: DataFrame, sim: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _pair(gt, sim, keys).select(*(keys or []), (100 * F.abs(F.col("s") - F.col("g")) / F.nullif(F.col("g").cast("double"), F.lit(0.0))).alias("value"))


def _pair(gt, sim, keys):
    g, s = gt.withColumnRenamed("value", "g"), sim.withColumnRenamed("value", "s")
    return g.join(s, keys, "left") if keys else g.join(s, how="left")


def histogram(gt: DataFrame, sim: DataFrame, method: str = "doane", group: list[str] | None = None) -> DataFrame:
    """(group, bin, bins, gt, sim): counts in common bins of equal width over both; rules doane, sturges, fd and auto (the narrower of the last two)."""
    group = group or []
    x = lambda df, a, b: df.select(*group, F.col("value").cast("double").alias("x"), F.lit(a).alias("g"), F.lit(b).alias("s"))
    rows = x(gt, 1, 0).unionByName(x(sim, 0, 1)).filter(finite(F.col("x")))
    stats = rows.groupBy(*group).agg(F.count("x").cast("double").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.coalesce(F.skewness("x"), F.lit(0.0)).alias("g1"),
                                     (F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"))
    n, span = F.col("n"), F.col("hi") - F.col("lo")
    sturges = span / (F.log2(n) + 1)
    fd = 2 * F.col("iqr") * F.pow(n, F.lit(-1 / 3))
    scale = F.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
    doane = F.when(n > 2, span / (1 + F.log2(n) + F.log2(1 + F.abs("g1") / F.nullif(scale, F.lit(0.0)))))
    width = {"doane": doane, "sturges": sturges, "fd": fd, "auto": F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)}[method]
    stats = stats.withColumn("bins", F.when((span > 0) & (width > 0), F.ceil(span / F.nullif(width, F.lit(0.0)))).otherwise(1).cast("bigint"))
    wide = rows.join(stats, group) if group else rows.join(F.broadcast(stats))
    place = F.when(span > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(span, F.lit(0.0)) * F.col("bins")), F.col("bins") - 1)).otherwise(0).cast("bigint")
    counts = wide.groupBy(*group, place.alias("bin")).agg(F.sum("g").alias("gt"), F.sum("s").alias("sim"))
    every = stats.select(*group, "bins", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"))
    return every.join(counts, [*group, "bin"], "left").select(*group, "bin", "bins", F.coalesce("gt", F.lit(0)).alias("gt"), F.coalesce("sim", F.lit(0)).alias("sim"))


def _shares(gt, sim, discrete, method, group, smooth=None):
    """Both as shares p, q of their sums over common bins or keys."""
    if discrete:
        rows = join(gt, sim, "full_outer", 0).withColumnsRenamed({"value_gt": "gt", "value_sim": "sim"})
    else:
        rows = histogram(gt, sim, method, group)
    if smooth is not None:
        rows = rows.withColumn("sim", (1 - smooth) * F.col("sim") + smooth)
    sums = _by(rows, group).agg(F.sum("gt").cast("double").alias("g"), F.sum("sim").cast("double").alias("s"))
    both = rows.join(sums, group) if group else rows.join(F.broadcast(sums))
    return both.select(*(group or []), (F.col("gt") / F.nullif(F.col("g"), F.lit(0.0))).alias("p"), (F.col("sim") / F.nullif(F.col("s"), F.lit(0.0))).alias("q"))


def kl_divergence(gt: DataFrame, sim: DataFrame, discrete: bool = False, group=None, smooth: float | None = None) -> DataFrame:
    """Sum of p ln(p / q); infinite where q is 0 and p isn't.  ``smooth``: counts of the simulation become (1 - a) c + a, bins by the rule "auto"."""
    rows = _shares(gt, sim, discrete, "auto" if smooth is not None else "doane", group, smooth)
    p, q = F.col("p"), F.col("q")
    term = F.when(p <= 0, 0.0).when(q <= 0, float("inf")).otherwise(p * F.ln(p / F.nullif(q, F.lit(0.0))))
    return _by(rows, group).agg(F.sum(term).alias("value"))


def kl_divergence_smoothed(gt: DataFrame, sim: DataFrame, alpha: float = 0.01, discrete: bool = False, group=None) -> DataFrame:
    return kl_divergence(gt, sim, discrete, group, alpha)


def js_divergence(gt: DataFrame, sim: DataFrame, discrete: bool = False, base: float = 2.0, group=None) -> DataFrame:
    rows = _shares(gt, sim, discrete, "doane", group)
    m = (F.col("p") + F.col("q")) / 2
    half = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / F.nullif(m, F.lit(0.0)))).otherwise(0.0)
    return _by(rows, group).agg((F.sum(half("p") + half("q")) / 2 / math.log(base)).alias("value"))


def _dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Exact dynamic time warping with absolute distance, one antidiagonal of the table at a time."""
    n, m = len(a), len(b)
    if not n or not m:
        return float("nan")
    inf = np.inf
    two, one = np.full(n + 1, inf), np.full(n + 1, inf)  # by row, from 1; row 0 is the border
    two[0] = 0.0  # the corner, before the first diagonal
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        i = np.arange(lo, hi + 1)
        new = np.full(n + 1, inf)
        new[i + 1] = np.abs(a[i] - b[d - i]) + np.minimum(np.minimum(one[i], one[i + 1]), two[i])
        two, one = one, new
    return float(one[n])


def dtw(gt: DataFrame, sim: DataFrame, group: list[str] | None = None) -> DataFrame:
    """DTW of the outer-joined series, filled with 0, in order of the keys.  A group's series meets in one task."""
    group = group or []
    order = [k for k in keys_of(gt) if k not in group]
    rows = join(gt, sim, "full_outer", 0).select(*group, F.struct(*order).alias("o"), "value_gt", "value_sim")
    packed = _by(rows, group).agg(F.sort_array(F.collect_list(F.struct("o", "value_gt", "value_sim"))).alias("s")).select(
        *group, F.transform("s", lambda x: x["value_gt"]).alias("a"), F.transform("s", lambda x: x["value_sim"]).alias("b"))

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_dtw(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b)])

    return packed.select(*group, run("a", "b").alias("value"))


#: Exact in place of the approximation: never larger.
fast_dtw = dtw


def rbo(gt: DataFrame, sim: DataFrame, p: float = 0.95, entity: str | None = None, group=None, least: int = 0) -> DataFrame:
    """Rank-biased overlap of two lists ranked by falling value (ties by entity): the overlap at each depth of the shorter list, weighted by p."""
    group = group or []
    entity = entity or [k for k in keys_of(gt) if k not in group][0]
    order = W.partitionBy(*group).orderBy(F.desc("value"), entity)
    rank = lambda df, n: df.select(*group, entity, F.row_number().over(order).alias(n))
    a, b = rank(gt, "ra"), rank(sim, "rb")
    na, nb = _by(a, group).agg(F.count(F.lit(1)).alias("na")), _by(b, group).agg(F.count(F.lit(1)).alias("nb"))
    n = (na.join(nb, group) if group else na.join(nb)).withColumn("s", F.least("na", "nb")).filter(F.col("na") >= least)
    hits = a.join(b, [*group, entity]).select(*group, F.greatest("ra", "rb").alias("d")).groupBy(*group, "d").agg(F.count(F.lit(1)).alias("k"))
    depth = n.select(*group, "s", F.explode(F.sequence(F.lit(1), F.greatest("s", F.lit(1)).cast("int"))).alias("d")).join(hits, [*group, "d"], "left")
    overlap = F.sum(F.coalesce("k", F.lit(0))).over(W.partitionBy(*group).orderBy("d"))
    terms = depth.withColumn("t", overlap / F.col("d") * F.pow(F.lit(p), F.col("d") - 1) * (1 - p))
    return _by(terms, group).agg(F.sum(F.when(F.col("d") <= F.col("s"), F.col("t")).otherwise(0.0)).alias("value"))


def rbo_mean(gt: DataFrame, sim: DataFrame, group: list[str], p: float = 0.9, least: int = 30) -> DataFrame:
    """Mean overlap of the groups whose ground truth ranks ``least`` items and more."""
    return rbo(gt, sim, p, group=group, least=least).agg(F.avg("value").alias("value"))


def rbo_weight(d: int, p: float) -> float:
    """Weight of the first d ranks."""
    head = sum(p**i / i for i in range(1, d))
    return 1 - p ** (d - 1) + (1 - p) / p * d * (math.log(1 / (1 - p)) - head)


def rmse(gt: DataFrame, sim: DataFrame, how: str = "inner", fill=0, relative: bool = False, group=None) -> DataFrame:
    """Root of the mean squared difference; ``relative`` to the ground truth's interquartile range."""
    rows = join(gt, sim, how, fill, group)
    d = F.col("value_sim") - F.col("value_gt")
    root = F.sqrt(F.avg(d * d))
    if relative:
        g = F.col("value_gt")
        root = root / F.nullif(F.percentile(g, F.lit(0.75)) - F.percentile(g, F.lit(0.25)), F.lit(0.0))
    return _by(rows, group).agg(root.alias("value"))


def r2(gt: DataFrame, sim: DataFrame, how: str = "inner", fill=0, group=None) -> DataFrame:
    """1 - residuals over the ground truth's variation; null for a single row, and where nothing varies 1 if equal, else 0."""
    rows = join(gt.filter(finite(F.col("value").cast("double"))), sim.filter(finite(F.col("value").cast("double"))), how, fill, group)
    g, s = F.col("value_gt"), F.col("value_sim")
    a = _by(rows, group).agg(F.sum((g - s) * (g - s)).alias("res"), (F.var_pop(g) * F.count(g)).alias("tot"), F.count(F.lit(1)).alias("n"))
    v = F.when(F.col("tot") > 0, 1 - F.col("res") / F.nullif("tot", F.lit(0.0))).otherwise(F.when(F.col("res") == 0, 1.0).otherwise(0.0))
    return a.select(*(group or []), F.when(F.col("n") > 1, v).alias("value"))


def pearson(gt: DataFrame, sim: DataFrame, how: str = "inner", fill=0, group=None) -> DataFrame:
    """Null where either side doesn't vary."""
    spread = F.stddev_pop("value_gt") * F.stddev_pop("value_sim")
    return _by(join(gt, sim, how, fill, group), group).agg((F.covar_pop("value_gt", "value_sim") / F.nullif(spread, F.lit(0.0))).alias("value"))


def pearson_test(gt: DataFrame, sim: DataFrame, how: str = "inner", fill=0, group=None) -> DataFrame:
    """``value``, the correlation, and ``p_value``, the chance of one as large in absolute value between independent normal variables; null below three rows."""
    rows = join(gt, sim, how, fill, group)
    spread = F.stddev_pop("value_gt") * F.stddev_pop("value_sim")
    found = _by(rows, group).agg((F.covar_pop("value_gt", "value_sim") / F.nullif(spread, F.lit(0.0))).alias("value"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("double")
    def chance(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_chance(x, int(k)) if x == x and k > 2 else None for x, k in zip(r, n)], dtype="float64")

    return found.select(*(group or []), "value", F.when(F.col("value").isNotNull() & (F.col("n") > 2), chance(F.coalesce("value", F.lit(0.0)), "n")).alias("p_value"))


def correlation_chance(r: float, n: int) -> float:
    """Two-sided: the regularised incomplete beta function of (n - 2) / 2 and 1 / 2 at 1 - r^2, by its continued fraction."""
    x, a, b = min(max(1.0 - r * r, 0.0), 1.0), (n - 2) / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _fraction(1 - x, b, a) / b


def _fraction(x: float, a: float, b: float) -> float:
    """The continued fraction of the incomplete beta function, from a depth at which it has long settled."""
    value = 1.0
    for k in range(200 + 4 * math.isqrt(int(a + b) + 1), 0, -1):
        m = k // 2
        term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if k % 2 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1.0 + term / value
    return 1.0 / value


def ks_test(gt: DataFrame, sim: DataFrame, group=None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic; the windows run over distinct values."""
    group = group or []
    x = lambda df, a, b: df.select(*group, F.col("value").cast("double").alias("x"), F.lit(a).alias("g"), F.lit(b).alias("s"))
    levels = x(gt, 1, 0).unionByName(x(sim, 0, 1)).groupBy(*group, "x").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    whole = W.partitionBy(*group)
    upto = whole.orderBy("x")
    share = lambda c: F.sum(c).over(upto) / F.nullif(F.sum(c).over(whole), F.lit(0))
    return _by(levels.withColumn("d", F.abs(share("g") - share("s"))), group).agg(F.max("d").alias("value"))


def plot_ready(gt: DataFrame, sim: DataFrame) -> DataFrame:
    """Both in one table with the columns ``Ground Truth`` and ``Simulation``."""
    return join(gt, sim, "full_outer", 0).withColumnsRenamed({"value_gt": "Ground Truth", "value_sim": "Simulation"})

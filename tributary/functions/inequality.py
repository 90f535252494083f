"""Gini and Palma coefficients and burstiness.

Counts per node are summed up by value first: the window then runs over
distinct values, of which there are few, and not over nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _levels(values: DataFrame, keys: list[str]) -> DataFrame:
    """One row a distinct value: multiplicity m, rows before c, rows of the group n."""
    by = W.partitionBy(*keys) if keys else W.partitionBy()
    levels = values.filter(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("m"))
    return levels.withColumn("n", F.sum("m").over(by)).withColumn(
        "c", F.coalesce(F.sum("m").over(by.orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def gini(values: DataFrame, keys: list[str] | None = None, method: str = "closed", epsilon: float = 1e-9) -> DataFrame:
    """keys and value: sum of (2i - n - 1) x_i over n times the sum of x, or 1 - 2 * the trapezoid area under the Lorenz curve."""
    keys = keys or []
    levels = _levels(values, keys)
    if method == "trapz":
        # the curve's area over steps of 1/n: all cumulative sums but half of the first and the last, over n * total
        x, m, c, n = (F.col(k).cast("double") for k in ("value", "m", "c", "n"))
        by = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
        rows = levels.withColumn("before", F.coalesce(F.sum(x * m).over(by), F.lit(0.0))).groupBy(*keys).agg(
            F.sum(F.col("before") * m + x * m * (m + 1) / 2).alias("area"), F.sum(x * m).alias("total"), F.min("value").cast("double").alias("least"), F.max(n).alias("n"))
        return rows.select(*keys, (1 - 2 * (F.col("area") - F.col("least") / 2 - F.col("total") / 2) / (F.col("n") * F.col("total"))).alias("value"))
    by = W.partitionBy(*keys) if keys else W.partitionBy()
    low = F.least(F.min("value").over(by), F.lit(0))
    x = F.col("value").cast("double") - low + F.lit(epsilon)
    m, c, n = (F.col(k).cast("double") for k in ("m", "c", "n"))
    rows = levels.withColumn("x", x).groupBy(*keys).agg(
        F.sum(F.col("x") * m * (2 * c + m - n)).alias("top"), F.sum(F.col("x") * m).alias("total"), F.max("n").alias("n"))
    return rows.filter("n is not null").select(*keys, (F.col("top") / (F.col("n") * F.col("total"))).alias("value"))


def palma(values: DataFrame, keys: list[str] | None = None, rank_base: int = 1) -> DataFrame:
    """Sum of the values of rank fraction 0.9 and more over that of 0.4 and less; null where the latter is 0."""
    keys = keys or []
    off = 1 - rank_base
    levels = _levels(values, keys)
    first_top = F.expr(f"(9 * n + 9) div 10 + {off}")
    last_low = F.expr(f"(4 * n) div 10 + {off}")
    top = F.greatest(F.col("c") + F.col("m") - F.greatest("c", first_top - 1), F.lit(0))
    low = F.greatest(F.least(F.col("c") + F.col("m"), last_low) - F.col("c"), F.lit(0))
    sums = levels.groupBy(*keys).agg(F.sum(F.col("value") * top).cast("double").alias("p10"), F.sum(F.col("value") * low).cast("double").alias("p40"))
    return sums.filter("p10 is not null").select(*keys, (F.col("p10") / F.nullif("p40", F.lit(0.0))).alias("value"))


def burstiness(gap: Column, empty: float | None = 0.0) -> Column:
    """(s - m) / (s + m) of gaps, s with one degree of freedom less; ``empty`` where s + m isn't positive."""
    s, m = F.stddev_samp(gap), F.avg(gap)
    return F.coalesce(F.when(s + m > 0, (s - m) / F.nullif(s + m, F.lit(0.0))), F.lit(empty).cast("double"))

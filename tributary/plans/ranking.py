"""Ranks and running sums over groups of any size.

``row_number().over(partitionBy(g))`` sends a group to one task, which a hot
group overruns.  Here a group is cut into buckets that follow the order; a
small table holds each bucket's totals, whose running sums are the buckets'
offsets, and only a bucket's own rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def shuffle_key(seed: str, *cols: Column) -> Column:
    """32 hex digits that order rows pseudo-randomly, the same on every run and engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def hex_fraction(key: Column) -> Column:
    """The first 8 hex digits of a key as an integer in [0, 2^32)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def buckets_for(rows: int, per_bucket: int = 50_000, most: int = 65_536) -> int:
    """So many buckets that each holds about ``per_bucket`` rows of an even group."""
    return max(16, min(most, -(-rows // per_bucket)))


def running(df: DataFrame, group: list[str], bucket: str, order: list, weight: str | None = None,
            rank: str = "__rank", before: str = "__before", size: str = "__size", total: str = "__total") -> DataFrame:
    """Add the 0-based rank in the group, the weights before the row, the group's size and its total weight.

    ``bucket`` has to be non-decreasing in ``order``; ``group`` columns must not be null.
    Adds two exchanges: the rows by (group, bucket), and one row for each (group, bucket).
    """
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(w).alias("__w"))
    part = W.partitionBy(*group) if group else W.partitionBy()
    prior = part.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        F.coalesce(F.sum("__n").over(prior), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__w").over(prior), F.lit(0)).alias("__w0"),
        F.sum("__n").over(part).alias(size),
        F.sum("__w").over(part).alias(total),
    )
    inner = W.partitionBy(*keys).orderBy(*order)
    local = df.withColumn("__rn", F.row_number().over(inner)).withColumn(
        "__cum", F.coalesce(F.sum(w).over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return (
        local.join(offsets, keys)
        .withColumn(rank, F.col("__n0") + F.col("__rn") - 1)
        .withColumn(before, F.col("__w0") + F.col("__cum"))
        .drop("__rn", "__cum", "__n0", "__w0")
    )

"""Measurements of communities.  ``log`` has a column ``community`` (``preprocess.communities``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions.inequality import burstiness
from tributary.functions.scalar import bin_start, epoch
from tributary.operators.preprocess import CONTRIBUTION, of_types


def event_proportion(log: DataFrame, events=None) -> DataFrame:
    counts = of_types(log, events).groupBy("community", "event").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("community", "event", (F.col("n") / F.sum("n").over(W.partitionBy("community"))).alias("value"))


def contributing_users(log: DataFrame, events=None, contribution: list[str] = CONTRIBUTION) -> DataFrame:
    """Share of a community's users that have a contribution event."""
    part = F.count_distinct(F.when(F.col("event").isin(contribution), F.col("user")))
    return of_types(log, events).groupBy("community").agg((part / F.count_distinct("user")).alias("value"))


def user_actions(log: DataFrame, events=None, unit: str = "hour") -> DataFrame:
    """Mean events of the users that are active in a bin."""
    bins = of_types(log, events).groupBy(bin_start(F.col("time"), unit).alias("time"), "community", "user").agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy("community", "time").agg(F.avg("n").alias("value"))


def bursts(log: DataFrame, events=None, empty: float | None = 0.0) -> DataFrame:
    """Burstiness of the seconds between consecutive events of a community.

    Times are whole hours, so a community's gaps follow from its counts by hour: only hours, not events, meet in the window.
    """
    hours = of_types(log, events).groupBy("community", "time").agg(F.count(F.lit(1)).cast("double").alias("n"))
    gap = epoch(F.col("time")) - epoch(F.lag("time").over(W.partitionBy("community").orderBy("time")))
    g = hours.withColumn("gap", F.coalesce(gap, F.lit(0.0)))
    sums = g.groupBy("community").agg((F.sum("n") - 1).alias("k"), F.sum("gap").alias("s1"), F.sum(F.col("gap") * F.col("gap")).alias("s2"))
    m = F.col("s1") / F.nullif("k", F.lit(0.0))
    s = F.sqrt(F.greatest((F.col("s2") - F.col("s1") * m) / F.nullif(F.col("k") - 1, F.lit(0.0)), F.lit(0.0)))
    return sums.select("community", F.coalesce(F.when(s + m > 0, (s - m) / F.nullif(s + m, F.lit(0.0))), F.lit(empty).cast("double")).alias("value"))


def issue_actions(log: DataFrame, event: str = "IssuesEvent", actions=("opened", "closed", "reopened"), unit: str = "day") -> DataFrame:
    """Issue events by bin and action, with 0 for the actions that a bin of the community lacks."""
    seen = log.filter((F.col("event") == event) & F.col("action").isin(list(actions))).groupBy(bin_start(F.col("time"), unit).alias("time"), "community")
    wide = seen.agg(*[F.count(F.when(F.col("action") == a, 1)).alias(a) for a in actions])
    return wide.unpivot(["time", "community"], list(actions), "action", "value")


def account_age(log: DataFrame, created: DataFrame, events=None) -> DataFrame:
    """Whole days of each event since the account (user, created_at) was made."""
    rows = of_types(log, events).join(created.select("user", "created_at"), "user")
    return rows.select("community", "seq", F.floor((epoch(F.col("time")) - epoch(F.col("created_at"))) / 86400).cast("bigint").alias("value"))


def geo_location(log: DataFrame, places: DataFrame, events=None, least: float = 0.007, counts: bool = False) -> DataFrame:
    """Shares (or counts) of countries (user, country) in a community; those below ``least`` are ``other``."""
    rows = of_types(log, events).join(places.select("user", "country"), "user").groupBy("community", "country").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("community")))
    if counts:  # the older rule: below the threshold of all events
        rows = rows.join(F.broadcast(rows.agg(F.sum("n").alias("all"))))
        return rows.groupBy("community", F.when(F.col("n") < least * F.col("all"), "other").otherwise(F.col("country")).alias("country")).agg(F.sum("n").alias("value"))
    return rows.groupBy("community", F.when(F.col("share") < least, "other").otherwise(F.col("country")).alias("country")).agg(F.sum("share").alias("value"))


def user_bursts(log: DataFrame, events=None, least: int = 5, empty: float | None = None) -> DataFrame:
    """Burstiness of each user with ``least`` events in the community; the first gap counts as 0."""
    own = W.partitionBy("community", "user")
    rows = of_types(log, events).withColumn("n", F.count(F.lit(1)).over(own)).filter(F.col("n") >= least)
    gap = F.coalesce(epoch(F.col("time")) - epoch(F.lag("time").over(own.orderBy("ts", "seq"))), F.lit(0.0))
    return rows.withColumn("gap", gap).groupBy("community", "user").agg(burstiness(F.col("gap"), empty).alias("value")).filter("value is not null")

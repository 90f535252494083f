"""Measurements of users.  ``log`` is canonical; ``events`` limits the event types; results have the user and ``value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions.scalar import bin_start, epoch, whole_units
from tributary.operators.preprocess import CREATION, of_types


def unique_content(log: DataFrame, events=None, field: str = "root") -> DataFrame:
    return of_types(log, events).groupBy("user").agg(F.count_distinct(field).alias("value"))


def spine(bins: DataFrame, keys: list[str], unit: str = "day", shared: bool = False) -> DataFrame:
    """A row for each key and bin from the key's first to last bin, or from the first to the last of all."""
    ends = bins.groupBy(*keys).agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    if shared:
        both = bins.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
        ends = ends.select(*keys).join(F.broadcast(both))
    return ends.select(*keys, F.explode(F.expr(f"sequence(lo, hi, interval 1 {unit})")).alias("time"))


def activity_timeline(log: DataFrame, events=None, time_bin: str = "day", cumulative: bool = False) -> DataFrame:
    """Events of each user by bin, on a daily range between the user's ends; gaps are 0, in cumulative series too."""
    counts = of_types(log, events).groupBy("user", bin_start(F.col("time"), time_bin).alias("time")).agg(F.count(F.lit(1)).alias("value"))
    if cumulative:
        counts = counts.withColumn("value", F.sum("value").over(W.partitionBy("user").orderBy("time")))
    return spine(counts, ["user"]).join(counts, ["user", "time"], "left").select("user", "time", F.coalesce("value", F.lit(0)).alias("value"))


def activity_shared_range(log: DataFrame, events=None) -> DataFrame:
    """Cumulative counts of each user on the days between the log's first and last; the value carries over gaps."""
    counts = of_types(log, events).groupBy("user", bin_start(F.col("time"), "day").alias("time")).agg(F.count(F.lit(1)).alias("n"))
    filled = spine(counts, ["user"], shared=True).join(counts, ["user", "time"], "left")
    return filled.select("user", "time", F.coalesce(F.sum("n").over(W.partitionBy("user").orderBy("time")), F.lit(0)).alias("value"))


def owners(log: DataFrame, creation: list[str] = CREATION, field: str = "root") -> DataFrame:
    """The owner of each content: the id's prefix where all ids are two parts of 22 characters, else the user of its first creation event."""
    every = log.agg(F.coalesce(F.bool_and(F.col(field).rlike(r"^.{22}/.{22}")), F.lit(False)).alias("prefixed"))
    first = log.filter(F.col("event").isin(creation)).groupBy(field).agg(F.min_by("user", F.struct("ts", "seq")).alias("first"))
    ids = log.select(field).filter(F.col(field).isNotNull()).distinct()
    return ids.join(first, field, "left").join(F.broadcast(every)).select(
        field, F.when(F.col("prefixed"), F.split(field, "/")[0]).otherwise(F.col("first")).alias("owner"))


def popularity(log: DataFrame, events=None, k: int = 5000, creation: list[str] = CREATION, field: str = "root", exclude=None) -> DataFrame:
    """Events on the content that a user owns; the k users with most."""
    counted = of_types(log, events)
    if exclude is not None:
        counted = counted.filter(~F.col("event").isin(exclude))
    counts = counted.groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(owners(log, creation, field), field).filter(F.col("owner").isNotNull())
    return named.groupBy(F.col("owner").alias("user")).agg(F.sum("n").alias("value")).orderBy(F.desc("value"), "user").limit(k)


def mean_gap(log: DataFrame, events=None, key: str = "user", unit: float = 1.0) -> DataFrame:
    """Mean time between consecutive events: (last - first) / (n - 1); null for one event."""
    at = epoch(F.col("time"))
    return of_types(log, events).groupBy(key).agg(((F.max(at) - F.min(at)) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0)) / unit).alias("value"))


def diffusion_delay(log: DataFrame, events=None, unit: str = "h", created: DataFrame | None = None) -> DataFrame:
    """Whole units of each event since the account's creation (user, created_at), or since the user's first event."""
    rows = of_types(log, events)
    if created is None:
        rows = rows.join(rows.groupBy("user").agg(F.min("time").alias("created_at")), "user")
    else:
        rows = rows.join(created.select("user", "created_at"), "user")
    return rows.select("user", "seq", whole_units(F.col("time"), F.col("created_at"), unit).alias("value"))


def activity_distribution(log: DataFrame, events=None) -> DataFrame:
    return of_types(log, events).groupBy("user").agg(F.count(F.lit(1)).alias("value"))


def most_active(log: DataFrame, events=None, k: int = 5000) -> DataFrame:
    return activity_distribution(log, events).orderBy(F.desc("value"), "user").limit(k)


def acceptance(log: DataFrame, events=("PullRequestEvent",), least: int = 2, per_user: bool = True, field: str = "root") -> DataFrame:
    """Share of closed requests that were merged, of pairs (or contents) with ``least`` of them; for users the mean over contents."""
    closed = of_types(log, list(events)).filter((F.col("action") == "closed") & F.col("merged").isNotNull())
    keys = ["user", field] if per_user else [field]
    share = closed.groupBy(*keys).agg(F.avg(F.col("merged").cast("double")).alias("value"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return share.groupBy("user").agg(F.avg("value").alias("value")) if per_user else share.select(field, "value")

"""Measurements of content.  ``field`` names the content column; results are keyed by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions.inequality import gini, palma
from tributary.functions.scalar import bin_start, epoch, log_bin, whole_units
from tributary.operators.preprocess import of_types


def diffusion_delay(log: DataFrame, events=None, unit: str = "m", created: DataFrame | None = None, field: str = "root", drop: str = "global") -> DataFrame:
    """Whole units of each event since the content was made (field, created_at), or since its first event; then the first row goes, of all (``global``) or ``per_content``.

    Of rows with equal (ts, seq) one goes."""
    rows = of_types(log, events)
    if created is not None:
        rows = rows.join(created.select(field, "created_at"), field)
        return rows.select(field, "seq", whole_units(F.col("time"), F.col("created_at"), unit).alias("value"))
    own = W.partitionBy(field)
    rows = rows.join(rows.groupBy(field).agg(F.min("time").alias("created_at")), field)
    if drop == "global":
        first = of_types(log, events).agg(F.min(F.struct("ts", "seq")).alias("first"))
        marked = rows.join(F.broadcast(first))
        is_first = F.struct("ts", "seq") == F.col("first")
        tied = marked.filter(is_first).withColumn("rn", F.row_number().over(W.orderBy(field, "time"))).filter("rn > 1").drop("rn")
        rows = marked.filter(~is_first).unionByName(tied)
    else:
        rows = rows.withColumn("rn", F.row_number().over(own.orderBy("ts", "seq"))).filter("rn > 1")
    return rows.select(field, "seq", whole_units(F.col("time"), F.col("created_at"), unit).alias("value"))


def growth(log: DataFrame, events=None, time_bin: str = "day", cumulative: bool = False, field: str = "root") -> DataFrame:
    """Events of each content by non-empty bin; cumulative within the content."""
    counts = of_types(log, events).groupBy(field, bin_start(F.col("time"), time_bin).alias("time")).agg(F.count(F.lit(1)).alias("value"))
    return counts.withColumn("value", F.sum("value").over(W.partitionBy(field).orderBy("time"))) if cumulative else counts


def contributors(log: DataFrame, events=None, time_bin: str = "hour", new_users: bool = False, cumulative: bool = False, field: str = "root") -> DataFrame:
    """Distinct users of each content by bin; ``new_users`` counts a user's first event of all only; cumulative sums the bins' counts."""
    rows = of_types(log, events)
    if new_users:
        rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("user").orderBy("ts", "seq"))).filter("rn = 1")
    counts = rows.groupBy(field, bin_start(F.col("time"), time_bin).alias("time")).agg(F.count_distinct("user").alias("value"))
    return counts.withColumn("value", F.sum("value").over(W.partitionBy(field).orderBy("time"))) if cumulative else counts


def event_distribution(log: DataFrame, by: str = "day", field: str = "root") -> DataFrame:
    """Events of each content and type by day, weekday name or month."""
    label = {"day": "yyyy-MM-dd", "weekday": "EEEE", "month": "yyyy-MM"}[by]
    return log.groupBy(field, "event", F.date_format("time", label).alias("date")).agg(F.count(F.lit(1)).alias("value"))


def counts_by(log: DataFrame, node: str, events=None, keys: list[str] | None = None) -> DataFrame:
    return of_types(log, events).filter(F.col(node).isNotNull()).groupBy(*(keys or []), node).agg(F.count(F.lit(1)).alias("value"))


def gini_of(log: DataFrame, node: str = "user", events=None, keys: list[str] | None = None, **options) -> DataFrame:
    return gini(counts_by(log, node, events, keys), keys, **options)


def palma_of(log: DataFrame, node: str = "user", events=None, keys: list[str] | None = None, **options) -> DataFrame:
    return palma(counts_by(log, node, events, keys), keys, **options)


def top(log: DataFrame, events=None, k: int = 100, field: str = "root") -> DataFrame:
    return counts_by(log, field, events).orderBy(F.desc("value"), field).limit(k)


def events_by_content(log: DataFrame, events=("WatchEvent",), field: str = "root") -> DataFrame:
    return counts_by(log, field, list(events))


def _running(log: DataFrame, events, field: str, previous: DataFrame | None, same_time_mean: bool = False) -> DataFrame:
    """Each event's number among those of its user on its content, added to the previous count."""
    own = W.partitionBy(field, "user").orderBy("ts", "seq")
    rows = of_types(log, events).withColumn("rn", F.row_number().over(own)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(field, "user")))
    rows = rows.withColumn("value", F.avg("rn").over(W.partitionBy(field, "user", "time")) if same_time_mean else F.col("rn").cast("double"))
    if previous is not None:
        rows = rows.join(previous.select(field, "user", F.col("value").alias("__before")), [field, "user"], "left")
        rows = rows.withColumn("value", F.col("value") + F.coalesce("__before", F.lit(0))).drop("__before")
    return rows


def event_type_ratio(log: DataFrame, event1: str, event2: str, events=None, previous: DataFrame | None = None, field: str = "root",
                     lead_scope: str = "group", same_time_mean: bool = False) -> DataFrame:
    """By content and bin of the running count: how often event1 comes next, over event2, among events of both types.

    ``lead_scope``: the next event of the same user on the content (``group``), or of the whole table in order of content, user and time (``global``).
    """
    rows = _running(log, events, field, previous, same_time_mean).filter(F.col("event").isin(event1, event2))
    nxt = W.partitionBy(field, "user").orderBy("ts", "seq") if lead_scope == "group" else W.orderBy(field, "user", "ts", "seq")
    rows = rows.withColumn("next", F.lead("event").over(nxt)).withColumn("num_events_binned", log_bin(F.col("value"), -1, 3, 16)).filter("num_events_binned is not null")
    a, b = (F.count(F.when(F.col("next") == e, 1)).cast("double") for e in (event1, event2))
    return rows.groupBy(field, "num_events_binned").agg(F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0)).alias("value"))


def user_continues(log: DataFrame, events=None, previous: DataFrame | None = None, field: str = "root") -> DataFrame:
    """By content and bin of the running count: share of events that weren't the user's last on the content."""
    rows = _running(log, events, field, previous).withColumn("num_actions", log_bin(F.col("value"), -1, 2.5, 30)).filter("num_actions is not null")
    return rows.groupBy(field, "num_actions").agg(F.avg((F.col("rn") < F.col("n")).cast("double")).alias("value"))


def lifetime(log: DataFrame, field: str = "root", most_days: int | None = None) -> DataFrame:
    """Events of each content and days between its first and last; with ``most_days`` whole days, longer lives left out."""
    at = epoch(F.col("time"))
    rows = log.groupBy(field).agg(F.count(F.lit(1)).alias("depth"), ((F.max(at) - F.min(at)) / 86400).alias("value"))
    return rows if most_days is None else rows.withColumn("value", F.floor("value").cast("double")).filter(F.col("value") <= most_days)

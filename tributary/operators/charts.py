"""Tables from which charts are drawn: both sides of a measurement in one table, and that table in the shape of each chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.metrics import histogram, keys_of

SIDES = ("Ground Truth", "Simulation")
#: Days in the order in which charts show them.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def table(gt: DataFrame | None = None, sim: DataFrame | None = None) -> DataFrame:
    """Keys and a column for each side that is given; a key that one side lacks has no value there."""
    sides = [(n, df) for n, df in zip(SIDES, (gt, sim)) if df is not None]
    if not sides:
        raise ValueError("a chart needs one side at least")
    out = None
    for name, df in sides:
        own = df.withColumn(name, F.col("value").cast("double")).drop("value")
        out = own if out is None else out.join(own, keys_of(sides[0][1]), "full_outer")
    return out


def _sides(t: DataFrame) -> list[str]:
    return [c for c in SIDES if c in t.columns]


def _tall(t: DataFrame) -> DataFrame:
    return t.unpivot([c for c in t.columns if c not in SIDES], _sides(t), "type", "vals")


def hist(t: DataFrame, method: str = "doane") -> DataFrame:
    """(bin, low, high, type, vals): how many values of a side fall into each of the bins that both share."""
    own = lambda c: t.select(F.col(c).alias("value")).filter("value is not null") if c in t.columns else t.sparkSession.createDataFrame([], "value double")
    gt, sim = own(SIDES[0]), own(SIDES[1])
    edges = gt.unionByName(sim).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    rows = histogram(gt, sim, method).join(F.broadcast(edges)).select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.col("gt").alias(SIDES[0]), F.col("sim").alias(SIDES[1]))
    return rows.unpivot(["bin", "low", "high"], _sides(t), "type", "vals")


def scatter(t: DataFrame) -> DataFrame:
    """The points that have both values; both sides are needed."""
    if len(_sides(t)) < 2:
        raise ValueError("a scatter chart needs both sides")
    return t.dropna(subset=list(SIDES))


def bar(t: DataFrame) -> DataFrame:
    """(keys, type, vals), 0 where a side lacks a key."""
    return _tall(t.fillna(0.0, _sides(t)))


def time_series(t: DataFrame) -> DataFrame:
    """(keys, type, vals), without the times that a side lacks."""
    return _tall(t).filter("vals is not null")


def multi_time_series(t: DataFrame) -> DataFrame:
    """(keys, type, vals) with 0 where a side lacks a key, and the number of the day where days are named by ``weekday``."""
    rows = bar(t)
    if "weekday" in rows.columns and not {"time", "date"} & set(rows.columns):
        number = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.col("weekday"))
        rows = rows.withColumn("weekday_int", F.when(number > 0, number).cast("int"))
    return rows


CHARTS = {"bar": bar, "hist": hist, "time_series": time_series, "scatter": scatter, "multi_time_series": multi_time_series}


def chart(kind: str, gt: DataFrame | None = None, sim: DataFrame | None = None) -> DataFrame:
    return CHARTS[kind](table(gt, sim))

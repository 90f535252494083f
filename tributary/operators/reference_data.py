"""Reference predictions from past activity, and tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.plans.ranking import running
from tributary.plans.scratch import Scratch

#: Metrics that are better when larger.
RISING = ("r2", "rbo", "pearson")


def shifted(log: DataFrame, start: str, end: str, to: str, until: str, time: str = "ts") -> DataFrame:
    """Events in the closed range moved so that ``start`` falls on ``to``, cut at ``until``; nothing if the past is no longer than the future."""
    day = lambda x: F.lit(x).cast("timestamp")
    past, future = F.unix_seconds(day(end)) - F.unix_seconds(day(start)), F.unix_seconds(day(until)) - F.unix_seconds(day(to))
    rows = log.filter((F.col(time) >= day(start)) & (F.col(time) <= day(end)) & (past > future))
    moved = rows.withColumn(time, F.timestamp_micros(F.unix_micros(F.col(time)) + F.unix_micros(day(to)) - F.unix_micros(day(start))))
    return moved.filter((F.col(time) >= day(to)) & (F.col(time) <= day(until)))


def gaps(log: DataFrame, time: str = "ts", order: str = "seq", parts: int = 256) -> DataFrame:
    """Microseconds between neighbours of the whole log, one row fewer than it has.

    Rows go by ranges of time with equal numbers of rows; a range's first row looks at the last time of the ranges before.
    """
    at = log.select(F.unix_micros(time).alias("__at"), F.col(order).alias("__order")).filter("__at is not null")
    edges = at.agg(F.approx_percentile("__at", [k / parts for k in range(1, parts)])).first()[0] or []
    edges = sorted(set(edges))
    placed = at.withColumn("__part", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("__at"))) if edges else F.lit(0))
    last = placed.groupBy("__part").agg(F.max("__at").alias("__last"))
    last = last.select("__part", F.max("__last").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    own = F.lag("__at").over(W.partitionBy("__part").orderBy("__at", "__order"))
    return placed.withColumn("__own", own).join(F.broadcast(last), "__part").select(
        (F.col("__at") - F.coalesce("__own", "__before")).alias("gap")).filter("gap is not null")


def _index(seed: int, name: str) -> Column:
    """A whole number below 2^60 for each id, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col("seq").cast("string"))), 1, 15), 16, 10).cast("bigint")


def _drawn(draws: DataFrame, pool: DataFrame, name: str, seed: int, alike: bool, cells: int = 4096) -> DataFrame:
    """``draws`` (seq) with ``name``, drawn with replacement from the rows of ``pool`` (or each of its values alike).

    Equal values are one interval of the numbers to draw from, and intervals meet draws by cells, so that a frequent value is spread.
    """
    count = F.lit(1).cast("bigint") if alike else F.count(F.lit(1))
    values = pool.select(name).groupBy(name).agg(count.alias("__c")).withColumn("__k", F.md5(F.coalesce(F.col(name).cast("string"), F.lit(""))))
    values = values.withColumn("__b", F.conv(F.substring("__k", 1, 2), 16, 10).cast("int"))
    laid = running(values, [], "__b", ["__k"], weight="__c", before="__lo", total="__all")
    all_ = laid.agg(F.max("__all")).first()[0]
    if not all_:
        return draws.withColumn(name, F.lit(None).cast(pool.schema[name].dataType))
    width = max(1, all_ // cells)
    arcs = laid.select(name, "__lo", (F.col("__lo") + F.col("__c")).alias("__hi"), F.explode(F.expr(f"sequence(__lo div {width}, (__lo + __c - 1) div {width})")).alias("__cell"))
    drawn = draws.withColumn("__at", F.pmod(_index(seed, name), F.lit(all_))).withColumn("__cell", F.expr(f"__at div {width}"))
    return drawn.join(arcs, "__cell").filter("__at >= __lo and __at < __hi").drop("__at", "__cell", "__lo", "__hi")


def sampled(log: DataFrame, to: str, until: str, seed: int = 7, proportional: bool = True, attributes: dict[str, list[str]] | None = None) -> DataFrame:
    """A bootstrap of the log that fills the time from ``to`` up to before ``until``: seq, ts, user, content, event.

    Gaps between neighbours of the whole log are drawn with replacement and summed to times, as many as the period takes; user,
    content and event are drawn each on its own from the past.  Without ``proportional`` each value is as likely as any other,
    and gaps are whole seconds, even between the smallest gap and one second.  ``attributes`` names further columns by the event
    that has them; they are drawn from the past rows of that event and null elsewhere.  Draws are by a seeded hash of the
    number of the draw.  A log of less than two events, or without any gap, gives no rows.
    """
    spark = log.sparkSession
    scratch = Scratch(spark, "sampled")
    span = spark.range(1).select((F.unix_micros(F.lit(until).cast("timestamp")) - F.unix_micros(F.lit(to).cast("timestamp"))).alias("s")).first()[0]
    pool = scratch.save(gaps(log), "gaps")
    n, total, least = pool.select(F.count(F.lit(1)), F.sum("gap"), F.min("gap")).first()
    names = [c for cols in (attributes or {}).values() for c in cols]
    kinds = {c: log.schema[c].dataType.simpleString() for c in ("user", "content", "event", *names)}
    if not total or span <= 0:
        return spark.createDataFrame([], "seq bigint, ts timestamp, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))
    draws = max(1, int(span * n / total))
    while True:
        ids = spark.range(draws).select(F.col("id").alias("seq"))
        if proportional:
            made = _drawn(ids, pool, "gap", seed, False)
        else:
            share = (_index(seed, "gap") / F.lit(float(1 << 60)))
            made = ids.withColumn("gap", F.round(F.lit(least / 1e6) + share * F.lit(1.0 - least / 1e6)).cast("bigint") * 1_000_000)
        made = scratch.save(made, f"drawn{draws}")
        if made.agg(F.sum("gap")).first()[0] >= span:
            break
        draws = int(draws * 1.5) + 1
    slices = max(1, draws // 50_000)
    timed = running(made.withColumn("__slice", F.expr(f"cast(seq div {-(-draws // slices)} as int)")), [], "__slice", ["seq"], weight="gap", before="__before")
    out = timed.withColumn("__at", F.col("__before") + F.col("gap")).filter(F.col("__at") < span).select(
        "seq", F.timestamp_micros(F.unix_micros(F.lit(to).cast("timestamp")) + F.col("__at")).alias("ts"))
    for c in ("user", "content", "event"):
        out = _drawn(out, log, c, seed, not proportional)
    out = scratch.save(out, "events")
    for event, columns in (attributes or {}).items():
        own, rest = out.filter(F.col("event") == event), out.filter(~F.col("event").eqNullSafe(F.lit(event)))
        for c in columns:
            own = _drawn(own, log.filter(F.col("event") == event), c, seed, not proportional) if c not in own.columns else _drawn(own.drop(c), log.filter(F.col("event") == event), c, seed, not proportional)
        out = own.unionByName(rest, allowMissingColumns=True)
    return out.select("seq", "ts", *kinds)


def tall(results: DataFrame, keys: list[str]) -> DataFrame:
    """One column a metric to (keys, metric, value), mean over rows with equal keys."""
    metrics = [c for c in results.columns if c not in keys]
    return results.unpivot(keys, metrics, "metric", "value").filter("value is not null").groupBy(*keys, "metric").agg(F.avg("value").alias("value"))


def mean_over_nodes(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.avg("value").alias("value"))


def relative_performance(scores: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """direction * (value - reference) / |reference|, the direction being 1 where larger is better; infinite and missing results go."""
    both = scores.join(reference.withColumnRenamed("value", "ref"), keys)
    up = F.when(F.col("metric").isin(*RISING), 1.0).otherwise(-1.0)
    return both.withColumn("value", up * (F.col("value") - F.col("ref")) / F.nullif(F.abs("ref"), F.lit(0.0))).filter("value is not null").drop("ref")

"""Raw logs to the canonical log: event, user, content, parent, root, ts, time and optional columns.

``ts`` is the true time and orders events, ``time`` is floored to the hour and
is what measurements see.  ``seq`` breaks ties of ``ts``: a hash of the whole row,
so that only equal rows tie, which measurements can't tell apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.scalar import coerce_time

#: Event types and column names of the platforms.
CONTRIBUTION = ["PullRequestEvent", "PushEvent", "IssuesEvent", "IssueCommentEvent", "PullRequestReviewCommentEvent",
                "CommitCommentEvent", "CreateEvent", "post", "tweet"]
POPULARITY = ["WatchEvent", "ForkEvent", "comment", "post", "retweet", "quote", "reply"]
CREATION = ["CreateEvent", "post", "tweet"]
COMMON = {"nodeID": "content", "nodeUserID": "user", "actionType": "event", "nodeTime": "ts"}
PLATFORMS = {
    "github": {**COMMON, "actionSubType": "action", "status": "merged"},
    "reddit": {**COMMON, "parentID": "parent", "rootID": "root", "communityID": "subreddit", "keywords": "keywords"},
    "twitter": {**COMMON, "parentID": "parent", "rootID": "root"},
}


def canonical(raw: DataFrame, platform: str, events: list[str] | None = None) -> DataFrame:
    """Rename, keep the platform's columns, drop other event types, coerce the time and floor it to the hour."""
    names = {a: b for a, b in PLATFORMS[platform].items() if a in raw.columns}
    log = raw.select(*[F.nullif(F.col(a), F.lit("")).alias(b) if raw.schema[a].dataType.simpleString() == "string" else F.col(a).alias(b) for a, b in names.items()])
    log = log.filter(F.col("event").isin(events or sorted({*CONTRIBUTION, *POPULARITY})))
    log = log.withColumn("ts", coerce_time(F.col("ts"), dict(log.dtypes)["ts"]))
    if "merged" in log.columns:
        log = log.withColumn("merged", truth(F.col("merged")))
    if "root" not in log.columns:
        log = log.withColumn("root", F.col("content"))
    return log.withColumn("time", F.date_trunc("hour", "ts")).withColumn("seq", F.xxhash64(*log.columns))


def truth(c: Column) -> Column:
    """Booleans and their texts alike."""
    return F.when(F.lower(c.cast("string")) == "true", True).when(F.lower(c.cast("string")) == "false", False)


def of_types(log: DataFrame, events: list[str] | None) -> DataFrame:
    return log if events is None else log.filter(F.col("event").isin(events))


def selected(log: DataFrame, ids: DataFrame | list | None, field: str) -> DataFrame:
    """Rows whose ``field`` is selected: a short list, a table of one column, or None and ["all"] for all."""
    if ids is None or ids == ["all"]:
        return log
    if isinstance(ids, list):
        return log.filter(F.col(field).isin(ids))
    return log.join(ids.toDF(field), field, "left_semi")


def scope(log: DataFrame, users: bool | list | DataFrame = False, chosen: DataFrame | list | None = None, events: list[str] | None = None) -> DataFrame:
    """True: the chosen users; False: all; a list or a table: these users."""
    ids = chosen if users is True else None if users is False else users
    return selected(of_types(log, events), ids, "user")


def communities(log: DataFrame, members: DataFrame | None = None, column: str | None = None) -> DataFrame:
    """``log`` with a column ``community``: the log's own, or a copy of a row for every community (ctype, community, id) of its content or user; ``all`` without members."""
    if column and column in log.columns:
        return log.withColumn("community", F.col(column)).filter(F.col("community").isNotNull())
    if members is None:
        return log.withColumn("community", F.lit("all"))
    by_user = F.col("ctype").isin("city", "country", "company", "locations")
    one = log.join(members.filter(~by_user).select(F.col("id").alias("content"), "community"), "content")
    two = log.join(members.filter(by_user).select(F.col("id").alias("user"), "community"), "user")
    return one.unionByName(two)


def or_default(result: DataFrame, **default) -> DataFrame:
    """``result``, or one row of defaults where it has none; decided inside the plan."""
    schema = result.schema
    row = result.sparkSession.range(1).select(*[F.lit(default.get(f.name)).cast(f.dataType).alias(f.name) for f in schema])
    marked = result.withColumn("__has", F.lit(1))
    return row.join(marked.select("__has").limit(1), how="left").filter("__has is null").drop("__has").unionByName(result)

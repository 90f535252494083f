"""Reconstruction of cascades: parents of retweets from followers, roots of replies from parents.

Rows are (nodeID, nodeUserID, actionType, nodeTime, parentID, rootID[, partialParentID]); "?" is unknown.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.plans.scratch import Scratch


def eligible(rows: DataFrame, followers: DataFrame, cascade: str) -> DataFrame:
    """(cascade, node, later): rows of the cascade strictly later whose user follows the node's user (user, follower) or is the same."""
    a = rows.select(cascade, F.col("nodeID").alias("node"), F.col("nodeUserID").alias("user"), F.col("nodeTime").alias("t"))
    b = rows.select(cascade, F.col("nodeID").alias("later"), F.col("nodeUserID").alias("follower"), F.col("nodeTime").alias("t2"))
    users = a.select("user").distinct()
    edges = followers.select("user", "follower").join(users, "user", "left_semi").unionByName(users.select("user", F.col("user").alias("follower"))).distinct()
    return a.join(edges, "user").join(b, [cascade, "follower"]).filter("t2 > t").select(cascade, "node", "later")


def _latest(f: pd.DataFrame) -> pd.DataFrame:
    """Parents in one cascade.  Rounds from the root let later rounds overwrite: a row's parent is, of the eligible rows that lie on a longest way from the root, the last in time."""
    f = f.sort_values(["t", "node"]).reset_index(drop=True)
    place = {n: i for i, n in enumerate(f["node"])}
    level, parent = np.full(len(f), -1), [None] * len(f)
    for i, (root, before) in enumerate(zip(f["is_root"], f["before"])):
        if root:
            level[i] = 0
        own = sorted(place[n] for n in before if n in place)
        if own and level[own].max() >= 0:
            top = level[own].max()
            parent[i] = f["node"][max(j for j in own if level[j] == top)]
            level[i] = max(level[i], top + 1)
    return pd.DataFrame({"node": f["node"], "parent": parent})


def retweet_parents(rows: DataFrame, followers: DataFrame, cascade: str = "rootID") -> DataFrame:
    """(nodeID, parent) for the rows of each cascade, null where none is found; the root row has to be among them.  Cascades are independent groups."""
    ok = eligible(rows, followers, cascade).groupBy(cascade, "later").agg(F.collect_list("node").alias("before"))
    wide = rows.select(cascade, F.col("nodeID").alias("node"), F.col("nodeTime").cast("string").alias("t"), (F.col("nodeID") == F.col(cascade)).alias("is_root")).join(
        ok.withColumnRenamed("later", "node"), [cascade, "node"], "left").withColumn("before", F.coalesce("before", F.array().cast("array<string>")))
    found = wide.groupBy(cascade).applyInPandas(lambda f: _latest(f[["node", "t", "is_root", "before"]]), "node string, parent string")
    return found.withColumnRenamed("node", "nodeID")


def top_ancestors(rows: DataFrame, rounds: int = 64) -> DataFrame:
    """(nodeID, top): the last ancestor that parents lead to, by pointer doubling; a parent that is no row is an ancestor too."""
    scratch = Scratch(rows.sparkSession, "roots")
    jump = scratch.save(rows.select(F.col("nodeID").alias("node"), F.col("parentID").alias("up")).dropDuplicates(["node"]), "up0")
    for r in range(1, rounds):
        over = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        new = scratch.save(jump.join(over, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), (F.coalesce("up2", "up") != F.col("up")).alias("moved")), f"up{r}")
        jump = new.select("node", "up")
        if new.filter("moved").isEmpty():
            break
    return jump.select(F.col("node").alias("nodeID"), F.col("up").alias("top"))


def reply_roots(rows: DataFrame, which: str = "unknown") -> DataFrame:
    """``rows`` with the root found by following parents, where the root is "?" (``unknown``) or the row is a reply (``replies``)."""
    update = F.col("rootID") == "?" if which == "unknown" else F.col("actionType") == "reply"
    return rows.join(top_ancestors(rows), "nodeID", "left").withColumn("rootID", F.when(update, F.col("top")).otherwise(F.col("rootID"))).select(*rows.columns)


def reconstruct(rows: DataFrame, followers: DataFrame | None = None) -> DataFrame:
    """Parents of retweets and quotes by their partial parents' cascades, then roots of all rows that lack one.

    Without followers only retweets by the same user link; what isn't reached falls back to the partial parent.
    """
    spark = rows.sparkSession
    followers = spark.createDataFrame([], "user string, follower string") if followers is None else followers
    part = rows.filter(F.col("actionType") != "reply").select("nodeID", "nodeUserID", "actionType", "nodeTime", "partialParentID").filter("partialParentID is not null")
    heads = part.select(F.col("partialParentID").alias("nodeID")).distinct().join(rows.select("nodeID", "nodeUserID", "actionType", "nodeTime"), "nodeID")
    lone = heads.withColumn("partialParentID", F.col("nodeID")).join(part.select("nodeID", "partialParentID"), ["nodeID", "partialParentID"], "left_anti")
    found = retweet_parents(part.unionByName(lone.select(*part.columns)), followers, "partialParentID").filter("parent is not null").dropDuplicates(["nodeID"])
    moved = ~F.col("actionType").isin("reply", "tweet")
    wide = rows.join(found, "nodeID", "left").withColumn("parentID", F.when(moved, F.coalesce("parent", "partialParentID")).otherwise(F.col("parentID")))
    return reply_roots(wide.select(*rows.columns))


def reconstruct_by_root(rows: DataFrame, followers: DataFrame) -> DataFrame:
    """The older variant: cascades by root, of roots that are rows; parents for retweets and quotes, unreached ones dropped; roots for replies."""
    moved = F.col("actionType").isin("retweet", "quote")
    roots = rows.filter(~moved).select("nodeID", "nodeUserID", "nodeTime").withColumn("rootID", F.col("nodeID"))
    inside = rows.filter(moved).select("nodeID", "nodeUserID", "nodeTime", "rootID")
    heads = roots.join(inside.select(F.col("rootID").alias("nodeID")).distinct(), "nodeID", "left_semi")
    found = retweet_parents(inside.unionByName(heads.select(*inside.columns)), followers, "rootID").filter("parent is not null")
    named = rows.join(found.dropDuplicates(["nodeID"]), "nodeID", "left").filter(~moved | F.col("parent").isNotNull())
    return reply_roots(named.withColumn("parentID", F.when(moved, F.col("parent")).otherwise(F.col("parentID"))).select(*rows.columns), "replies")

"""Information cascades: rooted trees of (node, parent, root, user, ts, seq), the root's parent being itself.

Depths and sizes of subtrees come from doubling joins, so the rounds grow with
the logarithm of the depth.  Series over time or depth are windows within the
cascade; none of them lists pairs of nodes, or of nodes and their ancestors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions.inequality import gini, palma
from tributary.functions.scalar import bin_start, epoch
from tributary.plans.scratch import Scratch


def present(log: DataFrame) -> DataFrame:
    """Rows of cascades whose root is a row itself."""
    roots = log.filter("node = root").select("root").distinct()
    return log.join(roots, "root", "left_semi")


def _present_table(log: DataFrame) -> DataFrame:
    """``present`` as a table, as what follows reads it several times."""
    return Scratch(log.sparkSession, "present").save(present(log), "log")


def _climbed(log: DataFrame, sizes: bool, rounds: int = 64) -> DataFrame:
    """(root, node, depth[, below]): steps to the root, -1 where the parents don't lead there, and the number of nodes below.

    Pointers double their reach in each round.  A pointer is live until it arrives at a node without a parent among the rows;
    with every round some do, so that pointers which are left once none does run in a circle.  The nodes less than 2^(k+1) steps
    below are those less than 2^k steps below, and those less than 2^k steps below the nodes that are 2^k steps below.
    """
    scratch = Scratch(log.sparkSession, "climbed")
    top = (F.col("node") == F.col("root")) | (F.col("node") == F.col("parent"))
    jump = scratch.save(log.select(
        "root", "node", F.when(top, F.col("node")).otherwise(F.col("parent")).alias("up"), F.when(top, 0).otherwise(1).cast("bigint").alias("hops"),
        (~top).alias("live"), F.lit(1).cast("bigint").alias("s")), "jump0")
    before = None
    for k in range(rounds):
        live, exact = jump.agg(F.count(F.when(F.col("live"), 1)), F.count(F.when(F.col("hops") == 1 << k, 1))).first()
        last = live == 0 or live == before
        before = live
        if last and not (sizes and exact):
            break
        new = jump
        if not last:
            over = jump.select("root", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("live").alias("live2"))
            moving = jump.filter("live").join(over, ["root", "up"], "left").select(
                "root", "node", F.coalesce("up2", "up").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.coalesce("live2", F.lit(False)).alias("live"), "s")
            new = moving.unionByName(jump.filter("not live"))
        if sizes:
            more = jump.filter(F.col("hops") == 1 << k).groupBy("root", F.col("up").alias("node")).agg(F.sum("s").alias("more"))
            new = new.join(more, ["root", "node"], "left").withColumn("s", F.col("s") + F.coalesce("more", F.lit(0))).drop("more")
        jump = scratch.save(new, f"jump{k + 1}")
        scratch.drop(f"jump{k}")
        if last:
            break
    there = (F.col("up") == F.col("root")) & ~F.col("live")
    return jump.select("root", "node", F.when(there, F.col("hops")).otherwise(-1).alias("depth"), *([F.when(F.col("live"), 0).otherwise(F.col("s") - 1).alias("below")] if sizes else []))


def depths(log: DataFrame, sizes: bool = False) -> DataFrame:
    """``log`` with ``depth``, the steps to the root (-1 where the parents don't lead there, as in a circle), and with ``sizes``
    the number of nodes ``below`` (0 in a circle)."""
    return log.join(_climbed(log, sizes), ["root", "node"])


def summary(log: DataFrame) -> DataFrame:
    """depth, size, breadth, structural virality, unique users and lifetime in days of each cascade.

    A cascade of its root alone has depth 0, size 1, breadth 0, no virality and lifetime 0.
    Virality: with s nodes below and at an edge's lower end, the sum of all distances is the sum of s (n - s).
    """
    rows = Scratch(log.sparkSession, "summary").save(depths(_present_table(log), sizes=True), "rows")
    plain = rows.groupBy("root").agg(
        F.max("depth").alias("depth"), F.count_distinct("user").alias("unique_users"), ((F.max(epoch(F.col("ts"))) - F.min(epoch(F.col("ts")))) / 86400).alias("lifetime"),
        F.count(F.when(F.col("node") != F.col("root"), 1)).alias("others"))
    ids = rows.filter("node != root").select("root", F.explode(F.array("node", "parent")).alias("id")).distinct().groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    breadth = rows.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("b")).groupBy("root").agg(F.max("b").alias("breadth"))
    s = (F.col("below") + 1).cast("double")
    sums = rows.filter("node != root").groupBy("root").agg(F.sum(s).alias("s1"), F.sum(s * s).alias("s2"))
    all_ = plain.join(ids, "root", "left").join(breadth, "root").join(sums, "root", "left").withColumn("wiener", F.col("size") * F.col("s1") - F.col("s2"))
    some, n = F.col("others") > 0, F.col("size").cast("double")
    return all_.select(
        "root", F.when(some, F.col("depth")).otherwise(0).cast("bigint").alias("depth"), F.when(some, F.col("size")).otherwise(1).cast("bigint").alias("size"),
        F.when(some, F.col("breadth")).otherwise(0).cast("bigint").alias("breadth"), F.when(some, 2 * F.col("wiener") / (n * (n - 1))).alias("structural_virality"),
        "unique_users", F.when(some, F.col("lifetime")).otherwise(0.0).alias("lifetime"))


def distances_to_earlier(parent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each node of one tree the sum of its distances to all nodes of lower rank; ``parent`` is an index, -1 at the top.

    By centroids: removing one leaves parts of at most half the size, and ways that it lies on are the ways to it, less
    those that stay within one of the parts.  Takes n log n steps whatever the tree's shape is.
    """
    n = len(parent)
    near: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            near[i].append(p)
            near[p].append(i)
    add, gone = np.zeros(n, np.int64), [False] * n
    tops = np.flatnonzero(parent < 0).tolist()
    while tops:
        top = tops.pop()
        order, above = [top], {top: -1}
        for x in order:
            for y in near[x]:
                if not gone[y] and y != above[x]:
                    above[y] = x
                    order.append(y)
        if len(order) == 1:
            gone[top] = True
            continue
        size = dict.fromkeys(order, 1)
        for x in reversed(order[1:]):
            size[above[x]] += size[x]
        centre = top
        while True:
            heavy = next((y for y in near[centre] if not gone[y] and above.get(y) == centre and 2 * size[y] > len(order)), None)
            if heavy is None:
                break
            centre = heavy
        nodes, depth, branch = [centre], [0], [-1]
        from_ = {centre: -1}
        for k in range(len(order)):
            x = nodes[k]
            for y in near[x]:
                if not gone[y] and y != from_[x]:
                    from_[y] = x
                    nodes.append(y)
                    depth.append(depth[k] + 1)
                    branch.append(y if k == 0 else branch[k])
        at, d, part = np.array(nodes), np.array(depth), np.array(branch)
        add[at] += _before(np.zeros(len(at), np.int64), rank[at], d)
        add[at] -= _before(part, rank[at], d)
        gone[centre] = True
        tops += [y for y in near[centre] if not gone[y]]
    return add


def _before(group: np.ndarray, rank: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The sums of d(x) + d(y) over the y of lower rank in the group of x."""
    order = np.lexsort((rank, group))
    g, x = group[order], d[order]
    first = np.concatenate([[True], g[1:] != g[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    sums = np.concatenate([[0], np.cumsum(x)])
    out = np.empty(len(g), np.int64)
    out[order] = (np.arange(len(g)) - start) * x + sums[:-1] - sums[start]
    return out


def _added(f: pd.DataFrame) -> pd.DataFrame:
    """Of one cascade: nodes that don't lead to the root add nothing."""
    f = f[f["depth"] >= 0].drop_duplicates("node").reset_index(drop=True)
    place = pd.Series(f.index, f["node"])
    parent = np.where(f["node"] == f["parent"], -1, place.reindex(f["parent"]).fillna(-1).to_numpy(np.int64))
    parent[(f["node"] == f["root"]).to_numpy()] = -1
    return pd.DataFrame({"root": f["root"], "node": f["node"], "add": distances_to_earlier(parent, f["place"].to_numpy(np.int64))})


def _prefixes(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each row with the measures of its cascade up to it; parents have to come before their children.

    A cascade's tree (ids, parents and places in the order) meets in one task, which takes n log n steps of it.
    """
    own = W.partitionBy("root").orderBy(*order)
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    first = F.row_number().over(W.partitionBy("root", "user").orderBy(*order)) == 1
    r = Scratch(rows.sparkSession, "prefixes").save(rows.withColumn("first", first.cast("bigint")).withColumn(
        "rank", F.row_number().over(W.partitionBy("root", "depth").orderBy(*order))).withColumn("place", F.row_number().over(own)), "rows")
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("root", "node"))
    added = r.select("root", "node", "parent", "depth", "place").groupBy("root").applyInPandas(_added, f"{kind}, add bigint")
    r = r.join(added.select(F.col("root").alias("root"), F.col("node").alias("node"), "add"), ["root", "node"], "left").fillna(0, ["add"])
    r = r.withColumn("size", F.row_number().over(own)).withColumn("wiener", F.sum("add").over(upto).cast("double"))
    alone = F.col("size") == 1
    n = F.col("size").cast("double")
    return r.select(
        "root", *order, F.max("depth").over(upto).alias("level"), F.when(alone, 0).otherwise(F.max("rank").over(upto)).cast("bigint").alias("breadth"), F.col("size").cast("bigint").alias("size"),
        F.when(~alone, 2 * F.col("wiener") / (n * (n - 1))).alias("structural_virality"), F.sum("first").over(upto).alias("unique_nodes"))


def _ratio(rows: DataFrame, by: str) -> DataFrame:
    u = F.col("unique_nodes")
    return rows.withColumn("new_node_ratio", (u - F.coalesce(F.lag("unique_nodes").over(W.partitionBy("root").orderBy(by)), F.lit(1))) / u.cast("double"))


def timeseries(log: DataFrame, unit: str = "day") -> DataFrame:
    """State of each cascade at the end of each non-empty bin: depth, breadth, size, structural virality, unique users, ratio of new ones."""
    rows = _prefixes(depths(_present_table(log)), ["ts", "seq"]).withColumn("timestamp", bin_start(F.col("ts"), unit))
    last = rows.withColumn("rn", F.row_number().over(W.partitionBy("root", "timestamp").orderBy(F.desc("ts"), F.desc("seq")))).filter("rn = 1").drop("rn", "ts", "seq")
    return _ratio(last.withColumnRenamed("level", "depth"), "timestamp")


def by_depth(log: DataFrame) -> DataFrame:
    """State of each cascade down to each depth; depth 0 is all zeros."""
    rows = _prefixes(depths(_present_table(log)).filter("depth >= 0"), ["depth", "ts", "seq"])
    last = rows.withColumn("rn", F.row_number().over(W.partitionBy("root", "depth").orderBy(F.desc("ts"), F.desc("seq")))).filter("rn = 1").drop("rn", "ts", "seq", "level")
    zero = lambda c, kind: F.when(F.col("depth") == 0, F.lit(0).cast(kind)).otherwise(F.col(c)).alias(c)
    got = _ratio(last, "depth")  # the root's own user is the first: the count starts at 1
    return got.select("root", "depth", zero("breadth", "bigint"), zero("size", "bigint"), zero("structural_virality", "double"), zero("unique_nodes", "bigint"), zero("new_node_ratio", "double"))


def participation(log: DataFrame, keys: list[str] | None = None, roots_only: bool = False) -> DataFrame:
    """(keys, user, value): rows, or roots, of each user."""
    rows = log.filter("node = root") if roots_only else log
    return rows.groupBy(*(keys or []), "user").agg(F.count(F.lit(1)).alias("value"))


def participation_gini(log: DataFrame, keys: list[str] | None = None, roots_only: bool = False) -> DataFrame:
    return gini(participation(log, keys, roots_only), keys, epsilon=0.0)


def participation_palma(log: DataFrame, keys: list[str] | None = None, roots_only: bool = False) -> DataFrame:
    """Of a single cascade's users: none for a root alone."""
    found = palma(participation(log, keys, roots_only), keys)
    if keys == ["root"]:
        alone = log.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("root", F.lit(1).alias("alone"))
        return found.join(alone, "root", "left").select("root", F.when(F.col("alone").isNull(), F.col("value")).alias("value"))
    return found


def size_timeseries(log: DataFrame, unit: str = "day", keys: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Mean size of the cascades that start in a bin; ``sizes`` is a summary that is there already."""
    starts = present(log).filter("node = root").select("root", *(keys or []), bin_start(F.col("ts"), unit).alias("timestamp"))
    return starts.join((summary(log) if sizes is None else sizes).select("root", "size"), "root").groupBy(*(keys or []), "timestamp").agg(F.avg("size").alias("value"))


def lifetime_timeseries(log: DataFrame, unit: str = "day", true_lifetime: bool = False) -> DataFrame:
    """Mean rows per root among root rows by bin, 0 in empty bins; or the mean lifetime in days of the cascades that start in a bin."""
    if true_lifetime:
        starts = present(log).filter("node = root").select("root", bin_start(F.col("ts"), unit).alias("timestamp"))
        return starts.join(summary(log).select("root", "lifetime"), "root").groupBy("timestamp").agg(F.avg("lifetime").alias("value"))
    roots = log.filter("node = root").groupBy(bin_start(F.col("ts"), unit).alias("timestamp"), "root").agg(F.count(F.lit(1)).alias("n"))
    means = roots.groupBy("timestamp").agg(F.avg("n").alias("value"))
    step = f"interval 1 {unit}"
    bins = means.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).select(F.explode(F.expr(f"sequence(lo, hi, {step})")).alias("timestamp"))
    return bins.join(means, "timestamp", "left").select("timestamp", F.coalesce("value", F.lit(0.0)).alias("value"))


def community_users(log: DataFrame, unit: str = "day") -> DataFrame:
    """Users of each community up to each bin (empty bins too) and the share that is new in it."""
    rows = log.select("community", "user", bin_start(F.col("ts"), unit).alias("timestamp"))
    fresh = rows.groupBy("community", "user").agg(F.min("timestamp").alias("timestamp")).groupBy("community", "timestamp").agg(F.count(F.lit(1)).alias("n"))
    ends = rows.groupBy("community").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    bins = ends.select("community", F.explode(F.expr(f"sequence(lo, hi, interval 1 {unit})")).alias("timestamp")).join(fresh, ["community", "timestamp"], "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("community").orderBy("timestamp"))
    return bins.withColumn("unique_users", total).select("community", "timestamp", "unique_users", (F.coalesce("n", F.lit(0)) / F.col("unique_users").cast("double")).alias("new_user_ratio"))


def largest_fraction(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Size of the largest cascade over the number of rows."""
    keys = keys or []
    sizes = present(log).filter("node = root").select("root", *keys).join(summary(log).select("root", "size"), "root").groupBy(*keys).agg(F.max("size").alias("size"))
    rows = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = sizes.join(rows, keys) if keys else sizes.join(rows)
    return both.select(*keys, (F.col("size") / F.col("n").cast("double")).alias("value"))


def original_ratio(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(originals + replies) over those and retweets."""
    a = F.count(F.when(F.col("event").isin("tweet", "reply"), 1))
    b = F.count(F.when(F.col("event").isin("tweet", "reply", "retweet"), 1))
    return log.groupBy(*(keys or [])).agg((a / F.nullif(b, F.lit(0))).alias("value"))

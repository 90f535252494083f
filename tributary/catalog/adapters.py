"""The driver's tables as event logs, and the same logs in SQL.

events: user_id acts by event_type on content props.k; signup creates, purchase
contributes, view and click make popular, error is a type that is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTRIBUTION, POPULARITY, CREATION = ["signup", "purchase"], ["view", "click"], ["signup"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(c) -> F.Column:
    return F.round(c, 6)


def text_time(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin(CONTRIBUTION + POPULARITY))
    k = F.get_json_object("props", "$.k")
    turn = F.element_at(F.array(F.lit("opened"), F.lit("closed"), F.lit("reopened")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("event"),
        k.alias("content"), k.alias("root"), F.col("ts").cast("timestamp").alias("ts"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time"),
        F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 2 == 0, "closed").otherwise("opened")).when(F.col("event_type") == "click", turn).alias("action"),
        F.when(F.col("event_type") == "purchase", F.col("event_id") % 3 == 0).alias("merged"),
    )


def community_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).withColumn("community", (F.col("content").cast("bigint") % 5).cast("string"))


def user_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    first = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("timestamp").alias("created_at"))
    return c.join(first, "c_custkey").join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("user"), "created_at", F.col("n_name").alias("country"))


def content_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").cast("string").alias("root")).agg(
        F.min("l_shipdate").cast("timestamp").alias("created_at"), F.min("l_suppkey").cast("string").alias("owner"))


def previous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user on each content before the middle of January."""
    return log(spark, sf_dir).filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp")).groupBy("root", "user").agg(F.count(F.lit(1)).alias("value"))


def later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).filter(F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ground truth (even ids) and simulation (odd ids)."""
    rows = log(spark, sf_dir)
    return rows.filter(F.col("seq") % 2 == 0), rows.filter(F.col("seq") % 2 == 1)


def cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content's events as a tree: the i-th event's parent is the (i div 2)-th, the first is the root."""
    own = W.partitionBy("content").orderBy("ts", "seq")
    rows = log(spark, sf_dir).withColumn("rn", F.row_number().over(own))
    node = lambda i: F.concat_ws("-", "content", i.cast("string"))
    return rows.select(
        node(F.col("rn")).alias("node"), node(F.greatest(F.floor(F.col("rn") / 2), F.lit(1))).alias("parent"), node(F.lit(1)).alias("root"),
        "user", "ts", "seq", F.when(F.col("rn") == 1, "tweet").when(F.col("rn") % 3 == 0, "reply").otherwise("retweet").alias("event"),
        (F.col("content").cast("bigint") % 5).cast("string").alias("community"),
    )


EV = """ev AS (
  SELECT event_id AS seq, user_id::VARCHAR AS u, event_type AS event, json_extract_string(props, '$.k') AS c, ts, date_trunc('hour', ts)::TIMESTAMP AS t,
         (json_extract_string(props, '$.k')::BIGINT % 5)::VARCHAR AS g,
         CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'closed' ELSE 'opened' END
                         WHEN 'click' THEN ['opened', 'closed', 'reopened'][(event_id % 3 + 1)::INTEGER] END AS action,
         CASE WHEN event_type = 'purchase' THEN event_id % 3 = 0 END AS merged
  FROM events WHERE event_type IN ('signup', 'purchase', 'view', 'click'))"""
META = """um AS (
  SELECT c_custkey::VARCHAR AS u, min(o_orderdate)::TIMESTAMP AS created, any_value(n_name) AS country
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY c_custkey),
cm AS (SELECT l_partkey::VARCHAR AS c, min(l_shipdate)::TIMESTAMP AS created, min(l_suppkey)::VARCHAR AS owner FROM lineitem GROUP BY l_partkey)"""
TREE = """tree AS (
  SELECT c || '-' || rn AS node, c || '-' || greatest(rn // 2, 1) AS parent, c || '-1' AS root, u, ts, seq, rn, c, g AS community,
         CASE WHEN rn = 1 THEN 'tweet' WHEN rn % 3 = 0 THEN 'reply' ELSE 'retweet' END AS event
  FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ts, seq) AS rn FROM ev))"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"

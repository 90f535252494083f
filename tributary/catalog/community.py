"""Queries of community measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.catalog.adapters import CONTRIBUTION, EV, META, community_log, log, six, table, text_time, user_metadata, with_
from tributary.operators import community as m
from tributary.operators import content
from tributary.operators.preprocess import communities


def _six(df):
    return df.withColumn("value", six(F.col("value")))


def _members(s, d):
    """Topics by content, countries by user, as one long table."""
    topic = log(s, d).select(F.lit("topic").alias("ctype"), (F.col("content").cast("bigint") % 5).cast("string").alias("community"), F.col("content").alias("id")).distinct()
    return topic.unionByName(user_metadata(s, d).select(F.lit("country").alias("ctype"), F.col("country").alias("community"), F.col("user").alias("id")))


_B = "coalesce(CASE WHEN s + m > 0 THEN (s - m) / (s + m) END, {e})"
_GAPS = """, x AS (SELECT g, u, t, epoch(t) - epoch(lag(t) OVER (PARTITION BY {p} ORDER BY ts, seq)) AS gap, count(*) OVER (PARTITION BY {p}) AS k FROM ev)
"""
_RANKED = """, k AS (SELECT g, {n} AS k, count(*) AS x FROM ev GROUP BY ALL),
r AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS i, count(*) OVER (PARTITION BY g) AS n FROM k)
"""
_COUNTRY = """, n AS (SELECT g, country, count(*) AS k FROM ev JOIN um USING (u) GROUP BY ALL),
w AS (SELECT g, country, k, k / sum(k) OVER (PARTITION BY g) AS share, sum(k) OVER () AS total FROM n)
"""

CATALOG = {
    "community_expand": (lambda s, d: communities(log(s, d), _members(s, d)).groupBy("community", "event").agg(F.count(F.lit(1)).alias("value")), with_(EV, META) + """
        SELECT g AS community, event, count(*) AS value FROM ev GROUP BY ALL
        UNION ALL SELECT country, event, count(*) FROM ev JOIN um USING (u) GROUP BY ALL"""),
    "event_proportion": (lambda s, d: _six(m.event_proportion(community_log(s, d))), with_(EV) + """
        SELECT g AS community, event, round(count(*) / sum(count(*)) OVER (PARTITION BY g), 6)::DOUBLE AS value FROM ev GROUP BY g, event"""),
    "contributing_users": (lambda s, d: _six(m.contributing_users(community_log(s, d), contribution=CONTRIBUTION)), with_(EV) + """
        SELECT g AS community, round(count(DISTINCT u) FILTER (event IN ('signup', 'purchase')) / count(DISTINCT u), 6)::DOUBLE AS value FROM ev GROUP BY g"""),
    "num_user_actions": (lambda s, d: _six(m.user_actions(community_log(s, d))).withColumn("time", text_time(F.col("time"))), with_(EV) + """
        SELECT g AS community, strftime(t, '%Y-%m-%d %H:%M:%S') AS time, round(count(*) / count(DISTINCT u), 6)::DOUBLE AS value FROM ev GROUP BY g, t"""),
    "community_burstiness": (lambda s, d: _six(m.bursts(community_log(s, d))), with_(EV) + _GAPS.format(p="g") +
        "SELECT g AS community, round(" + _B.format(e="0") + ", 6)::DOUBLE AS value FROM (SELECT g, stddev_samp(gap) AS s, avg(gap) AS m FROM x GROUP BY g)"),
    "issue_event_prop": (lambda s, d: m.issue_actions(community_log(s, d), "click").withColumn("time", text_time(F.col("time"))), with_(EV) + """
        , d AS (SELECT DISTINCT g, date_trunc('day', t) AS t FROM ev WHERE event = 'click'),
        n AS (SELECT g, date_trunc('day', t) AS t, action, count(*) AS k FROM ev WHERE event = 'click' GROUP BY ALL)
        SELECT d.g AS community, strftime(d.t, '%Y-%m-%d %H:%M:%S') AS time, a AS action, coalesce(k, 0)::BIGINT AS value
        FROM d CROSS JOIN (SELECT unnest(['opened', 'closed', 'reopened']) AS a) LEFT JOIN n ON n.g = d.g AND n.t = d.t AND n.action = a"""),
    "account_age": (lambda s, d: m.account_age(community_log(s, d), user_metadata(s, d)), with_(EV, META) +
        "SELECT g AS community, seq, floor((epoch(t) - epoch(created)) / 86400)::BIGINT AS value FROM ev JOIN um USING (u)"),
    "geo_location": (lambda s, d: _six(m.geo_location(community_log(s, d), user_metadata(s, d), least=0.03)), with_(EV, META) + _COUNTRY +
        "SELECT g AS community, CASE WHEN share < 0.03 THEN 'other' ELSE country END AS country, round(sum(share), 6)::DOUBLE AS value FROM w GROUP BY 1, 2"),
    "geo_location_counts": (lambda s, d: m.geo_location(community_log(s, d), user_metadata(s, d), counts=True), with_(EV, META) + _COUNTRY +
        "SELECT g AS community, CASE WHEN k < 0.007 * total THEN 'other' ELSE country END AS country, sum(k)::BIGINT AS value FROM w GROUP BY 1, 2"),
    "user_burstiness": (lambda s, d: _six(m.user_bursts(community_log(s, d))), with_(EV) + _GAPS.format(p="g, u") + """
        SELECT g AS community, u AS "user", round((s - m) / (s + m), 6)::DOUBLE AS value
        FROM (SELECT g, u, stddev_samp(coalesce(gap, 0)) AS s, avg(coalesce(gap, 0)) AS m FROM x WHERE k >= 5 GROUP BY g, u) WHERE s + m > 0"""),
    "user_burstiness_ten": (lambda s, d: _six(m.user_bursts(community_log(s, d), least=10, empty=None)), with_(EV) + _GAPS.format(p="g, u") + """
        SELECT g AS community, u AS "user", round((s - m) / (s + m), 6)::DOUBLE AS value
        FROM (SELECT g, u, stddev_samp(coalesce(gap, 0)) AS s, avg(coalesce(gap, 0)) AS m FROM x WHERE k >= 10 GROUP BY g, u) WHERE s + m > 0"""),
    "community_gini": (lambda s, d: _six(content.gini_of(community_log(s, d), "root", keys=["community"])), with_(EV) + _RANKED.format(n="c") +
        "SELECT g AS community, round(sum((2 * i - n - 1) * (x + 1e-9)) / (any_value(n) * sum(x + 1e-9)), 6)::DOUBLE AS value FROM r GROUP BY g"),
    "community_palma": (lambda s, d: _six(content.palma_of(community_log(s, d), "root", keys=["community"])), with_(EV) + _RANKED.format(n="c") +
        "SELECT g AS community, round(sum(x) FILTER (i / n >= 0.9) / nullif(sum(x) FILTER (i / n <= 0.4), 0), 6)::DOUBLE AS value FROM r GROUP BY g"),
    "region_membership": (lambda s, d: table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("community")).agg(F.count(F.lit(1)).alias("value")),
        "SELECT r_name AS community, count(*) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
}

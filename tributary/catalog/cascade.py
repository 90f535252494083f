"""Queries of cascades: the derived trees, and conversations as chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.catalog.adapters import EV, TREE, cascades, six, table, text_time, with_
from tributary.operators import cascade as m


def _six(df):
    df = df.select(*[six(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes])
    return df.withColumn("timestamp", text_time(F.col("timestamp"))) if "timestamp" in df.columns else df


def _chains(s, d):
    """A conversation's turns in a row, each the parent of the next."""
    node = lambda k: F.concat_ws("-", "conv_id", k.cast("string"))
    c = table(s, d, "conversations").filter("turn is not null and conv_id is not null")
    return c.select(node(F.col("turn")).alias("node"), node(F.greatest(F.col("turn") - 1, F.lit(0))).alias("parent"), node(F.lit(0)).alias("root"),
                    F.col("role").alias("user"), F.timestamp_seconds(F.col("turn") * 60).alias("ts"), F.col("turn").alias("seq"))


def _series(kind, column):
    return lambda s, d: _six(getattr(m, kind)(cascades(s, d)).select("root", "timestamp" if kind == "timeseries" else "depth", F.col(column).alias("value")))


_T = with_(EV, TREE) + """, n AS (SELECT root, count(*) AS n, (epoch(max(ts)) - epoch(min(ts))) / 86400 AS life, count(DISTINCT u) AS users, max(length(bin(rn)) - 1) AS depth FROM tree GROUP BY root),
lv AS (SELECT root, max(k) AS breadth FROM (SELECT root, length(bin(rn)) AS l, count(*) AS k FROM tree GROUP BY ALL) GROUP BY root),
up AS (SELECT root, rn, rn >> k AS above FROM tree, range(0, 24) r(k) WHERE rn >> k >= 1),
sub AS (SELECT root, above, count(*) AS s FROM up WHERE above > 1 GROUP BY ALL),
wi AS (SELECT root, sum(s * (n - s)) AS w FROM sub JOIN n USING (root) GROUP BY root),
sm AS (SELECT root, CASE WHEN n > 1 THEN depth ELSE 0 END AS depth, n AS size, CASE WHEN n > 1 THEN breadth ELSE 0 END AS breadth,
         CASE WHEN n > 1 THEN 2 * w / (n * (n - 1)) END AS sv, users, life FROM n JOIN lv USING (root) LEFT JOIN wi USING (root))
"""
# the state after each row, by counting afresh for every prefix
_PRE = _T + """, st AS (
  SELECT a.root, a.rn, date_trunc('day', a.ts) AS t, count(*) AS size, count(DISTINCT b.u) AS uniq, length(bin(a.rn)) - 1 AS depth FROM tree a JOIN tree b ON b.root = a.root AND b.rn <= a.rn GROUP BY ALL),
ends AS (SELECT root, {by} AS k, max(rn) AS rn FROM tree GROUP BY ALL),
pl AS (SELECT root, rn, max(c) AS breadth FROM (SELECT e.root, e.rn, length(bin(b.rn)) AS l, count(*) AS c FROM ends e JOIN tree b ON b.root = e.root AND b.rn <= e.rn GROUP BY ALL) GROUP BY ALL),
ps AS (SELECT e.root, e.rn, up.above, count(*) AS s FROM ends e JOIN up ON up.root = e.root AND up.rn <= e.rn AND up.above > 1 GROUP BY ALL),
pw AS (SELECT root, rn, sum(s * (rn - s)) AS w FROM ps GROUP BY ALL),
f AS (SELECT e.root, e.k, st.size, CASE WHEN size > 1 THEN breadth ELSE 0 END AS breadth, st.depth, uniq, CASE WHEN size > 1 THEN 2 * w / (size * (size - 1)) END AS sv,
        (uniq - coalesce(lag(uniq) OVER (PARTITION BY e.root ORDER BY e.k), 1)) / uniq AS ratio
      FROM ends e JOIN st ON st.root = e.root AND st.rn = e.rn JOIN pl ON pl.root = e.root AND pl.rn = e.rn LEFT JOIN pw ON pw.root = e.root AND pw.rn = e.rn)
"""
_TS = _PRE.format(by="date_trunc('day', ts)") + "SELECT root, strftime(k, '%Y-%m-%d %H:%M:%S') AS timestamp, {x} AS value FROM f"
_BD = _PRE.format(by="length(bin(rn)) - 1") + "SELECT root, k AS depth, CASE WHEN k = 0 THEN 0 ELSE {x} END AS value FROM f"
_RANK = """, k AS (SELECT {g} u, count(*) AS x FROM tree {where} GROUP BY ALL),
r AS (SELECT {g} x, row_number() OVER ({p} ORDER BY x) AS i, count(*) OVER ({p}) AS n FROM k)
"""
_G = "SELECT {g} round(sum((2 * i - n - 1) * x) / (any_value(n) * sum(x)), 6)::DOUBLE AS value FROM r {by}"
_PA = "SELECT {g} round(sum(x) FILTER (i / n >= 0.9) / nullif(sum(x) FILTER (i / n <= 0.4), 0), 6)::DOUBLE AS value FROM r {by}"


def _rank(sql, where="", key=""):
    g = f"{key}," if key else ""
    return with_(EV, TREE) + _RANK.format(g=g, where=where, p=f"PARTITION BY {key}" if key else "") + sql.format(g=g, by=f"GROUP BY {key}" if key else "")


CATALOG = {
    "cascade_depths": (lambda s, d: m.depths(cascades(s, d)).select("root", "node", "depth"), with_(EV, TREE) + "SELECT root, node, length(bin(rn)) - 1 AS depth FROM tree"),
    "conversation_depths": (lambda s, d: m.depths(_chains(s, d)).select("root", "node", "depth"),
        "SELECT conv_id || '-0' AS root, conv_id || '-' || turn AS node, turn AS depth FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL"),
    "cascade_summary": (lambda s, d: _six(m.summary(cascades(s, d))), _T + """SELECT root, depth, size, breadth, round(sv, 6)::DOUBLE AS structural_virality, users AS unique_users,
        CASE WHEN size > 1 THEN round(life, 6) ELSE 0 END::DOUBLE AS lifetime FROM sm"""),
    "cascade_timeseries_depth": (_series("timeseries", "depth"), _TS.format(x="depth")),
    "cascade_timeseries_breadth": (_series("timeseries", "breadth"), _TS.format(x="breadth")),
    "cascade_timeseries_size": (_series("timeseries", "size"), _TS.format(x="size")),
    "cascade_timeseries_virality": (_series("timeseries", "structural_virality"), _TS.format(x="round(sv, 6)::DOUBLE")),
    "cascade_timeseries_unique": (_series("timeseries", "unique_nodes"), _TS.format(x="uniq")),
    "cascade_timeseries_new_ratio": (_series("timeseries", "new_node_ratio"), _TS.format(x="round(ratio, 6)::DOUBLE")),
    "cascade_by_depth_breadth": (_series("by_depth", "breadth"), _BD.format(x="breadth")),
    "cascade_by_depth_size": (_series("by_depth", "size"), _BD.format(x="size")),
    "cascade_by_depth_virality": (_series("by_depth", "structural_virality"), _BD.format(x="round(sv, 6)::DOUBLE")),
    "cascade_by_depth_unique": (_series("by_depth", "unique_nodes"), _BD.format(x="uniq")),
    "cascade_by_depth_new_ratio": (_series("by_depth", "new_node_ratio"), _BD.format(x="round(ratio, 6)::DOUBLE")),
    "participation_gini": (lambda s, d: _six(m.participation_gini(cascades(s, d), ["root"])), _rank(_G, key="root")),
    "participation_palma": (lambda s, d: _six(m.participation_palma(cascades(s, d), ["root"])), _rank(_PA, key="root")),
    "collection_participation_gini": (lambda s, d: _six(m.participation_gini(cascades(s, d))), _rank(_G)),
    "collection_participation_palma": (lambda s, d: _six(m.participation_palma(cascades(s, d))), _rank(_PA)),
    "community_participation_gini": (lambda s, d: _six(m.participation_gini(cascades(s, d), ["community"])), _rank(_G, key="community")),
    "initialization_gini": (lambda s, d: _six(m.participation_gini(cascades(s, d), roots_only=True)), _rank(_G, where="WHERE rn = 1")),
    "initialization_palma": (lambda s, d: _six(m.participation_palma(cascades(s, d), roots_only=True)), _rank(_PA, where="WHERE rn = 1")),
    "size_timeseries": (lambda s, d: _six(m.size_timeseries(cascades(s, d))), _T + """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS timestamp, round(avg(size), 6)::DOUBLE AS value
        FROM tree JOIN sm USING (root) WHERE rn = 1 GROUP BY 1"""),
    "lifetime_timeseries": (lambda s, d: _six(m.lifetime_timeseries(cascades(s, d), "hour")), with_(EV, TREE) + """
        , r AS (SELECT date_trunc('hour', ts) AS t FROM tree WHERE rn = 1), b AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM r)
        SELECT strftime(b.t, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN b.t IN (SELECT t FROM r) THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM b"""),
    "true_lifetime_timeseries": (lambda s, d: _six(m.lifetime_timeseries(cascades(s, d), true_lifetime=True)), _T + """
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS timestamp, round(avg(CASE WHEN size > 1 THEN life ELSE 0 END), 6)::DOUBLE AS value FROM tree JOIN sm USING (root) WHERE rn = 1 GROUP BY 1"""),
    "community_users": (lambda s, d: _six(m.community_users(cascades(s, d), "hour")), with_(EV, TREE) + """
        , r AS (SELECT community, u, min(date_trunc('hour', ts)) AS t FROM tree GROUP BY ALL),
        b AS (SELECT community, unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS t FROM tree GROUP BY community),
        c AS (SELECT b.community, b.t, count(r.u) AS n FROM b LEFT JOIN r ON r.community = b.community AND r.t = b.t GROUP BY ALL),
        k AS (SELECT *, sum(n) OVER (PARTITION BY community ORDER BY t) AS upto FROM c)
        SELECT community, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp, upto::BIGINT AS unique_users, round(n / upto, 6)::DOUBLE AS new_user_ratio FROM k"""),
    "lcc_fraction": (lambda s, d: _six(m.largest_fraction(cascades(s, d))), with_(EV, TREE) + """
        SELECT round(max(n) / sum(n), 6)::DOUBLE AS value FROM (SELECT root, count(*) AS n FROM tree GROUP BY root)"""),
    "lcc_fraction_community": (lambda s, d: _six(m.largest_fraction(cascades(s, d), ["community"])), with_(EV, TREE) + """
        SELECT community, round(max(n) / sum(n), 6)::DOUBLE AS value FROM (SELECT community, root, count(*) AS n FROM tree GROUP BY ALL) GROUP BY community"""),
    "original_ratio": (lambda s, d: _six(m.original_ratio(cascades(s, d), ["community"])), with_(EV, TREE) + """
        SELECT community, round(count(*) FILTER (event IN ('tweet', 'reply')) / count(*), 6)::DOUBLE AS value FROM tree GROUP BY community"""),
}

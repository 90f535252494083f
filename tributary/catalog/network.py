"""Queries of networks: the reply graph of the derived trees, and suppliers that share parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.catalog.adapters import EV, TREE, cascades, six, table, with_
from tributary.operators import network as m


def _reply(s, d):
    return m.reply_edges(cascades(s, d))


def _six(df):
    return df.select(*[six(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes])


def _projection(s, d):
    return m.projection_edges(table(s, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("shared")))


_E = with_(EV, TREE, recursive=True) + """, e AS (SELECT x.u AS src, p.u AS dst FROM tree x JOIN tree p ON p.node = x.parent),
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), deg AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY src),
se AS (SELECT DISTINCT src, dst FROM b WHERE src <> dst)"""
_P = """WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b USING (l_partkey) WHERE a.l_suppkey < b.l_suppkey),
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), deg AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY src), se AS (SELECT * FROM b)"""
_N = " SELECT {x}::DOUBLE AS value FROM (SELECT count(*) AS n, sum(degree) AS m2 FROM deg)"
_ASSORT = """, c AS (SELECT x.degree::DOUBLE AS x, y.degree::DOUBLE AS y FROM b JOIN deg x ON x.node = b.src JOIN deg y ON y.node = b.dst)
SELECT CASE WHEN NOT isnan(corr(x, y)) THEN round(corr(x, y), 6) END AS value FROM c"""
_CLUSTER = """, k AS (SELECT src AS node, count(*) AS k FROM se GROUP BY src),
t AS (SELECT a.src AS node, count(*) AS closed FROM se a JOIN se b ON b.src = a.src AND b.dst <> a.dst JOIN se c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src)
SELECT round(avg(CASE WHEN k >= 2 THEN coalesce(closed, 0) / (k * (k - 1)) ELSE 0 END), 6)::DOUBLE AS value FROM deg LEFT JOIN k USING (node) LEFT JOIN t USING (node)"""
_PATHS = """, w(origin, node, d) AS (SELECT node, node, 0 FROM deg UNION SELECT w.origin, se.dst, w.d + 1 FROM w JOIN se ON se.src = w.node WHERE w.d < 5),
s AS (SELECT origin, node, min(d) AS d FROM w GROUP BY ALL) SELECT round(avg(d), 6) AS value FROM s WHERE d > 0"""
_COMP = """, w(origin, node) AS (SELECT node, node FROM deg UNION SELECT w.origin, se.dst FROM w JOIN se ON se.src = w.node)
SELECT count(DISTINCT least_) AS value FROM (SELECT origin, min(node) AS least_ FROM w GROUP BY origin)"""

CATALOG = {
    "reply_edges": (lambda s, d: _reply(s, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("value")), _E + " SELECT src, dst, count(*) AS value FROM e GROUP BY ALL"),
    "projection_edges": (_projection, _P + " SELECT src, dst FROM e"),
    "net_nodes": (lambda s, d: m.number_of_nodes(_reply(s, d)), _E + " SELECT count(*) AS value FROM deg"),
    "net_edges": (lambda s, d: m.number_of_edges(_reply(s, d)), _E + " SELECT count(*) AS value FROM e"),
    "net_density": (lambda s, d: _six(m.degree_summary(_reply(s, d)).select(F.col("density").alias("value"))), _E + _N.format(x="round(m2 / (n * (n - 1)), 6)")),
    "net_mean_degree": (lambda s, d: _six(m.degree_summary(_reply(s, d)).select(F.col("mean_degree").alias("value"))), _E + _N.format(x="round(m2 / n, 6)")),
    "net_max_degree": (lambda s, d: m.degree_summary(_reply(s, d)).select(F.col("max_degree").alias("value")), _E + " SELECT max(degree) AS value FROM deg"),
    "net_assortativity": (lambda s, d: _six(m.assortativity(_reply(s, d))), _E + _ASSORT),
    "net_components": (lambda s, d: m.number_of_components(_reply(s, d)), _E + _COMP),
    "net_clustering": (lambda s, d: _six(m.clustering(_reply(s, d))), _E + _CLUSTER),
    "net_mean_path": (lambda s, d: _six(m.mean_path(_reply(s, d))), _E + _PATHS),
    "net_modularity_given": (lambda s, d: _six(m.modularity(_reply(s, d), m.degrees(_reply(s, d)).select("node", (F.col("node").cast("bigint") % 7).alias("community")))), _E + """
        , k AS (SELECT node::BIGINT % 7 AS g, sum(degree)::DOUBLE AS k FROM deg GROUP BY 1), t AS (SELECT count(*)::DOUBLE AS m, count(*) FILTER (src::BIGINT % 7 = dst::BIGINT % 7) AS i FROM e)
        SELECT round(any_value(i / m) - sum(k * k) / any_value(4 * m * m), 6)::DOUBLE AS value FROM k, t"""),
    "net_modularity": (lambda s, d: _six(m.modularity(_reply(s, d))), None),
    "degree_distribution": (lambda s, d: m.degrees(_reply(s, d)), _E + " SELECT node, degree FROM deg"),
    "projection_density": (lambda s, d: _six(m.degree_summary(_projection(s, d)).select(F.col("density").alias("value"))), _P + _N.format(x="round(m2 / (n * (n - 1)), 6)")),
    "projection_clustering": (lambda s, d: _six(m.clustering(_projection(s, d), listed=True)), _P + _CLUSTER),
    "projection_components": (lambda s, d: m.number_of_components(_projection(s, d)), _P + _COMP),
    "projection_assortativity": (lambda s, d: _six(m.assortativity(_projection(s, d))), _P + _ASSORT),
}

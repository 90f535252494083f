"""Queries of metrics: even events are the ground truth, odd ones the simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.catalog.adapters import EV, halves, six, with_
from tributary.operators import charts, content, user
from tributary.operators import metrics as m


def _six(df):
    return df.select(*[six(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes])


def _on(measure, metric):
    """``metric`` of the measure of both halves."""
    return lambda s, d: _six(metric(*[measure(h) for h in halves(s, d)]))


def _users(log):
    return user.activity_distribution(log).withColumn("value", F.col("value").cast("double"))


def _days(log):
    return content.growth(log).select("root", F.date_format("time", "yyyy-MM-dd").alias("day"), "value")


def _week(log):
    return log.groupBy(F.date_format("time", "EEEE").alias("day")).agg(F.count(F.lit(1)).alias("value"))


def _weekdays(log):
    return log.groupBy("root", F.date_format("time", "EEEE").alias("weekday")).agg(F.count(F.lit(1)).alias("value"))


def _types(log):
    return log.groupBy("root", "event").agg(F.count(F.lit(1)).alias("value"))


def _delays(log):
    return user.diffusion_delay(log).select("user", "value")


def _count(log):
    return log.agg(F.count(F.lit(1)).cast("double").alias("value"))


_H = with_(EV) + """, g AS (SELECT * FROM ev WHERE seq % 2 = 0), s AS (SELECT * FROM ev WHERE seq % 2 = 1)
"""
_U = _H + """, a AS (SELECT u AS k, count(*)::DOUBLE AS v FROM g GROUP BY u), b AS (SELECT u AS k, count(*)::DOUBLE AS v FROM s GROUP BY u)
"""
_D = _H + """, a AS (SELECT c AS r, strftime(t, '%Y-%m-%d') AS k, count(*)::DOUBLE AS v FROM g GROUP BY ALL), b AS (SELECT c AS r, strftime(t, '%Y-%m-%d') AS k, count(*)::DOUBLE AS v FROM s GROUP BY ALL),
j AS (SELECT coalesce(a.r, b.r) AS r, coalesce(a.k, b.k) AS k, a.v AS g, b.v AS s FROM a FULL JOIN b ON a.r = b.r AND a.k = b.k)
"""
_W = _H + """, a AS (SELECT strftime(t, '%A') AS k, count(*)::DOUBLE AS v FROM g GROUP BY ALL), b AS (SELECT strftime(t, '%A') AS k, count(*)::DOUBLE AS v FROM s GROUP BY ALL),
p AS (SELECT coalesce(a.v, 0) / sum(coalesce(a.v, 0)) OVER () AS p, coalesce(b.v, 0) / sum(coalesce(b.v, 0)) OVER () AS q FROM a FULL JOIN b USING (k))
"""
_HIST = _U + """, x AS (SELECT v, 1 AS g, 0 AS s FROM a UNION ALL SELECT v, 0, 1 FROM b),
m AS (SELECT count(*)::DOUBLE AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mu, stddev_pop(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM x),
k AS (SELECT m.*, (SELECT avg(((v - mu) / sd) ** 3) FROM x, m) AS g1 FROM m),
n AS (SELECT lo, hi, ceil((hi - lo) / ({width}))::BIGINT AS bins FROM k),
h AS (SELECT least(floor((v - lo) / (hi - lo) * bins), bins - 1)::BIGINT AS bin, sum(g) AS g, sum(s) AS s FROM x, n GROUP BY 1),
z AS (SELECT i AS bin, bins, coalesce(g, 0)::BIGINT AS gt, coalesce(s, 0)::BIGINT AS sim FROM (SELECT bins, unnest(range(bins)) AS i FROM n) LEFT JOIN h ON h.bin = i)
"""
_DOANE = "(hi - lo) / (1 + log2(n) + log2(1 + abs(g1) / sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))))"
_AUTO = "CASE WHEN iqr > 0 THEN least(2 * iqr * n ** (-1 / 3.0::DOUBLE), (hi - lo) / (log2(n) + 1)) ELSE (hi - lo) / (log2(n) + 1) END"
_PQ = _HIST.format(width=_DOANE) + ", p AS (SELECT gt / sum(gt) OVER () AS p, sim / sum(sim) OVER () AS q FROM z)\n"
_JS = "SELECT round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2 / ln({b}), 6)::DOUBLE AS value FROM p"
_KL = "SELECT round(sum(CASE WHEN p <= 0 THEN 0 WHEN q <= 0 THEN 'Infinity'::DOUBLE ELSE p * ln(p / q) END), 6)::DOUBLE AS value FROM p"
_FF = """, f AS (SELECT r, k, last_value(g IGNORE NULLS) OVER w AS g, last_value(s IGNORE NULLS) OVER w AS s FROM j WINDOW w AS (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING))
"""
#: The table's cells one after the other, in a list.
_DTW = """, l AS (SELECT r AS root, list(coalesce(g, 0) ORDER BY k) AS a, list(coalesce(s, 0) ORDER BY k) AS b, count(*) AS n FROM j GROUP BY r),
w AS (SELECT root, a, b, n, [abs(a[1] - b[1])] AS st FROM l
  UNION ALL SELECT root, a, b, n, list_append(st, abs(a[len(st) // n + 1] - b[len(st) % n + 1]) + least(
    CASE WHEN len(st) % n > 0 THEN st[len(st)] ELSE 1e300 END, CASE WHEN len(st) >= n THEN st[len(st) - n + 1] ELSE 1e300 END,
    CASE WHEN len(st) % n > 0 AND len(st) >= n THEN st[len(st) - n] ELSE 1e300 END)) FROM w WHERE len(st) < n * n)
SELECT root, round(st[n * n], 6)::DOUBLE AS value FROM w WHERE len(st) = n * n"""
_RBO = _H + """, a AS (SELECT {p} c, row_number() OVER ({w} ORDER BY n DESC, c) AS i FROM (SELECT {p} c, count(*) AS n FROM g GROUP BY ALL)),
b AS (SELECT {p} c, row_number() OVER ({w} ORDER BY n DESC, c) AS i FROM (SELECT {p} c, count(*) AS n FROM s GROUP BY ALL))
"""


def _rmse_by_content(s, d):
    return _six(m.rmse(*[_days(h) for h in halves(s, d)], how="full_outer", group=["root"]))


CATALOG = {
    "m_join_outer_zero": (_on(_days, lambda g, s: m.join(g, s, "full_outer", 0)), _D + "SELECT r AS root, k AS day, coalesce(g, 0) AS value_gt, coalesce(s, 0) AS value_sim FROM j"),
    "m_join_outer_ffill": (_on(_days, lambda g, s: m.join(g, s, "full_outer", "ffill", ["root"]).withColumns({c: F.col(c).cast("double") for c in ("value_gt", "value_sim")})),
        _D + _FF + "SELECT r AS root, k AS day, g AS value_gt, s AS value_sim FROM f"),
    "m_absolute_difference": (_on(_count, m.absolute_difference), _H + "SELECT abs((SELECT count(*) FROM s) - (SELECT count(*) FROM g))::DOUBLE AS value"),
    "m_absolute_percentage_error": (_on(_count, m.absolute_percentage_error), _H + "SELECT round(100 * abs((SELECT count(*) FROM s) - n) / n, 6)::DOUBLE AS value FROM (SELECT count(*) AS n FROM g)"),
    "m_hist_doane": (_on(_users, m.histogram), _HIST.format(width=_DOANE) + "SELECT bin, bins, gt, sim FROM z"),
    "m_hist_auto": (_on(_users, lambda g, s: m.histogram(g, s, "auto")), _HIST.format(width=_AUTO) + "SELECT bin, bins, gt, sim FROM z"),
    "m_kl_discrete": (_on(_week, lambda g, s: m.kl_divergence(g, s, True)), _W + _KL),
    "m_kl_numeric": (_on(_users, m.kl_divergence), _PQ + _KL),
    "m_kl_smoothed": (_on(_users, m.kl_divergence_smoothed), _HIST.format(width=_AUTO) +
        ", p AS (SELECT gt / sum(gt) OVER () AS p, (0.99::DOUBLE * sim + 0.01) / sum(0.99::DOUBLE * sim + 0.01) OVER () AS q FROM z)\n" + _KL),
    "m_js_discrete": (_on(_week, lambda g, s: m.js_divergence(g, s, True)), _W + _JS.format(b="2::DOUBLE")),
    "m_js_numeric": (_on(_users, m.js_divergence), _PQ + _JS.format(b="2::DOUBLE")),
    "m_js_natural": (_on(_users, lambda g, s: m.js_divergence(g, s, base=2.718281828459045)), _PQ + _JS.format(b="exp(1::DOUBLE)")),
    "m_rbo": (_on(lambda log: content.counts_by(log, "root"), m.rbo), _RBO.format(p="", w="") + """, o AS (SELECT d, (SELECT count(*) FROM a JOIN b USING (c) WHERE a.i <= d AND b.i <= d) AS k
        FROM (SELECT unnest(range(1, 1 + least((SELECT count(*) FROM a), (SELECT count(*) FROM b)))) AS d)) SELECT round(sum(k / d * 0.95::DOUBLE ** (d - 1)) * 0.05, 6)::DOUBLE AS value FROM o"""),
    "m_rbo_grouped_mean": (_on(_types, lambda g, s: m.rbo_mean(g, s, ["event"], 0.9, 30)), _RBO.format(p="event,", w="PARTITION BY event") + """
        , n AS (SELECT event, least(x, y) AS n FROM (SELECT event, count(*) AS x FROM a GROUP BY event) JOIN (SELECT event, count(*) AS y FROM b GROUP BY event) USING (event) WHERE x >= 30),
        e AS (SELECT event, unnest(range(1, n + 1)) AS d FROM n),
        o AS (SELECT e.event, d, count(b.c) AS k FROM e LEFT JOIN a ON a.event = e.event AND a.i <= d LEFT JOIN b ON b.event = e.event AND b.c = a.c AND b.i <= d GROUP BY ALL)
        SELECT round(avg(v), 6)::DOUBLE AS value FROM (SELECT event, sum(k / d * 0.9::DOUBLE ** (d - 1)) * 0.1 AS v FROM o GROUP BY event)"""),
    "m_rmse": (_on(_users, m.rmse), _U + "SELECT round(sqrt(avg((a.v - b.v) ** 2)), 6)::DOUBLE AS value FROM a JOIN b USING (k)"),
    "m_rmse_outer": (_on(_days, lambda g, s: m.rmse(g, s, "full_outer", 0)), _D + "SELECT round(sqrt(avg((coalesce(g, 0) - coalesce(s, 0)) ** 2)), 6)::DOUBLE AS value FROM j"),
    "m_rmse_by_content": (_rmse_by_content, _D + "SELECT r AS root, round(sqrt(avg((coalesce(g, 0) - coalesce(s, 0)) ** 2)), 6)::DOUBLE AS value FROM j GROUP BY r"),
    "m_rmse_ffill": (_on(_days, lambda g, s: m.rmse(g, s, "full_outer", "ffill", group=["root"])), _D + _FF + "SELECT r AS root, round(sqrt(avg((g - s) ** 2)), 6)::DOUBLE AS value FROM f GROUP BY r"),
    "m_nrmse": (_on(_users, lambda g, s: m.rmse(g, s, relative=True)), _U + """
        SELECT round(sqrt(avg((a.v - b.v) ** 2)) / nullif(quantile_cont(a.v, 0.75) - quantile_cont(a.v, 0.25), 0), 6)::DOUBLE AS value FROM a JOIN b USING (k)"""),
    "m_r2": (_on(_users, m.r2), _U + "SELECT round(1 - sum((a.v - b.v) ** 2) / (var_pop(a.v) * count(*)), 6)::DOUBLE AS value FROM a JOIN b USING (k)"),
    "m_pearson": (_on(_users, m.pearson), _U + "SELECT round(corr(a.v, b.v), 6)::DOUBLE AS value FROM a JOIN b USING (k)"),
    "m_ks": (_on(_delays, m.ks_test), _H + """, a AS (SELECT trunc((epoch(t) - epoch(min(t) OVER (PARTITION BY u))) / 3600) AS v FROM g), b AS (SELECT trunc((epoch(t) - epoch(min(t) OVER (PARTITION BY u))) / 3600) AS v FROM s),
        x AS (SELECT DISTINCT v FROM (SELECT v FROM a UNION ALL SELECT v FROM b))
        SELECT round(max(abs((SELECT count(*) FROM a WHERE a.v <= x.v) / (SELECT count(*) FROM a) - (SELECT count(*) FROM b WHERE b.v <= x.v) / (SELECT count(*) FROM b))), 6)::DOUBLE AS value FROM x"""),
    "chart_hist": (_on(_users, lambda g, s: charts.chart("hist", g, s)), _HIST.format(width=_DOANE) + """, e AS (SELECT lo, (hi - lo) / bins AS w FROM n),
        t AS (SELECT bin, 'Ground Truth' AS type, gt AS vals FROM z UNION ALL SELECT bin, 'Simulation', sim FROM z)
        SELECT bin, round(lo + bin * w, 6)::DOUBLE AS low, round(lo + (bin + 1) * w, 6)::DOUBLE AS high, type, vals::BIGINT AS vals FROM t, e"""),
    "chart_scatter": (_on(_users, lambda g, s: charts.chart("scatter", g, s)), _U + 'SELECT a.k AS "user", a.v AS "Ground Truth", b.v AS "Simulation" FROM a JOIN b USING (k)'),
    "chart_bar": (_on(_users, lambda g, s: charts.chart("bar", g, s)), _U + """, j AS (SELECT k, coalesce(a.v, 0) AS g, coalesce(b.v, 0) AS s FROM a FULL JOIN b USING (k))
        SELECT k AS "user", 'Ground Truth' AS type, g::DOUBLE AS vals FROM j UNION ALL SELECT k, 'Simulation', s FROM j"""),
    "chart_time_series": (_on(_days, lambda g, s: charts.chart("time_series", g, s)), _D + """
        SELECT r AS root, k AS day, 'Ground Truth' AS type, g AS vals FROM j WHERE g IS NOT NULL UNION ALL SELECT r, k, 'Simulation', s FROM j WHERE s IS NOT NULL"""),
    "chart_multi_time_series": (_on(_weekdays, lambda g, s: charts.chart("multi_time_series", g, s)), _H + """,
        a AS (SELECT c AS r, strftime(t, '%A') AS k, count(*)::DOUBLE AS v FROM g GROUP BY ALL), b AS (SELECT c AS r, strftime(t, '%A') AS k, count(*)::DOUBLE AS v FROM s GROUP BY ALL),
        j AS (SELECT coalesce(a.r, b.r) AS r, coalesce(a.k, b.k) AS k, coalesce(a.v, 0) AS g, coalesce(b.v, 0) AS s FROM a FULL JOIN b ON a.r = b.r AND a.k = b.k),
        t AS (SELECT r, k, 'Ground Truth' AS type, g AS vals FROM j UNION ALL SELECT r, k, 'Simulation', s FROM j)
        SELECT r AS root, k AS weekday, type, vals::DOUBLE AS vals, list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], k)::INTEGER AS weekday_int FROM t"""),
    "m_dtw": (_on(_days, lambda g, s: m.dtw(g, s, ["root"])), _D.replace("WITH ", "WITH RECURSIVE ", 1) + _DTW),
    "m_pearson_test": (_on(_users, lambda g, s: m.pearson_test(g, s).select("value")), _U + "SELECT round(corr(a.v, b.v), 6)::DOUBLE AS value FROM a JOIN b USING (k)"),
    "m_plot_ready": (_on(_users, m.plot_ready), _U + 'SELECT coalesce(a.k, b.k) AS "user", coalesce(a.v, 0) AS "Ground Truth", coalesce(b.v, 0) AS "Simulation" FROM a FULL JOIN b ON a.k = b.k'),
}

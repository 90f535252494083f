"""Queries of content measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.catalog.adapters import EV, META, content_metadata, later, log, previous_counts, six, text_time, with_
from tributary.operators import content as m
from tributary.operators import user


def _timed(df):
    return df.withColumn("time", text_time(F.col("time")))


def _six(df):
    return df.withColumn("value", six(F.col("value")))


def _bins(low: float, high: float, edges: int) -> str:
    """A CASE over the edges, written out for SQL."""
    at = [10 ** (low + (high - low) * i / (edges - 1)) for i in range(edges)]
    return "CASE WHEN value <= %r THEN NULL %s END::DOUBLE" % (at[0], " ".join(f"WHEN value <= {x!r} THEN {int(x)}" for x in at[1:]))


_BY_HOUR = """, d AS (SELECT c AS root, t, count(DISTINCT u) AS n FROM {rows} GROUP BY ALL)
SELECT root, strftime(t, '%Y-%m-%d %H:%M:%S') AS time, {value}::BIGINT AS value FROM d"""
_DIST = "SELECT c AS root, event, strftime(t, '{f}') AS date, count(*) AS value FROM ev GROUP BY ALL"
_SORTED = """, k AS (SELECT {n} AS k, count(*) AS x FROM ev GROUP BY ALL), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM k)
"""
_GINI = _SORTED + "SELECT round(sum((2 * i - n - 1) * (x + 1e-9)) / (any_value(n) * sum(x + 1e-9)), 6)::DOUBLE AS value FROM r"
_TRAPZ = _SORTED + """, l AS (SELECT i, n, sum(x) OVER (ORDER BY i) / sum(x) OVER () AS y FROM r)
SELECT round(1 - 2 * sum(area), 6)::DOUBLE AS value FROM (SELECT (y + lag(y) OVER (ORDER BY i)) / 2 / n AS area FROM l)"""
_PALMA = _SORTED + "SELECT round(sum(x) FILTER ((i - {o})::DOUBLE / n >= 0.9) / nullif(sum(x) FILTER ((i - {o})::DOUBLE / n <= 0.4), 0), 6)::DOUBLE AS value FROM r"
_RUN = """, p AS (SELECT c, u, count(*) AS before FROM ev WHERE ts < '2024-01-16' GROUP BY ALL),
r AS (SELECT c, u, event, ts, seq, t, row_number() OVER (PARTITION BY c, u ORDER BY ts, seq) AS rn, count(*) OVER (PARTITION BY c, u) AS n FROM ev WHERE ts >= '2024-01-16'),
"""
_RATIO = _RUN + """v AS (SELECT r.*, {count} + coalesce(before, 0) AS value FROM r LEFT JOIN p USING (c, u)),
f AS (SELECT c, lead(event) OVER (PARTITION BY c, u ORDER BY ts, seq) AS nxt, """ + _bins(-1, 3, 16) + """ AS b FROM v WHERE event IN ('{a}', '{z}'))
SELECT c AS root, b AS num_events_binned, round(coalesce(count(*) FILTER (nxt = '{a}') / nullif(count(*) FILTER (nxt = '{z}'), 0)::DOUBLE, 0), 6)::DOUBLE AS value
FROM f WHERE b IS NOT NULL GROUP BY ALL"""

CATALOG = {
    "content_diffusion_delay": (lambda s, d: m.diffusion_delay(log(s, d)), with_(EV) + """
        SELECT c AS root, seq, ((epoch(t) - epoch(first)) // 60)::BIGINT AS value
        FROM (SELECT *, min(t) OVER (PARTITION BY c) AS first, row_number() OVER (ORDER BY ts, seq) AS rn FROM ev) WHERE rn > 1"""),
    "content_diffusion_delay_each": (lambda s, d: m.diffusion_delay(log(s, d), unit="h", drop="per_content"), with_(EV) + """
        SELECT c AS root, seq, ((epoch(t) - epoch(first)) // 3600)::BIGINT AS value
        FROM (SELECT *, min(t) OVER (PARTITION BY c) AS first, row_number() OVER (PARTITION BY c ORDER BY ts, seq) AS rn FROM ev) WHERE rn > 1"""),
    "content_diffusion_delay_meta": (lambda s, d: m.diffusion_delay(log(s, d), unit="d", created=content_metadata(s, d)), with_(EV, META) + """
        SELECT c AS root, seq, trunc((epoch(t) - epoch(created)) / 86400)::BIGINT AS value FROM ev JOIN cm USING (c)"""),
    "content_growth": (lambda s, d: _timed(m.growth(log(s, d))), with_(EV) + """
        SELECT c AS root, strftime(date_trunc('day', t), '%Y-%m-%d %H:%M:%S') AS time, count(*) AS value FROM ev GROUP BY ALL"""),
    "content_growth_cumulative": (lambda s, d: _timed(m.growth(log(s, d), cumulative=True)), with_(EV) + """
        , d AS (SELECT c AS root, date_trunc('day', t) AS t, count(*) AS n FROM ev GROUP BY ALL)
        SELECT root, strftime(t, '%Y-%m-%d %H:%M:%S') AS time, (sum(n) OVER (PARTITION BY root ORDER BY t))::BIGINT AS value FROM d"""),
    "content_contributors": (lambda s, d: _timed(m.contributors(log(s, d))), with_(EV) + _BY_HOUR.format(rows="ev", value="n")),
    "content_contributors_cumulative": (lambda s, d: _timed(m.contributors(log(s, d), cumulative=True)),
        with_(EV) + _BY_HOUR.format(rows="ev", value="sum(n) OVER (PARTITION BY root ORDER BY t)")),
    "content_contributors_new": (lambda s, d: _timed(m.contributors(log(s, d), new_users=True)),
        with_(EV) + _BY_HOUR.format(rows="(SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY u ORDER BY ts, seq) = 1)", value="n")),
    "event_distribution_daily": (lambda s, d: m.event_distribution(log(s, d)), with_(EV) + _DIST.format(f="%Y-%m-%d")),
    "event_distribution_weekday": (lambda s, d: m.event_distribution(log(s, d), "weekday"), with_(EV) + _DIST.format(f="%A")),
    "event_distribution_monthly": (lambda s, d: m.event_distribution(log(s, d), "month"), with_(EV) + _DIST.format(f="%Y-%m")),
    "gini_user": (lambda s, d: _six(m.gini_of(log(s, d))), with_(EV) + _GINI.format(n="u")),
    "gini_content": (lambda s, d: _six(m.gini_of(log(s, d), "root")), with_(EV) + _GINI.format(n="c")),
    "gini_trapz": (lambda s, d: _six(m.gini_of(log(s, d), method="trapz")), with_(EV) + _TRAPZ.format(n="u")),
    "palma_user": (lambda s, d: _six(m.palma_of(log(s, d))), with_(EV) + _PALMA.format(n="u", o=0)),
    "palma_content": (lambda s, d: _six(m.palma_of(log(s, d), "root")), with_(EV) + _PALMA.format(n="c", o=0)),
    "palma_base0": (lambda s, d: _six(m.palma_of(log(s, d), rank_base=0)), with_(EV) + _PALMA.format(n="u", o=1)),
    "topk_content": (lambda s, d: m.top(log(s, d), k=20), with_(EV) + "SELECT c AS root, count(*) AS value FROM ev GROUP BY c ORDER BY value DESC, c LIMIT 20"),
    "events_by_content": (lambda s, d: m.events_by_content(log(s, d), ["view"]), with_(EV) + "SELECT c AS root, count(*) AS value FROM ev WHERE event = 'view' GROUP BY c"),
    "content_pr_acceptance": (lambda s, d: _six(user.acceptance(log(s, d), ["purchase"], 2, per_user=False)), with_(EV) + """
        SELECT c AS root, round(sum(merged::INTEGER) / count(*), 6)::DOUBLE AS value FROM ev WHERE event = 'purchase' AND action = 'closed' GROUP BY c HAVING count(*) >= 2"""),
    "event_type_ratio": (lambda s, d: _six(m.event_type_ratio(later(s, d), "click", "view", previous=previous_counts(s, d))),
        with_(EV) + _RATIO.format(count="rn", a="click", z="view")),
    "push_issue_ratio": (lambda s, d: _six(m.event_type_ratio(later(s, d), "purchase", "click", previous=previous_counts(s, d), same_time_mean=True)),
        with_(EV) + _RATIO.format(count="avg(rn) OVER (PARTITION BY r.c, r.u, t)", a="purchase", z="click")),
    "prop_user_continue": (lambda s, d: _six(m.user_continues(later(s, d), previous=previous_counts(s, d))), with_(EV) + _RUN + """
        v AS (SELECT r.*, rn + coalesce(before, 0) AS value FROM r LEFT JOIN p USING (c, u)), b AS (SELECT *, """ + _bins(-1, 2.5, 30) + """ AS num_actions FROM v)
        SELECT c AS root, num_actions, round(avg((rn < n)::INTEGER), 6) AS value FROM b WHERE num_actions IS NOT NULL GROUP BY ALL"""),
    "content_mean_gap": (lambda s, d: _six(user.mean_gap(log(s, d), key="root", unit=3600.0)), with_(EV) + """
        SELECT c AS root, round((epoch(max(t)) - epoch(min(t))) / nullif(count(*) - 1, 0) / 3600, 6)::DOUBLE AS value FROM ev GROUP BY c"""),
    "content_lifetime": (lambda s, d: _six(m.lifetime(log(s, d))), with_(EV) + """
        SELECT c AS root, count(*) AS depth, round((epoch(max(t)) - epoch(min(t))) / 86400, 6)::DOUBLE AS value FROM ev GROUP BY c"""),
    "content_lifetime_short": (lambda s, d: m.lifetime(log(s, d), most_days=29), with_(EV) + """
        SELECT c AS root, count(*) AS depth, floor((epoch(max(t)) - epoch(min(t))) / 86400)::DOUBLE AS value FROM ev GROUP BY c HAVING value <= 29"""),
    "content_new_and_total": (lambda s, d: _timed(m.contributors(log(s, d), time_bin="day").withColumnRenamed("value", "total").join(
            m.contributors(log(s, d), time_bin="day", new_users=True), ["root", "time"], "left").select("root", "time", "total", F.coalesce("value", F.lit(0)).alias("new"))),
        with_(EV) + """, f AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts, seq) = 1 AS fresh FROM ev)
        SELECT c AS root, strftime(date_trunc('day', t), '%Y-%m-%d %H:%M:%S') AS time, count(DISTINCT u) AS total, count(DISTINCT u) FILTER (fresh) AS new FROM f GROUP BY ALL"""),
}

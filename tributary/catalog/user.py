"""Queries of user measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.catalog.adapters import CREATION, EV, META, POPULARITY, log, six, text_time, user_metadata, with_
from tributary.operators import user as m


def _timed(df):
    return df.withColumn("time", text_time(F.col("time")))


def _six(df):
    return df.withColumn("value", six(F.col("value")))


_DAYS = """, d AS (SELECT u, date_trunc('day', t)::TIMESTAMP AS t, count(*) AS n FROM ev GROUP BY ALL)"""
_SPINE = """, s AS (SELECT u, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS t FROM (SELECT u, min(t) AS lo, max(t) AS hi FROM d GROUP BY u))"""
_POP = """SELECT owner AS "user", sum(n)::BIGINT AS value
FROM (SELECT c, count(*) AS n FROM ev WHERE {which} GROUP BY c) JOIN (SELECT c, arg_min(u, (ts, seq)) AS owner FROM ev WHERE event = 'signup' GROUP BY c) USING (c)
GROUP BY owner ORDER BY value DESC, "user" LIMIT 50"""

CATALOG = {
    "user_unique_content": (lambda s, d: m.unique_content(log(s, d)), with_(EV) + 'SELECT u AS "user", count(DISTINCT c) AS value FROM ev GROUP BY u'),
    "user_activity_timeline": (lambda s, d: _timed(m.activity_timeline(log(s, d))), with_(EV) + _DAYS + _SPINE +
        """ SELECT s.u AS "user", strftime(s.t, '%Y-%m-%d %H:%M:%S') AS time, coalesce(n, 0)::BIGINT AS value FROM s LEFT JOIN d ON d.u = s.u AND d.t = s.t"""),
    "user_activity_timeline_cumulative": (lambda s, d: _timed(m.activity_timeline(log(s, d), cumulative=True)), with_(EV) + _DAYS + _SPINE +
        """, k AS (SELECT u, t, sum(n) OVER (PARTITION BY u ORDER BY t) AS n FROM d)
        SELECT s.u AS "user", strftime(s.t, '%Y-%m-%d %H:%M:%S') AS time, coalesce(n, 0)::BIGINT AS value FROM s LEFT JOIN k ON k.u = s.u AND k.t = s.t"""),
    "user_activity_shared_range": (lambda s, d: _timed(m.activity_shared_range(log(s, d))), with_(EV) + _DAYS +
        """, r AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS t FROM d)
        SELECT x.u AS "user", strftime(r.t, '%Y-%m-%d %H:%M:%S') AS time, coalesce(sum(n) OVER (PARTITION BY x.u ORDER BY r.t), 0)::BIGINT AS value
        FROM (SELECT DISTINCT u FROM d) x CROSS JOIN r LEFT JOIN d ON d.u = x.u AND d.t = r.t"""),
    "user_popularity": (lambda s, d: m.popularity(log(s, d), POPULARITY, 50, CREATION), with_(EV) + _POP.format(which="event IN ('view', 'click')")),
    "user_popularity_noncreate": (lambda s, d: m.popularity(log(s, d), None, 50, CREATION, exclude=CREATION), with_(EV) + _POP.format(which="event <> 'signup'")),
    "user_popularity_watch": (lambda s, d: m.popularity(log(s, d), ["view"], 50, CREATION), with_(EV) + _POP.format(which="event = 'view'")),
    "user_mean_gap": (lambda s, d: _six(m.mean_gap(log(s, d))), with_(EV) +
        """SELECT u AS "user", round((epoch(max(t)) - epoch(min(t))) / nullif(count(*) - 1, 0), 6)::DOUBLE AS value FROM ev GROUP BY u"""),
    "user_diffusion_delay": (lambda s, d: m.diffusion_delay(log(s, d)), with_(EV) +
        """SELECT u AS "user", seq, trunc((epoch(t) - epoch(min(t) OVER (PARTITION BY u))) / 3600)::BIGINT AS value FROM ev"""),
    "user_diffusion_delay_meta": (lambda s, d: m.diffusion_delay(log(s, d), created=user_metadata(s, d)), with_(EV, META) +
        """SELECT u AS "user", seq, trunc((epoch(t) - epoch(created)) / 3600)::BIGINT AS value FROM ev JOIN um USING (u)"""),
    "most_active_users": (lambda s, d: m.most_active(log(s, d), k=100), with_(EV) + 'SELECT u AS "user", count(*) AS value FROM ev GROUP BY u ORDER BY value DESC, u LIMIT 100'),
    "user_activity_distribution": (lambda s, d: m.activity_distribution(log(s, d), POPULARITY), with_(EV) +
        """SELECT u AS "user", count(*) AS value FROM ev WHERE event IN ('view', 'click') GROUP BY u"""),
    "user_pr_acceptance": (lambda s, d: _six(m.acceptance(log(s, d), ["purchase"], 1)), with_(EV) +
        """SELECT "user", round(avg(v), 6) AS value FROM (
          SELECT u AS "user", c, sum(merged::INTEGER) / count(*) AS v FROM ev WHERE event = 'purchase' AND action = 'closed' GROUP BY ALL) GROUP BY ALL"""),
}

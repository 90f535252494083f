"""Queries of extraction and reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.catalog.adapters import EV, TREE, cascades, log, table, with_
from tributary.functions.scalar import DOMAIN, iso_time, url_domains
from tributary.operators import extract as m
from tributary.operators import preprocess, reconstruct
from tributary.plans import registry


def _raw(s, d):
    """The trees under the raw names, parents of retweets and roots of replies unknown."""
    c = cascades(s, d)
    return c.select(
        F.col("node").alias("nodeID"), F.col("user").alias("nodeUserID"), F.col("event").alias("actionType"), F.col("ts").cast("string").alias("nodeTime"),
        F.when(F.col("event") == "retweet", "?").otherwise(F.col("parent")).alias("parentID"), F.when(F.col("event") == "reply", "?").otherwise(F.col("root")).alias("rootID"), F.col("root").alias("partialParentID"))


def _followers(s, d):
    """Who ever answered someone follows them."""
    c = cascades(s, d)
    p = c.select(F.col("node").alias("parent"), F.col("user").alias("followed"))
    return c.join(p, "parent").select(F.col("followed").alias("user"), F.col("user").alias("follower")).distinct()


def _tree_parents(s, d):
    rows = cascades(s, d).select(F.col("node").alias("nodeID"), F.col("user").alias("nodeUserID"), F.col("ts").alias("nodeTime"), F.col("root").alias("rootID"))
    return reconstruct.retweet_parents(rows, _followers(s, d)).filter("parent is not null")


def _threads(s, d):
    c = cascades(s, d)
    return c.select(F.col("node").alias("nodeID"), F.col("parent").alias("parentID"), F.col("root").alias("rootID"),
                    F.when(F.col("seq") % 7 == 0, F.array(F.concat(F.lit("i"), (F.col("seq") % 5).cast("string")))).otherwise(F.array().cast("array<string>")).alias("informationIDs"))


def _tweets(s, d):
    """Documents of every kind of tweet, by the remainder of the event's id."""
    e = table(s, d, "events")
    k, some = F.col("event_id") % 9, lambda *r: (F.col("event_id") % 9).isin(*r)
    sid = lambda p: F.concat(F.lit(p), F.col("event_id").cast("string"))
    null = F.lit(None).cast("string")
    return e.select(
        F.col("event_id").cast("string").alias("id_str_h"), F.struct(F.col("user_id").cast("string").alias("id_str_h")).alias("user"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(k == 0, sid("p")).otherwise("").alias("in_reply_to_status_id_str_h"),
        F.when(some(1, 2, 3, 4), F.struct(sid("r").alias("id_str_h"), F.when(k == 2, sid("a")).otherwise(null).alias("in_reply_to_status_id_str_h"))).alias("retweeted_status"),
        F.when(some(3, 4, 5, 6, 7), F.struct(sid("q").alias("id_str_h"), F.when(some(4, 6), sid("b")).otherwise("").alias("in_reply_to_status_id_str_h"), (k == 7).alias("is_quote_status"), sid("z").alias("quoted_status_id_str"))).alias("quoted_status"))


def _names(s, d):
    """Customers and suppliers of a nation as scored pairs."""
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("username1"), F.concat(F.lit("s"), (F.col("c_custkey") % 40).cast("string")).alias("username2"), (F.lit(0.85) + (F.col("c_custkey") % 13) / 100).alias("score"))
    x = table(s, d, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 40).cast("string")).alias("username1"), F.concat(F.lit("x"), (F.col("s_suppkey") % 7).cast("string")).alias("username2"))
    return m.user_alignment(c, x.distinct())


def _keywords(s, d):
    rows = log(s, d).select("seq", F.concat(F.lit("Alias"), F.col("content")).alias("informationID"))
    aliases = log(s, d).select(F.concat(F.lit("alias"), F.col("content")).alias("alias"), F.concat(F.lit("topic"), (F.col("content").cast("bigint") % 3).cast("string")).alias("name")).filter(F.col("content").cast("bigint") < 50).distinct()
    return m.keyword_map(rows, aliases).groupBy("informationID").agg(F.count(F.lit(1)).alias("value"))


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _github_docs(s, d):
    """Events as raw documents: pushes, issues and a type that isn't extracted, some twice."""
    e = log(s, d)
    ids = F.array(F.concat(F.lit("i"), (F.col("seq") % 5).cast("string")), F.lit("all"))
    text = F.concat(F.lit("see https://"), "content", F.lit(".org/x"))
    docs = e.select(
        F.struct(F.element_at(F.array(*map(F.lit, ("PushEvent", "IssuesEvent", "OtherEvent"))), (F.col("seq") % 3 + 1).cast("int")).alias("type"), _iso("ts").alias("created_at"),
                 F.struct(F.col("user").alias("login_h")).alias("actor"), F.struct(F.col("content").alias("name_h")).alias("repo")).alias("event"),
        F.struct(F.array(F.struct(text.alias("message_m"))).alias("commits"), F.struct(text.alias("body_m")).alias("issue")).alias("payload"),
        F.array(F.struct(F.struct(ids.alias("keywords")).alias("extension"))).alias("details"))
    return docs.unionByName(docs.filter("event.type = 'IssuesEvent'"))


def _github(s, d):
    rows = m.github(_github_docs(s, d), start="2024-01-05", end="2024-01-20")
    return rows.select("nodeID", "nodeUserID", "actionType", "nodeTime", "informationID", F.concat_ws(",", "urlDomains").alias("domains"))


def _marked(s, d):
    """Trees with an id on some nodes."""
    ids = F.when(F.col("seq") % 7 == 0, F.array(F.concat(F.lit("i"), (F.col("seq") % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    return cascades(s, d).withColumn("ids", ids)


def _reddit(s, d):
    rows = _marked(s, d)
    extra = F.struct(F.col("ids").alias("keywords"), F.lit("d").alias("domain")).alias("extension")
    common = [F.col("node").alias("id_h"), F.col("user").alias("author_h"), F.unix_seconds("ts").alias("created_utc"), F.col("community").alias("subreddit_id"), extra]
    posts = rows.filter("node = root").select(*common, F.lit("").alias("selftext_m"))
    parent = F.concat(F.when(F.col("parent") == F.col("root"), "t3_").otherwise("t1_"), "parent")
    comments = rows.filter("node != root").select(*common, parent.alias("parent_id_h"), F.concat(F.lit("t3_"), "root").alias("link_id_h"), F.lit("").alias("body_m"))
    return m.reddit(comments, posts, domains=["d"]).select("nodeID", "parentID", "rootID", "actionType", "informationID")


def _telegram(s, d):
    rows = _marked(s, d)
    number = lambda c: F.substring_index(c, "-", -1).cast("bigint")
    channel = F.substring_index("node", "-", 1).cast("bigint")
    docs = rows.select(
        F.col("node").alias("uid_h"), F.struct(_iso("ts").alias("timestamp"), F.col("user").alias("author"), F.lit("").alias("body_m")).alias("norm"),
        F.struct(F.struct(channel.alias("channel_id")).alias("to_id"), number("node").alias("id"), F.col("user").alias("from_id_h"),
                 F.when(F.col("node") != F.col("root"), number("parent")).alias("reply_to_msg_id"), F.struct(F.lit("room").alias("username")).alias("peer")).alias("doc"),
        F.struct(F.transform("ids", lambda i: F.struct(i.alias("keyword"))).alias("keywords")).alias("extension"))
    return m.telegram(docs).select("nodeID", "parentID", "rootID", "informationID", "communityID")


def _twitter(s, d):
    """The trees as tweets; without followers only a user's own retweets link."""
    rows = cascades(s, d)
    null = F.lit(None).cast("string")
    docs = rows.select(
        F.col("node").alias("id_str_h"), F.struct(F.col("user").alias("id_str_h")).alias("user"), F.col("ts").cast("string").alias("created_at"),
        F.when(F.col("event") == "reply", F.col("parent")).otherwise("").alias("in_reply_to_status_id_str_h"),
        F.when(F.col("event") == "retweet", F.struct(F.col("root").alias("id_str_h"), null.alias("in_reply_to_status_id_str_h"))).alias("retweeted_status"),
        F.struct(F.array(F.lit("i")).alias("keywords")).alias("extension"))
    return m.twitter(docs).select("nodeID", "parentID", "rootID", "actionType", "informationID")


def _by_root(s, d):
    return reconstruct.reconstruct_by_root(_raw(s, d).drop("partialParentID"), _followers(s, d)).select("nodeID", "parentID", "rootID")


def _payload_text(s, d):
    docs = _github_docs(s, d)
    return docs.select(m.text_field(docs, F.col("event.type")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("value"))


_URL = r"regexp_extract_all({c}, '(?:https?:)(?:\/\/)?(?:[^@\n]+@)?(?:www\.)?([^:\/\n]+)', 1)"
assert DOMAIN in _URL
#: Parents of retweets among the rows of a cascade that are no replies, by ``ff`` (u, f): who follows whom, oneself included.
_FOUND = """, pt AS (SELECT * FROM tree WHERE event <> 'reply'),
el AS (SELECT a.root, a.node, b.node AS later, a.ts FROM pt a JOIN ff ON ff.u = a.u JOIN pt b ON b.root = a.root AND b.u = ff.f AND b.ts > a.ts),
w(root, node, l) AS (SELECT root, root, 0 FROM tree WHERE rn = 1 UNION SELECT w.root, el.later, w.l + 1 FROM w JOIN el ON el.root = w.root AND el.node = w.node),
m AS (SELECT root, node, max(l) AS l FROM w GROUP BY ALL),
fp AS (SELECT el.later AS node, arg_max(el.node, (m.l, el.ts)) AS p FROM el JOIN m ON m.root = el.root AND m.node = el.node GROUP BY el.later)
"""
_FF = """, fl AS (SELECT DISTINCT p.u AS u, x.u AS f FROM tree x JOIN tree p ON p.node = x.parent), ff AS (SELECT u, f FROM fl UNION SELECT u, u FROM ev)"""
_UPLINE = """, up AS (SELECT a.root, a.node, b.node AS above, b.seq FROM tree a, range(0, 24) r(k), tree b WHERE a.rn >> k >= 1 AND b.c = a.c AND b.rn = a.rn >> k)
"""

CATALOG = {
    "url_domains": (lambda s, d: table(s, d, "pages").select("page_id", F.explode(url_domains(F.col("url"))).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("value")),
        f"SELECT domain, count(*) AS value FROM (SELECT page_id, unnest({_URL.format(c='url')}) AS domain FROM pages) GROUP BY domain"),
    "url_domains_text": (lambda s, d: table(s, d, "pages").select("page_id", F.explode(url_domains(F.concat(F.lit("read "), "url", F.lit("\n"), F.substring("html", 1, 200), F.lit("\nthen "), "url"))).alias("domain")),
        f"SELECT page_id, unnest({_URL.format(c='t')}) AS domain FROM (SELECT page_id, 'read ' || url || chr(10) || substr(html, 1, 200) || chr(10) || 'then ' || url AS t FROM pages)"),
    "extract_github": (_github, with_(EV) + """SELECT DISTINCT c AS "nodeID", u AS "nodeUserID", ['PushEvent', 'IssuesEvent'][(seq % 3 + 1)::INTEGER] AS "actionType",
          strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "nodeTime", unnest(['i' || seq % 5, 'all']) AS "informationID", c || '.org' AS domains
        FROM ev WHERE seq % 3 < 2 AND ts >= '2024-01-05' AND ts < '2024-01-20'"""),
    "extract_text": (_payload_text, with_(EV) + """SELECT CASE WHEN seq % 3 = 2 THEN '' ELSE 'see https://' || c || '.org/x' END AS text, count(*) + count(*) FILTER (seq % 3 = 1) AS value FROM ev GROUP BY 1"""),
    "extract_reddit": (_reddit, with_(EV, TREE) + _UPLINE + """SELECT DISTINCT CASE WHEN t.rn = 1 THEN 't3_' ELSE 't1_' END || t.node AS "nodeID", CASE WHEN t.rn <= 3 THEN 't3_' ELSE 't1_' END || t.parent AS "parentID", 't3_' || t.root AS "rootID",
          CASE WHEN t.rn = 1 THEN 'post' ELSE 'comment' END AS "actionType", 'i' || up.seq % 5 AS "informationID" FROM up JOIN tree t ON t.node = up.node WHERE up.seq % 7 = 0"""),
    "extract_telegram": (_telegram, with_(EV, TREE) + _UPLINE + """SELECT DISTINCT t.c || '_' || t.rn AS "nodeID", t.c || '_' || greatest(t.rn // 2, 1) AS "parentID", t.c || '_1' AS "rootID", 'i' || up.seq % 5 AS "informationID", 'room' AS "communityID"
        FROM up JOIN tree t ON t.node = up.node WHERE up.seq % 7 = 0"""),
    "extract_twitter": (_twitter, with_(EV, TREE, recursive=True) + ", ff AS (SELECT DISTINCT u, u AS f FROM ev)" + _FOUND + """
        SELECT t.node AS "nodeID", CASE WHEN event = 'retweet' THEN coalesce(p, t.root) ELSE t.parent END AS "parentID", t.root AS "rootID", event AS "actionType", 'i' AS "informationID"
        FROM tree t LEFT JOIN fp ON fp.node = t.node"""),
    "reconstruction_by_root": (_by_root, with_(EV, TREE, recursive=True) + _FF + _FOUND + """, k AS (
          SELECT t.node, t.rn, t.c, t.root, event, CASE WHEN event = 'retweet' THEN p ELSE t.parent END AS parent FROM tree t LEFT JOIN fp ON fp.node = t.node WHERE event <> 'retweet' OR p IS NOT NULL),
        z(node, top) AS (SELECT node, parent FROM k UNION SELECT z.node, k.parent FROM z JOIN k ON k.node = z.top WHERE k.parent <> k.node),
        e AS (SELECT z.node, z.top FROM z LEFT JOIN k ON k.node = z.top WHERE k.node IS NULL OR k.parent = k.node)
        SELECT k.node AS "nodeID", k.parent AS "parentID", CASE WHEN event = 'reply' THEN e.top ELSE k.root END AS "rootID" FROM k JOIN e ON e.node = k.node"""),
    "liveliest_content": (lambda s, d: registry.liveliest(log(s, d)).select("root", F.col("value").cast("double").alias("value")), with_(EV) + """
        SELECT root, value::DOUBLE AS value FROM (SELECT c AS root, median(n) AS value FROM (SELECT c, event, count(*) AS n FROM ev GROUP BY ALL) GROUP BY c) ORDER BY value DESC, root LIMIT 1"""),
    "timestamps_iso": (lambda s, d: table(s, d, "events").select("event_id", iso_time(F.unix_seconds(F.col("ts").cast("timestamp")), "bigint").alias("seconds"), iso_time(F.unix_millis(F.col("ts").cast("timestamp")), "bigint").alias("millis")),
        "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS millis FROM events"),
    "preprocess": (lambda s, d: preprocess.canonical(table(s, d, "events").select(F.get_json_object("props", "$.k").alias("nodeID"), F.col("user_id").cast("string").alias("nodeUserID"), F.col("event_type").alias("actionType"), F.col("ts").alias("nodeTime")),
            "github", ["signup", "purchase", "view", "click"]).groupBy("event", F.date_format("time", "HH").alias("hour")).agg(F.count(F.lit(1)).alias("value")),
        with_(EV) + "SELECT event, strftime(t, '%H') AS hour, count(*) AS value FROM ev GROUP BY ALL"),
    "selected_content": (lambda s, d: preprocess.selected(log(s, d), [str(i) for i in range(10)], "root").groupBy("root").agg(F.count_distinct("user").alias("value")),
        with_(EV) + "SELECT c AS root, count(DISTINCT u) AS value FROM ev WHERE c::INT < 10 GROUP BY c"),
    "selected_users": (lambda s, d: preprocess.scope(log(s, d), True, [str(i) for i in range(10)], ["view"]).groupBy("user").agg(F.count(F.lit(1)).alias("value")),
        with_(EV) + """SELECT u AS "user", count(*) AS value FROM ev WHERE u::INT < 10 AND event = 'view' GROUP BY u"""),
    "empty_guard": (lambda s, d: preprocess.or_default(log(s, d).filter("event = 'none'").groupBy("event").agg(F.count(F.lit(1)).alias("value")), event="none", value=0), "SELECT 'none' AS event, 0::BIGINT AS value"),
    "reply_roots": (lambda s, d: reconstruct.reply_roots(_raw(s, d).withColumn("parentID", F.when(F.col("parentID") == "?", F.col("partialParentID")).otherwise(F.col("parentID")))).select("nodeID", "rootID"),
        with_(EV, TREE) + 'SELECT node AS "nodeID", root AS "rootID" FROM tree'),
    "retweet_parents": (_tree_parents, with_(EV, TREE, recursive=True) + """, fl AS (SELECT DISTINCT p.u AS u, x.u AS f FROM tree x JOIN tree p ON p.node = x.parent),
        ff AS (SELECT u, f FROM fl UNION SELECT u, u FROM ev),
        el AS (SELECT a.root, a.node, b.node AS later, a.ts FROM tree a JOIN ff ON ff.u = a.u JOIN tree b ON b.root = a.root AND b.u = ff.f AND b.ts > a.ts),
        w(root, node, l) AS (SELECT root, root, 0 FROM tree WHERE rn = 1 UNION SELECT w.root, el.later, w.l + 1 FROM w JOIN el ON el.root = w.root AND el.node = w.node),
        m AS (SELECT root, node, max(l) AS l FROM w GROUP BY ALL)
        SELECT el.later AS "nodeID", arg_max(el.node, (m.l, el.ts)) AS parent FROM el JOIN m ON m.root = el.root AND m.node = el.node GROUP BY el.later"""),
    "full_reconstruction": (lambda s, d: reconstruct.reconstruct(_raw(s, d), _followers(s, d)).select("nodeID", "parentID", "rootID"), with_(EV, TREE, recursive=True) + _FF + _FOUND + """
        SELECT t.node AS "nodeID", CASE WHEN event = 'retweet' THEN coalesce(p, t.root) ELSE t.parent END AS "parentID", t.root AS "rootID" FROM tree t LEFT JOIN fp ON fp.node = t.node"""),
    "info_ids": (lambda s, d: m.propagate(_threads(s, d)).select("nodeID", F.concat_ws(",", "informationIDs").alias("ids")), with_(EV, TREE) + _UPLINE + """
        SELECT node AS "nodeID", coalesce(string_agg(DISTINCT 'i' || seq % 5, ',' ORDER BY 'i' || seq % 5) FILTER (seq % 7 = 0), '') AS ids FROM up GROUP BY node"""),
    "info_rows": (lambda s, d: m.propagate(_threads(s, d)).select("nodeID", F.explode("informationIDs").alias("informationID")), with_(EV, TREE) + _UPLINE + """
        SELECT DISTINCT node AS "nodeID", 'i' || seq % 5 AS "informationID" FROM up WHERE seq % 7 = 0"""),
    "classify_tweets": (lambda s, d: m.twitter_rows(_tweets(s, d)).select("nodeID", "actionType", "parentID", "rootID", "partialParentID"), """
        SELECT event_id::VARCHAR AS "nodeID", ['reply', 'retweet', 'retweet', 'retweet', 'retweet', 'quote', 'quote', 'quote', 'tweet'][k + 1] AS "actionType",
          CASE k WHEN 0 THEN 'p' || event_id WHEN 8 THEN event_id::VARCHAR ELSE '?' END AS "parentID",
          CASE k WHEN 1 THEN 'r' || event_id WHEN 3 THEN 'q' || event_id WHEN 5 THEN 'q' || event_id WHEN 8 THEN event_id::VARCHAR ELSE '?' END AS "rootID",
          ['p', 'r', 'a', 'r', 'q', 'q', 'b', 'z', ''][k + 1] || event_id AS "partialParentID" FROM (SELECT event_id, (event_id % 9)::INTEGER AS k FROM events)"""),
    "user_alignment": (_names, """WITH RECURSIVE p AS (SELECT 'c' || c_custkey AS a, 's' || c_custkey % 40 AS b, 0.85 + (c_custkey % 13) / 100.0 AS score FROM customer WHERE c_custkey % 13 > 5),
        q AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, a) = 1),
        e AS (SELECT a, b FROM q UNION SELECT 's' || s_suppkey % 40, 'x' || s_suppkey % 7 FROM supplier), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        w(o, n) AS (SELECT a, a FROM s UNION SELECT w.o, s.b FROM w JOIN s ON s.a = w.n), m AS (SELECT o, min(n) AS c FROM w GROUP BY o)
        SELECT o AS username, c AS canonical FROM m WHERE o <> c"""),
    "keyword_map": (_keywords, with_(EV) + """SELECT CASE WHEN c::INT < 50 THEN 'topic' || c::INT % 3 ELSE 'Alias' || c END AS "informationID", count(*) AS value FROM ev GROUP BY 1"""),
}

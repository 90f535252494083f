"""Raw platform documents to canonical events with one information id a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions.scalar import iso_time, url_domains
from tributary.operators.reconstruct import reconstruct, reply_roots
from tributary.plans.components import components
from tributary.plans.scratch import Scratch
from tributary.sources.writers import json_lines

#: Event types that are extracted, and where each keeps its text in the payload.
GITHUB_EVENTS = ["PullRequestEvent", "IssuesEvent", "CreateEvent", "DeleteEvent", "WatchEvent", "ForkEvent",
                 "PullRequestReviewCommentEvent", "CommitCommentEvent", "PushEvent", "IssueCommentEvent"]
GITHUB_TEXT = {"PullRequestEvent": "pull_request.body_m", "IssuesEvent": "issue.body_m", "CreateEvent": "description_m", "PullRequestReviewCommentEvent": "comment.body_m",
               "ForkEvent": "forkee.description_m", "IssueCommentEvent": "comment.body_m", "CommitCommentEvent": "comment.body_m"}
#: The platforms whose documents tell of an information type.
PLATFORMS = {"Coins": ["telegram", "twitter"], "CVE": ["reddit", "twitter", "github"], "Malware": ["reddit", "twitter"], "URL": ["reddit", "twitter"]}
OUTPUT = ["nodeID", "nodeUserID", "parentID", "rootID", "actionType", "nodeTime", "urlDomains", "informationIDs", "platform", "communityID"]


@dataclass(frozen=True)
class Names:
    """Where documents keep what was added to them: information ids, their domain, and the list of such additions of an event."""

    ids: str = "extension.keywords"
    domain: str = "extension.domain"
    details: str = "details"


NAMES = Names()


def field(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A nested field, null of the type where the schema lacks it."""
    schema = df.schema
    for part in path.split("."):
        names = getattr(schema, "names", None)
        if names is None or part not in names:
            return F.lit(None).cast(kind)
        schema = schema[part].dataType
    return F.col(path)


def merged_ids(*lists: Column) -> Column:
    """Distinct ids of several lists, sorted; null lists are empty."""
    empty = F.array().cast("array<string>")
    return F.sort_array(F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in lists])))


def text_field(df: DataFrame, event: Column, payload: str = "payload") -> Column:
    """A GitHub event's text: by type a path of the payload, for pushes the messages of all commits."""
    commits = field(df, f"{payload}.commits", "array<struct<message_m:string>>")
    out = F.when(event == "PushEvent", F.concat_ws(" ", F.transform(commits, lambda c: c["message_m"])))
    for name, path in GITHUB_TEXT.items():
        out = out.when(event == name, F.coalesce(field(df, f"{payload}.{path}"), F.lit("")))
    return F.coalesce(out.otherwise(""), F.lit(""))


def renamed(df: DataFrame, names: DataFrame | None, column: str = "nodeUserID") -> DataFrame:
    """``column`` through the map (username, canonical)."""
    if names is None:
        return df
    wide = df.join(names.withColumnsRenamed({"username": column, "canonical": "__canonical"}), column, "left")
    return wide.withColumn(column, F.coalesce("__canonical", column)).select(*df.columns)


def user_alignment(scored: DataFrame, external: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    """Pairs (username1, username2, score) above ``least``, the best of each side, with external pairs: (username, canonical), canonical the smallest of a component."""
    good = scored.filter((F.col("score") > least) & F.col("username1").isNotNull() & F.col("username2").isNotNull())
    best = lambda df, c, o: df.withColumn("rn", F.row_number().over(W.partitionBy(c).orderBy(F.desc("score"), o))).filter("rn = 1").drop("rn")
    pairs = best(best(good, "username2", "username1"), "username1", "username2").select("username1", "username2")
    if external is not None:
        pairs = pairs.unionByName(external.select("username1", "username2").dropna())
    edges = pairs.filter("username1 != username2").distinct().select(F.col("username1").alias("a"), F.col("username2").alias("b"))
    return components(edges, Scratch(scored.sparkSession, "names")).select(F.col("node").alias("username"), F.col("root").alias("canonical"))


def propagate(rows: DataFrame, rounds: int = 64) -> DataFrame:
    """Each row's informationIDs with those of all its ancestors (nodeID, parentID, rootID).

    In each round a node takes the ids of the node that its pointer leads to, and the pointer doubles its reach; after rounds
    enough for all nodes the pointers that are left run in circles, whose nodes share their ids.
    """
    scratch = Scratch(rows.sparkSession, "handed")
    up = rows.select(F.col("nodeID").alias("node"), F.col("parentID").alias("up")).dropDuplicates(["node"]).filter("up is not null and node != up")
    up = scratch.save(up.join(rows.select(F.col("nodeID").alias("up")).distinct(), "up", "left_semi").select("node", "up"), "up0")
    ids = scratch.save(rows.select(F.col("nodeID").alias("node"), F.explode("informationIDs").alias("id")).distinct(), "ids0")
    n, k = up.count(), 0
    while k < rounds and not up.isEmpty():
        handed = up.join(ids.withColumnRenamed("node", "up"), "up").select("node", "id")
        new_ids = scratch.save(ids.unionByName(handed).distinct(), f"ids{k + 1}")
        if (1 << k) > n:
            ids = new_ids
            break
        over = up.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        new_up = scratch.save(up.join(over, "up").select("node", F.col("up2").alias("up")), f"up{k + 1}")
        scratch.drop(f"ids{k}", f"up{k}")
        ids, up, k = new_ids, new_up, k + 1
    handed = ids.groupBy(F.col("node").alias("nodeID")).agg(F.collect_set("id").alias("handed"))
    return rows.join(handed, "nodeID", "left").withColumn("informationIDs", merged_ids(F.col("informationIDs"), F.col("handed"))).select(*rows.columns)


def per_information(rows: DataFrame) -> DataFrame:
    """A row for each information id; rows without any drop out; times in ISO text."""
    kind = dict(rows.dtypes)["nodeTime"]
    return rows.withColumn("informationID", F.explode("informationIDs")).drop("informationIDs").withColumn("nodeTime", iso_time(F.col("nodeTime"), kind))


def keyword_map(rows: DataFrame, aliases: DataFrame, column: str = "informationID") -> DataFrame:
    """``column`` through (alias, name), in any case; ids without an alias stay."""
    m = aliases.select(F.lower("alias").alias("__alias"), F.col("name").alias("__name")).dropDuplicates(["__alias"])
    wide = rows.join(m, F.lower(rows[column]) == F.col("__alias"), "left")
    return wide.withColumn(column, F.coalesce("__name", column)).drop("__alias", "__name")


def unbroken(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose parent and root are rows."""
    for c in columns:
        rows = rows.join(rows.select(F.col("nodeID").alias(c)).distinct(), c, "left_semi").select(*rows.columns)
    return rows


def telegram(docs: DataFrame, names: DataFrame | None = None, start: str | None = None, end: str | None = None, at: Names = NAMES) -> DataFrame:
    """Messages of channels: a reply's parent is in its channel; forwards' parents are overwritten by it, as in the data's contract."""
    docs = _between(docs, field(docs, "norm.timestamp"), start, end)
    channel = field(docs, "doc.to_id.channel_id").cast("string")
    node = F.concat_ws("_", channel, field(docs, "doc.id").cast("string"))
    reply = field(docs, "doc.reply_to_msg_id").cast("string")
    parent = F.when(reply.isNotNull(), F.concat_ws("_", channel, reply))
    words = F.transform(field(docs, at.ids, "array<struct<keyword:string>>"), lambda k: k["keyword"])
    rows = docs.dropDuplicates(["uid_h"]).select(
        node.alias("nodeID"), F.coalesce(field(docs, "doc.from_id_h"), field(docs, "norm.author")).alias("nodeUserID"), F.coalesce(parent, node).alias("parentID"),
        F.when(parent.isNull(), node).otherwise("?").alias("rootID"), F.lit("message").alias("actionType"), field(docs, "norm.timestamp").alias("nodeTime"),
        url_domains(field(docs, "norm.body_m")).alias("urlDomains"), merged_ids(words).alias("informationIDs"), F.lit("telegram").alias("platform"),
        field(docs, "doc.peer.username").alias("communityID"))
    rows = unbroken(reply_roots(unbroken(renamed(rows, names), "parentID")), "rootID")
    return per_information(propagate(rows)).filter("communityID is not null")


def reddit(comments: DataFrame, posts: DataFrame, names: DataFrame | None = None, domains: list[str] | None = None,
           start: str | None = None, end: str | None = None, at: Names = NAMES) -> DataFrame:
    """Comments (of repeated ids the one with most information) and posts; ids of other domains than ``domains`` lose their information."""
    comments, posts = (_between(df, field(df, "created_date"), start, end) for df in (comments, posts))

    def ids(df):
        own = merged_ids(field(df, at.ids, "array<string>"))
        return own if not domains else F.when(field(df, at.domain).isin(domains), own).otherwise(F.array().cast("array<string>"))

    c = comments.withColumn("__ids", ids(comments)).withColumn("__rn", F.row_number().over(W.partitionBy("id_h").orderBy(F.size("__ids").desc(), "created_utc"))).filter("__rn = 1")
    one = c.select(F.concat(F.lit("t1_"), "id_h").alias("nodeID"), F.col("author_h").alias("nodeUserID"), F.col("parent_id_h").alias("parentID"), F.col("link_id_h").alias("rootID"),
                   F.lit("comment").alias("actionType"), F.col("created_utc").alias("nodeTime"), url_domains(F.col("body_m")).alias("urlDomains"), F.col("__ids").alias("informationIDs"),
                   F.lit("reddit").alias("platform"), F.col("subreddit_id").alias("communityID"))
    node = F.concat(F.lit("t3_"), F.col("id_h"))
    two = posts.withColumn("__ids", ids(posts)).select(node.alias("nodeID"), F.col("author_h").alias("nodeUserID"), node.alias("parentID"), node.alias("rootID"), F.lit("post").alias("actionType"),
                       F.col("created_utc").alias("nodeTime"), url_domains(F.col("selftext_m")).alias("urlDomains"), F.col("__ids").alias("informationIDs"), F.lit("reddit").alias("platform"), F.col("subreddit_id").alias("communityID"))
    return per_information(propagate(unbroken(renamed(one.unionByName(two), names), "parentID", "rootID")))


def classify(df: DataFrame) -> Column:
    """The nine kinds of tweets by what they reply to, retweet and quote."""
    text = lambda p: F.nullif(field(df, p), F.lit(""))
    reply = text("in_reply_to_status_id_str_h").isNotNull()
    retweet, quote = field(df, "retweeted_status.id_str_h").isNotNull(), field(df, "quoted_status.id_str_h").isNotNull()
    quoted_reply, quoted_quote = text("quoted_status.in_reply_to_status_id_str_h").isNotNull(), F.coalesce(field(df, "quoted_status.is_quote_status", "boolean"), F.lit(False))
    return (
        F.when(reply, "reply")
        .when(retweet & text("retweeted_status.in_reply_to_status_id_str_h").isNotNull(), "retweet_of_reply")
        .when(retweet & quote & ~quoted_reply, "retweet_of_quote")
        .when(retweet & quote, "retweet_of_quote_of_reply")
        .when(retweet, "retweet")
        .when(quote & quoted_reply, "quote_of_reply")
        .when(quoted_quote, "quote_of_quote")
        .when(quote, "quote")
        .otherwise("tweet")
    )


def twitter_rows(df: DataFrame, at: Names = NAMES) -> DataFrame:
    """Type, parent, root and partial parent of each tweet: retweets and quotes know where their cascade starts, replies their parent."""
    kind = classify(df)
    rt, qt = field(df, "retweeted_status.id_str_h"), field(df, "quoted_status.id_str_h")
    node, answered = F.col("id_str_h"), field(df, "in_reply_to_status_id_str_h")
    part = (F.when(kind == "reply", answered).when(kind.isin("retweet", "retweet_of_quote"), rt).when(kind == "retweet_of_reply", field(df, "retweeted_status.in_reply_to_status_id_str_h"))
            .when(kind.isin("retweet_of_quote_of_reply", "quote"), qt).when(kind == "quote_of_reply", field(df, "quoted_status.in_reply_to_status_id_str_h"))
            .when(kind == "quote_of_quote", field(df, "quoted_status.quoted_status_id_str")).otherwise(node))
    root = F.when(kind == "tweet", node).when(kind == "retweet", rt).when(kind.isin("retweet_of_quote", "quote"), qt).otherwise("?")
    urls = field(df, "entities.urls", "array<struct<expanded_url_h:string>>")
    return df.select(
        node.alias("nodeID"), field(df, "user.id_str_h").alias("nodeUserID"), F.when(kind == "reply", answered).when(kind == "tweet", node).otherwise("?").alias("parentID"), root.alias("rootID"),
        F.when(kind.startswith("retweet"), "retweet").when(kind.startswith("quote"), "quote").otherwise(kind).alias("actionType"), F.col("created_at").alias("nodeTime"), part.alias("partialParentID"),
        F.filter(F.transform(urls, lambda u: F.get(url_domains(u["expanded_url_h"]), F.lit(0))), lambda u: u.isNotNull()).alias("urlDomains"),
        merged_ids(field(df, at.ids, "array<string>")).alias("informationIDs"), F.lit("twitter").alias("platform"))


def twitter(df: DataFrame, names: DataFrame | None = None, followers: DataFrame | None = None, start: str | None = None, end: str | None = None, at: Names = NAMES) -> DataFrame:
    """Tweets, their cascades reconstructed; a range is over ``timestamp_ms``, milliseconds as text or number."""
    ms = field(df, "timestamp_ms").cast("bigint")
    for day, keep in ((start, lambda x: ms >= x), (end, lambda x: ms < x)):
        if day:
            df = df.filter(keep(F.unix_millis(F.lit(f"{day}T00:00:00Z").cast("timestamp"))))
    rows = reconstruct(renamed(twitter_rows(df, at), names), followers)
    return per_information(propagate(rows).drop("partialParentID"))


def github(events: DataFrame, names: DataFrame | None = None, start: str | None = None, end: str | None = None, at: Names = NAMES) -> DataFrame:
    """Events (nested under ``event`` or flat) of the extracted types, one row an information id, repeated rows once whatever their domains."""
    below = "event." if "event" in events.columns else ""
    events = _between(events, field(events, f"{below}created_at"), start, end)
    kind = field(events, f"{below}type")
    path = at.ids.split(".")
    shape = "array<string>"
    for part in reversed(path):
        shape = f"struct<{part}:{shape}>"
    details = field(events, at.details, f"array<{shape}>")

    def ids(m):
        for part in path:
            m = m[part]
        return m

    rows = events.select(
        field(events, f"{below}repo.name_h").alias("nodeID"), field(events, f"{below}actor.login_h").alias("nodeUserID"), kind.alias("actionType"), field(events, f"{below}created_at").alias("nodeTime"),
        merged_ids(F.flatten(F.transform(details, ids))).alias("informationIDs"), url_domains(text_field(events, kind)).alias("urlDomains"), F.lit("github").alias("platform"))
    rows = per_information(renamed(rows.filter(F.col("actionType").isin(GITHUB_EVENTS)), names))
    return rows.dropDuplicates([c for c in rows.columns if c != "urlDomains"])


def _between(df: DataFrame, time: Column, start: str | None, end: str | None) -> DataFrame:
    """start <= time < end, by days as ISO text."""
    if start:
        df = df.filter(time >= f"{start}T00:00:00Z")
    return df.filter(time < f"{end}T00:00:00Z") if end else df


def ground_truth(sources: dict[str, DataFrame], aliases: DataFrame | None = None, info_type: str | None = None, folder: str | None = None) -> DataFrame:
    """Extracted platforms (name to rows) in one table; of an information type those of PLATFORMS, others are left out.

    Ids are mapped to their names by ``aliases`` where the type is Coins or none is given, and repeated (node, id) go then.
    With ``folder`` the rows are also written there as JSON lines.
    """
    if info_type is not None and info_type not in PLATFORMS:
        raise ValueError(f"no platforms are known for {info_type}: one of {sorted(PLATFORMS)}")
    out = None
    for name, rows in sources.items():
        if info_type is None or name in PLATFORMS[info_type]:
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"none of {sorted(sources)} belongs to {info_type}")
    if aliases is not None and info_type in (None, "Coins"):
        out = keyword_map(out, aliases)
        out = out.dropDuplicates([c for c in ("platform", "nodeID", "informationID") if c in out.columns]) if info_type else out
    if folder:
        json_lines(out, folder)
    return out

"""Configured measurements by platform, their metrics, and the runs over one log or two.

A specification is data: a name, a scale (population, node, community or te),
what to measure and which metrics compare it.  Domains and scenarios override
a few parameters of the platform's base, instead of copying it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import cascade, community, content, influence, metrics, network, preprocess, user
from tributary.operators.preprocess import CONTRIBUTION, CREATION, POPULARITY


@dataclass
class Inputs:
    """One log and what measurements derive from it; derived tables are planned once."""

    log: DataFrame
    platform: str = "github"
    members: DataFrame | None = None
    accounts: DataFrame | None = None  # user, created_at, country
    contents: DataFrame | None = None  # root, created_at
    previous: DataFrame | None = None
    contribution: list[str] = field(default_factory=lambda: CONTRIBUTION)
    popularity: list[str] = field(default_factory=lambda: POPULARITY)
    creation: list[str] = field(default_factory=lambda: CREATION)
    te: dict = field(default_factory=dict)

    @cached_property
    def by_community(self) -> DataFrame:
        return preprocess.communities(self.log, self.members, "subreddit" if self.platform == "reddit" else None)

    @cached_property
    def tree(self) -> DataFrame:
        own = "community" if "community" in self.log.columns else "subreddit" if "subreddit" in self.log.columns else None
        return self.log.select(F.col("content").alias("node"), F.coalesce("parent", "content").alias("parent"), "root", "user", "ts", "seq", "event", (F.col(own) if own else F.lit("all")).alias("community"))

    @cached_property
    def edges(self) -> DataFrame:
        if self.platform == "github":
            return network.projection_edges(self.log.select(F.col("user").alias("node"), F.col("content").alias("shared")))
        return network.reply_edges(self.tree)

    @cached_property
    def hours(self) -> DataFrame:
        """Cascades' series by hour, shared by all measurements of one of its columns."""
        return cascade.timeseries(self.tree, "hour")

    @cached_property
    def levels(self) -> DataFrame:
        return cascade.by_depth(self.tree)

    @cached_property
    def summaries(self) -> DataFrame:
        return cascade.summary(self.tree)

    def types(self, which: str | None) -> list[str] | None:
        return {None: None, "contribution": self.contribution, "popularity": self.popularity, "all": [*self.contribution, *self.popularity],
                "popularity+create": [*self.popularity, *self.creation]}.get(which, [which])


Measure = Callable[[Inputs, dict], DataFrame]


@dataclass(frozen=True)
class Spec:
    name: str
    scale: str
    node_type: str
    measure: Measure
    metrics: tuple[str, ...]
    args: dict = field(default_factory=dict, hash=False)
    key: str | None = None  # the column of nodes or communities
    family: str = "baseline"
    scenario1: bool = True
    scenario2: bool = True


#: Name to metric of (ground truth, simulation, group).
METRICS: dict[str, Callable] = {
    "js_divergence": lambda g, s, k, a: metrics.js_divergence(g, s, False, group=k),
    "js_divergence_discrete": lambda g, s, k, a: metrics.js_divergence(g, s, True, group=k),
    "kl_divergence": lambda g, s, k, a: metrics.kl_divergence(g, s, False, group=k),
    "rmse": lambda g, s, k, a: metrics.rmse(g, s, group=k),
    "rmse_outer": lambda g, s, k, a: metrics.rmse(g, s, "full_outer", group=k),
    "rmse_ffill": lambda g, s, k, a: metrics.rmse(g, s, "full_outer", "ffill", group=k),
    "nrmse": lambda g, s, k, a: metrics.rmse(g, s, relative=True, group=k),
    "nrmse_ffill": lambda g, s, k, a: metrics.rmse(g, s, "full_outer", "ffill", True, group=k),
    "r2": lambda g, s, k, a: metrics.r2(g, s, group=k),
    "r2_ffill": lambda g, s, k, a: metrics.r2(g, s, "full_outer", "ffill", group=k),
    "ks_test": lambda g, s, k, a: metrics.ks_test(g, s, k),
    "dtw": lambda g, s, k, a: metrics.dtw(g, s, k),
    "rbo": lambda g, s, k, a: metrics.rbo(g, s, a.get("p", 0.95), group=k),
    "rbo_mean": lambda g, s, k, a: metrics.rbo_mean(g, s, ["grp"], a.get("wt", 0.9), a.get("ct", 30)),
    "absolute_difference": lambda g, s, k, a: metrics.absolute_difference(g, s, k),
    "absolute_percentage_error": lambda g, s, k, a: metrics.absolute_percentage_error(g, s, k),
}
_FIT, _SERIES, _GAP = ("rmse", "nrmse", "r2"), ("rmse_outer", "nrmse", "dtw"), ("absolute_difference", "absolute_percentage_error")
_FFILL = ("rmse_ffill", "nrmse_ffill", "r2_ffill")


def _specs(*rows) -> dict[str, Spec]:
    return {s.name: s for s in rows}


def _user(name, measure, metric_names, scale="population", **args):
    return Spec(name, scale, "user", measure, metric_names, args, "user" if scale == "node" else None)


def _content(name, measure, metric_names, scale="population", **args):
    return Spec(name, scale, "content", measure, metric_names, args, args.get("field", "root") if scale == "node" else None)


def _community(name, measure, metric_names, node_type="content", **args):
    return Spec(name, "community", node_type, measure, metric_names, args, "community")


def _counts(i: Inputs, a: dict) -> DataFrame:
    return content.counts_by(i.log, "root", i.types(a["events"]))


def _top(i: Inputs, a: dict) -> DataFrame:
    return content.top(i.log, i.types(a["events"]), a["k"])


def _gini(i: Inputs, a: dict) -> DataFrame:
    return content.gini_of(i.log, a.get("node", "root"), i.types(a["events"]))


def _palma(i: Inputs, a: dict) -> DataFrame:
    return content.palma_of(i.log, a.get("node", "root"), i.types(a["events"]))


def _users(k: int, p: float, k_pop: int, p_pop: float, events: str, pop: str) -> list[Spec]:
    return [
        _user("user_unique_content", lambda i, a: user.unique_content(i.log, i.types(a["events"])), ("js_divergence", *_FIT), events=events),
        _user("user_activity_timeline", lambda i, a: user.activity_timeline(i.log, i.types(a["events"])), ("rmse", "nrmse", "ks_test", "dtw"), "node", events=events),
        _user("user_activity_distribution", lambda i, a: user.activity_distribution(i.log, i.types(a["events"])), (*_FIT, "js_divergence_discrete"), events="all"),
        _user("most_active_users", lambda i, a: user.most_active(i.log, i.types(a["events"]), a["k"]), ("rbo",), events="all", k=k, p=p),
        _user("user_popularity", lambda i, a: user.popularity(i.log, i.types(a["events"]), a["k"], i.creation), ("rbo",), events=pop, k=k_pop, p=p_pop),
        _user("user_gini_coef", _gini, _GAP, events=events, node="user"),
        _user("user_palma_coef", _palma, _GAP, events=events, node="user"),
    ]


def _disparity(*pairs: tuple[str, str]) -> list[Spec]:
    out = []
    for label, event in pairs:
        out += [_content(f"content_activity_disparity_gini_{label}", _gini, _GAP, events=event), _content(f"content_activity_disparity_palma_{label}", _palma, _GAP, events=event)]
    return out


def _communities(events: str) -> list[Spec]:
    ev = lambda i, a: i.types(a.get("events"))
    return [
        _community("community_gini", lambda i, a: content.gini_of(i.by_community, "root", keys=["community"]), _GAP),
        _community("community_palma", lambda i, a: content.palma_of(i.by_community, "root", keys=["community"]), _GAP),
        _community("community_event_proportions", lambda i, a: community.event_proportion(i.by_community, ev(i, a)), ("js_divergence_discrete",), events="all"),
        _community("community_contributing_users", lambda i, a: community.contributing_users(i.by_community, contribution=i.contribution), _GAP, "user"),
        _community("community_num_user_actions", lambda i, a: community.user_actions(i.by_community, ev(i, a), "day"), (*_SERIES, "js_divergence"), "user", events=events),
        _community("community_burstiness", lambda i, a: community.bursts(i.by_community, ev(i, a)), _GAP, events="all"),
        _community("community_user_burstiness", lambda i, a: community.user_bursts(i.by_community), ("ks_test",), "user"),
    ]


def _github() -> dict[str, Spec]:
    return _specs(
        *_users(700, 0.993, 200, 0.975, "contribution", "popularity+create"),
        _user("user_diffusion_delay", lambda i, a: user.diffusion_delay(i.log, i.types(a["events"]), created=i.accounts).select("user", "value"), ("ks_test",), events="contribution"),
        _user("user_trustingness", lambda i, a: user.acceptance(i.log, ["PullRequestEvent"]), ("ks_test",)),
        _content("content_diffusion_delay", lambda i, a: content.diffusion_delay(i.log, i.types("popularity"), "h", i.contents).select("root", "value"), ("ks_test", "js_divergence"), "node"),
        _content("content_growth", lambda i, a: content.growth(i.log, i.types("contribution")), _SERIES, "node"),
        _content("content_contributors", lambda i, a: content.contributors(i.log, i.types("contribution")), _SERIES, "node"),
        _content("content_event_distribution_daily", lambda i, a: content.event_distribution(i.log), ("js_divergence_discrete",), "node"),
        _content("content_event_distribution_dayofweek", lambda i, a: content.event_distribution(i.log, "weekday"), ("js_divergence_discrete",), "node"),
        _content("content_popularity_distribution", _counts, ("js_divergence", *_FIT), events="WatchEvent"),
        _content("content_popularity_topk", _top, ("rbo",), events="WatchEvent", k=125, p=0.96),
        _content("content_liveliness_distribution", _counts, ("js_divergence", *_FIT), events="ForkEvent"),
        _content("content_liveliness_topk", _top, ("rbo",), events="ForkEvent", k=50, p=0.9),
        *_disparity(("fork", "ForkEvent"), ("push", "PushEvent"), ("pullrequest", "PullRequestEvent"), ("issue", "IssuesEvent")),
        _content("repo_trustingness", lambda i, a: user.acceptance(i.log, ["PullRequestEvent"], per_user=False), ("ks_test",)),
        _content("repo_issue_to_push", lambda i, a: content.event_type_ratio(i.log, "IssuesEvent", "PushEvent", i.types("contribution"), i.previous), ("rmse", "nrmse"), "node"),
        _content("repo_event_counts_issue", _counts, ("js_divergence", *_FIT), events="IssuesEvent"),
        _content("repo_event_counts_pull_request", _counts, ("js_divergence", *_FIT), events="PullRequestEvent"),
        _content("repo_event_counts_push", _counts, ("js_divergence", *_FIT), events="PushEvent"),
        _content("repo_user_continue_prop", lambda i, a: content.user_continues(i.log, i.types("contribution"), i.previous), ("rmse", "nrmse"), "node"),
        *_communities("contribution"),
        _community("community_geo_locations", lambda i, a: community.geo_location(i.by_community, i.accounts, i.types("contribution")), ("js_divergence",), "user"),
        _community("community_issue_types", lambda i, a: community.issue_actions(i.by_community), (*_SERIES[:2], "js_divergence_discrete")),
        _community("community_user_account_ages", lambda i, a: community.account_age(i.by_community, i.accounts).select("community", "value"), ("ks_test",), "user"),
    )


def _reddit() -> dict[str, Spec]:
    return _specs(
        *_users(1500, 0.9965, 1500, 0.9965, "all", "all"),
        _content("content_liveliness_distribution", _counts, ("js_divergence",), events="comment"),
        *_disparity(("comment", "comment")),
        _content("subreddit_user_continue_prop", lambda i, a: content.user_continues(i.log, ["comment", "post"], i.previous, "subreddit"), ("rmse", "nrmse"), "node", field="subreddit"),
        _content("subreddit_post_to_comment", lambda i, a: content.event_type_ratio(i.log, "post", "comment", None, i.previous, "subreddit"), ("rmse", "nrmse"), "node", field="subreddit"),
        *_communities("all"),
        # off in the base, on in the second scenario
        *[replace(s, scenario1=False) for s in (
            _content("content_diffusion_delay", lambda i, a: content.diffusion_delay(i.log, ["comment"], "h").select("root", "value"), ("ks_test", "js_divergence"), "node"),
            _content("content_growth", lambda i, a: content.growth(i.log, ["comment"], "hour"), _SERIES, "node"),
            _content("content_contributors", lambda i, a: content.contributors(i.log, ["comment"]), _SERIES, "node"),
            _content("content_liveliness_topk", _top, ("rbo",), events="comment", k=100, p=0.95))],
    )


def _twitter() -> dict[str, Spec]:
    return _specs(
        *_users(5000, 0.999, 4000, 0.9987, "all", "all"),
        _content("content_liveliness_distribution", _counts, ("js_divergence",), events="reply"),
        _content("content_popularity_distribution", _counts, ("js_divergence",), events="retweet"),
        *_disparity(("retweet", "retweet"), ("quote", "quote"), ("reply", "reply")),
        *[replace(s, scenario1=False) for s in (
            _content("content_diffusion_delay", lambda i, a: content.diffusion_delay(i.log, i.types("popularity"), "h").select("root", "value"), ("ks_test", "js_divergence"), "node"),
            _content("content_growth", lambda i, a: content.growth(i.log, i.types("popularity"), "hour"), _SERIES, "node"),
            _content("content_contributors", lambda i, a: content.contributors(i.log, i.types("popularity")), _SERIES, "node"),
            _content("content_popularity_topk", _top, ("rbo",), events="retweet", k=10, p=0.58))],
    )


def _cascades() -> dict[str, Spec]:
    def one(name, scale, measure, metric_names, key=None):
        return Spec(name, scale, "content", measure, metric_names, {}, key, "cascade", scenario1=False)

    def series(kind, column):
        if kind == "timeseries":
            return lambda i, a: i.hours.select("root", "timestamp", F.col(column).cast("double").alias("value"))
        return lambda i, a: i.levels.select("root", "depth", F.col(column).cast("double").alias("value"))

    def distribution(column, keys=()):
        def run(i, a):
            table = i.summaries.select(F.col("root"), F.col(column).cast("double").alias("value"))
            return table.join(i.tree.filter("node = root").select("root", *keys), "root").select(*keys, "root", "value") if keys else table

        return run

    out = []
    for name, column in (("cascade_max_depth_over_time", "depth"), ("cascade_breadth_by_time", "breadth"), ("cascade_structural_virality_over_time", "structural_virality"),
                         ("cascade_size_over_time", "size"), ("cascade_uniq_users_by_time", "unique_nodes"), ("cascade_new_user_ratio_by_time", "new_node_ratio")):
        out.append(one(name, "node", series("timeseries", column), _FFILL, "root"))
    for name, column in (("cascade_breadth_by_depth", "breadth"), ("cascade_new_user_ratio_by_depth", "new_node_ratio"), ("cascade_uniq_users_by_depth", "unique_nodes")):
        out.append(one(name, "node", series("by_depth", column), _FFILL, "root"))
    out += [one("cascade_participation_gini", "node", lambda i, a: cascade.participation_gini(i.tree, ["root"]), _GAP, "root"),
            one("cascade_participation_palma", "node", lambda i, a: cascade.participation_palma(i.tree, ["root"]), _GAP, "root")]
    for scale, keys in (("community", ("community",)), ("population", ())):
        key, k = (keys or (None,))[0], list(keys)
        for label, column in (("max_depth", "depth"), ("max_breadth", "breadth"), ("structural_virality", "structural_virality"), ("cascade_size", "size"), ("cascade_lifetime", "lifetime")):
            out.append(one(f"{scale}_{label}_distribution", scale, distribution(column, keys), ("js_divergence",), key))
        out += [one(f"{scale}_cascade_size_timeseries", scale, lambda i, a, k=k: cascade.size_timeseries(i.tree, "day", k, i.summaries), _FFILL, key),
                one(f"{scale}_cascade_lifetime_timeseries", scale, lambda i, a, k=k: cascade.lifetime_timeseries(i.tree) if not k else _lifetimes(i.tree), _FFILL, key)]
        if keys:
            out += [one(f"community_{name}_by_time", scale, lambda i, a, c=c: cascade.community_users(i.tree).select("community", "timestamp", F.col(c).cast("double").alias("value")), _FFILL, key)
                    for name, c in (("unique_users", "unique_users"), ("new_user_ratio", "new_user_ratio"))]
        for label, roots in (("initialization", True), ("participation", False)):
            out += [one(f"{scale}_cascade_{label}_gini", scale, lambda i, a, k=k, r=roots: cascade.participation_gini(i.tree, k, r), _GAP, key),
                    one(f"{scale}_cascade_{label}_palma", scale, lambda i, a, k=k, r=roots: cascade.participation_palma(i.tree, k, r), _GAP, key)]
    return _specs(*out)


def _lifetimes(tree: DataFrame) -> DataFrame:
    """Rows per root among root rows by community and day."""
    roots = tree.filter("node = root").groupBy("community", F.date_trunc("day", "ts").alias("timestamp"), "root").agg(F.count(F.lit(1)).alias("n"))
    return roots.groupBy("community", "timestamp").agg(F.avg("n").alias("value"))


def _networks() -> dict[str, Spec]:
    def one(name, measure, metric_names=_GAP):
        return Spec(name, "population", "user", measure, metric_names, {}, None, "network")

    of = lambda c: lambda i, a: network.degree_summary(i.edges).select(F.col(c).cast("double").alias("value"))
    return _specs(
        one("number_of_nodes", lambda i, a: network.number_of_nodes(i.edges)), one("number_of_edges", lambda i, a: network.number_of_edges(i.edges)), one("density", of("density")),
        one("mean_shortest_path_length", lambda i, a: network.mean_path(i.edges, 500)), one("assortativity_coefficient", lambda i, a: network.assortativity(i.edges)),
        one("number_of_connected_components", lambda i, a: network.number_of_components(i.edges)), one("average_clustering_coefficient", lambda i, a: network.clustering(i.edges)),
        one("max_node_degree", of("max_degree")), one("mean_node_degree", of("mean_degree")),
        one("degree_distribution", lambda i, a: network.degrees(i.edges).withColumnRenamed("degree", "value"), ("js_divergence_discrete",)),
        one("community_modularity", lambda i, a: network.modularity(i.edges)))


def _influence() -> dict[str, Spec]:
    """Opt-in: not part of a platform's run."""

    def pairs(i: Inputs, entity: str, events: bool = False) -> DataFrame:
        t = {"startTime": "2015-01-01", "binSize": 10_800, "delayUnits": [1], "bins": 240, "starEvent": None, "otherEvents": None, "kE": 50, "kN": 50, **i.te}
        series = influence.offsets(i.by_community, t["startTime"], entity)
        src = influence.offsets(i.by_community, t["startTime"], entity, events=[t["starEvent"]]) if events and t["starEvent"] else series
        dst = influence.offsets(i.by_community, t["startTime"], entity, events=t["otherEvents"]) if events and t["otherEvents"] else series
        binned = influence.bins(series, t["binSize"], t["bins"] - 1)
        found = influence.pairs(binned, t["bins"], t["delayUnits"], influence.active(src, 20), influence.active(dst, 20))
        if t.get("nReps"):
            found = influence.significant(binned, found, t["bins"], t["teThresh"][0], t["nReps"])
        return found

    def edges(entity, events=False):
        return lambda i, a: influence.strongest(pairs(i, entity, events), i.te.get("kE", 50), 1)[0].select("grp", F.concat_ws("-", "src", "dst").alias("pair"), "value")

    def totals(entity):
        return lambda i, a: influence.strongest(pairs(i, entity), 1, i.te.get("kN", 50))[1].select("grp", F.col("src").alias("entity"), "value")

    def one(name, node, measure, wt, ct):
        return Spec(name, "te", node, measure, ("rbo_mean",), {"wt": wt, "ct": ct}, None, "te")

    return _specs(one("user_interactions", "user", edges("user"), 0.9, 30), one("user_total", "user", totals("user"), 0.75, 10), one("user_event_interactions", "user", edges("user", True), 0.9, 25),
                  one("repo_interactions", "content", edges("content"), 0.9, 30), one("repo_total", "content", totals("content"), 0.75, 10))


BASE = {"github": _github(), "reddit": _reddit(), "twitter": _twitter()}
CASCADE, NETWORK, INFLUENCE = _cascades(), _networks(), _influence()
#: Fixed values: (k, p) of ranked lists by platform, domain and scenario where they differ from the base.
OVERRIDES = {
    ("reddit", "crypto", 2): {"user_popularity": (100, 0.95), "content_liveliness_topk": (100, 0.95)},
    ("reddit", "cve", 1): {"most_active_users": (25, 0.8), "user_popularity": (25, 0.8)},
    ("reddit", "cve", 2): {"most_active_users": (12, 0.65), "user_popularity": (25, 0.81), "content_liveliness_topk": (5, 0.3)},
    ("reddit", "cyber", 2): {"user_popularity": (200, 0.975), "content_liveliness_topk": (200, 0.975)},
    ("twitter", "cve", 1): {"most_active_users": (30, 0.84), "user_popularity": (30, 0.84)},
    ("twitter", "cve", 2): {"most_active_users": (10, 0.58), "user_popularity": (10, 0.58), "content_popularity_topk": (10, 0.58)},
}
#: Platforms and domains that have a second scenario.
SECOND = {("twitter", "cve"), ("reddit", "cve"), ("reddit", "crypto"), ("reddit", "cyber")}


def specs(platform: str, domain: str | None = None, scenario: int = 1, influence: bool = False) -> dict[str, Spec]:
    """Measurements of a run: the platform's, the network's, in the second scenario the cascades' (Twitter without communities), and on demand those of transfer entropy."""
    if scenario == 2 and (platform, domain) not in SECOND:
        raise KeyError(f"no second scenario for {platform} and {domain}")
    found = {**BASE[platform], **NETWORK}
    if scenario == 2:
        found |= {n: s for n, s in CASCADE.items() if platform != "twitter" or s.scale != "community"}
    found = {n: s for n, s in found.items() if (s.scenario2 if scenario == 2 else s.scenario1)}
    if influence:
        found |= INFLUENCE
    for name, (k, p) in OVERRIDES.get((platform, domain, scenario), {}).items():
        if name in found:
            found[name] = replace(found[name], args={**found[name].args, "k": k, "p": p})
    return found


def chosen(found: dict[str, Spec], filters: dict[str, list[str]] | None = None) -> dict[str, Spec]:
    """Specifications whose fields (scale, node_type, name, family) are among the allowed values."""
    return {n: s for n, s in found.items() if all(getattr(s, f) in values for f, values in (filters or {}).items())}


def measure(spec: Spec, inputs: Inputs) -> DataFrame:
    return spec.measure(inputs, spec.args)


def compare(spec: Spec, gt: Inputs | DataFrame, sim: Inputs | DataFrame) -> DataFrame:
    """(measurement, node, metric, value): one plan a metric; nodes and communities are those of the ground truth."""
    a, b = (x if isinstance(x, DataFrame) else measure(spec, x) for x in (gt, sim))
    out = None
    for name in spec.metrics:
        group = [spec.key] if spec.key else None
        got = METRICS[name](a, b, group, spec.args)
        if group:
            got = a.select(spec.key).distinct().join(got, spec.key, "left").select(F.col(spec.key).cast("string").alias("node"), "value")
        else:
            got = got.select(F.lit(None).cast("string").alias("node"), "value")
        got = got.select(F.lit(spec.name).alias("measurement"), "node", F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        out = got if out is None else out.unionByName(got)
    return out


def run_measurements(inputs: Inputs, found: dict[str, Spec], folder: str | None = None, timings: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """All measurements; with ``folder`` each is written and the seconds it took are put into ``timings``."""
    from tributary.sources.writers import save_measurements

    out = {}
    for name, spec in found.items():
        began = time.time()
        out[name] = measure(spec, inputs)
        if folder:
            save_measurements({name: out[name]}, folder)
        if timings is not None:
            timings[name] = time.time() - began
    return out


def run_metrics(gt: Inputs, sim: Inputs, found: dict[str, Spec]) -> DataFrame:
    out = None
    for spec in found.values():
        got = compare(spec, gt, sim)
        out = got if out is None else out.unionByName(got)
    return out


def liveliest(log: DataFrame, node: str = "root") -> DataFrame:
    """The node with the highest median of its counts by event type, ties by name."""
    counts = log.groupBy(node, "event").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(node).agg(F.median("n").alias("value")).orderBy(F.desc("value"), node).limit(1)

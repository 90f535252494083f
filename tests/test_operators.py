"""Operators against fresh reference implementations, golden data and properties."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.functions.inequality import gini, palma
from tributary.functions.scalar import coerce_time, log_bin, url_domains
from tributary.operators import cascade, extract, influence, metrics, network, preprocess, reconstruct, user
from tributary.operators import reference_data as ref

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "value double")


def one(df):
    return df.first()["value"]


@few
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40))
def test_gini_and_palma_equal_numpy(spark, xs):
    x = np.sort(np.array(xs, float))
    n, i = len(x), np.arange(1, len(x) + 1)
    y = x + 1e-9
    assert one(gini(values(spark, xs))) == pytest.approx(((2 * i - n - 1) * y).sum() / (n * y.sum()), abs=1e-9)
    area = sum((a + b) / 2 / n for a, b in zip(np.cumsum(x) / x.sum(), (np.cumsum(x) / x.sum())[1:]))
    assert one(gini(values(spark, xs), method="trapz")) == pytest.approx(1 - 2 * area, abs=1e-9)
    for base in (0, 1):
        p = (i - 1 + base) / n
        low = x[p <= 0.4].sum()
        got = one(palma(values(spark, xs), rank_base=base))
        assert got is None if low == 0 else got == pytest.approx(x[p >= 0.9].sum() / low)


def test_log_bins_have_the_labels_of_right_edges(spark):
    got = [r["b"] for r in spark.range(1, 1001).select(log_bin(F.col("id"), -1, 3, 16).alias("b")).distinct().collect()]
    assert sorted(x for x in got if x is not None) == [1, 2, 3, 7, 13, 25, 46, 85, 158, 292, 541, 1000]


def test_times_by_magnitude(spark):
    df = spark.createDataFrame([("1500000000",), ("1500000000000",), ("2017-07-14T02:40:00Z",), ("x",)], "t string")
    got = [r["t"] for r in df.select(coerce_time(F.col("t"), "string").cast("string").alias("t")).collect()]
    assert got == ["2017-07-14 02:40:00"] * 3 + [None]


def test_url_domains(spark):
    df = spark.createDataFrame([("see https://www.a.org/x and http://me@b.com:80/y",), (None,)], "t string")
    assert [r["d"] for r in df.select(url_domains(F.col("t")).alias("d")).collect()][1] == []


def test_canonical_log(spark):
    raw = spark.createDataFrame([("c1", "u", "post", 1500000000, "", "c1", "s"), ("c2", "u", "DeleteEvent", 1500000000, "c1", "c1", "s")],
                                "nodeID string, nodeUserID string, actionType string, nodeTime long, parentID string, rootID string, communityID string")
    rows = preprocess.canonical(raw, "reddit").collect()
    assert len(rows) == 1 and rows[0]["parent"] is None and rows[0]["subreddit"] == "s"


def metric_frames(spark, rng, n=40):
    rows = [(f"k{i:02d}", float(rng.randint(0, 9))) for i in range(n)]
    return spark.createDataFrame(rows, "k string, value double")


def test_a_log_equals_itself(spark):
    g = metric_frames(spark, random.Random(1))
    assert one(metrics.rmse(g, g)) == 0 and one(metrics.ks_test(g, g)) == 0 and one(metrics.dtw(g, g)) == 0
    assert one(metrics.js_divergence(g, g)) == pytest.approx(0) and one(metrics.kl_divergence(g, g, True)) == pytest.approx(0) and one(metrics.r2(g, g)) == 1
    assert one(metrics.rbo(g, g, 0.9)) == pytest.approx(1 - 0.9**40)


def test_doane_histogram_and_divergence(spark):
    rng = np.random.default_rng(3)
    a, b = rng.gamma(2, 3, 80), rng.gamma(3, 2, 60)
    bins = np.histogram_bin_edges(np.concatenate([a, b]), "doane")
    rows = metrics.histogram(values(spark, a), values(spark, b)).orderBy("bin").collect()
    assert [r["gt"] for r in rows] == list(np.histogram(a, bins)[0]) and [r["sim"] for r in rows] == list(np.histogram(b, bins)[0])


def test_dtw_against_the_plain_recursion():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(0, 9, rng.integers(1, 8)).astype(float), rng.integers(0, 9, rng.integers(1, 8)).astype(float)
        t = np.full((len(a) + 1, len(b) + 1), np.inf)
        t[0, 0] = 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = abs(x - y) + min(t[i, j], t[i, j + 1], t[i + 1, j])
        assert metrics._dtw(a, b) == t[-1, -1]


def test_rbo_of_a_known_pair(spark):
    frame = lambda xs: spark.createDataFrame([(str(x), float(100 - i)) for i, x in enumerate(xs)], "k string, value double")
    a, b = list(range(10)), [0, 1, 3, 2, 6, 5, 9, 7]
    want = sum(len(set(a[:i]) & set(b[:i])) / i * 0.9 ** (i - 1) for i in range(1, 9)) * 0.1
    assert one(metrics.rbo(frame(a), frame(b), 0.9)) == pytest.approx(want)
    assert 0 < metrics.rbo_weight(10, 0.9) < 1


def test_fill_forward_stays_in_its_group(spark):
    g = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 7.0)], "k string, t int, value double")
    s = spark.createDataFrame([("a", 2, 6.0), ("b", 1, 9.0)], "k string, t int, value double")
    got = {(r["k"], r["t"]): (r["value_gt"], r["value_sim"]) for r in metrics.join(g, s, "full_outer", "ffill", ["k"]).collect()}
    assert got == {("a", 1): (5.0, None), ("a", 2): (5.0, 6.0), ("b", 1): (None, 9.0), ("b", 2): (7.0, 9.0)}


def random_tree(rng, n):
    return [(f"n{i}", f"n{rng.randrange(i) if i else 0}", "n0", f"u{rng.randrange(4)}", i) for i in range(n)]


def tree_frame(spark, rows):
    df = spark.createDataFrame(rows, "node string, parent string, root string, user string, seq long")
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 3600 * 5)).withColumn("event", F.lit("tweet")).withColumn("community", F.lit("c"))


def brute(rows):
    up = {a: b for a, b, *_ in rows}
    path = {a: [a] for a in up}
    for a in up:
        while path[a][-1] != up[path[a][-1]]:
            path[a].append(up[path[a][-1]])
    far = lambda a, b: min(path[a].index(x) + path[b].index(x) for x in path[a] if x in path[b])
    n = len(rows)
    depth = {a: len(p) - 1 for a, p in path.items()}
    wiener = sum(far(a, b) for a in up for b in up) / 2
    return max(depth.values()), n, max(list(depth.values()).count(d) for d in depth.values()), 2 * wiener / (n * (n - 1))


def test_cascade_measures_equal_brute_force(spark):
    rng = random.Random(4)
    for n in (2, 7, 15):
        rows = random_tree(rng, n)
        got = cascade.summary(tree_frame(spark, rows)).first()
        want = brute(rows)
        assert (got["depth"], got["size"], got["breadth"]) == want[:3] and got["structural_virality"] == pytest.approx(want[3])
        last = cascade.timeseries(tree_frame(spark, rows)).orderBy(F.desc("timestamp")).first()
        assert last["structural_virality"] == pytest.approx(want[3]) and last["breadth"] == want[2]
    alone = cascade.summary(tree_frame(spark, random_tree(rng, 1))).first()
    assert (alone["depth"], alone["size"], alone["breadth"], alone["structural_virality"], alone["lifetime"]) == (0, 1, 0, None, 0.0)


def test_rows_out_of_reach_have_no_depth(spark):
    df = tree_frame(spark, [("n0", "n0", "n0", "u", 0), ("n1", "gone", "n0", "u", 1)])
    assert {r["node"]: r["depth"] for r in cascade.depths(df).collect()} == {"n0": 0, "n1": -1}


def test_network_statistics_of_a_small_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", "d")], "src string, dst string")
    assert one(network.number_of_nodes(e)) == 6 and one(network.number_of_components(e)) == 2
    assert one(network.clustering(e)) == pytest.approx((1 + 1 + 1 / 3) / 6)
    assert one(network.mean_path(e)) == pytest.approx((2 * (4 * 1 + 2 * 2) + 2) / 14)
    assert network.degree_summary(e).first()["max_degree"] == 3
    parts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("x", 2), ("y", 2)], "node string, community int")
    assert one(network.modularity(e, parts)) == pytest.approx(5 / 6 + 1 / 6 - (100 + 4) / 144)


#: The published example of a reconstruction.
GOLDEN = [  # node, user, type, second, parent, root and what parents and roots should be
    ("A", "a", "tweet", 0, "A", "A", "A", "A"), ("B", "b", "retweet", 1, "?", "A", "A", "A"), ("C", "c", "retweet", 2, "?", "A", "A", "A"), ("D", "d", "reply", 3, "A", "?", "A", "A"),
    ("E", "e", "reply", 4, "D", "?", "D", "A"), ("F", "f", "retweet", 5, "?", "A", "B", "A"), ("G", "g", "reply", 6, "B", "?", "B", "A"), ("H", "h", "tweet", 7, "H", "H", "H", "H"),
    ("I", "i", "retweet", 8, "?", "H", "H", "H"), ("J", "j", "reply", 9, "H", "?", "H", "H"), ("M", "m", "retweet", 12, "?", "H", "I", "H"), ("N", "n", "retweet", 13, "?", "H", "I", "H"), ("O", "o", "retweet", 14, "?", "H", "M", "H")]
FOLLOWERS = {"a": "bcd", "b": "fg", "d": "e", "h": "ij", "i": "mn", "j": "k", "k": "l", "m": "o"}


def test_golden_reconstruction(spark):
    rows = spark.createDataFrame([(n, u, t, f"2017-08-15T00:00:{s:02d}Z", p, r) for n, u, t, s, p, r, _, _ in GOLDEN],
                                 "nodeID string, nodeUserID string, actionType string, nodeTime string, parentID string, rootID string")
    followers = spark.createDataFrame([(u, f) for u, fs in FOLLOWERS.items() for f in fs], "user string, follower string")
    got = {r["nodeID"]: (r["parentID"], r["rootID"]) for r in reconstruct.reconstruct_by_root(rows, followers).collect()}
    assert got == {g[0]: (g[6], g[7]) for g in GOLDEN}


def test_later_rounds_overwrite_parents(spark):
    """Against the rounds themselves, on random followers."""
    rng = random.Random(6)
    for _ in range(3):
        n = 9
        users = [f"u{rng.randrange(6)}" for _ in range(n)]
        follow = {u: {f"u{k}" for k in range(6) if rng.random() < 0.4} | {u} for u in set(users)}
        parent, seeds = {}, [0]
        while seeds:
            new = []
            for s in seeds:
                hit = [v for v in range(n) if v > s and users[v] in follow[users[s]]]
                for v in hit:
                    parent[f"n{v}"] = f"n{s}"
                new += hit
            seeds = sorted(set(new))
        rows = spark.createDataFrame([(f"n{i}", u, f"2017-08-15T00:00:{i:02d}Z", "n0") for i, u in enumerate(users)], "nodeID string, nodeUserID string, nodeTime string, rootID string")
        f = spark.createDataFrame([(u, x) for u, s in follow.items() for x in s], "user string, follower string")
        got = {r["nodeID"]: r["parent"] for r in reconstruct.retweet_parents(rows, f).filter("parent is not null").collect()}
        assert got == parent


def test_full_reconstruction_falls_back_to_the_partial_parent(spark):
    rows = spark.createDataFrame([("t", "a", "tweet", "2018-01-01", "t", "t", "t"), ("r", "b", "retweet", "2018-01-02", "?", "t", "t"), ("p", "c", "reply", "2018-01-03", "r", "?", "r")],
                                 "nodeID string, nodeUserID string, actionType string, nodeTime string, parentID string, rootID string, partialParentID string")
    got = {r["nodeID"]: (r["parentID"], r["rootID"]) for r in reconstruct.reconstruct(rows).collect()}
    assert got == {"t": ("t", "t"), "r": ("t", "t"), "p": ("r", "t")}


def test_transfer_entropy_of_pairs_equals_dense_series(spark):
    rng = np.random.default_rng(5)
    series = {e: (rng.random(60) < p).astype(int) for e, p in (("a", 0.3), ("b", 0.5), ("c", 0.1))}
    rows = spark.createDataFrame([("g", e, int(t)) for e, s in series.items() for t in np.flatnonzero(s)], "grp string, entity string, bin long")
    who = rows.select("grp", "entity").distinct()
    for r in influence.pairs(rows, 60, [1, 3], who, who).collect():
        assert r["value"] == pytest.approx(influence.te(series[r["src"]], series[r["dst"]], r["delay"]), abs=1e-9)


def test_bootstrap_fills_the_period(spark):
    start = 1_700_000_000  # events a day and a minute apart; hours apart, over midnight
    logs = {86_460: 14, 3_600: 24 * 14}
    for gap, least in logs.items():
        log = spark.createDataFrame([(i, f"u{i % 3}", f"c{i % 4}", "view" if i % 2 else "issue", "opened" if i % 4 else None) for i in range(50)],
                                    "seq long, user string, content string, event string, action string").withColumn("ts", F.timestamp_seconds(start + F.col("seq") * gap))
        assert [r["gap"] for r in ref.gaps(log).distinct().collect()] == [gap * 1_000_000] and ref.gaps(log).count() == 49
        got = sorted(ref.sampled(log, "2024-03-01", "2024-03-15", attributes={"issue": ["action"]}).collect(), key=lambda r: r["seq"])
        times = [r["ts"] for r in got]
        assert least - 1 <= len(got) <= least and all((b - a).total_seconds() == gap for a, b in zip(times, times[1:]))
        assert str(times[0] - timedelta(seconds=gap)) == "2024-03-01 00:00:00" and times[-1] < datetime(2024, 3, 15) <= times[-1] + timedelta(seconds=gap)
        assert {r["user"] for r in got} <= {"u0", "u1", "u2"} and all(r["action"] is None for r in got if r["event"] == "view")
    again = sorted(ref.sampled(log, "2024-03-01", "2024-03-15", attributes={"issue": ["action"]}).collect(), key=lambda r: r["seq"])
    assert again == got and {r["event"] for r in got} == {"view", "issue"} and "opened" in {r["action"] for r in got}
    log = log.filter("seq < 2 or seq > 40").withColumn("ts", F.timestamp_seconds(start + F.col("seq") / 4))
    even = ref.sampled(log, "2024-03-01 00:00:00", "2024-03-01 00:01:00", proportional=False).collect()
    assert all(r["ts"].microsecond == 0 for r in even) and len(even) > 50
    assert ref.sampled(log.filter("seq = 1"), "2024-03-01", "2024-03-15").count() == 0 == ref.sampled(log.limit(0), "2024-03-01", "2024-03-15").count()
    assert ref.shifted(log, "2023-11-01", "2023-11-02", "2024-01-01", "2024-02-01").count() == 0


def test_dtw_and_chances_of_correlations():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (1, 6), (9, 4), (15, 15)):
        a, b = rng.normal(size=n), rng.normal(size=k)
        d = np.full((n + 1, k + 1), np.inf)
        d[0, 0] = 0
        for i in range(n):
            for j in range(k):
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        assert metrics._dtw(a, b) == pytest.approx(d[n, k])
    for r, n in ((0.5, 10), (0.1, 5), (-0.9, 30), (0.3, 100), (0.97, 3)):  # by the density of Student's t
        t, df = abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2
        x = np.linspace(0, math.atan(t / math.sqrt(df)), 100_001)
        inside = np.trapezoid(np.cos(x) ** (df - 1), x) * 2 * math.gamma((df + 1) / 2) / (math.sqrt(math.pi) * math.gamma(df / 2))
        assert metrics.correlation_chance(r, n) == pytest.approx(1 - inside, rel=1e-4)
    assert metrics.correlation_chance(1.0, 5) == 0 and metrics.correlation_chance(0.0, 5) == 1


def test_sums_of_distances_to_earlier_nodes():
    rng = random.Random(1)
    for n in (1, 2, 9, 40):
        parent = [-1] + [rng.randrange(i) if rng.random() < 0.5 else i - 1 for i in range(1, n)]
        up = lambda i: [i] if parent[i] < 0 else [i, *up(parent[i])]  # noqa: E731, B023
        apart = lambda i, j: len(set(up(i)) ^ set(up(j)))  # noqa: E731, B023
        rank = rng.sample(range(n), n)
        want = [sum(apart(i, j) for j in range(n) if rank[j] < rank[i]) for i in range(n)]
        assert cascade.distances_to_earlier(np.array(parent), np.array(rank)).tolist() == want


def test_circles_and_chains(spark):
    rows = [("a", "a", "a", 0), ("b", "a", "a", 1), ("c", "d", "a", 2), ("d", "e", "a", 3), ("e", "c", "a", 4), ("f", "c", "a", 5), ("g", "b", "a", 6), ("h", "gone", "a", 7)]
    log = spark.createDataFrame(rows, "node string, parent string, root string, seq long").withColumns({"user": F.col("node"), "ts": F.timestamp_seconds("seq")})
    got = {r["node"]: (r["depth"], r["below"]) for r in cascade.depths(log, sizes=True).collect()}
    assert got == {"a": (0, 2), "b": (1, 1), "g": (2, 0), "c": (-1, 0), "d": (-1, 0), "e": (-1, 0), "f": (-1, 0), "h": (-1, 0)}
    assert cascade.summary(log).count() == 1 and cascade.by_depth(log).count() == 3
    n = 300
    chain = spark.range(n).select(F.col("id").cast("string").alias("node"), F.greatest(F.col("id") - 1, F.lit(0)).cast("string").alias("parent"), F.lit("0").alias("root"), F.col("id").alias("seq"))
    chain = chain.withColumns({"user": F.col("node"), "ts": F.timestamp_seconds("seq")})
    one_ = cascade.summary(chain).first()
    assert (one_["depth"], one_["size"], one_["breadth"]) == (n - 1, n, 1) and one_["structural_virality"] == pytest.approx((n + 1) / 3)
    ids = chain.select(F.col("node").alias("nodeID"), F.col("parent").alias("parentID"), F.when(F.col("seq") % 100 == 0, F.array("node")).otherwise(F.array().cast("array<string>")).alias("informationIDs"))
    handed = {r["nodeID"]: r["informationIDs"] for r in extract.propagate(ids).collect()}
    assert handed["99"] == ["0"] and handed["299"] == ["0", "100", "200"]
    ring = spark.createDataFrame([("x", "y", ["1"]), ("y", "x", ["2"]), ("z", "y", [])], "nodeID string, parentID string, informationIDs array<string>")
    assert {r["nodeID"]: r["informationIDs"] for r in extract.propagate(ring).collect()} == {"x": ["1", "2"], "y": ["1", "2"], "z": ["1", "2"]}


def test_rows_that_tie_lose_one_only(spark):
    from tributary.operators import content

    rows = [("u", "c", "post", "2017-08-01T00:00:00Z")] * 3 + [("v", "d", "post", "2017-08-01T05:00:00Z")]
    raw = spark.createDataFrame(rows, "nodeUserID string, nodeID string, actionType string, nodeTime string")
    log = preprocess.canonical(raw, "twitter")
    assert content.diffusion_delay(log).count() == 3 and content.diffusion_delay(log, drop="per_content").count() == 2


def test_louvain_over_levels(spark):
    cliques = [(f"{k}{i}", f"{k}{j}") for k in "abcdef" for i in range(5) for j in range(i)]
    bridges = [("a0", "b0"), ("b1", "a1"), ("c0", "d0"), ("d1", "c1"), ("e0", "f0"), ("f1", "e1"), ("b2", "c2"), ("d2", "e2")]
    edges = spark.createDataFrame(cliques + bridges, "src string, dst string")
    parts = {r["node"]: r["community"] for r in network.louvain(edges).collect()}
    assert len(parts) == 30 and all(len({parts[f"{k}{i}"] for i in range(5)}) == 1 for k in "abcdef")
    assert one(network.modularity(edges)) > 0.6


def test_ground_truth_by_information_type(spark, tmp_path):
    rows = lambda p, i: spark.createDataFrame([(p + "1", i, p)], "nodeID string, informationID string, platform string")
    sources = {"telegram": rows("telegram", "btc"), "twitter": rows("twitter", "BTC"), "github": rows("github", "x")}
    names = spark.createDataFrame([("btc", "Bitcoin")], "alias string, name string")
    got = extract.ground_truth(sources, names, "Coins", str(tmp_path / "out")).collect()
    assert sorted((r["platform"], r["informationID"]) for r in got) == [("telegram", "Bitcoin"), ("twitter", "Bitcoin")]
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and extract.ground_truth(sources, None, "CVE").count() == 2
    with pytest.raises(ValueError):
        extract.ground_truth(sources, None, "Weather")
    with pytest.raises(ValueError):
        extract.ground_truth({"telegram": sources["telegram"]}, None, "CVE")


def test_github_extraction(spark, tmp_path):
    import json

    docs = [{"event": {"created_at": "2017-08-01T00:00:00Z", "type": t, "actor": {"login_h": "u"}, "repo": {"name_h": "r"}}, "payload": {"commits": [{"message_m": "see https://a.org/x"}], "issue": {"body_m": "https://b.org"}},
             "details": [{"extension": {"keywords": ["k1", "k2"]}}]} for t in ("PushEvent", "IssuesEvent", "OtherEvent")]
    (tmp_path / "g.json").write_text("\n".join(map(json.dumps, docs)))
    got = extract.github(spark.read.json(str(tmp_path / "g.json"))).collect()
    assert sorted((r["actionType"], r["informationID"], r["urlDomains"][0]) for r in got) == [
        ("IssuesEvent", "k1", "b.org"), ("IssuesEvent", "k2", "b.org"), ("PushEvent", "k1", "a.org"), ("PushEvent", "k2", "a.org")]
    (tmp_path / "h.json").write_text("\n".join(json.dumps(d).replace("keywords", "tags").replace("extension", "more").replace("details", "marks") for d in docs))
    other = extract.github(spark.read.json(str(tmp_path / "h.json")), at=extract.Names(ids="more.tags", details="marks"), start="2017-08-01", end="2017-08-02")
    assert other.count() == 4 and extract.github(spark.read.json(str(tmp_path / "g.json")), start="2017-08-02").count() == 0


def test_reddit_extraction_hands_ids_down(spark):
    c = "id_h string, author_h string, parent_id_h string, link_id_h string, created_utc long, body_m string, subreddit_id string, extension struct<keywords: array<string>, domain: string>"
    comments = spark.createDataFrame([("c1", "u1", "t3_p1", "t3_p1", 1500000001, "", "s", ([], "d")), ("c2", "u2", "t1_c1", "t3_p1", 1500000002, "", "s", (["y"], "d")), ("c3", "u3", "t1_no", "t3_p1", 1500000003, "", "s", (["y"], "d"))], c)
    posts = spark.createDataFrame([("p1", "u0", 1500000000, "http://x.org", "s", (["k"], "d"))], "id_h string, author_h string, created_utc long, selftext_m string, subreddit_id string, extension struct<keywords: array<string>, domain: string>")
    got = sorted((r["nodeID"], r["informationID"]) for r in extract.reddit(comments, posts).collect())
    assert got == [("t1_c1", "k"), ("t1_c2", "k"), ("t1_c2", "y"), ("t3_p1", "k")]


def test_telegram_extraction(spark):
    kind = "uid_h string, norm struct<timestamp: string, author: string, body_m: string>, doc struct<to_id: struct<channel_id: long>, id: long, from_id_h: string, reply_to_msg_id: long, peer: struct<username: string>>, extension struct<keywords: array<struct<keyword: string>>>"
    rows = [("1", ("2017-08-01T00:00:00Z", "x", "https://a.org/"), ((7,), 1, "u1", None, ("ch",)), ([("k",)],)), ("2", ("2017-08-01T00:00:05Z", "x", ""), ((7,), 2, None, 1, ("ch",)), ([],))]
    got = sorted((r["nodeID"], r["nodeUserID"], r["parentID"], r["rootID"], r["informationID"]) for r in extract.telegram(spark.createDataFrame(rows, kind)).collect())
    assert got == [("7_1", "u1", "7_1", "7_1", "k"), ("7_2", "x", "7_1", "7_1", "k")]


def test_empty_logs_give_defaults(spark):
    empty = spark.createDataFrame([], "user string, root string, event string, time timestamp, ts timestamp, seq long")
    assert user.activity_distribution(empty).count() == 0 and gini(spark.createDataFrame([], "value double")).count() == 0
    assert preprocess.or_default(user.most_active(empty).select("value"), value=0).collect()[0]["value"] == 0
    assert math.isclose(one(preprocess.or_default(values(spark, [2]), value=0)), 2)


def test_triangles_meet_in_blocks(spark):
    """Dense and thin graphs, whose edges no task holds as a whole, against a search over all corners; hot things in a projection."""
    rng = random.Random(8)
    dense = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.6}
    thin = {(a, b) for a, b in ((rng.randrange(3000), rng.randrange(3000)) for _ in range(6000)) if a < b} | {(0, k) for k in range(1, 300)}
    for edges in (dense, thin):
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want = {n: k for n, v in near.items() if (k := sum(len(near[m] & v) for m in v) // 2)}
        df = spark.createDataFrame(sorted(edges), "src long, dst long")
        for held in (10**6, 4 * len(edges)):
            assert {r["node"]: r["t"] for r in network.triangles(df, held).collect()} == want
        named = df.select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"))
        assert {r["node"]: r["t"] for r in network.triangles(named, 2 * len(edges)).collect()} == {f"n{n}": k for n, k in want.items()}
    u, v = np.array([a for a, _ in sorted(thin)]), np.array([b for _, b in sorted(thin)])
    both = np.concatenate([u, v]), np.concatenate([v, u])
    found = network._common(u, v, both, both, 3000, 3000, 10**9)  # rows of bits would be too long
    assert [int(x) for x in found] == [len(near[a] & near[b]) for a, b in zip(u, v)]
    assert network.triangles(df.limit(0)).count() == 0


def test_projection_pairs_hot_things_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(network, "SHARERS", 5)
    monkeypatch.setattr(network, "LISTED", 3)
    rows = [(n, s) for s in range(4) for n in range(4 * s, 4 * s + 3 + 5 * s)] + [(1, 0), (None, 1), (2, None)]
    got = [tuple(r) for r in network.projection_edges(spark.createDataFrame(rows, "node long, shared long")).collect()]
    own = {(n, s) for n, s in rows if n is not None and s is not None}
    assert sorted(got) == sorted({(a, b) for a, s in own for b, t in own if s == t and a < b})


def test_pairs_of_a_projection_travel_packed(spark, monkeypatch):
    """No row of a pair travels, a packed pair takes under two bytes, and triangles are the same over ranges that hardly meet."""
    monkeypatch.setattr(network, "LISTED", 400)  # so that there are several parts
    rows = [(40 * c + n, 100 * c + s) for c in range(5) for s in range(20) for n in range(40) if (n + s) % 3]
    df = network.projection_edges(spark.createDataFrame(rows, "node long, shared long"))
    assert "hashpartitioning(src" not in df._jdf.queryExecution().toString()
    own = {}
    for n, s in rows:
        own.setdefault(s, set()).add(n)
    want = {(a, b) for v in own.values() for a in v for b in v if a < b}
    found = [tuple(r) for r in df.collect()]
    assert sorted(found) == sorted(want)
    src, dst = (np.array(x) for x in zip(*sorted((a, b) for a in range(500) for b in range(a + 1, 500))))
    data = network._packed(np.arange(500), src, np.arange(500), dst)
    assert len(data) < 2 * len(src)
    a, u, b, v = network._unpacked(data)
    assert (a[u] == src).all() and (b[v] == dst).all()
    near = {}
    for x, y in want:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    monkeypatch.undo()
    assert {r["node"]: r["t"] for r in network.triangles(df, 2 * len(want)).collect()} == {n: sum(len(near[m] & v) for m in v) // 2 for n, v in near.items()}


def test_paths_by_bits_and_by_joins(spark, monkeypatch):
    """Components in one task, over blocks of origins and by joins, against a search from each node."""
    monkeypatch.setattr(network, "ORIGINS", 70)
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(4)] + [(10, 11), (12, 12)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(320)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = []
    for n in near:
        d, line = {n: 0}, [n]
        for x in line:
            for y in near[x] - set(d):
                d[y] = d[x] + 1
                line.append(y)
        found += [v for v in d.values() if v]
    df = spark.createDataFrame(edges, "src long, dst long")
    for held in (None, 3):
        assert one(network.mean_path(df, held=held)) == pytest.approx(sum(found) / len(found))


def test_assortativity_of_parallel_edges_and_loops(spark):
    edges = [(1, 2), (1, 2), (2, 3), (3, 3), (3, 4), (5, 1), (5, 6)]
    degree = {n: sum((a == n) + (b == n) for a, b in edges) for n in range(1, 7)}
    x, y = zip(*[(degree[a], degree[b]) for e in edges for a, b in (e, e[::-1])])
    assert one(network.assortativity(spark.createDataFrame(edges, "src long, dst long"))) == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_all_pairs_by_blocks_and_the_strongest(spark, monkeypatch):
    """Blocks smaller than a group give the rows of ``pairs``; the strongest are those of a test of every pair, also where few or none stand."""
    monkeypatch.setattr(influence, "BLOCK", 4)
    monkeypatch.setattr(influence, "SCORED", 6)
    rng = np.random.default_rng(2)
    rows = [(g, f"u{u}", int(b)) for g in "xy" for u in range(9) for b in rng.choice(60, 4 + u, replace=False)]
    rows += [("x", f"v{u}", b + 1) for u in range(3) for g, v, b in rows if g == "x" and v == f"u{u + 5}" and b < 59] + [("z", "a", 1), ("z", "b", 2)]
    binned = spark.createDataFrame(rows, "grp string, entity string, bin long")
    who = binned.select("grp", "entity").distinct().unionByName(spark.createDataFrame([("x", "silent")], "grp string, entity string"))
    key = lambda df: {(r["grp"], r["src"], r["dst"], r["delay"]): r["value"] for r in df.collect()}
    want, got = key(influence.pairs(binned, 60, [1, 2], who, who)), key(influence.all_pairs(binned, 60, [1, 2], who, who))
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    every = influence.significant(binned, influence.all_pairs(binned, 60, [1, 2], who, who), 60, 0.02, reps=20)
    plain = influence.strongest(every, 8, 1)[0]
    lazy = influence.strongest_significant(binned, 60, [1, 2], who, 0.02, 8, reps=20, first=1)
    at = lambda df: sorted((r["grp"], r["rank"], r["src"], r["dst"], round(r["value"], 9)) for r in df.collect())
    assert at(lazy) == at(plain)


def test_the_strongest_of_equal_series(spark, monkeypatch):
    """Copies of series tie: of all their pairs only the first by name are kept and tested, over blocks and parts of a class too."""
    rng = np.random.default_rng(4)
    line = {k: sorted(int(b) for b in rng.choice(60, 8, replace=False)) for k in range(3)}
    line[3] = [b + 1 for b in line[0] if b < 59]
    rows = [("x", f"c{c}u{k}", b) for k, v in line.items() for c in range(7) for b in v]
    binned = spark.createDataFrame(rows, "grp string, entity string, bin long")
    who = binned.select("grp", "entity").distinct()
    plain = influence.strongest(influence.significant(binned, influence.all_pairs(binned, 60, [1, 2], who, who), 60, 0.02, reps=20), 8, 1)[0]
    at = lambda df: sorted((r["rank"], r["src"], r["dst"], round(r["value"], 9)) for r in df.collect())
    want = at(plain)
    every = sorted((-round(r["value"], 9), r["src"], r["dst"], r["delay"]) for r in influence.pairs(binned, 60, [1, 2], who, who).collect() if r["value"] > 0.02)
    for block in (8192, 3):
        monkeypatch.setattr(influence, "BLOCK", block)
        found = influence.all_pairs(binned, 60, [1, 2], who, who, above=0.02, best=5)
        got = sorted((-round(r["value"], 9), r["src"], r["dst"], r["delay"]) for r in found.collect())
        assert got[:5] == every[:5] and (block == 3 or len(got) == 5)
        assert at(influence.strongest_significant(binned, 60, [1, 2], who, 0.02, 8, reps=20, first=1)) == want


def test_blocks_of_all_pairs_travel_lean(spark, monkeypatch):
    """6,000 entities of three series: the blocks that meet hold a series once, with the names, and not once for every entity."""
    rows = [("x", f"u{u}", b) for u in range(6000) for b in range(u % 3, 60, 3)]
    binned = spark.createDataFrame(rows, "grp string, entity string, bin long")
    who, held = binned.select("grp", "entity").distinct(), []
    monkeypatch.setattr(type(binned), "mapInArrow", lambda self, *a, **k: held.append(self) or self)
    influence.all_pairs(binned, 60, [1], who, who)
    found = held[0].selectExpr("size(alla) a", "size(allb) b").collect()
    assert sum(r["a"] + r["b"] for r in found) <= 2 * 3 * len(found) and len(found) <= 64

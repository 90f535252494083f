"""Sources, sinks, registry and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tributary.plans import registry
from tributary.plans.ranking import running
from tributary.sources import readers, writers
from tributary.streaming import counters


def events(spark, platform):
    kinds = {"github": ["PushEvent", "WatchEvent", "ForkEvent", "IssuesEvent", "PullRequestEvent", "CreateEvent"], "reddit": ["post", "comment"], "twitter": ["tweet", "retweet", "reply", "quote"]}[platform]
    df = spark.range(120).select(
        F.col("id").alias("seq"), F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("user"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("content"),
        F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % len(kinds) + 1).cast("int")).alias("event"), F.timestamp_seconds(1_500_000_000 + F.col("id") * 4000).alias("ts"),
        F.concat(F.lit("n"), (F.col("id") % 6).cast("string")).alias("root"), F.concat(F.lit("n"), F.when(F.col("id") < 6, F.col("id")).otherwise(F.col("id") - 6).cast("string")).alias("parent"),
        F.lit("closed").alias("action"), (F.col("id") % 2 == 0).alias("merged"), F.concat(F.lit("s"), (F.col("id") % 6 % 2).cast("string")).alias("subreddit"))
    if platform == "github":
        df = df.withColumn("content", F.col("root"))
    return df.withColumn("time", F.date_trunc("hour", "ts"))


@pytest.mark.parametrize("platform,domain,scenario", [("github", "cve", 1), ("reddit", "cve", 2), ("twitter", "cve", 2)])
def test_all_configured_measurements_run(spark, platform, domain, scenario):
    log = events(spark, platform)
    accounts = log.select("user").distinct().withColumn("created_at", F.lit("2016-01-01").cast("timestamp")).withColumn("country", F.lit("X"))
    inputs = registry.Inputs(log, platform, accounts=accounts)
    found = registry.specs(platform, domain, scenario)
    slow = {"mean_shortest_path_length", "community_modularity"}
    for name, df in registry.run_measurements(inputs, {n: s for n, s in found.items() if n not in slow}).items():
        assert "value" in df.columns, name
        df.schema  # noqa: B018  the plan resolves
    few = registry.chosen(found, {"name": ["most_active_users", "user_activity_timeline", "user_gini_coef"]})
    got = registry.run_metrics(inputs, inputs, few).collect()
    by = {(r["measurement"], r["metric"]): r["value"] for r in got}
    assert by["user_gini_coef", "absolute_difference"] == 0 and by["user_activity_timeline", "rmse"] == 0


def test_overrides_and_missing_scenarios():
    assert registry.specs("reddit", "cve", 1)["most_active_users"].args["k"] == 25
    assert registry.specs("reddit", "crypto", 1)["most_active_users"].args["k"] == 1500
    assert not any(s.scale == "community" for n, s in registry.specs("twitter", "cve", 2).items() if s.family == "cascade")
    with pytest.raises(KeyError):
        registry.specs("github", "cve", 2)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"team": "x", "data": [{"nodeID": "a", "parentID": ""}, {"nodeID": "b", "parentID": "a"}]}))
    rows = readers.submission(spark, str(tmp_path / "s.json"))
    assert rows.columns == ["nodeID", "parentID"] and rows.filter("parentID is null").count() == 1
    (tmp_path / "f").mkdir()
    for u, fs in (("a", "b\nc\n"), ("b", "d\n")):
        (tmp_path / "f" / f"{u}.txt").write_text(fs)
    assert sorted(map(tuple, readers.followers(spark, str(tmp_path / "f")).collect())) == [("a", "b"), ("a", "c"), ("b", "d")]
    (tmp_path / "c.json").write_text(json.dumps({"topic": {"t": ["1", "2"]}, "country": {"X": ["u"]}}))
    assert readers.communities(spark, str(tmp_path / "c.json")).count() == 3
    (tmp_path / "k.json").write_text(json.dumps({"Bitcoin": ["btc"]}))
    assert sorted(r["alias"] for r in readers.keyword_aliases(spark, str(tmp_path / "k.json")).collect()) == ["Bitcoin", "btc"]
    assert readers.node_list(spark, str(tmp_path / "none.txt")) == ["all"] and readers.node_list(spark, None, []) == []
    (tmp_path / "g.csv").write_text("_id,time,event,user,repo\n1,2017-08-01 10:20:00,PushEvent,u,r\n")
    assert str(readers.github_positional(spark, str(tmp_path / "g.csv")).first()["time"]) == "2017-08-01 10:00:00"
    (tmp_path / "m.csv").write_text("user,created,location,company\nu,2017-01-01,X,Y\nv,2017-01-01,X,Y\n")
    log = spark.createDataFrame([("u",)], "user string")
    assert readers.metadata(spark, str(tmp_path / "m.csv"), "user", log).count() == 1
    writers.save_measurements({"m": rows}, str(tmp_path / "out"))
    assert set(writers.load_measurements(spark, str(tmp_path / "out"), ["m", "missing"])) == {"m"}
    writers.json_array(rows, str(tmp_path / "array"))
    assert readers.records(spark, str(tmp_path / "array"), array=True).count() == 2
    writers.json_lines(rows, str(tmp_path / "lines"))
    assert readers.records(spark, str(tmp_path / "lines")).count() == 2
    writers.parent_mapping_csv(rows, str(tmp_path / "csv"))
    assert readers.events_csv(spark, str(tmp_path / "csv")).count() == 2


def test_bucketed_ranks_equal_plain_windows(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("x"), (F.col("id") % 5).alias("w"))
    got = running(df.withColumn("b", F.expr("x div 100")), ["g"], "b", ["x", "id"], weight="w").collect()
    want = {}
    for g in "012":
        before = 0
        for k, r in enumerate(sorted((r for r in got if r["g"] == g), key=lambda r: (r["x"], r["id"]))):
            want[r["id"]] = (k, before)
            before += r["w"]
    assert {r["id"]: (r["__rank"], r["__before"]) for r in got} == want


def test_streaming_counters(spark, tmp_path):
    events(spark, "reddit").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, run in (("activity", counters.activity), ("growth", counters.growth), ("contributors", counters.contributors)):
        q = run(stream).writeStream.outputMode("complete").format("memory").queryName(f"t_{name}").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(f"t_{name}").agg(F.sum("value")).first()[0] > 0

"""Rules by longest domain, the artifact lake under repeated writes, and their plans."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from pageloom.functions import addresses as A
from pageloom.operators import domains as N
from pageloom.operators import extract as E
from pageloom.operators import requests as R
from pageloom.registry import Adapters, extract_join
from pageloom.sources import artifacts as L

from .test_streams_and_plans import plan


def longest(host, rules):
    """By comparing every rule."""
    name = host.lower().rstrip(".")
    fits = [r for r in rules if r and (name == r or name.endswith("." + r) and not name.replace(".", "").isdigit() and ":" not in name)]
    return max(fits, key=len, default=None)


def test_longest_domain_of_ten_thousand(spark):
    rng = random.Random(1)
    labels = [f"l{n}" for n in range(12)]
    name = lambda most: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, most)))
    rules = {name(6) for _ in range(10_000)} | {"0.1", "10.0.0.1"}
    hosts = [name(9) for _ in range(500)] + ["10.0.0.1", "9.0.0.1", "L1.l2.", "", "l1", "xl1", "::1"] + ["hot.l1.l2"] * 300
    table = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)] + [(-1, None)], "id int, host string")
    listed = spark.createDataFrame([(r.upper() + ".",) for r in rules] + [("",), (None,)], "domain string")
    found = N.longest_rule(table, listed)
    got = {r.id: r.name for r in found.select("id", N.plain_name(F.col("rule.domain")).alias("name")).collect()}
    assert got == {**{i: longest(h, rules) for i, h in enumerate(hosts)}, -1: None}
    text = plan(found)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_of_repeated_rules_the_greatest_counts(spark):
    rules = spark.createDataFrame([("a.b", 1), ("A.B.", 3), ("a.b", 2), ("b", 9)], "domain string, number int")
    hosts = spark.createDataFrame([("x.a.b",), ("c.b",)], "host string")
    assert {r.host: r.rule.number for r in N.longest_rule(hosts, rules).collect()} == {"x.a.b": 2, "c.b": 9}  # "a.b" > "A.B."
    assert N.longest_rule(hosts, rules.where("false")).where("rule is not null").count() == 0
    assert N.longest_rule(hosts.where("false"), rules).count() == 0


def test_sites_can_be_added(spark):
    own = spark.createDataFrame([("news.cn", [".mine"]), ("a.news.cn", [".nested"])], "domain string, selectors array<string>")
    hosts = spark.createDataFrame([("www.news.cn",), ("x.a.news.cn",), ("www.people.com.cn",), ("xnews.cn",)], "host string")
    known = E.known_sites(spark)
    found = {r.host: r.selectors for r in E.site_selectors(hosts, known.join(own, "domain", "left_anti").unionByName(own)).collect()}
    assert found == {"www.news.cn": [".mine"], "x.a.news.cn": [".nested"], "www.people.com.cn": [".p_content", ".rm_txt_con", ".text_con"], "xnews.cn": None}


def test_nested_policies_hold_alone(spark):
    requests = spark.createDataFrame([("http://x.shop.example.org/", "auto", "auto"), ("http://example.org/", "http", "auto"), (None, "http", "direct")], "url string, mode string, proxy_policy string")
    policies = spark.createDataFrame([("example.org", "browser", "proxy", 5, None), ("shop.example.org", None, "direct", None, 7)], "domain string, mode string, proxy_policy string, max_attempts int, interval_us long")
    found = {r.domain: (r.mode, r.proxy_policy, r.max_attempts, r.interval_us) for r in R.domain_policy_apply(requests, policies).collect()}
    assert found == {"x.shop.example.org": ("auto", "direct", 3, 7), "example.org": ("browser", "proxy", 5, 1_000_000), "": ("http", "direct", 3, 1_000_000)}


DAY = dt.datetime(2024, 5, 1)
FIELDS = "artifact_id string, url string, content_type string, body string, saved_at timestamp_ntz"


def stored(spark, *rows):
    return spark.createDataFrame([(i, f"http://h/{i}", "text/html", body, DAY + dt.timedelta(hours=hours)) for i, body, hours in rows], FIELDS)


def test_a_batch_written_twice_gives_one_row_of_each_id(spark, tmp_path):
    path = str(tmp_path / "lake")
    page = "<article><h1>{}</h1>text</article>"
    for _ in range(2):
        L.artifact_write(stored(spark, ("a", page.format("one"), 0), ("b", page.format("two"), 30)), path, "07")
    assert spark.read.parquet(path).count() == 2
    L.artifact_write(stored(spark, ("a", page.format("newer"), 1), ("c", "c", 0), ("c", "c", 0), ("d", "old", 0), ("d", "new", 2)), path, "08")
    lake = L.artifact_read(spark, path)
    assert {r.artifact_id: r.body for r in lake.collect()} == {"a": page.format("newer"), "b": page.format("two"), "c": "c", "d": "new"} and lake.count() == 4
    assert {r.artifact_id: r.copies for r in L.artifact_repeats(spark, path).collect()} == {"a": 2, "c": 2, "d": 2}
    asked = spark.createDataFrame([("r1", "a"), ("r2", "c"), ("r3", "none"), ("r4", "a")], "request_id string, artifact_id string")
    for index in (L.stored_index(lake), L.index_write(L.stored_index(lake), "index_of_test", str(tmp_path / "index"), 4)):
        rows = L.artifact_lookup(asked, index).collect()
        assert sorted((r.request_id, r.error) for r in rows) == [("r1", None), ("r2", None), ("r3", "ARTIFACT_NOT_FOUND"), ("r4", None)]
    wanted = asked.select("request_id", F.lit(None).cast("string").alias("url"), "artifact_id", F.lit("generic.article").alias("adapter"), F.lit("1").alias("adapter_version"))
    found = extract_join(wanted, lake, Adapters()).where("request_id in ('r1', 'r4')").collect()
    assert len(found) == 2 and all('"newer"' in r.data for r in found)


def test_a_retried_batch_leaves_other_batches(spark, tmp_path):
    path = str(tmp_path / "lake")
    L.artifact_write(stored(spark, ("a", "1", 0)), path, "x")
    L.artifact_write(stored(spark, ("b", "2", 0)), path, "y")
    L.artifact_write(stored(spark, ("a", "3", 0)), path, "x")
    assert sorted((r.artifact_id, r.body) for r in L.artifact_read(spark, path).collect()) == [("a", "3"), ("b", "2")]


def test_reading_the_lake_shuffles_no_body(spark, tmp_path):
    path = str(tmp_path / "lake")
    for batch in "12":
        L.artifact_write(stored(spark, *[(f"a{n}", "body", int(batch)) for n in range(20)]), path, batch)
    lake = L.artifact_read(spark, path)
    assert lake.count() == 20
    text = plan(lake)
    exchanges = [part for part in text.split("\n\n") if ") Exchange" in part]
    assert not any("body" in part for part in exchanges), exchanges


def test_lookup_reads_the_index_in_its_buckets(spark, tmp_path):
    index = spark.range(1000).select(F.concat(F.lit("a"), "id").alias("artifact_id"), F.col("id").alias("size_bytes"))
    table = L.index_write(index, "index_in_buckets", str(tmp_path / "index"), 4)
    asked = spark.range(50).select(F.concat(F.lit("a"), F.col("id") * 30).alias("artifact_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = L.artifact_lookup(asked, table)
        assert found.where("error is null").count() == 34
        text = plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in text and text.count("hashpartitioning(artifact_id") <= 1, text


def test_an_address_is_turned_into_a_number_once(spark):
    table = spark.createDataFrame([("10.0.0.1",)], "address string").select(A.address_allowed(F.col("address")).alias("ok"))
    text = table._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("split(") <= 2 and len(text) < 4000

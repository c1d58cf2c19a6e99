"""Cases whose results are fixed: profiles, guard, jobs, artifacts, errors."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import time

from pyspark.sql import functions as F

from pageloom.operators import extract as E
from pageloom.operators import fetchlog as L
from pageloom.operators import guard as G
from pageloom.operators import jobs as J
from pageloom.operators import requests as R
from pageloom.registry import Adapters, resolve
from pageloom.sources import artifacts as A

NOW = dt.datetime(2024, 5, 1, 12)


def profile(spark, html, url):
    frame = spark.createDataFrame([(1, url, bytearray(html.encode()))], "page_id int, url string, html binary")
    return E.profile_extract(frame).first()


def test_profile_with_bounded_periods(spark):
    html = (
        "<title>李 雪</title><div id=menu><p>2001－2002 菜单</p></div><section class='cnt_box'><p>旁注</p></section>"
        "<section class='x cnt_box'><p>1990-1995年 林场技术员<br>1996年—　林业局工程师</p><p>周海，女，生于海边。</p><p>现任站长</p></section>"
    )
    row = profile(spark, html, "https://hb.cppcc.gov.cn/a/b")
    assert (row.name, row.summary, row.current_position, row.error) == ("周海", "周海，女，生于海边。", "现任站长", None)
    assert [tuple(item) for item in row.timeline] == [("1990－1995", "林场技术员1996年—　林业局工程师".replace("　", " "))]
    assert row.title == "李 雪" and row.source_host == "hb.cppcc.gov.cn"


def test_profile_with_points_in_time(spark):
    html = "<h1>周海简历</h1><main><div>2003.9 进厂\n2007年起任组长\n2010年1月 调离</div></main>"
    row = profile(spark, html, "http://plain.example/")
    assert (row.name, row.summary, row.current_position) == ("周海", "", "")
    assert [tuple(item) for item in row.timeline] == [("2003.9", "进厂"), ("2010年1月", "调离")]


def test_profile_with_a_year_and_since(spark):
    """The branch with 起 and no 年, which the pattern of points in time knows."""
    row = profile(spark, "<h1>周海简历</h1><main><div>2007起任组长\n2010年1月起 调离</div></main>", "http://plain.example/")
    assert [tuple(item) for item in row.timeline] == [("2007", "任组长"), ("2010年1月", "调离")]


def test_profile_without_fields_fails(spark):
    assert profile(spark, "<p>nothing here</p>", "http://x.example/").error == "PARSE_FAILED"
    assert profile(spark, "", "http://x.example/").error == "PARSE_FAILED"


def test_empty_page_is_a_parse_failure(spark):
    frame = spark.createDataFrame([(1, "http://x/", ""), (2, "http://x/", None)], "page_id int, url string, html string")
    assert {row.error for row in E.article_extract(frame).collect()} == {"PARSE_FAILED"}
    assert {row.error for row in E.links_extract(frame).collect()} == {"PARSE_FAILED"}


def test_guard(spark):
    urls = spark.createDataFrame(
        [(1, "https://internal.example:8443/path"), (2, "https://user:password@h.example/"), (3, "http://local.example/"),
         (4, "http://nowhere.example/"), (5, "http://10.1.2.3/"), (6, "http://93.184.216.34/"), (7, "http://cidr.example/")],
        "page_id int, url string",
    )
    addresses = spark.createDataFrame(
        [(1, "internal.example", "10.0.0.2"), (2, "h.example", "93.184.216.34"), (3, "local.example", "127.0.0.1"),
         (3, "local.example", "93.184.216.34"), (7, "cidr.example", "10.9.0.1")],
        "page_id int, host string, address string",
    )
    more = spark.createDataFrame(
        [(8, "http://10.9.8.7/"), (9, "http://[fd00::5]/"), (10, "http://[::1]/"), (11, "http://[2606:4700::1]:81/")], "page_id int, url string"
    )
    urls = urls.unionByName(more)
    networks = spark.createDataFrame([("10.9.0.0/16",), ("fd00::/8",)], "cidr string")
    guarded = G.guard_urls(urls, addresses, "page_id", networks=networks, allowed_hosts=["Internal.example."])
    found = {row.page_id: (row.code, row.normalized) for row in guarded.collect()}
    assert found[1] == (None, "https://internal.example:8443/path")
    assert [found[number][0] for number in range(2, 12)] == [
        "INVALID_REQUEST", "DOMAIN_NOT_ALLOWED", "DNS_FAILED", "DOMAIN_NOT_ALLOWED", None, None, None, None, "DOMAIN_NOT_ALLOWED", None,
    ]
    trusted = G.guard_urls(urls, addresses, "page_id", allowed_hosts=["10.1.2.3"]).where("page_id = 5").first()
    assert trusted.code is None


def test_last_line_ends_are_not_accepted(spark):
    rows = [("ok", "art_" + "0" * 32), ("ok\n", "art_" + "0" * 32 + "\n")]
    frame = spark.createDataFrame(rows, "profile string, id string")
    assert [row.ok for row in frame.select(R.artifact_id_valid(F.col("id")).alias("ok")).collect()] == [True, False]
    from pageloom import settings as S

    assert [row.ok for row in frame.select(F.col("profile").rlike(S.PROFILE_PATTERN).alias("ok")).collect()] == [True, False]


def test_one_key_for_all_spellings_of_a_url(spark):
    urls = ["https://Example.org", "https://example.org/", "HTTPS://example.org:443/", "https://example.org/#top"]
    frame = spark.createDataFrame([(u, "auto", "p", "auto", None) for u in urls], "url string, mode string, profile string, proxy_policy string, save_artifact boolean")
    assert R.fetch_keys(frame).select("fetch_key").distinct().count() == 2
    assert R.fetch_keys(frame, normalized=True).select("fetch_key").distinct().count() == 1


def test_size_limit_is_strict(spark):
    frame = spark.createDataFrame([(bytearray(1024),), (bytearray(1025),)], "body binary")
    assert [row.e for row in frame.select(R.body_size_check(F.col("body"), 1024).alias("e")).collect()] == [None, "RESPONSE_TOO_LARGE"]


ITEM = (
    "item_id bigint, job_id bigint, position int, queue string, state string, attempts int, next_run_at timestamp_ntz, created_at timestamp_ntz,"
    " worker_id string, leased_until timestamp_ntz, request_id string, result string, error_code string, error_message string"
)
KEPT = ("w0", "old request", "old result", "OLD", "old message")


def items(spark, *states):
    """Items with traces of what was before."""
    rows = [(n, 1, n, "http", state, attempts, NOW, NOW, KEPT[0], NOW, *KEPT[1:]) for n, (state, attempts) in enumerate(states)]
    return spark.createDataFrame(rows, ITEM)


def traces(row):
    return (row.worker_id, row.request_id, row.result, row.error_code, row.error_message)


def job(spark):
    return spark.createDataFrame([(1, 7, "running", NOW)], "job_id bigint, client_id bigint, prior_state string, created_at timestamp_ntz")


OUTCOMES = (
    "item_id bigint, attempt int, reported_at timestamp_ntz, request_id string, result string, error_code string, error_message string, retry_after_seconds int"
)


def test_job_with_one_success_and_one_final_failure(spark):
    outcomes = spark.createDataFrame(
        [(0, 1, NOW, "req", "{}", None, None, None), (1, 1, NOW, None, None, "INVALID_REQUEST", "bad", None)], OUTCOMES
    )
    now = F.lit(NOW).cast("timestamp_ntz")
    before = items(spark, ("running", 1), ("running", 1), ("cancelled", 1))
    new_items, jobs = J.batch_outcome_apply(before, job(spark), outcomes, now)
    assert tuple(jobs.first()) == (1, 1, 1, "failed")
    found = {row.item_id: row for row in new_items.collect()}
    assert traces(found[0]) == ("w0", "req", "{}", "OLD", "old message") and found[0].leased_until is None
    assert traces(found[1]) == ("w0", "old request", "old result", "INVALID_REQUEST", "bad") and found[1].leased_until is None
    assert traces(found[2]) == KEPT and found[2].leased_until == NOW


def test_retryable_failures_go_back_until_the_third_attempt(spark):
    bad = lambda item, attempt, code, after: (item, attempt, NOW, None, None, code, "m", after)
    outcomes = spark.createDataFrame([bad(0, 1, "READ_TIMEOUT", 0), bad(1, 3, "READ_TIMEOUT", None), bad(2, 2, "CRASH", 30), bad(2, 2, "CRASH", 30)], OUTCOMES)
    failed = J.item_fail(items(spark, ("running", 1), ("running", 3), ("running", 2)), outcomes, F.lit(NOW).cast("timestamp_ntz"))
    found = {row.item_id: (row.state, (row.next_run_at - NOW).total_seconds(), row.error_code) for row in failed.collect()}
    assert found == {0: ("queued", 2.0, "READ_TIMEOUT"), 1: ("failed", 0.0, "READ_TIMEOUT"), 2: ("queued", 30.0, "INTERNAL_ERROR")}


def test_the_latest_attempt_wins(spark):
    rows = [
        (0, 1, NOW, "r9", None, "INVALID_REQUEST", "first", None), (0, 2, NOW, "r1", "{}", None, None, None),
        (1, 2, NOW, "a", "{}", None, None, None), (1, 2, NOW + dt.timedelta(seconds=1), "b", None, "INVALID_REQUEST", "later report", None),
    ]
    after = J.apply_outcomes(items(spark, ("running", 2), ("running", 2)), spark.createDataFrame(rows, OUTCOMES), F.lit(NOW).cast("timestamp_ntz"))
    assert {row.item_id: row.state for row in after.collect()} == {0: "succeeded", 1: "failed"}


def test_rollup_edges(spark):
    def state(*states):
        return J.job_rollup(items(spark, *[(name, 0) for name in states]), job(spark).withColumn("prior_state", F.lit("before"))).first().state

    assert state("cancelled", "cancelled") == "succeeded"
    assert state("succeeded", "failed") == "failed"
    assert state("queued", "running") == "running"
    assert state("queued", "failed") == "before"


def test_cancel(spark):
    cancels = spark.createDataFrame([(1, 7)], "job_id bigint, client_id bigint")
    jobs, after = J.job_cancel(job(spark), items(spark, ("queued", 0), ("succeeded", 1)), cancels)
    assert jobs.first().state == "cancelled" and {row.state for row in after.collect()} == {"cancelled", "succeeded"}
    jobs, after = J.job_cancel(job(spark), items(spark, ("queued", 0), ("running", 1)), cancels)
    assert jobs.first().state == "running" and {row.state for row in after.collect()} == {"cancelled", "running"}
    empty = spark.createDataFrame([], ITEM)
    assert J.job_cancel(job(spark), empty, cancels)[0].first().state == "cancelled"
    other = spark.createDataFrame([(1, 8)], "job_id bigint, client_id bigint")
    assert {row.state for row in J.job_cancel(job(spark), items(spark, ("queued", 0)), other)[1].collect()} == {"queued"}


def test_claim_takes_due_and_abandoned_items(spark):
    hour = dt.timedelta(hours=1)
    rows = [
        (1, "http", "queued", 0, NOW + hour, NOW, None),
        (2, "http", "running", 5, NOW - hour, NOW, NOW - hour),
        (3, "http", "queued", 0, NOW - hour, NOW - hour, None),
        (4, "http", "running", 1, NOW - 2 * hour, NOW, NOW + hour),
        (5, "browser", "queued", 0, NOW, NOW, None),
    ]
    frame = spark.createDataFrame(
        rows, "item_id int, queue string, state string, attempts int, next_run_at timestamp_ntz, created_at timestamp_ntz, leased_until timestamp_ntz"
    )
    now = F.lit(NOW).cast("timestamp_ntz")
    assert [(row.queue, row.item_id) for row in J.claim_order(frame, now, 2).orderBy("queue", "rank").collect()] == [
        ("browser", 5), ("http", 3), ("http", 2),
    ]
    whole = frame.select("*", F.lit(1).cast("bigint").alias("job_id"), F.lit("w0").alias("worker_id"))
    after, jobs = J.item_claim(whole, job(spark).withColumn("prior_state", F.lit("queued")), now, "w")
    claimed = {row.item_id: row for row in after.collect()}
    assert (claimed[3].state, claimed[3].attempts, claimed[3].worker_id) == ("running", 1, "w")
    assert claimed[3].leased_until == NOW + dt.timedelta(seconds=120) and claimed[2].attempts == 5 and claimed[4].worker_id == "w0"
    assert jobs.first().state == "running"


def test_large_jobs_are_shown_whole(spark):
    many = spark.range(2500).select(
        F.col("id").alias("item_id"), F.lit(1).cast("bigint").alias("job_id"), F.col("id").cast("int").alias("position"), F.lit("queued").alias("state"),
        F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("error_code"),
    )
    rows = J.job_view(job(spark), many).collect()
    assert sorted(row.position for row in rows) == list(range(2500)) and {row.item_count for row in rows} == {2500}
    alone = J.job_view(job(spark), many.where("false")).first()
    assert (alone.item_count, alone.item_id) == (0, None)


def test_artifact_tree_on_disk(spark, tmp_path):
    body = "正文".encode()
    folder = tmp_path / "2024/05/01" / hashlib.sha256(body).hexdigest()[:2] / ("art_" + "0" * 32)
    folder.mkdir(parents=True)
    (folder / "body.bin").write_bytes(body)
    (folder / "metadata.json").write_text(json.dumps({"fetched_at": "2024-05-01T00:00:00+00:00", "headers": {}}, indent=2))
    row = A.scan_files(spark, str(tmp_path)).first()
    assert (row.artifact_id, row.size_bytes, row.sha256) == ("art_" + "0" * 32, len(body), hashlib.sha256(body).hexdigest())
    assert row.content_type == "application/octet-stream" and row.created_at == "2024-05-01T00:00:00+00:00"
    assert row.relative_path.startswith("2024/05/01/")


def test_stale_temporary_files(spark, tmp_path):
    for name, age in (("old.tmp", 7200), ("fresh.tmp", 0), ("keep.bin", 7200)):
        path = tmp_path / "a" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
        os.utime(path, (time.time() - age, time.time() - age))
    stale = A.stale_tmp_select(A.file_listing(spark, str(tmp_path)), F.current_timestamp())
    assert [row.path.rsplit("/", 1)[1] for row in stale.collect()] == ["old.tmp"]


def test_redaction_at_write(spark, tmp_path):
    frame = spark.createDataFrame(
        [("art_1", None, {"Authorization": "secret", "content-type": "a"}, "x", NOW)],
        "artifact_id string, content_type string, headers map<string,string>, body string, saved_at timestamp_ntz",
    )
    A.artifact_write(frame, str(tmp_path / "lake"), "a")
    A.artifact_write(frame.withColumn("artifact_id", F.lit("art_2")), str(tmp_path / "lake"), "b")
    lake = A.artifact_read(spark, str(tmp_path / "lake"))
    assert lake.count() == 2 and A.artifact_repeats(spark, str(tmp_path / "lake")).count() == 0
    assert A.stored_index(lake).exceptAll(A.artifact_index(lake)).count() == 0
    row = lake.where("artifact_id = 'art_1'").first()
    assert row.headers == {"Authorization": "[REDACTED]", "content-type": "a"}
    assert row.relative_path == f"2024/05/01/{hashlib.sha256(b'x').hexdigest()[:2]}/art_1"


def test_latest_adapter_is_the_numerically_highest(spark):
    adapters = Adapters()
    links = dict(adapters.items())["generic.links", "1"]
    adapters.register("generic.links", "9", links)
    adapters.register("generic.links", "10", links)
    asked = spark.createDataFrame(
        [(1, "generic.links", "latest"), (2, "generic.links", "9"), (3, "generic.links", "8"), (4, "none", "latest")],
        "request_id int, adapter string, adapter_version string",
    )
    found = {row.request_id: (row.resolved_version, row.error) for row in resolve(asked, adapters.table(spark)).collect()}
    assert found == {1: ("10", None), 2: ("9", None), 3: (None, "ADAPTER_NOT_FOUND"), 4: (None, "ADAPTER_NOT_FOUND")}


def test_upgrade_reasons(spark):
    long = "<p>" + "x" * 300 + "</p>"
    rows = [
        (429, "text/html", long, None), (200, "application/json", "{}", None), (200, "text/HTML", "  <p>short</p> ", None),
        (200, "text/html", long + "Just a moment...", None), (200, "text/html", long, "h1"), (200, "text/html", long, "p"),
        (200, None, "x", "p"), (500, "text/html", long, ""), (200, "text/html", long, "p > b"), (200, "text/html", "<!--" + "x" * 300 + "-->", "p"),
    ]
    frame = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "n int, status_code int, content_type string, body string, required_selector string")
    assert [row.upgrade_reason for row in L.upgrade_reason(frame).orderBy("n").collect()] == [
        "status_429", None, "html_too_short", "javascript_challenge", "required_selector_missing", None, None, None,
        None, "invalid_html",
    ]
    assert [row.error for row in L.upgrade_reason(frame).where("n >= 7").orderBy("n").collect()] == [None, "selector_unsupported", None]

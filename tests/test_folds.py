"""Running aggregates and chains against plain loops on random logs."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import cache as C
from pageloom.operators import fetchlog as L
from pageloom.operators import politeness as P
from pageloom.operators import redirects as D
from pageloom.plans.running import running, with_chunk

BASE = dt.datetime(2024, 1, 1)
EPOCH = dt.datetime(1970, 1, 1)
LOG = "fetch_key string, request_id bigint, ts timestamp, ttl int, force_refresh boolean, success boolean, elapsed_ms bigint"


def us(ts):
    return round((ts - EPOCH).total_seconds() * 1e6)


def random_log(seed, size=400):
    rng = random.Random(seed)
    # one key holds most of the rows, some times are equal
    return [
        (
            rng.choice("aaaab"),
            number,
            BASE + dt.timedelta(seconds=rng.randrange(2000) / 4),
            rng.choice([0, 3, 10, 60]),
            rng.random() < 0.15,
            rng.random() < 0.8,
            rng.choice([10, 500, 3000]),
        )
        for number in range(size)
    ]


def before(rows, key, place):
    """Each row's earlier rows of its key, in order."""
    for row in rows:
        yield row, sorted((r for r in rows if r[key] == row[key] and place(r) < place(row)), key=place)


@pytest.mark.parametrize("negative", [None, 5])
def test_reuse_of_recorded_entries(spark, negative):
    log = random_log(1)
    want = {}
    for row, earlier in before(log, 0, lambda r: (r[2], r[1])):
        entries = [r for r in earlier if r[3] > 0 and (r[5] or negative is not None)]
        outcome = "miss"
        if entries and not row[4] and row[3] > 0:
            last = entries[-1]
            life = last[3] if last[5] else min(last[3], negative or 0)
            if us(last[2]) + life * 1_000_000 > us(row[2]):
                outcome = "hit" if last[5] else "negative_hit"
        want[row[1]] = outcome
    frame = spark.createDataFrame(log, LOG)
    found = C.cache_replay(frame) if negative is None else C.negative_cache(frame, negative)
    assert {row.request_id: row.outcome for row in found.collect()} == want
    assert len(set(want.values())) == (2 if negative is None else 3)


def test_requests_while_the_key_is_in_flight(spark):
    log = random_log(3)
    want = {}
    for row, earlier in before(log, 0, lambda r: (r[2], r[1])):
        busy = max((us(r[2]) + r[6] * 1000 for r in earlier), default=None)
        want[row[1]] = (busy, busy is not None and busy > us(row[2]))
    found = C.inflight_merge(spark.createDataFrame(log, LOG), chunk_us=20_000_000)
    assert {row.request_id: (row.busy_until, row.overlaps) for row in found.collect()} == want


def test_most_recently_used_keys(spark):
    log = random_log(2)
    last = {key: max((us(r[2]), r[1]) for r in log if r[0] == key) for key in "ab"}
    order = sorted("ab", key=last.get, reverse=True)
    assert [row.fetch_key for row in C.lru_resident(spark.createDataFrame(log, LOG), 1).collect()] == order[:1]
    assert [(row.fetch_key, row.last_used_at, row.last_request) for row in C.lru_resident(spark.createDataFrame(log, LOG)).collect()] == [(k, *last[k]) for k in order]


def random_outcomes(seed, size=300):
    rng = random.Random(seed)
    return [
        (n, rng.choice("xxxy"), BASE + dt.timedelta(seconds=rng.randrange(1500) / 2), rng.choice([True, True, False, None]))
        for n in range(size)
    ]


@pytest.mark.parametrize("chunk_us", [1_000_000, 50_000_000])
def test_runs_of_failures(spark, chunk_us):
    rows = random_outcomes(4)
    want = []
    for domain in "xy":
        run = []
        for _, _, ts, failed in [*sorted((r for r in rows if r[1] == domain), key=lambda r: (r[2], r[0])), (0, domain, BASE, False)]:
            if failed:
                run.append(us(ts))
            elif failed is False:
                if len(run) >= 3:
                    want.append((domain, run[0], run[-1], len(run)))
                run = []
    frame = spark.createDataFrame(rows, "request_id bigint, domain string, ts timestamp, failed boolean")
    found = P.circuit_breaker(frame, 3, chunk_us)
    assert sorted((r.domain, r.start_us, r.end_us, r.failures) for r in found.collect()) == sorted(want) and want


@pytest.mark.parametrize("chunk_us", [1_000_000, 30_000_000, 10**12])
def test_recorded_gaps(spark, chunk_us):
    rows = random_outcomes(5)
    frame = spark.createDataFrame(rows, "request_id bigint, domain string, ts timestamp, failed boolean")
    want = {}
    for row, earlier in before(rows, 1, lambda r: (r[2], r[0])):
        gap = us(row[2]) - us(earlier[-1][2]) if earlier else None
        want[row[0]] = (gap, 0 if gap is None else max(0, 1_000_000 - gap))
    assert {row.request_id: (row.gap_us, row.short_us) for row in P.rate_slots(frame, 1_000_000, chunk_us).collect()} == want


def test_domain_concurrency(spark):
    rng = random.Random(6)
    flights = [(rng.choice("pq"), start, start + rng.randrange(1, 60)) for start in (rng.randrange(300) for _ in range(200))]
    found = {
        row.domain: (row.peak, row.requests, row.above_limit)
        for row in P.domain_concurrency(
            spark.createDataFrame(flights, "domain string, start_us bigint, end_us bigint"), 4, chunk_us=25
        ).collect()
    }
    for domain in "pq":
        moves = sorted(
            [(start, 1) for owner, start, _ in flights if owner == domain]
            + [(end, -1) for owner, _, end in flights if owner == domain],
        )
        level = peak = above = 0
        for _, step in moves:
            level += step
            peak = max(peak, level)
            above += step == 1 and level > 4
        assert found[domain] == (peak, sum(owner == domain for owner, _, _ in flights), above)


def test_running_aggregates_equal_one_window(spark):
    rng = random.Random(7)
    rows = [(rng.choice("kkkl"), rng.randrange(500), n, rng.choice([None, rng.randrange(100)])) for n in range(300)]
    frame = spark.createDataFrame(rows, "k string, at bigint, id bigint, v bigint")
    line = with_chunk(frame, F.col("at"), 40)
    for backward in (False, True):
        for exclusive in (False, True):
            result = running(
                line, ["k"], ["at", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v"))}, backward, exclusive
            )
            found = {row.id: (row.s, row.m, row.l) for row in result.collect()}
            for key in "kl":
                own = sorted((row for row in rows if row[0] == key), key=lambda row: (row[1], row[2]), reverse=backward)
                for place, row in enumerate(own):
                    values = [r[3] for r in own[: place + (not exclusive)] if r[3] is not None]
                    want = (sum(values), max(values, default=None), min(values, default=None))
                    assert found[row[2]] == want


def plain_redirects(hops, limit, refused):
    steps = dict(hops)
    outcome = {}
    for start in steps:
        node, seen, code = start, [], None
        for _ in range(limit + 1):
            if node in refused:
                code = "DOMAIN_NOT_ALLOWED"
                seen.append(node)
                break
            if node in seen:
                code = "REDIRECT_LOOP"
                break
            seen.append(node)
            if node not in steps:
                code = "NOT_RECORDED"
                break
            if steps[node] is None:
                break
            node = steps[node]
        else:
            code = "TOO_MANY_REDIRECTS"
        outcome[start] = (seen[-1] if code is None else None, len(seen) - 1, code)
    return outcome


@pytest.mark.parametrize("limit", [0, 1, 3, 10])
@pytest.mark.parametrize("guarded", [False, True])
def test_redirects(spark, limit, guarded):
    rng = random.Random(limit)
    # many pages lead to page 7, which is final
    hops = [(n, None if n == 7 else rng.choice([7, rng.randrange(60), n + 1, None])) for n in range(60)]
    refused = {3, 11, 20} if guarded else set()
    verdicts = None
    if guarded:
        verdicts = spark.createDataFrame(
            [(n, "DOMAIN_NOT_ALLOWED" if n in refused else None) for n in range(60)], "src bigint, code string"
        )
    frame = spark.createDataFrame(hops, "src bigint, dst bigint")
    found = {row.src: (row.final, row.hops, row.code) for row in D.redirect_resolve(frame, limit, verdicts).collect()}
    assert found == plain_redirects(hops, limit, refused)


def test_retry_fold_ends(spark):
    rows = [
        ("ok", 1, 503, None), ("ok", 2, 503, None), ("ok", 3, 200, None),
        ("first", 1, 200, None), ("first", 2, 503, None),
        ("net", 1, None, "READ_TIMEOUT"), ("net", 2, None, "CONNECT_FAILED"), ("net", 3, None, "READ_TIMEOUT"), ("net", 4, 200, None),
        ("guard", 1, 503, None), ("guard", 2, None, "DOMAIN_NOT_ALLOWED"), ("guard", 3, 200, None),
        ("short", 1, 503, None),
    ]
    frame = spark.createDataFrame(rows, "request_id string, sequence int, status_code int, error_code string").withColumn(
        "elapsed_ms", F.lit(5)
    )
    found = {row.request_id: (row.n_attempts, row.final_status, row.final_error) for row in L.retry_fold(frame).collect()}
    assert found == {
        "ok": (3, 200, None),
        "first": (1, 200, None),
        "net": (3, None, "READ_TIMEOUT"),
        "guard": (2, None, "DOMAIN_NOT_ALLOWED"),
        "short": (1, 503, None),
    }


def test_repeated_attempt_rows_count_once(spark):
    rows = [("a", 1, 503)] * 50 + [("a", 2, 200)] * 50
    frame = spark.createDataFrame(rows, "request_id string, sequence int, status_code int").withColumn("elapsed_ms", F.lit(1))
    assert L.attempts_kept(frame).count() == 2


def test_redirects_from_recorded_urls(spark):
    rows = [
        ("HTTP://Site.example.org:80/a", 302, "b?x=1#top"), ("http://site.example.org/b?x=1", 308, "//other.example.org/c/../d"),
        ("http://other.example.org/c/../d", 200, "/unused"), ("http://other.example.org/d", 200, None),
        ("http://site.example.org/l", 301, "HTTP://SITE.example.org:80/l#again"), ("http://site.example.org/y", 301, "/gone"),
    ]
    hops = D.hops_of(spark.createDataFrame(rows, "url string, status_code int, location string"))
    found = {row.src: (row.final, row.hops, row.code) for row in D.redirect_resolve(hops).collect()}
    assert found["http://site.example.org/a"] == ("http://other.example.org/c/../d", 2, None)
    assert found["http://site.example.org/l"] == (None, 0, "REDIRECT_LOOP")
    assert found["http://site.example.org/y"] == (None, 1, "NOT_RECORDED")


def test_no_response_carries_its_body_through_a_join(spark, data):
    """Bodies were joined to the responses and then dealt out with them by request."""
    from pageloom.catalog import QUERIES

    plan = QUERIES["response_project"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    digest = plan.index("md5(cast(html")
    assert plan.index("Join") < digest and "body#" not in plan


def test_responses_with_a_digest_in_place_of_the_body(spark):
    columns = "request_id int, requested_url string, final_url string, status_code int, strategy string, elapsed_ms bigint, content_type string, {} string, artifact_id string, fetched_at timestamp, attempts array<string>, hit boolean, stale boolean"
    row = (1, "u", "u", 200, "http", 7, None, "x", None, BASE, ["a"], True, None)
    for name in ("body", "body_md5"):
        found = L.response_project(spark.createDataFrame([row], columns.format(name))).first()
        assert (found[name], found.elapsed_ms, found.attempts, found.stale) == ("x", 0, [], False)

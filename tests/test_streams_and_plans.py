"""Streams over many files equal the batch result; plans keep their shape."""

from __future__ import annotations

import datetime as dt
import functools
import os

import pytest
from pyspark.sql import functions as F

from pageloom.operators import jobs as J
from pageloom.operators import metrics as M
from pageloom.sources import fixtures, tables
from pageloom.streaming import jobs as Z
from __spark_entry__ import queries

from .test_folds import LOG, random_log


def in_files(spark, frame, folder, parts=5):
    """Write rows in time order into several files, oldest first."""
    rows = frame.orderBy("ts", "request_id").collect()
    size = len(rows) // parts + 1
    for number in range(parts):
        piece = spark.createDataFrame(rows[number * size : (number + 1) * size], frame.schema)
        piece.coalesce(1).write.parquet(f"{folder}/part{number}")
    return (
        spark.readStream.schema(frame.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(str(folder))
    )


@pytest.fixture
def log(spark):
    return spark.createDataFrame(random_log(11, 200), LOG)


def test_use_per_key_and_hour_over_many_batches(spark, log, tmp_path):
    found = Z.latest_update(Z.run_to_end(Z.stream_cache(in_files(spark, log, tmp_path / "log")), "t", "update"), ["fetch_key", "hour"])
    want = log.groupBy("fetch_key", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.max("ts").alias("last_used"))
    assert sorted(found.select("fetch_key", "hour", "n", "n_success", "last_used").collect()) == sorted(want.collect())


def test_requests_per_slot_over_many_batches(spark, log, tmp_path):
    stream = in_files(spark, log, tmp_path / "log").withColumn("domain", F.col("fetch_key"))
    found = Z.latest_update(Z.run_to_end(Z.stream_rate_slots(stream, "1 minute"), "t", "update"), ["domain", "slot"])
    want = log.groupBy("fetch_key", F.date_trunc("minute", "ts").alias("slot")).count()
    assert {(r.domain, r.slot): (r.n, r.above) for r in found.collect()} == {(r.fetch_key, r.slot): (r["count"], r["count"] - 1) for r in want.collect()}


@pytest.mark.parametrize("folder", [False, True])
def test_table_stream_reads_files_and_folders(spark, tmp_path, folder):
    rows = spark.range(100).withColumn("ts", F.timestamp_seconds(F.col("id") * 30))
    if folder:
        rows.repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    else:
        rows.toPandas().to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    rows.limit(3).toPandas().to_parquet(f"{tmp_path}/events_old.parquet", coerce_timestamps="us")
    stream = Z.table_stream(spark, str(tmp_path), "events", files_per_trigger=2)
    got = Z.run_to_end(stream, "t")
    assert got.count() == 100 and got.select("_batch").distinct().count() == (4 if folder else 1)


def test_counter_stream_over_many_batches(spark, log, tmp_path):
    named = log.withColumns({"method": F.lit("GET"), "path": F.col("fetch_key"), "status": F.lit(200), "seconds": F.lit(1.0)})
    updates = Z.run_to_end(Z.stream_request_counters(in_files(spark, named, tmp_path / "log")), "t", "update")
    latest = Z.latest_update(updates, ["minute", "method", "path", "status"])
    found = {(row.minute, row.path): row.n for row in latest.collect()}
    want = named.groupBy(F.date_trunc("minute", "ts").alias("minute"), "path").count().collect()
    assert found == {(row["minute"], row.path): row["count"] for row in want}


def test_dedupe_stream(spark, log, tmp_path):
    passed = Z.run_to_end(Z.stream_inflight_dedupe(in_files(spark, log, tmp_path / "log")), "t").drop("_batch").collect()
    want = log.select("fetch_key", F.date_trunc("hour", "ts").alias("hour")).distinct().collect()
    assert sorted(passed) == sorted(want)


def test_job_stream_survives_repeated_events(spark, data, tmp_path):
    fixtures.register(spark, data, "f_job_items", "f_jobs", "f_outcomes")
    items, jobs, outcomes = (spark.table(name) for name in ("f_job_items", "f_jobs", "f_outcomes"))
    for copy in range(2):
        outcomes.write.parquet(f"{tmp_path}/o/copy{copy}")
    stream = spark.readStream.schema(outcomes.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/o")
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    after_items, after = Z.stream_job_state(stream, items, jobs, now)
    batch_items, batch = J.batch_outcome_apply(items, jobs, outcomes, now)
    assert sorted(after.collect()) == sorted(batch.collect())
    assert after_items.exceptAll(batch_items.select(after_items.columns)).count() == 0


@pytest.mark.parametrize("name", ["stream_cache", "stream_inflight_dedupe", "stream_rate_slots", "stream_request_counters"])
def test_table_streams_are_whole_for_files_in_any_order(spark, data, tmp_path, monkeypatch, name):
    """Newest file first, then mixed ones: a watermark would drop almost everything after the first batch."""
    events = spark.read.parquet(f"{data}/events.parquet")
    newest, rest = (events.orderBy(F.desc("ts")).limit(50), events.orderBy("ts").limit(events.count() - 50))
    newest.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rest.repartition(4, F.pmod(F.hash("event_id"), F.lit(4))).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    for table in set(tables.TABLES) - {"events"}:
        os.symlink(f"{data}/{table}.parquet", f"{tmp_path}/{table}.parquet")
    whole = queries()[name](spark, data).collect()
    monkeypatch.setattr(Z, "table_stream", functools.partial(Z.table_stream, files_per_trigger=1))
    found = queries()[name](spark, str(tmp_path)).collect()
    assert whole and sorted(found) == sorted(whole)


def plan(frame) -> str:
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_claim_limits_before_the_shuffle(spark, data):
    text = plan(queries()["claim_order"](spark, data))
    assert text.count("WindowGroupLimit") >= 2


def test_scans_are_narrow(spark, data):
    assert "html" not in plan(tables.page_scan(spark, data, "page_id", "url"))
    digest = plan(queries()["distinct_artifact_digest"](spark, data))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in digest
    assert "n_chars" not in digest


def test_projections_do_not_shuffle(spark, data):
    for name in ("request_prepare", "request_validate", "url_normalize", "url_join", "timeline_parse", "upgrade_reason"):
        assert "hashpartitioning" not in plan(queries()[name](spark, data)), name


def test_running_aggregates_shuffle_by_chunk(spark, data):
    text = plan(queries()["rate_slots"](spark, data))
    assert "hashpartitioning(domain" in text and "_chunk" in text and "_group" in text


def test_levels_of_a_chain_read_one_exchange(spark):
    from pageloom.operators import redirects

    hops = spark.range(50).select(F.col("id").alias("src"), F.when(F.col("id") < 40, F.col("id") + 1).alias("dst"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    resolved = redirects.redirect_resolve(hops)
    resolved.collect()
    text = plan(resolved)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("ReusedExchange") >= 4 or text.count("Exchange") < 40


def test_log_lines_drop_missing_fields(spark):
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), "INFO", "l", "m", "r1", None)],
        "timestamp timestamp, level string, logger string, message string, request_id string, error_code string",
    )
    assert tables.log_lines(rows).first().value == (
        '{"timestamp":"2024-01-01T00:00:00.000000+00:00","level":"INFO","logger":"l","message":"m","request_id":"r1"}'
    )


def test_approximate_latency_is_close(spark):
    frame = spark.range(1000).select(F.lit("d").alias("domain"), F.lit("http").alias("strategy"), F.col("id").alias("elapsed_ms"))
    exact, rough = (M.latency_by_domain_strategy(frame, flag).where("strategy IS NOT NULL").first().p95_ms for flag in (True, False))
    assert abs(exact - rough) <= 5


def test_sketches_of_hours_are_merged_within_their_bound(spark):
    """Skewed latencies, hours of very different size, two sizes of sketch."""
    rows = spark.range(60_000).select(
        (F.timestamp_seconds(F.pow(F.col("id"), 1.3))).alias("ts"), F.concat(F.lit("d"), F.col("id") % 2).alias("domain"), F.lit("http").alias("strategy"),
        F.pow(F.pmod(F.hash("id"), F.lit(1000)), 2).cast("long").alias("elapsed_ms"),
    ).unionAll(spark.createDataFrame([(None, "none", "http", None)], "ts timestamp, domain string, strategy string, elapsed_ms long"))
    for k in (100, 800):
        hours = M.latency_sketches(rows, k)
        assert hours.count() > 100
        for r in M.latency_of(hours.where("hour >= '1970-01-02'"), k=k).where("domain is null or domain <> 'none'").collect():
            part = rows.where("ts >= '1970-01-02'").where(F.lit(r.domain is None) | (F.col("domain") == r.domain))
            n, below, up_to = part.agg(F.count("*"), F.count_if(F.col("elapsed_ms") < r.p95_ms), F.count_if(F.col("elapsed_ms") <= r.p95_ms)).first()
            assert r.n == n and below / n <= 0.95 + 2 * M.rank_error(k) and up_to / n >= 0.95 - 2 * M.rank_error(k)
    empty = M.latency_of(hours).where("domain = 'none'").first()
    assert empty.n == 0 and empty.p95_ms is None

"""Change sets of job items, keyed stream state, range places, pruned scans and documents as VARIANT."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import guard as G
from pageloom.operators import jobs as J
from pageloom.plans import running as P
from pageloom.sources import artifacts as A
from pageloom.sources import fixtures, jobs_io, tables
from pageloom.streaming import jobs as Z

from .test_streams_and_plans import plan

def now():
    return F.lit("1998-06-01").cast("timestamp_ntz")


@pytest.fixture
def job_tables(spark, data):
    fixtures.register(spark, data, "f_queue", "f_job_items", "f_jobs", "f_outcomes")
    return spark.table("f_queue"), spark.table("f_jobs"), spark.table("f_outcomes")


def same(one, two):
    columns = sorted(set(one.columns) & set(two.columns))
    one, two = one.select(columns), two.select(columns)
    return one.exceptAll(two).count() == two.exceptAll(one).count() == 0 and one.count() == two.count()


def test_a_claim_of_ten_writes_ten_rows(spark, job_tables, tmp_path):
    items, jobs, _ = job_tables
    path = str(tmp_path / "t")
    jobs_io.write_base(items, path, 4)
    base = jobs_io.read_items(spark, path, changed=False)
    for _ in range(2):  # repeated after a failure
        jobs_io.append_changes(J.claim_changes(base, now(), "w1", 5).drop("version", "part"), path, 1, 4)
    assert spark.read.parquet(f"{path}/changes").count() == 10
    whole, _ = J.item_claim(items, jobs, now(), "w1", 5)
    assert same(jobs_io.read_items(spark, path).drop("part", "version"), whole)
    text = plan(jobs_io.read_items(spark, path))
    assert "BroadcastHashJoin LeftAnti" in text or "SortMergeJoin LeftAnti" in text or "LeftAnti" in text


def test_changes_are_brought_into_touched_parts_only(spark, job_tables, tmp_path):
    items, _, outcomes = job_tables
    path = str(tmp_path / "t")
    jobs_io.write_base(items, path, 8)
    files = lambda: {r.f: r.n for r in spark.read.parquet(f"{path}/items").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    before = files()
    some = outcomes.where(F.pmod(F.xxhash64("item_id"), F.lit(8)) < 2)
    for version in (1, 2):
        read = jobs_io.read_items(spark, path, changed=version > 1)
        jobs_io.append_changes(J.outcome_changes(read, some.where(F.col("item_id") % 2 == version - 1), now()).drop("version", "part"), path, version, 8)
    want = J.apply_outcomes(items, some, now())
    assert same(jobs_io.read_items(spark, path).drop("part", "version"), want)
    jobs_io.compact(spark, path)
    for changed in (True, False):  # the change sets are superfluous now
        assert same(jobs_io.read_items(spark, path, changed).drop("part", "version"), want)
    kept = set(before) & set(files())
    assert 0 < len(set(before) - kept) <= 2 * len(before) / 8 + 1 and kept


def test_job_state_survives_a_restart_and_disorder(spark, job_tables, tmp_path):
    """Two runs over one progress log, events shuffled over files, some of them twice."""
    items, jobs, outcomes = job_tables
    rows = outcomes.collect()
    rows += random.Random(3).sample(rows, len(rows) // 5)
    random.Random(4).shuffle(rows)
    read = lambda: spark.readStream.schema(outcomes.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/o")
    want_items, want_jobs = J.batch_outcome_apply(items, jobs, outcomes, now())
    for run in range(2):
        for number in range(2):
            part = rows[(2 * run + number) :: 4]
            spark.createDataFrame(part, outcomes.schema).coalesce(1).write.parquet(f"{tmp_path}/o/{run}{number}")
        found_items, found_jobs = Z.stream_job_state(read(), items, jobs, now(), at=f"{tmp_path}/log")
    assert same(found_items, want_items) and same(found_jobs, want_jobs)
    assert spark.read.parquet(f"{tmp_path}/log").select("_batch").distinct().count() == 4


def test_state_ends_with_the_item(spark, tmp_path):
    """Only open items are kept; the state operator is in the plan of the stream."""
    kind = "item_id long, attempt int, reported_at timestamp_ntz, request_id string, result string, error_code string, error_message string, retry_after_seconds int"
    rows = [(1, 1, None, "a", "{}", None, None, None), (2, 1, None, "b", None, "READ_TIMEOUT", "m", 5), (3, 1, None, "c", None, "INVALID_REQUEST", "m", None), (4, 3, None, "d", None, "READ_TIMEOUT", "m", None)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/o")
    stream = Z.latest_outcomes(spark.readStream.schema(kind).parquet(f"{tmp_path}/o"))
    query = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start()
    query.awaitTermination()
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 1 and "State" in state["operatorName"]


def test_live_streams_keep_state_and_refuse_late_rows(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{n % 7}", n * 600) for n in range(200)], "fetch_key string, s long").select("fetch_key", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("ts"))
    rows.where("ts >= '2001-09-10'").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows.where("ts < '2001-09-10'").repartition(3).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = lambda: Z.table_stream(spark, str(tmp_path), "events", files_per_trigger=1)
    want = rows.select("fetch_key", F.date_trunc("hour", "ts").alias("hour")).distinct()
    whole = Z.run_to_end(Z.stream_inflight_dedupe(stream(), Z.span(spark, str(tmp_path), "events")), "t", whole=True)
    assert same(whole.drop("_batch"), want)
    with pytest.raises(Z.LateRows):
        Z.run_to_end(Z.stream_inflight_dedupe(stream(), "1 minute"), "t", whole=True)
    query = Z.stream_inflight_dedupe(stream(), "1 hour").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["operatorName"] == "dedupeWithinWatermark"


def test_places_of_a_host_with_very_many_addresses(spark, request):
    many = spark.range(200_000).select(F.lit("hot").alias("host"), F.md5(F.col("id").cast("string")).alias("address"))
    few = spark.createDataFrame([("b", "2"), ("b", "1"), ("b", "2"), ("a", "x"), (None, "x"), ("c", None)], "host string, address string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart, as large ones do
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    found = G.addresses_sorted(many.unionAll(few.repartition(2)))
    assert [tuple(r) for r in found.where("host <> 'hot'").orderBy("host", "place").collect()] == [("a", "x", 1), ("b", "1", 1), ("b", "2", 2)]
    hot = found.where("host = 'hot'")
    assert hot.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first() == (1, 200_000, 200_000)
    places = [r.address for r in hot.orderBy("place").collect()]
    assert places == sorted(places)
    assert hot.select(F.spark_partition_id()).distinct().count() > 1 and "_part" in plan(found)
    assert P.range_places(few.where("false"), ["host"], ["address"]).count() == 0


def test_retention_reads_old_days_only(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("record_id"), F.when(F.col("id") % 2 == 0, "raw").otherwise("audit").alias("kind"), (F.lit("2024-01-01").cast("timestamp_ntz") - F.make_dt_interval(F.col("id").cast("int"))).alias("created_at"))
    rows.withColumn("dt", F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM-dd")).write.partitionBy("dt").parquet(f"{tmp_path}/r")
    stored = spark.read.schema("record_id long, kind string, created_at timestamp_ntz, dt string").parquet(f"{tmp_path}/r")
    references = spark.createDataFrame([(100,), (380,)], "record_id long")
    expired = A.retention_expired(stored, references, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {r.record_id for r in expired.collect()} == {n for n in range(400) if n > (30 if n % 2 == 0 else 365) and n not in (100, 380)}
    assert "PartitionFilters: [isnotnull(dt" in plan(expired)


def test_documents_keep_what_no_field_names(spark, tmp_path):
    texts = ['{"url":"http://x/","extra":{"b":[1,null]},"cache_ttl":"soon","mode":null}', "[1]", "7", "{", "", None, '{"headers":{"A":"b"},"save_artifact":true}']
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", tables.payload_variant(F.col("text")).alias("p")).select("id", "p.*")
    table.write.parquet(f"{tmp_path}/v")
    rows = {r.id: r for r in spark.read.parquet(f"{tmp_path}/v").withColumn("again", tables.serialize_document(F.col("document"))).collect()}
    assert rows[0].again == '{"cache_ttl":"soon","extra":{"b":[1,null]},"mode":null,"url":"http://x/"}'
    assert (rows[0].request.url, rows[0].request.mode, rows[0].request.cache_ttl, rows[0].unread) == ("http://x/", "auto", None, None)
    assert [rows[n].unread for n in (1, 2, 3, 4, 5)] == ["[1]", "7", "{", "", None] and all(rows[n].request is None and rows[n].document is None for n in (1, 2, 3, 4, 5))
    assert rows[6].request.headers == {"A": "b"} and rows[6].request.save_artifact is True

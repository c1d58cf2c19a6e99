"""Artifact lake and log files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timing as T
from ..functions.timing import micros
from ..session import scratch_path
from ..sources import artifacts as A
from ..sources import tables
from .book import query

_NOW = "2024-01-01 00:00:00"


def now():
    return F.lit(_NOW).cast("timestamp_ntz")


_TYPE = "CASE artifact_no % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' END"


def bodies(spark):
    return spark.table("f_artifacts").select(
        F.concat(F.lit("art_"), F.md5(F.col("artifact_no").cast("string"))).alias("artifact_id"),
        "artifact_no",
        F.expr(_TYPE).alias("content_type"),
        T.plus_seconds(now(), (F.col("artifact_no") % 3) * 86400).alias("saved_at"),
        F.create_map(F.lit("Authorization"), F.col("source"), F.lit("X-Lang"), F.col("lang")).alias("headers"),
        "body",
    )


_PATH = """concat_ws('/', strftime(TIMESTAMP '2024-01-01' + to_days(CAST(artifact_no % 3 AS INTEGER)), '%Y/%m/%d'), sha256(body)[1:2],
 concat('art_', md5(CAST(artifact_no AS VARCHAR))))"""


def lake(spark, rows):
    """A lake of two batches, the second one written twice; every third artifact is in both, older in the first."""
    path = scratch_path(spark, "artifacts")
    earlier = rows.where(F.col("artifact_no") % 3 != 1).withColumns({"saved_at": T.plus_seconds(F.col("saved_at"), F.lit(-60)), "body": F.lit("older")})
    A.artifact_write(earlier.where(F.col("artifact_no") % 3 == 0).unionAll(rows.where(F.col("artifact_no") % 3 == 2)), path, "1")
    for _ in range(2):
        A.artifact_write(rows.where(F.col("artifact_no") % 3 != 2), path, "2")
    return A.artifact_read(spark, path)


@query(
    "artifact_write",
    "f_artifacts",
    sql=f"""SELECT artifact_no, {_PATH} AS relative_path, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS size_bytes,
 coalesce({_TYPE}, 'application/octet-stream') AS content_type, '[REDACTED]' AS auth, lang FROM f_artifacts""",
)
def artifact_write(spark, root):
    """Writes the lake below the shared folder in batches, one of them twice, and reads it back."""
    return lake(spark, bodies(spark)).select(
        "artifact_no",
        "relative_path",
        "sha256",
        "size_bytes",
        "content_type",
        F.col("headers")["Authorization"].alias("auth"),
        F.col("headers")["X-Lang"].alias("lang"),
    )


@query(
    "artifact_index",
    "f_artifacts",
    sql=f"""SELECT concat('art_', md5(CAST(artifact_no AS VARCHAR))) AS artifact_id, coalesce({_TYPE}, 'application/octet-stream') AS content_type,
 CAST(strlen(body) AS BIGINT) AS size_bytes, sha256(body) AS sha256, {_PATH} AS relative_path,
 epoch_us(TIMESTAMP '2024-01-01' + to_days(CAST(artifact_no % 3 AS INTEGER))) AS created_us FROM f_artifacts""",
)
def artifact_index(spark, root):
    return A.artifact_index(bodies(spark)).withColumn("created_us", micros(F.col("created_at"))).drop("created_at")


@query(
    "artifact_lookup",
    "f_requests",
    "f_artifacts",
    sql="""SELECT request_id, sha256(a.body) AS sha256, CASE WHEN a.artifact_no IS NULL THEN 'ARTIFACT_NOT_FOUND' END AS error
FROM f_requests LEFT JOIN f_artifacts a ON artifact_no = page_id * 7""",
)
def artifact_lookup(spark, root):
    """Requests ask for seven times their page number, which goes beyond the last artifact, in a lake that was written twice."""
    path = scratch_path(spark, "artifact-index")
    index = A.index_write(A.stored_index(lake(spark, bodies(spark))), "artifact_index_" + path[-32:], path, 8)
    asked = spark.table("f_requests").select(
        "request_id", F.concat(F.lit("art_"), F.md5((F.col("page_id") * 7).cast("string"))).alias("artifact_id")
    )
    return A.artifact_lookup(asked, index).select("request_id", "sha256", "error")


@query(
    "distinct_artifact_digest",
    "f_artifacts",
    sql="SELECT sha256(body) AS sha256, count(*) AS copies, min(artifact_no) AS first_artifact FROM f_artifacts GROUP BY 1",
)
def distinct_artifact_digest(spark, root):
    return A.distinct_digest(spark.table("f_artifacts"))


_LISTING = """SELECT doc_id, concat('a/', doc_id, CASE doc_id % 3 WHEN 0 THEN '/body.bin.tmp' WHEN 1 THEN '/x.tmp' ELSE '/body.bin' END) AS path,
 n_chars AS length FROM documents"""


@query(
    "stale_tmp_select",
    sql=f"SELECT path, count(*) OVER () AS found FROM ({_LISTING}) WHERE path LIKE '%.tmp' AND doc_id % 7200 > 3600 % 7200 - 3300",
)
def stale_tmp_select(spark, root):
    """Files are between 300 and 7500 seconds old by their id; the count is one more pass."""
    age = F.col("doc_id") % 7200 + 3300
    listing = spark.sql(_LISTING).withColumn("modification_time", T.plus_seconds(now(), -age))
    stale = A.stale_tmp_select(listing, now()).select("path")
    return stale.crossJoin(F.broadcast(stale.agg(F.count("*").alias("found"))))


@query(
    "log_lines",
    "f_requests",
    sql="""SELECT concat('{"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00","level":"INFO","logger":"fetch","message":"done","request_id":"',
 request_id, '"', CASE status_code WHEN 429 THEN ',"error_code":"THROTTLED"' ELSE '' END, ',"elapsed_ms":', elapsed_ms, '}') AS value FROM f_requests""",
)
def log_lines(spark, root):
    log = spark.table("f_requests").select(
        F.col("ts").alias("timestamp"),
        F.lit("INFO").alias("level"),
        F.lit("fetch").alias("logger"),
        F.lit("done").alias("message"),
        F.col("request_id").cast("string").alias("request_id"),
        F.when(F.col("status_code") == 429, "THROTTLED").alias("error_code"),
        "elapsed_ms",
    )
    return tables.log_lines(log)


@query(
    "retention_expired",
    sql=f"""SELECT record_id, kind FROM (SELECT doc_id AS record_id, ['success', 'failure', 'raw', 'evidence', 'audit'][1 + doc_id % 5] AS kind,
 doc_id % 400 AS age FROM documents) WHERE age > CASE kind WHEN 'success' THEN 180 WHEN 'raw' THEN 30 WHEN 'audit' THEN 365 ELSE 90 END
AND record_id NOT IN (SELECT doc_id FROM labels)""",
)
def retention_expired(spark, root):
    kinds = F.array(*[F.lit(name) for name in ("success", "failure", "raw", "evidence", "audit")])
    records = spark.table("documents").select(
        F.col("doc_id").alias("record_id"),
        F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("kind"),
        T.plus_seconds(now(), -(F.col("doc_id") % 400) * 86400).alias("created_at"),
    )
    path = scratch_path(spark, "records")
    day = F.date_trunc("month", "created_at")  # one folder a month keeps the small tables' files few
    records.withColumn("dt", F.date_format(day, "yyyy-MM-dd")).hint("rebalance", "dt").write.partitionBy("dt").parquet(path)
    stored = spark.read.schema("record_id long, kind string, created_at timestamp_ntz, dt string").parquet(path)
    references = spark.table("labels").select(F.col("doc_id").alias("record_id"))
    return A.retention_expired(stored, references, now()).select("record_id", "kind")

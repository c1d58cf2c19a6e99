"""The artifact lake: raw bodies by day and digest prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import headers as H
from ..functions import timing as T
from ..settings import DEFAULTS


def layout(bodies: DataFrame) -> DataFrame:
    """Add digest, size, day, prefix and path to bodies (artifact_id, body, saved_at, ...)."""
    laid = bodies.withColumns(
        {
            "content_type": F.coalesce("content_type", F.lit(S.DEFAULT_CONTENT_TYPE)),
            "size_bytes": F.octet_length("body").cast("bigint"),
            "sha256": F.sha2(F.col("body").cast("binary"), 256),
        }
    )
    if "headers" in bodies.columns:
        laid = laid.withColumn("headers", H.redact_headers(F.col("headers")))
    prefix = F.substring("sha256", 1, 2)
    return laid.withColumns(
        {
            "relative_path": F.concat_ws("/", T.date_path(F.col("saved_at")), prefix, "artifact_id"),
            "dt": F.date_format("saved_at", "yyyy-MM-dd"),
            "sha_prefix": prefix,
        }
    )


def artifact_write(bodies: DataFrame, root: str, batch: str) -> None:
    """Write a batch of bodies with their metadata, partitioned by batch and day, in files by digest prefix.

    A batch replaces what an earlier try of it has written into the same partitions, so a
    repeated write leaves one copy; other batches are not touched. An id that several batches
    hold is settled when the lake is read (:func:`artifact_read`).

    The rebalance brings equal prefixes of a day together, so that a file's statistics tell which it
    holds, and splits a prefix that many copies of one body fill over several tasks. The
    committer makes finished files visible at once.
    """
    laid = layout(bodies).withColumn("batch", F.lit(batch)).hint("rebalance", "dt", "sha_prefix")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "dt").parquet(root)


#: What orders the copies of an artifact: the time it was saved, then the batch; the place in the files tells equal ones apart.
_NEWEST = ("saved_at", "batch", "place")


def _placed(spark: SparkSession, root: str) -> DataFrame:
    """The stored rows with their ``place``: file and row."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # names that are numbers or dates stay as they were written
    stored = spark.read.option("inferSchema", "false").parquet(root)
    return stored.select("*", place.alias("place")).withColumn("batch", F.col("batch").cast("string"))


def artifact_repeats(spark: SparkSession, root: str) -> DataFrame:
    """``artifact_id, copies, newest`` of the ids that the lake holds more than once; bodies are not read."""
    keys = _placed(spark, root).select("artifact_id", F.struct(*_NEWEST).alias("copy"))
    return keys.groupBy("artifact_id").agg(F.count("*").alias("copies"), F.max("copy").alias("newest")).where("copies > 1")


def artifact_read(spark: SparkSession, root: str) -> DataFrame:
    """One row of each artifact id: the newest by ``saved_at``, of equal ones that of the last batch.

    Only ids and times are grouped. Of the ids that occur more than once the older copies'
    places are taken out of the scan by an anti-join on file and row; while these are few, Spark
    broadcasts them, and no body is shuffled.
    """
    placed = _placed(spark, root)
    keys = placed.select("artifact_id", F.struct(*_NEWEST).alias("copy"))
    older = keys.join(artifact_repeats(spark, root), "artifact_id").where(F.col("copy") < F.col("newest")).select(F.col("copy.place").alias("place"))
    return placed.join(older, "place", "left_anti").drop("place")


def artifact_index(stored: DataFrame, as_of=None) -> DataFrame:
    """Index rows with size and digest computed anew from the bodies.

    The time is the one of the metadata (``saved_at``), else ``as_of``; the path is the one
    of the layout.
    """
    times = [F.col("saved_at")] + ([as_of] if as_of is not None else [])
    digest = F.sha2(F.col("body").cast("binary"), 256)
    created = F.coalesce(*times)
    return stored.select(
        "artifact_id",
        F.concat_ws("/", T.date_path(created), F.substring(digest, 1, 2), "artifact_id").alias("relative_path"),
        F.coalesce("content_type", F.lit(S.DEFAULT_CONTENT_TYPE)).alias("content_type"),
        F.octet_length("body").cast("bigint").alias("size_bytes"),
        digest.alias("sha256"),
        created.alias("created_at"),
    )


def stored_index(stored: DataFrame) -> DataFrame:
    """The index rows as they were written: no body is read or hashed again."""
    return stored.select("artifact_id", "relative_path", "content_type", "size_bytes", "sha256", F.col("saved_at").alias("created_at"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Index rows of a tree ``YYYY/MM/DD/<prefix>/<artifact_id>/{body.bin,metadata.json}``."""
    folder = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+/[^/]+/[^/]+)/[^/]+$", 1)
    bodies = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "body.bin")
        .load(root)
        .select(folder.alias("relative_path"), F.col("content").alias("body"))
    )
    schema = "content_type string, fetched_at string, requested_url string, final_url string, status_code int, strategy string"
    metadata = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "metadata.json")
        .json(root)
        .select("*", F.col("_metadata.file_path").alias("path"))
        .withColumn("relative_path", folder)
        .drop("path")
    )
    stored = bodies.join(metadata, "relative_path").withColumn(
        "artifact_id", F.substring_index("relative_path", "/", -1)
    )
    return stored.select(
        "artifact_id",
        "relative_path",
        F.coalesce("content_type", F.lit(S.DEFAULT_CONTENT_TYPE)).alias("content_type"),
        F.octet_length("body").cast("bigint").alias("size_bytes"),
        F.sha2("body", 256).alias("sha256"),
        F.col("fetched_at").alias("created_at"),
    )


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """Path, time and length of every file below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.col("modificationTime").alias("modification_time"), "length")
    )


def stale_tmp_select(listing: DataFrame, as_of, age_seconds: int = DEFAULTS.tmp_age_seconds) -> DataFrame:
    """Temporary files older than the age; selection only, nothing is deleted."""
    cutoff = T.plus_seconds(as_of, F.lit(-age_seconds))
    return listing.where(F.col("path").endswith(".tmp") & (F.col("modification_time") < cutoff))


def index_write(index: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Write an index as a table in buckets of ``artifact_id`` at ``path``, and return it.

    Look-ups by id then meet it bucket by bucket: only what is looked up is shuffled.
    """
    index.write.mode("overwrite").bucketBy(buckets, "artifact_id").sortBy("artifact_id").option("path", path).saveAsTable(table)
    return index.sparkSession.table(table)


def artifact_lookup(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Requests (artifact_id) with their index row, or ARTIFACT_NOT_FOUND.

    With an index in buckets (:func:`index_write`) the index is read in place, by buckets in
    order; the requests are dealt to the same buckets.
    """
    found = index.withColumn("_found", F.lit(True))
    return (
        requests.join(found, "artifact_id", "left")
        .withColumn("error", F.when(F.col("_found").isNull(), "ARTIFACT_NOT_FOUND"))
        .drop("_found")
    )


def distinct_digest(artifacts: DataFrame) -> DataFrame:
    """Equal bodies as one row: digest, copies, first artifact. Only digests are shuffled."""
    hashed = artifacts.select("artifact_no", F.sha2(F.col("body").cast("binary"), 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("artifact_no").alias("first_artifact"))


def retention_expired(records: DataFrame, references: DataFrame, as_of) -> DataFrame:
    """Records (record_id, kind, created_at) past their class's age and not referenced.

    Records may be laid out by ``dt``, the first day of a period of ``created_at`` as text: then only the periods
    that begin before the shortest class's limit are read at all.
    """
    age = None
    for kind, days in S.RETENTION_DAYS.items():
        age = F.when(F.col("kind") == kind, days) if age is None else age.when(F.col("kind") == kind, days)
    old = F.col("created_at") < T.plus_seconds(as_of, -age * 86400)
    if "dt" in records.columns:
        last = T.plus_seconds(as_of, F.lit(-min(S.RETENTION_DAYS.values()) * 86400))
        old = (F.col("dt") <= F.date_format(last, "yyyy-MM-dd")) & old
    return records.where(old).join(references.select("record_id"), "record_id", "left_anti")

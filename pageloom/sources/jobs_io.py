"""Job and item tables on storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tables(jobs: DataFrame, items: DataFrame, root: str) -> None:
    """Items are laid out by queue and state, the columns a claim filters by."""
    jobs.write.parquet(f"{root}/jobs")
    items.hint("rebalance", "queue", "state").write.partitionBy("queue", "state").parquet(f"{root}/job_items")


def read_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/jobs"), spark.read.parquet(f"{root}/job_items")


# ---------------------------------------------------------------------------
# items as a base and change sets
# ---------------------------------------------------------------------------
PARTS = 16


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")


def write_base(items: DataFrame, root: str, parts: int = PARTS) -> None:
    """The items with version 0, dealt to ``parts`` folders by their id."""
    laid = items.withColumns({"version": F.lit(0).cast("bigint"), "part": _part(parts)})
    laid.hint("rebalance", "part").write.partitionBy("part").parquet(f"{root}/items")


def append_changes(changes: DataFrame, root: str, version: int, parts: int = PARTS) -> None:
    """Write changed items, whole rows, as one version; a repeated write replaces its first try. The base is not touched."""
    changes.withColumn("part", _part(parts)).write.mode("overwrite").parquet(f"{root}/changes/version={version}")


def _changes(spark: SparkSession, root: str) -> DataFrame:
    """The newest change of each changed item."""
    rows = spark.read.parquet(f"{root}/changes").withColumn("version", F.col("version").cast("bigint"))
    columns = [name for name in rows.columns if name != "item_id"]
    return rows.groupBy("item_id").agg(F.max_by(F.struct(*columns), "version").alias("r")).select("item_id", "r.*")


def read_items(spark: SparkSession, root: str, changed: bool = True) -> DataFrame:
    """All items with their newest version.

    Changed items take the place of their base rows by an anti-join on the id; while the change
    sets are small Spark broadcasts them, and the base is read without a shuffle.
    """
    base = spark.read.parquet(f"{root}/items")
    if not changed:
        return base
    newest = _changes(spark, root)
    seen = newest.select(F.col("item_id").alias("_id"), F.col("version").alias("_version"))
    kept = base.join(seen, (F.col("item_id") == F.col("_id")) & (F.col("_version") > F.col("version")), "left_anti")
    newer = newest.join(base.select(F.col("item_id").alias("_id"), F.col("version").alias("_version")), (F.col("item_id") == F.col("_id")) & (F.col("_version") >= F.col("version")), "left_anti")
    return kept.unionByName(newer.select(kept.columns))


def compact(spark: SparkSession, root: str) -> None:
    """Bring the changes into the base, by rewriting only the parts that hold a changed item.

    Change sets up to the newest version are then superfluous; read again they change nothing.
    """
    touched = [row.part for row in _changes(spark, root).select("part").distinct().collect()]
    if touched:
        rows = read_items(spark, root).where(F.col("part").isin(touched))
        rows.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{root}/items")

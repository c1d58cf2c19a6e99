"""Stages of the corpus pipeline: each takes documents and returns documents, the last one batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination as _decontamination
from . import ngram_join as _ngram_join
from . import packing as _packing
from . import secret_scan as _secret_scan
from . import toxicity as _toxicity
from .queries import table

MASK = "[SECRET]"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not call toxic; all columns and texts stay."""
    return _toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id, and all without a near copy."""
    return _ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items; those that are mostly such passages go."""
    return _decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked."""
    return _secret_scan.mask(docs, MASK)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches over length buckets."""
    return _packing.pack(docs)

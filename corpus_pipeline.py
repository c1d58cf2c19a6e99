"""The corpus pipeline: documents through a chain of filtering, cleaning and packing stages."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pageloom.llm import stages  # noqa: E402
from pageloom.session import scratch_path  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", stages.toxicity),
    ("ngram_join", stages.ngram_join),
    ("decontamination", stages.decontamination),
    ("secret_scan", stages.secret_scan),
    ("packing", stages.packing),
]

#: A learned scorer and an iterated join are among the stages; the tests hold the result against loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

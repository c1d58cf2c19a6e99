"""The operators as queries over the whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_root
from . import decontamination, lexical_search, lm_scoring, neighbours, ngram_join, oracles, packing, pii, quality, secret_scan, spelling, substring_dedup, suffix_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op1_decontamination": oracles.OP1,
    "op2_substring_dedup": oracles.OP2,
    "op7_quality_cascade": oracles.OP7,
    "op9_lm_scoring": oracles.OP9,
    "op11_spelling_variants": oracles.OP11,
    "op13_lexical_search": oracles.OP13,
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def query(fn: Query) -> Query:
    """Register under the function's name; checkpoints go to the shared folder."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        shared_root(spark)
        return fn(spark, root)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """Words of documents inside windows of test items."""
    return decontamination.report(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query
def op2_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Word spans that repeat across documents."""
    return substring_dedup.report(table(spark, root, "documents"))


@query
def op3_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    """Single and multipart credentials."""
    return secret_scan.report(table(spark, root, "documents"))


@query
def op4_packing(spark: SparkSession, root: str) -> DataFrame:
    """Batches of documents in optimal length buckets."""
    return packing.pack(table(spark, root, "documents"))


@query
def op5_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity scores."""
    return toxicity.report(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op6_pii(spark: SparkSession, root: str) -> DataFrame:
    """Personal data."""
    return pii.report(table(spark, root, "documents"))


@query
def op7_quality_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Quality counts and verdicts; how many rules a document met depends on measured times and is left out."""
    return quality.cascade(table(spark, root, "documents")).drop("rules_run")


@query
def op8_ngram_join(spark: SparkSession, root: str) -> DataFrame:
    """Near copies and their components."""
    return ngram_join.near_copies(table(spark, root, "documents"))


@query
def op9_lm_scoring(spark: SparkSession, root: str) -> DataFrame:
    """Stupid-backoff scores."""
    return lm_scoring.report(table(spark, root, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Byte spans that repeat across documents."""
    return suffix_dedup.report(table(spark, root, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    """Words, their near words and their most frequent spelling."""
    return spelling.variants(table(spark, root, "documents"))


@query
def op12_permutation_index(spark: SparkSession, root: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return neighbours.search(table(spark, root, "embeddings"))


@query
def op13_lexical_search(spark: SparkSession, root: str) -> DataFrame:
    """The 20 best documents of each test item."""
    return lexical_search.search(table(spark, root, "documents"), table(spark, root, "benchmark"))

"""Readers of the page lake's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S
from ..functions import headers as H

ATTEMPT = T.StructType(
    [
        T.StructField("sequence", T.IntegerType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("elapsed_ms", T.LongType()),
        T.StructField("upgrade_reason", T.StringType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("proxy_policy", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("cache_ttl", T.LongType()),
        T.StructField("force_refresh", T.BooleanType()),
        T.StructField("save_artifact", T.BooleanType()),
        T.StructField("timeout_seconds", T.DoubleType()),
        T.StructField("required_selector", T.StringType()),
    ]
)

TABLES = ("pages", "documents", "events", "orders", "lineitem", "labels", "customer")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A base table; the schema is that of its files now."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def page_scan(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Raw responses as rows; name the columns to keep the scan narrow."""
    pages = table(spark, root, "pages")
    return pages.select(*columns) if columns else pages


def parse_payload(payload: Column) -> Column:
    """JSON document to typed request: unknown keys ignored, missing ones defaulted."""
    parsed = F.from_json(payload, REQUEST, {"mode": "PERMISSIVE"})
    return with_defaults(parsed)


def with_defaults(request: Column) -> Column:
    """Fill the defaults of a request struct; ``save_artifact`` stays NULL."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    defaults = {
        "mode": F.lit("auto"),
        "profile": F.lit("anonymous"),
        "proxy_policy": F.lit("auto"),
        "headers": empty,
        "force_refresh": F.lit(False),
    }
    return F.struct(
        *[
            (F.coalesce(request[name], defaults[name]) if name in defaults else request[name]).alias(name)
            for name in REQUEST.names
        ]
    )


def serialize(row: Column) -> Column:
    """Struct to JSON document, NULL fields included."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def payload_variant(payload: Column) -> Column:
    """JSON document as ``request`` (typed, defaulted), ``document`` (VARIANT, everything in it) and ``unread``.

    Text that is no JSON object has neither: it is kept as it is in ``unread``. A field of
    another type than the request's is missing from the request and stays in the document.
    """
    read = F.try_parse_json(payload)
    document = F.when(F.schema_of_variant(read).startswith("OBJECT"), read)
    typed = F.struct(*[F.try_variant_get(document, f"$.{field.name}", field.dataType.simpleString()).alias(field.name) for field in REQUEST])
    request = F.when(document.isNotNull(), with_defaults(typed))
    return F.struct(request.alias("request"), document.alias("document"), F.when(document.isNull(), payload).alias("unread"))


def serialize_document(document: Column) -> Column:
    """A document as JSON text again, its keys in order: what no field of the request names is still there."""
    return F.to_json(document)


def log_lines(log: DataFrame) -> DataFrame:
    """One JSON object per log row; optional fields only where they have a value."""
    optional = [name for name in ("request_id", "job_id", "error_code", "domain", "elapsed_ms") if name in log.columns]
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp")
    fields = [stamp, "level", "logger", "message", *optional]
    return log.select(F.to_json(F.struct(*fields)).alias("value"))


def write_log(log: DataFrame, path: str) -> None:
    log_lines(log).write.text(path)


def error_catalog(spark: SparkSession) -> DataFrame:
    """The fixed error dimension (one row per code)."""
    return spark.createDataFrame(list(S.ERRORS), "code string, http_status int, retryable boolean")


def header_map(rows: DataFrame, *keys: str) -> DataFrame:
    """Long-form headers (keys, name, value) to one map per key.

    Repeated names are reduced first, before the shuffle; the largest value counts.
    """
    single = rows.groupBy(*keys, "name").agg(F.max("value").alias("value"))
    return single.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("headers")
    )


def response_type(headers: Column) -> Column:
    return H.content_type(headers)

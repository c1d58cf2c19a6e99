"""Redirect chains over a recorded hop table.

Following one hop per join would take a join per redirect. Instead the path
segments double: a segment of k hops continued by the segment of its end has 2k
hops, so four joins cover the default limit. Only redirecting pages take part, ends
that are final leave the join, and segments stay as short as the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import urls as U
from ..session import shared_root
from ..settings import DEFAULTS


def hops_of(responses: DataFrame) -> DataFrame:
    """Recorded responses (url, status_code, location) as hops (src, dst) between normalised URLs.

    A redirect status with a Location moves on to it, resolved against the URL that sent it;
    anything else is final. Of several records of a URL the one with the largest Location counts.
    """
    moves = F.col("status_code").isin(*S.REDIRECT_STATUS) & F.col("location").isNotNull()
    sent = U.with_normalized(responses.select("url", F.when(moves, F.col("location")).alias("location")), "url", "src")
    single = sent.where("src is not null").groupBy("src").agg(F.max("location").alias("location"))
    target = single.select("src", U.url_join(F.col("src"), F.col("location")).alias("_to"))
    return U.with_normalized(target, "_to", "dst").select("src", "dst")


def redirect_resolve(
    hops: DataFrame, max_redirects: int = DEFAULTS.max_redirects, verdicts: DataFrame | None = None
) -> DataFrame:
    """Outcome of every start page: (src, final, hops, code).

    ``hops``: src (unique), dst (NULL for a final page). ``verdicts``: src, code of
    the address guard; every requested page is checked before it is fetched. Codes:
    NULL ok, REDIRECT_LOOP, TOO_MANY_REDIRECTS, NOT_RECORDED (the last page has no
    record, so nothing is known of it) or the guard's.
    """
    key_type = hops.schema["src"].dataType
    nodes = hops.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    # the levels below read the hops again and again; written once, they stay a small leaf of the plan
    shared_root(hops.sparkSession)
    nodes = nodes.checkpoint(eager=False)
    limit = max_redirects + 1  # requests that may be made

    # path of a segment: the pages requested after src, in order; NULL end = known final
    moving = nodes.where(F.col("dst").isNotNull())
    segments = moving.select("src", F.array("dst").alias("path"), F.col("dst").alias("end"))
    span = 1
    while span < limit:
        # both sides of the level read this one exchange
        segments = segments.repartition("src")
        further = segments.select(
            F.col("src").alias("_src"), F.col("path").alias("_path"), F.col("end").alias("_end")
        )
        # finished segments match nothing; their own id spreads them over the partitions
        probe = F.coalesce(F.col("end"), F.concat(F.lit("\u0000"), F.col("src")))
        joined = segments.withColumn("_probe", probe).join(further, F.col("_probe") == F.col("_src"), "left")
        segments = joined.select(
            "src",
            F.when(F.col("_src").isNull(), F.col("path"))
            .otherwise(F.slice(F.concat("path", "_path"), 1, limit))
            .alias("path"),
            F.when(F.col("_src").isNull(), F.lit(None).cast("string")).otherwise(F.col("_end")).alias("end"),
        )
        span *= 2

    # requested pages: src, then the path. The first repeat is the loop.
    path = F.concat(F.array("src"), F.col("path"))
    visits = segments.withColumn("path", path).withColumn(
        "repeat",
        F.array_min(
            F.filter(
                F.transform(
                    F.col("path"),
                    lambda page, at: F.when(F.array_position(F.col("path"), page) < at + 1, at),
                ),
                lambda at: at.isNotNull(),
            )
        ),
    )
    # requests made before the loop shows; more than the limit never happen
    seen = F.when(F.col("repeat") < limit, F.col("repeat")).otherwise(F.size("path"))
    outcome = (
        F.when(F.col("repeat") < limit, "REDIRECT_LOOP")
        .when(F.size("path") > limit, "TOO_MANY_REDIRECTS")
        .otherwise(F.lit(None).cast("string"))
    )
    resolved = visits.select(
        "src", F.slice("path", F.lit(1), F.least(seen, F.lit(limit))).alias("visited"), outcome.alias("code")
    )
    still = nodes.where(F.col("dst").isNull()).select(
        "src", F.array("src").alias("visited"), F.lit(None).cast("string").alias("code")
    )
    # a chain that goes on to a page without a record
    last = F.when(F.col("code").isNull(), F.element_at("visited", -1))
    recorded = nodes.select(F.col("src").alias("_known"))
    chains = (
        resolved.withColumn("_last", last)
        .join(recorded, F.col("_last") == F.col("_known"), "left")
        .withColumn("code", F.when(F.col("code").isNull() & F.col("_known").isNull(), "NOT_RECORDED").otherwise(F.col("code")))
        .drop("_last", "_known")
        .unionByName(still)
    )
    if verdicts is not None:
        chains = _apply_guard(chains, verdicts)
    return chains.select(
        F.col("src").cast(key_type).alias("src"),
        F.when(F.col("code").isNull(), F.element_at("visited", -1)).cast(key_type).alias("final"),
        (F.size("visited") - 1).alias("hops"),
        "code",
    )


def _apply_guard(chains: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The first refused page of a chain ends it there with the guard's code."""
    refused = verdicts.where(F.col("code").isNotNull()).select(
        F.col("src").cast("string").alias("page"), F.col("code").alias("_refusal")
    )
    steps = chains.select("src", F.posexplode("visited").alias("at", "page"))
    first = steps.join(refused, "page").groupBy("src").agg(
        F.min(F.struct("at", "_refusal")).alias("stop")
    )
    return chains.join(first, "src", "left").select(
        "src",
        F.when(F.col("stop").isNotNull(), F.slice("visited", F.lit(1), F.col("stop.at") + 1))
        .otherwise(F.col("visited"))
        .alias("visited"),
        F.coalesce("stop._refusal", "code").alias("code"),
    )

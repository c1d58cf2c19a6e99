"""Running aggregates that do not put one key into one task.

A window over ``partition by key order by time`` reads a whole key in one task, so
one hot key is as slow as all of its rows. Here a key's timeline is cut on two levels,
seconds within hours. Each (key, second) is a window of its own; the totals of the
seconds are run within their hour, and the totals of the hours over the key; the three
are put together. So no task holds more of a key than the rows of a second, the seconds
of an hour, or the hours of its life.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
GROUPED = "_group"
SECOND_US = 1_000_000
#: Chunks that make one group of the level above.
GROUP = 3600

_FUNCTIONS = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    # both skip NULLs
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def with_chunk(df: DataFrame, time_us: Column, width_us: int = SECOND_US) -> DataFrame:
    """Add the chunk number of each row's time."""
    return df.withColumn(CHUNK, F.floor(time_us / F.lit(width_us)).cast("bigint"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggregates: dict[str, tuple[str, Column]],
    backward: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Add running ``sum``/``max``/``min`` columns over each key.

    Keys are not NULL. ``df`` has a chunk column from :func:`with_chunk` that never decreases along
    ``order``. ``backward`` runs from the last row to the first; ``exclusive`` leaves
    the row itself out.
    """
    keys = list(keys)
    local = _local(keys, order, backward, exclusive)
    inside = df.withColumns(
        {f"_in_{name}": _FUNCTIONS[kind](value).over(local) for name, (kind, value) in aggregates.items()}
    )
    # totals come from the rows themselves, so they are combined before their shuffle
    totals = df.groupBy(*keys, CHUNK).agg(
        *[_FUNCTIONS[kind](value).alias(f"_all_{name}") for name, (kind, value) in aggregates.items()]
    )
    carried = _carried(totals, keys, {name: kind for name, (kind, _) in aggregates.items()}, backward)
    return inside.join(carried, [*keys, CHUNK], "left").select(
        *df.columns,
        *[
            _combine(kind, F.col(f"_carry_{name}"), F.col(f"_in_{name}")).alias(name)
            for name, (kind, _) in aggregates.items()
        ],
    )


def _carried(totals: DataFrame, keys: list[str], kinds: dict[str, str], backward: bool) -> DataFrame:
    """What each chunk starts with: all chunks before it, by groups of chunks."""
    grouped = totals.withColumn(GROUPED, F.floor(F.col(CHUNK) / F.lit(GROUP)))
    order = lambda name: F.col(name).desc() if backward else F.col(name).asc()
    in_group = Window.partitionBy(*keys, GROUPED).orderBy(order(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    over_groups = Window.partitionBy(*keys).orderBy(order(GROUPED)).rowsBetween(Window.unboundedPreceding, -1)
    near = grouped.withColumns({f"_near_{name}": _FUNCTIONS[kind](F.col(f"_all_{name}")).over(in_group) for name, kind in kinds.items()})
    sums = grouped.groupBy(*keys, GROUPED).agg(*[_FUNCTIONS[kind](F.col(f"_all_{name}")).alias(f"_sum_{name}") for name, kind in kinds.items()])
    far = sums.select(*keys, GROUPED, *[_FUNCTIONS[kind](F.col(f"_sum_{name}")).over(over_groups).alias(f"_far_{name}") for name, kind in kinds.items()])
    return near.join(far, [*keys, GROUPED], "left").select(
        *keys, CHUNK, *[_combine(kind, F.col(f"_far_{name}"), F.col(f"_near_{name}")).alias(f"_carry_{name}") for name, kind in kinds.items()]
    )


def _local(keys: list[str], order: Sequence[str], backward: bool, exclusive: bool):
    """Window inside a chunk."""
    ordered = [F.col(name).desc() if backward else F.col(name).asc() for name in order]
    return Window.partitionBy(*keys, CHUNK).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)


def range_places(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """Number the rows of each key from 1 in order, by a range sort and the sizes of its parts.

    The rows are dealt by ranges of (keys, order), so a key with very many rows takes many
    parts. Each part numbers its own rows of a key; what the parts before it hold of the key
    is added from one small row for each part and key. Rows are distinct in (keys, order). The sorted rows
    are written once, as both readings must see the same ranges.
    """
    part = "_part"
    dealt = rows.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()).checkpoint()
    own = F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order))
    sizes = dealt.groupBy(part, *keys).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return dealt.withColumn("_own", own).join(offsets, [part, *keys]).select(*rows.columns, (F.col("_own") + F.col("_before")).cast("bigint").alias(name))

"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: the smallest node it can reach.

    Each round gives a node the least root among its neighbours and itself, then follows the
    root's own root, so long chains shrink by doubling. Rounds are cut off by checkpoints in
    the shared folder and end when no root changes. Null ends and self links say nothing.
    """
    edges = links.select("a", "b").where("a is not null and b is not null and a <> b")
    both = edges.union(edges.select("b", "a")).distinct().checkpoint(eager=True)
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")).checkpoint(eager=True)
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        met = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("found"))
        # hang the old root, too, below the root that one of its nodes has found
        hung = met.groupBy(F.col("root").alias("node")).agg(F.min("found").alias("hung"))
        met = met.join(hung, "node", "left").select("node", "root", F.least("found", F.coalesce("hung", "found")).alias("found"))
        above = met.select(F.col("node").alias("found"), F.col("found").alias("above"))
        new = met.join(above, "found", "left").select("node", F.col("root").alias("old"), F.coalesce("above", "found").alias("root")).checkpoint(eager=True)
        changed = new.where("old <> root").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_bounded


#: Edges of a partition: of small tables a round's dozen jobs would otherwise have as many tasks each as there are shuffle partitions, all of which the driver keeps account of.
PART_ROWS = 20_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (u, v: longs); component is the smallest node of it.

    Each round hangs the neighbours of a node on the smallest one it sees (the
    union), which also halves paths (the find). No edges give no rows. Tables
    of a round have a partition for each PART_ROWS edges, or those they have
    if these are fewer.
    """
    now = checkpoint(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = -(-now.count() // PART_ROWS) or 1  # rounds add no edges
    now, before = now.coalesce(parts), None
    for _ in range(most_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a star's centre has as many rows as its component has nodes: least neighbours are a table of their own, so that the join may be broadcast or split
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).coalesce(parts))
        large = join_bounded(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large.coalesce(parts))
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
        small = join_bounded(large, least, ["u"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.filter("u <> v").distinct().coalesce(parts))
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()

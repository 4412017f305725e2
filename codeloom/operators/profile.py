"""Runtime evidence from sampled stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evidence_edges(frames: DataFrame) -> DataFrame:
    """(src_key, dst_key, indirect, weight) of frames (stack, pos, key, n): neighbouring resolved frames of a stack, indirect across frames without a key; equal neighbours are skipped.

    Windows are over single stacks, whose depth a profiler bounds.
    """
    w = Window.partitionBy("stack").orderBy("pos")
    own = frames.filter("key is not null").withColumns({"src_key": F.lag("key").over(w), "before": F.lag("pos").over(w)})
    own = own.filter("src_key is not null AND src_key <> key")
    return own.groupBy("src_key", F.col("key").alias("dst_key"), (F.col("pos") - F.col("before") > 1).alias("indirect")).agg(F.sum("n").alias("weight"))


def heat(frames: DataFrame) -> DataFrame:
    """(key, leaf, total, entry): samples of stacks that end in a key, have it, and begin with it, among resolved frames."""
    own = frames.filter("key is not null")
    total = own.select("stack", "key", "n").distinct().groupBy("key").agg(F.sum("n").alias("total"))
    ends = own.groupBy("stack").agg(F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"), F.first("n").alias("n"))
    entry = ends.groupBy(F.col("first").alias("key")).agg(F.sum("n").alias("entry"))
    leaf = ends.groupBy(F.col("last").alias("key")).agg(F.sum("n").alias("leaf"))
    out = total.join(entry, "key", "left").join(leaf, "key", "left")
    return out.select("key", F.coalesce("leaf", F.lit(0)).alias("leaf"), "total", F.coalesce("entry", F.lit(0)).alias("entry"))


def unseen(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (path, hash, ...) that the ledger does not have with this content."""
    return batch.join(ledger.select("path", "hash"), ["path", "hash"], "left_anti")


def provenance(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.max("end").alias("latest"), F.array_join(F.array_sort(F.collect_set("commit_id")), ",").alias("commits"))

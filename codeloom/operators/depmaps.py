"""Dependency maps: attaching, verifying and naming their origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(depfiles: DataFrame, new: DataFrame, prefix: str = "") -> DataFrame:
    """depfiles with those of a map whose prefixed path is not covered yet: what was attached first stays."""
    added = new.withColumn("path", F.concat(F.lit(prefix), "path")).join(depfiles.select("path"), "path", "left_anti")
    return depfiles.unionByName(added)


def verify(depfiles: DataFrame, disk: DataFrame, most: int | None = None) -> DataFrame:
    """(path, state): same, refresh, modified or restored, for files of the maps that are on disk (path, hash, size, mtime). With `most`, maps that cover more files are not looked at, as in interactive use."""
    if most is not None and depfiles.limit(most + 1).count() > most:
        return depfiles.limit(0).select("path", F.lit("").alias("state"))
    d = disk.select("path", F.col("hash").alias("h"), F.col("size").alias("s"), F.col("mtime").alias("m"))
    state = F.when((F.col("s") == F.col("size")) & (F.col("m") == F.col("mtime")), "same").when(F.col("h") == F.col("curhash"), "refresh").when(F.col("h") == F.col("maphash"), "restored").otherwise("modified")
    return depfiles.join(d, "path").select("path", state.alias("state"))


def provenance(rows: DataFrame, depfiles: DataFrame) -> DataFrame:
    """rows (def_file, ...) with dep (`namespace@version`, empty for project files) and modified."""
    d = depfiles.select(F.col("path").alias("def_file"), F.concat_ws("@", "namespace", F.when(F.col("version") != "", F.col("version"))).alias("dep"), "modified")
    return rows.join(d, "def_file", "left").withColumns({"dep": F.coalesce("dep", F.lit("")), "modified": F.coalesce("modified", F.lit(False))})

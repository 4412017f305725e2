"""Sampled stacks: JSON lines with a header and one record a stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "cxprof int, lang string, unit string, hz int, start long, end long, commit string, tag string"
RECORD = f"{HEADER}, st array<array<string>>, n long"
VERSION = 1


def parsed(text: DataFrame) -> DataFrame:
    """(path, at, r) of lines (path, at, value); r is null for a line that is no record."""
    return text.withColumn("r", F.when(F.trim("value").startswith("{"), F.from_json("value", RECORD)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, value) of whole files, in line order."""
    whole = spark.read.format("binaryFile").load(path)
    return whole.select("path", F.sha2("content", 256).alias("hash"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("at", "value"))


def split(text: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, stacks, counts) of lines.

    A file counts if its first record that is not blank is a header of version
    1. A stack needs a frame and a positive count; other lines are skipped and
    counted.
    """
    rows = parsed(text.filter(F.trim("value") != ""))
    first = rows.groupBy("path").agg(F.min_by("r", "at").alias("h"), F.min("at").alias("h_at"))
    headers = first.filter(F.col("h.cxprof") == VERSION).select("path", "h_at", "h.lang", "h.start", "h.end", F.coalesce("h.commit", F.lit("")).alias("commit_id"))
    body = rows.join(headers.select("path", "h_at"), "path").filter("at > h_at")
    good = F.coalesce((F.size("r.st") > 0) & (F.col("r.n") >= 1), F.lit(False))
    stacks = body.filter(good).select("path", F.concat_ws(":", "path", "at").alias("stack"), "r.st", "r.n")
    counts = body.groupBy("path").agg(F.count_if(good).alias("stacks"), F.count_if(~good).alias("skipped"), F.coalesce(F.sum(F.when(good, F.col("r.n"))), F.lit(0)).alias("samples"))
    return headers.drop("h_at"), stacks, counts


def frames(stacks: DataFrame, root: str = "") -> DataFrame:
    """(stack, pos, n, file, line) of well-formed frames, files relative to root; positions count those frames only."""
    cut = root.rstrip("/") + "/" if root else ""
    ok = F.filter("st", lambda f: (F.size(f) >= 2) & F.try_to_number(F.element_at(f, 2), F.lit("999999999")).isNotNull())
    rows = stacks.select("stack", "n", F.posexplode(ok).alias("pos", "f"))
    file = F.col("f")[0]
    file = F.when(F.lit(bool(cut)) & file.startswith(cut), F.substring(file, len(cut) + 1, 1 << 30)).when(file.startswith("/"), F.lit("")).otherwise(F.regexp_replace(file, r"^\./", ""))
    return rows.select("stack", "pos", "n", file.alias("file"), F.col("f")[1].cast("int").alias("line"))


def emit(stacks: DataFrame, path: str, *, lang: str, start: int, end: int, commit: str = "") -> None:
    """Writes aggregated stacks (st, n) as one file: the header, then stacks in order. For what one agent gathers."""
    spark = stacks.sparkSession
    head = spark.range(1).select(F.lit("").alias("k"), F.to_json(F.struct(F.lit(VERSION).alias("cxprof"), F.lit(lang).alias("lang"), F.lit("samples").alias("unit"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(commit).alias("commit"))).alias("value"))
    body = stacks.groupBy("st").agg(F.sum("n").alias("n")).select(F.concat(F.lit("~"), F.to_json(F.struct("st"))).alias("k"), F.to_json(F.struct("st", "n")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)

"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import checkpoint, join_bounded, shared_folder, table
from codeloom.llm.decontaminate import decontaminate
from codeloom.llm.minhash import groups
from codeloom.llm.mixing import mix_documents
from codeloom.llm.quality import score_quality
from codeloom.llm.sharding import shard_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # a fitted network, hashed draws and bin packing are not SQL's to express


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = score_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*COLUMNS)


def keyed(df: DataFrame, text: Column) -> DataFrame:
    """df with what tells its rows apart, as join keys that are never null: doc_id, which may be null, and a hash of the text."""
    return df.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__text": text})


KEYS = ["__id", "__none", "__text"]


def rows_of(docs: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """Rows of docs by whether some (of KEYS) has them; texts stay where they are if some is of a checked size."""
    return join_bounded(keyed(docs, F.xxhash64("text")), some.select(*KEYS), KEYS, how).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, rows without an id last, and among equal ids that with the smallest hash of the text. Rows that share an id, or have none, are told apart by their texts; those with equal texts too are one."""
    found = keyed(groups(docs.withColumn("__key", F.xxhash64("text")), carry=("__key",)), F.col("__key"))
    found = checkpoint(found.groupBy(*KEYS).agg(F.min("component").alias("component"), F.count("*").alias("n")))
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("__none", "__id", "__text")).alias("x")).select("x.*")
    gone = checkpoint(found.filter("component is not null").join(first, KEYS, "left_anti"))
    left = rows_of(docs.select(*COLUMNS), gone, "left_anti")
    twice = found.filter("n > 1").join(gone, KEYS, "left_anti")
    if twice.isEmpty():
        return left
    again = rows_of(left, twice, "left_semi")
    return rows_of(left, twice, "left_anti").unionByName(again.dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item. The text alone decides, so hits are found and removed by its hash; ids may be null or repeat."""
    texts = docs.withColumn("__text", F.xxhash64("text"))
    hit = decontaminate(texts, table(spark, sf_dir, "benchmark"), id_col="__text").filter("n_hit > 0").select(F.col("doc_id").alias("__text")).distinct()
    return join_bounded(texts, checkpoint(hit), ["__text"], "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mix_documents(docs.select(*COLUMNS))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    return shard_documents(docs.select(*COLUMNS)).select(*COLUMNS, "size", "text_crc32", "law", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def place(spark: SparkSession, path: str):
    """The file system of a path in whatever store it is, and the path there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def complete(spark: SparkSession, path: str) -> bool:
    fs, at = place(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    """The rows of the last stage.

    Each stage's rows are written to a folder named after it in the shared
    folder, and those of the stage before it are removed then. `resume` names a
    run: one that was begun under that name, over the same tables, goes on from
    its last stage that was written whole.
    """
    folder = f"{shared_folder(spark)}/pipeline-{resume or uuid.uuid4().hex}"
    paths = [f"{folder}/{at}-{name}" for at, (name, _) in enumerate(STAGES[:-1])]
    done = max((at for at, p in enumerate(paths) if resume and complete(spark, p)), default=-1)
    docs = table(spark, sf_dir, "documents") if done < 0 else spark.read.parquet(paths[done])
    for at in range(done + 1, len(paths)):
        STAGES[at][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[at])
        docs = spark.read.parquet(paths[at])
        if at:
            fs, before = place(spark, paths[at - 1])
            fs.delete(before, True)
    return STAGES[-1][1](spark, docs, sf_dir)

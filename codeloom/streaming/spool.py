"""Streaming ingestion of profile files: a file source feeds sums and a ledger."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import profile
from ..operators.incremental import upsert, upsert_add
from ..operators.verbs import innermost
from ..schema import LEDGER, OBS_EDGES, OBS_HEAT
from ..sources import profiles

FILES = "path string, modificationTime timestamp, length long, content binary"


def resolved(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """Frames with the key (file|parent|name) of the project symbol around them."""
    own = symbols.filter("tier = 0")
    points = frames.withColumn("id", F.concat_ws("#", "stack", "pos"))
    keys = own.select("sym_id", F.concat_ws("|", "file", "parent", "name").alias("key"))
    found = innermost(points.select("id", "file", "line"), own).select("id", "sym_id").join(keys, "sym_id", "left")
    return points.join(found.select("id", "key"), "id", "left").select("stack", "pos", "n", "key")


def ingest(text: DataFrame, symbols: DataFrame, ledger: DataFrame, root: str = "", now: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, heat, ledger rows) of files (path, hash, at, value) that the ledger has not seen with this content.

    A known path with new content adds again and replaces its ledger row.
    """
    files = profile.unseen(text.select("path", "hash").distinct(), ledger)
    fresh = text.join(files, ["path", "hash"], "left_semi")
    headers, stacks, _ = profiles.split(fresh)
    keyed = resolved(profiles.frames(stacks, root), symbols)
    n = keyed.groupBy(F.regexp_replace("stack", ":[0-9]+$", "").alias("path")).agg(F.count("*").cast("int").alias("frames_total"), F.count("key").cast("int").alias("frames_resolved"))
    rows = headers.join(files, "path").join(n, "path", "left").select("path", "hash", "lang", "start", "end", "commit_id", F.coalesce("frames_total", F.lit(0)).alias("frames_total"), F.coalesce("frames_resolved", F.lit(0)).alias("frames_resolved"), F.lit(now).cast("long").alias("ingested_at"))
    return profile.evidence_edges(keyed), profile.heat(keyed), rows


@dataclass
class Store:
    """The sums as snapshot folders, one a batch; a batch that runs again writes the same folder and reads the one before it."""

    spark: SparkSession
    path: str

    def at(self, batch: int, name: str, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{batch}/{name}")

    def put(self, batch: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{batch}/{name}")


def stream(spark: SparkSession, spool: str, symbols: DataFrame, store: Store, checkpoint: str, *, root: str = "", clock: Callable[[], int] = lambda: 0) -> StreamingQuery:
    """Ingests what is in the spool and not yet seen, then stops. Exactly once: the stream's checkpoint names the batch, each batch is a function of the batch before it and its files."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.cxprof.jsonl").load(spool)

    def batch(df: DataFrame, number: int) -> None:
        text = df.select("path", F.sha2("content", 256).alias("hash"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("at", "value"))
        ledger = store.at(number - 1, "ledger", LEDGER)
        edges, heat, rows = ingest(text, symbols, ledger, root, clock())
        store.put(
            number,
            obs_edges=upsert_add(store.at(number - 1, "obs_edges", OBS_EDGES), edges, ["src_key", "dst_key", "indirect"], ["weight"]),
            obs_heat=upsert_add(store.at(number - 1, "obs_heat", OBS_HEAT), heat, ["key"], ["leaf", "total", "entry"]),
            ledger=upsert(ledger, rows, ["path"]),
        )

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, *, late: str = "1 hour", every: str = "10 minutes") -> DataFrame:
    """Counts of a stream of events (ts, event_type, value) by event-time window and type, with late rows up to a bound."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")

"""Substring dedup by content-defined chunking.

A gear hash rolls over a text's bytes: each byte shifts it by one bit and adds
a random number of the byte, so it depends on the last 32 bytes only, and a
chunk ends where its top bits are zero. An insertion moves the ends near it and
no others. Chunks are deduplicated by digest: the first of equal chunks, by
document and place, stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import merged, slices, stored, table, text_bytes

GEAR = np.append(np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32), np.uint32(0))
WINDOW = 32


def boundaries(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places after which a chunk may end: the document's number and the number of bytes up to there, for the texts of data."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), lengths)
    symbols = np.full(int(lengths.sum()) + n * WINDOW, 256, np.int16)  # 256 adds nothing: no hash reaches into the text before
    place = np.arange(len(doc)) + (doc + 1) * WINDOW
    symbols[place] = data[offsets[0] : offsets[-1]]
    h, span = GEAR[symbols], 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    ends = np.flatnonzero((h[place] >> np.uint32(32 - bits)) == 0)
    return doc[ends], ends + 1 - (offsets[:-1] - offsets[0])[doc[ends]]


def cuts(candidates: list[int], length: int, least: int, most: int) -> list[int]:
    """Ends of chunks of at least `least` bytes (the last may be shorter) and at most `most`."""
    out, start = [], 0
    for c in candidates:
        while c - start > most:
            start += most
            out.append(start)
        if c - start >= least:
            out.append(c)
            start = c
    while length - start > most:
        start += most
        out.append(start)
    if length > start:
        out.append(length)
    return out


def chunk(docs: DataFrame, *, bits: int = 5, least: int = 24, most: int = 512) -> DataFrame:
    """(row, id, digest, start, n): the chunks of each row of (row, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            offsets, data, _ = text_bytes(batch.column(2))
            for lo, hi in slices(offsets, 1 << 20):
                doc, ends = boundaries(data, offsets[lo : hi + 1], bits)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                row, owner, digests, starts, sizes = [], [], [], [], []
                for i in range(hi - lo):
                    base, length = int(offsets[lo + i]), int(offsets[lo + i + 1] - offsets[lo + i])
                    text, at = data[base : base + length].tobytes(), 0
                    for end in cuts(ends[first[i] : first[i + 1]].tolist(), length, least, most):
                        digests.append(hashlib.blake2b(text[at:end], digest_size=16).digest())
                        starts.append(at)
                        sizes.append(end - at)
                        owner.append(lo + i)
                        at = end
                owner = np.array(owner, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[owner], pa.int64()), ids.take(pa.array(owner)), pa.array(digests, pa.binary()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], names=["row", "id", "digest", "start", "n"])

    return docs.mapInArrow(run, "row long, id long, digest binary, start int, n int")


def chunk_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", bits: int = 5, least: int = 24, most: int = 512, min_run: int = 0, whole: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_chunks, n_removed, n_spans, n_short, spans, duplicated (n_removed > 0).

    A chunk is a duplicate if an equal one stands in a row with a smaller id,
    or earlier in its own text. spans are the maximal runs of adjacent
    duplicate chunks, as struct(start, end) in bytes of the UTF-8 text, that
    have min_run bytes or more (all, by default); shorter ones, which chance
    gives common words, stay and are counted in n_short, in bytes, unless
    `whole` is set and they are all of the text. Chunks have `least` to `most` bytes, about least + 2**bits on
    average. Rows that repeat an id are told apart by an order of their texts'
    hashes; rows that repeat an id and a text are one document: all or none of
    them keep a chunk. Null ids come last. Null and empty texts have no chunks.
    Empty tables give no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("row"), "id", "text")
    chunks = stored(chunk(rows, bits=bits, least=least, most=most))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "start")
    # most digests occur once and go no further
    again = chunks.groupBy("digest").agg(F.count("*").alias("c")).filter("c > 1").select("digest")
    shared = chunks.join(again, "digest")
    first = shared.groupBy("digest").agg(F.min(order).alias("first"))
    later = shared.join(first, "digest").filter(F.col("first") < order).select("row", "id", "start", "n").distinct()
    runs = merged(later.groupBy("row").agg(F.collect_list(F.col("start").cast("long")).alias("starts"), F.collect_list((F.col("start") + F.col("n")).cast("long")).alias("ends")))
    counts = chunks.groupBy("row").agg((F.count("*") / F.count_if(F.col("start") == 0)).cast("long").alias("n_chunks"))
    out = rows.select("row", F.col("id").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = out.join(counts, "row", "left").join(runs, "row", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    taken = lambda r: (r["end"] - r["start"] >= min_run) | (F.lit(whole) & (r["end"] - r["start"] == F.col("n_bytes")))
    length = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]))
    out = out.withColumn("n_short", length(F.coalesce(F.filter("spans", lambda r: ~taken(r)), none)))
    out = out.withColumns({"spans": F.coalesce(F.filter("spans", taken), none), "n_chunks": F.coalesce("n_chunks", F.lit(0)).cast("long")})
    out = out.withColumns({"n_removed": length(F.col("spans")), "n_spans": F.size("spans").cast("long")})
    return out.select("doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", "n_short", "spans", (F.col("n_removed") > 0).alias("duplicated"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_duplicates(table(spark, sf_dir, "documents"), min_run=50, whole=True)
    spans = F.array_join(F.transform("spans", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return found.withColumn("spans", spans)

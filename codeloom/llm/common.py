"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that count as white space between words: space and tab to carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


#: Rows of an Arrow batch: texts and sets of a few kilobytes, of which a batch is held several times over on its way through a Python worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path is left to Spark, as it may be in any store. Sets the session's Arrow batches to BATCH_ROWS rows at most."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session on one machine may do without and gets one of its own; on a cluster its lack is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codeloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder; Spark removes it with the last use of the result."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as written to Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def words_pattern() -> str:
    return r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column) -> Column:
    """True for rows no label is learned from: crc32 of the id's text is divisible by 5, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Names of columns that df does not have, like those given."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own = "_" + own
        out[name] = own
    return out


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than are needed to tell."""
    return df.limit(rows + 1).count() <= rows


def join_bounded(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int = 200_000) -> DataFrame:
    """Broadcasts small only after counting that it has at most `rows` rows; otherwise leaves it to a shuffled join that AQE may split."""
    return big.join(F.broadcast(small) if small_enough(small, rows) else small, keys, how)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column as (offsets, bytes, validity); null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    valid = np.asarray(column.is_valid())
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8), valid
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not valid.all():  # a null slot may still own bytes
        lengths = np.where(valid, np.diff(offsets), 0)
        if int(lengths.sum()) != int(offsets[-1] - offsets[0]):
            bytes_ = np.concatenate([bytes_[offsets[i] : offsets[i + 1]] for i in range(n) if valid[i]] or [np.zeros(0, np.uint8)])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
    return offsets, bytes_, valid


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `most` bytes together; one long text is a range of its own."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the published SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def merged(found: DataFrame) -> DataFrame:
    """(row, spans): the maximal runs that the spans of each row (starts, ends: in any order) make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, sizes = [], [], [0]
            for starts, ends in zip(batch.column(1), batch.column(2), strict=True):
                a, b = (x.values.to_numpy(zero_copy_only=False) for x in (starts, ends))
                order = np.argsort(a, kind="stable")
                a, reach = a[order], np.maximum.accumulate(b[order])
                begin = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
                lo.append(a[begin])
                hi.append(reach[np.append(begin[1:], len(a)) - 1])
                sizes.append(sizes[-1] + len(begin))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (lo, hi)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], names=["row", "spans"])

    return found.select("row", "starts", "ends").mapInArrow(run, "row long, spans array<struct<start:bigint,end:bigint>>")

"""Exact substring dedup with a threshold-bounded interval expansion on a Burrows-Wheeler transform.

A string of `length` bytes has an anchor that depends on its bytes only: the
leftmost of its grams with the least hash. Strings that are equal have equal
anchors at equal offsets, so texts are cut at their anchors' runs of starts,
and only runs whose anchor occurs again anywhere go on, with the bytes around
them, to the task of their anchor. There, runs with equal bytes become one, and
what is left is put in suffix order. Starting with the intervals of single
bytes, all intervals are extended backwards by one byte at a time, breadth
first: suffixes j - 1 and j have a common prefix over l bytes if their first
bytes agree and their next suffixes lie in one interval of l bytes. So common
prefixes come out by increasing value, and the expansion stops at `length`.

Anchors that occur very often are dealt out by longer keys: the range of the
anchor's offsets is split, and a string's key then covers all bytes that the
strings of its part of the range share; at the finest split, the string itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, join_bounded, merged, mix64, shuffle_width, slices, table, text_bytes

GRAM = 32
TABLE = mix64(np.arange(256, dtype=np.uint64))
BASE = 0x9E3779B97F4A7C15
#: Texts beyond this are looked at in pieces that overlap.
PIECE = 4 << 20
#: Runs that a task remembers to tell which of its later ones they cover.
KNOWN = 200_000


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For some bytes: runs of starts that share an anchor, as (first start, number of starts, anchor's place, hash of its gram)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    h, span = TABLE[data], 1
    while span < GRAM:
        h = h[:-span] * np.uint64(pow(BASE, span, 1 << 64)) + h[span:]
        span *= 2
    h = mix64(h)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    at = place[first]
    return first, np.diff(np.append(first, len(place))), at, h[at]


def pieces(n: int, length: int) -> Iterator[tuple[int, int]]:
    """[start, end) pieces of n bytes whose runs of starts follow each other."""
    at = 0
    while at == 0 or at + length <= n:
        yield at, min(n, at + PIECE)
        at += PIECE - length + 1


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of symbols, the last of which must be unique, by prefix doubling."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, h = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        if h < n:
            after[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = fresh
        if rank.max() == n - 1:
            return order, rank
        h *= 2


def repeats(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all starts of `length` bytes in the texts that share them with another start: the text's number, the start, and a number for the string."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + len(texts)
    symbols[ends] = np.arange(len(texts))  # ends differ, so nothing reaches over them
    order, rank = suffix_order(symbols)
    following = np.empty(len(order), np.int32)  # of each suffix in order, the place of the next suffix of its text: the inverse of the transform's last-to-first mapping
    following[:] = rank[np.minimum(order + 1, len(order) - 1)]
    first = symbols[order]
    same = np.flatnonzero((first[1:] == first[:-1]) & (first[1:] >= len(texts))) + 1
    block = np.empty(len(order), np.int32)
    for _ in range(length - 1):
        if not len(same):
            break
        border = np.ones(len(order), np.int32)
        border[same] = 0
        np.cumsum(border, out=block)
        same = same[block[following[same]] == block[following[same - 1]]]
    if not len(same):
        return (np.zeros(0, np.int64),) * 3
    border = np.ones(len(order), np.int32)
    border[same] = 0
    number = np.cumsum(border)
    member = np.union1d(same, same - 1)
    at = order[member]
    text = np.searchsorted(ends, at)
    return text, at - (ends - sizes)[text], number[member]


class Group:
    """Runs of starts of whole keys, gathered until there is enough for one transform."""

    def __init__(self, length: int) -> None:
        self.length, self.bytes = length, 0
        self.rows: list[tuple] = []  # (document order, row, first start, bytes)

    def take(self, runs: list[tuple]) -> None:
        """The different runs of one key. A single one has nothing to share: its starts differ in the anchor's offset, and so do their strings."""
        if len(runs) > 1:
            self.rows += runs
            self.bytes += sum(len(r[3]) for r in runs)

    def removed(self) -> list[tuple[int, int, int]]:
        """(row, start, end) of what is covered by strings that start earlier elsewhere among the runs."""
        if not self.rows:
            return []
        text, start, number = repeats([r[3] for r in self.rows], self.length)
        if not len(text):
            return []
        rank = {d: i for i, d in enumerate(sorted({r[0] for r in self.rows}))}
        base = np.array([(rank[r[0]] << 40) + r[2] for r in self.rows])
        key = base[text] + start
        order = np.lexsort((key, number))
        text, start, key, number = text[order], start[order], key[order], number[order]
        head = np.concatenate([[True], number[1:] != number[:-1]])
        later = ~head
        text, start, key = text[later], start[later], key[later]
        if not len(text):
            return []
        order = np.lexsort((start, text))
        text, start = text[order], start[order]
        cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(start) != 1)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(text)]]) - 1
        return [(self.rows[t][1], self.rows[t][2] + a, self.rows[t][2] + b + self.length) for t, a, b in zip(text[lo].tolist(), start[lo].tolist(), start[hi].tolist(), strict=True)]


def repeated_strings(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", length: int = 100, often: tuple[int, int] = (1000, 20_000), block: int = 1 << 16) -> DataFrame:
    """(doc_id, row, n_bytes, sha256 of the whole text, whole: covered altogether, spans) for each row of docs.

    spans are the maximal runs of bytes, as struct(start, end) in the UTF-8
    text, that are covered by a string of `length` bytes that also starts
    earlier: in a row with a smaller id, or in the same text before. Null texts
    are empty. Rows that repeat an id and a text are one document and answered
    alike; other rows of one id are ordered by a hash of their texts. Null ids
    come last. Empty tables give no rows; other columns are not read.

    often: anchors with more occurrences than the first bound are split by 8
    ranges of offsets, with more than the second by every offset: different
    runs of one key are no more than the second. block: bytes of one transform,
    or those of one key's runs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("row", F.xxhash64("id", "text"))
    facts = checkpoint(rows.select("id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = checkpoint(facts.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.min(order).alias("o")).select(F.col("o.row").alias("row")))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            offsets, data, _ = text_bytes(batch.column(1))
            for lo, hi in slices(offsets, 1 << 20):
                own, owner = [], []
                for i in range(lo, hi):
                    n = int(offsets[i + 1] - offsets[i])
                    for a, b in pieces(n, length):
                        h = anchors(data[offsets[i] + a : offsets[i] + b], length)[3]
                        own.append(h.view(np.int64))
                        owner.append(np.full(len(h), ids[i], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own), pa.int64()), pa.array(np.concatenate(owner), pa.int64())], names=["gram", "row"])

    # of equal texts only the first document matters: the others are covered by it
    found = rows.select("row", "text").mapInArrow(grams, "gram long, row long").groupBy("gram", "row").agg(F.count("*").alias("c"))
    found = checkpoint(found.join(first, "row", "left_semi"))
    counts = found.groupBy("gram").agg(F.sum("c").alias("all")).filter("all > 1")
    level = F.when(F.col("all") <= often[0], 0).when(F.col("all") <= often[1], 1).otherwise(2)
    listed = found.join(counts, "gram").select("row", F.struct("gram", level.alias("level")).alias("g")).groupBy("row").agg(F.collect_list("g").alias("g"))
    listed = checkpoint(listed.select("row", F.col("g.gram").alias("grams"), F.col("g.level").alias("levels")))
    some = join_bounded(rows, listed.select("row"), ["row"], rows=1_000_000).dropDuplicates(["row"])
    steps = (length - GRAM + 1, 9, 1)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a task's runs with equal key and bytes, those behind the first seen so far are covered by it: no bytes of theirs travel, and none to the key's task
        firsts: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            offsets, data, _ = text_bytes(batch.column(2))
            for i in range(batch.num_rows):
                grams_ = np.array(batch.column(3)[i].as_py(), np.int64)
                levels = np.array(batch.column(4)[i].as_py(), np.int64)
                by = np.argsort(grams_)
                grams_, levels = grams_[by], levels[by]
                body, out = data[offsets[i] : offsets[i + 1]], []
                last, id_, row = ids[i] is None, ids[i] or 0, hashes[i]

                def put(key: int, at: int, own: bytes) -> None:
                    mark, order = (key, xxhash.xxh3_64_intdigest(own)), (last, id_, row, at)
                    before = firsts.get(mark)
                    if before is not None and before < order:
                        out.append((xxhash.xxh3_64_intdigest(f"{row} {at}".encode()) - (1 << 63), at, None, len(own)))
                        return
                    if before is not None or len(firsts) < KNOWN:
                        firsts[mark] = order
                    out.append((key, at, own, len(own)))

                for a, b in pieces(len(body), length):
                    own = body[a:b].tobytes()
                    begin, many, place, h = anchors(body[a:b], length)
                    h = h.view(np.int64)
                    where = np.minimum(np.searchsorted(grams_, h), len(grams_) - 1)
                    for r in np.flatnonzero(grams_[where] == h).tolist():
                        step, s, e, p = steps[levels[where[r]]], int(begin[r]), int(begin[r] + many[r]), int(place[r])
                        if step == steps[0]:
                            put(int(h[r]), a + s, own[s : e + length - 1])
                            continue
                        # a part has the starts with offsets of the anchor from part * step on; the key covers what those strings share
                        for part in range((p - e + 1) // step, (p - s) // step + 1):
                            u, v = max(s, p - part * step - step + 1), min(e, p - part * step + 1)
                            core = own[max(0, p - part * step) : p - part * step - step + 1 + length]
                            key = xxhash.xxh3_64_intdigest(core, part + 1) - (1 << 63)
                            put(key, a + u, own[u : v + length - 1])
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in out], pa.int64()), pa.array([ids[i]] * len(out), pa.int64()), pa.array([hashes[i]] * len(out), pa.int64()),
                    pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.int32()),
                ], names=["key", "id", "row", "at", "bytes", "size"])

    cut = some.join(listed, "row").select("id", "row", "text", "grams", "levels").mapInArrow(runs, "key long, id long, row long, at long, bytes binary, size int")
    dealt = cut.select("key", F.col("id").isNull().alias("none"), "id", "row", "at", "bytes", "size").repartition(shuffle_width(docs), "key").sortWithinPartitions("key", "bytes", "none", "id", "row", "at")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["row", "start", "end"])

        group, held, key, before = Group(length), [], None, None
        for batch in batches:
            known = batch.column(batch.schema.get_field_index("bytes")).is_null().to_numpy(zero_copy_only=False)
            if known.any():
                row, at, size = (batch.column(c).to_numpy(zero_copy_only=False)[known] for c in ("row", "at", "size"))
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(at, pa.int64()), pa.array(at + size, pa.int64())], names=["row", "start", "end"])
                batch = batch.filter(pa.array(~known))
            # a key with one run shares nothing; the first and the last key of a batch may go on in another
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            change = np.concatenate([[False], keys[1:] != keys[:-1], [False]])
            batch, out = batch.filter(pa.array(~(change[:-1] & change[1:]))), []
            for k, none, id_, row, at, own in zip(*[batch.column(c).to_pylist() for c in ("key", "none", "id", "row", "at", "bytes")], strict=True):
                if k == key and own == before:
                    out.append((row, at, at + len(own)))  # equal bytes came first in another place
                    continue
                if k != key:
                    group.take(held)
                    held = []
                    if group.bytes >= block:
                        out += group.removed()
                        group = Group(length)
                key, before = k, own
                held.append(((none, id_ or 0, row), row, at, own))
            yield put(out)
        group.take(held)
        yield put(group.removed())

    spans = dealt.mapInArrow(expand, "row long, start long, end long")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = merged(spans.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")))
    out = facts.join(first.withColumn("first", F.lit(True)), "row", "left").join(spans, "row", "left")
    whole = (F.col("n_bytes") >= length) & F.col("first").isNull()
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return out.select(F.col("id").alias("doc_id"), "row", "n_bytes", "sha", whole.alias("whole"), F.when(whole, one).otherwise(F.coalesce("spans", none)).alias("spans"))


def kept_texts(docs: DataFrame, found: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, kept: the remaining bytes) of the documents that lose some bytes, but not all."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), text.alias("text"))
    part = found.filter(~F.col("whole") & (F.size("spans") > 0)).select("row", "spans").dropDuplicates(["row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data, _ = text_bytes(batch.column(1))
            out = []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                own, at, left = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
                for s in spans:
                    left.append(own[at : s["start"]])
                    at = s["end"]
                out.append(b"".join([*left, own[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "kept"])

    some = join_bounded(rows, part.select("row"), ["row"], rows=1_000_000).dropDuplicates(["row"])
    return some.join(part, "row").select("row", "text", "spans").mapInArrow(cut, "row long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = checkpoint(repeated_strings(docs))
    kept = kept_texts(docs, found).select("row", F.sha2("kept", 256).alias("kept_sha"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    digest = F.when(F.col("whole"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", "sha"))
    return found.join(kept, "row", "left").select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), digest.alias("kept_sha256"))

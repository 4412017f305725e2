"""Benchmark decontamination with a positional inverted index.

The training side is indexed shard by shard, where it is read: a shard is a run
of documents of bounded size, stored as one row with its dictionary of terms
and, for each term, the ascending list of its positions. Queries are answered
shard by shard: a phrase starts from the rarest of its terms in that shard, and
the lists of its other terms, shifted by their offsets, are intersected with it
from rare to frequent. Postings are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lists, slices, table, text_bytes

#: Lower-cases A-Z; digits, letters and all bytes of non-ASCII characters stay, everything else separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = pa.schema([
    ("docs", pa.list_(pa.int64())),  # null where the id is null
    ("starts", pa.list_(pa.int64())),  # position of each document's first word, and the end
    ("terms", pa.binary()),  # the dictionary, sorted, separated by one space
    ("heads", pa.list_(pa.int32())),  # where each term's positions begin, and the end
    ("positions", pa.list_(pa.int32())),
])
INDEX_DDL = "docs array<long>, starts array<long>, terms binary, heads array<int>, positions array<int>"


def words(text: str | bytes | None) -> list[bytes]:
    """The words of a text; none for null."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(FOLD).split()


def build_index(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", shard_bytes: int = 4 << 20) -> DataFrame:
    """One row for each shard of about shard_bytes of text (a longer text is a shard of its own)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            offsets, data, _ = text_bytes(batch.column(1))
            for lo, hi in slices(offsets, shard_bytes):
                seen: dict[bytes, int] = {}
                number = seen.setdefault
                parts, starts, at = [], [0], 0
                for i in range(lo, hi):
                    own = data[offsets[i] : offsets[i + 1]].tobytes().translate(FOLD).split()
                    parts.append(np.fromiter([number(w, len(seen)) for w in own], np.int32, len(own)))
                    at += len(own)
                    starts.append(at)
                flat = np.concatenate(parts)
                order = sorted(seen)
                rank = np.empty(len(order), np.int32)
                rank[[seen[w] for w in order]] = np.arange(len(order), dtype=np.int32)
                flat = rank[flat]
                positions = np.argsort(flat, kind="stable").astype(np.int32)
                heads = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(order)))]).astype(np.int32)
                one = np.array([0, 1])
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.slice(lo, hi - lo)),
                    lists(np.array(starts, np.int64), one * len(starts), pa.int64()),
                    pa.array([b" ".join(order)], pa.binary()),
                    lists(heads, one * len(heads), pa.int32()),
                    lists(positions, one * len(positions), pa.int32()),
                ], schema=INDEX)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(index, INDEX_DDL)


class Shard:
    """One row of the index, ready for queries."""

    def __init__(self, docs: np.ndarray, starts: np.ndarray, terms: bytes, heads: np.ndarray, positions: np.ndarray) -> None:
        self.docs, self.starts, self.heads, self.positions = docs, starts, heads, positions
        self.number = {w: i for i, w in enumerate(terms.split(b" "))} if terms else {}
        self.n_words = int(starts[-1])
        self._doc_of: np.ndarray | None = None

    @property
    def doc_of(self) -> np.ndarray:
        """Each position's document, by ordinal."""
        if self._doc_of is None:
            self._doc_of = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return self._doc_of

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.heads[term] : self.heads[term + 1]]

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Starts of exact occurrences, none of which spans two documents."""
        order = sorted(range(len(terms)), key=lambda i: (self.heads[terms[i] + 1] - self.heads[terms[i]], i))
        at = self.list_of(terms[order[0]]) - order[0]
        for i in order[1:]:
            if not len(at):
                return at
            own = self.list_of(terms[i])
            where = np.searchsorted(own, at + i)
            at = at[(where < len(own)) & (own[np.minimum(where, len(own) - 1)] == at + i)]
        at = at[(at >= 0) & (at + len(terms) <= self.n_words)]
        return at[self.doc_of[at] == self.doc_of[at + len(terms) - 1]] if len(at) else at

    def near(self, terms: list[int], slop: int) -> list[tuple[int, int]]:
        """[start, end) of minimal spans around occurrences of the rarest term that hold all terms, in any order and as often as the phrase has them, within len(terms) + slop words of one document."""
        need: dict[int, int] = {}
        for t in terms:
            need[t] = need.get(t, 0) + 1
        rare = min(need, key=lambda t: (self.heads[t + 1] - self.heads[t], t))
        reach, spans = len(terms) + slop, set()
        for p in self.list_of(rare).tolist():
            d = self.doc_of[p]
            lo, hi = max(int(self.starts[d]), p - reach + 1), min(int(self.starts[d + 1]), p + reach)
            near = []
            for t in need:
                own = self.list_of(t)
                near += [(int(x), t) for x in own[np.searchsorted(own, lo) : np.searchsorted(own, hi)]]
            near.sort()
            have, missing, left, best = dict.fromkeys(need, 0), len(terms), 0, None
            for x, t in near:
                have[t] += 1
                missing -= have[t] <= need[t]
                while not missing:
                    y, u = near[left]
                    if y <= p <= x and x + 1 - y <= reach and (best is None or x + 1 - y < best[1] - best[0]):
                        best = y, x + 1
                    have[u] -= 1
                    missing += have[u] < need[u]
                    left += 1
            if best:
                spans.add(best)
        return sorted(spans)


def shards(batch: pa.RecordBatch) -> Iterator[Shard]:
    for i in range(batch.num_rows):
        column = [batch.column(k)[i] for k in range(5)]
        arrays = [column[k].values.to_numpy(zero_copy_only=False) for k in (1, 3, 4)]
        yield Shard(np.array(column[0].values.to_pylist(), object), arrays[0], column[2].as_py(), arrays[1], arrays[2])


def windows(texts: list[tuple[object, str | None]], size: int) -> list[tuple[list[bytes], list[object]]]:
    """Each distinct window with the items that have it."""
    found: dict[tuple[bytes, ...], dict[object, None]] = {}
    for item, text in texts:
        own = words(text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            found.setdefault(tuple(own[i : i + size]), {})[item] = None
    return [(list(w), list(items)) for w, items in found.items()]


class Wanted:
    """Windows by the term of theirs that is rarest among the windows: a shard is asked only for those whose rarest term it has."""

    def __init__(self, windows: list[tuple[list[bytes], list[object]]]) -> None:
        count: dict[bytes, int] = {}
        for own, _ in windows:
            for w in set(own):
                count[w] = count.get(w, 0) + 1
        self.windows, self.by_term = windows, {}
        for i, (own, _) in enumerate(windows):
            self.by_term.setdefault(min(own, key=lambda w: (count[w], w)), []).append(i)

    def hits(self, shard: Shard) -> Iterator[tuple[np.ndarray, int, list[object]]]:
        """Starts of occurrences, the number of words, and the items, of the windows that occur in a shard."""
        get = shard.number.get
        for term in self.by_term.keys() & shard.number.keys():
            for i in self.by_term[term]:
                own, of = self.windows[i]
                terms = [get(w, -1) for w in own]
                if -1 not in terms:
                    at = shard.phrase(terms)
                    if len(at):
                        yield at, len(terms), of


def phrase_matches(index: DataFrame, phrases: list[tuple[int, str]], *, slop: int | None = None) -> DataFrame:
    """(phrase_id, doc_id, start, end) of every match, in words from the document's first: exact ones, or with slop those of Shard.near. A phrase without words matches nothing."""
    wanted = [(p, words(t)) for p, t in phrases if words(t)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in shards(batch):
                out = []
                for p, own in wanted:
                    terms = [shard.number.get(w, -1) for w in own]
                    if -1 in terms:
                        continue
                    spans = [(int(s), int(s) + len(terms)) for s in shard.phrase(terms)] if slop is None else shard.near(terms, slop)
                    out += [(p, shard.docs[d := int(shard.doc_of[s])], s - int(shard.starts[d]), e - int(shard.starts[d])) for s, e in spans]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["phrase_id", "doc_id", "start", "end"])

    return index.mapInArrow(search, "phrase_id long, doc_id long, start long, end long")


def covered(index: DataFrame, wanted: Wanted) -> DataFrame:
    """For every document of the index: doc_id, n_words, n_hit and the items met."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in shards(batch):
                edge = np.zeros(shard.n_words + 1, np.int32)
                items: dict[int, set] = {}
                for at, n, of in wanted.hits(shard):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n, -1)
                    for d in np.unique(shard.doc_of[at]).tolist():
                        items.setdefault(d, set()).update(of)
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)]).astype(np.int64)
                n = len(shard.docs)
                listed = [sorted(map(str, items[d])) if d in items else [] for d in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.docs.tolist(), pa.int64()),
                    pa.array(np.diff(shard.starts), pa.int64()),
                    pa.array(hit[shard.starts[1:]] - hit[shard.starts[:-1]], pa.int64()),
                    pa.array(listed, pa.list_(pa.string())),
                ], names=["doc_id", "n_words", "n_hit", "items"])

    return index.mapInArrow(search, "doc_id long, n_words long, n_hit long, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", window: int = 10, item_rows: int = 20_000) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside an occurrence of an item's window), and items (ids, as sorted strings).

    A window is `window` consecutive words of an item; an item of fewer words,
    but not none, is one window. Null and empty texts have no words and are
    kept with zeros; null item ids count as one item, written ''. Repeated rows
    are answered row by row. Repeated items count once. Other columns are not
    read. With an empty benchmark nothing is hit.

    Benchmark items come to the tasks in blocks of at most item_rows items; a
    larger benchmark makes more passes over the stored index, whose answers are
    joined by row. Within a block, items are at most as many as the parameter
    says, so what is sent is bounded.
    """
    index = checkpoint(build_index(docs, text_col=text_col, id_col=id_col))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, -(-items.count() // item_rows))
    if blocks == 1:
        return covered(index, Wanted(windows([tuple(r) for r in items.collect()], window)))
    # spans of all blocks are united per document: counts of single blocks may overlap
    numbered = checkpoint(index.withColumn("shard_id", F.monotonically_increasing_id()))
    of_block = lambda b: Wanted(windows([tuple(r) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()], window))
    return united(numbered, map(of_block, range(blocks)))


def united(numbered: DataFrame, blocks: Iterator[Wanted]) -> DataFrame:
    """Like covered(), for several blocks of windows, which are made, sent and answered one after the other: hit runs are gathered by shard and document, then merged."""

    def runs(wanted: Wanted):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, shard in enumerate(shards(batch)):
                    number, out = batch.column(5)[i].as_py(), []
                    for at, n, of in wanted.hits(shard):
                        out += [(number, int(shard.doc_of[s]), int(s), int(s) + n, [str(x) for x in of]) for s in at]
                    yield pa.RecordBatch.from_arrays([*[pa.array([o[k] for o in out], pa.int64()) for k in range(4)], pa.array([o[4] for o in out], pa.list_(pa.string()))], names=["shard_id", "d", "s", "e", "items"])

        return search

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shard in enumerate(shards(batch)):
                n = len(shard.docs)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(5)[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(shard.docs.tolist(), pa.int64()), pa.array(np.diff(shard.starts), pa.int64())], names=["shard_id", "d", "doc_id", "n_words"])

    found = None
    for wanted in blocks:
        own = checkpoint(numbered.mapInArrow(runs(wanted), "shard_id long, d long, s long, e long, items array<string>"))
        found = own if found is None else found.unionByName(own)
    merged = found.groupBy("shard_id", "d").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    length = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")), lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], a["end"]))).alias("n"), F.greatest(a["end"], r["e"]).alias("end")), lambda a: a["n"])
    base = numbered.mapInArrow(documents, "shard_id long, d long, doc_id long, n_words long")
    out = base.join(merged.select("shard_id", "d", length.alias("n_hit"), "items"), ["shard_id", "d"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKENS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents),
b AS (SELECT item_id, {TOKENS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item_id, grams.n, i FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

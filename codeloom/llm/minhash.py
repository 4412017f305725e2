"""Near-duplicate detection: SuperMinHash signatures, banding, full verification, union-find grouping.

Each element of a set draws, rank by rank, a place of the signature from a
permutation of its own and a value in [rank, rank + 1); a place keeps the least
value. A set stops at the rank no place of it can still gain from. Equal sets
are one node from then on. Nodes that agree on all values of a band share a
bucket. A bucket is never expanded into all its pairs: its nodes are compared
with two leaders; the components of the links found so far settle most buckets; and in those that still hold several
components, only nodes of different components are compared, block by block,
on full sets. So every pair that shares a band and may still join two
components is decided exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, join_bounded, mix64, shuffle_width, slices, table, text_bytes
from .graph import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit word hashes; a bounded memory of words seen."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


def shingles(text: bytes, size: int, hashes: Hashes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles: `size` words each, or all words if there are fewer; none without words."""
    own = text.translate(LOWER).split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
    size = min(size, len(own))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * STEP + h[k : len(h) - size + 1 + k]
    return np.unique(mix64(total))


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash signatures of n sets of distinct elements, as an n by m array; infinity throughout for an empty set."""
    out = np.full(n * m, np.inf)
    ranks = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    active = np.arange(len(elements))
    base = owner.astype(np.int64) * m
    for j in range(m):
        if not len(active):
            break
        draw = mix64(elements[active] + np.uint64(j * int(STEP) % (1 << 64)))
        value = (draw >> np.uint64(11)).astype(np.float64) / float(1 << 53) + j
        k = j + (mix64(draw) >> np.uint64(32)).astype(np.int64) * (m - j) // (1 << 32)
        place = ranks[active, k]
        ranks[active, k] = ranks[active, j]
        np.minimum.at(out, base[active] + place, value)
        going = out.reshape(n, m).max(1) > j + 1
        active = active[going[owner[active]]]
    return out.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    values = signature[:, : bands * rows].copy().view(np.uint64).reshape(len(signature), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(rows):
        key = mix64(key * STEP + values[:, :, r])
    return key.view(np.int64)


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), its band keys and the columns after text as they are, for each row of (id, text, ...)."""
    rest = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            offsets, data, _ = text_bytes(batch.column(1))
            for lo, hi in slices(offsets, 1 << 18):
                sets = [shingles(data[offsets[i] : offsets[i + 1]].tobytes(), size, hashes) for i in range(lo, hi)]
                lengths = np.array([len(s) for s in sets])
                keys = band_keys(signatures(np.concatenate(sets), np.repeat(np.arange(hi - lo), lengths), hi - lo, bands * rows), bands, rows)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(lengths, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * bands, bands), pa.int32()), pa.array(keys.reshape(-1))),
                    *[c.slice(lo, hi - lo) for c in batch.columns[2:]],
                ], names=["doc_id", "n_shingles", "digest", "bands", *rest])

    return docs.mapInArrow(run, "".join(["doc_id long, n_shingles long, digest binary, bands array<long>", *[f", {c} long" for c in rest]]))


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """digest and the set itself (8 bytes a shingle, ascending), for each row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            offsets, data, _ = text_bytes(batch.column(1))
            for lo, hi in slices(offsets, 1 << 20):
                sets = [shingles(data[offsets[i] : offsets[i + 1]].tobytes(), size, hashes).tobytes() for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) if s else None for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "set"])

    return docs.mapInArrow(run, "digest binary, set binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_u = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u")
    both = with_u.join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of components that a link between left and right nodes of a cell unites, no more than that takes. cells: key, i, j, right, node, component, set; a cell's rows stand together."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        left = [r for r in rows if not r[3]]
        right = [r for r in rows if r[3]]
        if not left or not right:
            return
        sets = [np.frombuffer(r[6], np.uint64) for r in right]
        sizes = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(right)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for r in left:
            own = np.frombuffer(r[6], np.uint64)
            begin, end = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            many = end - begin
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            common = np.bincount(owner[at], minlength=len(right))
            for t in np.flatnonzero(100 * common >= percent * (len(own) + sizes - common)).tolist():
                a, b = find(r[5]), find(right[t][5])
                if a != b:
                    parent[a] = b
                    yield r[5], right[t][5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][:3] != row[:3]:
                    found += links(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
        found = list(links(held)) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return cells.select("key", "i", "j", "right", "node", "component", "set").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, block: int = 512) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    A text's set is that of its distinct shingles of `words` words (runs of
    anything but space and tab to carriage return, A-Z lower-cased); with fewer
    words, all of them are one shingle; null, empty and blank texts have an
    empty set and are linked with nothing. Texts with 100 * intersection >=
    percent * union are linked; component_id is the smallest id that links
    reach, and kept says that the row's id is it. Rows that repeat an id are
    kept or not like it. A null id is smaller than none: it is component_id
    only of a group without other ids. Empty tables give no rows; other columns
    are not read.

    A pair of the least similarity shares no band with a probability of
    (1 - 0.75**rows)**bands, 5e-6; pairs that share one are compared exactly.
    """
    found = groups(docs, text_col=text_col, id_col=id_col, words=words, percent=percent, bands=bands, rows=rows, block=block)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def groups(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = (), words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, block: int = 512) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id as near_duplicates() has them, component (a number of the row's group, whatever its ids; null for an empty set) and the long columns of docs that carry names."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carry)
    sketched = checkpoint(sketch(kept, words, bands, rows).withColumn("node", F.xxhash64("digest")))
    nodes = sketched.filter("digest is not null").groupBy("node", "digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n_shingles", "bands")).alias("x"))
    nodes = checkpoint(nodes.select("node", F.col("x.doc_id").alias("first"), F.col("x.n_shingles").alias("n"), F.col("x.bands").alias("bands")))
    banded = nodes.select(F.explode("bands").alias("key"), "node")
    # what is known of a key is worked out first and joined as a table of its own: broadcast while it is small, else with shuffles of which Spark may split a hot key's
    full = checkpoint(banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    buckets = checkpoint(join_bounded(banded, full, ["key"]))
    wanted = buckets.select("node").distinct().join(nodes.select("node", "first"), "node")
    ids = wanted.select(F.col("first").alias("id")).filter("id is not null").distinct()
    again = join_bounded(texts.filter("id is not null"), ids, ["id"])
    if not wanted.filter("first is null").isEmpty():
        again = again.unionByName(texts.filter("id is null"))
    sets = full_sets(again.select("id", "text"), words).select(F.xxhash64("digest").alias("node"), "set")
    sets = checkpoint(sets.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.min("set").alias("set")))
    # two leaders a bucket: the node whose id comes first, which most of its copies are near to, and one that hashing picks; bands mostly agree on them
    led = buckets.join(nodes.select("node", "first", "n"), "node")
    lead = led.groupBy("key").agg(F.min(F.struct("first", "node", "n")).alias("lead"), F.max(F.struct("node", "n")).alias("high"))
    lead = checkpoint(lead.select("key", F.array(F.struct("lead.node", "lead.n"), "high").alias("leads")))
    star = join_bounded(led, lead, ["key"]).select(F.col("node").alias("u"), F.col("n").alias("m"), F.explode("leads").alias("l")).filter("u <> l.node")
    # sizes alone rule out many
    star = star.filter(100 * F.least("m", "l.n") >= percent * F.greatest("m", "l.n"))
    star = star.select(F.greatest("u", "l.node").alias("u"), F.least("u", "l.node").alias("v")).distinct()
    label = components(verified(star, sets, percent))
    mixed = checkpoint(unsettled(buckets, label))
    sizes = mixed.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("x"), F.sum("c").alias("all"))
    main = main.select("key", F.col("x.component").alias("main"), F.ceil(F.col("all") / block).cast("int").alias("nj"), F.ceil((F.col("all") - F.col("x.c")) / block).cast("int").alias("ni"))
    spread = join_bounded(mixed, checkpoint(main), ["key"]).withColumn("h", F.xxhash64("node", "key"))
    i, j = F.pmod("h", "ni").cast("int"), F.pmod("h", "nj").cast("int")
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = spread.filter("component <> main").select("key", i.alias("i"), F.explode(count("nj")).alias("j"), F.lit(False).alias("right"), "node", "component")
    right = spread.select("key", F.explode(count("ni")).alias("i"), j.alias("j"), F.lit(True).alias("right"), "node", "component")
    cells = left.unionByName(right).join(sets, "node").repartition(shuffle_width(docs), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    # the links found now are between components, few of which are left to unite
    united = components(cell_links(cells, percent)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    named = label.unionByName(united.select(F.col("component").alias("node"), "component")).distinct().join(united, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    named = named.join(nodes.select("node", "first"), "node")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = named.select("node", "component").join(least, "component").select("node", "component", "component_id", F.lit(True).alias("grouped")).dropDuplicates(["node"])
    firsts = nodes.select("node", "first").join(of_node, "node", "left").select("node", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"), F.coalesce("component", "node").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "node", "digest", *carry).withColumn("node", F.when(F.col("digest").isNotNull(), F.col("node")))
    # all copies of a text have one node: its rows must not wait for the joins above
    out = join_bounded(out, checkpoint(firsts), ["node"], "left").withColumn("component_id", F.when(F.col("digest").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", "component", *carry)


def unsettled(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of buckets, with their nodes' components, of those buckets that hold several components."""
    now = checkpoint(buckets.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = checkpoint(now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key"))
    return join_bounded(now, mixed, ["key"])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
k AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)
"""

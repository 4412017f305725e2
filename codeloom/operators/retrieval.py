"""Ranked retrieval: vector lane, rank fusion, blending with diffusion, pins, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cosine, file_penalty, quantize
from ..storage import cut

# How ranks of the lanes count, and how much usage counts.
LEXICAL_K, VECTOR_K, LITERAL_K = 60, 10, 20
GAMMA = 0.35
ROLE_GAMMA = 0.25
LAMBDA = 0.3


def top_k(vectors: DataFrame, query: DataFrame, k: int = 50) -> DataFrame:
    """(id, score) of the k vectors (id, vec int8) nearest to the query (one row: q int8), by cosine, ties to the smaller id."""
    scored = vectors.crossJoin(F.broadcast(query.limit(1))).select("id", F.round(cosine("vec", "q"), 6).alias("score"))  # query is one row
    return scored.orderBy(F.desc("score"), "id").limit(k)


class Nearest:
    """The running k best dot products of a block of queries, all of one length (-1: no vector), over chunks of vectors."""

    def __init__(self, q: np.ndarray, vectors: np.ndarray | None, k: int) -> None:
        self.q, self.k = q, k
        self.length = -1 if vectors is None else vectors.shape[1]
        # sums of products of int8 stay exact
        self.kind = np.float32 if self.length * 128 * 128 < 1 << 24 else np.float64
        self.vectors = None if vectors is None else vectors.astype(self.kind)
        self.floor = np.full(len(q), -np.inf)
        self.at, self.id, self.dot = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, vectors: np.ndarray | None, group: int = 512) -> None:
        """Vectors of one length; without a product (none, or another length) a pair comes after all others, and then only small ids count."""
        met = vectors is not None and vectors.shape[1] == self.length
        if not met:
            ids = np.sort(ids)[: self.k + 1]
        columns = np.ascontiguousarray(vectors.T.astype(self.kind)) if met else None
        found = []
        for lo in range(0, len(self.q), group):
            own = slice(lo, lo + group)
            dots = self.vectors[own] @ columns if met else np.full((len(self.q[own]), len(ids)), -np.inf)
            floor = self.floor[own].astype(dots.dtype)
            hit = np.flatnonzero(dots.max(1) >= floor)
            dots, floor = dots[hit], floor[hit]
            if len(ids) > self.k + 1 and len(hit):  # the own vector may be among the best
                open_ = np.flatnonzero(np.isneginf(floor))
                if len(open_):
                    floor[open_] = np.partition(dots[open_], -self.k - 1, axis=1)[:, -self.k - 1]
            i, j = np.nonzero(dots >= floor[:, None])
            other = self.q[lo + hit[i]] != ids[j]
            i, j = i[other], j[other]
            found.append((lo + hit[i], ids[j], dots[i, j].astype(np.float64)))
        self.merge(*(np.concatenate([own, *new]) for own, new in zip((self.at, self.id, self.dot), zip(*found, strict=True), strict=True)))

    def merge(self, at: np.ndarray, ids: np.ndarray, dots: np.ndarray) -> None:
        if len(at) == len(self.at):
            return
        order = np.lexsort((ids, -dots, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = order[rank < self.k]
        self.at, self.id, self.dot = at[rank < self.k], ids[kept], dots[kept]
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[at[last]] = dots[order[last]]


def nearest(queries: dict[int, tuple[np.ndarray, np.ndarray | None]], k: int, chunk: int = 2048):
    """A function over Arrow batches of (id, vec): (q, id, dot) of the k best of each query among a task's rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Nearest(q, vectors, k) for q, vectors in queries.values()]
        for batch in batches:
            ids, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for rows in (at[i : i + chunk] for i in range(0, len(at), chunk)):
                    vectors = None if size < 0 else flat[starts[rows][:, None] + np.arange(size)]
                    for x in own:
                        x.add(ids[rows], vectors)
        for x in own:
            yield pa.RecordBatch.from_arrays([pa.array(x.q[x.at], pa.int64()), pa.array(x.id, pa.int64()), pa.array(x.dot, pa.float64())], names=["q", "id", "dot"])

    return scan


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, rows: int = 16_384) -> DataFrame:
    """(q, id, rank) of the k largest dot products of each query (q, qv) with all vectors (id, vec) of int8 but its own; queries come in blocks of about `rows`, each through the driver, and tasks keep k rows a query before anything is shuffled."""
    ranked = Window.partitionBy("q").orderBy(F.desc("dot"), "id")
    out = None
    queries = cut(queries)
    blocks = max(1, -(-queries.count() // rows))
    for b in range(blocks):
        by_size: dict[int, list[tuple[int, list[int] | None]]] = {}
        for q, v in queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "qv").toLocalIterator():
            by_size.setdefault(-1 if v is None else len(v), []).append((q, v))
        own = {n: (np.array([q for q, _ in x], np.int64), None if n < 0 else np.array([v for _, v in x], np.int8).reshape(len(x), n)) for n, x in by_size.items()}
        one = vectors.select(F.col("id").cast("long"), "vec").mapInArrow(nearest(own, k), "q long, id long, dot double")
        one = one.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).drop("dot")
        # stored, as answers are read more than once, and before the next block's queries come
        one = cut(one)
        out = one if out is None else out.unionByName(one)
    return out


def quantized(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("id"), quantize("embedding").alias("vec"))


def missing_vectors(cards: DataFrame, vecs: DataFrame, model: str) -> DataFrame:
    return cards.select("hash").distinct().join(vecs.filter(F.col("model") == model), "hash", "left_anti")


def prune_vectors(vecs: DataFrame, symvec: DataFrame) -> DataFrame:
    return vecs.join(symvec.select("hash").distinct(), "hash", "left_semi")


def ranks(lane: DataFrame, *order: Column) -> DataFrame:
    """0-based ranks of a lane that a limit bounds (tens of rows)."""
    return lane.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


def fuse(lexical: DataFrame, vector: DataFrame, literal: DataFrame | None = None) -> DataFrame:
    """(id, fused, lanes) of lanes (id, rank), the literal one with conf: the sum of 1 / (k + rank)."""
    one = lambda df, k, lane, weight: df.select("id", (weight / (k + F.col("rank"))).alias("part"), F.lit(lane).alias("lane"))
    parts = one(lexical, LEXICAL_K, "lex", F.lit(1.0)).unionByName(one(vector, VECTOR_K, "vec", F.lit(1.0)))
    if literal is not None:
        parts = parts.unionByName(one(literal, LITERAL_K, "lit", F.col("conf")))
    return parts.groupBy("id").agg(F.sum("part").alias("fused"), F.array_join(F.array_sort(F.collect_set("lane")), "+").alias("lanes"))


def blend(fused: DataFrame, mass: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """(id, score, lanes): both scores over their maxima, mixed; what only diffusion reached is in lane graph."""
    both = fused.join(mass, "id", "full").select("id", F.coalesce("fused", F.lit(0.0)).alias("fused"), F.coalesce("mass", F.lit(0.0)).alias("mass"), F.coalesce("lanes", F.lit("graph")).alias("lanes"))
    tops = both.agg(F.max("fused").alias("f"), F.max("mass").alias("d"))
    top = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    return both.crossJoin(F.broadcast(tops)).select("id", ((1 - lam) * F.col("fused") / top("f") + lam * F.col("mass") / top("d")).alias("score"), "lanes")  # tops is one row


def pin(scored: DataFrame, pins: DataFrame) -> DataFrame:
    """Adds the largest boost of pins (id, boost) to rows that were retrieved."""
    most = pins.groupBy("id").agg(F.max("boost").alias("boost"))
    return scored.join(most, "id", "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")


def cluster_entries(scored: DataFrame, components: DataFrame) -> DataFrame:
    """Per component of scored rows (id, score, file, heat, mass, callers): members, best score, and the entry, which has most heat, then mass, then callers, then the smallest id."""
    own = scored.join(components, "id")
    entry = F.max_by(F.struct("id", "file"), F.struct("heat", "mass", "callers", -F.col("id")))
    return own.groupBy("component").agg(F.count("*").alias("members"), F.max("score").alias("best"), entry.alias("e")).select("component", "members", "best", F.col("e.id").alias("entry"), F.col("e.file").alias("entry_file"))


def cluster_labels(members: DataFrame) -> DataFrame:
    """Per component of (component, place, file, tokens): the prefix its files share, its most frequent token (the smaller on ties), and the label, which joins them.

    The prefix is that of a fold over the members in order of place: a member's
    directories are compared with what is left, whose last part always counts
    as a file name and goes. So a single member keeps its whole path, and each
    one after the second costs a part at least: after member k, d(k) is the
    least of the parts shared with the first one by member i, less k - i.
    """
    words = members.select("component", F.explode("tokens").alias("t")).groupBy("component", "t").agg(F.count("*").alias("n"))
    top = words.groupBy("component").agg(F.min_by("t", F.struct(-F.col("n"), "t")).alias("token"))
    first = members.groupBy("component").agg(F.min_by("file", "place").alias("lead"), F.count("*").alias("k"))
    placed = members.join(first, "component").withColumn("i", F.row_number().over(Window.partitionBy("component").orderBy("place")) - 1)
    a, b = F.split("lead", "/"), F.split("file", "/")
    most = F.least(F.size(a), F.size(b)) - 1
    shared = F.coalesce(F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.when((i <= most) & (F.element_at(a, i) == F.element_at(b, i)), F.lit(None)).otherwise(i - 1)), lambda x: x.isNotNull())), most)
    depth = F.min(F.when(F.col("i") > 0, shared - (F.col("k") - 1 - F.col("i"))))
    found = placed.groupBy("component").agg(depth.cast("int").alias("d"), F.first("lead").alias("lead"))
    prefix = F.when(F.col("d").isNull(), F.col("lead")).otherwise(F.array_join(F.slice(F.split("lead", "/"), 1, F.greatest("d", F.lit(0))), "/"))
    out = found.select("component", prefix.alias("prefix")).join(top, "component", "left").withColumn("token", F.coalesce("token", F.lit("")))
    label = F.when((F.col("prefix") != "") & (F.col("token") != ""), F.concat("prefix", F.lit(" \u00b7 "), "token")).when(F.col("prefix") != "", F.col("prefix")).otherwise(F.col("token"))
    return out.withColumn("label", label)


def role_votes(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, votes): distinct user-side files (those that the file penalty lowers) with an edge (a, b) to a symbol that is not user-side itself."""
    own = symbols.select("sym_id", "file", (file_penalty("file") < 1).alias("user"))
    src = own.select(F.col("sym_id").alias("a"), F.col("file").alias("src_file"), F.col("user").alias("src_user"))
    dst = own.select(F.col("sym_id").alias("b"), F.col("user").alias("dst_user"))
    hits = pairs.join(src.filter("src_user"), "a").join(dst.filter("NOT dst_user"), "b")
    return hits.groupBy(F.col("b").alias("id")).agg(F.countDistinct("src_file").alias("votes"))


def role_boost(scored: DataFrame, votes: DataFrame) -> DataFrame:
    """scored (id, score, ...) with score raised by (1 + votes) to ROLE_GAMMA; off by default in search."""
    return scored.join(votes, "id", "left").withColumn("score", F.col("score") * F.pow(1.0 + F.coalesce("votes", F.lit(0)), F.lit(ROLE_GAMMA))).drop("votes")

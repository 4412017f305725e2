"""Exact top-k search by columnar branch and bound.

Candidates stay where they are read. Each task lays a chunk of them out
vertically (one row a dimension), adds up inner products one block of
dimensions after another, and after each block keeps only candidates whose
partial score plus the most the remaining dimensions can add (the product of
the remaining norms, by Cauchy-Schwarz) still reaches the query's k-th best.
The k-th best carries over from chunk to chunk of a task. Queries are a stated
set, brought in blocks of a fixed number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

SCHEMA = "query_id long, vec_id long, score long"
#: Sums of products below this are exact in float64.
EXACT = float(1 << 53)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Search:
    """The running top k of one block of queries of one length; `blocks` are the dimensions in the order they are added up."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, block: int, group: int = 16) -> None:
        self.ids, self.k, self.group = ids, k, group
        energy = (vectors.astype(np.float64) ** 2).sum(0)
        order = np.argsort(-energy, kind="stable")
        self.blocks = [order[i : i + block] for i in range(0, len(order), block)]
        self.vectors, self.top = vectors, [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.floor = np.full(len(ids), -np.inf)
        self.most = float(np.abs(vectors).max(initial=0))
        self.rest = self.norms(vectors)

    def norms(self, rows: np.ndarray) -> list[np.ndarray]:
        """Norms of what is left of each row after each block, rounded up."""
        square = [(rows[:, b].astype(np.float64) ** 2).sum(1) for b in self.blocks]
        return [np.sqrt(reduce(np.add, square[i + 1 :], np.zeros(len(rows)))) * (1 + 1e-9) + 1e-6 for i in range(len(square))]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        exact = self.most * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) < EXACT
        kind = np.float64 if exact else np.int64
        columns = [np.ascontiguousarray(rows[:, b].T.astype(kind)) for b in self.blocks]
        queries = [self.vectors[:, b].astype(kind) for b in self.blocks]
        rest = self.norms(rows)
        for lo in range(0, len(self.ids), self.group):
            own = slice(lo, min(lo + self.group, len(self.ids)))
            alive, score = None, np.zeros((own.stop - lo, len(ids)), kind)
            for i, column in enumerate(columns):
                score += queries[i][own] @ (column if alive is None else column[:, alive])
                bound = self.rest[i][own, None] * (rest[i] if alive is None else rest[i][alive])
                keep = np.flatnonzero((score + bound >= self.floor[own, None]).any(0))
                if len(keep) < score.shape[1]:
                    alive = keep if alive is None else alive[keep]
                    score = score[:, keep]
            left = np.arange(len(ids)) if alive is None else alive
            for q in range(own.stop - lo):
                self.merge(lo + q, ids[left], score[q])

    def merge(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        good = np.flatnonzero((score >= self.floor[q]) & (ids != self.ids[q]))
        if not len(good):
            return
        found = best(ids[good], score[good], self.k)
        all_ids = np.concatenate([self.top[q][0], ids[good[found]]])
        all_scores = np.concatenate([self.top[q][1], score[good[found]].astype(np.int64)])
        kept = best(all_ids, all_scores, self.k)
        self.top[q] = all_ids[kept], all_scores[kept]
        if len(kept) == self.k:
            self.floor[q] = float(all_scores[kept[-1]]) * (1 if abs(all_scores[kept[-1]]) < EXACT else 1 - 1e-12)


def scanner(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, block: int, chunk: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {d: Search(ids, vectors, k, block) for d, (ids, vectors) in queries.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = batch.column(1)
            lengths = np.asarray(values.value_lengths())
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            for d, search in searches.items():
                own = np.flatnonzero(lengths == d)
                for at in range(0, len(own), chunk):
                    rows = own[at : at + chunk]
                    search.add(ids[rows], flat[starts[rows][:, None] + np.arange(d)])
        found = [(int(q), *pair) for s in searches.values() for q, top in zip(s.ids, s.top, strict=True) for pair in zip(*top, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([int(f[i]) for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return scan


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    whole = F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.filter(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def exact_top_k(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, block: int = 16, query_rows: int = 8192, chunk: int = 4096) -> DataFrame:
    """The k highest inner products of each query (ids divisible by `every`) over all rows but its own, ties to the smaller id.

    Components are floor(scale * x). Rows with a null id, and vectors that are
    null, empty or hold null or non-finite components, take no part. Vectors
    only meet vectors of their own length. A repeated row is a candidate of
    its own, so it may take several ranks; a query id that repeats is one query,
    with the smallest of its vectors. All rows of a query's id are its own. An
    empty table gives no rows; other columns are not read. Scores are int64:
    scaled components must stay below 2**28 for 64 or fewer dimensions.

    query_rows bounds the block of queries that a scan carries and the driver
    holds; more queries mean more scans, not a larger block.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, id_col, vec_col, scale)
    queries = checkpoint(vectors.filter(F.col("vec_id") % every == 0).withColumn("part", F.xxhash64("vec_id")))
    parts = max(1, -(-queries.count() // query_rows))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    found = []
    for part in range(parts):
        chosen: dict[int, list[int]] = {}
        for row in queries.filter(F.pmod("part", F.lit(parts)) == part).select("vec_id", "v").toLocalIterator():
            chosen[row[0]] = min(chosen.get(row[0], row[1]), row[1])
        if not chosen:
            continue
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in sorted({len(v) for v in chosen.values()}):
            own = sorted(q for q, v in chosen.items() if len(v) == d)
            by_length[d] = np.array(own, np.int64), np.array([chosen[q] for q in own], np.int64)
        own = top(vectors.mapInArrow(scanner(by_length, k, block, chunk), SCHEMA))
        # one block's queries are on the driver and in the tasks at a time: its answers are stored before the next one's come
        found.append(checkpoint(own) if parts > 1 else own)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

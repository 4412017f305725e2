"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Words that several of the labelled texts have are tokens of their own, and so
are marks; all other words share hashed numbers. Every token has a fixed sparse
random index vector. A token's vector is the sum of the index vectors of the
tokens that stand within two places of it anywhere in the corpus: one pass over
all texts adds up, with whole numbers, so the sums do not depend on the
partitioning. A document is the mean and the spread of its tokens' vectors, and
how alike the vectors of neighbours are. A network of two layers, fitted with
numpy, scores it, and a temperature fitted on labelled rows left out of the fit
makes its output a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, held_out, slices, table, text_bytes

SHARED, DIM, REACH, NONZERO = 4096, 48, 2, 6
#: Characters that are tokens of their own, with the token numbers of their bytes; words without a number of their own are hashed to those from 256 to SHARED, the others follow.
MARKS = "!?.,;:|#$%&*@~^_=+-/\\<>()[]{}\"'`"
SPLIT = bytes(32 if b in SPACE_BYTES else b for b in range(256))


class Numbers(dict):
    """Token numbers: those of a vocabulary, and a bounded memory of other words seen."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        super().__init__({w: SHARED + i for i, w in enumerate(vocabulary)})
        self.most = len(self) + 300_000

    def __missing__(self, word: bytes) -> int:
        number = word[0] if len(word) == 1 and word[0] < 128 else 256 + zlib.crc32(word) % (SHARED - 256)
        if len(self) < self.most:
            self[word] = number
        return number


def words(text: bytes) -> list[bytes]:
    text = text.translate(SPLIT)
    for mark in MARKS:
        one = mark.encode()
        text = text.replace(one, b" " + one + b" ")
    return text.split()


def tokens(text: bytes, numbers: Numbers) -> np.ndarray:
    own = words(text)
    return np.fromiter(map(numbers.__getitem__, own), np.int32, len(own))


def frequent_words(sample: DataFrame, least: int, most: int) -> list[bytes]:
    """The words that at least `least` texts of a bounded sample (id, y, text) have: the most frequent ones, in a fixed order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            offsets, data, _ = text_bytes(batch.column(2))
            for i in range(batch.num_rows):
                seen.update(w for w in set(words(data[offsets[i] : offsets[i + 1]].tobytes())) if len(w) > 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    found = sample.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return [bytes(r[0]) for r in found.orderBy(F.desc("n"), "word").limit(most).collect()]


def index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary vectors, one a token number: the places of what is not zero, and the signs."""
    rng = np.random.default_rng(seed)
    return rng.random((n, DIM)).argsort(1)[:, :NONZERO].astype(np.int64), rng.choice((-1.0, 1.0), (n, NONZERO))


def context_sums(docs: DataFrame, text_col: str, vocabulary: list[bytes], seed: int) -> np.ndarray:
    """Of each token number, the sum of its neighbours' index vectors over all texts. What reaches the driver has a row for each number."""
    n = SHARED + len(vocabulary)
    place, sign = index_vectors(n, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, numbers = np.zeros(n * DIM), Numbers(vocabulary)  # sums below 2**53 are exact

        def add(to: np.ndarray, of: np.ndarray) -> None:
            for j in range(NONZERO):
                sums[:] += np.bincount(to * DIM + place[of, j], sign[of, j], n * DIM)

        for batch in batches:
            offsets, data, _ = text_bytes(batch.column(0))
            for lo, hi in slices(offsets, 1 << 22):
                texts = [tokens(data[offsets[i] : offsets[i + 1]].tobytes(), numbers) for i in range(lo, hi)]
                doc = np.repeat(np.arange(hi - lo), [len(t) for t in texts])
                own = np.concatenate(texts).astype(np.int64)
                for step in range(1, REACH + 1):
                    near = doc[:-step] == doc[step:]
                    a, b = own[:-step][near], own[step:][near]
                    if len(a):
                        add(a, b)
                        add(b, a)
        table = sums.reshape(n, DIM)
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(table[used, d].astype(np.int32)) for d in range(DIM)]], names=["token", *[f"d{d}" for d in range(DIM)]])

    parts = docs.select(text_col).mapInArrow(count, "token int, " + ", ".join(f"d{d} int" for d in range(DIM)))
    out = np.zeros((n, DIM), np.int64)
    for row in parts.groupBy("token").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM)]).collect():
        out[row[0]] = row[1:]
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors of the sums, each relative to the mean direction."""
    unit = sums / np.maximum(np.sqrt((sums.astype(np.float64) ** 2).sum(1, keepdims=True)), 1e-12)
    seen = sums.any(1)
    unit[seen] -= unit[seen].mean(0) if seen.any() else 0
    return (unit / np.maximum(np.sqrt((unit**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


class Pool:
    """Pools a document's token vectors: their mean, their spread, the length of the mean, and how alike tokens one and two places apart are, on average and as the share of equal ones; zeros for a document without tokens."""

    size, block = 2 * DIM + 5, 1 << 16

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors

    def alike(self, own: np.ndarray, step: int) -> float:
        total = 0.0
        for at in range(0, len(own) - step, self.block):
            part = self.vectors[own[at : at + self.block + step]]
            total += float(np.einsum("ij,ij->", part[:-step], part[step:], dtype=np.float64))
        return total / (len(own) - step)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, np.float32)
        if len(own):
            used, counts = np.unique(own, return_counts=True)
            share, rows = counts / len(own), self.vectors[used].astype(np.float64)
            mean = share @ rows
            out[:DIM] = mean
            out[DIM : 2 * DIM] = np.sqrt(np.maximum(share @ rows**2 - mean**2, 0))
            out[2 * DIM] = np.sqrt((mean**2).sum())
            for step in (1, 2):
                if len(own) > step:
                    out[2 * DIM + 2 * step - 1] = self.alike(own, step)
                    out[2 * DIM + 2 * step] = (own[:-step] == own[step:]).mean()
        return out


@dataclass
class Network:
    """Two layers over standardised inputs; probabilities at a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, hidden: int = 24, steps: int = 600, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Network:
    """Adam on the log loss of four fifths of the rows, the temperature on the rest. Without both labels, a network that gives the labels' mean (0.5 without rows)."""
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = rng.permutation(len(y))
    rest, own = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(x[own].mean(0), x[own].std(0) + 1e-3, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z, t = (x[own] - net.shift) / net.scale, y[own].astype(np.float64)
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(own), min(512, len(own)))
        h = np.tanh(z[pick] @ values[0] + values[1])
        p = 1 / (1 + np.exp(-np.clip(h @ values[2] + values[3], -30, 30)))
        d = (p - t[pick]) / len(pick)
        back = np.outer(d, values[2]) * (1 - h**2)
        for i, g in enumerate((z[pick].T @ back + decay * values[0], back.sum(0), h.T @ d + decay * values[2], d.sum(keepdims=True))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            values[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if len(set(y[rest].tolist())) == 2:
        logits, target = net.logits(x[rest]), y[rest]
        loss = lambda t: np.logaddexp(0, np.where(target > 0, -logits, logits) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def labelled(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label: str, most: int) -> DataFrame:
    """(id, y, text) of at most `most` labelled rows that may be learned from, the first in the order of a hash of the id; a label that is not null and over 0 counts as 1, the larger if labels of an id differ."""
    chosen = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("id"), "id").limit(most))  # at most `most` rows
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "y", "text")


def quality_scorer(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label: str = "quality", fit_rows: int = 8000, least: int = 3, most: int = 8192, seed: int = 1):
    """A function from a text column to its score, fitted on docs and labels.

    The network is fitted on at most fit_rows labelled documents, none of which
    is held out; of their words, at most `most` that `least` of them have get
    vectors of their own. The vectors add up all texts of docs. Repeated rows of
    a labelled id are fitted as often as they are.
    """
    sample = labelled(docs, labels, text_col, id_col, label, fit_rows)
    vocabulary = frequent_words(sample, least, most)
    vectors = word_vectors(context_sums(docs, text_col, vocabulary, seed))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, pool = Numbers(vocabulary), Pool(vectors)
        for batch in batches:
            offsets, data, _ = text_bytes(batch.column(2))
            rows = [pool(tokens(data[offsets[i] : offsets[i + 1]].tobytes(), numbers)).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(rows, pa.binary())], names=["id", "y", "x"])

    found = sample.mapInArrow(features, "id long, y int, x binary").orderBy(F.xxhash64("id"), "id", "x").limit(fit_rows).collect()
    x = np.array([np.frombuffer(r[2], np.float32) for r in found], np.float64).reshape(-1, Pool.size)
    net = fit(x, np.array([r[1] for r in found], np.int64))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers, pool = Numbers(vocabulary), Pool(vectors)
        for texts in batches:
            offsets, data, _ = text_bytes(texts)
            x = np.zeros((len(texts), Pool.size), np.float32)
            for i in range(len(texts)):
                x[i] = pool(tokens(data[offsets[i] : offsets[i + 1]].tobytes(), numbers))
            yield pa.array(net.probability(x.astype(np.float64)), pa.float64())

    udf = F.arrow_udf(score, "double")
    return lambda text: udf(text)


def score_quality(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.3, **settings) -> DataFrame:
    """docs with held_out, score (0 to 1, higher: better) and predicted (1 if score >= threshold).

    Null and empty texts have no tokens and get the network's score of a
    document of zeros. A null id is held out. Repeated rows are scored alike.
    Empty tables give no rows; without usable labels every score is 0.5.
    Columns of docs named like a new one are replaced.
    """
    score = quality_scorer(docs, labels, text_col=text_col, id_col=id_col, **settings)
    out = docs.withColumns({"held_out": held_out(F.col(id_col)), "score": score(F.col(text_col).cast("string"))})
    return out.withColumn("predicted", verdict(F.col("score"), threshold))


def verdict(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")

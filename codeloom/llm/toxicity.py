"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the n-grams it has, each worth the log ratio of its
share in toxic and in other labelled documents, times the logarithm of its
count. Ratios shrink by what their counts leave in doubt, so that a long clean
text does not add up chance. A logistic regression weighs them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table, text_bytes
from .quality import labelled, verdict

ORDERS, BITS = (4, 5, 6), 22
#: Lower-cases A-Z; letters, digits and bytes of non-ASCII characters stay.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, hashes of all n-grams of the texts and the text of each; texts are folded, runs of separators are one space, and a space stands at either end."""
    n = len(offsets) - 1
    base = data[offsets[0] : offsets[-1]]
    folded = np.full(len(base) + 2 * n, 32, np.uint8)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(n, dtype=np.int32), lengths)
    folded[np.arange(len(base)) + 2 * doc + 1] = FOLD[base]
    doc = np.repeat(np.arange(n, dtype=np.int32), lengths + 2)
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (doc[1:] != doc[:-1])
    folded, doc = folded[keep].astype(np.uint64), doc[keep]
    packed = np.zeros(len(folded), np.uint64)
    for k in range(max(ORDERS)):
        packed = (packed[: len(folded) - k] if k else packed) | (folded[k:] << np.uint64(8 * k))
        if k + 1 in ORDERS:
            whole = doc[: len(packed)] == doc[k:]
            hashed = ((packed + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            yield hashed[whole].astype(np.int64), doc[: len(packed)][whole]


def present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, of hashes whose `wanted` is not 0, and how often each text has the n-gram."""
    n, pairs = len(offsets) - 1, []
    for hashed, doc in grams(data, offsets):
        if wanted is not None:
            own = wanted[hashed] != 0
            hashed, doc = hashed[own], doc[own]
        pairs.append((doc.astype(np.int64) << BITS) | hashed)
    both, many = np.unique(np.concatenate(pairs), return_counts=True) if n else (np.zeros(0, np.int64),) * 2
    return both >> BITS, both & ((1 << BITS) - 1), many


def log_ratios(sample: DataFrame, doubt: float) -> dict[int, float]:
    """The n-grams' log-count ratios, each shrunk by what its own counts leave in doubt.

    Counts of documents are smoothed by one document that is split like the
    labels, so that an n-gram never seen has ratio 0. A ratio r with standard
    error e shrinks to r * max(0, 1 - doubt * (e / r)**2), the positive-part
    James-Stein rule: n-grams that the labels hardly tell apart fade out, with
    no limit on the number of those that stay.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = np.zeros((2, 1 << BITS), np.int32), False
        docs = [0, 0]
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            offsets, data, _ = text_bytes(batch.column(2))
            for lo, hi in slices(offsets, 1 << 20):
                doc, hashed, _ = present(data, offsets[lo : hi + 1])
                for k in (0, 1):
                    docs[k] += int((y[lo:hi] == k).sum())
                    np.add.at(counts[k], hashed[y[lo:hi][doc] == k], 1)
                any_ = True
        used = np.flatnonzero(counts.any(0)) if any_ else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(counts[0][used], docs[0]).astype(np.int64)), pa.array(np.append(counts[1][used], docs[1]).astype(np.int64))], names=["h", "n0", "n1"])

    sums = sample.mapInArrow(count, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
    try:
        total = sums.filter("h = -1").first()
        if not total or not total[1] or not total[2]:
            return {}
        n0, n1 = float(total[1]), float(total[2])
        share = n1 / (n0 + n1)
        a0, a1 = F.col("n0") + (1 - share), F.col("n1") + share
        ratio = F.log(a1 / (n1 + share)) - F.log(a0 / (n0 + 1 - share))
        error2 = F.greatest(1 / a0 + 1 / a1 - 1 / n0 - 1 / n1, F.lit(1e-9))
        rows = sums.filter("h >= 0").select("h", ratio.alias("r"), error2.alias("e2"))
        kept = rows.filter(F.col("r") * F.col("r") > doubt * F.col("e2")).select("h", F.col("r") - doubt * F.col("e2") / F.col("r"))
        return {r[0]: r[1] for r in kept.collect()}  # hashes of n-grams: at most 2**BITS, whatever the corpus
    finally:
        sums.unpersist()


def regression(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, n_features: int, *, steps: int = 200, rate: float = 0.05, decay: float = 1e-4, batch: int = 4096) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows, which stand in a random order, by Adam over one batch of rows after another, from weights that trust the ratios a little."""
    parts = []
    for at in range(0, len(y), batch):
        lo, hi = np.searchsorted(doc, [at, at + batch])
        parts.append((doc[lo:hi] - at, feature[lo:hi], value[lo:hi], y[at : at + batch]))
    w = np.append(np.full(n_features, 0.1), -1.0)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        own, at, x, t = parts[step % len(parts)]
        logits = np.bincount(own, w[at] * x, len(t)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - t) / len(t)
        g = np.append(np.bincount(at, d[own] * x, n_features) + decay * w[:-1], d.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def toxicity_scorer(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label: str = "toxic", fit_rows: int = 8000, doubt: float = 9.0):
    """A function from a text column to its score, fitted on at most fit_rows labelled documents, none of which is held out."""
    sample = labelled(docs, labels, text_col, id_col, label, fit_rows)
    ratios = log_ratios(sample, doubt)
    order = np.array(sorted(ratios), np.int64)

    def lookup(values: np.ndarray, kind: type) -> np.ndarray:
        dense = np.zeros(1 << BITS, kind)
        dense[order] = values
        return dense

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = lookup(np.arange(1, len(order) + 1), np.int32)
        for batch in batches:
            offsets, data, _ = text_bytes(batch.column(2))
            for lo, hi in slices(offsets, 1 << 20):
                doc, hashed, many = present(data, offsets[lo : hi + 1], place)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                own = [(place[hashed[cut[i] : cut[i + 1]]] - 1).astype(np.int32).tobytes() + many[cut[i] : cut[i + 1]].clip(max=(1 << 16) - 1).astype(np.uint16).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo), pa.array(own, pa.binary())], names=["id", "y", "f"])

    rows = sample.mapInArrow(features, "id long, y int, f binary").orderBy(F.xxhash64("id"), "id", "f").limit(fit_rows).collect()
    y = np.array([r[1] for r in rows], np.float64)
    if len(order):
        sizes = [len(r[2]) // 6 for r in rows]  # an int32 and a uint16 each
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        feature = np.concatenate([np.frombuffer(r[2], np.int32, n) for r, n in zip(rows, sizes, strict=True)])
        many = np.concatenate([np.frombuffer(r[2], np.uint16, n, 4 * n) for r, n in zip(rows, sizes, strict=True)])
        del rows
        ratio = np.array([ratios[h] for h in order.tolist()])
        w, bias = regression(doc, feature, ratio.astype(np.float32)[feature] * np.log2(np.float32(1) + many), y, len(order))
        weights = w * ratio
    else:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        weights, bias = np.zeros(0), float(np.log(share / (1 - share)))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = lookup(weights, np.float32)
        for texts in batches:
            offsets, data, _ = text_bytes(texts)
            logits = np.full(len(texts), bias)
            for lo, hi in slices(offsets, 1 << 20):
                doc, hashed, many = present(data, offsets[lo : hi + 1], dense)
                logits[lo:hi] += np.bincount(doc, dense[hashed] * np.log2(1.0 + many), hi - lo)
            yield pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))), pa.float64())

    udf = F.arrow_udf(score, "double")
    return lambda text: udf(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5, **settings) -> DataFrame:
    """docs with held_out, score (0 to 1, higher: likelier toxic) and predicted (1 if score >= threshold).

    Null and empty texts have no n-grams and get the score of the bias alone. A
    null id is held out. Repeated rows are scored alike. Empty tables give no
    rows; without labels of both kinds every score is the labels' mean (0.5 if
    there are none). Columns of docs named like a new one are replaced.
    """
    score = toxicity_scorer(docs, labels, text_col=text_col, id_col=id_col, **settings)
    out = docs.withColumns({"held_out": held_out(F.col(id_col)), "score": score(F.col(text_col).cast("string"))})
    return out.withColumn("predicted", verdict(F.col("score"), threshold))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")

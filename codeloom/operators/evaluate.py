"""Evaluation: recall, precision, hit@k, percentiles, paired deltas, bootstrap, reranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Recall that all groups together, and each of them, must reach.
BAR_ALL, BAR_EACH = 0.95, 0.90


def confusion(predicted: DataFrame, truth: DataFrame, key: list[str], group: str = "grp") -> DataFrame:
    """Per group: tp, fp, fn, recall, precision (1 where nothing is asked or given) and f1."""
    p = predicted.select(group, *key).distinct().withColumn("p", F.lit(1))
    t = truth.select(group, *key).distinct().withColumn("t", F.lit(1))
    n = p.join(t, [group, *key], "full").groupBy(group).agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    ratio = lambda a, b: F.when(a + b == 0, 1.0).otherwise(a / (a + b))
    n = n.withColumns({"recall": ratio(F.col("tp"), F.col("fn")), "precision": ratio(F.col("tp"), F.col("fp"))})
    return n.withColumn("f1", F.when(F.col("recall") + F.col("precision") == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))))


def micro_average(counts: DataFrame, group: str = "grp", *, bar_each: float = BAR_EACH, bar_all: float = BAR_ALL) -> DataFrame:
    """Per group of counts (group, graded, tp, fp, fn), and over all groups (overall): how many rows are graded, recall and precision of their sums, and whether recall reaches the bar. Without a graded row a group has none of these; of all groups they are 1."""
    own = lambda c: F.coalesce(F.sum(F.when(F.col("graded"), F.col(c))), F.lit(0)).alias(c)
    n = counts.rollup(group).agg((F.grouping(group) == 1).alias("overall"), F.count_if("graded").alias("n_graded"), own("tp"), own("fp"), own("fn"))
    ratio = lambda a, b: F.when(F.col("overall") | (F.col("n_graded") > 0), F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b))))
    return n.select(group, "overall", "n_graded", ratio("tp", "fn").alias("recall"), ratio("tp", "fp").alias("precision")).withColumn("passes", F.col("recall") >= F.when(F.col("overall"), bar_all).otherwise(bar_each))


def hit_at_k(ranked: DataFrame, accept: DataFrame, k: int = 5) -> DataFrame:
    """Per question of ranked (q, id, rank): whether one of accept (q, id) is among the first k (ranks from 1)."""
    hits = ranked.filter(F.col("rank") <= k).join(accept.select("q", "id").distinct(), ["q", "id"], "left_semi").select("q").distinct().withColumn("h", F.lit(True))
    return ranked.select("q").distinct().join(hits, "q", "left").select("q", F.coalesce("h", F.lit(False)).alias("hit"))


def percentiles(values: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Elements at int(share * (n - 1)) of each group's sorted values, and the maximum."""
    per = values.groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    per = per.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(group))})
    at = lambda s: F.min(F.when(F.col("upto") > F.floor(F.lit(s) * (F.col("n") - 1)), F.col(value)))
    return per.groupBy(group).agg(*[at(s).alias(f"p{round(s * 100)}") for s in shares], F.max(value).alias("most"))


def paired_deltas(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Per task of runs (task, arm, value): the median of each of two arms, and b - a."""
    med = runs.groupBy("task", "arm").agg(F.median("value").alias("m"))
    left, right = (med.filter(F.col("arm") == arm).select("task", F.col("m").alias(name)) for arm, name in ((a, "a"), (b, "b")))
    return left.join(right, "task").withColumn("delta", F.col("b") - F.col("a"))


def paired_summary(runs: DataFrame, a: str, b: str) -> DataFrame:
    """One row on the tasks that both arms ran: n_paired, median_reduction (of b against a, in percent of a; 0 where a is 0) and win_rate (percent of tasks in which b is below a); the last two are null without a task."""
    pairs = paired_deltas(runs, a, b).filter("a IS NOT NULL AND b IS NOT NULL")
    cut_by = F.when(F.col("a") == 0, 0.0).otherwise(100 * (F.col("a") - F.col("b")) / F.col("a"))
    return pairs.agg(F.count("*").alias("n_paired"), F.median(cut_by).alias("median_reduction"), (100 * F.avg((F.col("b") < F.col("a")).cast("double"))).alias("win_rate"))


def bootstrap_ci(values: DataFrame, *, replicates: int = 5000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of value over resamples: each row counts in each replicate as often as a Poisson draw of its id's hash says, so no rows are gathered."""
    reps = values.select("id", "value", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    u = F.pmod(F.xxhash64("id", "rep", F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    times, total, term = F.lit(6), 0.0, 2.718281828459045**-1
    steps = []
    for k in range(6):
        total += term
        steps.append((total, k))
        term /= k + 1
    for limit, k in reversed(steps):
        times = F.when(u < limit, k).otherwise(times)
    means = reps.withColumn("c", times).groupBy("rep").agg(F.try_divide(F.sum(F.col("c") * F.col("value")), F.sum("c")).alias("m")).filter("m is not null")
    low = (1 - level) / 2
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", low).alias("low"), F.percentile("m", 1 - low).alias("high"))


def mmr(candidates: DataFrame, *, k: int = 10, lam: float = 0.7) -> DataFrame:
    """Per question, the first k of candidates (q, id, score, vec: unit vectors) by maximal marginal relevance: greedy, so each question's (bounded) candidates go to one call."""
    import numpy as np

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        vec = np.array(pdf["vec"].tolist(), dtype=float).reshape(len(pdf), -1)
        near, left, out = np.full(len(pdf), -1.0), list(range(len(pdf))), []
        while left and len(out) < k:
            gain = [lam * pdf["score"][i] - (1 - lam) * max(near[i], 0.0) for i in left]
            best = left.pop(int(np.argmax(gain)))
            near = np.maximum(near, vec @ vec[best])
            out.append((pdf["q"][best], pdf["id"][best], len(out) + 1))
        return pd.DataFrame(out, columns=["q", "id", "rank"])

    return candidates.groupBy("q").applyInPandas(rerank, f"q {dict(candidates.dtypes)['q']}, id {dict(candidates.dtypes)['id']}, rank int")


def round_robin(candidates: DataFrame, k: int = 10) -> DataFrame:
    """Per question, the first k of candidates (q, id, score, family), one family after the other."""
    inside = Window.partitionBy("q", "family").orderBy(F.desc("score"), "id")
    turn = candidates.withColumns({"turn": F.row_number().over(inside), "best": F.max("score").over(Window.partitionBy("q", "family"))})
    w = Window.partitionBy("q").orderBy("turn", F.desc("best"), "family", "id")
    return turn.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "id", "rank")


def family_discount(candidates: DataFrame, *, tau: float, beta: float, k: int = 5) -> DataFrame:
    """Per question, the first k of candidates (q, id, rank from 1, vec or null) by 1 / (59 + rank), less the share beta of the largest cosine with a candidate of the same family that ranks before it.

    Families are joined by cosines of tau or more. A question's candidates are
    a list that a limit bounds, so each goes to one call.
    """
    import numpy as np

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"]).reset_index(drop=True)
        n, width = len(pdf), max((len(v) for v in pdf["vec"] if v is not None), default=0)
        vec = np.array([np.zeros(width) if v is None else np.asarray(v, dtype=float) for v in pdf["vec"]]).reshape(n, width)
        size = np.sqrt((vec * vec).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.nan_to_num(vec @ vec.T / np.outer(size, size))
        family, linked = np.arange(n), near >= tau
        linked[size == 0, :] = linked[:, size == 0] = False
        np.fill_diagonal(linked, True)
        while True:
            least = np.where(linked, family[None, :], n).min(axis=1)
            if (least == family).all():
                break
            family = least
        before = (family[:, None] == family[None, :]) & np.tri(n, k=-1, dtype=bool) & (size > 0)[None, :]
        most = np.where(before, near, -np.inf).max(axis=1, initial=-np.inf)
        score = (1.0 - beta * np.where(np.isinf(most), 0.0, most)) / (60.0 + np.arange(n))
        first = np.argsort(-score, kind="stable")[:k]
        return pd.DataFrame({"q": pdf["q"].iloc[first].to_numpy(), "id": pdf["id"].iloc[first].to_numpy(), "rank": np.arange(1, len(first) + 1)})

    types = dict(candidates.dtypes)
    return candidates.groupBy("q").applyInPandas(rerank, f"q {types['q']}, id {types['id']}, rank int")

import random
from collections import defaultdict

import numpy as np
import pytest

from codeloom.llm import chunk_dedup, graph, minhash

from .helpers import corpus, empty, frame, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x for x in (text or "").translate(LOW).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(r[0], len(sets[i]), least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)]


def near_copies(seed):
    """Copies whose edits leave them on either side of the similarity, without the text they come from."""
    rng = random.Random(seed)
    out = []
    for g in range(4):
        base = prose(rng, 100 + 40 * g).split()
        for i in range(14):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            out.append((2000 + 100 * g + i, " ".join(words), "en", "s", 1))
    passage = prose(rng, 60)
    return out + [(4000 + i, prose(rng, rng.randint(5, 60)) + " " + passage, "en", "s", 1) for i in range(12)]


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 2)])
def test_near_duplicates(spark, seed, block):
    rows = corpus(seed) + near_copies(seed)
    got = sorted((tuple(r) for r in minhash.near_duplicates(frame(spark, rows, clash=True), block=block).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    rows = [(None, "a b c d e f", "x", "y", 1), (1, None, "x", "y", 1), (2, "", "x", "y", 1)]
    assert sorted(tuple(r) for r in minhash.near_duplicates(frame(spark, rows[1:])).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert [tuple(r) for r in minhash.near_duplicates(frame(spark, rows[:1])).collect()] == [(None, 2, None, True)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    for size, shift in ((400, 50), (60, 10), (3, 1)):
        a, b = pool[:size], pool[shift : shift + size]
        sig = minhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], size), 2, 128)
        assert np.isfinite(sig).all()
        true = (size - shift) / (size + shift)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.16
    alone = minhash.signatures(pool[:60], np.zeros(60, int), 1, 128)
    assert (alone[0] == minhash.signatures(np.concatenate([pool[100:900], pool[:60]]), np.repeat([0, 1], [800, 60]), 2, 128)[1]).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def chunks_of(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    doc, ends = chunk_dedup.boundaries(data, np.array([0, len(data)]), 5)
    out, at = [], 0
    for e in chunk_dedup.cuts(ends.tolist(), len(data), 24, 512):
        out.append((at, e, data[at:e].tobytes()))
        at = e
    return out


def test_chunk_duplicates(spark):
    rng = random.Random(9)
    rows = corpus(9)
    passage = prose(rng, 60)
    rows += [(5000 + i, f"{prose(rng, rng.randint(3, 40))} {passage} {prose(rng, 9)}", "en", "s", 1) for i in range(5)]
    rows += [(6000, ("line of licence text that comes again and again\n") * 12, "en", "s", 1)]
    unique = {(r[0], r[1]): r for r in rows}
    seen, spans = {}, {}
    for key in sorted(unique, key=lambda k: (k[0] is None, k[0] or 0)):
        own = []
        for a, b, piece in chunks_of(key[1]):
            if piece in seen:
                if own and own[-1][1] == a:
                    own[-1][1] = b
                else:
                    own.append([a, b])
            seen[piece] = True
        spans[key] = [tuple(s) for s in own]
    text = {r[0]: r[1] for r in rows}
    for least in (0, 100):
        got = chunk_dedup.chunk_duplicates(frame(spark, rows, clash=True), min_run=least).collect()
        assert len(got) == len(rows)
        for r in got:
            own = spans[r["doc_id"], text[r["doc_id"]]]
            assert [(s["start"], s["end"]) for s in r["spans"]] == [s for s in own if s[1] - s[0] >= least]
            assert r["n_short"] == sum(b - a for a, b in own if b - a < least)
            assert r["n_chunks"] == len(chunks_of(text[r["doc_id"]])) and r["n_bytes"] == len((text[r["doc_id"]] or "").encode())
    assert all(r["n_removed"] > 100 for r in got if 5001 <= (r["doc_id"] or 0) <= 5004)
    assert chunk_dedup.chunk_duplicates(empty(spark)).count() == 0


def test_chunks_resist_insertions():
    rng = random.Random(2)
    text = prose(rng, 800)
    a, b = ({c[2] for c in chunks_of(t)} for t in (text, text[:900] + "inserted" + text[900:]))
    assert len(a & b) > 0.9 * len(a)


def test_chunk_query_takes_short_copies_and_passages(spark, tmp_path):
    rng = random.Random(5)
    short, passages = "one two three", [prose(rng, 14)[:80] for _ in range(20)]
    rows = [(i, short, "en", "s", 1) for i in (1, 2)]
    rows += [(10 * (k + 1) + i, f"{prose(rng, 20)} {p} {prose(rng, 20)}", "en", "s", 1) for k, p in enumerate(passages) for i in (1, 2)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in chunk_dedup.op3_chunk_dedup(spark, str(tmp_path)).collect()}
    assert (got[2]["spans"], got[2]["n_removed"], got[2]["duplicated"]) == (f"0:{len(short)}", len(short), True) and not got[1]["duplicated"]
    assert any(got[10 * (k + 1) + 2]["duplicated"] for k in range(20)) and not any(got[10 * (k + 1) + 1]["duplicated"] for k in range(20))


def test_small_components_keep_few_partitions(spark, monkeypatch):
    from codeloom.llm import graph

    kept, keep = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: kept.append(keep(df)) or kept[-1])
    edges = spark.range(0, 600, 1, 8).selectExpr("id AS u", "id - id % 30 AS v").unionByName(spark.range(600, 640).selectExpr("id AS u", "id + 1 AS v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {k: k - k % 30 for k in range(600)} | {k: 600 for k in range(600, 641)}
    assert len(kept) > 4 and all(df.rdd.getNumPartitions() == 1 for df in kept[1:])  # the first is counted to know

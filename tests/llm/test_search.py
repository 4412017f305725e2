import hashlib
import random
import re

import numpy as np

from codeloom.llm import decontaminate, topk

from .helpers import corpus, empty, frame, prose, tables

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(text, items, size=10):
    own, hit, met = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[i : i + n]:
                    hit.update(range(at, at + n))
                    met.add(str(item))
    return len(own), len(hit), sorted(met)


def fixture():
    rng = random.Random(8)
    rows = corpus(8)
    items = [(1, prose(rng, 25)), (2, "One, two THREE"), (3, None), (4, ""), (5, prose(rng, 10)), (11, "a b a b a b a b a b a b"), (12, "été Über straße"), (1, "four five six")]
    extra = [(700, f"x {items[0][1].upper()} y"), (701, "... one\ntwo--three one two three"), (702, " ".join(words(items[0][1])[3:14])), (703, "a b " * 30), (704, "ete uber ÉTÉ été über straße"), (705, items[4][1] + " " + items[4][1]), (706, " ".join(words(items[4][1])[:9])), (707, "four five six")]
    return rows + [(*e, "en", "s", 1) for e in extra], items


def test_decontamination(spark, tmp_path):
    rows, items = fixture()
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    for settings in ({}, {"item_rows": 2}):
        got = decontaminate.decontaminate(frame(spark, rows, clash=True), bench, **settings).collect()
        want = sorted([(r[0] is None, r[0] or 0, *brute(r[1], items)) for r in rows])
        assert sorted([(r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in got]) == want
    path = tables(spark, tmp_path, rows, benchmark=bench.select("item_id", "text"))
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.op2_decontamination(spark, path).collect()}
    for r in rows:
        n, hit, met = brute(r[1], items)
        q = got[r[0], n]
        assert (q["n_hit"], q["n_items"], q["contaminated"], q["items_sha256"]) == (hit, len(met), hit > 0, hashlib.sha256(",".join(met).encode()).hexdigest())


def test_decontamination_empty(spark):
    rows, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(frame(spark, rows), bench.limit(0)).collect()} == {0}


def test_phrases_and_proximity(spark):
    docs = frame(spark, [(1, "the quick brown fox", "en", "s", 1), (2, "fox jumps; brown quick", "en", "s", 1), (3, "quick one two three four brown", "en", "s", 1), (4, "quick", "en", "s", 1), (5, "brown fox", "en", "s", 1)])
    index = decontaminate.build_index(docs)
    find = lambda **k: sorted(tuple(r) for r in decontaminate.phrase_matches(index, [(7, "Quick brown"), (8, "")], **k).collect())
    assert find() == [(7, 1, 1, 3)]
    assert find(slop=0) == [(7, 1, 1, 3), (7, 2, 2, 4)]
    assert find(slop=4) == [(7, 1, 1, 3), (7, 2, 2, 4), (7, 3, 0, 6)]


def brute_top(rows, every=50, k=5):
    whole = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q in sorted({i for i, _ in whole if i % every == 0}):
        v = min((v.tolist() for i, v in whole if i == q))
        scored = sorted((-int(np.dot(v, c)), i) for i, c in whole if i != q and len(c) == len(v))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12) / 3]) for i in range(240)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(100, rows[7][1]), (1000, [1.0, 2.0]), (1001, [2.0, 2.0]), (1050, None), (1100, []), (1101, [1.0, None] * 6), (1102, [float("nan")] * 12), (1103, [float("inf")] * 12), (None, rows[1][1]), rows[9], rows[50]]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, v int, score int, part int")
    for settings in ({}, {"query_rows": 2, "chunk": 16, "block": 5}):
        got = {}
        for r in sorted(topk.exact_top_k(df, **settings).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got == brute_top(rows)
    assert topk.exact_top_k(df.limit(0)).count() == 0

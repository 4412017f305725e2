from collections import Counter

import corpus_pipeline
from codeloom.llm import decontaminate, minhash, quality

from .helpers import SCHEMA, corpus, empty, prose, tables
from .test_classifiers_secrets import LABELS, training

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows, labels = training(n=120)
    item = prose(rng, 15)
    rows = rows + [r for r in corpus(2, 5) if r[0] is None or r[0] > 500] + [(3000, f"{prose(rng, 30)} {item}", "en", "s", 1)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    path = tables(spark, tmp_path, rows, labels=spark.createDataFrame(labels, LABELS), benchmark=bench)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        got.append(docs.collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(sorted(r.asDict()) == sorted(COLUMNS) for step in got[:-1] for r in step[:1])
    keep = lambda step: Counter((r["doc_id"], r["text"]) for r in step)
    want = quality.score_quality(spark.createDataFrame(got[0], SCHEMA), spark.createDataFrame(labels, LABELS)).filter("predicted = 1").collect()
    assert keep(got[1]) == keep(want)
    kept = {r["doc_id"] for r in minhash.near_duplicates(spark.createDataFrame(got[1], SCHEMA)).filter("kept").collect()}
    assert {r["doc_id"] for r in got[2]} == kept and max(keep(got[2]).values()) == 1
    hit = {r["doc_id"] for r in decontaminate.decontaminate(spark.createDataFrame(got[2], SCHEMA), bench).filter("n_hit > 0").collect()}
    assert {r["doc_id"] for r in got[3]} == kept - hit and 3000 not in {r["doc_id"] for r in got[3]}
    assert set(keep(got[4])) <= set(keep(got[3])) and max(keep(got[4]).values()) <= 3
    assert keep(got[5]) == keep(got[4])
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, path).collect()) == Counter(tuple(r)[:5] for r in got[5])


def test_empty_corpus(spark, tmp_path):
    path = tables(spark, tmp_path, [], labels=spark.createDataFrame([], LABELS), benchmark=spark.createDataFrame([], "item_id long, text string"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), path).count() == 0


def test_stages_decide_by_row(spark, tmp_path):
    import random

    rng = random.Random(7)
    item, copied = prose(rng, 15), prose(rng, 80)
    near = copied + " " + prose(rng, 2)
    clean, other, alone = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    dirty = f"{prose(rng, 30)} {item}"
    rows = [(None, t) for t in (clean, dirty, copied, near, clean, "")] + [(5, other), (5, dirty), (6, copied), (6, alone), (7, near), (8, alone)]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    path = tables(spark, tmp_path, rows, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    counted = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert counted(corpus_pipeline.decontamination(spark, docs, path)) == Counter((r[0], r[1]) for r in rows if r[1] != dirty)
    assert counted(corpus_pipeline.near_duplicate(spark, docs, path)) == Counter([(None, clean), (None, ""), (5, other), (5, dirty), (6, copied), (6, alone)])
    nameless = docs.filter("doc_id is null")
    left = counted(corpus_pipeline.near_duplicate(spark, nameless, path))
    assert sum(left.values()) == 4 and sum(left[None, t] for t in (copied, near)) == 1 and all(left[None, t] == 1 for t in (clean, dirty, ""))

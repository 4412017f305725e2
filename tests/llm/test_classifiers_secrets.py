import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import quality, secrets, toxicity

from .helpers import corpus, empty, frame, prose

SF = "/root/testdata/sf0.1"


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def training(seed=3, n=240):
    """Clean documents, repeated or shouted junk, and insults."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, bad, toxic = prose(rng, rng.randint(20, 60)), i % 3 == 0, i % 4 == 1
        if bad:
            text = " ".join(w for w in text.split()[:8] for _ in range(12)) if i % 2 else text.upper().replace(" ", "!! ")
        if toxic and not bad:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron"]))
            text = " ".join(words)
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 0 if bad else 1, int(toxic and not bad)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality(spark):
    rows, labels = training()
    rows += corpus(5, 5)
    got = quality.score_quality(frame(spark, rows, clash=True), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"]) for r in got)
    own = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] < 900 and r["text"] == rows[r["doc_id"]][1]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in own) >= 0.85 * len(own)


def test_word_vectors_match_plain_sums(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(0, 40), "ab") + rng.choice(["", " !!", "\tx."]), "en", "s", 1) for i in range(40)]
    sample = frame(spark, rows).selectExpr("doc_id AS id", "1 AS y", "text")
    vocabulary = quality.frequent_words(sample, 3, 20)
    count = Counter(w for r in rows for w in set(quality.words(r[1].encode())) if len(w) > 1)
    assert vocabulary == sorted((w for w in count if count[w] >= 3), key=lambda w: (-count[w], w))[:20] and len(vocabulary) == 20
    got = quality.context_sums(frame(spark, rows).repartition(3), "text", vocabulary, 1)
    place, sign = quality.index_vectors(len(got), 1)
    want, numbers = np.zeros_like(got), quality.Numbers(vocabulary)
    for r in rows:
        own = [numbers[w] for w in quality.words(r[1].encode())]
        for i, a in enumerate(own):
            for b in own[max(0, i - 2) : i] + own[i + 1 : i + 3]:
                want[a, place[b]] += sign[b].astype(int)
    assert (got == want).all() and got[quality.SHARED :].any(1).all()


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_held_out_labels_and_odd_tables(spark, score):
    rows, labels = training(n=120)
    docs = frame(spark, rows)
    turned = [(i, 1 - q if held(i) else q, 1 - t if held(i) else t) for i, q, t in labels] + [(7777, 1, 1), (None, 0, 0), (3, None, None)]
    a, b = ({r["doc_id"]: r["score"] for r in score(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b
    assert score(empty(spark), spark.createDataFrame(labels, LABELS)).count() == 0
    assert {r["score"] for r in score(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}


def test_toxicity(spark):
    rows, labels = training()
    rows += corpus(5, 5)
    got = toxicity.score_toxicity(frame(spark, rows, clash=True), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    own = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["text"] == rows[r["doc_id"]][1]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in own) >= 0.9 * len(own)


def found_and_right(spark, op, column, sf, rare):
    """Recall and precision of the label `rare` on held-out rows, and the number of rows that have it."""
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(r["predicted"] == rare, labels[r["doc_id"]][column] == rare) for r in op(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    both, said, is_ = sum(p and t for p, t in own), sum(p for p, _ in own), sum(t for _, t in own)
    return both / is_, both / max(said, 1), is_


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_recall_and_precision(spark):
    # six of the 97 toxic rows are junk without any insult left in the text: more than 0.938 cannot be found
    recall, precision, n = found_and_right(spark, toxicity.op9_toxicity, "toxic", SF, 1)
    assert n >= 90 and recall >= 0.92 and precision >= 0.95
    recall, precision, n = found_and_right(spark, quality.op5_quality, "quality", SF, 0)
    assert n >= 100 and recall >= 0.95 and precision >= 0.95


def base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def plain_battery(token):
    """The battery, number by number."""
    cdf = lambda z: 1 / (1 + math.exp(-(1.5976 * z + 0.07056 * z**3)))
    clip = lambda z: max(-8.0, min(8.0, z))
    two = lambda z: max(2 * (1 - cdf(min(abs(z), 8))), 1e-12)
    core = token.rstrip("=")
    chars, far, letters = next((e for e in secrets.ENCODINGS if core and set(core) <= set(e[0])), secrets.ENCODINGS[-1])
    v, size = np.array([max(chars.find(c), 0) for c in core or "0"], float), len(chars)
    n, free = len(v), size - 1
    chi = size / n * (np.unique(v, return_counts=True)[1] ** 2).sum() - n
    uniform = max(1 - cdf(clip((chi - free) / math.sqrt(2 * free))), 1e-12)
    written = cdf(clip((chi - free - n * far) / math.sqrt(2 * (free + 2 * n * far))))
    up = v >= size / 2
    expected = 1 + 2 * up.sum() * (~up).sum() / n
    spread = math.sqrt(max((expected - 1) * (expected - 2) / max(n - 1, 1), 1e-9))
    runs = two((1 + (up[1:] != up[:-1]).sum() - expected) / spread) if 0 < up.sum() < n else 1e-12
    d = v - v.mean()
    serial = two((d[1:] * d[:-1]).sum() / (d**2).sum() * math.sqrt(n)) if (d**2).sum() > 0 else 1e-12
    half = -sum(map(math.log, (uniform, runs, serial)))
    random_ = max(math.exp(-half) * (1 + half + half**2 / 2), 1e-30)
    return n, min(1.0, written * letters ** sum(not c.isdigit() for c in core) / random_)


def plain_random(text, rate=0.05):
    """Tokens that overlap no base span, by step-up over their weighted p values."""
    tokens = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text)]
    tokens = [t for t in tokens if not any(a < t[1] and t[0] < b for a, _, b in base(text))]
    tested = [(*plain_battery(t[2]), *t) for t in tokens]
    if not tested:
        return []
    mean = sum(t[0] for t in tested) / len(tested)
    ps = sorted(t[1] * mean / t[0] for t in tested)
    most = max((p for i, p in enumerate(ps) if p <= rate * (i + 1) / len(ps)), default=-1)
    return sorted(t[2:] for t in tested if t[1] * mean / t[0] <= most)


def test_random_spans_match_plain_battery(spark):
    rng = random.Random(9)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    alphabets = [e[0] for e in secrets.ENCODINGS] + ["ab", "0", "the of and "]
    rows = []
    for i in range(150):
        parts = [pick(rng.choice(alphabets), rng.randint(1, 60)) for _ in range(rng.randint(0, 12))]
        parts += rng.choice([[], ["password=" + pick(alphabets[5], 30)], ["my_token=" + pick("abc", 25) + ".tail" + pick(alphabets[5], 30)], ["AKIA" + pick(alphabets[3], 30)], [" " + pick(alphabets[5], 30)]])
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", "é "]).join(parts)))
    found = {r["doc_id"]: [(s["start"], s["end"], s["value"]) for s in r["secrets"] if s["kind"] == "random"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(found[i] == plain_random(t) for i, t in rows) and sum(map(len, found.values())) > 100


def test_very_many_matches(spark):
    text = " ".join(f"token=abcdefgh{i}" for i in range(32_000)) + " end"
    began = time.time()
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    took = time.time() - began
    assert [(s["start"], s["end"]) for s in row["base"]] == [(m.start(), m.end()) for m in re.finditer(r"\S+=\S+", text)]
    assert took < 20


def test_secrets(spark, tmp_path):
    rng = random.Random(6)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(a) for _ in range(n))
    texts = [
        f'é😀 Password: "{key(12)}" and token={key(7)} API_KEY = {key(20)}', "secret:secret:longvalue1", "AKIA" + key(16, "ABCDEFGH0123"), "AKIAAKIA short", key(40, "0123456789abcdef") + "g" + key(31, "0123456789abcdef"),
        f"see {key(60)} there", f"hash {key(64, '0123456789ABCDEF')} x", "internationalization_of_configuration_properties and /usr/local/share/applications/thing", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", None, "", "passwd  ==  abcdefgh\ntoken = 'x.y.z-0000000'", "token=" + "A" * 50_000,
    ]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + corpus(7)
    got = secrets.find_secrets(frame(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] < len(texts) and r["text"] == texts[r["doc_id"]]}
    for i, t in enumerate(texts):
        assert [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in found[i]["base"]] == base(t or ""), i
        assert all(s["value"] == t[s["start"] : s["end"]] for s in found[i]["secrets"])
    extra = {i: [s["value"] for s in r["secrets"] if s["kind"] == "random"] for i, r in found.items()}
    assert len(extra[5]) == 1 and len(extra[6]) == 1 and not extra[7] and not extra[8]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    listed = lambda t: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base(t or ""))
    want = Counter((r[0], *(sum(k == x for _, k, _ in base(r[1] or "")) for x in range(3)), hashlib.sha256(listed(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter(tuple(r)[:5] for r in secrets.op10_secrets(spark, str(tmp_path)).collect()) == want
    assert secrets.find_secrets(empty(spark)).count() == 0

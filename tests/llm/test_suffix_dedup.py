import hashlib
import random

import pytest

from codeloom.llm import common, suffix_dedup


def brute(rows, length):
    """{row number: covered byte positions}; rows in order of (id, text hash is not needed for distinct ids)."""
    seen, covered = set(), {i: set() for i in range(len(rows))}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        b = (rows[i][1] or "").encode()
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                covered[i].update(range(s, s + length))
            seen.add(b[s : s + length])
    return covered


def documents():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(20)
    out = [(i, prose(rng.randint(5, 80))) for i in range(30)]
    out += [(100 + i, f"{prose(rng.randint(0, 30))} {passage} {prose(10)}") for i in range(6)]
    out += [(200 + i, f"{prose(3)}\n{line}\n{prose(3)}\n{line}\n{prose(20)}") for i in range(12)]
    base = passage.split()
    for i in range(8):
        own = list(base) + prose(40).split()
        own[rng.randrange(len(own))] = word()
        out.append((300 + i, " ".join(own)))
    out += [(400, "ab" * 300), (401, "x" * 700), (402, "ab" * 170), (403, None), (404, ""), (405, "z" * 99), (406, "z" * 100), (407, "z" * 100), (None, passage)]
    out += [(500 + i, out[3][1] + out[4][1]) for i in range(5)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("often", [(1000, 20_000), (3, 6), (1, 1)])
def test_matches_brute_force(spark, often):
    rows = documents()
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, row long, sha string")
    found = {r["doc_id"]: r for r in suffix_dedup.repeated_strings(docs, often=often, block=2000).collect()}
    expected = brute(rows, 100)
    assert len(found) == len(rows)
    for i, (doc, _) in enumerate(rows):
        got = {p for s in found[doc]["spans"] for p in range(s["start"], s["end"])}
        assert got == expected[i], doc


def test_query_digests_and_repeated_rows(spark, tmp_path):
    rows = documents()
    rows += [rows[0], rows[1]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["n_bytes"]): r for r in suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    expected = brute(rows[:-2], 100)
    assert len(got) == len(rows) - 2
    for i, (doc, text) in enumerate(rows[:-2]):
        b = (text or "").encode()
        r = got[doc, len(b)]
        assert r["n_removed"] == len(expected[i])
        assert r["n_spans"] == sum(1 for p in expected[i] if p - 1 not in expected[i])
        assert r["kept_sha256"] == hashlib.sha256(bytes(c for p, c in enumerate(b) if p not in expected[i])).hexdigest()


def test_empty(spark):
    assert suffix_dedup.repeated_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_beyond_a_piece_and_few_known_runs(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup, "KNOWN", 3)
    rows = documents()
    long_ = " ".join(t or "" for _, t in rows if t and len(t) < 400)
    rows += [(900, long_ + "x" * 3000), (50, long_[2000:6000] + "ab" * 800)]
    found = {r["doc_id"]: r for r in suffix_dedup.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string"), often=(3, 6), block=2000).collect()}
    expected = brute(rows, 100)
    for i, (doc, _) in enumerate(rows):
        assert {p for s in found[doc]["spans"] for p in range(s["start"], s["end"])} == expected[i], doc


def test_merged_runs(spark):
    df = spark.createDataFrame([(1, [5, 0, 4, 20], [9, 5, 6, 21]), (2, [3], [4])], "row long, starts array<long>, ends array<long>")
    assert {r["row"]: [tuple(s) for s in r["spans"]] for r in common.merged(df).collect()} == {1: [(0, 9), (20, 21)], 2: [(3, 4)]}


def test_many_copies_in_one_task(spark):
    # all runs but the first are known to be covered: a batch may hold nothing else
    rows = [(i, "start " + "word of a passage " * 12 + f" {i}") for i in range(3000)]
    got = {r["doc_id"]: len(r["spans"]) for r in suffix_dedup.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert all(got[i] == 1 for i in range(1, 3000))

from codeloom.operators import cards, evaluate, search
from pyspark.sql import functions as F

from .test_graph import build, sym


def test_comments():
    go = ["// Package x.", "", "/**", " * Loads the config", " * from disk.", " * @param p path", " */", "func Load() {}"]
    assert cards.comment_above(go, 8) == "Loads the config from disk."
    assert cards.comment_above(["# One", "# two", "def f():", "    pass"], 3) == "One two"
    assert cards.comment_above(["x = 1", "", "def f():"], 3) == ""
    assert cards.docstring_below(["def f():", '    """Does it."""', "    pass"], 1, 3) == "Does it."
    assert cards.docstring_below(["def f():", "    '''A", "    b", "    '''"], 1, 4).startswith("A b")


def graph(spark):
    symbols = [sym(1, "host/on.go", "StartOnboarding", start=1), sym(2, "host/on.go", "verifyHost", start=11), sym(3, "host/on.go", "createListing", start=21), sym(4, "parse/p.go", "ParseFile", start=1), sym(5, "parse/p.go", "readToken", start=11)]
    call = lambda i, a, b: (i, a, b, "", "", "", "calls", 2, "host/on.go" if a < 4 else "parse/p.go")
    return build(spark, symbols, [call(1, 1, "verifyHost"), call(2, 1, "createListing"), call(3, 4, "readToken")])


def test_cards_and_search(spark):
    g = graph(spark)
    docs = spark.createDataFrame([(2, "checks who may rent a flat"), (4, "reads source text")], "sym_id long, doc string")
    made = cards.cards(g.symbols, docs)
    text = {r["sym_id"]: r["text"] for r in made.collect()}
    assert text[4] == "ParseFile func. name: parse file. distinct: file parse reads source text. signature: func ParseFile(). in parse p. doc: reads source text"
    embed = cards.hashing_embedder()
    vecs = cards.embed_pass(made, spark.createDataFrame([], "hash string, model string, vec array<tinyint>"), "m", embed)
    assert vecs.count() == 5
    v = search.Vectors(made.select("sym_id", "hash"), vecs, "m", embed)
    found, clusters, note = search.search(g, "who may rent a flat", vectors=v, limit=5)
    rows = found.collect()
    # what the vectors find, and the hub that calls it
    assert note == "" and {r["qname"] for r in rows[:2]} == {"verifyHost", "StartOnboarding"} and "vec" in rows[0]["lanes"]
    assert clusters.count() == 2
    found, _, note = search.search(g, "parse file", limit=3)
    assert found.first()["qname"] == "ParseFile" and note


def test_evaluation(spark):
    truth = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1)], "grp string, k int")
    guess = spark.createDataFrame([("g", 1), ("g", 3), ("i", 9)], "grp string, k int")
    got = {r["grp"]: (r["tp"], r["fp"], r["fn"], r["recall"], r["precision"]) for r in evaluate.confusion(guess, truth, ["k"]).collect()}
    assert got == {"g": (1, 1, 1, 0.5, 0.5), "h": (0, 0, 1, 0.0, 1.0), "i": (0, 1, 0, 1.0, 0.0)}
    values = spark.createDataFrame([("a", float(i)) for i in range(10)], "g string, v double")
    assert tuple(evaluate.percentiles(values, "g", "v").first())[1:] == (4.0, 8.0, 9.0)
    ci = evaluate.bootstrap_ci(spark.range(500).select("id", (F.col("id") % 10).cast("double").alias("value"))).first()
    assert ci["low"] < 4.5 < ci["high"] and ci["high"] - ci["low"] < 1


def test_top_k_of_many_queries(spark):
    import numpy as np
    from codeloom.operators import retrieval

    rng = np.random.default_rng(2)
    rows = [(i, None if i % 97 == 0 else rng.integers(-127, 128, 5 if i % 41 == 0 else 8).tolist()) for i in range(600)]
    rows += [(i + 600, v) for i, v in rows[:60]]  # ties
    df = spark.createDataFrame(rows, "id long, vec array<tinyint>").repartition(3)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) if a is not None and b is not None and len(a) == len(b) else float("-inf")
    for most in (4096, 15):
        got = {}
        for r in retrieval.top_k_batch(df, df.filter("id % 20 = 0").selectExpr("id AS q", "vec AS qv"), 5, most).orderBy("q", "rank").collect():
            got.setdefault(r["q"], []).append(r["id"])
        assert got == {q: [i for _, i in sorted((-dot(v, w), i) for i, w in rows if i != q)[:5]] for q, v in rows if q % 20 == 0}
    plan = retrieval.top_k_batch(df, df.limit(3).selectExpr("id AS q", "vec AS qv"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan  # pairs are no rows

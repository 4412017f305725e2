import itertools
import random

from codeloom.operators import graph, incremental, nav, resolve, retrieval, text, verbs, workspace
from codeloom.operators.verbs import CodeGraph
from codeloom.schema import EDGES, SYMBOLS
from pyspark.sql import functions as F

RAW = "edge_id long, src_id long, dst_name string, dst_qualifier string, dst_ns string, src_ns string, kind string, line int, src_file string"


def sym(i, file, name, parent="", ns="", tier=0, kind="func", start=1, end=9):
    return (i, file, name, parent, ns, tier, kind, f"func {name}()", start, end)


def ladder(symbols, name, qualifier, src_ns, hint):
    """The ladder, rung by rung, as a check of the one-pass form."""
    def match(a, b):
        ends = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
        return bool(a and b) and (a == b or any(x.endswith(m + y) for m in "/.\\" for x, y in ((a, b), (b, a))) or a in [b + e for e in ends])

    own = [s for s in symbols if s[2] == name]
    plain, spaced = (lambda s: (s[1], s[8], s[0])), (lambda s: (s[4], s[1], s[8], s[0]))
    rungs = [
        (lambda s: qualifier and s[3] == qualifier and s[5] == 0, plain), (lambda s: qualifier and s[3] == qualifier and s[5] == 1, spaced),
        (lambda s: match(s[4], hint) and s[5] == 0, spaced), (lambda s: match(s[4], hint) and s[5] == 1, spaced),
        (lambda s: src_ns and s[4] == src_ns and s[5] == 0, plain), (lambda s: s[5] == 0, plain), (lambda s: s[5] == 1, spaced),
    ]
    for i, (ok, order) in enumerate(rungs):
        if found := sorted([s for s in own if ok(s)], key=order):
            return found[0][0], "unambiguous" if len(found) == 1 else "ambiguous", i + 1
    return 0, "unresolved", 0


def test_ladder(spark):
    symbols = [sym(i + 1, f"f{i % 3}", "abc"[i % 3], ["", "P", "Q"][i % 4 % 3], ["x", "y/x", "z.ts", ""][i % 4], i % 5 == 0, start=i) for i in range(24)]
    symbols = [(*s[:5], int(s[5]), *s[6:]) for s in symbols]
    asks = list(itertools.product("abd", ["", "P", "R"], ["", "x", "q"], ["", "x", "z", "nope"]))
    raw = spark.createDataFrame(asks, "dst_name string, dst_qualifier string, src_ns string, dst_ns string")
    got = {tuple(r)[:4]: (r["dst_id"], r["confidence"], r["rung"]) for r in resolve.resolve(raw, spark.createDataFrame(symbols, SYMBOLS)).collect()}
    assert len(got) == len(asks)
    for a in asks:
        assert got[a] == ladder(symbols, *a), a


def build(spark, symbols, edges):
    s = spark.createDataFrame(symbols, SYMBOLS)
    return CodeGraph(s, resolve.resolve_edges(spark.createDataFrame(edges, RAW), s))


def small(spark):
    symbols = [sym(1, "a.go", "Target", start=3, end=3), sym(2, "a.go", "CallerOne", start=5, end=7), sym(3, "b.go", "CallerTwo", start=3, end=6)]
    call = lambda i, src, line, file: (i, src, "Target", "", "", "", "calls", line, file)
    return build(spark, symbols, [call(1, 2, 6, "a.go"), call(2, 3, 4, "b.go"), call(3, 3, 5, "b.go"), (4, 0, "lib/Target", "", "", "", "imports", 1, "b.go")])


def test_verbs(spark):
    g = small(spark)
    assert sorted(tuple(r)[:2] + (r["line"],) for r in verbs.callers(g, "Target").collect()) == [("a.go", "CallerOne", 6), ("b.go", "CallerTwo", 4), ("b.go", "CallerTwo", 5)]
    assert sorted(r["line"] for r in verbs.callees(g, "CallerTwo").collect()) == [4, 5]
    assert [tuple(r) for r in verbs.dependents(g, "target").collect()] == [("imports", "b.go", "", 1)]
    assert {r["section"]: r["n"] for r in verbs.impact(g, "Target").collect()} == {"definitions": 1, "callers": 3, "callees": 0, "dependents": 1, "files": 2}
    assert verbs.median_called(g, 4).count() == 0 and verbs.median_called(g, 1).first()["name"] == "Target"
    near = verbs.enclosing(g, "a.go", 6, 6).collect()
    assert [(r["name"], r["callers"]) for r in near] == [("CallerOne", 0)]
    assert [(r["callers"], r["external"]) for r in verbs.enclosing(g, "a.go", 1, 3).collect()] == [(3, 2)]
    nodes, edges = graph.neighborhood_graph(g, "Target")
    assert sorted(r["id"] for r in nodes.collect()) == ["sym:CallerOne", "sym:CallerTwo", "sym:Target"] and edges.count() == 3
    nodes, edges = graph.full_graph(g)
    assert nodes.count() == 3 and edges.count() == 3
    assert '"schemaVersion":"1"' in graph.to_json(nodes, edges).first()[0]


def test_innermost(spark):
    spans = spark.createDataFrame([(1, "f", "outer", 1, 1000), (2, "f", "inner", 300, 310), (3, "f", "twin", 300, 310), (4, "g", "other", 1, 5)], "sym_id long, file string, name string, start_line int, end_line int")
    points = spark.createDataFrame([("a", "f", 305), ("b", "f", 299), ("c", "f", 2000), ("d", "g", 5)], "id string, file string, line int")
    assert {r["id"]: r["name"] for r in verbs.innermost(points, spans).collect()} == {"a": "inner", "b": "outer", "c": None, "d": "other"}


def test_patch_equals_rebuild(spark):
    g = small(spark)
    new = spark.createDataFrame([sym(9, "a.go", "Renamed", start=3, end=3), sym(10, "a.go", "CallerOne", start=5, end=7)], SYMBOLS)
    raw = spark.createDataFrame([(1, 10, "Renamed", "", "", "", "calls", 6, "a.go")], RAW)
    patched = incremental.patch(g, new, raw, spark.createDataFrame([("a.go",)], "path string"))
    symbols = g.symbols.filter("file = 'b.go'").unionByName(new)
    rebuilt = CodeGraph(symbols, resolve.resolve_edges(g.edges.filter("src_file = 'b.go'").select(*raw.columns).unionByName(raw), symbols))
    assert incremental.differences(patched, rebuilt).count() == 0
    assert incremental.differences(g, rebuilt).count() > 0


def test_snapshot(spark, tmp_path):
    g = small(spark)
    incremental.export(g, str(tmp_path / "snap"))
    assert incremental.differences(g, incremental.open_snapshot(spark, str(tmp_path / "snap"))).count() == 0
    (tmp_path / "other").mkdir()
    spark.createDataFrame([('{"schema_version": 99}',)], "value string").coalesce(1).write.text(str(tmp_path / "other/_meta"))
    try:
        incremental.open_snapshot(spark, str(tmp_path / "other"))
        raise AssertionError("read a snapshot of another version")
    except incremental.VersionMismatch:
        pass


def test_diffusion_keeps_mass(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 1.0)], "a long, b long, w double")
    got = {r["id"]: r["mass"] for r in graph.diffuse(pairs, spark.createDataFrame([(1, 2.0), (9, 1.0)], "id long, score double")).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got[1] == max(got.values()) and abs(got[2] - got[4]) < 1e-12
    assert graph.diffuse(pairs, spark.createDataFrame([(1, 0.0)], "id long, score double")).count() == 0


def test_components_and_admission(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.connected_components(chain, spark.createDataFrame([(500,)], "id long")).collect()}
    assert got == {500: 500}
    got = {r["id"]: r["component"] for r in graph.connected_components(chain).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43
    state = graph.Admission([1], 3, 2)
    assert state.take(iter([(1, 2), (2, 1), (1, 3), (1, 4), (5, 6)])) == [2, 3] and list(state.pairs) == [(1, 2), (1, 3)]


def walked(edges, seeds, most_nodes, most_degree, part):
    """Two hops as the rules say them, one edge at a time, with one state."""
    nodes, degree, seen, frontier = set(seeds), {}, [], list(seeds)
    for _ in range(2):
        if not frontier or len(nodes) >= most_nodes:
            break
        fresh = []
        for at in range(0, len(frontier), part):
            own = set(frontier[at : at + part])
            for a, b in edges:
                if a == b or not own & {a, b} or (min(a, b), max(a, b)) in seen or degree.get(a, 0) >= most_degree or degree.get(b, 0) >= most_degree:
                    continue
                new = {a, b} - nodes
                if len(nodes) + len(new) > most_nodes:
                    continue
                seen.append((min(a, b), max(a, b)))
                for x in (a, b):
                    degree[x] = degree.get(x, 0) + 1
                    if x in new:
                        nodes.add(x)
                        fresh.append(x)
        frontier = fresh
    return seen


def test_neighborhood_keeps_its_state_over_hops(spark):
    rng = random.Random(4)
    for most_nodes, most_degree, part in ((1000, 1, 400), (12, 3, 2), (40, 2, 3), (1000, 64, 5)):
        edges = [(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(120)]
        df = spark.createDataFrame([(i, a, b, "x", "", "", "calls", "unambiguous", 1, "f") for i, (a, b) in enumerate(edges)], EDGES)
        got = graph.neighborhood(CodeGraph(df.limit(0).select(), df), [3, 7, 3], most_nodes, most_degree, part).collect()
        assert [(r["a"], r["b"]) for r in got] == walked(edges, [3, 7], most_nodes, most_degree, part)
    line = spark.createDataFrame([(1, 1, 2, "x", "", "", "calls", "unambiguous", 1, "f"), (2, 2, 3, "x", "", "", "calls", "unambiguous", 1, "f")], EDGES)
    assert [tuple(r) for r in graph.neighborhood(CodeGraph(line, line), [1], most_degree=1).collect()] == [(1, 2, 1)]


def test_observed_edges_bring_in_their_ends(spark):
    rng = random.Random(8)
    for _ in range(3):
        edges = [(rng.randint(1, 40), rng.randint(1, 40)) for _ in range(60)]
        inside, want = {1, 2}, []
        for i, (a, b) in enumerate(edges):
            if a != b and (a in inside or b in inside):
                inside |= {a, b}
                want.append(i)
        df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "a long, b long, at long")
        assert sorted(r["at"] for r in graph.reached(df, spark.createDataFrame([(1,), (2,)], "id long")).collect()) == want


def test_labels_fold_member_by_member(spark):
    rows = [(1, i, f, ["x"]) for i, f in enumerate(["a/b/f", "a/b/g", "a/b/h"])] + [(2, 0, "a/b/only.go", ["y", "x", "y"]), (3, 0, "p/q", []), (3, 1, "r/s", [])]
    got = {r["component"]: r["label"] for r in retrieval.cluster_labels(spark.createDataFrame(rows, "component long, place long, file string, tokens array<string>")).collect()}
    assert got == {1: "a \u00b7 x", 2: "a/b/only.go \u00b7 y", 3: ""}


def test_answers_with_order_and_total(spark):
    g = small(spark)
    rows, total = verbs.limited(verbs.callers(g, "Target"), 2, "file", "line")
    assert [(r["file"], r["line"]) for r in rows] == [("a.go", 6), ("b.go", 4)] and total == 3
    a = verbs.impact_answer(g, "Target", limit=1)
    assert (len(a.callers), a.callers_total, a.dependents_total, a.callees_total, len(a.definitions)) == (1, 3, 1, 0, 1)
    files = spark.createDataFrame([("a.go", "x\nTarget\nfunc Target"), ("c.go", "Mention"), ("z_test.go", "Mention Mention\nMention")], "file string, content string")
    found = nav.nav(g, files, "Target")
    assert [r["file"] for r in found.definitions] == ["a.go"] and found.callers_total == 3 and not found.callers_from_grep and found.files == ["a.go"]
    found = nav.nav(g, files, "Mention")
    assert found.callers_from_grep and [(r["file"], r["line"]) for r in found.callers] == [("c.go", 1), ("z_test.go", 1)] and found.files == ["c.go", "z_test.go"]
    own = CodeGraph(g.symbols, g.edges, files=spark.createDataFrame([("empty.go",)], "path string"))
    assert verbs.has_file(own, "empty.go") and verbs.deps(own, "empty.go").count() == 0 and not verbs.has_file(g, "empty.go")


def test_find_and_grep(spark):
    symbols = [sym(1, "a.go", "LoadConfig"), sym(2, "b.go", "ParseConfig"), sym(3, "c.go", "GetUser"), sym(4, "d_test.go", "LoadConfig")]
    g = build(spark, symbols, [(1, 2, "LoadConfig", "", "", "", "calls", 1, "b.go")])
    got = text.find(verbs.symbols_with_callers(g), "config load").collect()
    assert [(r["name"], r["file"], r["match"]) for r in got[:2]] == [("LoadConfig", "a.go", "token-set"), ("LoadConfig", "d_test.go", "token-set")]
    assert text.find(verbs.symbols_with_callers(g), "fetch user").first()["match"] == "all-tokens"
    files = spark.createDataFrame([("a.go", "x\nfetchAll()\nfetchAll()\n"), ("t_test.go", "fetchAll\n"), ("z.go", "refetchAlls")], "file string, content string")
    spans = spark.createDataFrame([(1, "a.go", "fetchAll", 2, 3, 0)], "sym_id long, file string, name string, start_line int, end_line int, tier int")
    got = {r["file"]: r for r in text.grep_grouped(files, spans, "fetchAll", word=True).collect()}
    assert got["a.go"]["hits"] == 2 and got["a.go"]["is_def"] and got["t_test.go"]["is_test"] and "z.go" not in got


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = retrieval.quantized(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"))
    got = retrieval.top_k(df, df.filter("id = 7").select(F.col("vec").alias("q")), 10).collect()
    want = np.sort(v @ v[7])[::-1][:10]
    assert got[0]["id"] == 7 and all(abs(r["score"] - w) < 0.05 for r, w in zip(got, want, strict=True))


def test_cross_ladder(spark):
    members = spark.createDataFrame([("app", "", 0, ["app"], ["lib"]), ("lib", "", 1, ["acme/lib"], []), ("two", "", 2, ["acme/two"], [])], "id string, root string, ord int, namespaces array<string>, deps array<string>")
    defs = spark.createDataFrame([("lib", "l.go", "Only", "", 1), ("lib", "l.go", "Both", "", 2), ("two", "t.go", "Both", "", 3), ("two", "t.go", "Twice", "A", 4), ("two", "t.go", "Twice", "B", 5), ("lib", "l.go", "Mix", "", 6), ("two", "t.go", "Mix", "", 7), ("two", "u.go", "Mix", "", 8)], "member string, file string, name string, parent string, line int")
    ask = [(1, "Only", "", "acme/lib/sub"), (2, "Only", "", ""), (3, "Both", "", ""), (4, "Both", "", "acme/two"), (5, "Twice", "", ""), (6, "Twice", "B", ""), (7, "None", "", "acme/lib"), (8, "Mix", "", "")]
    edges = spark.createDataFrame([(k, "app", n, q, h) for k, n, q, h in ask], "edge_key long, consumer string, dst_name string, dst_qualifier string, dst_ns string")
    got = {r["edge_key"]: (r["outcome"], r["confidence"], r["to_member"]) for r in workspace.cross_ladder(edges, members, defs).collect()}
    assert got == {1: ("cross_repo_import", "exact", "lib"), 2: ("cross_repo_name", "inferred", "lib"), 3: ("ambiguous", "", ""), 4: ("cross_repo_import", "exact", "two"), 5: ("ambiguous", "", ""), 6: ("cross_repo_name", "inferred", "two"), 7: ("none", "", ""), 8: ("cross_repo_name", "inferred", "lib")}
    first = {r["edge_key"]: r["candidates"][0]["member"] for r in workspace.candidates(edges, members, defs).collect()}
    assert first[3] == "lib"


def test_overlay_updates(spark):
    edge = "k long, confidence string, src_member string, dst_member string"
    old = spark.createDataFrame([(1, "exact", "a", "b"), (2, "inferred", "b", "c"), (3, "inferred", "c", "d")], edge)
    new = spark.createDataFrame([(1, "inferred", "a", "x"), (2, "exact", "b", "y")], edge)
    got = {r["k"]: (r["confidence"], r["dst_member"]) for r in workspace.strong_wins(old, new, ["k"]).collect()}
    assert got == {1: ("exact", "b"), 2: ("exact", "y"), 3: ("inferred", "d")}
    assert sorted(r["k"] for r in workspace.replace_member(old, new.filter("k = 2"), "b").collect()) == [2, 3]
    try:
        workspace.replace_member(old, new, "z")
        raise AssertionError("took an edge that does not touch the member")
    except ValueError:
        pass


def test_differences_count_lines_and_store_none(spark, monkeypatch):
    g = small(spark)
    twice = CodeGraph(g.symbols.unionByName(g.symbols.filter("name = 'CallerOne'")).unionByName(g.symbols.filter("name = 'CallerOne'")), g.edges.limit(0))
    once = CodeGraph(g.symbols, g.edges.limit(0))
    stored = []
    monkeypatch.setattr(incremental, "cut", lambda df: stored.append(df.columns) or df)
    found = [(r["side"], r["line"].split("|")[3]) for r in incremental.differences(twice, once).collect()]
    assert found == [("a", "CallerOne")] * 2
    assert [r["side"] for r in incremental.differences(once, twice).collect()] == ["b", "b"]
    assert incremental.differences(once, once).count() == 0
    assert all("line" not in columns for columns in stored)

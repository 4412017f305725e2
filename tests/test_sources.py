import json
from dataclasses import asdict

from codeloom.operators import build, incremental, verbs
from codeloom.sources import extract, manifests, profiles
from codeloom.sources.tree import Filter, scan
from codeloom.streaming import spool

GO = """package a

import (
	"fmt"
	u "x/util"
)

type Base struct{}
type Widget struct {
	Base
	n int
}

// Grow calls nothing(here)
func (w *Widget) Grow() { w.scale(); fmt.Println("call()"); u.Go() }
func (w *Widget) scale() {}
func Helper() int { return helper2(func() int { return 1 }()) }
"""
PY = "import os\nfrom m.n import f, g as h\n\nclass A(B):\n    def run(self):\n        def inner():\n            self.go()\n        f(1)\n        Other.make()\n\nasync def top():\n    A().run()\n"
TS = """import d, { a as b } from './util';
import * as ns from 'x';
export abstract class Svc extends Base implements One, Two {
  private run(x: number): void { this.go(x); new Thing(); }
}
export enum Color { Red }
export const fn = (x) => { helper(x); };
function plain() { if (x) { call(); } }
"""
PHP = """<?php
namespace App\\Http;
use App\\Models\\User;
class C extends Base implements I {
    use Shares;
    public function go() { $this->run(); self::make(); User::find(1); new User(); helper(); }
}
function free() {}
"""


def names(p):
    return [(s["kind"], s["parent"], s["name"]) for s in p.symbols]


def calls(p):
    return {(p.symbols[c["enclosing"]]["name"] if c["enclosing"] >= 0 else "", c["qualifier"], c["callee"]) for c in p.calls}


def deps(p):
    return {(d["kind"], d["target"], d["source"]) for d in p.deps}


def test_go():
    p = extract.parse("go", GO)
    assert set(names(p)) == {("type", "", "Base"), ("type", "", "Widget"), ("method", "Widget", "Grow"), ("method", "Widget", "scale"), ("func", "", "Helper")}
    assert {("Grow", "Widget", "scale"), ("Grow", "", "Println"), ("Grow", "", "Go"), ("Helper", "", "helper2")} == calls(p)
    assert {("imports", "fmt", ""), ("imports", "x/util", ""), ("extends", "Base", "")} == deps(p)
    assert {c["callee"]: c["hint"] for c in p.calls}["Go"] == "x/util"


def test_python():
    p = extract.parse("python", PY)
    assert set(names(p)) == {("type", "", "A"), ("method", "A", "run"), ("func", "", "inner"), ("func", "", "top")}
    assert {("inner", "A", "go"), ("run", "", "f"), ("run", "Other", "make"), ("top", "", "run"), ("top", "", "A")} == calls(p)
    assert {("imports", "os", ""), ("imports", "f", "m.n"), ("imports", "g", "m.n"), ("extends", "B", "")} == deps(p)
    assert extract.parse("python", "def (").symbols == []


def test_tsjs():
    p = extract.parse("tsjs", TS)
    assert set(names(p)) == {("type", "", "Svc"), ("method", "Svc", "run"), ("type", "", "Color"), ("func", "", "fn"), ("func", "", "plain")}
    assert {("run", "Svc", "go"), ("run", "", "Thing"), ("fn", "", "helper"), ("plain", "", "call")} == calls(p)
    assert {("imports", "d", "./util"), ("imports", "a", "./util"), ("extends", "Base", ""), ("implements", "One", ""), ("implements", "Two", "")} == deps(p)


def test_php():
    p = extract.parse("php", PHP)
    assert p.namespace == "App\\Http"
    assert set(names(p)) == {("type", "", "C"), ("method", "C", "go"), ("func", "", "free")}
    assert {("go", "C", "run"), ("go", "C", "make"), ("go", "User", "find"), ("go", "", "User"), ("go", "", "helper")} == calls(p)
    assert {("imports", "User", "App\\Models\\User"), ("extends", "Base", ""), ("implements", "I", ""), ("implements", "Shares", "")} == deps(p)


def test_tree_and_refresh(spark, tmp_path):
    root = tmp_path / "repo"
    for path, text in {"a.go": "package a\nfunc Helper() {}\nfunc A() { Helper() }\n", "b.go": "package a\nfunc B() { Helper() }\n", "vendor/x.go": "package x\nfunc Hidden() {}\n", "run": "#!/usr/bin/env python\ndef main():\n    pass\n", "notes.txt": "none"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    assert sorted((r["path"], r["lang"]) for r in scan(spark, str(root)).collect()) == [("a.go", "go"), ("b.go", "go"), ("run", "python")]
    assert sorted(r["path"] for r in scan(spark, str(root), Filter(exclude=["b.go"], include=["vendor/x.go"])).collect()) == ["a.go", "run", "vendor/x.go"]
    g, files = build.build(spark, str(root))
    g = verbs.CodeGraph(spark.createDataFrame(g.symbols.collect(), g.symbols.schema), spark.createDataFrame(g.edges.collect(), g.edges.schema))
    files = spark.createDataFrame(files.collect(), files.schema)
    assert sorted(r["qname"] for r in verbs.callers(g, "Helper").collect()) == ["A", "B"]
    (root / "a.go").write_text("package a\nfunc Renamed() {}\nfunc A() { Renamed() }\n")
    (root / "c.go").write_text("package a\nfunc Helper() {}\n")
    patched, _, change = build.refresh(spark, str(root), g, files)
    assert {r["path"]: r["state"] for r in change.collect()}["c.go"] == "added"
    rebuilt, _ = build.build(spark, str(root))
    assert incremental.differences(patched, rebuilt).count() == 0


HEAD = {"cxprof": 1, "lang": "php", "unit": "samples", "hz": 99, "start": 1, "end": 2, "commit": "c1"}


def write_profile(path, stacks, head=HEAD):
    path.write_text("\n".join([json.dumps(head), *[json.dumps({"st": [[f, line] for f, line in st], "n": n}) for st, n in stacks], '{"st": [["broken']))


def test_profile_stream(spark, tmp_path):
    symbols = spark.createDataFrame([(1, "a.php", "Start", "", 0, 1, 9), (2, "b.php", "Handle", "", 0, 1, 9)], "sym_id long, file string, name string, parent string, tier int, start_line int, end_line int")
    (tmp_path / "spool").mkdir()
    write_profile(tmp_path / "spool/one.cxprof.jsonl", [([("/r/a.php", 2), ("/r/none.php", 1), ("/r/b.php", 3)], 7), ([("/r/a.php", 4)], 3)])
    write_profile(tmp_path / "spool/bad.cxprof.jsonl", [([("/r/a.php", 4)], 5)], HEAD | {"cxprof": 2})
    store = spool.Store(spark, str(tmp_path / "store"))
    go = lambda: spool.stream(spark, str(tmp_path / "spool"), symbols, store, str(tmp_path / "check"), root="/r").awaitTermination()
    go()
    last = lambda name, schema: store.at(max(int(p.name) for p in (tmp_path / "store").iterdir()), name, schema).collect()
    assert [tuple(r) for r in last("obs_edges", spool.OBS_EDGES)] == [("a.php||Start", "b.php||Handle", True, 7)]
    assert {tuple(r) for r in last("obs_heat", spool.OBS_HEAT)} == {("a.php||Start", 3, 10, 10), ("b.php||Handle", 7, 7, 0)}
    row = last("ledger", spool.LEDGER)[0]
    assert (row["frames_total"], row["frames_resolved"]) == (4, 3)
    go()
    assert len(last("ledger", spool.LEDGER)) == 1
    _, stacks, counts = profiles.split(profiles.read(spark, str(tmp_path / "spool/one.cxprof.jsonl")))
    assert tuple(counts.first())[1:] == (2, 1, 10)
    profiles.emit(stacks.select("st", "n"), str(tmp_path / "out"), lang="php", start=1, end=2)
    assert profiles.split(profiles.read(spark, str(tmp_path / "out/*.txt")))[2].first()["samples"] == 10


def test_workspace(tmp_path):
    files = {"package.json": '{"workspaces": ["packages/*"]}', "packages/a/package.json": '{"name": "@x/a"}', "packages/b/package.json": '{"name": "@x/b"}', "packages/empty/readme": "", "go.work": "go 1.22\nuse (\n\t./svc\n)\n", "svc/go.mod": "module x/svc\n"}
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = manifests.discover(tmp_path)
    assert [(m.id, m.namespaces) for m in found] == [("a", ["@x/a"]), ("b", ["@x/b"]), ("svc", ["x/svc"])]
    merged = manifests.merge([manifests.Member("mine", "packages/b"), manifests.Member("a", "elsewhere", ["own"])], found)
    assert [asdict(m)["id"] for m in merged] == ["mine", "a", "svc"] and merged[0].namespaces == ["@x/b"] and merged[1].namespaces == ["own"]

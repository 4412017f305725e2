import re

import pytest

from codeloom.functions import exprs, naming
from pyspark.sql import functions as F

IDENTIFIERS = {
    "parseConfig": "parse config", "load_config": "load config", "HTTPServerConfig": "http server config",
    "firstOrCreate": "first or create", "NewV4Signer": "new v 4 signer", "a": "a", "": "", "red ring": "red ring", "x86.Asm-code$y": "x 86 asm code y",
}


def test_tokenize(spark):
    for word, want in IDENTIFIERS.items():
        assert " ".join(naming.tokenize(word)) == want
    df = spark.createDataFrame([(w,) for w in IDENTIFIERS], "w string").select("w", F.array_join(exprs.tokens("w"), " ").alias("t"))
    assert {r["w"]: r["t"] for r in df.collect()} == IDENTIFIERS


def test_stem(spark):
    words = {"parsing": "pars", "parsers": "pars", "parser": "pars", "boxes": "box", "cats": "cat", "red": "red", "ring": "ring", "used": "used", "sing": "sing"}
    for w, s in words.items():
        assert naming.stem(w) == s
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", exprs.stem("w").alias("s"))
    assert {r["w"]: r["s"] for r in df.collect()} == words


def test_anchor_and_words():
    assert naming.split_anchor("A::b") == ("b", "A")
    assert naming.split_anchor("a.B.c") == ("c", "a.B")
    assert naming.split_anchor(".x") == (".x", "")
    assert naming.distinctive_words("Where is the retry backoff for failed uploads", 2) == ["backoff", "uploads"]
    assert naming.quoted_phrase('say "not found" now') == "not found"
    assert "fetch" in naming.expand("get") and naming.expand("nothing") == []


@pytest.mark.parametrize("glob, yes, no", [("*.go", "a.go", "b/a.go"), ("**/*.min.js", "x/y.min.js", "x/y.js"), ("**/*.min.js", "y.min.js", "y.min.jsx"), ("a/**", "a/b/c", "b/a"), ("f?o", "foo", "f/o"), ("x[1].ts", "x[1].ts", "x1.ts")])
def test_glob(glob, yes, no):
    assert re.match(naming.glob_to_regex(glob), yes) and not re.match(naming.glob_to_regex(glob), no)


def test_normalize_hint():
    assert naming.normalize_hint("tsjs", "src/a/b.ts", "../util", "x") == "src/util"
    assert naming.normalize_hint("php", "a.php", "App\\Models\\User", "User") == "App\\Models"
    assert naming.normalize_hint("python", "a.py", ".mod", "f") == ".mod"


@pytest.mark.parametrize("ns, hint, match, prefix", [
    ("app/util", "app/util", True, True), ("src/app/util", "app/util", True, False), ("util", "app/util", True, False), ("app.util", "util", True, False),
    ("App\\Models", "Models", True, False), ("src/util.ts", "src/util", True, False), ("src/util/index.js", "src/util", True, False), ("src/util.rs", "src/util", False, False),
    ("", "x", False, False), ("x", "", False, False), ("app", "app/util", False, True), ("app/", "app/util", False, True), ("app", "apple", False, False),
])
def test_namespaces(spark, ns, hint, match, prefix):
    row = spark.createDataFrame([(ns, hint)], "a string, b string").select(exprs.ns_match("a", "b"), exprs.ns_prefix("a", "b")).first()
    assert tuple(row) == (match, prefix)


def test_scalars(spark):
    rows = [("a/b.go", "", "a"), ("b.go", "", "."), ("a/b.py", "", "a.b"), ("a/__init__.py", "", "a.__init__"), ("a/b.ts", "", "a/b.ts"), ("x.pyi", "", "x.pyi"), ("a.php", "App", "App")]
    df = spark.createDataFrame(rows, "p string, d string, want string").select("want", exprs.derive_namespace("p", "d").alias("ns"))
    assert all(r["want"] == r["ns"] for r in df.collect())
    df = spark.createDataFrame([("a_test.go", 0.7), ("x/tests/y.py", 0.7), ("demo/x.go", 0.7), ("src/demos.go", 1.0), ("a/testing.go", 0.7)], "f string, want double").select("want", exprs.file_penalty("f").alias("p"))
    assert all(r["want"] == r["p"] for r in df.collect())
    q = spark.createDataFrame([([0.999, -0.999, 2.0, -2.0, 0.0],)], "v array<float>").select(exprs.quantize("v")).first()[0]
    assert q == [126, -126, 127, -127, 0]
    assert [r[0] for r in spark.createDataFrame([(60,), (7200,), (400_000,)], "s long").select(exprs.age("s")).collect()] == ["<1h", "2h", "4d"]

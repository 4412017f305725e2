"""Column expressions of the graph's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import naming

# What a module path may be written without, and directories that hold no implementation.
MODULE_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
SAMPLE_DIRS = ("sample", "samples", "example", "examples", "demo", "demos", "benchmark", "benchmarks", "fixture", "fixtures", "integration")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qname(parent: Column | str = "parent", name: Column | str = "name") -> Column:
    parent, name = column(parent), column(name)
    return F.when(parent != "", F.concat_ws(".", parent, name)).otherwise(name)


def dirname(path: Column | str, root: str = "") -> Column:
    path = column(path)
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(root))


def derive_namespace(path: Column | str, declared: Column | str) -> Column:
    """What is declared, else the directory for .go and .php, the dotted module for .py, the path for others."""
    path, declared = column(path), column(declared)
    module = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.when(F.coalesce(declared, F.lit("")) != "", declared).when(path.rlike(r"\.(go|php)$"), dirname(path, ".")).when(path.endswith(".py"), module).otherwise(path)


def ns_match(namespace: Column | str, hint: Column | str) -> Column:
    """Whether a namespace is what a hint means: equal, one ends the other after a separator, or it is the hint with a module ending."""
    a, b = column(namespace), column(hint)
    ends = F.lit(False)
    for mark in ("/", ".", "\\"):
        ends = ends | a.endswith(F.concat(F.lit(mark), b)) | b.endswith(F.concat(F.lit(mark), a))
    return (a != "") & (b != "") & ((a == b) | ends | a.isin(*[F.concat(b, F.lit(e)) for e in MODULE_ENDINGS]))


def ns_prefix(namespace: Column | str, hint: Column | str) -> Column:
    """Whether a member that owns a namespace claims a hint: equal, or a prefix up to a separator; trailing separators of the namespace do not count."""
    a, b = F.regexp_replace(column(namespace), r"[/\\.]+$", ""), column(hint)
    return (a != "") & ((a == b) | (b.startswith(a) & F.substring(b, F.length(a) + 1, F.lit(1)).isin("/", "\\", ".")))


def file_penalty(file: Column | str) -> Column:
    file = column(file)
    test = file.contains("_test.") | file.contains("/test") | file.contains("tests/") | file.contains(".spec.")
    return F.when(test | F.arrays_overlap(F.split(file, "/"), F.array(*map(F.lit, SAMPLE_DIRS))), 0.7).otherwise(1.0)


def graph_boost(callers: Column | str, tier: Column | str, kind: Column | str) -> Column:
    use = 1 + F.log10(1 + column(callers).cast("double"))
    return use * F.when(column(tier) != 0, 0.6).otherwise(1.0) * F.when(column(kind) == "method", 0.9).otherwise(1.0)


def tokens(identifier: Column | str) -> Column:
    """The lower-case words of an identifier."""
    parts = F.regexp_replace(column(identifier), naming.BREAKS.pattern, " ")
    return F.transform(F.filter(F.split(parts, naming.SEPARATORS), lambda t: t != ""), F.lower)


def stem(token: Column | str) -> Column:
    token = column(token)
    out = None
    for s in naming.SUFFIXES:
        fits = token.endswith(s) & (F.length(token) >= len(s) + 3)
        cut = F.substring(token, F.lit(1), F.length(token) - len(s))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(token)


def quantize(vector: Column | str) -> Column:
    """Int8 components: 127 times the value, towards zero, within -127 and 127."""
    return F.transform(column(vector), lambda x: F.greatest(F.least(x.cast("double") * 127, F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))


def l2_normalize(vector: Column | str) -> Column:
    """The vector at length 1, as floats; one of length 0 as it is."""
    v = column(vector)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length == 0, v.cast("array<float>")).otherwise(F.transform(v, lambda x: (x.cast("double") / length).cast("float")))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(column(a), column(b), lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of integer vectors, 0 if one is zero; the sums are exact."""
    return F.coalesce(F.try_divide(dot(a, b).cast("double"), F.sqrt(dot(a, a).cast("double") * dot(b, b).cast("double"))), F.lit(0.0))


def one_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(column(text), r"\s+", " "))


def is_subsequence(needle: str, hay: Column | str) -> Column:
    hay = column(hay)
    return hay.rlike("(?s).*?".join("\\Q" + c + "\\E" for c in needle)) if needle else F.lit(False)


def age(seconds: Column | str) -> Column:
    s = column(seconds)
    return F.when(s < 3600, F.lit("<1h")).when(s < 48 * 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once wherever body uses it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def concept_query(name: Column | str, doc: Column | str) -> Column:
    """What a doc says without the words of its symbol's name: the first ten of its other words, in lower case; null if fewer than three are left, or fewer than two of the ten are informative."""
    others = let(tokens(name), lambda own: F.filter(F.regexp_extract_all(column(doc), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: ~F.array_contains(own, F.lower(w)) & ~F.arrays_overlap(tokens(w), own)))

    def told(words: Column) -> Column:
        first = F.transform(F.slice(words, 1, 10), lambda w: F.lower(w))
        telling = F.filter(first, lambda w: (F.length(w) >= 3) & ~w.isin(*naming.CONCEPT_STOPWORDS))
        return F.when((F.size(words) >= 3) & (F.size(telling) >= 2), F.array_join(first, " "))

    return let(others, told)

"""Name resolution: a ladder of candidate sets, the first of which that is not empty decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import MODULE_ENDINGS
from ..storage import bounded

REQUEST = ("dst_name", "dst_qualifier", "src_ns", "dst_ns")


def tails(path: Column) -> Column:
    """What stands after each separator of a path, the path itself left out."""
    marks = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(path, i, F.lit(1)).isin("/", ".", "\\"))
    return F.filter(F.transform(marks, lambda i: F.substring(path, i + 1, F.length(path))), lambda t: t != "")


def counted(symbols: DataFrame, *key: str) -> DataFrame:
    """Per key of symbols: how many are the project's (n0) and dependencies' (n1), and the first of each in the order in which rungs choose."""
    by_file = lambda *head: F.struct(*head, "file", "start_line", "sym_id")
    own, dep = F.col("tier") == 0, F.col("tier") == 1
    return symbols.groupBy(*key).agg(
        F.count_if(own).alias("n0"),
        F.count_if(dep).alias("n1"),
        F.min(F.when(own, by_file())).alias("f0"),
        F.min(F.when(own, by_file("namespace"))).alias("s0"),
        F.min(F.when(dep, by_file("namespace"))).alias("s1"),
    )


def bound(asked: DataFrame, of_space: DataFrame) -> DataFrame:
    """Per (dst_name, dst_ns) of asked: what namespaces the hint means have of the name, in both tiers.

    ns_match() as equalities: the hint is listed as itself, with each module
    ending and by its tails, which are namespaces; and a namespace's tails,
    added up first, are hints. A namespace that is met both ways counts once.
    """
    hint = F.col("dst_ns")
    hints = asked.select("dst_name", "dst_ns").filter(hint != "").distinct()
    ends_so = lambda n: F.exists(F.array(*map(F.lit, ("/", ".", "\\"))), lambda m: n.endswith(F.concat(m, hint)))
    longer = F.filter(F.array(*[F.concat(hint, F.lit(e)) for e in MODULE_ENDINGS]), lambda n: ~ends_so(n))
    listed = hints.withColumn("namespace", F.explode(F.array_distinct(F.concat(F.array(hint), longer, tails(hint)))))
    there = listed.join(of_space, ["dst_name", "namespace"]).drop("namespace")
    shorter = of_space.withColumn("dst_ns", F.explode(tails(F.col("namespace")))).groupBy("dst_name", "dst_ns").agg(*summed())
    here = hints.join(shorter, ["dst_name", "dst_ns"])
    return there.select(*here.columns).unionByName(here).groupBy("dst_name", "dst_ns").agg(*summed())


def summed() -> list[Column]:
    return [F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *[F.min(c).alias(c) for c in ("f0", "s0", "s1")]]


def resolve(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per distinct request (dst_name, dst_qualifier, src_ns, dst_ns): dst_id (0 if unresolved), confidence, rung (0), candidates.

    Rungs: the qualifier's member in the project (1), in dependencies (2); a
    namespace that the hint means in the project (3), in dependencies (4); the
    source's own namespace (5); the name in the project (6), in dependencies
    (7). Requests never meet symbols: these are counted once by (name, parent),
    (name, namespace) and name, with the first of each, and every rung is an
    equality join with at most one such row. So a name that thousands of
    symbols and edges share costs its requests, not their product.
    """
    asked = requests.select(*REQUEST).distinct()
    named = symbols.withColumnRenamed("name", "dst_name")
    of_space = counted(named, "dst_name", "namespace")
    of_parent = counted(named.filter("parent <> ''"), "dst_name", "parent").withColumnRenamed("parent", "dst_qualifier")
    of_name = of_space.groupBy("dst_name").agg(*summed())
    hinted = bound(asked, of_space)
    near = of_space.filter("namespace <> ''").withColumnRenamed("namespace", "src_ns")
    rungs = (("q", 0, "f0"), ("q", 1, "s1"), ("h", 0, "s0"), ("h", 1, "s1"), ("o", 0, "f0"), ("a", 0, "f0"), ("a", 1, "s1"))
    wide = asked
    for side, df, key in (("q", of_parent, ["dst_name", "dst_qualifier"]), ("h", hinted, ["dst_name", "dst_ns"]), ("o", near, ["dst_name", "src_ns"]), ("a", of_name, ["dst_name"])):
        used = {c for s, t, f in rungs if s == side for c in (f"n{t}", f)}
        slim = df.select(*key, *[(F.col(c) if c[0] == "n" else F.col(f"{c}.sym_id")).alias(f"{side}_{c}") for c in sorted(used)])
        wide = wide.join(slim, key, "left")
    n, at, chosen = F.lit(0).cast("long"), F.lit(0), F.lit(0).cast("long")
    for number, (side, t, f) in reversed(list(enumerate(rungs, 1))):
        there = F.col(f"{side}_n{t}") > 0
        n = F.when(there, F.col(f"{side}_n{t}")).otherwise(n)
        at, chosen = F.when(there, number).otherwise(at), F.when(there, F.col(f"{side}_{f}")).otherwise(chosen)
    return wide.select(
        *REQUEST,
        chosen.alias("dst_id"),
        F.when(n == 0, "unresolved").when(n == 1, "unambiguous").otherwise("ambiguous").alias("confidence"),
        at.alias("rung"),
        n.alias("candidates"),
    )


def resolve_edges(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Raw edges with dst_id and confidence. raw has the request's columns."""
    return raw.drop("dst_id", "confidence").join(resolve(raw, symbols).drop("rung", "candidates"), list(REQUEST))


def file_namespaces(symbols: DataFrame) -> DataFrame:
    """A file's namespace as its project symbols give it."""
    return symbols.filter("tier = 0").groupBy(F.col("file").alias("src_file")).agg(F.min("namespace").alias("src_ns"))


def re_resolve(edges: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """edges with those whose dst_name is in names (name) resolved anew; the others untouched. Only symbols of these names are counted."""
    own = bounded(names.select(F.col("name").alias("dst_name")).distinct())
    hit = edges.join(own, "dst_name", "left_semi")
    rest = edges.join(own, "dst_name", "left_anti")
    return rest.unionByName(resolve_some(hit, symbols, own).select(*rest.columns))


def resolve_some(raw: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """resolve_edges() of edges whose names (dst_name) are few: other symbols are left out before anything is counted."""
    return resolve_edges(raw, symbols.withColumnRenamed("name", "dst_name").join(names, "dst_name", "left_semi").withColumnRenamed("dst_name", "name"))


def pick_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; for windows whose groups are bounded."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")

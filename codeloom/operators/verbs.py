"""Structural query verbs over a CodeGraph: every section is a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from ..functions.exprs import qname
from ..functions.naming import split_anchor
from ..storage import cut
from .depmaps import provenance


@dataclass
class CodeGraph:
    symbols: DataFrame
    edges: DataFrame
    depfiles: DataFrame | None = None
    lines: DataFrame | None = None
    files: DataFrame | None = None


def of_anchor(name: str, parent: str = "") -> Column:
    own = F.col("name") == name
    return own & (F.col("parent") == parent) if parent else own


def definitions(g: CodeGraph, name: str, parent: str = "", project_only: bool = False) -> DataFrame:
    found = g.symbols.filter(of_anchor(name, parent))
    if project_only:
        found = found.filter("tier = 0")
    return found.orderBy("file", "start_line", "name", "sym_id")


def callers(g: CodeGraph, name: str, parent: str = "") -> DataFrame:
    """Sources of edges of any kind that name the symbol; with a parent, only of those that resolve to it."""
    hits = g.edges.filter(F.col("dst_name") == name)
    if parent:
        target = g.symbols.filter(of_anchor(name, parent)).select(F.col("sym_id").alias("dst_id"))
        hits = hits.join(target, "dst_id", "left_semi")
    s = g.symbols.select("sym_id", "file", "parent", "name", "signature")
    return hits.join(s, F.col("src_id") == F.col("sym_id")).select("file", qname("parent", "name").alias("qname"), "signature", "line", "confidence")


def callees(g: CodeGraph, name: str, parent: str = "") -> DataFrame:
    src = g.symbols.filter(of_anchor(name, parent)).select(F.col("sym_id").alias("src_id"))
    d = g.symbols.select(F.col("sym_id").alias("dst_id"), F.col("parent").alias("def_parent"), F.col("file").alias("def_file"), F.col("start_line").alias("def_line"))
    hits = g.edges.filter("kind = 'calls'").join(src, "src_id", "left_semi").join(d, "dst_id", "left")
    return hits.select("dst_name", F.coalesce("def_parent", F.lit("")).alias("def_parent"), "line", "confidence", F.coalesce("def_file", F.lit("")).alias("def_file"), F.coalesce("def_line", F.lit(0)).alias("def_line"))


def dependents(g: CodeGraph, name: str) -> DataFrame:
    """Imports, extends and implements edges of the name, or of a path that ends with it: without regard to case, and with % and _ in the name as wildcards."""
    named = (F.col("dst_name") == name) | F.col("dst_name").ilike("%/" + name)
    hits = g.edges.filter(F.col("kind").isin("imports", "extends", "implements") & named)
    s = g.symbols.select(F.col("sym_id").alias("src_id"), "parent", "name")
    return hits.join(s, "src_id", "left").select("kind", F.col("src_file").alias("file"), F.coalesce(qname("parent", "name"), F.lit("")).alias("qname"), "line")


def dep_rows(g: CodeGraph, hits: DataFrame) -> DataFrame:
    d = g.symbols.select(F.col("sym_id").alias("dst_id"), F.col("file").alias("def_file"), F.col("start_line").alias("def_line"))
    return hits.join(d, "dst_id", "left").select("kind", F.col("dst_name").alias("target"), F.coalesce("def_file", F.lit("")).alias("def_file"), F.coalesce("def_line", F.lit(0)).alias("def_line"), "line")


def file_imports(g: CodeGraph, path: str) -> DataFrame:
    return dep_rows(g, g.edges.filter((F.col("src_file") == path) & (F.col("kind") == "imports")))


def symbol_deps(g: CodeGraph, name: str, parent: str = "") -> DataFrame:
    src = g.symbols.filter(of_anchor(name, parent)).select(F.col("sym_id").alias("src_id"))
    return dep_rows(g, g.edges.filter(F.col("kind").isin("extends", "implements")).join(src, "src_id", "left_semi"))


def has_file(g: CodeGraph, path: str) -> bool:
    """Whether a file is indexed: by the table of files if the graph has it, else by what was found in it."""
    if g.files is not None:
        return not g.files.filter(F.col("path") == path).isEmpty()
    return not g.symbols.filter((F.col("file") == path) & (F.col("tier") == 0)).isEmpty() or not g.edges.filter(F.col("src_file") == path).isEmpty()


def deps(g: CodeGraph, anchor: str) -> DataFrame:
    """A file's imports (none, if it has none); for a symbol, what it extends and implements, and the imports of its first definition's file."""
    if has_file(g, anchor):
        return file_imports(g, anchor).withColumn("section", F.lit("imports"))
    name, parent = split_anchor(anchor)
    first = definitions(g, name, parent).limit(1).select(F.col("file").alias("src_file"))
    own = symbol_deps(g, name, parent).withColumn("section", F.lit("symbol"))
    return own.unionByName(dep_rows(g, g.edges.filter("kind = 'imports'").join(first, "src_file", "left_semi")).withColumn("section", F.lit("imports")))


def referencing_files(g: CodeGraph, name: str) -> DataFrame:
    return g.edges.filter(F.col("dst_name") == name).select(F.col("src_file").alias("file")).distinct()


def impact(g: CodeGraph, name: str, parent: str = "") -> DataFrame:
    """Sizes of an impact answer's sections, in one job."""
    parts = {"definitions": definitions(g, name, parent), "callers": callers(g, name, parent), "callees": callees(g, name, parent), "dependents": dependents(g, name), "files": referencing_files(g, name)}
    out = None
    for section, df in parts.items():
        one = df.agg(F.count("*").alias("n")).withColumn("section", F.lit(section))
        out = one if out is None else out.unionByName(one)
    return out.select("section", "n")


def median_called(g: CodeGraph, least: int) -> DataFrame:
    """The upper median, by number of edges, of called names without a slash that have `least` or more; names break ties."""
    n = g.edges.filter("kind = 'calls' AND NOT contains(dst_name, '/')").groupBy("dst_name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    n = cut(n)
    # names by count: as many rows as there are different counts, not names
    by_count = n.groupBy("n").agg(F.count("*").alias("c"))
    running = by_count.withColumns({"upto": F.sum("c").over(Window.orderBy("n")), "all": F.sum("c").over(Window.partitionBy())})
    place = F.floor(F.col("all") / 2) + 1
    at = running.filter((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place)).select("n", (place - (F.col("upto") - F.col("c"))).cast("int").alias("k")).first()
    if at is None:
        return n.select(F.col("dst_name").alias("name"), "n").limit(0)
    tied = n.filter(F.col("n") == at["n"]).orderBy("dst_name")
    return tied.offset(at["k"] - 1).limit(1).select(F.col("dst_name").alias("name"), "n")


def neighbor_names(g: CodeGraph, top: int = 5) -> DataFrame:
    """(sym_id, side, names): of each called or calling symbol, the `top` names of its callers and of its callees, by number of calls, then name."""
    calls = g.edges.filter("kind = 'calls' AND dst_id <> 0 AND src_id <> 0")
    name = g.symbols.select(F.col("sym_id").alias("other"), "name")
    both = calls.select(F.col("dst_id").alias("sym_id"), F.col("src_id").alias("other"), F.lit("callers").alias("side")).unionByName(calls.select(F.col("src_id").alias("sym_id"), F.col("dst_id").alias("other"), F.lit("callees").alias("side")))
    # counted by id before names are joined: a hot symbol's calls are one row for each other end
    n = both.groupBy("sym_id", "side", "other").agg(F.count("*").alias("n")).join(name, "other").groupBy("sym_id", "side", "name").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("sym_id", "side").orderBy(F.desc("n"), "name")
    kept = n.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= top)
    return kept.groupBy("sym_id", "side").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("x")).select("sym_id", "side", F.col("x.name").alias("names"))


def caller_counts(g: CodeGraph) -> DataFrame:
    """The three counts of callers that differ: edges that name it, calls that name it, and edges of any kind that resolve to it, per project symbol."""
    named = g.edges.groupBy(F.col("dst_name").alias("name")).agg(F.count("*").alias("named"), F.count_if(F.col("kind") == "calls").alias("calls_named"))
    resolved = g.edges.filter("dst_id <> 0").groupBy(F.col("dst_id").alias("sym_id")).agg(F.count("*").alias("resolved"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g.symbols.filter("tier = 0").join(named, "name", "left").join(resolved, "sym_id", "left").select("sym_id", "name", zero("named"), zero("calls_named"), zero("resolved"))


def symbols_with_callers(g: CodeGraph) -> DataFrame:
    n = g.edges.filter("dst_id <> 0").groupBy(F.col("dst_id").alias("sym_id")).agg(F.count("*").alias("callers"))
    return g.symbols.join(n, "sym_id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))


def enclosing(g: CodeGraph, file: str, start: int, end: int) -> DataFrame:
    """Symbols of a file that overlap a range of lines, with the calls that name them and those from other files."""
    hit = g.symbols.filter((F.col("file") == file) & (F.col("start_line") <= end) & (F.col("end_line") >= start))
    calls = g.edges.filter("kind = 'calls'").groupBy(F.col("dst_name").alias("name")).agg(F.count("*").alias("callers"), F.count_if(F.col("src_file") != file).alias("external"))
    return hit.join(calls, "name", "left").select("name", "kind", "start_line", "end_line", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("external", F.lit(0)).alias("external"))


def innermost(points: DataFrame, spans: DataFrame, block: int = 256) -> DataFrame:
    """points (id, file, line) with the sym_id, name of the smallest span of their file around them (the first start, then the smallest id, on ties), or nulls.

    The range condition becomes an equality on blocks of lines: a span is
    listed in each block it touches if there are few, so that neither a file
    with many spans nor one with many points becomes one pair of lists.
    """
    pieces = spans.select("file", "sym_id", "name", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))).alias("block"))
    keyed = points.withColumn("block", F.floor(F.col("line") / block))
    inside = keyed.join(pieces, ["file", "block"]).filter("start_line <= line AND line <= end_line")
    best = inside.groupBy("id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", "sym_id", "name")).alias("x"))
    return points.join(best, "id", "left").select("id", "file", "line", F.col("x.sym_id").alias("sym_id"), F.col("x.name").alias("name"))


ORDER = ("src_file", "src_name", "src_parent", "dst_name", "kind", "line", "dst_qualifier", "dst_ns", "edge_id")


def unresolved_edges(g: CodeGraph) -> DataFrame:
    """Edges without a target that have a source symbol, in a total order."""
    src = g.symbols.select(F.col("sym_id").alias("src_id"), F.col("name").alias("src_name"), F.col("parent").alias("src_parent"))
    return g.edges.filter("dst_id = 0 AND src_id <> 0").join(src, "src_id").orderBy(*ORDER).select("src_file", "src_name", "src_parent", "dst_name", "dst_qualifier", "dst_ns", "kind", "line")


def tier_one_edges(g: CodeGraph) -> DataFrame:
    """Edges into dependencies, in the same order."""
    src = g.symbols.select(F.col("sym_id").alias("src_id"), F.col("name").alias("src_name"), F.col("parent").alias("src_parent"))
    dst = g.symbols.filter("tier = 1").select(F.col("sym_id").alias("dst_id"), F.col("namespace").alias("target_ns"))
    return g.edges.join(dst, "dst_id").join(src, "src_id").orderBy(*ORDER).select("src_file", "src_name", "dst_name", "kind", "line", "target_ns")


def limited(df: DataFrame, limit: int, *order: Column | str) -> tuple[list[Row], int]:
    """The first rows of an answer and its total, in one run of the plan."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order).limit(limit).collect()
    return rows, seen.get["n"]


@dataclass
class ImpactAnswer:
    """Sections of an impact answer: their first rows, and their totals."""

    definitions: list[Row]
    callers: list[Row]
    dependents: list[Row]
    callees: list[Row]
    callers_total: int
    dependents_total: int
    callees_total: int


def impact_answer(g: CodeGraph, name: str, parent: str = "", limit: int = 20) -> ImpactAnswer:
    own = limited(callers(g, name, parent), limit, "file", "line", "qname")
    used = limited(dependents(g, name), limit, "kind", "file", "line", "qname")
    down = callees(g, name, parent)
    if g.depfiles is not None:
        down = provenance(down, g.depfiles)
    calls = limited(down, limit, "line", "dst_name", "def_file", "def_line")
    return ImpactAnswer(definitions(g, name, parent).collect(), own[0], used[0], calls[0], own[1], used[1], calls[1])

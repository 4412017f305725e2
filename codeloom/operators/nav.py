"""One answer for every question of where something is: definitions, matches, callers and files of an anchor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.naming import quoted, split_anchor
from . import text, verbs
from .verbs import CodeGraph


@dataclass
class NavAnswer:
    """Sections in order. Without callers in the graph, the symbols around the text's hits stand in for them."""

    definitions: list[Row]
    matches: list[Row]
    callers: list[Row]
    callers_total: int
    callers_from_grep: bool
    files: list[str]
    files_total: int


def nav(g: CodeGraph, files: DataFrame, anchor: str, limit: int = 20) -> NavAnswer:
    """files: (file, content) of what is indexed. Each section is one query that orders and limits; what comes to the driver is bounded by the limit, but for the groups of hits, of which the different files are counted where they are."""
    name, parent = split_anchor(anchor)
    shape = ("name", "parent", "kind", "file", "start_line")
    defs = verbs.definitions(g, name, parent).select(*shape).collect()
    pool = verbs.symbols_with_callers(g)
    matches = text.find(pool, anchor, limit=limit).join(g.symbols.select("sym_id", "kind", "parent"), "sym_id").orderBy(F.desc("score"), "name", "file", "start_line", "sym_id").collect()
    defs = defs or [Row(**{c: name if c == "name" else r[c] for c in shape}) for r in matches if r["match"] == "exact"]
    callers, total = verbs.limited(verbs.callers(g, name, parent), limit, "file", "line", "qname")
    groups = text.grep_grouped(files, g.symbols, quoted(name), word=True).cache()
    try:
        ordered = [way(c) for way, c in text.GREP_ORDER]
        stand_in = not total and not groups.isEmpty()
        if stand_in:
            first, total = verbs.limited(groups, limit, *ordered)
            names = {r["sym_id"]: r["qname"] for r in g.symbols.filter(F.col("sym_id").isin([r["sym_id"] for r in first if r["sym_id"] is not None])).select("sym_id", verbs.qname("parent", "name").alias("qname")).collect()}
            callers = [Row(file=r["file"], qname=names.get(r["sym_id"], "<outside any symbol>"), signature="", line=r["first_line"], confidence="") for r in first]
        found = list(dict.fromkeys(r["file"] for r in matches))
        best = groups.groupBy("file").agg(F.min(F.struct(~F.col("is_def"), "is_test", -F.col("hits"), "file", "first_line")).alias("o")).filter(~F.col("file").isin(found))
        more, n = verbs.limited(best, limit, "o")
        return NavAnswer(defs, matches, callers, total, stand_in, (found + [r["file"] for r in more])[:limit], len(found) + n)
    finally:
        groups.unpersist()


def nav_rows(g: CodeGraph, files: DataFrame, anchor: str, limit: int = 20) -> DataFrame:
    """nav() as a table (section, place, file, line, label), with the totals as rows of their own."""
    a = nav(g, files, anchor, limit)
    rows = [("definition", i, r["file"], r["start_line"], r["name"]) for i, r in enumerate(a.definitions)]
    rows += [("match", i, r["file"], r["start_line"], r["match"]) for i, r in enumerate(a.matches)]
    rows += [("caller", i, r["file"], r["line"], r["qname"]) for i, r in enumerate(a.callers)]
    rows += [("file", i, f, 0, "") for i, f in enumerate(a.files)]
    rows += [("callers_total", a.callers_total, "", int(a.callers_from_grep), ""), ("files_total", a.files_total, "", 0, "")]
    return g.edges.sparkSession.createDataFrame([(s, int(i), f, int(n), t) for s, i, f, n, t in rows], "section string, place long, file string, line long, label string")

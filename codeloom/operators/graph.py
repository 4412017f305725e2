"""Graph operators: diffusion, components, bounded neighbourhoods, graph output."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dirname, qname
from ..storage import cut
from .verbs import CodeGraph, callees, callers


def undirected(pairs: DataFrame) -> DataFrame:
    """(a, b, w) in both directions, parallel edges summed, self-loops dropped."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))


def diffuse(pairs: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 12, every: int = 4) -> DataFrame:
    """Personalised PageRank: (id, mass) after `rounds` steps over weighted undirected pairs, restarting in proportion to seeds (id, score).

    Mass of nodes without edges goes back to the seeds. Seeds that sum to 0
    give no rows. Each step is one join and one sum; lineage is cut every few.
    """
    edges = undirected(pairs)
    out_weight = edges.groupBy("a").agg(F.sum("w").alias("total"))
    share = edges.join(out_weight, "a").select("a", "b", (F.col("w") / F.col("total")).alias("p"))
    share = cut(share)
    total = seeds.agg(F.sum("score").alias("all")).filter(F.col("all") > 0)
    restart = cut(seeds.crossJoin(F.broadcast(total)).select("id", (F.col("score") / F.col("all")).alias("r")))  # total is one row
    linked = share.select(F.col("a").alias("id")).distinct()
    mass = restart.select("id", F.col("r").alias("m"))
    for i in range(rounds):
        dangling = mass.join(linked, "id", "left_anti").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("lost"))
        moved = mass.join(share, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg((F.sum(F.col("m") * F.col("p")) * alpha).alias("m"))
        back = restart.crossJoin(F.broadcast(dangling)).select("id", (F.col("r") * (1 - alpha) + F.col("r") * F.col("lost") * alpha).alias("m"))  # dangling is one row
        mass = moved.unionByName(back).groupBy("id").agg(F.sum("m").alias("m"))
        if (i + 1) % every == 0 and i + 1 < rounds:
            mass = cut(mass)
    return mass.withColumnRenamed("m", "mass")


def connected_components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) with the smallest id of each component, by hanging neighbours on the smallest one seen, alternately from above and below."""
    now = cut(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        up = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(up.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
    if nodes is None:
        return found
    return nodes.select("id").distinct().join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


class Admission:
    """Which pairs a node and a degree limit let in, over all hops; seeds are in from the start."""

    def __init__(self, seeds: list[int], most_nodes: int, most_degree: int) -> None:
        self.nodes, self.degree, self.pairs = dict.fromkeys(seeds), {}, {}
        self.most_nodes, self.most_degree = most_nodes, most_degree
        self.saturated = 0  # nodes at the degree limit

    def done(self) -> bool:
        """Nothing more can come in: no node may join, and no two of those that are in have room."""
        return len(self.nodes) >= self.most_nodes and len(self.nodes) - self.saturated < 2

    def take(self, found: Iterator[tuple[int, int]]) -> list[int]:
        """Takes pairs in order, as far as any may still come in; returns the nodes that are new."""
        fresh = []
        for a, b in found:
            if self.done():
                break
            pair = min(a, b), max(a, b)
            if a == b or pair in self.pairs or max(self.degree.get(a, 0), self.degree.get(b, 0)) >= self.most_degree:
                continue
            new = [x for x in (a, b) if x not in self.nodes]
            if len(new) == 2 or len(self.nodes) + len(new) > self.most_nodes:
                continue
            self.pairs[pair] = None
            for x in (a, b):
                self.degree[x] = self.degree.get(x, 0) + 1
                self.saturated += self.degree[x] == self.most_degree
            self.nodes |= dict.fromkeys(new)
            fresh += new
        return fresh


def neighborhood(g: CodeGraph, seeds: list[int], most_nodes: int = 2000, most_degree: int = 64, part: int = 400) -> DataFrame:
    """(a, b, hop): undirected pairs within two hops of a few seeds, over calls, extends and implements edges.

    Which pairs the limits admit depends on the order of edges: nodes are asked
    for their edges in the order in which they came in, `part` at a time, each
    time in the order of edge ids, and degrees count over both hops. Edges
    stream through the driver a partition at a time, until nothing more can
    come in; it holds most_nodes * most_degree pairs at most.
    """
    spark = g.edges.sparkSession
    edges = g.edges.filter("kind <> 'imports' AND dst_id <> 0 AND src_id <> 0 AND src_id <> dst_id").select("edge_id", F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    state, frontier, out = Admission(list(dict.fromkeys(seeds)), most_nodes, most_degree), list(dict.fromkeys(seeds)), []
    for hop in (1, 2):
        if not frontier or len(state.nodes) >= most_nodes:
            break
        at = F.broadcast(spark.createDataFrame([(x, i // part) for i, x in enumerate(frontier)], "id long, part int"))  # most_nodes rows at most
        near = edges.join(at, F.col("a") == F.col("id")).unionByName(edges.join(at, F.col("b") == F.col("id"))).select("part", "edge_id", "a", "b").distinct()
        before = len(state.pairs)
        frontier = state.take((r["a"], r["b"]) for r in near.orderBy("part", "edge_id").toLocalIterator())
        out += [(*p, hop) for p in list(state.pairs)[before:]]
    return spark.createDataFrame(out, "a long, b long, hop int")


def reached(observed: DataFrame, start: DataFrame) -> DataFrame:
    """Those of observed edges (a, b, at, ...) that an ordered walk admits: in the order of `at`, an edge comes in if one of its ends is in, by start (id) or by an edge before it, and brings in the other.

    A node comes in at the least `at` of an edge whose other end came in
    before that edge's: shortest paths of a kind, by rounds of joins until
    nothing changes.
    """
    own = cut(observed.filter("a <> b"))
    both = own.select(F.col("a").alias("u"), F.col("b").alias("v"), "at").unionByName(own.select(F.col("b").alias("u"), F.col("a").alias("v"), "at"))
    kind = dict(own.dtypes)["at"]
    came = cut(start.select("id").distinct().withColumn("t", F.struct(F.lit(0).alias("later"), F.lit(None).cast(kind).alias("at"))))
    state = None
    while True:
        steps = both.join(came, F.col("u") == F.col("id")).filter((F.col("t.later") == 0) | (F.col("t.at") < F.col("at")))
        steps = steps.select(F.col("v").alias("id"), F.struct(F.lit(1).alias("later"), F.col("at")).alias("t"))
        came = cut(came.unionByName(steps).groupBy("id").agg(F.min("t").alias("t")))
        now = tuple(came.agg(F.count("*"), F.sum(F.xxhash64("id", "t").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if now == state:
            break
        state = now
    first = both.join(came, F.col("u") == F.col("id")).filter((F.col("t.later") == 0) | (F.col("t.at") < F.col("at"))).select("at").distinct()
    return own.join(first, "at", "left_semi")


def two_hops(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Undirected pairs (a, b) within two hops of the seeds (id), without limits: joins only."""
    both = pairs.filter("a <> b").unionByName(pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    first = both.join(seeds.select(F.col("id").alias("a")), "a", "left_semi")
    reach = first.select(F.col("b").alias("a")).unionByName(seeds.select(F.col("id").alias("a"))).distinct()
    second = both.join(reach, "a", "left_semi")
    return second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def neighborhood_graph(g: CodeGraph, name: str, parent: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a symbol, its callers and its callees. A node that several of these give is described by the first."""
    focus = qname(F.lit(parent), F.lit(name))
    me = g.symbols.limit(1).select(focus.alias("qname"), F.lit("focus").alias("role"), F.lit(0).alias("place"))
    up = callers(g, name, parent).select(F.col("qname"), F.lit("caller").alias("role"), F.lit(1).alias("place"), "confidence", "line")
    down = callees(g, name, parent).select(qname("def_parent", "dst_name").alias("qname"), F.lit("callee").alias("role"), F.lit(2).alias("place"), "confidence", "line")
    nodes = me.unionByName(up.select("qname", "role", "place")).unionByName(down.select("qname", "role", "place"))
    nodes = nodes.groupBy("qname").agg(F.min(F.struct("place", "role")).alias("x")).select(F.concat(F.lit("sym:"), "qname").alias("id"), F.col("x.role").alias("role"))
    ends = lambda s, t: (F.concat(F.lit("sym:"), s).alias("source"), F.concat(F.lit("sym:"), t).alias("target"))
    edges = up.select(*ends(F.col("qname"), focus), F.lit("calls").alias("kind"), "confidence").unionByName(down.select(*ends(focus, F.col("qname")), F.lit("calls").alias("kind"), "confidence"))
    return nodes, edges


def full_graph(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """Project symbols that resolved calls join, without self-loops; grouped by directory."""
    own = g.symbols.filter("tier = 0")
    ids = own.select("sym_id")
    calls = g.edges.filter("kind = 'calls' AND dst_id <> 0 AND src_id <> dst_id").join(ids.withColumnRenamed("sym_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("sym_id", "dst_id"), "dst_id", "left_semi")
    used = calls.select(F.explode(F.array("src_id", "dst_id")).alias("sym_id")).distinct()
    nodes = own.join(used, "sym_id", "left_semi").select(F.concat(F.lit("sym#"), "sym_id").alias("id"), qname().alias("label"), dirname("file", "(root)").alias("group"))
    edges = calls.select(F.concat(F.lit("sym#"), "src_id").alias("source"), F.concat(F.lit("sym#"), "dst_id").alias("target"), "kind", "confidence")
    return nodes, edges


def to_json(nodes: DataFrame, edges: DataFrame, focus: str = "") -> DataFrame:
    """One row with the graph document; for graphs that a view can show."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit("1").alias("schemaVersion"), F.lit(focus).alias("focus"), "nodes", "edges")).alias("json"))  # one row each

"""Concept search: lexical, vector and literal lanes, fused, diffused over the graph, pinned, clustered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.exprs import cosine, file_penalty, graph_boost, qname, quantize, tokens
from . import graph, retrieval, text, verbs
from .verbs import CodeGraph

SEEDS, LANE = 50, 50
NAME_PIN, PHRASE_PIN = 1000.0, 900.0


@dataclass
class Vectors:
    """Cards' vectors: symvec (sym_id, hash), vecs (hash, model, vec), and the embedder of queries."""

    symvec: DataFrame
    vecs: DataFrame
    model: str
    embed: object


def vector_lane(v: Vectors, query: str, k: int = LANE) -> DataFrame:
    spark = v.vecs.sparkSession
    q = spark.createDataFrame([([float(x) for x in v.embed([query])[0]],)], "e array<float>").select(quantize("e").alias("q"))
    own = v.symvec.join(v.vecs.filter(F.col("model") == v.model), "hash").select(F.col("sym_id").alias("id"), "vec")
    scored = own.crossJoin(F.broadcast(q)).select("id", F.round(cosine("vec", "q"), 6).alias("score"))  # q is one row
    return scored.orderBy(F.desc("score"), "id").limit(k)


def live_ids(symbols: DataFrame) -> DataFrame:
    """(key, id) of project symbols: the key that evidence is stored under, and the last symbol that has it."""
    return symbols.filter("tier = 0").groupBy(F.concat_ws("|", "file", "parent", "name").alias("key")).agg(F.max("sym_id").alias("id"))


def live_heat(heat: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, total, entry) of stored heat whose key a live symbol has."""
    return heat.join(live_ids(symbols), "key").select("id", "total", "entry")


def live_edges(observed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(a, b, weight, at) of stored run-time edges between live symbols; `at` is their order, that of their keys."""
    ids = live_ids(symbols)
    both = observed.join(ids.select(F.col("key").alias("src_key"), F.col("id").alias("a")), "src_key").join(ids.select(F.col("key").alias("dst_key"), F.col("id").alias("b")), "dst_key")
    return both.select("a", "b", "weight", F.struct("src_key", "dst_key", "indirect").alias("at"))


def search(g: CodeGraph, query: str, *, hints: list[str] | None = None, vectors: Vectors | None = None, files: DataFrame | None = None, heat: DataFrame | None = None, observed: DataFrame | None = None, error_text: str = "", roles: bool = False, limit: int = 20) -> tuple[DataFrame, DataFrame, str]:
    """(results, clusters, note) for a query in words.

    results: id, qname, file, start_line, score, lanes. Without vectors the
    note says that only words were matched. files (file, content) turn on the
    literal lane if there is an error text. heat (key, leaf, total, entry)
    raises what runs; observed (src_key, dst_key, indirect, weight) adds
    run-time edges to the diffusion; keys without a live symbol match nothing.
    roles turns on the boost of what user-side files use.
    """
    pool = verbs.symbols_with_callers(g).cache()
    try:
        lexical = text.find(pool, query, limit=LANE)
        lex = retrieval.ranks(lexical.select(F.col("sym_id").alias("id"), "score", "name", "file"), F.desc("score"), F.col("name"), F.col("file"), F.col("id"))
        if hints:
            extra = text.find(pool, " ".join(hints), limit=LANE).select(F.col("sym_id").alias("id"), "score", "name", "file")
            lex = lex.unionByName(retrieval.ranks(extra, F.desc("score"), F.col("name"), F.col("file"), F.col("id"))).groupBy("id").agg(F.min("rank").alias("rank"))
        asked = " ".join([query, *(hints or [])])
        near = retrieval.ranks(vector_lane(vectors, asked), F.desc("score"), F.col("id")) if vectors else lex.limit(0)
        literal = None
        if files is not None and error_text:
            literal = text.literal_lane(files, g.symbols, error_text, n_symbols=g.symbols.count()).select(F.col("sym_id").alias("id"), "rank", (F.col("conf") * 1.5).alias("conf"))
        fused = retrieval.fuse(lex, near, literal)
        warm = live_heat(heat, g.symbols) if heat is not None else pool.limit(0).select(F.col("sym_id").alias("id"), F.lit(0).alias("total"), F.lit(0).alias("entry"))
        facts = pool.select(F.col("sym_id").alias("id"), qname().alias("qname"), "name", "file", "start_line", "tier", "kind", "callers").join(warm, "id", "left").fillna(0, ["total", "entry"])
        boost = F.pow(graph_boost("callers", "tier", "kind") * (1 + F.log10(1 + F.col("total").cast("double"))), F.lit(retrieval.GAMMA))
        fused = fused.join(facts, "id").select("id", (F.col("fused") * boost * file_penalty("file")).alias("fused"), "lanes")
        fused = graph.cut(fused)  # a few lanes of 50 rows
        seeds = fused.orderBy(F.desc("fused"), "id").limit(SEEDS)
        pairs = graph.neighborhood(g, [r["id"] for r in seeds.select("id").collect()]).select("a", "b", F.lit(1.0).alias("w"))
        if observed is not None:
            touched = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(seeds.select("id")).distinct()
            seen = graph.reached(live_edges(observed, g.symbols), touched)
            pairs = pairs.unionByName(seen.select("a", "b", (1 + F.log10(1 + F.col("weight").cast("double"))).alias("w")))
        pairs = graph.cut(pairs)
        mass = graph.diffuse(pairs, seeds.select("id", F.col("fused").alias("score")))
        blended = retrieval.blend(fused, mass)
        if roles:
            blended = retrieval.role_boost(blended, retrieval.role_votes(pairs.select("a", "b"), g.symbols))
        low = query.lower()
        pins = facts.filter((F.lower("name") == low) | (F.lower("qname") == low)).select("id", F.lit(NAME_PIN).alias("boost"))
        phrase = naming.quoted_phrase(query)
        if files is not None and len(phrase) >= 8:
            hits = text.grep(files, naming.quoted(phrase)).withColumn("id", F.concat_ws(":", "file", "line"))
            inside = verbs.innermost(hits.select("id", "file", "line"), g.symbols.filter("tier = 0")).filter("sym_id is not null").select(F.col("sym_id").alias("id")).distinct()
            if inside.limit(4).count() <= 3:
                pins = pins.unionByName(inside.select("id", F.lit(PHRASE_PIN).alias("boost")))
        scored = retrieval.pin(blended, pins).withColumn("score", F.round("score", 6)).join(facts, "id")
        top = graph.cut(scored.orderBy(F.desc("score"), "name", "file", "start_line", "id").limit(limit))
        groups = graph.connected_components(pairs.select("a", "b"), top.select("id"))
        rows = top.join(mass, "id", "left").select("id", "score", "file", F.col("entry").alias("heat"), F.coalesce("mass", F.lit(0.0)).alias("mass"), "callers")
        labels = retrieval.cluster_labels(top.join(groups, "id").select("component", F.struct(-F.col("score"), "name", "file", "start_line", "id").alias("place"), "file", tokens("name").alias("tokens")))
        clusters = retrieval.cluster_entries(rows, groups).join(labels, "component", "left").orderBy(F.desc("best"), "entry_file")
        return top.select("id", "qname", "file", "start_line", "score", "lanes").orderBy(F.desc("score"), "file", "start_line"), clusters, "" if vectors else "lexical-only: no vectors"
    finally:
        pool.unpersist()

"""The graph of a source tree: symbols and resolved edges from parsed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import derive_namespace
from ..functions.naming import normalize_hint
from ..sources.extract import extract
from ..sources.tree import Filter, scan
from ..storage import current, publish
from .incremental import export, merkle_diff, open_files, open_snapshot, patch
from .resolve import file_namespaces, resolve_edges
from .verbs import CodeGraph


def symbols_of(parsed: DataFrame, tier: int = 0) -> DataFrame:
    """Symbols with ids that depend on what they are and where they begin, not on when they were read."""
    s = parsed.select("path", F.when(F.lit(tier == 0), derive_namespace("path", "namespace")).otherwise(F.col("namespace")).alias("ns"), F.posexplode("symbols").alias("idx", "s"))
    key = F.xxhash64("path", "s.parent", "s.name", "s.kind", "s.start_line", "idx", F.lit(tier)).bitwiseAND(F.lit((1 << 62) - 1)) + 1
    return s.select(key.alias("sym_id"), F.col("path").alias("file"), "s.name", "s.parent", F.col("ns").alias("namespace"), F.lit(tier).alias("tier"), "s.kind", "s.signature", "s.start_line", "s.end_line", "idx")


def raw_edges_of(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Raw edges: calls inside symbols, with the hint of their alias or else of the file's last import of the name; and dependencies, whose source may be the file (0)."""
    hint = F.udf(normalize_hint, "string")  # a handful of imports a file
    deps = parsed.select("path", "lang", F.posexplode("deps").alias("at", "d"))
    bound = deps.filter("d.kind = 'imports' AND d.source <> ''").select("path", F.col("d.target").alias("name"), "at", hint("lang", "path", "d.source", "d.target").alias("bound"))
    bound = bound.groupBy("path", "name").agg(F.max_by("bound", "at").alias("bound"))
    ids = symbols.select(F.col("file").alias("path"), F.col("idx").alias("enclosing"), F.col("sym_id").alias("src_id"))
    calls = parsed.select("path", F.explode("calls").alias("c")).select("path", F.col("c.enclosing").alias("enclosing"), F.col("c.callee").alias("name"), "c.qualifier", "c.hint", "c.line").join(ids, ["path", "enclosing"])
    calls = calls.join(bound, ["path", "name"], "left")
    own = F.when(F.col("hint") != "", F.col("hint")).otherwise(F.coalesce("bound", F.lit("")))
    calls = calls.select("src_id", F.col("name").alias("dst_name"), F.col("qualifier").alias("dst_qualifier"), own.alias("dst_ns"), F.lit("calls").alias("kind"), "line", F.col("path").alias("src_file"))
    used = deps.select("path", "lang", F.col("d.enclosing").alias("enclosing"), "d.kind", "d.target", "d.source", "d.line").join(ids, ["path", "enclosing"], "left").join(bound.withColumnRenamed("name", "target"), ["path", "target"], "left")
    used = used.select(F.coalesce("src_id", F.lit(0)).alias("src_id"), F.col("target").alias("dst_name"), F.lit("").alias("dst_qualifier"), F.coalesce("bound", F.lit("")).alias("dst_ns"), "kind", "line", F.col("path").alias("src_file"))
    raw = calls.unionByName(used).withColumn("edge_id", F.xxhash64("src_file", "line", "kind", "dst_name", "src_id").bitwiseAND(F.lit((1 << 62) - 1)))
    spaces = file_namespaces(symbols)
    return raw.join(spaces, "src_file", "left").withColumn("src_ns", F.coalesce("src_ns", F.lit(""))).select("edge_id", "src_id", "dst_name", "dst_qualifier", "dst_ns", "src_ns", "kind", "line", "src_file")


def build(spark: SparkSession, root: str, filter_: Filter | None = None) -> tuple[CodeGraph, DataFrame]:
    """A tree's graph, and its files (path, hash, size, mtime, lang)."""
    files = scan(spark, root, filter_)
    parsed = extract(files)
    symbols = symbols_of(parsed)
    edges = resolve_edges(raw_edges_of(parsed, symbols), symbols)
    return CodeGraph(symbols.drop("idx"), edges), files.drop("content")


def refresh(spark: SparkSession, root: str, g: CodeGraph, stored: DataFrame, filter_: Filter | None = None) -> tuple[CodeGraph, DataFrame, DataFrame]:
    """The graph after what changed on disk since `stored`: only changed and new files are parsed, only affected names resolved. Also the files now, and what changed."""
    files = scan(spark, root, filter_)
    change = merkle_diff(files, stored)
    touched = change.filter("state IN ('changed', 'added', 'deleted')").select("path")
    parsed = extract(files.join(touched, "path", "left_semi"))
    symbols = symbols_of(parsed)
    return patch(g, symbols.drop("idx"), raw_edges_of(parsed, symbols), touched), files.drop("content"), change


def publish_index(g: CodeGraph, files: DataFrame, index: str) -> str:
    """Writes a graph and its files as the current version of an index; gives its folder."""
    return publish(g.symbols.sparkSession, index, lambda folder: export(g, folder, files))


def open_index(spark: SparkSession, index: str) -> tuple[CodeGraph, DataFrame]:
    """The current version of an index: its graph and files."""
    folder = current(spark, index)
    return open_snapshot(spark, folder), open_files(spark, folder)


def import_snapshot(spark: SparkSession, artifact: str, root: str, index: str, filter_: Filter | None = None) -> DataFrame:
    """Takes an exported snapshot as a tree's index, patched to the tree as it is; gives what the snapshot did not cover (path, state). One of another schema version is an error, and the index stays as it was."""
    g, files, change = refresh(spark, root, open_snapshot(spark, artifact), open_files(spark, artifact), filter_)
    publish_index(g, files, index)
    return change.filter("state IN ('changed', 'added', 'deleted')")


def dependency_map(spark: SparkSession, root: str, namespace: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(symbols at tier 1, depfiles) of a dependency's directory."""
    files = scan(spark, root, Filter(skipped_dirs=(".git",)))
    symbols = symbols_of(extract(files).withColumn("namespace", F.lit(namespace)), tier=1).drop("idx")
    meta = files.select("path", F.lit(namespace).alias("namespace"), F.lit(version).alias("version"), F.col("hash").alias("maphash"), F.col("hash").alias("curhash"), "size", "mtime", F.lit(False).alias("modified"))
    return symbols, meta

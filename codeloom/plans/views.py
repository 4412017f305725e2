"""The code graph as the driver's tables stand in for it, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import resolve_edges
from ..operators.verbs import CodeGraph

DEP, ORDER, NATION, REGION, SUPPLIER = (k * 10_000_000_000 for k in range(1, 6))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    kind = F.when(F.col("p_size") <= 15, "func").when(F.col("p_size") <= 35, "method").otherwise("type")

    def row(df: DataFrame, sym_id, file, name, parent, namespace, tier, kind, start, size) -> DataFrame:
        col = lambda c: F.lit(c) if isinstance(c, str) else c
        return df.select(sym_id.cast("long").alias("sym_id"), col(file).alias("file"), name.alias("name"), col(parent).alias("parent"), col(namespace).alias("namespace"), F.lit(tier).alias("tier"), col(kind).alias("kind"), F.concat(F.lit("func "), name, F.lit("()")).alias("signature"), start.cast("int").alias("start_line"), (start + size).cast("int").alias("end_line"))

    name, brand = F.col("p_name"), F.col("p_brand")
    own = part.filter(~name.startswith("cold ") & ~name.startswith("new "))
    dep = part.filter((F.col("p_partkey") % 3 == 0) & ~name.startswith("cold "))
    none = F.lit(0)
    parts = [
        row(own, F.col("p_partkey") + 1, F.concat(F.lit("brand/"), brand), name, F.col("p_type"), brand, 0, kind, F.col("p_partkey"), F.col("p_size")),
        row(dep, F.col("p_partkey") + 1 + DEP, F.concat(F.lit("dep/"), brand), name, F.col("p_type"), F.concat(F.lit("dep/"), brand), 1, kind, F.col("p_partkey"), F.col("p_size")),
        row(table(spark, d, "orders"), F.col("o_orderkey") + 1 + ORDER, F.concat(F.lit("orders/"), F.col("o_orderpriority")), F.concat(F.lit("order_"), F.col("o_orderkey")), "", "orders", 0, "func", F.col("o_orderkey"), none),
        row(table(spark, d, "nation"), F.col("n_nationkey") + 1 + NATION, "geo/nations", F.col("n_name"), "", "geo", 0, "type", F.col("n_nationkey"), none),
        row(table(spark, d, "region"), F.col("r_regionkey") + 1 + REGION, "geo/regions", F.col("r_name"), "", "geo", 0, "type", F.col("r_regionkey"), none),
        row(table(spark, d, "supplier"), F.col("s_suppkey") + 1 + SUPPLIER, "supply/suppliers", F.col("s_name"), "", "supply", 0, "type", F.col("s_suppkey"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    part, orders = table(spark, d, "part"), table(spark, d, "orders")
    nation, region, supplier = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    line = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    empty = F.lit("")

    def row(df: DataFrame, edge_id, src_id, dst_name, qualifier, hint, ns, kind, line, file) -> DataFrame:
        return df.select(edge_id.cast("long").alias("edge_id"), src_id.cast("long").alias("src_id"), dst_name.alias("dst_name"), qualifier.alias("dst_qualifier"), hint.alias("dst_ns"), ns.alias("src_ns"), F.lit(kind).alias("kind"), line.cast("int").alias("line"), file.alias("src_file"))

    qualifier = F.when(F.col("l_returnflag") == "A", F.col("p_type")).when(F.col("l_returnflag") == "R", F.concat(F.col("p_type"), F.lit("_"))).otherwise("")
    calls = row(line, F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_orderkey") + 1 + ORDER, F.col("p_name"), qualifier, F.when(F.col("l_linestatus") == "O", F.col("p_brand")).otherwise(""), F.when(F.col("l_quantity") < 10, F.col("p_brand")).otherwise(""), "calls", F.col("l_linenumber"), F.concat(F.lit("orders/"), F.col("o_orderpriority")))
    seg = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority", "c_mktsegment").agg(F.min("o_orderkey").alias("k"))
    imports = row(seg, F.col("k") + 2 * ORDER, F.lit(0), F.concat(F.lit("seg/"), F.col("c_mktsegment")), empty, empty, empty, "imports", F.col("k"), F.concat(F.lit("orders/"), F.col("o_orderpriority")))
    extends = row(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_suppkey") + 2 * SUPPLIER, F.col("s_suppkey") + 1 + SUPPLIER, F.col("n_name"), empty, F.lit("geo"), F.lit("supply"), "extends", F.col("s_suppkey"), F.lit("supply/suppliers"))
    implements = row(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_nationkey") + 2 * NATION, F.col("n_nationkey") + 1 + NATION, F.col("r_name"), empty, empty, F.lit("geo"), "implements", F.col("n_nationkey"), F.lit("geo/nations"))
    return calls.unionByName(imports).unionByName(extends).unionByName(implements)


def graph(spark: SparkSession, d: str) -> CodeGraph:
    own = symbols(spark, d)
    return CodeGraph(own, resolve_edges(raw_edges(spark, d), own))


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("file"), F.col("text").alias("content"), "doc_id")


def doc_spans(spark: SparkSession, d: str, block: int = 5) -> DataFrame:
    """Symbols of documents: the whole document, and blocks of lines in it."""
    docs = doc_files(spark, d).withColumn("n", F.size(F.split("content", "\n")))
    whole = docs.select("file", (F.col("doc_id") * 100_000).alias("sym_id"), F.concat(F.lit("doc_"), "doc_id").alias("name"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"))
    blocks = docs.select("file", "doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))).alias("b"))
    blocks = blocks.select("file", (F.col("doc_id") * 100_000 + 1 + F.col("b")).alias("sym_id"), F.concat(F.lit("block_"), "b").alias("name"), (F.col("b") * block + 1).cast("int").alias("start_line"), F.least(F.col("n"), (F.col("b") + 1) * block).cast("int").alias("end_line"))
    return whole.unionByName(blocks).withColumn("tier", F.lit(0))


SYM_SQL = f"""
sym AS (
  SELECT p_partkey + 1 AS sym_id, 'brand/' || p_brand AS file, p_name AS name, p_type AS parent, p_brand AS namespace, 0 AS tier,
    CASE WHEN p_size <= 15 THEN 'func' WHEN p_size <= 35 THEN 'method' ELSE 'type' END AS kind, 'func ' || p_name || '()' AS signature,
    CAST(p_partkey AS INTEGER) AS start_line, CAST(p_partkey + p_size AS INTEGER) AS end_line
  FROM part WHERE p_name NOT LIKE 'cold %' AND p_name NOT LIKE 'new %'
  UNION ALL SELECT p_partkey + 1 + {DEP}, 'dep/' || p_brand, p_name, p_type, 'dep/' || p_brand, 1,
    CASE WHEN p_size <= 15 THEN 'func' WHEN p_size <= 35 THEN 'method' ELSE 'type' END, 'func ' || p_name || '()', CAST(p_partkey AS INTEGER), CAST(p_partkey + p_size AS INTEGER)
  FROM part WHERE p_partkey % 3 = 0 AND p_name NOT LIKE 'cold %'
  UNION ALL SELECT o_orderkey + 1 + {ORDER}, 'orders/' || o_orderpriority, 'order_' || o_orderkey, '', 'orders', 0, 'func', 'func order_' || o_orderkey || '()', CAST(o_orderkey AS INTEGER), CAST(o_orderkey AS INTEGER) FROM orders
  UNION ALL SELECT n_nationkey + 1 + {NATION}, 'geo/nations', n_name, '', 'geo', 0, 'type', 'func ' || n_name || '()', n_nationkey, n_nationkey FROM nation
  UNION ALL SELECT r_regionkey + 1 + {REGION}, 'geo/regions', r_name, '', 'geo', 0, 'type', 'func ' || r_name || '()', r_regionkey, r_regionkey FROM region
  UNION ALL SELECT s_suppkey + 1 + {SUPPLIER}, 'supply/suppliers', s_name, '', 'supply', 0, 'type', 'func ' || s_name || '()', CAST(s_suppkey AS INTEGER), CAST(s_suppkey AS INTEGER) FROM supplier
)"""
RAW_SQL = f"""
raw AS (
  SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_orderkey + 1 + {ORDER} AS src_id, p_name AS dst_name,
    CASE l_returnflag WHEN 'A' THEN p_type WHEN 'R' THEN p_type || '_' ELSE '' END AS dst_qualifier, CASE WHEN l_linestatus = 'O' THEN p_brand ELSE '' END AS dst_ns,
    CASE WHEN l_quantity < 10 THEN p_brand ELSE '' END AS src_ns, 'calls' AS kind, CAST(l_linenumber AS INTEGER) AS line, 'orders/' || o_orderpriority AS src_file
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT min(o_orderkey) + 2 * {ORDER}, 0, 'seg/' || c_mktsegment, '', '', '', 'imports', CAST(min(o_orderkey) AS INTEGER), 'orders/' || o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority, c_mktsegment
  UNION ALL SELECT s_suppkey + 2 * {SUPPLIER}, s_suppkey + 1 + {SUPPLIER}, n_name, '', 'geo', 'supply', 'extends', CAST(s_suppkey AS INTEGER), 'supply/suppliers' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_nationkey + 2 * {NATION}, n_nationkey + 1 + {NATION}, r_name, '', '', 'geo', 'implements', n_nationkey, 'geo/nations' FROM nation JOIN region ON n_regionkey = r_regionkey
)"""


def ns_match_sql(a: str, b: str) -> str:
    ends = " OR ".join(f"ends_with({x}, '{m}' || {y})" for m in ("/", ".", "\\") for x, y in ((a, b), (b, a)))
    listed = ", ".join(f"{b} || '{e}'" for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"))
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR {ends} OR {a} IN ({listed})))"


def resolve_sql(raw: str = "raw", sym: str = "sym") -> str:
    m = ns_match_sql("s.namespace", "q.dst_ns")
    return f"""
req AS (SELECT DISTINCT dst_name, dst_qualifier, src_ns, dst_ns FROM {raw}),
cand AS (
  SELECT q.*, s.sym_id, s.file, s.start_line, s.namespace, CASE
    WHEN q.dst_qualifier <> '' AND s.parent = q.dst_qualifier AND tier = 0 THEN 1 WHEN q.dst_qualifier <> '' AND s.parent = q.dst_qualifier AND tier = 1 THEN 2
    WHEN {m} AND tier = 0 THEN 3 WHEN {m} AND tier = 1 THEN 4
    WHEN q.src_ns <> '' AND s.namespace = q.src_ns AND tier = 0 THEN 5 WHEN tier = 0 THEN 6 ELSE 7 END AS rung
  FROM req q JOIN {sym} s ON s.name = q.dst_name
),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY dst_name, dst_qualifier, src_ns, dst_ns, rung) AS n,
    row_number() OVER (PARTITION BY dst_name, dst_qualifier, src_ns, dst_ns ORDER BY rung, CASE WHEN rung IN (1, 5, 6) THEN '' ELSE namespace END, file, start_line, sym_id) AS r
  FROM cand
),
res AS (
  SELECT req.*, coalesce(sym_id, 0) AS dst_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'unambiguous' ELSE 'ambiguous' END AS confidence, coalesce(rung, 0) AS rung, coalesce(n, 0) AS candidates
  FROM req LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (dst_name, dst_qualifier, src_ns, dst_ns)
)"""


EDGE_SQL = "edge AS (SELECT raw.*, res.dst_id, res.confidence FROM raw JOIN res USING (dst_name, dst_qualifier, src_ns, dst_ns))"
GRAPH_SQL = f"WITH {SYM_SQL}, {RAW_SQL}, {resolve_sql()}, {EDGE_SQL}"
QNAME = "CASE WHEN {p} <> '' THEN {p} || '.' || {n} ELSE {n} END"
DOC_SQL = """
files AS (SELECT source || '/' || doc_id AS file, text AS content, doc_id, len(string_split(text, chr(10))) AS n FROM documents),
lines AS (SELECT file, doc_id, unnest(string_split(content, chr(10))) AS text, unnest(generate_series(1, n)) AS line FROM files),
spans AS (
  SELECT file, doc_id * 100000 AS sym_id, 'doc_' || doc_id AS name, 1 AS start_line, n AS end_line FROM files
  UNION ALL SELECT file, doc_id * 100000 + 1 + b, 'block_' || b, b * 5 + 1, least(n, (b + 1) * 5) FROM (SELECT *, unnest(generate_series(0, (n - 1) // 5)) AS b FROM files)
)"""

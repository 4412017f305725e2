from codeloom.operators import depmaps
from codeloom.plans import catalog
from pyspark.sql import functions as F


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_workspace_takes_every_part_and_supplier(spark, tmp_path):
    put(spark, tmp_path, "nation", [(i, f"NATION_{i}", i % 5) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int")
    put(spark, tmp_path, "supplier", [(1, 3), (2, 4)], "s_suppkey long, s_nationkey int")
    put(spark, tmp_path, "part", [(5, "red plate", "ECONOMY", 1), (7, "blue cup", "SMALL", 1)], "p_partkey long, p_name string, p_type string, p_size int")
    # no key divides by four, and one supplier comes on a second line only
    put(spark, tmp_path, "lineitem", [(5, 1, 1), (5, 2, 2), (7, 2, 3)], "l_partkey long, l_suppkey long, l_linenumber int")
    found = catalog.queries()["cross_ladder"](spark, str(tmp_path)).collect()
    assert {r["edge_key"]: (r["outcome"], r["to_member"], r["candidate_count"]) for r in found} == {5: ("ambiguous", "", 2), 7: ("cross_repo_name", "NATION_4", 1)}
    found = catalog.queries()["ambiguity_candidates"](spark, str(tmp_path)).collect()
    assert {r["edge_key"]: r["candidates"] for r in found} == {5: "NATION_3:f/5,NATION_4:f/5", 7: "NATION_4:f/7"}


def test_overlay_looks_at_maps_of_any_size(spark):
    k = F.col("id")
    files = spark.range(25_002).select(k.cast("string").alias("path"), k.alias("size"), k.alias("mtime"), F.lit("a").alias("curhash"), F.lit("a").alias("maphash"))
    disk = files.select("path", F.when(F.col("size") % 2 == 0, "a").otherwise("b").alias("hash"), "size", (F.col("mtime") + 1).alias("mtime"))
    assert {r["state"]: r["count"] for r in depmaps.verify(files, disk).groupBy("state").count().collect()} == {"refresh": 12_501, "modified": 12_501}
    assert depmaps.verify(files, disk, most=25_000).isEmpty()


def test_literal_lane_counts_symbols(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    for name, lines in (("few", 40), ("many", 60)):
        (tmp_path / name).mkdir()
        put(spark, tmp_path / name, "documents", [(1, "\n".join(["a license"] * lines), "s")], schema)
    # 13 symbols at most: a word of more than 50 lines says nothing
    assert catalog.queries()["literal_lane"](spark, str(tmp_path / "few")).count() > 0
    assert catalog.queries()["literal_lane"](spark, str(tmp_path / "many")).count() == 0


def test_bootstrap_interval_is_not_noise(spark, tmp_path):
    put(spark, tmp_path, "events", [(i, float(i * 37 % 101)) for i in range(1000)], "event_id long, value double")
    got = catalog.queries()["bootstrap_ci"](spark, str(tmp_path)).first()
    values = [float(i * 37 % 101) for i in range(1000)]
    mean = sum(values) / 1000
    error = (sum((v - mean) ** 2 for v in values) / 1000 / 1000) ** 0.5
    # percentiles of 5000 draws have a standard error of 0.04 of it
    assert abs(got["low"] - (mean - 1.96 * error)) < 0.12 * error and abs(got["high"] - (mean + 1.96 * error)) < 0.12 * error

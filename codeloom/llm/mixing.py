"""Mixing sources to target weights by pivotal dependent rounding.

Each document has a number of copies to be taken in expectation: its source's
target over its source's size. The whole part is certain. The fractional parts
are rounded dependently: two documents meet, and mass moves between them in a
random direction, so that their expected words keep their sum, until one
fraction is 0 or 1; the other goes on with what is left. Documents of a source
meet in blocks of bounded size, each folded into at most one document that is
still fractional; the left-over documents of the blocks meet in blocks again,
and so on: a reduction tree of logarithmic depth. A source's words then miss
its target by less than one document, which is drawn like the others; turning a
fitting document, or trading one for another, makes up for that. Only DataFrame
functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_enough, table, words_pattern

ELEMENT = "struct<id:bigint,size:bigint,n:bigint,p:double,m:double>"
DONE = "array<struct<id:bigint,size:bigint,n:bigint,k:int>>"


def let(value: Column, body) -> Column:
    """Binds a value once for a lambda body that uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_draw(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") / float(1 << 53)


def fold(items: Column, seed: int) -> Column:
    """Pivotal rounding of an array of elements, in order: struct(rest, done), where rest is the one that is still fractional."""

    def one(x: Column, k: int) -> Column:
        return F.array(F.struct(x["id"].alias("id"), x["size"].alias("size"), x["n"].alias("n"), F.lit(k).alias("k")))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["size"].alias("size"), x["n"].alias("n"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"), x["m"].alias("m"))

    def state(rest: Column, done: Column) -> Column:
        return F.struct(rest.cast(ELEMENT).alias("rest"), done.cast(DONE).alias("done"))

    def meet(s: Column, b: Column) -> Column:
        a = s["rest"]
        room = F.struct((a["m"] * (1 - a["p"])).alias("a1"), (a["m"] * a["p"]).alias("a0"), (b["m"] * (1 - b["p"])).alias("b1"), (b["m"] * b["p"]).alias("b0"))

        def go(r: Column) -> Column:
            up, down = F.least(r["a1"], r["b0"]), F.least(r["a0"], r["b1"])
            rises = unit_draw(a["id"], a["size"], b["id"], b["size"], F.lit(seed)) * (up + down) < down
            return (
                F.when(rises & (r["a1"] <= r["b0"]), state(with_p(b, b["p"] - r["a1"] / b["m"]), F.concat(s["done"], one(a, 1))))
                .when(rises, state(with_p(a, a["p"] + r["b0"] / a["m"]), F.concat(s["done"], one(b, 0))))
                .when(r["a0"] <= r["b1"], state(with_p(b, b["p"] + r["a0"] / b["m"]), F.concat(s["done"], one(a, 0))))
                .otherwise(state(with_p(a, a["p"] - r["b1"] / a["m"]), F.concat(s["done"], one(b, 1))))
            )

        return let(room, go)

    start = state(F.element_at(items, 1), F.array().cast(DONE))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, meet)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Per source (with its sum of size and number of units): target, by filling up in order of the ratio of cap to weight. One row a source, ordered in one task."""
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))
    shared = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    s = s.withColumn("level", F.try_divide(left, shared)).withColumn("place", F.row_number().over(by_ratio))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("place"))).over(every)
    return s.withColumn("target", F.coalesce(F.least(F.col("most"), level * F.col("weight")), F.lit(0.0))).select("source", "source_size", "units", "target")


def repaired(decided: DataFrame, miss: DataFrame, rounds: int) -> DataFrame | None:
    """Documents to turn (__s, __null, id, size, turns), or None: each round turns, in every source, the one document, or takes one off and puts one on, that leaves the smallest miss, as long as that helps.

    Candidates are two documents for each number of words that a source's
    documents have, on either side, so what the rounds read grows with the
    number of different sizes, not with the documents.
    """
    key = ["__s", "__null"]
    pick = F.struct(F.xxhash64("id", F.lit("turn")).alias("h"), "id", "size")
    pool = decided.groupBy(*key, (F.col("n") * F.col("size")).alias("mass"), "k").agg(F.array_distinct(F.array(F.min(pick), F.max(pick))).alias("x"))
    pool = checkpoint(pool.select(*key, "mass", "k", F.explode("x").alias("x")).select(*key, "mass", "k", "x.*"))
    done = None
    for _ in range(rounds):
        now = pool.join(miss, key)
        item = F.struct("id", "size", "mass", "h")
        nothing = F.lit(None).cast("struct<id:bigint,size:bigint,mass:bigint,h:bigint>")
        single = now.select(*key, F.abs(F.col("miss") + F.when(F.col("k") == 0, F.col("mass")).otherwise(-F.col("mass"))).alias("left"), F.when(F.col("k") == 1, item).otherwise(nothing).alias("off"), F.when(F.col("k") == 0, item).otherwise(nothing).alias("on"))
        # taking one off asks for another whose words are its own less the miss: the nearest on either side
        wanted = now.withColumn("at", F.when(F.col("k") == 1, F.col("mass") - F.col("miss")).otherwise(F.col("mass").cast("double")))
        by_size = Window.partitionBy(*key).orderBy("at", "k", "h", "id", "size")
        other = F.when(F.col("k") == 0, item)
        beside = wanted.withColumns({"below": F.last(other, True).over(by_size.rowsBetween(Window.unboundedPreceding, 0)), "above": F.first(other, True).over(by_size.rowsBetween(0, Window.unboundedFollowing))}).filter("k = 1")
        pairs = [beside.filter(F.col(c).isNotNull()).select(*key, F.abs(F.col(f"{c}.mass") - F.col("at")).alias("left"), item.alias("off"), F.col(c).alias("on")) for c in ("below", "above")]
        best = single.unionByName(pairs[0]).unionByName(pairs[1]).groupBy(*key).agg(F.min_by(F.struct("left", "off", "on"), F.struct("left", "off.h", "on.h", "off.id", "on.id")).alias("b"))
        better = checkpoint(best.join(miss, key).filter(F.col("b.left") < F.abs("miss") - 1e-6).select(*key, "b.off", "b.on"))
        if better.isEmpty():
            break
        moved = better.select(*key, F.explode(F.filter(F.array("off", "on"), lambda x: x.isNotNull())).alias("x")).select(*key, F.col("x.id").alias("id"), F.col("x.size").alias("size"), F.lit(1).alias("turn"))
        done = moved if done is None else done.unionByName(moved)
        change = better.select(*key, (F.coalesce("on.mass", F.lit(0)) - F.coalesce("off.mass", F.lit(0))).alias("change"))
        miss = checkpoint(miss.join(change, key, "left").select(*key, (F.col("miss") + F.coalesce("change", F.lit(0))).alias("miss")))
        turning = moved.select(*[F.col(c).alias(f"t_{c}") for c in (*key, "id", "size", "turn")])
        same = (F.col("__s") == F.col("t___s")) & (F.col("__null") == F.col("t___null")) & F.col("id").eqNullSafe(F.col("t_id")) & (F.col("size") == F.col("t_size"))
        pool = checkpoint(pool.join(turning, same, "left").select(*key, "mass", F.when(F.col("t_turn").isNull(), F.col("k")).otherwise(1 - F.col("k")).alias("k"), "h", "id", "size"))
    return done and done.groupBy(*key, "id", "size").agg(F.sum("turn").alias("turns"))


def mixing_plan(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, block: int = 128, seed: int = 11, repairs: int = 8, source_rows: int = 10_000) -> DataFrame:
    """Per distinct (id, source, size) of docs: n (rows that share it), source_size, target, copies.

    size is the number of words (runs of anything but space and tab to carriage
    return); null and empty texts have none. Sources in code-point order, null
    last, weigh `weights`, repeating, and share all words; a target stops at
    cap times its source's size, and what exceeds that is shared by the others
    by weight. copies is at most ceil(cap). Rows that repeat an (id, source,
    size) are taken together, as often as each other. Draws are hashes of ids,
    so reruns and other partitionings agree. An empty table gives no rows.

    repairs: the rounding keeps each document's expected copies and misses a
    target by less than one document. Then, at most so often and as long as
    that brings a source nearer to its target, one document of it is turned, or
    one taken off and one put on: a few documents a source trade what is
    expected of them for the target.

    source_rows: the per-source table is broadcast only if it has no more rows
    than this; a larger one is joined by source and salt.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.size(F.regexp_extract_all(text_col, F.lit(words_pattern()), 0)), F.lit(0)).alias("size"))
    rows = rows.withColumn("size", F.when(F.col("size") < 0, 0).otherwise(F.col("size")).cast("long"))
    units = checkpoint(rows.groupBy("id", "source", "size").agg(F.count("*").alias("n")))
    stats = checkpoint(source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units")), weights, cap))
    key = lambda df: df.withColumns({"__s": F.coalesce("source", F.lit("")), "__null": F.col("source").isNull()})
    keyed, by_source = key(units), key(stats).drop("source")
    if small_enough(stats, source_rows):
        units = keyed.join(F.broadcast(by_source), ["__s", "__null"])
    else:
        salts = 64
        keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        by_source = by_source.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        units = keyed.join(by_source, ["__s", "__null", "__salt"]).drop("__salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.floor("rate"))
    meets = (F.col("p") > 0) & (F.col("size") > 0)
    alone = units.filter(~meets).withColumn("k", F.when(unit_draw(F.col("id"), F.lit(seed)) < F.col("p"), 1).otherwise(0))
    most = stats.agg(F.max("units")).first()[0] or 0
    level = units.filter(meets).select("__s", "__null", F.pmod(F.xxhash64("id", "size", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("units") / block))).alias("block"), F.struct("id", "size", "n", "p", (F.col("size") * F.col("n")).cast("double").alias("m")).cast(ELEMENT).alias("e"))
    blocks, depth, done = -(-most // block), 0, []
    while True:
        # larger documents first, so that what is left over tends to be small
        order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("e")["m"]).alias("first"), F.xxhash64(F.col("e")["id"], F.lit(seed + depth)).alias("then"), F.col("e")))), lambda x: x["e"])
        folded = checkpoint(level.groupBy("__s", "__null", "block").agg(order.alias("items")).select("__s", "__null", "block", fold(F.col("items"), seed + depth).alias("f")))
        done.append(folded.select("__s", "__null", F.explode("f.done").alias("d")))
        level = folded.select("__s", "__null", F.floor(F.col("block") / block).alias("block"), F.col("f.rest").alias("e"))
        depth += 1
        if blocks <= 1:
            break
        blocks = -(-blocks // block)
    # one document a source is still fractional: drawn like all others, so that what is expected of it stays
    last = F.when(unit_draw(F.col("e.id"), F.col("e.size"), F.lit(seed), F.lit("last")) < F.col("e.p"), 1).otherwise(0)
    done.append(level.select("__s", "__null", F.struct(F.col("e.id"), F.col("e.size"), F.col("e.n"), last.alias("k")).alias("d")))
    decided = checkpoint(reduce(DataFrame.unionByName, done).select("__s", "__null", "d.*"))
    facts = by_source.drop("__salt").distinct()
    few = small_enough(stats, source_rows)
    near = lambda df: F.broadcast(df) if few else df  # noqa: E731  one row a source
    decided = decided.join(near(facts), ["__s", "__null"]).withColumn("whole", F.floor(F.try_divide("target", "source_size")).cast("int"))
    taken = F.col("n") * F.col("size") * (F.col("whole") + F.col("k"))
    sums = decided.groupBy("__s", "__null").agg(F.sum(taken).alias("drawn"), F.first("target").alias("target"))
    sure = alone.groupBy("__s", "__null").agg(F.sum(taken).alias("sure"))
    miss = sums.join(sure, ["__s", "__null"], "left").select("__s", "__null", (F.col("drawn") + F.coalesce("sure", F.lit(0)) - F.col("target")).alias("miss"))
    turned = repaired(decided, checkpoint(miss), repairs)
    if turned is not None:
        # at most 2 * repairs rows a source
        turned = near(turned.select("__s", "__null", F.col("id").alias("turn_id"), F.col("size").alias("turn_size"), "turns"))
        same = (F.col("id").eqNullSafe(F.col("turn_id"))) & (F.col("size") == F.col("turn_size"))
        decided = decided.alias("d").join(turned.alias("t"), (F.col("d.__s") == F.col("t.__s")) & (F.col("d.__null") == F.col("t.__null")) & same, "left")
        decided = decided.select("d.*", "turns").withColumn("k", F.when(F.coalesce("turns", F.lit(0)) % 2 == 1, 1 - F.col("k")).otherwise(F.col("k")))
    both = [df.select("id", F.when(~F.col("__null"), F.col("__s")).alias("source"), "size", "n", "source_size", "target", (F.col("whole") + F.col("k")).alias("copies")) for df in (alone, decided)]
    return both[0].unionByName(both[1])


def mix_documents(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **settings) -> DataFrame:
    """The mixture itself: each row of docs as often as mixing_plan takes it, with its own columns; see there for nulls, repeated rows and empty tables. Columns whose names begin with '__mix' are reserved."""
    plan = mixing_plan(docs, text_col=text_col, id_col=id_col, source_col=source_col, **settings).filter("copies > 0")
    plan = plan.select(F.col("id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), F.col("copies").alias("__mix_copies"))
    size = F.greatest(F.coalesce(F.size(F.regexp_extract_all(text_col, F.lit(words_pattern()), 0)), F.lit(0)), F.lit(0)).cast("long")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__mix_id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_words") == F.col("__mix_size"))
    joined = docs.withColumn("__mix_words", size).join(plan, same)
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

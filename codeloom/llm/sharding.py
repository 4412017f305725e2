"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts form a group that stays in one shard. Groups that are
large against a shard's capacity are sorted by size and put, one by one, into
the bin with the tightest sufficient remaining capacity, found in a balanced
tree. There are at most `shards * fine` of them, whatever the input. All
smaller groups are first gathered, where they are, into bundles of nearly one
fine unit (size order within a hash bucket), which are then packed like groups.
So the driver packs a number of items that the parameters bound.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table


@dataclass
class Node:
    key: tuple[int, int]
    weight: float
    left: Node | None = None
    right: Node | None = None


@dataclass
class BinTree:
    """A treap of (remaining capacity, bin); deterministic, as its weights come from a seeded generator."""

    root: Node | None = None
    rng: random.Random = field(default_factory=lambda: random.Random(0))

    def split(self, node: Node | None, key: tuple[int, int]) -> tuple[Node | None, Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, more = self.split(node.right, key)
            return node, more
        less, node.left = self.split(node.left, key)
        return less, node

    def join(self, a: Node | None, b: Node | None) -> Node | None:
        if a is None or b is None:
            return a or b
        if a.weight < b.weight:
            a.right = self.join(a.right, b)
            return a
        b.left = self.join(a, b.left)
        return b

    def insert(self, key: tuple[int, int]) -> None:
        less, more = self.split(self.root, key)
        self.root = self.join(self.join(less, Node(key, self.rng.random())), more)

    def remove(self, key: tuple[int, int]) -> None:
        less, more = self.split(self.root, key)
        _, more = self.split(more, (key[0], key[1] + 1))
        self.root = self.join(less, more)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (remaining, bin) with remaining >= size."""
        node, found = self.root, None
        while node is not None:
            if node.key >= (size, -1):
                found, node = node.key, node.left
            else:
                node = node.right
        return found

    def roomiest(self) -> tuple[int, int]:
        node = self.root
        while node.right is not None:
            node = node.right
        return node.key


def best_fit_decreasing(sizes: list[tuple[int, object]], capacity: int, bins: int | None = None) -> tuple[dict[object, int], list[int]]:
    """Packs (size, item) pairs; returns each item's bin and the load of each bin.

    With `bins`, there are that many, and an item that fits nowhere goes where
    most room is left. Without, such an item opens a new bin (alone in it, if
    it exceeds the capacity).
    """
    tree, load, where = BinTree(), [0] * (bins or 0), {}
    for b in range(len(load)):
        tree.insert((capacity, b))
    for size, item in sorted(sizes, key=lambda x: (-x[0], x[1])):
        found = tree.tightest(size)
        if found is None and bins:
            found = tree.roomiest()
        if found is None:
            load.append(0)
            found = capacity, len(load) - 1
        else:
            tree.remove(found)
        left, b = found
        where[item], load[b] = b, load[b] + size
        tree.insert((left - size, b))
    return where, load


def shard_documents(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", shards: int = 16, fine: int = 1024, rows_a_part: int = 100_000) -> DataFrame:
    """All rows of docs with size, text_crc32, law ('bytes'), shard, slot and grown_shard.

    The law is 'bytes': shard sizes are near equal. size is the text's UTF-8
    bytes plus 1. Rows with equal texts share a shard; null texts (size 1,
    crc32 0, as of no bytes) form one group and empty texts another. A group
    larger than a shard's capacity cannot stay whole under this law: its rows
    are dealt by a hash of the id into pieces. slot counts from 0 without gaps
    within a shard, in the order of a hash and then of the id; repeated rows
    get slots of their own. An empty table gives no rows. Columns of docs named
    like a new column are replaced. grown_shard is null, as only law 'key' has it.
    """
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    taken = {c.lower() for c in new}
    kept = [c for c in docs.columns if c.lower() not in taken]
    # columns of the caller's that are named like our own stand aside meanwhile
    aside = {c: f"__aside_{i}" for i, c in enumerate(kept) if c.startswith("__")}
    docs = docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in kept])
    text_col, id_col = aside.get(text_col, text_col), aside.get(id_col, id_col)
    text = F.col(text_col)
    keyed = docs.withColumns({
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        "text_crc32": F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long"),
        "__group": F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()),
        "__row": F.xxhash64(id_col, F.lit("row")),
    })
    rows = checkpoint(keyed.select("__group", "__row", "size"))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    capacity = max(1, -(-total // shards))
    unit = max(1, capacity // fine)
    groups = rows.groupBy("__group", "size").agg(F.count("*").alias("n"))
    # at most `shards` groups exceed a shard's capacity
    large = {(r[0], r[1]): 8 * (-(-r[1] * r[2] // capacity)) for r in groups.filter(F.col("size") * F.col("n") > capacity).collect()}

    def salted(df: DataFrame) -> DataFrame:
        salt = F.lit(0).cast("long")
        for (g, size), n in large.items():
            salt = F.when((F.col("__group") == g) & (F.col("size") == size), F.pmod("__row", F.lit(n))).otherwise(salt)
        return df.withColumn("__salt", salt)

    units = checkpoint(salted(rows).groupBy("__group", "size", "__salt").agg((F.sum("size")).alias("bytes")))
    width = max(8, -(-count // rows_a_part))
    parts = min(width, 4 * fine)
    whole = units.filter(F.col("bytes") >= unit)
    running = Window.partitionBy("__part").orderBy(F.desc("bytes"), "__group", "size", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    bundled = units.filter(F.col("bytes") < unit).withColumn("__part", F.pmod(F.xxhash64("__group", F.lit("part")), F.lit(parts)))
    bundled = bundled.withColumn("__bundle", F.floor(F.coalesce(F.sum("bytes").over(running), F.lit(0)) / unit))
    bundled = checkpoint(bundled.select("__group", "size", "__salt", "bytes", "__part", "__bundle"))
    items: list[tuple[int, object]] = [(r[3], (0, r[0], r[1], r[2])) for r in whole.select("__group", "size", "__salt", "bytes").collect()]
    items += [(r[2], (1, r[0], r[1], 0)) for r in bundled.groupBy("__part", "__bundle").agg(F.sum("bytes").alias("bytes")).collect()]
    where, _ = best_fit_decreasing(items, capacity, shards)
    spark = docs.sparkSession
    # both maps have at most shards * fine rows, and one for each part of the bundles, of which there are 4 * fine at most
    of_groups = spark.createDataFrame([(k[1], k[2], k[3], b) for k, b in where.items() if k[0] == 0], "__group long, size long, __salt long, __whole int")
    of_bundles = spark.createDataFrame([(k[1], k[2], b) for k, b in where.items() if k[0] == 1], "__part long, __bundle long, __in int")
    small = bundled.join(F.broadcast(of_bundles), ["__part", "__bundle"]).select("__group", "size", "__salt", "__in")
    placed = salted(keyed).join(F.broadcast(of_groups), ["__group", "size", "__salt"], "left")
    # rows of small units meet no hot key: a unit that reached `unit` bytes is in the broadcast map; spreading those keeps them off one task
    spread = F.when(F.col("__whole").isNotNull(), -1 - F.pmod("__row", F.lit(1 << 40))).otherwise(F.col("__group"))
    small = small.withColumnRenamed("__group", "__spread")
    placed = placed.withColumn("__spread", spread).join(small, ["__spread", "size", "__salt"], "left")
    placed = placed.withColumn("shard", F.coalesce("__whole", "__in"))
    chunk = F.pmod(F.xxhash64("__row"), F.lit(width)).cast("int")
    placed = placed.withColumn("__chunk", chunk)
    counts = placed.groupBy("shard", "__chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__chunk").orderBy("__row", F.col(id_col), "size", "__group")
    out = placed.withColumn("__rank", F.row_number().over(within)).join(starts, ["shard", "__chunk"])
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in kept], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__start") + F.col("__rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

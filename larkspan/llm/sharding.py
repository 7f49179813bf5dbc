"""Shards of near equal bytes by best-fit-decreasing bin packing.

Rows with equal texts are one group and are never parted. Whole groups are far too many to be packed one by one, so
they become *units* first: a group of more than `1 / (grain * shards)` of all bytes is a unit by itself (there are at
most `grain * shards` of these), the others are dealt by the hash of their text into `grain * shards` units. Both
numbers are bounded by parameters, not by the data, so the packing itself is one small task whatever the size of the
table: units, largest first, enter the open shard with the least room that still holds them.

The capacity is the smallest one for which the packing needs no more than `shards` bins; a group larger than the mean
shard raises it to that group's size, for groups are indivisible.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.common import read, shuffle_width, whole
from larkspan.session import cut_lineage

ROW_BYTES = 8


class RoomTree:
    """Open bins by remaining room: a balanced (AVL) search tree over (room, bin)."""

    def __init__(self, items: list[tuple[int, int]] = ()):
        self.root = None
        for item in items:
            self.add(item)

    def add(self, item: tuple[int, int]) -> None:
        self.root = self._add(self.root, item)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that holds `size`."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                node, best = node[1], node[0]
            else:
                node = node[2]
        if best:
            self.root = self._remove(self.root, best)
        return best

    # a node is [item, left, right, height]
    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _even(self, node):
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) < 2:
            return node
        heavy, light = (1, 2) if lean > 0 else (2, 1)
        child = node[heavy]
        if self._height(child[light]) > self._height(child[heavy]):
            node[heavy] = self._lift(child, light)
        return self._lift(node, heavy)

    def _lift(self, node, side):
        child, other = node[side], 3 - side
        node[side], child[other] = child[other], node
        for n in (node, child):
            n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        return child

    def _add(self, node, item):
        if not node:
            return [item, None, None, 1]
        side = 1 if item < node[0] else 2
        node[side] = self._add(node[side], item)
        return self._even(node)

    def _remove(self, node, item):
        if item != node[0]:
            side = 1 if item < node[0] else 2
            node[side] = self._remove(node[side], item)
            return self._even(node)
        if not node[1] or not node[2]:
            return node[1] or node[2]
        least = node[2]
        while least[1]:
            least = least[1]
        node[0] = least[0]
        node[2] = self._remove(node[2], least[0])
        return self._even(node)


def best_fit(sizes: list[int], capacity: int, bins: int) -> list[int] | None:
    """The bin of each size (sizes come largest first), or None where `bins` bins don't hold them."""
    tree, placed, opened = RoomTree(), [], 0
    for size in sizes:
        found = tree.take_tightest(size)
        if not found:
            if opened == bins or size > capacity:
                return None
            found = (capacity, opened)
            opened += 1
        tree.add((found[0] - size, found[1]))
        placed.append(found[1])
    return placed


def pack_units(sizes: list[int], bins: int) -> list[int]:
    """Best-fit-decreasing into `bins` bins of the smallest capacity that serves (to a 10,000th)."""
    low = max([-(-sum(sizes) // bins), *sizes[:1], 1])
    least, step = low, max(1, low // 10_000)
    while (placed := best_fit(sizes, low + step, bins)) is None:
        low, step = low + step, 2 * step
    high, fine = low + step, max(1, least // 10_000)
    while high - low > fine:
        middle = (low + high) // 2
        found = best_fit(sizes, middle, bins)
        if found is not None:
            placed, high = found, middle
        else:
            low = middle
    return placed


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, grain: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    A null text has no bytes and is equal to an empty one; a row costs 8 bytes more than its text. Repeated rows and
    null ids are rows like any other. An empty table gives no rows. Slots are numbered from 0 in each shard.
    """
    spark = docs.sparkSession
    text = whole(text_col)
    rows = cut_lineage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("key"),
        )
    )
    groups = cut_lineage(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    units = grain * shards
    light_unit = F.pmod(F.xxhash64("key"), F.lit(units))
    heavy = F.col("bytes") * units > F.lit(total)
    # at most `units` groups can each hold more than 1 / units of all bytes: a bound that no data exceed
    big = groups.filter(heavy).select("key", (F.lit(units) + F.row_number().over(Window.orderBy("key")) - 1).alias("big_unit"))
    big = cut_lineage(big)
    small = groups.filter(~heavy).groupBy(light_unit.alias("unit")).agg(F.sum("bytes").alias("bytes"))
    sized = small.unionByName(groups.join(F.broadcast(big), "key").select(F.col("big_unit").alias("unit"), "bytes"))

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "unit"], ascending=[False, True])
        return pd.DataFrame({"unit": frame["unit"], "shard": pack_units(frame["bytes"].tolist(), shards)})

    placed = cut_lineage(sized.groupBy(F.lit("all")).applyInPandas(packed, "unit long, shard int"))
    dealt = (
        rows.join(F.broadcast(big), "key", "left")
        .withColumn("unit", F.coalesce("big_unit", light_unit))
        .join(F.broadcast(placed), "unit")
        .select("doc_id", "row", "size", "text_crc32", "shard")
    )
    return _slots(spark, dealt, shards)


def _slots(spark: SparkSession, dealt: DataFrame, shards: int) -> DataFrame:
    """Number the rows of each shard from 0. A shard is numbered in many parts at once: the count of the parts before
    it (one row per part) is added to the place in the part."""
    parts = max(8, shuffle_width(spark))
    cut = cut_lineage(dealt.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return cut.withColumn("place", place).join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

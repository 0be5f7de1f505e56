"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that stays in one shard.  Groups are
packed, largest first, each into the shard with the tightest remaining
capacity that still holds it; the shards' remaining capacities are kept in a
balanced tree.  For a fixed number of shards the capacity is the smallest (by
bisection) at which best-fit-decreasing needs no more than that many.

Scale.  Only groups above ``1 / (shards * FINE)`` of all bytes are packed one
by one; there are at most ``shards * FINE`` of them.  The others are dealt by
a hash of their text into ``shards * FINE`` bundles, which are packed as
items.  So the driver sees at most ``2 * shards * FINE`` sizes whatever the
input, and no row passes through it.  Sizes are summed per group with
map-side aggregation, so a group with a third of all rows is no hot task.
Slots come from counts per (shard, block) plus a rank within the block, never
from one sort per shard.

Defined cases: a null text has size 1 (its text and checksum are null) and all
null texts are one group; the empty text is a group of its own; rows that
repeat entirely get slots of their own; a null id sorts first; an empty table
gives an empty result.  A group larger than the ideal shard gets a shard of
its own and raises the capacity to its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from random import Random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.session import cut_lineage

FINE = 128
ROWS_PER_BLOCK = 20_000


class Treap:
    """Balanced search tree of ``(remaining capacity, bin)``, by random priorities."""

    def __init__(self, seed: int = 0):
        self.rnd, self.root = Random(seed), None

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.rnd.random(), None, None]), high)

    def take_at_least(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest key whose capacity is ``size`` or more."""
        node, found = self.root, None
        while node is not None:
            if node[0] >= (size, -1):
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            low, rest = self._split(self.root, found)
            _, high = self._split(rest, (found[0], found[1] + 1))
            self.root = self._merge(low, high)
        return found

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]


def best_fit_decreasing(sizes: Sequence[int], capacity: int, max_bins: int | None = None) -> list[int] | None:
    """Bin of each size, or None if more than ``max_bins`` are needed.  Sizes
    above the capacity get a bin each."""
    out, tree, bins = [0] * len(sizes), Treap(), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_at_least(sizes[i])
        if found is None:
            found = (max(capacity, sizes[i]), bins)
            bins += 1
            if max_bins is not None and bins > max_bins:
                return None
        out[i] = found[1]
        tree.insert((found[0] - sizes[i], found[1]))
    return out


def pack_into(sizes: Sequence[int], bins: int) -> list[int]:
    """Best-fit-decreasing at the smallest capacity that needs ``bins`` or fewer."""
    low = max([-(-sum(sizes) // bins), *sizes, 1])
    found = best_fit_decreasing(sizes, low, bins)
    if found is not None:
        return found
    high = 2 * low
    while (found := best_fit_decreasing(sizes, high, bins)) is None:
        low, high = high, 2 * high
    while high - low > max(1, low // 100_000):
        mid = (low + high) // 2
        at_mid = best_fit_decreasing(sizes, mid, bins)
        low, high, found = (low, mid, at_mid) if at_mid is not None else (mid, high, found)
    return found


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot``; see the module's text."""
    text = F.col(f"`{text_col}`")
    raw = text.cast("binary")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("crc"), F.md5(raw).alias("digest"),
    )
    # a few words a row without the text: the texts are read once
    rows = cut_lineage(rows.withColumn("digest", F.coalesce("digest", F.lit(""))))
    sums = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    bundles = shards * FINE
    sums = sums.withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("int"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = total or 0
    cut = max(1, total // bundles)
    # at most `bundles` groups lie above the cut, and there are `bundles` bundles
    items = (sums.groupBy(F.when(F.col("bytes") > cut, F.col("digest")).alias("digest"),
                          F.when(F.col("bytes") <= cut, F.col("bundle")).alias("bundle"))
             .agg(F.sum("bytes").alias("bytes")).orderBy("bundle", "digest").collect())
    place = pack_into([r["bytes"] for r in items], shards)
    spark = docs.sparkSession
    big = spark.createDataFrame([(r["digest"], p) for r, p in zip(items, place, strict=True) if r["digest"] is not None],
                                "digest string, own int")
    small = {r["bundle"]: p for r, p in zip(items, place, strict=True) if r["bundle"] is not None}
    table = F.array(*[F.lit(small.get(i, 0)) for i in range(bundles)])
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("int")
    blocks = max(1, n // ROWS_PER_BLOCK)
    placed = (rows.join(F.broadcast(big), "digest", "left")
              .withColumn("shard", F.coalesce("own", F.element_at(table, bundle + 1)))
              .withColumn("block", F.pmod(F.xxhash64(F.col("id").cast("string"), "crc"), F.lit(blocks)).cast("int"))
              .select("id", "size", "crc", "shard", "block"))
    counts = placed.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("id", "crc")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    return (ranked.join(offsets, ["shard", "block"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("offset") + F.col("rank")).cast("long").alias("slot")))

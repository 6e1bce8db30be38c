"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts form an indivisible group. Groups, largest first, go to the bin with the tightest
remaining capacity that still holds them; the open bins stand in a balanced tree keyed by what remains. Groups of
one size are alike, so the packing runs over the histogram of sizes: its input is bounded (some 90,000 size
classes), however many documents there are. Which groups of a class go where follows from their number in it.

The driver holds the histogram and the runs: a run for each size class of each bin, so that bins (all bytes over the
capacity) bound them. Plans beyond a proven size are not broadcast; texts of many copies meet their place in many tasks.

Nulls and edge cases: a null text counts as empty and takes one byte, as an empty one does. A null doc_id is a row
like any other. Repeated rows are copies and stay together, in any order of their own. Groups of one size class go in
the order of their text's hash. A very long text is a group like any other; one beyond the capacity is a shard of its
own. An empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_copies, join_plan, numbered, scratch, size_class, text_key


class RemainingTree:
    """A treap of (remaining capacity, bin): insert, remove and the smallest entry that is large enough, in log time."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.draw = random.Random(7).random

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.draw(), None, None]), right)

    def take_fitting(self, size: int) -> tuple[int, int] | None:
        """Remove and give the tightest bin with room for `size`; None if there is none."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        _, right = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, right)
        return node[0]


def pack(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best-fit-decreasing over (size, count); gives runs (size, bin, count) in order, None if over `most` bins are needed.

    A group larger than the capacity gets a bin of its own.
    """
    tree, bins, runs = RemainingTree(), 0, []
    for size, left in sorted(classes, reverse=True):
        while left:
            if found := tree.take_fitting(size):
                remaining, bin_ = found
            else:
                remaining, bin_, bins = max(capacity, size), bins, bins + 1
                if most is not None and bins > most:
                    return None
            n = min(left, remaining // max(size, 1))
            runs.append((size, bin_, n))
            left -= n
            if remaining - n * size:
                tree.insert(remaining - n * size, bin_)
    return runs


def pack_into(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """The smallest capacity found by bisection for which best-fit-decreasing needs no more than `shards` bins.

    A group larger than an equal share of what is left gets a bin of its own first, so that the rest stays even.
    """
    left, runs = {s: n for s, n in classes if n}, []
    while left and len(runs) < shards - 1 and (largest := max(left)) * (shards - len(runs)) > sum(s * n for s, n in left.items()):
        runs.append((largest, len(runs), 1))
        left[largest] -= 1
        if not left[largest]:
            del left[largest]
    rest, own = sorted(left.items()), len(runs)
    if not rest:
        return runs
    low = max(-(-sum(s * n for s, n in rest) // (shards - own)), rest[-1][0])
    high, best = low, None
    while not (best := pack(rest, high, shards - own)):
        high += max(1, low // 64)
    while low < high:
        middle = (low + high) // 2
        if found := pack(rest, middle, shards - own):
            best, high = found, middle
        else:
            low = middle + 1
    return runs + [(s, b + own, n) for s, b, n in best]


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (number in the shard by doc_id) of each row.

    Give a number of shards of near equal bytes, or the capacity in bytes of as few shards as best-fit-decreasing finds.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), text_key(F.col("text")).alias("_key"))
    slim = scratch(slim, "slim")
    groups = slim.groupBy("_key").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_n")).select("_key", "_n", size_class(F.col("_size")).alias("_class"))
    groups = numbered(groups, ["_class"], ["_key"], "_rank")
    found = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("rows")).collect()
    classes = [(r["_class"], r["n"]) for r in found]
    runs, seen = [], {}
    for size, bin_, n in pack_into(classes, shards) if shards else pack(classes, capacity):
        first = seen.get(size, 0)
        runs.append((size, bin_, first, first + n))
        seen[size] = first + n
    plan = spark.createDataFrame(runs, "_class long, shard int, _from long, _to long")
    placed = scratch(join_plan(groups, plan, ["_class"], "_from", "_to", len(runs)).select("_key", "_n", "shard"), "placed")
    return numbered(join_copies(slim, placed, "_key", "_n", sum(r["rows"] for r in found)), ["shard"], ["doc_id", "_key"], "slot").drop("_key")

"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are equal texts. All of them, large or small, enter by falling size, ties by the hash of their text: each goes to the
bin with the tightest remaining capacity that holds it, found in a balanced tree; what no bin holds
goes to a new bin, or, with a fixed number of shards, to the emptiest bin. Groups of one size are dealt
together: the tightest bin that holds one takes as many as it has room for, as each of them leaves it the tightest, and so on.
So the packing needs no groups, only how many there are of each size. The driver reads these counts as a stream by falling size and writes runs of
places in the order of groups, each with its first bin and the number for a bin; the cluster ranks the groups and looks each
one's place up. With n bins of capacity c and groups of d different sizes there are at most d + n * log2(c) runs, as a bin that
takes a run keeps less than half of its room; d is at most the root of twice the bytes of all texts, as different sizes add up.
The driver holds the tree of bins and one batch of runs.

Cases. A null text counts as an empty one: no bytes, crc 0, and one group with empty texts. Ties in size are
broken by the text's hash. Repeated rows are rows of one group, each with its own slot. A group that is larger
than the capacity fills a bin alone or, when the number of shards is fixed, exceeds it. Null ids sort first. An
empty table gives no rows. Very long texts are hashed whole. Only doc_id and text are read, whatever other columns are named.
Of the groups, at most ``HOT`` can have that part of all rows; these are broadcast to their rows instead of joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, with_rank

#: Runs are looked up by blocks of this many places, and cut so that none has more than ``CUT`` of these; a group of
#: at least 1/``HOT`` of all rows is hot.
PLACES, CUT, HOT, RUNS_AT_ONCE = 128, 1 << 18, 1000, 1 << 20


class Tree:
    """An AVL tree of distinct (remaining, bin) pairs with insertion, removal and lower bound."""

    class Node:
        __slots__ = ("key", "left", "right", "height")

        def __init__(self, key):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self):
        self.root = None

    @staticmethod
    def _fit(x):
        x.height = 1 + max(x.left.height if x.left else 0, x.right.height if x.right else 0)
        return x

    def _tilt(self, x):
        return (x.left.height if x.left else 0) - (x.right.height if x.right else 0)

    def _turn(self, x, up: str, down: str):
        y = getattr(x, up)
        setattr(x, up, getattr(y, down))
        setattr(y, down, self._fit(x))
        return self._fit(y)

    def _balance(self, x):
        self._fit(x)
        if self._tilt(x) > 1:
            if self._tilt(x.left) < 0:
                x.left = self._turn(x.left, "right", "left")
            return self._turn(x, "left", "right")
        if self._tilt(x) < -1:
            if self._tilt(x.right) > 0:
                x.right = self._turn(x.right, "left", "right")
            return self._turn(x, "right", "left")
        return x

    def add(self, key):
        def go(x):
            if x is None:
                return self.Node(key)
            if key < x.key:
                x.left = go(x.left)
            else:
                x.right = go(x.right)
            return self._balance(x)

        self.root = go(self.root)

    def remove(self, key):
        def go(x, key):
            if key < x.key:
                x.left = go(x.left, key)
            elif key > x.key:
                x.right = go(x.right, key)
            elif x.left is None or x.right is None:
                return x.left or x.right
            else:
                y = x.right
                while y.left:
                    y = y.left
                x.key, x.right = y.key, go(x.right, y.key)
            return self._balance(x)

        self.root = go(self.root, key)

    def at_least(self, key):
        x, best = self.root, None
        while x:
            if x.key >= key:
                x, best = x.left, x.key
            else:
                x = x.right
        return best

    def last(self):
        x = self.root
        while x.right:
            x = x.right
        return x.key


def pack_runs(counts: Iterable[tuple[int, int]], capacity: int, shards: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """Best-fit decreasing of items given as (size, number) by falling size: runs (start, end, bin, each) of places in the order
    of items, the first ``each`` of which go to ``bin``, the next to the bin after it, and so on. Without ``shards``, bins are opened as needed."""
    tree, opened, at = Tree(), 0, 0
    for b in range(shards or 0):
        tree.add((capacity, -b))
    for size, left in counts:
        while left:
            found = tree.at_least((size, float("-inf")))
            if found is None and shards is None:
                each = max(1, capacity // size)
                bins = max(1, left // each)
                first, n = opened, min(left, bins * each)
                opened += bins
                for b in range(first, opened):
                    tree.add((max(capacity, size) - min(n, each) * size, -b))
            else:
                each = n = min(left, found[0] // size) if found else 1
                room, b = found or tree.last()
                first = -b
                tree.remove((room, b))
                tree.add((room - n * size, b))
            yield at, at + n, first, each
            at, left = at + n, left - n


def best_fit_decreasing(items: list[tuple], capacity: int, shards: int | None = None) -> dict:
    """{key: bin} of (key, size) items, ties in size by key."""
    items = sorted(items, key=lambda x: (-x[1], x[0]))
    counts = ((size, len(list(same))) for size, same in groupby(items, key=lambda x: x[1]))
    return {items[i][0]: b + (i - start) // each for start, end, b, each in pack_runs(counts, capacity, shards) for i in range(start, end)}


def cut_runs(runs: Iterable[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """Runs as (start, from, to, bin, each): none goes over a multiple of ``PLACES * CUT`` places."""
    for start, end, b, each in runs:
        at = start
        while at < end:
            to = min(end, (at // (PLACES * CUT) + 1) * PLACES * CUT)
            yield start, at, to, b, each
            at = to


def shard_groups(groups: DataFrame, capacity: int, shards: int | None) -> DataFrame:
    """groups (grp, size, ...) with the column shard."""
    spark = groups.sparkSession
    ranked = materialize(with_rank(groups.withColumn("_falling", -F.col("size")), ["_falling", "grp"], "_place"))
    counts = materialize(ranked.groupBy("size").count()).orderBy(F.desc("size"))
    runs, shape = scratch(spark), "_start long, _from long, _to long, _bin int, _each long"
    for some in batched(cut_runs(pack_runs(counts.toLocalIterator(), capacity, shards)), RUNS_AT_ONCE):
        spark.createDataFrame(some, shape).write.mode("append").parquet(runs)
    block = lambda e: F.floor(e / PLACES)
    at = spark.read.schema(shape).parquet(runs).withColumn("_block", F.explode(F.sequence(block(F.col("_from")), block(F.col("_to") - 1))))
    inside = (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))
    shard = F.col("_bin") + F.floor((F.col("_place") - F.col("_start")) / F.col("_each"))
    found = ranked.withColumn("_block", block(F.col("_place"))).join(at, "_block").where(inside)
    return found.select(*groups.columns, shard.cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int | None = 24, capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (its rank by doc_id within the
    shard). Give ``shards`` for a fixed number of shards of near equal bytes, or ``capacity`` (with ``shards``
    None) for as few shards of that capacity as best-fit-decreasing needs."""
    if (shards is None) == (capacity is None):
        raise ValueError("give a number of shards or a capacity")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("grp"),
    )
    rows = materialize(rows)
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    placed = materialize(shard_groups(groups, capacity or -(-total // shards), shards))
    hot = F.broadcast(placed.where(F.col("n") * HOT >= n).select("grp", "shard"))
    others = rows.join(hot, "grp", "left_anti").join(placed.where(F.col("n") * HOT < n).select("grp", "shard"), "grp")
    dealt = rows.join(hot, "grp").unionByName(others).select("doc_id", "size", "text_crc32", "shard")
    return with_rank(dealt, ["shard", "doc_id"], "slot", within="shard").select("doc_id", "size", "text_crc32", "shard", "slot")

"""Minimax contiguous partition of ordered atomic groups into shards.

The groups (equal keys) stand in order of their key.  The smallest capacity
for which a greedy walk needs no more than the wanted shards is found by
binary search, and the groups are cut there.  No machine ever holds all
groups: the walk runs over at most ``width`` ranges of the key, each with its
sum and its largest group.  Walking as if a range could be cut anywhere, and
as if a cut fell short by the largest group, bounds every cut; only ranges
that a cut may hit are split, until each such cut is at a single group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import read, stored

KEY_BITS = 63


class Ranges:
    """Ordered key ranges: first key, sum, largest group, and whether it is one group."""

    def __init__(self, low, total, largest, single):
        self.low, self.total, self.largest, self.single = (np.asarray(x, np.int64) for x in (low, total, largest, single))
        self.ends = np.cumsum(self.total)

    def walk(self, capacity: int, shards: int, generous: bool) -> tuple[list[int], bool]:
        """Positions after each shard, and whether all is placed."""
        at, out, end = 0, [], int(self.ends[-1]) if len(self.ends) else 0
        for _ in range(shards):
            if at >= end:
                break
            to = at + capacity
            if to < end:
                j = int(np.searchsorted(self.ends, to, "right"))
                start = int(self.ends[j] - self.total[j])
                if self.single[j]:
                    to = start
                elif not generous:
                    to = max(start, to - int(self.largest[j]) + 1)
            at = max(at, min(to, end))
            out.append(at)
        return out, at >= end

    def smallest(self, shards: int, generous: bool) -> int:
        low, high = max([1, *self.largest.tolist()]), max(1, int(self.total.sum()))
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, generous)[1]:
                high = mid
            else:
                low = mid + 1
        return low

    def open(self, shards: int) -> tuple[int, np.ndarray]:
        """The smallest capacity (a lower bound while ranges are open) and the ranges to split."""
        low, high = self.smallest(shards, True), self.smallest(shards, False)
        first, last = self.walk(low, shards, False)[0], self.walk(high, shards, True)[0]
        hit = np.zeros(len(self.total), bool)
        for i in range(len(last)):
            a = np.searchsorted(self.ends, first[i] if i < len(first) else 0, "right")
            b = np.searchsorted(self.ends, last[i], "left")
            hit[a : b + 1] = True
        return low, np.flatnonzero(hit & (self.single == 0))


def plan(groups: DataFrame, shards: int, width: int = 1 << 16) -> list[int]:
    """First keys of the shards after the first, for rows (key, size) with keys in [0, 2**63).

    ``groups`` may hold several rows of a key; they are summed first.
    """
    sums = groups.groupBy("key").agg(F.sum("size").alias("size"))

    def ranges(which: DataFrame, bits: int) -> dict[int, tuple]:
        shift = KEY_BITS - bits
        got = which.groupBy(F.shiftright("key", shift).alias("r")).agg(F.min("key").alias("low"), F.sum("size").alias("s"), F.max("size").alias("m"), F.count("*").alias("n")).collect()
        return {x.r: (x.low, x.s, x.m, int(x.n == 1)) for x in got}

    bits = width.bit_length() - 1
    items = [(r, bits, *v) for r, v in sorted(ranges(sums, bits).items())]
    while True:
        table = Ranges(*zip(*[x[2:] for x in items])) if items else Ranges([], [], [], [])
        if not items:
            return []
        capacity, again = table.open(shards)
        if not len(again):
            cuts = [x for x in table.walk(capacity, shards, False)[0] if x < int(table.ends[-1])]
            return [int(table.low[np.searchsorted(table.ends, x, "right")]) for x in cuts]
        split = [items[i] for i in again]
        deep = min(KEY_BITS, min(x[1] for x in split) + max(4, (width // len(split)).bit_length() - 1))
        spans = groups.sparkSession.createDataFrame([(x[0], x[1]) for x in split if x[1] < deep], "r long, bits int")
        level = sorted({x[1] for x in split if x[1] < deep})
        part = None
        for b in level:
            one = sums.join(F.broadcast(spans.filter(F.col("bits") == b).select("r")), F.shiftright("key", KEY_BITS - b) == F.col("r"), "left_semi")
            part = one if part is None else part.unionByName(one)
        finer = ranges(part, deep)
        by: dict[tuple, list] = {}
        for r, v in sorted(finer.items()):
            for b in level:
                by.setdefault((r >> (deep - b), b), []).append((r, deep, *v))
        opened = {(x[0], x[1]) for x in split if x[1] < deep}
        items = [y for x in items for y in (by[x[:2]] if x[:2] in opened else [x])]


def shard(df: DataFrame, shards: int, key: Column, size: Column, tie: str, salts: int = 64, buckets: int = 1024) -> DataFrame:
    """Columns ``tie``, size, key, shard and slot for each row of ``df`` plus its ``crc``.

    Rows with equal ``key`` (a long from 0) stay in one shard.  Slots follow
    key ranges and salts, so that a hot key is numbered by many tasks.
    Empty input gives no rows; fewer groups than shards leave shards empty.
    """
    spark = df.sparkSession
    thin = stored(spark, df.select(F.col(tie), size.alias("size"), key.alias("key"), *[c for c in df.columns if c == "text_crc32"]), "sizes")
    cuts = plan(thin.select("key", "size"), shards)
    where = F.lit(0)
    for c in cuts:
        where = where + (F.col("key") >= F.lit(c)).cast("int")
    bucket = F.shiftright("key", KEY_BITS - (buckets.bit_length() - 1)).cast("int")
    salt = F.pmod(F.xxhash64(tie), F.lit(salts)).cast("int")
    placed = thin.withColumn("shard", where).withColumn("bucket", bucket).withColumn("salt", salt)
    cell = ["shard", "bucket", "salt"]
    counts = placed.groupBy(*cell).count()  # at most (buckets + shards) * salts rows, whatever the input
    before = counts.select(*cell, (F.sum("count").over(W.partitionBy("shard").orderBy("bucket", "salt")) - F.col("count")).alias("before"))
    row = F.row_number().over(W.partitionBy(*cell).orderBy("key", tie)) - 1
    return placed.withColumn("row", row).join(F.broadcast(before), cell).withColumn("slot", F.col("before") + F.col("row")).drop("before", "row", "bucket", "salt")


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law ``bytes``; equal texts stay together (null counts as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text")).withColumn("text_crc32", F.crc32(F.encode("text", "UTF-8")))
    out = shard(docs, 40, F.shiftrightunsigned(F.xxhash64("text"), 1), F.octet_length("text").cast("long") + 16, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))

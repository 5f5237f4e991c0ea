"""Connected components of an edge table by local contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each reaches by them."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(node)), at[: len(a)], at[len(a) :]
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return node, node[label]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _contract(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            node, root = roots(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)))
            return pa.record_batch([pa.array(node), pa.array(root)], names=["node", "root"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= chunk:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run


def components(edges: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node reachable.

    Each task contracts its edges by union-find, ``chunk`` at a time, and names
    each node's local root.  A node thus has one row for each chunk it is in,
    however many edges it has, so a hub is no hot key.  Where a node's roots
    differ, they are the edges of the next, smaller level; it goes on until all
    agree, and roots are then handed back down.  Each level is a table in the
    shared folder.  Null ends are no edges; loops only make their node appear.
    """
    spark = edges.sparkSession
    now = stored(spark, edges.filter("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges")
    levels = []
    while True:
        local = now.mapInArrow(_contract(chunk), "node long, root long")
        named = stored(spark, local.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("all")), "named")
        discard(now)
        levels.append(named)
        now = stored(spark, named.filter(F.size("all") > 1).select(F.explode("all").alias("a"), F.col("root").alias("b")).filter("a <> b"), "edges")
        if now.isEmpty():
            discard(now)
            break
    out = levels.pop().select("node", "root")
    while levels:
        low, high = levels.pop(), out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = stored(spark, low.select("node", "root").join(high, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    return out

"""MinHash near-dedup: one-permutation hashing, bands, star edges, exact confirmation.

1. Each text becomes its set of word shingles (64-bit hashes).  Texts with
   equal sets are one from here on.
2. One hash of each shingle picks a bin and a value; the least value of a bin
   is its sketch entry and empty bins borrow from full ones (optimal
   densification), so a sketch costs one pass however many bins it has.
3. Each band of a sketch is a bucket.  A bucket of ``n`` gives ``n - 1``
   candidate edges, from its smallest member to the others.  The components of
   all candidate edges are clusters: sets that ever shared a bucket are in one.
4. Within a cluster links are confirmed on full sets.  Sets that share buckets
   with many others come first; each set that is not yet in a class is compared
   with all, then each that is not in the largest class.  Two sets of the
   largest class need no comparison, every other pair has one: no link between
   classes is lost, and a group of ``n`` near copies costs ``n`` comparisons.  Clusters
   above ``local`` shingles are compared part by part, each pair of parts in a group
   of its own.
5. Where the largest class of such a cluster leaves over so much that the cluster
   would travel more often than its sets have buckets, what is left over is compared
   inside its buckets instead, as each link shares one: a chain of unlike sets
   then costs the sum of its buckets, not the product of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components, roots
from .tables import bitmap, bits_for, discard, read, stored

U = np.uint64
BINS, BANDS = 128, 32


def densify(bins: np.ndarray, empty: int) -> np.ndarray:
    """Fill the empty bins of each row from full ones, by a fixed probe order of each bin."""
    full = bins != empty
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    out, probe = bins.copy(), 0
    width = U(bins.shape[1])
    while len(rows):
        probe += 1
        source = (K.mix(cols.astype(U) * U(0x9E3779B97F4A7C15) + U(probe)) % width).astype(np.int64)
        hit = full[rows, source]
        out[rows[hit], cols[hit]] = bins[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def sketch(value: np.ndarray, row: np.ndarray, n_rows: int, bins: int = BINS) -> np.ndarray:
    """The (rows, bins) sketch of sets given as values with their rows."""
    empty = (1 << 48) - 1
    out = np.full((n_rows, bins), empty, np.int64)
    h = K.mix(value)
    cell = row.astype(np.int64) * bins + (h % U(bins)).astype(np.int64)
    least = (h >> U(17)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    if len(order):
        cell, least = cell[order], least[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        out.reshape(-1)[cell[first]] = np.minimum.reduceat(least, first)
    return densify(out, empty)


def bands(sketches: np.ndarray, n: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band, the band's number included."""
    rows, bins = sketches.shape
    parts = sketches.astype(U).reshape(rows, n, bins // n)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=U), (rows, n)).copy()
    for j in range(bins // n):
        key = K.mix(key * U(0xD1342543DE82EF95) + parts[:, :, j])
    return key.astype(np.int64)


def sets(texts, k: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, int]]:
    """Row slices of a column with the distinct shingles of their rows."""
    for rows, data, offs in K.chunks(texts):
        data = K.LOWER[data]
        start, end, row = K.spans(data, offs)
        value, of, _ = K.shingles(K.hashes(data, start, end), row, len(offs) - 1, k)
        yield rows, *K.distinct(value, of), len(offs) - 1


def signatures(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, n_shingles, a 128-bit digest of the set (h1, h2) and its bands."""

    def run(batches):
        for batch in batches:
            for rows, value, row, n in sets(batch.column(1), k):
                size = np.bincount(row, minlength=n)
                first = np.cumsum(size) - size
                total = lambda x: np.r_[U(0), np.cumsum(x)]
                digests = []
                for salt in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
                    run_ = total(K.mix(value ^ U(salt)))
                    digests.append(K.mix(run_[first + size] - run_[first] + size.astype(U)).astype(np.int64))
                keys = bands(sketch(value, row, n))
                yield pa.record_batch(
                    [batch.column(0).slice(rows.start, n), pa.array(size.astype(np.int64)), *map(pa.array, digests), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))],
                    names=[key, "n_shingles", "h1", "h2", "bands"],
                )

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_shingles long, h1 long, h2 long, bands array<long>")


class Classes:
    """Union-find over 0 .. n-1 with the size of each class."""

    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            if self.size[i] < self.size[j]:
                i, j = j, i
            self.up[j] = i
            self.size[i] += self.size[j]


class Sets:
    """Sorted sets, one after another in ``value``, that queries are compared with."""

    def __init__(self, value: np.ndarray, size: np.ndarray):
        self.value, self.size, self.first = value, size, np.cumsum(size) - size
        self.kinds, self.at = np.unique(value, return_inverse=True)

    def one(self, i: int) -> np.ndarray:
        return self.value[self.first[i] : self.first[i] + self.size[i]]

    def like(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Which sets have 100 * intersection >= percent * union with the sorted ``query``."""
        at = np.minimum(np.searchsorted(self.kinds, query), len(self.kinds) - 1)
        met = np.zeros(len(self.kinds), np.int8)
        met[at[self.kinds[at] == query]] = 1
        both = np.add.reduceat(met[self.at], self.first, dtype=np.int64)
        return np.flatnonzero(100 * both >= percent * (self.size + len(query) - both))


def classes(value: np.ndarray, size: np.ndarray, score: np.ndarray, percent: int) -> list[int]:
    """The class (root) of each set of a cluster; ``value`` holds the sorted sets one after another."""
    n, every = len(size), Sets(value, size)
    found = Classes(n)

    def ask(i: int) -> None:
        for j in every.like(every.one(i), percent):
            found.join(i, int(j))

    rest = []
    for i in np.argsort(-score, kind="stable").tolist():
        if found.size[found.root(i)] == 1:
            ask(i)
        else:
            rest.append(i)
    largest = max(range(n), key=lambda i: found.size[found.root(i)])
    for i in rest:
        if found.root(i) != found.root(largest):
            ask(i)
    return [found.root(i) for i in range(n)]


def full_sets(df: DataFrame, key: str, text: str, k: int, only=None) -> DataFrame:
    """key and the sorted shingles of each row; of rows whose key is in the bitmap ``only`` if one is given."""
    sent = None if only is None else df.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        for batch in batches:
            keep = batch if sent is None else batch.filter(pa.array(sent.value.has(K.mix(batch.column(0).to_numpy().view(U)))))
            for rows, value, row, n in sets(keep.column(1), k):
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32)
                yield pa.record_batch([keep.column(0).slice(rows.start, n), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.int64)))], names=[key, "grams"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, grams array<long>")


def _unsigned(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).view(U), np.diff(column.offsets.to_numpy())


def _near(percent: int):
    """(node, root) of the sets of one cluster ``rep, score, grams``; the root is the smallest of a class."""

    def near(table: pa.Table) -> pa.Table:
        value, size = _unsigned(table.column("grams"))
        rep = table.column("rep").to_numpy()
        root = classes(value, size, table.column("score").to_numpy(), percent)
        least: dict[int, int] = {}
        for r, c in zip(rep.tolist(), root):
            least[c] = min(least.get(c, r), r)
        return pa.table({"node": rep, "root": pa.array([least[c] for c in root], pa.int64())})

    return near


def link(members: DataFrame, texts: DataFrame, buckets: DataFrame, percent: int, local: int, block: int) -> DataFrame:
    """(node, root) of the sets ``rep, cluster, score, n_shingles`` with full sets ``rep, grams`` and ``rep, bucket``; roots are the smallest of their class."""
    spark = members.sparkSession
    weight = members.groupBy("cluster").agg(F.sum("n_shingles").alias("w"))
    giant = stored(spark, weight.filter(F.col("w") > local), "giants")
    sized = members.hint("merge").join(texts.hint("merge"), "rep")
    if giant.isEmpty():
        return sized.groupBy("cluster").applyInArrow(_near(percent), "node long, root long")
    sized = stored(spark, sized, "sets")
    small = sized.join(giant, "cluster", "left_anti").groupBy("cluster").applyInArrow(_near(percent), "node long, root long")
    # The centre of each giant cluster against all its members, then what it leaves against all.
    large = sized.join(giant, "cluster")
    centre = members.join(giant, "cluster", "left_semi").groupBy("cluster").agg(F.max_by("rep", F.struct("score", -F.col("rep"))).alias("rep"))
    first = stored(spark, compare(large, large.join(centre, ["cluster", "rep"], "left_semi"), percent, block), "links")
    inside = first.filter("node <> root").select(F.col("node").alias("rep")).union(centre.select("rep"))
    left = large.join(inside, "rep", "left_anti")
    wide = left.groupBy("cluster").agg(F.sum("n_shingles").alias("w")).filter(F.col("w") > F.lit(BANDS * block))
    wide = stored(spark, wide.select("cluster"), "wide")
    if wide.isEmpty():
        every = first.unionByName(compare(large, left, percent, block))
    else:
        narrow = compare(large.join(wide, "cluster", "left_anti"), left.join(wide, "cluster", "left_anti"), percent, block)
        spread = inside_buckets(large.join(wide, "cluster", "left_semi"), left.join(wide, "cluster", "left_semi"), buckets, percent, local, block)
        every = first.unionByName(narrow).unionByName(spread)
    return small.unionByName(components(every.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def inside_buckets(members: DataFrame, queries: DataFrame, buckets: DataFrame, percent: int, local: int, block: int) -> DataFrame:
    """Links (node, root) between each query and the members that share a bucket with it and are alike.

    A member travels once for each of its buckets that has a query.  Buckets of
    up to ``local`` shingles are dealt to groups of about as many, larger ones
    are compared part by part.
    """
    spark = members.sparkSession
    asked = queries.select("rep")
    used = buckets.join(asked, "rep", "left_semi").select("bucket").distinct()
    own = buckets.join(used, "bucket", "left_semi").select("rep", F.col("bucket").alias("cluster")).join(members.select("rep", "score", "n_shingles"), "rep")
    own = stored(spark, own, "shared")
    weight = stored(spark, own.groupBy("cluster").agg(F.sum("n_shingles").alias("w")), "weights")
    total = weight.filter(F.col("w") <= local).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    own = own.join(weight, "cluster").hint("merge").join(members.select("rep", "grams").hint("merge"), "rep")
    near = _near(percent)

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("cluster").combine_chunks()
        cluster = table.column("cluster").to_numpy()
        ends = np.r_[np.flatnonzero(cluster[1:] != cluster[:-1]) + 1, len(cluster)]
        return pa.concat_tables([near(table.slice(s, e - s)) for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())])

    deal = F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-total // local))))
    light = own.filter(F.col("w") <= local).withColumn("deal", deal).groupBy("deal").applyInArrow(each, "node long, root long")
    heavy = own.filter(F.col("w") > local)
    return light.unionByName(compare(heavy, heavy.join(asked, "rep", "left_semi"), percent, block))


def compare(members: DataFrame, queries: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (node, root) between each query and the members of its cluster that are alike.

    Members and queries ``cluster, rep, w, grams`` are dealt to parts of about
    ``block`` shingles; each part of the queries meets each part of the members
    in a group of its own.  A group names the smallest node of its classes for
    each set, so its links are as many as its sets.
    """
    queries = stored(members.sparkSession, queries.select("cluster", "rep", "w", "grams"), "queries")
    deal = F.pmod(F.xxhash64("rep"), F.ceil(F.col("w") / F.lit(block))).cast("int")
    asked = queries.groupBy("cluster").agg(F.ceil(F.sum(F.size("grams")) / F.lit(block)).cast("int").alias("q"))
    own = members.select("cluster", "rep", "grams", deal.alias("part")).join(asked, "cluster").select("cluster", "rep", "grams", "part", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("ask"))
    parts = F.sequence(F.lit(0), F.ceil(F.col("w") / F.lit(block)).cast("int") - 1)
    ask = queries.join(asked, "cluster").select("cluster", "rep", "grams", F.pmod(F.xxhash64("rep"), F.col("q")).cast("int").alias("ask"), F.explode(parts).alias("part"))

    def meet(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not len(own) or not len(asked):
            return pa.table({"node": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        sets_, rep = Sets(*_unsigned(own.column("grams"))), own.column("rep").to_numpy()
        value, size = _unsigned(asked.column("grams"))
        of, a, b, held = asked.column("rep").to_numpy(), [rep], [rep], 0
        for r, f, s in zip(of.tolist(), (np.cumsum(size) - size).tolist(), size.tolist()):
            hit = rep[sets_.like(value[f : f + s], percent)]
            a.append(np.full(len(hit), r, np.int64))
            b.append(hit)
            held += len(hit)
            if held > 1 << 20:  # as few links as there are sets say the same
                node, root = roots(np.concatenate(a), np.concatenate(b))
                a, b, held = [node], [root], 0
        node, root = roots(np.concatenate(a), np.concatenate(b))
        return pa.table({"node": node, "root": root})

    by = ("cluster", "part", "ask")
    return ask.groupBy(*by).cogroup(own.groupBy(*by)).applyInArrow(meet, "node long, root long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, local: int = 100_000, block: int = 500_000) -> DataFrame:
    """key, n_shingles, component_id and kept for each row.

    Rows are linked when 100 * intersection >= ``percent`` * union of their
    sets of ``k``-word shingles; component_id is the smallest key reachable.
    Null, empty and blank texts have no shingles and no links.  ``key`` is a
    whole number; rows with a null key are left out, rows that repeat a key
    are kept and share a class through it when their sets are equal.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("body")).filter("rep is not null")
    signs = stored(spark, signatures(docs, "rep", "body", k), "signs")
    unique = signs.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("rep").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"))
    unique = stored(spark, unique, "unique")
    hits = unique.select("rep", F.explode("bands").alias("bucket"))
    buckets = hits.groupBy("bucket").agg(F.min("rep").alias("least"), F.count("*").alias("n")).filter("n > 1")
    shared = hits.hint("merge").join(buckets.hint("merge"), "bucket")
    stars = stored(spark, shared.groupBy("rep", "least").agg(F.sum("n").alias("n")), "stars")
    score = stars.groupBy("rep").agg(F.sum("n").cast("double").alias("score"))
    cluster = components(stars.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    members = cluster.select(F.col("node").alias("rep"), F.col("root").alias("cluster")).join(score, "rep").join(unique.select("rep", "n_shingles"), "rep")
    members = stored(spark, members, "members")
    discard(stars)
    bits = bits_for(members.count())
    if bits:
        only = bitmap(members.select("rep"), lambda b: K.mix(b.column(0).to_numpy().view(U)), bits)
        texts = full_sets(docs, "rep", "body", k, only)
    else:  # more than a bitmap of bounded size can tell apart
        texts = full_sets(docs.join(members.select("rep"), "rep", "left_semi"), "rep", "body", k)
    links = stored(spark, link(members, texts, shared.select("rep", "bucket"), percent, local, block), "classes").filter("node <> root")
    links = links.groupBy(F.col("node").alias("rep")).agg(F.min("root").alias("root"))
    named = unique.join(links, "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("component_id"), "copies", "root")
    named = named.filter("copies > 1 or root is not null").drop("copies", "root")
    out = signs.select("rep", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "rep")).otherwise(F.col("rep"))
    return out.select(F.col("rep").alias(key), "n_shingles", component.alias("component_id"), (component == F.col("rep")).alias("kept"))


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by two-word shingles at 80 %."""
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)

"""VLAD and Fisher vectors over descriptor tables.

Descriptors are rows (image_id, desc_id, v).  A codebook or mixture has a size
bounded by its number of components, which is checked; it travels as one row of
arrays, so a nearest centre costs no row explosion and no shuffle.  Residual and
Fisher sums are made by numpy where the descriptors are, and only these sums
are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Components that a codebook or mixture may have to be sent to all tasks.
MOST = 4096


def _packed(model: DataFrame, fields: list[str]) -> DataFrame:
    """One row with all components, in the order of k; an error beyond ``MOST``."""
    one = model.agg(F.array_sort(F.collect_list(F.struct("k", *fields))).alias("model"))
    fail = F.raise_error(F.lit(f"more than {MOST} components")).cast(one.schema["model"].dataType)
    return F.broadcast(one.select(F.when(F.size("model") > MOST, fail).otherwise(F.col("model")).alias("model")))


def _components(model: DataFrame) -> list:
    """The rows of a model in the order of k; ValueError beyond ``MOST``."""
    rows = model.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} components")
    return sorted(rows, key=lambda r: r.k)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _added(partial: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """The sum of the arrays ``row`` for each key."""

    def add(table: pa.Table) -> pa.Table:
        row = sum(c.flatten().to_numpy().reshape(len(c), -1).sum(0) for c in table["row"].chunks)
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "row": pa.array([row])})

    return partial.groupBy(*keys).applyInArrow(add, schema)


def nearest(descriptors: DataFrame, codebook: DataFrame) -> DataFrame:
    """Each descriptor with the nearest centre: k, c, dist (squared); ties go to the lowest k."""
    best = F.array_min(F.transform("model", lambda m: F.struct(V.distance2(F.col("v"), m.c).alias("dist"), m.k.alias("k"), m.c.alias("c"))))
    return descriptors.crossJoin(_packed(codebook, ["c"])).withColumn("best", best).drop("model").select("*", "best.k", "best.c", "best.dist").drop("best")


def vlad(descriptors: DataFrame, codebook: DataFrame, dim: int, power: float = 0.5, order: float = 2, eps: float = V.EPS) -> DataFrame:
    """Rows (image_id, k, row): residual sums of each non-empty cluster, power and row normalised.

    Descriptors without an image or a vector take no part.
    """
    book = _components(codebook)
    schema = f"image_id {descriptors.schema['image_id'].dataType.simpleString()}, k long, row array<double>"
    ks, centres = np.array([r.k for r in book], np.int64), np.array([r.c for r in book], float).reshape(-1, dim)
    step = max(1, (1 << 21) // max(1, centres.size))

    def sums(batches):
        for b in batches:
            ids, x = b.column("image_id").to_numpy(), _vectors(b)
            if not len(ids) or not len(ks):
                continue
            own = np.concatenate([((x[i : i + step, None] - centres) ** 2).sum(2).argmin(1) for i in range(0, len(x), step)])
            by = np.lexsort((own, ids))
            first = np.flatnonzero(np.r_[True, (ids[by[1:]] != ids[by[:-1]]) | (own[by[1:]] != own[by[:-1]])])
            row = np.add.reduceat((x - centres[own])[by], first)
            yield pa.record_batch([pa.array(ids[by[first]]), pa.array(ks[own[by[first]]]), pa.array(list(row))], names=["image_id", "k", "row"])

    asked = descriptors.filter("image_id is not null and v is not null").select("image_id", F.col("v").cast("array<double>").alias("v"))
    total = _added(asked.mapInArrow(sums, schema), ["image_id", "k"], schema)
    powered = F.transform("row", lambda z: V.sign_power(z, power))
    return total.select("image_id", F.col("k").cast(codebook.schema["k"].dataType), V.lp_normalize(powered, order, eps).alias("row"))


def flat(rows: DataFrame, codebook: DataFrame, dim: int) -> DataFrame:
    """One vector of K * dim values for each image; empty clusters are zeros."""
    have = rows.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "row"))).alias("m"))
    ks = codebook.agg(F.array_sort(F.collect_list("k")).alias("ks"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return have.crossJoin(F.broadcast(ks)).select("image_id", F.flatten(F.transform("ks", lambda k: F.coalesce(F.element_at("m", k), zero))).alias("vector"))


def mean_residual(descriptors: DataFrame, codebook: DataFrame, dim: int) -> DataFrame:
    """Rows (image_id, k, row): mean residuals, for the dot similarity."""
    residual = nearest(descriptors, codebook).select("image_id", "k", F.zip_with("v", "c", lambda x, c: x - c).alias("r"))
    return residual.groupBy("image_id", "k").agg(F.array(*[F.avg(F.col("r")[i]) for i in range(dim)]).alias("row"))


def row_similarity(rows: DataFrame) -> DataFrame:
    """(a, b, dot) summed over the clusters that both images have."""
    left, right = rows.select(F.col("image_id").alias("a"), "k", F.col("row").alias("x")), rows.select(F.col("image_id").alias("b"), "k", F.col("row").alias("y"))
    return left.join(right, "k").filter("a < b").groupBy("a", "b").agg(F.sum(V.dot(F.col("x"), F.col("y"))).alias("dot"))


def pairs(vectors: DataFrame, by: str | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """(a, b, cos) of all pairs a < b, or of those with equal ``by``; a zero vector gives 0.

    Vectors are dealt to blocks of about ``block_bytes``, at most 1024 vectors,
    and each pair of blocks is a matrix product in a task of its own.  Rows
    without an id, a vector or a group have no pairs.
    """
    rows = vectors.select("image_id", "vector", (F.col(by) if by else F.lit(0)).alias("g")).filter("image_id is not null and vector is not null and g is not null")
    most = F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(F.lit(block_bytes) / F.nullif(8 * F.max(F.size("vector")), F.lit(0)))))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    rows = rows.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("image_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("g", "image_id", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def run(table: pa.Table) -> pa.Table:
        ids, block = table["image_id"].to_numpy(), table["block"].to_numpy()
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["vector"].chunks]).reshape(len(ids), -1)
        length = np.sqrt((v * v).sum(1))
        unit = v / np.where(length > 0, length, 1)[:, None]
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
        cos = unit[x] @ unit[y].T
        left, right = ids[x][:, None], ids[y]
        i, j = np.nonzero(left < right if low == high else left != right)
        a, b = ids[x[i]], ids[y[j]]
        out = {"a": np.minimum(a, b), "b": np.maximum(a, b), "g": table["g"].combine_chunks().take(pa.array(np.zeros(len(a), np.int64))), "cos": cos[i, j]}
        return pa.table(out)

    types = vectors.schema["image_id"].dataType.simpleString(), rows.schema["g"].dataType.simpleString()
    out = rows.groupBy("g", "low", "high").applyInArrow(run, f"a {types[0]}, b {types[0]}, g {types[1]}, cos double")
    return out.select("a", "b", *([F.col("g").alias(by)] if by else []), "cos")


def posterior(descriptors: DataFrame, gmm: DataFrame) -> DataFrame:
    """Rows (image_id, desc_id, v, g) with g an array of (k, gamma): soft assignment in log space."""
    # Of the log density: what does not depend on the descriptor is computed once for the model.
    model = gmm.select("k", "w", "mu", "var", (F.log("w") - 0.5 * V.total(F.transform("var", lambda s: F.log(F.lit(2 * 3.141592653589793) * s)))).alias("c"))
    far = lambda m: V.total(F.transform(F.arrays_zip(F.col("v"), m.mu, m["var"]), lambda t: (t.v - t.mu) * (t.v - t.mu) / t["var"]))
    log = F.transform("model", lambda m: m.c - 0.5 * far(m))
    gamma = V.let(log, lambda l: V.let(F.array_max(l), lambda top: V.let(F.transform(l, lambda x: F.exp(x - top)), lambda e: V.let(V.total(e), lambda t: F.transform(e, lambda x: x / t)))))
    with_g = descriptors.crossJoin(_packed(model, ["w", "mu", "var", "c"])).withColumn("gamma", gamma)
    both = F.zip_with("model", "gamma", lambda m, g: F.struct(m.k.alias("k"), g.alias("gamma")))
    return with_g.select("image_id", "desc_id", "v", both.alias("g"))


def fisher(descriptors: DataFrame, gmm: DataFrame, dim: int, power: float = 0.5, order: float = 2, eps: float = V.EPS, means_only: bool = False) -> DataFrame:
    """(image_id, vector) of 2KD + K values: weights, means, variances by k; power then global normalisation.

    ``means_only`` gives the gradient of the means alone (KD values).
    Descriptors without an image or a vector take no part.
    """
    model = _components(gmm)
    k = len(model)
    w = np.array([r.w for r in model], float)
    mu, var = (np.array([r[c] for r in model], float).reshape(k, dim) for c in ("mu", "var"))
    fixed = np.log(w) - 0.5 * np.log(2 * np.pi * var).sum(1)
    step = max(1, (1 << 21) // max(1, mu.size))

    def gammas(x: np.ndarray) -> np.ndarray:
        log = np.concatenate([fixed - 0.5 * ((x[i : i + step, None] - mu) ** 2 / var).sum(2) for i in range(0, len(x), step)])
        e = np.exp(log - log.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def sums(batches):
        for b in batches:
            ids, x = b.column("image_id").to_numpy(), _vectors(b)
            if not len(ids) or not k:
                continue
            by = np.argsort(ids, kind="stable")
            ids, x = ids[by], x[by]
            g, ends = gammas(x), np.r_[np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                one = np.concatenate([[e - s], g[s:e].sum(0), (g[s:e].T @ x[s:e]).ravel(), (g[s:e].T @ (x[s:e] * x[s:e])).ravel()])
                yield pa.record_batch([pa.array(ids[s : s + 1]), pa.array([one])], names=["image_id", "row"])

    def gradient(batches):
        for b in batches:
            for i in range(b.num_rows):
                s = b.column("row")[i].values.to_numpy()
                s = s[1:] / s[0]
                s0, s1, s2 = s[:k, None], s[k : k + k * dim].reshape(k, dim), s[k + k * dim :].reshape(k, dim)
                m = (s1 - s0 * mu) / (np.sqrt(w)[:, None] * np.sqrt(var))
                v = (-s2 - s0 * mu * mu + s0 * var + 2 * s1 * mu) / (np.sqrt(2 * w)[:, None] * var)
                raw = m.ravel() if means_only else np.concatenate([(s[:k] - w) / np.sqrt(w), m.ravel(), v.ravel()])
                yield pa.record_batch([b.column("image_id").slice(i, 1), pa.array([raw])], names=["image_id", "row"])

    schema = f"image_id {descriptors.schema['image_id'].dataType.simpleString()}, row array<double>"
    asked = descriptors.filter("image_id is not null and v is not null").select("image_id", F.col("v").cast("array<double>").alias("v"))
    raw = _added(asked.mapInArrow(sums, schema), ["image_id"], schema).mapInArrow(gradient, schema)
    return raw.select("image_id", V.lp_normalize(F.transform("row", lambda z: V.sign_power(z, power)), order, eps).alias("vector"))

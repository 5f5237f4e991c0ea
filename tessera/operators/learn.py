"""Learners: k-means, diagonal Gaussian mixtures and PCA through the Gram matrix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Images, or positions where images outnumber them, of which a square matrix may be made on the driver.
MOST_ROWS = 4096


def kmeans(descriptors: DataFrame, k: int, seed: int = 42, feature: str = "sift", max_iter: int = 20) -> DataFrame:
    """A codebook (k, c, feature) of ``descriptors(v)``."""
    if k < 2:
        raise ValueError("a codebook has at least two centres")
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="f").fit(descriptors.select(array_to_vector("v").alias("f")))
    rows = [(i, [float(x) for x in c], feature) for i, c in enumerate(model.clusterCenters())]
    return descriptors.sparkSession.createDataFrame(rows, "k int, c array<double>, feature string")


def gmm(descriptors: DataFrame, k: int, seed: int = 42, iterations: int = 20, floor: float = 1e-6, tolerance: float = 1e-3) -> DataFrame:
    """A mixture (k, w, mu, var) with diagonal covariance, by expectation maximisation.

    Each step is one pass: tasks reduce their descriptors to K * (2 D + 1)
    sums, which the driver adds up.  Starts from the k-means codebook.
    """
    spark = descriptors.sparkSession
    centres = np.array([r.c for r in kmeans(descriptors, k, seed, max_iter=5).orderBy("k").collect()])
    data = descriptors.select("v").persist()  # read once for each step
    n, dim = data.count(), centres.shape[1]
    mean = data.agg(*[F.var_pop(F.col("v")[i]) for i in range(dim)]).first()
    w, mu, var = np.full(k, 1 / k), centres, np.tile(np.maximum(np.array(mean, float), floor), (k, 1))
    last = -math.inf
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast((w, mu, var))

        def sums(batches, sent=sent):
            w, mu, var = sent.value
            total = None
            for b in batches:
                x = np.array(b.column(0).flatten()).reshape(len(b.column(0)), -1)
                if not len(x):
                    continue
                log = np.log(w) - 0.5 * (np.log(2 * np.pi * var).sum(1) + (x * x) @ (1 / var).T - 2 * x @ (mu / var).T + (mu * mu / var).sum(1))
                top = log.max(1, keepdims=True)
                like = top + np.log(np.exp(log - top).sum(1, keepdims=True))
                g = np.exp(log - like)
                part = np.concatenate([g.sum(0), (g.T @ x).ravel(), (g.T @ (x * x)).ravel(), [like.sum()]])
                total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

        s = np.sum([r.s for r in data.mapInArrow(sums, "s array<double>").collect()], axis=0)  # a row for each task
        s0, s1, s2 = np.maximum(s[:k], 1e-12), s[k : k + k * dim].reshape(k, dim), s[k + k * dim : -1].reshape(k, dim)
        w, mu = s0 / n, s1 / s0[:, None]
        var = np.maximum(s2 / s0[:, None] - mu * mu, floor)
        if abs(s[-1] / n - last) < tolerance:
            break
        last = s[-1] / n
    data.unpersist()
    rows = [(i, float(w[i]), mu[i].tolist(), var[i].tolist()) for i in range(k)]
    return spark.createDataFrame(rows, "k int, w double, mu array<double>, var array<double>")


def standardized(vectors: DataFrame) -> DataFrame:
    """(image_id, pos, z): each position less its mean, over its population deviation; null where that is 0."""
    long = vectors.select("image_id", F.posexplode("vector").alias("pos", "v"))
    stats = long.groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return long.join(stats, "pos").select("image_id", "pos", ((F.col("v") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("z"))


def pca(vectors: DataFrame, components: int) -> DataFrame:
    """(image_id, scores) of standardised vectors, by the smaller of the Gram matrix of images and the covariance of positions.

    ValueError for more components than images or positions, or where both
    are above ``MOST_ROWS``, as the driver could hold neither matrix.
    """
    n = vectors.count()
    width = vectors.select(F.size("vector")).first()
    if width is None or not 1 <= components <= min(n, width[0]):
        raise ValueError("components must be between 1 and the lesser of images and positions")
    if min(n, width[0]) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} images and positions")
    if n > width[0]:
        return _by_covariance(vectors, width[0], components)
    z = standardized(vectors).filter("z is not null")
    a, b = z.select("pos", F.col("image_id").alias("i"), F.col("z").alias("x")), z.select("pos", F.col("image_id").alias("j"), F.col("z").alias("y"))
    gram = a.join(b, "pos").filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("g")).toPandas()
    ids = np.array(sorted(r.image_id for r in vectors.select("image_id").collect()))
    m = np.zeros((n, n))
    i, j = np.searchsorted(ids, gram["i"]), np.searchsorted(ids, gram["j"])
    m[i, j] = m[j, i] = gram["g"]
    value, vector = np.linalg.eigh(m)
    top = np.argsort(-value)[:components]
    u = vector[:, top] * np.sqrt(np.maximum(value[top], 0))
    u *= np.where(np.take_along_axis(u, np.abs(u).argmax(0)[None], 0) < 0, -1, 1)
    return vectors.sparkSession.createDataFrame([(int(d), r.tolist()) for d, r in zip(ids, u)], "image_id long, scores array<double>")


def _by_covariance(vectors: DataFrame, width: int, components: int) -> DataFrame:
    """Scores through the covariance: tasks add up z'z of their images, so nothing that grows with them reaches the driver."""
    spark = vectors.sparkSession
    one = vectors.select("image_id", F.col("vector").cast("array<double>").alias("vector"))
    stats = one.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("pos").toPandas()
    mean, spread = stats["m"].to_numpy(), stats["s"].to_numpy()
    scale = spark.sparkContext.broadcast((mean, np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0)))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return (batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width) - scale.value[0]) * scale.value[1]

    def sums(batches):
        total = np.zeros((width, width))
        for b in batches:
            z = matrix(b)
            total += z.T @ z
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(list(total))], names=["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        row = sum(c.flatten().to_numpy().reshape(len(c), width).sum(0) for c in table["row"].chunks)
        return pa.table({"i": table["i"].slice(0, 1), "row": pa.array([row])})

    made = one.mapInArrow(sums, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>")
    value, vector = np.linalg.eigh(np.array([r.row for r in made.orderBy("i").collect()]))
    top = vector[:, np.argsort(-value)[:components]]

    def scores(axes: np.ndarray) -> DataFrame:
        def run(batches):
            for b in batches:
                yield pa.record_batch([b.column("image_id"), pa.array(list(matrix(b) @ axes), pa.list_(pa.float64()))], names=["image_id", "scores"])

        return one.mapInArrow(run, "image_id long, scores array<double>")

    signs = scores(top).agg(*[F.max_by(F.col("scores")[c], F.abs(F.col("scores")[c])) for c in range(components)]).first()
    return scores(top * np.where(np.array(signs) < 0, -1, 1))


def training_matrix(features: dict[str, DataFrame], sizes: tuple[int, ...] = (32, 64, 128, 256), seed: int = 42):
    """Yield (feature, kind, k, model) for each feature table, both learners and all sizes; features are read once."""
    for name, table in features.items():
        kept = table.persist()
        try:
            for k in sizes:
                yield name, "kmeans", k, kmeans(kept, k, seed, name)
                yield name, "gmm", k, gmm(kept, k, seed)
        finally:
            kept.unpersist()

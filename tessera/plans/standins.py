"""How the supplied tables stand in for images, descriptors and masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import distance2, doubles
from ..operators.pixels import map_images

DIM, CENTRES, SIDE = 64, 8, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten consecutive vectors are the descriptors of an image."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("image_id"), F.col("vec_id").alias("desc_id"), doubles(F.col("embedding")).alias("v"), "label")


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vectors as centres."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < CENTRES).select(F.col("vec_id").cast("int").alias("k"), doubles(F.col("embedding")).alias("c"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component for each label."""
    d = descriptors(spark, sf_dir)
    x = [F.col("v")[i] for i in range(DIM)]
    own = d.groupBy(F.col("label").alias("k")).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("mu"), F.array(*[F.var_pop(c) for c in x]).alias("var"))
    return own.crossJoin(F.broadcast(d.agg(F.count("*").alias("all")))).select("k", (F.col("n") / F.col("all")).alias("w"), "mu", "var")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label): the label of the first descriptor."""
    return descriptors(spark, sf_dir).groupBy("image_id").agg(F.min_by("label", "desc_id").alias("label"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (image_id, y, x, v) of 40 by 40 grey tiles, each from 25 consecutive whole vectors, dealt by image."""
    e = table(spark, sf_dir, "embeddings")
    whole = e.withColumn("image_id", F.expr("vec_id div 25")).repartition("image_id").select("image_id", F.expr("vec_id % 25").alias("r"), F.posexplode("embedding").alias("i", "f"))
    at = F.col("r") * DIM + F.col("i")
    return whole.select("image_id", F.floor(at / SIDE).cast("int").alias("y"), (at % SIDE).cast("int").alias("x"), F.floor((F.col("f").cast("double") + 1) * 127.5).cast("double").alias("v"))


def tile_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in array form: image_id, height, width, nChannels, data, path, label; a last incomplete tile is filled up with black."""
    def full(table: pa.Table) -> pa.Table:
        data = np.zeros(SIDE * SIDE, np.uint8)
        data[table["y"].to_numpy() * SIDE + table["x"].to_numpy()] = table["v"].to_numpy()
        return pa.table({"image_id": table["image_id"].slice(0, 1), "data": pa.array([data.tobytes()], pa.binary())})

    rows = tiles(spark, sf_dir).groupBy("image_id").applyInArrow(full, "image_id long, data binary")
    return rows.select("image_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(1).alias("nChannels"), "data", F.concat(F.lit("tile/"), "image_id").alias("path"), F.lit("tile").alias("label"))


def large_tiles(spark: SparkSession, sf_dir: str, times: int = 5) -> DataFrame:
    """Tiles in array form, each pixel ``times`` by ``times``: 200 by 200, which MS-SSIM needs."""
    def one(row, image):
        yield {**row, "height": SIDE * times, "width": SIDE * times, "data": image.repeat(times, 0).repeat(times, 1).tobytes()}

    return map_images(tile_images(spark, sf_dir), one, "image_id long, height int, width int, nChannels int, data binary, path string, label string")


def large_truth(spark: SparkSession, sf_dir: str, times: int = 5) -> DataFrame:
    """(image_id, mask, cls) of the large tiles: class 1 everywhere, a byte for a pixel."""
    ids = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 25").alias("image_id")).distinct()
    return ids.select("image_id", F.array_repeat(F.lit(1).cast("byte"), (SIDE * times) ** 2).alias("mask"), F.lit(1).alias("cls"))


def classes(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.col("id").cast("int").alias("cls"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, cls, p): soft nearness of each vector to the label means; ten pixels in an image."""
    means = F.broadcast(mixture(spark, sf_dir).select(F.col("k").alias("cls"), "mu"))  # ten rows
    d = descriptors(spark, sf_dir).crossJoin(means).select("image_id", F.lit(0).alias("y"), F.expr("cast(desc_id % 10 as int)").alias("x"), "cls", F.exp(-F.round(distance2(F.col("v"), F.col("mu")), 6)).alias("e"))
    total = d.groupBy("image_id", "y", "x").agg(F.sum("e").alias("t"))
    return d.join(total, ["image_id", "y", "x"]).select("image_id", "y", "x", "cls", (F.col("e") / F.col("t")).alias("p"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptors(spark, sf_dir).select("image_id", F.lit(0).alias("y"), F.expr("cast(desc_id % 10 as int)").alias("x"), F.col("label").alias("truth"))

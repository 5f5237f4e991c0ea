"""Class masks: colours, predictions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rgb_to_class(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, y, x, cls) of pixels (r, g, b): exact colours, the last class of a colour wins, no match is 0."""
    last = palette.groupBy("r", "g", "b").agg(F.max("cls").alias("cls"))
    return pixels.join(F.broadcast(last), ["r", "g", "b"], "left").select("image_id", "y", "x", F.coalesce("cls", F.lit(0)).alias("cls"))


def class_to_rgb(mask: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b) of classes; unknown ones are black."""
    zero = F.lit(0)
    return mask.join(F.broadcast(palette.select("cls", "r", "g", "b")), "cls", "left").select("image_id", "y", "x", *[F.coalesce(c, zero).alias(c) for c in "rgb"])


def overlap(pixels: DataFrame, classes: DataFrame, ignore: tuple[int, ...] = ()) -> DataFrame:
    """Per image and class of the dimension: common, predicted and true pixels of rows (image_id, truth, pred)."""
    counts = pixels.groupBy("image_id", "truth", "pred").count()  # at most classes squared rows for an image
    both = counts.select("image_id", F.explode(F.array(F.struct(F.col("pred").alias("cls"), F.lit(1).alias("p"), F.lit(0).alias("t"), (F.col("pred") == F.col("truth")).cast("int").alias("i")), F.struct(F.col("truth").alias("cls"), F.lit(0).alias("p"), F.lit(1).alias("t"), F.lit(0).alias("i")))).alias("c"), "count").select("image_id", "c.*", "count")
    sums = both.groupBy("image_id", "cls").agg(*[F.sum(F.col(c) * F.col("count")).alias(c) for c in "ipt"])
    grid = pixels.select("image_id").distinct().crossJoin(F.broadcast(classes.select("cls").filter(~F.col("cls").isin(*ignore)) if ignore else classes.select("cls")))
    return grid.join(sums, ["image_id", "cls"], "left").fillna(0, list("ipt"))


def dice_macro(pixels: DataFrame, classes: DataFrame, ignore: tuple[int, ...] = (), eps: float = 1e-8) -> DataFrame:
    """Unweighted mean over all classes of 2I / (P + T + eps); a class in neither mask counts as 0."""
    return overlap(pixels, classes, ignore).groupBy("image_id").agg(F.avg(2.0 * F.col("i") / (F.col("p") + F.col("t") + F.lit(eps))).alias("dice"))


def iou_micro(pixels: DataFrame, classes: DataFrame, ignore: tuple[int, ...] = (), eps: float = 1e-6) -> DataFrame:
    """One ratio pooled over the classes: (I + eps) / (P + T - I + eps)."""
    i, p, t = F.sum("i"), F.sum("p"), F.sum("t")
    return overlap(pixels, classes, ignore).groupBy("image_id").agg(((i + F.lit(eps)) / (p + t - i + F.lit(eps))).alias("iou"))


def confidence(probabilities: DataFrame, truth: DataFrame) -> DataFrame:
    """(image_id, cls, confidence): mean probability of a class over its true pixels, 0 without any.

    ``probabilities`` are rows (image_id, y, x, cls, p), ``truth`` (image_id, y, x, truth).
    """
    joined = probabilities.join(truth, ["image_id", "y", "x"])
    mean = F.avg(F.when(F.col("truth") == F.col("cls"), F.col("p")))
    return joined.groupBy("image_id", "cls").agg(F.coalesce(mean, F.lit(0.0)).alias("confidence"))


def argmax(probabilities: DataFrame) -> DataFrame:
    """(image_id, y, x, pred): the most probable class, ties to the first."""
    return probabilities.groupBy("image_id", "y", "x").agg(F.max_by("cls", F.struct("p", -F.col("cls"))).alias("pred"))

"""Image trees as tables: ``{split}/{label}/{stem}.jpg`` with masks ``{split}_annotations/{label}/{stem}.png``.

Scans list files with Spark's own readers; pixels are decoded only by
:func:`decode`, so that listings never read image bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")
RETURN_TYPES = {
    "image": ["image_id", "path"],
    "image+mask": ["image_id", "path", "mask_path"],
    "image+label": ["image_id", "path", "label"],
    "image+mask+label": ["image_id", "path", "mask_path", "label"],
    "all": ["image_id", "split", "label", "path", "mask_path"],
}
#: Class index, name and colour.
CLASSES = [
    (0, "BACKGROUND", 0, 0, 0), (1, "BULLDOZER", 0, 183, 235), (2, "CAR", 255, 255, 0), (3, "CATERPILLAR", 0, 16, 235),
    (4, "CRANE", 199, 252, 0), (5, "CRUSHER", 255, 0, 140), (6, "DRILLER", 14, 122, 254), (7, "EXCAVATOR", 255, 171, 171),
    (8, "HUMAN", 254, 0, 86), (9, "ROLLER", 255, 0, 255), (10, "TRACTOR", 128, 128, 0), (11, "TRUCK", 134, 34, 255),
]


def classes(spark: SparkSession) -> DataFrame:
    """The class dimension: twelve rows."""
    return spark.createDataFrame(CLASSES, "cls int, name string, r int, g int, b int")


def checked_split(purpose: str) -> str:
    if purpose not in SPLITS:
        raise ValueError(f"purpose must be one of {SPLITS}")
    return purpose


def label_of(path: Column) -> Column:
    """The name of the folder that holds a file."""
    return F.element_at(F.split(path, "/"), -2)


def file_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mask_name(file: Column) -> Column:
    """Every ``.jpg`` in the name becomes ``.png``."""
    return F.replace(file, F.lit(".jpg"), F.lit(".png"))


def is_image(path: Column) -> Column:
    return path.endswith(".jpg")


def scan(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """path, label and file of each file below ``folder``; a missing folder is an AnalysisException."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", label_of(F.col("path")).alias("label"), file_of(F.col("path")).alias("file"))


def with_masks(images: DataFrame, masks: DataFrame | None, required: bool = True) -> DataFrame:
    """Images with the path of their mask, matched by label and file name.

    Without ``masks`` the path is null.  With ``required`` an image that has no
    mask is an error when its row is read.
    """
    if masks is None:
        return images.withColumn("mask_path", F.lit(None).cast("string"))
    found = masks.select(F.col("path").alias("mask_path"), F.col("label"), F.col("file").alias("_mask"))
    out = images.withColumn("_mask", mask_name(F.col("file"))).join(found, ["label", "_mask"], "left").drop("_mask")
    if required:
        lost = F.raise_error(F.concat(F.lit("no mask for "), F.col("path"))).cast("string")
        out = out.withColumn("mask_path", F.coalesce("mask_path", lost))
    return out


def missing_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    return images.withColumn("_mask", mask_name(F.col("file"))).join(masks.select("label", F.col("file").alias("_mask")), ["label", "_mask"], "left_anti").drop("_mask")


def numbered(images: DataFrame, order: str = "path", parts: int = 256) -> DataFrame:
    """All columns and ``image_id``, gapless by the order of paths; no single task sorts all rows.

    The bounds of the parts are fixed first, at the ``parts - 1`` paths of least
    hash, so a row's part does not depend on how Spark deals out rows.  Equal
    paths get numbers next to each other, null ones come first.
    """
    bounds = sorted({r[0] for r in images.filter(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(parts - 1).collect()})
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    ranged = images.withColumn("_part", part)
    before = ranged.groupBy("_part").count().select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each part
    row = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_row", row).join(F.broadcast(before), "_part").withColumn("image_id", (F.col("_before") + F.col("_row")).cast("long")).drop("_part", "_row", "_before")


def dataset(spark: SparkSession, root: str, purpose: str, with_annotations: bool = True) -> DataFrame:
    """The images of one split: image_id, split, label, path, mask_path."""
    purpose = checked_split(purpose)
    images = scan(spark, f"{root}/{purpose}")
    masks = scan(spark, f"{root}/{purpose}_annotations", "*.png") if with_annotations else None
    return numbered(with_masks(images, masks)).select("image_id", F.lit(purpose).alias("split"), "label", "path", "mask_path")


def project(images: DataFrame, return_type: str) -> DataFrame:
    if return_type not in RETURN_TYPES:
        raise ValueError(f"return_type must be one of {sorted(RETURN_TYPES)}")
    return images.select(*RETURN_TYPES[return_type])


def item(images: DataFrame, index: int) -> DataFrame:
    """The row with this number; ValueError for a slice, IndexError below 0 and past the end."""
    if isinstance(index, slice):
        raise ValueError("slices are not supported")
    found = images.filter(F.col("image_id") == index)
    if index < 0 or found.isEmpty():
        raise IndexError(f"no image has the number {index}")
    return found


def enum_lookup(rows: DataFrame, label: str, members: DataFrame) -> DataFrame:
    """``cls`` of the member with the upper-case label, null if there is none."""
    names = F.broadcast(members.select("cls", F.col("name").alias("_name")))  # the dimension has twelve rows
    return rows.join(names, F.upper(F.col(label)) == F.col("_name"), "left").drop("_name")


def class_required(rows: DataFrame, label: str, members: DataFrame) -> DataFrame:
    """As :func:`enum_lookup`, but an unknown label is an error."""
    lost = F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(label, F.lit("null")))).cast("int")
    return enum_lookup(rows, label, members).withColumn("cls", F.coalesce("cls", lost))


def decode(spark: SparkSession, paths: str | list[str], channel_order: str = "rgb") -> DataFrame:
    """path, height, width and pixel bytes of images; Spark decodes to BGR, ``rgb`` swaps the channels."""
    if channel_order not in ("rgb", "bgr"):
        raise ValueError("channel_order is rgb or bgr")
    rows = spark.read.format("image").option("dropInvalid", False).load(paths).select("image.*")
    if channel_order == "bgr":
        return rows.select("origin", "height", "width", "nChannels", "data")

    def swap(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            data = []
            for n, raw in zip(b.column("nChannels").to_pylist(), b.column("data").to_pylist()):
                data.append(np.frombuffer(raw, np.uint8).reshape(-1, n)[:, ::-1].tobytes() if n == 3 else raw)
            yield pa.record_batch([b.column("origin"), b.column("height"), b.column("width"), b.column("nChannels"), pa.array(data, pa.binary())], names=["origin", "height", "width", "nChannels", "data"])

    return rows.mapInArrow(swap, "origin string, height int, width int, nChannels int, data binary")


def synthetic(spark: SparkSession, low: float, high: float, n: int, seed: int = 42) -> DataFrame:
    """``n`` evenly spaced x with uniform y."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select((F.lit(float(low)) + F.col("id") * F.lit(step)).alias("x"), (F.lit(float(low)) + F.rand(seed) * F.lit(float(high - low))).alias("y"))

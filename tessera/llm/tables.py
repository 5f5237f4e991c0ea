"""Reading inputs and cutting lineage through tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import PROBES, U, Bitmap, places


#: Bytes of an Arrow batch, so that long texts do not add up to what a task can't hold.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches; a lower bound of the session stays."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH[0]))
    if size > BATCH[1]:
        spark.conf.set(*BATCH)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session of one machine names none (as in tests) a local folder is
    set; on a cluster that is a RuntimeError, as executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table survives lost executors and gives the planner real sizes.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored`; later reads of it fail."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def bits_for(n: int, most: int = 1 << 28) -> int:
    """Bits of a bitmap of ``n`` hashes, 32 or more for each, so that less than one other in 1000 is let through; 0 if that is above ``most`` (32 MB)."""
    bits = max(1 << 20, 1 << (32 * max(1, n) - 1).bit_length())
    return bits if bits <= most else 0


def bitmap(df: DataFrame, hashed, bits: int) -> Bitmap:
    """A bitmap of fixed size of the hashes that ``hashed`` makes of each Arrow batch of ``df``.

    Tasks or their words together; at most ``bits / 64`` words reach the driver.
    """

    def run(batches):
        for b in batches:
            value = hashed(b)
            h = np.unique(np.concatenate([places(value, p) for p in range(PROBES)]) & U(bits - 1))
            if len(h):
                word, first = np.unique(h >> U(6), return_index=True)
                yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(np.bitwise_or.reduceat(U(1) << (h & U(63)), first).astype(np.int64))], names=["word", "bits"])

    got = df.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, U)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U)
    return Bitmap(words)

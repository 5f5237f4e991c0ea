"""Results and models to files and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one part file for each partition; replaces what is there."""
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One text file with one JSON array, an object a line; rows stream through its one task, none are collected."""
    import pyarrow as pa

    def joined(batches):
        first = True
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                yield pa.record_batch([pa.array([("[" if first and not i else ",") + r for i, r in enumerate(rows)])], names=["value"])
                first = False
        yield pa.record_batch([pa.array(["[]" if first else "]"])], names=["value"])

    text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    text.coalesce(1).mapInArrow(joined, "value string").write.mode("overwrite").text(path)


def save_model(df: DataFrame, path: str) -> None:
    """A codebook, mixture or components as Parquet; replaces what is there."""
    df.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """A saved model; ValueError if it says that it is for another feature."""
    out = spark.read.parquet(path)
    if feature is not None and "feature" in out.columns:
        found = {r.feature for r in out.select("feature").distinct().take(2)}
        if found - {feature}:
            raise ValueError(f"the model is for {sorted(found)}, not for {feature}")
    return out

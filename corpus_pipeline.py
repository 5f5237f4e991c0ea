"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns
the columns of ``documents`` for what it keeps; the last adds tokens.  Nulls and
empty texts pass every stage.  A stage is judged on its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, lines, minhash, toxicity
from tessera.llm.tables import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are toxic with a probability of a half or more."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select(*COLUMNS), model, name="_toxic")
    return out.filter(F.col("_toxic") < 0.5).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that stand in an earlier document or place; drop documents that lose all their words by it."""
    out = lines.dedup_lines(docs.select(*COLUMNS), equal=1)
    blank = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"^[\x20\x09-\x0D]*$"))
    kept = out.filter((F.col("n_dropped") == 0) | ~blank)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate class (five-word shingles, 80 %)."""
    classes = minhash.near_duplicates(docs)
    gone = stored(spark, classes.filter(~F.col("kept")).select("doc_id"), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold 80 % of the five-word shingles of a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left; ids come with digests of them and of the decoded text."""
    return bpe.encode(docs, bpe.default_path(), [c for c in COLUMNS if c != "text"])


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return docs


#: A fitted classifier and MinHash classes are beyond SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None

"""The pipeline's filtering stages on nulls, blank texts, repeats, extra columns and no rows."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_odd_rows(spark):
    rows = [(10**9 + i, t, None, None, None) for i, t in enumerate([None, "", " \n", "some plain words here", "some plain words here", "z" * 300_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit(1)).withColumn("marks", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(r.doc_id - 10**9 for r in docs.collect()) == [0, 1, 2, 3, 5]  # the repeat lost its only line
    assert corpus_pipeline.line_dedup(spark, docs.limit(0), SF).count() == 0

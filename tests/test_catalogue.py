"""Every query with SQL agrees with DuckDB; the others give rows."""

import numbers

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import sweep
from tessera.plans import catalogue, standins

SF = "/root/testdata/sf0.001"
#: Long plans; the driver runs them too.
SLOW = {"dog", "fisher_long", "cosine_same_label"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if pd.isna(x) else (f"{float(x):.6f}" if isinstance(x, numbers.Number) else str(x)) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in catalogue.SQL if n not in SLOW])
def test_agrees_with_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["blur3", "sharpen", "resize_half", "dog"])
def test_agrees_with_sql_where_the_last_tile_is_incomplete(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 31").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["jpeg_variants", "ms_ssim", "pca_gram", "pair_records"])
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_pair_records_has_all_pairs_and_settings(spark):
    n = -(-spark.read.parquet(f"{SF}/embeddings.parquet").count() // 25)
    out = catalogue.QUERIES["pair_records"](spark, SF).select("image_i_path", "image_j_path", "sigma", "quality", "ssim_score", "ms_ssim_score").toPandas()
    assert len(out) == n * (n - 1) // 2 * 90 and not out.duplicated(["image_i_path", "image_j_path", "sigma", "quality"]).any()
    assert out.ms_ssim_score.notna().all() and out.ssim_score.between(-1, 1).all()


def test_per_image_records_joins_vectors_and_scores_of_all_images(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    out = catalogue.QUERIES["per_image_records"](spark, SF)
    scores = [f"{n}_{m}" for n in ("u_net", "deeplabv3") for m in ("confidence", "iou", "dice_score")]
    assert out.columns == ["path", "label", "type", "vlad_vector", "fisher_vector", *scores]
    rows_, k = out.collect(), e.select("label").distinct().count()
    assert {r.path for r in rows_} == {f"tile/{i}" for i in range(-(-e.count() // 25))} and len(rows_) == -(-e.count() // 25)
    assert all(len(r.vlad_vector) == 8 * 64 and len(r.fisher_vector) == 2 * k * 64 + k for r in rows_)
    assert all(0 <= r[s] <= 1 for r in rows_ for s in scores)


def test_masks_are_not_broadcast(spark):
    tiles = standins.large_tiles(spark, SF)
    truth = tiles.select("image_id", F.array_repeat(F.lit(1), F.col("height") * F.col("width")).alias("mask"), F.lit(1).alias("cls"))
    scores = sweep.predict(tiles, truth, {"net": sweep.stub_predictor()}, sigmas=None)
    assert "Broadcast" not in scores._jdf.queryExecution().executedPlan().toString()
    same = sweep.predict(tiles, standins.large_truth(spark, SF), {"net": sweep.stub_predictor()}, sigmas=None)
    assert same.orderBy("image_id").collect() == scores.orderBy("image_id").collect()


def test_similarity_heatmap_has_every_image(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    out = catalogue.QUERIES["similarity_heatmap"](spark, SF)
    assert out.count() == n * 10 and out.select("image_id").distinct().count() == n // 10

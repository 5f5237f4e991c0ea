"""Numeric kernels against small formulas, properties and error paths."""

import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import encode, jpeg, learn, masks, pixels, sift, ssim, sweep
from tessera.sources import images as I
from tessera.sources import settings, sinks

RNG = np.random.default_rng(3)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def lit(v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_vectors(spark):
    a, b = RNG.normal(size=5), RNG.normal(size=5)
    assert one(spark, V.cosine(lit(a), lit(b))) == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert one(spark, V.cosine(lit(a), lit(a * 0))) == 0
    assert one(spark, V.lp_normalize(lit(a), 1)) == pytest.approx(list(a / (np.abs(a).sum() + 1e-9)))
    assert one(spark, V.root_sift(lit(np.abs(a)))) == pytest.approx(list(np.sqrt(np.abs(a) / (np.abs(a).sum() + 1e-7))))
    assert one(spark, V.sign_power(F.lit(-4.0))) == -2
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            V.sign_power(F.lit(1.0), bad)
    with pytest.raises(ValueError):
        V.norm(lit(a), 0)
    with pytest.raises(Exception, match="longer"):
        one(spark, V.is_subset(F.array(F.lit(1), F.lit(1)), F.array(F.lit(1))))
    with pytest.raises(Exception, match="range"):
        one(spark, V.checked_range(F.lit(256.0), 0, 255))


def test_vlad_rows_have_at_most_length_one(spark):
    d = spark.createDataFrame([(i // 5, i, RNG.normal(size=4).tolist()) for i in range(20)], "image_id long, desc_id long, v array<double>")
    book = spark.createDataFrame([(k, RNG.normal(size=4).tolist()) for k in range(3)], "k int, c array<double>")
    for r in encode.vlad(d, book, 4).collect():
        assert np.linalg.norm(r.row) <= 1 + 1e-9
    gmm = learn.gmm(d.select("v"), 2)
    for r in encode.posterior(d, gmm).collect():
        assert sum(g.gamma for g in r.g) == pytest.approx(1)
    assert all(len(r.vector) == 2 * 2 * 4 + 2 for r in encode.fisher(d, gmm, 4).collect())
    with pytest.raises(ValueError):
        learn.kmeans(d, 1)


def test_mask_scores(spark):
    px = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 2, 2)], "image_id long, truth int, pred int")
    cls = spark.createDataFrame([(c,) for c in range(4)], "cls int")
    assert masks.dice_macro(px, cls).first().dice == pytest.approx((2 / 3 + 2 / 3) / 4)
    assert masks.iou_micro(px, cls).first().iou == pytest.approx((2 + 1e-6) / (4 + 1e-6))
    assert masks.iou_micro(px, cls, (1,)).first().iou == pytest.approx((1 + 1e-6) / (2 + 1e-6))


def test_pixel_kernels(spark):
    image = RNG.integers(0, 256, (8, 8)).astype(float)
    px = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(8) for x in range(8)], "image_id long, y int, x int, v double")
    dense = lambda df, n=8: np.array([r.v for r in df.orderBy("y", "x").collect()]).reshape(n, n)
    assert dense(pixels.blur(px, 2.0, 8, 8)) == pytest.approx(pixels.convolve(image, np.array(pixels.gaussian(3, 2.0))))
    pad = np.pad(image, 1, "reflect")
    near = sum(pad[i : i + 8, j : j + 8] for i in range(3) for j in range(3))
    assert dense(pixels.sharpen(px, 8, 8)) == pytest.approx(np.clip(10 * image - near, 0, 255))
    assert dense(pixels.resize(px, 8, 8, 4, 4), 4) == pytest.approx(ssim.pool(image, 2))
    wrapped = pixels.difference_of_gaussians(px, 1.6, 8, 8, octaves=1, wrap=True).filter("scale = 0")
    signed = pixels.difference_of_gaussians(px, 1.6, 8, 8, octaves=1).filter("scale = 0")
    assert 0 <= dense(wrapped).min() and dense(wrapped).max() <= 255
    assert (np.abs((dense(wrapped) - dense(signed) + 128) % 256 - 128) <= 1.01).all()
    for size, sigma in ((2, 1.0), (3, 0.0)):
        with pytest.raises(ValueError):
            pixels.gaussian(size, sigma)


def test_ssim():
    a, b = RNG.random((200, 200)), RNG.random((200, 200))
    assert ssim.ssim(a, a) == pytest.approx(1) and ssim.ms_ssim(a, a) == pytest.approx(1)
    assert abs(ssim.ssim(a, b)) < 0.1 < 0.9 < ssim.ssim(a, b, 255.0)
    with pytest.raises(ValueError):
        ssim.ms_ssim(a[:160], b[:160])


def test_jpeg_loses_less_at_higher_quality():
    image = np.clip(np.add.outer(np.arange(40), np.arange(48))[..., None] * [1, 2, 1] + RNG.integers(0, 20, (40, 48, 1)), 0, 255).astype(np.uint8)
    errors = [np.abs(jpeg.round_trip(image, q).astype(int) - image).mean() for q in (10, 50, 100)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 3
    assert (jpeg.round_trip(image, 1000) == jpeg.round_trip(image, 100)).all()


def test_sift_finds_a_blob_and_turns_with_the_image():
    y, x = np.mgrid[:64, :64]
    blob = np.exp(-((y - 30) ** 2 + (x - 26) ** 2) / 32) + 0.5 * np.exp(-((y - 36) ** 2 + (x - 34) ** 2) / 18)
    found = sift.detect(blob)
    assert any(abs(p["x"] - 26) < 3 and abs(p["y"] - 30) < 3 for p in found)
    turned = sift.detect(np.rot90(blob).copy())
    best = min(np.linalg.norm(np.array(p["v"]) - q["v"]) for p in found for q in turned)
    assert best < 250 and all(len(p["v"]) == 128 for p in found)
    assert sift.detect(np.zeros((64, 64))) == [] and sift.detect(np.zeros((8, 8))) == []


def test_pca_and_standardize(spark):
    m = RNG.normal(size=(6, 9))
    m[:, 3] = 1
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "image_id long, vector array<double>")
    assert learn.standardized(v).filter("pos = 3").filter("z is not null").count() == 0
    got = np.array([r.scores for r in learn.pca(v, 3).orderBy("image_id").collect()])
    z = np.delete(m, 3, 1)
    z = (z - z.mean(0)) / z.std(0)
    assert np.abs(got) == pytest.approx(np.abs(np.linalg.svd(z)[0][:, :3] * np.linalg.svd(z)[1][:3]), abs=1e-6)
    for bad in (0, 7):
        with pytest.raises(ValueError):
            learn.pca(v, bad)


def test_pca_of_more_images_than_positions(spark):
    m = RNG.normal(size=(40, 7)) * np.arange(1, 8)
    m[:, 2] = 5
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "image_id long, vector array<double>").repartition(3)
    got = np.array([r.scores for r in learn.pca(v, 3).orderBy("image_id").collect()])
    z = np.delete(m, 2, 1)
    u, s, _ = np.linalg.svd((z - z.mean(0)) / z.std(0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-6)
    assert all(c[np.abs(c).argmax()] > 0 for c in got.T)


def test_pairs_by_blocks_are_all_pairs(spark):
    m = RNG.normal(size=(30, 4))
    m[5] = 0
    v = spark.createDataFrame([(i, i % 3, r.tolist()) for i, r in enumerate(m)] + [(None, 0, [1.0] * 4), (99, None, None)], "image_id long, label int, vector array<double>")
    unit = m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    for by, block_bytes in ((None, 1), (None, 7 * 32), ("label", 4 * 32), ("label", 1 << 20)):
        got = encode.pairs(v, by, block_bytes).collect()
        want = {(a, b) for a in range(30) for b in range(a + 1, 30) if by is None or a % 3 == b % 3}
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
        assert all(r.cos == pytest.approx(unit[r.a] @ unit[r.b], abs=1e-12) for r in got)
        assert by is None or all(r.label == r.a % 3 for r in got)
    assert encode.pairs(v.limit(0)).count() == 0


def test_image_tree(spark, tmp_path):
    for label in ("car", "truck"):
        for folder, ext in (("train", "jpg"), ("train_annotations", "png")):
            (tmp_path / folder / label).mkdir(parents=True)
            for i in range(2):
                (tmp_path / folder / label / f"{i}.{ext}").write_bytes(b"x")
    (tmp_path / "train/car/notes.txt").write_bytes(b"x")
    found = I.dataset(spark, str(tmp_path), "train").orderBy("image_id").collect()
    assert [r.image_id for r in found] == [0, 1, 2, 3] and all(r.mask_path.endswith(r.path.rsplit("/", 1)[1].replace("jpg", "png")) for r in found)
    (tmp_path / "train_annotations/car/0.png").unlink()
    with pytest.raises(Exception, match="no mask"):
        I.dataset(spark, str(tmp_path), "train").collect()
    assert I.dataset(spark, str(tmp_path), "train", False).filter("mask_path is null").count() == 4
    with pytest.raises(ValueError):
        I.dataset(spark, str(tmp_path), "other")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        I.dataset(spark, str(tmp_path), "test").collect()
    rows = spark.createDataFrame([("car",), ("ship",)], "label string")
    assert {r.label: r.cls for r in I.enum_lookup(rows, "label", I.classes(spark)).collect()} == {"car": 2, "ship": None}
    with pytest.raises(Exception, match="unknown class"):
        I.class_required(rows, "label", I.classes(spark)).collect()
    with pytest.raises(ValueError):
        I.project(rows, "pixels")
    with pytest.raises(ValueError):
        I.item(rows, slice(0, 1))
    for index in (-1, 4):
        with pytest.raises(IndexError):
            I.item(spark.createDataFrame([(3,)], "image_id long"), index)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_gapless(spark, adaptive):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(50_000).select(F.concat(F.lit("p"), F.xxhash64(F.col("id") % 40_000)).alias("path"), F.repeat(F.lit("w"), 200).alias("wide"), "id").union(spark.sql("SELECT CAST(NULL AS STRING), 'x', -1L"))
        got = I.numbered(rows).select("image_id", "path", "id").toPandas().sort_values("image_id")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert got.image_id.tolist() == list(range(50_001)) and got.id.nunique() == 50_001 and got.path.iloc[0] is None
    assert got.path.iloc[1:].tolist() == sorted(got.path.iloc[1:])
    assert I.numbered(rows.limit(0)).count() == 0


def test_whole_images_are_resized(spark):
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    made = pixels.resize_images(spark.createDataFrame([(1, 5, 7, 3, bytearray(image.tobytes()))], "image_id long, height int, width int, nChannels int, data binary"), 4).first()
    got = np.frombuffer(made.data, np.uint8).reshape(4, 4, 3)
    one = spark.createDataFrame([(1, y, x, float(image[y, x, 2])) for y in range(5) for x in range(7)], "image_id long, y int, x int, v double")
    want = {(r.y, r.x): r.v for r in pixels.resize(one, 5, 7, 4, 4).collect()}
    assert (made.height, made.width) == (4, 4) and all(abs(got[y, x, 2] - v) <= 0.5 + 1e-9 for (y, x), v in want.items())


def test_scores_count_all_classes(spark):
    rng = np.random.default_rng(3)
    image, mask = rng.integers(0, 256, (6, 6, 3)).astype(np.uint8), rng.integers(0, 12, 36)
    rows = spark.createDataFrame([(0, 6, 6, 3, bytearray(image.tobytes()))], "image_id long, height int, width int, nChannels int, data binary")
    truth = spark.createDataFrame([(0, mask.tolist(), 4)], "image_id long, mask array<int>, cls int")
    network = sweep.stub_predictor()
    got = sweep.predict(rows, truth, {"n": network}, sigmas=None).first()
    p = network(image).reshape(36, 12)
    guess = p.argmax(1)
    both, each = [np.sum((guess == c) & (mask == c)) for c in range(12)], [np.sum(guess == c) + np.sum(mask == c) for c in range(12)]
    assert got.n_dice_score == pytest.approx(np.mean([2 * i / (u + 1e-8) for i, u in zip(both, each)]))
    assert got.n_iou == pytest.approx((sum(both) + 1e-6) / (sum(each) - sum(both) + 1e-6)) and got.n_proba == pytest.approx(p[mask == 4, 4].mean() if (mask == 4).any() else 0)


def test_models_and_results_round_trip(spark, tmp_path):
    book = spark.createDataFrame([(0, [1.0], "sift")], "k int, c array<double>, feature string")
    sinks.save_model(book, f"{tmp_path}/m")
    assert sinks.load_model(spark, f"{tmp_path}/m", "sift").collect() == book.collect()
    with pytest.raises(ValueError):
        sinks.load_model(spark, f"{tmp_path}/m", "root_sift")
    for n in (0, 1, 3):
        sinks.write_json_array(spark.range(n).withColumn("x", F.lit(None).cast("int")), f"{tmp_path}/a{n}")
        assert json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/a{n}").collect())) == [{"id": i, "x": None} for i in range(n)]
    sinks.write_json(book, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 1


def test_sweep_has_a_row_for_each_pair_and_setting(spark):
    data = [(i, 24, 24, 1, bytearray(RNG.integers(0, 256, 576).astype(np.uint8).tobytes()), f"p{i}", "tile") for i in range(3)]
    images = spark.createDataFrame(data, "image_id long, height int, width int, nChannels int, data binary, path string, label string")
    truth = images.select("image_id", F.array_repeat(F.lit(1), 576).alias("mask"), F.lit(1).alias("cls"))
    out = sweep.pair_records(images, truth, {"u_net": sweep.stub_predictor(), "deeplabv3": sweep.stub_predictor()}, sigmas=(2,), qualities=(10, 90))
    assert out.count() == 6 and len(out.columns) == 20
    assert sweep.grid(spark).count() == 90


def test_similarities_of_blocks_are_those_of_single_pairs(spark):
    side = 176
    data = [(i, side, side, 1, bytearray(RNG.integers(0, 256, side * side).astype(np.uint8).tobytes())) for i in range(5)]
    images = spark.createDataFrame(data, "image_id long, height int, width int, nChannels int, data binary")
    got = {(r.i, r.j, r.sigma, r.quality): (r.ssim_score, r.ms_ssim_score) for r in sweep.similarities(images, (4,), (10, 90), block_bytes=2 * side * side).collect()}
    made = {i: dict(sweep._variants(np.frombuffer(d, np.uint8).reshape(side, side, 1), 4, (10, 90))) for i, *_, d in data}
    assert set(got) == {(i, j, 4, q) for i in range(5) for j in range(i + 1, 5) for q in (10, 90)}
    for (i, j, _, q), scores in got.items():
        a, b = made[i][q], made[j][q]
        assert scores == pytest.approx((ssim.ssim(a, b, 255.0), ssim.ms_ssim(a, b, 255.0)))


def test_equal_variants_are_scored_once_and_large_images_in_colour_as_single_ones(spark):
    side, sigmas = 176, (2, 16, 18)
    data = [(i, side, side, 1, bytearray(np.full((side, side), 40 * i + 20, np.uint8).tobytes())) for i in range(3)]
    images = spark.createDataFrame(data, "image_id long, height int, width int, nChannels int, data binary").cache()
    calls = spark.sparkContext.accumulator(0)
    net = sweep.stub_predictor()

    def counted(image):
        calls.add(1)
        return net(image)

    truth = images.select("image_id", F.array_repeat(F.lit(1), side * side).alias("mask"), F.lit(1).alias("cls"))
    got = sweep.predict(images, truth, {"net": counted}, sigmas, (50,)).collect()
    assert {(r.image_id, r.sigma, r.quality) for r in got} == {(i, s, 50) for i in range(3) for s in sigmas} and calls.value == 3
    pictures = [RNG.integers(0, 256, (400, 410, 3)).astype(np.uint8) for _ in range(3)]
    stack = ssim.Stack(3, 255.0)
    for i, p in enumerate(pictures):
        stack.put(i, p)
    one, many = stack.scores(2, np.array([0, 1]))
    assert one == pytest.approx([ssim.ssim(pictures[2], p, 255.0) for p in pictures[:2]])
    assert many == pytest.approx([ssim.ms_ssim(pictures[2], p, 255.0) for p in pictures[:2]])


def test_only_strips_that_changed_are_compared_again(monkeypatch):
    pictures = [RNG.integers(0, 256, (176, 190)).astype(np.uint8) for _ in range(3)]
    stack, (second, first), filled = ssim.Stack(3, 255.0), np.tril_indices(3, -1), []
    for i, p in enumerate(pictures):
        stack.put(i, p)
    stack.scores(second, first)
    fill = ssim._Level._fill
    monkeypatch.setattr(ssim._Level, "_fill", lambda self, s, i, o: filled.append((self.count, s, i, *o)) or fill(self, s, i, o))
    pictures[1] = pictures[1].copy()
    pictures[1][:8, 50:60] = 7
    stack.put(1, pictures[1])
    one, many = stack.scores(second, first)
    assert {x[1] for x in filled} == {0} and len(stack.levels[0].x) > 1 and (2, 0) not in {x[2:] for x in filled}
    for k, (a, b) in enumerate(zip(second, first)):
        assert (one[k], many[k]) == pytest.approx((ssim.ssim(pictures[a], pictures[b], 255.0), ssim.ms_ssim(pictures[a], pictures[b], 255.0)), abs=1e-6)


def test_pairs_of_blocks_have_partitions_of_their_own(spark):
    data = [(i, 24, 24, 1, bytearray(RNG.integers(0, 256, 576).astype(np.uint8).tobytes())) for i in range(9)]
    images = spark.createDataFrame(data, "image_id long, height int, width int, nChannels int, data binary")
    out = sweep.similarities(images, (2,), (10, 90), block_bytes=2 * 576)
    assert "repartition_by_num" in (plan := out._jdf.queryExecution().executedPlan().toString().lower()) and "hashpartitioning(low" not in plan
    used = [r.n for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()]
    blocks = dict(images.select("image_id", F.pmod(F.xxhash64("image_id"), F.lit(5))).collect())
    met = {tuple(sorted((blocks[i], blocks[j]))) for i in range(9) for j in range(i)}
    assert sum(used) == 36 * 2 and len(used) in (len(met), 2 * len(met))


def test_logging_from_a_file_or_by_default(tmp_path):
    (tmp_path / "log.json").write_text('{"version": 1, "disable_existing_loggers": false, "loggers": {"tessera.probe": {"level": "ERROR"}}}')
    assert settings.setup_logging(f"{tmp_path}/log.json") and logging.getLogger("tessera.probe").level == logging.ERROR
    assert not settings.setup_logging(f"{tmp_path}/none.json")

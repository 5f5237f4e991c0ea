"""Named queries over the supplied tables, and the SQL each must agree with.

Every query reads its whole table.  Floats are rounded to six digits in both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import encode, jpeg, learn, masks, pixels, sift, ssim, sweep
from ..sources import images as I
from . import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
D, N = S.DIM, S.SIDE

# Parts of the SQL
DESC = "d AS (SELECT vec_id // 10 AS image_id, vec_id AS desc_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
LONG = f"{DESC}, l AS (SELECT image_id, desc_id, label, p::INT AS pos, v[p + 1] AS x FROM d, (SELECT unnest(range({D})) AS p))"
BOOK = f"cb AS (SELECT vec_id::INT AS k, p::INT AS pos, embedding[p + 1]::DOUBLE AS c FROM embeddings, (SELECT unnest(range({D})) AS p) WHERE vec_id < {S.CENTRES})"
NEAR = f"{LONG}, {BOOK}, dist AS (SELECT image_id, desc_id, k, sum((x - c) * (x - c)) AS dist FROM l JOIN cb USING (pos) GROUP BY ALL), near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY desc_id ORDER BY dist, k) = 1)"
SIGNED = "sign({0}) * sqrt(abs({0}))"
VLAD = f"""{NEAR}, s AS (SELECT image_id, k, pos, sum(x - c) AS z FROM l JOIN near USING (image_id, desc_id) JOIN cb USING (k, pos) GROUP BY ALL),
  p AS (SELECT image_id, k, pos, {SIGNED.format('z')} AS z FROM s), vlad AS (SELECT image_id, k, pos, z / (sqrt(sum(z * z) OVER (PARTITION BY image_id, k)) + 1e-9) AS v FROM p)"""
GMM = f"{LONG}, gmm AS (SELECT label AS k, pos, avg(x) AS mu, var_pop(x) AS var, count(*)::DOUBLE / (SELECT count(*) FROM embeddings) AS w FROM l GROUP BY ALL)"
POST = f"""{GMM}, lg AS (SELECT image_id, desc_id, k, ln(any_value(w)) - 0.5e0 * sum(ln(6.283185307179586e0 * var) + (x - mu) * (x - mu) / var) AS lp FROM l JOIN gmm USING (pos) GROUP BY ALL),
  ex AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY desc_id)) AS e FROM lg), post AS (SELECT image_id, desc_id, k, e / sum(e) OVER (PARTITION BY desc_id) AS g FROM ex)"""
FISHER = f"""{POST}, st AS (SELECT image_id, k, pos, avg(g) AS s0, avg(g * x) AS s1, avg(g * x * x) AS s2 FROM post JOIN l USING (image_id, desc_id) GROUP BY ALL),
  raw AS (SELECT image_id, 0 AS part, k, 0 AS pos, (any_value(s0) - any_value(w)) / sqrt(any_value(w)) AS z FROM st JOIN gmm USING (k, pos) GROUP BY image_id, k
    UNION ALL SELECT image_id, 1, k, pos, (s1 - s0 * mu) / (sqrt(w) * sqrt(var)) FROM st JOIN gmm USING (k, pos)
    UNION ALL SELECT image_id, 2, k, pos, (-s2 - s0 * mu * mu + s0 * var + 2 * s1 * mu) / (sqrt(2 * w) * var) FROM st JOIN gmm USING (k, pos)),
  pw AS (SELECT image_id, part, k, pos, {SIGNED.format('z')} AS z FROM raw),
  fish AS (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY part, k, pos) - 1)::INT AS pos, z / (sqrt(sum(z * z) OVER (PARTITION BY image_id)) + 1e-9) AS v FROM pw)"""
PAIRS = "SELECT x.image_id AS a, y.image_id AS b, round(sum(x.v * y.v) / (max(x.n) * max(y.n)), 6) + 0.0 AS cos FROM n x JOIN n y ON x.image_id < y.image_id AND {on} GROUP BY ALL"
TILE = f"px AS (SELECT vec_id // 25 AS image_id, (((vec_id % 25) * {D} + p) // {N})::INT AS y, (((vec_id % 25) * {D} + p) % {N})::INT AS x, floor((embedding[p + 1]::DOUBLE + 1) * 127.5e0) AS v FROM embeddings, (SELECT unnest(range({D})) AS p))"
MEANS = f"{GMM}, pd AS (SELECT image_id, desc_id, label, k AS cls, exp(-round(sum((x - mu) * (x - mu)), 6)) AS e FROM l JOIN gmm USING (pos) GROUP BY ALL), pr AS (SELECT image_id, desc_id, label, cls, e / sum(e) OVER (PARTITION BY desc_id) AS p FROM pd), am AS (SELECT image_id, desc_id, label AS truth, cls AS pred FROM pr QUALIFY row_number() OVER (PARTITION BY desc_id ORDER BY p DESC, cls) = 1)"
OVERLAP = f"""{MEANS}, c AS (SELECT unnest(range(10))::INT AS cls), ov AS (SELECT image_id, cls, count(*) FILTER (pred = cls) AS p, count(*) FILTER (truth = cls) AS t, count(*) FILTER (pred = cls AND truth = cls) AS i FROM am, c GROUP BY ALL)"""


def r6(c: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def long(vectors: DataFrame, column: str, *keys: str) -> DataFrame:
    return vectors.select(*keys, F.posexplode(column).alias("pos", "v")).withColumn("v", r6("v"))


# Vectors


@query("cosine_same_label", f"WITH {LONG}, n AS (SELECT desc_id AS image_id, label, pos, x AS v, sqrt(sum(x * x) OVER (PARTITION BY desc_id)) AS n FROM l) SELECT x.image_id AS a, y.image_id AS b, x.label AS label, round(sum(x.v * y.v) / (max(x.n) * max(y.n)), 6) + 0.0 AS cos FROM n x JOIN n y ON x.label = y.label AND x.pos = y.pos AND x.image_id < y.image_id GROUP BY ALL")
def cosine_same_label(spark, d):
    v = S.descriptors(spark, d).select(F.col("desc_id").alias("image_id"), F.col("v").alias("vector"), "label")
    return encode.pairs(v, "label").select("a", "b", "label", r6("cos").alias("cos"))


@query("cosine_all_pairs_topk", f"WITH {LONG}, n AS (SELECT desc_id AS image_id, pos, x AS v, sqrt(sum(x * x) OVER (PARTITION BY desc_id)) AS n FROM l), q AS ({PAIRS.format(on='x.pos = y.pos')}) SELECT * FROM q ORDER BY cos DESC, a, b LIMIT 20")
def cosine_all_pairs_topk(spark, d):
    v = S.descriptors(spark, d).select(F.col("desc_id").alias("image_id"), F.col("v").alias("vector"))
    return encode.pairs(v).select("a", "b", r6("cos").alias("cos")).orderBy(F.desc("cos"), "a", "b").limit(20)


@query("rootsift", f"WITH {LONG} SELECT desc_id, pos, round(sqrt(abs(x) / (sum(abs(x)) OVER (PARTITION BY desc_id) + 1e-7)), 6) + 0.0 AS v FROM l")
def rootsift(spark, d):
    one = S.descriptors(spark, d).select("desc_id", F.transform("v", F.abs).alias("a"))
    return long(one.select("desc_id", V.root_sift(F.col("a")).alias("r")), "r", "desc_id")


@query("standardize", f"WITH {LONG}, s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY pos) SELECT desc_id AS image_id, pos, round((x - m) / nullif(s, 0), 6) + 0.0 AS z FROM l JOIN s USING (pos)")
def standardize(spark, d):
    return learn.standardized(S.descriptors(spark, d).select(F.col("desc_id").alias("image_id"), F.col("v").alias("vector"))).select("image_id", "pos", r6("z").alias("z"))


@query("column_moments", f"WITH {LONG} SELECT pos, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS low, round(max(x), 6) + 0.0 AS high FROM l GROUP BY pos")
def column_moments(spark, d):
    one = S.descriptors(spark, d).select(F.posexplode("v").alias("pos", "x"))
    return one.groupBy("pos").agg(r6(F.avg("x")).alias("mean"), r6(F.stddev_pop("x")).alias("std"), r6(F.min("x")).alias("low"), r6(F.max("x")).alias("high"))


@query("norms", f"WITH {LONG} SELECT desc_id, round(sum(abs(x)), 6) AS l1, round(sqrt(sum(x * x)), 6) AS l2, round(pow(sum(pow(abs(x), 3.0e0)), 1.0e0 / 3.0e0), 6) AS l3, round(max(abs(x)), 6) AS linf FROM l GROUP BY desc_id")
def norms(spark, d):
    v = F.col("v")
    return S.descriptors(spark, d).select("desc_id", *[r6(V.norm(v, p)).alias(n) for n, p in (("l1", 1), ("l2", 2), ("l3", 3), ("linf", float("inf")))])


@query("sign_power_normalize", f"WITH {LONG}, p AS (SELECT desc_id, pos, {SIGNED.format('x')} AS z FROM l) SELECT desc_id, pos, round(z / (sum(abs(z)) OVER (PARTITION BY desc_id) + 1e-9), 6) + 0.0 AS v FROM p")
def sign_power_normalize(spark, d):
    one = S.descriptors(spark, d).select("desc_id", V.lp_normalize(F.transform("v", lambda x: V.sign_power(x)), 1).alias("r"))
    return long(one, "r", "desc_id")


# VLAD


@query("nearest_centroid", f"WITH {NEAR} SELECT image_id, desc_id, k, round(dist, 6) + 0.0 AS dist FROM near")
def nearest_centroid(spark, d):
    return encode.nearest(S.descriptors(spark, d), S.codebook(spark, d)).select("image_id", "desc_id", "k", r6("dist").alias("dist"))


def _vlad(spark, d):
    return encode.vlad(S.descriptors(spark, d), S.codebook(spark, d), D)


@query("vlad_long", f"WITH {VLAD} SELECT image_id, k, pos, round(v, 6) + 0.0 AS v FROM vlad")
def vlad_long(spark, d):
    return long(_vlad(spark, d), "row", "image_id", "k")


@query("vlad_flat", f"WITH {VLAD}, g AS (SELECT DISTINCT image_id FROM d), c AS (SELECT DISTINCT k, pos FROM cb) SELECT image_id, (k * {D} + pos)::INT AS pos, round(coalesce(v, 0), 6) + 0.0 AS v FROM g CROSS JOIN c LEFT JOIN vlad USING (image_id, k, pos)")
def vlad_flat(spark, d):
    return long(encode.flat(_vlad(spark, d), S.codebook(spark, d), D), "vector", "image_id")


@query("vlad_cosine", f"WITH {VLAD}, n AS (SELECT image_id, k, pos, v, sqrt(sum(v * v) OVER (PARTITION BY image_id)) AS n FROM vlad), q AS ({PAIRS.format(on='x.k = y.k AND x.pos = y.pos')}), i AS (SELECT DISTINCT image_id FROM d) SELECT a.image_id AS a, b.image_id AS b, coalesce(cos, 0.0) AS cos FROM i a JOIN i b ON a.image_id < b.image_id LEFT JOIN q ON q.a = a.image_id AND q.b = b.image_id")
def vlad_cosine(spark, d):
    return encode.pairs(encode.flat(_vlad(spark, d), S.codebook(spark, d), D)).select("a", "b", r6("cos").alias("cos"))


@query("mean_residual_similarity", f"WITH {NEAR}, m AS (SELECT image_id, k, pos, avg(x - c) AS z FROM l JOIN near USING (image_id, desc_id) JOIN cb USING (k, pos) GROUP BY ALL) SELECT x.image_id AS a, y.image_id AS b, round(sum(x.z * y.z), 6) + 0.0 AS dot FROM m x JOIN m y ON x.k = y.k AND x.pos = y.pos AND x.image_id < y.image_id GROUP BY ALL")
def mean_residual_similarity(spark, d):
    rows = encode.mean_residual(S.descriptors(spark, d), S.codebook(spark, d), D)
    return encode.row_similarity(rows).select("a", "b", r6("dot").alias("dot"))


# Fisher vectors


@query("gmm_posterior", f"WITH {POST} SELECT desc_id, k, round(g, 6) + 0.0 AS gamma FROM post")
def gmm_posterior(spark, d):
    return encode.posterior(S.descriptors(spark, d), S.mixture(spark, d)).select("desc_id", F.explode("g").alias("g")).select("desc_id", "g.k", r6("g.gamma").alias("gamma"))


def _fisher(spark, d, **options):
    return encode.fisher(S.descriptors(spark, d), S.mixture(spark, d), D, **options)


@query("fisher_long", f"WITH {FISHER} SELECT image_id, pos, round(v, 6) + 0.0 AS v FROM fish")
def fisher_long(spark, d):
    return long(_fisher(spark, d), "vector", "image_id")


@query("fisher_cosine", f"WITH {FISHER}, n AS (SELECT image_id, pos, v, sqrt(sum(v * v) OVER (PARTITION BY image_id)) AS n FROM fish) {PAIRS.format(on='x.pos = y.pos')}")
def fisher_cosine(spark, d):
    return encode.pairs(_fisher(spark, d)).select("a", "b", r6("cos").alias("cos"))


@query("fisher_means", f"WITH {POST}, st AS (SELECT image_id, k, pos, avg(g) AS s0, avg(g * x) AS s1 FROM post JOIN l USING (image_id, desc_id) GROUP BY ALL), raw AS (SELECT image_id, k, pos, (s1 - s0 * mu) / (sqrt(w) * sqrt(var)) AS z FROM st JOIN gmm USING (k, pos)), pw AS (SELECT image_id, k, pos, {SIGNED.format('z')} AS z FROM raw) SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY k, pos) - 1)::INT AS pos, round(z / (sqrt(sum(z * z) OVER (PARTITION BY image_id)) + 1e-9), 6) + 0.0 AS v FROM pw")
def fisher_means(spark, d):
    return long(_fisher(spark, d, means_only=True), "vector", "image_id")


# Masks


def _predicted(spark, d):
    return masks.argmax(S.probabilities(spark, d)).join(S.truth(spark, d), ["image_id", "y", "x"])


@query("argmax_mask", f"WITH {MEANS} SELECT image_id, 0 AS y, (desc_id % 10)::INT AS x, pred FROM am")
def argmax_mask(spark, d):
    return masks.argmax(S.probabilities(spark, d))


@query("dice_macro", f"WITH {OVERLAP} SELECT image_id, round(avg(2.0e0 * i / (p + t + 1e-8)), 6) AS dice FROM ov GROUP BY image_id")
def dice_macro(spark, d):
    return masks.dice_macro(_predicted(spark, d), S.classes(spark)).select("image_id", r6("dice").alias("dice"))


@query("dice_macro_ignoring", f"WITH {OVERLAP} SELECT image_id, round(avg(2.0e0 * i / (p + t + 1e-8)), 6) AS dice FROM ov WHERE cls <> 0 GROUP BY image_id")
def dice_macro_ignoring(spark, d):
    return masks.dice_macro(_predicted(spark, d), S.classes(spark), (0,)).select("image_id", r6("dice").alias("dice"))


@query("iou_micro", f"WITH {OVERLAP} SELECT image_id, round((sum(i) + 1e-6) / (sum(p) + sum(t) - sum(i) + 1e-6), 6) AS iou FROM ov GROUP BY image_id")
def iou_micro(spark, d):
    return masks.iou_micro(_predicted(spark, d), S.classes(spark)).select("image_id", r6("iou").alias("iou"))


@query("confidence", f"WITH {MEANS} SELECT image_id, cls, round(coalesce(avg(p) FILTER (label = cls), 0), 6) + 0.0 AS confidence FROM pr GROUP BY ALL")
def confidence(spark, d):
    return masks.confidence(S.probabilities(spark, d), S.truth(spark, d)).select("image_id", "cls", r6("confidence").alias("confidence"))


@query("two_class_scores", "WITH x AS (SELECT doc_id // 10 AS image_id, toxic AS truth, quality AS pred FROM labels), c AS (SELECT unnest([0, 1]) AS cls), o AS (SELECT image_id, cls, count(*) FILTER (pred = cls) AS p, count(*) FILTER (truth = cls) AS t, count(*) FILTER (pred = cls AND truth = cls) AS i FROM x, c GROUP BY ALL) SELECT image_id, round(avg(2.0e0 * i / (p + t + 1e-8)), 6) AS dice, round((sum(i) + 1e-6) / (sum(p) + sum(t) - sum(i) + 1e-6), 6) AS iou FROM o GROUP BY image_id")
def two_class_scores(spark, d):
    x = S.table(spark, d, "labels").select(F.expr("doc_id div 10").alias("image_id"), F.col("toxic").alias("truth"), F.col("quality").alias("pred"))
    c = spark.range(2).select(F.col("id").cast("int").alias("cls"))
    return masks.dice_macro(x, c).join(masks.iou_micro(x, c), "image_id").select("image_id", r6("dice").alias("dice"), r6("iou").alias("iou"))


PALETTE = "pal AS (SELECT * FROM (VALUES " + ", ".join(str(c) for c in I.CLASSES) + ") t(cls, name, r, g, b))"


@query("class_to_rgb", f"WITH {PALETTE}, m AS (SELECT vec_id // 10 AS image_id, 0 AS y, (vec_id % 10)::INT AS x, (label * 2)::INT AS cls FROM embeddings) SELECT image_id, y, x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM m LEFT JOIN pal USING (cls)")
def class_to_rgb(spark, d):
    m = S.truth(spark, d).select("image_id", "y", "x", (F.col("truth") * 2).alias("cls"))
    return masks.class_to_rgb(m, I.classes(spark))


@query("rgb_to_class", f"WITH {PALETTE}, m AS (SELECT vec_id // 10 AS image_id, 0 AS y, (vec_id % 10)::INT AS x, (label * 2)::INT AS cls FROM embeddings) SELECT image_id, y, x, CASE WHEN cls < 12 THEN cls ELSE 0 END AS cls FROM m")
def rgb_to_class(spark, d):
    return masks.rgb_to_class(class_to_rgb(spark, d), I.classes(spark))


@query("nonzero_pixels", f"WITH {PALETTE}, m AS (SELECT vec_id // 10 AS image_id, 0 AS y, (vec_id % 10)::INT AS x, (label * 2)::INT AS cls FROM embeddings) SELECT image_id, y, x FROM m WHERE cls BETWEEN 1 AND 11")
def nonzero_pixels(spark, d):
    return pixels.nonzero(class_to_rgb(spark, d))


# Pixels


def _taps(along: str, source: str, taps: list[tuple[int, float]], n: int) -> str:
    """SQL of a mirrored stencil along one axis."""
    rows = ", ".join(f"({dt}, {w!r}::DOUBLE)" for dt, w in taps)
    other = "x" if along == "y" else "y"
    at = f"abs(a.{along} + t.d)"
    return f"SELECT a.image_id, a.{other}, a.{along}, sum(t.w * b.v) AS v FROM {source} a CROSS JOIN (VALUES {rows}) t(d, w) JOIN {source} b ON b.image_id = a.image_id AND b.{other} = a.{other} AND b.{along} = CASE WHEN {at} >= {n} THEN {2 * n - 2} - {at} ELSE {at} END GROUP BY ALL"


def _blur_sql(name: str, source: str, sigma: float, n: int = N) -> str:
    g = [(i - 1, w) for i, w in enumerate(pixels.gaussian(3, sigma))]
    return f"{name}_x AS ({_taps('x', source, g, n)}), {name} AS ({_taps('y', f'{name}_x', g, n)})"


HALF = "SELECT image_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM {0} GROUP BY image_id, y // 2, x // 2"


@query("blur3", f"WITH {TILE}, {_blur_sql('b', 'px', 2.0)} SELECT image_id, y, x, round(v, 6) AS v FROM b")
def blur3(spark, d):
    return pixels.blur(S.tiles(spark, d), 2.0, N, N).select("image_id", "y", "x", r6("v").alias("v"))


@query("sharpen", f"WITH {TILE}, t AS (SELECT dy, dx, CASE WHEN dy = 0 AND dx = 0 THEN 9.0e0 ELSE -1.0e0 END AS w FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)), s AS (SELECT a.image_id, a.y, a.x, sum(w * b.v) AS v FROM px a CROSS JOIN t JOIN px b ON b.image_id = a.image_id AND b.y = CASE WHEN abs(a.y + dy) >= {N} THEN {2 * N - 2} - abs(a.y + dy) ELSE abs(a.y + dy) END AND b.x = CASE WHEN abs(a.x + dx) >= {N} THEN {2 * N - 2} - abs(a.x + dx) ELSE abs(a.x + dx) END GROUP BY ALL) SELECT image_id, y, x, greatest(0.0e0, least(255.0e0, v)) + 0.0 AS v FROM s")
def sharpen(spark, d):
    return pixels.sharpen(S.tiles(spark, d), N, N).select("image_id", "y", "x", r6("v").alias("v"))


@query("threshold", f"WITH {TILE} SELECT image_id, y, x, CASE WHEN v > 127 THEN 255.0e0 ELSE 0.0e0 END AS v FROM px")
def threshold(spark, d):
    return pixels.threshold(S.tiles(spark, d), 127.0)


@query("gray_bgr", f"WITH {TILE} SELECT image_id, y, x, round(0.299e0 * v + 0.587e0 * (255 - v) + 0.114e0 * abs(v - 128), 6) AS v FROM px")
def gray_bgr(spark, d):
    v = F.col("v")
    return S.tiles(spark, d).select("image_id", "y", "x", r6(V.gray_bgr(F.abs(v - 128), 255 - v, v)).alias("v"))


@query("otsu_level", f"WITH {TILE}, h AS (SELECT image_id, v::INT AS g, count(*) AS c FROM px GROUP BY ALL), w AS (SELECT image_id, g, sum(c) OVER o AS w0, sum(g * c) OVER o AS s0, sum(c) OVER (PARTITION BY image_id) AS n, sum(g * c) OVER (PARTITION BY image_id) AS s FROM h WINDOW o AS (PARTITION BY image_id ORDER BY g)), b AS (SELECT image_id, g, coalesce(round((w0 * (n - w0))::DOUBLE * pow(s0::DOUBLE / w0 - (s - s0)::DOUBLE / nullif(n - w0, 0), 2), 3), 0) AS b FROM w) SELECT image_id, g AS level FROM b QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY b DESC, g) = 1")
def otsu_level(spark, d):
    return pixels.otsu(S.tiles(spark, d))


@query("resize_half", f"WITH {TILE} SELECT image_id, y, x, round(v, 6) AS v FROM ({HALF.format('px')})")
def resize_half(spark, d):
    return pixels.resize(S.tiles(spark, d), N, N, N // 2, N // 2).select("image_id", "y", "x", r6("v").alias("v"))


def _dog_sql(wrap: bool) -> str:
    parts, out, source, n = [TILE], [], "px", N
    k = 2 ** (1 / 2)
    for o in range(2):
        parts += [_blur_sql(f"o{o}s{i}", source, 1.6 * k**i, n) for i in range(5)]
        for s in range(4):
            v = "((round(b.v)::INT - round(a.v)::INT) % 256 + 256) % 256" if wrap else "round(b.v - a.v, 6) + 0.0"
            out.append(f"SELECT image_id, {o} AS octave, {s} AS scale, y, x, ({v})::DOUBLE AS v FROM o{o}s{s} a JOIN o{o}s{s + 1} b USING (image_id, y, x)")
        parts.append(f"half{o} AS ({HALF.format(source)})")
        source, n = f"half{o}", n // 2
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@query("dog", _dog_sql(False))
def dog(spark, d):
    return pixels.difference_of_gaussians(S.tiles(spark, d), 1.6, N, N).select("image_id", "octave", "scale", "y", "x", r6("v").alias("v"))


@query("pixel_contract", f"WITH {TILE} SELECT image_id, min(v) AS low, max(v) AS high FROM px GROUP BY image_id")
def pixel_contract(spark, d):
    checked = S.tiles(spark, d).withColumn("v", V.checked_range(F.col("v"), 0, 255))
    return checked.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def _ssim_sql(data_range: float) -> str:
    g = pixels.gaussian(11, 1.5)
    taps = "t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in enumerate(g)) + ") t(i, w))"
    cols = ("p", "q", "pp", "qq", "pq")
    passed = lambda axis, src: f"SELECT a, b, {', '.join((f'{axis} - i AS {axis}', 'x' if axis == 'y' else 'y'))}, {', '.join(f'sum(w * {c}) AS {c}' for c in cols)} FROM {src}, t GROUP BY ALL HAVING count(*) = 11"
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    return f"""WITH {TILE}, {taps}, m AS (SELECT l.image_id AS a, r.image_id AS b, l.y, l.x, l.v AS p, r.v AS q, l.v * l.v AS pp, r.v * r.v AS qq, l.v * r.v AS pq FROM px l JOIN px r ON r.image_id = l.image_id + 1 AND l.y = r.y AND l.x = r.x),
      mx AS ({passed('x', 'm')}), my AS ({passed('y', 'mx')})
      SELECT a, b, round(avg((2 * p * q + {c1!r}::DOUBLE) * (2 * (pq - p * q) + {c2!r}::DOUBLE) / ((p * p + q * q + {c1!r}::DOUBLE) * (pp - p * p + qq - q * q + {c2!r}::DOUBLE))), 6) AS ssim FROM my GROUP BY ALL"""


def _neighbours(spark, d):
    ids = S.table(spark, d, "embeddings").select(F.expr("vec_id div 25").alias("a")).distinct()
    return ids.join(ids.select((F.col("a") - 1).alias("a")), "a").select("a", (F.col("a") + 1).alias("b"))


@query("ssim_tiles", _ssim_sql(255.0))
def ssim_tiles(spark, d):
    return ssim.ssim_tiles(_neighbours(spark, d), S.tiles(spark, d), 255.0).select("a", "b", r6("ssim").alias("ssim"))


# Pairs, grids and scores


@query("pair_grid", "WITH i AS (SELECT DISTINCT vec_id // 25 AS id FROM embeddings) SELECT a.id AS i, b.id AS j, s::INT AS sigma, q::INT AS quality FROM i a JOIN i b ON a.id < b.id, (SELECT unnest(range(2, 19, 2)) AS s), (SELECT unnest(range(10, 101, 10)) AS q)")
def pair_grid(spark, d):
    ids = S.table(spark, d, "embeddings").select(F.expr("vec_id div 25").alias("image_id"), F.lit("tile").alias("label")).distinct()
    return sweep.image_pairs(ids).crossJoin(F.broadcast(sweep.grid(spark)))


@query("same_class_pairs", f"WITH {DESC}, i AS (SELECT image_id, arg_min(label, desc_id) AS label FROM d GROUP BY image_id) SELECT a.image_id AS i, b.image_id AS j FROM i a JOIN i b ON a.label = b.label AND a.image_id < b.image_id")
def same_class_pairs(spark, d):
    return sweep.image_pairs(S.images(spark, d), same_label=True)


@query("score_correlation", "WITH x AS (SELECT doc_id % 5 AS grp, quality::DOUBLE AS x, toxic::DOUBLE AS y FROM labels), r AS (SELECT grp, x, y, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0e0 AS rx, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0e0 AS ry FROM x) SELECT grp, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) + 0.0 AS pearson, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) + 0.0 AS spearman, count(*) AS n FROM r GROUP BY grp")
def score_correlation(spark, d):
    x = S.table(spark, d, "labels").select((F.col("doc_id") % 5).alias("grp"), F.col("quality").cast("double").alias("x"), F.col("toxic").cast("double").alias("y"))
    return sweep.correlation(x, "x", "y", ["grp"]).select("grp", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"), "n")


# Sources and scalar functions


@query("path_label", "SELECT page_id, split_part(url, '/', -2) AS label, split_part(url, '/', -1) AS file FROM pages")
def path_label(spark, d):
    return S.table(spark, d, "pages").select("page_id", I.label_of(F.col("url")).alias("label"), I.file_of(F.col("url")).alias("file"))


@query("mask_name", "SELECT page_id, replace(url || '.jpg.jpg', '.jpg', '.png') AS mask FROM pages")
def mask_name(spark, d):
    return S.table(spark, d, "pages").select("page_id", I.mask_name(F.concat("url", F.lit(".jpg.jpg"))).alias("mask"))


@query("extension_filter", "SELECT page_id FROM pages WHERE CASE WHEN page_id % 3 = 0 THEN url || '.jpg' WHEN page_id % 3 = 1 THEN url || '.JPG' ELSE url END LIKE '%.jpg'")
def extension_filter(spark, d):
    name = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".jpg"))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(".JPG"))).otherwise(F.col("url"))
    return S.table(spark, d, "pages").filter(I.is_image(name)).select("page_id")


@query("enum_lookup", f"WITH {PALETTE}, n AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'car' WHEN 1 THEN 'Truck' WHEN 2 THEN 'HUMAN' ELSE 'ship' END AS label FROM orders) SELECT o_orderkey, label, cls FROM n LEFT JOIN pal ON upper(label) = name")
def enum_lookup(spark, d):
    k = F.col("o_orderkey") % 4
    n = S.table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "car").when(k == 1, "Truck").when(k == 2, "HUMAN").otherwise("ship").alias("label"))
    return I.enum_lookup(n, "label", I.classes(spark))


@query("split_selection", "SELECT doc_id FROM documents WHERE CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END = 'validation'")
def split_selection(spark, d):
    k = F.col("doc_id") % 3
    named = S.table(spark, d, "documents").select("doc_id", F.when(k == 0, "train").when(k == 1, "validation").otherwise("test").alias("split"))
    return named.filter(F.col("split") == I.checked_split("validation")).select("doc_id")


@query("numbered_paths", "SELECT row_number() OVER (ORDER BY path) - 1 AS image_id, path FROM (SELECT DISTINCT url AS path FROM pages)")
def numbered_paths(spark, d):
    return I.numbered(S.table(spark, d, "pages").select(F.col("url").alias("path")).distinct()).select("image_id", "path")


@query("random_access", "SELECT image_id, path FROM (SELECT row_number() OVER (ORDER BY path) - 1 AS image_id, path FROM (SELECT DISTINCT url AS path FROM pages)) WHERE image_id = 7")
def random_access(spark, d):
    return I.item(numbered_paths(spark, d), 7)


@query("dataset_length", "SELECT count(*) AS n FROM pages")
def dataset_length(spark, d):
    return S.table(spark, d, "pages").agg(F.count("*").alias("n"))


@query("image_mask_join", "SELECT page_id, 'm/' || page_id || '.png' AS mask_path FROM pages WHERE page_id % 5 <> 0")
def image_mask_join(spark, d):
    p = S.table(spark, d, "pages")
    images = p.filter("page_id % 5 <> 0").select("page_id", F.lit("a").alias("label"), F.concat("page_id", F.lit(".jpg")).alias("file"), F.col("url").alias("path"))
    found = p.select(F.concat(F.lit("m/"), "page_id", F.lit(".png")).alias("path"), F.lit("a").alias("label"), F.concat("page_id", F.lit(".png")).alias("file"))
    return I.with_masks(images, found).select("page_id", "mask_path")


@query("missing_mask", "SELECT page_id FROM pages WHERE page_id % 5 = 0")
def missing_mask(spark, d):
    p = S.table(spark, d, "pages")
    images = p.select("page_id", F.lit("a").alias("label"), F.concat("page_id", F.lit(".jpg")).alias("file"))
    found = p.filter("page_id % 5 <> 0").select(F.lit("a").alias("label"), F.concat("page_id", F.lit(".png")).alias("file"))
    return I.missing_masks(images, found).select("page_id")


@query("subset", "SELECT o_orderkey, list_has_all([1, 2, 3, 4, 5, 6, 7], [o_orderkey % 9, o_orderkey % 4]) AS inside FROM orders")
def subset(spark, d):
    k = F.col("o_orderkey")
    small, large = F.array(k % 9, k % 4), F.array(*[F.lit(i).cast("long") for i in range(1, 8)])
    return S.table(spark, d, "orders").select("o_orderkey", V.is_subset(small, large).alias("inside"))


@query("truncate_points", "SELECT o_orderkey, trunc(o_totalprice / 7)::INT AS x, trunc(-o_totalprice / 3)::INT AS y FROM orders")
def truncate_points(spark, d):
    one = S.table(spark, d, "orders").select("o_orderkey", V.truncated(F.array(F.struct((F.col("o_totalprice") / 7).alias("x"), (-F.col("o_totalprice") / 3).alias("y"))))[0].alias("p"))
    return one.select("o_orderkey", "p.x", "p.y")


@query("quality_clamp", "SELECT o_orderkey, greatest(0, least(o_orderkey - 50, 100)) AS q FROM orders")
def quality_clamp(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", V.clamp_quality(F.col("o_orderkey") - 50).alias("q"))


@query("synthetic_x", "SELECT round(-1.0e0 + i * (2.0e0 / 99), 6) + 0.0 AS x FROM range(100) r(i)")
def synthetic_x(spark, d):
    return I.synthetic(spark, -1.0, 1.0, 100).select(r6("x").alias("x"))


@query("distinct_labels", "SELECT DISTINCT label FROM embeddings ORDER BY label")
def distinct_labels(spark, d):
    return S.table(spark, d, "embeddings").select("label").distinct().orderBy("label")


@query("cluster_points", f"WITH {NEAR} SELECT k AS cluster, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM (SELECT desc_id, max(x) FILTER (pos = 0) AS x, max(x) FILTER (pos = 1) AS y FROM l GROUP BY desc_id) JOIN near USING (desc_id)")
def cluster_points(spark, d):
    n = encode.nearest(S.descriptors(spark, d), S.codebook(spark, d))
    return n.select(F.col("k").alias("cluster"), r6(F.col("v")[0]).alias("x"), r6(F.col("v")[1]).alias("y"))


@query("cluster_sizes", f"WITH {NEAR} SELECT k, count(*) AS n FROM near GROUP BY k")
def cluster_sizes(spark, d):
    return encode.nearest(S.descriptors(spark, d), S.codebook(spark, d)).groupBy("k").agg(F.count("*").alias("n"))


@query("first_images", "SELECT vec_id FROM embeddings WHERE vec_id // 10 < 10")
def first_images(spark, d):
    return S.descriptors(spark, d).filter("image_id < 10").select(F.col("desc_id").alias("vec_id"))


# Beyond SQL: tests hold the operators against numpy or properties


@query("jpeg_variants")
def jpeg_variants(spark, d):
    def one(row, image):
        for q in (10, 50, 90):
            yield {"image_id": row["image_id"], "quality": q, "error": round(float(np.abs(jpeg.round_trip(image, q).astype(int) - image).mean()), 6)}

    return pixels.map_images(S.tile_images(spark, d), one, "image_id long, quality int, error double")


@query("ms_ssim")
def ms_ssim(spark, d):
    def one(row, image):
        large = np.kron(image[..., 0], np.ones((5, 5)))
        yield {"image_id": row["image_id"], "ms_ssim": round(ssim.ms_ssim(large, np.roll(large, 1, 1), 255.0), 6)}

    return pixels.map_images(S.tile_images(spark, d), one, "image_id long, ms_ssim double")


@query("kmeans_train")
def kmeans_train(spark, d):
    return learn.kmeans(S.descriptors(spark, d).select("v"), 8)


@query("gmm_train")
def gmm_train(spark, d):
    return learn.gmm(S.descriptors(spark, d).select("v"), 4)


@query("pca_gram")
def pca_gram(spark, d):
    return learn.pca(encode.flat(_vlad(spark, d), S.codebook(spark, d), D), 8)


@query("image_clusters")
def image_clusters(spark, d):
    v = encode.flat(_vlad(spark, d), S.codebook(spark, d), D).withColumnRenamed("vector", "v")
    return encode.nearest(v, learn.kmeans(v.select("v"), 5)).select("image_id", "k")


@query("sift")
def sift_descriptors(spark, d):
    return sift.extract(S.tile_images(spark, d), contrast=0.005)


@query("root_sift")
def root_sift_descriptors(spark, d):
    return sift.extract(S.tile_images(spark, d), contrast=0.005, root=True)


@query("resize_640")
def resize_640(spark, d):
    """Digests of all tiles at the working size of 640 by 640."""
    return pixels.resize_images(S.tile_images(spark, d)).select("image_id", "height", "width", F.sha2("data", 256).alias("sha256"))


@query("pair_records")
def pair_records(spark, d):
    tiles = S.large_tiles(spark, d)
    truth = S.large_truth(spark, d)
    return sweep.pair_records(tiles, truth, {"u_net": sweep.stub_predictor(), "deeplabv3": sweep.stub_predictor(12)})


@query("per_image_records")
def per_image_records(spark, d):
    tiles = S.large_tiles(spark, d).withColumn("type", F.lit("train"))
    truth = S.large_truth(spark, d)
    own = S.descriptors(spark, d).withColumn("image_id", F.expr("desc_id div 25"))  # the vectors that a tile is made of
    predictors = {"u_net": sweep.stub_predictor(), "deeplabv3": sweep.stub_predictor(12)}
    return sweep.per_image_records(tiles, truth, own, S.codebook(spark, d), S.mixture(spark, d), D, predictors)


@query("similarity_heatmap", f"WITH {LONG}, n AS (SELECT image_id, desc_id, pos, x AS v, sqrt(sum(x * x) OVER (PARTITION BY desc_id)) AS n FROM l) SELECT x.image_id AS image_id, x.desc_id AS i, y.desc_id AS j, round(sum(x.v * y.v) / (max(x.n) * max(y.n)), 6) + 0.0 AS cos FROM n x JOIN n y ON x.image_id = y.image_id AND x.pos = y.pos GROUP BY ALL")
def similarity_heatmap(spark, d):
    """The matrix of every image with itself."""
    v = S.descriptors(spark, d).select("image_id", "desc_id", "v")
    return v.toDF("image_id", "i", "x").join(v.toDF("image_id", "j", "y"), "image_id").select("image_id", "i", "j", r6(V.cosine(F.col("x"), F.col("y"))).alias("cos"))

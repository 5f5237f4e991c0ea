"""Toxic passages by maximum-scoring segment search.

Terms and their stems (first characters) get a log-odds of the toxic against
the other class, with a Dirichlet prior from all labelled text; a term scores
by the stronger of them.  Every maximal scoring segment of a text is found
in one linear scan (Ruzzo and Tompa), and scores are put on an extreme-value
scale: in clean text of ``n`` terms the best segment exceeds ``x`` with
probability ``1 - exp(-K n exp(-lambda x))``.  A logistic curve over the
calibrated bits of the best segment, of all significant ones together and their
density turns that into a probability.

The classifier is fitted on at most ``per_class`` labelled rows of each class,
those of least hash; it keeps every term of theirs that says anything (a weight
other than 0).  Scoring reads all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .tables import read, stored

U = np.uint64
FEATURES = 4
#: Characters of the stems that speak for terms which are rare themselves.
STEMS = (4, 5, 6)


def held_out(key, modulus: int = 5):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(modulus)) == 0


def terms(texts):
    """Row slice, rows, hashes (of each term, then of its first characters) and row of each term.

    Terms are runs of letters, digits and non-ASCII, in lower case.  A term
    that is no longer than a stem has 0 in its place.
    """
    for rows, data, offs in K.chunks(texts, 2 * K.SPAN):
        start, end, row = K.spans(data, offs, K.PUNCT)
        chars = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        first = np.searchsorted(chars, start)
        h = np.zeros((len(start), 1 + len(STEMS)), U)
        h[:, 0] = K.hashes(data, start, end)
        for c, n in enumerate(STEMS, 1):
            to = chars[np.minimum(first + n, len(chars) - 1)]
            long = np.flatnonzero(to < end)
            h[long, c] = K.hashes(data, start[long], to[long], n)
        yield rows, len(offs) - 1, h, row


def lowered(column) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (sum, start, end) in linear time.

    Only terms above zero start or end one, so the scan steps over those.
    """
    up = np.flatnonzero(score > 0)
    if not len(up):
        return []
    run = np.r_[0.0, np.cumsum(score)]
    stack: list[list] = []  # left sum, right sum, start, end, place of the nearest earlier one with a lower left sum
    for i in up.tolist():
        low, high, start, end = float(run[i]), float(run[i + 1]), i, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                stack.append([low, high, start, end, j])
                break
            low, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(high - low, start, end) for low, high, start, end, _ in stack]


@dataclass
class Model:
    """Sorted term hashes with their log-odds, what every term loses (``other``), and the calibration."""

    value: np.ndarray
    weight: np.ndarray
    other: float
    decay: float = 1.0  # lambda
    spread: float = 1.0  # K
    curve: np.ndarray | None = None
    least: float = 3.0  # nats above chance that make a segment significant

    def scores(self, h: np.ndarray) -> np.ndarray:
        """Of each term: the strongest evidence of the term and its stems, or ``other``."""
        out = np.zeros(len(h))
        for column in h.T if len(self.value) else ():
            at = np.minimum(np.searchsorted(self.value, column), len(self.value) - 1)
            odds = np.where(self.value[at] == column, self.weight[at], 0)
            out = np.where(np.abs(odds) > np.abs(out), odds, out)
        return out + self.other

    def nats(self, found: list[tuple[float, int, int]], length: int) -> np.ndarray:
        """Calibrated nats above chance of segments of a text of ``length`` terms."""
        return self.decay * np.array([x for x, _, _ in found]) - np.log(max(self.spread * length, 1e-9))

    def passages(self, found: list[tuple[float, int, int]], length: int) -> list[tuple[float, int, int]]:
        """Significant segments: nats, first and last term."""
        return [(float(v), s, e) for v, (_, s, e) in zip(self.nats(found, length), found) if v >= self.least]

    def features(self, found: list[tuple[float, int, int]], length: int) -> list[float]:
        """Calibrated best segment, log of significant ones' sum, their number, and the share of terms in them."""
        if not found:
            return [0.0] * FEATURES
        nats = self.nats(found, length)
        high = nats >= self.least
        inside = sum(e - s for (_, s, e), k in zip(found, high) if k)
        return [float(np.clip(nats.max(), -10, 60)) / 10, float(np.log1p(nats[high].sum())), float(np.log1p(high.sum())), float(inside / length)]

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = self.curve[0] + features @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior: float, floor: float = 0.25, errors: float = 2.0) -> np.ndarray:
    """Shrunken log-odds of terms under a Dirichlet prior.

    The prior spreads ``prior`` pseudo-counts as in all text and adds ``floor``
    for each term, dealt to the classes by their size.  The estimate is moved
    to zero by ``errors`` standard errors, so that rare terms carry little.
    """
    both = toxic + clean
    total = max(1.0, both.sum())
    share = 2 * (both / total * prior + floor)
    a, b = toxic + share * toxic.sum() / total, clean + share * clean.sum() / total
    odds = np.log(np.maximum(a, 1e-9) / max(a.sum(), 1e-9)) - np.log(np.maximum(b, 1e-9) / max(b.sum(), 1e-9))
    error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return np.sign(odds) * np.maximum(0, np.abs(odds) - errors * error)


def build(value: np.ndarray, toxic: np.ndarray, clean: np.ndarray, prior: float, drift: float = 0.7) -> Model:
    """A model of term counts; ordinary terms lose ``drift``, so that segments end."""
    seen = np.flatnonzero(toxic + clean > 0)
    weight = np.clip(log_odds(toxic[seen], clean[seen], prior), -4, 8)
    some = np.flatnonzero(weight)  # a weight of 0 is what an unknown term has
    by = some[np.argsort(value[seen[some]])]
    return Model(value[seen[by]], weight[by], -drift)


def calibrate(best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """lambda and K of the extreme-value law from the best segments of clean texts (moments of the Gumbel law)."""
    if len(best) < 8 or not np.isfinite(best).all():
        return 1.0, 1.0
    level = best - np.log(np.maximum(length, 1)) if best.std() < 1e-9 else best
    decay = float(np.clip(np.pi / (np.sqrt(6) * max(level.std(), 1e-3)), 0.2, 3.0))
    return decay, float(np.exp(np.clip(np.mean(decay * best - np.log(np.maximum(length, 1))) - 0.5772156649, -12, 3)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method for a ridge-regularised logistic curve; the base rate alone if one class is missing."""
    one = np.c_[np.ones(len(x)), x]
    w = np.zeros(one.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = -5.0 if not len(y) or y.max() == 0 else 5.0
        return w
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        step = np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + penalty, one.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 4000, prior: float = 200.0, use=None) -> Model:
    """A model from labelled rows for which ``use`` (a condition on the key) holds.

    Two halves of the rows score each other for the calibration; the final
    terms come from all.  No labelled rows give a model that scores near zero.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    if use is not None:
        rows = rows.filter(use("_id"))
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y"))
    share = {r._y: r["count"] for r in rows.groupBy("_y").count().collect()}
    picked = None
    for y in (0, 1):
        some = rows.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    chosen = [(r._id, r._y) for r in picked.collect()]  # at most 2 * per_class rows
    small = spark.createDataFrame(chosen, f"_id {docs.schema[key].dataType.simpleString()}, _y int")
    sample = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(small), "_id").select(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(2)).cast("int").alias("fold"), "_y", "_t")
    sample = stored(spark, sample, "labelled")

    def count(batches):
        for batch in batches:
            group = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            for rows_, n, h, row in terms(lowered(batch.column(2))):
                h, row = h.reshape(-1), np.repeat(row, h.shape[1])
                h, row = K.distinct(h[h != 0], row[h != 0])  # a text counts once for a term, however often it repeats it
                g = group[rows_][row]
                for k in np.unique(g):
                    v, c = np.unique(h[g == k], return_counts=True)
                    yield pa.record_batch([pa.array(v.astype(np.int64)), pa.array(np.full(len(v), k, np.int32)), pa.array(c)], names=["term", "grp", "n"])

    per = [F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("n"))), F.lit(0)).cast("double").alias(f"g{g}") for g in range(4)]
    table = sample.mapInArrow(count, "term long, grp int, n long").groupBy("term").agg(*per)
    table = table.toArrow()  # terms of at most 2 * per_class rows
    value = table.column("term").to_numpy().view(U)
    g0, g1, g2, g3 = (table.column(f"g{i}").to_numpy() for i in range(4))
    crossed = [build(value, g3, g2, prior), build(value, g1, g0, prior)]  # each fold is scored by the other's counts
    sent = spark.sparkContext.broadcast(crossed)

    def best(batches):
        for batch in batches:
            fold = batch.column(0).to_numpy()
            for rows_, n, h, row in terms(lowered(batch.column(2))):
                cut = np.searchsorted(row, np.arange(n + 1))
                top = []
                for i in range(n):
                    s = sent.value[fold[rows_.start + i]].scores(h[cut[i] : cut[i + 1]])
                    top.append(max((x[0] for x in segments(s)), default=0.0))
                yield pa.record_batch([batch.column(1).slice(rows_.start, n), pa.array(top, pa.float64()), pa.array(np.diff(cut))], names=["y", "best", "n"])

    got = sample.mapInArrow(best, "y int, best double, n long").toArrow()
    y, top, n = (got.column(c).to_numpy() for c in ("y", "best", "n"))
    clean = (y == 0) & (n > 0)
    decay, spread = calibrate(top[clean], n[clean])
    for m in crossed:
        m.decay, m.spread = decay, spread
    sent2 = spark.sparkContext.broadcast(crossed)

    def measure(batches):
        for batch in batches:
            fold = batch.column(0).to_numpy()
            for rows_, n_, h, row in terms(lowered(batch.column(2))):
                cut = np.searchsorted(row, np.arange(n_ + 1))
                x = [(m := sent2.value[fold[rows_.start + i]]).features(segments(m.scores(h[cut[i] : cut[i + 1]])), cut[i + 1] - cut[i]) for i in range(n_)]
                yield pa.record_batch([batch.column(1).slice(rows_.start, n_), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = sample.mapInArrow(measure, "y int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, FEATURES)
    final = build(value, g1 + g3, g0 + g2, prior)
    y = got.column("y").to_numpy()
    final.decay, final.spread, final.curve = decay, spread, logistic(x, y.astype(float))
    if len(share) == 2 and 0 < y.sum() < len(y):  # the sample has the classes in another proportion than the labels
        final.curve[0] += np.log(share[1] / share[0] * (y == 0).sum() / (y == 1).sum())
    return final


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", passages: str | None = None) -> DataFrame:
    """All rows and columns and a probability; with ``passages`` also (nats, first term, last term) of significant segments.

    Null, empty and blank texts get what the curve gives for no segment.  Every
    row gives one, repeats and null keys too; texts are read whole; an empty
    table gives none.  Columns with the names of the new ones are replaced.
    """
    docs = docs.drop(name, *([passages] if passages else []))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text)
    extra = [name, *([passages] if passages else [])]

    def run(batches):
        m = sent.value
        for batch in batches:
            p, found = [], []
            for _, n, h, row in terms(lowered(batch.column(at))):
                every, cut = m.scores(h), np.searchsorted(row, np.arange(n + 1))
                some = np.bincount(row[every > 0], minlength=n) > 0
                x, parts = np.zeros((n, FEATURES)), [[] for _ in range(n)]
                for i in np.flatnonzero(some).tolist():
                    size, every_one = int(cut[i + 1] - cut[i]), segments(every[cut[i] : cut[i + 1]])
                    x[i] = m.features(every_one, size)
                    if passages:
                        parts[i] = [{"nats": v, "first": int(s), "last": int(e) - 1} for v, s, e in m.passages(every_one, size)]
                p.append(m.probability(x))
                found += parts
            columns = [*batch.columns, pa.array(np.concatenate(p) if p else np.zeros(0))]
            if passages:
                columns.append(pa.array(found, pa.list_(pa.struct([("nats", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))))
            yield pa.record_batch(columns, names=[*names, *extra])

    more = ", `%s` array<struct<nats:double,first:bigint,last:bigint>>" % passages if passages else ""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` double{more}")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability of the label for every document, learned from those that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"), use=lambda k: ~held_out(k))
    out = score(docs, model, passages="passages")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))

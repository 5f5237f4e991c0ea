"""Line dedup by a deletion-neighbourhood join.

Two lines are copies when they are equal or, from ``least`` characters on, one
edit (a character put in, taken out or replaced) apart; a line goes when an
earlier copy stands anywhere in the corpus.  "Earlier" is by (key, line number).
Empty lines stay.

1. Equal lines of ``equal`` characters or more meet by a 128-bit hash.  Of each
   only the first occurrence goes on, if it has ``least`` characters.
2. One edit leaves a half of a line as it is.  Lines that share no half with
   another line have no copy one edit away, so they emit nothing (a bitmap of
   the shared halves may let a few of them emit all the same).
3. The others emit the hashes of all variants with one character less in the
   half that may differ, each with the place of the character, and their own
   hash.  Lines one replacement apart share a variant and the place; where one
   has a character more, a variant of it is the other line.  As the lines of one
   variant and place are all copies of each other, each is joined to the
   earliest only: no bucket makes pairs.
4. The texts of these pairs are fetched and the edit distance is verified.

Which lines take part in 3 and 4 goes to the tasks as a bitmap sized by their
number, up to 32 MB; what it lets through by chance is a line all the same and is
verified as any.  Beyond that, a join hands each text its lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .tables import bitmap, bits_for, discard, read, stored

U = np.uint64
BREAK = np.zeros(256, bool)
BREAK[10] = True
PREFIX, SUFFIX, TEXT = 1, 2, 3
#: Names that no input has.
OWNER, OWN_TEXT, LOST, HELD = "__tessera_owner", "__tessera_own_text", "__tessera_lost", "__tessera_held"


def tag(key: np.ndarray, h1: np.ndarray, side) -> np.ndarray:
    """One hash for a line (by its hash) under a key and what is asked of it."""
    side = np.asarray(side, np.int64).astype(U)
    return K.mix(K.mix(key.astype(np.int64).view(U) ^ U(0x9E3779B97F4A7C15)) + (h1.astype(np.int64).view(U) ^ side * U(0xD1342543DE82EF95)))


def split(column, least: int):
    """Per chunk: row slice, bytes, and start, end, row, number and characters of each line of ``least`` characters or more."""
    for rows, data, offs in K.chunks(column):
        breaks = np.flatnonzero(data == 10)
        start, end, row = K.spans(data, offs, BREAK)
        number = np.searchsorted(breaks, start) - np.searchsorted(breaks, offs[row])
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        low = np.searchsorted(chars, start)
        n = np.searchsorted(chars, end) - low
        keep = n >= least
        yield rows, data, chars, low[keep], start[keep], end[keep], row[keep], number[keep], n[keep]


def _lines(least: int, equal: int):
    def run(batches):
        for batch in batches:
            for rows, data, chars, low, start, end, row, number, n in split(batch.column(2), equal):
                half, odd = n // 2, n % 2
                at = np.r_[chars, len(data)]
                keys, short = [], n < least  # short lines are equal or not copies: no halves
                for side, length in ((PREFIX, half), (PREFIX, half - 1 + 2 * odd), (SUFFIX, half), (SUFFIX, half + 1)):
                    s, e = (start, at[low + length]) if side == PREFIX else (at[low + n - length], end)
                    keys.append(K.mix(K.hashes(data, s, e) * U(4) + U(side)).astype(np.int64))
                h1 = K.hashes(data, start, end)
                own = [batch.column(c).slice(rows.start).take(pa.array(row)) for c in (0, 1)]
                yield pa.record_batch(
                    [*own, pa.array(number.astype(np.int32)), pa.array(_again(row, h1)), pa.array(h1.astype(np.int64)), pa.array(K.hashes(data, start, end, 7).astype(np.int64)), *(pa.array(k, mask=short) for k in keys)],
                    names=["key", "t", "line", "again", "h1", "h2", "p1", "p2", "s1", "s2"],
                )

    return run


def _again(row: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """Which lines stand in their text before."""
    by = np.lexsort((h1, row))
    out = np.zeros(len(row), bool)
    out[by[1:]] = (row[by[1:]] == row[by[:-1]]) & (h1[by[1:]] == h1[by[:-1]])
    return out


def _tags(batch: pa.RecordBatch) -> np.ndarray:
    return tag(*(batch.column(c).to_numpy() for c in ("key", "h1", "side")))


class Listed:
    """The tags that a batch brings along."""

    def __init__(self, batch: pa.RecordBatch):
        marks = batch.column("marks")
        of = np.repeat(batch.column("key").to_numpy(), np.diff(marks.offsets.to_numpy()))
        h1, side = (marks.flatten().field(c).to_numpy() for c in ("h1", "side"))
        self.tags = np.unique(tag(of, h1, side))

    def has(self, value: np.ndarray) -> np.ndarray:
        return np.isin(value, self.tags)


def asking(docs: DataFrame, wanted: DataFrame, work, schema: str) -> DataFrame:
    """``work(batch, asked)`` over texts with lines in ``wanted`` (key, h1, side); ``asked.has`` takes tags."""
    bits = bits_for(wanted.count())
    if bits:
        sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, _tags, bits))
        return docs.mapInArrow(lambda batches: (x for b in batches for x in work(b, sent.value)), schema)
    marks = wanted.groupBy("key").agg(F.collect_list(F.struct("h1", "side")).alias("marks"))
    return docs.join(marks, "key").select("key", "t", "body", "marks").mapInArrow(lambda batches: (x for b in batches for x in work(b, Listed(b))), schema)


def met(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among ``values``, so that fewer go to a join; all of them beyond a bitmap."""
    bits = bits_for(values.count())
    if not bits:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(values, lambda b: b.column(0).to_numpy().view(U), bits))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sent.value.has(b.column(column).to_numpy().view(U))))

    return rows.mapInArrow(run, rows.schema)


def sharing(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, h1, side) of ``lines`` with a half in ``shared``; by a bitmap, with the few that it lets through by chance, or by a join."""
    spark, sides = lines.sparkSession, ((PREFIX, ("p1", "p2")), (SUFFIX, ("s1", "s2")))
    bits = bits_for(shared.count())
    if not bits:
        each = F.explode(F.array(*[F.struct(F.col(c).alias("half"), F.lit(s).alias("side")) for s, own in sides for c in own]))
        return lines.select("key", "h1", each.alias("x")).select("key", "h1", "x.*").join(shared, "half", "left_semi").select("key", "h1", "side")
    sent = spark.sparkContext.broadcast(bitmap(shared, lambda b: b.column(0).to_numpy().view(U), bits))

    def run(batches):
        for b in batches:
            for side, own in sides:
                some = np.logical_or(*(sent.value.has(b.column(c).to_numpy().view(U)) for c in own))
                part = b.select(["key", "h1"]).filter(pa.array(some))
                yield part.append_column("side", pa.array(np.full(part.num_rows, side, np.int32)))

    return lines.mapInArrow(run, "key long, h1 long, side int")


def _variants(least: int):
    def work(batch, asked):
        key, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for rows, data, _, _, start, end, row, number, n in split(batch.column(2), least):
            of, text, h1 = key[rows.start + row], t[rows.start + row], K.hashes(data, start, end)
            sides = asked.has(tag(of, h1, PREFIX)) * PREFIX + asked.has(tag(of, h1, SUFFIX)) * SUFFIX
            value, place, who, size = [], [], [], 0
            hit = np.flatnonzero((sides > 0) & ~_again(row, h1))
            for i in hit.tolist():
                m = int(n[i])
                first = 0 if sides[i] & SUFFIX else max(0, m // 2 - 1)
                last = m if sides[i] & PREFIX else min(m, m - m // 2 + 1)
                value += [h1[i : i + 1], K.deletions(data[start[i] : end[i]], first, last)]
                place.append(np.r_[-1, np.arange(first, last)])
                who.append(i)
                size += last - first + 1
                if size >= 1 << 17 or i == hit[-1]:
                    w = np.repeat(who, [len(p) for p in place])
                    yield pa.record_batch([pa.array(np.concatenate(value).astype(np.int64)), pa.array(np.concatenate(place).astype(np.int32)), *(pa.array(c[w].astype(k)) for c, k in ((of, np.int64), (number, np.int32), (text, np.int64), (h1, np.int64)))], names=["v", "place", "key", "line", "t", "h1"])
                    value, place, who, size = [], [], [], 0

    return work


def _fetch(least: int):
    def work(batch, asked):
        key, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for rows, data, _, _, start, end, row, number, _ in split(batch.column(2), least):
            of, h1 = key[rows.start + row], K.hashes(data, start, end)
            hit = np.flatnonzero(asked.has(tag(of, h1, TEXT)) & ~_again(row, h1))
            text = [data[start[i] : end[i]].tobytes().decode() for i in hit]
            yield pa.record_batch([pa.array(of[hit].astype(np.int64)), pa.array(number[hit].astype(np.int32)), pa.array(t[rows.start + row[hit]].astype(np.int64)), pa.array(text, pa.string())], names=["key", "line", "t", "text"])

    return work


def repeated(df: DataFrame, key: str, text: str, least: int = 16, equal: int | None = None) -> DataFrame:
    """(key, t, line, first_key, near): lines that go, ``t`` the xxhash64 of their text, and the key that holds their earlier copy."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("t"), F.col(text).alias("body")).filter("key is not null")
    found = docs.select("key", "t", "body").mapInArrow(_lines(least, least if equal is None else min(least, equal)), "key long, t long, line int, again boolean, h1 long, h2 long, p1 long, p2 long, s1 long, s2 long")
    lines = stored(spark, found, "lines")
    halves = [F.first(c).alias(c) for c in ("p1", "p2", "s1", "s2")]
    unique = stored(spark, lines.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("n"), *halves), "unique")
    often = unique.filter("n > 1").select("h1", "h2", F.col("key").alias("first_key"))
    same = met(lines.select("key", "t", "line", "again", "h1", "h2"), often.select("h1"), "h1").join(often, ["h1", "h2"]).filter("again or key > first_key")
    same = same.select("key", "t", "line", "first_key", F.lit(False).alias("near"))

    long = unique.filter("p1 is not null").select("key", "h1", "p1", "p2", "s1", "s2")
    half = long.select(F.explode(F.array("p1", "p2", "s1", "s2")).alias("half"))
    shared = stored(spark, half.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half"), "shared")
    taking = stored(spark, sharing(long, shared), "taking")
    variants = asking(docs, taking, _variants(least), "v long, place int, key long, line int, t long, h1 long").select("v", "place", F.struct("key", "line", "t", "h1").alias("ref")).repartition("v")
    own, cut = F.when(F.col("place") < 0, F.col("ref")), F.when(F.col("place") >= 0, F.col("ref"))
    with_v = W.partitionBy("v")
    seen = variants.withColumn("same", F.min("ref").over(W.partitionBy("v", "place"))).withColumn("own", F.min(own).over(with_v)).withColumn("cut", F.min(cut).over(with_v))
    first = F.when(F.col("place") < 0, F.array("cut")).otherwise(F.array("own", "same"))
    pairs = seen.select("ref", F.explode(first).alias("first")).filter("first < ref and (first.key <> ref.key or first.t = ref.t)").distinct()
    pairs = stored(spark, pairs, "pairs")

    ends = pairs.select("ref.key", "ref.h1").union(pairs.select("first.key", "first.h1")).distinct().withColumn("side", F.lit(TEXT))
    texts = stored(spark, asking(docs, ends, _fetch(least), "key long, line int, t long, text string").dropDuplicates(["key", "line", "t"]), "texts")
    at = ("key", "line", "t")
    both = pairs.select(*[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("ref", "first") for c in at])
    for end, name in (("ref", "a"), ("first", "b")):
        both = both.join(texts.toDF(*[f"{end}_{c}" for c in at], name), [f"{end}_{c}" for c in at])
    apart = F.levenshtein("a", "b", 1)
    near = both.filter((apart >= 0) & (apart <= 1)).groupBy(*[F.col(f"ref_{c}").alias(c) for c in at]).agg(F.min("first_key").alias("first_key"))
    near = near.select("key", "t", "line", "first_key", F.lit(True).alias("near"))
    out = stored(spark, same.unionByName(near), "repeated")
    for table in (lines, unique, shared, taking, pairs, texts):
        discard(table)
    return out


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 16, equal: int | None = None) -> DataFrame:
    """All rows and columns, ``text`` without its repeated lines, and n_lines, n_dropped, originals.

    Lines end at line feeds.  Of lines with fewer than ``least`` characters only
    equal copies go, and those of fewer than ``equal`` (``least`` if not given) stay, as empty lines do.
    ``originals`` are the keys that hold the earlier copies.  Null and empty
    texts stay as they are, as do rows with a null key.  Equal rows are one
    document and lose the same lines; rows that share a key only are not
    compared with each other, and a line that they share stays in each.
    The key is a whole number; ValueError for another.  Columns of ``df``
    with the names of the new ones are replaced.
    """
    if df.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"the key must be a whole number: {key}")
    made = ("n_lines", "n_dropped", "originals")
    columns = [c for c in df.columns if c not in made]
    gone = repeated(df, key, text, least, equal).groupBy(F.col("key").alias(OWNER), F.col("t").alias(OWN_TEXT)).agg(F.collect_set("line").alias(LOST), F.array_sort(F.collect_set("first_key")).alias(HELD))
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(LOST))
    body = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    out = df.select(*columns).join(gone, (F.col(key) == F.col(OWNER)) & (F.xxhash64(text) == F.col(OWN_TEXT)), "left")
    none = F.array().cast("array<bigint>")
    return out.select(
        *[F.when(F.col(LOST).isNull(), F.col(text)).otherwise(body).alias(text) if c == text else F.col(c) for c in columns],
        F.coalesce(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(LOST), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(HELD, none).alias("originals"),
    )


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines without copies: counts, where the originals are, and a digest of what stays."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), equal=1)
    return out.select("doc_id", "n_lines", "n_dropped", "originals", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

"""Benchmark decontamination: containment search for short items in long texts.

An item leaks into a document that has at least ``percent`` of the item's
word shingles.  Jaccard similarity says little where one side is a hundred
times longer, so an item is looked for by a bottom-k MinHash sketch whose
members are tested against the document's full set.  Items are partitioned by
size: an item of ``n`` shingles may lack ``n - ceil(percent * n / 100)`` of
them, and a sketch of one more than that must meet every document that holds
the rest.  Candidates are thus complete; only they are verified, by looking up
the item's whole shingle set in the document.

Items of fewer words than a shingle are a size class of their own: a document
holds such an item if its words stand in it one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .minhash import _unsigned
from .tables import read, stored

U = np.uint64


def _lookup(value: np.ndarray, keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``value``, owner) of each equal pair; ``keys`` ascend and may repeat."""
    low, high = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
    hit = np.flatnonzero(high > low)
    n = (high - low)[hit]
    at = np.repeat(low[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(hit, n), owner[at]


class Index:
    """Items by size class: sketch members of each, and all shingles of the items for verification."""

    def __init__(self, items: list, words: np.ndarray, value: np.ndarray, size: np.ndarray, k: int, percent: int):
        self.items, self.size, self.k = np.asarray(items), size, k
        self.need = -(-percent * size // 100)
        self.kinds, self.at = np.unique(value, return_inverse=True)
        self.first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((K.mix(value), owner))  # bottom-k: the least mixed values of each item
        rank = np.arange(len(value)) - np.repeat(self.first, size)
        order = order[(rank < np.repeat(size - self.need + 1, size)) & (words[owner] >= k)]
        classes = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        self.sketches, self.short = [], []
        for c in np.unique(classes[owner[order]]):
            own = order[classes[owner[order]] == c]
            own = own[np.argsort(value[own], kind="stable")]
            self.sketches.append((value[own], owner[own]))
        for m in np.unique(words[words < k]).tolist():
            own = np.flatnonzero(words == m)
            own = own[np.argsort(value[self.first[own]], kind="stable")]
            self.short.append((m, value[self.first[own]], own))

    def search(self, word: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, items and shared shingles of all leaks, from the word hashes of some texts."""
        value, of, _ = K.shingles(word, row, n_rows, self.k)
        n = len(self.size)
        at = np.minimum(np.searchsorted(self.kinds, value), len(self.kinds) - 1)
        known = self.kinds[at] == value
        value, of, at = value[known], of[known].astype(np.int64), at[known]
        found = [np.zeros(0, np.int64)]
        for keys, owner in self.sketches:
            hit, item = _lookup(value, keys, owner)
            found.append(of[hit] * n + item)
        pair = np.unique(np.concatenate(found))
        r, o = pair // n, pair % n
        # Only candidates are verified: each shingle of theirs is looked up in its text.
        held, width = np.unique(of * len(self.kinds) + at), self.size[o]
        place = np.repeat(self.first[o] - np.cumsum(width) + width, width) + np.arange(width.sum())
        asked = np.repeat(r, width) * len(self.kinds) + self.at[place]
        there = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked if len(held) else np.zeros(len(asked), bool)
        shared = np.bincount(np.repeat(np.arange(len(pair)), width), there, len(pair)).astype(np.int64)
        keep = shared >= self.need[o]
        out = [(r[keep], o[keep], shared[keep])]
        for m, keys, own in self.short:
            value, of = K.phrases(word, row, m)
            hit, item = _lookup(value, keys, own)
            pair = np.unique(of[hit].astype(np.int64) * n + item)
            out.append((pair // n, pair % n, np.ones(len(pair), np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out))


def _words(texts) -> Iterator[tuple[slice, np.ndarray, np.ndarray, int]]:
    for rows, data, offs in K.chunks(texts):
        data = K.LOWER[data]
        start, end, row = K.spans(data, offs)
        yield rows, K.hashes(data, start, end), row, len(offs) - 1


def indexes(items: DataFrame, key: str, text: str, k: int, percent: int, block: int) -> Iterator[Index]:
    """Indexes of about ``block`` shingles (or one item) each; items without words are not looked for."""

    def run(batches):
        for batch in batches:
            for rows, word, row, n in _words(batch.column(1)):
                value, of, count = K.shingles(word, row, n, k)
                value, of = K.distinct(value, of)
                ends = np.r_[0, np.cumsum(np.bincount(of, minlength=n))].astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(rows.start, n), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.int64)))], names=["item", "words", "grams"])

    asked = items.select(key, text).filter(F.col(key).isNotNull())
    made = asked.mapInArrow(run, f"item {items.schema[key].dataType.simpleString()}, words long, grams array<long>").filter("words > 0")
    whole = stored(items.sparkSession, made, "items")
    total = whole.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    parts = max(1, -(-total // block))
    for p in range(parts):
        rows = whole.filter(F.pmod(F.xxhash64("grams"), F.lit(parts)) == p).toArrow()
        if len(rows):
            value, size = _unsigned(rows.column("grams"))
            yield Index(rows.column("item").to_pylist(), rows.column("words").to_numpy(), value, size, k, percent)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80, block: int = 2_000_000) -> DataFrame:
    """(key, item, n_item, n_shared) of every item that leaks into a row of ``docs``.

    Shingles are ``k`` words, lower-cased A-Z, cut at ASCII white space; an
    item of fewer words is one shingle of all its words, found wherever they
    stand in a row.  Null or blank texts and items give nothing, as do items
    with a null key.  Repeated rows and items each have their own rows; rows
    with a null key are searched too.  Texts are read whole.  An empty side
    gives no rows.  Other columns play no part; ValueError if a key has the
    name of a new column or both have the same name.  The items are a stated
    query set: they are sent to all tasks in blocks of about ``block`` shingles,
    and the documents are read once for each block, in place.
    """
    if len({key, item, "n_item", "n_shared"}) < 4:
        raise ValueError(f"names clash: {key}, {item}")
    spark = docs.sparkSession
    types = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"`{key}` {types[0]}, `{item}` {types[1]}, n_item long, n_shared long"
    out = spark.createDataFrame([], schema)
    for index in indexes(items, item, item_text, k, percent, block):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                for rows, word, row, n in _words(batch.column(1)):
                    r, o, shared = index.search(word, row, n)
                    if len(r):
                        of = batch.column(0).take(pa.array(r + rows.start))
                        yield pa.record_batch([of, pa.array(index.items[o]), pa.array(index.size[o].astype(np.int64)), pa.array(shared)], names=[key, item, "n_item", "n_shared"])

        out = out.unionByName(docs.select(key, text).mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns; rows with a null key stay."""
    found = stored(docs.sparkSession, leaks(docs, items, key=key, **options).select(key).distinct(), "leaks")
    return docs.join(found, key, "left_anti").select(*docs.columns)


def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item with 80 % of its five-word shingles in a document."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH words AS (
  SELECT true AS item, item_id AS id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark
  UNION ALL
  SELECT false, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM documents),
lengths AS (SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE item AND len(w) > 0),
grams AS (
  SELECT DISTINCT item, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM words JOIN lengths ON CASE WHEN item THEN k = least(len(w), 5) ELSE k <= len(w) END),
sized AS (SELECT id, k, g, count(*) OVER (PARTITION BY id) AS n FROM grams WHERE item)
SELECT d.id AS doc_id, s.id AS item_id, s.n AS n_item, count(*) AS n_shared
FROM sized s JOIN grams d ON NOT d.item AND d.k = s.k AND d.g = s.g
GROUP BY ALL HAVING 100 * count(*) >= 80 * s.n
"""

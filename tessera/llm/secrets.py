"""Secret scans with multipart credential linking, in DataFrame functions only.

Positions come from splitting a text at the matches of a pattern: pieces and
matches alternate, so their running lengths are the offsets (code points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import read, stored

#: Kinds in their order: pattern, the group whose length counts, its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Weak parts: reported only beside a complementary one.
WEAK = {
    "id": (r"(?<![A-Za-z0-9])(?:A3T[A-Z0-9]|AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{10,}", 0, 14),
    "blob": (r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    "endpoint": (r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+|(?<![A-Za-z0-9.-])[a-z0-9.-]+\.amazonaws\.com""", 0, 8),
}
#: Which parts make each weak kind a finding.
PARTNERS = {"id": ("blob", "assign", "hex", "endpoint"), "blob": ("id", "access", "endpoint"), "endpoint": ("id", "access", "blob", "assign")}
ORDER = [*BASE, *(f"linked_{k}" for k in WEAK)]


def lengths(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """For each leftmost non-overlapping match: the text before it and it, in code points, and whether its group is long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    both = F.arrays_zip(F.split(text, pattern, -1).alias("a"), whole.alias("b"), part.alias("c"))
    made = F.transform(
        F.filter(both, lambda x: x.b.isNotNull()),
        lambda x, i: F.struct(F.lit(kind).alias("k"), i.alias("i"), F.length(x.a).alias("gap"), F.length(x.b).alias("len"), (F.length(x.c) >= least).alias("ok")),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), made).otherwise(made_none())


def made_none() -> Column:
    return F.array().cast("array<struct<k:int,i:int,gap:int,len:int,ok:boolean>>")


def scan(df: DataFrame, key: str, text: str, scope: int = 240) -> DataFrame:
    """Columns ``key`` and ``spans``, an array of (start, k, end) by start, then k (a place in ``ORDER``).

    Base kinds stand by themselves.  A weak identifier, secret or endpoint
    outside them is added when a complementary part starts within ``scope``
    code points of its start.  The parts of a row are swept in order, keeping
    the nearest start of each kind on either side, so the interval join makes
    no pairs.  Null text is empty; rows without a span have an empty array;
    repeated rows, and rows with a null key, each keep their own.  Texts are
    read whole, whatever their length.  An empty table gives no rows, and other
    columns, whatever their names, play no part.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = BASE | WEAK
    names, n_base = list(kinds), len(BASE)
    found = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key), body.alias("_t"))
    found = found.select("_row", key, F.concat(*[lengths(F.col("_t"), i, *kinds[k]) for i, k in enumerate(names)]).alias("parts"))
    found = stored(df.sparkSession, found, "parts")
    parts = found.select("_row", F.inline("parts"))
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("_row", "k").orderBy("i"))
    parts = parts.withColumn("e", end.cast("int")).filter("ok").select("_row", (F.col("e") - F.col("len")).alias("s"), "k", "e")
    order = W.partitionBy("_row").orderBy("s", "k", "e")
    before, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    start = lambda j: F.when(F.col("k") == j, F.col("s"))
    covered = F.coalesce(F.max(F.when(F.col("k") < n_base, F.col("e"))).over(before) > F.col("s"), F.lit(False))
    seen = parts.withColumn("covered", covered & (F.col("k") >= n_base))
    for j, name in enumerate(names):
        live = F.when(~F.col("covered"), start(j))
        gap = F.least(F.col("s") - F.max(live).over(before), F.min(live).over(after) - F.col("s"))
        seen = seen.withColumn(f"d_{name}", F.coalesce(gap, F.lit(scope + 1)))
    linked = F.lit(False)
    for name, others in PARTNERS.items():
        linked = linked | ((F.col("k") == names.index(name)) & (F.least(*[F.col(f"d_{o}") for o in others]) <= scope))
    kept = seen.filter((F.col("k") < n_base) | (~F.col("covered") & linked))
    spans = kept.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("spans"))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return found.select("_row", key).join(spans, "_row", "left").select(key, F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x.k), x.s, x.e)), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, a digest of their spans, and all spans with linked parts."""
    got = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    base = F.filter("spans", lambda x: x.k < len(BASE))
    of = lambda i: F.filter("spans", lambda x: x.k == i)  # noqa: E731  a second parameter would be the place
    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return got.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

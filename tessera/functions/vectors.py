"""Column functions over arrays of doubles and over pixel values.

All are built-in expressions; none leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, also where ``f`` uses it inside a lambda of its own."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def distance2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(v: Column, p: float = 2) -> Column:
    """The L-p norm; ``float('inf')`` gives the largest magnitude. ValueError for p <= 0."""
    if p <= 0:
        raise ValueError("the order of a norm is positive")
    if p == float("inf"):
        return F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0))
    if p == 1:
        return total(F.transform(v, F.abs))
    if p == 2:
        return F.sqrt(dot(v, v))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.coalesce(dot(a, b) / F.nullif(size, F.lit(0.0)), F.lit(0.0))


def sign_power(x: Column, a: float = 0.5) -> Column:
    """``sign(x) * |x| ** a``. ValueError unless 0 <= a <= 1."""
    if not 0 <= a <= 1:
        raise ValueError("the power must be within [0, 1]")
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(a)))


def lp_normalize(v: Column, p: float = 2, eps: float = EPS) -> Column:
    return let(v, lambda u: let(norm(u, p) + F.lit(eps), lambda n: F.transform(u, lambda x: x / n)))


def root_sift(v: Column) -> Column:
    """``sqrt(d / (sum(d) + 1e-7))`` for descriptors without negative values."""
    return let(total(v) + F.lit(1e-7), lambda n: F.transform(v, lambda x: F.sqrt(x / n)))


def clamp_quality(q: Column) -> Column:
    return F.greatest(F.lit(0), F.least(q, F.lit(100)))


def truncated(points: Column) -> Column:
    """(x, y) pairs with both parts cut toward zero."""
    return F.transform(points, lambda p: F.struct(p.x.cast("int").alias("x"), p.y.cast("int").alias("y")))


def is_subset(a: Column, b: Column) -> Column:
    """Whether every element of ``a`` is in ``b``; an error if ``a`` has more elements (repeats count)."""
    fail = F.raise_error(F.lit("the first list is longer than the second")).cast("boolean")
    return F.when(F.size(a) > F.size(b), fail).otherwise(F.size(F.array_except(a, b)) == 0)


def gray_bgr(b: Column, g: Column, r: Column) -> Column:
    """Luma of channels given in BGR order."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def checked_range(v: Column, low: float, high: float) -> Column:
    """``v``, or an error outside the range."""
    return F.when(v.between(low, high), v).otherwise(F.raise_error(F.lit("a pixel is out of range")).cast("double"))

"""Vector expressions as Spark columns.

Everything here stays in the JVM. Elements are cast to double before any
multiplication, so results do not depend on the stored element type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of each space.
SPACE_NAMES = {
    "l2": "l2",
    "l2_squared": "l2",
    "innerproduct": "innerproduct",
    "inner_product": "innerproduct",
    "cosine": "cosine",
    "cosinesimil": "cosine",
}

#: Distances are rounded to this many decimals before they are ranked or
#: compared with a threshold, so copies of a vector tie wherever they are read.
RANK_DECIMALS = 9


def space_of(name: str) -> str:
    """Canonical space (``l2``, ``innerproduct`` or ``cosine``) for any accepted spelling."""
    try:
        return SPACE_NAMES[name]
    except KeyError:
        raise ValueError(f"unsupported space {name!r}; use one of {sorted(SPACE_NAMES)}") from None


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit vector in the direction of ``v``; a zero vector is returned as is."""
    d, n = as_doubles(v), norm(v)
    return F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)


def scale(v: Column, factor: Column) -> Column:
    return F.transform(as_doubles(v), lambda x: x * factor)


def distance(a: Column, b: Column, space: str) -> Column:
    """Smaller is closer: squared L2, negated inner product, or 1 - cosine.

    Cosine with a zero vector is NULL, which no predicate or ranking accepts.
    """
    space = space_of(space)
    if space == "l2":
        squares = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))
        return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    if space == "innerproduct":
        return -dot(a, b)
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(a: Column, b: Column) -> Column:
    """Raw inner product: larger is closer. Not a distance."""
    return dot(a, b)


def score(d: Column, space: str) -> Column:
    """Larger-is-better score of a distance produced by :func:`distance`."""
    space = space_of(space)
    if space == "l2":
        return F.lit(1.0) / (F.lit(1.0) + d)
    if space == "cosine":
        return (F.lit(2.0) - d) / F.lit(2.0)
    return F.when(d >= 0, F.lit(1.0) / (F.lit(1.0) + d)).otherwise(F.lit(1.0) - d)


def similarity_score(s: Column) -> Column:
    """Score of a raw inner product ``s``; equals :func:`score` at distance ``-s``."""
    return F.when(s > 0, s + F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) - s))


def distance_to_score(threshold: float, space: str) -> float:
    """Score threshold that accepts the same rows as a distance threshold."""
    space = space_of(space)
    if space == "l2":
        return 1.0 / (1.0 + threshold)
    if space == "cosine":
        return (2.0 - threshold) / 2.0
    return 1.0 / (1.0 + threshold) if threshold >= 0 else 1.0 - threshold


def score_to_distance(threshold: float, space: str) -> float:
    """Inverse of :func:`distance_to_score`; infinite where every row qualifies."""
    space = space_of(space)
    if space == "cosine":
        return 2.0 - 2.0 * threshold
    if threshold <= 0:
        return float("inf")
    if space == "innerproduct" and threshold >= 1:
        return 1.0 - threshold
    return 1.0 / threshold - 1.0


def within(d: Column, max_distance: float) -> Column:
    """Inclusive upper bound on a distance."""
    return d <= F.lit(float(max_distance))


def at_least(s: Column, min_score: float) -> Column:
    """Inclusive lower bound on a score. NaN compares above everything in Spark, so it is excluded."""
    return (s >= F.lit(float(min_score))) & ~F.isnan(s)


def pad(ids: Column, width: int, fill: int = -1) -> Column:
    """Fixed-width id array: cut to ``width`` or filled up with ``fill``."""
    filler = F.array_repeat(F.lit(fill).cast("bigint"), width)
    return F.slice(F.concat(ids.cast("array<bigint>"), filler), 1, width)


def first_k(ids: Column, k: int) -> Column:
    return F.slice(ids, 1, k)


def well_formed(v: Column, dim: int) -> Column:
    """True when a vector has the mapped dimension and no NULL or NaN element."""
    ok = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce(ok, F.lit(False))

"""Vector arithmetic as column expressions over ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def usable(v: Column) -> Column:
    """Whether a vector can be compared: not null, not all zero, all parts finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (squared_norm(v) > 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Null if the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def normalized(v: Column) -> Column:
    """Null for a zero vector. The norm is computed once, not per part."""
    return F.get(F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))), 0)


def angular_distance(unit_a: Column, unit_b: Column) -> Column:
    """1 - cos, in [0, 2]."""
    return 1 - dot(unit_a, unit_b)


def squared_euclidean(a: Column, b: Column, sqnorm_a: Column, sqnorm_b: Column) -> Column:
    """From precomputed squared norms, with one dot product; never below 0."""
    return F.greatest(F.lit(0.0), sqnorm_a + sqnorm_b - 2 * dot(a, b))


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def padded(v: Column, multiple: int = 8) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), (F.lit(multiple) - F.size(v) % multiple) % multiple))

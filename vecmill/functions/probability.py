"""Collision and failure probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def simhash_collision(distance: Column) -> Column:
    """Chance that one sign function agrees, from the angular distance."""
    return 1 - F.acos(clamp(1 - distance)) / F.lit(math.pi)


def simhash_collision_znorm(zeucl: Column, dim: int) -> Column:
    """The same from the Euclidean distance of two z-normalized series of length ``dim``."""
    return 1 - F.acos(clamp((2.0 * dim - zeucl * zeucl) / (2.0 * dim))) / F.lit(math.pi)


#: The coefficients of a standard rational approximation of the error function (error below 1.5e-7).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / F.lit(math.sqrt(2))
    t = 1 / (1 + ERF_P * z)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x < 0, (1 - erf) / 2).otherwise((1 + erf) / 2)


def pstable_collision(distance: Column, width: Column | float) -> Column:
    """Chance that one 2-stable function of slot ``width`` agrees at a Euclidean distance above 0."""
    width = width if isinstance(width, Column) else F.lit(float(width))
    c = width / distance
    return 1 - 2 * normal_cdf(-c) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - F.exp(-c * c / 2))


def search_failure(p: Column, prefix: Column, rep: Column, bits: int, reps: int) -> Column:
    """Chance that a point whose functions agree with chance ``p`` was not met after ``rep`` of ``reps`` tables at
    this prefix (and all at the longer ones)."""
    longer = F.when(prefix < bits, F.pow(1 - F.pow(p, prefix + 1), F.lit(reps) - rep)).otherwise(1.0)
    return F.pow(1 - F.pow(p, prefix), rep) * longer


def hoeffding_bound(p: Column, delta: float, samples: int) -> Column:
    return p - math.sqrt(math.log(2 / delta) / (2 * samples))


def count_threshold(p: Column, delta: float, samples: int) -> Column:
    """Least number of collisions that a point at the range passes with chance 1 - delta; 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(hoeffding_bound(p, delta, samples) * samples))


def concomitant_scale(dims: int) -> float:
    return math.sqrt(2 * math.log(dims))


def rank_swap(dims: Column, s: Column, tau1: Column, tau2: Column) -> Column:
    sigma = F.sqrt(1 - tau1 * tau1) + F.sqrt(1 - tau2 * tau2)
    return F.pow(dims, -s * (tau1 - tau2) / (sigma * sigma))


def squared_reach(inner: Column, first: Column, second: Column) -> Column:
    """Squared distance from the origin to where two caps meet: the caps at heights ``first`` and ``second`` along two
    unit vectors with this inner product. The meeting point is first * u + x * w with w the part of the second vector
    across the first one, and its height on the second vector gives x = (second - first * inner) / |w|, |w|^2 = 1 - inner^2."""
    across = (second - first * inner) / F.sqrt(1 - inner * inner)
    return first * first + across * across


def filter_near(alpha: Column, lam: Column, t: Column) -> Column:
    """Lower bound of the chance that a locality-sensitive filter with heights t and alpha^lam * t keeps a pair at inner
    product ``alpha``: a two-dimensional normal tail beyond the point where both caps meet."""
    return F.exp(squared_reach(alpha, t, F.pow(alpha, lam) * t) / -2) / (2 * math.pi * F.pow(1 + t / alpha, 2))


def filter_far(alpha: Column, beta: Column, lam: Column, t: Column) -> Column:
    """Upper bound of the chance that it keeps a pair at inner product ``beta``."""
    return F.exp(squared_reach(beta, t, F.pow(alpha, lam) * t) / -2)

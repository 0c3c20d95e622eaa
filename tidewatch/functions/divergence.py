"""Histogram bins, divergences of histograms and the two-sample KS p-value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EPSILON = 1e-10  # fixed value: decides what empty bins cost


def bin_index(x: Column, bins: int) -> Column:
    """Equal-width bin over [0, 1], the last one closed; null outside.

    Edges are multiples of 1/bins; the guess is set right against them, as the
    product ``x * bins`` misplaces values on an edge.
    """
    width = F.lit(1.0 / bins)
    guess = F.floor(x * bins)
    guess = F.when(x < guess * width, guess - 1).when((guess + 1 < bins) & (x >= (guess + 1) * width), guess + 1).otherwise(guess)
    return F.when((x >= 0) & (x <= 1), F.least(guess, F.lit(bins - 1)).cast("int"))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def shares(counts: Column) -> Column:
    """Counts over their sum; zeros stay zeros."""
    total = _total(F.transform(counts, lambda x: x.cast("double")))
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def _clip(p: Column) -> Column:
    return F.transform(p, lambda x: F.greatest(x, F.lit(EPSILON)))


def kl(p: Column, q: Column) -> Column:
    """KL(p || q) in nats of clipped shares made to sum to one again."""
    p, q = _clip(p), _clip(q)
    sp, sq = _total(p), _total(q)
    return _total(F.zip_with(p, q, lambda a, b: a / sp * F.log((a / sp) / (b / sq))))


def js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats; the middle is of unclipped shares."""
    m = F.zip_with(p, q, lambda a, b: F.greatest((a + b) / 2, F.lit(EPSILON)))
    half = lambda x: _total(F.zip_with(_clip(x), m, lambda a, b: a * F.log(a / b)))
    return (half(p) + half(q)) / 2


def ks_p(n1: int, n2: int, k: int) -> float:
    """Exact P(D >= k / (n1 n2)) of two samples; 1 for an empty one.  Series beyond 10,000 rows."""
    if not n1 or not n2 or k <= 0:
        return 1.0
    if max(n1, n2) > 10_000:
        x = (n1 * n2 / (n1 + n2)) ** 0.5 * k / (n1 * n2)
        return float(np.clip(2 * sum((-1) ** (j - 1) * np.exp(-2 * (j * x) ** 2) for j in range(1, 101)), 0, 1))
    if n1 == n2:
        h, total = -(-k // n1), 0.0
        for j in range(1, n1 // h + 1):
            i = np.arange(j * h)
            total += (-1) ** (j - 1) * float(np.prod((n1 - j * h + 1 + i) / (n1 + 1 + i)))
        return min(1.0, 2 * total)
    # walk the lattice by steps; mass that leaves the band |i n2 - j n1| < k is the p-value
    mass, out = np.zeros(n1 + 1), 0.0
    mass[0] = 1.0
    i = np.arange(n1 + 1)
    for step in range(n1 + n2):
        left = n1 + n2 - step
        up = mass * np.maximum(n1 - i, 0) / left
        mass = mass * np.clip(n2 - (step - i), 0, None) / left
        mass[1:] += up[:-1]
        away = np.abs(i * n2 - (step + 1 - i) * n1) >= k
        out += mass[away].sum()
        mass[away] = 0
    return float(min(1.0, out))


@F.pandas_udf(DoubleType())
def ks_p_value(n1: pd.Series, n2: pd.Series, k: pd.Series) -> pd.Series:
    made = {t: ks_p(*t) for t in set(zip(n1, n2, k))}
    return pd.Series([made[t] for t in zip(n1, n2, k)], dtype="float64")

"""Special functions and exact tests. Factorials and tests are column expressions; the incomplete
gamma and beta functions run over Arrow batches in numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def log_gamma(x: Column) -> Column:
    """ln Gamma of a positive number: eight steps of the recurrence, then Stirling's series; null at or below 0."""
    x = x.cast("double")
    y = x + 8
    shift = sum((F.ln(x + k) for k in range(1, 8)), F.ln(x))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return F.when(x > 0, (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - shift)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def poisson_term(mean: Column, i: Column) -> Column:
    """Probability of i events where ``mean`` are expected."""
    return F.exp(i * F.ln(mean) - mean - log_gamma(i + 1))


def poisson_cutoff(mean: Column, threshold: float, most: int = 1000) -> Column:
    """One more than the least count from 2 on whose term is under the threshold; 0 where none is."""
    low = F.filter(F.sequence(F.lit(2), F.lit(most - 1)), lambda x: poisson_term(mean, x) < threshold)
    return F.when(F.size(low) > 0, F.array_min(low) + 1).otherwise(0)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Left, right and two-sided probability of the table a b / c d with its margins held.

    Two-sided: all tables that are no likelier than this one, up to a relative 1e-8.
    """
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    chance = lambda x: F.exp(log_choose(row, x) + log_choose(n - row, col - x) - log_choose(n, col))
    cells = F.transform(F.sequence(F.greatest(F.lit(0), row + col - n), F.least(row, col)), lambda x: F.struct(x.alias("x"), chance(x).alias("p")))
    total = lambda keep: F.least(F.lit(1.0), F.aggregate(F.filter(cells, keep), F.lit(0.0), lambda s, e: s + e["p"]))
    here = chance(a)
    return F.struct(total(lambda e: e["x"] <= a).alias("left"), total(lambda e: e["x"] >= a).alias("right"), total(lambda e: e["p"] <= here * (1 + 1e-8)).alias("two"))


_lgamma = np.vectorize(math.lgamma, otypes=[float])
_TINY = 1e-290


def _fraction(first: np.ndarray, terms) -> np.ndarray:
    """A continued fraction by the modified Lentz rule; terms(k) gives (numerator, denominator)."""
    f = np.where(first == 0, _TINY, first)
    c, d = f.copy(), np.zeros_like(f)
    for k in range(1, 400):
        num, den = terms(k)
        d = den + num * d
        c = den + num / c
        d = 1 / np.where(d == 0, _TINY, d)
        c = np.where(c == 0, _TINY, c)
        f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return f


def upper_gamma(s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(s, z), s > 0 and z >= 0."""
    s, z = np.asarray(s, float), np.asarray(z, float)
    with np.errstate(all="ignore"):
        scale = np.exp(s * np.log(z) - z - _lgamma(s))
        term, total = 1 / s, 1 / s
        for k in range(1, 600):
            term = term * z / (s + k)
            total = total + term
        tail = scale / _fraction(z + 1 - s, lambda k: (k * (s - k), z + 2 * k + 1 - s))
        return np.where(z == 0, 1.0, np.where(z < s + 1, 1 - scale * total, tail))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = (np.asarray(v, float) for v in (a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)

    def terms(k):
        m = k // 2
        num = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)) if k % 2 == 0 else -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        return num, np.ones_like(y)

    with np.errstate(all="ignore"):
        scale = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        part = np.where(y <= 0, 0.0, scale / _fraction(np.ones_like(y), terms))
    return np.where(turned, 1 - part, part)


@F.pandas_udf(DoubleType())
def gamma_q(s: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series(upper_gamma(s, z))


@F.pandas_udf(DoubleType())
def beta_i(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(incomplete_beta(a, b, x))


def gamma_p(s: Column, z: Column) -> Column:
    return 1 - gamma_q(s, z)


def erfc(x: Column) -> Column:
    x = x.cast("double")
    q = gamma_q(F.lit(0.5), x * x)
    return F.when(x >= 0, q).otherwise(2 - q)

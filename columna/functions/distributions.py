"""Probability distributions and special functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ieee

# Abramowitz and Stegun, formula 7.1.26 (p, then a1 to a5).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Lanczos approximation, g = 7 (the constant term, then eight coefficients).
LANCZOS_G = 7.0
LANCZOS_0 = 0.99999999999980993
LANCZOS = (676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Terms of the power series of the lower incomplete gamma function.
SERIES_TERMS = 100


def erf(x: Column) -> Column:
    sign = F.when(x < 0, -1.0).otherwise(1.0)
    z = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return sign * (1.0 - poly * F.exp(-z * z))


def normal_pdf(x: Column, mean: float, sd: float) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mean: float, sd: float) -> Column:
    return 0.5 * (1.0 + erf((x - mean) / (sd * math.sqrt(2.0))))


def uniform_pdf(x: Column, a: float, b: float) -> Column:
    outside = (x < a) | ((x > b) & ~F.isnan(x))
    return F.when(outside, 0.0).otherwise(1.0 / (b - a))


def uniform_cdf(x: Column, a: float, b: float) -> Column:
    return F.when(x < a, 0.0).when(x <= b, (x - a) / (b - a)).otherwise(1.0)


def _lanczos(z: Column) -> Column:
    """Gamma for z of one half or more."""
    y = z - 1.0
    series = F.lit(LANCZOS_0)
    for i, c in enumerate(LANCZOS):
        series = series + c / (y + float(i + 1))
    t = y + LANCZOS_G + 0.5
    return math.sqrt(2 * math.pi) * F.pow(t, y + 0.5) * F.exp(-t) * series


def gamma(z: Column) -> Column:
    low = z < 0.5
    reflected = ieee.div(F.lit(math.pi), F.sin(math.pi * z) * _lanczos(F.when(low, 1.0 - z).otherwise(F.lit(1.0))))
    return F.when(low, reflected).otherwise(_lanczos(F.when(low, F.lit(1.0)).otherwise(z)))


def lower_incomplete_gamma(s: Column | float, x: Column) -> Column:
    """Power series of exactly ``SERIES_TERMS`` terms."""
    s = F.lit(s) if isinstance(s, (int, float)) else s
    first = 1.0 / s
    state = F.struct(first.cast("double").alias("sum"), first.cast("double").alias("term"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * x / (s + n)
        return F.struct((acc["sum"] + term).cast("double").alias("sum"), term.cast("double").alias("term"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS - 1)), state, step, lambda acc: acc["sum"])
    return F.pow(x, s) * F.exp(-x) * series


def gamma_pdf(x: Column, k: float, theta: float) -> Column:
    return F.when(x < 0, 0.0).otherwise(F.pow(x, F.lit(k - 1.0)) * F.exp(-x / theta) / (gamma(F.lit(float(k))) * theta**k))


def gamma_cdf(x: Column, k: Column | float, theta: float) -> Column:
    k = F.lit(float(k)) if isinstance(k, (int, float)) else k
    return F.when(x < 0, 0.0).otherwise(lower_incomplete_gamma(k, F.when(x < 0, 0.0).otherwise(x) / theta) / gamma(k))


def binomial_coefficient(n: int, k: Column) -> Column:
    """Running products of numerator and denominator, in doubles; 0 beyond n."""
    m = F.least(k, F.lit(n) - k)
    steps = F.when(m > 0, F.sequence(F.lit(0).cast("long"), F.greatest(m, F.lit(1)) - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("up"), F.lit(1.0).alias("down"))
    ratio = F.aggregate(steps, start, lambda a, i: F.struct((a["up"] * (F.lit(n) - i).cast("double")).alias("up"), (a["down"] * (i + 1).cast("double")).alias("down")), lambda a: a["up"] / a["down"])
    return F.when(k > n, 0.0).otherwise(ratio)


def binomial_pmf(n: int, k: Column, p: float) -> Column:
    k = k.cast("long")
    return F.when(k > n, 0.0).otherwise(binomial_coefficient(n, k) * F.pow(F.lit(float(p)), k.cast("double")) * F.pow(F.lit(1.0 - p), (F.lit(n) - k).cast("double")))


def binomial_cdf(n: int, k: Column, p: float) -> Column:
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.lit(0.0), lambda a, i: a + binomial_pmf(n, i, p))


def factorial(k: Column) -> Column:
    """k! as a double; infinite above 170."""
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.lit(1.0), lambda a, i: a * F.greatest(i, F.lit(1)).cast("double"))


def poisson_pmf(rate: float, k: Column) -> Column:
    return F.pow(F.lit(float(rate)), k.cast("double")) * math.exp(-rate) / factorial(k)


def poisson_cdf(rate: float, k: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.lit(0.0), lambda a, i: a + poisson_pmf(rate, i))

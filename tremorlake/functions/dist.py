"""Log-densities of the usual distributions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def gaussian_logp(x, mean, std) -> Column:
    z = (_c(x) - _c(mean)) / _c(std)
    return -0.5 * z * z - F.ln(_c(std)) - 0.5 * math.log(2 * math.pi)


def laplace_logp(x, center, scale) -> Column:
    return -F.abs(_c(x) - _c(center)) / _c(scale) - F.ln(2 * _c(scale))


def exponential_logp(x, rate) -> Column:
    return F.when(_c(x) >= 0, F.ln(_c(rate)) - _c(rate) * _c(x)).otherwise(F.lit(float("-inf")))


def lognormal_logp(x, mu, sigma) -> Column:
    z = (F.ln(_c(x)) - _c(mu)) / _c(sigma)
    return F.when(_c(x) > 0, -0.5 * z * z - F.ln(_c(sigma) * _c(x)) - 0.5 * math.log(2 * math.pi)).otherwise(F.lit(float("-inf")))


def uniform_logp(x, low, high) -> Column:
    return F.when((_c(x) >= _c(low)) & (_c(x) <= _c(high)), -F.ln(_c(high) - _c(low))).otherwise(F.lit(float("-inf")))


def bernoulli_logp(hit: Column, p) -> Column:
    return F.when(hit, F.ln(_c(p))).otherwise(F.ln(1 - _c(p)))


def gamma_logp(x, shape: float, rate: float) -> Column:
    """The shape is a number, so that its gamma function is a constant of the plan."""
    return F.when(_c(x) > 0, shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * F.ln(_c(x)) - rate * _c(x)).otherwise(F.lit(float("-inf")))


def inverse_gamma_logp(x, shape: float, scale: float) -> Column:
    return F.when(_c(x) > 0, shape * math.log(scale) - math.lgamma(shape) - (shape + 1) * F.ln(_c(x)) - scale / _c(x)).otherwise(F.lit(float("-inf")))


def beta_logp(x, a: float, b: float) -> Column:
    inside = (_c(x) > 0) & (_c(x) < 1)
    return F.when(inside, math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * F.ln(_c(x)) + (b - 1) * F.ln(1 - _c(x))).otherwise(F.lit(float("-inf")))


def poisson_logp(n, mean: float) -> Column:
    """n! through the sum of logarithms, which stays exact for counts as they occur here."""
    n = _c(n)
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda s, k: s + F.ln(k.cast("double")))
    return n * math.log(mean) - mean - log_factorial


def laplace_cdf(x, center, scale) -> Column:
    z = (_c(x) - _c(center)) / _c(scale)
    return F.when(z < 0, 0.5 * F.exp(z)).otherwise(1 - 0.5 * F.exp(-z))


def normal_cdf(x) -> Column:
    """Standard normal, by the rational approximation of the error function with an error below 1.5e-7."""
    z = F.abs(_c(x)) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    # fixed values of that approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-z * z)
    return F.when(_c(x) >= 0, 1 - upper).otherwise(upper)

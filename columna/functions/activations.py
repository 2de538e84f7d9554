"""Activation functions as Column expressions. Comparisons with NaN are false, as in IEEE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _positive(x: Column) -> Column:
    return (x > 0) & ~F.isnan(x)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def dsigmoid(y: Column) -> Column:
    """The derivative where the sigmoid is already ``y``."""
    return y * (1.0 - y)


def relu(x: Column) -> Column:
    return F.when(_positive(x), x).otherwise(0.0)


def drelu(x: Column) -> Column:
    return F.when(_positive(x), 1.0).otherwise(0.0)


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(_positive(x), x).otherwise(slope * x)


def dleaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(_positive(x), 1.0).otherwise(slope)


def tanh(x: Column) -> Column:
    return F.tanh(x)


def dtanh(x: Column) -> Column:
    """The derivative at the pre-activation ``x``."""
    return 1.0 - F.tanh(x) * F.tanh(x)

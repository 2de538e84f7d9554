"""IEEE arithmetic and comparison as Column expressions, where Spark's own differ (ANSI errors, NaN order, NULL)."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, mul, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def div(a: Column, b: Column) -> Column:
    """a / b for doubles: a zero divisor gives an infinity or NaN."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def ln(x: Column) -> Column:
    return F.when(F.isnan(x), nan()).when(x == 0, F.lit(float("-inf"))).when(x < 0, nan()).otherwise(F.ln(x))


def compare(op: str, a: Column, b: Column, floating: bool = True) -> Column:
    """eq, ne, lt, le, gt, ge; NaN differs from everything and is ordered with nothing."""
    plain = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]
    if not floating:
        return plain
    odd = F.isnan(a) | F.isnan(b)
    return odd | plain if op == "ne" else ~odd & plain


def or_zero(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))


def or_one(x: Column) -> Column:
    return F.nanvl(x, F.lit(1.0))


def total(xs: list[Column], start: float = 0.0) -> Column:
    """Sum across columns; one array beyond a hundred, so that expressions stay small."""
    if len(xs) > 100:
        return F.aggregate(F.array(*xs), F.lit(start), lambda a, x: a + x)
    return reduce(add, xs, F.lit(start))


def product(xs: list[Column]) -> Column:
    if len(xs) > 100:
        return F.aggregate(F.array(*xs), F.lit(1.0), lambda a, x: a * x)
    return reduce(mul, xs, F.lit(1.0))


def any_of(xs: list[Column]) -> Column:
    return reduce(or_, xs, F.lit(False))


def all_of(xs: list[Column]) -> Column:
    return reduce(and_, xs, F.lit(True))

"""Element-wise operators and predictions on streams: stateless projections, row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.matrix import Matrix


def on_stream(stream: DataFrame, columns: list[str], f: Callable[[Matrix], Matrix]) -> DataFrame:
    """``f`` of the stream's ``columns``; other columns pass. ``f`` may use element-wise operators only."""
    m = Matrix(stream, {c: F.col(f"`{c}`") for c in columns}, keys=())
    out: dict[str, Column] = f(m).cells
    return stream.select(*[c for c in stream.columns if c not in columns], *[e.alias(n) for n, e in out.items()])

"""Vectors of a table as the embedding operators take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """``vectors`` with ``_v``, the vector in doubles, or null where it takes no part.

    That is where it is null or zero, holds null or non-finite components, or has another length than most
    of the others (of equally many, the smaller length counts).
    """
    v = F.col(vec).cast("array<double>")
    inf = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    rows = vectors.withColumn("_v", F.when(fine, v))
    lengths = rows.where("_v is not null").groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.withColumn("_v", F.when(F.size("_v") == (lengths[0]["d"] if lengths else 0), F.col("_v")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths, without nulls, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def sample(rows: DataFrame, key: str, most: int, seed: int, n: int) -> np.ndarray:
    """The ``_v`` of the ``most`` of ``n`` rows that come first by seeded hash: a bounded sample, the same every time.

    Only hashes below twice the sample's share are sorted, so that no partition sends ``most`` rows.
    """
    h = F.xxhash64(F.lit(seed), key)
    bound = (1 << 64) * min(1.0, (2 * most + 64) / max(n, 1)) - (1 << 63)
    few = rows.select(h.alias("h"), "_v").where(F.col("h") <= F.lit(min((1 << 63) - 1, int(bound))))
    got = few.orderBy("h", "_v").limit(most).select("_v").toArrow()
    return matrix(got.column("_v"))

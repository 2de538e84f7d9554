"""Running sums over dense positions without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block: what one task adds up alone.
BLOCK = 1 << 18


def running_sums(df: DataFrame, pos: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its running sum in the order of ``pos`` (dense, from 0).

    Blocks of positions are added up first; their sums, a row a block, are added up in turn and start each block's
    own window.
    """
    own = df.withColumn("_b", F.floor(F.col(pos) / block))
    sums = own.groupBy("_b").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_b", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0.0)).alias(f"_s{i}") for i in range(len(columns))])
    w = Window.partitionBy("_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = own.join(starts, "_b")
    out = {c: F.sum(c).over(w) + F.col(f"_s{i}") for i, c in enumerate(columns)}
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])

"""Conway's Game of Life on living cells (i, j): an integration of shifts, sums and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step(alive: DataFrame, rows: int, cols: int) -> DataFrame:
    """The living cells of the next generation; beyond the border all is dead."""
    shifts = [F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), F.lit(int((a, b) == (0, 0))).alias("me")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    seen = alive.select(F.inline(F.array(*shifts)))
    n = seen.groupBy("i", "j").agg(F.count_if(F.col("me") == 0).alias("n"), F.max("me").alias("me"))
    lives = (F.col("n") == 3) | ((F.col("me") == 1) & (F.col("n") == 2))
    return n.where(lives & F.col("i").between(0, rows - 1) & F.col("j").between(0, cols - 1)).select("i", "j")

"""Random numbers: seeded and secure columns, and an exact xorshift sequence."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


class Prng:
    """64-bit xorshift with shifts 13, 7, 17. A seed of 0 gives zeros for ever."""

    def __init__(self, seed: int) -> None:
        self.state = seed & _MASK

    @classmethod
    def from_entropy(cls) -> Prng:
        return cls(time.time_ns())

    def next_u64(self) -> int:
        x = self.state
        x ^= (x << 13) & _MASK
        x ^= x >> 7
        x ^= (x << 17) & _MASK
        self.state = x
        return x

    def range_int(self, low: int, high: int) -> int:
        return low + self.next_u64() % (high - low)

    def range_float(self, low: float, high: float) -> float:
        return low + self.next_u64() / _MASK * (high - low)

    def gen_bool(self) -> bool:
        return bool(self.next_u64() & 1)

    def normal(self, mean: float, sd: float) -> float:
        import math

        u1, u2 = self.range_float(0.0, 1.0), self.range_float(0.0, 1.0)
        radius = math.sqrt(-2.0 * math.log(u1)) if u1 > 0 else math.inf
        return mean + sd * radius * math.cos(2 * math.pi * u2)

    def shuffle(self, items: list) -> None:
        """Fisher-Yates, from the end."""
        for i in range(len(items) - 1, 0, -1):
            j = self.range_int(0, i + 1)
            items[i], items[j] = items[j], items[i]


def xorshift_step(x: Column) -> Column:
    """The next state as a signed bigint."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def _jump(steps: int) -> list[int]:
    """The images of the 64 single bits after ``steps`` steps: a step is linear over GF(2)."""
    one = []
    for i in range(64):
        g = Prng(1 << i)
        one.append(g.next_u64())
    out, power = [1 << i for i in range(64)], one
    while steps:
        if steps & 1:
            out = [_apply(power, x) for x in out]
        power = [_apply(power, x) for x in power]
        steps >>= 1
    return out


def _apply(images: list[int], x: int) -> int:
    y, i = 0, 0
    while x:
        if x & 1:
            y ^= images[i]
        x >>= 1
        i += 1
    return y


def xorshift(spark: SparkSession, seed: int, n: int, block: int = 65_536) -> DataFrame:
    """(i, state): the first ``n`` states of one sequence, as signed bigints.

    Blocks of ``block`` states are made where they lie, each from its own start, to which the driver jumps.
    """
    starts, state, jump = [], seed & _MASK, _jump(block)
    for k in range(-(-n // block)):
        starts.append((k, min(block, n - k * block), state - (1 << 64) if state >> 63 else state))
        state = _apply(jump, state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, count, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                g = Prng(start)
                states = np.array([g.next_u64() for _ in range(count)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * block, k * block + count), pa.int64()), pa.array(states)], ["i", "state"])

    made = spark.createDataFrame(starts, "k long, count long, start long")
    return made.repartition(max(1, len(starts))).mapInArrow(run, "i long, state long")


def uniform(low: float, high: float, seed: int | None = None) -> Column:
    return F.lit(low) + (F.rand(seed) if seed is not None else F.rand()) * (high - low)


def uniform_int(low: int, high: int, seed: int | None = None) -> Column:
    return (F.lit(low) + F.floor((F.rand(seed) if seed is not None else F.rand()) * (high - low))).cast("long")


def normal(mean: float, sd: float, seed: int | None = None) -> Column:
    return F.lit(mean) + (F.randn(seed) if seed is not None else F.randn()) * sd


def boolean(seed: int | None = None) -> Column:
    return (F.rand(seed) if seed is not None else F.rand()) < 0.5


def secure_u64(df: DataFrame, name: str = "random") -> DataFrame:
    """``df`` with a bigint of eight bytes from the operating system for each row."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = pa.array(np.frombuffer(os.urandom(8 * b.num_rows), "<i8"))
            yield pa.RecordBatch.from_arrays([*b.columns, drawn], [*columns, name])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def shuffle(df: DataFrame, seed: int, key: str, cells: int = 4096) -> DataFrame:
    """``df`` in seeded order, the same every time, with each row's place as ``__pos``; ``key`` tells rows apart.

    The order is that of an MD5.  Its first bits cut the rows into even cells, which are numbered alone and start at the
    sum of the cells before.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.withColumn("_h", h).withColumn("_cell", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int") % cells)
    before = F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("_cell").agg(F.count("*").alias("_n")).select("_cell", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", key)) - 1 + F.col("_start")
    return rows.join(F.broadcast(counts), "_cell").withColumn("__pos", place).drop("_h", "_cell", "_start").orderBy("__pos")

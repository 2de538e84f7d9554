"""A homogeneous matrix over a DataFrame: one row each, ordered by ``__pos`` (0-based), one expression a column.

Nothing runs until a result is asked for.  Matrices made from the same source are combined in one projection;
others are joined by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ieee
from ..plans.prefix import running_sums

POS = "__pos"
#: Beyond so many rows a transpose is a matrix in blocks.
MAX_TRANSPOSE = 2000
#: A right-hand factor of so many cells is put into the plan as literals.
LITERAL_CELLS = 4096
#: A right-hand factor of so many cells (8 MB) is sent to the tasks; products with a larger one are made in blocks.
SENT_CELLS = 1_000_000

Value = float | int | bool | str


@contextmanager
def told() -> Iterator[None]:
    """What a job found wrong with its matrices, as the error that the same finding has elsewhere."""
    try:
        yield
    except SparkRuntimeException as e:
        if e.getCondition() != "USER_RAISED_EXCEPTION":
            raise
        raise ValueError(e.getMessageParameters()["errorMessage"]) from e


class Matrix:
    def __init__(self, source: DataFrame, cells: dict[str, Column], keys: tuple[str, ...] = (POS,)) -> None:
        self.source, self.cells, self.keys = source, dict(cells), keys

    @classmethod
    def over(cls, df: DataFrame, pos: str = POS) -> Matrix:
        """All columns of ``df`` but ``pos``, which numbers the rows from 0."""
        df = df if pos == POS else df.withColumnRenamed(pos, POS)
        return cls(df, {c: F.col(f"`{c}`") for c in df.columns if c != POS})

    # -- shape and access ---------------------------------------------------------------------------------
    def _new(self, cells: dict[str, Column], source: DataFrame | None = None):
        return Matrix(source or self.source, cells, self.keys)

    @property
    def df(self) -> DataFrame:
        return self.source.select(*self.keys, *[e.alias(n) for n, e in self.cells.items()])

    @property
    def columns(self) -> list[str]:
        return list(self.cells)

    @property
    def cols(self) -> int:
        return len(self.cells)

    def rows(self) -> int:
        return self.source.count()

    def is_empty(self) -> bool:
        return not self.source.limit(1).count()

    def shape(self) -> tuple[int, int]:
        return self.rows(), self.cols

    @property
    def dtype(self) -> T.DataType:
        kinds = {f.dataType for f in self.df.schema.fields[len(self.keys) :]}
        if len(kinds) > 1:
            raise TypeError(f"columns differ in type: {kinds}")
        return kinds.pop()

    def _name(self, c: int) -> str:
        if not 0 <= c < self.cols:
            raise IndexError(f"column {c} is out of bounds for {self.cols} columns")
        return self.columns[c]

    def row(self, r: int) -> list:
        with told():
            got = self.df.where(F.col(POS) == r).first()
        if got is None:
            raise IndexError(f"row {r} is out of bounds")
        return [got[c] for c in self.columns]

    def get(self, r: int, c: int):
        name = self._name(c)
        with told():
            got = self.df.where(F.col(POS) == r).select(name).first()
        if got is None:
            raise IndexError(f"row {r} is out of bounds")
        return got[0]

    def set(self, r: int, c: int, value: Value):
        name = self._name(c)
        return self._new({**self.cells, name: F.when(F.col(POS) == r, F.lit(value)).otherwise(self.cells[name])})

    def column(self, c: int) -> DataFrame:
        return self.df.select(POS, self._name(c))

    def iter_columns(self) -> Iterator[DataFrame]:
        return (self.column(c) for c in range(self.cols))

    def iter_rows(self) -> Iterator[Row]:
        return self.df.orderBy(POS).drop(*self.keys).toLocalIterator()

    def collect_columns(self) -> list[list]:
        """All cells on the driver, column by column."""
        with told():
            got = self.df.orderBy(POS).collect()
        return [[r[c] for r in got] for c in self.columns]

    def to_vec(self) -> list:
        return [v for c in self.collect_columns() for v in c]

    # -- structure ------------------------------------------------------------------------------------------
    def swap_columns(self, a: int, b: int):
        names = self.columns
        self._name(a), self._name(b)
        names[a], names[b] = names[b], names[a]
        return self._new({n: self.cells[n] for n in names})

    def _joined(self, name: str, values: list) -> DataFrame:
        if self.rows() != len(values):
            raise ValueError(f"column length mismatch: {len(values)} values for {self.rows()} rows")
        spark = self.source.sparkSession
        kind = self.dtype if self.cells else T._infer_type(values[0])
        schema = T.StructType([T.StructField("_p", T.LongType()), T.StructField(name, kind)])
        extra = spark.createDataFrame(list(enumerate(values)), schema)
        return self.df.join(extra, F.col(POS) == F.col("_p")).drop("_p")

    def add_column(self, at: int, values: list | Column, name: str | None = None):
        if not 0 <= at <= self.cols:
            raise IndexError(f"column {at} is out of bounds for {self.cols} columns")
        name = name or f"c{self.cols}"
        if name in self.cells:
            raise ValueError(f"duplicate column label: {name}")
        names = self.columns
        names.insert(at, name)
        if isinstance(values, Column):
            return self._new({n: values if n == name else self.cells[n] for n in names})
        return self._new({n: F.col(f"`{n}`") for n in names}, self._joined(name, values))

    def delete_column(self, c: int):
        gone = self._name(c)
        return self._new({n: e for n, e in self.cells.items() if n != gone})

    def _over(self, df: DataFrame):
        return self._new({n: F.col(f"`{n}`") for n in self.columns}, df)

    def add_row(self, at: int, values: list):
        if not 0 <= at <= self.rows():
            raise IndexError(f"row {at} is out of bounds")
        if len(values) != self.cols:
            raise ValueError(f"row length mismatch: {len(values)} values for {self.cols} columns")
        df = self.df
        new = df.sparkSession.createDataFrame([(at, *values)], df.schema)
        return self._over(df.withColumn(POS, F.when(F.col(POS) >= at, F.col(POS) + 1).otherwise(F.col(POS))).unionByName(new))

    def delete_row(self, r: int):
        if not 0 <= r < self.rows():
            raise IndexError(f"row {r} is out of bounds")
        return self._over(self.df.where(F.col(POS) != r).withColumn(POS, F.when(F.col(POS) > r, F.col(POS) - 1).otherwise(F.col(POS))))

    def set_row(self, r: int, values: list):
        if len(values) != self.cols:
            raise ValueError(f"row length mismatch: {len(values)} values for {self.cols} columns")
        return self._new({n: F.when(F.col(POS) == r, F.lit(v)).otherwise(e) for (n, e), v in zip(self.cells.items(), values, strict=True)})

    def repeat_rows(self, n: int):
        """Row 0, n times; its cells become literals."""
        first = self.row(0)
        return self._new({c: F.lit(v) for c, v in zip(self.columns, first, strict=True)}, self.source.sparkSession.range(n).withColumnRenamed("id", POS))

    def broadcast_row(self, rows: int, cols: int):
        if self.rows() != 1 or self.cols != cols:
            raise ValueError(f"only a row of {cols} cells can be broadcast to {rows} x {cols}")
        return self.repeat_rows(rows)

    def to_long(self) -> DataFrame:
        """(i, j, v): one row a cell."""
        pairs = [F.struct(F.lit(j).alias("j"), e.alias("v")) for j, e in enumerate(self.cells.values())]
        return self.source.select(F.col(POS).alias("i"), F.explode(F.array(*pairs)).alias("_c")).select("i", "_c.j", "_c.v")

    def transpose_long(self) -> DataFrame:
        """(i, j, v): one row a cell of the transpose, at any number of rows."""
        return self.to_long().select(F.col("j").alias("i"), F.col("i").alias("j"), "v")

    def blocks(self, side: int | None = None):
        """The cells as a :class:`BlockMatrix`."""
        from .blocks import SIDE, BlockMatrix

        return BlockMatrix.of(self, side or SIDE)

    def transpose(self):
        """Of up to ``MAX_TRANSPOSE`` rows, which become columns of a plan, a Matrix; of more, a :class:`BlockMatrix`."""
        n, last = self.source.agg(F.count("*"), F.max(POS)).first()
        if n and last + 1 != n:
            raise ValueError(f"positions are not dense: {n} rows, the last one is {last}")
        if n > MAX_TRANSPOSE:
            return self.blocks().transpose()
        wide = self.to_long().groupBy(F.col("j").cast("long").alias(POS)).pivot("i", list(range(n))).agg(F.first("v"))
        return Matrix(wide, {f"c{i}": F.col(f"`{i}`") for i in range(n)})

    # -- element-wise -----------------------------------------------------------------------------------------
    def _beside(self, other: Matrix, on: str = POS, strict: bool = True):
        """A source that holds both, and the cells of each over it.

        Sources that differ are joined once, fully, on positions or index; with ``strict``, a row that only one side has, or
        whose positions differ, stops the job that computes the result.
        """
        if self.cols != other.cols:
            raise ValueError(f"dimensions differ: {self.cols} and {other.cols} columns")
        if self.source is other.source:
            return self.source, list(self.cells.values()), list(other.cells.values())
        left = self.source.select(*self.keys, *[e.alias(f"_l{i}") for i, e in enumerate(self.cells.values())])
        # Sides that stand on one index need their positions compared, too.
        theirs = {on: "_on", POS: "_at"} if on != POS else {POS: "_on"}
        right = other.source.select(*[F.col(k).alias(n) for k, n in theirs.items()], *[e.alias(f"_r{i}") for i, e in enumerate(other.cells.values())])
        both = left.join(right, F.col(on) == F.col("_on"), "full" if strict else "inner")
        if strict:
            same = F.col(on).isNotNull() & F.col("_on").isNotNull()
            same = same & F.col(POS).eqNullSafe(F.col("_at")) if on != POS else same
            said = "row indexes differ" if on != POS else "dimensions differ: row counts"
            both = both.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit(said)).cast("boolean")))
        both = both.drop("_on", "_at")
        return both, [F.col(f"_l{i}") for i in range(self.cols)], [F.col(f"_r{i}") for i in range(self.cols)]

    def _binary(self, other, f: Callable[[Column, Column], Column]):
        if not isinstance(other, Matrix):
            return self._new({n: f(e, F.lit(other)) for n, e in self.cells.items()})
        source, left, right = self._beside(other)
        return self._new({n: f(a, b) for n, a, b in zip(self.columns, left, right, strict=True)}, source)

    @property
    def _floating(self) -> bool:
        return isinstance(self.dtype, (T.DoubleType, T.FloatType))

    def __add__(self, other):
        return self._binary(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._binary(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._binary(other, lambda a, b: a * b)

    def __truediv__(self, other):
        if self._floating:
            return self._binary(other, ieee.div)
        kind = self.dtype.simpleString()
        return self._binary(other, lambda a, b: F.call_function("div", a, b).cast(kind))

    def compare(self, op: str, other):
        """eq, ne, lt, le, gt, ge with a matrix or a scalar."""
        floating = self._floating
        return self._binary(other, lambda a, b: ieee.compare(op, a, b, floating))

    def __and__(self, other):
        return self._binary(other, lambda a, b: a & b)

    def __or__(self, other):
        return self._binary(other, lambda a, b: a | b)

    def __xor__(self, other):
        return self._binary(other, lambda a, b: a != b)

    def __invert__(self):
        return self._new({n: ~e for n, e in self.cells.items()})

    def equals(self, other: Matrix) -> bool:
        """The same cells at the same places; NaN differs from NaN."""
        if self.cols != other.cols or self.columns != other.columns or self.rows() != other.rows():
            return False
        source, left, right = self._beside(other, strict=False)
        floating = self._floating
        bad = [~ieee.compare("eq", a, b, floating) for a, b in zip(left, right, strict=True)]
        both = source.agg(F.count("*").alias("n"), F.count_if(ieee.any_of(bad)).alias("bad")).first()
        return both["bad"] == 0 and both["n"] == self.rows()

    def map(self, f: Callable[[Column], Column]):
        return self._new({n: f(e) for n, e in self.cells.items()})

    def zip(self, other: Matrix, f: Callable[[Column, Column], Column]):
        return self._binary(other, f)

    def is_nan(self):
        return self.map(F.isnan)

    # -- reductions ------------------------------------------------------------------------------------------
    def _vertical(self, f: Callable[[Column], Column]) -> DataFrame:
        return self.source.agg(*[f(e).alias(n) for n, e in self.cells.items()])

    def _horizontal(self, e: Column, name: str = "value") -> DataFrame:
        return self.source.select(POS, e.alias(name))

    def sum_vertical(self) -> DataFrame:
        return self._vertical(lambda c: F.coalesce(F.sum(ieee.or_zero(c)), F.lit(0.0)))

    def prod_vertical(self) -> DataFrame:
        return self._vertical(lambda c: F.coalesce(F.product(ieee.or_one(c)), F.lit(1.0)))

    def count_nan_vertical(self) -> DataFrame:
        return self._vertical(lambda c: F.count_if(F.isnan(c)))

    def any_vertical(self) -> DataFrame:
        return self._vertical(lambda c: F.coalesce(F.bool_or(c), F.lit(False)))

    def all_vertical(self) -> DataFrame:
        return self._vertical(lambda c: F.coalesce(F.bool_and(c), F.lit(True)))

    def count_vertical(self) -> DataFrame:
        return self._vertical(F.count_if)

    def sum_horizontal(self) -> DataFrame:
        return self._horizontal(ieee.total([ieee.or_zero(c) for c in self.cells.values()]))

    def prod_horizontal(self) -> DataFrame:
        return self._horizontal(ieee.product([ieee.or_one(c) for c in self.cells.values()]))

    def count_nan_horizontal(self) -> DataFrame:
        return self._horizontal(ieee.total([F.isnan(c).cast("double") for c in self.cells.values()]).cast("long"))

    def any_horizontal(self) -> DataFrame:
        return self._horizontal(ieee.any_of(list(self.cells.values())))

    def all_horizontal(self) -> DataFrame:
        return self._horizontal(ieee.all_of(list(self.cells.values())))

    def count_horizontal(self) -> DataFrame:
        return self._horizontal(ieee.total([c.cast("double") for c in self.cells.values()]).cast("long"))

    def _whole(self, f: Callable[[list[Column]], Column]):
        return self.source.agg(f(list(self.cells.values()))).first()[0]

    def any(self) -> bool:
        return bool(self._whole(lambda cs: F.coalesce(F.bool_or(ieee.any_of(cs)), F.lit(False))))

    def all(self) -> bool:
        return bool(self._whole(lambda cs: F.coalesce(F.bool_and(ieee.all_of(cs)), F.lit(True))))

    def count(self) -> int:
        return int(self._whole(lambda cs: F.coalesce(F.sum(ieee.total([c.cast("double") for c in cs])), F.lit(0.0))))

    def cumsum_horizontal(self):
        if self.cols <= 8:
            out, so_far = {}, F.lit(0.0)
            for n, e in self.cells.items():
                so_far = so_far + ieee.or_zero(e)
                out[n] = so_far
            return self._new(out)
        # One array of sums a row, made once, whose elements are the columns.
        values = F.array(*[ieee.or_zero(e).cast("double") for e in self.cells.values()])
        sums = F.aggregate(values, F.array().cast("array<double>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x))
        source = self.source.select(*self.keys, F.explode(F.array(sums)).alias("_sums"))
        return self._new({n: F.col("_sums")[i] for i, n in enumerate(self.cells)}, source)

    def cumsum_vertical(self):
        df = self.source.select(*self.keys, *[ieee.or_zero(e).alias(n) for n, e in self.cells.items()])
        return self._over(running_sums(df, POS, self.columns))

    def apply_axis(self, axis: str, f: Callable[[Column], Column]) -> DataFrame:
        """``col``: f aggregates each column; ``row``: f maps the array of each row."""
        if axis == "col":
            return self._vertical(f)
        return self._horizontal(f(F.array(*self.cells.values())))

    def matmul(self, other: Matrix):
        """The matrix product; NaN propagates.

        A small right factor joins the plan as literals, one of up to ``SENT_CELLS`` is sent to the tasks, and with a
        larger one the product is made in blocks, of which nothing is collected.
        """
        n = other.rows()
        if n != self.cols:
            raise ValueError(f"inner dimensions differ: {self.cols} and {n}")
        if n * other.cols <= LITERAL_CELLS:
            b = other.collect_columns()
            mine = list(self.cells.values())
            return self._product({f"c{k}": ieee.total([e * F.lit(float(v)) for e, v in zip(mine, col, strict=True)]) for k, col in enumerate(b)})
        if n * other.cols > SENT_CELLS:
            return self.blocks().matmul(other.blocks()).to_matrix()
        factor, width = np.array(other.collect_columns(), np.float64).T, other.cols
        data = self.source.select(POS, F.array(*[e.cast("double") for e in self.cells.values()]).alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, n)
                flat = pa.array((x @ factor).ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * width + 1, width), pa.int32()), flat)], [POS, "_x"])

        wide = data.mapInArrow(run, f"{POS} long, _x array<double>")
        return Matrix(wide, {f"c{k}": F.col("_x")[k] for k in range(width)})

    def _product(self, cells: dict[str, Column]):
        return Matrix(self.source, cells, (POS,))

    dot = matmul

    def __repr__(self) -> str:
        rows, cols = self.shape()
        return f"{type(self).__name__}({rows} x {cols}, columns={self.columns}, keys={list(self.keys)})"

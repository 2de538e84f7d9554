"""A matrix in square blocks, for shapes that columns of a plan can't hold: rows (bi, bj, data), every block there once.

``data`` is the block's cells, row after row, in numpy's bytes.  Blocks at the lower and right edge are smaller.  The
operators are those of :class:`Matrix`; nothing comes to the driver but the shape.

Products.  The p x q x r blocks of rows, inner dimension and columns are dealt to a grid of cells.  A cell gets its share of
both factors, multiplies it in numpy and sends one partial product a block of the result; partial products are added up
in a tree.  A left factor is sent once for each column of the grid, a right one once for each row, a result once for
each layer: the grid that sends least is taken, of those whose cells fit in a task (``CELL`` numbers) and that are enough
to keep all cores busy.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import POS, Matrix

#: Rows and columns of a block: 2 MB of doubles.
SIDE = 512
#: Numbers that a task may hold of both factors and the result (64 MB).
CELL = 1 << 23
#: Partial results that a task adds up.
FAN = 16
_KIND = {"double": "f8", "float": "f8", "bigint": "i8", "int": "i8", "smallint": "i8", "tinyint": "i8", "boolean": "b1"}
_SQL = {"f8": "double", "i8": "long", "b1": "boolean"}
_BLOCK = "bi long, bj long, data binary"


def _whole_div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Division of whole numbers, towards zero."""
    if not np.all(b):
        raise ZeroDivisionError("division by zero")
    return np.sign(a) * np.sign(b) * (np.abs(a) // np.abs(b))


_COMPARE = {"eq": np.equal, "ne": np.not_equal, "lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal}


def _places(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, bytes]]:
    return zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), (v.as_buffer() for v in batch.column("data")), strict=True)


def _batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([np.ascontiguousarray(r[2]).tobytes() for r in rows], pa.binary())], ["bi", "bj", "data"])


def grid(p: int, q: int, r: int, side: int = SIDE, cell: int = CELL, tasks: int = 1) -> tuple[int, int, int]:
    """How many parts to cut p, q and r blocks into."""
    halves = lambda n: [*itertools.takewhile(lambda x: x < n, (1 << i for i in range(n.bit_length()))), n]
    best, most = None, min(tasks, p * q * r)
    for a, b, c in itertools.product(halves(p), halves(q), halves(r)):
        x, y, z = -(-p // a), -(-q // b), -(-r // c)
        fits = (x * y + y * z + x * z) * side * side <= cell or x * y * z == 1
        cost = (p * q * c + q * r * a + p * r * b, a * b * c)
        if fits and a * b * c >= most and (best is None or cost < best[0]):
            best = (cost, (a, b, c))
    return best[1] if best else (p, q, r)


class BlockMatrix:
    def __init__(self, blocks: DataFrame, rows: int, cols: int, kind: str = "f8", side: int = SIDE) -> None:
        self.blocks, self._rows, self.cols, self.kind, self.side = blocks, rows, cols, kind, side

    # -- from and to other forms --------------------------------------------------------------------------
    @classmethod
    def of(cls, m: Matrix, side: int = SIDE) -> BlockMatrix:
        """The cells of ``m``, whose positions must be 0, 1, ... without a gap."""
        kind = _KIND.get(m.dtype.simpleString())
        if kind is None:
            raise TypeError(f"no blocks of {m.dtype.simpleString()}")
        rows, last = m.source.agg(F.count("*"), F.max(POS)).first()
        if rows and last + 1 != rows:
            raise ValueError(f"positions are not dense: {rows} rows, the last one is {last}")
        k = m.cols
        data = m.source.select(F.expr(f"{POS} div {side}").cast("long").alias("bi"), F.col(POS).alias("i"), F.array(*[c.cast(_SQL[kind]) for c in m.cells.values()]).alias("x"))

        def cut(t: pa.Table) -> pa.Table:
            bi = t.column("bi")[0].as_py()
            height = min(side, rows - bi * side)
            i = np.asarray(t.column("i")) - bi * side
            if len(np.unique(i)) != height or len(i) != height:
                raise ValueError("positions are not dense")
            x = np.empty((height, k), kind)
            x[i] = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(height, k)
            return pa.Table.from_batches([_batch([(bi, bj, x[:, bj * side : (bj + 1) * side]) for bj in range(-(-k // side))])])

        return cls(data.groupBy("bi").applyInArrow(cut, _BLOCK), rows, k, kind, side)

    def to_rows(self) -> DataFrame:
        """(``__pos``, ``x``): each row as an array, of any length."""
        width, high, side, kind = self.cols, self._rows, self.side, self.kind

        def join(t: pa.Table) -> pa.Table:
            parts = sorted((bj, d) for _, bj, d in _places(t))
            bi = t.column("bi")[0].as_py()
            h = min(side, high - bi * side)
            x = np.hstack([np.frombuffer(d, kind).reshape(h, -1) for _, d in parts])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(h + 1) * width, pa.int32()), pa.array(x.ravel()))
            return pa.table({POS: pa.array(np.arange(bi * side, bi * side + h)), "x": flat})

        return self.blocks.groupBy("bi").applyInArrow(join, f"{POS} long, x array<{_SQL[kind]}>")

    def to_matrix(self) -> Matrix:
        """As columns ``c0``, ``c1``, ... of a plan, which should be no more than some thousand."""
        return Matrix(self.to_rows(), {f"c{j}": F.col("x")[j] for j in range(self.cols)})

    def to_long(self) -> DataFrame:
        """(i, j, v): one row a cell."""
        side, cols, rows, kind = self.side, self.cols, self._rows, self.kind

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bi, bj, d in _places(b):
                    x = np.frombuffer(d, kind).reshape(min(side, rows - bi * side), min(side, cols - bj * side))
                    i, j = np.indices(x.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(i.ravel() + bi * side), pa.array(j.ravel() + bj * side), pa.array(x.ravel())], ["i", "j", "v"])

        return self.blocks.mapInArrow(cells, f"i long, j long, v {_SQL[kind]}")

    # -- shape and access ---------------------------------------------------------------------------------
    def rows(self) -> int:
        return self._rows

    def shape(self) -> tuple[int, int]:
        return self._rows, self.cols

    def _shape(self) -> Callable[[int, int], tuple[int, int]]:
        side, rows, cols = self.side, self._rows, self.cols
        return lambda bi, bj: (min(side, rows - bi * side), min(side, cols - bj * side))

    def get(self, i: int, j: int):
        if not (0 <= i < self._rows and 0 <= j < self.cols):
            raise IndexError(f"cell ({i}, {j}) is out of bounds for {self._rows} x {self.cols}")
        bi, bj = i // self.side, j // self.side
        got = self.blocks.where((F.col("bi") == bi) & (F.col("bj") == bj)).first()
        return np.frombuffer(got["data"], self.kind).reshape(self._shape()(bi, bj))[i - bi * self.side, j - bj * self.side].item()

    def row(self, i: int) -> list:
        if not 0 <= i < self._rows:
            raise IndexError(f"row {i} is out of bounds")
        bi, shape = i // self.side, self._shape()
        got = sorted(self.blocks.where(F.col("bi") == bi).collect(), key=lambda r: r["bj"])
        return [v for r in got for v in np.frombuffer(r["data"], self.kind).reshape(shape(bi, r["bj"]))[i - bi * self.side].tolist()]

    # -- element-wise -------------------------------------------------------------------------------------
    def _made(self, blocks: DataFrame, rows: int, cols: int, kind: str) -> BlockMatrix:
        return BlockMatrix(blocks, rows, cols, kind, self.side)

    def map(self, f: Callable[[np.ndarray], np.ndarray], kind: str | None = None) -> BlockMatrix:
        """``f`` on the cells of each block; ``kind`` of the result: f8, i8 or b1."""
        mine, out = self.kind, kind or self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                with np.errstate(all="ignore"):
                    yield _batch([(bi, bj, f(np.frombuffer(d, mine)).astype(out)) for bi, bj, d in _places(b)])

        return self._made(self.blocks.mapInArrow(run, _BLOCK), self._rows, self.cols, out)

    def zip(self, other: BlockMatrix, f: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str | None = None) -> BlockMatrix:
        if self.shape() != other.shape():
            raise ValueError(f"dimensions differ: {self.shape()} and {other.shape()}")
        if self.side != other.side:
            raise ValueError("blocks differ in size")
        mine, theirs, out = self.kind, other.kind, kind or self.kind
        both = self.blocks.join(other.blocks.withColumnRenamed("data", "_other"), ["bi", "bj"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                with np.errstate(all="ignore"):
                    yield _batch([(bi, bj, f(np.frombuffer(d, mine), np.frombuffer(e.as_buffer(), theirs)).astype(out)) for (bi, bj, d), e in zip(_places(b), b.column("_other"), strict=True)])

        return self._made(both.mapInArrow(run, _BLOCK), self._rows, self.cols, out)

    def _binary(self, other, f: Callable, kind: str | None = None) -> BlockMatrix:
        if isinstance(other, BlockMatrix):
            return self.zip(other, f, kind)
        return self.map(lambda x: f(x, other), kind)

    def __add__(self, other):
        return self._binary(other, np.add)

    def __sub__(self, other):
        return self._binary(other, np.subtract)

    def __mul__(self, other):
        return self._binary(other, np.multiply)

    def __truediv__(self, other):
        return self._binary(other, np.divide if self.kind == "f8" else lambda a, b: _whole_div(a, np.asarray(b)))

    def compare(self, op: str, other) -> BlockMatrix:
        return self._binary(other, _COMPARE[op], "b1")

    def __and__(self, other):
        return self._binary(other, np.logical_and)

    def __or__(self, other):
        return self._binary(other, np.logical_or)

    def __xor__(self, other):
        return self._binary(other, np.logical_xor)

    def __invert__(self):
        return self.map(np.logical_not)

    def is_nan(self) -> BlockMatrix:
        return self.map(np.isnan, "b1")

    def transpose(self) -> BlockMatrix:
        shape, kind = self._shape(), self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _batch([(bj, bi, np.frombuffer(d, kind).reshape(shape(bi, bj)).T) for bi, bj, d in _places(b)])

        return self._made(self.blocks.mapInArrow(run, _BLOCK), self.cols, self._rows, kind)

    # -- reductions -----------------------------------------------------------------------------------------
    def _reduced(self, axis: int, f: Callable[[np.ndarray, int], np.ndarray], merge: Callable, out: str) -> DataFrame:
        """(``j`` or ``i``, ``value``): ``f`` of each block along the axis, merged by Spark with partial aggregation."""
        shape, kind, side = self._shape(), self.kind, self.side
        name = "i" if axis else "j"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bi, bj, d in _places(b):
                    value = f(np.frombuffer(d, kind).reshape(shape(bi, bj)), axis)
                    at = (bi if axis else bj) * side + np.arange(len(value))
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value.astype({"double": "f8", "long": "i8", "boolean": "b1"}[out]))], [name, "value"])

        return self.blocks.mapInArrow(run, f"{name} long, value {out}").groupBy(name).agg(merge("value").alias("value"))

    def sum_vertical(self) -> DataFrame:
        """(j, value); NaN is skipped."""
        return self._reduced(0, np.nansum, F.sum, "double")

    def sum_horizontal(self) -> DataFrame:
        """(i, value); NaN is skipped."""
        return self._reduced(1, np.nansum, F.sum, "double")

    def prod_vertical(self) -> DataFrame:
        return self._reduced(0, np.nanprod, F.product, "double")

    def prod_horizontal(self) -> DataFrame:
        return self._reduced(1, np.nanprod, F.product, "double")

    def count_nan_vertical(self) -> DataFrame:
        return self._reduced(0, lambda x, axis: np.isnan(x).sum(axis), F.sum, "long")

    def count_nan_horizontal(self) -> DataFrame:
        return self._reduced(1, lambda x, axis: np.isnan(x).sum(axis), F.sum, "long")

    def any_vertical(self) -> DataFrame:
        return self._reduced(0, np.any, F.bool_or, "boolean")

    def any_horizontal(self) -> DataFrame:
        return self._reduced(1, np.any, F.bool_or, "boolean")

    def all_vertical(self) -> DataFrame:
        return self._reduced(0, np.all, F.bool_and, "boolean")

    def all_horizontal(self) -> DataFrame:
        return self._reduced(1, np.all, F.bool_and, "boolean")

    # -- products ---------------------------------------------------------------------------------------------
    def matmul(self, other: BlockMatrix | Matrix, tasks: int | None = None, cell: int = CELL) -> BlockMatrix:
        """The matrix product; NaN propagates."""
        if isinstance(other, Matrix):
            other = BlockMatrix.of(other, self.side)
        if self.cols != other.rows():
            raise ValueError(f"inner dimensions differ: {self.cols} and {other.rows()}")
        if self.side != other.side:
            raise ValueError("blocks differ in size")
        side, left_shape, right_shape, kinds = self.side, self._shape(), other._shape(), (self.kind, other.kind)
        p, q, r = (max(1, -(-n // side)) for n in (self._rows, self.cols, other.cols))
        work = self._rows * self.cols * other.cols
        tasks = tasks or min(self.blocks.sparkSession.sparkContext.defaultParallelism, 1 + work // (1 << 28))
        a, b, c = grid(p, q, r, side, cell, tasks)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        part = lambda name, n, parts: F.expr(f"{name} div {-(-n // parts)}").cast("long")
        # New names for the same columns: both factors may come from one table.
        own = [F.col(n).alias(n) for n in ("bi", "bj", "data")]
        left = self.blocks.select(*own, part("bi", p, a).alias("x"), part("bj", q, b).alias("y"), every(-(-r // -(-r // c))).alias("z"))
        right = other.blocks.select(*own, every(-(-p // -(-p // a))).alias("x"), part("bi", q, b).alias("y"), part("bj", r, c).alias("z"))

        def product(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            found: dict[tuple[int, int], np.ndarray] = {}
            inner: dict[int, list] = {}
            for bi, bj, d in _places(theirs):
                inner.setdefault(bi, []).append((bj, np.frombuffer(d, kinds[1]).reshape(right_shape(bi, bj)).astype("f8", copy=False)))
            for bi, bk, d in _places(mine):
                x = np.frombuffer(d, kinds[0]).reshape(left_shape(bi, bk)).astype("f8", copy=False)
                for bj, y in inner.get(bk, ()):
                    with np.errstate(all="ignore"):
                        z = x @ y
                    found[bi, bj] = found[bi, bj] + z if (bi, bj) in found else z
            y = (mine if mine.num_rows else theirs).column("y")[0].as_py()
            out = _batch([(bi, bj, v) for (bi, bj), v in found.items()])
            return pa.Table.from_batches([out]).append_column("y", pa.array([y] * out.num_rows, pa.int64()))

        def added(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(d, "f8") for _, _, d in _places(t))
            first = t.slice(0, 1)
            return pa.table({"bi": first.column("bi"), "bj": first.column("bj"), "data": pa.array([total.tobytes()], pa.binary()), "y": first.column("y")})

        cells = ["x", "y", "z"]
        got = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(product, f"{_BLOCK}, y long")
        layers = -(-q // -(-q // b))
        while layers > 1:
            got = got.withColumn("y", F.expr(f"y div {FAN}").cast("long")).groupBy("bi", "bj", "y").applyInArrow(added, f"{_BLOCK}, y long")
            layers = -(-layers // FAN)
        return BlockMatrix(got.drop("y"), self._rows, other.cols, "f8", side)

    dot = __matmul__ = matmul

    def __repr__(self) -> str:
        return f"BlockMatrix({self._rows} x {self.cols} of {_SQL[self.kind]}, blocks of {self.side})"

"""A labelled matrix with a typed row index (``int``, ``date`` or ``range``). Immutable: edits return new frames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from .matrix import POS, Matrix, Value

INDEX = "__idx"


class Frame(Matrix):
    def __repr__(self) -> str:
        """Shape, labels, and the index with its first and last key."""
        rows, low, high = self.source.agg(F.count("*"), F.min(INDEX), F.max(INDEX)).first()
        span = f"{low}..{high}" if rows else "empty"
        return f"Frame({rows} x {self.cols}, columns={self.columns}, index={self.kind} {span})"

    def __init__(self, source: DataFrame, cells: dict[str, Column], kind: str = "range") -> None:
        if kind not in ("int", "date", "range"):
            raise ValueError(f"unknown index kind: {kind}")
        super().__init__(source, cells, (POS, INDEX))
        self.kind = kind

    @classmethod
    def of(cls, df: DataFrame, index: str | None = None, columns: list[str] | None = None, kind: str = "int", pos: str | None = None, validate: bool = True, order: list[str] | None = None) -> Frame:
        """A frame over ``df``. ``index``: its unique key (else ``pos``, or a range 0, 1, ... over the rows).

        ``pos``: a column of dense positions; without it positions are the index itself.  With neither, rows are
        numbered without a gap, in the order in which ``df`` gives them or in that of the columns ``order``; for that they are
        written once.  ``validate`` counts once whether the index is unique.
        """
        names = columns or [c for c in df.columns if c not in (index, pos)]
        if len(set(names)) != len(names):
            raise ValueError("duplicate column label")
        missing = [c for c in names if c not in df.columns]
        if missing:
            raise KeyError(f"unknown column label: {missing[0]}")
        if index is None:
            source = df.withColumn(POS, F.col(pos)) if pos else numbered(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, *(order or [])])]), POS, order)
            source = source.withColumn(INDEX, F.col(POS))
            return cls(source, {c: F.col(f"`{c}`") for c in names}, "range")
        if validate:
            n, distinct, nulls = df.agg(F.count("*"), F.count_distinct(index), F.count_if(F.col(index).isNull())).first()
            if n != distinct or nulls:
                raise ValueError("duplicate index value")
        source = df.withColumns({POS: F.col(pos or index), INDEX: F.col(index)})
        return cls(source, {c: F.col(f"`{c}`") for c in names}, kind)

    def _new(self, cells: dict[str, Column], source: DataFrame | None = None) -> Frame:
        return Frame(source or self.source, cells, self.kind)

    @property
    def matrix(self) -> Matrix:
        """The cells without labels and index."""
        return Matrix(self.source, self.cells)

    def column_index(self, name: str) -> int | None:
        return self.columns.index(name) if name in self.cells else None

    def _known(self, name: str) -> str:
        if name not in self.cells:
            raise KeyError(f"unknown column label: {name}")
        return name

    def column(self, name: str) -> DataFrame:  # type: ignore[override]
        return self.source.select(POS, INDEX, self.cells[self._known(name)].alias(name))

    __getitem__ = column

    def index(self) -> DataFrame:
        return self.source.select(POS, INDEX)

    def _row(self, key: Column, shown: object) -> Row:
        got = self.df.where(F.col(INDEX) == key).drop(POS, INDEX).first()
        if got is None:
            raise KeyError(f"unknown row key: {shown}")
        return got

    def get_row(self, key: int) -> Row:
        """By label of an int or range index."""
        if self.kind == "date":
            raise TypeError("a date index is looked up by date")
        return self._row(F.lit(key), key)

    def get_row_date(self, key: dt.date) -> Row:
        if self.kind != "date":
            raise TypeError("only a date index is looked up by date")
        return self._row(F.lit(key), key)

    def set_cell(self, key: int | dt.date, column: str | int, value: Value) -> Frame:
        name = self._known(column) if isinstance(column, str) else self._name(column)
        return self._new({**self.cells, name: F.when(F.col(INDEX) == F.lit(key), F.lit(value)).otherwise(self.cells[name])})

    # -- labels ------------------------------------------------------------------------------------------------
    def rename(self, old: str, new: str) -> Frame:
        self._known(old)
        if old == new:
            raise ValueError("the new label is the old one")
        if new in self.cells:
            raise ValueError(f"duplicate column label: {new}")
        return self._new({new if n == old else n: e for n, e in self.cells.items()})

    def add_column(self, name: str, values: list | Column) -> Frame:  # type: ignore[override]
        return super().add_column(self.cols, values, name)

    def delete_column(self, name: str) -> tuple[Frame, DataFrame]:  # type: ignore[override]
        """The frame without the column, and the column."""
        gone = self.column(name)
        return self._new({n: e for n, e in self.cells.items() if n != name}), gone

    def sort_columns(self) -> Frame:
        return self._new({n: self.cells[n] for n in sorted(self.cells, key=lambda n: n.encode())})

    def dense(self) -> Frame:
        """The same rows, labels and index, with positions 0, 1, ... in the order of the present ones."""
        return self._over(numbered(self.df.withColumnRenamed(POS, "_was"), POS, ["_was"]).drop("_was"))

    def transpose(self) -> Matrix:  # type: ignore[override]
        """Without labels and index.  Where positions have gaps (an index without ``pos``), rows count in their order."""
        n, last = self.source.agg(F.count("*"), F.max(POS)).first()
        return (self.dense() if n and last + 1 != n else self).matrix.transpose()

    # -- aligned arithmetic ----------------------------------------------------------------------------------------
    def _beside(self, other: Matrix, on: str = INDEX, strict: bool = True):
        if isinstance(other, Frame) and strict and self.kind != other.kind:
            raise ValueError("row indexes differ in kind")
        return super()._beside(other, on if isinstance(other, Frame) else POS, strict)

    def _binary(self, other, f: Callable[[Column, Column], Column]):
        if isinstance(other, Frame) and self.columns != other.columns:
            raise ValueError("column labels differ")
        return super()._binary(other, f)

    frame_map = Matrix.map

    def frame_zip(self, other: Frame, f: Callable[[Column, Column], Column]) -> Frame:
        """Only dimensions must agree; labels and index are those of this frame."""
        source, left, right = Matrix._beside(self, other, POS)
        return self._new({n: f(a, b) for n, a, b in zip(self.columns, left, right, strict=True)}, source)

    def map(self, f: Callable[[Column], Column]) -> Matrix:
        return self.matrix.map(f)

    def zip(self, other: Frame, f: Callable[[Column, Column], Column]) -> Matrix:
        return self.matrix.zip(other.matrix, f)

    def equals(self, other: Matrix) -> bool:
        return isinstance(other, Frame) and self.kind == other.kind and super().equals(other)

"""Matrices from values in memory, constants, and Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.frame import INDEX, Frame
from ..operators.matrix import POS, Matrix, Value


def from_cols(spark: SparkSession, cols: list[list], names: list[str] | None = None) -> Matrix:
    if not cols or not cols[0]:
        raise ValueError("a matrix needs a column and a row")
    if len({len(c) for c in cols}) > 1:
        raise ValueError("columns differ in length")
    names = names or [f"c{i}" for i in range(len(cols))]
    if any(isinstance(v, float) for c in cols for v in c):  # one element type: whole numbers among doubles are doubles
        cols = [[float(v) for v in c] for c in cols]
    return Matrix.over(spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*cols, strict=True))], [POS, *names]))


def from_vec(spark: SparkSession, data: list, rows: int, cols: int) -> Matrix:
    """Column after column."""
    if len(data) != rows * cols:
        raise ValueError(f"{len(data)} values for {rows} x {cols} cells")
    return from_cols(spark, [data[c * rows : (c + 1) * rows] for c in range(cols)])


def from_rows_vec(spark: SparkSession, data: list, rows: int, cols: int) -> Matrix:
    """Row after row; values beyond rows x cols are ignored."""
    if len(data) < rows * cols:
        raise ValueError(f"{len(data)} values for {rows} x {cols} cells")
    return from_cols(spark, [[data[r * cols + c] for r in range(rows)] for c in range(cols)])


def filled(spark: SparkSession, rows: int, cols: int, value: Value) -> Matrix:
    return Matrix(spark.range(rows).withColumnRenamed("id", POS), {f"c{i}": F.lit(value) for i in range(cols)})


def zeros(spark: SparkSession, rows: int, cols: int) -> Matrix:
    return filled(spark, rows, cols, 0.0)


def ones(spark: SparkSession, rows: int, cols: int) -> Matrix:
    return filled(spark, rows, cols, 1.0)


def nans(spark: SparkSession, rows: int, cols: int) -> Matrix:
    return filled(spark, rows, cols, float("nan"))


def frame(m: Matrix, labels: list[str], index: list | range | None = None) -> Frame:
    """Labels and an index (ints, dates, or a range; else 0..n) for a matrix."""
    if len(labels) != m.cols:
        raise ValueError(f"{len(labels)} labels for {m.cols} columns")
    if len(set(labels)) != len(labels):
        raise ValueError("duplicate column label")
    cells = {n: F.col(f"`{c}`") for n, c in zip(labels, m.columns, strict=True)}
    if index is None:
        return Frame(m.df.withColumn(INDEX, F.col(POS)), cells, "range")
    if len(index) != m.rows():
        raise ValueError(f"index length mismatch: {len(index)} keys for {m.rows()} rows")
    if isinstance(index, range):
        return Frame(m.df.withColumn(INDEX, F.col(POS) * index.step + index.start), cells, "range")
    if len(set(index)) != len(index):
        raise ValueError("duplicate index value")
    kind = "int" if isinstance(index[0], int) else "date"
    keys = m.source.sparkSession.createDataFrame(list(enumerate(index)), f"_p long, {INDEX} {'long' if kind == 'int' else 'date'}")
    return Frame(m.df.join(keys, F.col(POS) == F.col("_p")).drop("_p"), cells, kind)


def read_frame(spark: SparkSession, path: str, index: str, columns: list[str], kind: str = "int", validate: bool = True) -> Frame:
    """Columns of a Parquet table, as doubles, by a unique key."""
    df = spark.read.parquet(path).select(index, *[F.col(c).cast("double").alias(c) for c in columns if c != index])
    return Frame.of(df, index, columns, kind, validate=validate)


def write(m: Matrix, path: str) -> None:
    m.df.write.parquet(path)

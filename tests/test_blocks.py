"""Matrices in blocks against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from columna.operators import matrix
from columna.operators.blocks import BlockMatrix, grid
from columna.operators.matrix import POS, Matrix


def made(spark, rows: int, cols: int, seed: int = 1) -> tuple[Matrix, np.ndarray]:
    x = np.random.default_rng(seed).integers(-9, 10, (rows, cols)) / 4.0
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], f"{POS} long, x array<double>").repartition(3)
    return Matrix(df, {f"c{j}": F.col("x")[j] for j in range(cols)}), x


def dense(b: BlockMatrix) -> np.ndarray:
    out = np.full(b.shape(), np.nan)
    for r in b.to_long().collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def column(df, key: str) -> list:
    return [r["value"] for r in df.orderBy(key).collect()]


def test_blocks_and_back(spark):
    m, x = made(spark, 23, 11)
    b = m.blocks(4)
    assert b.shape() == (23, 11) and b.blocks.count() == 18
    assert (dense(b) == x).all() and (dense(b.transpose()) == x.T).all() and (dense(b.transpose().transpose()) == x).all()
    back = b.transpose().to_matrix().df.orderBy(POS).collect()
    assert [[r[f"c{j}"] for j in range(23)] for r in back] == x.T.tolist()
    assert b.get(22, 10) == x[22, 10] and b.row(9) == x[9].tolist()
    with pytest.raises(IndexError):
        b.get(23, 0)


def test_element_wise_and_axes(spark):
    m, x = made(spark, 9, 7)
    n, y = made(spark, 9, 7, 2)
    a, b = m.blocks(4), n.blocks(4)
    with np.errstate(all="ignore"):
        for got, want in ((a + b, x + y), (a - b, x - y), (a * b, x * y), (a / b, x / y), (a * 2.0 + 1.0, x * 2 + 1)):
            assert np.array_equal(dense(got), want, equal_nan=True)
        odd, w = a / b, x / y
    assert np.allclose(column(odd.sum_vertical(), "j"), np.nansum(w, 0), equal_nan=True) and np.allclose(column(a.sum_horizontal(), "i"), x.sum(1))
    assert np.allclose(column(a.prod_horizontal(), "i"), x.prod(1)) and np.allclose(column(a.prod_vertical(), "j"), x.prod(0))
    assert column(odd.count_nan_vertical(), "j") == np.isnan(w).sum(0).tolist() and column(odd.count_nan_horizontal(), "i") == np.isnan(w).sum(1).tolist()
    low, high = a.compare("lt", 0.0), a.compare("ge", b)
    assert column((low | ~high).any_vertical(), "j") == ((x < 0) | ~(x >= y)).any(0).tolist() and column((low ^ high).all_horizontal(), "i") == ((x < 0) ^ (x >= y)).all(1).tolist()
    with pytest.raises(ValueError):
        a + b.transpose()


def test_whole_numbers_and_masks(spark):
    df = spark.createDataFrame([(0, 7, -7), (1, 3, 2)], f"{POS} long, a int, b int")
    b = Matrix.over(df).blocks(1)
    assert b.kind == "i8" and dense(b / 2).tolist() == [[3, -3], [1, 1]] and dense(b.transpose()).tolist() == [[7, 3], [-7, 2]]
    with pytest.raises(TypeError):
        Matrix.over(spark.createDataFrame([(0, "x")], f"{POS} long, a string")).blocks()


@pytest.mark.parametrize("shape", [(13, 40, 9), (1, 1, 1), (40, 3, 40), (5, 90, 5), (33, 17, 2)])
@pytest.mark.parametrize("tasks,cell", [(1, 1 << 23), (6, 200), (64, 48)])
def test_products_in_every_grid(spark, shape, tasks, cell):
    p, q, r = shape
    (m, x), (n, y) = made(spark, p, q), made(spark, q, r, 3)
    got = m.blocks(4).matmul(n.blocks(4), tasks=tasks, cell=cell)
    assert got.shape() == (p, r) and np.allclose(dense(got), x @ y)


def test_neither_factor_fits_in_a_task(spark, monkeypatch):
    """The right factor is beyond what is sent to tasks, and a task holds a small share of either."""
    monkeypatch.setattr(matrix, "SENT_CELLS", 100)
    monkeypatch.setattr(matrix, "LITERAL_CELLS", 10)
    (m, x), (n, y) = made(spark, 70, 60), made(spark, 60, 50, 5)
    rows = m.matmul(n).df.orderBy(POS).collect()
    assert np.allclose([[r[f"c{j}"] for j in range(50)] for r in rows], x @ y)
    small = m.blocks(8).matmul(n.blocks(8), cell=3 * 64 * 4)
    assert np.allclose(dense(small), x @ y)


def test_grid_sends_little_and_fits():
    assert grid(1, 1000, 1, cell=10 * 512 * 512, tasks=8)[0::2] == (1, 1)
    assert grid(100, 1, 1, tasks=8) == (100, 1, 1) or grid(100, 1, 1, tasks=8)[1:] == (1, 1)
    for p, q, r in ((7, 9, 300), (50, 50, 50), (1, 1, 1)):
        a, b, c = grid(p, q, r, tasks=16)
        x, y, z = -(-p // a), -(-q // b), -(-r // c)
        assert (x * y + y * z + x * z) * 512 * 512 <= 1 << 23 or x * y * z == 1


def test_nan_propagates_in_products(spark):
    df = spark.createDataFrame([(0, math.nan, 1.0), (1, 2.0, 3.0)], f"{POS} long, a double, b double")
    b = Matrix.over(df).blocks(1)
    got = dense(b.matmul(b))
    assert np.isnan(got[0]).all() and np.isnan(got[1, 0]) and got[1, 1] == 11.0
    assert dense(b + b)[1].tolist() == [4.0, 6.0]


def test_transpose_of_many_rows_stays_a_matrix(spark):
    m = Matrix(spark.range(2500).select(F.col("id").alias(POS), F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b")), {"a": F.col("a"), "b": F.col("b")})
    t = m.transpose()
    assert isinstance(t, BlockMatrix) and t.shape() == (2, 2500) and t.get(1, 2499) == 4998.0
    assert [r["value"] for r in t.sum_horizontal().orderBy("i").collect()] == [2499 * 1250.0, 2499 * 2500.0]
    assert dense(t.matmul(m.blocks()))[0, 1] == 2 * sum(i * i for i in range(2500))


def test_gaps_are_no_nulls(spark):
    """Positions with a gap, or twice, raise instead of giving empty cells."""
    gap = Matrix.over(spark.createDataFrame([(0, 1.0), (5, 2.0)], f"{POS} long, a double"))
    twice = Matrix.over(spark.createDataFrame([(0, 1.0), (0, 2.0), (2, 3.0)], f"{POS} long, a double"))
    for m in (gap, gap):
        with pytest.raises(ValueError):
            m.transpose()
    with pytest.raises(ValueError):
        gap.blocks()
    with pytest.raises(Exception, match="not dense"):
        twice.blocks().blocks.collect()

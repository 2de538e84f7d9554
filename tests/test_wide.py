"""Many columns, many ranks, and the cases in which an order statistic has no answer."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from columna.operators import models, rng, stats
from columna.operators.matrix import POS, Matrix
from columna.plans import queries_whole
from columna.sources.build import from_cols, from_vec


@pytest.fixture(scope="module")
def wide(spark):
    rows = spark.range(60).select(F.col("id").alias(POS), F.transform(F.sequence(F.lit(0), F.lit(499)), lambda j: (F.col("id") * 31 + j * 17) % 23 / F.lit(4.0)).alias("x"))
    rows = rows.select(POS, F.explode(F.array("x")).alias("x"))
    return Matrix(rows, {f"c{j}": F.col("x")[j] for j in range(500)}), np.array([[(i * 31 + j * 17) % 23 / 4 for j in range(500)] for i in range(60)])


def cells(m, width):
    rows = m.df.orderBy(POS).collect()
    return np.array([[r[f"c{k}"] for k in range(width)] for r in rows])


def test_five_hundred_columns(spark, wide):
    m, x = wide
    assert np.allclose(cells(m.cumsum_horizontal(), 500), np.cumsum(x, 1))
    got = np.zeros((500, 500))
    for r in stats.covariance_matrix(m).collect():
        got[r["i"], r["j"]] = r["value"]
    assert np.allclose(got, np.cov(x.T))
    factor = np.arange(500 * 12).reshape(500, 12) % 7 / 3
    right = spark.range(500).select(F.col("id").alias(POS), *[((F.col("id") * 12 + k) % 7 / F.lit(3.0)).alias(f"k{k}") for k in range(12)])
    assert np.allclose(cells(m.matmul(Matrix.over(right)), 12), x @ factor)


def test_cumsum_horizontal_skips_nan(spark):
    row = [1.0, math.nan] + [2.0] * 10
    m = from_cols(spark, [[v] for v in row])
    assert cells(m.cumsum_horizontal(), 12).tolist() == [[1, 1, *range(3, 23, 2)]]


def test_row_covariance_in_blocks(spark, wide):
    m, x = wide
    got = {(r["i"], r["j"]): r["value"] for r in stats.covariance_horizontal(m, block=7).collect()}
    assert len(got) == 3600 and all(got[i, j] == pytest.approx(v) for (i, j), v in np.ndenumerate(np.cov(x, bias=True)))


def test_row_covariance_is_rounded_where_it_is_made(spark, wide, tmp_path):
    """Rounding rows**2 cells one by one in the plan took most of the query's time."""
    m, x = wide
    exact = {(r["i"], r["j"]): r["value"] for r in stats.covariance_horizontal(m, block=7).collect()}
    got = {(r["i"], r["j"]): r["value"] for r in stats.covariance_horizontal(m, block=7, digits=3).collect()}
    assert got.keys() == exact.keys() and all(abs(v - exact[k]) < 0.000501 and v == round(v, 3) for k, v in got.items())
    v = np.array([0.5, 1.5, -0.5, -2.5, -0.25, 0.0, -0.0, 1e300, -1e307, math.inf, math.nan])
    want = [1.0, 2.0, -1.0, -3.0, 0.0, 0.0, 0.0, 1e300, -1e307, math.inf, math.nan]
    assert list(map(repr, stats._round_half_up(v, 0).tolist())) == list(map(repr, want))
    assert list(map(repr, stats._round_half_up(np.array([5e-7, -5e-7, np.nextafter(5e-7, 0), -1e-9, 1e307]), 6).tolist())) == ["1e-06", "-1e-06", "0.0", "0.0", "1e+307"]
    spark.createDataFrame([(0, 1, [1.0, 2.0, 4.0]), (1, 1, [2.0, 1.0, 1.0])], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries_whole.covariance_horizontal_embeddings(spark, str(tmp_path))
    assert {(r["i"], r["j"]): r["value"] for r in found.collect()} == {(0, 0): 1.555556, (0, 1): -0.444444, (1, 0): -0.444444, (1, 1): 0.222222}
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_row_covariance_holds_rows_on_disk_once(spark, wide):
    """Each row went to every pair of its block, so the shuffle grew as the square of the rows: 1,800 records for 60 rows here."""
    m, x = wide
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    sent = lambda: sum((s := stages().apply(k)).shuffleWriteRecords() for k in range(stages().size()))
    found = stats.covariance_horizontal(m, block=2)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = sent()
    got = {(r["i"], r["j"]): r["value"] for r in found.collect()}
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert len(got) == 3600 and all(got[i, j] == pytest.approx(v) for (i, j), v in np.ndenumerate(np.cov(x, bias=True)))
    assert 60 <= sent() - before <= 60 + 30


def test_row_covariance_is_small_when_written(spark, tmp_path):
    """Both cells of a pair of rows lie near each other, so that the second one costs next to nothing."""
    v = np.random.default_rng(1).normal(size=(512, 16)).round(3)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], f"{POS} long, x array<double>")
    m = Matrix(df, {f"c{j}": F.col("x")[j] for j in range(16)})
    stats.covariance_horizontal(m, block=128, digits=3).coalesce(1).write.parquet(f"{tmp_path}/out")
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(2) for f in tmp_path.glob("out/*.parquet")]
    assert sum(c.num_values for c in columns) == 512 * 512
    assert sum(c.total_compressed_size for c in columns) < 0.8 * sum(c.total_uncompressed_size for c in columns)


def test_row_covariance_of_any_positions(spark):
    """Blocks behind one below zero got no rows of the other, and a gap made as many blocks as fit in it."""
    at, v = [-9, -3, 0, 5, 10**12], np.arange(15.0).reshape(5, 3) ** 2 % 7
    df = spark.createDataFrame([(i, *r) for i, r in zip(at, v.tolist(), strict=True)], f"{POS} long, c0 double, c1 double, c2 double")
    got = {(r["i"], r["j"]): r["value"] for r in stats.covariance_horizontal(Matrix.over(df), block=2).collect()}
    assert got == {(at[i], at[j]): pytest.approx(c) for (i, j), c in np.ndenumerate(np.cov(v, bias=True))}
    assert stats.covariance_horizontal(Matrix.over(df.where("false"))).collect() == []


def test_order_statistics(spark, monkeypatch):
    assert stats.median(from_vec(spark, [3.0, 1, 4, 1], 4, 1)) == 2 and stats.median(from_vec(spark, [3.0], 1, 1)) == 3
    many = Matrix(spark.range(20_001).select(F.col("id").alias(POS), ((F.col("id") * 7919) % 20_011).cast("double").alias("c0")), {"c0": F.col("c0")})
    want = np.sort((np.arange(20_001) * 7919) % 20_011)
    monkeypatch.setattr(stats, "FEW_VALUES", 20)
    assert stats.median_vertical(many).first()[0] == want[10_000] and stats.percentile_vertical(many, 99.9).first()[0] == want[19_980]
    for p in (0, 0.004, 37.3, 50, 100):
        assert stats.percentile_vertical(many, p).first()[0] == want[math.floor(p / 100 * 20_000 + 0.5)]
    ties = Matrix(spark.range(30_000).select(F.col("id").alias(POS), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 11 * 1.0).alias("a"), F.lit(2.5).alias("b")), {"a": F.col("a"), "b": F.col("b")})
    v = np.sort([5.0 if i % 3 == 0 else float(i % 11) for i in range(30_000)])
    assert tuple(stats.percentile_vertical(ties, 62.0).first()) == (v[math.floor(0.62 * 29_999 + 0.5)], 2.5) and stats.median_vertical(ties).first()[0] == (v[14_999] + v[15_000]) / 2
    monkeypatch.setattr(stats, "BRACKET", 0.0003)
    monkeypatch.setattr(stats, "ACCURACY", 2)  # a sketch that misses: all values are looked at
    assert stats.percentile_vertical(many, 37.3).first()[0] == want[math.floor(0.373 * 20_000 + 0.5)]
    for bad in (from_vec(spark, [1.0, math.nan, 3, 4], 4, 1), Matrix(many.source.where("c0 < 0"), many.cells)):
        for f in (stats.median, stats.median_vertical, lambda m: stats.percentile(m, 100), lambda m: stats.percentile_vertical(m, 50)):
            with pytest.raises(ValueError):
                f(bad)


def test_models_over_long_rows(spark, wide):
    m, x = wide
    w = np.linspace(-1, 1, 500)
    model = models.LinReg(500)
    model.w, model.b = w, 0.5
    assert np.allclose([r["value"] for r in model.predict(m).orderBy(POS).collect()], x @ w + 0.5)
    some = Matrix(m.source, {f"c{j}": m.cells[f"c{j}"] for j in range(40)})
    fitted = models.GaussianNB().fit(some, (F.col(POS) % 3).cast("double"))
    y = np.arange(60) % 3
    mean, var = (np.array([f(x[y == k, :40], 0) for k in range(3)]) for f in (np.mean, np.var))
    var = var + 1e-9 * x[:, :40].var(0).max()
    score = -0.5 * (np.log(2 * np.pi * var).sum(1)[None] + ((x[:, None, :40] - mean) ** 2 / var).sum(2)) + np.log(1 / 3)
    assert [r["label"] for r in fitted.predict(some).orderBy(POS).collect()] == score.argmax(1).tolist()


def test_fits_over_long_rows(spark, wide):
    """64 columns: products are added up in numpy, not as aggregates in one plan."""
    m, x = wide
    some, v = Matrix(m.source, {f"c{j}": m.cells[f"c{j}"] for j in range(64)}), x[:, :64]
    y = np.arange(60) % 7 / 2.0
    fitted = models.LinReg(64).fit(some, F.col(POS) % 7 / 2.0, 0.0005, 20)
    w, b = np.zeros(64), 0.0
    for _ in range(20):
        e = v @ w + b - y
        w, b = w - 0.0005 * 2 / 60 * (v.T @ e), b - 0.0005 * 2 / 60 * e.sum()
    assert np.allclose(fitted.w, w) and fitted.b == pytest.approx(b)
    p = models.PCA.fit(some, 3)
    assert np.allclose(p.components, np.cov(v.T)[:3]) and np.allclose(p.mean, v.mean(0))


def test_row_centred_covariance_of_long_rows(spark, wide):
    m, x = wide
    some, v = Matrix(m.source, {f"c{j}": m.cells[f"c{j}"] for j in range(64)}), x[:, :64]
    got = np.zeros((64, 64))
    for r in stats.covariance_matrix(some, "row").collect():
        got[r["i"], r["j"]] = r["value"]
    c = v - v.mean(1, keepdims=True)
    assert np.allclose(got, c.T @ c / 59)


def test_a_thousand_centroids(spark):
    rng_ = np.random.default_rng(5)
    v = np.round(rng_.normal(size=(3000, 64)), 2)
    v[2000:2400] = v[:400]  # ties
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], f"{POS} long, x array<double>").repartition(4)
    m = Matrix(df, {f"c{j}": F.col("x")[j] for j in range(64)})
    init = v[:1000].copy()
    init[7] = init[3]  # an empty cluster
    model, labels = models.KMeans.fit(m, 1000, max_iter=2, tol=0.0, init=init)
    cent = init
    for _ in range(2):
        d = ((v[:, None] - cent) ** 2).sum(2)
        near = d.argmin(1)
        n = np.bincount(near, minlength=1000)
        new = cent.copy()
        for k in np.flatnonzero(n):
            new[k] = v[near == k].mean(0)
        for k, far in zip(np.flatnonzero(n == 0), np.lexsort((np.arange(3000), -d.min(1))), strict=False):
            new[k] = v[far]
        cent = new
    assert [r["label"] for r in labels.orderBy(POS).collect()] == near.tolist() and np.allclose(model.centroids, cent)


def test_ten_thousand_labels(spark):
    v = (np.arange(40_000)[:, None] * np.arange(1, 9)) % 997 / 7.0 + (np.arange(40_000) % 10_000)[:, None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], f"{POS} long, x array<double>").repartition(4)
    m = Matrix(df, {f"c{j}": F.col("x")[j] for j in range(8)})
    fitted = models.GaussianNB().fit(m, (F.col(POS) % 10_000).cast("double"))
    assert fitted.classes == [float(i) for i in range(10_000)]
    y = np.arange(40_000) % 10_000
    mean = np.array([v[y == k].mean(0) for k in (0, 77, 9999)])
    assert np.allclose(fitted.means[[0, 77, 9999]], mean)
    got = np.array([r["label"] for r in fitted.predict(m).where(f"{POS} % 500 = 0").orderBy(POS).collect()])
    some = v[::500]
    score = np.stack([np.log(fitted.priors[k]) - 0.5 * np.log(2 * np.pi * fitted.variances[k]).sum() - 0.5 * ((some - fitted.means[k]) ** 2 / fitted.variances[k]).sum(1) for k in range(10_000)], 1)
    assert got.tolist() == score.argmax(1).tolist()


def test_random_sequences(spark):
    g = rng.Prng(42)
    want = [g.next_u64() for _ in range(1000)]
    got = rng.xorshift(spark, 42, 1000, block=64).orderBy("i").collect()
    assert [r["state"] % (1 << 64) for r in got] == want and [r["i"] for r in got] == list(range(1000))
    mixed = rng.shuffle(spark.range(500), 3, "id").collect()
    assert [r["__pos"] for r in mixed] == list(range(500)) and sorted(r["id"] for r in mixed) == list(range(500)) and [r["id"] for r in mixed[:50]] != list(range(50))

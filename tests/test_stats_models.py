from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from columna.functions import activations as A
from columna.functions import distributions as D
from columna.operators import life, models, rng, stats
from columna.sources.build import from_cols, from_rows_vec, from_vec


def one(spark, e):
    return spark.range(1).select(e).first()[0]


def v(df):
    return list(df.first())


def h(df):
    return [r[1] for r in df.orderBy("__pos").collect()]


def square(df):
    return {(r["i"], r["j"]): r["value"] for r in df.collect()}


def test_descriptive(spark):
    m = from_vec(spark, [1.0, 4, 2, 5, 3, 6], 2, 3)
    assert stats.mean(m) == 3.5 and v(stats.mean_vertical(m)) == [2.5, 3.5, 4.5] and h(stats.mean_horizontal(m)) == [2, 5]
    assert v(stats.population_variance_vertical(m)) == [2.25] * 3 and v(stats.sample_variance_vertical(m)) == [4.5] * 3
    assert h(stats.population_variance_horizontal(m)) == pytest.approx([2 / 3] * 2) and h(stats.sample_variance_horizontal(m)) == [1, 1]
    x = from_vec(spark, [1.0, 2, 3, 4, 100], 1, 5)
    assert stats.mean(x) == 22 and stats.population_variance(x) == 1522 and stats.stddev(x) == pytest.approx(39.0128183970461) and stats.median(x) == 3
    assert math.isnan(stats.sample_variance(from_vec(spark, [1.0], 1, 1)))
    assert v(stats.median_vertical(m)) == [2.5, 3.5, 4.5] and h(stats.median_horizontal(m)) == [2, 5]
    assert h(stats.stddev_horizontal(m)) == pytest.approx([math.sqrt(2 / 3)] * 2) and v(stats.stddev_vertical(m)) == [1.5] * 3


def test_nearest_rank(spark):
    m = from_vec(spark, [float(i) for i in range(1, 25)], 4, 6)
    assert v(stats.percentile_vertical(m, 0)) == [1, 5, 9, 13, 17, 21]
    assert v(stats.percentile_vertical(m, 50)) == [3, 7, 11, 15, 19, 23]
    assert v(stats.percentile_vertical(m, 100)) == [4, 8, 12, 16, 20, 24]
    assert h(stats.percentile_horizontal(m, 50)) == [13, 14, 15, 16]
    assert stats.percentile(from_vec(spark, [1.0, 2, 3, 4], 1, 4), 50) == 3
    with pytest.raises(ValueError):
        stats.percentile(m, 101)


def test_covariance(spark):
    m = from_rows_vec(spark, [1.0, 2, 3, 4], 2, 2)
    assert set(square(stats.covariance_vertical(m)).values()) == {1.0}
    assert set(square(stats.covariance_horizontal(m)).values()) == {0.25}
    assert set(square(stats.covariance_matrix(m)).values()) == {2.0}
    assert square(stats.covariance_matrix(m, "row")) == {(0, 0): 0.5, (0, 1): -0.5, (1, 0): -0.5, (1, 1): 0.5}
    a, b = from_vec(spark, [1.0, 2, 3, 4], 4, 1), from_vec(spark, [1.0, 2, 3, 5], 4, 1)
    assert stats.covariance(a, b) == 1.625 and stats.pearson(a, b) == pytest.approx(0.9827076298)
    assert stats.pearson(a, from_vec(spark, [1.0] * 4, 4, 1)) == 0.0


def test_distributions(spark):
    x = lambda a: F.lit(float(a))
    assert one(spark, D.erf(x(0))) == pytest.approx(1e-9, rel=1e-6) and one(spark, D.erf(x(1))) == pytest.approx(0.8427006897, abs=1e-9)
    assert one(spark, D.normal_cdf(x(1), 0, 1)) == pytest.approx(0.8413447, abs=1e-6) and one(spark, D.normal_pdf(x(0), 0, 1)) == pytest.approx(0.39894228)
    assert one(spark, D.uniform_pdf(x("nan"), 0, 2)) == 0.5 and one(spark, D.uniform_cdf(x("nan"), 0, 2)) == 1.0 and one(spark, D.uniform_cdf(x(-1), 0, 2)) == 0
    assert one(spark, D.gamma(x(0.3))) == pytest.approx(2.9915689876875904) and one(spark, D.gamma(x(5))) == pytest.approx(24)
    assert one(spark, D.lower_incomplete_gamma(2.0, x(1))) == pytest.approx(0.2642411176571153) and one(spark, D.gamma_cdf(x(-1), 2, 1)) == 0
    k = F.lit(2)
    assert one(spark, D.binomial_pmf(5, k, 0.5)) == 0.3125 and one(spark, D.binomial_cdf(5, k, 0.5)) == 0.5 and one(spark, D.binomial_pmf(5, F.lit(6), 0.5)) == 0
    assert one(spark, D.poisson_pmf(2.0, F.lit(0))) == pytest.approx(math.exp(-2)) and one(spark, D.poisson_cdf(2.0, F.lit(1))) == pytest.approx(3 * math.exp(-2))


def test_inference(spark):
    s = lambda a: spark.createDataFrame([(float(i),) for i in a], "v double")
    assert tuple(stats.t_test(s(range(1, 6)), s(range(6, 11))).first()) == (pytest.approx(-5), 0.5)
    cells = spark.createDataFrame([(0, 0, 12), (1, 0, 5), (0, 1, 8), (1, 1, 10)], "r int, c int, n long")
    got = stats.chi2_test(cells, "r", "c", "n").first()
    assert got["chi2"] == pytest.approx(2.4400871459694997) and got["p"] == pytest.approx(0.02716687584915145)
    assert stats.chi2_test(cells, "r", "c", "n", textbook=True).first()["p"] == pytest.approx(0.118270, abs=1e-5)
    g = spark.createDataFrame([(k, float(k + i)) for k in range(1, 4) for i in range(5)], "g int, v double")
    assert tuple(stats.anova(g, "g", "v").first()) == (pytest.approx(1.6), pytest.approx(0.20189651799465536))


def test_activations(spark):
    nan = F.lit(float("nan"))
    assert one(spark, A.relu(nan)) == 0 and one(spark, A.drelu(F.lit(0.0))) == 0 and one(spark, A.dleaky_relu(nan)) == 0.01
    assert one(spark, A.leaky_relu(F.lit(-2.0))) == -0.02 and one(spark, A.sigmoid(F.lit(0.0))) == 0.5 and one(spark, A.dsigmoid(F.lit(0.5))) == 0.25
    assert one(spark, A.dtanh(F.lit(1.0))) == pytest.approx(0.41997434161)


def test_regressions(spark, monkeypatch):
    x = from_vec(spark, [1.0, 2, 3, 4], 4, 1)
    y = F.col("__pos") + 2.0
    m = models.LinReg(1).fit(x, y, 0.01, 100)
    assert (m.w[0], m.b) == (pytest.approx(1.1490523883), pytest.approx(0.5617677562))
    assert h(m.fit(x, y, 0.01, 10_000).predict(x)) == pytest.approx([2, 3, 4, 5], abs=1e-2)
    t = (F.col("__pos") >= 2).cast("double")
    g = models.LogReg(1).fit(x, t, 0.1, 100)
    assert (g.w[0], g.b) == (pytest.approx(0.6877918896), pytest.approx(-1.2158512498))
    d = models.LogReg(1).fit(x, t, 0.1, 3, held=False)
    assert d.w[0] == pytest.approx(models.LogReg(1).fit(x, t, 0.1, 3).w[0])
    monkeypatch.setattr(models, "TASK_CELLS", 2)
    e = models.LogReg(1).fit(x, t, 0.1, 3)  # in several tasks
    assert (e.w[0], e.b) == (pytest.approx(d.w[0]), pytest.approx(d.b))
    monkeypatch.undo()
    assert h(models.LogReg(1).fit(x, t, 0.01, 10_000).predict(x)) == [0, 0, 1, 1]


def test_pca(spark):
    x = from_rows_vec(spark, [1.0, 1, 2, 2, 3, 3], 3, 2)
    p = models.PCA.fit(x, 1)
    assert p.components.tolist() == [[1, 1]] and p.transform(x).to_vec() == [-2, 0, 2]
    assert models.PCA.fit(from_rows_vec(spark, [1.0, 2, 3, 4, 5, 6], 3, 2), 3).components[2].tolist() == [0, 0]


def test_kmeans(spark):
    x = from_cols(spark, [[1.0, 1.5, 5, 8, 6], [1.0, 1.5, 8, 8, 7]])
    m, labels = models.KMeans.fit(x, 2, init=np.array([[1.0, 1], [8.0, 8]]))
    assert h(labels) == [0, 0, 1, 1, 1] == h(m.predict(x))
    m, labels = models.KMeans.fit(from_cols(spark, [[1.0, 2, 3], [1.0, 2, 3]]), 1)
    assert m.centroids.tolist() == [[2, 2]] and h(labels) == [0, 0, 0]
    m, labels = models.KMeans.fit(x, 2, seed=4)
    assert len(set(h(labels))) == 2
    with pytest.raises(ValueError):
        models.KMeans.fit(x, 9)


def test_gaussian_nb(spark):
    x = from_vec(spark, [1.0, 1.2, 0.8, 3, 3.2, 2.8], 6, 1)
    m = models.GaussianNB().fit(x, (F.col("__pos") >= 3).cast("double"))
    assert h(m.predict(from_vec(spark, [1.1, 3.1, float("nan")], 3, 1))) == [0, 1, 0]


def test_dense_nn(spark, monkeypatch):
    assert models.loss_gradient("bce", np.array([0.1, 0.9, 0.4]), np.array([0, 1, 0.5])).tolist() == pytest.approx([0.1 / 3, -0.1 / 3, -0.1 / 3])
    with pytest.raises(ValueError):
        models.DenseNN([1, 2, 1], ["relu"])
    x = from_cols(spark, [[0.0, 0, 1, 1], [0.0, 1, 0, 1]])
    y = [(F.col("__pos") == 3).cast("double")]
    make = lambda: models.DenseNN([2, 3, 1], ["tanh", "sigmoid"], loss="bce", rate=1.0, epochs=5, seed=2)
    near = make().train(x, y)
    far = make().train(x, y, held=False)
    monkeypatch.setattr(models, "TASK_CELLS", 3)
    wide = make().train(x, y)  # in several tasks
    monkeypatch.undo()
    for other in (far, wide):
        assert all(np.allclose(a, b) for a, b in zip(near.weights + near.biases, other.weights + other.biases, strict=True))
    assert len(h(near.predict(x))) == 4


def test_random(spark):
    p = rng.Prng(42)
    assert [p.next_u64() for _ in range(3)] == [45454805674, 11532217803599905471, 10021416941527320954]
    assert rng.Prng(0).next_u64() == 0
    items = [1, 2, 3, 4, 5]
    rng.Prng(3).shuffle(items)
    assert items == [5, 2, 1, 3, 4]
    assert [r["state"] % (1 << 64) for r in rng.xorshift(spark, 42, 3).collect()] == [45454805674, 11532217803599905471, 10021416941527320954]
    df = spark.range(2000).select(rng.uniform(2.0, 3.0, 1).alias("u"), rng.uniform_int(0, 4, 2).alias("k"), rng.normal(0.0, 1.0, 3).alias("z"), rng.boolean(4).alias("b"))
    r = df.agg(F.min("u") >= 2, F.max("u") <= 3, F.count_distinct("k"), F.abs(F.avg("z")) < 0.1, F.abs(F.avg(F.col("b").cast("double")) - 0.5) < 0.05).first()
    assert tuple(r) == (True, True, 4, True, True)
    assert rng.secure_u64(spark.range(50)).select("random").distinct().count() == 50


def test_life(spark):
    cells = lambda df: sorted(map(tuple, df.collect()))
    blinker = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "i long, j long")
    once = life.step(blinker, 3, 3)
    assert cells(once) == [(0, 1), (1, 1), (2, 1)] and cells(life.step(once, 3, 3)) == [(1, 0), (1, 1), (1, 2)]
    block = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "i long, j long")
    assert cells(life.step(block, 4, 4)) == cells(block)

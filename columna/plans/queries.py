"""Queries that apply the engine's operators to the test tables, and the same in SQL.

Floating results are rounded, as sums depend on their order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import activations as A
from ..functions import calendar as C
from ..functions import distributions as D
from ..functions.calendar import DateFreq
from ..operators import calendar as cal
from ..operators import life, models, rng, stats
from ..operators.frame import Frame
from ..operators.matrix import POS, Matrix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _lines(spark: SparkSession, sf: str, *columns: str) -> Matrix:
    """Columns of lineitem as doubles, for operators that need no order."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    return Matrix(df, {c: F.col(c).cast("double") for c in columns}, keys=())


def _orders(spark: SparkSession, sf: str) -> Frame:
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return Frame.of(df, "o_orderkey", ["o_totalprice", "o_custkey"], validate=False)


def _events(spark: SparkSession, sf: str) -> Matrix:
    """Events by position, with NaN where event_id divides by 5."""
    df = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias(POS), F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return Matrix.over(df)


def _parts(spark: SparkSession, sf: str) -> Matrix:
    df = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias(POS), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return Matrix.over(df)


# -- element-wise and reductions -----------------------------------------------------------------------------
@query("SELECT round(sum(l_extendedprice * (1 - l_discount)) / count(*), 4) AS revenue, round(sum(l_extendedprice) / count(*), 4) AS price FROM lineitem")
def frame_mul_sum_vertical(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("row", F.struct("l_orderkey", "l_linenumber"))
    f = Frame.of(df, "row", ["l_extendedprice", "l_discount"], validate=False)
    labelled = lambda cells: Frame(f.source, cells, f.kind)
    price = labelled({"revenue": f.cells["l_extendedprice"], "price": f.cells["l_extendedprice"], "rows": F.lit(1.0)})
    kept = labelled({"revenue": 1.0 - f.cells["l_discount"], "price": F.lit(1.0), "rows": F.lit(1.0)})
    total = (price * kept).sum_vertical()
    return total.select(*[F.round(F.col(c) / F.col("rows"), 4).alias(c) for c in ("revenue", "price")])


@query("SELECT o_orderkey, round(o_totalprice + o_totalprice * 2, 4) AS o_totalprice, round(o_custkey + o_custkey * 2, 4)::DOUBLE AS o_custkey FROM orders")
def frame_add_same_source(spark: SparkSession, sf: str) -> DataFrame:
    f = _orders(spark, sf)
    return _rounded((f + f * 2.0).df.select(F.col("__idx").alias("o_orderkey"), "o_totalprice", "o_custkey"), 4)


@query("SELECT a.o_orderkey, round(a.o_totalprice - b.o_totalprice / 2, 4) AS o_totalprice, round(a.o_custkey / 2.0::DOUBLE, 4) AS o_custkey FROM orders a JOIN orders b USING (o_orderkey)")
def frame_sub_joined(spark: SparkSession, sf: str) -> DataFrame:
    f, g = _orders(spark, sf), _orders(spark, sf)
    return _rounded((f - g / 2.0).df.select(F.col("__idx").alias("o_orderkey"), "o_totalprice", "o_custkey"), 4)


@query("SELECT count(*) FILTER (isnan(r)) AS nans, count(*) FILTER (isinf(r)) AS infs, count(*) FILTER (r > 1 AND NOT isinf(r) AND NOT isnan(r)) AS large FROM (SELECT l_tax / l_discount AS r FROM lineitem)")
def elementwise_div_ieee(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_tax", "l_discount")
    r = Matrix(m.source, {"r": m.cells["l_tax"]}, ()) / Matrix(m.source, {"r": m.cells["l_discount"]}, ())
    inf = F.lit(float("inf"))
    return r.df.agg(F.count_if(F.isnan("r")).alias("nans"), F.count_if(F.abs("r") == inf).alias("infs"), F.count_if((F.col("r") > 1) & (F.abs("r") < inf)).alias("large"))


@query("SELECT l_linenumber // 2 AS half, count(*) AS n FROM lineitem GROUP BY 1")
def int_division(spark: SparkSession, sf: str) -> DataFrame:
    m = Matrix(spark.read.parquet(f"{sf}/lineitem.parquet"), {"half": F.col("l_linenumber")}, ())
    return (m / 2).df.groupBy("half").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (l_quantity > 25) AS gt, count(*) FILTER (l_quantity <= 10) AS le, count(*) FILTER (l_quantity = 7) AS eq, count(*) FILTER (l_quantity <> 7) AS ne, count(*) FILTER (l_quantity >= 25) AS ge, count(*) FILTER (l_quantity < 10) AS lt FROM lineitem")
def cmp_mask_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity")
    masks = {op: m.compare(op, v).cells["l_quantity"] for op, v in (("gt", 25.0), ("le", 10.0), ("eq", 7.0), ("ne", 7.0), ("ge", 25.0), ("lt", 10.0))}
    return Matrix(m.source, masks, ()).count_vertical()


@query("SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS one, count(*) FILTER (a <> b) AS differ, count(*) FILTER (NOT a) AS no FROM (SELECT l_quantity > 25 AS a, l_discount > 0.05 AS b FROM lineitem)")
def bool_ops(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity", "l_discount")
    a = Matrix(m.source, {"v": m.cells["l_quantity"]}, ()).compare("gt", 25.0)
    b = Matrix(m.source, {"v": m.cells["l_discount"]}, ()).compare("gt", 0.05)
    masks = {"both": a & b, "one": a | b, "differ": a ^ b, "no": ~a}
    return Matrix(m.source, {n: x.cells["v"] for n, x in masks.items()}, ()).count_vertical()


@query("SELECT bool_or(l_quantity > 49) AS a, bool_and(l_quantity > 0) AS b, bool_and(l_tax > 0.01) AS c, count(*) FILTER (l_tax > 0.01) AS d FROM lineitem")
def bool_reductions(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity", "l_tax")
    a, b, c = m.cells["l_quantity"] > 49, m.cells["l_quantity"] > 0, m.cells["l_tax"] > 0.01
    bools = lambda **k: Matrix(m.source, k, ())
    return bools(a=a).any_vertical().crossJoin(bools(b=b, c=c).all_vertical()).crossJoin(bools(d=c).count_vertical())


@query("SELECT p_partkey AS __pos, round(p_size + p_retailprice, 4) AS s, round(p_size * p_retailprice, 4) AS p FROM part")
def sum_prod_horizontal(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    both = Matrix(m.source, {"s": F.col("size") + F.col("price"), "p": F.col("size") * F.col("price")})
    assert both.cols == m.cols
    s, p = m.sum_horizontal().withColumnRenamed("value", "s"), m.prod_horizontal().withColumnRenamed("value", "p")
    return _rounded(s.join(p, POS), 4)


@query("SELECT p_partkey AS __pos, p_size > 25 OR p_retailprice > 1500 AS any_of, p_size > 25 AND p_retailprice > 1500 AS all_of, (p_size > 25)::BIGINT + (p_retailprice > 1500)::BIGINT AS n FROM part")
def bool_horizontal(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    b = Matrix(m.source, {"a": F.col("size") > 25, "b": F.col("price") > 1500})
    return b.source.select(POS, b.cells["a"].alias("a"), b.cells["b"].alias("b")).transform(lambda d: Matrix.over(d).any_horizontal().withColumnRenamed("value", "any_of")).join(b.all_horizontal().withColumnRenamed("value", "all_of"), POS).join(b.count_horizontal().withColumnRenamed("value", "n"), POS)


@query("SELECT event_id AS __pos, round(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END) OVER (ORDER BY event_id), 4) AS value FROM events")
def cumsum_vertical_events(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_events(spark, sf).cumsum_vertical().df, 4)


@query("SELECT p_partkey AS __pos, p_size::DOUBLE AS size, round(p_size + p_retailprice, 4) AS price FROM part")
def cumsum_horizontal_part(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_parts(spark, sf).cumsum_horizontal().df, 4)


@query("SELECT count(*) FILTER (event_id % 5 = 0) AS value FROM events")
def count_nan_vertical(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).count_nan_vertical()


@query("SELECT round(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END) / count(*), 6) AS value FROM events")
def mean_nan_full_divisor(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.mean_vertical(_events(spark, sf)))


@query("SELECT round(product(1 + l_tax / 100000), 6) AS v FROM lineitem")
def prod_vertical(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_tax")
    return _rounded(Matrix(m.source, {"v": 1.0 + m.cells["l_tax"] / 100000.0}, ()).prod_vertical())


@query("SELECT p_partkey AS __pos, round(sqrt(p_size), 6) AS size, round(ln(p_retailprice), 6) AS price FROM part")
def map_zip(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    return _rounded(m.zip(m.map(F.ln), lambda a, b: F.when(a < 60, F.sqrt(a)).otherwise(b)).df)


@query("SELECT round(max(l_quantity) - min(l_quantity), 6) AS l_quantity, round(max(l_tax) - min(l_tax), 6) AS l_tax FROM lineitem")
def apply_axis_range(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_lines(spark, sf, "l_quantity", "l_tax").apply_axis("col", lambda c: F.max(c) - F.min(c)))


# -- structure --------------------------------------------------------------------------------------------------
@query("SELECT __pos, custkey, price, extra FROM (SELECT o_orderkey AS __pos, o_custkey::DOUBLE AS custkey, CASE WHEN o_orderkey = 3 THEN 1.5 ELSE o_totalprice END AS price, o_totalprice * 0 + 1 AS extra FROM orders)")
def frame_edits(spark: SparkSession, sf: str) -> DataFrame:
    f = _orders(spark, sf).rename("o_totalprice", "price").rename("o_custkey", "custkey").add_column("extra", F.col("o_totalprice") * 0 + 1).sort_columns()
    return f.set_cell(3, "price", 1.5).df.drop("__idx")


@query("SELECT CASE WHEN p_partkey >= 4 THEN p_partkey ELSE p_partkey END AS __pos, p_retailprice AS price, p_size::DOUBLE AS size FROM part WHERE p_partkey > 5 UNION ALL SELECT CASE WHEN p_partkey < 3 THEN p_partkey ELSE p_partkey + 1 END, p_retailprice, p_size FROM part WHERE p_partkey < 5 UNION ALL SELECT 3, 9.5, 8.5")
def row_edits(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    return m.add_row(3, [8.5, 9.5]).delete_row(6).swap_columns(0, 1).df


@query("SELECT 0 AS i, p_partkey AS j, p_size::DOUBLE AS v FROM part UNION ALL SELECT 1, p_partkey, p_retailprice::DOUBLE FROM part")
def transpose_part(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).transpose_long()


@query("SELECT p_partkey AS __pos, round(p_size * 2 + p_retailprice * 3, 4) AS c0, round(p_size * -1 + p_retailprice * 0.5, 4) AS c1 FROM part")
def matmul_literal(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.build import from_cols

    return _rounded(_parts(spark, sf).matmul(from_cols(spark, [[2.0, 3.0], [-1.0, 0.5]])).df, 4)


@query("WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, event_id, value FROM events) SELECT i AS __idx, event_id::DOUBLE AS event_id, round(sum(value) OVER (ORDER BY i), 4) AS value, NULL::BIGINT AS j FROM e UNION ALL SELECT i, event_id::DOUBLE, round(value, 4), 0 FROM e")
def frame_default_index(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the order of time as a frame without index: running sums by its rows, and its transpose, a row a cell."""
    df = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_id", F.col("event_id").cast("double").alias("id"), "value")
    f = Frame.of(df.repartition(7, "event_id").orderBy("ts", "event_id"), columns=["id", "value"])
    sums = f.cumsum_vertical().df.select("__idx", "value").join(f.df.select("__idx", "id"), "__idx")
    sums = sums.select("__idx", F.col("id").alias("event_id"), F.round("value", 4).alias("value"), F.lit(None).cast("long").alias("j"))
    across = f.matrix.blocks().transpose().to_long().groupBy("j").agg(F.max(F.when(F.col("i") == 0, F.col("v"))).alias("event_id"), F.max(F.when(F.col("i") == 1, F.col("v"))).alias("value"))
    return sums.unionAll(across.select("j", "event_id", F.round("value", 4), F.lit(0).cast("long")))


@query("SELECT a.j AS i, b.j AS j, sum(a.x * b.x)::DOUBLE AS v FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS j, floor(unnest(embedding)::DOUBLE * 1024) AS x FROM embeddings) a JOIN (SELECT vec_id, unnest(range(0, len(embedding))) AS j, floor(unnest(embedding)::DOUBLE * 1024) AS x FROM embeddings) b USING (vec_id) GROUP BY a.j, b.j")
def matmul_gram_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The transpose of all embeddings times all embeddings, in blocks; components as whole numbers, whose sums are exact."""
    m = _vectors(spark, sf)
    x = m.map(lambda c: F.floor(c * 1024).cast("double")).blocks()
    return x.transpose().matmul(x).to_long()


@query("WITH r AS (SELECT p_partkey AS i, p_size::DOUBLE AS s, floor(p_retailprice)::DOUBLE AS p FROM part) SELECT 'sum' AS what, i, NULL::BIGINT AS j, s + p AS v FROM r UNION ALL SELECT 'product', 0, 0, sum(s * s) FROM r UNION ALL SELECT 'product', 0, 1, sum(s * p) FROM r UNION ALL SELECT 'product', 1, 0, sum(s * p) FROM r UNION ALL SELECT 'product', 1, 1, sum(p * p) FROM r")
def transpose_then_product_part(spark: SparkSession, sf: str) -> DataFrame:
    """All of part transposed (two rows, a column a part): the sum of each column, and its product with part."""
    m = _parts(spark, sf).map(F.floor).map(lambda c: c.cast("double"))
    t = m.blocks().transpose()
    sums = t.sum_vertical().select(F.lit("sum").alias("what"), F.col("j").alias("i"), F.lit(None).cast("long").alias("j"), F.col("value").alias("v"))
    return sums.unionAll(t.matmul(m).to_long().select(F.lit("product").alias("what"), "i", "j", "v"))


# -- statistics -----------------------------------------------------------------------------------------------
@query("SELECT round(var_pop(l_quantity), 6) AS pop_q, round(var_samp(l_quantity), 6) AS samp_q, round(stddev_pop(l_quantity), 6) AS sd_q FROM lineitem")
def variance_stddev_vertical(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity")
    one = lambda d, n: d.withColumnRenamed("l_quantity", n)
    return _rounded(one(stats.population_variance_vertical(m), "pop_q").crossJoin(one(stats.sample_variance_vertical(m), "samp_q")).crossJoin(one(stats.stddev_vertical(m), "sd_q")))


@query("SELECT median(l_quantity) AS l_quantity, median(l_extendedprice) AS l_extendedprice FROM lineitem")
def median_vertical(spark: SparkSession, sf: str) -> DataFrame:
    return stats.median_vertical(_lines(spark, sf, "l_quantity", "l_extendedprice"))


@query("WITH r AS (SELECT l_quantity q, row_number() OVER (ORDER BY l_quantity) i, l_extendedprice p, row_number() OVER (ORDER BY l_extendedprice) j, count(*) OVER () n FROM lineitem) SELECT max(q) FILTER (i = floor(0.9 * (n - 1) + 0.5) + 1) AS l_quantity, max(p) FILTER (j = floor(0.9 * (n - 1) + 0.5) + 1) AS l_extendedprice FROM r")
def percentile_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return stats.percentile_vertical(_lines(spark, sf, "l_quantity", "l_extendedprice"), 90.0)


@query("SELECT p_partkey AS __pos, round((p_size + p_retailprice) / 2, 4) AS mean, round(var_pop, 4) AS var, round((p_size + p_retailprice) / 2, 4) AS median FROM (SELECT *, power((p_size - p_retailprice) / 2, 2) AS var_pop FROM part)")
def horizontal_statistics(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    named = lambda d, n: d.withColumnRenamed("value", n)
    return _rounded(named(stats.mean_horizontal(m), "mean").join(named(stats.population_variance_horizontal(m), "var"), POS).join(named(stats.median_horizontal(m), "median"), POS), 4)


@query("SELECT i, j, round(v, 4) AS value FROM (SELECT 0 AS i, 0 AS j, covar_samp(l_quantity, l_quantity) AS v FROM lineitem UNION ALL SELECT 0, 1, covar_samp(l_quantity, l_tax * 100) FROM lineitem UNION ALL SELECT 1, 0, covar_samp(l_quantity, l_tax * 100) FROM lineitem UNION ALL SELECT 1, 1, covar_samp(l_tax * 100, l_tax * 100) FROM lineitem)")
def covariance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity", "l_tax")
    return _rounded(stats.covariance_matrix(Matrix(m.source, {"q": m.cells["l_quantity"], "t": m.cells["l_tax"] * 100}, ())), 4)


@query("SELECT round(covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)), 8) AS r, round(covar_pop(l_quantity, l_extendedprice) / 1000, 4) AS c FROM lineitem")
def pearson_covariance(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity", "l_extendedprice")
    x, y = (Matrix(m.source, {"v": m.cells[c]}, ()) for c in ("l_quantity", "l_extendedprice"))
    return spark.createDataFrame([(round(stats.pearson(x, y), 8), round(stats.covariance(x, y) / 1000, 4))], "r double, c double")


_ERF = "(CASE WHEN z < 0 THEN -1.0 ELSE 1.0 END) * (1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z))"


@query(f"SELECT p_partkey, round(0.5 * (1 + {_ERF}), 8) AS cdf, round(exp(-0.5 * power((p_size - 25) / 10.0, 2)) / (10 * sqrt(2 * pi())), 8) AS pdf, CASE WHEN p_size < 10 OR p_size > 40 THEN 0 ELSE round(1.0 / 30, 8) END::DOUBLE AS u, round(CASE WHEN p_size < 10 THEN 0 WHEN p_size <= 40 THEN (p_size - 10) / 30.0::DOUBLE ELSE 1 END, 8) AS ucdf FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS t FROM (SELECT *, (p_size - 25)::DOUBLE / (10 * sqrt(2)) AS z FROM part))")
def normal_uniform(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    df = spark.read.parquet(f"{sf}/part.parquet")
    return _rounded(df.select("p_partkey", D.normal_cdf(x, 25.0, 10.0).alias("cdf"), D.normal_pdf(x, 25.0, 10.0).alias("pdf"), D.uniform_pdf(x, 10.0, 40.0).alias("u"), D.uniform_cdf(x, 10.0, 40.0).alias("ucdf")), 8)


@query("SELECT p_partkey, round(1 - exp(-x) * (1 + x), 8) AS cdf, round(x * exp(-x / 1.0) , 8) AS pdf, round(gamma(x + 0.3), 4) AS g FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS x FROM part)")
def gamma_functions(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p_size") / F.lit(10.0)
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", x.alias("x"))
    return df.select("p_partkey", F.round(D.gamma_cdf(F.col("x"), 2.0, 1.0), 8).alias("cdf"), F.round(D.gamma_pdf(F.col("x"), 2.0, 1.0), 8).alias("pdf"), F.round(D.gamma(F.col("x") + 0.3), 4).alias("g"))


@query("""WITH d AS (SELECT p_partkey, p_size % 11 AS k, p_size % 20 AS q FROM part),
b AS (SELECT i, factorial(10)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial((10 - i)::INT)::DOUBLE) * power(0.3::DOUBLE, i) * power(0.7::DOUBLE, 10 - i) AS f FROM range(0, 11) t(i)),
p AS (SELECT i, power(4.0::DOUBLE, i) * exp(-4.0::DOUBLE) / factorial(i::INT)::DOUBLE AS f FROM range(0, 20) t(i))
SELECT p_partkey, round((SELECT f FROM b WHERE i = k), 8) AS b_pmf, round((SELECT sum(f) FROM b WHERE i <= k), 8) AS b_cdf, round((SELECT f FROM p WHERE i = q), 8) AS p_pmf, round((SELECT sum(f) FROM p WHERE i <= q), 8) AS p_cdf FROM d""")
def binomial_poisson(spark: SparkSession, sf: str) -> DataFrame:
    """At numbers that all parts give."""
    k, q = F.col("p_size") % 11, F.col("p_size") % 20
    df = spark.read.parquet(f"{sf}/part.parquet")
    return _rounded(df.select("p_partkey", D.binomial_pmf(10, k, 0.3).alias("b_pmf"), D.binomial_cdf(10, k, 0.3).alias("b_cdf"), D.poisson_pmf(4.0, q).alias("p_pmf"), D.poisson_cdf(4.0, q).alias("p_cdf")), 8)


@query("WITH a AS (SELECT avg(o_totalprice) m, var_samp(o_totalprice) v, count(*) n FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT avg(o_totalprice) m, var_samp(o_totalprice) v, count(*) n FROM orders WHERE o_orderstatus = 'O') SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, 0.5::DOUBLE AS p FROM a, b")
def t_test_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderstatus", F.col("o_totalprice").alias("v"))
    return _rounded(stats.t_test(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")))


@query("WITH c AS (SELECT l_returnflag a, l_linestatus b, count(*)::DOUBLE o FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(o) r FROM c GROUP BY 1), k AS (SELECT b, sum(o) k FROM c GROUP BY 1), t AS (SELECT sum(o) t FROM c), e AS (SELECT coalesce(o, 0) o, r * k / t AS e FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (a, b)) SELECT round(chi2, 6) AS chi2, round(exp(-chi2), 6) AS p FROM (SELECT sum((o - e) * (o - e) / e) AS chi2 FROM e)")
def chi2_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.chi2_test(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_returnflag", "l_linestatus").select("chi2", F.round("p", 6).alias("p")))


@query("WITH g AS (SELECT o_orderpriority, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v FROM orders GROUP BY 1), a AS (SELECT avg(m) g FROM g) SELECT round(f, 6) AS f, round(exp(-f) * (1 + f), 6) AS p FROM (SELECT (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(v * n) / (sum(n) - count(*))) AS f FROM g, a)")
def anova_priority(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.anova(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderpriority", "o_totalprice").select("f", F.round("p", 6).alias("p")))


# -- models ---------------------------------------------------------------------------------------------------
@query("SELECT p_partkey, round(1 / (1 + exp(-x)), 8) AS sigmoid, greatest(x, 0) AS relu, CASE WHEN x > 0 THEN x ELSE 0.01 * x END AS leaky, round(tanh(x), 8) AS tanh FROM (SELECT p_partkey, (p_size - 25) / 10.0::DOUBLE AS x FROM part)")
def activations(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", ((F.col("p_size") - 25) / F.lit(10.0)).alias("x"))
    return df.select("p_partkey", F.round(A.sigmoid(x), 8).alias("sigmoid"), A.relu(x).alias("relu"), A.leaky_relu(x).alias("leaky"), F.round(A.tanh(x), 8).alias("tanh"))


@query("SELECT * FROM (SELECT round(covar_samp(q, q), 4) AS c00, round(covar_samp(q, d), 4) AS c01, round(covar_samp(q, t), 4) AS c02 FROM (SELECT l_quantity q, l_discount * 100 d, l_tax * 100 t FROM lineitem))")
def pca_components(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity", "l_discount", "l_tax")
    x = Matrix(m.source, {"q": m.cells["l_quantity"], "d": m.cells["l_discount"] * 100, "t": m.cells["l_tax"] * 100}, ())
    return spark.createDataFrame([tuple(round(float(v), 4) for v in models.PCA.fit(x, 1).components[0])], "c00 double, c01 double, c02 double")


@query("WITH RECURSIVE s AS (SELECT count(*) m, sum(x) sx, sum(x * x) sxx, sum(x * y) sxy, sum(y) sy FROM (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem)), g AS (SELECT 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, w - 0.1::DOUBLE * 2 / m * (sxx * w + b * sx - sxy), b - 0.1::DOUBLE * 2 / m * (sx * w + b * m - sy) FROM g, s WHERE i < 50) SELECT round(w, 6) AS w, round(b, 6) AS b FROM g WHERE i = 50")
def linreg_gd(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity", "l_extendedprice")
    model = models.LinReg(1).fit(Matrix(m.source, {"x": m.cells["l_quantity"] / 50}, ()), m.cells["l_extendedprice"] / 100000, 0.1, 50)
    return spark.createDataFrame([(round(float(model.w[0]), 6), round(float(model.b), 6))], "w double, b double")


def _vectors(spark: SparkSession, sf: str) -> Matrix:
    """All components of all vectors, with their labels."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    dims = df.agg(F.max(F.size("embedding"))).first()[0]
    df = df.select(F.col("vec_id").alias(POS), "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])
    return Matrix(df, {f"e{i}": F.col(f"e{i}") for i in range(dims)})


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS j FROM embeddings),
s AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT var_pop(x) AS v FROM v GROUP BY j)),
p AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings)::DOUBLE AS p FROM embeddings GROUP BY label),
c AS (SELECT label, j, avg(x) AS m, var_pop(x) + eps AS v FROM v, s GROUP BY label, j, eps),
l AS (SELECT v.vec_id, c.label, ln(p) - 0.5 * sum(ln(2 * pi() * c.v) + (x - m) * (x - m) / c.v) AS s FROM v JOIN c USING (j) JOIN p ON p.label = c.label GROUP BY v.vec_id, c.label, p)
SELECT vec_id AS __pos, arg_max(label, s)::DOUBLE AS label FROM l GROUP BY vec_id""")
def gaussian_nb(spark: SparkSession, sf: str) -> DataFrame:
    x = _vectors(spark, sf)
    return models.GaussianNB().fit(x, F.col("label").cast("double")).predict(x)


# -- calendar --------------------------------------------------------------------------------------------------
_STARTS = {"MS": ("month", "s"), "ME": ("month", "e"), "QS": ("quarter", "s"), "QE": ("quarter", "e"), "YS": ("year", "s"), "YE": ("year", "e")}


FIRST_DAY, LAST_DAY = ("(SELECT min(o_orderdate)::DATE FROM orders)", "(SELECT max(o_orderdate)::DATE FROM orders)")


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """(date, n): how many orders each day has."""
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n"))


def _span(spark: SparkSession, sf: str) -> tuple[dt.date, dt.date]:
    """The first and the last day of the orders."""
    return tuple(_days(spark, sf).agg(F.min("date"), F.max("date")).first())


def _dates_sql() -> str:
    days = f"SELECT unnest(generate_series({FIRST_DAY}, {LAST_DAY}, INTERVAL 1 DAY))::DATE AS d"
    parts = ["SELECT 'D' AS freq, d FROM days", "SELECT 'W', d FROM days WHERE isodow(d) = 1", "SELECT 'WF', d FROM days WHERE isodow(d) = 5"]
    for code, (unit, side) in _STARTS.items():
        short = DateFreq.parse(code).code
        test = f"d = date_trunc('{unit}', d)" if side == "s" else f"d = (date_trunc('{unit}', d + 1))::DATE - 1"
        parts.append(f"SELECT '{short}', d FROM days WHERE {test}")
    return f"WITH days AS ({days}), a AS ({' UNION ALL '.join(parts)}) "


def _lists(spark: SparkSession, sf: str, kind: type[cal.DatesList]) -> DataFrame:
    """All frequencies' dates over the span of the orders, with the orders of each date."""
    first, last = _span(spark, sf)
    out = None
    for f in DateFreq:
        one = kind(first, last, f).list(spark).select(F.lit(f.code).alias("freq"), "date")
        out = one if out is None else out.unionAll(one)
    return out.join(_days(spark, sf), "date", "left").select("freq", "date", F.coalesce("n", F.lit(0)).alias("orders"))


_COUNTED = ", c AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1), l AS ({}) SELECT freq, date, coalesce(n, 0)::BIGINT AS orders FROM l LEFT JOIN c ON c.d = date"


@query(_dates_sql().rstrip() + _COUNTED.format("SELECT freq, d AS date FROM a"))
def dates_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf, cal.DatesList)


@query(_dates_sql().rstrip() + _COUNTED.format("SELECT freq, CASE WHEN freq LIKE 'W%' OR isodow(d) < 6 THEN d WHEN freq LIKE '%E' THEN d - (isodow(d) - 5)::INT ELSE d + (8 - isodow(d))::INT END AS date FROM a WHERE freq <> 'D' OR isodow(d) < 6"))
def bdates_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf, cal.BDatesList)


@query(_dates_sql() + "SELECT isoyear(d)::INT AS year, week(d)::INT AS part, count(*) AS n, min(d) AS first FROM a WHERE freq = 'W' GROUP BY 1, 2")
def date_groups(spark: SparkSession, sf: str) -> DataFrame:
    return cal.DatesList(*_span(spark, sf), DateFreq.WEEKLY_MONDAY).groups(spark).select("year", "part", F.size("dates").cast("long").alias("n"), F.element_at("dates", 1).alias("first"))


@query("SELECT o_orderkey, d AS date, isodow(d) < 6 AS business, CASE isodow(d) WHEN 6 THEN d + 2 WHEN 7 THEN d + 1 ELSE d END AS forward, CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d - 2 ELSE d END AS back, quarter(d)::INT AS quarter FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def business_days_orders(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("date")
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return df.select("o_orderkey", "date", C.is_business_day(d).alias("business"), C.roll_forward(d).alias("forward"), C.roll_back(d).alias("back"), C.month_to_quarter(F.month(d)).alias("quarter"))


@query(f"WITH o AS (SELECT {FIRST_DAY} AS a), m AS (SELECT a, ((date_trunc('month', a) + to_months(k::INT + 1))::DATE - 1) AS d FROM o, range(0, 40) t(k)), b AS (SELECT a, CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d - 2 ELSE d END AS d FROM m) SELECT d AS date FROM b WHERE d >= a ORDER BY d LIMIT 24")
def bdates_generator(spark: SparkSession, sf: str) -> DataFrame:
    """The last business days of 24 months from the first order on."""
    return cal.generate(spark, _span(spark, sf)[0], DateFreq.MONTH_END, 24, business=True)


# -- random and integration ----------------------------------------------------------------------------------
_MASK = "18446744073709551615::UHUGEINT"


def xorshift_sql(x: str) -> str:
    """The next state of an UHUGEINT below 2 ** 64."""
    a = f"xor({x}, ({x} << 13) & {_MASK})"
    b = f"xor({a}, {a} >> 7)"
    return f"xor({b}, ({b} << 17) & {_MASK})"


@query(f"WITH RECURSIVE n AS (SELECT count(*)::UHUGEINT AS n FROM part), s(i, x) AS (SELECT 0, {xorshift_sql('n')} FROM n UNION ALL SELECT i + 1, {xorshift_sql('x')} FROM s WHERE i + 1 < (SELECT n FROM n)) SELECT i::BIGINT AS i, (CASE WHEN x >= 9223372036854775808::UHUGEINT THEN x::HUGEINT - 18446744073709551616::HUGEINT ELSE x::HUGEINT END)::BIGINT AS state FROM s")
def xorshift_states(spark: SparkSession, sf: str) -> DataFrame:
    """As many states as there are parts, from their number as seed, in blocks that are jumped to."""
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    return rng.xorshift(spark, n, n, block=700)


@query("WITH d AS (SELECT count(*) // 40 AS rows FROM part), b AS (SELECT p_partkey // 40 AS i, p_partkey % 40 AS j FROM part WHERE p_size % 3 = 0), n AS (SELECT i + a AS i, j + c AS j, a = 0 AND c = 0 AS me FROM b, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS c)), s AS (SELECT i, j, count(*) FILTER (NOT me) AS n, bool_or(me) AS me FROM n GROUP BY 1, 2) SELECT i::BIGINT AS i, j::BIGINT AS j FROM s, d WHERE (n = 3 OR (me AND n = 2)) AND i BETWEEN 0 AND rows - 1 AND j BETWEEN 0 AND 39")
def game_of_life_step(spark: SparkSession, sf: str) -> DataFrame:
    """On a board with a cell for each part, alive where its size divides by 3."""
    df = spark.read.parquet(f"{sf}/part.parquet")
    board = df.where("p_size % 3 = 0").select(F.floor(F.col("p_partkey") / 40).alias("i"), (F.col("p_partkey") % 40).alias("j"))
    return life.step(board, df.count() // 40, 40)

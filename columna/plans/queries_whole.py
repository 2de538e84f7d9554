"""More queries over whole tables, with their SQL: access, edits, whole-table reductions, models, calendars, random numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import activations as A
from ..functions import calendar as C
from ..functions.calendar import DateFreq
from ..operators import calendar as cal
from ..operators import models, rng, stats
from ..operators.frame import Frame
from ..operators.matrix import POS, Matrix
from ..sources import build
from .queries import FIRST_DAY, LAST_DAY, _events, _lines, _orders, _parts, _rounded, _span, _vectors, query, xorshift_sql


def _bools(spark: SparkSession, sf: str) -> tuple[Frame, Frame]:
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("P"), (F.col("o_custkey") % 2 == 0).alias("Q"), (F.col("o_custkey") % 3 == 0).alias("R"))
    f = Frame.of(df, "o_orderkey", ["P", "Q"], validate=False)
    return f, f._new({"P": F.col("Q"), "Q": F.col("R")})


def _named(spark: SparkSession, kind: str, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind}" for k in values))


# -- construction and access ---------------------------------------------------------------------------------
@query("""WITH n AS (SELECT n_nationkey::BIGINT AS i, n_nationkey::DOUBLE AS a, n_regionkey::DOUBLE AS b FROM nation), p AS (SELECT p_partkey AS i FROM part), f AS (SELECT p_size::DOUBLE AS s, p_retailprice AS r FROM part WHERE p_partkey = 0), s AS (SELECT row_number() OVER () - 1 AS i FROM supplier)
SELECT name, i::BIGINT AS i, j::INT AS j, v::DOUBLE AS v FROM (
SELECT 'cols' AS name, i, 0 AS j, a AS v FROM n UNION ALL SELECT 'cols', i, 1, b FROM n UNION ALL SELECT 'rows', i, 0, a FROM n UNION ALL SELECT 'rows', i, 1, b FROM n
UNION ALL SELECT 'nine', i, 0, 9 FROM p UNION ALL SELECT 'nine', i, 1, 9 FROM p UNION ALL SELECT 'zero', i, 0, 0 FROM p UNION ALL SELECT 'one', i, 0, 1 FROM p UNION ALL SELECT 'nan', i, 0, 'nan'::DOUBLE FROM p
UNION ALL SELECT 'again', i, 0, s FROM f, s UNION ALL SELECT 'again', i, 1, r FROM f, s UNION ALL SELECT 'wide', i, 0, s FROM f, s UNION ALL SELECT 'wide', i, 1, r FROM f, s)""")
def matrix_constructors(spark: SparkSession, sf: str) -> DataFrame:
    """From values of nation, constants for each part, and the first part as often as there are suppliers."""
    nation = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").select(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")).collect()
    n, suppliers = spark.read.parquet(f"{sf}/part.parquet").count(), spark.read.parquet(f"{sf}/supplier.parquet").count()
    m = _parts(spark, sf)
    first = Matrix(m.source.where(F.col(POS) == 0), m.cells)
    made = {
        "cols": build.from_vec(spark, [r[c] for c in (0, 1) for r in nation], len(nation), 2), "rows": build.from_rows_vec(spark, [v for r in nation for v in r], len(nation), 2),
        "nine": build.filled(spark, n, 2, 9.0), "zero": build.zeros(spark, n, 1), "one": build.ones(spark, n, 1), "nan": build.nans(spark, n, 1), "again": m.repeat_rows(suppliers), "wide": first.broadcast_row(suppliers, 2),
    }
    out = None
    for name, x in made.items():
        one = x.to_long().select(F.lit(name).alias("name"), "i", "j", "v")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT count(*) AS n_rows, 2::BIGINT AS n_cols, count(*) = 0 AS empty, true AS same, false AS differs FROM orders")
def frame_shape_equality(spark: SparkSession, sf: str) -> DataFrame:
    f = _orders(spark, sf)
    rows, cols = f.shape()
    other = _orders(spark, sf)
    same, differs = f.equals(other), f.equals(other.set_cell(3, "o_totalprice", -1.0))
    return spark.createDataFrame([(rows, cols, f.is_empty(), same, differs)], "n_rows long, n_cols long, empty boolean, same boolean, differs boolean")


@query("SELECT (SELECT p_retailprice FROM part WHERE p_partkey = 7) AS cell, (SELECT p_size FROM part WHERE p_partkey = 9)::DOUBLE AS row_first, (SELECT o_totalprice FROM orders WHERE o_orderkey = 5) AS by_key, (SELECT min(p_size) FROM part)::DOUBLE AS nothing, 1.0::DOUBLE AS position")
def cell_and_row_access(spark: SparkSession, sf: str) -> DataFrame:
    m, f = _parts(spark, sf), _orders(spark, sf)
    low = m.set(7, 1, -1.0).column(0).agg(F.min("size")).first()[0]
    return _named(spark, "double", cell=m.get(7, 1), row_first=m.row(9)[0], by_key=f.get_row(5)["o_totalprice"], nothing=low, position=float(f.column_index("o_custkey")))


@query("SELECT o_orderdate::DATE AS day, o_totalprice AS price FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def row_by_date(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.max(F.struct("o_orderkey", "o_totalprice")).alias("last"))
    frame = Frame.of(df.select("day", F.col("last.o_totalprice").alias("price"), F.col("last.o_orderkey").alias("key")), "day", ["price", "key"], kind="date")
    day = df.orderBy(F.desc("last.o_orderkey")).first()["day"]
    return spark.createDataFrame([(day, frame.get_row_date(day)["price"])], "day date, price double")


@query("SELECT o_orderkey AS __pos, o_totalprice, o_custkey::DOUBLE AS kept FROM orders")
def frame_columns(spark: SparkSession, sf: str) -> DataFrame:
    f = _orders(spark, sf)
    left, gone = f.rename("o_custkey", "kept").delete_column("o_totalprice")
    return gone.drop("__idx").join(left.matrix.df, POS).join(f.index().drop("__idx"), POS)


@query("SELECT p_partkey AS __pos, CASE WHEN p_partkey = 2 THEN 8.5 ELSE p_size END::DOUBLE AS size, CASE WHEN p_partkey = 2 THEN 9.5 ELSE p_size * 2 END::DOUBLE AS twice FROM part")
def column_edits(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    return m.add_column(1, m.cells["size"] * 2.0, "twice").delete_column(2).set_row(2, [8.5, 9.5]).df


@query("SELECT n_nationkey::BIGINT AS __pos, n_nationkey::DOUBLE AS a, n_regionkey::DOUBLE AS b FROM nation")
def literal_column(spark: SparkSession, sf: str) -> DataFrame:
    """A column of values in memory, those of nation, beside another."""
    nation = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").collect()
    return build.from_cols(spark, [[float(r["n_nationkey"]) for r in nation]], ["a"]).add_column(1, [float(r["n_regionkey"]) for r in nation], "b").df


@query("SELECT p_partkey AS __pos, 0 AS j, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part")
def iter_columns_part(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for j, c in enumerate(_parts(spark, sf).iter_columns()):
        one = c.select(POS, F.lit(j).alias("j"), F.col(c.columns[1]).alias("v"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT p_partkey AS i, p_size::DOUBLE AS size, p_retailprice AS price FROM part")
def iter_rows_part(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as they come one after another, in order, made a table again."""
    rows = _parts(spark, sf).iter_rows()
    return spark.createDataFrame([(i, r["size"], r["price"]) for i, r in enumerate(rows)], "i long, size double, price double")


@query("SELECT 'Frame(' || count(*) || ' x 2, columns=[''o_totalprice'', ''o_custkey''], index=int ' || min(o_orderkey) || '..' || max(o_orderkey) || ')' AS shown, 'Matrix(' || (SELECT count(*) FROM part) || ' x 2, columns=[''size'', ''price''], keys=[''__pos''])' AS matrix FROM orders")
def printed(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(repr(_orders(spark, sf)), repr(_parts(spark, sf)))], "shown string, matrix string")


# -- element-wise -----------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, p AND q AS p_and, p OR q AS p_or, p <> q AS p_xor, NOT p AS p_not, q AND r AS q_and, q OR r AS q_or, q <> r AS q_xor, NOT q AS q_not FROM (SELECT o_orderkey, o_totalprice > 150000 AS p, o_custkey % 2 = 0 AS q, o_custkey % 3 = 0 AS r FROM orders)")
def frame_bool_ops(spark: SparkSession, sf: str) -> DataFrame:
    f, g = _bools(spark, sf)
    made = {"and": f & g, "or": f | g, "xor": f ^ g, "not": ~f}
    return f.source.select("o_orderkey", *[x.cells[c].alias(f"{c.lower()}_{n}") for n, x in made.items() for c in ("P", "Q")])


@query("SELECT o_orderkey, round(o_totalprice / 2, 4) AS half, round(o_totalprice + o_custkey, 4) AS zipped FROM orders")
def frame_map_zip(spark: SparkSession, sf: str) -> DataFrame:
    f = _orders(spark, sf)
    half = f.frame_map(lambda c: c / 2.0)
    other = f._new({"x": f.cells["o_custkey"], "y": f.cells["o_totalprice"]})
    both = f.frame_zip(other, lambda a, b: a + b)
    return _rounded(f.source.select("o_orderkey", half.cells["o_totalprice"].alias("half"), both.cells["o_totalprice"].alias("zipped")), 4)


@query("SELECT event_id AS __pos, event_id % 5 = 0 AS is_nan, (event_id % 5 = 0)::BIGINT AS n FROM events")
def nan_horizontal(spark: SparkSession, sf: str) -> DataFrame:
    m = _events(spark, sf)
    return m.is_nan().df.withColumnRenamed("value", "is_nan").join(m.count_nan_horizontal().withColumnRenamed("value", "n"), POS)


@query("SELECT round(sum(l_extendedprice) / 1000, 3) AS price, round(sum(l_discount) / 1000, 3) AS discount FROM lineitem")
def sum_vertical(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_extendedprice", "l_discount")
    got = m.sum_vertical()
    return got.select(F.round(F.col("l_extendedprice") / 1000, 3).alias("price"), F.round(F.col("l_discount") / 1000, 3).alias("discount"))


@query("SELECT round(sum(o_totalprice * o_custkey + o_totalprice) / count(*) / 1000, 3) AS o_totalprice, round(sum(o_custkey::DOUBLE * o_custkey + o_custkey) / count(*) / 1000, 3) AS o_custkey FROM orders")
def frame_forwarding(spark: SparkSession, sf: str) -> DataFrame:
    f = _orders(spark, sf)
    total = (f.frame_zip(f._new({c: f.cells["o_custkey"] for c in f.columns}), lambda a, b: a * b) + f).sum_vertical()
    n = f.rows()
    return total.select(*[F.round(F.col(c) / n / 1000, 3).alias(c) for c in total.columns])


@query("SELECT p_partkey AS __pos, greatest(p_size, p_retailprice)::DOUBLE AS most, (p_size > 25) <> (p_retailprice > 1500) AS odd FROM part")
def apply_axis_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    b = Matrix(m.source, {"a": F.col("size") > 25, "b": F.col("price") > 1500})
    most = m.apply_axis("row", F.array_max).withColumnRenamed("value", "most")
    return most.join(b.apply_axis("row", lambda x: x[0] != x[1]).withColumnRenamed("value", "odd"), POS)


@query("WITH b AS (SELECT unnest([l_quantity > 49, l_tax > 0.01]) AS v FROM lineitem) SELECT bool_or(v) AS some, bool_and(v) AS every, count(*) FILTER (v) AS n FROM b")
def bool_whole(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity", "l_tax")
    b = Matrix(m.source, {"a": m.cells["l_quantity"] > 49, "b": m.cells["l_tax"] > 0.01}, ())
    return spark.createDataFrame([(b.any(), b.all(), b.count())], "some boolean, every boolean, n long")


# -- statistics -----------------------------------------------------------------------------------------------
@query("WITH v AS (SELECT unnest([l_quantity::DOUBLE, l_tax * 100]) AS v FROM lineitem), r AS (SELECT v, row_number() OVER (ORDER BY v) i, count(*) OVER () n FROM v) SELECT round(avg(v), 6) AS mean, round(var_pop(v), 4) AS pop, round(var_samp(v), 4) AS samp, round(stddev_pop(v), 6) AS sd, round(median(v), 6) AS med, round(max(v) FILTER (i = floor(0.25 * (n - 1) + 0.5) + 1), 6) AS p25 FROM r")
def statistics_whole(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity", "l_tax")
    x = Matrix(m.source, {"q": m.cells["l_quantity"], "t": m.cells["l_tax"] * 100}, ())
    got = _named(spark, "double", mean=stats.mean(x), pop=stats.population_variance(x), samp=stats.sample_variance(x), sd=stats.stddev(x), med=stats.median(x), p25=stats.percentile(x, 25.0))
    return got.select(*[F.round(c, 4 if c in ("pop", "samp") else 6).alias(c) for c in got.columns])


@query("SELECT p_partkey AS __pos, round(power((p_size - p_retailprice) / 2, 2) * 2, 4) AS var, round(abs(p_size - p_retailprice) / 2, 4) AS sd, greatest(p_size, p_retailprice)::DOUBLE AS p FROM part")
def horizontal_spread(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    named = lambda d, n: d.withColumnRenamed("value", n)
    return _rounded(named(stats.sample_variance_horizontal(m), "var").join(named(stats.stddev_horizontal(m), "sd"), POS).join(named(stats.percentile_horizontal(m, 80.0), "p"), POS), 4)


_PAIRS = "SELECT {i} AS i, {j} AS j, round({f}({a}, {b}), 4) AS value FROM v"


@query("WITH v AS (SELECT l_quantity::DOUBLE q, l_tax * 100 t FROM lineitem) " + " UNION ALL ".join(_PAIRS.format(i=i, j=j, f="covar_pop", a="qt"[i], b="qt"[j]) for i in (0, 1) for j in (0, 1)))
def covariance_vertical(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf, "l_quantity", "l_tax")
    return _rounded(stats.covariance_vertical(Matrix(m.source, {"q": m.cells["l_quantity"], "t": m.cells["l_tax"] * 100}, ())), 4)


@query("WITH r AS (SELECT n_nationkey::BIGINT AS i, n_nationkey::DOUBLE AS a, n_regionkey::DOUBLE AS b FROM nation), c AS (SELECT i, a - (a + b) / 2 AS a, b - (a + b) / 2 AS b FROM r) SELECT x.i, y.i AS j, round((x.a * y.a + x.b * y.b) / 2, 6) AS value FROM c x, c y")
def covariance_horizontal(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias(POS), F.col("n_nationkey").cast("double").alias("a"), F.col("n_regionkey").cast("double").alias("b"))
    return _rounded(stats.covariance_horizontal(Matrix.over(df), block=10))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT vec_id, list_transform(x, lambda e: e - list_avg(x)) AS x FROM v) SELECT a.vec_id AS i, b.vec_id AS j, CASE WHEN abs(list_dot_product(a.x, b.x) / len(a.x)) < 5e-7 THEN 0 ELSE round(list_dot_product(a.x, b.x) / len(a.x), 6) END AS value FROM c a, c b")
def covariance_horizontal_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Between all pairs of embeddings."""
    return stats.covariance_horizontal(_vectors(spark, sf), digits=6)


@query("WITH v AS (SELECT vec_id, unnest(list_transform(embedding::DOUBLE[], lambda e: e - list_avg(embedding::DOUBLE[]))) AS x, unnest(range(0, len(embedding)))::INT AS j FROM embeddings) SELECT a.j AS i, b.j AS j, round(sum(a.x * b.x) / (count(*) - 1), 8) AS value FROM v a JOIN v b USING (vec_id) GROUP BY a.j, b.j")
def covariance_matrix_row_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """All 64 components, each row less its own mean."""
    return _rounded(stats.covariance_matrix(_vectors(spark, sf), "row"), 8)


@query("WITH c AS (SELECT p_size - (p_size + p_retailprice) / 2 AS a, p_retailprice - (p_size + p_retailprice) / 2 AS b FROM part) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum({'ab'[i]} * {'ab'[j]}) / (count(*) - 1), 4) AS value FROM c" for i in (0, 1) for j in (0, 1)))
def covariance_matrix_row(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.covariance_matrix(_parts(spark, sf), "row"), 4)


@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INT AS j FROM embeddings) SELECT a.j AS i, b.j AS j, round(covar_samp(a.x, b.x), 8) AS value FROM v a JOIN v b USING (vec_id) GROUP BY a.j, b.j")
def covariance_of_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.covariance_matrix(_vectors(spark, sf)), 8)


# -- activations and models -------------------------------------------------------------------------------------
@query("SELECT p_partkey, round(x * (1 - x), 8) AS dsigmoid, CASE WHEN x > 0 THEN 1 ELSE 0 END::DOUBLE AS drelu, CASE WHEN x > 0 THEN 1 ELSE 0.01 END::DOUBLE AS dleaky, round(1 - tanh(x) * tanh(x), 8) AS dtanh FROM (SELECT p_partkey, (p_size - 25) / 10.0::DOUBLE AS x FROM part)")
def activation_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", ((F.col("p_size") - 25) / F.lit(10.0)).alias("x"))
    return df.select("p_partkey", F.round(A.dsigmoid(x), 8).alias("dsigmoid"), A.drelu(x).alias("drelu"), A.dleaky_relu(x).alias("dleaky"), F.round(A.dtanh(x), 8).alias("dtanh"))


@query("WITH RECURSIVE d AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS x, p_retailprice / 1000 AS y FROM part), s AS (SELECT count(*) m, sum(x) sx, sum(x * x) sxx, sum(x * y) sxy, sum(y) sy FROM d), g AS (SELECT 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, w - 0.1::DOUBLE * 2 / m * (sxx * w + b * sx - sxy), b - 0.1::DOUBLE * 2 / m * (sx * w + b * m - sy) FROM g, s WHERE i < 40) SELECT p_partkey AS __pos, round(x * w + b, 6) AS value FROM d, g WHERE i = 40")
def linreg_predict(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    x = Matrix(m.source, {"x": m.cells["size"] / 50})
    return _rounded(models.LinReg(1).fit(x, m.cells["price"] / 1000, 0.1, 40).predict(x))


@query("WITH s AS (SELECT covar_samp(p_size, p_size) a, covar_samp(p_size, p_retailprice / 100) b, covar_samp(p_retailprice / 100, p_retailprice / 100) c, avg(p_size) ms, avg(p_retailprice / 100) mp FROM part) SELECT p_partkey AS __pos, round((p_size - ms) * a + (p_retailprice / 100 - mp) * b, 4) AS pc0, round((p_size - ms) * b + (p_retailprice / 100 - mp) * c, 4) AS pc1, 0.0::DOUBLE AS pc2 FROM part, s")
def pca_transform(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    x = Matrix(m.source, {"s": m.cells["size"], "p": m.cells["price"] / 100})
    return _rounded(models.PCA.fit(x, 3).transform(x).df, 4)


_VECTORS = "d AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x, (label < 5)::DOUBLE AS y FROM embeddings), m AS MATERIALIZED (SELECT count(*) AS m FROM d)"


def _logreg_sql(epochs: int, rate: float) -> str:
    steps = [_VECTORS, "w0 AS MATERIALIZED (SELECT list_transform(x, lambda v: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b FROM d LIMIT 1)"]
    for k in range(epochs):
        steps.append(f"e{k} AS MATERIALIZED (SELECT x, 1 / (1 + exp(-(list_dot_product(x, w) + b))) - y AS e FROM d, w{k})")
        steps.append(f"g{k} AS MATERIALIZED (SELECT list(g ORDER BY j) AS g FROM (SELECT j, sum(g) AS g FROM (SELECT unnest(range(1, len(x) + 1)) AS j, unnest(list_transform(x, lambda v: v * e)) AS g FROM e{k}) GROUP BY j))")
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT list_transform(list_zip(w, g), lambda p: p[1] - {rate}::DOUBLE * p[2] / m) AS w, b - {rate}::DOUBLE * (SELECT sum(e) FROM e{k}) / m AS b FROM w{k}, g{k}, m)")
    return f"WITH {', '.join(steps)} SELECT vec_id AS __pos, round(1 / (1 + exp(-(list_dot_product(x, w) + b))), 6) AS p, (list_dot_product(x, w) + b >= 0)::DOUBLE AS label FROM d, w{epochs}"


@query(_logreg_sql(6, 0.5))
def logreg_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    x = _vectors(spark, sf)
    model = models.LogReg(x.cols).fit(x, (F.col("label") < 5).cast("double"), 0.5, 6)
    p = model.predict_proba(x).select(POS, F.round("value", 6).alias("p"))
    return p.join(model.predict(x).withColumnRenamed("value", "label"), POS)


def _kmeans_sql(k: int, moves: int) -> str:
    """Centroids start at the vectors 0 to k - 1; labels are those of the last move."""
    steps = [_VECTORS, f"c0 AS MATERIALIZED (SELECT vec_id AS c, x AS z FROM d WHERE vec_id < {k})"]
    for i in range(moves):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, x, (SELECT arg_min(c, list_distance(x, z)) FROM c{i}) AS c FROM d)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, list(v ORDER BY j) AS z FROM (SELECT c, j, avg(v) AS v FROM (SELECT c, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM a{i}) GROUP BY c, j) GROUP BY c)")
    return f"WITH {', '.join(steps)} SELECT vec_id AS __pos, a{moves - 1}.c::BIGINT AS label, (SELECT arg_min(c, list_distance(x, z)) FROM c{moves})::BIGINT AS next FROM a{moves - 1}"


@query(_kmeans_sql(4, 3))
def kmeans_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    x = _vectors(spark, sf)
    init = np.array([[r[c] for c in x.columns] for r in x.df.where(F.col(POS) < 4).orderBy(POS).collect()])
    model, labels = models.KMeans.fit(x, 4, max_iter=3, tol=0.0, init=init)
    return labels.join(model.predict(x).withColumnRenamed("label", "next"), POS)


def _network_sql(epochs: int, rate: float, loss: str = "bce", init: str = "xavier") -> str:
    """One input, one tanh unit, one sigmoid output, as the operator starts and steps."""
    net = models.DenseNN([1, 1, 1], ["tanh", "sigmoid"], init=init, loss=loss, seed=1)
    error = "(o - y) / m" if loss == "bce" else "2 * (o - y) / m * o * (1 - o)"
    w, v = float(net.weights[0][0, 0]), float(net.weights[1][0, 0])
    steps = ["d AS MATERIALIZED (SELECT p_partkey, (p_size - 25) / 25.0::DOUBLE AS x, (p_retailprice > 1200)::DOUBLE AS y FROM part), m AS MATERIALIZED (SELECT count(*) AS m FROM d)", f"w0 AS MATERIALIZED (SELECT {w!r}::DOUBLE AS w, 0.0::DOUBLE AS a, {v!r}::DOUBLE AS v, 0.0::DOUBLE AS b)"]
    for k in range(epochs):
        steps.append(f"o{k} AS MATERIALIZED (SELECT x, h, {error} AS e FROM (SELECT *, 1 / (1 + exp(-(h * v + b))) AS o FROM (SELECT *, tanh(x * w + a) AS h FROM d, w{k}, m)))")
        steps.append(f"u{k} AS MATERIALIZED (SELECT v - {rate}::DOUBLE * (SELECT sum(h * e) FROM o{k}) / m AS v, b - {rate}::DOUBLE * (SELECT sum(e) FROM o{k}) / m AS b FROM w{k}, m)")
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT w - {rate}::DOUBLE * (SELECT sum(x * e * u.v * (1 - h * h)) FROM o{k}, u{k} u) / m AS w, a - {rate}::DOUBLE * (SELECT sum(e * u.v * (1 - h * h)) FROM o{k}, u{k} u) / m AS a, u{k}.v, u{k}.b FROM w{k}, u{k}, m)")
    return f"WITH {', '.join(steps)} SELECT p_partkey AS __pos, round(1 / (1 + exp(-(tanh(x * w + a) * v + b))), 6) AS value FROM d, w{epochs}"


@query(_network_sql(5, 50.0))
def dense_nn_part(spark: SparkSession, sf: str) -> DataFrame:
    m = _parts(spark, sf)
    x = Matrix(m.source, {"x": (m.cells["size"] - 25) / F.lit(25.0)})
    model = models.DenseNN([1, 1, 1], ["tanh", "sigmoid"], loss="bce", rate=50.0, epochs=5, seed=1).train(x, [(m.cells["price"] > 1200).cast("double")])
    return model.predict(x).select(POS, F.round(F.col("value")[0], 6).alias("value"))


def _network(spark: SparkSession, sf: str, loss: str, init: str) -> DataFrame:
    m = _parts(spark, sf)
    x = Matrix(m.source, {"x": (m.cells["size"] - 25) / F.lit(25.0)})
    model = models.DenseNN([1, 1, 1], ["tanh", "sigmoid"], init=init, loss=loss, rate=50.0, epochs=3, seed=1).train(x, [(m.cells["price"] > 1200).cast("double")])
    return model.predict(x).select(POS, F.round(F.col("value")[0], 6).alias("value"))


@query(_network_sql(3, 50.0, "mse", "he"))
def dense_nn_mse_part(spark: SparkSession, sf: str) -> DataFrame:
    return _network(spark, sf, "mse", "he")


@query(_network_sql(3, 50.0, "bce", "uniform"))
def dense_nn_uniform_part(spark: SparkSession, sf: str) -> DataFrame:
    return _network(spark, sf, "bce", "uniform")


@query("WITH n AS (SELECT (SELECT count(*) FROM region)::DOUBLE AS r, (SELECT count(*) FROM nation)::DOUBLE AS n), p AS (SELECT p_size / 50.0::DOUBLE AS a, p_retailprice / 2000 AS b FROM part), c AS (SELECT count(*)::DOUBLE AS m FROM part) SELECT 'uniform' AS name, 0.5::DOUBLE AS bound UNION ALL SELECT 'xavier', round(sqrt(6 / (n + r)), 8) FROM n UNION ALL SELECT 'he', round(sqrt(2 / n), 8) FROM n UNION ALL SELECT 'mse', round(sum(abs(2 * (a - b) / m)), 8) FROM p, c UNION ALL SELECT 'bce', round(sum(abs((a - b) / m)), 8) FROM p, c")
def initializers_and_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of first weights between as many units as nations and regions; absolute gradients of both losses summed over part."""
    regions, nations = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("region", "nation"))
    limits = {"uniform": models.init_limit("uniform", nations, regions), "xavier": models.init_limit("xavier", nations, regions), "he": models.init_limit("he", nations, regions)}
    made = spark.createDataFrame([(k, round(float(v), 8)) for k, v in limits.items()], "name string, bound double")
    m = _parts(spark, sf)
    data, rows = m.source.select((F.col("size") / 50.0).alias("a"), (F.col("price") / 2000.0).alias("b")), m.rows()

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, want = np.asarray(b.column(0))[:, None], np.asarray(b.column(1))[:, None]
            sums = [float(np.abs(models.loss_gradient(k, got, want, rows)).sum()) for k in ("mse", "bce")]
            yield pa.RecordBatch.from_arrays([pa.array(["mse", "bce"]), pa.array(sums)], ["name", "g"])

    found = data.mapInArrow(gradients, "name string, g double").groupBy("name").agg(F.round(F.sum("g"), 8).alias("bound"))
    return made.unionAll(found)


# -- calendar ----------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, d + 1 AS day, d + 7 AS week, (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE AS month, ((date_trunc('quarter', d) + INTERVAL 6 MONTH)::DATE - 1) AS quarter, n + CASE isodow(n) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS bmonth, e - CASE isodow(e) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS bend FROM (SELECT o_orderkey, o_orderdate::DATE AS d, (date_trunc('month', o_orderdate::DATE) + INTERVAL 1 MONTH)::DATE AS n, ((date_trunc('month', o_orderdate::DATE) + INTERVAL 1 MONTH)::DATE - 1) AS e FROM orders)")
def next_dates_orders(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("d")
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return df.select("o_orderkey", C.next_date(d, DateFreq.DAILY).alias("day"), C.next_date(d, DateFreq.WEEKLY_MONDAY).alias("week"), C.next_date(d, DateFreq.MONTH_START).alias("month"), C.next_date(d, DateFreq.QUARTER_END).alias("quarter"), C.next_business_date(d, DateFreq.MONTH_START).alias("bmonth"), C.first_business_on_or_after(d, DateFreq.MONTH_END).alias("bend"))


@query("WITH o AS (SELECT min(o_orderdate)::DATE AS a FROM orders), m AS (SELECT (date_trunc('month', a) + to_months(CASE WHEN day(a) = 1 THEN 0 ELSE 1 END + k))::DATE AS d FROM o, range(0, 30) t(k)) SELECT d AS date, 30::BIGINT AS n FROM m")
def dates_generator(spark: SparkSession, sf: str) -> DataFrame:
    first = spark.read.parquet(f"{sf}/orders.parquet").agg(F.min(F.col("o_orderdate").cast("date"))).first()[0]
    made = cal.DatesList.from_n_periods(spark, first, DateFreq.MONTH_START, 30)
    generated = cal.generate(spark, first, DateFreq.MONTH_START, 30)
    return generated.join(made.list(spark), "date").withColumn("n", F.lit(made.count(spark)).cast("long"))


@query(f"WITH days AS (SELECT unnest(generate_series({FIRST_DAY}, {FIRST_DAY} + 300, INTERVAL 1 DAY))::DATE AS d), b AS (SELECT d FROM days WHERE isodow(d) < 6 ORDER BY d LIMIT 200) SELECT year(d)::INT AS year, dayofyear(d)::INT AS part, 1::BIGINT AS n, d AS first FROM b")
def bdates_from_n_periods(spark: SparkSession, sf: str) -> DataFrame:
    """200 business days from the first order on."""
    made = cal.BDatesList.from_n_periods(spark, _span(spark, sf)[0].isoformat(), DateFreq.DAILY, 200)
    return made.groups(spark).select("year", "part", F.size("dates").cast("long").alias("n"), F.element_at("dates", 1).alias("first"))


@query(f"WITH d AS (SELECT unnest(generate_series({FIRST_DAY}, {LAST_DAY}, INTERVAL 1 DAY))::DATE AS d) SELECT 'M' AS kind, year(d)::INT AS year, month(d)::INT AS part, count(*) AS n FROM d WHERE d = date_trunc('month', d) GROUP BY ALL UNION ALL SELECT 'Q', year(d)::INT, quarter(d)::INT, count(*) FROM d WHERE d + 1 = date_trunc('quarter', d + 1) GROUP BY ALL UNION ALL SELECT 'Y', year(d)::INT, 0, count(*) FROM d WHERE d = date_trunc('year', d) GROUP BY ALL")
def date_groups_by_period(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for kind, freq in (("M", DateFreq.MONTH_START), ("Q", DateFreq.QUARTER_END), ("Y", DateFreq.YEAR_START)):
        spec = cal.DatesList(*_span(spark, sf), freq)
        one = cal.DatesList(spec.start_date, spec.end_date, spec.freq).groups(spark).select(F.lit(kind).alias("kind"), "year", "part", F.size("dates").cast("long").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


# -- random numbers -----------------------------------------------------------------------------------------------
@query("SELECT * FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('3:' || p_partkey), p_partkey) - 1 AS __pos FROM part)")
def shuffle_order(spark: SparkSession, sf: str) -> DataFrame:
    return rng.shuffle(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey"), 3, "p_partkey")


@query(f"WITH s AS (SELECT p_partkey, {xorshift_sql('(p_partkey + 1)::UHUGEINT')} AS x FROM part), t AS (SELECT *, {xorshift_sql('x')} AS y FROM s), u AS (SELECT *, {xorshift_sql('y')} AS z FROM t) SELECT p_partkey, (5 + x % 10)::BIGINT AS k, round(-1 + y::DOUBLE / 18446744073709551615::DOUBLE * 2, 12) AS u, z % 2 = 1 AS b FROM u")
def prng_samples(spark: SparkSession, sf: str) -> DataFrame:
    """For each part a generator seeded by its key draws a whole number, a float and a bool."""
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            drawn = [(g.range_int(5, 15), round(g.range_float(-1.0, 1.0), 12), g.gen_bool()) for g in (rng.Prng(k + 1) for k in keys)]
            k, u, t = zip(*drawn, strict=True) if drawn else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k, pa.int64()), pa.array(u, pa.float64()), pa.array(t, pa.bool_())], ["p_partkey", "k", "u", "b"])

    return df.mapInArrow(draw, "p_partkey long, k long, u double, b boolean")


@query("SELECT p_partkey, true AS inside, true AS whole, true AS flag, true AS drawn FROM part")
def random_ranges(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    made = rng.secure_u64(df.withColumns({"u": rng.uniform(-1.0, 1.0, 7), "k": rng.uniform_int(0, 10, 8), "b": rng.boolean(10)}))
    return made.select("p_partkey", F.col("u").between(-1.0, 1.0).alias("inside"), F.col("k").between(0, 9).alias("whole"), F.col("b").isNotNull().alias("flag"), F.col("random").isNotNull().alias("drawn"))

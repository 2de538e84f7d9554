from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from columna.operators.frame import Frame
from columna.operators.matrix import Matrix
from columna.sources.build import filled, frame, from_cols, from_rows_vec, from_vec, nans, ones, zeros

NAN = float("nan")


def same(a, b):
    return len(a) == len(b) and all((x != x and y != y) or x == pytest.approx(y) for x, y in zip(a, b, strict=True))


def vertical(df):
    return list(df.first())


def horizontal(df):
    return [r[1] for r in df.orderBy("__pos").collect()]


@pytest.fixture(scope="module")
def nan3(spark):
    return from_vec(spark, [1.0, 2, 3, 4, NAN, 6, 7, 8, NAN], 3, 3)


def test_constructors(spark):
    assert from_vec(spark, [1, 2, 3, 4], 2, 2).to_vec() == [1, 2, 3, 4]
    assert from_rows_vec(spark, [1, 2, 3, 4, 9], 2, 2).to_vec() == [1, 3, 2, 4]
    assert zeros(spark, 2, 1).to_vec() == [0, 0] and ones(spark, 1, 2).to_vec() == [1, 1]
    assert all(map(math.isnan, nans(spark, 2, 2).to_vec()))
    assert filled(spark, 0, 3, 1.0).shape() == (0, 3)
    for bad in (lambda: from_cols(spark, []), lambda: from_cols(spark, [[1], [1, 2]]), lambda: from_vec(spark, [1], 2, 2), lambda: from_rows_vec(spark, [1], 2, 2)):
        with pytest.raises(ValueError):
            bad()


def test_nan_reductions(nan3):
    assert vertical(nan3.sum_vertical()) == [6, 10, 15]
    assert horizontal(nan3.sum_horizontal()) == [12, 10, 9]
    assert vertical(nan3.prod_vertical()) == [6, 24, 56]
    assert horizontal(nan3.prod_horizontal()) == [28, 16, 18]
    assert nan3.cumsum_vertical().to_vec() == [1, 3, 6, 4, 4, 10, 7, 15, 15]
    assert nan3.cumsum_horizontal().to_vec() == [1, 2, 3, 5, 2, 9, 12, 10, 9]
    assert vertical(nan3.count_nan_vertical()) == [0, 1, 1] and horizontal(nan3.count_nan_horizontal()) == [0, 1, 1]
    assert nan3.is_nan().count() == 2


def test_all_nan_and_empty(spark):
    m = nans(spark, 2, 2)
    assert vertical(m.sum_vertical()) == [0, 0] and vertical(m.prod_vertical()) == [1, 1] and m.cumsum_vertical().to_vec() == [0] * 4
    e = filled(spark, 0, 1, True)
    assert vertical(e.any_vertical()) == [False] and vertical(e.all_vertical()) == [True] and not e.any() and e.all()


def test_running_sums_over_blocks(spark):
    from columna.plans.prefix import running_sums

    df = spark.range(1000).select(F.col("id").alias("p"), F.col("id").cast("double").alias("v"))
    got = [r["v"] for r in running_sums(df, "p", ["v"], block=64).orderBy("p").collect()]
    assert got == [i * (i + 1) / 2 for i in range(1000)]


def test_matmul(spark, nan3):
    a, b = from_vec(spark, [1.0, 2, 3, 4], 2, 2), from_vec(spark, [5.0, 6, 7, 8], 2, 2)
    assert a.matmul(b).to_vec() == [23, 34, 31, 46]
    got = nan3.dot(nan3).to_vec()
    assert got[0] == 30 and all(map(math.isnan, got[1:]))
    import columna.operators.matrix as mod

    old, mod.LITERAL_CELLS = mod.LITERAL_CELLS, 0
    try:
        assert a.matmul(b).to_vec() == [23, 34, 31, 46]
    finally:
        mod.LITERAL_CELLS = old
    with pytest.raises(ValueError):
        a.matmul(nan3)


def test_arithmetic_is_ieee(spark):
    a, z = from_vec(spark, [1.0, -1.0, 0.0, 4.0], 4, 1), from_vec(spark, [0.0, 0.0, 0.0, 2.0], 4, 1)
    assert same((a / z).to_vec(), [math.inf, -math.inf, NAN, 2.0])
    assert ((a + 1.0) * 2.0 - 1.0).to_vec() == [3, -1, 1, 9]
    i = from_vec(spark, [7, -7], 2, 1)
    assert (i / 2).to_vec() == [3, -3]


def test_comparison_with_nan(spark):
    a, b = from_vec(spark, [1.0, NAN, 3.0], 3, 1), from_vec(spark, [1.0, NAN, 2.0], 3, 1)
    want = {"eq": [True, False, False], "ne": [False, True, True], "lt": [False] * 3, "le": [True, False, False], "gt": [False, False, True], "ge": [True, False, True]}
    for op, v in want.items():
        assert a.compare(op, b).to_vec() == v
    assert a.compare("gt", 2.0).to_vec() == [False, False, True]
    assert a.equals(a) is False and from_vec(spark, ["x"], 1, 1).equals(from_vec(spark, ["x"], 1, 1))


def test_booleans(spark):
    p, q = from_vec(spark, [True, False, False, True], 2, 2), from_vec(spark, [True, True, False, False], 2, 2)
    assert (p & q).to_vec() == [True, False, False, False]
    assert (p | q).to_vec() == [True, True, False, True]
    assert (p ^ q).to_vec() == [False, True, False, True]
    assert (~p).to_vec() == [False, True, True, False]
    assert vertical(p.count_vertical()) == [1, 1] and horizontal(p.count_horizontal()) == [1, 1]
    assert horizontal(p.any_horizontal()) == [True, True] and horizontal(q.all_horizontal()) == [False, False]
    assert p.any() and not p.all() and p.count() == 2


def test_structure(spark):
    m = from_vec(spark, [1, 2, 3, 4, 5, 6], 3, 2)
    assert m.swap_columns(0, 1).to_vec() == [4, 5, 6, 1, 2, 3]
    assert m.add_column(1, [7, 8, 9], "n").to_vec() == [1, 2, 3, 7, 8, 9, 4, 5, 6]
    assert m.delete_column(0).to_vec() == [4, 5, 6]
    assert m.add_row(1, [0, 0]).to_vec() == [1, 0, 2, 3, 4, 0, 5, 6]
    assert m.delete_row(1).to_vec() == [1, 3, 4, 6]
    assert m.set_row(0, [9, 9]).row(0) == [9, 9] and m.set(2, 1, 0).get(2, 1) == 0
    assert m.transpose().to_vec() == [1, 4, 2, 5, 3, 6]
    assert m.repeat_rows(2).to_vec() == [1, 1, 4, 4]
    assert [tuple(r) for r in m.iter_rows()] == [(1, 4), (2, 5), (3, 6)] and len(list(m.iter_columns())) == 2
    with pytest.raises(ValueError):
        m.broadcast_row(3, 2)
    for bad in (lambda: m.delete_column(5), lambda: m.row(7), lambda: m.delete_row(9), lambda: m.add_row(9, [1, 2]), lambda: m.get(0, 4)):
        with pytest.raises(IndexError):
            bad()


@pytest.fixture()
def fa(spark):
    return frame(from_cols(spark, [[1.0, 2, 3], [4.0, 5, 6]]), ["A", "B"])


def test_frame_labels(spark, fa):
    f = frame(from_cols(spark, [[1, 2], [3, 4]]), ["C", "A"]).add_column("B", [5, 6]).rename("C", "X")
    f, gone = f.delete_column("A")
    f = f.sort_columns()
    assert f.columns == ["B", "X"] and f.to_vec() == [5, 6, 1, 2] and [r["A"] for r in gone.collect()] == [3, 4]
    for bad, kind in ((lambda: fa.rename("A", "A"), ValueError), (lambda: fa.rename("Z", "Y"), KeyError), (lambda: fa.rename("A", "B"), ValueError), (lambda: fa["Z"], KeyError), (lambda: frame(from_cols(spark, [[1]]), ["A", "B"]), ValueError), (lambda: frame(from_cols(spark, [[1], [2]]), ["A", "A"]), ValueError), (lambda: frame(from_cols(spark, [[1, 2]]), ["A"], [1, 1]), ValueError), (lambda: frame(from_cols(spark, [[1, 2]]), ["A"], [1]), ValueError)):
        with pytest.raises(kind):
            bad()


def test_frame_lookup(spark):
    f = frame(from_cols(spark, [[1.0, 2.0]]), ["A"], [10, 20])
    assert f.get_row(20)["A"] == 2 and f.set_cell(10, "A", 7.0).get_row(10)["A"] == 7
    with pytest.raises(KeyError):
        f.get_row(5)
    with pytest.raises(TypeError):
        f.get_row_date(dt.date(2024, 1, 1))
    d = frame(from_cols(spark, [["x", "y"]]), ["A"], [dt.date(2023, 5, 1), dt.date(2023, 5, 10)])
    assert d.get_row_date(dt.date(2023, 5, 10))["A"] == "y"
    assert f.column_index("A") == 0 and f.column_index("Z") is None and "A" in repr(f)


def test_frame_arithmetic(spark, fa):
    fb = frame(from_cols(spark, [[0.1, 0.2, 0.3], [0.4, 0.5, 0.6]]), ["A", "B"])
    assert same((fa + fb).to_vec(), [1.1, 2.2, 3.3, 4.4, 5.5, 6.6])
    assert (fa * fa).to_vec() == [1, 4, 9, 16, 25, 36]
    assert fa.frame_map(lambda c: c * 2).columns == ["A", "B"]
    other = frame(from_cols(spark, [[1.0, 2, 3], [4.0, 5, 6]]), ["A", "B"], [7, 8, 9])
    assert fa.frame_zip(other, lambda a, b: a - b).to_vec() == [0] * 6
    assert isinstance(fa.map(F.sqrt), Matrix) and not isinstance(fa.map(F.sqrt), Frame)
    for bad in (frame(from_cols(spark, [[1.0, 2, 3], [4.0, 5, 6]]), ["A", "C"]), other, frame(from_cols(spark, [[1.0], [2.0]]), ["A", "B"])):
        with pytest.raises(ValueError):
            (fa + bad).to_vec()
    dates = [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    p, q = frame(from_cols(spark, [[True, False]]), ["P"], dates), frame(from_cols(spark, [[True, True]]), ["P"], dates)
    assert (p & q).to_vec() == [True, False] and (p ^ q).to_vec() == [False, True] and (~p).to_vec() == [False, True]


def test_stream_projection(spark, tmp_path):
    from columna.streaming.elementwise import on_stream

    spark.createDataFrame([(1, 0.0), (2, 4.0)], "k long, v double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k long, v double").parquet(str(tmp_path / "in"))
    q = on_stream(s, ["v"], lambda m: (m + 1.0) / 2.0).writeStream.format("memory").queryName("elementwise_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("elementwise_out").collect())) == [(1, 0.5), (2, 2.5)]


def test_transpose_takes_the_whole_table(spark):
    import duckdb

    from columna.plans import queries

    sf = "/root/testdata/sf0.1"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{sf}/part.parquet')")
    got = queries.QUERIES["transpose_part"](spark, sf)
    want = duck.execute(queries.SQL["transpose_part"])
    assert got.columns == [c[0] for c in want.description]
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) == 40_000 and rows == sorted(want.fetchall())


def test_a_frame_without_index_counts_its_rows(spark):
    df = spark.range(40).select((F.col("id") * 7 % 40).cast("double").alias("a"), F.col("id").cast("double").alias("b")).repartition(4)
    given = [tuple(r) for r in df.collect()]
    f = Frame.of(df)
    assert [r["__idx"] for r in f.df.orderBy("__pos").collect()] == list(range(40))
    assert [(f.get_row(i)["a"], f.get_row(i)["b"]) for i in (0, 5, 39)] == [given[i] for i in (0, 5, 39)]
    assert f.transpose().df.orderBy("__pos").first()["c39"] == given[39][0]
    by = Frame.of(df, columns=["b"], order=["a"])
    assert [r["b"] for r in by.df.orderBy("__pos").collect()] == [b for _, b in sorted(given)]
    assert "index=range 0..39" in repr(f) and "empty" in repr(Frame.of(df.where("a < 0")))


def test_transpose_of_an_index_with_gaps_loses_no_cell(spark):
    df = spark.createDataFrame([(10, 1.0, 2.0), (30, 3.0, 4.0), (20, 5.0, 6.0)], "k long, a double, b double")
    rows = Frame.of(df, "k").transpose().df.orderBy("__pos").collect()
    assert [[r[f"c{i}"] for i in range(3)] for r in rows] == [[1, 5, 3], [2, 6, 4]]


def test_rows_that_only_one_side_has_stop_the_job(spark):
    make = lambda keys: Frame.of(spark.createDataFrame([(k, p, float(k)) for p, k in enumerate(keys)], "k long, p long, v double"), "k", pos="p")
    assert (make([3, 5]) - make([3, 5])).to_vec() == [0, 0]
    for a, b in (([3, 5], [3, 6]), ([3, 5], [3]), ([3], [3, 5]), ([3, 5], [5, 3])):
        with pytest.raises(Exception, match="row indexes differ"):
            (make(a) + make(b)).sum_vertical().collect()
    with pytest.raises(Exception, match="row counts"):
        make([3, 5]).frame_zip(make([3]), lambda x, y: x + y).df.collect()

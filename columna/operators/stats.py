"""Descriptive statistics, covariance and correlation, and tests, over a :class:`Matrix`.

``*_vertical`` gives a one-row DataFrame with a column each, ``*_horizontal`` one value a row.  Standard deviations and
covariances are of the population, ``covariance_matrix`` is of the sample.  Means divide by all cells, and those of
columns and rows skip NaN in the sum only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.distributions import gamma_cdf
from ..plans.numbering import durable
from .matrix import POS, Matrix


def _cells(x: Matrix) -> list[Column]:
    return list(x.cells.values())


def _whole(x: Matrix) -> DataFrame:
    return x.source.select(F.explode(F.array(*_cells(x))).alias("v"))


def _fold(cs: list[Column], f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.array(*cs), F.lit(0.0), f)


# -- means and spread ----------------------------------------------------------------------------------------
def mean(x: Matrix) -> float:
    """Over all cells; NaN propagates."""
    total, n = x.source.agg(F.sum(ieee.total(_cells(x))), F.count("*")).first()
    return total / (n * x.cols) if n else math.nan


def mean_vertical(x: Matrix) -> DataFrame:
    return x._vertical(lambda c: F.sum(ieee.or_zero(c)) / F.count("*"))


def mean_horizontal(x: Matrix) -> DataFrame:
    return x._horizontal(ieee.total([ieee.or_zero(c) for c in _cells(x)]) / float(x.cols))


def population_variance(x: Matrix) -> float:
    return _whole(x).agg(F.var_pop("v")).first()[0]


def sample_variance(x: Matrix) -> float:
    got = _whole(x).agg(F.var_samp("v")).first()[0]
    return math.nan if got is None else got


def population_variance_vertical(x: Matrix) -> DataFrame:
    return x._vertical(F.var_pop)


def sample_variance_vertical(x: Matrix) -> DataFrame:
    return x._vertical(lambda c: F.coalesce(F.var_samp(c), ieee.nan()))


def _variance_row(x: Matrix, less: int) -> Column:
    cs = _cells(x)
    m = ieee.total(cs) / float(len(cs))
    squares = F.aggregate(F.array(*cs), F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    return squares / float(len(cs) - less) if len(cs) > less else ieee.nan()


def population_variance_horizontal(x: Matrix) -> DataFrame:
    return x._horizontal(_variance_row(x, 0))


def sample_variance_horizontal(x: Matrix) -> DataFrame:
    return x._horizontal(_variance_row(x, 1))


def stddev(x: Matrix) -> float:
    return math.sqrt(population_variance(x))


def stddev_vertical(x: Matrix) -> DataFrame:
    return x._vertical(F.stddev_pop)


def stddev_horizontal(x: Matrix) -> DataFrame:
    return x._horizontal(F.sqrt(_variance_row(x, 0)))


def _middle(source: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Each column's median: the mean of the two middle ranks."""
    return _nearest(source, cells, 0.5, lambda n: ((n - 1) // 2, n // 2))


def median(x: Matrix) -> float:
    return _middle(_whole(x), {"v": F.col("v")}).first()[0]


def median_vertical(x: Matrix) -> DataFrame:
    return _middle(x.source, x.cells)


def median_horizontal(x: Matrix) -> DataFrame:
    s, n = F.sort_array(F.array(*_cells(x))), x.cols
    return x._horizontal((s[(n - 1) // 2] + s[n // 2]) / 2.0)


def _checked(p: float) -> float:
    if not 0.0 <= p <= 100.0:
        raise ValueError("a percentile lies between 0 and 100")
    return p


def _rank(p: float, n: int) -> int:
    """Nearest rank from 0, halves away from zero."""
    return math.floor(p / 100.0 * (n - 1) + 0.5)


#: So many distinct values in the brackets are ranked in one task a column; more are cut into ranges first.
FEW_VALUES = 200_000
#: A bracket's half width as a share of the rows: ten times the error of the sketch that gives it.
BRACKET, ACCURACY = 0.0005, 20_000


def _nearest(source: DataFrame, cells: dict[str, Column], near: float, ranks: Callable[[int], tuple[int, int]]) -> DataFrame:
    """Each column's mean of its values at two ranks (from 0, of ``n`` rows; they may be one), exactly, as one row.

    The first scan counts rows and NaN and sketches quantiles about ``near``, which bracket the ranks.  The second one counts
    what lies below a bracket, and how often each value in it occurs.  So no column is sorted whole.
    """
    names, es = list(cells), list(cells.values())
    share = F.array(F.lit(max(0.0, near - BRACKET)), F.lit(min(1.0, near + BRACKET)))
    first = source.agg(F.count("*").alias("n"), *[x for i, e in enumerate(es) for x in (F.count_if(e.isNull() | F.isnan(e)).alias(f"b{i}"), F.percentile_approx(e, share, F.lit(ACCURACY)).alias(f"q{i}"))]).first()
    n = first["n"]
    if not n:
        raise ValueError("an order statistic of no rows")
    if any(first[f"b{i}"] for i in range(len(names))):
        raise ValueError("an order statistic of NaN")
    low, high = ranks(n)
    # Ranks lie a row or so off the share; few rows are looked at whole.
    whole = n * BRACKET < 4
    lo = [-math.inf if whole or near - BRACKET <= 0 else first[f"q{i}"][0] for i in range(len(names))]
    hi = [math.inf if whole or near + BRACKET >= 1 else first[f"q{i}"][1] for i in range(len(names))]
    for _ in range(2):
        # Values below a bracket are counted as null.
        seen = [F.struct(F.lit(i).alias("j"), F.when(e >= F.lit(a), e).alias("v"), (e <= F.lit(b)).alias("in")) for i, (e, a, b) in enumerate(zip(es, lo, hi, strict=True))]
        few = durable(source.select(F.explode(F.filter(F.array(*seen), lambda c: c["in"])).alias("c")).groupBy("c.j", "c.v").count(), "ranks")
        held = {r["j"]: r for r in few.groupBy("j").agg(F.sum(F.when(F.col("v").isNull(), F.col("count"))).alias("below"), F.sum("count").alias("upto"), F.count("*").alias("values")).collect()}
        missed = [i for i in range(len(names)) if i not in held or not (held[i]["below"] or 0) <= low <= high < held[i]["upto"]]
        if not missed:
            break
        for i in missed:  # the sketch missed: all values count
            lo[i], hi[i] = -math.inf, math.inf
    by, ranked = ["j"], few
    if max(r["values"] for r in held.values()) > FEW_VALUES:
        by = ["j", "part"]
        ranked = durable(few.repartitionByRange("j", "v").withColumn("part", F.spark_partition_id()), "ranges")
        sums = ranked.groupBy("j", "part").agg(F.sum("count").alias("of"))
        starts = sums.select("j", "part", (F.sum("of").over(Window.partitionBy("j").orderBy("part")) - F.col("of")).alias("start"))
        ranked = ranked.join(starts, by)
    else:
        ranked = ranked.withColumn("start", F.lit(0).cast("long"))
    # A running count finds the ranks; nulls come first.
    run = ranked.withColumn("upto", F.col("start") + F.sum("count").over(Window.partitionBy(*by).orderBy("v"))).where("v is not null")
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    hit = run.groupBy("j").agg(((at(low) + at(high)) / 2.0 if low != high else at(low)).alias("v"))
    return hit.groupBy().agg(*[F.max(F.when(F.col("j") == i, F.col("v"))).alias(c) for i, c in enumerate(names)])


def percentile(x: Matrix, p: float) -> float:
    _checked(p)
    return _nearest(_whole(x), {"v": F.col("v")}, p / 100.0, lambda n: (_rank(p, n),) * 2).first()[0]


def percentile_vertical(x: Matrix, p: float) -> DataFrame:
    _checked(p)
    return _nearest(x.source, x.cells, p / 100.0, lambda n: (_rank(p, n),) * 2)


def percentile_horizontal(x: Matrix, p: float) -> DataFrame:
    return x._horizontal(F.sort_array(F.array(*_cells(x)))[_rank(_checked(p), x.cols)])


# -- covariance and correlation -------------------------------------------------------------------------------
def _pairs(x: Matrix, y: Matrix) -> DataFrame:
    source, left, right = x._beside(y)
    return source.select(F.explode(F.arrays_zip(F.array(*left).alias("a"), F.array(*right).alias("b"))).alias("c")).select(F.col("c.a").alias("a"), F.col("c.b").alias("b"))


def covariance(x: Matrix, y: Matrix) -> float:
    return _pairs(x, y).agg(F.covar_pop("a", "b")).first()[0]


def pearson(x: Matrix, y: Matrix) -> float:
    """0 if either does not vary."""
    c, a, b = _pairs(x, y).agg(F.covar_pop("a", "b"), F.stddev_pop("a"), F.stddev_pop("b")).first()
    return 0.0 if a == 0 or b == 0 else c / (a * b)


def _symmetric(source: DataFrame, cells: dict[str, Column], f: Callable[[Column, Column], Column]) -> DataFrame:
    """(i, j, value) for all pairs of columns, each computed once, in one aggregate."""
    cs = list(cells.values())
    if len(cs) > WIDE:
        return _wide_symmetric(source, cs, f)
    pairs = [(i, j) for i in range(len(cs)) for j in range(i, len(cs))]
    one = source.agg(*[f(cs[i], cs[j]).alias(f"p{i}_{j}") for i, j in pairs])
    entries = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{min(i, j)}_{max(i, j)}").alias("value")) for i in range(len(cs)) for j in range(len(cs))]
    return one.select(F.inline(F.array(*entries)))


#: From so many columns on, products are added up as blocks in numpy instead of as aggregates in one plan.
WIDE = 40


def _moments(source: DataFrame, cs: list[Column], shifted: bool = True, centred: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, the columns' sums and the sums of their products: one array a task, added in a tree.

    ``shifted``: of all rows less the first one.  ``centred``: of each row less its own mean.
    """
    c = len(cs)
    data = source.select(F.array(*[e.cast("double") for e in cs]).alias("x"))
    shift = np.zeros(c)
    if shifted:
        origin = data.first()
        if origin is None:
            return 0, np.zeros(c), np.zeros((c, c))
        shift = np.array(origin["x"], float)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + c + c * c)
        for b in batches:
            x = np.asarray(b.column(0).flatten(), np.float64).reshape(b.num_rows, c) - shift
            if centred:
                x -= x.mean(1, keepdims=True)
            total += np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + c + c * c)
        for b in batches:
            for t in b.column(0):
                total += np.frombuffer(t.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

    got = data.mapInArrow(add, "t binary").repartition(16).mapInArrow(merge, "t binary").repartition(1).mapInArrow(merge, "t binary").first()
    total = np.frombuffer(got["t"])
    return int(total[0]), total[1 : c + 1], total[c + 1 :].reshape(c, c)


def _square(source: DataFrame, value: np.ndarray) -> DataFrame:
    i, j = np.indices(value.shape)
    return source.sparkSession.createDataFrame(pa.table({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "value": value.ravel()}))


def _wide_symmetric(source: DataFrame, cs: list[Column], f: Callable[[Column, Column], Column]) -> DataFrame:
    n, s, xx = _moments(source, cs)
    centred = xx - np.outer(s, s) / max(n, 1)
    less = {F.covar_pop: 0, F.covar_samp: 1}[f]
    value = centred / (n - less) if n > less else np.full_like(xx, math.nan)
    return _square(source, value)


def covariance_vertical(x: Matrix) -> DataFrame:
    return _symmetric(x.source, x.cells, F.covar_pop)


def _round_half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """``v`` rounded, halves away from zero, zeros without sign."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = v * 10.0**digits
        out = np.rint(scaled)
        half = np.abs(scaled - out) == 0.5
        if half.any():
            s = scaled[half]
            # Of what lies below half of the last digit, the product alone was rounded up to it.
            out[half] = np.where(np.abs(v[half]) < 0.5 / 10.0**digits, 0.0, s + np.copysign(0.5, s))
        out /= 10.0**digits
        out += 0.0
        whole = np.isfinite(scaled)
    return out if whole.all() else np.where(whole, out, v)


#: Bytes of a block of rows at most, and blocks in a partition of them: each task takes the pairs of two partitions.
BLOCK_BYTES, BLOCKS_A_PART = 8_000_000, 16
#: Cells that are sent from Python at a time, before they are mirrored, and in a run that its mirror follows.
SENT_CELLS, RUN = 1 << 17, 64


def covariance_horizontal(x: Matrix, block: int = 1024, digits: int | None = None) -> DataFrame:
    """(i, j, value) between rows, ``rows ** 2`` of them: blocks of rows meet in pairs, each pair once, its product mirrored.

    Rows are shuffled into blocks once, and each task reads two partitions of blocks from that one copy, so what lies on
    disk besides the result grows as the rows, not as the pairs.  Short runs of cells are followed by their mirror, so near
    that a file's codec finds the values repeated.  With ``digits`` values are rounded where they are made, each pair once:
    so many are made that rounding them one by one behind takes most of the time.
    """
    c = x.cols
    block = max(1, min(block, BLOCK_BYTES // (8 * c)))
    rows = x.source.select(F.col(POS).cast("long").alias("i"), F.array(*[e.cast("double") for e in _cells(x)]).alias("x"))
    numbered = rows.withColumn("p", F.floor(F.col("i") / block).cast("long"))
    blocks = numbered.agg(F.count_distinct("p")).first()[0]
    # Some tasks a core, too, where there are few blocks.
    parts = max(1, min(blocks, max(-(-blocks // BLOCKS_A_PART), math.isqrt(8 * x.source.sparkSession.sparkContext.defaultParallelism))))

    def cut(t: pa.Table) -> pa.Table:
        i = np.asarray(t.column("i"), np.int64)
        v = np.asarray(t.column("x").combine_chunks().flatten(), np.float64).reshape(len(i), c)
        v = v - v.mean(1, keepdims=True)
        return pa.table({"p": t.column("p")[:1], "i": pa.array([i.tobytes()], pa.binary()), "x": pa.array([v.tobytes()], pa.binary())})

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for p, i, v, q, j, w in zip(*t.columns, strict=True):
                i, j = np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(j.as_buffer(), np.int64)
                value = np.frombuffer(v.as_buffer()).reshape(-1, c) @ np.frombuffer(w.as_buffer()).reshape(-1, c).T
                value /= c
                if digits is not None:
                    value = _round_half_up(value, digits)
                step = max(1, SENT_CELLS // len(j))
                at = np.arange(len(j)) if p == q else np.argsort(np.tile(np.arange(len(j)) // RUN, 2), kind="stable")
                back, at = at >= len(j), at % len(j)
                to = j[at]
                for k in range(0, len(i), step):
                    here = i[k : k + step, None]
                    cells = np.where(back, to, here), np.where(back, here, to), value[k : k + step].take(at, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in cells], ["i", "j", "value"])

    held = numbered.groupBy("p").applyInArrow(cut, "p long, i binary, x binary").repartitionById(parts, F.pmod("p", F.lit(parts)).cast("int"))
    others = held.select(F.col("p").alias("q"), F.col("i").alias("j"), F.col("x").alias("y"))
    # No side is broadcast: the hint asks for the product of partitions at every size.
    return held.join(others.hint("shuffle_replicate_nl"), F.col("p") <= F.col("q")).mapInArrow(products, "i long, j long, value double")


def covariance_matrix(x: Matrix, axis: str = "col") -> DataFrame:
    """Columns x columns over rows - 1, centred by column means or (``row``) by row means."""
    if axis == "col":
        return _symmetric(x.source, x.cells, F.covar_samp)
    if x.cols > WIDE:
        n, _, products = _moments(x.source, _cells(x), shifted=False, centred=True)
        return _square(x.source, products / (n - 1) if n > 1 else np.full_like(products, math.nan))
    m = ieee.total(_cells(x)) / float(x.cols)
    centred = {c: e - m for c, e in x.cells.items()}
    return _symmetric(x.source, centred, lambda a, b: F.sum(a * b) / (F.count("*") - 1))


# -- tests ---------------------------------------------------------------------------------------------------------
def t_test(a: DataFrame, b: DataFrame, column: str = "v") -> DataFrame:
    """Welch's t of two samples; ``p`` is the constant 0.5 here (see the README)."""
    s = lambda d, k: d.agg(F.avg(column).alias(f"m{k}"), F.var_samp(column).alias(f"v{k}"), F.count(column).alias(f"n{k}"))
    t = (F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    return s(a, 1).crossJoin(s(b, 2)).select(t.alias("t"), F.lit(0.5).alias("p"))


def chi2_test(observed: DataFrame, row: str, col: str, count: str | None = None, textbook: bool = False) -> DataFrame:
    """Chi-squared of independence from rows (row, col[, count]).

    ``p`` is 1 - GammaCDF(chi2, df / 2) at scale 1; ``textbook`` takes scale 2, the true distribution.
    """
    n = F.sum(count) if count else F.count("*")
    cell = observed.groupBy(F.col(row).alias("_a"), F.col(col).alias("_b")).agg(n.cast("double").alias("_o"))
    r, c = cell.groupBy("_a").agg(F.sum("_o").alias("_r")), cell.groupBy("_b").agg(F.sum("_o").alias("_c"))
    total = r.agg(F.sum("_r").alias("_t"), F.count("*").alias("_nr")).crossJoin(c.agg(F.count("*").alias("_nc")))
    # Margins are small, and their product holds the empty cells too.
    e = F.col("_r") * F.col("_c") / F.col("_t")
    full = r.crossJoin(c).join(cell, ["_a", "_b"], "left").crossJoin(total)
    o = F.coalesce("_o", F.lit(0.0))
    out = full.agg(F.sum((o - e) * (o - e) / e).alias("chi2"), ((F.max("_nr") - 1) * (F.max("_nc") - 1) / 2.0).alias("k"))
    return out.select("chi2", (1.0 - gamma_cdf(F.col("chi2"), F.col("k"), 2.0 if textbook else 1.0)).alias("p"))


def anova(groups: DataFrame, group: str, column: str) -> DataFrame:
    """F over groups: unweighted grand mean, within-group squares as sample variance times n; p as for chi2_test."""
    per = groups.groupBy(F.col(group).alias("_g")).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v"))
    grand = per.agg(F.avg("m").alias("g"))
    sums = per.crossJoin(grand).agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("b"), F.sum(F.col("v") * F.col("n")).alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))
    f = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return sums.select(f.alias("f"), ((F.col("k") - 1) / 2.0).alias("h")).select("f", (1.0 - gamma_cdf(F.col("f"), F.col("h"), 1.0)).alias("p"))

"""Small models: parameters on the driver, data in Spark.

What a fit needs of the data is gathered by aggregates.  Linear regression by gradient descent needs sums and products
only, once.  Logistic regression and dense networks need the data every epoch: they are fitted in one barrier stage, whose
tasks hold their rows in memory and add up gradients among each other, so an epoch is neither a job nor a scan.  Where
the rows don't fit in the cluster's memory, ``held=False`` reads them again for every epoch (and layer) instead.  (Barrier
stages need their tasks to run at once and no dynamic allocation.)
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.activations import sigmoid
from .matrix import POS, Matrix
from .stats import WIDE, _moments

#: Cells of a task of a barrier stage, while there are cores for more tasks.
TASK_CELLS = 1 << 14
#: Numbers of an intermediate array.
CELLS = 1 << 21
#: Labels of a classifier, each a row of means and variances on the driver.
MOST_CLASSES = 10_000


#: Beyond so many columns sums run over arrays, whose code does not grow with them.
LONG_ROW = 16


def _over(cells: list[Column], values: np.ndarray, f: Callable[[Column, Column], Column], start: float = 0.0) -> Column:
    """``start`` and the sum of f(cell, value) over the columns."""
    if len(cells) <= LONG_ROW:
        return ieee.total([f(c, F.lit(float(v))) for c, v in zip(cells, values, strict=True)], start)
    pairs = F.zip_with(F.array(*cells), F.array(*[F.lit(float(v)) for v in values]), f)
    return F.aggregate(pairs, F.lit(float(start)), lambda a, x: a + x)


def _linear(cells: list[Column], w: np.ndarray, b: float) -> Column:
    return _over(cells, w, lambda c, v: c * v, float(b))


def _xy(x: Matrix, y: Column) -> DataFrame:
    return x.source.select(F.array(*[c.cast("double") for c in x.cells.values()]).alias("x"), y.cast("double").alias("y"))


def _arrays(batch: pa.RecordBatch | pa.Table, outputs: int = 0) -> tuple[np.ndarray, np.ndarray]:
    flat = lambda c: np.asarray((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).flatten(), np.float64)
    n = batch.num_rows
    y = flat(batch.column("y")).reshape(n, -1) if outputs else np.asarray(batch.column("y"), np.float64)
    return (flat(batch.column("x")).reshape(n, -1) if n else np.zeros((0, 0))), y


def _summed(data: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], outputs: int = 0) -> np.ndarray:
    """``f(x, y)`` added up over all partitions: one array a partition is sent, and eight reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = f(*_arrays(b, outputs))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for g in b.column(0):
                total = np.asarray(g.values) if total is None else total + np.asarray(g.values)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

    per = data.mapInArrow(run, "g array<double>").repartition(8).mapInArrow(merge, "g array<double>")
    return np.sum([r["g"] for r in per.collect()], axis=0)


def _together(data: DataFrame, width: int, body: Callable[[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]], list[np.ndarray]], outputs: int = 0) -> list[np.ndarray]:
    """``body(x, y, total)`` in all tasks of one barrier stage at once; ``total`` adds an array up over them.

    Sums are made in the tasks' order, so all tasks go on with the same numbers; the first one's result is returned.  A task
    holds its share of the rows, and what ``total`` is given, once for each task.
    """
    cells = data.count() * (width + max(1, outputs))
    tasks = max(1, min(data.sparkSession.sparkContext.defaultParallelism, -(-cells // TASK_CELLS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        parts = [_arrays(b, outputs) for b in batches if b.num_rows]
        x = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, width))
        y = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, outputs) if outputs else 0)

        def total(g: np.ndarray) -> np.ndarray:
            if tasks == 1:
                return g
            sent = context.allGather(base64.b64encode(np.ascontiguousarray(g, np.float64).tobytes()).decode())
            return np.sum([np.frombuffer(base64.b64decode(s)).reshape(np.shape(g)) for s in sent], axis=0)

        found = body(x, y, total)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(a, np.float64).tobytes() for a in found], pa.binary()), pa.array([list(np.shape(a)) for a in found], pa.list_(pa.int64()))], ["a", "shape"])

    got = data.repartition(tasks).mapInArrow(run, "a binary, shape array<long>", barrier=True).collect()
    return [np.frombuffer(r["a"]).reshape(r["shape"]) for r in got]


@dataclass
class LinReg:
    """Full-batch gradient descent on squared errors; fitting again goes on from the present weights. NaN spreads to them."""

    n: int
    w: np.ndarray = field(init=False)
    b: float = 0.0

    def __post_init__(self) -> None:
        self.w = np.zeros(self.n)

    def fit(self, x: Matrix, y: Column, rate: float, epochs: int) -> LinReg:
        cs = [c.cast("double") for c in x.cells.values()]
        k = len(cs)
        if k > WIDE:
            # A column of ones gives the sums along with the products.
            _, _, all_ = _moments(x.source, [*cs, y.cast("double"), F.lit(1.0)], shifted=False)
            return self._descend(all_[:k, :k], all_[:k, k + 1], all_[:k, k], all_[k, k + 1], all_[k + 1, k + 1], rate, epochs)
        asks = {f"g{i}_{j}": F.sum(cs[i] * cs[j]) for i in range(k) for j in range(i, k)}
        asks |= {f"x{i}": F.sum(c) for i, c in enumerate(cs)} | {f"y{i}": F.sum(c * y) for i, c in enumerate(cs)}
        got = x.source.agg(F.count("*").alias("m"), F.sum(y).alias("y"), *[e.alias(n) for n, e in asks.items()]).first()
        gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
        return self._descend(gram, np.array([got[f"x{i}"] for i in range(k)]), np.array([got[f"y{i}"] for i in range(k)]), got["y"], got["m"], rate, epochs)

    def _descend(self, gram: np.ndarray, sx: np.ndarray, xy: np.ndarray, sy: float, m: float, rate: float, epochs: int) -> LinReg:
        for _ in range(epochs):
            gw = 2.0 / m * (gram @ self.w + self.b * sx - xy)
            gb = 2.0 / m * (sx @ self.w + self.b * m - sy)
            self.w = self.w - rate * gw
            self.b -= rate * gb
        return self

    def predict(self, x: Matrix) -> DataFrame:
        return x._horizontal(_linear(list(x.cells.values()), self.w, self.b))


@dataclass
class LogReg:
    n: int
    w: np.ndarray = field(init=False)
    b: float = 0.0

    def __post_init__(self) -> None:
        self.w = np.zeros(self.n)

    def fit(self, x: Matrix, y: Column, rate: float, epochs: int, held: bool = True) -> LogReg:
        data = _xy(x, y)

        def gradient(a: np.ndarray, t: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
            with np.errstate(over="ignore"):
                e = 1.0 / (1.0 + np.exp(-(a @ w + b))) - t
            return np.append(a.T @ e, e.sum())

        w, b = self.w, self.b

        def descend(a: np.ndarray, t: np.ndarray, total: Callable) -> list[np.ndarray]:
            v, c = w, b
            m = total(np.array([float(len(a))]))[0]
            for _ in range(epochs):
                g = total(gradient(a, t, v, c))
                v, c = v - rate * g[:-1] / m, c - rate * g[-1] / m
            return [v, np.array(c)]

        if held:
            self.w, c = _together(data, self.n, descend)
            self.b = float(c)
            return self
        m = data.count()
        for _ in range(epochs):
            g = _summed(data, lambda a, t, w=self.w, b=self.b: gradient(a, t, w, b))
            self.w = self.w - rate * g[:-1] / m
            self.b -= rate * g[-1] / m
        return self

    def probability(self, x: Matrix) -> Column:
        return sigmoid(_linear(list(x.cells.values()), self.w, self.b))

    def predict_proba(self, x: Matrix) -> DataFrame:
        return x._horizontal(self.probability(x))

    def predict(self, x: Matrix) -> DataFrame:
        p = self.probability(x)
        return x._horizontal(F.when((p >= 0.5) & ~F.isnan(p), 1.0).otherwise(0.0))


@dataclass
class PCA:
    """Components are the first rows of the sample covariance matrix; further ones are zero (see the README)."""

    components: np.ndarray
    mean: np.ndarray

    @classmethod
    def fit(cls, x: Matrix, k: int) -> PCA:
        cs = list(x.cells.values())
        n = len(cs)
        if n > WIDE:
            m, sums, products = _moments(x.source, cs)
            covariance = (products - np.outer(sums, sums) / max(m, 1)) / (m - 1) if m > 1 else np.full((n, n), np.nan)
            means = x.source.agg(*[(F.sum(ieee.or_zero(c)) / F.count("*")).alias(f"m{i}") for i, c in enumerate(cs)]).first()
            comp = np.zeros((k, n))
            comp[: min(k, n)] = covariance[: min(k, n)]
            return cls(comp, np.array([means[f"m{i}"] for i in range(n)], float))
        asks = [F.covar_samp(cs[i], cs[j]).alias(f"p{i}_{j}") for i in range(min(k, n)) for j in range(n)]
        got = x.source.agg(*[(F.sum(ieee.or_zero(c)) / F.count("*")).alias(f"m{i}") for i, c in enumerate(cs)], *asks).first()
        comp = np.zeros((k, n))
        for i in range(min(k, n)):
            comp[i] = [got[f"p{i}_{j}"] for j in range(n)]
        return cls(comp, np.array([got[f"m{i}"] for i in range(n)]))

    def transform(self, x: Matrix) -> Matrix:
        cs = [c - F.lit(float(m)) for c, m in zip(x.cells.values(), self.mean, strict=True)]
        return Matrix(x.source, {f"pc{i}": _linear(cs, row, 0.0) for i, row in enumerate(self.components)})


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, ties to the lower number, and the squared distance.

    A matrix product gives all distances with a bound on their rounding error; those that may be the smallest are computed
    again from the differences.
    """
    label, least = np.zeros(len(x), np.int64), np.zeros(len(x))
    norm = (centres * centres).sum(1)
    step = max(1, CELLS // max(1, len(centres)))
    for a in range(0, len(x), step):
        some = x[a : a + step]
        with np.errstate(all="ignore"):
            value = norm - 2.0 * (some @ centres.T)
            bound = 1e-15 * (x.shape[1] + 4) * (norm + 2 * np.sqrt((some * some).sum(1))[:, None] * np.sqrt(norm))
            best = np.fmin.reduce(value + bound, axis=1)
            rows, at = np.nonzero(~(value - bound > best[:, None]))
            exact = np.empty(len(rows))
            few = max(1, CELLS // max(1, x.shape[1]))
            for b in range(0, len(rows), few):
                d = some[rows[b : b + few]] - centres[at[b : b + few]]
                exact[b : b + few] = (d * d).sum(1)
        exact = np.where(np.isnan(exact), np.inf, exact)
        low = np.minimum.reduceat(exact, np.searchsorted(rows, np.arange(len(some))))
        hit = np.flatnonzero(exact == low[rows])
        label[a : a + step], least[a : a + step] = at[hit[np.unique(rows[hit], return_index=True)[1]]], low
    return label, least


def _rows(x: Matrix) -> DataFrame:
    return x.source.select(POS, F.array(*[c.cast("double") for c in x.cells.values()]).alias("x"))


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


@dataclass
class KMeans:
    centroids: np.ndarray

    def _labelled(self, rows: DataFrame) -> DataFrame:
        """(``__pos``, x, label, d)."""
        centres = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    label, d = _nearest(_flat(b), centres)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label), pa.array(d)], [POS, "x", "label", "d"])

        return rows.mapInArrow(run, f"{POS} {dict(rows.dtypes)[POS]}, x array<double>, label long, d double")

    def predict(self, x: Matrix) -> DataFrame:
        """Ties go to the lower number."""
        return self._labelled(_rows(x)).select(POS, "label")

    def _step(self, rows: DataFrame, old: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Each centre's rows and the sum of their vectors, added up in tasks first, and how many rows changed since ``old``."""
        centres = self.centroids
        k, d = centres.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, moved = np.zeros(k, np.int64), np.zeros((k, d)), 0
            for b in batches:
                if b.num_rows:
                    v = _flat(b)
                    label, _ = _nearest(v, centres)
                    moved += b.num_rows if old is None else int((_nearest(v, old)[0] != label).sum())
                    n += np.bincount(label, minlength=k)
                    np.add.at(total, label, v)
            used = np.flatnonzero(n)
            change = np.zeros(len(used), np.int64)
            change[:1] = moved
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(change), pa.array([t.tobytes() for t in total[used]], pa.binary())], ["label", "n", "moved", "t"])

        def add(t: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(v.as_buffer()) for v in t.column("t")], axis=0)
            first = lambda c: [sum(t.column(c).to_pylist())]
            return pa.table({"label": t.column("label")[:1], "n": pa.array(first("n"), pa.int64()), "moved": pa.array(first("moved"), pa.int64()), "t": pa.array([total.tobytes()], pa.binary())})

        schema = "label long, n long, moved long, t binary"
        n, total, moved = np.zeros(k, np.int64), np.zeros((k, d)), 0
        for r in rows.mapInArrow(run, schema).groupBy("label").applyInArrow(add, schema).collect():
            n[r["label"]], total[r["label"]] = r["n"], np.frombuffer(r["t"])
            moved += r["moved"]
        return n, total, moved

    @classmethod
    def fit(cls, x: Matrix, k: int, max_iter: int = 100, tol: float = 1e-4, init: np.ndarray | None = None, seed: int = 0) -> tuple[KMeans, DataFrame]:
        """The model and the labels (``__pos``, ``label``) assigned before the last move of the centroids.

        ``init``: first centroids; else the mean for k = 1, or k distinct rows drawn by seed.
        """
        m = x.rows()
        if not 0 < k <= m:
            raise ValueError(f"{k} clusters of {m} rows")
        rows = _rows(x)
        data = rows.cache()
        if init is not None:
            cent = np.array(init, float)
        elif k == 1:
            n, total, _ = cls(np.zeros((1, x.cols)))._step(data, None)
            cent = total / n[0]
        else:
            cent = np.array([r["x"] for r in data.orderBy(F.xxhash64(F.lit(seed), POS), POS).limit(k).collect()], float)
        model, old, before = cls(cent), None, cls(cent)
        for _ in range(max_iter):
            before = cls(model.centroids.copy())
            n, total, moved = before._step(data, old)
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], model.centroids)
            empty = np.flatnonzero(n == 0).tolist()
            if empty:  # each takes the farthest point that no other empty cluster has taken
                far = before._labelled(data).orderBy(F.desc("d"), POS).limit(len(empty)).collect()
                for i, r in zip(empty, far, strict=True):
                    new[i] = r["x"]
            shift = float(np.sqrt(((new - model.centroids) ** 2).sum(1)).max())
            model = cls(new)
            if old is not None and not moved:
                break
            if tol > 0 and shift < tol:
                break
            old = before.centroids
        data.unpersist()
        return model, before._labelled(rows).select(POS, "label")


@dataclass
class GaussianNB:
    """Classes in ascending order, their priors, means and (smoothed) variances."""

    smoothing: float = 1e-9
    unbiased: bool = False
    classes: list[float] = field(default_factory=list)
    priors: np.ndarray | None = None
    means: np.ndarray | None = None
    variances: np.ndarray | None = None

    def fit(self, x: Matrix, label: Column) -> GaussianNB:
        # Grouped by the label's text, which tells 0.0 from -0.0.
        data = x.source.select(label.cast("string").alias("k"), label.cast("double").alias("y"), F.array(*[c.cast("double") for c in x.cells.values()]).alias("x"))

        def merged(known: tuple | None, n: int, mean: np.ndarray, m2: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
            if known is None:
                return n, mean, m2
            d, all_ = mean - known[1], known[0] + n
            return all_, known[1] + d * (n / all_), known[2] + m2 + d * d * (known[0] * n / all_)

        def emit(found: dict, ys: dict) -> dict[str, pa.Array]:
            return {"k": pa.array(list(found), pa.string()), "y": pa.array([ys[k] for k in found], pa.float64()), "n": pa.array([f[0] for f in found.values()], pa.int64()), "mean": pa.array([f[1].tobytes() for f in found.values()], pa.binary()), "m2": pa.array([f[2].tobytes() for f in found.values()], pa.binary())}

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, ys = {}, {}
            for b in batches:
                if not b.num_rows:
                    continue
                code = b.column("k").dictionary_encode()
                at, names = np.asarray(code.indices.fill_null(-1)), code.dictionary.to_pylist()
                if (at < 0).any():
                    raise ValueError("a null label")
                by = np.argsort(at, kind="stable")
                v, at = _flat(b)[by], at[by]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                n = np.diff(np.append(first, len(at)))
                mean = np.add.reduceat(v, first) / n[:, None]
                m2 = np.add.reduceat((v - np.repeat(mean, n, 0)) ** 2, first)
                y = np.asarray(b.column("y"))[by][first]
                for i, c in enumerate(at[first].tolist()):
                    k = names[c]
                    ys[k] = float(y[i])
                    found[k] = merged(found.get(k), int(n[i]), mean[i], m2[i])
            yield pa.RecordBatch.from_pydict(emit(found, ys))

        def together(t: pa.Table) -> pa.Table:
            known = None
            for n, mean, m2 in zip(t.column("n").to_pylist(), t.column("mean"), t.column("m2"), strict=True):
                known = merged(known, n, np.frombuffer(mean.as_buffer()), np.frombuffer(m2.as_buffer()))
            k = t.column("k")[0].as_py()
            return pa.table(emit({k: known}, {k: t.column("y")[0].as_py()}))

        schema = "k string, y double, n long, mean binary, m2 binary"
        per = data.mapInArrow(add, schema).groupBy("k").applyInArrow(together, schema).limit(MOST_CLASSES + 1).collect()
        if not per:
            raise ValueError("no rows to fit")
        if len(per) > MOST_CLASSES:
            raise ValueError(f"over {MOST_CLASSES} distinct labels")
        per = sorted(per, key=lambda r: (float(r["y"]), r["k"] != "-0.0"))
        n = np.array([r["n"] for r in per], float)
        means, m2 = (np.array([np.frombuffer(r[c]) for r in per]) for c in ("mean", "m2"))
        overall = n @ means / n.sum()
        eps = self.smoothing * float(((m2.sum(0) + n @ (means - overall) ** 2) / n.sum()).max())
        self.classes = [float(r["y"]) for r in per]
        self.priors, self.means = n / n.sum(), means
        v = m2 / n[:, None] if not self.unbiased else np.where(n[:, None] > 1, m2 / np.maximum(n - 1, 1)[:, None], 0.0)
        self.variances = np.where(v + eps <= 0, eps, v + eps)
        return self

    def _best(self, x: np.ndarray) -> np.ndarray:
        """Each row's class number: the highest score; ties and NaN go to the lower class.

        Two matrix products give all scores with a bound on their rounding error; those that may be the highest are computed
        again from the differences.
        """
        out = np.zeros(len(x), np.int64)
        m, v = self.means, self.variances
        with np.errstate(all="ignore"):
            base = np.log(self.priors) - 0.5 * np.log(2 * np.pi * v).sum(1)
            share, pull, own = 1.0 / v, m / v, (m * m / v).sum(1)
            step, few = max(1, CELLS // len(m)), max(1, CELLS // max(1, x.shape[1]))
            for a in range(0, len(x), step):
                some = x[a : a + step]
                squares, cross = (some * some) @ share.T, some @ pull.T
                score = base - 0.5 * (squares - 2 * cross + own)
                bound = 1e-15 * (x.shape[1] + 8) * (np.abs(base) + squares + 2 * np.abs(some) @ np.abs(pull).T + own)
                best = np.fmax.reduce(score - bound, axis=1)
                rows, at = np.nonzero(~(score + bound < best[:, None]))
                exact = np.empty(len(rows))
                for b in range(0, len(rows), few):
                    d = some[rows[b : b + few]] - m[at[b : b + few]]
                    exact[b : b + few] = base[at[b : b + few]] + (-0.5 * d * d / v[at[b : b + few]]).sum(1)
                exact = np.where(np.isnan(exact), -np.inf, exact)
                high = np.maximum.reduceat(exact, np.searchsorted(rows, np.arange(len(some))))
                hit = np.flatnonzero(exact == high[rows])
                out[a : a + step] = at[hit[np.unique(rows[hit], return_index=True)[1]]]
        return out

    def predict(self, x: Matrix) -> DataFrame:
        """Ties and NaN go to the lower class."""
        classes, rows = np.array(self.classes), _rows(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes[self._best(_flat(b))])], [POS, "label"])

        return rows.mapInArrow(run, f"{POS} {dict(rows.dtypes)[POS]}, label double")


_ACT = {"relu": (lambda z: np.where(z > 0, z, 0.0), lambda z: np.where(z > 0, 1.0, 0.0)), "sigmoid": (lambda z: 1 / (1 + np.exp(-z)), lambda z: (1 / (1 + np.exp(-z))) * (1 - 1 / (1 + np.exp(-z)))), "tanh": (np.tanh, lambda z: 1 - np.tanh(z) ** 2)}


def init_limit(kind: str, inputs: int, outputs: int, limit: float = 0.5) -> float:
    """First weights are uniform between minus this and this."""
    return {"uniform": limit, "xavier": np.sqrt(6 / (inputs + outputs)), "he": np.sqrt(2 / inputs)}[kind]


def loss_gradient(kind: str, got: np.ndarray, want: np.ndarray, rows: float | None = None) -> np.ndarray:
    """``mse``, or ``bce`` with respect to the input of a sigmoid; both divided by the rows."""
    return (2.0 if kind == "mse" else 1.0) * (got - want) / (rows or len(got))


@dataclass
class DenseNN:
    """Fully connected layers trained on the full batch.

    Two properties are kept on purpose: weight gradients are divided by the rows once more after the loss gradient was,
    and errors go back through weights that are updated already.
    """

    sizes: list[int]
    activations: list[str]
    init: str = "xavier"
    limit: float = 0.5
    loss: str = "mse"
    rate: float = 0.1
    epochs: int = 100
    seed: int = 0
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        if len(self.activations) != len(self.sizes) - 1:
            raise ValueError("the activations' count differs from the layers'")
        rng = np.random.default_rng(self.seed)
        for a, b in zip(self.sizes[:-1], self.sizes[1:], strict=True):
            lim = init_limit(self.init, a, b, self.limit)
            self.weights.append(rng.uniform(-lim, lim, (a, b)))
            self.biases.append(np.zeros(b))

    def forward(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        outs, zs = [x], []
        for w, b, act in zip(self.weights, self.biases, self.activations, strict=True):
            zs.append(outs[-1] @ w + b)
            outs.append(_ACT[act][0](zs[-1]))
        return outs, zs

    def step(self, x: np.ndarray, y: np.ndarray, rows: float | None = None, total: Callable[[np.ndarray], np.ndarray] = lambda g: g) -> None:
        """One epoch on data in memory: all of it, or a share of ``rows`` whose gradients ``total`` adds up."""
        m = rows or len(x)
        with np.errstate(over="ignore"):
            outs, zs = self.forward(x)
            delta = loss_gradient(self.loss, outs[-1], y, m)
            if self.loss != "bce":
                delta = delta * _ACT[self.activations[-1]][1](zs[-1])
            for i in range(len(self.weights) - 1, -1, -1):
                g = total(np.vstack((outs[i].T @ delta, delta.sum(0, keepdims=True)))) / m
                self.weights[i] = self.weights[i] - self.rate * g[:-1]
                self.biases[i] = self.biases[i] - self.rate * g[-1]
                if i:
                    delta = (delta @ self.weights[i].T) * _ACT[self.activations[i - 1]][1](zs[i - 1])

    def train(self, x: Matrix, y: list[Column], held: bool = True) -> DenseNN:
        data = x.source.select(F.array(*[c.cast("double") for c in x.cells.values()]).alias("x"), F.array(*[c.cast("double") for c in y]).alias("y"))
        if held:
            layers = len(self.weights)
            found = _together(data, x.cols, self._epochs, len(y))
            self.weights, self.biases = found[:layers], found[layers:]
            return self
        m = data.count()
        for _ in range(self.epochs):
            self._distributed_step(data, m, len(y))
        return self

    def _epochs(self, x: np.ndarray, y: np.ndarray, total: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
        """All epochs on a task's rows; gradients of a layer are added up before it is updated, and the next one's follow."""
        net = DenseNN(self.sizes, self.activations, self.init, self.limit, self.loss, self.rate, self.epochs, self.seed)
        net.weights, net.biases = list(self.weights), list(self.biases)
        m = total(np.array([float(len(x))]))[0]
        for _ in range(self.epochs):
            net.step(x, y, m, total)
        return [*net.weights, *net.biases]

    def _distributed_step(self, data: DataFrame, m: int, outputs: int) -> None:
        """One epoch: a job for each layer, as a layer's errors pass through the updated weights of the next."""
        forward = ([w.copy() for w in self.weights], [b.copy() for b in self.biases])
        for i in range(len(self.weights) - 1, -1, -1):
            updated = [w.copy() for w in self.weights]

            def gradient(a: np.ndarray, t: np.ndarray, i: int = i, updated: list[np.ndarray] = updated) -> np.ndarray:
                outs, zs = [a], []
                for w, b, act in zip(*forward, self.activations, strict=True):
                    zs.append(outs[-1] @ w + b)
                    outs.append(_ACT[act][0](zs[-1]))
                delta = (2.0 if self.loss == "mse" else 1.0) * (outs[-1] - t) / m
                if self.loss != "bce":
                    delta = delta * _ACT[self.activations[-1]][1](zs[-1])
                for k in range(len(updated) - 1, i, -1):
                    delta = (delta @ updated[k].T) * _ACT[self.activations[k - 1]][1](zs[k - 1])
                return np.concatenate(((outs[i].T @ delta).ravel(), delta.sum(0)))

            g = _summed(data, gradient, outputs) / m
            n = self.weights[i].size
            self.weights[i] = self.weights[i] - self.rate * g[:n].reshape(self.weights[i].shape)
            self.biases[i] = self.biases[i] - self.rate * g[n:]

    def predict(self, x: Matrix) -> DataFrame:
        """(``__pos``, ``value``): the output layer as an array."""
        data = x.source.select(POS, F.array(*[c.cast("double") for c in x.cells.values()]).alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a = np.asarray(b.column("x").flatten(), np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, self.sizes[0]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(self.forward(a)[0][-1].tolist(), pa.list_(pa.float64()))], [POS, "value"])

        return data.mapInArrow(run, f"{POS} long, value array<double>")

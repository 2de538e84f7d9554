"""Vector codes: each vector cut into parts, each part coded by its nearest entry of a trained codebook, exactly.

Components become whole numbers, floor(scale * x), so that sums, means and distances are exact and a rerun, a lost
executor or another cut of the table changes nothing.  Each round assigns every part to its nearest entry and replaces
each entry by the floored mean of its parts; Spark adds up each task's sums by part and entry.

Assignment.  A float32 matrix product gives ``|c|^2 - 2 x.c`` for all entries at once.  Its rounding error is at most
``gamma * |x| * |c|`` with ``gamma = k u / (1 - k u)`` for k roundings of u = 2^-24 (each product and sum, and the rounding of
both factors; in any order of summing), so each entry has an interval that holds its true value.  Every entry whose
interval overlaps the best one is computed again in int64, and the smallest distance wins, ties to the lower index.

What bounds a task's memory: codebooks (``entries`` times a vector) travel with the code; a batch is screened ``BLOCK`` rows at a
time and recomputed ``CELLS`` numbers at a time.  A task sends one row for each part and entry, and the codebooks, of fixed size,
are all that comes to the driver, with the first ``entries`` vectors.  Errors by label are pre-aggregated in Spark; the totals are
broadcast up to ``BROADCAST_LABELS`` labels, beyond that both sides are shuffled, with each label's rows dealt to ``SALTS`` keys.

Defined cases.  Vectors that are null or empty, or hold null or non-finite components, give no row; a zero vector does.
Vectors of another length than most (of equally many, the smaller) give none either.  Where the length is no multiple
of the parts, the first parts have a component more.  Fewer vectors than ``entries`` make a smaller codebook.  Null ids
come last, ties in id go by the vector, and repeated rows are each coded.  Vectors whose sums or squares int64 does not
hold are computed in Python's whole numbers throughout; an error beyond 64 bits is then null.  An empty table gives no
rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep

#: Rows screened at a time, and numbers recomputed at a time.
BLOCK, CELLS = 2048, 1 << 21
#: Totals of so many labels (some 30 bytes each) are broadcast.
BROADCAST_LABELS = 200_000
SALTS = 32
_EXACT = 1 << 62


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest row of ``book``, and the squared distance; both hold whole numbers."""
    at, error = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    k, width = book.shape
    with np.errstate(over="ignore", invalid="ignore"):
        c32, c64 = book.astype(np.float32), book.astype(np.float64)
        squares = (c64 * c64).sum(1)
        norms = np.sqrt(squares)
        u = 2.0**-24
        roundings = (width + 4) * u
        gamma = roundings / (1 - roundings)
        for a in range(0, len(x), BLOCK):
            some = x[a : a + BLOCK]
            x64 = some.astype(np.float64)
            dots = (some.astype(np.float32) @ c32.T).astype(np.float64)
            # The last term covers the roundings in double precision of what is around the product.
            bound = 2.0 * gamma * np.sqrt((x64 * x64).sum(1))[:, None] * norms * (1 + 1e-6) + 1e-12 * (squares + np.abs(dots))
            value = squares - 2.0 * dots
            best = np.fmin.reduce(value + bound, axis=1)
            rows, entry = np.nonzero(~(value - bound > best[:, None]))  # not comparable counts as overlapping
            exact = np.empty(len(rows), x.dtype)
            step = max(1, CELLS // max(width, 1))
            for s in range(0, len(rows), step):
                d = some[rows[s : s + step]] - book[entry[s : s + step]]
                exact[s : s + step] = (d * d).sum(1)
            first = np.searchsorted(rows, np.arange(len(some)))
            least = np.minimum.reduceat(exact, first)
            hit = np.flatnonzero(exact == least[rows])
            won = hit[np.unique(rows[hit], return_index=True)[1]]
            at[a : a + BLOCK], error[a : a + BLOCK] = entry[won], least
    return at, error


def _whole(batch: pa.RecordBatch, kind: type, scale: int) -> np.ndarray:
    """The batch's vectors as whole numbers, floor(scale * x)."""
    x = np.asarray(batch.column("_v").flatten(), np.float64).reshape(batch.num_rows, -1)
    if kind is object:
        from fractions import Fraction

        return np.array([[int((Fraction(v) * scale).__floor__()) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return np.floor(x * scale).astype(np.int64)


def _cuts(width: int, parts: int) -> list[int]:
    return [0, *np.cumsum([width // parts + (i < width % parts) for i in range(parts)]).tolist()]


class Codebooks:
    """For each part its entries, whole numbers, and how vectors are read."""

    def __init__(self, books: list[np.ndarray], scale: int, kind: type) -> None:
        self.books, self.scale, self.kind = books, scale, kind
        self.cuts = [0, *np.cumsum([b.shape[1] for b in books]).tolist()]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x parts) of entries and of squared distances."""
        found = [nearest(x[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """``vectors`` with ``_v``, the vector in doubles; only rows that take part."""
    v, inf = F.col(f"`{vec}`").cast("array<double>"), F.lit(float("inf"))
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    rows = vectors.withColumn("_v", v).where(fine)
    lengths = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("_v") == (lengths[0]["d"] if lengths else 0))


def train(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of ``rows`` (``_id``, ``_v``), starting from the vectors of the smallest ids."""
    n, most, width = rows.agg(F.count("*"), F.max(F.array_max(F.transform("_v", F.abs))), F.max(F.size("_v"))).first()
    if not n:
        return None
    size = int(most) * scale + scale + 1
    kind = np.int64 if (2 * size) ** 2 * width < _EXACT and size * n < _EXACT else object
    # The bound on ids is found on ids alone, so that no task sends whole vectors to find it.
    ids = rows.select("_id").orderBy(F.asc_nulls_last("_id")).limit(entries).collect()
    few = rows if any(r[0] is None for r in ids) else rows.where(F.col("_id") <= max(r[0] for r in ids))
    start = few.select("_v", "_id").orderBy(F.asc_nulls_last("_id"), "_v").limit(entries).select("_v").toArrow().combine_chunks().to_batches()
    first = np.concatenate([_whole(b, kind, scale) for b in start])
    cuts = _cuts(width, parts)
    books = Codebooks([first[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], scale, kind)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries replaced by the floored means of the parts assigned to them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, books.kind) for b in books.books]
        count = [np.zeros(len(b), np.int64) for b in books.books]
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch, books.kind, books.scale)
                at, _ = books.assign(x)
                for p, (a, b) in enumerate(zip(books.cuts[:-1], books.cuts[1:], strict=True)):
                    np.add.at(total[p], at[:, p], x[:, a:b])
                    count[p] += np.bincount(at[:, p], minlength=len(count[p]))
        for p, (t, c) in enumerate(zip(total, count, strict=True)):
            used = np.flatnonzero(c)
            values = [[str(int(v)) for v in r] for r in t[used].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(c[used]), pa.array(values, pa.list_(pa.string()))], ["p", "e", "n", "t"])

    def merged(table: pa.Table) -> pa.Table:
        t = np.array([[int(v) for v in r] for r in table.column("t").to_pylist()], object).sum(0)
        n = sum(table.column("n").to_pylist())
        return pa.table({"p": table.column("p")[:1], "e": table.column("e")[:1], "m": pa.array([[str(v // n) for v in t.tolist()]], pa.list_(pa.string()))})

    means = rows.select("_v").mapInArrow(sums, "p int, e int, n long, t array<string>").groupBy("p", "e").applyInArrow(merged, "p int, e int, m array<string>").collect()
    new = [b.copy() for b in books.books]
    for r in means:
        new[r["p"]][r["e"]] = [int(v) for v in r["m"]]
    return Codebooks(new, books.scale, books.kind)


def encode(rows: DataFrame, books: Codebooks, keys: str) -> DataFrame:
    """``keys`` (DDL of the columns of ``rows`` but ``_v``) with ``code``, two hex digits a part, and ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, error = books.assign(_whole(batch, books.kind, books.scale)) if batch.num_rows else (np.zeros((0, 1), int), np.zeros((0, 1), int))
            codes = [bytes(r).hex() for r in at.tolist()]
            errors = [int(e) for e in error.sum(1).tolist()]
            errors = pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "_v"), pa.array(codes, pa.string()), errors], [*(c for c in batch.schema.names if c != "_v"), "code", "error"])

    return rows.mapInArrow(run, f"{keys}, code string, error long")


def compress(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """A row for each usable vector: ``key``, code, error, label_error (summed over its label) and codebooks_sha256."""
    if entries > 256:
        raise ValueError("an entry's index takes two hex digits: 256 entries at most")
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    rows = usable(vectors.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{label}`").alias("_label"), F.col(f"`{vec}`").alias("_raw")), "_raw").select("_id", "_label", "_v")
    books = train(rows, parts, entries, rounds, scale)
    if books is None:
        coded = rows.select("_id", "_label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = keep(encode(rows, books, f"_id {kinds[key]}, _label {kinds[label]}"), "codes")
    total = F.try_sum(F.col("error")).alias("label_error")
    totals = keep(coded.groupBy("_label").agg(total), "label-errors")
    if totals.count() <= BROADCAST_LABELS:
        same, right = F.col("_label").eqNullSafe(F.col("_of")), F.broadcast(totals.select(F.col("_label").alias("_of"), "label_error"))
        both = coded.join(right, same)
    else:
        salted = coded.withColumn("_salt", F.pmod(F.xxhash64("_id", "code"), F.lit(SALTS)).cast("int"))
        right = totals.select(F.col("_label").alias("_of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        both = salted.join(right, F.col("_label").eqNullSafe(F.col("_of")) & (salted["_salt"] == right["_salt"]))
    return both.select(F.col("_id").alias(key), "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))



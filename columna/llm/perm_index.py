"""Approximate nearest neighbours by a permutation index, for the largest inner product.

Every vector is represented by its ``prefix`` nearest pivots in order.  Pivots come from a bounded
sample (four times ``pivots`` rows), of which those near another are left out.  As nearness is the inner product,
vectors get one more component that makes all lengths equal to the largest, and queries a zero there; then nearest
pivots, and nearest vectors, are those of the largest inner product.  Each pivot's inverted file posts the vectors
that have it in their prefix, with the place.  A query reads the files of its own prefix and adds up, for each vector
met, what their footrule distance falls short of its largest value; vectors that reach the query's least sum are
reranked by exact inner products in double precision.

How much is reranked follows from the data (:func:`plan`): ``asked`` vectors of a sample of ``trial`` rows are searched
for in the others by brute force, and the share of the sample that lies as near by footrule as their true neighbours
is taken at the quantile ``recall``.  Each query's least sum is what that share of the sample reaches; over a share of
``scan`` every vector is reranked, which is exact.

The index is cut by vectors into shards by their first pivot: small cells share a shard, large ones are split by hash.
A query goes only to the shards of its own first pivots, as many as hold nearly all true neighbours of the trial.
Shards and blocks of queries of about ``block_bytes`` bytes each bound what a task holds.  Every vector is indexed, at
any size of the table.  Queries that found fewer than k so, though there are more, go to every shard and rerank all.

Defined cases.  Vectors that are null, zero, or hold null or non-finite components, or are not of the
commonest length, take no part, nor do rows without vec_id.  Rows of one vec_id are vectors, and queries, of their
own; a query's candidates are all other rows.  Equal scores are ranked by vec_id.  A query with fewer candidates gets
all of them.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, release
from .vectors import marked, matrix, sample


def apart(points: np.ndarray, most: int, nearest: float = 0.8) -> np.ndarray:
    """The first ``most`` rows with a cosine of ``nearest`` or less to all taken before.

    Copies among the pivots would fill the prefixes of what lies near them and say nothing.
    """
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    taken: list[int] = []
    for i in range(len(unit)):
        if len(taken) == most:
            break
        if not taken or float((unit[taken] @ unit[i]).max()) <= nearest:
            taken.append(i)
    return points[taken]


@dataclass
class Files:
    """Inverted files of vectors' prefixes: for each pivot the vectors that have it, and at which place."""

    n: int
    prefix: int
    ends: np.ndarray
    rows: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, posted: np.ndarray, pivots: int) -> Files:
        n, prefix = posted.shape
        flat = posted.ravel()
        by = np.argsort(flat, kind="stable")
        return cls(n, prefix, np.searchsorted(flat[by], np.arange(pivots + 1)), by // prefix, (by % prefix).astype(np.int32))

    def sums(self, asked: np.ndarray) -> np.ndarray:
        """What each vector's footrule distance to the prefix ``asked`` falls short of the largest."""
        near = np.zeros(self.n, np.int32)
        for i, p in enumerate(asked.tolist()):
            s = slice(self.ends[p], self.ends[p + 1])
            near[self.rows[s]] += self.prefix - np.maximum(self.places[s], i)
        return near


@dataclass
class Index:
    """Pivots (with their added component), the largest length, and what :func:`plan` found."""

    pivots: np.ndarray
    top: float
    prefix: int
    share: float = 1.0
    route: int = 0
    trial: Files | None = None
    #: By which vectors are multiplied, a power of two, so that squares of their components are finite.
    scale: float = 1.0

    def represent(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes of the rows as data and, with a zero in the added component, as queries (all their pivots)."""
        x = x * self.scale
        base = x @ self.pivots[:, :-1].T
        near = base + np.sqrt(np.maximum(self.top * self.top - (x * x).sum(1), 0))[:, None] * self.pivots[None, :, -1]
        return tuple(np.argsort(-a, axis=1, kind="stable").astype(np.uint16) for a in (near, base))

    def least(self, asked: np.ndarray) -> int:
        """The sum that the query's share of the trial reaches."""
        if self.trial is None:
            return 0
        sums = self.trial.sums(asked[: self.prefix])
        at = min(len(sums) - 1, int(np.ceil(self.share * len(sums))))
        return int(np.partition(sums, len(sums) - 1 - at)[len(sums) - 1 - at])


def plan(index: Index, x: np.ndarray, k: int, recall: float, scan: float, asked: int = 128) -> Index:
    """``index`` with the share to rerank and the first pivots to follow, measured on the sample ``x``."""
    data, query = index.represent(x)
    files = Files.of(data[:, : index.prefix], len(index.pivots))
    place = np.empty((len(index.pivots),), np.int64)
    shares, routes = [], []
    for i in range(min(asked, len(x))):
        score = x @ x[i]
        score[i] = -np.inf
        true = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        sums = files.sums(query[i, : index.prefix])
        shares.extend((sums[None, :] >= sums[true, None]).sum(1) / len(x))
        place[query[i]] = np.arange(len(place))
        routes.extend((place[data[true, 0]] + 1).tolist())
    share = float(np.quantile(shares, recall)) if shares else 1.0
    route = int(np.quantile(routes, (1 + recall) / 2, method="higher")) if routes else len(index.pivots)
    if share > scan or len(x) - 1 <= k:
        return Index(index.pivots, index.top, index.prefix, 1.0, len(index.pivots), None)
    return Index(index.pivots, index.top, index.prefix, share, route, files)


def shard_cells(counts: dict[int, int], pivots: int, rows: int) -> tuple[list[int], list[int], int]:
    """For each cell its first shard and how many it is split into, and the shards in all; about ``rows`` a shard."""
    first, split, shard, held = [0] * pivots, [1] * pivots, 0, 0
    for c in range(pivots):
        n = counts.get(c, 0)
        if n > rows:
            if held:
                shard, held = shard + 1, 0
            first[c], split[c] = shard, -(-n // rows)
            shard += split[c]
        else:
            if held and held + n > rows:
                shard, held = shard + 1, 0
            first[c] = shard
            held += n
    return first, split, max(1, shard + bool(held))


def _represent(index: Index):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                x, asks = matrix(b.column("_v")), np.asarray(b.column("_query"))
                data, query = index.represent(x)
                least = [index.least(query[i]) if asks[i] else 0 for i in range(len(x))]
                blobs = [pa.array([v.tobytes() for v in a], pa.binary()) for a in (x, data[:, : index.prefix], query[:, : index.prefix])]
                cells = pa.array([q[: index.route].astype(np.int32) if a else None for q, a in zip(query, asks, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("_query"), *blobs, pa.array(data[:, 0].astype(np.int32)), cells, pa.array(least, pa.int32())], ["row", "vec_id", "is_query", "vector", "posted", "asked", "cell", "cells", "least"])

    return run


def _search(k: int, pivots: int):
    def run(table: pa.Table) -> pa.Table:
        role, ids, own = (np.asarray(table.column(c)) for c in ("role", "vec_id", "row"))
        least = np.asarray(table.column("least"))
        take = lambda name, rows, kind: np.frombuffer(b"".join(table.column(name).take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), -1)
        data, asks = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        if len(data) and len(asks):
            x, q = take("vector", data, np.float64), take("vector", asks, np.float64)
            files, asked = Files.of(take("perm", data, np.uint16), pivots), take("perm", asks, np.uint16)
            xid, xrow = ids[data], own[data]
            for j, a in enumerate(asks.tolist()):
                found = np.flatnonzero(files.sums(asked[j]) >= least[a]) if least[a] else np.arange(len(data))
                found = found[xrow[found] != own[a]]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = (x[found] * q[j]).sum(1)  # row by row, so that equal vectors have equal scores
                order = np.where(np.isnan(score), -np.inf, score)  # infinities of both signs come last
                if len(found) > k:
                    near = order >= np.partition(order, len(order) - k)[len(order) - k]
                    found, score, order = found[near], score[near], order[near]
                best = np.lexsort((xid[found], -order))[:k]
                out.append((np.full(len(best), own[a]), np.full(len(best), ids[a]), xid[found[best]], score[best]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(4)]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("row", "query_id", "vec_id"), cols, strict=False)} | {"score": pa.array(cols[3].astype(np.float64))})

    return run


def permutation_search(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 256, prefix: int = 64, recall: float = 0.98, scan: float = 0.6, trial: int = 4096, block_bytes: int = 4_000_000, query_bytes: int = 16_000_000, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of the other rows. See the module's text."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    rows = marked(rows).where("_v is not null").select(F.monotonically_increasing_id().alias("row"), "vec_id", "_v", F.coalesce(is_query, F.lit(False)).alias("_query"))
    rows = keep(rows, "vectors")
    n, asks, d, big = rows.agg(F.count("*"), F.count_if("_query"), F.max(F.size("_v")), F.max(F.array_max(F.transform("_v", F.abs)))).first()
    if not asks or n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Products of components up to 1 are safe; scores are computed from the vectors as they are.
    scale = 2.0 ** -min(1000, max(-1000, int(np.frexp(big)[1])))
    squares = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x * F.lit(scale)) * (x * F.lit(scale)))
    top = rows.agg(F.max(F.sqrt(squares))).first()[0]
    few = sample(rows, "vec_id", max(trial, 4 * pivots), seed, n) * scale
    piv = apart(few[: 4 * pivots], pivots)
    piv = np.hstack([piv, np.sqrt(np.maximum(top * top - (piv * piv).sum(1), 0))[:, None]])
    index = plan(Index(piv, top, min(prefix, len(piv))), few[:trial], k, recall, scan)
    index.scale = scale
    made = keep(rows.mapInArrow(_represent(index), "row long, vec_id long, is_query boolean, vector binary, posted binary, asked binary, cell int, cells array<int>, least int"), "permutations")
    release(rows)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, min(block_bytes // (8 * d), max(2048, -(-n // tasks))))
    first, split, shards = shard_cells({r["cell"]: r["count"] for r in made.groupBy("cell").count().collect()}, len(piv), each)
    begins, widths = F.array(*map(F.lit, first)), F.array(*map(F.lit, split))
    spread = lambda c: F.get(begins, c) + F.pmod(F.xxhash64(F.lit(seed), "row"), F.get(widths, c)).cast("int")
    # Shards of the query's cells.
    goes = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.sequence(F.get(begins, c), F.get(begins, c) + F.get(widths, c) - 1))))
    cols = ["shard", "block", "role", "row", "vec_id", "vector", "perm", "least"]

    def search(queries: DataFrame, count: int, goes: Column, least: Column) -> DataFrame:
        blocks = -(-count // max(1, query_bytes // (8 * d)))
        block = F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.lit(blocks))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        asked = queries.select(F.explode(goes).alias("shard"), block.alias("block"), F.lit(1).alias("role"), "row", "vec_id", "vector", F.col("asked").alias("perm"), least.alias("least"))
        data = made.select(spread(F.col("cell")).alias("shard"), every.alias("block"), F.lit(0).alias("role"), "row", "vec_id", "vector", F.col("posted").alias("perm"), F.lit(0).alias("least"))
        groups = data.select(cols).unionAll(asked.select(cols)).repartition(min(max(tasks, shards), 100_000), "shard", "block").groupBy("shard", "block")
        found = groups.applyInArrow(_search(k, len(piv)), "row long, query_id long, vec_id long, score double")
        order = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc(order), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    found = keep(search(made.where("is_query"), asks, goes, F.col("least")), "nearest")
    full = found.where(F.col("rank") == min(k, n - 1)).select("row")
    short = keep(made.where("is_query").join(full, "row", "left_anti"), "short")
    if left := short.count():
        again = search(short, left, F.sequence(F.lit(0), F.lit(shards - 1)), F.lit(0))
        found = found.join(short.select("row"), "row", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")

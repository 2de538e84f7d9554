"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Codes.  Rotations that turn (unit) vectors into balanced binary codes are learned on a bounded sample
(``fit_rows`` rows) by iterative quantisation: signs, then the orthogonal rotation that fits them best, in
turns.  Each rotation gives as many bits as vectors have components; several, from different starts, give
``tables`` substrings of ``b`` bits, b about the binary logarithm of the rows.

Retrieval.  Each substring keys a Hamming table; vectors meet if a substring is equal, which codes within
``tables - 1`` bits of each other must have, and farther ones nearly always.  How many tables there are
follows from the data: sample vectors are turned by the threshold's angle, the bits that this changes are
counted, and there are as many tables as it takes for such a pair to share no substring with a probability
of ``miss`` at most (at cosine 0.98, where the mean is near zero, 32 tables of 16 bits).  Vectors that crowd
about their mean take more; beyond ``most_tables`` substrings get shorter instead.  Where four bits are too many, codes
tell nothing, and each label is one bucket, compared whole: that is exact.

Rerank.  Vectors that meet are compared by the cosine of the original vectors in double precision, once per
pair: only in the first table where their substrings are equal.  Equal vectors of a label are one class with
a number and a size; different vectors of one vec_id are different classes.  Within a task the links of each class are added up and only those that connect something new are
sent on, so no list of pairs leaves it.  Buckets of more than ``chunk`` classes are compared in blocks of two
chunks, in any number of tasks.

Defined cases.  Vectors that are null, zero or hold null or non-finite components, or are not of the commonest
length, and rows with a null label, link with nothing (n_links 0, own component).  A row without vec_id is
returned with null component and kept true.  Repeated rows are vectors of their own, linked with each other.
Components of any finite size count, as vectors are scaled by their largest one first.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Union, components, keep
from .vectors import marked, matrix, sample


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """The d x d matrix of iterative quantisation for unit rows ``x``: principal axes, then a learned rotation."""
    d = x.shape[1]
    axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(d))[1]
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds):
        signs = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(signs.T @ v)
        r = w.T @ u.T
    return axes @ r


def substrings(x: np.ndarray, rotation: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Each row's code cut into ``tables`` numbers of ``bits`` bits."""
    on = (x @ rotation >= 0)[:, : tables * bits].reshape(len(x), tables, bits)
    return (on * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def table_plan(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray, threshold: float, bits: int, miss: float, most_tables: int, seed: int) -> tuple[int, int]:
    """(tables, bits) that pairs at the threshold share no substring of with a probability of ``miss`` or less.

    ``x``: unit rows.  Each is turned by the threshold's angle in a random direction; the share of its code's
    bits that change says how often a substring stays.
    """
    noise = np.random.default_rng(seed).standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-300)
    turned = threshold * x + math.sqrt(1 - threshold * threshold) * noise
    stays = 1 - (((x - mean) @ rotation >= 0) != ((turned - mean) @ rotation >= 0)).mean(1)
    while True:
        apart = 1 - stays**bits
        for tables in range(1, most_tables + 1):
            if (apart**tables).mean() <= miss:
                return tables, bits
        if bits <= 4:
            return 1, 0
        bits -= 1


def _key_rows(rotation: np.ndarray, mean: np.ndarray, tables: int, bits: int, kind: type):
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("_v"))
            if not len(x):
                continue
            scale = np.abs(x).max(1, keepdims=True)
            unit = x / scale
            unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
            code = substrings(unit - mean, rotation, tables, bits).astype(np.int32)
            blob = pa.array([c.tobytes() for c in code.astype(_code_kind(bits))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("label"), batch.column("of"), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), blob, pa.array(code.tolist(), pa.list_(pa.int32()))], ["cls", "label", "of", "vector", "code", "subs"])

    return run


def _code_kind(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.int32


def _compare(threshold: float, tables: int, bits: int, kind: type):
    """Partial link counts and connecting links of the buckets in one group."""

    def run(t: pa.Table) -> pa.Table:
        key, side = np.asarray(t.column("bucket")), np.asarray(t.column("side"))
        cls, of, table = np.asarray(t.column("cls")), np.asarray(t.column("of")), np.asarray(t.column("t"))
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), _code_kind(bits)).reshape(len(cls), tables)
        x = np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(len(cls), -1).astype(np.float64)
        scale = np.abs(x).max(1, keepdims=True)
        unit = x / scale
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        out: tuple[list, list, list] = ([], [], [])
        by = np.lexsort((cls, key))
        for rows in np.split(by, np.flatnonzero(np.diff(key[by])) + 1):
            if len(rows) < 2:
                continue
            left, right = rows[side[rows] != 1], rows[side[rows] != 0]
            links, groups = np.zeros(len(rows), np.int64), Union(len(rows))
            place = {int(r): i for i, r in enumerate(rows)}
            lp, rp = np.array([place[int(r)] for r in left]), np.array([place[int(r)] for r in right])
            tt = int(table[rows[0]])
            for a in range(0, len(left), 512):
                li = left[a : a + 512]
                near = unit[li] @ unit[right].T >= threshold
                i, j = np.nonzero(near)
                both = (side[li[i]] == 2) & (side[right[j]] == 2)
                fine = (cls[li[i]] != cls[right[j]]) & (~both | (cls[li[i]] < cls[right[j]]))
                i, j = i[fine], j[fine]
                if tt and len(i):
                    first = ~(code[li[i], :tt] == code[right[j], :tt]).any(1)
                    i, j = i[first], j[first]
                pi, pj = lp[a + i], rp[j]
                np.add.at(links, pi, of[right[j]])
                np.add.at(links, pj, of[li[i]])
                for p, q in zip(pi.tolist(), pj.tolist(), strict=True):
                    if groups.sets == 1:
                        break
                    if groups.join(p, q):
                        out[0].append(int(cls[rows[p]]))
                        out[1].append(int(cls[rows[q]]))
                        out[2].append(0)
            some = np.flatnonzero(links)
            out[0].extend(cls[rows[some]].tolist())
            out[1].extend(cls[rows[some]].tolist())
            out[2].extend(links[some].tolist())
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip("abn", out, strict=True)})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-6, most_tables: int = 128, fit_rows: int = 8192, chunk: int = 2048, group_rows: int = 20_000, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: see the module's text."""
    # Floats travel as floats, which is half; they are widened before anything is computed.
    kind = np.float32 if vectors.select("embedding").dtypes[0][1] == "array<float>" else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.struct(F.col("label")).alias("label"))
    taken = F.col("vec_id").isNotNull() & F.col("label.label").isNotNull()
    rows = keep(marked(rows.withColumn("embedding", F.when(taken, F.col("embedding")))).drop("embedding"), "vectors")
    good = rows.where("_v is not null")
    classes = keep(good.groupBy("label", "_v").agg(F.min("vec_id").alias("first"), F.count("*").alias("of")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    spark = vectors.sparkSession
    links = spark.createDataFrame([], "a long, b long, n long")
    if n > 1:
        x = sample(classes, "first", fit_rows, seed, n)
        x = x / np.abs(x).max(1, keepdims=True)  # squares of tiny or huge components would vanish or overflow
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        mean = x.mean(0)
        d = x.shape[1]
        bits = max(8, min(24, math.ceil(math.log2(n))))
        rotations = [learn_rotation(x - mean, seed + i) for i in range(-(-256 // d))]
        tables, bits = table_plan(x, mean, np.hstack(rotations), threshold, bits, miss, most_tables, seed)
        rotations += [learn_rotation(x - mean, seed + i) for i in range(len(rotations), -(-tables * bits // d))]
        rotation = np.hstack(rotations)
        coded = keep(classes.mapInArrow(_key_rows(rotation, mean, tables, bits, kind), _coded_schema(classes)), "codes")
        keyed = coded.select("cls", "label", F.posexplode("subs").alias("t", "sub"))
        keyed = keyed.select("cls", "t", F.xxhash64("t", "sub", "label").alias("bucket"))
        counts = keyed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
        # Vectors travel only to buckets where they meet another.
        met = keyed.join(counts, "bucket").join(coded.select("cls", "of", "vector", "code"), "cls")
        groups = max(1, n * tables // group_rows)
        small = met.where(F.col("m") <= chunk).withColumns({"group": F.pmod(F.xxhash64("bucket", F.lit(1)), F.lit(groups)).cast("string"), "side": F.lit(2)})
        chunks = F.ceil(F.col("m") / chunk).cast("long")
        large = met.where(F.col("m") > chunk).withColumns({"chunks": chunks, "mine": F.pmod(F.xxhash64("cls"), chunks)})
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
        large = large.withColumns({"side": side, "group": F.concat_ws(":", "bucket", F.least("mine", "other"), F.greatest("mine", "other"))})
        cols = ["group", "bucket", "side", "cls", "of", "t", "vector", "code"]
        links = small.select(cols).unionAll(large.select(cols)).groupBy("group").applyInArrow(_compare(threshold, tables, bits, kind), "a long, b long, n long")
        links = keep(links, "links")
    found = components(links.where("n = 0").select("a", "b"))
    per = links.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    named = classes.select("cls", "first").join(found, F.col("cls") == found["node"]).select("node", "component", "first")
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    named = named.join(heads, "component").select("node", "head")
    info = classes.join(per, classes["cls"] == per["a"], "left").join(named, classes["cls"] == named["node"], "left")
    info = info.select("label", "_v", (F.coalesce("n", F.lit(0)) + F.col("of") - 1).alias("n_links"), F.coalesce("head", "first").alias("component_id"))
    linked = good.join(info, ["label", "_v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("_v is null")
    out = linked.unionAll(rest.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _coded_schema(classes: DataFrame):
    from pyspark.sql import types as T

    extra = [T.StructField("vector", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("subs", T.ArrayType(T.IntegerType()))]
    return T.StructType([classes.schema["cls"], classes.schema["label"], classes.schema["of"], *extra])

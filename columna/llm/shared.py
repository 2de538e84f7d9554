"""What several corpus operators share: durable tables, words of whole texts, components.

Durable tables.  :func:`keep` writes a DataFrame as Parquet below the folder that the session names in
``spark.checkpoint.dir`` and reads it back, so that the lineage is cut and a lost executor costs nothing
but its running tasks.  Only where that setting is missing, and Spark runs on this machine alone, a
temporary folder takes its place.

Words.  A word is a run of bytes other than space and ``\\x09-\\x0D`` of the UTF-8 text; ``A-Z`` are
lower-cased.  Words are hashed to 64 bits by tabulation, straight from Arrow's buffers.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
_U = np.uint64
_LOWER = bytes(range(256)).lower()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_TABLE = mix((np.arange(64 * 256, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; set for this session only where Spark is local and none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="columna-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def keep(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written to the shared folder, below the application's name, and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/columna/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _KEPT[id(back)] = (weakref.ref(back), path)
    return back


#: Where tables of :func:`keep` lie, while they are in use.
_KEPT: dict[int, tuple[weakref.ref, str]] = {}


def release(*kept: DataFrame) -> None:
    """Deletes tables of :func:`keep` that nothing reads any more; other DataFrames are passed over."""
    for df in kept:
        ref, path = _KEPT.get(id(df), (lambda: None, ""))
        if ref() is df:
            del _KEPT[id(df)]
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def give_back() -> None:
    """Memory that numpy and Arrow have freed goes back to the system: a Python worker outlives its task, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def giving_back(f: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    """``f(*tables)``, and :func:`give_back` when what it held is freed."""
    out = f(*tables)
    give_back()
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Copies of a row that are made in one go; beyond that they are dealt to all tasks.
COPY_RUN = 1 << 16


def counted(rows: DataFrame, count: str) -> DataFrame:
    """The distinct rows with their number as ``count``, pre-aggregated, so equal rows meet in no task."""
    return rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count("*").alias(count))


def each_copy(rows: DataFrame, count: str, number: str, most: int) -> DataFrame:
    """``rows``, each ``count`` times, with ``number`` (long, from 0) for ``count``; ``most``: the largest count."""
    runs = rows.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {COPY_RUN}"))))
    if most > COPY_RUN:
        runs = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.col(number) * COPY_RUN
    copies = F.explode(F.sequence(first, F.least(first + F.lit(COPY_RUN), F.col(count)) - 1))
    return runs.withColumn(number, copies).drop(count)


def pieces(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, pa.Array]]:
    """The column in runs of about ``most`` bytes; a longer text is a run of its own."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def word_bounds(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes run together, where each word starts in them, its length, and its row; null texts have none."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    none = np.zeros(0, np.int64)
    if texts.buffers()[2] is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), none, none, none
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = (data != 32) & (data - np.uint8(9) > 4)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # Words end with their text, too.
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] |= inside[begins]
    begins = begins[begins > 0]
    last[begins - 1] |= inside[begins - 1]
    begun = np.flatnonzero(first)
    lengths = np.flatnonzero(last) - begun + 1
    chars = np.frombuffer(data.tobytes().translate(_LOWER if lower else None, b" \t\n\v\f\r"), np.uint8)
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begun, ends)))
    if texts.null_count:
        valid = ~np.asarray(texts.is_null())
        if not valid[row].all():  # Arrow may leave bytes below a null
            live = valid[row]
            kept = np.repeat(live, lengths)
            chars, lengths, row = chars[kept], lengths[live], row[live]
    return chars, np.cumsum(lengths) - lengths, lengths, row


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each word's 64-bit hash and row, in order."""
    chars, starts, lengths, row = word_bounds(texts, lower)
    return hashes_of(chars, starts, lengths), row


def hashes_of(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hashes of words as :func:`word_bounds` gives them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums, cuts = np.empty(len(starts), np.uint64), np.searchsorted(starts, np.arange(0, len(chars), _HASHED)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        if a < b:
            sums[a:b] = _sums_of(chars[starts[a] : starts[b - 1] + lengths[b - 1]], lengths[a:b])
    long = np.flatnonzero(lengths > 64)
    if len(long):
        sums[long] = _long_sums(chars, starts[long], lengths[long])
    return mix(sums)


#: Bytes of words that are hashed in one go, so that their numbers stay near the processor.
_HASHED = 1 << 16


def _sums_of(chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What :func:`hashes_of` mixes, for words of up to 64 bytes that fill ``chars``; longer ones get no use from it."""
    # Each byte's number in the table: 256 more than that of the byte before, and from 0 again where a word starts.
    ends = np.cumsum(lengths)
    at = np.full(len(chars), 256, np.int64)
    at[0] = 0
    at[ends[:-1]] -= lengths[:-1] << 8
    np.cumsum(at, out=at)
    at |= chars
    sums = np.cumsum(_TABLE.take(at, mode="clip")).take(ends - 1)
    sums[1:] -= sums[:-1].copy()
    return sums + lengths.astype(np.uint64)


def _long_sums(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What :func:`hashes_of` mixes, for words of over 64 bytes."""
    begins = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(begins, lengths)
    value = _TABLE[((place & 63) << 8) | chars[place + np.repeat(starts, lengths)]]
    value *= (2 * (place >> 6) + 1).astype(np.uint64)
    return np.add.reduceat(value, begins) + lengths.astype(np.uint64)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles.

    A text of fewer than ``n`` words has its whole sequence as one; without words it has none.
    """
    out: list[np.ndarray] = []
    for _, part in pieces(texts):
        words, row = word_hashes(part)
        bounds = np.searchsorted(row, np.arange(len(part) + 1))
        with np.errstate(over="ignore"):
            acc = words.copy()
            for j in range(1, n):
                acc = mix(acc[:-1] * _U(0x9E3779B97F4A7C15) + words[j:]) if len(acc) > 1 else acc[:0]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= n:
                    s = np.sort(acc[a : b - n + 1])
                    out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
                elif b > a:
                    s = words[a : a + 1]
                    for j in range(a + 1, b):
                        s = mix(s * _U(0x9E3779B97F4A7C15) + words[j : j + 1])
                    out.append(mix(s + _U(b - a)))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out


#: Bits of :func:`seeded_bits`.
SEEDED_BITS = 52


def seeded_bits(seed: int, *key: Column) -> Column:
    """52 bits (long) from the MD5 of the seed and the key, which other engines have too."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("-")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


class Union:
    """Disjoint sets of 0..n-1; the smaller member is the root."""

    def __init__(self, n: int) -> None:
        self.up, self.sets = list(range(n)), n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.sets -= 1
        return True


#: Up to so many edges (16 bytes each) are solved in one task; their count is taken first.
ONE_TASK_EDGES = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars: (a, b) with b the smallest node that a reaches within the batch."""
    for batch in batches:
        ends = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))])
        nodes, back = np.unique(ends, return_inverse=True)
        groups = Union(len(nodes))
        for a, b in back.reshape(2, -1).T.tolist():
            groups.join(a, b)
        roots = np.array([groups.find(i) for i in range(len(nodes))], np.int64)
        leaf = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[roots[leaf]] if len(nodes) else nodes)], ["a", "b"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of the one partition as stars."""
    got = [b for b in batches if b.num_rows]
    if got:
        yield from _stars(iter(pa.Table.from_batches(got).combine_chunks().to_batches()))


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a long, b long) reaches.

    Each batch of edges is made stars where it lies.  Up to ``one_task`` distinct edges are then solved in one
    task.  More go through alternating large-star and small-star rounds: each groups by node for a minimum,
    which is pre-aggregated, and joins it back, which AQE splits where one node has many edges; rounds end when
    all stars are flat.  Rounds are kept as tables; nothing but two numbers a round comes to the driver.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    short = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_stars, "a long, b long")
    e = keep(short.distinct(), "edges")
    before = mark(e)
    if before[0] <= one_task:
        done = keep(e.coalesce(1).mapInArrow(_solve, "a long, b long"), "components")
        release(e)
        e = done
    else:
        for _ in range(most_rounds):
            both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a")
            last, e = e, small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
            e = keep(e.where("a <> b").distinct(), "edges")
            release(last)
            after = mark(e)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

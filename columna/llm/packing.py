"""Best-fit packing into bins of several permitted capacities.

Documents longer than the largest capacity are cut into pieces of it; no word is dropped.  Pieces are packed
longest first: each goes to the open bin that it leaves the least room in.  If none has room, a bin is opened
at the capacity of least cost, where a capacity's cost is what its words and its start cost for each word
that the bin is expected to hold: the piece, and the share of the remaining room that the pieces still to
come can fill.  At last each bin is cut down to the smallest capacity that holds its contents.

Packing is sequential, so pieces are dealt by hash (and, of equal rows, by their number, for which these are
counted first) into groups of about ``group_pieces`` and each group is packed alone; at most one badly filled bin of each capacity a group is lost by that.  :func:`packed_sequences` then
brings the words of each bin together: a row a bin, its pieces' texts in the order of their offsets.

Defined cases.  A text that is null or has no words gives one row with length 0 and no bin, and is in no sequence.
Rows of the same doc_id are documents of their own (dealt by their text's checksum too); rows equal in both are
alike, and their pieces are interchangeable.  Ties in length go by doc_id, checksum and piece.  Very long texts are
cut, and a task holds one of them.  An empty table gives no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, counted, each_copy, keep
from .sharding import starts

CAPACITIES = (256, 512, 1024, 2048)


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, start_cost: float = 16.0) -> tuple[list[int], list[int]]:
    """The bin of each size, and each bin's capacity. Sizes lie between 1 and the largest capacity."""
    caps = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = sum(sizes)  # words of pieces still to come
    room: list[tuple[int, int]] = []  # (room, bin) of open bins, sorted
    bins, held, given = [0] * len(sizes), [], []
    for i in order:
        s = sizes[i]
        left -= s
        at = bisect_left(room, (s, -1))
        if at < len(room):
            r, b = room.pop(at)
        else:
            # Later pieces are no longer than this one: they fill a room that holds several of them well,
            # a room smaller than the piece with the chance of its share.
            def cost(c: int, s: int = s) -> float:
                free = c - s
                fill = min(left, free * (free / (free + s / 2)) if free else 0)
                return (c + start_cost) / (s + fill)

            c = min((c for c in caps if c >= s), key=lambda c: (cost(c), c))
            b, r = len(given), c
            given.append(c)
            held.append(0)
        bins[i] = b
        held[b] += s
        if r - s:
            insort(room, (r - s, b))
    return bins, [caps[bisect_left(caps, h)] for h in held]


def _pack(capacities: tuple[int, ...], start_cost: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("crc", "ascending"), ("piece", "ascending")])
        length = np.asarray(table.column("length"))
        bins, caps = best_fit(length.tolist(), capacities, start_cost)
        where = np.array(bins, np.int64)
        by = np.argsort(where, kind="stable")
        begun = np.cumsum(length[by]) - length[by]
        firsts = np.flatnonzero(np.diff(where[by], prepend=-1)) if len(by) else by
        offset = np.empty(len(by), np.int64)
        offset[by] = begun - np.repeat(begun[firsts], np.diff(np.append(firsts, len(by))))
        group = np.asarray(table.column("group"))
        return pa.table({
            "doc_id": table.column("doc_id"), "crc": table.column("crc"), "piece": table.column("piece"), "first_word": table.column("first_word"), "length": table.column("length"),
            "bin_id": pa.array((group << 32) + where), "bin_capacity": pa.array(np.array(caps, np.int32)[where], pa.int32()), "bin_offset": pa.array(offset),
        })

    return run


def pack_pieces(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, start_cost: float = 16.0, group_pieces: int = 20_000) -> DataFrame:
    """A row for each piece: doc_id, crc (of its text), piece, first_word, length, bin_id, bin_capacity, bin_offset."""
    top = max(capacities)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words"), F.coalesce(F.crc32(F.col("text")), F.lit(0)).alias("crc"))
    rows = keep(counted(rows, "_rows"), "sizes")
    n, most = rows.agg(F.sum(F.ceil(F.col("words") / top) * F.col("_rows")), F.max("_rows")).first()
    rows = each_copy(rows, "_rows", "_copy", most or 0)
    groups = max(1, -(-int(n or 0) // group_pieces))
    cut = rows.where("words > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(words - 1) div {top}"))))
    cut = cut.select("doc_id", "crc", "_copy", "piece", (F.col("piece") * top).alias("first_word"), F.least(F.lit(top), F.col("words") - F.col("piece") * top).cast("long").alias("length"))
    cut = cut.withColumn("group", F.pmod(F.xxhash64(F.lit(3), "doc_id", "crc", "_copy", "piece"), F.lit(groups))).drop("_copy")
    schema = "doc_id long, crc long, piece long, first_word long, length long, bin_id long, bin_capacity int, bin_offset long"
    packed = cut.groupBy("group").applyInArrow(_pack(tuple(capacities), start_cost), schema)
    none = rows.where("words = 0").select("doc_id", "crc", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_capacity"), F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionAll(none)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, start_cost: float = 16.0, group_pieces: int = 20_000) -> DataFrame:
    """A row for each piece: doc_id, piece, first_word, length, bin_id, bin_capacity, bin_offset."""
    return pack_pieces(docs, capacities, start_cost, group_pieces).drop("crc")


def packed_sequences(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, start_cost: float = 16.0, group_pieces: int = 20_000) -> DataFrame:
    """A row for each bin: bin_id, bin_capacity, length (words), doc_ids, ends (words up to each piece's end), text.

    Words are joined by a blank.  Each piece's words are cut out where its text lies, and only they travel, once for
    equal pieces and group of bins.  Equal pieces are numbered within each group, so they meet in no task.
    """
    key = ["doc_id", "crc", "piece", "length"]
    placed = pack_pieces(docs, capacities, start_cost, group_pieces).where("bin_id is not null")
    placed = keep(placed.withColumn("group", F.shiftright("bin_id", 32)), "placed")
    text = F.col("text").cast("string")
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(text), F.lit(0)).alias("crc"), F.regexp_extract_all(text, F.lit(f"({WORD})")).alias("words"))
    words = words.where(F.size("words") > 0)
    top = max(capacities)
    cut = words.select("doc_id", "crc", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {top}").cast("int")), lambda i: F.array_join(F.slice("words", i * top + 1, top), " "))).alias("piece", "part"))
    # Equal parts are counted; a key has several only where checksums of different texts agree.
    cut = cut.withColumns({"piece": F.col("piece").cast("long"), "length": F.regexp_count("part", F.lit(WORD)).cast("long")})
    cut = keep(counted(cut, "count"), "parts")
    cut = starts(cut, key, "part").select(*key, "part", F.col("start").alias("first"), (F.col("start") + F.col("count")).alias("end"))
    # The pieces of a key in one group of bins start where those in the groups before end, and are numbered there.
    cells = starts(placed.groupBy(*key, "group").count(), key, "group").select(*key, "group", "start", (F.col("start") + F.col("count")).alias("stop"))

    def alike(*names: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names])

    meet = alike(*key) & (F.col("a.start") < F.col("b.end")) & (F.col("b.first") < F.col("a.stop"))
    parts = cells.alias("a").join(cut.alias("b"), meet).select("a.*", "b.part", "b.first", "b.end")
    number = F.row_number().over(Window.partitionBy(*key, "group").orderBy("bin_id", "bin_offset")) - 1
    own = F.col("a.number") + F.col("b.start")
    both = placed.withColumn("number", number).alias("a").join(parts.alias("b"), alike(*key, "group") & (own >= F.col("b.first")) & (own < F.col("b.end")))
    both = both.select("a.bin_id", "a.bin_capacity", F.struct("a.bin_offset", "a.doc_id", "a.length", "b.part").alias("one"))
    bins = both.groupBy("bin_id", "bin_capacity").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return bins.select("bin_id", "bin_capacity", F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), F.col("all.doc_id").alias("doc_ids"), F.transform("all", lambda x: x["bin_offset"] + x["length"]).alias("ends"), F.array_join("all.part", " ").alias("text"))

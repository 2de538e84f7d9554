"""Proportional stratified interleaving: shards that all have the mixture of the sources. Native.

Rows are ranked within each source in a seeded order, get the fractional rank (rank - 1/2) / rows of the
source, are sorted by it, and the sorted rows are cut into equal runs.  Law ``rows``: the shards' row counts
differ by one at most, and so do the counts of any source in them, but for rounding at the cuts.

No source is brought together to be ranked.  The seeded hash splits a source into even cells; a cell's rows
are numbered alone and start at the sum of the cells before, from a pre-aggregated table of counts.  Equal rows,
which no hash splits, are ranked as one with their count, and told apart by their ranks after that.  The
sort by fractional rank goes the same way, by cells of the fraction.

Defined cases.  A null text has size 1 and a null text_crc32.  A null source is a source of its own, after
all others.  A null doc_id sorts first.  Repeated rows are rows; equal rows are interchangeable.  Very long texts
are read for their size and checksum alone and never travel.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SEEDED_BITS, counted, each_copy, keep, seeded_bits

#: Cells of the fractional rank, and bits of the hash that make a source's cells; both grow with the rows, so that a cell
#: holds about ``CELL_ROWS`` of them at most.
FRACTION_CELLS, HASH_BITS, CELL_ROWS = 4096, 10, 100_000


def starts(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """``counts`` (by, order, count) with the sum of the counts before as ``start``."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(order)
    return counts.withColumn("start", F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count"))


def stratified_shards(rows: DataFrame, stratum: str, key: list[str], shards: int = 8, seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, from 0 in each shard).

    ``key``: columns that tell rows apart; rows equal in all of them are interchangeable.
    """
    own = counted(rows, "_rows").withColumns({"_s": F.struct(F.col(stratum).isNull(), F.col(stratum)), "_h": seeded_bits(seed, *[F.col(k) for k in key])})
    own = keep(own, "hashed")
    number, most = own.agg(F.sum("_rows"), F.max("_rows")).first()
    many = max(1, (number or 0) // CELL_ROWS)
    bits, fractions = max(HASH_BITS, (many - 1).bit_length()), max(FRACTION_CELLS, many)
    own = own.withColumn("_cell", F.shiftright("_h", SEEDED_BITS - bits))
    cells = starts(own.groupBy("_s", "_cell").agg(F.sum("_rows").alias("count")), ["_s"], "_cell").withColumn("_n", F.sum("count").over(Window.partitionBy("_s"))).drop("count")
    order = ["_h", *key]
    w = Window.partitionBy("_s", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = own.join(cells, ["_s", "_cell"]).withColumn("_rank", F.sum("_rows").over(w) + F.col("start")).drop("start", "_cell")
    # The rank of the last of equal rows; the others have those before.
    ranked = each_copy(ranked, "_rows", "_copy", most or 0)
    ranked = ranked.withColumn("_f", (F.col("_rank") - F.col("_copy") - 0.5) / F.col("_n"))
    ranked = keep(ranked.withColumn("_cell", F.floor(F.col("_f") * fractions)), "ranked")
    counts = starts(ranked.groupBy("_cell").count(), [], "_cell").withColumn("_all", F.sum("count").over(Window.partitionBy())).drop("count")
    w = Window.partitionBy("_cell").orderBy("_f", "_s", *order)
    # A row a cell: some thousand, or one for 100,000 rows; only few are broadcast.
    placed = ranked.join(F.broadcast(counts) if fractions <= 1_000_000 else counts, "_cell").withColumn("_at", F.row_number().over(w) + F.col("start") - 1)
    # Shard k takes the places from ceil(k * all / shards): integer arithmetic only.
    placed = placed.withColumn("shard", F.expr(f"(_at * {shards}) div _all").cast("int"))
    placed = placed.withColumn("slot", F.col("_at") - F.expr(f"(shard * _all + {shards - 1}) div {shards}"))
    return placed.drop("_s", "_h", "_n", "_rank", "_copy", "_f", "_cell", "start", "_all", "_at")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (and source) of every document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text")).alias("text_crc32"),
        F.col("source").cast("string").alias("source"),
    )
    out = stratified_shards(rows, "source", ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "source")

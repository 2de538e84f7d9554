"""Mixing sources to target weights by Pareto order sampling.

Targets.  Sources, by code point and null last, weigh 5, 2, 1, repeating; together they are to give
``budget`` times all words.  A target stops at ``most`` times its source's words, and the excess goes to the
others by weight until none is above: that is min(most * words, level * weight) at one level, found from
running sums over the sources ordered by where they stop.

Sampling.  A document is wanted ``target / words of its source`` times on the average of its source's words, fuller
documents more: a document's weight is size / (size + 64) in whole thousandths, and what it differs from the
source's mean weight by (mean by words), halved, moves it by that share of the nearer limit (0 or ``most``).  So the
sum stays the target and no document is wanted over ``most`` times.  The whole part is allocated for certain.  The
rest, p, is its inclusion probability: with u uniform from its seeded hash, documents are ranked by the odds
u / (1 - u) divided by p / (1 - p), and the lowest ranks are taken, a fixed number of words: up to the document
whose middle passes what the source still lacks.

The running sums are cut into cells of the rank, each summed alone, so that no source meets in one task.  The
logarithm of the rank has a logistic distribution about each p, whose density is 1/4 at most: cells of a width of
4 / ``cells`` in it hold one ``cells``-th of a source at most, whatever the probabilities.  Equal rows, which share a
rank, are summed as one with their count, and told apart after that.

Defined cases.  A null text, or one without words, has size 0 and is never taken; a null source is a source of its
own, the last; a null doc_id draws by its text alone.  Repeated rows are documents of their own: equal ranks are
taken in any order, as they are alike.  A source without words has target 0.  Very long texts count whole.  An empty
table gives no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SEEDED_BITS, WORD, counted, each_copy, keep, seeded_bits
from .sharding import starts


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``; one row a source, so its windows may be global."""
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    out = out.withColumn("_stop", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy()
    before = Window.partitionBy().orderBy("_stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({
        "_budget": F.least(F.sum("source_size").over(everything) * F.lit(float(budget)), F.sum("_cap").over(everything)),
        "_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_open": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    # The level if exactly the sources before are full; the right one is the first that stops nobody from here on.
    out = out.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
    out = out.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_stop"), F.struct("_stop", "_level"))).over(everything)["_level"])
    return out.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_at") * F.col("_w")), F.col("_cap")).alias("target"))


def seeded_uniform(seed: int, *key: Column) -> Column:
    """In (0, 1)."""
    return (seeded_bits(seed, *key) + F.lit(0.5)) / F.lit(float(1 << SEEDED_BITS))


#: Words at which a document's weight is a half.
HALF_WEIGHT = 64


def wanted_times(rate: Column, weight: Column, mean: Column, most: float) -> Column:
    """How many times a document of ``weight`` (0 to 1000) is wanted where the mean weight is wanted ``rate`` times."""
    return rate + (weight - mean) / F.lit(2000.0) * F.least(rate, F.lit(float(most)) - rate)


def pareto_sample(rows: DataFrame, source: str, size: str, target: str, wanted: Column, key: list[str], seed: int = 29, cells: int = 1024) -> DataFrame:
    """``rows`` with ``copies`` (long), so that each source's size times copies comes near ``target``.

    ``wanted``: how many times each row is wanted; its whole part is allocated, the rest sampled.
    """
    u = seeded_uniform(seed, *[F.col(k) for k in key])
    own = counted(rows, "_rows").withColumns({"_src": F.struct(F.col(source).isNull(), F.col(source)), "_wanted": wanted, "_u": u})
    own = own.withColumn("_whole", F.floor("_wanted")).withColumn("_p", F.col("_wanted") - F.col("_whole"))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    own = keep(own.withColumn("_q", F.when((F.col("_p") > 0) & (F.col(size) > 0), odds)), "odds")
    # A cell a million rows for the largest tables.
    number, most = own.agg(F.sum("_rows"), F.max("_rows")).first()
    width = max(cells, (number or 0) // 1_000_000) / 4
    # Undrawn rows have no rank and a cell of their own, which isn't gathered.
    own = own.withColumn("_cell", F.floor(F.log("_q") * F.lit(float(width))))
    sums = own.groupBy("_src", "_cell").agg(F.sum(F.when(F.col("_q").isNotNull(), F.col(size) * F.col("_rows")).otherwise(0)).alias("count"), F.sum(F.col("_whole") * F.col(size) * F.col("_rows")).alias("_certain"))
    sums = starts(sums, ["_src"], "_cell").withColumn("_certain", F.sum("_certain").over(Window.partitionBy("_src"))).drop("count")
    w = Window.partitionBy("_src", "_cell").orderBy("_q", *key, size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = own.where("_q is not null").join(sums, ["_src", "_cell"]).withColumn("_to", F.sum(F.col(size) * F.col("_rows")).over(w) + F.col("start"))
    drawn = each_copy(drawn, "_rows", "_copy", most or 0).withColumn("_to", F.col("_to") - F.col("_copy") * F.col(size))
    take = F.col("_to") - F.col(size) / 2 <= F.col(target) - F.col("_certain")
    drawn = drawn.withColumn("copies", F.col("_whole") + take.cast("long")).drop("start", "_to", "_certain")
    rest = each_copy(own.where("_q is null"), "_rows", "_copy", most or 0).withColumn("copies", F.col("_whole"))
    return drawn.unionByName(rest).drop("_copy", "_src", "_wanted", "_u", "_whole", "_p", "_q", "_cell")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, seed: int = 29) -> DataFrame:
    """doc_id, size, source_size, target, taken (and source, copies, text_md5) of every document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.col("text")).alias("text_md5"),
    )
    weight = F.expr(f"(1000 * size) div (size + {HALF_WEIGHT})")
    rows = keep(rows.withColumn("_weight", weight), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_weight")).alias("_weights"))
    targets = source_targets(sums.drop("_weights"), weights, budget, most).withColumnRenamed("source", "_source")
    targets = targets.join(sums.select(F.col("source").alias("_s"), "_weights"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["_source"])).drop("_source")
    times = wanted_times(F.col("target") / F.col("source_size"), F.col("_weight"), F.col("_weights") / F.col("source_size"), most)
    out = pareto_sample(rows, "source", "size", "target", F.when(F.col("source_size") > 0, times).otherwise(0.0), ["doc_id", "text_md5"], seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "text_md5")

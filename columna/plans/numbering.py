"""Tables that outlive their executors, and positions 0, 1, ... for rows that have none."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Partitions whose offsets are broadcast (16 bytes each).
BROADCAST_PARTITIONS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of this machine only where none is named and Spark runs on it alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="columna-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def durable(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written to the shared folder, below the application's name, and read back: its lineage is cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/columna/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """``df`` with ``name`` (long): its rows numbered from 0 without a gap, in their order, or in that of ``order``.

    Rows are written once with their partition and their place in it; the partitions' counts, added up, are where each
    begins.  What is written stays, so a lost executor changes no number, and no task holds more than a partition.
    """
    ranged = df.orderBy(*order) if order else df
    part, at = f"{name}_part", f"{name}_at"
    kept = durable(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = kept.groupBy(F.col(part).alias("_p")).agg(F.count("*").alias("_n"))
    # One row a partition: few enough for a window in one task.
    offsets = durable(counts.select("_p", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n")).alias("_first")), "offsets")
    if offsets.count() <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    return kept.join(offsets, F.col(part) == F.col("_p")).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_first") + F.col(at)).alias(name))

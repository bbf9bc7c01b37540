"""Where lineage ends: written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; where none is set, a local session gets one of its own and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="labelmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_batches(spark: SparkSession) -> None:
    """Python workers get at most 1,000 rows, or 8 MB, at a time, as whole texts may be long; a session that has set its own limits keeps them."""
    of = "spark.sql.execution.arrow."
    if spark.conf.get(f"{of}maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set(f"{of}maxRecordsPerBatch", "1000")
    if spark.conf.get(f"{of}maxBytesPerBatch", None) in (None, "64MB", str(64 << 20)):
        spark.conf.set(f"{of}maxBytesPerBatch", str(8 << 20))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df and reads it again: a lost executor costs its tasks only."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's place in the order, from 1, as `name`, within strata if given (null is one).

    Ranges of (stratum, order) are sorted apart; a row for each range and stratum tells how many rows come before it. No
    stratum, however large, passes through one task.
    """
    keys = [F.col(c).asc_nulls_first() for c in within]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_row", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_row", 33)), "ranked")
    sizes = placed.groupBy(*within, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # ranges of a stratum
    sizes = sizes.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return placed.join(sizes, same).withColumn(name, F.col("_base") + F.col("_row") - F.col("_first") + 1).select(*df.columns, name)

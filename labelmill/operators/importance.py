"""Permutation importance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions.base import hash_order


def permutation_importance(df: DataFrame, key: str, features: list[str], score: Column, seed: str, blocks: int = 64) -> DataFrame:
    """(feature, base, permuted, drop): score (an aggregate over the features' columns) before and after a feature is permuted.

    Values change places within blocks of keys by hash order, so no task sorts all rows. Rows are dealt to blocks before
    they get their hashes, which stay where they are sorted, as bytes.
    """
    d = df.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(blocks)).cast("int"))
    base = df.agg(score.alias("base"))
    out = []
    for f in features:
        a, b = (F.row_number().over(Window.partitionBy("_block").orderBy(F.unhex(hash_order(seed + s + f, key)))) for s in ("a", "b"))
        left = d.drop(f).repartition("_block").withColumn("_i", a)
        right = d.select("_block", key, F.col(f).alias("_v")).repartition("_block").select("_block", "_v", b.alias("_i"))
        p = left.join(right, ["_block", "_i"]).withColumnRenamed("_v", f)
        out.append(p.agg(score.alias("permuted")).select(F.lit(f).alias("feature"), "permuted"))
    return reduce(DataFrame.union, out).crossJoin(base).select("feature", "base", "permuted", (F.col("base") - F.col("permuted")).alias("drop"))

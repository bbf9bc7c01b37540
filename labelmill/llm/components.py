"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so nothing passes through the
driver but two numbers that tell whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import cut


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    low = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
    out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(low.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Returns (node, component): each node of an edge with the smallest node it can reach.

    Loops and repeated edges do no harm; rows with a null end are ignored; no edges give
    an empty table. Nodes without edges are not returned: they are their own component.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("a"), F.col(dst).alias("b"))
    e = cut(e.where("a is not null and b is not null and u <> v").select("u", "v").distinct(), "cc")
    before = _signature(e)
    while before[0]:
        # after a large star all edges point from larger to smaller nodes
        e = cut(_small(cut(_large(e).distinct(), "cc")).distinct(), "cc")
        now = _signature(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())

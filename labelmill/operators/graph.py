"""Connected components of edge tables, and what else walks along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators.lineage import cut


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge and the smallest node that it reaches; nodes may be numbers, strings or structs.

    Every round hangs the neighbours of a node on its smallest one, first those above it, then those below it, so that
    paths halve; each is a grouped minimum and an equi-join. The edges' number and hash tell when nothing moves any more.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")) if edges.schema[a].dataType.typeName() != "struct" else edges.select(F.array_max(F.array(a, b)).alias("hi"), F.array_min(F.array(a, b)).alias("lo"))
    e = cut(e.where("hi > lo").distinct(), "edges")
    told = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first())
    before = None
    while (now := told(e)) != before and now[0]:
        before = now
        both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m"))
        low = low.select("n", F.when(F.col("m") < F.col("n"), F.col("m")).otherwise(F.col("n")).alias("m"))
        up = cut(e.join(low, e["lo"] == low["n"]).select("hi", F.col("m").alias("lo")).distinct(), "edges-up")  # neighbours above a node
        low = up.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m"))
        down = up.join(low, up["hi"] == low["n"]).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut(down.union(low.select(F.col("n").alias("hi"), F.col("m").alias("lo"))).where("hi > lo").distinct(), "edges")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())


def rings(links: DataFrame, order: str) -> DataFrame:
    """links: v, nxt (a permutation of v, in cycles), order (what starts a ring: the smallest); adds first (order of its ring's first) and left (steps from v to that first).

    Pointer doubling: after k rounds a row has seen 2^k of its successors; when a round finds no smaller start for any
    row, every row has seen its whole ring.
    """
    at = cut(links.select("v", F.col("nxt").alias("to"), F.col(order).alias("first"), F.lit(0).cast("long").alias("left")), "rings")
    step, moved = 1, 1
    while moved:
        ahead = at.select(F.col("v").alias("to"), F.col("to").alias("beyond"), F.col("first").alias("f"), F.col("left").alias("l"))
        better = F.col("f") < F.col("first")
        seen = at.join(ahead, "to").select("v", F.col("beyond").alias("to"), F.when(better, F.col("f")).otherwise(F.col("first")).alias("first"), F.when(better, F.col("l") + step).otherwise(F.col("left")).alias("left"), better.alias("moved"))
        at = cut(seen, "rings")
        moved, step = at.where("moved").limit(1).count(), step * 2
        at = at.drop("moved")
    return links.join(at.select("v", "first", "left"), "v")

"""Polygon checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def self_intersecting(polygons: DataFrame, key: str, least: int = 4, most: int = 5000) -> DataFrame:
    """Keys of rings (points: array<struct<x, y>>) with two edges that cross or touch without being neighbours.

    Edges meet within their polygon only, after a test of their boxes; rings of fewer than `least` or more than
    `most` vertices are not checked.
    """
    p = polygons.where(F.size("points").between(least, most)).withColumn("n", F.size("points"))
    e = p.select(key, "n", "points", F.posexplode("points").alias("i", "a")).withColumn("b", F.get("points", ((F.col("i") + 1) % F.col("n")).cast("int"))).drop("points")
    f = e.select(key, F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    lo, hi = (lambda s, t, k: F.least(F.col(s)[k], F.col(t)[k])), (lambda s, t, k: F.greatest(F.col(s)[k], F.col(t)[k]))
    meet = F.lit(True)
    for k in ("x", "y"):
        meet = meet & (lo("a", "b", k) <= hi("c", "d", k)) & (lo("c", "d", k) <= hi("a", "b", k))
    apart = (F.col("j") > F.col("i") + 1) & ~((F.col("i") == 0) & (F.col("j") == F.col("n") - 1))
    side = lambda o, p, q: F.signum((F.col(p)["x"] - F.col(o)["x"]) * (F.col(q)["y"] - F.col(o)["y"]) - (F.col(p)["y"] - F.col(o)["y"]) * (F.col(q)["x"] - F.col(o)["x"]))
    cross = (side("a", "b", "c") * side("a", "b", "d") <= 0) & (side("c", "d", "a") * side("c", "d", "b") <= 0)
    return e.join(f, key).where(apart & meet & cross).select(key).distinct()


def _around(ring: Column, step) -> Column:
    """The sum of step(p, q) over the edges of a closed ring."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, nxt, step), F.lit(0.0), lambda s, v: s + v)


def ring_area(ring: Column) -> Column:
    return F.abs(_around(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def ring_length(ring: Column) -> Column:
    return _around(ring, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def polygon_measures(outer: Column, holes: Column) -> dict[str, Column]:
    """area (holes taken off), perimeter (holes included) and the bounding box of a polygon; outer: array<struct<x, y>>, holes: array of such."""
    total = lambda f: F.aggregate(F.transform(holes, f), F.lit(0.0), lambda s, v: s + v)
    end = lambda f, k: f(F.transform(outer, lambda p: p[k]))
    return {"area": ring_area(outer) - total(ring_area), "perimeter": ring_length(outer) + total(ring_length), "x0": end(F.array_min, "x"), "y0": end(F.array_min, "y"), "x1": end(F.array_max, "x"), "y1": end(F.array_max, "y")}

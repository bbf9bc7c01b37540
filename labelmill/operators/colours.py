"""Nearest colours by CIEDE2000, exact, through cells of CIELAB.

CIEDE2000 is no metric, but it has lower bounds. With S_L at most 1.75, S_H at most S_C (its hue term T stays below
3), and a rotation term that takes at most the share 1 - sin(60 deg) of the chroma and hue terms away,

    dE >= |dL| / 1.75   and   dE >= KEPT * dab / (1 + 0.045 * C'),   KEPT = sqrt(1 - sin 60 deg),

where dab is the distance in a and b (stretching a only adds to it) and C' the pair's mean stretched chroma, at most
the query's 1.5 * C + 0.75 * dab. So a difference already found bounds where a nearer colour can lie.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.operators.lineage import cut

S_L = 1 + 0.015 * 2500 / math.sqrt(2520)  # the largest weight of lightness, at 0 and 100
KEPT = math.sqrt(1 - math.sin(math.radians(60)))
VOLUME, WIDTH = 8.3e5, 300.0  # of 8-bit sRGB in CIELAB: its volume, and more than its extent along any axis
FULL = 16  # colours in a cell on average


def reach(found: Column, a: Column, b: Column) -> Column:
    """How far in a and b a colour can lie that is no farther than `found` from (a, b)."""
    k = (found + 1e-9) / KEPT
    free = 1 - 0.045 * 0.75 * k
    return F.when(free > 0.05, F.least(F.lit(WIDTH), k * (1 + 0.045 * 1.5 * F.hypot(a, b)) / free)).otherwise(WIDTH)


@F.pandas_udf("double")
def differences(l1: pd.Series, a1: pd.Series, b1: pd.Series, l2: pd.Series, a2: pd.Series, b2: pd.Series) -> pd.Series:
    """CIEDE2000, rounded to nine places, of batches of pairs; as one column expression it is thousands of nodes, which takes longer to plan than to run."""
    l1, a1, b1, l2, a2, b2 = (v.to_numpy(float) for v in (l1, a1, b1, l2, a2, b2))
    c7 = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    stretch = 1.5 - 0.5 * np.sqrt(c7 / (c7 + 25.0**7))
    p, q = stretch * a1 + 1j * b1, stretch * a2 + 1j * b2
    k1, k2 = np.abs(p), np.abs(q)
    mean, grey = (k1 + k2) / 2, k1 * k2 == 0
    h1, h2 = np.degrees(np.angle(p)) % 360, np.degrees(np.angle(q)) % 360
    gap = h2 - h1
    turn = np.where(grey, 0.0, gap - 360 * (gap > 180) + 360 * (gap < -180))  # from the first hue to the second, the short way
    hue = np.where(grey, h1 + h2, h1 + turn / 2)
    cos = lambda k, shift: np.cos(np.radians(k * hue + shift))
    s_h = 1 + 0.015 * mean * (1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63))
    off = ((l1 + l2) / 2 - 50) ** 2
    x = (l2 - l1) / (1 + 0.015 * off / np.sqrt(20 + off))
    y, z = (k2 - k1) / (1 + 0.045 * mean), 2 * np.sqrt(k1 * k2) * np.sin(np.radians(turn / 2)) / s_h
    blue = np.exp(-(((hue % 360 - 275) / 25) ** 2))
    turned = -2 * np.sqrt(mean**7 / (mean**7 + 25.0**7)) * np.sin(np.radians(60 * blue))
    return pd.Series(np.round(np.sqrt(np.maximum(0.0, x * x + y * y + z * z + turned * y * z)), 9))


def nearest_colours(points: DataFrame, full: int = FULL, asked: DataFrame | None = None) -> DataFrame:
    """(id, near, distance): for each row of points (id, l, a, b; distinct 8-bit colours), or those whose id is in `asked`, all others at its least CIEDE2000 difference, rounded to nine places.

    A colour's own cell, or the first of cells three times as wide that has another colour, gives a difference; the cells
    within its bound are then looked through. Colours are at most 2^24, however many observations have them, and cells
    shrink as colours get dense. A lone colour has no row; an empty table gives none.
    """
    points = cut(points.select("id", "l", "a", "b"), "colours")
    box = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in "lab"]).first()
    n = box["n"]
    side = max(0.5, (VOLUME * full / max(n, 1)) ** (1 / 3))
    cell = lambda w: F.struct(*[F.floor(F.col(c) / w).cast("int").alias(c) for c in "lab"])
    lab = lambda p: tuple(F.col(f"{p}.{c}") for c in "lab")
    one, other = F.struct("id", "l", "a", "b").alias("p"), F.struct("id", "l", "a", "b").alias("q")
    apart = differences(*lab("p"), *lab("q"))
    left = points if asked is None else cut(points.join(asked.select("id"), "id", "left_semi"), "colours-asked")
    width, found = side, []
    while n > 1:
        pairs = left.select(cell(width).alias("cell"), one).join(points.select(cell(width).alias("cell"), other), "cell").where("p.id <> q.id").withColumn("d", apart)
        found.append(cut(pairs.groupBy("p").agg(F.min("d").alias("found")), "colours-first"))
        left = cut(left.join(found[-1].select("p.id"), "id", "left_anti"), "colours-left")
        if width > WIDTH or left.isEmpty():
            break
        width = width * 3 if width * 3 < WIDTH else 4 * WIDTH  # these are split at 0 alone
    if not found:
        return points.select("id", F.col("id").alias("near"), F.lit(0.0).alias("distance")).where("false")
    first = found[0]
    for f in found[1:]:
        first = first.union(f)
    if not left.isEmpty():  # alone in its quadrant of a and b, so four rows at most: all others are candidates
        first = first.union(left.select(one, F.lit(WIDTH).alias("found")))
    dl, dab = (F.col("found") + 1e-9) * S_L, reach(F.col("found"), F.col("p.a"), F.col("p.b"))
    span = lambda c, d: F.sequence(F.floor(F.greatest(F.col(f"p.{c}") - d, F.lit(box[f"lo_{c}"])) / side).cast("int"), F.floor(F.least(F.col(f"p.{c}") + d, F.lit(box[f"hi_{c}"])) / side).cast("int"))
    asks = first.withColumns({"dl": dl, "dab": dab}).select("*", F.explode(span("l", F.col("dl"))).alias("cl")).select("*", F.explode(span("a", F.col("dab"))).alias("ca"))
    off = lambda c, v: F.greatest(F.lit(0.0), v * side - F.col(f"p.{c}"), F.col(f"p.{c}") - (v + 1) * side)  # noqa: E731  from p to the cell along an axis
    asks = asks.select("*", F.explode(span("b", F.col("dab"))).alias("cb")).where(F.hypot(off("a", F.col("ca")), off("b", F.col("cb"))) <= F.col("dab"))
    asks = asks.select("p", "found", F.struct(F.col("cl").alias("l"), F.col("ca").alias("a"), F.col("cb").alias("b")).alias("cell"))
    near = asks.join(points.select(cell(side).alias("cell"), other), "cell").where("p.id <> q.id")
    near = near.where((F.abs(F.col("p.l") - F.col("q.l")) <= dl) & (F.hypot(F.col("p.a") - F.col("q.a"), F.col("p.b") - F.col("q.b")) <= dab))
    near = near.select(F.col("p.id").alias("id"), F.col("q.id").alias("near"), "found", apart.alias("distance")).where(F.col("distance") <= F.col("found"))
    near = cut(near.select("id", "near", "distance"), "colours-near")
    return near.join(near.groupBy("id").agg(F.min("distance").alias("distance")), ["id", "distance"]).select("id", "near", "distance")


def nearest_agreement(observations: DataFrame, label: str) -> DataFrame:
    """(label, n, agreement): the share of a class's observations (r, g, b, label) whose nearest other observation by CIEDE2000 has their class.

    Observations of one colour are each other's nearest; of several nearest, each counts in proportion. Null colours or
    labels take no part; a lone observation counts as disagreeing.
    """
    from labelmill.functions.color import rgb_to_lab

    o = observations.where(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull() & F.col(label).isNotNull())
    by = cut(o.groupBy((F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int").alias("id"), F.col(label).alias("label")).agg(F.count("*").alias("n")), "colour-classes")
    total = cut(by.groupBy("id").agg(F.sum("n").alias("all")), "colour-totals")
    rgb = [F.shiftright("id", 16), F.shiftright("id", 8).bitwiseAND(255), F.col("id").bitwiseAND(255)]
    points = total.select("id", *[v.alias(c) for v, c in zip(rgb_to_lab(*rgb), "lab", strict=True)])
    own = by.join(total, "id").where("all > 1").select("label", "n", (F.col("n") * (F.col("n") - 1) / (F.col("all") - 1)).alias("agree"))
    lone = by.join(total.where("all = 1").select("id"), "id")
    near = nearest_colours(points, asked=lone).join(lone.select("id", "label"), "id")  # a lone observation has one class; others are nearest to each other
    around = near.join(by.select(F.col("id").alias("near"), F.col("label").alias("other"), "n"), "near")
    alone = around.groupBy("id", "label").agg((F.sum(F.when(F.col("other") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agree"))
    alone = lone.select("id", "label").join(alone.drop("label"), "id", "left").select("label", F.lit(1).cast("long").alias("n"), F.coalesce("agree", F.lit(0.0)).alias("agree"))
    return own.union(alone).groupBy("label").agg(F.sum("n").alias("n"), (F.sum("agree") / F.sum("n")).alias("agreement"))

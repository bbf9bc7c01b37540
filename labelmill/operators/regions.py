"""Connected regions of label images: labelled in strips, traced into rings, and written as run lengths.

An image of any size is cut into strips of rows. Runs of equal pixels are joined within a
strip by one small helper; the runs on either side of a strip's border are an edge table,
whose connected components name the regions. No task holds more than a strip.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.operators.graph import connected, rings
from labelmill.operators.lineage import cut

#: Rows of a strip; columns of a tile in which runs on two sides of a border meet.
STRIP, TILE = 64, 256


def row_runs(px: DataFrame, value: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """(image, y, x0, x1, value, sums): the runs of equal values in the rows of px, and sums of its columns over each; null values are left out."""
    gap = F.col("x") - F.row_number().over(Window.partitionBy("image", "y", "value").orderBy("x"))
    p = px.select("image", "y", "x", F.col(value).alias("value"), *sums).where("value is not null").withColumn("gap", gap)
    return p.groupBy("image", "y", "value", "gap").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), *[F.sum(c).cast("long").alias(c) for c in sums]).drop("gap")


def join_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, value: np.ndarray, eight: bool) -> np.ndarray:
    """The first run that each run is connected with; runs come by y, then x0."""
    up, reach, above = np.arange(len(y)), int(eight), 0

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(y)):
        while above < i and (y[above] < y[i] - 1 or y[above] == y[i] - 1 and x1[above] + reach < x0[i]):
            above += 1
        j = above
        while j < i and y[j] == y[i] - 1 and x0[j] <= x1[i] + reach:
            if value[j] == value[i]:
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
            j += 1
    return np.array([find(i) for i in range(len(y))], int)


def labelled_runs(px: DataFrame, value: str, eight: bool = False, sums: tuple[str, ...] = (), strip: int = STRIP) -> DataFrame:
    """(image, value, y, x0, x1, comp, sums): runs of equal values and the connected region that each belongs to.

    comp names a region by its first pixel in reading order: y * 2^32 + x of the first run. Regions of different values
    never touch each other's names. Pixels with null values belong to none.
    """
    runs = row_runs(px, value, sums).withColumn("strip", F.floor(F.col("y") / strip))
    kinds, names = dict(runs.dtypes), ["image", "y", "x0", "x1", "value", *sums, "comp"]

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x0"]).reset_index(drop=True)
        y, x0 = pdf["y"].to_numpy(), pdf["x0"].to_numpy()
        first = join_runs(y, x0, pdf["x1"].to_numpy(), pdf["value"].to_numpy(), eight)
        return pdf.assign(comp=y[first].astype(np.int64) * (1 << 32) + x0[first])[names]

    own_runs = runs.groupBy("image", "strip").applyInPandas(own, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))
    own_runs = cut(own_runs, "strip-runs")
    reach = int(eight)
    tiles = F.explode(F.sequence(F.floor((F.col("x0") - reach) / TILE), F.floor((F.col("x1") + reach) / TILE))).alias("tile")
    low = own_runs.where(F.col("y") % strip == 0).select("image", "value", "y", tiles, "x0", "x1", F.struct("image", "comp").alias("b"))
    high = own_runs.where(F.col("y") % strip == strip - 1).select("image", "value", (F.col("y") + 1).alias("y"), tiles, F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.struct("image", "comp").alias("a"))
    edges = low.join(high, ["image", "value", "y", "tile"]).where((F.col("u0") <= F.col("x1") + reach) & (F.col("x0") <= F.col("u1") + reach)).select("a", "b").distinct()
    root = connected(edges).select(F.col("node.image").alias("image"), F.col("node.comp").alias("comp"), F.col("root.comp").alias("root"))
    return own_runs.join(root, ["image", "comp"], "left").select("image", "value", "y", "x0", "x1", F.coalesce("root", "comp").alias("comp"), *sums)


def region_sizes(runs: DataFrame, least: int = 1) -> DataFrame:
    """(image, value, comp, size, x0, y0, x1, y1) of regions of at least `least` pixels; boxes include their last pixel."""
    found = runs.groupBy("image", "value", "comp").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("size"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))
    return found.where(F.col("size") >= least)


def corners(runs: DataFrame) -> DataFrame:
    """(image, comp, y, x, place, out): the corners of all regions' outlines, in pixel edges, with the side that the outline leaves by.

    An outline keeps its region on the right. On the line between two rows, a corner is where a run of the row above or
    below starts or ends and no run of the other row does alike. Where one starts as the other ends, two corners meet,
    and each belongs to the pixel on its own side (place 0 and 1, along the line and along the column).
    """
    ends = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col(x) + dx).alias("x"), F.lit(name).alias("end")) for dy, row in ((0, "below"), (1, "above")) for x, dx, kind in (("x0", 0, "start"), ("x1", 1, "end")) for name in (f"{row} {kind}",)])).alias("e")
    met = runs.select("image", "comp", ends).select("image", "comp", "e.y", "e.x", "e.end")
    has = lambda name: F.max((F.col("end") == name).cast("int")) == 1
    at = met.groupBy("image", "comp", "y", "x").agg(has("below start").alias("bs"), has("below end").alias("be"), has("above start").alias("as_"), has("above end").alias("ae"))
    at = at.where(~((F.col("bs") & F.col("as_")) | (F.col("be") & F.col("ae"))))
    corner = lambda out, row, col: F.struct(F.lit(out).alias("out"), F.lit(row).alias("row"), F.lit(col).alias("col"))
    # row, col: which of two corners at a point comes first along its line, and along its column
    both = F.when(F.col("as_") & F.col("be"), F.array(corner("up", 1, 0), corner("down", 0, 1))).when(F.col("ae") & F.col("bs"), F.array(corner("left", 0, 0), corner("right", 1, 1)))
    one = F.when(F.col("be"), F.array(corner("down", 0, 0))).when(F.col("as_"), F.array(corner("up", 0, 0))).otherwise(F.array(corner("along", 0, 0)))
    c = at.select("image", "comp", "y", "x", "bs", "ae", F.explode(F.coalesce(both, one)).alias("c"))
    return c.select("image", "comp", "y", "x", "c.row", "c.col", "c.out", "bs")


#: Corners of a region that one task chains; those of larger regions are chained by pointer doubling.
LOCAL = 1 << 16


def traced(batches):
    """Rings (image, comp, fy, fx, fv, points) of whole regions from their corners, region after region: image, comp, region, v, nxt, y, x."""
    rest = None

    def rings_of(d: pd.DataFrame) -> pd.DataFrame:
        v, y, x, out = d["v"].to_numpy(), d["y"].to_numpy(), d["x"].to_numpy(), []
        by_v = np.argsort(v)
        nxt = by_v[np.searchsorted(v[by_v], d["nxt"].to_numpy())].tolist()
        seen, ys, xs = bytearray(len(v)), y.tolist(), x.tolist()
        for first in np.lexsort((v, x, y)).tolist():
            if seen[first]:
                continue
            ring, i = [], first
            while not seen[i]:
                seen[i] = 1
                ring.append({"x": xs[i], "y": ys[i]})
                i = nxt[i]
            out.append((first, ring))
        of = d.iloc[[f for f, _ in out]]
        return pd.DataFrame({"image": of["image"].to_numpy(), "comp": of["comp"].to_numpy(), "fy": of["y"].to_numpy(), "fx": of["x"].to_numpy(), "fv": of["v"].to_numpy(), "points": [r for _, r in out]})

    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if len(b):
            last = b["region"] == b["region"].iloc[-1]  # may go on in the next batch
            rest = b[last]
            if not last.all():
                yield rings_of(b[~last].reset_index(drop=True))
    if rest is not None and len(rest):
        yield rings_of(rest.reset_index(drop=True))


def outlines(runs: DataFrame, local: int = LOCAL) -> DataFrame:
    """(image, comp, ring, hole, points, area2): the closed rings of each region; area2 is twice the signed area, negative for holes.

    runs: image, comp, y, x0, x1. Points are corners in pixel edges, from the topmost (then leftmost) on, with the region
    on the right; only corners where the outline turns are kept. Corners on a line, and on a column, pair up into edges.
    Regions of at most `local` corners are chained where they lie, larger ones by pointer doubling. ring numbers a region's
    rings by their first point.
    """
    c = corners(runs).withColumn("v", F.monotonically_increasing_id())
    c = cut(c, "corners")
    large = cut(c.groupBy("image", "comp").agg(F.count("*").alias("n")).where(F.col("n") > local).select("image", "comp"), "large-regions")
    line, column = Window.partitionBy("image", "comp", "y").orderBy("x", "row"), Window.partitionBy("image", "comp", "x").orderBy("y", "col")
    # along a line corners pair up from the left: the first of a pair goes right or comes from the right
    pair = (F.row_number().over(line) - 1) % 2
    nxt = (
        F.when(F.col("out") == "up", F.lag("v").over(column)).when(F.col("out") == "down", F.lead("v").over(column))
        .otherwise(F.when(pair == 0, F.lead("v").over(line)).otherwise(F.lag("v").over(line)))
    )
    kinds = dict(c.dtypes)
    # regions of a bounded size share no line with others, so one shuffle serves both orders and the chains
    small = c.join(large, ["image", "comp"], "left_anti").repartition("image", "comp").withColumn("nxt", nxt).withColumn("region", F.min("v").over(Window.partitionBy("image", "comp")))
    small = small.sortWithinPartitions("region").select("image", "comp", "region", "v", "nxt", "y", "x")
    point = f"array<struct<x:{kinds['x']},y:{kinds['y']}>>"
    ring = small.mapInPandas(traced, f"image {kinds['image']}, comp {kinds['comp']}, fy {kinds['y']}, fx {kinds['x']}, fv long, points {point}")
    if large.limit(1).count():
        linked = c.join(large, ["image", "comp"], "left_semi").withColumn("nxt", nxt).withColumn("start", F.struct("image", "comp", "y", "x", "v"))
        walked = rings(linked.select("v", "nxt", "start", "y", "x"), "start")
        # left is 0 at the first corner, and falls along the ring from there
        order = F.when(F.col("left") == 0, F.lit(-(1 << 62))).otherwise(-F.col("left"))
        far = walked.groupBy("first").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "x", "y"))).alias("p"))  # a ring's corners
        points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
        far = far.select(F.col("first.image").alias("image"), F.col("first.comp").alias("comp"), F.col("first.y").alias("fy"), F.col("first.x").alias("fx"), F.col("first.v").alias("fv"), points.alias("points"))
        ring = ring.unionByName(far)
    after = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    twice = F.aggregate(F.zip_with("points", after, lambda p, q: p["x"].cast("long") * q["y"] - q["x"].cast("long") * p["y"]), F.lit(0).cast("long"), lambda s, v: s + v)
    number = F.row_number().over(Window.partitionBy("image", "comp").orderBy("fy", "fx", "fv"))
    return ring.withColumn("area2", twice).select("image", "comp", number.alias("ring"), (F.col("area2") < 0).alias("hole"), "points", "area2")


def mask_counts(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """(image, comp, counts): run lengths of each region's mask down the columns of its image, in turn outside and inside; frames: image, width, height.

    Rows of runs become runs of columns; those that end at an image's foot and go on at the next column's head are one.
    """
    p = runs.join(frames, "image").select("image", "comp", "y", "width", "height", F.explode(F.sequence("x0", "x1")).alias("x"))
    gap = F.col("y") - F.row_number().over(Window.partitionBy("image", "comp", "x").orderBy("y"))
    col = p.withColumn("g", gap).groupBy("image", "comp", "width", "height", "x", "g").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    place = lambda y: F.col("x").cast("long") * F.col("height") + y
    own = F.sort_array(F.collect_list(F.struct(place(F.col("a")).alias("a"), (place(F.col("b")) + 1).alias("b"))))
    r = col.groupBy("image", "comp", "width", "height").agg(own.alias("r"))  # a region's runs
    was, then = (lambda i: F.when(i > 0, F.get("r", i - 1)["b"])), (lambda i: F.get("r", i + 1)["a"])
    begins = F.filter(F.transform("r", lambda q, i: F.struct(q["a"].alias("at"), was(i).alias("was"))), lambda q: q["was"].isNull() | (q["at"] > q["was"]))
    ends = F.filter(F.transform("r", lambda q, i: F.struct(q["b"].alias("at"), then(i).alias("then"))), lambda q: q["then"].isNull() | (q["then"] > q["at"]))
    counts = F.flatten(F.zip_with(begins, ends, lambda s, e: F.array(s["at"] - F.coalesce(s["was"], F.lit(0)), e["at"] - s["at"])))
    rest = F.col("width").cast("long") * F.col("height") - F.element_at("r", -1)["b"]
    return r.select("image", "comp", F.concat(counts, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))).alias("counts"))


def opened(mask: DataFrame, frames: DataFrame) -> DataFrame:
    """(image, value, y, x): a mask's pixels after an opening by the cross of five pixels, each value apart; beyond the frame counts as set."""
    cross = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])).alias("d")
    key = ["image", "value", "y", "x"]
    moved = lambda d: d.select("image", "value", "y", "x", cross).select("image", "value", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    hits = moved(mask).groupBy(*key).agg(F.count("*").alias("n")).join(frames, "image")
    beyond = sum(c.cast("int") for c in (F.col("y") == 0, F.col("x") == 0, F.col("y") == F.col("height") - 1, F.col("x") == F.col("width") - 1))
    kept = hits.where(F.col("n") + beyond == 5).join(mask.select(*key), key, "left_semi").select(*key)
    return moved(kept).distinct().join(mask.select(*key), key, "left_semi")


def region_candidates(px: DataFrame, label: str, lab: tuple[str, str, str], near: float = 8.0, least: int = 50, most: int = 50, references: DataFrame | None = None) -> DataFrame:
    """(image, cls, comp, size, distance, x0, y0, x1, y1, rank): unlabelled regions whose colour is near a class's, the nearest `most` of each image.

    px: image, y, x, label (0 unlabelled, 255 ignored) and the three columns of a Lab colour. A class's colour is the
    median of each channel over its pixels in the image, or in references (cls, l, a, b) for all images. Unlabelled pixels
    within CIEDE2000 `near` of it are opened and taken together by 8 neighbours; regions below `least` pixels drop out,
    the others stand by mean distance, ties by class and first pixel.
    """
    from labelmill.functions.color import ciede2000

    frames = px.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    open_ = px.where(F.col(label) == 0).select("image", "y", "x", *lab)
    if references is None:
        own = px.where(~F.col(label).isin(0, 255))
        references = own.groupBy("image", F.col(label).alias("cls")).agg(*[F.median(c).alias(f"m{i}") for i, c in enumerate(lab)])
        free = open_.join(references, "image")
    else:
        free = open_.crossJoin(F.broadcast(references.toDF("cls", "m0", "m1", "m2")))  # a row for each class
    d = ciede2000([F.col(c) for c in lab], [F.col(f"m{i}") for i in range(3)])
    close = cut(free.select("image", "y", "x", F.col("cls").alias("value"), d.alias("d")).where(F.col("d") <= near), "near-colours")
    # each class is an image of its own, so that regions of two classes may overlap
    key = ["image", "value", "y", "x"]
    kept = opened(close, frames).join(close, key).select(F.struct("image", "value").alias("image"), "y", "x", F.lit(1).alias("one"), F.col("d"))
    named = cut(kept.withColumn("image", F.concat_ws("|", F.col("image.image").cast("string"), F.col("image.value").cast("string"))).withColumn("d9", F.round(F.col("d") * 1e9).cast("long")), "near-regions")
    runs = labelled_runs(named, "one", eight=True, sums=("d9",))
    r = runs.groupBy("image", "comp").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("size"), F.sum("d9").alias("d9"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))
    parts = F.split("image", r"\|")
    r = r.where(F.col("size") >= least).select(parts[0].cast(dict(px.dtypes)["image"]).alias("image"), parts[1].cast("int").alias("cls"), "comp", "size", (F.col("d9") / 1e9 / F.col("size")).alias("distance"), "x0", "y0", "x1", "y1")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.round("distance", 9), "cls", "comp"))).where(F.col("rank") <= most)

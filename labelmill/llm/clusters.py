"""Centroid clustering of integer vectors, nearest centroids by the threshold algorithm.

For every dimension the centroids stand in a list sorted by their component. A vector
walks all lists outward from its own values at once: each step brings the next nearest
centroid of every list, whose exact distance is taken when it is met first. The squares of
the last steps' distances, summed over the lists, bound what any centroid not yet met can
reach; the walk ends when that sum strictly exceeds the best exact distance, so that ties
still go to the smaller number. Centroids (k vectors) are all that a task gets besides its
own vectors, and sums of k vectors are all that it sends.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import cut, usable

#: Vectors that walk together.
WALK = 1024
#: Components below this size leave room for a distance in 64 bits; larger ones are computed in Python's integers.
ROOM = 1 << 27
FAR = 1 << 62
LIMIT = (1 << 63) - 1


def _walk(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, d = x.shape
    k, dims, far = len(c), np.arange(d), FAR if x.dtype != object else 1 << 140
    order = np.argsort(c, axis=0, kind="stable")
    value = np.take_along_axis(c, order, 0)
    right = np.stack([np.searchsorted(value[:, j], x[:, j]) for j in range(d)], axis=1)
    left, live = right - 1, np.arange(n)
    best, near = np.full(n, far, x.dtype), np.full(n, k)
    met = np.zeros((n, k), bool)
    for _ in range(k):
        own = x[live]
        below = np.where(left >= 0, own - value[np.maximum(left, 0), dims], far)
        above = np.where(right < k, value[np.minimum(right, k - 1), dims] - own, far)
        down = (below <= above).astype(bool)
        frontier = np.where(down, below, above)
        at = order[np.where(down, left, right), dims]
        left, right = left - down, right + ~down
        fresh = np.zeros((len(live), k), bool)
        fresh[np.arange(len(live))[:, None], at] = True
        fresh &= ~met[live]
        row, of = np.nonzero(fresh)
        if len(row):
            met[live] |= fresh
            exact = np.full((len(live), k), far, x.dtype)
            exact[row, of] = ((own[row] - c[of]) ** 2).sum(axis=1)
            first = exact.argmin(axis=1)
            least = exact[np.arange(len(live)), first]
            better = ((least < best[live]) | (least == best[live]) & (first < near[live])).astype(bool)
            best[live[better]], near[live[better]] = least[better], first[better]
        going = ~((frontier**2).sum(axis=1) > best[live]).astype(bool)
        live, left, right = live[going], left[going], right[going]
        if not len(live):
            break
    return near, best


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the number of the nearest row of c (ties: the smaller) and the squared distance; x and c hold integers."""
    near, best = np.zeros(len(x), int), np.zeros(len(x), object)
    small = max((int(abs(y)) for y in (c.max(initial=0), c.min(initial=0))), default=0) < ROOM
    for i in range(0, len(x), WALK):
        own = x[i : i + WALK]
        kind = np.int64 if small and -ROOM < own.min(initial=0) and own.max(initial=0) < ROOM else object
        near[i : i + WALK], best[i : i + WALK] = _walk(own.astype(kind), c.astype(kind))
    return near, best


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _first(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors whose hash comes first; rows of one id stand by their components, null ids last."""
    hashed = rows.select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [r["v"] for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """Returns vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each vector of exactly `dims` usable components.

    A component x counts as floor(scale * x), held at the limits of a long. The k vectors
    with the smallest sha256 of seed and vec_id start as centroids 0, 1, ...; where ids
    repeat, by their components; null ids last. With fewer vectors there are fewer
    centroids. Each round moves every centroid that has vectors to floor(sum / count) and
    leaves the others. Vectors that are null, of another length, or hold null or non-finite
    components are left out; repeated rows and null ids are vectors of their own. Sums
    beyond a long are given as the largest long. Other columns are ignored; an empty table
    gives an empty one.
    """
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fit = vectors.where((F.size("embedding") == dims) & usable(F.col("embedding")))
    rows = cut(fit.select("vec_id", whole.alias("v")), "vectors")
    centres = np.array(_first(rows, k, seed), object).reshape(-1, dims)

    def sums(batches):
        total, count = np.zeros(centres.shape, object), np.zeros(len(centres), int)
        for b in batches:
            x = _matrix(b.column(0), dims)
            near, _ = nearest(x, centres)
            count += np.bincount(near, minlength=len(centres))
            order = np.argsort(near, kind="stable")
            ends = np.flatnonzero(np.diff(near[order], prepend=-1))
            if len(ends):
                wide = x[order] if np.abs(x).max() < ROOM else x[order].astype(object)
                total[near[order][ends]] += np.add.reduceat(wide, ends, axis=0).astype(object)
        got = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(got, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(got)), pa.int32()), pa.array(np.repeat(count[got], dims), pa.int64()), pa.array([Decimal(int(y)) for y in total[got].ravel()], pa.decimal128(38, 0))], names=["cluster", "dim", "n", "total"])

    for _ in range(rounds if len(centres) else 0):
        part = rows.select("v").mapInArrow(sums, "cluster int, dim int, n long, total decimal(38,0)")
        for r in part.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k vectors at most
            centres[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]

    def assign(batches):
        for b in batches:
            near, far = nearest(_matrix(b.column(1), dims), centres)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), pa.array([min(int(y), LIMIT) for y in far], pa.int64())], names=["vec_id", "cluster", "distance"])

    found = cut(rows.mapInArrow(assign, T.StructType([rows.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])), "assigned")
    by = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    named = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    about = [(i, min(s, LIMIT), min(sum(by.values()), LIMIT), named(centres[i])) for i, s in by.items()]
    about = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Exact top-k inner products: a ball tree in every shard, searched by branch and bound.

Vectors are dealt over cells of nearby vectors (centres of a bounded sample), and cells over
shards of bounded size. A cell's ball bounds what a query can find in it (q.c + |q| r), so a
query first asks one shard of its best cell, then the other cells that can still beat its
k-th score so far, best bounds first, in rounds that share the k-th score between them. In a
shard a ball is opened only for the queries that its bound can still improve.
"""

from __future__ import annotations

import heapq
import math
import pickle
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.llm.centroids import kmeans, nearest
from labelmill.llm.common import cut, usable

LEAF = 64
#: The rows that centres are fitted on, and cells of one number of components, at most.
SAMPLE, CELLS = 20_000, 256
#: How many of a query's cells, best bounds first, are asked by the end of each round.
ROUNDS = (1, 16, CELLS)
NONE = np.iinfo(np.int64).min


def ball_tree(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> dict:
    """Nodes split at the median of their widest component down to LEAF rows; node i: center, radius, children or rows."""
    order, nodes, todo = np.arange(len(ids)), [], [(0, len(ids), -1, 0)]
    real = x.astype(float)
    while todo:
        lo, hi, parent, side = todo.pop()
        own = real[order[lo:hi]]
        center = own.mean(axis=0)
        node = {"rows": (lo, hi), "kids": [], "center": center, "radius": math.sqrt(((own - center) ** 2).sum(axis=1).max())}
        if parent >= 0:
            nodes[parent]["kids"].append(len(nodes))
        nodes.append(node)
        if hi - lo > LEAF and node["radius"] > 0:
            axis = int(np.ptp(own, axis=0).argmax())
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
            todo += [(lo, lo + mid, len(nodes) - 1, 0), (lo + mid, hi, len(nodes) - 1, 1)]
    return {"rows": rows[order], "ids": ids[order], "x": x[order], "nodes": [(*n["rows"], n["kids"]) for n in nodes], "centers": np.array([n["center"] for n in nodes]), "radii": np.array([n["radius"] for n in nodes])}


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond 64 bits they stop at the ends of the range."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1]
    if most < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    exact = q.astype(object) @ x.T.astype(object)
    return np.clip(exact, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def search(tree: dict, own_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of the tree, its own row left out, for each query that can reach its floor; NONE where there is none."""
    best, who = np.full((len(q), k), NONE), np.zeros((len(q), k), np.int64)
    kth, real = floor.copy(), q.astype(float)
    norms = np.sqrt((real**2).sum(axis=1))

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        up = real[rows] @ tree["centers"][node] + norms[rows] * tree["radii"][node]
        return up + 1 + 1e-9 * (np.abs(up) + norms[rows] * tree["radii"][node])

    rows = np.arange(len(q))
    up = bound(0, rows)
    heap = [(-up.max(), 0, rows, up)] if len(q) else []
    while heap:
        _, node, rows, up = heapq.heappop(heap)
        live = up >= kth[rows]
        rows = rows[live]
        if not len(rows):
            continue
        lo, hi, kids = tree["nodes"][node]
        for kid in kids:
            up = bound(kid, rows)
            if (up >= kth[rows]).any():
                heapq.heappush(heap, (-up.max(), kid, rows, up))
        if not kids:
            score = _dot(q[rows], tree["x"][lo:hi])
            score[own_rows[rows][:, None] == tree["rows"][None, lo:hi]] = NONE
            hit = (score >= np.maximum(kth[rows], NONE + 1)[:, None]).any(axis=1)
            rows, score = rows[hit], score[hit]
            both = np.concatenate([best[rows], score], axis=1)
            own = np.concatenate([who[rows], np.broadcast_to(tree["ids"][lo:hi], score.shape)], axis=1)
            order = np.lexsort((own, ~both), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(own, order, 1)
            kth[rows] = np.maximum(kth[rows], best[rows][:, -1])
    return best, who


def top_inner_products(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, shard_rows: int = 4096, group_rows: int = 4096) -> DataFrame:
    """Returns query_id, rank (from 1), vec_id, score: each query row's k highest integer inner products, ties to the smaller vec_id.

    vectors: vec_id, embedding; components become floor(scale * x). is_query: a condition on
    vec_id. A query is compared with every other row of its number of components, also with
    rows that repeat its vec_id; each row that repeats is a candidate, and a query, of its
    own. Rows with a null vec_id and vectors that are null or hold null or non-finite
    components take no part. Integers stop at the ends of 64 bits. Queries without
    candidates give no rows. Other columns are ignored. Memory: a shard's tree and a block
    of `group_rows` queries.
    """
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    v = v.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    v = cut(v.withColumn("dim", F.size("v")), "vectors")
    n, asked = v.agg(F.count("*"), F.count_if("query")).first()
    groups = max(1, -(-asked // group_rows))
    sample = v.orderBy(F.xxhash64(F.lit("centres"), "row")).limit(SAMPLE).select("dim", "v").toPandas()  # bounded
    centres = {}
    for dim, own in sample.groupby("dim"):
        many = round(n * len(own) / max(1, len(sample)) / shard_rows)
        centres[int(dim)] = kmeans(np.array(own["v"].tolist(), float).reshape(len(own), int(dim)), max(1, min(CELLS, many, len(own) // 16)))

    def deal(batches):
        for b in batches:
            cell, far = np.zeros(len(b), np.int32), np.zeros(len(b))
            for dim, own in b.groupby("dim").indices.items():
                if dim in centres:
                    x = np.array(b["v"].iloc[own].tolist(), float).reshape(len(own), dim)
                    cell[own] = nearest(x, centres[dim], 1)[:, 0]
                    far[own] = np.sqrt(((x - centres[dim][cell[own]]) ** 2).sum(axis=1))
            yield b.assign(cell=cell, far=far)

    dealt = cut(v.select("row", "vec_id", "v", "dim", "query").mapInPandas(deal, "row long, vec_id long, v array<long>, dim int, query boolean, cell int, far double"), "dealt")
    cells = cut(dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / float(shard_rows)).cast("int").alias("pieces"), F.max("far").alias("radius")), "cells")
    radius = {(r["dim"], r["cell"]): r["radius"] for r in cells.where(F.col("dim").isin(list(centres))).collect()} if centres else {}  # at most CELLS for each length in the sample

    def plant(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), key[0])
        return pd.DataFrame([(*key, pickle.dumps(ball_tree(rows["row"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64), x)))], columns=["dim", "cell", "piece", "tree"])

    unit = ["dim", "cell", "piece"]
    placed = dealt.join(cells.select("dim", "cell", "pieces"), ["dim", "cell"]).withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "row"), F.col("pieces")).cast("int"))
    planted = placed.select("row", "vec_id", "v", *unit).groupBy(*unit).applyInPandas(plant, "dim int, cell int, piece int, tree binary")
    trees = cut(planted, "trees")
    queries = cut(dealt.where("query").select("row", F.col("vec_id").alias("query_id"), "v", "dim"), "queries")

    def aim(first: int, last: int):
        """The cells at places first..last of each query's order of bounds that can still reach its floor."""

        def run(batches):
            for b in batches:
                places, aims = np.zeros(len(b), object), b["floor"].to_numpy(np.int64)
                for dim, own in b.groupby("dim").indices.items():
                    if dim not in centres:
                        for i in own:
                            places[i] = [0] if first == 0 else []
                        continue
                    q = np.array(b["v"].iloc[own].tolist(), float).reshape(len(own), dim)
                    live = np.array([c for c in range(len(centres[dim])) if (dim, c) in radius])
                    dot = q @ centres[dim][live].T
                    far = np.sqrt((q**2).sum(axis=1))[:, None] * np.array([radius[dim, c] for c in live])
                    bound = dot + far + 1 + 1e-9 * (np.abs(dot) + far)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    for i, own_order, own_bound in zip(own, order, bound, strict=True):
                        places[i] = [int(c) for c in live[own_order[own_bound[own_order] >= aims[i]]]]
                yield b.assign(cells=places)

        return run

    def ask(key: tuple[Any, ...], tree: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(tree) or not len(rows):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        q = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), key[0])
        own, grown, out = rows["row"].to_numpy(np.int64), pickle.loads(tree["tree"].iloc[0]), []
        for i in range(0, len(own), 256):
            best, who = search(grown, own[i : i + 256], q[i : i + 256], rows["floor"].to_numpy(np.int64)[i : i + 256], k)
            row, col = np.nonzero(best != NONE)
            out.append(pd.DataFrame({"row": own[i : i + 256][row], "query_id": rows["query_id"].to_numpy(np.int64)[i : i + 256][row], "vec_id": who[row, col], "score": best[row, col]}))
        return pd.concat(out)

    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    found, before = None, 0
    home = F.pmod(F.xxhash64(F.lit("home"), "row"), F.col("pieces")).cast("int")  # the shard of its best cell that a query asks first
    for at, upto in enumerate(ROUNDS):
        floor = queries.withColumn("floor", F.lit(NONE))
        if found is not None:
            kth = found.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("row", "floor")
            floor = queries.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
        aims = lambda first, last: floor.mapInPandas(aim(first, last), "row long, query_id long, v array<long>, dim int, floor long, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells").join(cells.select("dim", "cell", "pieces"), ["dim", "cell"])  # noqa: B023, E731
        pieces = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
        if at == 0:
            asks = aims(0, upto).withColumn("piece", home)
        else:
            asks = aims(before, upto).withColumn("piece", pieces)
            if at == 1:  # and the rest of the best cell
                asks = asks.union(aims(0, before).withColumn("piece", pieces).where(F.col("piece") != home))
        asks = cut(asks.drop("pieces").withColumn("grp", F.pmod(F.xxhash64(F.lit("grp"), "row"), F.lit(groups)).cast("int")), "asks")
        wanted = trees.join(asks.select(*[F.col(c).alias(c) for c in (*unit, "grp")]).distinct(), unit)  # only shards that somebody asks, once for each block of queries
        got = wanted.groupBy(*unit, "grp").cogroup(asks.groupBy(*unit, "grp")).applyInPandas(ask, "row long, query_id long, vec_id long, score long")
        got = got if found is None else found.union(got)
        found, before = cut(got.withColumn("rank", place).where(F.col("rank") <= k).drop("rank"), "found"), upto
    return found.withColumn("rank", place).select("query_id", "rank", "vec_id", "score")

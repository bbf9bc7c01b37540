"""Near-duplicate embeddings by product quantisation.

Coarse centroids and residual codebooks are fitted on a bounded sample; every vector goes
to its nearest list with its code and its code's error, and asks every list that may hold
a vector within reach: the bisector of the two centroids and the list's radius both bound
how near its members can be, so no link is lost between lists. Of two lists that ask each
other one does. Centroids nearer than the reach are one list, and lists are coarsened until
a vector of the sample asks few, since a bound that can't tell lists apart only costs copies.

In a list, asymmetric table-lookup distances pass every pair that the threshold allows,
given the stored error of the code, so nothing is lost there either; pairs that pass are
reranked by exact cosine. Copies of a vector are one entry. Tasks return sums and a
spanning forest, never pairs. Long lists are split into tiles on both sides.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.centroids import kmeans, nearest
from labelmill.llm.common import cut, usable
from labelmill.llm.components import components

SAMPLE, PROBES, TILE, SUBSPACES, WORDS = 20_000, 8, 4096, 8, 64
#: Vector lengths, the most frequent ones, that get lists and codes of their own; of the others those with more than TILE vectors do too.
LENGTHS = 16


class Codes:
    """Coarse centroids, and codebooks of the residuals for each subspace."""

    def __init__(self, sample: np.ndarray, coarse: np.ndarray):
        self.coarse = coarse
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        rest = sample - self.coarse[nearest(sample, self.coarse, 1)[:, 0]]
        self.books = [kmeans(rest[:, s], WORDS) for s in self.cuts]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance between each vector and what its code stands for."""
        rest = x - self.coarse[home]
        code = np.stack([nearest(rest[:, s], b, 1)[:, 0] for s, b in zip(self.cuts, self.books, strict=True)], axis=1)
        back = np.concatenate([b[code[:, j]] for j, b in enumerate(self.books)], axis=1)
        return code.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(axis=1))

    def distances(self, y: np.ndarray, centroid: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of one list's codes (rows) to the vectors y (columns): a table for each subspace, a row of it for each code."""
        rest, total = y - centroid, np.zeros((len(code), len(y)), np.float32)
        for j, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = (b**2).sum(axis=1)[:, None] - 2 * b @ rest[:, s].T + (rest[:, s] ** 2).sum(axis=1)
            total += table.astype(np.float32)[code[:, j]]
        return total


class Forest:
    """Of the edges it is given, those that connect what was not connected before."""

    def __init__(self, nodes: int):
        self.label = np.arange(nodes)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the edges (a, b) that connect."""
        used, left, pick = [], np.arange(len(a)), np.zeros(len(self.label), int)
        while len(left := left[self.label[a[left]] != self.label[b[left]]]):
            p = self.label[a[left]]
            pick[p] = left
            own = left[pick[p] == left]  # one edge for each tree
            up = np.arange(len(self.label))

            def find(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            ends = self.label[a[own]].tolist(), self.label[b[own]].tolist()
            for i, x, y in zip(own.tolist(), *ends, strict=True):
                if (p := find(x)) != (q := find(y)):
                    up[p] = q
                    used.append(i)
            for x in {*ends[0], *ends[1]}:
                up[x] = find(x)
            self.label = up[self.label]
        return np.array(used, int)


def may_hold(y: np.ndarray, coarse: np.ndarray, reach: float, radii: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest list of each y, and which lists may hold a vector within reach of it (a vector is held by its nearest)."""
    d = (y**2).sum(axis=1)[:, None] + (coarse**2).sum(axis=1) - 2 * y @ coarse.T
    home = d.argmin(axis=1)
    apart = np.sqrt(np.maximum((coarse[home] ** 2).sum(axis=1)[:, None] + (coarse**2).sum(axis=1) - 2 * coarse[home] @ coarse.T, 1e-12))
    asks = d - d[np.arange(len(y)), home][:, None] <= 2 * apart * reach
    if radii is not None:
        asks &= np.sqrt(np.maximum(d, 0)) <= radii + reach
    asks[np.arange(len(y)), home] = True
    return home, asks


def lists(sample: np.ndarray, many: int, reach: float, probes: float) -> np.ndarray:
    """At most `many` coarse centroids no nearer to each other than the reach, so few that a vector asks about `probes`."""
    while True:
        fit = kmeans(sample, many)
        size = np.bincount(nearest(sample, fit, 1)[:, 0], minlength=len(fit))
        kept = np.zeros((0, sample.shape[1]))
        for c in fit[np.argsort(-size, kind="stable")]:
            if not len(kept) or ((kept - c) ** 2).sum(axis=1).min() >= max(reach, 1e-4) ** 2:
                kept = np.concatenate([kept, c[None]])
        if len(kept) <= probes or np.mean([may_hold(sample[i : i + 512], kept, reach)[1].sum(axis=1).mean() for i in range(0, min(2048, len(sample)), 512)]) <= probes:
            return kept
        many = min(many, len(kept)) // 2


def _found(groups: DataFrame, dim: int, threshold: float, probes: int, tile: int) -> DataFrame:
    """groups: gid, v (arrays of dim components), n. Rows (src, n) of link counts and (src, dst) of a spanning forest."""
    own = groups.where(F.size("v") == dim)
    count = own.count()
    tile = max(tile, min(8 * tile, count // 16))
    rows = own.select("v").orderBy(F.xxhash64("gid")).limit(SAMPLE).toPandas()["v"]  # the bounded sample that the codes are fitted on
    sample = np.array(rows.tolist(), float)
    sample /= np.sqrt((sample**2).sum(axis=1))[:, None]
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    codes = Codes(sample, lists(sample, max(1, min(4096, round(count**0.5 / 2))), radius, probes))
    kind = "float" if groups.schema["v"].dataType.elementType.typeName() == "float" else "double"
    raw = np.float32 if kind == "float" else np.float64
    v_only = own.select("gid", "n", F.transform("v", lambda x: x.cast(kind)).alias("v"))

    def pieces(batches):
        for b in batches:
            for i in range(0, len(b), 1024):
                f = b.iloc[i : i + 1024]
                v = np.array(f["v"].tolist(), float).reshape(len(f), dim)
                yield f, v, v / np.sqrt((v**2).sum(axis=1))[:, None]

    def reaches(batches):
        for _, _, x in pieces(batches):
            home = nearest(x, codes.coarse, 1)[:, 0]
            yield pd.DataFrame({"home": home, "far": np.sqrt(((x - codes.coarse[home]) ** 2).sum(axis=1))}).groupby("home", as_index=False).max()

    radii = np.full(len(codes.coarse), -np.inf)
    for home, far in v_only.select("v").mapInPandas(reaches, "home int, far double").groupBy("home").max("far").collect():  # at most 4096 lists
        radii[home] = far + 1e-6

    def code(batches):
        every = np.arange(len(codes.coarse))
        for f, v, x in pieces(batches):
            home = nearest(x, codes.coarse, 1)[:, 0]
            asks = may_hold(x, codes.coarse, radius, radii)[1]
            even = (home[:, None] + every) % 2 == 0
            asks &= np.where(even, every < home[:, None], every > home[:, None])  # of two lists one asks
            asks[np.arange(len(x)), home] = True
            got, err = codes.encode(x, home)
            yield pd.DataFrame({"gid": f["gid"].to_numpy(), "n": f["n"].to_numpy(), "v": [r.tobytes() for r in v.astype(raw)], "home": home.astype("int32"), "asks": [np.flatnonzero(r).astype("int32") for r in asks], "code": [r.tobytes() for r in got], "err": err})

    coded = cut(v_only.mapInPandas(code, "gid long, n long, v binary, home int, asks array<int>, code binary, err double"), "codes")
    asked = coded.select("gid", "n", "v", "home", F.explode("asks").alias("list"))
    tiles = lambda df: F.create_map(*[F.lit(x) for r in df.groupBy("list").count().where(F.col("count") > tile).collect() for x in (r[0], -(-r[1] // tile))] or [F.lit(-1), F.lit(1)])  # noqa: E731  at most 4096 lists
    kept = coded.select("gid", "n", "v", "code", "err", F.col("home").alias("list"))
    x_tiles, y_tiles = tiles(kept), tiles(asked)
    many = lambda m: F.coalesce(m[F.col("list")], F.lit(1)).cast("int")
    deal = lambda m: F.pmod(F.xxhash64("gid"), many(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), many(m) - 1))
    x = kept.withColumn("xt", deal(x_tiles)).withColumn("yt", every(y_tiles))
    y = asked.withColumn("yt", deal(y_tiles)).withColumn("xt", every(x_tiles))

    def compare(key: tuple[Any, ...], x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"src": [], "dst": [], "n": []}).astype({"src": "int64", "dst": "Int64", "n": "int64"})
        if not len(x) or not len(y):
            return none
        real = lambda f: np.frombuffer(b"".join(f["v"]), raw).reshape(len(f), dim).astype(float)
        vx, nx, gx = real(x), x["n"].to_numpy(), x["gid"].to_numpy()
        norm = np.sqrt((vx**2).sum(axis=1))
        code = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
        reach = ((radius + x["err"].to_numpy()) ** 2 * (1 + 1e-4) + 1e-4).astype(np.float32)[:, None]  # with room for single precision
        gy_all, ny_all, away = y["gid"].to_numpy(), y["n"].to_numpy(), y["home"].to_numpy() != key[0]
        gids, node = np.unique(np.concatenate([gx, gy_all]), return_inverse=True)
        forest, sums, out = Forest(len(gids)), np.zeros(len(gids), np.int64), [none]
        step = max(16, (1 << 19) // len(x))
        for i in range(0, len(y), step):
            vy, gy, ny, out_of = real(y.iloc[i : i + step]), gy_all[i : i + step], ny_all[i : i + step], away[i : i + step]
            far = np.sqrt((vy**2).sum(axis=1))
            c, r = np.divmod(np.flatnonzero(codes.distances(vy / far[:, None], codes.coarse[key[0]], code) <= reach), len(vy))
            dots = (vy @ vx.T)[r, c] if 32 * len(r) > len(vy) * len(vx) else np.einsum("ij,ij->i", vy[r], vx[c])
            ok = (dots / (far[r] * norm[c]) >= threshold) & (gy[r] != gx[c])
            r, c = r[ok], c[ok]
            a, b, other = node[c], node[len(gx) + i + r], out_of[r]  # links within a list are found from both ends, others here alone
            sums += np.bincount(a, ny[r], len(gids)).astype(np.int64) + np.bincount(b[other], nx[c[other]], len(gids)).astype(np.int64)
            used = forest.add(a, b)
            out.append(pd.DataFrame({"src": gids[a[used]], "dst": gids[b[used]], "n": 0}).astype({"dst": "Int64"}))
        some = np.flatnonzero(sums)
        out.append(pd.DataFrame({"src": gids[some], "dst": pd.NA, "n": sums[some]}).astype({"dst": "Int64"}))
        return pd.concat(out)[["src", "dst", "n"]]

    unit = ["list", "xt", "yt"]
    return x.groupBy(*unit).cogroup(y.groupBy(*unit)).applyInPandas(compare, "src long, dst long, n long")


def _few(threshold: float):
    """Links within a group of at most `tile` vectors of one length, as _found gives them."""

    def compare(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        x, n, gid = np.array(rows["v"].tolist(), float).reshape(len(rows), key[0]), rows["n"].to_numpy(), rows["gid"].to_numpy()
        norm, none = np.sqrt((x**2).sum(axis=1)), {"src": "int64", "dst": "Int64", "n": "int64"}
        forest, sums, out = Forest(len(x)), np.zeros(len(x), np.int64), [pd.DataFrame({"src": [], "dst": [], "n": []}).astype(none)]
        for i in range(0, len(x), 256):
            near = (x[i : i + 256] @ x.T) / (norm[i : i + 256, None] * norm) >= threshold
            near[np.arange(len(near)), i + np.arange(len(near))] = False
            sums[i : i + 256] = near @ n
            a, b = np.nonzero(near)
            used = forest.add(a + i, b)
            out.append(pd.DataFrame({"src": gid[a[used] + i], "dst": gid[b[used]], "n": 0}).astype(none))
        some = np.flatnonzero(sums)
        out.append(pd.DataFrame({"src": gid[some], "dst": pd.NA, "n": sums[some]}).astype(none))
        return pd.concat(out)[["src", "dst", "n"]]

    return compare


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, probes: int = PROBES, tile: int = TILE) -> DataFrame:
    """Returns vec_id, n_links (other rows with cosine >= threshold), component_id (smallest vec_id reachable), kept.

    One row for each input row. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different length. Rows that repeat link
    with each other. A null vec_id is never the smallest; a component of null ids alone has a
    null component_id and is not kept. Other columns are ignored. Every link is found;
    `probes` and `tile` only say how finely the work is cut.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    zero = F.forall("v", lambda x: x == 0)
    fit = usable(F.col("v")) & ~F.coalesce(zero, F.lit(True))
    groups = rows.where(fit).groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).withColumn("gid", F.monotonically_increasing_id())
    groups = cut(groups, "groups")
    found = None
    lengths = cut(groups.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("of_length")), "lengths")
    often = lengths.orderBy(F.desc("of_length"), "dim").limit(LENGTHS).union(lengths.where(F.col("of_length") > tile)).distinct()
    chains = sorted(r["dim"] for r in often.collect())  # LENGTHS, and what has more than `tile` vectors
    for dim in chains:
        own = cut(_found(groups, dim, threshold, probes, tile), "links")
        found = own if found is None else found.union(own)
    if found is not None:
        rare = groups.withColumn("dim", F.size("v")).join(lengths, "dim").where((F.col("of_length") > 1) & ~F.col("dim").isin(chains))
        found = found.union(rare.select("dim", "gid", "n", F.transform("v", lambda x: x.cast("double")).alias("v")).groupBy("dim").applyInPandas(_few(threshold), "src long, dst long, n long"))
    if found is None:
        found = groups.select(F.col("gid").alias("src"), F.col("gid").alias("dst"), "n")
    sums = found.where("n > 0").groupBy(F.col("src").alias("gid")).agg(F.sum("n").alias("others"))
    label = components(found.where("dst is not null")).select(F.col("node").alias("gid"), F.col("component").alias("label"))
    labelled = cut(groups.join(sums, "gid", "left").join(label, "gid", "left").select("v", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("label", "gid").alias("label")), "labelled")
    least = cut(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "components")
    to = cut(labelled.join(least, "label").select("v", "n_links", "component_id"), "vector-components")
    linked = rows.where(fit).join(to, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

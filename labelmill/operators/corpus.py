"""Corpus ingestion: host policy, content uniqueness, upserts, chunks, embeddings, retrieval."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions.base import when_chain
from labelmill.functions.text import url_host
from labelmill.operators.lineage import cut, text_batches


def domain_policy(pages: DataFrame, approved: DataFrame, blocked: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, verdict (unparseable, blocked, not_approved, approved), priority and min_score.

    approved: domain, priority, min_score; blocked: domain, reason. Hosts match exactly; blocked wins.
    """
    p = pages.withColumn("host", url_host(F.col(url)))
    ok = approved.select(F.col("domain").alias("host"), "priority", "min_score", F.lit(True).alias("_ok"))
    no = blocked.select(F.col("domain").alias("host"), F.col("reason").alias("_reason"), F.lit(True).alias("_no"))
    j = p.join(no, "host", "left").join(ok, "host", "left")
    verdict = when_chain([(F.col("host") == "", "unparseable"), (F.col("_no").isNotNull(), "blocked"), (F.col("_ok").isNull(), "not_approved")], "approved")
    j = j.withColumn("verdict", verdict)
    only = lambda c: F.when(F.col("verdict") == "approved", F.col(c))
    return j.withColumn("priority", only("priority")).withColumn("min_score", only("min_score")).drop("_ok", "_no", "_reason")


def fetch_gate(status: Column, content_type: Column, size: Column, most: int = 20 << 20) -> Column:
    """Why a fetched page is refused: status, content_type or size; null if it is not."""
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    return when_chain([(~status.between(200, 299), "status"), (~kind.isin("text/html", "application/pdf"), "content_type"), (size > most, "size")])


def new_content(batch: DataFrame, known: DataFrame, key: str, content: Column) -> DataFrame:
    """Rows of batch (with hash) whose content is neither in known (hash) nor earlier in the batch by key."""
    h = batch.withColumn("hash", F.sha2(content, 256)).join(known.select("hash").distinct(), "hash", "left_anti")
    first = h.groupBy("hash").agg(F.min(key).alias(key))  # a grouped minimum: copies are combined before they are dealt
    return h.join(first, ["hash", key], "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def hash_embedding(docs: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """(key, bucket, weight): unit-length counts of tokens by hash bucket, sparse; each distinct token of a text is hashed once.

    A text is counted where it is read and sent on as its counts, at most `dim`; texts of one key count together.
    """
    from labelmill.functions.helpers import bucket_counts

    text_batches(docs.sparkSession)
    c = docs.where(F.col(key).isNotNull()).select(key, bucket_counts(dim)(F.lower(F.col(text))).alias("c")).repartition(key)
    b = c.select(key, F.explode(F.arrays_zip(F.col("c.b").alias("bucket"), F.col("c.n").alias("n"))).alias("c")).groupBy(key, F.col("c.bucket").alias("bucket")).agg(F.sum("c.n").alias("n"))
    whole = b.groupBy(key).agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("norm"), F.collect_list(F.struct("bucket", "n")).alias("c"))  # at most dim
    return whole.select(key, "norm", F.explode("c").alias("c")).select(key, "c.bucket", (F.col("c.n") / F.col("norm")).alias("weight"))


#: Vectors that pivots are fitted on, pivots at most, and queries that a task compares at a time.
FITTED, PIVOTS, AT_ONCE = 20_000, 1024, 512


def pivots_of(x: np.ndarray, many: int, rounds: int = 6) -> np.ndarray:
    """Centres of x by a few rounds of moving each to the mean of its vectors."""
    c = x[np.linspace(0, len(x) - 1, min(many, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = to_pivots(x, c).argmin(axis=1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def to_pivots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all pivots."""
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * (x @ c.T), 0))


def cells_to_ask(far: np.ndarray, radius: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Which cells can hold a vector within kth of a query, by the triangle inequality; far: distances of queries to pivots."""
    least = np.maximum(far - radius, 0)
    return least**2 <= kth[:, None] ** 2 * (1 + 1e-7) + 1e-7


def _ready(vectors, by: str) -> np.ndarray:
    x = np.array(vectors.tolist(), float)
    if by != "cosine":
        return x
    norm = np.sqrt((x**2).sum(axis=1))[:, None]
    return x / np.where(norm > 0, norm, 1)


def some_to_pivots(vectors: pd.Series, c: np.ndarray, by: str):
    """to_pivots for AT_ONCE vectors at a time, as a batch may hold many and pivots are up to PIVOTS."""
    return (to_pivots(_ready(vectors.iloc[a : a + AT_ONCE], by), c) for a in range(0, len(vectors), AT_ONCE))


def nearest_vectors(queries: DataFrame, chunks: DataFrame, k: int = 8, by: str = "cosine", block: int = 8192, shard: int = 8192) -> DataFrame:
    """(query_id, chunk_id, value, rank): the k chunks of highest cosine, or least Euclidean distance (by="euclid"), other than the query itself.

    queries: query_id, q; chunks: chunk_id, v, of one length. Chunks stand in cells around pivots (of a bounded sample),
    about `shard` in each; a larger cell is several shards. A query asks the cell of its nearest pivot, then those whose
    pivot and radius allow a vector as near as its k-th so far (for cosines: distances of unit vectors), so the result is
    exact. A cell's shard meets only the blocks of queries that ask it. Values are compared to nine places, ties go to the
    smaller chunk_id; a zero vector has cosine 0 with everything.
    """
    spark = chunks.sparkSession
    sizes = queries.agg(F.count("*").alias("n")).crossJoin(chunks.agg(F.count("*").alias("m"))).first()  # one row each
    blocks, cells = max(1, -(-sizes["n"] // block)), min(PIVOTS, max(1, -(-sizes["m"] // shard)))
    every = max(1, sizes["m"] // FITTED)
    sample = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(every)) == 0).orderBy("chunk_id").select("v").limit(2 * FITTED).toPandas()["v"] if cells > 1 else []
    centres = pivots_of(_ready(sample, by), cells) if len(sample) else None

    @F.pandas_udf("struct<cell:int,far:double>")
    def placed_at(v: pd.Series) -> pd.DataFrame:
        if centres is None or not len(v):
            return pd.DataFrame({"cell": np.zeros(len(v), np.int32), "far": np.zeros(len(v))})
        return pd.concat([pd.DataFrame({"cell": far.argmin(axis=1).astype(np.int32), "far": far.min(axis=1)}) for far in some_to_pivots(v, centres, by)], ignore_index=True)

    held = cut(chunks.select(F.col("chunk_id").alias("id"), "v", placed_at("v").alias("p")).select("id", "v", "p.cell", "p.far"), "cells")
    about = held.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()  # a row for each pivot
    radius = np.full(cells if centres is None else len(centres), -np.inf)
    for r in about:
        radius[r["cell"]] = r["radius"] + 1e-9
    split = spark.createDataFrame([(r["cell"], -(-r["n"] // shard)) for r in about], "cell int, shards int")
    held = held.join(F.broadcast(split), "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("s"))
    shards = split.select("cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"))

    def meet(key: tuple[Any, ...], asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "chunk_id": [], "value": []}).astype({"query_id": "int64", "chunk_id": "int64", "value": "float64"})
        if not len(asks) or not len(own):
            return none
        y, ids, out = _ready(own["v"], by), own["id"].to_numpy(), [none]
        for a in range(0, len(asks), AT_ONCE):
            x, who = _ready(asks["v"].iloc[a : a + AT_ONCE], by), asks["id"].to_numpy()[a : a + AT_ONCE]
            value = x @ y.T if by == "cosine" else to_pivots(x, y)
            value[who[:, None] == ids] = -np.inf if by == "cosine" else np.inf
            sign, many = (-1 if by == "cosine" else 1), min(k, len(ids))
            edge = np.partition(sign * value, many - 1, axis=1)[:, many - 1] + 1e-7  # all that may tie at nine places
            for i in range(len(x)):
                near = np.flatnonzero((sign * value[i] <= edge[i]) & np.isfinite(value[i]))
                exact = value[i, near] if by == "cosine" else np.sqrt(((y[near] - x[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], np.round(sign * exact, 9)))[:k]
                out.append(pd.DataFrame({"query_id": who[i], "chunk_id": ids[near[best]], "value": exact[best]}))
        return pd.concat(out)

    def answers(asks: DataFrame) -> DataFrame:
        """asks: id, v, cell."""
        q = asks.join(shards, "cell").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        met = q.select(*[F.col(x).alias(f"to_{x}") for x in ("cell", "s", "b")]).distinct()
        c = held.join(met, (F.col("cell") == F.col("to_cell")) & (F.col("s") == F.col("to_s"))).select("id", "v", *[F.col(f"to_{x}").alias(f"c_{x}") for x in ("cell", "s", "b")])
        return cut(q.groupBy("cell", "s", "b").cogroup(c.groupBy("c_cell", "c_s", "c_b")).applyInPandas(meet, "query_id long, chunk_id long, value double"), "answers")

    own = queries.select(F.col("query_id").alias("id"), F.col("q").alias("v"))
    if centres is None:
        found = answers(own.withColumn("cell", F.lit(0)))
    else:
        own = cut(own.withColumn("cell", placed_at("v")["cell"]), "asks")
        found = answers(own)
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), (F.array_sort(F.collect_list(F.col("value") if by != "cosine" else -F.col("value")))[k - 1]).alias("kth"))  # at most k for each shard of a cell

        @F.pandas_udf("array<int>")
        def more(v: pd.Series, cell: pd.Series, kth: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            worst = kth.to_numpy(float)
            reach = np.where(np.isnan(worst), np.inf, np.sqrt(np.maximum(2 + 2 * worst, 0)) if by == "cosine" else worst)
            out = []
            for far in some_to_pivots(v, centres, by):
                at = np.arange(len(out), len(out) + len(far))
                ask = cells_to_ask(far, radius, reach[at])
                ask[np.arange(len(far)), cell.to_numpy()[at]] = False
                ask[:, np.isinf(radius)] = False
                out += [np.flatnonzero(a).astype(np.int32).tolist() for a in ask]
            return pd.Series(out)

        known = F.when(F.col("n") >= k, F.col("kth"))
        wider = own.join(kth, own["id"] == kth["query_id"], "left").select("id", "v", F.explode(more("v", "cell", known.cast("double"))).alias("cell"))
        found = found.union(answers(wider))
    order = F.round("value", 9)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order.desc() if by == "cosine" else order.asc(), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def provenance(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, context): cited chunks of a candidate rendered in order. citations: id, chunk_id; chunks: chunk_id, section, page, text."""
    head = F.format_string("[chunk:%s] (section: %s, page: %s)", F.col("chunk_id").cast("string"), F.coalesce("section", F.lit("-")), F.coalesce(F.col("page").cast("string"), F.lit("-")))
    row = F.struct("chunk_id", F.concat_ws("\n", head, "text").alias("line"))
    g = citations.join(chunks, "chunk_id").groupBy("id").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # a candidate cites a few chunks
    return g.select("id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("context"))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, section): each line with the last heading at or above it."""
    from labelmill.functions.text import is_heading

    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(is_heading(F.col("line")), F.trim("line")), ignorenulls=True).over(upto))

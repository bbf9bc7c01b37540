"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code on 64 bits: two [23,12] Golay blocks (radius
3 each, perfect) and two [9,1] repetition blocks (radius 4 each, perfect), so 2^26 anchors
with covering radius 14. Two fingerprints that differ in at most 2 bits have a midpoint
within one bit of both, and the anchor that covers the midpoint lies within the radius
plus one of both. So each fingerprint is replicated to the anchors that cover the points
within its half of the threshold (about 11 of them), and fingerprints are compared per
anchor. An anchor that attracts more than CROWD fingerprints is not compared pairwise:
its fingerprints go to the finest code there is, all points (radius 0), where those that
share an anchor are within the threshold by construction and need no comparing.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm import shingles
from labelmill.llm.common import cut, free_name, numbered, words_lower
from labelmill.llm.components import components

#: Fingerprints that an anchor compares pairwise; beyond it they go to the finest code. Either way gives the same links: a small number costs
#: more replicas (65 of each fingerprint in a crowded anchor), a large one more pairs (half its square for an anchor).
CROWD = 64
#: Shingles whose hashes are held at a time.
SLICE = 1 << 16
#: Generator polynomial of the [23,12] Golay code.
GOLAY = 0b110001110101


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits: each the majority of that bit over the XXH64 (seed 42) of all word shingles; 0 without words."""
    words = words_lower(text)
    if not words:
        return 0
    line, at = b" ".join(words), list(accumulate((len(w) + 1 for w in words), initial=0))
    digest, total, last = xxhash.xxh64_digest, np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for i in range(0, last, SLICE):
        own = [line] if last == 1 else [line[a : b - 1] for a, b in zip(at[i : min(i + SLICE, last)], at[i + width :])]  # noqa: B905
        total += np.unpackbits(np.frombuffer(b"".join([digest(x, 42) for x in own]), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > last).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in text], np.uint64).view(np.int64))


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GOLAY << (bit - 11), 0)
    return v


def _leaders() -> np.ndarray:
    """The error of weight 3 or less for each of the 2048 syndromes."""
    errors = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)] + [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    errors = np.array(errors, np.int64)
    out = np.zeros(2048, np.int64)
    out[_syndrome(errors)] = errors
    return out


def _golay(v: np.ndarray) -> np.ndarray:
    """The 12 bits that name the codeword nearest to v."""
    return (v ^ _leaders()[_syndrome(v)]) >> 11


def _flips(bits: int, half: int) -> list[int]:
    """All masks of at most `half` bits, the empty one first."""
    masks = {0}
    for _ in range(half):
        masks |= {m ^ 1 << i for m in masks for i in range(bits)}
    return sorted(masks, key=lambda m: (m.bit_count(), m))


def anchors(prints: np.ndarray, half: int = 1) -> np.ndarray:
    """(n, masks) anchors that cover the points within `half` bits of each fingerprint; repeats are -1."""
    x = prints.view(np.uint64)
    ones = np.array([i.bit_count() for i in range(512)])
    name = lambda p: _golay((p & np.uint64(0x7FFFFF)).astype(np.int64)) | _golay((p >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)) << 12 | (ones[(p >> np.uint64(46) & np.uint64(511)).astype(int)] > 4).astype(np.int64) << 24 | (ones[(p >> np.uint64(55)).astype(int)] > 4).astype(np.int64) << 25
    out = np.sort(np.stack([name(x ^ np.uint64(m)) for m in _flips(64, half)], axis=1), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def _spread(prints: DataFrame, to) -> DataFrame:
    """(anchor, fp) rows; to(int64 array) gives a row of anchors for each fingerprint, -1 where there is none."""

    def run(batches):
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for i in range(0, len(fp), 4096):
                own = to(fp[i : i + 4096])
                row, col = np.nonzero(own != -1) if own.dtype == np.int64 else np.nonzero(np.ones(own.shape, bool))
                yield pd.DataFrame({"anchor": own[row, col].view(np.int64), "fp": fp[i : i + 4096][row]})

    return prints.select("fp").mapInPandas(run, "anchor long, fp long")


def links(prints: DataFrame, half: int = 1, crowd: int = CROWD) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (fp) that connect all pairs within 2 * half bits, and no others."""
    spread = cut(_spread(prints, lambda x: anchors(x, half)), "anchors")
    size = cut(spread.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchor-sizes")
    few = cut(spread.join(size.where(F.col("n") <= crowd), "anchor").select("anchor", "fp"), "anchors-few")
    a, b = few.select("anchor", F.col("fp").alias("src")), few.select("anchor", F.col("fp").alias("dst"))
    near = a.join(b, "anchor").where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2 * half))
    many = spread.join(size.where(F.col("n") > crowd), "anchor").select("fp").distinct()
    masks = np.array(_flips(64, half), np.uint64)
    points = cut(_spread(many, lambda x: x.view(np.uint64)[:, None] ^ masks), "points")
    least = cut(points.groupBy("anchor").agg(F.min("fp").alias("src"), F.max("fp").alias("top")).where("src < top").drop("top"), "points-least")
    star = points.join(least, "anchor").select("src", F.col("fp").alias("dst")).where("src < dst")
    return near.select("src", "dst").union(star).distinct()


def near_duplicates(docs: DataFrame, half: int = 1, crowd: int = CROWD) -> DataFrame:
    """Returns doc_id, fp (signed 64 bits) and component_id (smallest doc_id reachable by links of at most 2 * half bits).

    One row for each input row; null and blank texts have fingerprint 0 and link like any
    other. Rows that repeat get the same component. Null ids take part but are never the
    smallest; a component of null ids alone has a null component_id. Other columns are
    ignored. `crowd` moves work, not results (see CROWD).
    """
    prints = cut(docs.select("doc_id", fingerprint_udf("text").alias("fp")), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints-distinct")
    label = components(links(distinct, half, crowd)).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    labelled = cut(distinct.join(label, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "fingerprints-labelled")
    least = cut(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "components")
    to = cut(labelled.join(least, "label").select("fp", "component_id"), "fingerprint-components")
    return prints.join(to, "fp").select("doc_id", "fp", "component_id")


def _proposed(sets: DataFrame, half: int, crowd: int) -> DataFrame:
    """Pairs (a, b) of rows that share an anchor within 2 * half bits, one for each link of fingerprints and each row beyond a fingerprint's first."""
    by = cut(sets.groupBy("fp").agg(F.min("row").alias("first")), "print-rows")
    same = sets.join(by, "fp").where("row > first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    end = lambda c, to: by.select(F.col("fp").alias(c), F.col("first").alias(to))
    near = links(by, half, crowd).join(end("src", "a"), "src").join(end("dst", "b"), "dst").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.union(near).distinct()


def deduplicated(docs: DataFrame, half: int = 1, width: int = 5, least: float = 0.8, crowd: int = CROWD, stored: bool = False) -> DataFrame:
    """The rows of docs, one for each group of near copies: that with the smallest doc_id (of rows that repeat it, one).

    Near copies: the sets of `width`-word shingles have Jaccard similarity `least` or more,
    directly or along a chain. Fingerprints of those sets propose pairs by anchors, and the
    texts decide. At 0.8 fingerprints differ in ten bits or so, far more than any cover can
    afford, so a prefix filter (see shingles) finds, without loss, the groups that anchors
    leave apart. Null and blank texts are alike. A group of null ids alone keeps its first
    row. All columns are kept, whatever they are called; an empty table stays empty. stored:
    docs is a Parquet table as read, of which no copy is written.
    """
    row = free_name(docs, "row")
    docs_rows = numbered(docs, row, stored)
    texts = docs_rows.select(F.col(row).alias("row"), "text")
    parts = cut(shingles.parts(texts, width, least), "parts")
    ids = docs_rows.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias("id"))
    sets = cut(parts.select("row", "key", "fp").join(ids, "row").groupBy("key").agg(F.min("id").alias("id"), F.first("fp").alias("fp")).select(F.col("id.row").alias("row"), "id", "fp"), "sets")
    once = parts.join(sets.select("row"), "row", "left_semi").select("row", "size", "part", "late", "last")
    anchored = _proposed(sets.select("row", "fp"), half, crowd)
    label = components(shingles.links(texts, once, width, least, anchored), "a", "b").withColumnRenamed("node", "row")
    kept = sets.join(label, "row", "left").groupBy(F.coalesce("component", "row").alias("label")).agg(F.min("id").alias("id")).select(F.col("id.row").alias(row))
    return docs_rows.join(cut(kept, "kept"), row, "left_semi").select(*docs.columns)

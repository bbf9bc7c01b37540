"""Near-duplicates by exact Jaccard similarity of word shingles.

Of two sets whose similarity reaches the threshold, the parts that come first in any common
order of shingles share one (prefix filter), so only those parts are spread, rare shingles
first, and nothing is lost. Copies of a set are one entry. How much of the parts counts rests
on both sizes: of two sets of n shingles at 0.8 the first ninth, not the first fifth, so that
a set with many shingles of its own does not meet all others by those that are common. Each
shingle first proposes pairs with one set alone, the one that it stands foremost in, which
has the fewest of its own; all its pairs are proposed only where the groups found so far
still differ, so a hot group of near copies costs a star, not its square. Every proposed
pair is checked on the texts.
"""

from __future__ import annotations

import hashlib
import math
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labelmill.llm.common import cut, words_lower
from labelmill.llm.components import components

#: Documents that tell which shingles are common, in how many of them such a one is, and how many are kept.
SAMPLE, COMMON, MOST = 8_000, 4, 50_000
#: Texts whose shingles a worker holds at a time.
SLICE = 256
#: Rows that a list of rows may have to be broadcast (8 bytes each).
ASKED = 1_000_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; fewer words are one shingle."""
    words = words_lower(text)
    line, at = b" ".join(words), list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_digest
    hashes = digest(line, 42) if len(words) <= width else b"".join([digest(line[a : b - 1], 42) for a, b in zip(at, at[width:])])  # noqa: B905
    return np.unique(np.frombuffer(hashes, np.int64))


def first_part(own: np.ndarray, least: float, common: np.ndarray) -> tuple[np.ndarray, bool, int]:
    """What any set similar to `own` shares a shingle with, in 40 bits, and where it ends in the common order: `common` shingles last, then by value."""
    many = len(own) - math.ceil(least * len(own) - 1e-9) + 1
    at = np.searchsorted(common, own)
    late = common[np.minimum(at, len(common) - 1)] == own if len(common) else np.zeros(len(own), bool)
    part = np.concatenate([own[~late], own[late]])[:many]
    return part & ((1 << 40) - 1), len(part) > (~late).sum(), int(part[-1])


def set_print(own: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes: each bit the majority of that bit over the set, as a signed number."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(own), 1 << 16):
        total += np.unpackbits(own[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(own)).tobytes(), "little", signed=True)


def parts(texts: DataFrame, width: int, least: float) -> DataFrame:
    """For texts (row, text): row, key (the set of shingles), size, fp (its SimHash), part (its first part) and where that ends (late, last)."""
    every = max(1, texts.count() // SAMPLE)

    def seen(batches):
        for b in batches:
            for i in range(0, len(b), SLICE):
                yield pd.DataFrame({"shingle": np.concatenate([shingles(x, width) for x in b["text"].iloc[i : i + SLICE]])})

    sample = texts.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("text").mapInPandas(seen, "shingle long")
    common = np.array(sorted(r[0] for r in sample.groupBy("shingle").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST).collect()), np.int64)

    def read(batches):
        for whole, i in ((b, i) for b in batches for i in range(0, len(b), SLICE)):
            b = whole.iloc[i : i + SLICE]
            own = [shingles(x, width) for x in b["text"]]
            first = [first_part(x, least, common) for x in own]
            yield pd.DataFrame({"row": b["row"].to_numpy(), "key": [hashlib.md5(x.tobytes()).digest() for x in own], "size": [len(x) for x in own], "fp": [set_print(x) for x in own], "part": [x for x, _, _ in first], "late": [x for _, x, _ in first], "last": [x for _, _, x in first]})

    return texts.mapInPandas(read, "row long, key binary, size int, fp long, part array<long>, late boolean, last long")


def _asked(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (row, ...) that pairs (a, b) ask for, as long as their list is short; else all."""
    asked = cut(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "asked")
    return rows.join(F.broadcast(asked), "row", "left_semi") if asked.count() <= ASKED else rows


def similar(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Of pairs (a, b) of rows, those whose texts are similar. Texts that no pair asks for are left where they are, as long as the list of rows is short."""

    @F.pandas_udf(T.BooleanType())
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = shingles(x, width), shingles(y, width)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= least * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    texts = _asked(texts, pairs)
    side = lambda c: texts.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}"))
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").where(close("text_a", "text_b")).select("a", "b"), "similar")


def links(texts: DataFrame, parts: DataFrame, width: int, least: float, proposed: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all similar pairs, and no others; parts: row, size, part, late, last, distinct sets; texts: row, text; proposed: further pairs worth a look.

    Similar sets of x and y shingles share `need` of them, the first of which stands at most x - need and y - need places
    after their first ones; so a shingle proposes only sets in which it stands there. Of two first parts, the one that ends
    first has, in its order, no shingle of the other set but those they share: what it does not share is outside the other
    set, and may be no more than the similarity leaves.
    """
    spread = parts.select("row", "size", F.posexplode("part").alias("at", "shingle"))
    group = Window.partitionBy("shingle")
    shared = cut(spread.withColumn("n", F.count("*").over(group)).withColumn("hub", F.min(F.struct("at", "row", "size")).over(group)).where("n > 1").drop("n"), "shared")
    need = lambda x, y: F.ceil(least / (1 + least) * (x["size"] + y["size"]) - 1e-9)  # noqa: E731  shingles that similar sets share
    early = lambda x, y: (x["at"] <= x["size"] - need(x, y)) & (y["at"] <= y["size"] - need(x, y))
    this = {"at": F.col("at"), "size": F.col("size")}
    stars = shared.where((F.col("row") != F.col("hub.row")) & early(this, F.col("hub"))).select(F.least("row", "hub.row").alias("a"), F.greatest("row", "hub.row").alias("b"))
    stars = cut(stars.union(proposed).distinct(), "stars")
    first = similar(stars, texts, width, least)
    label = cut(components(first, "a", "b"), "star-groups")
    left = cut(shared.drop("hub").join(label.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("component", "row")).drop("component"), "shared-labelled")
    mixed = left.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
    left = cut(left.join(mixed, "shingle"), "shared-mixed")
    ends = F.struct("at", "size")
    one, other = left.select("shingle", F.col("row").alias("a"), "label", ends.alias("x")), left.select("shingle", F.col("row").alias("b"), F.col("label").alias("label_b"), ends.alias("y"))
    rest = one.join(other, "shingle").where("a < b and label <> label_b").where(early(F.col("x"), F.col("y"))).select("a", "b").distinct()
    rest = cut(rest.join(stars, ["a", "b"], "left_anti"), "rest-early")
    told = _asked(parts, rest)
    side = lambda c, to: told.select(F.col("row").alias(c), F.struct("size", "late", "last", F.array_distinct("part").alias("part")).alias(to))
    rest = rest.join(side("a", "x"), "a").join(side("b", "y"), "b")
    both = F.size(F.array_intersect("x.part", "y.part"))
    apart = lambda c: F.size(f"{c}.part") - both <= F.col(f"{c}.size") - need(F.col("x"), F.col("y"))
    rest = rest.where(F.when(F.struct("x.late", "x.last") <= F.struct("y.late", "y.last"), apart("x")).otherwise(apart("y")))
    rest = cut(rest.select("a", "b"), "rest")
    return first.union(similar(rest, texts, width, least))

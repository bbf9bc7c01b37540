"""Question bank: checks, staged deduplication, scores, status, planning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions.base import when_chain
from labelmill.functions.text import normalize, word_count
from labelmill.operators.lineage import cut, ranked

#: Statuses that take a candidate out of the pool, and the weights of the composite score.
DEAD = ("REJECTED", "DUPLICATE", "INVALID")
WEIGHTS = {"factual_correctness": 0.25, "source_grounding": 0.10, "clarity": 0.10, "distractor_quality": 0.15, "single_correctness": 0.15, "difficulty_match": 0.05, "bloom_match": 0.05, "option_conciseness": 0.05, "notation_validity": 0.05, "duplicate_risk": 0.05}


def alive(status: Column, stem: Column) -> Column:
    return ~status.isin(*DEAD) & (F.trim(stem) != "")


def accept_rate(df: DataFrame, wanted: int, least: float = 0.2) -> DataFrame:
    """(job, round, generated, valid, accept_rate, next_ask): the next round asks for the shortfall over the rate, which counts as `least` at least."""
    c = df.groupBy("job", "round").agg(F.count("*").alias("generated"), F.count_if("valid").alias("valid"))
    rate = F.col("valid") / F.col("generated")
    return c.select("job", "round", "generated", "valid", rate.alias("accept_rate"), F.ceil((wanted - F.col("valid")) / F.greatest(rate, F.lit(least))).alias("next_ask"))


def structural_reasons(stem: Column, options: Column, correct: Column, max_words: int = 6) -> Column:
    """Array of: correct_out_of_range, duplicate_options, options_too_long, stem_too_short."""
    norm = F.transform(options, lambda o: F.regexp_replace(F.lower(F.trim(o)), r"\s+", " "))
    found = F.array(
        F.when((correct < 0) | (correct >= F.size(options)), "correct_out_of_range"),
        F.when(F.size(F.array_distinct(norm)) < F.size(options), "duplicate_options"),
        F.when(F.exists(options, lambda o: word_count(o) > max_words), "options_too_long"),
        F.when(F.length(F.trim(stem)) < 15, "stem_too_short"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def option_grades(options: Column, max_words: int = 6) -> tuple[Column, Column]:
    """Share of options within max_words, and 1 less the share of repeated ones."""
    n = F.size(options)
    norm = F.transform(options, lambda o: F.regexp_replace(F.lower(F.trim(o)), r"\s+", " "))
    long = F.size(F.filter(options, lambda o: word_count(o) > max_words))
    return 1 - long / F.greatest(n, F.lit(1)), F.greatest(F.lit(0.0), 1 - (n - F.size(F.array_distinct(norm))) / n)


def length_outliers(options: Column, ratio_: float = 2.0) -> Column:
    """How many options have a word count at least ratio_ times the median, or the other way."""
    n = F.array_sort(F.transform(options, lambda o: word_count(o)))
    size = F.size(n)
    mid = F.floor(size / 2).cast("int")
    median = F.when(size % 2 == 1, F.get(n, mid).cast("double")).otherwise((F.get(n, mid - 1) + F.get(n, mid)) / 2.0)
    return F.size(F.filter(n, lambda c: (median > 0) & (c > 0) & (F.greatest(c / median, median / c) >= ratio_)))


def distractor_score(outliers: Column, close: Column | None = None) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - 10 * outliers - (15 * close if close is not None else 0))


def quality_score(v: dict[str, Column]) -> dict[str, Column]:
    """Ten sub-scores and the composite, from: verdict, has_sources, has_context, structural_ok, n_reasons, distractor_score,
    distractor_ok, embedding_checked, difficulty_match, bloom_match, notation_ok, is_duplicate, dup_score."""
    match = lambda c: F.when(c.isNull(), 75.0).when(c, 100.0).otherwise(50.0)
    s = {
        "factual_correctness": when_chain([(v["verdict"] == "PASS", 100.0), (v["verdict"] == "UNCERTAIN", 50.0)], 0.0),
        "source_grounding": when_chain([(v["has_sources"], 100.0), (v["has_context"], 60.0)], 20.0),
        "clarity": F.when(v["structural_ok"], 100.0).otherwise(0.0),
        "distractor_quality": F.when(v["embedding_checked"], v["distractor_score"]).otherwise(F.least(v["distractor_score"], F.lit(75.0))),
        "single_correctness": F.when(v["structural_ok"] & v["distractor_ok"], 100.0).otherwise(0.0),
        "difficulty_match": match(v["difficulty_match"]),
        "bloom_match": match(v["bloom_match"]),
        "option_conciseness": F.when(v["structural_ok"], 100.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 20 * v["n_reasons"])),
        "notation_validity": F.when(v["notation_ok"], 100.0).otherwise(0.0),
        "duplicate_risk": when_chain([(v["is_duplicate"], 0.0), (v["dup_score"] >= 0.7, 100.0 - (v["dup_score"] - 0.7) * 200)], 100.0),
    }
    return {**s, "composite": sum((s[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))}


def status(structural: Column, notation: Column, duplicate: Column, distractor: Column, answer: Column, score: Column, least: float = 50.0) -> Column:
    """The first gate that fails decides; a low score is kept for review as LOW_CONFIDENCE."""
    return when_chain([(~structural, "INVALID"), (~notation, "INVALID"), (duplicate, "DUPLICATE"), (~distractor, "REJECTED"), (~answer, "REJECTED"), (score < least, "LOW_CONFIDENCE")], "PENDING_REVIEW")


def dedup_pool(candidates: DataFrame) -> DataFrame:
    """(id, pool, earlier, links): alive candidates with the smallest id of their pool (subject, topic), and how many others of it have a smaller id, and any.

    A pool stands for its pairs, which are as many as its size squared. Without subject or topic a candidate is alone.
    """
    live = candidates.where(alive(F.col("status"), F.col("stem"))).select("id", "subject", "topic")
    key, known = ["subject", "topic"], F.col("subject").isNotNull() & F.col("topic").isNotNull()
    pools = live.where(known).groupBy(*key).agg(F.min("id").alias("pool"), F.count("*").alias("all"))
    placed = ranked(live.where(known), [F.col("id")], "place", tuple(key)).groupBy(*key, "id").agg((F.min("place") - 1).alias("earlier"), F.count("*").alias("same"))
    alone = live.where(~known).select("id", F.col("id").alias("pool"), F.lit(0).cast("long").alias("earlier"), F.lit(0).cast("long").alias("links")).distinct()
    return placed.join(pools, key).select("id", "pool", "earlier", (F.col("all") - F.col("same")).alias("links")).union(alone)


#: Candidates of a pool that a task pairs with as many others.
POOL_TILE = 8192


def pool_pairs(candidates: DataFrame, tile: int = POOL_TILE) -> DataFrame:
    """(id, other) pairs of alive candidates of the same subject and topic, the other being the earlier (smaller id); every row of an id has its own.

    The pairs are as many as a pool's size squared, so only ids are dealt, in tiles of about `tile` by `tile`: a hot pool is
    many tasks, and none holds more than the rows of two tiles.
    """
    spark, key = candidates.sparkSession, ["subject", "topic"]
    live = candidates.where(alive(F.col("status"), F.col("stem"))).select("id", *key).where("id is not null and subject is not null and topic is not null")
    live = cut(live, "pool")  # read three times below
    size = cut(live.groupBy(*key).agg(F.ceil(F.count("*") / float(tile)).cast("int").alias("tiles")), "pool-tiles")  # a row for each pool
    own = live.join(size, key).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    left = own.select(*key, "id", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"))
    right = own.select(*key, F.col("id").alias("o"), F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"))
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # tiles are small in bytes and their pairs are many
    cells = [*key, "i", "j"]
    both = left.repartition(spread, *cells).join(right.repartition(spread, *cells), cells)
    both = both.where((F.col("id") != F.col("o")) & ((F.col("i") < F.col("j")) | (F.col("o") < F.col("id"))))  # a tile meets itself both ways
    return both.select(F.greatest("id", "o").alias("id"), F.least("id", "o").alias("other"))


def exact_duplicates(candidates: DataFrame) -> DataFrame:
    """(id, matched) of candidates whose normalised stem an earlier one of the block has; one grouping, no pairs."""
    h = candidates.select("id", "subject", "topic", F.sha2(normalize(F.col("stem")), 256).alias("h"))
    first = h.withColumn("matched", F.min("id").over(Window.partitionBy("subject", "topic", "h")))
    return first.where("matched < id").select("id", "matched")


#: Rows of a tile, and bytes of unpacked sketches that a task multiplies at a time.
LEXICAL_TILE, UNPACKED = 2048, 1 << 24


def gram_widths(band: Column, ratio: float) -> Column:
    """Bits of a text's sketch: at least four times the longest text of its band of lengths, a power of two from 2^8 to 2^18."""
    return F.pow(F.lit(2.0), F.least(F.greatest(F.ceil((band + 1) * math.log2(ratio)) + 2, F.lit(8)), F.lit(18))).cast("int")


#: Characters of a block's texts whose grams a task holds, postings that it forms at a time, and texts that tell how common grams are.
INDEXED_TEXT, POSTINGS, ORDER_TEXTS = 1 << 24, 1 << 21, 1000


def sure_windows(n: Column, rare: Column, threshold: float) -> Column:
    """How many windows of a text any larger-numbered one within the threshold shares with it at least, whatever its length."""
    from labelmill.functions.helpers import BROKEN

    wide = 2 / threshold - 1
    need = F.floor(threshold * (n + n / wide) / 2 - 1e-6)
    return (need - (F.least(F.floor((1 - threshold) * (n + n * wide) + 1e-6) + 1, rare) + 1) * BROKEN).cast("long")


def window_pairs(rows: DataFrame, threshold: float, spread: int) -> DataFrame:
    """(id, matched) of texts of a block that share as many windows as the threshold needs, where matched, the smaller id, is `sure` to share some.

    rows: id, s, n, block, rare, sure. Grams that are first in a window are an index. A text asks it by its first ones from
    rare to common, until what it has left is too little for a pair by itself; the windows that both share there are added up.
    The order of grams comes from a sample, but the bound holds in any order. A block's grams are dealt by hash, so that a
    task holds those of about INDEXED_TEXT characters.
    """
    from labelmill.functions.helpers import gram_order

    wide = 2 / threshold - 1
    order = gram_order(r.s for r in rows.select("id", F.substring("s", 1, 4000).alias("s")).orderBy(F.xxhash64("id"), "id", "s").limit(ORDER_TEXTS).collect())  # at most 4 MB of characters
    size = cut(rows.groupBy("block").agg(F.ceil(F.sum("n") / float(INDEXED_TEXT)).cast("int").alias("buckets")), "buckets")

    def deal(batches):
        from labelmill.functions.helpers import window_grams

        table = np.frombuffer(order, np.uint8)
        for d in batches:
            out = []
            for r in d.itertuples(index=False):
                key, n = window_grams(r.s, table)
                rest = n.sum() - np.cumsum(n)
                asks = int(np.argmax(rest < 0.9 * r.sure)) + 1 if r.sure > 0 else 0
                left = int(rest[asks - 1]) if asks else 0
                of, gram, n = (key & np.uint64(0xFFFFFF)) % np.uint64(r.buckets), ((key >> np.uint64(24)) & np.uint64(0xFFFFFFFF)).astype("<u4"), n.astype("<u4")
                by = np.argsort(of, kind="stable")  # the grams that ask stay first
                at = np.flatnonzero(np.r_[True, np.diff(of[by]) > 0]) if len(by) else by
                for part in np.split(by, at[1:]) if len(by) else ():
                    out.append((r.block, int(of[part[0]]), r.id, r.n, r.rare, left, gram[part].tobytes(), n[part[part < asks]].tobytes()))
            yield pd.DataFrame(out, columns=["block", "bucket", "id", "n", "rare", "rest", "grams", "windows"])

    def meet(d: pd.DataFrame):
        from labelmill.functions.helpers import shared_windows

        ids, n, rare, left = (d[c].to_numpy() for c in ("id", "n", "rare", "rest"))
        grams, windows = np.frombuffer(b"".join(d["grams"]), "<u4").astype(np.uint64), np.frombuffer(b"".join(d["windows"]), "<u4")
        has, asks = d["grams"].map(len).to_numpy() // 4, d["windows"].map(len).to_numpy() // 4
        who = np.repeat(np.arange(len(d)), asks)
        asked = grams[np.arange(len(windows)) + np.repeat(np.cumsum(has) - has - (np.cumsum(asks) - asks), asks)] << np.uint64(32)
        owner = np.repeat(np.arange(len(d), dtype=np.int32), has)
        index = (grams << np.uint64(32)) | n[owner].astype(np.uint64)  # by gram, then length
        by = np.argsort(index)
        index, owner = index[by], owner[by]
        first = np.searchsorted(index, asked | np.floor(n[who] / wide).astype(np.uint64), "left")
        many = np.searchsorted(index, asked | np.ceil(n[who] * wide).astype(np.uint64), "right") - first
        upto = np.r_[0, np.cumsum(many)]
        at = 0
        while at < len(who):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + POSTINGS, "right")) - 1)
            k = np.repeat(np.arange(at, to), many[at:to])
            x, y, mass = owner[first[k] + np.arange(len(k)) + upto[at] - upto[k]].astype(np.int64), who[k], windows[k]
            at = to
            later = ids[x] > ids[y]
            pair, of = np.unique(x[later] * len(d) + y[later], return_inverse=True)
            x, y = pair // len(d), pair % len(d)
            need, allowed = shared_windows(n[x], n[y], rare[y], threshold)
            yield pd.DataFrame({"id": ids[x], "matched": ids[y], "windows": np.bincount(of, mass[later], len(pair)).astype("int64"), "need": need - left[y]})[allowed]

    def each(batches):
        parts, last = [], None
        for d in batches:
            change = np.flatnonzero(((d["block"] != d["block"].shift()) | (d["bucket"] != d["bucket"].shift())).to_numpy())
            for a, b in zip(change, [*change[1:], len(d)], strict=True):
                now = (d["block"].iloc[a], d["bucket"].iloc[a])
                if now != last and parts:
                    yield from meet(pd.concat(parts, ignore_index=True))
                    parts = []
                last = now
                parts.append(d.iloc[a:b])
        if parts:
            yield from meet(pd.concat(parts, ignore_index=True))

    dealt = rows.join(size, "block").select("block", "buckets", F.col("id").cast("long").alias("id"), F.col("n").cast("long").alias("n"), "rare", "sure", "s").mapInPandas(deal, "block long, bucket int, id long, n long, rare long, rest long, grams binary, windows binary")
    found = dealt.repartition(spread, "block", "bucket").sortWithinPartitions("block", "bucket").mapInPandas(each, "id long, matched long, windows long, need long")
    return found.groupBy("id", "matched").agg(F.sum("windows").alias("windows"), F.min("need").alias("need")).where("windows >= need").select("id", "matched")


def lexical_pairs(candidates: DataFrame, threshold: float = 0.9, tile: int = LEXICAL_TILE) -> DataFrame:
    """(id, matched, ratio) of distinct stems with a difflib ratio of at least the threshold, within blocks (subject, topic).

    A stem that repeats is compared once, under its smallest id; exact_duplicates has the rest. Lossless bounds come
    first: difflib's blocks are few, so a text with few rare characters shares windows of some characters in a row with any
    that it pairs with (shared_windows), and an index of their rarest grams gives those. The others (below about 200
    characters, or with many rare ones) meet all later texts on short sketches instead: lengths must lie within
    threshold / (2 - threshold), which bands of lengths hold to; then the grams of either text that may lie outside
    difflib's blocks (few_blocks) are counted, and all others must be in the sketch of the other one. Only pairs that pass
    get their texts, and meet the longest common subsequence before they are measured. Sketches of a band of a block meet in
    tiles of about `tile` by `tile`, so that a hot block is many tasks and none holds more than two tiles.
    """
    from labelmill.functions.helpers import difflib_ratio, gram_sketch

    spark, wide = candidates.sparkSession, 2 / threshold - 1  # longest over shortest
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # cells are small in bytes and long to compare
    rows = candidates.select("id", "subject", "topic", normalize(F.col("stem")).alias("s")).where("s <> ''").repartition(spread, "subject", "topic", "s").groupBy("subject", "topic", "s").agg(F.min("id").alias("id")).withColumn("n", F.length("s"))
    rows = rows.where("id is not null").withColumn("band", F.floor(F.log("n") / F.log(F.lit(wide))).cast("int"))
    rows = rows.withColumn("k", gram_sketch("s", gram_widths(F.col("band"), wide))).withColumn("block", F.xxhash64(F.coalesce("subject", F.lit("")), F.coalesce("topic", F.lit(""))))
    rows = rows.select("id", "subject", "topic", "s", "n", "band", "block", "k.*").withColumn("sure", sure_windows(F.col("n"), F.col("rare"), threshold))
    rows = cut(rows, "stems")  # texts are read again for the pairs that pass
    size = cut(rows.groupBy("block", "band").agg(F.ceil(F.count("*") / float(tile)).cast("int").alias("tiles"), F.ceil(F.count_if(F.col("sure") <= 0) / float(tile)).cast("int").alias("asking")), "tiles")
    own = rows.select("id", "n", "rare", "short", "long", "block", "band", "sure").join(size, ["block", "band"])
    for step in (-1, 0, 1):  # the tiles of the bands beside, all and those that ask
        own = own.join(size.select("block", (F.col("band") - step).alias("band"), F.col("tiles").alias(f"tiles{step}"), F.col("asking").alias(f"asking{step}")), ["block", "band"], "left")

    def cells(name: str, by: int) -> Column:
        """(step, tile) for each tile of a band `by` steps away, times step."""

        def of(step: int) -> Column:
            tiles = F.col(f"{name}{by * step}")
            return F.when(tiles > 0, F.transform(F.sequence(F.lit(0), F.greatest(tiles, F.lit(1)) - 1), lambda x: F.struct(F.lit(step).alias("step"), x.alias("with")))).otherwise(F.array().cast("array<struct<step:int,with:int>>"))

        return F.explode(F.concat(*map(of, (-1, 0, 1))))

    # texts that ask, in tiles of their own, meet all tiles of their band and the two beside
    at = lambda tiles: F.pmod(F.xxhash64("id"), F.col(tiles)).cast("int")
    left = own.where("sure <= 0").withColumn("c", cells("tiles", 1)).select("block", "band", F.col("c.step").alias("step"), at("asking").alias("i"), F.col("c.with").alias("j"), "id", "n", "rare", "short", "long")
    right = own.withColumn("c", cells("asking", -1)).select("block", (F.col("band") - F.col("c.step")).alias("band"), F.col("c.step").alias("step"), F.col("c.with").alias("i"), at("tiles").alias("j"), "id", "n", "short", "long")
    right = right.toDF(*[f"o_{c}" for c in right.columns])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        from labelmill.functions.helpers import LONG_GRAM, SHORT_GRAM, few_blocks, unpacked

        none, b = pd.DataFrame({"id": [], "matched": []}).astype("int64"), b.rename(columns=lambda c: c.removeprefix("o_"))
        if not len(a) or not len(b):
            return none
        short = bool(a["short"].notna().all() and b["short"].notna().all())
        name, gram = ("short", SHORT_GRAM) if short else ("long", LONG_GRAM)
        bits = 8 * min(len(v) for d in (a, b) for v in d[name])
        at_once = max(1, UNPACKED // (4 * bits))
        found = [none]
        for p in range(0, len(a), at_once):
            x = a.iloc[p : p + at_once]
            xs, xi, xn, xr = unpacked(x[name], bits), x["id"].to_numpy()[:, None], x["n"].to_numpy()[:, None], x["rare"].to_numpy()[:, None]
            for q in range(0, len(b), at_once):
                y = b.iloc[q : q + at_once]
                yi, yn = y["id"].to_numpy(), y["n"].to_numpy()
                ys = unpacked(y[name], bits)
                lost_x, lost_y, allowed = few_blocks(xn, yn, xr, gram, threshold)
                common = xs @ ys.T
                near = allowed & (common >= xs.sum(axis=1)[:, None] - lost_x) & (common >= ys.sum(axis=1) - lost_y)
                row, col = np.nonzero(near & (xi < yi))
                found.append(pd.DataFrame({"id": yi[col], "matched": xi[row, 0]}))
        return pd.concat(found)

    key = ["block", "band", "step", "i", "j"]
    other_key = [f"o_{c}" for c in key]
    near = left.repartition(spread, *key).groupBy(*key).cogroup(right.repartition(spread, *other_key).groupBy(*other_key)).applyInPandas(meet, "id long, matched long")
    near = near.union(window_pairs(rows.select("id", "s", "n", "block", "rare", "sure"), threshold, spread))
    near = cut(near.distinct(), "lexical-near")  # of a known size: where pairs are few, texts are not shuffled
    text = rows.select("id", "subject", "topic", "s")
    other = text.select(F.col("id").alias("matched"), F.col("subject").alias("o_subject"), F.col("topic").alias("o_topic"), F.col("s").alias("t"))
    both = near.join(text, "id").join(other, "matched").where(F.col("subject").eqNullSafe(F.col("o_subject")) & F.col("topic").eqNullSafe(F.col("o_topic")))
    return both.repartition(spread, "id", "matched").select("id", "matched", difflib_ratio(threshold)("s", "t").alias("ratio")).where(F.col("ratio") >= threshold)


#: Vectors of a block that a task compares with as many others, and those that it compares at a time.
TILE, AT_ONCE = 4096, 512


def nearest_earlier(vectors: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """(id, other, score): for each vector that has an earlier one (smaller id) in its block the earlier one of highest cosine, compared to nine places; ties: the smaller id.

    vectors: id, *by, v; rows with a null in `by` take no part. Every vector meets all earlier ones of its block, in tiles of
    about `tile` by `tile`, so that a task holds two tiles however large a block is. A zero vector has cosine 0; where a
    vector is null, holds a null or is of another length the cosine is null and comes last, NaN comes first.
    """
    known = F.coalesce(~F.exists("v", lambda x: x.isNull()), F.lit(False))
    full = vectors.where(" and ".join(f"`{c}` is not null" for c in ["id", *by])).select("id", *by, known.alias("known"), F.when(known, F.col("v").cast("array<double>")).otherwise(F.array().cast("array<double>")).alias("v"))
    placed = ranked(full, [F.col("id")], "place", tuple(by)).withColumn("t", F.floor((F.col("place") - 1) / tile).cast("int")).drop("place")
    placed = cut(placed, "tiles")  # read three times below
    last = placed.groupBy(*by).agg(F.max("t").alias("last"))
    asks = placed.select(*by, "id", "known", "v", F.col("t").alias("i"), F.explode(F.sequence(F.lit(0), F.col("t"))).alias("j"))
    others = placed.join(last, by).select("*", F.explode(F.sequence("t", "last")).alias("i")).select(*[F.col(c).alias(f"o_{c}") for c in [*by, "i"]], F.col("t").alias("o_j"), F.col("id").alias("other"), F.col("known").alias("o_known"), F.col("v").alias("w"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "other": [], "key": [], "s": []}).astype({"id": "int64", "other": "int64", "key": "float64", "s": "float64"})]
        wide = max([len(v) for d in (a["v"], b["w"]) for v in d], default=0)

        def matrix(vectors: pd.Series, known: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            size = np.array([len(v) for v in vectors])
            x = np.zeros((len(size), wide))
            for k, v in enumerate(vectors):
                x[k, : len(v)] = v
            return x, np.where(known.to_numpy(bool), size, -1), np.sqrt((x * x).sum(axis=1))

        (x, m, p), (y, n, q) = matrix(a["v"], a["known"]), matrix(b["w"], b["o_known"])
        who, ids = a["id"].to_numpy(), b["other"].to_numpy()
        plain = len(set(m) | set(n)) == 1 and m[:1] != -1 and np.isfinite(p).all() and np.isfinite(q).all()
        for k in range(0, len(x) if len(y) else 0, AT_ONCE):
            of = slice(k, k + AT_ONCE)
            norm = p[of, None] * q
            with np.errstate(all="ignore"):
                s = np.where(norm == 0, 0.0, x[of] @ y.T / norm)
            if not plain:
                s[np.isnan(s)] = 2.0  # NaN
                s[((m[of, None] != n) & (norm != 0)) | (m[of, None] == -1) | (n == -1)] = -2.0  # null
            s[who[of, None] <= ids] = -3.0
            row, col = np.nonzero((s >= s.max(axis=1)[:, None] - 2e-9) & (s > -3))
            key = np.round(s[row, col], 9)
            order = np.lexsort((ids[col], -key, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            out.append(pd.DataFrame({"id": who[of][row[first]], "other": ids[col[first]], "key": key[first], "s": s[row[first], col[first]]}))
        return pd.concat(out)

    key = [*by, "i", "j"]
    met = asks.groupBy(*key).cogroup(others.groupBy(*[f"o_{c}" for c in key])).applyInPandas(meet, "id long, other long, key double, s double")
    best = met.groupBy("id").agg(F.max(F.struct("key", (-F.col("other")).alias("neg"), "s")).alias("m"))
    return best.select("id", (-F.col("m.neg")).alias("other"), F.when(F.col("m.key") == 2, float("nan")).when(F.col("m.key") > -2, F.col("m.s")).alias("score"))


def embedding_matches(vectors: DataFrame, low: float, high: float) -> DataFrame:
    """(id, matched, score, verdict): the nearest earlier vector of the block, from `low` on; duplicate from `high`, else borderline.

    vectors: id, subject, topic, v. Ties: the smaller id.
    """
    best = nearest_earlier(vectors, ["subject", "topic"]).withColumnRenamed("other", "matched")
    return best.where(F.col("score") >= low).select("id", "matched", "score", F.when(F.col("score") >= high, "duplicate").otherwise("borderline").alias("verdict"))


def cascade_edges(candidates: DataFrame, vectors: DataFrame, judged: DataFrame, lexical: float = 0.9, low: float = 0.8, high: float = 0.92) -> DataFrame:
    """(id, matched, level) of alive candidates of a block: equal stems, lexical pairs, embedding matches, and borderline ones that the judge confirms.

    judged: id, duplicate (a judge's answer for the candidate's nearest). A pair stands under its first level. Lexical pairs
    of a stem hold for all its copies, since those are linked to its first one.
    """
    live = candidates.where(alive(F.col("status"), F.col("stem")))
    near = embedding_matches(live.select("id").join(vectors, "id"), low, high)
    sure = near.where("verdict = 'duplicate'").select("id", "matched", F.lit(3).alias("level"))
    told = near.where("verdict = 'borderline'").join(judged.where("duplicate").select("id").distinct(), "id", "left_semi").select("id", "matched", F.lit(4).alias("level"))
    edges = exact_duplicates(live).select("id", "matched", F.lit(1).alias("level")).union(lexical_pairs(live, lexical).select("id", "matched", F.lit(2).alias("level"))).union(sure).union(told)
    return edges.groupBy("id", "matched").agg(F.min("level").alias("level"))


def first_kept(edges: DataFrame, nodes: DataFrame, checkpoint) -> DataFrame:
    """(id, kept, matched): an id is a duplicate of the smallest kept neighbour below it, and kept if it has none.

    edges: id, matched (smaller). Rounds decide every id whose smaller neighbours are all decided; checkpoint(df)
    cuts lineage between rounds.
    """
    state = checkpoint(nodes.select("id").join(edges.select("id").distinct().withColumn("open", F.lit(True)), "id", "left").select("id", F.when(F.col("open").isNull(), F.lit(True)).alias("kept"), F.lit(None).cast("long").alias("matched")))
    while state.where("kept is null").limit(1).count():
        seen = edges.join(state.select(F.col("id").alias("matched"), "kept"), "matched")
        by = seen.groupBy("id").agg(F.min(F.when(F.col("kept"), F.col("matched"))).alias("hit"), F.count_if(F.col("kept").isNull()).alias("unknown"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit").isNotNull(), False).when(F.coalesce("unknown", F.lit(0)) == 0, True)
        state = checkpoint(state.join(by, "id", "left").select("id", now.alias("kept"), F.coalesce("matched", "hit").alias("matched")))
    return state


def apportion(df: DataFrame, by: list[str], weight: str, total: Column, order: str) -> DataFrame:
    """df with `count`: `total` split by weight within `by`, largest remainders first, ties in order."""
    w = Window.partitionBy(*by)
    exact = total * F.col(weight) / F.sum(weight).over(w)
    d = df.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact")).withColumn("_total", total)
    d = d.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), order))).withColumn("_rest", F.col("_total") - F.sum("_floor").over(w))
    return d.withColumn("count", (F.col("_floor") + (F.col("_rank") <= F.col("_rest")).cast("int")).cast("long")).drop("_exact", "_floor", "_rank", "_rest", "_total")


def plan_cells(topics: DataFrame, dims: dict[str, dict[str, float]]) -> DataFrame:
    """topics: topic, count. One row per topic and value of each dimension with its share of the count; zero cells are dropped."""
    cells, keys = topics.select("topic", F.col("count").alias("n")), ["topic"]
    for name, shares in dims.items():
        values = F.array(*[F.struct(F.lit(k).alias(name), F.lit(float(v)).alias("w"), F.lit(i).alias("o")) for i, (k, v) in enumerate(shares.items())])
        each = cells.select(*keys, "n", F.explode(values).alias("v")).select(*keys, "n", "v.*")
        cells = apportion(each, keys, "w", F.col("n"), "o").where("count > 0").select(*keys, name, F.col("count").alias("n"))
        keys.append(name)
    return cells


def prompt_rows(cells: DataFrame, batch: int = 20) -> DataFrame:
    """One row for each batch of at most `batch` questions of a plan cell, with the prompt's text."""
    b = cells.withColumn("batch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / batch).cast("int"))))
    size = F.least(F.lit(batch).cast("long"), F.col("n") - (F.col("batch") - 1) * batch)
    return b.withColumn("ask", size).withColumn("prompt", F.format_string("Write %d %s questions at level %s on topic %s.", F.col("ask"), F.col("difficulty"), F.col("bloom"), F.col("topic").cast("string")))



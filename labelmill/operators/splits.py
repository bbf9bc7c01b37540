"""Splits, samples and selections that any engine repeats: orders are md5 of a seed and the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions.base import hash_order, when_chain
from labelmill.operators.lineage import ranked


def group_split(groups: DataFrame, key: str, seed: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """(key, split): whole groups in shuffled order, at least one in train and, from three groups on, one in val.

    groups has one row for each group.
    """
    g = groups.select(key).distinct()
    n = g.agg(F.count("*").alias("n"))
    placed = ranked(g, [hash_order(seed, key)], "i").crossJoin(n)  # one row
    cut1 = F.greatest(F.lit(1), F.bround(F.col("n") * train))
    cut2 = cut1 + F.greatest(F.when(F.col("n") >= 3, 1).otherwise(0), F.bround(F.col("n") * val))
    return placed.select(key, when_chain([(F.col("i") <= cut1, "train"), (F.col("i") <= cut2, "val")], "test").alias("split"))


def stratified_split(df: DataFrame, key: str, stratum: str, seed: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(key, stratum, split): rounded shares within each stratum."""
    n = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("n"))  # a row for each stratum
    p = ranked(df.select(key, stratum), [hash_order(seed, key)], "i", (stratum,))
    p = p.join(n, F.col(stratum).eqNullSafe(F.col("_s")))
    a, b = F.bround(F.col("n") * train), F.bround(F.col("n") * val)
    return p.select(key, stratum, when_chain([(F.col("i") <= a, "train"), (F.col("i") <= a + b, "val")], "test").alias("split"))


def folds(df: DataFrame, key: str, stratum: str, seed: str, k: int = 5) -> DataFrame:
    """(key, stratum, fold): the rows of each stratum dealt in turn, in shuffled order."""
    p = ranked(df.select(key, stratum), [hash_order(seed, key)], "i", (stratum,))
    return p.select(key, stratum, ((F.col("i") - 1) % k).cast("int").alias("fold"))


def group_mode(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, stratum): the most frequent label, the smallest of equals."""
    n = df.groupBy(group, label).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(F.desc("c"), label)
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select(group, F.col(label).alias("stratum"))


def group_stratified(groups: DataFrame, group: str, stratum: str, share: float, seed: str) -> DataFrame:
    """(group, stratum, picked): per stratum a rounded share, what rounding leaves being carried to the next stratum in order."""
    n = groups.groupBy(stratum).agg(F.count("*").alias("n"))
    w = Window.orderBy(stratum)  # a row for each stratum
    upto = F.floor(F.sum(F.col("n") * share).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    t = n.withColumn("upto", upto).withColumn("take", F.least(F.col("upto") - F.coalesce(F.lag("upto").over(w), F.lit(0)), F.col("n")))
    return ranked(groups, [hash_order(seed, group)], "i", (stratum,)).join(t, stratum).select(group, stratum, (F.col("i") <= F.col("take")).alias("picked"))


def greedy_split(sizes: DataFrame, group: str, size: str, targets: dict[str, float], seed: str, manual: DataFrame | None = None) -> DataFrame:
    """(group, split): groups in shuffled order each to the split furthest below its target share; manual (group, split) first.

    The order matters, so group sizes (a row for each group) are folded in one array; the data itself is not.
    """
    names = list(targets)
    fixed = sizes.join(manual, group, "left") if manual is not None else sizes.withColumn("split", F.lit(None).cast("string"))
    row = F.struct(F.col("split").isNull().alias("free"), hash_order(seed, group).alias("h"), F.col(group).cast("string").alias("g"), F.col(size).cast("double").alias("n"), F.col("split"))
    one = fixed.agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum(size).cast("double").alias("total"))
    want = F.array(*[F.lit(float(targets[s])) for s in names])
    start = F.struct(F.array(*[F.lit(0.0) for _ in names]).alias("have"), F.array().cast("array<struct<g:string,k:int>>").alias("out"))

    def step(acc, r):
        short = F.zip_with(want, acc["have"], lambda t, h: t - h)
        fixed_k = when_chain([(r["split"] == s, k) for k, s in enumerate(names)])
        k = F.coalesce(fixed_k, (F.array_position(short, F.array_max(short)) - 1).cast("int"))
        have = F.transform(acc["have"], lambda h, i: F.when(i == k, h + r["n"]).otherwise(h))
        return F.struct(have.alias("have"), F.concat(acc["out"], F.array(F.struct(r["g"].alias("g"), k.alias("k")))).alias("out"))

    scaled = one.withColumn("rows", F.transform("rows", lambda r: F.struct(r["g"].alias("g"), (r["n"] / F.col("total")).alias("n"), r["split"].alias("split"))))
    done = scaled.select(F.explode(F.aggregate("rows", start, step)["out"]).alias("o"))
    return done.select(F.col("o.g").alias(group), F.element_at(F.array(*map(F.lit, names)), F.col("o.k") + 1).alias("split"))


def sample_stratified(px: DataFrame, label: str, n: int, seed: str, key: tuple[str, ...]) -> DataFrame:
    """At most n rows per image, as many of each label that occurs there."""
    kinds = px.groupBy("image").agg(F.count_distinct(label).alias("kinds"))
    each = F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("kinds")))
    ranked = px.withColumn("i", F.row_number().over(Window.partitionBy("image", label).orderBy(hash_order(seed, *[x for k in key for x in (k, None)]))))
    return ranked.join(kinds, "image").where(F.col("i") <= each).drop("i", "kinds")


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each group: a grouped maximum of (order, row)."""
    rest = [c for c in df.columns if c not in by and c != order]
    top = df.groupBy(*by).agg(F.max(F.struct(order, *rest)).alias("m"))
    return top.select(*by, "m.*")


def threshold_search(df: DataFrame, grid: list[float], conf: str, correct: Column, least_coverage: float = 0.7) -> DataFrame:
    """(tau, coverage, accuracy) of the best threshold: highest accuracy with enough coverage, the later of equals."""
    taus = df.sparkSession.createDataFrame([(float(t),) for t in grid], "tau double")
    by = df.groupBy(conf).agg(F.count("*").alias("n"), F.sum(correct.cast("int")).alias("ok"))  # distinct confidences meet the grid, not rows
    total = by.agg(F.sum("n").alias("total"))
    c = by.crossJoin(F.broadcast(taus)).where(F.col(conf) >= F.col("tau")).groupBy("tau").agg(F.sum("n").alias("kept"), F.sum("ok").alias("ok")).crossJoin(total)
    s = c.select("tau", (F.col("kept") / F.col("total")).alias("coverage"), (F.col("ok") / F.col("kept")).alias("accuracy")).where(F.col("coverage") >= least_coverage)
    return s.orderBy(F.desc(F.round("accuracy", 9)), F.desc("tau")).limit(1)


def active_batch(scores: DataFrame, labelled: DataFrame, budget: int) -> DataFrame:
    """(image, score): the highest-scoring images that have no label yet."""
    return scores.join(labelled.select("image").distinct(), "image", "left_anti").orderBy(F.desc(F.round("score", 9)), "image").limit(budget)

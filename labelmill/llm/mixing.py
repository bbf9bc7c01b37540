"""Mixing sources to target weights by systematic sampling with one random offset.

Within a source documents stand from large to small, and every other run of documents that
shares one expected copy is turned round, so that whatever the offset, a sample that takes
the larger of one run takes the smaller of the next: its words come near the target as well
as its documents. A document's expected copies are prefix-summed in that order, the
source's offset is added, and each integer that the sum crosses gives a copy. The order
rests on sizes and contents alone, not on how files are split; places come from ranges that
are sorted apart, so that a source of any share of the rows is never gathered in one task.

A document longer than SPARE of its source's target would decide alone whether the target is
met. Its expected copies are the whole ones of its source's rate, and the mass that it leaves
goes to the shorter documents, in equal shares. Where those, at `most` copies each, could not
carry it, the limit doubles until they can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.llm.common import cut, fraction, free_name, n_words, numbered

WEIGHTS = (5.0, 2.0, 1.0)
SPARE = 0.05  # of a source's target; a document beyond it is long
RUNGS = 6  # doublings of the limit, to more than the target; then no document is long


def ordinal(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with its rows' places in the order, from 0, as `name`: ranges are sorted apart and their sizes added up."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright("_row", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy(part).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))  # a row for each range
    return placed.withColumn("_part", part).join(base, "_part").withColumn(name, F.col("_base") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_part", "_base", "_row")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """For (source, size) rows: source, source_size, docs, nth (its place by code point, null last), target.

    Targets share all of the sizes by weight; those above `most` times their source's size
    stop there and the rest is shared again, until none is above. Only sums reach the driver.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by = cut(ordinal(by, [F.col("source").asc_nulls_last()], "nth"), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    by = by.withColumn("w", weight.cast("double")).withColumn("top", most * F.col("source_size").cast("double"))
    level = 0.0
    while True:
        stops = F.col("top") < F.lit(level) * F.col("w")
        total, held, free = by.agg(F.sum("source_size"), F.sum(F.when(stops, F.col("top")).otherwise(0.0)), F.sum(F.when(stops, 0.0).otherwise(F.col("w")))).first()
        now = ((total or 0) - (held or 0)) / free if free else level
        if not free or now <= level:
            break
        level = now
    return by.select("source", "source_size", "docs", "nth", F.least("top", F.lit(level) * F.col("w")).alias("target"))


def turned(place, part):
    """Places from 0, with every other run of places that shares one expected copy (part: copies beyond whole ones) the other way round."""
    run = F.floor(place * part)
    first, last = F.ceil(run / part), F.ceil((run + 1) / part) - 1
    return F.when((part > 0) & (run % 2 == 1), first + last - place).otherwise(place)


def limited(rows: DataFrame, share: DataFrame, most: int) -> DataFrame:
    """share with long (how many documents are over the limit), whole (copies of each) and rate (expected copies of the others), from sums of each source's sizes."""
    key = ["null_source", "source"]
    under = [F.col("size") <= SPARE * 2**k * F.col("target") for k in range(RUNGS)]
    sums = [F.sum(F.when(u, F.col("size")).otherwise(0)).alias(f"short{k}") for k, u in enumerate(under)] + [F.count_if(~u).alias(f"long{k}") for k, u in enumerate(under)]
    share = share.join(rows.join(share.select(*key, "target"), key).groupBy(*key).agg(*sums), key).withColumn("whole", F.floor("rate"))
    rest = lambda short: F.col("target") - F.col("whole") * (F.col("source_size") - short)  # noqa: E731  what the short ones have to carry
    choice = lambda short, long: F.struct(short.cast("long").alias("short"), long.cast("long").alias("long"))
    none, pick = choice(F.col("source_size"), F.lit(0)), F.when(F.col("rate") == F.col("whole"), choice(F.col("source_size"), F.lit(0)))
    for k in range(RUNGS):
        pick = pick.when(most * F.col(f"short{k}") >= rest(F.col(f"short{k}")), choice(F.col(f"short{k}"), F.col(f"long{k}")))
    share = share.withColumn("pick", pick.otherwise(none))
    rate = F.when(F.col("pick.long") == 0, F.col("rate")).when(F.col("pick.short") == 0, F.col("whole").cast("double")).otherwise(F.least(F.lit(float(most)), rest(F.col("pick.short")) / F.col("pick.short")))
    return share.select(*key, "source_size", "target", rate.alias("rate"), "whole", F.col("pick.long").alias("long"), "offset", "base")


def _decide(rows: DataFrame, weights, most: int, seed: str) -> DataFrame:
    """rows: row, source, size, tie (a hash of the content); adds source_size, target, copies."""
    share = cut(targets(rows, weights, most), "targets")
    share = share.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)).withColumn("offset", fraction("nth", seed=seed))
    before = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    share = share.withColumn("base", F.coalesce(F.sum("docs").over(before), F.lit(0)))  # a row for each source
    named = lambda df: df.withColumn("null_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    share = cut(limited(named(rows), named(share), most), "rates")
    placed = named(ordinal(rows, [F.col("source").asc_nulls_last(), F.desc("size"), F.asc("tie")], "place")).join(share, ["null_source", "source"])
    rate, place = F.col("rate"), F.col("place") - F.col("base") - F.col("long")  # long ones come first
    upto = lambda k: F.floor(rate * k + F.col("offset"))
    out = placed.withColumn("at", turned(place, rate - F.floor(rate)))
    out = out.withColumn("copies", F.when(place < 0, F.col("whole")).otherwise(F.least(upto(F.col("at") + 1) - upto(F.col("at")), F.lit(most))))
    return out.withColumn("source", F.when(~F.col("null_source"), F.col("source"))).select("row", "source", "size", "source_size", "target", "copies")


def _sizes(docs: DataFrame, row: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col(row).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", text).alias("tie"))


def shares(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """Returns doc_id, source, size (words), source_size, target (of the source), copies and taken (copies * size).

    Every row stands for itself, also where it repeats or its id is null. Null and blank
    texts have size 0; a source without words has target 0 and gives no copies. The seed and
    the contents fix the result, however files are split; only which of some equal rows comes
    once more is left open. A source's words miss its target by less than its largest short
    document: SPARE of the target, unless short documents are too few. Other columns are ignored.
    """
    rows = cut(_sizes(docs.withColumn("_row", F.monotonically_increasing_id()), "_row"), "sizes")
    made = _decide(rows.select("row", "source", "size", "tie"), weights, most, seed)
    return rows.select("row", "doc_id").join(made, "row").select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, seed: str = "mix", stored: bool = False) -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it (see shares, also for nulls, ties and repeats); an empty table stays empty.

    stored: docs is a Parquet table as read, of which no copy is written.
    """
    row = free_name(docs, "row")
    docs_rows = numbered(docs, row, stored)
    sizes = cut(_sizes(docs_rows, row).drop("doc_id"), "sizes")
    made = _decide(sizes, weights, most, seed).where("copies > 0")
    times = made.select(F.col("row").alias(row), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(free_name(docs, "copy_no")))
    return docs_rows.join(times, row).select(*docs.columns)

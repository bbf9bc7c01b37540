"""Profiles, summaries and per-class statistics of tabular data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions.base import when_chain

#: Two-sided 95 % quantiles of Student's t for n - 1 degrees of freedom, n = 2..10.
T95 = {2: 12.706, 3: 4.303, 4: 3.182, 5: 2.776, 6: 2.571, 7: 2.447, 8: 2.365, 9: 2.306, 10: 2.262}


def seed_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, sd, lo, hi): 95 % t-interval of a mean; beyond the table the normal quantile."""
    q = F.coalesce(F.create_map(*[F.lit(x) for n, t in T95.items() for x in (n, t)])[F.col("n").cast("int")], F.lit(1.96))
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = q * F.col("sd") / F.sqrt("n")
    return s.select(*by, "n", "mean", "sd", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type, rows, nulls, distinct, least, most) with values as text, in one pass."""
    aggs = [x for c in columns for x in (F.count(c).alias(f"{c}|n"), F.count_distinct(c).alias(f"{c}|d"), F.min(c).cast("string").alias(f"{c}|lo"), F.max(c).cast("string").alias(f"{c}|hi"))]
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("rows"), *aggs)
    each = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col("rows").alias("rows"), (F.col("rows") - F.col(f"{c}|n")).alias("nulls"), F.col(f"{c}|d").alias("distinct"), F.col(f"{c}|lo").alias("least"), F.col(f"{c}|hi").alias("most")) for c in columns]
    return one.select(F.explode(F.array(*each)).alias("p")).select("p.*")


def id_gaps(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct ids, duplicates, gaps (max - min + 1 - distinct)."""
    one = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    return one.select("rows", "ids", (F.col("rows") - F.col("ids")).alias("duplicates"), (F.col("hi") - F.col("lo") + 1 - F.col("ids")).alias("gaps"))


def valid_rows(df: DataFrame, label: Column, ignore: str, known: list[str], ranges: dict[str, tuple[float, float]], policy: str = "remove") -> DataFrame:
    """df with `reason` (null: valid): missing, ignored, unknown_label or out_of_range, in that order.

    policy remove keeps the reason for counting; error raises on the first row that is neither valid nor ignored.
    """
    missing = label.isNull()
    for c in ranges:
        missing = missing | F.col(c).isNull()
    outside = F.lit(False)
    for c, (lo, hi) in ranges.items():
        outside = outside | ~F.col(c).between(lo, hi)
    out = df.withColumn("reason", when_chain([(missing, "missing"), (label == ignore, "ignored"), (~label.isin(known), "unknown_label"), (outside, "out_of_range")]))
    if policy == "error":
        bad = F.col("reason").isNotNull() & (F.col("reason") != "ignored")
        out = out.withColumn("reason", F.when(bad, F.raise_error(F.concat(F.lit("invalid row: "), F.col("reason")))).otherwise(F.col("reason")))
    return out


def fit_scaler(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """One row of means and population deviations over training rows."""
    t = df.where(train)
    return t.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Standardised columns; a column without spread becomes 0. The scaler is one row, so it is broadcast."""
    out = df.crossJoin(F.broadcast(scaler))
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"{c}_std") < 1e-8, 0.0).otherwise((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")))
    return out.drop(*[f"{c}_{s}" for c in columns for s in ("mean", "std")])


def class_weights(df: DataFrame, label: str, mode: str = "inverse", beta: float = 0.999) -> DataFrame:
    """(label, n, weight) with mean weight 1: none, inverse (N / (K n)) or effective ((1 - beta) / (1 - beta^n))."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    c = F.greatest(F.col("n"), F.lit(1)).cast("double")
    raw = {"none": F.lit(1.0), "inverse": F.sum("n").over(w) / (F.count("*").over(w) * c), "effective": (1 - beta) / (1 - F.pow(F.lit(beta), c))}[mode]
    return n.withColumn("raw", raw).select(label, "n", (F.col("raw") / F.avg("raw").over(w)).alias("weight"))


def duplicate_conflicts(df: DataFrame, keys: list[str], label: str, digits: int = 4) -> DataFrame:
    """One row: groups of rows equal after rounding, their rows, and groups whose labels differ."""
    g = df.groupBy(*[F.round(k, digits).alias(k) for k in keys]).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("labels") > 1).alias("conflicting"))


def append_schema(df: DataFrame, columns: dict[str, str], origin: str) -> DataFrame:
    """df in the schema's column order, missing columns null, data_origin stamped; unknown columns raise."""
    unknown = sorted(set(df.columns) - set(columns))
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    kinds = {**columns, "data_origin": "string"}
    return df.withColumn("data_origin", F.lit(origin)).select(*[(F.col(c) if c in df.columns or c == "data_origin" else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a that b lacks and of b that a lacks, repeats counted."""
    left = a.exceptAll(b).agg(F.count("*").alias("missing"))
    return left.crossJoin(b.exceptAll(a).agg(F.count("*").alias("unexpected")))  # one row each


def leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """(group, splits) of groups in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")

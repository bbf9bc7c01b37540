"""Measures from confusion tables, calibration, resampling and comparison of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions.base import ratio, when_chain


def confusion(df: DataFrame, ref: str, pred: str, classes: int, ignore: int = 255, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ref, pred, n): pixel counts; ignored references drop out, predictions beyond the classes count as class `classes` (abstained)."""
    keep = df.where(F.col(ref) != ignore)
    cell = F.when(F.col(pred).between(0, classes - 1), F.col(pred)).otherwise(classes)
    return keep.groupBy(*by, F.col(ref).alias("ref"), cell.alias("pred")).agg(F.count("*").alias("n"))


def confusion_grid(cm: DataFrame, classes: int) -> DataFrame:
    """The confusion table with its empty cells."""
    spark = cm.sparkSession
    grid = spark.range(classes).select(F.col("id").cast("int").alias("ref")).crossJoin(spark.range(classes + 1).select(F.col("id").cast("int").alias("pred")))  # classes * (classes + 1) rows
    return grid.join(cm, ["ref", "pred"], "left").select("ref", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_counts(cm: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, cls, tp, fp, fn, total) from a confusion table, in one grouping."""
    each = cm.select(*by, "n", F.explode(F.array_distinct(F.array("ref", "pred"))).alias("cls"), "ref", "pred").where(F.col("cls") < classes)
    total = cm.groupBy(*by).agg(F.sum("n").alias("total"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = each.groupBy(*by, "cls").agg(count((F.col("ref") == F.col("cls")) & (F.col("pred") == F.col("cls"))).alias("tp"), count((F.col("pred") == F.col("cls")) & (F.col("ref") != F.col("cls"))).alias("fp"), count((F.col("ref") == F.col("cls")) & (F.col("pred") != F.col("cls"))).alias("fn"))
    return out.join(total, list(by)) if by else out.crossJoin(F.broadcast(total))  # one row


def class_scores(counts: DataFrame, eps: float = 0.0, smooth: float = 0.0) -> DataFrame:
    """IoU, Dice, precision, recall, specificity, support per class; eps goes under the line, smooth above and under."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    tn = F.col("total") - tp - fp - fn
    over = lambda a, b: (a + smooth) / (b + smooth) if smooth else a / (b + eps) if eps else ratio(a, b)
    return counts.select("*", over(tp, tp + fp + fn).alias("iou"), over(2 * tp, 2 * tp + fp + fn).alias("dice"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(tn, tn + fp).alias("specificity"), (F.col("tp") + F.col("fn")).alias("support"))


def score_summary(scores: DataFrame, cm: DataFrame, classes: int, healthy: int = 0) -> DataFrame:
    """One row: macro means over classes that occur, mIoU without the healthy class, support-weighted Dice, accuracy, abstention."""
    macro = scores.agg(F.avg("iou").alias("macro_iou"), F.avg("dice").alias("macro_dice"), F.avg(F.when(F.col("cls") != healthy, F.col("iou"))).alias("defect_miou"), ratio(F.sum(F.coalesce("dice", F.lit(0.0)) * F.col("support")), F.sum("support")).alias("weighted_dice"), F.avg("recall").alias("balanced_accuracy"))
    whole = cm.agg(ratio(F.sum(F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"), ratio(F.sum(F.when(F.col("pred") == classes, F.col("n")).otherwise(0)), F.sum("n")).alias("abstention"))
    return macro.crossJoin(whole)  # one row each


def binary_scores(df: DataFrame, ref: Column, pred: Column, by: tuple[str, ...] = (), empty_is_one: bool = False) -> DataFrame:
    """Dice, IoU, sensitivity, specificity, FPR, FNR of 0/1 columns; any other prediction on a positive counts as missed.

    empty_is_one: both empty gives Dice = IoU = 1; else undefined scores are null.
    """
    tp, fp, fn, tn = (F.count_if(c) for c in ((ref == 1) & (pred == 1), (ref == 0) & (pred == 1), (ref == 1) & (pred != 1), (ref == 0) & (pred == 0)))
    c = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    one = (lambda x, d: F.when(d == 0, 1.0).otherwise(x)) if empty_is_one else (lambda x, d: x)
    return c.select(*by, one(ratio(2 * tp, 2 * tp + fp + fn), tp + fp + fn).alias("dice"), one(ratio(tp, tp + fp + fn), tp + fp + fn).alias("iou"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = (), at_one: float | None = None) -> DataFrame:
    """(by, agreement, kappa) from columns of two raters; kappa is at_one where chance agreement is complete."""
    cm = pairs.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("n"))
    side = lambda c: cm.groupBy(*by, F.col(c).alias("k")).agg(F.sum("n").alias(f"n_{c}"))
    pe = side("_a").join(side("_b"), [*by, "k"]).groupBy(*by).agg(F.sum(F.col("n__a").cast("double") * F.col("n__b")).alias("chance"))
    po = cm.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("n")).otherwise(0)).alias("same"))
    both = po.join(pe, list(by), "left") if by else po.crossJoin(pe)  # one row each
    agreement, chance = ratio(F.col("same"), F.col("n")), F.coalesce(F.col("chance"), F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return both.select(*by, agreement.alias("agreement"), F.when(chance < 1, (agreement - chance) / (1 - chance)).otherwise(F.lit(at_one).cast("double")).alias("kappa"))


def fleiss_kappa(votes: DataFrame, item: list[str], label: str, raters: int) -> DataFrame:
    """One row with Fleiss kappa over the items that all raters have labelled."""
    counts = votes.groupBy(*item, F.col(label).alias("k")).agg(F.count("*").cast("double").alias("c"))
    per = counts.groupBy(*item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree")).where(F.col("n") == raters)
    full = counts.join(per.select(*item), item, "left_semi")
    share = full.groupBy("k").agg(F.sum("c").alias("c"))
    total = share.agg(F.sum("c").alias("total"))
    pe = share.crossJoin(F.broadcast(total)).agg(F.sum((F.col("c") / F.col("total")) ** 2).alias("pe"))  # one row
    p = per.agg(F.avg(F.col("agree") / (raters * (raters - 1.0))).alias("p"), F.count("*").alias("items"))
    return p.crossJoin(pe).select("items", F.when(F.col("pe") < 1, (F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def weighted_kappa(df: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Quadratic weighted kappa, accuracy, off-by-one accuracy and mean absolute error of ordinal levels."""
    cm = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    w = (F.col("a") - F.col("b")).cast("double") ** 2 / float((levels - 1) ** 2)
    side = lambda c: cm.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))
    expected = side("a").crossJoin(side("b")).agg(F.sum(w * F.col("n_a") * F.col("n_b")).alias("expected"))  # levels * levels rows
    seen = cm.agg(F.sum(w * F.col("n")).alias("seen"), F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("same"), F.sum(F.when(F.abs(F.col("a") - F.col("b")) <= 1, F.col("n")).otherwise(0.0)).alias("near"), F.sum(F.abs(F.col("a") - F.col("b")) * F.col("n")).alias("off"))
    return seen.crossJoin(expected).select((1 - ratio(F.col("seen") * F.col("n"), F.col("expected"))).alias("qwk"), (F.col("same") / F.col("n")).alias("accuracy"), (F.col("near") / F.col("n")).alias("off_by_one"), (F.col("off") / F.col("n")).alias("mae"))


def spearman(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Correlation of average ranks. Ranks come from counts of distinct values, so ties of any size cost one row."""

    def ranked(c: str) -> DataFrame:
        n = df.groupBy(*by, c).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*by, F.lit(0)).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return n.select(*by, c, (upto - (F.col("n") - 1) / 2.0).alias(f"rank_{c}"))

    return df.join(ranked(a), [*by, a]).join(ranked(b), [*by, b]).groupBy(*by).agg(F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"))


def regression_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    t, p = F.col(truth), F.col(pred)
    sums = df.agg(F.avg(F.abs(t - p)).alias("mae"), F.sqrt(F.avg((t - p) ** 2)).alias("rmse"), F.avg((t - p) ** 2).alias("m"), F.var_pop(t).alias("v"))
    return sums.select("mae", "rmse", F.when(F.col("v") > 0, 1 - F.col("m") / F.col("v")).alias("r2"))


def confidence_bin(conf: Column, bins: int, edges: str = "floor") -> Column:
    """floor: min(int(c * n), n - 1). right: bins closed on the right, the first with 0. open: the same without 0 (null)."""
    if edges == "floor":
        return F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")
    right = F.least(F.greatest(F.ceil(conf * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return right if edges == "right" else F.when(conf > 0, right)


def reliability(df: DataFrame, conf: str, correct: str, bins: int, edges: str = "floor") -> DataFrame:
    """(bin, center, n, accuracy, confidence), empty bins included."""
    by = df.groupBy(confidence_bin(F.col(conf), bins, edges).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(conf).alias("confidence"))
    all_ = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_.join(by, "bin", "left").select("bin", ((F.col("bin") + 0.5) / bins).alias("center"), F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "confidence")


def expected_calibration_error(df: DataFrame, conf: str, correct: str, bins: int, edges: str = "floor") -> DataFrame:
    rows = reliability(df, conf, correct, bins, edges).where("n > 0")
    total = df.agg(F.count("*").alias("total"))
    return rows.agg(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("s")).crossJoin(total).select(ratio(F.col("s"), F.col("total")).alias("ece"))


def brier_nll(df: DataFrame, probs: list[str], truth: str, eps: float = 1e-8) -> DataFrame:
    """Multi-class Brier score and mean -log p(true)."""
    hit = lambda k: F.when(F.col(truth) == k, 1.0).otherwise(0.0)
    brier = sum(((F.col(p) - hit(k)) ** 2 for k, p in enumerate(probs)), F.lit(0.0))
    true = when_chain([(F.col(truth) == k, F.col(p)) for k, p in enumerate(probs)])
    return df.agg(F.avg(brier).alias("brier"), F.avg(-F.log(F.greatest(true, F.lit(eps)))).alias("nll"))


def risk_curve(df: DataFrame, conf: str, error: str, points: int, rounded: bool = False, digits: int = 4) -> DataFrame:
    """(point, coverage, risk): error among the most confident share of rows, at `points` coverages.

    Rows are summed by confidence (to `digits` places) first, so the running sum is over at most 10^digits + 1 rows;
    within one confidence errors count in proportion.
    """
    by = df.groupBy(F.round(conf, digits).alias("c")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(error).cast("double")).alias("e"))
    run = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    curve = by.select("n", "e", F.sum("n").over(run).alias("upto"), F.sum("e").over(run).alias("errors"))
    total = by.agg(F.sum("n").alias("total"))
    q = F.col("id") / float(points)
    cut = F.greatest(F.lit(1.0), F.floor(q * F.col("total") + (0.5 if rounded else 0.0)).cast("double"))
    grid = df.sparkSession.range(1, points + 1).crossJoin(total).select(F.col("id").cast("int").alias("point"), q.alias("coverage"), cut.alias("cut"))
    hit = grid.join(curve, (F.col("upto") >= F.col("cut")) & (F.col("upto") - F.col("n") < F.col("cut")))
    return hit.select("point", "coverage", ((F.col("errors") - F.col("e") + F.col("e") * (F.col("cut") - F.col("upto") + F.col("n")) / F.col("n")) / F.col("cut")).alias("risk"))


def area_under(curve: DataFrame, x: str, y: str) -> DataFrame:
    """Trapezoid area of a short curve."""
    w = Window.orderBy(x)
    return curve.select((F.col(x) - F.lag(x).over(w)).alias("dx"), ((F.col(y) + F.lag(y).over(w)) / 2).alias("m")).agg(F.sum(F.col("dx") * F.col("m")).alias("area"))


def draws(units: DataFrame, unit: str, rounds: int, seed: str) -> DataFrame:
    """(iter, idx): for each round as many draws with replacement of unit places as there are units, by md5."""
    n = units.agg(F.count("*").alias("units"))
    spark = units.sparkSession
    grid = spark.range(rounds).select(F.col("id").alias("iter")).crossJoin(F.broadcast(n)).select("iter", "units", F.explode(F.sequence(F.lit(1).cast("long"), F.col("units"))).alias("draw"))
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit("|"), F.col("iter").cast("string"), F.lit("|"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    return grid.select("iter", (pick % F.col("units") + 1).alias("idx"))


def numbered(units: DataFrame, *order: str) -> DataFrame:
    """Places from 1 in the order; for tables of units (images, groups), not of rows."""
    return units.withColumn("idx", F.row_number().over(Window.orderBy(*order)).cast("long"))


def bootstrap(units: DataFrame, order: list[str], value: Column, rounds: int = 200, seed: str = "boot") -> DataFrame:
    """(iter, stat): value is an aggregate expression over the drawn units' rows."""
    placed = numbered(units, *order)
    return draws(units, order[0], rounds, seed).join(placed, "idx").groupBy("iter").agg(value.alias("stat"))


def interval(stats: DataFrame, sample: DataFrame, level: float = 0.95) -> DataFrame:
    """(estimate, lo, hi): the statistic of the sample itself (one row, `estimate`) and percentiles of the resampled ones."""
    a = (1 - level) / 2
    return sample.select("estimate").crossJoin(stats.agg(F.percentile("stat", F.lit(a)).alias("lo"), F.percentile("stat", F.lit(1 - a)).alias("hi")))  # one row each


def bootstrap_interval(units: DataFrame, order: list[str], value: Column, rounds: int = 200, seed: str = "boot", level: float = 0.95) -> DataFrame:
    """(estimate, lo, hi) of an aggregate expression over units, by resampling them."""
    return interval(bootstrap(units, order, value, rounds, seed), units.agg(value.alias("estimate")), level)


def bootstrap_paired(units: DataFrame, order: list[str], diff: str, rounds: int = 200, seed: str = "boot", level: float = 0.95) -> DataFrame:
    """(estimate, lo, hi, p, p_centred) of the mean difference: p doubles the smaller share beyond 0; p_centred is the share of means at least as
    far from the estimate as that is from 0, and 1 / rounds at least."""
    stats, own = bootstrap(units, order, F.avg(diff), rounds, seed), units.agg(F.avg(diff).alias("estimate"))
    share = lambda c: F.avg(c.cast("int"))
    both = stats.crossJoin(F.broadcast(own))  # one row
    p = both.agg(F.least(F.lit(1.0), 2 * F.least(share(F.col("stat") <= 0), share(F.col("stat") >= 0))).alias("p"), F.greatest(share(F.abs(F.col("stat") - F.col("estimate")) >= F.abs("estimate")), F.lit(1.0 / rounds)).alias("p_centred"))
    return interval(stats, own, level).crossJoin(p)  # one row each


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """(a, b, n, used, w, ties): pairs, differences other than 0, the smaller rank sum, and the sum of t^3 - t over groups of t equal sizes."""
    size = pairs.withColumn("size", F.abs("diff"))
    by = size.where("diff <> 0").groupBy("a", "b", "size").agg(F.count("*").cast("double").alias("t"), F.count_if(F.col("diff") > 0).cast("double").alias("up"))
    upto = F.sum("t").over(Window.partitionBy("a", "b").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    rank = by.withColumn("rank", upto - (F.col("t") - 1) / 2.0)
    sums = rank.groupBy("a", "b").agg(F.sum("t").cast("long").alias("used"), F.least(F.sum(F.col("rank") * F.col("up")), F.sum(F.col("rank") * (F.col("t") - F.col("up")))).alias("w"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).join(sums, ["a", "b"], "left").select("a", "b", "n", F.coalesce("used", F.lit(0)).alias("used"), "w", "ties")


def holm_bh(df: DataFrame, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p; null p stays null and does not count."""
    ok = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    w = Window.partitionBy(*by, F.lit(0))
    m, i = F.count("*").over(w), F.row_number().over(w.orderBy(p))
    out = ok.withColumn("_m", m).withColumn("_i", i)
    holm = F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_i") + 1) * F.col(p)).over(w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    bh = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_i")).over(w.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)))
    done = out.withColumn("holm", holm).withColumn("bh", bh).drop("_m", "_i")
    return done.unionByName(df.where(F.col(p).isNull() | F.isnan(p)).withColumn("holm", F.lit(None).cast("double")).withColumn("bh", F.lit(None).cast("double")))


def select_best(long: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(approach, score) from (approach, metric, value): sum of weight * (1 - rank / (n - 1)); a metric named with "-" is better when lower."""
    spec = F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m.lstrip("-"), w)])
    low = F.array(*[F.lit(m[1:]) for m in weights if m.startswith("-")] or [F.lit("")])
    ok = long.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("w", spec[F.col("metric")]).where("w is not null")
    ok = ok.withColumn("key", F.when(F.array_contains(low, F.col("metric")), F.col("value")).otherwise(-F.col("value")))
    w = Window.partitionBy("metric")
    ranked = ok.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("key", "approach")) - 1).where("n >= 2")
    return ranked.groupBy("approach").agg(F.sum(F.col("w") * (1 - F.col("rank") / (F.col("n") - 1))).alias("score"))


def paired(df: DataFrame, unit: str, method: str, value: str) -> DataFrame:
    """(unit, a, b, diff) for methods a < b on common units with finite values."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(unit, F.col(method).alias("m"), F.col(value).alias("v"))
    return ok.select(unit, F.col("m").alias("a"), F.col("v").alias("va")).join(ok.select(unit, F.col("m").alias("b"), F.col("v").alias("vb")), unit).where("a < b").select(unit, "a", "b", (F.col("va") - F.col("vb")).alias("diff"), "va", "vb")


def paired_tests(pairs: DataFrame, least_n: int = 6) -> DataFrame:
    """(a, b, n, mean_diff, dz, t, w): Cohen dz, paired t and the Wilcoxon rank sum W (zeros out, average ranks); t and W null under least_n."""
    by = ("a", "b")
    basic = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd"))
    nz = pairs.where("diff <> 0").withColumn("size", F.abs("diff"))
    w = Window.partitionBy(*by).orderBy("size")
    ranked = nz.withColumn("rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, "size")) - 1) / 2.0)
    wil = ranked.groupBy(*by).agg(F.least(F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)), F.sum(F.when(F.col("diff") < 0, F.col("rank")).otherwise(0.0))).alias("w"))
    enough = F.col("n") >= least_n
    return basic.join(wil, list(by), "left").select(*by, "n", "mean_diff", ratio(F.col("mean_diff"), F.col("sd")).alias("dz"), F.when(enough, ratio(F.col("mean_diff"), F.col("sd") / F.sqrt("n"))).alias("t"), F.when(enough, F.col("w")).alias("w"))


def cliffs_delta(df: DataFrame, method: str, value: str) -> DataFrame:
    """(a, b, delta) for methods a < b, from counts of distinct values and running sums: no pairs of rows."""
    n = df.groupBy(F.col(method).alias("m"), F.col(value).alias("v")).agg(F.count("*").cast("double").alias("n"))
    names = n.select("m").distinct()
    pairs = names.select(F.col("m").alias("a")).join(names.select(F.col("m").alias("b")), F.col("a") < F.col("b"))  # method names
    both = pairs.join(n, (F.col("m") == F.col("a")) | (F.col("m") == F.col("b"))).groupBy("a", "b", "v").agg(F.sum(F.when(F.col("m") == F.col("a"), F.col("n")).otherwise(0.0)).alias("na"), F.sum(F.when(F.col("m") == F.col("b"), F.col("n")).otherwise(0.0)).alias("nb"))
    w = Window.partitionBy("a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    cum = both.withColumn("lower_b", F.coalesce(F.sum("nb").over(w), F.lit(0.0))).withColumn("lower_a", F.coalesce(F.sum("na").over(w), F.lit(0.0)))
    return cum.groupBy("a", "b").agg(((F.sum(F.col("na") * F.col("lower_b")) - F.sum(F.col("nb") * F.col("lower_a"))) / (F.sum("na") * F.sum("nb"))).alias("delta"))

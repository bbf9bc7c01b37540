"""Queries of the measures in operators.stats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions.base import r6
from labelmill.operators import stats as S
from labelmill.plans.data import PX, RESULTS, annotations, pixels, results, ANN
from labelmill.plans.registry import query, table

K = 6
CM = f"WITH {PX}, cm AS (SELECT ref, CASE WHEN pred BETWEEN 0 AND 5 THEN pred ELSE 6 END AS pred, count(*) AS n FROM px WHERE ref <> 255 GROUP BY ALL)"
CNT = CM + """, cls AS (SELECT CAST(range AS INTEGER) AS cls FROM range(6)),
cnt0 AS (SELECT cls, CAST(sum(CASE WHEN ref=cls AND pred=cls THEN n ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN pred=cls AND ref<>cls THEN n ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN ref=cls AND pred<>cls THEN n ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(n) AS DOUBLE) AS total FROM cls, cm GROUP BY cls),
cnt AS (SELECT * FROM cnt0 WHERE tp+fp+fn > 0)"""


def rounded(df, *keep):
    """df with its doubles rounded to six places."""
    return df.select(*[r6(F.col(c), c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def cm_of(spark, sf):
    return S.confusion(pixels(spark, sf), "ref", "pred", K)


@query("agg_confusion", CM + " SELECT CAST(g.r AS INTEGER) AS ref, CAST(h.p AS INTEGER) AS pred, coalesce(n, 0) AS n FROM range(6) g(r) CROSS JOIN range(7) h(p) LEFT JOIN cm ON cm.ref = g.r AND cm.pred = h.p")
def _(spark, sf):
    return S.confusion_grid(cm_of(spark, sf), K)


@query("flt_ignore", f"WITH {PX} SELECT image, count(*) AS kept FROM px WHERE ref <> 255 GROUP BY image")
def _(spark, sf):
    return pixels(spark, sf).where("ref <> 255").groupBy("image").agg(F.count("*").alias("kept"))


@query("agg_seg_scores", CNT + " SELECT cls, round(tp/nullif(tp+fp+fn,0),6) AS iou, round(2*tp/nullif(2*tp+fp+fn,0),6) AS dice, round(tp/nullif(tp+fp,0),6) AS precision, round(tp/nullif(tp+fn,0),6) AS recall FROM cnt")
def _(spark, sf):
    return rounded(S.class_scores(S.class_counts(cm_of(spark, sf), K)).select("cls", "iou", "dice", "precision", "recall"))


@query("agg_seg_scores_summary", CNT + """, sc AS (SELECT cls, tp/nullif(tp+fp+fn,0) AS iou, 2*tp/nullif(2*tp+fp+fn,0) AS dice, tp/nullif(tp+fn,0) AS recall, tp+fn AS support FROM cnt)
SELECT round(avg(iou),6) AS macro_iou, round(avg(dice),6) AS macro_dice, round(avg(CASE WHEN cls<>0 THEN iou END),6) AS defect_miou, round(sum(coalesce(dice,0)*support)/sum(support),6) AS weighted_dice, round(avg(recall),6) AS balanced_accuracy,
(SELECT round(sum(CASE WHEN ref=pred THEN n ELSE 0 END)/CAST(sum(n) AS DOUBLE),6) FROM cm) AS accuracy, (SELECT round(sum(CASE WHEN pred=6 THEN n ELSE 0 END)/CAST(sum(n) AS DOUBLE),6) FROM cm) AS abstention FROM sc""")
def _(spark, sf):
    cm = cm_of(spark, sf)
    return rounded(S.score_summary(S.class_scores(S.class_counts(cm, K)), cm, K))


@query("agg_seg_scores_vpc", CNT + " SELECT cls, round(tp/(tp+fp+fn+1e-12),6) AS iou, round(2*tp/(2*tp+fp+fn+1e-12),6) AS dice, round(tp/(tp+fp+1e-12),6) AS precision, round(tp/(tp+fn+1e-12),6) AS recall, round((total-tp-fp-fn)/(total-tp-fp-fn+fp+1e-12),6) AS specificity, CAST(tp+fn AS BIGINT) AS support FROM cnt")
def _(spark, sf):
    return rounded(S.class_scores(S.class_counts(cm_of(spark, sf), K), eps=1e-12).select("cls", "iou", "dice", "precision", "recall", "specificity", "support"))


@query("agg_seg_scores_smooth", CNT + " SELECT round(avg((tp+1e-6)/(tp+fp+fn+1e-6)),6) AS miou, round(avg((2*tp+1e-6)/(2*tp+fp+fn+1e-6)),6) AS mdice FROM cnt")
def _(spark, sf):
    s = S.class_scores(S.class_counts(cm_of(spark, sf), K), smooth=1e-6)
    return rounded(s.agg(F.avg("iou").alias("miou"), F.avg("dice").alias("mdice")))


@query("agg_cls_report", CNT + """ SELECT cls, CAST(tp+fn AS BIGINT) AS support, round(coalesce(tp/nullif(tp+fp,0),0),6) AS precision, round(coalesce(tp/nullif(tp+fn,0),0),6) AS recall, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) AS f1, round(coalesce((total-tp-fp-fn)/nullif(total-tp-fn,0),0),6) AS specificity, round(tp/nullif(tp+fn,0),4) AS diagonal FROM cnt""")
def _(spark, sf):
    s = S.class_scores(S.class_counts(cm_of(spark, sf), K))
    zero = lambda c, n: r6(F.coalesce(c, F.lit(0.0)), n)
    return s.select("cls", "support", zero("precision", "precision"), zero("recall", "recall"), zero("dice", "f1"), zero("specificity", "specificity"), F.round("recall", 4).alias("diagonal"))


BIN = f"WITH {PX}, b AS (SELECT image, CASE WHEN ref=255 THEN 255 WHEN ref=0 THEN 0 ELSE 1 END AS r, CASE WHEN pred=255 THEN 255 WHEN pred=0 THEN 0 ELSE 1 END AS p FROM px)"
CNT2 = BIN + ", c AS (SELECT image, CAST(count_if(r=1 AND p=1) AS DOUBLE) AS tp, CAST(count_if(r=0 AND p=1) AS DOUBLE) AS fp, CAST(count_if(r=1 AND p<>1) AS DOUBLE) AS fn, CAST(count_if(r=0 AND p=0) AS DOUBLE) AS tn FROM b WHERE r<>255 GROUP BY image)"


def binary(c):
    """Class to defect (1), healthy (0), uncertain (255)."""
    return F.when(F.col(c) == 255, 255).when(F.col(c) == 0, 0).otherwise(1)


@query("prj_binary", BIN + " SELECT r AS ref_binary, p AS pred_binary, count(*) AS n FROM b GROUP BY ALL")
def _(spark, sf):
    return pixels(spark, sf).groupBy(binary("ref").alias("ref_binary"), binary("pred").alias("pred_binary")).agg(F.count("*").alias("n"))


@query("agg_binary_scores", CNT2 + " SELECT image, round(2*tp/nullif(2*tp+fp+fn,0),6) AS dice, round(tp/nullif(tp+fp+fn,0),6) AS iou, round(tp/nullif(tp+fn,0),6) AS sensitivity, round(tn/nullif(tn+fp,0),6) AS specificity, round(fp/nullif(tn+fp,0),6) AS fpr, round(fn/nullif(tp+fn,0),6) AS fnr FROM c")
def _(spark, sf):
    return rounded(S.binary_scores(pixels(spark, sf).where("ref <> 255"), binary("ref"), binary("pred"), ("image",)))


@query("agg_binary_empty", f"WITH {PX}, c AS (SELECT image, y, CAST(count_if(ref=5 AND pred=5) AS DOUBLE) AS tp, CAST(count_if(ref<>5 AND pred=5) AS DOUBLE) AS fp, CAST(count_if(ref=5 AND pred<>5) AS DOUBLE) AS fn FROM px WHERE ref<>255 GROUP BY image, y) SELECT image, y, round(CASE WHEN tp+fp+fn=0 THEN 1 ELSE 2*tp/(2*tp+fp+fn) END,6) AS dice, round(CASE WHEN tp+fp+fn=0 THEN 1 ELSE tp/(tp+fp+fn) END,6) AS iou, round(tp/nullif(tp+fn,0),6) AS sensitivity FROM c")
def _(spark, sf):
    is5 = lambda c: (F.col(c) == 5).cast("int")
    return rounded(S.binary_scores(pixels(spark, sf).where("ref <> 255"), is5("ref"), is5("pred"), ("image", "y"), empty_is_one=True).select("image", "y", "dice", "iou", "sensitivity"))


def kappa_sql(a, b, where, by="image", one="NULL", src=None):
    return f"""WITH {PX}, p AS (SELECT {by} AS k0, {a} AS a, {b} AS b FROM px WHERE {where}), n AS (SELECT k0, count(*) AS n, count_if(a=b) AS same FROM p GROUP BY k0),
pa AS (SELECT k0, a AS k, count(*) AS na FROM p GROUP BY ALL), pb AS (SELECT k0, b AS k, count(*) AS nb FROM p GROUP BY ALL),
pe AS (SELECT k0, sum(CAST(na AS DOUBLE)*nb) AS chance FROM pa JOIN pb USING (k0, k) GROUP BY k0)
SELECT k0 AS {by}, round(same/CAST(n AS DOUBLE),6) AS agreement, round(CASE WHEN coalesce(chance,0)/(CAST(n AS DOUBLE)*n) < 1 THEN (same/CAST(n AS DOUBLE) - coalesce(chance,0)/(CAST(n AS DOUBLE)*n))/(1-coalesce(chance,0)/(CAST(n AS DOUBLE)*n)) ELSE {one} END,6) AS kappa FROM n LEFT JOIN pe USING (k0)"""


@query("agg_kappa", kappa_sql("pred", "pred3", "pred<>255 AND pred3<>255"))
def _(spark, sf):
    return rounded(S.cohen_kappa(pixels(spark, sf).where("pred <> 255 and pred3 <> 255"), "pred", "pred3", ("image",)))


@query("agg_agreement", kappa_sql("ref", "pred3", "ref<>255 AND pred3<>255 AND NOT (ref=0 AND pred3=0)", one="1"))
def _(spark, sf):
    px = pixels(spark, sf).where("ref <> 255 and pred3 <> 255 and not (ref = 0 and pred3 = 0)")
    return rounded(S.cohen_kappa(px, "ref", "pred3", ("image",), at_one=1.0))


VOTES = f"WITH {PX}, v AS (SELECT image, y, x, ref AS k FROM px WHERE ref<>255 UNION ALL SELECT image, y, x, pred FROM px WHERE pred<>255 UNION ALL SELECT image, y, x, pred3 FROM px WHERE pred3<>255)"


def votes(spark, sf):
    px = pixels(spark, sf)
    return px.select("image", "y", "x", F.explode(F.array("ref", "pred", "pred3")).alias("k")).where("k <> 255")


@query("agg_fleiss", VOTES + """, c AS (SELECT image, y, x, k, CAST(count(*) AS DOUBLE) AS c FROM v GROUP BY ALL), per AS (SELECT image, y, x, sum(c) AS n, sum(c*(c-1)) AS agree FROM c GROUP BY ALL HAVING sum(c)=3),
sh AS (SELECT k, sum(c) AS c FROM c JOIN per USING (image,y,x) GROUP BY k), pe AS (SELECT sum(power(c/(SELECT sum(c) FROM sh),2)) AS pe FROM sh)
SELECT count(*) AS items, round((avg(agree/6)-any_value(pe))/(1-any_value(pe)),6) AS kappa FROM per, pe""")
def _(spark, sf):
    return rounded(S.fleiss_kappa(votes(spark, sf), ["image", "y", "x"], "k", 3))


@query("agg_iaa_report", f"""WITH {PX}, v AS (SELECT image,y,x,'a' AS m,ref AS k FROM px UNION ALL SELECT image,y,x,'b',pred FROM px UNION ALL SELECT image,y,x,'c',pred3 FROM px),
p AS (SELECT l.m AS a, r.m AS b, l.k AS ka, r.k AS kb FROM v l JOIN v r ON l.image=r.image AND l.y=r.y AND l.x=r.x AND l.m<r.m),
n AS (SELECT a,b,count_if(ka<>255 AND kb<>255) AS n, count_if(ka=kb AND ka<>255) AS same, avg(CAST(ka=255 OR kb=255 AS INTEGER)) AS unsure FROM p GROUP BY ALL),
pa AS (SELECT a,b,ka AS k,count(*) AS na FROM p WHERE ka<>255 AND kb<>255 GROUP BY ALL), pb AS (SELECT a,b,kb AS k,count(*) AS nb FROM p WHERE ka<>255 AND kb<>255 GROUP BY ALL),
pe AS (SELECT a,b,sum(CAST(na AS DOUBLE)*nb) AS c FROM pa JOIN pb USING (a,b,k) GROUP BY ALL)
SELECT a,b,round(same/CAST(n AS DOUBLE),6) AS agreement, round((same/CAST(n AS DOUBLE)-c/(CAST(n AS DOUBLE)*n))/(1-c/(CAST(n AS DOUBLE)*n)),6) AS kappa, round(unsure,6) AS uncertain_rate FROM n JOIN pe USING (a,b)""")
def _(spark, sf):
    px = pixels(spark, sf)
    m = px.select("image", "y", "x", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).alias("k")) for m, c in (("a", "ref"), ("b", "pred"), ("c", "pred3"))])).alias("v")).select("image", "y", "x", "v.*")
    p = m.select("image", "y", "x", F.col("m").alias("a"), F.col("k").alias("ka")).join(m.select("image", "y", "x", F.col("m").alias("b"), F.col("k").alias("kb")), ["image", "y", "x"]).where("a < b")
    unsure = p.groupBy("a", "b").agg(F.avg(((F.col("ka") == 255) | (F.col("kb") == 255)).cast("int")).alias("uncertain_rate"))
    return rounded(S.cohen_kappa(p.where("ka <> 255 and kb <> 255"), "ka", "kb", ("a", "b")).join(unsure, ["a", "b"]))


@query("agg_qwk", f"""WITH {PX}, p AS (SELECT ref AS a, pred3 AS b FROM px WHERE ref<>255 AND pred3<>255), cm AS (SELECT a,b,CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL), na AS (SELECT a,sum(n) AS na FROM cm GROUP BY a), nb AS (SELECT b,sum(n) AS nb FROM cm GROUP BY b),
e AS (SELECT sum((a-b)*(a-b)/25e0*na*nb) AS e FROM na, nb) SELECT round(1-sum((a-b)*(a-b)/25e0*n)*sum(n)/any_value(e),6) AS qwk, round(sum(CASE WHEN a=b THEN n ELSE 0 END)/sum(n),6) AS accuracy, round(sum(CASE WHEN abs(a-b)<=1 THEN n ELSE 0 END)/sum(n),6) AS off_by_one, round(sum(abs(a-b)*n)/sum(n),6) AS mae FROM cm, e""")
def _(spark, sf):
    return rounded(S.weighted_kappa(pixels(spark, sf).where("ref <> 255 and pred3 <> 255"), "ref", "pred3", K))


@query("agg_spearman", f"WITH {PX}, p AS (SELECT image, ref AS a, pred3 AS b FROM px WHERE ref<>255 AND pred3<>255), r AS (SELECT image, rank() OVER (PARTITION BY image ORDER BY a) + (count(*) OVER (PARTITION BY image, a)-1)/2e0 AS ra, rank() OVER (PARTITION BY image ORDER BY b) + (count(*) OVER (PARTITION BY image, b)-1)/2e0 AS rb FROM p) SELECT image, round(corr(ra, rb),6) AS spearman FROM r GROUP BY image")
def _(spark, sf):
    px = pixels(spark, sf).where("ref <> 255 and pred3 <> 255").select("image", F.col("ref").alias("a"), F.col("pred3").alias("b"))
    return rounded(S.spearman(px, "a", "b", ("image",)))


@query("agg_regression", "SELECT round(avg(abs(l_extendedprice - l_quantity*1000)),6) AS mae, round(sqrt(avg(power(l_extendedprice - l_quantity*1000,2))),6) AS rmse, round(1-avg(power(l_extendedprice - l_quantity*1000,2))/var_pop(l_extendedprice),6) AS r2 FROM lineitem")
def _(spark, sf):
    return rounded(S.regression_scores(table(spark, sf, "lineitem").withColumn("guess", F.col("l_quantity") * 1000), "l_extendedprice", "guess"))


ECE = f"WITH {PX}, q AS (SELECT conf, CAST(ref=pred AS INTEGER) AS ok FROM px WHERE ref<>255 AND pred<>255)"


def judged(spark, sf):
    return pixels(spark, sf).where("ref <> 255 and pred <> 255").withColumn("ok", (F.col("ref") == F.col("pred")).cast("int"))


def ece_sql(b):
    return ECE + f", b AS (SELECT {b} AS bin, count(*) AS n, avg(ok) AS a, avg(conf) AS c FROM q GROUP BY ALL) SELECT round(sum(CASE WHEN bin IS NOT NULL THEN n*abs(a-c) ELSE 0 END)/sum(n),6) AS ece FROM b"


@query("agg_ece_floor", ece_sql("least(CAST(floor(conf*15) AS INTEGER), 14)"))
def _(spark, sf):
    return rounded(S.expected_calibration_error(judged(spark, sf), "conf", "ok", 15))


@query("agg_ece_edges", ece_sql("least(greatest(CAST(ceil(conf*10) AS INTEGER)-1,0),9)"))
def _(spark, sf):
    return rounded(S.expected_calibration_error(judged(spark, sf), "conf", "ok", 10, "right"))


@query("agg_ece_open", ece_sql("CASE WHEN conf>0 THEN least(greatest(CAST(ceil(conf*15) AS INTEGER)-1,0),14) END"))
def _(spark, sf):
    return rounded(S.expected_calibration_error(judged(spark, sf), "conf", "ok", 15, "open"))


@query("agg_reliability", ECE + ", b AS (SELECT least(CAST(floor(conf*15) AS INTEGER), 14) AS bin, count(*) AS n, avg(ok) AS a, avg(conf) AS c FROM q GROUP BY ALL) SELECT CAST(r AS INTEGER) AS bin, round((r+0.5e0)/15,6) AS center, coalesce(n,0) AS n, round(a,6) AS accuracy, round(c,6) AS confidence FROM range(15) t(r) LEFT JOIN b ON bin=r")
def _(spark, sf):
    return rounded(S.reliability(judged(spark, sf), "conf", "ok", 15))


@query("agg_brier_nll", f"WITH {PX}, q AS (SELECT p0,p1,p2,p3, x%4 AS t FROM px) SELECT round(avg(power(p0-(CASE WHEN t=0 THEN 1 ELSE 0 END),2)+power(p1-(CASE WHEN t=1 THEN 1 ELSE 0 END),2)+power(p2-(CASE WHEN t=2 THEN 1 ELSE 0 END),2)+power(p3-(CASE WHEN t=3 THEN 1 ELSE 0 END),2)),6) AS brier, round(avg(-ln(greatest(CASE t WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END,1e-8))),6) AS nll FROM q")
def _(spark, sf):
    return rounded(S.brier_nll(pixels(spark, sf).withColumn("t", F.col("x") % 4), ["p0", "p1", "p2", "p3"], "t"))


RISK = ECE + """, b AS (SELECT conf AS c, CAST(count(*) AS DOUBLE) AS n, CAST(sum(1-ok) AS DOUBLE) AS e FROM q GROUP BY ALL), cum AS (SELECT n, e, sum(n) OVER (ORDER BY c DESC) AS upto, sum(e) OVER (ORDER BY c DESC) AS errors FROM b),
g AS (SELECT CAST(i AS INTEGER) AS point, i/20e0 AS coverage, greatest(1, floor(i/20e0*(SELECT sum(n) FROM b))) AS cut FROM range(1,21) t(i)),
curve AS (SELECT point, coverage, (errors-e+e*(cut-upto+n)/n)/cut AS risk FROM g JOIN cum ON upto>=cut AND upto-n<cut)"""


@query("win_risk_curve", RISK + " SELECT point, coverage, round(risk,6) AS risk FROM curve")
def _(spark, sf):
    return rounded(S.risk_curve(judged(spark, sf).withColumn("err", 1 - F.col("ok")), "conf", "err", 20), "coverage")


@query("agg_aurc", RISK + ", t AS (SELECT coverage-lag(coverage) OVER (ORDER BY coverage) AS dx, (risk+lag(risk) OVER (ORDER BY coverage))/2 AS m FROM curve) SELECT round(sum(dx*m),6) AS area FROM t")
def _(spark, sf):
    return rounded(S.area_under(S.risk_curve(judged(spark, sf).withColumn("err", 1 - F.col("ok")), "conf", "err", 20), "coverage", "risk"))


UNITS = f"WITH {RESULTS}, u AS (SELECT image, sum(score) AS s, count(*) AS n, avg(score) AS m, row_number() OVER (ORDER BY image) AS idx FROM res GROUP BY image), k AS (SELECT count(*) AS units FROM u)"
DRAW = "d AS (SELECT i AS iter, CAST(('0x'||substr(md5('boot|'||i||'|'||j),1,8)) AS BIGINT) % units + 1 AS idx FROM k, range(200) a(i), range(1,51) b(j) WHERE j <= units)"


def units(spark, sf):
    return results(spark, sf).groupBy("image").agg(F.sum("score").alias("s"), F.count("*").alias("n"), F.avg("score").alias("m"))


@query("agg_bootstrap", UNITS + f", {DRAW}, t AS (SELECT iter, avg(m) AS stat FROM d JOIN u USING (idx) GROUP BY iter) SELECT round((SELECT avg(m) FROM u),6) AS estimate, round(quantile_cont(stat,0.025),6) AS lo, round(quantile_cont(stat,0.975),6) AS hi FROM t")
def _(spark, sf):
    return rounded(S.bootstrap_interval(units(spark, sf), ["image"], F.avg("m")))


@query("agg_bootstrap_grouped", UNITS + f", {DRAW}, t AS (SELECT iter, sum(s)/sum(n) AS stat FROM d JOIN u USING (idx) GROUP BY iter) SELECT round((SELECT sum(s)/sum(n) FROM u),6) AS estimate, round(quantile_cont(stat,0.025),6) AS lo, round(quantile_cont(stat,0.975),6) AS hi FROM t")
def _(spark, sf):
    return rounded(S.bootstrap_interval(units(spark, sf), ["image"], F.sum("s") / F.sum("n")))


@query("udaf_stat", UNITS + f", {DRAW}, t AS (SELECT iter, median(m) AS stat FROM d JOIN u USING (idx) GROUP BY iter) SELECT round((SELECT median(m) FROM u),6) AS estimate, round(quantile_cont(stat,0.025),6) AS lo, round(quantile_cont(stat,0.975),6) AS hi FROM t")
def _(spark, sf):
    return rounded(S.bootstrap_interval(units(spark, sf), ["image"], F.median("m")))


PAIRS = f"WITH {RESULTS}, m AS (SELECT image, method, avg(score) AS v FROM res GROUP BY ALL), pr AS (SELECT l.image, l.method AS a, r.method AS b, l.v-r.v AS diff FROM m l JOIN m r ON l.image=r.image AND l.method<r.method)"


def pairs(spark, sf):
    return S.paired(results(spark, sf).groupBy("image", "method").agg(F.avg("score").alias("v")), "image", "method", "v")


@query("jn_paired_methods", PAIRS + " SELECT image, a, b, round(diff,6) AS diff FROM pr")
def _(spark, sf):
    return rounded(pairs(spark, sf).select("image", "a", "b", "diff"))


@query("agg_bootstrap_paired", PAIRS + f""", u AS (SELECT image, diff, row_number() OVER (ORDER BY image) AS idx FROM pr WHERE a='A' AND b='N'), k AS (SELECT count(*) AS units FROM u), {DRAW}, t AS (SELECT iter, avg(diff) AS stat FROM d JOIN u USING (idx) GROUP BY iter)
SELECT round(e,6) AS estimate, round(quantile_cont(stat,0.025),6) AS lo, round(quantile_cont(stat,0.975),6) AS hi, round(least(1.0,2*least(avg(CAST(stat<=0 AS INTEGER)),avg(CAST(stat>=0 AS INTEGER)))),6) AS p, round(greatest(1/200e0,avg(CAST(abs(stat-e)>=abs(e) AS INTEGER))),6) AS p_centred FROM t, (SELECT avg(diff) AS e FROM u) GROUP BY e""")
def _(spark, sf):
    return rounded(S.bootstrap_paired(pairs(spark, sf).where("a = 'A' and b = 'N'"), ["image"], "diff"))


@query("agg_bootstrap_kappa", f"""WITH {PX}, cell AS (SELECT image, pred AS a, pred3 AS b, count(*) AS n FROM px WHERE pred<>255 AND pred3<>255 GROUP BY ALL), im AS (SELECT image, row_number() OVER (ORDER BY image) AS idx FROM (SELECT DISTINCT image FROM cell)), k AS (SELECT count(*) AS units FROM im),
d AS (SELECT i AS iter, CAST(('0x'||substr(md5('boot|'||i||'|'||j),1,8)) AS BIGINT) % units + 1 AS idx FROM k, range(100) a(i), range(1,51) b(j) WHERE j <= units),
c AS (SELECT iter, a, b, CAST(sum(n) AS DOUBLE) AS n FROM d JOIN im USING (idx) JOIN cell USING (image) GROUP BY ALL), tot AS (SELECT iter, sum(n) AS n, sum(CASE WHEN a=b THEN n ELSE 0 END) AS same FROM c GROUP BY iter),
na AS (SELECT iter, a AS k, sum(n) AS na FROM c GROUP BY ALL), nb AS (SELECT iter, b AS k, sum(n) AS nb FROM c GROUP BY ALL), pe AS (SELECT iter, sum(na*nb) AS ch FROM na JOIN nb USING (iter,k) GROUP BY iter),
t AS (SELECT (same/n-ch/(n*n))/(1-ch/(n*n)) AS stat FROM tot JOIN pe USING (iter)), o AS (SELECT sum(n) AS n, sum(CASE WHEN a=b THEN n ELSE 0 END) AS same FROM cell), oc AS (SELECT sum(CAST(x.n AS DOUBLE)*y.n) AS ch FROM (SELECT a AS k, sum(n) AS n FROM cell GROUP BY a) x JOIN (SELECT b AS k, sum(n) AS n FROM cell GROUP BY b) y USING (k))
SELECT round((SELECT (same/n-ch/(CAST(n AS DOUBLE)*n))/(1-ch/(CAST(n AS DOUBLE)*n)) FROM o, oc),6) AS estimate, round(quantile_cont(stat,0.025),6) AS lo, round(quantile_cont(stat,0.975),6) AS hi FROM t""")
def _(spark, sf):
    cell = pixels(spark, sf).where("pred <> 255 and pred3 <> 255").groupBy("image", "pred", "pred3").agg(F.count("*").cast("double").alias("n"))
    im = S.numbered(cell.select("image").distinct(), "image")
    c = S.draws(im, "image", 100, "boot").join(im, "idx").join(cell, "image").groupBy("iter", "pred", "pred3").agg(F.sum("n").alias("n"))
    side = lambda k, name: c.groupBy("iter", F.col(k).alias("k")).agg(F.sum("n").alias(name))
    pe = side("pred", "na").join(side("pred3", "nb"), ["iter", "k"]).groupBy("iter").agg(F.sum(F.col("na") * F.col("nb")).alias("ch"))
    tot = c.groupBy("iter").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("pred") == F.col("pred3"), F.col("n")).otherwise(0.0)).alias("same"))
    ch = F.col("ch") / (F.col("n") * F.col("n"))
    own = S.cohen_kappa(pixels(spark, sf).where("pred <> 255 and pred3 <> 255"), "pred", "pred3").select(F.col("kappa").alias("estimate"))
    return rounded(S.interval(tot.join(pe, "iter").select(((F.col("same") / F.col("n") - ch) / (1 - ch)).alias("stat")), own))


@query("agg_paired_tests", PAIRS + """, bs AS (SELECT a,b,count(*) AS n, avg(diff) AS md, stddev_samp(diff) AS sd FROM pr GROUP BY ALL), rk AS (SELECT a,b,diff, rank() OVER (PARTITION BY a,b ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY a,b,abs(diff))-1)/2e0 AS r FROM pr WHERE diff<>0),
w AS (SELECT a,b,least(sum(CASE WHEN diff>0 THEN r ELSE 0 END),sum(CASE WHEN diff<0 THEN r ELSE 0 END)) AS w FROM rk GROUP BY ALL) SELECT a,b,n,round(md,6) AS mean_diff, round(md/sd,6) AS dz, round(md/(sd/sqrt(n)),6) AS t, round(w,6) AS w FROM bs LEFT JOIN w USING (a,b)""")
def _(spark, sf):
    return rounded(S.paired_tests(pairs(spark, sf)))


@query("agg_cliffs_delta", f"WITH {RESULTS}, n AS (SELECT method AS m, score AS v, CAST(count(*) AS DOUBLE) AS n FROM res GROUP BY ALL), t AS (SELECT m, sum(n) AS t FROM n GROUP BY m) SELECT l.m AS a, r.m AS b, round(sum(CASE WHEN l.v>r.v THEN l.n*r.n WHEN l.v<r.v THEN -l.n*r.n ELSE 0 END)/any_value(ta.t*tb.t),6) AS delta FROM n l JOIN n r ON l.m<r.m JOIN t ta ON ta.m=l.m JOIN t tb ON tb.m=r.m GROUP BY ALL")
def _(spark, sf):
    return rounded(S.cliffs_delta(results(spark, sf), "method", "score"))


PV = f"WITH {RESULTS}, pv AS (SELECT image AS test, CASE WHEN image%10=9 THEN NULL ELSE avg(score)*avg(score) END AS p FROM res GROUP BY image)"


@query("win_holm_bh", PV + """, o AS (SELECT test, p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM pv WHERE p IS NOT NULL), h AS (SELECT test, p, least(1, max((m-i+1)*p) OVER (ORDER BY i)) AS holm, least(1, min(p*m/i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh FROM o)
SELECT pv.test, round(pv.p,6) AS p, round(holm,6) AS holm, round(bh,6) AS bh FROM pv LEFT JOIN h USING (test)""")
def _(spark, sf):
    pv = results(spark, sf).groupBy(F.col("image").alias("test")).agg((F.avg("score") * F.avg("score")).alias("p"))
    return rounded(S.holm_bh(pv.withColumn("p", F.when(F.col("test") % 10 != 9, F.col("p"))), "p"))


@query("win_select_best", f"""WITH {RESULTS}, l AS (SELECT method AS approach, avg(score) AS iou, stddev_samp(score) AS spread, CAST(count(*) AS DOUBLE) AS cost FROM res GROUP BY method), u AS (SELECT approach, 'iou' AS metric, iou AS value, -iou AS key, 0.6 AS w FROM l UNION ALL SELECT approach,'spread',spread,spread,0.3 FROM l UNION ALL SELECT approach,'cost',cost,cost,0.1 FROM l),
r AS (SELECT approach, w, row_number() OVER (PARTITION BY metric ORDER BY key, approach)-1 AS rk, count(*) OVER (PARTITION BY metric) AS n FROM u) SELECT approach, round(sum(w*(1-rk/(n-1))),6) AS score FROM r WHERE n>=2 GROUP BY approach""")
def _(spark, sf):
    m = results(spark, sf).groupBy(F.col("method").alias("approach")).agg(F.avg("score").alias("iou"), F.stddev_samp("score").alias("spread"), F.count("*").cast("double").alias("cost"))
    return rounded(S.select_best(m.unpivot(["approach"], ["iou", "spread", "cost"], "metric", "value"), {"iou": 0.6, "-spread": 0.3, "-cost": 0.1}))


@query("agg_seed_summary", f"""WITH {RESULTS}, s AS (SELECT method, seed, avg(score) AS v FROM res GROUP BY ALL), t AS (SELECT method, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM s GROUP BY method)
SELECT method, n, round(mean,6) AS mean, round(sd,6) AS sd, round(mean - q*sd/sqrt(n),6) AS lo, round(mean + q*sd/sqrt(n),6) AS hi FROM t JOIN (VALUES (2,12.706),(3,4.303),(4,3.182),(5,2.776),(6,2.571),(7,2.447),(8,2.365),(9,2.306),(10,2.262)) AS tq(k,q) ON k=n""")
def _(spark, sf):
    from labelmill.operators.tables import seed_summary

    by = results(spark, sf).groupBy("method", "seed").agg(F.avg("score").alias("v"))
    return rounded(seed_summary(by, ["method"], "v"))


@query("agg_benchmark_pipeline", f"""WITH {PX}, m AS (SELECT 'a' AS approach, image, ref, pred AS k FROM px UNION ALL SELECT 'b', image, ref, pred3 FROM px), im AS (SELECT approach, image, avg(CAST(ref=k AS INTEGER)) AS acc FROM m WHERE ref<>255 GROUP BY ALL), pool AS (SELECT approach, avg(CAST(ref=k AS INTEGER)) AS pooled FROM m WHERE ref<>255 GROUP BY approach)
SELECT approach, count(*) AS images, round(avg(acc),6) AS mean_accuracy, round(stddev_samp(acc),6) AS sd_accuracy, round(any_value(pooled),6) AS pooled_accuracy FROM im JOIN pool USING (approach) GROUP BY approach""")
def _(spark, sf):
    m = pixels(spark, sf).where("ref <> 255").select("image", "ref", F.explode(F.array(F.struct(F.lit("a").alias("approach"), F.col("pred").alias("k")), F.struct(F.lit("b").alias("approach"), F.col("pred3").alias("k")))).alias("m")).select("image", "ref", "m.*")
    per = m.groupBy("approach", "image").agg(F.count_if(F.col("ref") == F.col("k")).alias("hit"), F.count("*").alias("n"))
    return rounded(per.groupBy("approach").agg(F.count("*").alias("images"), F.avg(F.col("hit") / F.col("n")).alias("mean_accuracy"), F.stddev_samp(F.col("hit") / F.col("n")).alias("sd_accuracy"), (F.sum("hit") / F.sum("n")).alias("pooled_accuracy")))


@query("agg_model_agreement", f"WITH {PX} SELECT image, round(avg(CAST(pred=pred3 AS INTEGER)),6) AS agreement FROM px WHERE pred<>255 AND pred3<>255 GROUP BY image")
def _(spark, sf):
    px = pixels(spark, sf).where("pred <> 255 and pred3 <> 255")
    return rounded(px.groupBy("image").agg(F.avg((F.col("pred") == F.col("pred3")).cast("int")).alias("agreement")))


@query("agg_composition", f"WITH {PX}, f AS (SELECT image, pred AS cls, count(*)/CAST(sum(count(*)) OVER (PARTITION BY image) AS DOUBLE) AS share FROM px GROUP BY image, pred) SELECT cls, round(sum(share)/(SELECT count(DISTINCT image) FROM px),6) AS share FROM f GROUP BY cls")
def _(spark, sf):
    n = pixels(spark, sf).groupBy("image", F.col("pred").alias("cls")).agg(F.count("*").alias("n"))
    f = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("image")))
    return rounded(f.groupBy("cls").agg(F.sum("share").alias("s")).crossJoin(n.agg(F.count_distinct("image").alias("k"))).select("cls", (F.col("s") / F.col("k")).alias("share")))


@query("agg_rare_classes", f"WITH {PX}, s AS (SELECT ref AS cls, count(*) AS n, count(*)/CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM px WHERE ref<>255 GROUP BY ref) SELECT cls, n, round(share,6) AS share FROM s WHERE cls<>0 AND share<0.12")
def _(spark, sf):
    n = pixels(spark, sf).where("ref <> 255").groupBy(F.col("ref").alias("cls")).agg(F.count("*").alias("n"))
    return rounded(n.crossJoin(n.agg(F.sum("n").alias("t"))).select("cls", "n", (F.col("n") / F.col("t")).alias("share")).where("cls <> 0 and share < 0.12"))


@query("agg_bench_summary", "SELECT l_linestatus AS task_set, count(*) AS total, count_if(l_returnflag='R') AS errored, round(avg(CAST(l_discount>=0.05 AS INTEGER)),6) AS pass_rate, round(median(l_extendedprice),6) AS median_latency, round(median(nullif(l_tax,0)),6) AS median_tps FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(li.groupBy(F.col("l_linestatus").alias("task_set")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("errored"), F.avg((F.col("l_discount") >= 0.05).cast("int")).alias("pass_rate"), F.median("l_extendedprice").alias("median_latency"), F.median(F.when(F.col("l_tax") != 0, F.col("l_tax"))).alias("median_tps")))


@query("agg_verdict_accuracy", "SELECT l_linenumber AS task, round(avg(CASE WHEN l_returnflag = (CASE WHEN l_linestatus='O' THEN 'N' ELSE 'A' END) THEN 1.0 WHEN l_returnflag='R' THEN 0.5 ELSE 0.0 END),6) AS score, round(avg(CAST(l_returnflag = (CASE WHEN l_linestatus='O' THEN 'N' ELSE 'A' END) AS INTEGER)),6) AS accuracy FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    same = F.col("l_returnflag") == F.when(F.col("l_linestatus") == "O", "N").otherwise("A")  # verdicts: N pass, A fail, R uncertain
    return rounded(li.groupBy(F.col("l_linenumber").alias("task")).agg(F.avg(F.when(same, 1.0).when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)).alias("score"), F.avg(same.cast("int")).alias("accuracy")))


@query("agg_resource", "SELECT user_id, count(*) AS samples, max(value) AS peak, round(avg(CASE WHEN event_type<>'error' THEN value END),6) AS mean_use FROM events GROUP BY user_id")
def _(spark, sf):
    return rounded(table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("samples"), F.max("value").alias("peak"), F.avg(F.when(F.col("event_type") != "error", F.col("value"))).alias("mean_use")), "peak")


@query("agg_latency", "SELECT event_type AS model, round(avg(value),6) AS mean, round(median(value),6) AS median, round(quantile_cont(value,0.95),6) AS p95, round(1/nullif(avg(value),0),6) AS fps FROM events GROUP BY 1")
def _(spark, sf):
    return rounded(table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.percentile("value", F.lit(0.95)).alias("p95"), (1 / F.avg("value")).alias("fps")))


@query("agg_job_progress", "SELECT o_custkey AS job, count_if(o_orderstatus='O') AS pending, count_if(o_orderstatus='F') AS approved, count_if(o_orderstatus='P') AS duplicate, count(*) AS total FROM orders GROUP BY 1")
def _(spark, sf):
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("job")).agg(is_("O").alias("pending"), is_("F").alias("approved"), is_("P").alias("duplicate"), F.count("*").alias("total"))


@query("agg_accept_rate", "SELECT l_suppkey AS job, l_linenumber AS round, count(*) AS generated, count_if(l_returnflag='N') AS valid, round(count_if(l_returnflag='N')/CAST(count(*) AS DOUBLE),6) AS accept_rate, CAST(ceil((100-count_if(l_returnflag='N'))/greatest(count_if(l_returnflag='N')/CAST(count(*) AS DOUBLE),0.2e0)) AS BIGINT) AS next_ask FROM lineitem GROUP BY ALL")
def _(spark, sf):
    from labelmill.operators.bank import accept_rate

    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("job"), F.col("l_linenumber").alias("round"), (F.col("l_returnflag") == "N").alias("valid"))
    return rounded(accept_rate(li, 100))


@query("agg_small_counts_by_status", f"WITH {ANN} SELECT cls, status, count(*) AS n, CAST(sum(bw*bh) AS BIGINT) AS area FROM ann GROUP BY ALL")
def _(spark, sf):
    return annotations(spark, sf).groupBy("cls", "status").agg(F.count("*").alias("n"), F.sum(F.col("bw") * F.col("bh")).alias("area"))

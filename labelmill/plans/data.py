"""Inputs that the registered queries derive from the given tables, in Spark and in the same words as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.plans.registry import table

CUTS = (-0.12, -0.02, 0.05, 0.12, 0.2)


def _class(v: Column) -> Column:
    out = F.lit(len(CUTS))
    for k in range(len(CUTS) - 1, -1, -1):
        out = F.when(v < CUTS[k], k).otherwise(out)
    return out


def _class_sql(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} < {c}e0 THEN {k}" for k, c in enumerate(CUTS)) + f" ELSE {len(CUTS)} END"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense images from embeddings: image = label, y = place within the label, x = component.

    ref (255: ignored), pred and pred3 (255: uncertain) are classes 0..5 by value; conf is
    pred's confidence, p0..p3 probabilities of four classes.
    """
    e = table(spark, sf_dir, "embeddings")
    y = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    px = e.select(F.col("label").alias("image"), y.alias("y"), "embedding").select("image", "y", F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    px = px.withColumn("ref", F.when((y * 64 + x) % 97 == 0, 255).otherwise(_class(v)))
    px = px.withColumn("pred", F.when((x * 3 + y * 5) % 37 == 0, 255).otherwise(_class(v + ((x * 7 + y * 3) % 5 - 2) * 0.03)))
    px = px.withColumn("pred3", F.when((x + y * 7) % 53 == 0, 255).otherwise(_class(v + ((x * 5 + y * 11) % 7 - 3) * 0.02)))
    px = px.withColumn("conf", (x * 13 + y * 29 + F.col("image") * 7) % 101 / 100.0)
    a = [1 + (x * (k + 3) + y * (k + 5) + F.col("image")) % 11 for k in range(4)]
    total = a[0] + a[1] + a[2] + a[3]
    return px.select("*", *[(a[k] / total).alias(f"p{k}") for k in range(4)])


_A = [f"(1 + (x*{k + 3}+y*{k + 5}+image) % 11)" for k in range(4)]
PX = f"""base AS (SELECT label AS image, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS y, embedding FROM embeddings),
px0 AS (SELECT image, y, CAST(unnest(range(64)) AS INTEGER) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM base),
px AS (SELECT image, y, x, v,
 CASE WHEN (y*64+x) % 97 = 0 THEN 255 ELSE {_class_sql("v")} END AS ref,
 CASE WHEN (x*3+y*5) % 37 = 0 THEN 255 ELSE {_class_sql("(v + ((x*7+y*3) % 5 - 2) * 0.03e0)")} END AS pred,
 CASE WHEN (x+y*7) % 53 = 0 THEN 255 ELSE {_class_sql("(v + ((x*5+y*11) % 7 - 3) * 0.02e0)")} END AS pred3,
 ((x*13+y*29+image*7) % 101) / 100e0 AS conf,
 {", ".join(f"{_A[k]} / CAST({' + '.join(_A)} AS DOUBLE) AS p{k}" for k in range(4))} FROM px0)"""


def regions_sql(value: str) -> str:
    """cl (image, value, y, x0, x1, comp): the runs of value in px and their 4-connected regions, by reachability."""
    return f"""cr AS MATERIALIZED (SELECT image, value, y, min(x) AS x0, max(x) AS x1, CAST(y AS BIGINT) * 4294967296 + min(x) AS id FROM (SELECT image, y, x, value, x - row_number() OVER (PARTITION BY image, y, value ORDER BY x) AS g FROM (SELECT image, y, x, {value} AS value FROM px)) WHERE value IS NOT NULL GROUP BY image, value, y, g),
ce AS MATERIALIZED (SELECT a.image, unnest([a.id, b.id]) AS s, unnest([b.id, a.id]) AS t FROM cr a JOIN cr b ON a.image = b.image AND a.value = b.value AND b.y = a.y + 1 AND b.x0 <= a.x1 AND a.x0 <= b.x1),
cc(image, s, t) AS (SELECT image, id, id FROM cr UNION SELECT cc.image, cc.s, ce.t FROM cc JOIN ce ON cc.image = ce.image AND cc.t = ce.s),
cl AS MATERIALIZED (SELECT cr.*, comp FROM cr JOIN (SELECT image, t AS id, min(s) AS comp FROM cc GROUP BY ALL) USING (image, id))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of methods on images: method = l_returnflag, image = l_orderkey % 50, seed = l_linenumber, score = l_discount."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("method"), (F.col("l_orderkey") % 50).alias("image"), F.col("l_linenumber").alias("seed"), (F.col("l_discount") + F.col("l_suppkey") % 7 / 100.0).alias("score"))


RESULTS = "res AS (SELECT l_returnflag AS method, l_orderkey % 50 AS image, l_linenumber AS seed, l_discount + (l_suppkey % 7) / 100e0 AS score FROM lineitem)"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on 256 x 256 images from orders: image = o_custkey, class = priority 1..5, z = o_orderkey."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("ann"), F.col("o_custkey").alias("image"), F.substring("o_orderpriority", 1, 1).cast("int").alias("cls"), k.alias("z"),
        (k * 7 % 200).cast("int").alias("bx"), (k * 11 % 220).cast("int").alias("bt"), (k % 23 + 4).cast("int").alias("bw"), (k % 17 + 4).cast("int").alias("bh"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("price"))


ANN = "ann AS (SELECT o_orderkey AS ann, o_custkey AS image, CAST(substr(o_orderpriority,1,1) AS INTEGER) AS cls, o_orderkey AS z, CAST(o_orderkey*7%200 AS INTEGER) AS bx, CAST(o_orderkey*11%220 AS INTEGER) AS bt, CAST(o_orderkey%23+4 AS INTEGER) AS bw, CAST(o_orderkey%17+4 AS INTEGER) AS bh, o_orderstatus AS status, o_orderdate AS created, o_totalprice AS price FROM orders)"


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour observations from lineitem: id = (orderkey, linenumber), 8-bit r, g, b, class label."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") * 7 % 256).cast("int").alias("g"), (F.col("l_orderkey") % 256).cast("int").alias("b"), F.col("l_returnflag").alias("label"))


COLOURS = "col AS (SELECT l_orderkey AS ok, l_linenumber AS ln, CAST(l_partkey%256 AS INTEGER) AS r, CAST(l_suppkey*7%256 AS INTEGER) AS g, CAST(l_orderkey%256 AS INTEGER) AS b, l_returnflag AS label FROM lineitem)"

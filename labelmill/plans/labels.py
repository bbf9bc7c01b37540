"""Queries of label images, annotations, colours and polarization."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions import color as K
from labelmill.functions import polar as P
from labelmill.functions.base import r6, ratio
from labelmill.operators import labels as L
from labelmill.operators import tables as T
from labelmill.operators.lineage import cut, scratch
from labelmill.operators.regions import labelled_runs
from labelmill.plans.data import ANN, COLOURS, PX, annotations, colours, pixels, regions_sql
from labelmill.plans.registry import query, table
from labelmill.plans.stats import VOTES, rounded, votes

# ---------------------------------------------------------------- annotations


@query("flt_review_queue", f"WITH {ANN} SELECT ann, image FROM ann WHERE cls=2 AND status='O' AND price<=200000 AND created>=TIMESTAMP '1996-01-01' ORDER BY image, created, ann")
def _(spark, sf):
    import datetime

    q = L.review_queue(annotations(spark, sf), cls=2, status="O", price_max=200000.0, created_from=datetime.datetime(1996, 1, 1), image=None)
    return q.orderBy("image", "created", "ann").select("ann", "image")


TAX = "tax(cls, name, off) AS (VALUES (1,'urgent',FALSE),(2,'high',FALSE),(3,'medium',TRUE),(4,NULL,FALSE))"


def taxonomy(spark):
    return spark.createDataFrame([(1, "urgent", False), (2, "high", False), (3, "medium", True), (4, None, False)], "cls int, name string, off boolean")


@query("jn_review_index", f"WITH {ANN}, {TAX} SELECT ann, o.image, c_mktsegment AS file, coalesce(name,'') AS class_name FROM ann o JOIN customer ON c_custkey=o.image LEFT JOIN tax USING (cls)")
def _(spark, sf):
    im = table(spark, sf, "customer").select(F.col("c_custkey").alias("image"), F.col("c_mktsegment").alias("file"))
    j = annotations(spark, sf).join(im, "image").join(F.broadcast(taxonomy(spark)), "cls", "left")  # four literal rows
    return j.select("ann", "image", "file", F.coalesce("name", F.lit("")).alias("class_name"))


@query("jn_taxonomy_missing", f"WITH {ANN}, {TAX} SELECT cls, count(*) AS n, CASE WHEN any_value(t.cls2) IS NULL THEN 'missing' WHEN any_value(off) THEN 'disabled' ELSE 'ok' END AS state FROM ann LEFT JOIN (SELECT cls AS cls2, off FROM tax) t ON t.cls2=ann.cls GROUP BY cls")
def _(spark, sf):
    n = annotations(spark, sf).groupBy("cls").agg(F.count("*").alias("n"))
    j = n.join(taxonomy(spark).withColumn("known", F.lit(True)), "cls", "left")
    return j.select("cls", "n", F.when(F.col("known").isNull(), "missing").when(F.col("off"), "disabled").otherwise("ok").alias("state"))


@query("prj_class_id", "SELECT c_custkey AS id, CASE lower(trim('  '||c_mktsegment||' ')) WHEN 'building' THEN 1 WHEN 'machinery' THEN 2 WHEN 'household' THEN 3 ELSE 255 END AS cls FROM customer")
def _(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in (("building", 1), ("machinery", 2), ("household", 3)) for x in kv])
    title = F.lower(F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(names[title], F.lit(255)).alias("cls"))


@query("flt_bounds", f"WITH {ANN} SELECT ann, bx+bw>210 OR bt+bh>230 AS outside FROM ann")
def _(spark, sf):
    a = annotations(spark, sf)
    corners = F.array(F.struct((F.col("bx") + F.col("bw")).alias("x"), (F.col("bt") + F.col("bh")).alias("y")), F.struct(F.col("bx").alias("x"), F.col("bt").alias("y")))
    return a.select("ann", F.exists(corners, lambda p: (p["x"] > 210) | (p["y"] > 230) | (p["x"] < 0) | (p["y"] < 0)).alias("outside"))



@query("win_topmost", f"WITH {ANN}, bp AS (SELECT image, cls, z, y, unnest(range(bx, bx+bw)) AS x FROM (SELECT *, unnest(range(bt, bt+bh)) AS y FROM ann)), t AS (SELECT image, y, x, arg_max(cls, z) AS cls, count(*) AS claims FROM bp GROUP BY ALL) SELECT image, cls, count(*) AS pixels, CAST(sum(claims-1) AS BIGINT) AS overlaps FROM t GROUP BY ALL")
def _(spark, sf):
    t = L.topmost_cells(annotations(spark, sf))
    return t.groupBy("image", "cls").agg(F.sum("pixels").alias("pixels"), F.sum((F.col("claims") - 1) * F.col("pixels")).alias("overlaps"))


@query("win_topmost_created", f"WITH {ANN}, bp AS (SELECT image, cls, ann%3 AS z, created, y, unnest(range(bx, bx+bw)) AS x FROM (SELECT *, unnest(range(bt, bt+bh)) AS y FROM ann)), t AS (SELECT image, y, x, arg_max(cls, (z, created, cls)) AS cls, count(*) AS claims FROM bp GROUP BY ALL) SELECT image, cls, count(*) AS pixels, CAST(sum(claims-1) AS BIGINT) AS overlaps FROM t GROUP BY ALL")
def _(spark, sf):
    """Three heights only: the time of creation decides within them."""
    t = L.topmost_cells(annotations(spark, sf).withColumn("z", F.col("ann") % 3), ("z", "created"))
    return t.groupBy("image", "cls").agg(F.sum("pixels").alias("pixels"), F.sum((F.col("claims") - 1) * F.col("pixels")).alias("overlaps"))


@query("udf_filter", f"WITH {ANN}, bp AS (SELECT image, cls, z, y, unnest(range(bx, bx+bw)) AS x FROM (SELECT *, unnest(range(bt, bt+bh)) AS y FROM ann WHERE status='F')) SELECT image, count(DISTINCT (y, x)) AS pixels FROM bp GROUP BY image")
def _(spark, sf):
    keep = F.col("status") == "F"  # any condition on an annotation
    return L.topmost_cells(annotations(spark, sf).where(keep)).groupBy("image").agg(F.sum("pixels").alias("pixels"))


PAIR = f"""{ANN}, pr AS (SELECT a.ann AS a, b.ann AS b, least(a.bx+a.bw,b.bx+b.bw)-greatest(a.bx,b.bx) AS w, least(a.bt+a.bh,b.bt+b.bh)-greatest(a.bt,b.bt) AS h, a.bw*a.bh+b.bw*b.bh AS s FROM ann a JOIN ann b ON a.image=b.image AND a.ann<b.ann)"""


@query("jn_overlap_pixels", f"WITH {PAIR} SELECT a, b, CAST(w*h AS BIGINT) AS pixels FROM pr WHERE w>0 AND h>0")
def _(spark, sf):
    return L.box_overlap(annotations(spark, sf)).select("a", "b", "pixels")


@query("jn_box_iou", f"WITH {PAIR} SELECT a, b, round(w*h/CAST(s-w*h AS DOUBLE),6) AS iou FROM pr WHERE w>0 AND h>0")
def _(spark, sf):
    return rounded(L.box_overlap(annotations(spark, sf)).select("a", "b", "iou"))


OLDNEW = f"{PX}, o AS (SELECT image,y,x,pred AS cls FROM px WHERE pred=1 OR pred=2), n AS (SELECT image,y,x,pred3 AS cls FROM px WHERE pred3=2 OR pred3=3)"


def old_new(spark, sf):
    px = pixels(spark, sf)
    return px.where("pred in (1, 2)").select("image", "y", "x", F.col("pred").alias("cls")), px.where("pred3 in (2, 3)").select("image", "y", "x", F.col("pred3").alias("cls"))


@query("jn_overlap_policy", f"WITH {OLDNEW}, k AS (SELECT 'preserve' AS policy, image, coalesce(o.cls, n.cls) AS cls FROM o FULL JOIN n USING (image,y,x) UNION ALL SELECT 'replace', image, coalesce(n.cls, o.cls) FROM o FULL JOIN n USING (image,y,x)) SELECT policy, image, cls, count(*) AS pixels FROM k GROUP BY ALL")
def _(spark, sf):
    o, n = old_new(spark, sf)
    out = [L.resolve_overlap(n, o, p).withColumn("policy", F.lit(p)) for p in ("preserve", "replace")]
    return out[0].unionByName(out[1]).groupBy("policy", "image", "cls").agg(F.count("*").alias("pixels"))


@query("set_mask_algebra", f"WITH {OLDNEW}, j AS (SELECT image, o.cls AS a, n.cls AS b FROM o FULL JOIN n USING (image,y,x)) SELECT image, count(*) AS in_union, count_if(a IS NOT NULL AND b IS NOT NULL) AS in_both, count_if(b IS NULL) AS only_old FROM j GROUP BY image")
def _(spark, sf):
    o, n = (d.select("image", "y", "x") for d in old_new(spark, sf))
    count = lambda d, name: d.groupBy("image").agg(F.count("*").alias(name))
    j = count(o.union(n).distinct(), "in_union").join(count(o.intersect(n), "in_both"), "image", "left").join(count(o.exceptAll(n), "only_old"), "image", "left")
    return j.na.fill(0)


@query("agg_coverage_report", f"WITH {PX} SELECT image, count(*) AS total, count(*)-count_if(ref=255)-count_if(ref=0) AS labelled, count_if(ref=255) AS ignored, count_if(ref=0) AS unlabelled, round(100*(count(*)-count_if(ref=255)-count_if(ref=0))/CAST(count(*) AS DOUBLE),6) AS coverage FROM px GROUP BY image")
def _(spark, sf):
    return rounded(L.coverage_report(pixels(spark, sf), "ref"))


@query("agg_instances", f"WITH {ANN} SELECT cls, count(*) AS instances, round(avg(bw*bh),6) AS mean_area, round(median(bw*bh),6) AS median_area, min(bw*bh) AS least, max(bw*bh) AS most, count_if(status='F') AS verified FROM ann GROUP BY cls")
def _(spark, sf):
    area = F.col("bw") * F.col("bh")
    return rounded(annotations(spark, sf).groupBy("cls").agg(F.count("*").alias("instances"), F.avg(area).alias("mean_area"), F.median(area).alias("median_area"), F.min(area).alias("least"), F.max(area).alias("most"), F.count_if(F.col("status") == "F").alias("verified")))


@query("agg_size_hist", f"WITH {ANN} SELECT CAST(CASE WHEN bw*bh<=10 THEN 10 WHEN bw*bh<=100 THEN 100 WHEN bw*bh<=1000 THEN 1000 ELSE 10000 END AS BIGINT) AS bucket, count(*) AS n FROM ann GROUP BY 1")
def _(spark, sf):
    return annotations(spark, sf).groupBy(L.size_bucket(F.col("bw") * F.col("bh")).alias("bucket")).agg(F.count("*").alias("n"))


def ring(*points):
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def outlines(a):
    """Annotations with points: the corners of the box, in an order that crosses itself where ann divides by 3."""
    x0, y0, x1, y1 = F.col("bx"), F.col("bt"), F.col("bx") + F.col("bw"), F.col("bt") + F.col("bh")
    return a.withColumn("points", F.when(F.col("ann") % 3 == 0, ring((x0, y0), (x1, y1), (x1, y0), (x0, y1))).otherwise(ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))))


@query("agg_quality_issues", f"""WITH {ANN}, a AS (SELECT ann, image, cls, bx, bt, CASE WHEN ann%46=0 THEN 0 ELSE bw END AS bw, bh, status, CASE status WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS verified FROM ann), c(cls, enabled, required) AS (VALUES (1,TRUE,2),(2,TRUE,1),(3,FALSE,1),(4,TRUE,0)), s AS (SELECT * FROM a WHERE bw>0)
SELECT ann, image, 'error' AS severity, 'empty' AS message FROM a WHERE bw=0 UNION ALL SELECT ann, image, 'error', 'outside the image' FROM s WHERE bx+bw>210 OR bt+bh>230 UNION ALL SELECT ann, image, 'error', 'vertex outside the image' FROM s WHERE bx+bw>=210 OR bt+bh>=230 UNION ALL SELECT ann, image, 'warning', 'very small' FROM s WHERE bw*bh<30
UNION ALL SELECT ann, image, 'error', 'class not defined' FROM a WHERE cls NOT IN (SELECT cls FROM c) UNION ALL SELECT ann, image, 'info', 'class not enabled' FROM a JOIN c USING (cls) WHERE NOT enabled UNION ALL SELECT ann, image, 'info', 'less verified than its class asks for' FROM a JOIN c USING (cls) WHERE verified<required UNION ALL SELECT ann, image, 'info', 'not verified' FROM a WHERE status='P'
UNION ALL SELECT ann, image, 'warning', 'crosses itself' FROM s WHERE ann%3=0
UNION ALL SELECT DISTINCT NULL, p.image, 'warning', 'pixels claimed by several' FROM s p JOIN s q ON p.image=q.image AND p.ann<q.ann AND least(p.bx+p.bw,q.bx+q.bw)>greatest(p.bx,q.bx) AND least(p.bt+p.bh,q.bt+q.bh)>greatest(p.bt,q.bt)
UNION ALL SELECT DISTINCT NULL, image, 'error', 'file not found' FROM a WHERE image NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal>=0)""")
def _(spark, sf):
    """Classes 1 to 4 are defined, 3 is not enabled; boxes divisible by 46 are emptied; files are those of customers whose balance isn't negative."""
    a = annotations(spark, sf).withColumn("bw", F.when(F.col("ann") % 46 == 0, 0).otherwise(F.col("bw"))).withColumn("verified", F.when(F.col("status") == "F", 2).when(F.col("status") == "O", 1).otherwise(0))
    classes = spark.createDataFrame([(1, True, 2), (2, True, 1), (3, False, 1), (4, True, 0)], "cls int, enabled boolean, required int")
    files = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("image"))
    return L.quality_issues(outlines(a), 210, 230, 30, classes, files)


@query("agg_efficiency", "WITH m AS (SELECT user_id, event_type, TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE) AS k FROM events) SELECT user_id, round(sum(k),6) AS seconds, round(avg(k),6) AS mean_seconds, count_if(event_type='click') AS interactions FROM m GROUP BY user_id")
def _(spark, sf):
    p = F.from_json("props", "map<string,string>")
    k = F.element_at(p, "k").try_cast("double")
    return rounded(table(spark, sf, "events").withColumn("k", k).groupBy("user_id").agg(F.sum("k").alias("seconds"), F.avg("k").alias("mean_seconds"), F.count_if(F.col("event_type") == "click").alias("interactions")))


@query("fn_map_params", "SELECT event_id, 'k' AS key, TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE) AS value FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v")).select("event_id", "key", F.col("v").try_cast("double").alias("value"))


@query("fn_time_format", "SELECT event_id, strftime(ts,'%Y-%m-%d %H:%M:%S')||' UTC' AS text FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("text"))


@query("snk_coco", f"WITH {ANN} SELECT row_number() OVER (ORDER BY image, ann) AS id, image AS image_id, cls AS category_id, bw*bh AS area, [bx,bt,bw,bh] AS bbox FROM ann WHERE cls NOT IN (0,255,5)")
def _(spark, sf):
    from labelmill.sources.exports import coco_annotations

    return coco_annotations(annotations(spark, sf), skip=(0, 255, 5))


SEG = "CASE WHEN pred IN (2, 3) THEN 1 WHEN pred IN (4, 5) THEN 2 WHEN pred = 1 THEN 3 ELSE pred END"


def seg_pixels(spark, sf):
    """Dense label images of three classes, 0 (unlabelled) and 255 (ignored)."""
    pred = F.col("pred")
    return pixels(spark, sf).withColumn("seg", F.when(pred.isin(2, 3), 1).when(pred.isin(4, 5), 2).when(pred == 1, 3).otherwise(pred))


def seg_frames(px):
    return px.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


@query("snk_coco_segmentation", f"""WITH RECURSIVE {PX}, {regions_sql(SEG)},
sz AS (SELECT image, value, comp, CAST(sum(x1-x0+1) AS BIGINT) AS area, [min(x0), min(y), max(x1)-min(x0)+1, max(y)-min(y)+1] AS bbox FROM cl WHERE value NOT IN (0, 255) GROUP BY ALL),
pp AS (SELECT image, comp, y, unnest(range(x0, x1+1)) AS x FROM cl WHERE value NOT IN (0, 255)),
pt AS (SELECT image, comp, y+dy AS y, x+dx AS x, count(*) AS n, sum(b) AS b FROM pp, (VALUES (0,0,8),(0,1,4),(1,0,2),(1,1,1)) t(dy, dx, b) GROUP BY ALL),
co AS (SELECT image, comp, CAST(sum(CASE WHEN n IN (1,3) THEN 1 WHEN b IN (6,9) THEN 2 ELSE 0 END) AS BIGINT) AS corners, 1-sum(CASE WHEN n=1 THEN 1 WHEN n=3 THEN -1 WHEN b IN (6,9) THEN 2 ELSE 0 END)//4 AS holes FROM pt GROUP BY ALL),
ht AS (SELECT image, max(y)+1 AS h FROM px GROUP BY image),
il AS (SELECT image, comp, h, min(p) AS a, max(p)+1 AS b FROM (SELECT image, comp, h, x*h+y AS p, x*h+y-row_number() OVER (PARTITION BY image, comp ORDER BY x*h+y) AS g FROM pp JOIN ht USING (image)) GROUP BY image, comp, h, g),
rl AS (SELECT image, comp, md5(string_agg((a-coalesce(w,0))||','||(b-a), ',' ORDER BY a)||CASE WHEN any_value(64*h)>max(b) THEN ','||any_value(64*h)-max(b) ELSE '' END) AS counts FROM (SELECT *, lag(b) OVER (PARTITION BY image, comp ORDER BY a) AS w FROM il) GROUP BY image, comp)
SELECT row_number() OVER (ORDER BY image, comp) AS id, image AS image_id, value AS category_id, area, bbox, CAST(holes AS BIGINT) AS holes, corners, CASE WHEN holes>0 THEN counts END AS counts_md5 FROM sz JOIN co USING (image, comp) JOIN rl USING (image, comp)""")
def _(spark, sf):
    """Regions of label images as COCO annotations: outlines where there are no holes, run lengths elsewhere; the rings' areas are checked in the tests."""
    from labelmill.sources.exports import coco_segments

    px = seg_pixels(spark, sf)
    a = coco_segments(labelled_runs(px, "seg"), seg_frames(px))
    return a.select("id", "image_id", "category_id", "area", "bbox", "holes", "corners", F.md5(F.array_join("counts", ",")).alias("counts_md5"))


@query("chk_export_release", f"WITH {PX} SELECT image, count(*) AS pixels, 0 AS missing, 0 AS unexpected, 0 AS coco_missing, 0 AS coco_unexpected, TRUE AS size_ok FROM px GROUP BY image")
def _(spark, sf):
    """A release of masks, COCO parts and tables is written, read again, and compared with its source pixel by pixel, both ways."""
    from labelmill.sources.exports import check_dataset, write_dataset

    px = seg_pixels(spark, sf)
    images, root = release_images(px), scratch(spark, "release")
    write_dataset(root, px, images, release_classes(spark), annotations(spark, sf).select("image", "ann", "cls", "status"), "seg")
    return check_dataset(spark, root, px, images, "seg")


def release_images(px):
    """A frame, a file name and a split (by the hash of its number) for each image."""
    part = F.conv(F.substring(F.md5(F.col("image").cast("string")), 1, 6), 16, 10).cast("long") % 10
    return seg_frames(px).withColumns({"file": F.concat(F.lit("image"), "image"), "split": F.when(part < 6, "train").when(part < 8, "val").otherwise("test")})


def release_classes(spark):
    return spark.createDataFrame([(0, "unlabelled"), (1, "middle"), (2, "high"), (3, "low"), (255, "ignored")], "id int, name string")


@query("snk_dataset_tables", f"""WITH {PX}, im AS (SELECT image, max(x)+1 AS width, max(y)+1 AS height, CAST('0x'||substr(md5(CAST(image AS VARCHAR)),1,6) AS BIGINT)%10 AS p FROM px WHERE image IN (SELECT image FROM px WHERE {SEG} NOT IN (0,255)) GROUP BY image), {ANN},
s AS (SELECT image, width, height, CASE WHEN p<6 THEN 'train' WHEN p<8 THEN 'val' ELSE 'test' END AS split FROM im)
SELECT 'images' AS part, split AS key, count(*) AS n FROM s GROUP BY split UNION ALL SELECT 'pixels', split, sum(width*height)::BIGINT FROM s GROUP BY split UNION ALL SELECT 'classes', '', 5 UNION ALL SELECT 'categories', '', 3 UNION ALL SELECT 'verification', status, count(*) FROM ann WHERE image IN (SELECT image FROM s) GROUP BY status""")
def _(spark, sf):
    """The tables of a release of annotated images, read again: images and mask bytes of each split, classes, categories, and annotations by status."""
    from labelmill.sources.exports import write_dataset

    px = seg_pixels(spark, sf)
    root = scratch(spark, "release")
    write_dataset(root, px, release_images(px), release_classes(spark), annotations(spark, sf).select("image", "ann", "cls", "status"), "seg", annotated_only=True, about={"project": "label images"})
    read = lambda name, schema: spark.read.schema(schema).json(f"{root}/{name}")
    row = lambda df, part, key, n: df.groupBy(key.alias("key")).agg(n.alias("n")).select(F.lit(part).alias("part"), "key", "n")
    none, many = F.lit(""), F.count("*")
    parts = [
        row(read("metadata/images", "image long, split string"), "images", F.col("split"), many),
        row(spark.read.parquet(f"{root}/masks"), "pixels", F.col("split"), F.sum(F.length("mask"))),
        row(read("metadata/classes", "id int"), "classes", none, many), row(read("coco/categories", "id int"), "categories", none, many),
        row(read("metadata/verification", "image long, status string"), "verification", F.col("status"), many),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("snk_yolo", f"""WITH {ANN}, l AS (SELECT image, ann, (cls-1)||' '||printf('%.6f',(bx+0.5e0)/256)||' '||printf('%.6f',(bt+0.5e0)/256)||' '||printf('%.6f',(bx+bw+0.5e0)/256)||' '||printf('%.6f',(bt+0.5e0)/256)||' '||printf('%.6f',(bx+bw+0.5e0)/256)||' '||printf('%.6f',(bt+bh+0.5e0)/256)||' '||printf('%.6f',(bx+0.5e0)/256)||' '||printf('%.6f',(bt+bh+0.5e0)/256) AS line FROM ann), p AS (SELECT 'fill' AS policy, * FROM l UNION ALL SELECT 'skip', * FROM l WHERE ann%4<>0) SELECT policy, image, md5(string_agg(line, chr(10) ORDER BY ann)) AS h FROM p GROUP BY policy, image""")
def _(spark, sf):
    """Under both policies of holes; every fourth annotation has one."""
    from labelmill.sources.exports import yolo_files

    a = annotations(spark, sf)
    x1, y1 = F.col("bx") + F.col("bw"), F.col("bt") + F.col("bh")
    pts = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.col("bx"), F.col("bt")), (x1, F.col("bt")), (x1, y1), (F.col("bx"), y1))])
    a = a.withColumns({"points": pts, "index": F.col("cls") - 1, "n_holes": (F.col("ann") % 4 == 0).cast("int")})
    files = [yolo_files(a, 256, 256, p).select(F.lit(p).alias("policy"), "image", F.md5("text").alias("h")) for p in ("fill", "skip")]
    return files[0].union(files[1])


@query("chk_export", f"WITH {PX} SELECT count_if(pred<>pred3) AS missing, count_if(pred<>pred3) AS unexpected FROM px")
def _(spark, sf):
    px = pixels(spark, sf)
    return T.same_rows(px.select("image", "y", "x", "pred"), px.select("image", "y", "x", F.col("pred3").alias("pred")))


@query("jn_ref_pred", f"WITH {PX}, r AS (SELECT * FROM px WHERE x<60), p AS (SELECT * FROM px WHERE x>2) SELECT image, count_if(r.ref IS NOT NULL AND p.pred IS NOT NULL) AS aligned, count_if(p.pred IS NULL) AS only_ref, count_if(r.ref IS NULL) AS only_pred FROM r FULL JOIN p USING (image,y,x) GROUP BY image")
def _(spark, sf):
    px = pixels(spark, sf)
    j = px.where("x < 60").select("image", "y", "x", "ref").join(px.where("x > 2").select("image", "y", "x", "pred"), ["image", "y", "x"], "full")
    return j.groupBy("image").agg(F.count_if(F.col("ref").isNotNull() & F.col("pred").isNotNull()).alias("aligned"), F.count_if(F.col("pred").isNull()).alias("only_ref"), F.count_if(F.col("ref").isNull()).alias("only_pred"))


AP = f"""WITH {ANN}, t AS (SELECT ann AS truth, image, cls, bx, bt, bw, bh FROM ann), p AS (SELECT ann AS pred, image, cls, CASE WHEN ann%7=0 THEN bx+40 ELSE bx+ann%3 END AS bx, bt+ann%2 AS bt, bw, bh, ((ann*37)%1000)/1000e0 AS score FROM ann WHERE ann%5<>0),
io AS (SELECT pred, truth, greatest(0,least(p.bx+p.bw,t.bx+t.bw)-greatest(p.bx,t.bx))*greatest(0,least(p.bt+p.bh,t.bt+t.bh)-greatest(p.bt,t.bt)) AS i, p.bw*p.bh+t.bw*t.bh AS s FROM p JOIN t USING (image, cls)),
bs AS (SELECT pred, truth, round(i/CAST(s-i AS DOUBLE),9) AS iou, row_number() OVER (PARTITION BY pred ORDER BY round(i/CAST(s-i AS DOUBLE),9) DESC, truth) AS rk FROM io), b AS (SELECT * FROM bs WHERE rk=1),
thr(th) AS (VALUES (0.5e0),(0.75e0)), j AS (SELECT th, p.pred, p.cls, p.score, b.truth, coalesce(iou>=th,FALSE) AS hit FROM p CROSS JOIN thr LEFT JOIN b ON b.pred=p.pred),
c AS (SELECT *, CASE WHEN hit AND row_number() OVER (PARTITION BY th, truth, hit ORDER BY score DESC, pred)=1 THEN 1 ELSE 0 END AS tp FROM j), n AS (SELECT cls, count(*) AS n FROM t GROUP BY cls),
r AS (SELECT th, cls, sum(tp) OVER w/CAST(n AS DOUBLE) AS recall, sum(tp) OVER w/CAST(count(*) OVER w AS DOUBLE) AS prec, row_number() OVER w AS rk FROM c JOIN n USING (cls) WINDOW w AS (PARTITION BY th, cls ORDER BY score DESC, pred ROWS UNBOUNDED PRECEDING)),
e AS (SELECT th, cls, recall - coalesce(lag(recall) OVER (PARTITION BY th, cls ORDER BY rk),0) AS step, max(prec) OVER (PARTITION BY th, cls ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r), ap AS (SELECT th, cls, sum(step*env) AS ap FROM e GROUP BY ALL)"""


def boxes(spark, sf):
    a, k = annotations(spark, sf), F.col("ann")
    truths = a.select(k.alias("truth"), "image", "cls", "bx", "bt", "bw", "bh")
    preds = a.where("ann % 5 <> 0").select(k.alias("pred"), "image", "cls", F.when(k % 7 == 0, F.col("bx") + 40).otherwise(F.col("bx") + k % 3).alias("bx"), (F.col("bt") + k % 2).alias("bt"), "bw", "bh", ((k * 37) % 1000 / 1000.0).alias("score"))
    return preds, truths


@query("win_pr_curve", AP + " SELECT cls, round(ap,6) AS ap FROM ap WHERE th=0.5")
def _(spark, sf):
    return rounded(L.average_precision(*boxes(spark, sf), 0.5))


@query("agg_map", AP + " SELECT round(avg(CASE WHEN th=0.5 THEN ap END),6) AS map50, round(avg(ap),6) AS map_mean FROM ap")
def _(spark, sf):
    b = boxes(spark, sf)
    each = L.average_precision(*b, 0.5).select("ap", F.lit(0.5).alias("th")).union(L.average_precision(*b, 0.75).select("ap", F.lit(0.75).alias("th")))
    return rounded(each.agg(F.avg(F.when(F.col("th") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map_mean")))


# ---------------------------------------------------------------- pixels


EDGE = f"WITH {PX}, e AS (SELECT image, y, x, coalesce(ref<>lag(ref) OVER (PARTITION BY image,y ORDER BY x),FALSE) OR coalesce(ref<>lag(ref) OVER (PARTITION BY image,x ORDER BY y),FALSE) AS er, coalesce(pred3<>lag(pred3) OVER (PARTITION BY image,y ORDER BY x),FALSE) OR coalesce(pred3<>lag(pred3) OVER (PARTITION BY image,x ORDER BY y),FALSE) AS ep FROM px)"


@query("win_boundary", EDGE + " SELECT image, count_if(er) AS ref_edge, count_if(ep) AS pred_edge FROM e GROUP BY image")
def _(spark, sf):
    px = pixels(spark, sf)
    n = lambda c, name: L.boundary(px, c).groupBy("image").agg(F.count_if("edge").alias(name))
    return n("ref", "ref_edge").join(n("pred3", "pred_edge"), "image")


@query("win_boundary_fg", f"WITH {PX}, f AS (SELECT *, CAST(ref IN (2,3) AS INTEGER) AS f FROM px), n AS (SELECT image, f=1 AND least(coalesce(lag(f) OVER r,0),coalesce(lead(f) OVER r,0),coalesce(lag(f) OVER c,0),coalesce(lead(f) OVER c,0))=0 AS edge FROM f WINDOW r AS (PARTITION BY image,y ORDER BY x), c AS (PARTITION BY image,x ORDER BY y)) SELECT image, count_if(edge) AS n FROM n GROUP BY image")
def _(spark, sf):
    return L.boundary_of(pixels(spark, sf), F.col("ref").isin(2, 3)).groupBy("image").agg(F.count_if("edge").alias("n"))


@query("jn_boundary_tol", EDGE + """, a AS (SELECT image,y,x FROM e WHERE ep), b AS (SELECT image,y,x FROM e WHERE er), d(dy,dx) AS (SELECT i, j FROM range(-1,2) t(i), range(-1,2) u(j) WHERE i*i+j*j<=1),
ha AS (SELECT image, count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b, d WHERE b.image=a.image AND a.y=b.y+dy AND a.x=b.x+dx) GROUP BY image), hb AS (SELECT image, count(*) AS n FROM b WHERE EXISTS (SELECT 1 FROM a, d WHERE b.image=a.image AND b.y=a.y+dy AND b.x=a.x+dx) GROUP BY image),
s AS (SELECT image, ha.n/CAST((SELECT count(*) FROM a WHERE a.image=ha.image) AS DOUBLE) AS p, hb.n/CAST((SELECT count(*) FROM b WHERE b.image=hb.image) AS DOUBLE) AS r FROM ha JOIN hb USING (image)) SELECT image, round(p,6) AS precision, round(r,6) AS recall, round(2*p*r/(p+r),6) AS f1 FROM s""")
def _(spark, sf):
    px = pixels(spark, sf)
    edge = lambda c: L.boundary(px, c).where("edge").select("image", "y", "x")
    return rounded(L.boundary_f1(edge("pred3"), edge("ref"), 1))


@query("jn_boundary_dilate", f"WITH {PX}, m AS (SELECT image,y,x FROM px WHERE ref=3), d(dy,dx) AS (VALUES (0,0),(0,1),(0,-1),(1,0),(-1,0)), h AS (SELECT m.image, m.y+dy AS y, m.x+dx AS x, count(*) AS n FROM m, d GROUP BY ALL) SELECT image, count(*) AS band FROM h JOIN px USING (image,y,x) WHERE n<5 GROUP BY image")
def _(spark, sf):
    px = pixels(spark, sf)
    return L.band(px.where("ref = 3").select("image", "y", "x"), px, 1).groupBy("image").agg(F.count("*").alias("band"))


@query("jn_region_adjacency", f"WITH {PX}, p AS (SELECT image, ref AS r, lead(ref) OVER (PARTITION BY image,y ORDER BY x) AS s, lead(ref) OVER (PARTITION BY image,x ORDER BY y) AS t FROM px), u AS (SELECT image,r,s FROM p UNION ALL SELECT image,r,t FROM p) SELECT DISTINCT image, least(r,s) AS a, greatest(r,s) AS b FROM u WHERE s IS NOT NULL AND r<>s")
def _(spark, sf):
    return L.region_adjacency(pixels(spark, sf), "ref")


@query("jn_graph_smooth", f"""WITH {PX}, n0 AS (SELECT image, ref AS r, avg(v) AS p FROM px GROUP BY ALL), p AS (SELECT image, ref AS r, lead(ref) OVER (PARTITION BY image,y ORDER BY x) AS s, lead(ref) OVER (PARTITION BY image,x ORDER BY y) AS t FROM px), u AS (SELECT image,r,s FROM p UNION ALL SELECT image,r,t FROM p), e0 AS (SELECT DISTINCT image, least(r,s) AS a, greatest(r,s) AS b FROM u WHERE s IS NOT NULL AND r<>s),
e AS (SELECT image, a AS r, b AS o, exp(-abs(a-b)/10e0) AS w FROM e0 UNION ALL SELECT image, b, a, exp(-abs(a-b)/10e0) FROM e0), m1 AS (SELECT e.image, e.r, sum(w*p)/sum(w) AS m FROM e JOIN n0 ON n0.image=e.image AND n0.r=e.o GROUP BY ALL), n1 AS (SELECT image, r, CASE WHEN m IS NULL THEN p ELSE 0.5e0*p+0.5e0*m END AS p FROM n0 LEFT JOIN m1 USING (image,r)),
m2 AS (SELECT e.image, e.r, sum(w*p)/sum(w) AS m FROM e JOIN n1 ON n1.image=e.image AND n1.r=e.o GROUP BY ALL) SELECT image, r, round(CASE WHEN m IS NULL THEN p ELSE 0.5e0*p+0.5e0*m END,6) AS p FROM n1 LEFT JOIN m2 USING (image,r)""")
def _(spark, sf):
    px = pixels(spark, sf)
    nodes = px.groupBy("image", F.col("ref").alias("r")).agg(F.avg("v").alias("p"))
    edges = L.region_adjacency(px, "ref").withColumn("w", F.exp(-F.abs(F.col("a") - F.col("b")) / 10.0))
    return rounded(L.graph_smooth(nodes, edges))


@query("win_local_std", f"""WITH {PX}, r AS (SELECT image, y, x, v FROM px), d(k) AS (SELECT * FROM range(-2,3)), h AS (SELECT image, max(y)+1 AS hh FROM px GROUP BY image),
a AS (SELECT r.image, r.y, r.x, avg(q.v) AS s1, avg(q.v*q.v) AS s2 FROM r, d, r q WHERE q.image=r.image AND q.y=r.y AND q.x = CASE WHEN r.x+k<0 THEN -1-(r.x+k) WHEN r.x+k>63 THEN 127-(r.x+k) ELSE r.x+k END GROUP BY ALL),
b AS (SELECT a.image, a.y, a.x, avg(q.s1) AS s1, avg(q.s2) AS s2 FROM a JOIN h ON h.image=a.image, d, a q WHERE q.image=a.image AND q.x=a.x AND q.y = CASE WHEN a.y+k<0 THEN -1-(a.y+k) WHEN a.y+k>hh-1 THEN 2*hh-1-(a.y+k) ELSE a.y+k END GROUP BY ALL) SELECT image, y, x, round(sqrt(greatest(0,s2-s1*s1)),6) AS local_std FROM b""")
def _(spark, sf):
    return rounded(L.window_stats(pixels(spark, sf).select("image", "y", "x", "v"), "v", 2).select("image", "y", "x", "local_std"))


@query("agg_local_contrast")
def _(spark, sf):
    s = L.window_stats(pixels(spark, sf).select("image", "y", "x", "v"), "v", 3, "replicate")
    return rounded(s.groupBy("image").agg(F.avg("local_std").alias("contrast")))


@query("win_gradient", f"""WITH {PX}, h AS (SELECT image,y,x,v, coalesce(lag(v) OVER r, v) AS l, coalesce(lead(v) OVER r, v) AS rr FROM px WINDOW r AS (PARTITION BY image,y ORDER BY x)), g AS (SELECT *, rr-l AS d, l+2*v+rr AS s FROM h),
k AS (SELECT image, coalesce(lag(d) OVER c,d)+2*d+coalesce(lead(d) OVER c,d) AS gx, coalesce(lead(s) OVER c,s)-coalesce(lag(s) OVER c,s) AS gy, l+rr+coalesce(lag(v) OVER c,v)+coalesce(lead(v) OVER c,v)-4*v AS lap FROM g WINDOW c AS (PARTITION BY image,x ORDER BY y)) SELECT image, round(avg(sqrt(gx*gx+gy*gy)/8),6) AS mean_gradient, round(var_pop(lap),6) AS laplacian_var FROM k GROUP BY image""")
def _(spark, sf):
    g = L.gradient(pixels(spark, sf).select("image", "y", "x", "v"), "v")
    return rounded(g.groupBy("image").agg(F.avg("sobel").alias("mean_gradient"), F.var_pop("laplacian").alias("laplacian_var")))


@query("win_rle_runs", f"WITH {PX}, h AS (SELECT image, max(y)+1 AS hh FROM px GROUP BY image), d AS (SELECT image, x*hh+y AS pos, CAST(ref=1 AS INTEGER) AS v FROM px JOIN h USING (image)), c AS (SELECT *, CAST(coalesce(v<>lag(v) OVER (PARTITION BY image ORDER BY pos), v=1) AS INTEGER) AS ch FROM d), r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY image ORDER BY pos) AS BIGINT) AS run FROM c) SELECT image, run, min(pos) AS start, min(v) AS value, count(*) AS length FROM r GROUP BY image, run")
def _(spark, sf):
    px = pixels(spark, sf).withColumn("m", (F.col("ref") == 1).cast("int"))
    return L.runs(px, "m")


@query("agg_consensus", VOTES + ", n AS (SELECT image,y,x,k,count(*) AS c FROM v GROUP BY ALL), g AS (SELECT image,y,x,count(*) AS kinds,min(k) AS k,max(c) AS top,sum(c) AS n FROM n GROUP BY ALL) SELECT image, count_if(kinds>1) AS review, round(avg(1-top/CAST(n AS DOUBLE)),6) AS disagreement FROM g GROUP BY image")
def _(spark, sf):
    return rounded(L.consensus(votes(spark, sf)).groupBy("image").agg(F.count_if("review").alias("review"), F.avg("disagreement").alias("disagreement")))


@query("agg_adjudication", VOTES + ", g AS (SELECT image,y,x,count(*) AS n,count(DISTINCT k) AS d FROM v GROUP BY ALL) SELECT image, round(avg(CAST(d>1 AS INTEGER)),6) AS disputed FROM g WHERE n>=2 GROUP BY image")
def _(spark, sf):
    g = votes(spark, sf).groupBy("image", "y", "x").agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).where("n >= 2")
    return rounded(g.groupBy("image").agg(F.avg((F.col("d") > 1).cast("int")).alias("disputed")))


@query("agg_region_stats", f"""WITH {PX}, e AS (SELECT image, ref, unnest([{{'d':0,'y':y,'x':x}},{{'d':0,'y':y+1,'x':x}},{{'d':1,'y':y,'x':x}},{{'d':1,'y':y,'x':x+1}}]) AS e FROM px), p AS (SELECT image, ref, count(*) AS perimeter FROM (SELECT image, ref, e FROM e GROUP BY ALL HAVING count(*)=1) GROUP BY ALL), g AS (SELECT image, ref, count(*) AS area, round(avg(v),6) AS mean, round(median(v),6) AS median, round(stddev_pop(v),6) AS sd, round(min(v),6) AS least, round(max(v),6) AS most FROM px GROUP BY ALL)
SELECT image, ref AS region, area, mean, median, sd, least, most, perimeter, round(4*pi()*area/(CAST(perimeter AS DOUBLE)*perimeter),6) AS circularity, round(CAST(perimeter AS DOUBLE)*perimeter/area,6) AS compactness FROM g JOIN p USING (image, ref)""")
def _(spark, sf):
    px, p = pixels(spark, sf).withColumnRenamed("ref", "region"), F.col("perimeter").cast("double")
    g = px.groupBy("image", "region").agg(F.count("*").alias("area"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_pop("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))
    return rounded(g.join(L.perimeters(px, "image", "region"), ["image", "region"]).withColumns({"circularity": 4 * F.pi() * F.col("area") / (p * p), "compactness": p * p / F.col("area")}))


@query("agg_region_hist", f"WITH {PX} SELECT ref AS region, CAST(least(19,greatest(0,floor((v+0.6e0)/1.2e0*20))) AS INTEGER) AS bin, count(*) AS n FROM px GROUP BY ALL")
def _(spark, sf):
    b = F.least(F.lit(19), F.greatest(F.lit(0), F.floor((F.col("v") + 0.6) / 1.2 * 20))).cast("int")
    return pixels(spark, sf).groupBy(F.col("ref").alias("region"), b.alias("bin")).agg(F.count("*").alias("n"))


@query("agg_image_stats", f"WITH {PX} SELECT image, pred AS cls, count(*) AS pixels, round(count(*)/CAST(any_value(t) AS DOUBLE),6) AS share, round(avg(conf),6) AS mean_conf, round(quantile_cont(1-conf,0.95),6) AS p95_uncertainty FROM px JOIN (SELECT image, count(*) AS t FROM px GROUP BY image) USING (image) GROUP BY image, pred")
def _(spark, sf):
    px = pixels(spark, sf)
    g = px.groupBy("image", F.col("pred").alias("cls")).agg(F.count("*").alias("pixels"), F.avg("conf").alias("mean_conf"), F.percentile(1 - F.col("conf"), F.lit(0.95)).alias("p95_uncertainty"))
    total = g.groupBy("image").agg(F.sum("pixels").alias("t"))
    return rounded(g.join(total, "image").select("image", "cls", "pixels", (F.col("pixels") / F.col("t")).alias("share"), "mean_conf", "p95_uncertainty"))


@query("agg_region_features", f"WITH {PX} SELECT image, y, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS sd, round(ln(1+count(*)),6) AS log_size FROM px GROUP BY image, y")
def _(spark, sf):
    return rounded(pixels(spark, sf).groupBy("image", "y").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.log1p(F.count("*")).alias("log_size")))


@query("agg_region_label", f"WITH {PX}, n AS (SELECT image, y, ref, count(*) AS c FROM px WHERE ref<>255 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image,y ORDER BY c DESC, ref) AS rk, c/CAST(sum(c) OVER (PARTITION BY image,y) AS DOUBLE) AS share FROM n) SELECT image, y, ref AS label, round(share,6) AS share FROM r WHERE rk=1 AND share>=0.3")
def _(spark, sf):
    n = pixels(spark, sf).where("ref <> 255").groupBy("image", "y", "ref").agg(F.count("*").alias("c"))
    g = n.groupBy("image", "y").agg(F.max(F.struct("c", (-F.col("ref")).alias("neg"))).alias("m"), F.sum("c").alias("n"))
    return rounded(g.select("image", "y", (-F.col("m.neg")).alias("label"), (F.col("m.c") / F.col("n")).alias("share")).where("share >= 0.3"))


@query("agg_severity", f"WITH {PX}, s AS (SELECT image, y, sum(p3)/greatest(1,count_if(ref<>0)) AS area FROM px WHERE ref<>255 GROUP BY ALL) SELECT image, y, round(area,6) AS area, CASE WHEN area<0.01 THEN 0 WHEN area<0.05 THEN 1 WHEN area<0.15 THEN 2 WHEN area<0.3 THEN 3 ELSE 4 END AS level FROM s")
def _(spark, sf):
    s = pixels(spark, sf).where("ref <> 255").groupBy("image", "y").agg((F.sum("p3") / F.greatest(F.lit(1), F.count_if(F.col("ref") != 0))).alias("area"))
    level = F.when(F.col("area") < 0.01, 0).when(F.col("area") < 0.05, 1).when(F.col("area") < 0.15, 2).when(F.col("area") < 0.3, 3).otherwise(4)
    return s.select("image", "y", r6(F.col("area"), "area"), level.alias("level"))


@query("agg_glare", f"WITH {PX}, g AS (SELECT image, avg(CASE WHEN v>0.2 THEN v END) AS hi, avg(CASE WHEN v>0.2 THEN v-0.02e0*(x%5) END) AS hi2, avg(CASE WHEN v<=0.2 THEN abs(v) END) AS lo, CAST(count_if(v>0.2) AS DOUBLE) AS n1, CAST(count_if(v-0.02e0*(x%5)>0.2) AS DOUBLE) AS n2 FROM px GROUP BY image) SELECT image, round(1-hi2/hi,6) AS suppression, round(1-n2/n1,6) AS area_reduction, round(lo/hi2,6) AS signal_to_glare FROM g")
def _(spark, sf):
    v, w = F.col("v"), F.col("v") - 0.02 * (F.col("x") % 5)
    g = pixels(spark, sf).groupBy("image").agg(F.avg(F.when(v > 0.2, v)).alias("hi"), F.avg(F.when(v > 0.2, w)).alias("hi2"), F.avg(F.when(v <= 0.2, F.abs(v))).alias("lo"), F.count_if(v > 0.2).alias("n1"), F.count_if(w > 0.2).alias("n2"))
    return rounded(g.select("image", (1 - F.col("hi2") / F.col("hi")).alias("suppression"), (1 - F.col("n2") / F.col("n1")).alias("area_reduction"), (F.col("lo") / F.col("hi2")).alias("signal_to_glare")))


@query("agg_entropy", f"WITH {PX}, b AS (SELECT image, CAST(least(255,greatest(0,floor((v+0.6e0)/1.2e0*256))) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS n FROM px GROUP BY ALL), p AS (SELECT image, n/sum(n) OVER (PARTITION BY image) AS p FROM b) SELECT image, round(-sum(p*log2(p)),6) AS entropy FROM p GROUP BY image")
def _(spark, sf):
    b = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v") + 0.6) / 1.2 * 256))).cast("int")
    n = pixels(spark, sf).groupBy("image", b.alias("bin")).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image")))
    return rounded(p.groupBy("image").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy")))


@query("agg_pair_rmse_psnr", f"WITH {PX}, e AS (SELECT image, sqrt(avg(power(0.02e0*((x*5+y)%7),2))) AS rmse FROM px GROUP BY image) SELECT image, round(rmse,6) AS rmse, round(20*log10(1/rmse),6) AS psnr FROM e")
def _(spark, sf):
    e = pixels(spark, sf).groupBy("image").agg(F.sqrt(F.avg((0.02 * ((F.col("x") * 5 + F.col("y")) % 7)) ** 2)).alias("rmse"))
    return rounded(e.select("image", "rmse", (20 * F.log10(1 / F.col("rmse"))).alias("psnr")))


@query("prj_abstain_conf", f"WITH {PX}, m AS (SELECT image, y, x, greatest(p0,p1,p2,p3) AS top, CASE WHEN p0>=greatest(p1,p2,p3) THEN 0 WHEN p1>=greatest(p2,p3) THEN 1 WHEN p2>=p3 THEN 2 ELSE 3 END AS k FROM px) SELECT image, CASE WHEN top>=0.4 THEN k ELSE -1 END AS label, count(*) AS n FROM m GROUP BY ALL")
def _(spark, sf):
    p = F.array("p0", "p1", "p2", "p3")
    lab = F.when(F.array_max(p) >= 0.4, F.array_position(p, F.array_max(p)).cast("int") - 1).otherwise(-1)
    return pixels(spark, sf).groupBy("image", lab.alias("label")).agg(F.count("*").alias("n"))


@query("prj_abstain_margin", f"WITH {PX}, m AS (SELECT image, list_sort([abs(v+0.1e0),abs(v),abs(v-0.1e0),abs(v-0.2e0)]) AS d FROM px) SELECT image, count_if(d[1]>0.08 OR d[2]-d[1]<0.02) AS abstained, count(*) AS n FROM m GROUP BY image")
def _(spark, sf):
    d = F.sort_array(F.array(*[F.abs(F.col("v") - c) for c in (-0.1, 0.0, 0.1, 0.2)]))
    out = F.count_if((d[0] > 0.08) | (d[1] - d[0] < 0.02))
    return pixels(spark, sf).groupBy("image").agg(out.alias("abstained"), F.count("*").alias("n"))


@query("fn_softmax_entropy", f"WITH {PX}, e AS (SELECT image, exp(-abs(v+0.1e0)/0.05e0) AS a, exp(-abs(v)/0.05e0) AS b, exp(-abs(v-0.1e0)/0.05e0) AS c FROM px), p AS (SELECT image, a/(a+b+c) AS a, b/(a+b+c) AS b, c/(a+b+c) AS c FROM e) SELECT image, round(avg(-(a*ln(a)+b*ln(b)+c*ln(c))/ln(3)),6) AS entropy, round(avg(greatest(a,b,c)),6) AS confidence FROM p GROUP BY image")
def _(spark, sf):
    e = F.transform(F.array(*[F.abs(F.col("v") - c) for c in (-0.1, 0.0, 0.1)]), lambda d: F.exp(-d / 0.05))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    px = pixels(spark, sf).withColumn("e", e).withColumn("t", total).withColumn("p", F.transform("e", lambda x: x / F.col("t")))
    h = -F.aggregate("p", F.lit(0.0), lambda s, x: s + x * F.log(x)) / F.log(F.lit(3.0))
    return rounded(px.groupBy("image").agg(F.avg(h).alias("entropy"), F.avg(F.array_max("p")).alias("confidence")))


@query("fn_disagreement", f"WITH {PX}, q AS (SELECT image, p0,p1,p2,p3, p1 AS q0,p2 AS q1,p3 AS q2,p0 AS q3 FROM px) SELECT image, round(avg(0.5e0*(abs(p0-q0)+abs(p1-q1)+abs(p2-q2)+abs(p3-q3))),6) AS tv, round(avg(-(((p0+q0)/2)*ln((p0+q0)/2)+((p1+q1)/2)*ln((p1+q1)/2)+((p2+q2)/2)*ln((p2+q2)/2)+((p3+q3)/2)*ln((p3+q3)/2)) + (p0*ln(p0)+p1*ln(p1)+p2*ln(p2)+p3*ln(p3))/2 + (q0*ln(q0)+q1*ln(q1)+q2*ln(q2)+q3*ln(q3))/2),6) AS mutual_information FROM q GROUP BY image")
def _(spark, sf):
    p, q = F.array("p0", "p1", "p2", "p3"), F.array("p1", "p2", "p3", "p0")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ent = lambda a: -add(F.transform(a, lambda x: x * F.log(x)))
    mean = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return rounded(pixels(spark, sf).groupBy("image").agg(F.avg(0.5 * add(F.zip_with(p, q, lambda a, b: F.abs(a - b)))).alias("tv"), F.avg(ent(mean) - (ent(p) + ent(q)) / 2).alias("mutual_information")))


@query("fn_sample_summary", f"WITH {PX} SELECT y, x, round(avg(v),6) AS mean, round(var_pop(v),6) AS variance, round(quantile_cont(v,0.05),6) AS lo, round(quantile_cont(v,0.95),6) AS hi, round(1-sqrt(power(avg(cos(2*v)),2)+power(avg(sin(2*v)),2)),6) AS circular FROM px GROUP BY y, x")
def _(spark, sf):
    v = F.col("v")
    return rounded(pixels(spark, sf).groupBy("y", "x").agg(F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.percentile(v, F.lit(0.05)).alias("lo"), F.percentile(v, F.lit(0.95)).alias("hi"), (1 - F.sqrt(F.avg(F.cos(2 * v)) ** 2 + F.avg(F.sin(2 * v)) ** 2)).alias("circular")))


@query("fn_mask_measures", f"WITH {PX}, m AS (SELECT image,y,x FROM px WHERE ref=3), d(dy,dx) AS (VALUES (0,1),(0,-1),(1,0),(-1,0)), s AS (SELECT m.image, count(*) AS sides FROM m, d WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.image=m.image AND n.y=m.y+dy AND n.x=m.x+dx) GROUP BY m.image) SELECT image, count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x)-min(x)+1 AS w, max(y)-min(y)+1 AS h, round(avg(x)+0.5e0,6) AS cx, round(avg(y)+0.5e0,6) AS cy, any_value(sides) AS perimeter FROM m JOIN s USING (image) GROUP BY image")
def _(spark, sf):
    m = pixels(spark, sf).where("ref = 3").select("image", "y", "x")
    g = m.groupBy("image").agg(F.count("*").alias("pixels"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), (F.avg("x") + 0.5).alias("cx"), (F.avg("y") + 0.5).alias("cy"))
    near = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    sides = m.select("image", "y", "x", F.explode(near).alias("d")).select("image", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).join(m, ["image", "y", "x"], "left_anti").groupBy("image").agg(F.count("*").alias("perimeter"))
    return rounded(g.join(sides, "image"))


@query("fn_polygon", f"WITH {ANN}, h AS (SELECT *, CASE WHEN bw>=6 AND bh>=6 THEN 1 ELSE 0 END AS hole FROM ann) SELECT ann, CAST(bw*bh-hole*(bw-4)*(bh-4) AS DOUBLE) AS area, CAST(2*(bw+bh)+hole*2*(bw+bh-8) AS DOUBLE) AS perimeter, CAST(bx AS DOUBLE) AS x0, CAST(bt AS DOUBLE) AS y0, CAST(bx+bw AS DOUBLE) AS x1, CAST(bt+bh AS DOUBLE) AS y1 FROM h")
def _(spark, sf):
    """Boxes of six or more a side have a hole two within their sides."""
    from labelmill.operators.geometry import polygon_measures

    box = lambda n: ring(*[(F.col("bx") + a, F.col("bt") + b) for a, b in ((F.lit(n), F.lit(n)), (F.col("bw") - n, F.lit(n)), (F.col("bw") - n, F.col("bh") - n), (F.lit(n), F.col("bh") - n))])
    holes = F.when((F.col("bw") >= 6) & (F.col("bh") >= 6), F.array(box(2))).otherwise(F.slice(F.array(box(2)), 1, 0))
    a = annotations(spark, sf).select("ann", box(0).alias("outer"), holes.alias("holes"))
    return a.select("ann", *[c.alias(k) for k, c in polygon_measures(F.col("outer"), F.col("holes")).items()])


@query("jn_self_intersect", f"WITH {ANN} SELECT ann, TRUE AS crossed FROM ann WHERE ann%3=0 AND bw>0")
def _(spark, sf):
    from labelmill.operators.geometry import self_intersecting

    return self_intersecting(outlines(annotations(spark, sf)).select("ann", "points"), "ann").select("ann", F.lit(True).alias("crossed"))


# ---------------------------------------------------------------- colours

LIN = lambda c: f"(CASE WHEN {c}/255e0<=0.04045 THEN {c}/255e0/12.92e0 ELSE power(({c}/255e0+0.055e0)/1.055e0,2.4e0) END)"
LABC = f"""{COLOURS}, lin AS (SELECT *, {LIN('r')} AS lr, {LIN('g')} AS lg, {LIN('b')} AS lb FROM col), xyz AS (SELECT *, (0.4124564e0*lr+0.3575761e0*lg+0.1804375e0*lb)/0.95047e0 AS tx, (0.2126729e0*lr+0.7151522e0*lg+0.0721750e0*lb)/1e0 AS ty, (0.0193339e0*lr+0.1191920e0*lg+0.9503041e0*lb)/1.08883e0 AS tz FROM lin),
f3 AS (SELECT *, CASE WHEN tx>216/24389e0 THEN cbrt(tx) ELSE (24389/27e0*tx+16)/116 END AS fx, CASE WHEN ty>216/24389e0 THEN cbrt(ty) ELSE (24389/27e0*ty+16)/116 END AS fy, CASE WHEN tz>216/24389e0 THEN cbrt(tz) ELSE (24389/27e0*tz+16)/116 END AS fz FROM xyz),
lab AS (SELECT ok, ln, r, g, b, label, 116*fy-16 AS ll, 500*(fx-fy) AS aa, 200*(fy-fz) AS bb FROM f3)"""


def labs(spark, sf):
    c = colours(spark, sf)
    lab = K.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return c.select("*", *[v.alias(n) for v, n in zip(lab, ("ll", "aa", "bb"), strict=True)])


@query("fn_rgb_lab", f"WITH {LABC} SELECT ok, ln, round(ll,5) AS l, round(aa,5) AS a, round(bb,5) AS b FROM lab")
def _(spark, sf):
    return labs(spark, sf).select("ok", "ln", F.round("ll", 5).alias("l"), F.round("aa", 5).alias("a"), F.round("bb", 5).alias("b"))


@query("fn_lab_rgb", f"WITH {COLOURS} SELECT ok, ln, r, g, b FROM col")
def _(spark, sf):
    back = K.lab_to_rgb(F.col("ll"), F.col("aa"), F.col("bb"))
    return labs(spark, sf).select("ok", "ln", *[F.round(v).cast("int").alias(n) for v, n in zip(back, "rgb", strict=True)])


@query("fn_hsv_chroma", f"WITH {LABC}, h AS (SELECT *, greatest(r,g,b)/255e0 AS hi, (greatest(r,g,b)-least(r,g,b))/255e0 AS d FROM lab) SELECT ok, ln, round(CASE WHEN hi=0 THEN 0 ELSE d/hi END+1e-9,6) AS s, round(hi,6) AS v, round(sqrt(aa*aa+bb*bb),4) AS chroma FROM h")
def _(spark, sf):
    _, s, v = K.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    return labs(spark, sf).select("ok", "ln", r6(s + 1e-9, "s"), r6(v, "v"), F.round(K.chroma(F.col("aa"), F.col("bb")), 4).alias("chroma"))


@query("fn_parse_rgb", f"WITH {COLOURS} SELECT ok, ln, CASE WHEN ln=7 THEN NULL WHEN ln=6 THEN NULL ELSE [r,g,b] END AS rgb FROM col")
def _(spark, sf):
    text = F.when(F.col("ln") == 7, " ").when(F.col("ln") == 6, "1,2,300").otherwise(F.concat_ws(" ,\n", "r", "g", "b"))
    from labelmill.functions.text import parse_rgb

    return colours(spark, sf).select("ok", "ln", parse_rgb(text).alias("rgb"))


@query("fn_delta_e", f"WITH {LABC} SELECT ok, ln, round(sqrt(power(ll-50,2)+power(aa-10,2)+power(bb+20,2)),4) AS de76 FROM lab")
def _(spark, sf):
    p = (F.col("ll"), F.col("aa"), F.col("bb"))
    return labs(spark, sf).select("ok", "ln", F.round(K.delta_e76(p, (F.lit(50.0), F.lit(10.0), F.lit(-20.0))), 4).alias("de76"))


@query("fn_ciede2000")
def _(spark, sf):
    """CIEDE2000 against a fixed colour; held against published pairs in tests."""
    p = (F.col("ll"), F.col("aa"), F.col("bb"))
    return labs(spark, sf).select("ok", "ln", F.round(K.ciede2000(p, (F.lit(50.0), F.lit(10.0), F.lit(-20.0))), 4).alias("de00"))


@query("agg_prototypes", f"WITH {LABC} SELECT label, round(avg(ll),5) AS l, round(avg(aa),5) AS a, round(avg(bb),5) AS b, count(*) AS n FROM lab WHERE ok%5<>0 GROUP BY label")
def _(spark, sf):
    g = labs(spark, sf).where("ok % 5 <> 0").groupBy("label").agg(F.avg("ll").alias("l"), F.avg("aa").alias("a"), F.avg("bb").alias("b"), F.count("*").alias("n"))
    return g.select("label", *[F.round(c, 5).alias(c) for c in "lab"], "n")


PROTO = "pr AS (SELECT label AS proto, avg(r) AS pr_, avg(g) AS pg, avg(b) AS pb FROM col WHERE ok%5<>0 GROUP BY label), dc AS (SELECT DISTINCT r, g, b FROM col), ds AS (SELECT r, g, b, proto, round(sqrt(power(r-pr_,2)+power(g-pg,2)+power(b-pb,2)),9) AS d FROM dc, pr), nn AS (SELECT r, g, b, arg_min(proto, struct_pack(d:=d, p:=proto)) AS near, min(d) AS d FROM ds GROUP BY r, g, b)"


def nearest(spark, sf):
    """Each distinct colour is scored once, however many observations have it."""
    c = colours(spark, sf)
    protos = c.where("ok % 5 <> 0").groupBy(F.col("label").alias("proto")).agg(F.avg("r").alias("pr"), F.avg("g").alias("pg"), F.avg("b").alias("pb"))
    d = K.delta_e76((F.col("r"), F.col("g"), F.col("b")), (F.col("pr"), F.col("pg"), F.col("pb")))
    return L.nearest_prototype(c.select("r", "g", "b").distinct(), protos, d, ["r", "g", "b"])


@query("jn_nearest_proto", f"WITH {COLOURS}, {PROTO} SELECT r, g, b, near AS label, round(d,4) AS distance FROM nn")
def _(spark, sf):
    return nearest(spark, sf).select("r", "g", "b", "label", F.round("distance", 4).alias("distance"))


@query("agg_crosstab", f"WITH {COLOURS}, {PROTO} SELECT label, near, count(*) AS n FROM col JOIN nn USING (r, g, b) GROUP BY ALL")
def _(spark, sf):
    near = nearest(spark, sf).select("r", "g", "b", F.col("label").alias("near"))
    return colours(spark, sf).join(near, ["r", "g", "b"]).groupBy("label", "near").agg(F.count("*").alias("n"))


@query("agg_gamut_outliers", f"WITH {COLOURS} SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS outliers FROM col GROUP BY label")
def _(spark, sf):
    c = labs(spark, sf)
    back = K.lab_to_rgb(F.col("ll"), F.col("aa"), F.col("bb"))
    c = c.withColumns({n: F.round(v) for n, v in zip(("r2", "g2", "b2"), back, strict=True)})
    c = c.withColumns(dict(zip(("l2", "a2", "bb2"), K.rgb_to_lab(F.col("r2"), F.col("g2"), F.col("b2")), strict=True)))
    de = K.ciede2000((F.col("ll"), F.col("aa"), F.col("bb")), (F.col("l2"), F.col("a2"), F.col("bb2")))
    return c.withColumn("de", de).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("de") > 2).alias("outliers"))


@query("agg_dup_conflict", f"WITH {COLOURS}, g AS (SELECT r, g, count(*) AS n, count(DISTINCT label) AS labels FROM col GROUP BY r, g HAVING count(*)>1) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, count_if(labels>1) AS conflicting FROM g")
def _(spark, sf):
    return T.duplicate_conflicts(colours(spark, sf), ["r", "g"], "label")


@query("flt_valid_rows", f"WITH {COLOURS} SELECT coalesce(CASE WHEN ln=7 THEN 'missing' WHEN label='R' THEN 'ignored' WHEN label='A' AND ok%9=0 THEN 'unknown_label' WHEN r>240 THEN 'out_of_range' END,'valid') AS reason, count(*) AS n FROM col GROUP BY 1")
def _(spark, sf):
    c = colours(spark, sf).withColumn("name", F.when(F.col("ln") == 7, None).when((F.col("label") == "A") & (F.col("ok") % 9 == 0), "X").otherwise(F.col("label")))
    v = T.valid_rows(c, F.col("name"), "R", ["A", "N"], {"r": (0, 240)})
    return v.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("agg_separability", f"WITH {COLOURS}, s AS (SELECT label, r//32 AS r, g//32 AS g, b//32 AS b, CAST(count(*) AS DOUBLE) AS n FROM col GROUP BY ALL), p AS (SELECT x.label, y.label AS other, CASE WHEN x.label=y.label AND x.r=y.r AND x.g=y.g AND x.b=y.b THEN x.n*(x.n-1) ELSE x.n*y.n END AS w, 32*sqrt(power(x.r-y.r,2)+power(x.g-y.g,2)+power(x.b-y.b,2)) AS d FROM s x, s y) SELECT round(sum(CASE WHEN label=other THEN w*d END)/sum(CASE WHEN label=other THEN w END),6) AS intra, round(sum(CASE WHEN label<>other THEN w*d END)/sum(CASE WHEN label<>other THEN w END),6) AS inter FROM p")
def _(spark, sf):
    """Mean distance within and between classes, over colours quantised to eight levels a channel (at most 512 cells a class)."""
    s = colours(spark, sf).groupBy("label", *[F.floor(F.col(c) / 32).alias(c) for c in "rgb"]).agg(F.count("*").cast("double").alias("n"))
    o = s.select(F.col("label").alias("other"), *[F.col(c).alias(f"{c}2") for c in "rgbn"])
    p = s.crossJoin(o)  # cells, not observations
    d = 32 * K.delta_e76(tuple(F.col(c) for c in "rgb"), tuple(F.col(f"{c}2") for c in "rgb"))
    same = F.col("label") == F.col("other")
    w = F.when(same & (d == 0), F.col("n") * (F.col("n") - 1)).otherwise(F.col("n") * F.col("n2"))
    mean = lambda c: F.sum(F.when(c, w * d)) / F.sum(F.when(c, w))
    return rounded(p.agg(mean(same).alias("intra"), mean(~same).alias("inter")))


@query("agg_nearest_agreement")
def _(spark, sf):
    """Leave-one-out agreement with the nearest colour by CIEDE2000; SQL would measure all pairs, so tests hold it against brute force."""
    from labelmill.operators.colours import nearest_agreement

    return rounded(nearest_agreement(colours(spark, sf), "label"))


@query("agg_scaler", f"WITH {COLOURS}, s AS (SELECT avg(r) AS m, stddev_pop(r) AS d FROM col WHERE ok%5<>0) SELECT ok, ln, round((r-m)/d,6) AS r FROM col, s WHERE ok%5=0")
def _(spark, sf):
    c = colours(spark, sf)
    return rounded(T.apply_scaler(c.where("ok % 5 = 0"), T.fit_scaler(c, ["r"], F.col("ok") % 5 != 0), ["r"]).select("ok", "ln", "r"))


@query("agg_class_weights", f"WITH {COLOURS}, n AS (SELECT label, count(*) AS n FROM col GROUP BY label), w AS (SELECT label, n, sum(n) OVER ()/(count(*) OVER ()*CAST(n AS DOUBLE)) AS raw FROM n) SELECT label, n, round(raw/avg(raw) OVER (),6) AS weight FROM w")
def _(spark, sf):
    return rounded(T.class_weights(colours(spark, sf), "label"))


@query("win_white_balance", f"""WITH {COLOURS}, m AS (SELECT label, avg(r)+1e-6 AS mr, avg(g)+1e-6 AS mg, avg(b)+1e-6 AS mb, quantile_cont(r,0.99)+1e-6 AS pr, quantile_cont(g,0.99)+1e-6 AS pg, quantile_cont(b,0.99)+1e-6 AS pb FROM col GROUP BY label),
v AS (SELECT ok, ln, r*((mr+mg+mb)/3/mr) AS r, g*((mr+mg+mb)/3/mg) AS g, b*((mr+mg+mb)/3/mb) AS b, r*(255/pr) AS white_r, g*(255/pg) AS white_g, b*(255/pb) AS white_b FROM col JOIN m USING (label))
SELECT ok, ln, {", ".join(f"CAST(floor(least(255,greatest(0,{c}))+1e-9) AS INTEGER) AS {c}" for c in ("r", "g", "b", "white_r", "white_g", "white_b"))} FROM v""")
def _(spark, sf):
    """All three channels of an observation side by side: r, g, b by the means of its image (label), white_* by the 99th percentiles."""
    c = colours(spark, sf)
    grey = L.white_balanced(c.withColumns({f"white_{x}": F.col(x) for x in "rgb"}), "label", ("r", "g", "b"), "gray_world")
    return L.white_balanced(grey, "label", ("white_r", "white_g", "white_b"), "white_patch").select("ok", "ln", "r", "g", "b", "white_r", "white_g", "white_b")


@query("win_white_balance_rgb", f"""WITH {COLOURS}, m AS (SELECT label, avg(r)+1e-6 AS mr, avg(g)+1e-6 AS mg, avg(b)+1e-6 AS mb, quantile_cont(r,0.99)+1e-6 AS pr, quantile_cont(g,0.99)+1e-6 AS pg, quantile_cont(b,0.99)+1e-6 AS pb FROM col GROUP BY label),
v AS (SELECT ok, ln, 'gray_world' AS method, r*((mr+mg+mb)/3/mr) AS r, g*((mr+mg+mb)/3/mg) AS g, b*((mr+mg+mb)/3/mb) AS b FROM col JOIN m USING (label) UNION ALL SELECT ok, ln, 'white_patch', r*(255/pr), g*(255/pg), b*(255/pb) FROM col JOIN m USING (label))
SELECT ok, ln, method, CAST(floor(least(255,greatest(0,r))+1e-9) AS INTEGER) AS r, CAST(floor(least(255,greatest(0,g))+1e-9) AS INTEGER) AS g, CAST(floor(least(255,greatest(0,b))+1e-9) AS INTEGER) AS b FROM v""")
def _(spark, sf):
    """All three channels, by the mean of the image (label) and by the 99th percentile of each channel."""
    c = colours(spark, sf)
    out = [L.white_balanced(c, "label", ("r", "g", "b"), method).select("ok", "ln", F.lit(method).alias("method"), "r", "g", "b") for method in ("gray_world", "white_patch")]
    return out[0].union(out[1])


NOISE = "(CAST('0x'||substr(md5('{i} '||ok||' '||ln),1,8) AS BIGINT)+0.5e0)/4294967296"


@query("fn_perturb", f"""WITH {COLOURS}, p AS (SELECT *, ok%100 AS x, ln*10 AS y, {NOISE.format(i=1)} AS u, {NOISE.format(i=2)} AS w FROM col), v AS (SELECT ok, ln, 'brightness' AS kind, r*1.25e0 AS r, g*1.25e0 AS g, b*1.25e0 AS b FROM p UNION ALL SELECT ok, ln, 'dark', r*0.75e0, g*0.75e0, b*0.75e0 FROM p UNION ALL SELECT ok, ln, 'white_balance', r*1.08e0, g*1e0, b*0.9e0 FROM p
UNION ALL SELECT ok, ln, 'gamma', 255*power(r/255e0,1.3e0), 255*power(g/255e0,1.3e0), 255*power(b/255e0,1.3e0) FROM p UNION ALL SELECT ok, ln, 'shadow', r*k, g*k, b*k FROM (SELECT *, 0.6e0+0.4e0*x/99e0 AS k FROM p) UNION ALL SELECT ok, ln, 'specular', r+k, g+k, b+k FROM (SELECT *, 120*exp(-(power(y-80/3e0,2)+power(x-100/3e0,2))/128e0) AS k FROM p) UNION ALL SELECT ok, ln, 'noise', r+k, g+k, b+k FROM (SELECT *, 6*sqrt(-2*ln(u))*cos(2*pi()*w) AS k FROM p))
SELECT ok, ln, kind, CAST(floor(least(255,greatest(0,r+1e-9))) AS INTEGER) AS r, CAST(floor(least(255,greatest(0,g+1e-9))) AS INTEGER) AS g, CAST(floor(least(255,greatest(0,b+1e-9))) AS INTEGER) AS b FROM v""")
def _(spark, sf):
    """Seven changes of a picture; observations stand on a picture of 100 x 80, noise is normal by hashes of the id."""
    c = colours(spark, sf).withColumns({"x": F.col("ok") % 100, "y": F.col("ln") * 10})
    kinds = K.perturbation_kinds(F.col("x"), F.col("y"), 100, 80, F.concat_ws(" ", "ok", "ln"))
    c = c.select("ok", "ln", "r", "g", "b", F.explode(kinds).alias("k")).select("ok", "ln", "r", "g", "b", "k.*")
    clipped = lambda v: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v + 1e-9))).cast("int")
    return c.select("ok", "ln", "kind", *[clipped(K.perturbed(F.col(n), F.col("kind"), F.col(f"f{n}"), F.col("plus"))).alias(n) for n in "rgb"])


@query("set_union_protos", f"WITH {COLOURS}, p AS (SELECT label, avg(r) AS r FROM col GROUP BY label UNION ALL SELECT label, min(r) FROM col GROUP BY label UNION ALL SELECT label, NULL FROM col GROUP BY label) SELECT label, round(r,6) AS r FROM p WHERE r IS NOT NULL")
def _(spark, sf):
    g = colours(spark, sf).groupBy("label").agg(F.avg("r").alias("mean"), F.min("r").cast("double").alias("rep"), F.lit(None).cast("double").alias("extra"))
    return rounded(g.select("label", F.explode(F.array("mean", "rep", "extra")).alias("r")).where("r is not null"))


@query("set_names_equal", f"WITH {COLOURS}, a AS (SELECT DISTINCT label FROM col WHERE ok%2=0), b AS (SELECT DISTINCT label FROM col WHERE ok%2=1 AND label<>'R') SELECT count(*) AS differing FROM ((SELECT label FROM a EXCEPT SELECT label FROM b) UNION ALL (SELECT label FROM b EXCEPT SELECT label FROM a))")
def _(spark, sf):
    c = colours(spark, sf)
    a, b = c.where("ok % 2 = 0").select("label").distinct(), c.where("ok % 2 = 1 and label <> 'R'").select("label").distinct()
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("differing"))


# ---------------------------------------------------------------- polarization

STACK = "st AS (SELECT vec_id, label, run, " + ", ".join(f"CAST(embedding[8*run+{i + 1}] AS DOUBLE)+1 AS i{i}" for i in range(8)) + " FROM (SELECT vec_id, label, embedding, CAST(unnest(range(len(embedding)//8)) AS INTEGER) AS run FROM embeddings))"


def stack(spark, sf):
    """Eight analyzer angles (0, 22.5, ...) from each run of eight components, shifted to be positive."""
    runs = F.filter(F.sequence(F.lit(0), F.floor(F.size("embedding") / 8).cast("int")), lambda k: 8 * k + 8 <= F.size("embedding"))
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.explode(runs).alias("run"))
    return e.select("vec_id", "label", "run", *[(F.get("embedding", 8 * F.col("run") + i).cast("double") + 1).alias(f"i{i}") for i in range(8)])


ST4 = f"WITH {STACK}, s AS (SELECT vec_id, label, run, (i0+i2+i4+i6)/2 AS s0, i0-i4 AS s1, i2-i6 AS s2 FROM st)"


def four(spark, sf):
    s = P.stokes_four(*[F.col(f"i{i}") for i in (0, 2, 4, 6)])
    return stack(spark, sf).select("*", *[c.alias(f"s{k}") for k, c in enumerate(s)])


@query("fn_stokes", ST4 + ", f AS (SELECT vec_id, run, s0, s1, s2, " + ", ".join(f"{n} AS {a}" for n, a in (("2*(" + "+".join(f"i{i}" for i in range(8)) + ")/8", "f0"), ("2*(" + "+".join(f"i{i}*cos(radians({i * 45}e0))" for i in range(8)) + ")/4", "f1"), ("2*(" + "+".join(f"i{i}*sin(radians({i * 45}e0))" for i in range(8)) + ")/4", "f2"))) + " FROM s JOIN st USING (vec_id, label, run)) SELECT vec_id, run, round(s0,6) AS s0, round(s1,6) AS s1, round(s2,6) AS s2, round(f0,6) AS f0, round(f1,6) AS f1, round(f2,6) AS f2 FROM f")
def _(spark, sf):
    fit = P.stokes_fit([F.col(f"i{i}") for i in range(8)], [22.5 * i for i in range(8)])
    return rounded(four(spark, sf).select("vec_id", "run", "s0", "s1", "s2", *[c.alias(f"f{k}") for k, c in enumerate(fit)]))


@query("fn_dolp_aolp", ST4 + " SELECT vec_id, run, round(least(1,greatest(0,sqrt(s1*s1+s2*s2)/greatest(s0,1e-8))),6) AS dolp, round(0.5e0*atan2(s2,s1),6) AS aolp, s1*s1+s2*s2<=s0*s0 AS physical FROM s")
def _(spark, sf):
    s0, s1, s2 = (F.col(f"s{k}") for k in range(3))
    return four(spark, sf).select("vec_id", "run", r6(P.dolp(s0, s1, s2), "dolp"), r6(P.aolp(s1, s2), "aolp"), (s1 * s1 + s2 * s2 <= s0 * s0).alias("physical"))


@query("fn_analyzer", ST4 + " SELECT vec_id, run, CAST(a AS INTEGER) AS angle, round(0.5e0*((0.9e0+0.01e0)*s0+(0.9e0-0.01e0)*(s1*cos(2*radians(a))+s2*sin(2*radians(a)))),6) AS i FROM s, range(0,180,45) t(a)")
def _(spark, sf):
    s = four(spark, sf).withColumn("angle", F.explode(F.array(*[F.lit(a) for a in (0, 45, 90, 135)])))
    return rounded(s.select("vec_id", "run", "angle", P.analyzer(F.col("s0"), F.col("s1"), F.col("s2"), F.col("angle").cast("double"), 0.9, 0.01).alias("i")))


@query("fn_dark_flat", f"WITH {STACK}, fl AS (SELECT label, avg(i1) AS flat FROM st GROUP BY label), m AS (SELECT avg(flat) AS m FROM fl) SELECT vec_id, run, round(greatest(0,(i0-0.1e0)/greatest(0.2e0,flat/m)),6) AS i FROM st JOIN fl USING (label), m")
def _(spark, sf):
    s = stack(spark, sf)
    flat = s.groupBy("label").agg(F.avg("i1").alias("flat"))
    m = flat.agg(F.avg("flat").alias("m"))
    return rounded(s.join(flat, "label").crossJoin(F.broadcast(m)).select("vec_id", "run", F.greatest(F.lit(0.0), (F.col("i0") - 0.1) / F.greatest(F.lit(0.2), F.col("flat") / F.col("m"))).alias("i")))


HARM = ", ".join(f"({'+'.join(f'i{i}*{f}(radians({2 * k * 22.5 * i}e0))' for i in range(8))})/4 AS {f[0]}{k}" for k in (1, 2) for f in ("cos", "sin"))


@query("fn_psrf", f"WITH {STACK}, h AS (SELECT vec_id, run, (" + "+".join(f"i{i}" for i in range(8)) + f")/8 AS c0, {HARM} FROM st) SELECT vec_id, run, round(sqrt(c1*c1+s1*s1)/c0,6) AS dolp, round((c2*c2+s2*s2)/(c1*c1+s1*s1+c2*c2+s2*s2),6) AS order2_energy FROM h")
def _(spark, sf):
    c0, c1, s1, c2, s2 = P.fit([F.col(f"i{i}") for i in range(8)], P.harmonic_weights([22.5 * i for i in range(8)], 2))
    e1, e2 = c1 * c1 + s1 * s1, c2 * c2 + s2 * s2
    return rounded(stack(spark, sf).select("vec_id", "run", (F.sqrt(e1) / c0).alias("dolp"), (e2 / (e1 + e2)).alias("order2_energy")))


@query("top_psrf_order")
def _(spark, sf):
    """Order 1 or 2 by the error at held-out angles after fitting the others."""
    odd, even = (1, 3, 5, 7), (0, 2, 4, 6)
    rows = stack(spark, sf)
    import math

    errs = []
    for order, fit_on, test_on in ((1, odd, even), (2, (*odd, 0), (2, 4, 6))):
        c = P.fit([F.col(f"i{i}") for i in fit_on], P.harmonic_weights([22.5 * i for i in fit_on], order))
        guess = lambda i: c[0] + sum((c[2 * k - 1] * math.cos(2 * k * math.radians(22.5 * i)) + c[2 * k] * math.sin(2 * k * math.radians(22.5 * i)) for k in range(1, order + 1)), F.lit(0.0))  # noqa: B023, E731
        errs.append(F.sqrt(sum(((F.col(f"i{i}") - guess(i)) ** 2 for i in test_on), F.lit(0.0)) / len(test_on)))
    return rounded(rows.select("vec_id", "run", errs[0].alias("rmse1"), errs[1].alias("rmse2"), F.when(errs[0] <= errs[1], 1).otherwise(2).alias("best")))


@query("agg_polar_agreement", ST4 + ", q AS (SELECT a.label, a.s0, b.s0 AS t0, least(1,sqrt(a.s1*a.s1+a.s2*a.s2)/a.s0) AS d, least(1,sqrt(b.s1*b.s1+b.s2*b.s2)/b.s0) AS e, 0.5e0*atan2(a.s2,a.s1) AS u, 0.5e0*atan2(b.s2,b.s1) AS w FROM s a JOIN s b ON b.vec_id=a.vec_id+1 AND b.run=a.run) SELECT label, round(avg(abs(s0-t0)/t0),6) AS s0_error, round(avg(abs(d-e)),6) AS dolp_mae, round(sqrt(avg((d-e)*(d-e))),6) AS dolp_rmse, round(sum(e*least(abs(u-w)%pi(),pi()-abs(u-w)%pi()))/sum(e),6) AS aolp_error FROM q GROUP BY label")
def _(spark, sf):
    s0, s1, s2 = (F.col(f"s{k}") for k in range(3))
    f = four(spark, sf).select("vec_id", "run", "label", "s0", P.dolp(s0, s1, s2).alias("d"), P.aolp(s1, s2).alias("u"))
    j = f.join(f.select((F.col("vec_id") - 1).alias("vec_id"), "run", F.col("s0").alias("t0"), F.col("d").alias("e"), F.col("u").alias("w")), ["vec_id", "run"])
    return rounded(j.groupBy("label").agg(F.avg(F.abs(F.col("s0") - F.col("t0")) / F.col("t0")).alias("s0_error"), F.avg(F.abs(F.col("d") - F.col("e"))).alias("dolp_mae"), F.sqrt(F.avg((F.col("d") - F.col("e")) ** 2)).alias("dolp_rmse"), ratio(F.sum(F.col("e") * P.aolp_gap(F.col("u"), F.col("w"))), F.sum("e")).alias("aolp_error")))


TERMS = f"WITH {STACK}, l AS (SELECT vec_id, label, CAST(unnest(range(8)) AS INTEGER) AS a, unnest([i0,i1,i2,i3,i4,i5,i6,i7]) AS i FROM st), t AS (SELECT label, a, abs(avg(CASE WHEN vec_id%2=0 THEN i END)-avg(CASE WHEN vec_id%2=1 THEN i END))/(stddev_pop(CASE WHEN vec_id%2=0 THEN i END)+stddev_pop(CASE WHEN vec_id%2=1 THEN i END)) AS contrast, avg(CASE WHEN i>1.2 THEN i*i ELSE 0 END) AS glare FROM l GROUP BY ALL)"


def angle_terms(spark, sf):
    l = stack(spark, sf).select("vec_id", "label", F.posexplode(F.array(*[f"i{i}" for i in range(8)])).alias("a", "i"))  # noqa: E741
    on, off, i = F.col("vec_id") % 2 == 0, F.col("vec_id") % 2 == 1, F.col("i")
    return l.groupBy("label", "a").agg((F.abs(F.avg(F.when(on, i)) - F.avg(F.when(off, i))) / (F.stddev_pop(F.when(on, i)) + F.stddev_pop(F.when(off, i)))).alias("contrast"), F.avg(F.when(i > 1.2, i * i).otherwise(0.0)).alias("glare"))


@query("agg_angle_terms", TERMS + " SELECT label, a, round(contrast,6) AS contrast, round(glare,6) AS glare FROM t")
def _(spark, sf):
    return rounded(angle_terms(spark, sf))


MM = "(CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-12 THEN 0 ELSE ({c}-min({c}) OVER w)/(max({c}) OVER w-min({c}) OVER w) END)"


@query("win_minmax", TERMS + f", j AS (SELECT label, a, {MM.format(c='contrast')} - 0.5e0*{MM.format(c='glare')} AS j FROM t WINDOW w AS (PARTITION BY label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(j,9) DESC, a) AS rk FROM j) SELECT label, a AS best_angle, round(j,6) AS j FROM r WHERE rk=1")
def _(spark, sf):
    w = Window.partitionBy("label")
    mm = lambda c: F.when(F.max(c).over(w) - F.min(c).over(w) < 1e-12, 0.0).otherwise((F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w)))
    j = angle_terms(spark, sf).select("label", "a", (mm("contrast") - 0.5 * mm("glare")).alias("j"))
    r = j.withColumn("rk", F.row_number().over(w.orderBy(F.desc(F.round("j", 9)), "a"))).where("rk = 1")
    return rounded(r.select("label", F.col("a").alias("best_angle"), "j"))

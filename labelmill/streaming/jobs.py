"""Audit and result streams. Each job is a function of a DataFrame, streaming or not; run_once drives a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of an audit event.
AUDIT = "timestamp string, actor string, action string, imageId string, annotationId string, details string"


def read_audit(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """JSON-lines audit events; blank and torn lines are skipped."""
    r = (spark.readStream if stream else spark.read).schema(AUDIT).option("mode", "DROPMALFORMED")
    e = r.json(path).where("action is not null")
    return e.withColumn("ts", F.to_timestamp("timestamp")).withColumn("actor_kind", F.split("actor", ":")[0])


def audit_counts(events: DataFrame, ts: str, kind: str, action: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, kind, action, n) per tumbling or sliding window; later events than `late` are dropped from a stream."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    e = events.withWatermark(ts, late)
    return e.groupBy(w.alias("w"), F.col(kind).alias("kind"), F.col(action).alias("action")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "action", "n")


def effort_sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, seconds, interactions): sessions end after a gap."""
    e = events.withWatermark(ts, late)
    g = e.groupBy(F.session_window(ts, gap).alias("s"), F.col(user).alias("user")).agg(F.count("*").alias("interactions"), F.max(ts).alias("last"))
    return g.select("user", F.col("s.start").alias("start"), (F.unix_micros("last") - F.unix_micros("s.start")).alias("micros"), "interactions")


def confusion_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("ref", "pred").agg(F.count("*").alias("n"))


def first_hashes(docs: DataFrame, ts: str, text: str, late: str = "1 hour") -> DataFrame:
    """Rows whose content is new within the watermark."""
    return docs.withColumn("hash", F.sha2(text, 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["hash"])


def job_rounds(rows: DataFrame, wanted: int) -> DataFrame:
    """(job, generated, valid, shortfall, alert)."""
    g = rows.groupBy("job").agg(F.count("*").alias("generated"), F.count_if("valid").alias("valid"))
    short = F.greatest(F.lit(0).cast("long"), F.lit(wanted).cast("long") - F.col("valid"))
    return g.select("job", "generated", "valid", short.alias("shortfall"), (F.col("valid") / F.col("generated") < 0.2).alias("alert"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Writes all that a stream has now and returns it. append: Parquet files; otherwise each batch replaces the table."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        q = w.format("parquet").start(path)
    else:
        q = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_new(batch: DataFrame, catalog: str) -> None:
    """foreachBatch body for all-time uniqueness: only hashes that the catalog lacks are appended to it."""
    spark = batch.sparkSession
    new = batch.dropDuplicates(["hash"])
    try:
        new = new.join(spark.read.parquet(catalog).select("hash"), "hash", "left_anti")
    except Exception as e:  # the catalog is made by the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(catalog)

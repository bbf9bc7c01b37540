"""The streaming jobs driven to their end over files, against the same jobs in batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelmill.streaming import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The events as several files, so that a stream has more than one batch."""
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(4, "ts").write.mode("overwrite").parquet(path)
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_window_counts(events, tmp_path):
    batch, stream = events
    job = lambda d: J.audit_counts(d, "ts", "event_type", "event_type", late="40 days")
    got = J.run_once(job(stream), str(tmp_path / "o"), str(tmp_path / "c"), "complete")
    assert rows(got) == rows(job(batch)) and got.count() > 0
    slid = J.audit_counts(batch, "ts", "event_type", "event_type", "2 hours", "1 hour")
    assert slid.agg(F.sum("n")).first()[0] == 2 * batch.count()


def test_sessions(events, tmp_path):
    batch, stream = events
    job = lambda d: J.effort_sessions(d, "ts", "user_id", late="40 days")
    got = J.run_once(job(stream), str(tmp_path / "o"), str(tmp_path / "c"), "complete")
    assert rows(got) == rows(job(batch))


def test_confusion_and_rounds(events, tmp_path):
    batch, stream = events
    pairs = lambda d: J.confusion_counts(d.select(F.col("event_type").alias("ref"), (F.col("user_id") % 3).alias("pred")))
    assert rows(J.run_once(pairs(stream), str(tmp_path / "o"), str(tmp_path / "c"), "complete")) == rows(pairs(batch))
    rounds = lambda d: J.job_rounds(d.select(F.col("user_id").alias("job"), (F.col("event_type") == "click").alias("valid")), 3)
    assert rows(J.run_once(rounds(stream), str(tmp_path / "o2"), str(tmp_path / "c2"), "complete")) == rows(rounds(batch))


def test_first_hashes(events, tmp_path):
    batch, stream = events
    got = J.run_once(J.first_hashes(stream, "ts", "props", "40 days").select("hash"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert rows(got) == rows(batch.select(F.sha2("props", 256)).distinct())
    catalog = str(tmp_path / "catalog")
    for k in (0, 1, 0):
        J.append_new(batch.where(F.col("event_id") % 2 == k).select(F.sha2("props", 256).alias("hash")), catalog)
    assert rows(batch.sparkSession.read.parquet(catalog)) == rows(batch.select(F.sha2("props", 256)).distinct())


def test_audit_skips_torn_lines(spark, tmp_path):
    src = tmp_path / "audit"
    src.mkdir()
    (src / "a.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00+02:00","actor":"user:1","action":"edit"}\n\n{"timestamp":"2024-01\n{"timestamp":"2024-01-01T01:00:00Z","actor":"system","action":"save"}\n')
    got = J.run_once(J.read_audit(spark, str(src)), str(tmp_path / "o"), str(tmp_path / "c")).withColumn("t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).orderBy("action").collect()
    assert [(r.actor_kind, r.action, r.t) for r in got] == [("user", "edit", "2023-12-31T22:00:00"), ("system", "save", "2024-01-01T01:00:00")]

"""Nearest colours against all pairs, and sources that go through files and a database."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.functions import color as K


def all_pairs(spark, points):
    """Each point's nearest others by measuring every pair with the column expression."""
    p, q = (points.select(*[F.col(c).alias(f"{k}{c}") for c in ("id", "l", "a", "b")]) for k in "pq")
    d = K.ciede2000(tuple(F.col(f"p{c}") for c in "lab"), tuple(F.col(f"q{c}") for c in "lab")).alias("d")
    rows = p.join(q, F.col("pid") < F.col("qid")).select("pid", "qid", d).toPandas()
    best = {}
    for a, b, d in zip(rows.pid, rows.qid, rows.d.round(9), strict=True):
        for x, y in ((a, b), (b, a)):
            had = best.setdefault(x, (math.inf, set()))
            if d < had[0]:
                best[x] = (d, {y})
            elif d == had[0]:
                had[1].add(y)
    return best


def points_of(spark, ids):
    rgb = [F.shiftright("id", 16), F.shiftright("id", 8).bitwiseAND(255), F.col("id").bitwiseAND(255)]
    return spark.createDataFrame([(int(i),) for i in ids], "id int").select("id", *[v.alias(c) for v, c in zip(K.rgb_to_lab(*rgb), "lab", strict=True)])


@pytest.mark.parametrize("kind", ["spread", "blue", "grey", "far"])
def test_nearest_colours_equal_all_pairs(spark, kind):
    from labelmill.operators.colours import nearest_colours

    rng = np.random.default_rng(7)
    if kind == "spread":
        ids = rng.integers(0, 1 << 24, 200)
    elif kind == "blue":  # where the rotation term acts
        ids = rng.integers(0, 90, 200) * 65536 + rng.integers(0, 90, 200) * 256 + rng.integers(180, 256, 200)
    elif kind == "grey":
        ids = np.concatenate([np.arange(0, 256, 3) * 65793, rng.integers(0, 256, 100) * 65793 + rng.integers(-2, 3, 100).clip(0)])
    else:  # a few colours at the ends, one of them alone
        ids = np.array([0, 0xFFFFFF, 0x0000FF, 0x0000FE, 0x00FF00, 0xFF0000, 0xFF0001])
    points = points_of(spark, sorted(set(map(int, ids))))
    want = all_pairs(spark, points)
    for full in (2, 16):
        got = {}
        for r in nearest_colours(points, full).collect():
            d, near = got.setdefault(r.id, (r.distance, set()))
            assert abs(d - r.distance) < 2e-9 and r.near not in near
            near.add(r.near)
        assert {i: near for i, (_, near) in got.items()} == {i: near for i, (_, near) in want.items()}
        assert all(abs(got[i][0] - want[i][0]) < 2e-9 for i in want)


def test_nearest_colours_of_none_and_one(spark):
    from labelmill.operators.colours import nearest_agreement, nearest_colours

    assert nearest_colours(points_of(spark, [])).count() == 0 and nearest_colours(points_of(spark, [5])).count() == 0
    schema = "r int, g int, b int, label string"
    assert nearest_agreement(spark.createDataFrame([], schema), "label").count() == 0
    rows = [(1, 2, 3, "x")] * 2 + [(1, 2, 3, "y"), (200, 0, 0, "x"), (201, 0, 0, "y"), (0, 200, 0, "x"), (0, 201, 0, "x"), (None, 1, 1, "x"), (9, 9, 9, None)]
    got = {r.label: (r.n, round(r.agreement, 9)) for r in nearest_agreement(spark.createDataFrame(rows, schema), "label").collect()}
    assert got == {"x": (5, round((0.5 * 2 + 0 + 1 + 1) / 5, 9)), "y": (2, 0.0)}


def test_nearest_agreement_of_the_table(spark):
    """The registered query on sf0.001 against all pairs of its distinct colours."""
    from labelmill.operators.colours import nearest_agreement
    from labelmill.plans.data import colours

    o = colours(spark, "/root/testdata/sf0.001").where("ok % 16 = 1")  # a fixture of the table, so that all pairs stay small
    rows = [(r.r * 65536 + r.g * 256 + r.b, r.label) for r in o.collect()]
    near = all_pairs(spark, points_of(spark, sorted({i for i, _ in rows})))
    of = {}
    for i, label in rows:
        of.setdefault(i, []).append(label)
    hit, n = {}, {}
    for i, label in rows:
        others = [x for j in near[i][1] for x in of[j]]
        if len(of[i]) > 1:
            others = list(of[i])
            others.remove(label)
        hit[label] = hit.get(label, 0) + others.count(label) / len(others)
        n[label] = n.get(label, 0) + 1
    got = {r.label: (r.n, round(r.agreement, 9)) for r in nearest_agreement(o, "label").collect()}
    assert got == {k: (n[k], round(hit[k] / n[k], 9)) for k in n}


def test_bitmaps_round_trip(spark, tmp_path):
    from labelmill.sources.exports import bmp, write_files
    from labelmill.sources.readers import read_image_pixels

    for width in (1, 2, 3, 4):
        folder = str(tmp_path / str(width))
        rows = [["".join(f"{(y * 31 + x * 7 + c * 11) % 256:02X}" for x in range(width) for c in range(3)) for y in range(5)]]
        df = spark.createDataFrame([(rows[0],)], "rows array<string>").select(F.lit("i.bmp").alias("name"), bmp(F.col("rows"), width).alias("content"))
        assert write_files(df, folder).collect()[0].size == 54 + 5 * (width * 3 + -width * 3 % 4)
        write_files(df, folder).collect()  # a task that runs again
        got = {(r.y, r.x): (r.b, r.g, r.r) for r in read_image_pixels(spark, folder).collect()}
        assert got == {(y, x): tuple((y * 31 + x * 7 + c * 11) % 256 for c in range(3)) for y in range(5) for x in range(width)}


def test_jdbc_index_reads_ranges_and_pushes_filters(spark):
    from labelmill.sources.exports import index_url, rebuild_jdbc_index
    from labelmill.sources.readers import read_jdbc_index

    url = index_url(spark)
    rows = spark.range(1000).select(F.col("id").alias("ID"), (F.col("id") % 3).cast("int").alias("STATE"))
    rebuild_jdbc_index(rows, url, "IDX")
    rebuild_jdbc_index(rows.where("ID >= 100"), url, "IDX")  # the rebuild replaces what was there
    got = read_jdbc_index(spark, url, "IDX", "ID", 4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 900
    some = got.where("STATE = 1")
    assert "EqualTo(STATE,1)" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 300
    rebuild_jdbc_index(rows.where("false"), url, "IDX")
    assert read_jdbc_index(spark, url, "IDX", "ID").count() == 0


def test_files_of_null_and_repeated_rows(spark, tmp_path):
    from labelmill.sources.exports import write_files
    from labelmill.sources.readers import read_binary

    df = spark.createDataFrame([("a", b"x"), ("b", None), ("c", b""), ("a", b"x")], "name string, content binary")
    assert {(r.name, r.size) for r in write_files(df, str(tmp_path / "f")).collect()} == {("a", 1), ("c", 0)}
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in read_binary(spark, str(tmp_path / "f")).collect()) == [("a", 1)]  # empty files are passed over


def test_only_asked_colours_ask(spark):
    """Neighbours of some colours among all: the rows that all of them would give; shared colours are not looked up."""
    from unittest import mock

    from labelmill.operators import colours

    points = points_of(spark, [i * 977 % (1 << 24) for i in range(60)])
    some = points.where("id % 3 = 0").select("id")
    full = {(r.id, r.near, r.distance) for r in colours.nearest_colours(points).collect()}
    assert {(r.id, r.near, r.distance) for r in colours.nearest_colours(points, asked=some).collect()} == {r for r in full if r[0] % 3 == 0}
    seen = []
    real = colours.nearest_colours
    with mock.patch.object(colours, "nearest_colours", lambda p, **k: seen.append(k["asked"]) or real(p, **k)):
        colours.nearest_agreement(spark.createDataFrame([(1, 2, 3, "x"), (1, 2, 3, "y"), (9, 9, 9, "x")], "r int, g int, b int, label string"), "label")
    assert [r.id for r in seen[0].select("id").collect()] == [9 * 65536 + 9 * 256 + 9]


def test_perturbations_are_code_that_the_jvm_compiles(spark):
    import re

    import __spark_entry__

    df = __spark_entry__.queries()["fn_perturb"](spark, "/root/testdata/sf0.001")
    told = spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert sizes and max(sizes) < 8000  # bytes of a method that HotSpot still compiles


def test_many_files_are_listed_in_folders_and_read_in_few_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    import __spark_entry__
    from labelmill.sources.exports import write_files

    df = spark.createDataFrame([("x/a", bytearray(b"1")), ("x/y/b", bytearray(b"22")), ("c", bytearray(b"3"))], "name string, content binary")
    assert {(r.name, r.size) for r in write_files(df, str(tmp_path / "f")).collect()} == {("x/a", 1), ("x/y/b", 2), ("c", 1)}
    assert (tmp_path / "f" / "x" / "y" / "b").read_bytes() == b"22"
    none = str(tmp_path / "none")
    spark.range(0).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).write.parquet(f"{none}/documents.parquet")
    assert __spark_entry__.queries()["src_binary_hash"](spark, none).count() == 0
    many = str(tmp_path / "many")
    spark.range(1200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).write.parquet(f"{many}/documents.parquet")
    out = __spark_entry__.queries()["src_binary_hash"](spark, many)
    assert out.count() == 1200 and out.rdd.getNumPartitions() < 30  # at 4 MB for opening a file it is 38 tasks


def test_files_are_not_known_to_the_driver(spark, tmp_path):
    import hashlib

    import __spark_entry__
    from labelmill.sources.exports import write_files
    from labelmill.sources.readers import read_folders

    out = __spark_entry__.queries()["src_binary_hash"](spark, "/root/testdata/sf0.001")
    assert out.count() == 200 and not [f for f in out.inputFiles() if f.endswith(".bin")]  # was one for each document
    files = [("x/a", b"1"), ("x/b", b""), ("x/_c", b"3"), ("x/d/e", b"4"), ("y/f", b"5" * 3000)]
    write_files(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "name string, content binary"), str(tmp_path / "f")).collect()
    folders = spark.createDataFrame([("x",), ("y",), ("none",)], "name string")
    got = {(r.path.split("/f/")[1], r.size, r.sha256) for r in read_folders(spark, str(tmp_path / "f"), folders).collect()}
    assert got == {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in files if n in ("x/a", "y/f")}

"""Regions, outlines, run lengths, cells of boxes and releases against brute force."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.functions import helpers as H
from labelmill.operators import graph as G
from labelmill.operators import labels as L
from labelmill.operators import regions as R


def image(spark, grid, name=0):
    h, w = grid.shape
    return spark.createDataFrame([(name, y, x, int(grid[y, x]) if grid[y, x] >= 0 else None) for y in range(h) for x in range(w)], "image int, y int, x int, v int")


def slow_regions(grid, eight):
    """{first pixel: (value, pixels)} by flooding."""
    seen, out = np.zeros(grid.shape, bool), {}
    for y, x in itertools.product(*map(range, grid.shape)):
        if seen[y, x] or grid[y, x] < 0:
            continue
        todo, own = [(y, x)], set()
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            own.add((a, b))
            for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                p, q = a + dy, b + dx
                if (eight or not dy or not dx) and 0 <= p < grid.shape[0] and 0 <= q < grid.shape[1] and not seen[p, q] and grid[p, q] == grid[y, x]:
                    seen[p, q] = True
                    todo.append((p, q))
        out[(y << 32) + x] = (int(grid[y, x]), own)
    return out


@pytest.mark.parametrize("eight, strip", [(False, 4), (True, 4), (False, 64)])
def test_regions_in_strips(spark, eight, strip):
    grid = np.random.default_rng(2).integers(-1, 3, (40, 30))
    runs = R.labelled_runs(image(spark, grid), "v", eight, strip=strip).collect()
    got = defaultdict(set)
    for r in runs:
        got[r.comp] |= {(r.value, r.y, x) for x in range(r.x0, r.x1 + 1)}
    assert got == {k: {(v, y, x) for y, x in p} for k, (v, p) in slow_regions(grid, eight).items()}


def test_one_tall_image_is_cut_into_strips(spark):
    """A snake through 3,000 rows: one region, and no strip holds more than 16 rows of it."""
    px = spark.range(3000).select(F.lit(7).alias("image"), F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.when(F.col("y") % 4 == 0, F.sequence(F.lit(0), F.lit(9))).when(F.col("y") % 4 == 2, F.sequence(F.lit(0), F.lit(9))).when(F.col("y") % 4 == 1, F.array(F.lit(9))).otherwise(F.array(F.lit(0))))).withColumn("v", F.lit(1))
    row = R.region_sizes(R.labelled_runs(px, "v", strip=16)).collect()
    assert [(r.comp, r["size"], r.y1) for r in row] == [(0, px.count(), 2999)]


def test_labelled_runs_of_nothing(spark):
    px = spark.createDataFrame([], "image int, y int, x int, v int")
    assert R.labelled_runs(px, "v").count() == 0 and R.outlines(R.labelled_runs(px, "v")).count() == 0


def test_connected(spark):
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 200, (150, 2)).tolist() + [[300 + i, 301 + i] for i in range(60)]
    up = list(range(400))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in G.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for p in pairs if p[0] != p[1] for i in p}


def inside(rings, y, x):
    return sum(p[0] == q[0] and p[0] > x and min(p[1], q[1]) <= y < max(p[1], q[1]) for r in rings for p, q in zip(r, r[1:] + r[:1], strict=True)) % 2 == 1


@pytest.mark.parametrize("eight", [False, True])
def test_outlines_enclose_their_pixels(spark, eight):
    grid = np.random.default_rng(3).integers(0, 2, (24, 20))
    want = slow_regions(grid, eight)
    runs = R.cut(R.labelled_runs(image(spark, grid), "v", eight, strip=8))
    rings = defaultdict(list)
    for r in R.outlines(runs).collect():
        pts = [(p.x, p.y) for p in r.points]
        assert r.area2 == sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(pts, pts[1:] + pts[:1], strict=True)) and r.hole == (r.area2 < 0)
        assert all((p[0] == q[0]) != (p[1] == q[1]) for p, q in zip(pts, pts[1:] + pts[:1], strict=True))
        assert all((p[0] == q[0]) != (q[0] == s[0]) for p, q, s in zip(pts, pts[1:] + pts[:1], pts[2:] + pts[:2], strict=True))  # it turns at each point
        assert pts[0] == min(pts, key=lambda p: (p[1], p[0]))
        rings[r.comp].append((r.area2, pts))
    assert rings.keys() == want.keys()
    for k, (_, pixels) in want.items():
        assert sum(a for a, _ in rings[k]) == 2 * len(pixels)
        if len(pixels) > 6 or k % 7 == 0:
            assert {(y, x) for y in range(24) for x in range(20) if inside([p for _, p in rings[k]], y, x)} == pixels
    frames = spark.createDataFrame([(0, 20, 24)], "image int, width int, height int")
    for r in R.mask_counts(runs, frames).collect():
        flat = [i for i, n in enumerate(r.counts) for _ in range(n)]
        assert len(flat) == 480 and all(n > 0 for n in r.counts[1:])
        assert {(i % 24, i // 24) for i, k in enumerate(flat) if k % 2} == want[r.comp][1]


def test_coco_reads_back(spark):
    from labelmill.sources.exports import coco_pixels, coco_segments

    grid = np.random.default_rng(5).integers(0, 3, (30, 26))
    grid[3:12, 4:15], grid[5:9, 6:12], grid[7, 8], grid[20:, :] = 1, 2, 255, 255  # a hole within a hole, an ignored part
    px = image(spark, grid).union(image(spark, np.zeros((3, 3), int), 1))  # an image without classes
    frames = spark.createDataFrame([(0, 26, 30), (1, 3, 3)], "image int, width int, height int")
    for always in (False, True):
        a = R.cut(coco_segments(R.labelled_runs(px, "v"), frames, always_rle=always))
        rows = a.orderBy("id").collect()
        assert [r.id for r in rows] == list(range(1, len(rows) + 1)) and {r.category_id for r in rows} == {1, 2}
        assert all((r.polygons is None) == (always or r.holes > 0) and (r.counts is None) != (r.polygons is None) for r in rows)
        assert any(r.holes for r in rows) and sum(r.area for r in rows) == int(np.isin(grid, (1, 2)).sum())
        got = {(r.y, r.x): r.cls for r in coco_pixels(a, frames).collect()}
        assert got == {(y, x): int(grid[y, x]) for y, x in zip(*np.nonzero(np.isin(grid, (1, 2))), strict=True)}
        for r in rows:
            if r.counts is not None:
                assert H.rle_counts(__import__("json").loads(r.segmentation)["counts"]) == r.counts


def test_release_check_sees_differences(spark, tmp_path):
    from labelmill.sources.exports import check_dataset, write_dataset

    grid = np.random.default_rng(6).integers(0, 3, (70, 5))
    px = image(spark, grid).union(image(spark, np.zeros((4, 6), int), 1))
    images = spark.createDataFrame([(0, 5, 70, "a.png", "train"), (1, 6, 4, "b.png", "test")], "image int, width int, height int, file string, split string")
    classes, verified = spark.createDataFrame([(0, "none"), (1, "one"), (2, "two")], "id int, name string"), spark.createDataFrame([(0, "yes")], "image int, status string")
    write_dataset(str(tmp_path / "r"), px, images, classes, verified, "v")
    row = {r.image: r for r in check_dataset(spark, str(tmp_path / "r"), px, images, "v").collect()}
    assert all((r.missing, r.unexpected, r.coco_missing, r.coco_unexpected, r.size_ok) == (0, 0, 0, 0, True) for r in row.values()) and row[0].pixels == 350
    other = px.withColumn("v", F.when((F.col("y") == 3) & (F.col("x") == 2) & (F.col("image") == 0), (F.col("v") + 1) % 3).otherwise(F.col("v")))
    r = {r.image: r for r in check_dataset(spark, str(tmp_path / "r"), other, images.withColumn("height", F.lit(70)), "v").collect()}
    assert (r[0].missing, r[0].unexpected, r[0].size_ok, r[1].missing, r[1].size_ok) == (1, 1, True, 0, False)
    write_dataset(str(tmp_path / "s"), px, images, classes, verified, "v", annotated_only=True)
    assert [x.image for x in spark.read.json(str(tmp_path / "s/metadata/images")).collect()] == [0]


@pytest.mark.parametrize("tile", [4, 64])
def test_cells_of_boxes(spark, tile):
    rng = np.random.default_rng(8)
    rows = [(int(i % 2), int(x), int(y), int(w), int(h), int(c), int(z), int(t)) for i, (x, y, w, h, c, z, t) in enumerate(rng.integers([0, 0, 0, 0, 1, 0, 0], [20, 20, 9, 9, 5, 3, 3], (40, 7)))]
    ann = spark.createDataFrame(rows, "image int, bx int, bt int, bw int, bh int, cls int, z int, created int")
    claims = defaultdict(list)
    for im, x, y, w, h, c, z, t in rows:
        for p in itertools.product(range(y, y + h), range(x, x + w)):
            claims[im, *p].append((z, t, c))
    want = defaultdict(int)
    for k, v in claims.items():
        want[k[0], max(v)[2], len(v)] += 1
    cells = L.box_cells(ann, tile)
    assert {(r.image, r.y0 + i, r.x0 + j) for r in cells.collect() for i in range(r.h) for j in range(r.w)} == set(claims)
    got = defaultdict(int)
    for r in L.topmost_cells(ann, ("z", "created")).collect():
        got[r.image, r.cls, r.claims] += r.pixels
    assert got == want


def test_common_subsequences():
    random.seed(1)

    def slow(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[j]))
            p = q
        return p[-1]

    for _ in range(400):
        a = "".join(random.choice("abcdé") for _ in range(random.randint(0, 60)))
        b = list(a)
        for _ in range(random.randint(0, 16)):
            if b and random.random() < 0.5:
                b.pop(random.randrange(len(b)))
            else:
                b.insert(random.randint(0, len(b)), random.choice("abcdé"))
        b, places = "".join(b), H.char_places(a)
        n = slow(a, b)
        assert H.common_length(places, len(a), b) == n
        assert all(H.common_at_least(places, len(a), b, k) == (n >= k) for k in (n - 1, n, n + 1, n + 4))


def test_region_candidates_by_brute_force(spark):
    from labelmill.functions.color import ciede2000

    rng = np.random.default_rng(9)
    rows = []
    for im in (0, 1):
        for y, x in itertools.product(range(18), range(16)):
            known = (y * 3 + x * 5 + im) % 7 == 0 and y < 14
            cls = 255 if known and x == 3 else (1 + (x >= 8)) if known else 0
            rows.append((im, y, x, cls, 50.0 + 3 * rng.normal(), (20.0 if x < 8 else -20.0) + 3 * rng.normal(), 5.0 * (y > 14)))
    px = spark.createDataFrame(rows, "image int, y int, x int, label int, l double, a double, b double")
    for given in (None, spark.createDataFrame([(1, 50.0, 20.0, 0.0), (4, 49.0, -19.0, 5.0)], "cls int, l double, a double, b double")):
        got = {(r.image, r.cls, r.comp): (r["size"], round(r.distance, 6), r.x0, r.y0, r.x1, r.y1, r["rank"]) for r in R.region_candidates(px, "label", ("l", "a", "b"), near=9.0, least=3, most=6, references=given).collect()}
        want = {}
        for im in (0, 1):
            own = [r for r in rows if r[0] == im]
            middle = {c: [float(np.median([r[k] for r in own if r[3] == c])) for k in (4, 5, 6)] for c in {r[3] for r in own} - {0, 255}} if given is None else {r.cls: [r.l, r.a, r.b] for r in given.collect()}
            found = []
            for c, m in middle.items():
                free = px.where(f"image = {im} and label = 0").select("y", "x", ciede2000([F.col(k) for k in "lab"], [F.lit(v) for v in m]).alias("d")).collect()
                d = {(r.y, r.x): r.d for r in free if r.d <= 9.0}
                cross = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
                out = lambda y, x: not (0 <= y < 18 and 0 <= x < 16)
                core = {p for p in d if all(out(p[0] + a, p[1] + b) or (p[0] + a, p[1] + b) in d for a, b in cross)}
                mask = {(y + a, x + b) for y, x in core for a, b in cross} & d.keys()
                grid = np.array([[1 if (y, x) in mask else -1 for x in range(16)] for y in range(18)])
                for k, (_, p) in slow_regions(grid, True).items():
                    if len(p) >= 3:
                        found.append((sum(d[q] for q in p) / len(p), c, k, p))
            for n, (mean, c, k, p) in enumerate(sorted(found, key=lambda f: (round(f[0], 9), f[1], f[2]))[:6]):
                ys, xs = [y for y, _ in p], [x for _, x in p]
                want[im, c, k] = (len(p), round(mean, 6), min(xs), min(ys), max(xs), max(ys), n + 1)
        assert got == want and len(want) > 3


def test_ranks_are_those_of_one_sort(spark):
    from labelmill.operators.lineage import ranked

    rng = np.random.default_rng(10)
    rows = [(i, None if k == 3 else int(k > 0)) for i, k in enumerate(rng.integers(0, 4, 500))]
    df = spark.createDataFrame(rows, "id long, s int").repartition(5)
    got = {r.id: r.n for r in ranked(df, [F.desc("id")], "n", ("s",)).collect()}
    for s in (None, 0, 1):
        assert [got[i] for i in sorted((i for i, k in rows if k == s), reverse=True)] == list(range(1, 1 + sum(k == s for _, k in rows)))
    assert sorted(r.n for r in ranked(df, [F.asc("id")], "n").collect()) == list(range(1, 501))
    assert ranked(df.where("false"), [F.asc("id")], "n", ("s",)).count() == 0


def test_outlines_of_small_and_large_regions_agree(spark):
    rng = np.random.default_rng(23)
    px = spark.createDataFrame([(k, y, x, int(v)) for k in range(3) for (y, x), v in np.ndenumerate(rng.random((24, 24)) < 0.6)], "image long, y int, x int, v int")
    runs = R.labelled_runs(px, "v")
    rows = lambda d: sorted((r.image, r.comp, r.ring, r.hole, r.area2, tuple((p.x, p.y) for p in r.points)) for r in d.collect())
    here = rows(R.outlines(runs))
    assert len(here) > 50 and here == rows(R.outlines(runs, local=0)) == rows(R.outlines(runs, local=40))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # regions go on from batch to batch
    try:
        assert here == rows(R.outlines(runs))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

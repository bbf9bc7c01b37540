"""Vector search by cells and bounds against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from labelmill.operators import corpus as C


def data(rng, n=600, d=5):
    x = np.concatenate([rng.normal(size=(n // 2, d)), np.repeat(rng.normal(size=(6, d)) * 3, n // 12, axis=0) + 0.05 * rng.normal(size=(n // 12 * 6, d))])
    x[7] = x[8] = x[9]  # ties
    x[20] = 0
    return x


@pytest.mark.parametrize("by", ["cosine", "euclid"])
@pytest.mark.parametrize("shard, block", [(10_000, 10_000), (40, 50)])
def test_nearest_vectors(spark, by, shard, block):
    x = data(np.random.default_rng(4))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "chunk_id long, v array<double>")
    asks = [*range(0, 600, 7), 7, 8, 9, 20]
    q = v.where(v.chunk_id.isin(asks)).toDF("query_id", "q")
    got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.value, 6)) for r in C.nearest_vectors(q, v, 4, by, block=block, shard=shard).collect()}
    norm = np.linalg.norm(x, axis=1)
    want = {}
    for i in set(asks):
        value = np.divide(x @ x[i], norm * norm[i], out=np.zeros(len(x)), where=norm * norm[i] > 0) if by == "cosine" else np.linalg.norm(x - x[i], axis=1)
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (round((-1 if by == "cosine" else 1) * value[j], 9), j))[:4]
        want.update({(i, k + 1): (j, round(value[j], 6)) for k, j in enumerate(order)})
    assert got == want


def test_nearest_vectors_of_few_or_none(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, v array<double>")
    q = v.toDF("query_id", "q")
    assert {(r.query_id, r.chunk_id) for r in C.nearest_vectors(q, v, 5, shard=1).collect()} == {(1, 2), (2, 1)}
    assert C.nearest_vectors(q, v.where("false"), 5).count() == 0 and C.nearest_vectors(q.where("false"), v, 5).count() == 0


def test_bounds_lose_nothing_and_skip_cells():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 8)) * 4, 40, axis=0) + 0.1 * rng.normal(size=(1200, 8))
    c = C.pivots_of(x, 30)
    far = C.to_pivots(x, c)
    cell = far.argmin(axis=1)
    radius = np.array([far[cell == i, i].max(initial=-np.inf) for i in range(len(c))])
    d = C.to_pivots(x, x)
    kth = np.sort(d, axis=1)[:, 5]
    ask = C.cells_to_ask(far, radius, kth)
    assert all(ask[i, cell[j]] for i in range(0, 1200, 17) for j in np.flatnonzero(d[i] <= kth[i]))
    assert ask.mean() < 0.3  # most cells are left alone


def test_distances_to_pivots_in_slices():
    """A batch's distances to all pivots are never held at once, and are the same."""
    import numpy as np
    import pandas as pd

    from labelmill.operators import corpus as C

    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(1300, 8)), rng.normal(size=(40, 8))
    parts = list(C.some_to_pivots(pd.Series(list(x)), c, "euclid"))
    assert [len(p) for p in parts] == [512, 512, 276] and np.allclose(np.concatenate(parts), C.to_pivots(x, c))

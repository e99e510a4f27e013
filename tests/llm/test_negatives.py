"""Hard negatives against all products; bounds of boxes; trees of odd shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, positives=5, negatives=3):
    fit = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (a, va, la) in enumerate(fit):
        if a is None or a % every:
            continue
        scored = [(-dot(va, v), last(i), j, i, lab) for j, (i, v, lab) in enumerate(fit) if j != k]
        for s, _, _, p, _ in sorted(x for x in scored if x[4] == la)[:positives]:
            hard = sorted(x for x in scored if x[4] != la and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out += [(a, p, r, x[3], -s, -x[0]) for r, x in enumerate(hard, 1)]
    return sorted(out, key=str)


def vectors(rng, n, d=6):
    centres = rng.normal(size=(5, d))
    return [(i, (centres[i % 5] + rng.normal(size=d) * 0.6).tolist(), int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize(("tile", "anchors", "seed"), [(4096, 2048, 0), (50, 4, 1)])
def test_equals_all_products(spark, monkeypatch, tile, anchors, seed):
    monkeypatch.setattr(H, "TILE", tile)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    rows = vectors(np.random.default_rng(seed), 400)
    rows += [(1000, None, 1), (1010, [1.0] * 6, None), (1020, [float("nan")] + [0.0] * 5, 1), (1030, [float("inf")] * 6, 2), (1040, [None] * 6, 0), (1050, [0.5, 0.25], 0), (1060, [], 1), (None, [0.7] * 6, 1)]
    rows += [(2000 + k, rows[3][1], 1) for k in range(90)]  # equal vectors, more than a tile
    random.Random(seed).shuffle(rows)
    documents = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("row", "id", "v", "slab", "tile", "part")})
    got = H.mine(documents, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 10)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.8, 0.0], 2)]
    got = H.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 1, 65536, 52224)] * 2


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.mine(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0], 1)], SCHEMA)
    assert H.mine(one, F.col("vec_id") % 50 == 0).count() == 0 and H.mine(one, F.col("vec_id") < 0).count() == 0


def test_bounds_hold_every_product():
    rng = np.random.default_rng(3)
    a, x = rng.integers(-300, 300, (20, 8)), rng.integers(-300, 300, (500, 8))
    lo, hi = (f.reduceat(x, np.arange(0, 500, 50), axis=0) for f in (np.minimum, np.maximum))
    low, high = H.bounds(a, lo, hi)
    for k in range(10):
        score = a @ x[50 * k : 50 * k + 50].T
        assert (score.min(axis=1) >= low[:, k]).all() and (score.max(axis=1) <= high[:, k]).all()


def test_large_components_are_exact(spark):
    rows = [(0, [60000.0, 1.0], 1), (2, [60000.0, 3.0], 1), (3, [50000.0, 7.0], 2), (4, [50000.0, 7.5], 2)]
    got = H.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows[:1] + rows[1:], 100)

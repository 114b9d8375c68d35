import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import negatives


def brute_force(rows, low=30, high=90):
    """rows: (id, vector, label); those alike get rows of their own, so ids of results repeat."""
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for a, (i, q, y) in enumerate(good):
        if i is None or i % 100:
            continue
        scores = [(sum(x * z for x, z in zip(q, p)), j, b, w) for b, (j, p, w) in enumerate(good) if b != a]
        for s, p, *_ in sorted((x for x in scores if x[3] == y), key=order)[:5]:
            near = sorted((x for x in scores if x[3] != y and low * s <= 100 * x[0] <= high * s), key=order)[:10]
            out += [(i, p, r, n, s, t) for r, (t, n, *_) in enumerate(near, 1)]
    return sorted(out, key=str)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS row", "3 AS q").repartition(parts)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 100 == 0, F.col("label")).collect()), key=str)


@pytest.mark.parametrize("sizes", [(1024, 64, 32), (7, 3, 5)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, k in zip(("ROWS", "ANCHORS", "DIMS"), sizes):
        monkeypatch.setattr(negatives, name, k)
    rng = np.random.default_rng(8)
    rows = [(int(i), (rng.normal(size=12) + (0.4 * (i % 3))).tolist(), int(y)) for i, y in zip(rng.permutation(700), rng.choice(5, 700, p=[0.6, 0.2, 0.1, 0.05, 0.05]))]
    assert mined(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    v, w = [1.0] * 4, [0.5, 0.5, 0.4, 0.6]
    bad = [None, [float("nan")] * 4, [float("inf")] + [1.0] * 3, [None] + [1.0] * 3]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, w, 2), (2, w, 2), (3, w, 3), (None, w, 2), (100, [], 1), (4, [1.0] * 6, 2), (5, [0.7], 2), (6, w, None), (None, v, 1), (200, [3e5] * 4, 2), (300, v, 9), (7, [1e6] * 4, 2)]
    rows += [(10 + i, x, 2) for i, x in enumerate(bad)] + [(400, None, 1)]
    assert mined(spark, rows) == brute_force(rows)
    assert mined(spark, []) == [] and mined(spark, rows[3:4]) == [] and mined(spark, [(0, v, 1)]) == []


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 29):
        one, two = rng.integers(-top, top, (5, 8)), rng.integers(-top, top, (6, 8))
        assert (negatives._product(one, two).astype(object) == one.astype(object) @ two.T.astype(object)).all()

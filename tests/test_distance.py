import math
import random

import numpy as np
import pytest

from gridloom.operators.distance import distance_transform, envelope


def test_envelope_by_brute_force():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 8, 9, 64, 101):
        f = rng.integers(0, 400, (6, width)).astype(float)
        f[rng.random(f.shape) < 0.6] = np.inf
        f[0] = np.inf
        x = np.arange(width)
        want = ((x[:, None] - x[None, :]) ** 2 + f[:, None, :]).min(axis=2)
        assert np.array_equal(envelope(f), want)


def scene(seed, h, w, share):
    rng = random.Random(seed)
    return [(y, x, 1 if rng.random() < share else rng.choice([0, None])) for y in range(h) for x in range(w) if rng.random() < 0.8]


@pytest.mark.parametrize("rows", [1, 4, 7, None])
def test_far_beyond_a_strip(spark, rows):
    """Few targets in 60 x 40 pixels with gaps: distances of many strips, and columns whose pixels are missing."""
    px = scene(3, 60, 40, 0.003)
    hits = [(y, x) for y, x, v in px if v == 1]
    assert 0 < len(hits) < 12
    df = spark.createDataFrame(px, "y long, x long, value int")
    got = {(r.y, r.x): r.distance for r in distance_transform(df, "value = 1", rows=rows).collect()}
    assert got == {(y, x): math.sqrt(min((y - a) ** 2 + (x - b) ** 2 for a, b in hits)) for y, x, _ in px}
    assert max(got.values()) > 15


def test_limit_and_no_target(spark):
    df = spark.createDataFrame([(0, x, int(x == 0)) for x in range(9)], "y long, x long, value int")
    assert [r.distance for r in distance_transform(df, "value = 1", limit=3).orderBy("x").collect()] == [0, 1, 2, 3] + [None] * 5
    assert {r.distance for r in distance_transform(df, "value = 7").collect()} == {None}
    assert distance_transform(df.limit(0), "value = 1").count() == 0

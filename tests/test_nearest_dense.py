"""Nearest neighbours among points far denser than the cell given."""

import math

import numpy as np
import pytest

from gridloom.operators import spatial as S


@pytest.mark.parametrize("flat", [False, True])
def test_first_square_follows_density(spark, monkeypatch, flat):
    r = np.random.default_rng(2)
    rows = [(n, float(x), 0.5 if flat else float(y)) for n, (x, y) in enumerate(r.random((1500, 2)))]
    kind = "id long, px double, py double"
    b, a = spark.createDataFrame(rows, kind), spark.createDataFrame([*rows[:20], (9000, 40.0, 3.0)], kind)
    first, plain = [], S.within_radius
    monkeypatch.setattr(S, "within_radius", lambda p, q, radius: first.append(radius) or plain(p, q, radius))
    got = {(x.aid, x["rank"]): (x.bid, x.distance) for x in S.nearest(a, b, 3).collect()}
    for n, x, y in [*rows[:20], (9000, 40.0, 3.0)]:
        want = sorted((math.sqrt((x - p) ** 2 + (y - q) ** 2), m) for m, p, q in rows)[:3]
        assert [got[n, k + 1] for k in range(3)] == [(m, pytest.approx(e)) for e, m in want]
    assert first[0] < 0.1 or flat

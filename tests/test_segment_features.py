"""Segment features of several bands against brute force, for several tile sizes; hierarchy features of odd links."""

import numpy as np
import pytest

from gridloom.operators import stats as S
from gridloom.operators import tiles


@pytest.mark.parametrize("size", [3, 256])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(tiles, "SIZE", size)
    rng = np.random.default_rng(9)
    seg = rng.integers(0, 3, (4, 5)).repeat(2, axis=0).repeat(2, axis=1)  # 0 is no segment
    a, b = rng.random(seg.shape), rng.random(seg.shape) * 10
    b[rng.random(seg.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(y, x, int(seg[y, x]), float(a[y, x]), float(b[y, x])) for y in range(8) for x in range(10)], "y bigint, x bigint, seg int, a double, b double")
    got = {r["segment_id"]: r for r in S.segment_features(df, "seg", ["a", "b"], 4, [0.0, 0.0], [1.0, 10.0]).collect()}
    assert sorted(got) == sorted(set(seg.ravel().tolist()) - {0})
    edge = np.pad(seg, 1, constant_values=-1)
    around = [edge[1 + dy : 9 + dy, 1 + dx : 11 + dx] == seg for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))]
    for k, r in got.items():
        own = seg == k
        assert r["area"] == own.sum() and r["perimeter"] == (own & ~np.logical_and.reduce(around)).sum()
        for name, v, top in (("a", a, 1.0), ("b", b, 10.0)):
            q = np.floor(v / top * 4)
            pairs = [(q[y, x], q[c, d]) for y in range(8) for x in range(10) for c, d in ((y, x + 1), (y + 1, x)) if c < 8 and d < 10 and own[y, x] and own[c, d] and not np.isnan(q[y, x] + q[c, d])]
            one, two = np.array(pairs).T
            n = np.array(list({p: pairs.count(p) for p in pairs}.values()))
            want = [np.nanmean(v[own]), np.nanstd(v[own]), ((one - two) ** 2).mean(), (1 / (1 + abs(one - two))).mean(), (n**2).sum() / n.sum() ** 2, np.corrcoef(one, two)[0, 1]]
            assert np.allclose([r[f"{c}_{name}"] for c in ("mean", "stddev", "contrast", "homogeneity", "energy", "correlation")], want)


def test_hierarchy(spark):
    level = spark.createDataFrame([(1, 4, 0.5), (2, 6, 0.1), (3, 5, 0.2), (4, 1, None)], "segment_id int, area bigint, mean double")
    links = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, None), (4, 77)], "segment_id int, parent_id int")
    parents = spark.createDataFrame([(10, 20)], "segment_id int, area bigint")
    children = spark.createDataFrame([(100, 1), (101, 1), (101, 1), (102, None)], "segment_id int, parent_id int")
    got = {tuple(r) for r in S.hierarchy_features(level, links, parents, children).select("segment_id", "parent_id", "child_count", "area_ratio").collect()}
    assert got == {(1, 10, 2, 0.2), (2, 10, 0, 0.3), (3, 0, 0, 0.0), (4, 0, 0, 0.0)}  # 77 has no area
    assert {r["child_count"] for r in S.hierarchy_features(level, links, parents).collect()} == {0}


def test_empty(spark):
    df = spark.createDataFrame([], "y bigint, x bigint, seg int, a double")
    assert S.segment_features(df, "seg", "a").count() == 0

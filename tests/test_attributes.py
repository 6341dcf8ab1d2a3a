"""Neighbours with attributes and coordinate export with windows and missing values."""

import pytest

from gridloom.operators import spatial as S
from gridloom.sources import rasters as R


def test_neighbours_keep_attributes(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, "p"), (2, 50.0, 0.0, None), (3, None, 1.0, "q"), (4, float("nan"), 1.0, "r")], "id long, px double, py double, name string")
    b = spark.createDataFrame([(7, 3.0, 4.0), (8, -3.0, 4.0), (9, None, 0.0)], "id long, px double, py double")
    got = sorted(tuple(r) for r in S.nearest_features(a, b, 2, limit=6.0).collect())
    assert got == [(1, 0.0, 0.0, "p", 7, 3.0, 4.0, 5.0, 1), (1, 0.0, 0.0, "p", 8, -3.0, 4.0, 5.0, 2)]
    far = S.nearest_features(a, b, 1).filter("id = 2").collect()
    assert [(r["name"], r["neighbor_id"], r["rank"]) for r in far] == [(None, 7, 1)]
    assert S.nearest_features(a, b.limit(0), 1, limit=6.0).count() == 0
    with pytest.raises(ValueError):
        S.nearest_features(a.withColumnRenamed("name", "rank"), b)


def test_xyz_window_and_missing_values(spark):
    px = spark.createDataFrame([(y, x, float(y * 10 + x), None if x == 3 else -1.0) for y in range(6) for x in range(6)], "y long, x long, a double, b double")
    got = R.to_xyz(px, 0.0, 0.0, 1.0, 1.0, 2, ["a", "b"], (1, 1, 4, 4), nodata=-1.0).collect()
    assert sorted(map(tuple, got)) == [(1.5, 1.5, 11.0, None), (1.5, 3.5, 31.0, None), (3.5, 1.5, 13.0, None), (3.5, 3.5, 33.0, None)]
    assert R.to_xyz(px, 0.0, 0.0, 1.0, 1.0, bands=["b"], nodata=-1.0, drop=True).count() == 0
    assert {r["b"] for r in R.to_xyz(px, 0.0, 0.0, 1.0, 1.0, bands=["b"], fill=5.0).collect()} == {-1.0, 5.0}

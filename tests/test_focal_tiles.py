"""Window operators on tiles of several sizes against brute force over single windows."""

from collections import Counter

import numpy as np
import pytest

from gridloom.operators import focal as O
from gridloom.operators import tiles

H, W = 13, 17


@pytest.fixture(scope="module")
def raster():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 6, (H, W)).astype(float)
    v[rng.random((H, W)) < 0.1] = np.nan
    return v


def table(spark, v, kind="double"):
    return spark.createDataFrame([(y, x, None if np.isnan(v[y, x]) else (int if kind == "int" else float)(v[y, x])) for y in range(H) for x in range(W)], f"y bigint, x bigint, value {kind}")


def window(v, y, x, r):
    """Values of a clamped window, missing ones left out."""
    around = [v[min(max(y + a, 0), H - 1), min(max(x + b, 0), W - 1)] for a in range(-r, r + 1) for b in range(-r, r + 1)]
    return [w for w in around if not np.isnan(w)]


def rows(df, *cols):
    return {(r["y"], r["x"]): tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("size", [4, 6, 256])
def test_windows(spark, raster, monkeypatch, size):
    monkeypatch.setattr(tiles, "SIZE", size)
    got = rows(O.local_statistics(table(spark, raster), 2), "mean", "variance", "skewness", "kurtosis")
    commonest = rows(O.majority_filter(table(spark, raster, "int"), "value", 5), "value")
    lowest = rows(O.morphology(table(spark, raster, "int"), "erode", 2, nodata=5), "value")
    for y in range(H):
        for x in range(W):
            w = np.array(window(raster, y, x, 2))
            m = w - w.mean()
            want = (w.mean(), (m**2).mean(), (m**3).mean() / (m**2).mean() ** 1.5, (m**4).mean() / (m**2).mean() ** 2 - 3)
            assert np.allclose(got[y, x], want)
            n = Counter(w.tolist())
            assert commonest[y, x] == (min(n, key=lambda c: (-n[c], c)),)
            assert lowest[y, x] == (5 if raster[y, x] == 5 else min(c for c in w if c != 5),)


@pytest.mark.parametrize("size,offset", [(4, (0, 1)), (6, (1, -1)), (256, (2, 0))])
def test_texture(spark, raster, monkeypatch, size, offset):
    monkeypatch.setattr(tiles, "SIZE", size)
    got = rows(O.glcm(table(spark, raster), 2, 3, 0.0, 6.0, offset), "energy", "entropy", "contrast", "homogeneity", "correlation")
    q = np.floor(raster / 2)
    for y in range(H):
        for x in range(W):
            pairs = []
            for a in range(max(y - 2, 0), min(y + 3, H)):
                for b in range(max(x - 2, 0), min(x + 3, W)):
                    c, d = a + offset[0], b + offset[1]
                    if 0 <= c < H and 0 <= d < W and not np.isnan(q[a, b]) and not np.isnan(q[c, d]):
                        pairs.append((q[a, b], q[c, d]))
            if not pairs:
                assert (y, x) not in got
                continue
            p = np.array(list(Counter(pairs).values())) / len(pairs)
            one, two = np.array(pairs).T
            d = one - two
            assert np.allclose(got[y, x][:4], ((p * p).sum(), -(p * np.log(p)).sum(), (d * d).mean(), (1 / (1 + d * d)).mean()))
            if one.std() > 0 and two.std() > 0:
                assert np.isclose(got[y, x][4], np.corrcoef(one, two)[0, 1])
            else:
                assert got[y, x][4] is None


def test_equal_values_do_not_vary(spark):
    df = spark.createDataFrame([(y, x, 0.1) for y in range(4) for x in range(4)], "y bigint, x bigint, value double")
    assert {r[2:] for r in O.local_statistics(df).select("y", "x", "variance", "skewness", "kurtosis").collect()} == {(0.0, None, None)}
    assert all(abs(r["value"] - 0.1) < 1e-12 for kind in ("lee", "kuan", "frost", "enhanced_lee", "gamma_map") for r in O.speckle(df, kind).collect())


def test_empty(spark):
    df = spark.createDataFrame([], "y bigint, x bigint, value double")
    assert O.local_statistics(df).count() + O.majority_filter(df, "value").count() + O.glcm(df, 1, 4, 0.0, 1.0).count() + O.morphology(df, "open").count() + O.terrain(df).count() == 0


def test_threshold_met_exactly(spark, tmp_path):
    """Windows whose variance is half their squared mean: the gamma map takes the side that its SQL takes."""
    import duckdb

    from gridloom.plans.all import ORACLES, QUERIES

    v = np.random.default_rng(151).integers(1, 13, 400)
    spark.createDataFrame([(k, int(p)) for k, p in enumerate(v)], "p_partkey bigint, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = {(y, x): v for y, x, v in con.execute(ORACLES["e05_gamma_map"]).fetchall()}
    got = {(r.y, r.x): r.value for r in QUERIES["e05_gamma_map"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 2e-6

"""Pinned numeric cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.expressions import band_math, referenced_bands
from gridloom.operators import chain, components, focal, ml, pixel, spatial, spectral, stats
from gridloom.sources import rasters


def row(spark, values):
    return spark.createDataFrame([(0, k, float(v) if v is not None else None) for k, v in enumerate(values)], "y long, x long, value double")


def by_x(df, col="value"):
    return [r[col] for r in df.orderBy("y", "x").collect()]


def test_laplacian_clamps_and_keeps_missing_centres(spark):
    got = by_x(focal.convolve(row(spark, [math.nan, 10, 0, 10, 5]), focal.LAPLACIAN))
    assert got[0] is None and got[1:3] == [-20.0, 20.0]


def test_mean_renormalises(spark):
    got = by_x(focal.mean_filter(row(spark, [None, 10, 4])))
    assert got[0] is None and got[1] == pytest.approx(7.0)
    assert by_x(focal.median_filter(row(spark, [None, 10, 4])))[1] == pytest.approx(7.0)


def test_linear_stretch(spark):
    assert by_x(row(spark, [0, 50, 100]).withColumn("value", pixel.linear_stretch(F.col("value"), 0.0, 100.0))) == [0, 127.5, 255]


def test_equalize_ends(spark):
    got = by_x(spectral.equalize(row(spark, [1, 1, 2, 3, 9]), "value"))
    assert got[0] == 0 and got[-1] == 255


def test_band_math_missing(spark):
    df = spark.createDataFrame([(1.0, math.nan, 0.0), (2.0, 4.0, 0.0)], "b1 double, b2 double, b3 double")
    for e in ("b1 < b2", "b1 > 0 && b2 > 0", "b2 > 1 ? 1 : 2", "b1 / b3", "sqrt(-b1)", "ln(b3)", "min(b1, b2 / b3)"):
        assert df.select(band_math(e).alias("v")).first()["v"] is None
    assert [r[0] for r in df.select(band_math("(b1 > 1 ? (b2 > 3 ? 10 : 20) : 30) + max(b1, 3)").alias("v")).collect()] == [33.0, 13.0]
    assert referenced_bands("b3 > 1 ? b1 : b10 + b3") == ["b1", "b3", "b10"]


def test_statistics_skip_infinite(spark):
    r = stats.band_statistics(row(spark, [1, math.inf, 3, math.nan, None]), ["value"]).first()
    assert (r["n"], r["min"], r["max"], r["mean"], r["stddev"]) == (2, 1, 3, 2, 1)


def test_hillshade(spark):
    df = spark.createDataFrame([(y, x, None if (y, x) in ((0, 0), (3, 3)) else float(y * x)) for y in range(4) for x in range(4)], "y long, x long, value double")
    got = {(r.y, r.x): r.hillshade for r in focal.terrain(df).collect()}
    assert (3, 3) not in got and all(0 <= v <= 1 for v in got.values()) and (1, 1) in got
    flat = focal.terrain(row(spark, [5, 5, 5])).first()
    assert flat.aspect == -1 and flat.slope == 0


def test_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (2, 2), (2, 1)], "t int, p int")
    r = stats.accuracy(df, "t", "p")[0].first()
    assert r["overall"] == pytest.approx(5 / 6) and r["kappa"] == pytest.approx(0.75)
    same = stats.accuracy(df.withColumn("p", F.col("t")), "t", "p")[0].first()
    assert same["kappa"] == 1.0


def test_jm(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (60, 2)), rng.normal(12, 1, (60, 2))
    rows = [(0, v.tolist()) for v in a] + [(1, v.tolist()) for v in a] + [(2, v.tolist()) for v in b] + [(3, [0.0, 1.0])]
    cov = stats.covariance(spark.createDataFrame(rows, "label int, s array<double>"), "s", 2, ["label"])
    got = {(x, y): v for x, y, v in stats.jm_separability(cov, 2)}
    assert abs(got[0, 1]) < 1e-9 and got[0, 2] > 1.95 and got[0, 3] == -1


def test_sieve_replaces_the_odd_pixel(spark):
    df = spark.createDataFrame([(y, x, 3 if (y, x) == (2, 2) else 1 if x < 4 else 2) for y in range(6) for x in range(8)], "y long, x long, label int")
    got = {(r.y, r.x): r.label for r in components.sieve(df, "label", 4).collect()}
    assert got[2, 2] == 1 and got[0, 7] == 2 and len(got) == 48


def test_labels_constant_on_edges(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 2, (12, 12))
    df = spark.createDataFrame([(y, x, int(g[y, x])) for y in range(12) for x in range(12)], "y long, x long, label int")
    lab = {(r.y, r.x): r.region for r in components.labels(df, "label", True).collect()}
    for (y, x), r in lab.items():
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if (y + dy, x + dx) in lab and g[y + dy, x + dx] == g[y, x]:
                    assert lab[y + dy, x + dx] == r


def test_fractions_and_rx(spark):
    e = np.array([[1.0, 0.0, 0.2], [0.1, 1.0, 0.5]])
    mix = [(k, 0, (e[0] * w + e[1] * (1 - w)).tolist()) for k, w in enumerate((0.0, 0.25, 0.7, 1.0))]
    out = spectral.unmix(spark.createDataFrame(mix, "y long, x long, spectrum array<double>"), e).orderBy("y").collect()
    assert [r.fractions[0] for r in out] == pytest.approx([0, 0.25, 0.7, 1.0], abs=1e-5) and max(r.rmse for r in out) < 1e-5
    rng = np.random.default_rng(5)
    px = spark.createDataFrame([(k, 0, rng.normal(size=3).tolist()) for k in range(80)], "y long, x long, spectrum array<double>")
    assert spectral.rx(px, 3).agg(F.avg("score")).first()[0] == pytest.approx(3, abs=1e-4)


def test_continuum_hulls(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.5, 1.0, 0.8])], "y long, x long, spectrum array<double>")
    assert spectral.continuum(df, ["y", "x"]).first()["removed"] == pytest.approx([1, 0.5, 1, 1])


def test_assignment():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(20):
        t = rng.integers(0, 30, (4, 4)).astype(float)
        got = ml.assign(t)
        assert sum(t[i, j] for i, j in enumerate(got)) == max(sum(t[i, p[i]] for i in range(4)) for p in permutations(range(4)))


def test_nearest_with_limit_and_ties(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 500.0)], "id long, px double, py double")
    b = spark.createDataFrame([(7, 3.0, 4.0), (5, 4.0, 3.0), (9, 100.0, 0.0)], "id long, px double, py double")
    assert [(r.aid, r.bid) for r in spatial.nearest(a, b, 1, 2.0).orderBy("aid").collect()][0] == (1, 5)
    assert [(r.aid, r.bid) for r in spatial.nearest(a, b, 3, 2.0, limit=5.0).orderBy("bid").collect()] == [(1, 5), (1, 7)]


def test_hull(spark):
    rng = np.random.default_rng(2)
    pts = [(0, float(x), float(y)) for x, y in rng.uniform(0, 1, (400, 2))] + [(0, -1.0, -1.0), (0, 2.0, -1.0), (0, 2.0, 2.0), (0, -1.0, 2.0)]
    got = {(r.px, r.py) for r in spatial.convex_hull(spark.createDataFrame(pts, "g int, px double, py double"), "g").collect()}
    assert got == {(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)}


def test_attribute_tests(spark):
    df = spark.createDataFrame([("10",), ("10.0000000001",), ("abc",), (None,)], "f string")
    n = lambda op, v=None: pixel.extract_by_attribute(df, "f", op, v).count()
    assert (n("=", "10"), n("begins", "a"), n("null"), n(">", "9"), n("contains", "b")) == (2, 1, 1, 3, 1)


def test_metadata_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text('GROUP = X\n  SUN_ELEVATION = 41.5\n  SPACECRAFT_ID = "SAT_8"\nEND\n')
    r = rasters.key_values(spark, str(tmp_path / "a.txt"), ["SUN_ELEVATION", "SPACECRAFT_ID"]).first()
    assert (r["SUN_ELEVATION"], r["SPACECRAFT_ID"]) == ("41.5", "SAT_8")
    (tmp_path / "b.xml").write_text("<root><meta><quant>10000</quant><zenith>30.5</zenith></meta></root>")
    assert rasters.xml_rows(spark, str(tmp_path / "b.xml"), "meta").first()["quant"] == 10000
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"p"},"geometry":{"type":"Point","coordinates":[1.0,2.0]}}]}')
    assert rasters.read_features(spark, str(tmp_path / "c.json"), "geojson").first()["properties"]["name"] == "p"
    rasters.write_pixels(row(spark, [1, math.nan]), str(tmp_path / "px"))
    assert by_x(rasters.read_pixels(spark, str(tmp_path / "px"))) == [1.0, None]


def test_chain_checks(spark):
    from gridloom.plans import table_queries  # noqa: F401  registers operators

    df = row(spark, [1, 2])
    for bad in (dict(k=0), dict(q=1)):
        with pytest.raises(ValueError):
            chain.apply("mean", df, **bad)
    with pytest.raises(ValueError):
        chain.apply("threshold", df)
    assert chain.schema("mean")["k"]["range"] == (1, 99)

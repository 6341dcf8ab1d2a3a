import math
import random

import numpy as np
import pytest

from gridloom.functions.projections import between, forward, inverse
from gridloom.operators.warp import Grid, located, traced, warp

SYSTEMS = ["geographic", "mercator", "sinusoidal", "utm:33", "utm:31s"]


@pytest.mark.parametrize("crs", SYSTEMS)
def test_projections_undo_themselves(crs):
    zone = 15 if crs == "utm:33" else 3
    lon, lat = np.meshgrid(np.linspace(zone - 3, zone + 3, 13), np.linspace(-70, 70, 29))
    back = inverse(crs, *forward(crs, lon, lat, np), np)
    assert np.abs(back[0] - lon).max() < 1e-7 and np.abs(back[1] - lat).max() < 1e-7


def test_known_places():
    """Half the equator, the zone's middle, and the meridian arc to the pole on a sphere."""
    assert forward("mercator", 180.0, 0.0, np) == pytest.approx([math.pi * 6378137, 0], abs=1e-6)
    assert forward("utm:33", 15.0, 0.0, np) == pytest.approx([500000, 0], abs=1e-6)
    assert forward("utm:33s", 15.0, 0.0, np) == pytest.approx([500000, 10000000], abs=1e-6)
    assert forward("utm:31", 0.0, 0.0, np) == pytest.approx([166021.443, 0], abs=1e-2)
    assert forward("sinusoidal", 77.0, 90.0, np)[1] == pytest.approx(math.pi / 2 * 6371007.181)


CASES = [
    (Grid("sinusoidal", 0.0, 6000000.0, 5000.0, -5000.0, 40, 60), Grid("geographic", 0.0, 54.0, 0.05, -0.05, 70, 60)),
    (Grid("geographic", 13.0, 50.0, 0.02, -0.02, 60, 50), Grid("utm:33", 380000.0, 5540000.0, 2000.0, -2000.0, 50, 55)),
    (Grid("utm:33", 500000.0, 5500000.0, 1000.0, -1000.0, 50, 50), Grid("sinusoidal", 1060000.0, 5520000.0, 900.0, -900.0, 60, 60)),
    (Grid("geographic", 0.0, 10.0, 0.1, -0.1, 60, 60), Grid("mercator", 0.0, 1118890.0, 100000.0, -100000.0, 8, 12)),
]


def one_by_one(values, source, target, method):
    """Each target pixel by itself."""
    out = {}
    for y in range(target.height):
        for x in range(target.width):
            r, c = source.place(*between(target.crs, source.crs, *target.centre(y, x), np))
            if method == "nearest":
                taps = [(math.floor(r + 0.5), math.floor(c + 0.5), 1.0)]
            else:
                w = (lambda d: max(1 - d, 0)) if method == "bilinear" else (lambda d: 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0)
                span = (0, 1) if method == "bilinear" else (-1, 0, 1, 2)
                taps = [(math.floor(r) + a, math.floor(c) + b, w(abs(r - math.floor(r) - a)) * w(abs(c - math.floor(c) - b))) for a in span for b in span]
            got = [(values[i, j], w) for i, j, w in taps if (i, j) in values]
            if sum(w for _, w in got) > 1e-12:
                out[y, x] = sum(v * w for v, w in got) / sum(w for _, w in got)
    return out


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_pixel_by_pixel(spark, case, method):
    source, target = CASES[case]
    rng = random.Random(case)
    values = {(y, x): rng.random() for y in range(source.height) for x in range(source.width) if rng.random() < 0.95}
    df = spark.createDataFrame([(y, x, v) for (y, x), v in values.items()] + [(0, 0, None)] * ((0, 0) not in values), "y long, x long, value double")
    want = one_by_one(values, source, target, method)
    assert len(want) > target.width * target.height / 20
    got = {(r.y, r.x): r.value for r in warp(df, source, target, method, tolerance=0, tile=16).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tiles_leave_no_seam_and_classes_stay_whole(spark):
    source, target = CASES[0]
    df = spark.range(source.height * source.width).selectExpr(f"id div {source.width} AS y", f"id % {source.width} AS x", "cast(id % 7 AS int) AS value", "cast(id AS double) AS b2")
    sets = [sorted(map(tuple, warp(df, source, target, "cubic", ["value", "b2"], categorical=True, tolerance=0, tile=t).collect())) for t in (7, 64, 256)]
    assert sets[0] == sets[1] == sets[2] and {type(r[2]) for r in sets[0]} == {int}


@pytest.mark.parametrize("tolerance", [0.5, 0.125, 0.01])
def test_control_points_keep_their_bound(tolerance):
    for source, target in CASES:
        rows, cols = np.arange(0, target.height), np.arange(0, target.width)
        r, c, error = located(source, target, rows, cols, tolerance)
        exact = traced(source, target, rows.astype(float), cols.astype(float))
        ok = np.isfinite(exact[0])
        assert error <= tolerance
        assert max(np.abs(r - exact[0])[ok].max(), np.abs(c - exact[1])[ok].max()) <= max(1.1 * error, 1e-9)


def test_strong_reduction_reads_no_more_than_its_taps(spark):
    """A target pixel of 40 x 40 source pixels: tiles are so small that footprints stay bounded."""
    source, target = Grid("geographic", 0.0, 0.0, 0.001, -0.001, 2000, 2000), Grid("mercator", 0.0, 0.0, 4453.0, -4453.0, 49, 49)
    df = spark.range(2000 * 2000).selectExpr("id div 2000 AS y", "id % 2000 AS x", "cast(id div 2000 + id % 2000 AS double) AS value")
    out = warp(df, source, target, "bilinear", tolerance=0)
    for r in out.sample(0.05, seed=1).collect():
        i, j = source.place(*between("mercator", "geographic", *target.centre(r.y, r.x), np))
        assert r.value == pytest.approx(i + j, abs=1e-6)
    assert out.count() == 49 * 49


def test_empty(spark):
    assert warp(spark.createDataFrame([], "y long, x long, value double"), *CASES[0]).count() == 0

import random

import pytest

from gridloom.operators import morphology, tiles
from gridloom.operators.morphology import by_reconstruction, profile, reconstruct, shaped


@pytest.fixture(params=[4, 64])
def tile(request, monkeypatch):
    monkeypatch.setattr(morphology, "TILE", request.param)
    monkeypatch.setattr(tiles, "SIZE", request.param)


def scene(spark, seed=1, h=14, w=17):
    rng = random.Random(seed)
    px = {(y, x): float(rng.randint(0, 9)) if rng.random() < 0.95 else None for y in range(h) for x in range(w)}
    return px, spark.createDataFrame([(y, x, v) for (y, x), v in px.items()], "y long, x long, value double")


def brute(px, how, radius, shape):
    if how in ("open", "close"):
        a, b = ("erode", "dilate") if how == "open" else ("dilate", "erode")
        return brute(brute(px, a, radius, shape), b, radius, shape)
    f = min if how == "erode" else max
    near = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if shape == "square" or a * a + b * b <= radius * radius]
    return {p: None if v is None else f(px[q] for a, b in near if px.get(q := (p[0] + a, p[1] + b)) is not None) for p, v in px.items()}


def grown(marker, mask):
    """Dilation and cut, again and again."""
    g = {p: min(marker[p], mask[p]) for p in mask if mask[p] is not None and marker.get(p) is not None}
    while True:
        new = {}
        for p, m in mask.items():
            near = [g[q] for a in (-1, 0, 1) for b in (-1, 0, 1) if (q := (p[0] + a, p[1] + b)) in g]
            if m is not None and near:
                new[p] = min(max(near), m)
        if new == g:
            return {p: g.get(p) for p in mask}
        g = new


@pytest.mark.parametrize("shape", ["ball", "square"])
def test_elements(spark, tile, shape):
    px, df = scene(spark)
    for how, radius in (("erode", 2), ("dilate", 3), ("open", 1), ("close", 2)):
        assert {(r.y, r.x): r.value for r in shaped(df, how, radius, shape).collect()} == brute(px, how, radius, shape)


def test_reconstruction_winds_through_tiles(spark, tile):
    """One marker in a spiral corridor, with walls and holes."""
    h, w = 13, 13
    wall = {(y, x) for y in range(h) for x in range(w) if y % 2 and not (x == (0 if y % 4 == 1 else w - 1))}
    mask = {(y, x): None if (y, x) in {(5, 4), (9, 5)} else 1.0 if (y, x) in wall else 8.0 for y in range(h) for x in range(w)}
    marker = {p: 9.0 if p == (0, 5) else None if p[0] > 9 else 0.0 for p in mask}
    df = spark.createDataFrame([(*p, marker[p], mask[p]) for p in mask], "y long, x long, marker double, mask double")
    got = {(r.y, r.x): r.value for r in reconstruct(df).collect()}
    assert got == grown(marker, mask) and got[12, 6] == 8.0


def test_profile(spark, tile):
    px, df = scene(spark, 2)
    out = {(r.y, r.x): r for r in profile(df, [1, 2]).collect()}
    for radius, name, last in ((1, "p1", px), (2, "p2", None)):
        want = grown(brute(px, "erode", radius, "ball"), px)
        assert {p: r[name] for p, r in out.items()} == want
    assert all(r.d2 == abs(r.p2 - r.p1) for r in out.values() if r.p1 is not None)
    low = {p: None if v is None else -v for p, v in px.items()}
    want = grown(brute(low, "erode", 1, "ball"), low)
    assert {(r.y, r.x): r.value for r in by_reconstruction(df, "close", 1).collect()} == {p: None if v is None else -v for p, v in want.items()}


def test_empty(spark):
    assert reconstruct(spark.createDataFrame([], "y long, x long, marker double, mask double")).count() == 0

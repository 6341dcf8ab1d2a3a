import math
import random

import pytest

from gridloom.operators import components, lines
from gridloom.operators.components import labels
from gridloom.operators.lines import contour_lines, region_polygons, region_rings


@pytest.fixture(params=[4, 64])
def tile(request, monkeypatch):
    monkeypatch.setattr(lines, "TILE", request.param)
    monkeypatch.setattr(components, "TILE", request.param)


def area(points):
    return sum(a.x * b.y - b.x * a.y for a, b in zip(points, points[1:] + points[:1])) / 2


def crossings(points, y):
    """Columns at which the ring's vertical edges cross the row's middle."""
    return [a.x for a, b in zip(points, points[1:] + points[:1]) if a.x == b.x and min(a.y, b.y) <= y < max(a.y, b.y)]


def test_rings_fill_their_regions(spark, tile):
    rng = random.Random(3)
    px = {(y, x): rng.choice([1, 1, 2]) for y in range(13) for x in range(17) if rng.random() < 0.95}
    df = spark.createDataFrame([(y, x, c) for (y, x), c in px.items()], "y long, x long, label int")
    lab = {(r.y, r.x): r.region for r in labels(df).collect()}
    rings = region_rings(labels(df)).collect()
    for region in set(lab.values()):
        own = [r for r in rings if r.region == region]
        assert sum(r.area for r in own) == sum(v == region for v in lab.values()) and sum(not r.hole for r in own) == 1
        for r in own:
            p = r.points
            assert area(p) == r.area and r.hole == (r.area < 0)
            # corners only, sides along the axes
            for a, b, c in zip(p, p[1:] + p[:1], p[2:] + p[:2]):
                assert (a.x == b.x) != (a.y == b.y) and (a.x == b.x) != (b.x == c.x)
        for y in range(13):
            cross = sorted(c for r in own for c in crossings(r.points, y))
            inside = {x for x in range(17) if sum(c <= x for c in cross) % 2}
            assert inside == {x for x in range(17) if lab.get((y, x)) == region}
    polygons = region_polygons(labels(df)).collect()
    assert {p.region: 1 + len(p.holes) for p in polygons} == {g: sum(r.region == g for r in rings) for g in set(lab.values())}
    assert any(p.holes for p in polygons)


def test_pixels_that_touch_at_a_corner(spark, tile):
    """A ring around a diagonal pair of holes, and a region that closes on itself at a corner."""
    gone = {(1, 1), (2, 2)}
    df = spark.createDataFrame([(y, x, 1) for y in range(4) for x in range(4) if (y, x) not in gone], "y long, x long, label int")
    rings = region_rings(labels(df)).collect()
    assert sum(r.area for r in rings) == 14 and [r.area for r in rings if not r.hole] == [16]


def test_contours(spark, tile):
    rng = random.Random(5)
    px = {(y, x): rng.choice([rng.uniform(0, 30), rng.randint(0, 3) * 10.0]) for y in range(12) for x in range(15) if rng.random() < 0.95}
    df = spark.createDataFrame([(y, x, v) for (y, x), v in px.items()], "y long, x long, value double")
    got = contour_lines(df, 10.0).collect()
    cells = {(y, x) for y, x in px if all((y + a, x + b) in px for a in (0, 1) for b in (0, 1))}
    crossed = {}
    for y, x in px:
        for dy, dx in ((0, 1), (1, 0)):
            q = (y + dy, x + dx)
            beside = [(y, x), (y - dx, x - dy)]
            n = sum(b in cells for b in beside)
            if q in px and n:
                for k in range(4):
                    level = 10.0 * k
                    if (px[y, x] >= level) != (px[q] >= level):
                        f = (level - px[y, x]) / (px[q] - px[y, x])
                        at = (level, round(x + 0.5 + f * dx, 9), round(y + 0.5 + f * dy, 9))
                        crossed[at, y, x, dy] = n
    ends = sorted(k[0] for k, n in crossed.items() if n == 1)
    seen = sorted((r.level, round(p.x, 9), round(p.y, 9)) for r in got if not r.closed for p in (r.points[0], r.points[-1]))
    assert seen == ends, "open lines end where cells do, and only there"
    on = {k[0] for k in crossed}
    for r in got:
        assert len(r.points) >= 2 or r.closed or len({(p.x, p.y) for p in r.points}) == 1  # a peak of the level itself is one place
        for p in r.points:
            assert (r.level, round(p.x, 9), round(p.y, 9)) in on


def test_a_cone_has_round_contours(spark, tile):
    df = spark.range(41 * 41).selectExpr("id div 41 AS y", "id % 41 AS x").selectExpr("y", "x", "20 - sqrt(pow(y - 20, 2) + pow(x - 20, 2)) AS value")
    got = contour_lines(df, 5.0, base=0.5).filter("level > 0 AND level < 19").collect()
    assert sorted(r.level for r in got) == [0.5, 5.5, 10.5, 15.5] and all(r.closed for r in got)
    for r in got:
        assert all(abs(math.hypot(p.x - 20.5, p.y - 20.5) - (20 - r.level)) < 0.1 for p in r.points)


def test_empty(spark):
    assert region_rings(spark.createDataFrame([], "y long, x long, region long")).count() == 0
    assert contour_lines(spark.createDataFrame([], "y long, x long, value double"), 1.0).count() == 0

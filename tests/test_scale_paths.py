"""Exact order statistics by refinement, Jenks over all values, ranks, rings, tiles: against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import focal, ml, rings, spatial, stats, tiles


def table(spark, values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v double")


@pytest.mark.parametrize("most", [5, 10**6])
def test_order_statistics(spark, most):
    rng = random.Random(1)
    values = [rng.choice([0.0, 7.0, -3.5, rng.gauss(0, 1e6), rng.random() * 1e-9]) for _ in range(3000)]
    df = table(spark, [*values, None, math.nan])
    want = sorted(values)
    ranks = [0, 1, 1499, 1500, 2998, 2999, 40]
    assert stats.order_statistics(df, "v", ranks, most=most, bins=16) == [want[r] for r in ranks]
    got = stats.quantiles(df, "v", [0, 0.1, 0.5, 0.999, 1])
    assert got == pytest.approx(list(np.quantile(want, [0, 0.1, 0.5, 0.999, 1])), rel=1e-12)
    assert stats.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_jenks_against_all_breaks(spark):
    rng = random.Random(3)
    values = [float(rng.choice([1, 2, 3, 8, 9, 20, 21, 22, 40])) for _ in range(200)]
    kinds = sorted(set(values))

    def cost(ends):
        parts = [[v for v in values if lo < v <= hi] for lo, hi in zip([-1e9, *ends], [*ends, 1e9])]
        return sum(np.var(p) * len(p) for p in parts if p)

    best = min(itertools.combinations(kinds[:-1], 3), key=cost)
    assert stats.jenks(table(spark, values), "v", 4) == [*best, kinds[-1]]
    many = [rng.gauss(c, 1) for c in (0, 50, 200) for _ in range(3000)]
    got = stats.jenks(table(spark, many), "v", 3, bins=512)
    assert got == [max(many[:3000]), max(many[3000:6000]), max(many)]
    assert stats.jenks(table(spark, []), "v", 3) == []


def test_ranked_by_group(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", None, "b"]), rng.randrange(5)) for k in range(4000)]
    got = ml.ranked(spark.createDataFrame(rows, "id long, g string, v int").repartition(7), "g", ["v", "id"]).collect()
    want = {}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted([r for r in rows if r[1] == g], key=lambda r: (r[2], r[0]))):
            want[r[0]] = n
    assert {r.id: r._rank for r in got} == want and {r.g: r._many for r in got} == {g: sum(r[1] == g for r in rows) for g in ("a", "b", None)}


def test_group_split_keeps_regions_whole(spark):
    df = spark.range(600).selectExpr("id", "cast(id % 2 AS int) AS c", "id div 7 AS roi")
    got = ml.stratified_split(df, "id", "c", group="roi").groupBy("roi").agg(F.count_distinct("train").alias("n")).filter("n > 1").count()
    assert got == 0


def test_ring_relations():
    square = lambda x, y, s: np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], float)
    rel = lambda a, b, **k: rings.relation(a, b, **k)
    a = square(0, 0, 4)
    assert rel(a, a[::-1]) == {"intersects", "within", "contains", "equals"}
    assert rel(a, square(4, 1, 2)) == {"intersects", "touches"} and rel(a, square(4, 4, 2)) == {"intersects", "touches"}
    assert rel(a, square(9, 0, 1)) == {"disjoint"}
    assert rel(square(0, 1, 2), a) == {"intersects", "within"} and rel(a, square(1, 1, 1)) == {"intersects", "contains"}
    assert rel(a, square(2, 2, 4)) == {"intersects", "overlaps"}
    ell = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)
    assert rel(ell, square(2, 2, 1)) == {"disjoint"} and rel(ell, square(1, 1, 3)) == {"intersects", "touches"} and rel(ell, a) == {"intersects", "within"}
    line = lambda *p: np.array(p, float)
    assert rel(line((-1, 2), (5, 2)), a, line=True) == {"intersects", "crosses"} and rel(line((1, 1), (2, 3)), a, line=True) == {"intersects", "within"}
    assert rel(line((0, -1), (0, 5)), a, line=True) == {"intersects", "touches"} and rel(line((6, 0), (7, 1)), a, line=True) == {"disjoint"}


def test_predicates_that_make_no_sense_raise(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "id long, ring array<struct<x:double,y:double>>")
    with pytest.raises(ValueError):
        rings.rings_meet(df, df, 1.0, "crosses")
    with pytest.raises(KeyError):
        spatial.boxes_meet(*[spark.sql("SELECT 1 AS id, 0D AS x0, 0D AS y0, 1D AS x1, 1D AS y1")] * 2, 1.0, "crosses")
    assert rings.rings_meet(df.limit(0), df, 1.0).count() == 0


def test_tiles_join_without_seams(spark, monkeypatch):
    """Tiles of 8 pixels give what one tile gives, holes included."""
    rng = random.Random(9)
    rows = [(y, x, rng.choice([None, rng.random()])) for y in range(37) for x in range(29) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "y long, x long, value double")
    ops = [lambda d: focal.median_filter(d, 5), lambda d: focal.mean_filter(d, 3), lambda d: focal.fill_nodata(d, 3), lambda d: focal.proximity(d, "value > 0.9", 4).withColumnRenamed("distance", "value"), lambda d: focal.mean_shift(d.filter("value is not null"), 2, 0.3)]
    one = [sorted((r.y, r.x, r.value) for r in op(df).collect()) for op in ops]
    monkeypatch.setattr(tiles, "SIZE", 8)
    for op, want in zip(ops, one):
        got = sorted((r.y, r.x, r.value) for r in op(df).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-9) for a, b in zip(got, want))


def test_fits(spark):
    pts = [(10, 20), (120, 30), (15, 140), (130, 150), (70, 90)]
    a, b = 3**0.5, 1.0
    df = spark.createDataFrame([(float(x), float(y), a * x - b * y - 100, b * x + a * y + 50) for x, y in pts], "px double, py double, mx double, my double")
    r = stats.helmert_fit(df, "px", "py", "mx", "my").first()
    assert (r.x0, r.y0, r.scale, r.rotation) == pytest.approx((-100, 50, 2, math.pi / 6), abs=1e-8)
    flat = spark.createDataFrame([(5.0, 5.0, float(k), float(k)) for k in range(4)], df.schema)
    assert stats.helmert_fit(flat, "px", "py", "mx", "my").first().scale is None and stats.linear_fit(flat, "px", "py", "mx", "my").first().sx is None
    with pytest.raises(ValueError):
        stats.projective_fit(flat, "px", "py", "mx", "my")


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels_over_tiles(spark, monkeypatch, diagonal):
    """Regions over tiles of 8 pixels, holes and missing classes included, against a plain flood."""
    from gridloom.operators import components

    rng = random.Random(13)
    cells = {(y, x): rng.choice([1, 1, 2, None]) for y in range(40) for x in range(33) if rng.random() < 0.95}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    want, width = {}, 1000
    for at in sorted(cells):
        if at in want:
            continue
        want[at], todo = at[0] * width + at[1], [at]
        while todo and cells[at] is not None:
            y, x = todo.pop()
            for a, b in steps:
                n = (y + a, x + b)
                if n not in want and cells.get(n) == cells[at]:
                    want[n] = want[at]
                    todo.append(n)
    monkeypatch.setattr(components, "TILE", 8)
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "y long, x long, label int")
    got = {(r.y, r.x): r.region for r in components.labels(df, "label", diagonal, width).collect()}
    assert got == want
    seeds = df.filter("y = 20 AND label = 1").select("y", "x")
    ones = df.filter("label = 1")
    hit = {want[k] for k in cells if k[0] == 20 and cells[k] == 1}
    assert {(r.y, r.x) for r in components.reach(ones, seeds, diagonal).collect()} == {k for k in cells if cells[k] == 1 and want[k] in hit}
    assert components.labels(df.limit(0)).count() == 0

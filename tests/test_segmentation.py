import math
import random

import pytest

from gridloom.operators import components, segmentation, tiles
from gridloom.operators.segmentation import basins, lsms, merge_small, mode_regions, modes, watershed

W = 1 << 31


@pytest.fixture(params=[6, 64])
def tile(request, monkeypatch):
    for module, name in ((tiles, "SIZE"), (components, "TILE"), (segmentation, "TILE")):
        monkeypatch.setattr(module, name, request.param)
    return request.param


def scene(spark, h, w, seed, bands=2, holes=0.05, digits=None):
    rng = random.Random(seed)
    px = {}
    for y in range(h):
        for x in range(w):
            base = 20.0 * ((y // 6 + x // 7) % 3)
            v = tuple(None if rng.random() < holes else round(base + rng.uniform(0, 12), digits) if digits is not None else base + rng.uniform(0, 12) for _ in range(bands))
            if rng.random() > holes / 2:
                px[y, x] = v
    cols = [f"b{k + 1}" for k in range(bands)]
    return px, cols, spark.createDataFrame([(y, x, *v) for (y, x), v in px.items()], "y long, x long, " + ", ".join(f"{c} double" for c in cols))


def one_mode(px, p, radius, spread, iterations, least):
    if p not in px or None in px[p]:
        return None
    my, mx, v = 0.0, 0.0, px[p]
    n = 0
    for _ in range(iterations):
        near = []
        for y in range(p[0] + math.floor(my - radius), p[0] + math.ceil(my + radius) + 1):
            for x in range(p[1] + math.floor(mx - radius), p[1] + math.ceil(mx + radius) + 1):
                q = px.get((y, x))
                if q is not None and None not in q and (y - p[0] - my) ** 2 + (x - p[1] - mx) ** 2 <= radius**2 and sum((a - b) ** 2 for a, b in zip(q, v)) <= spread**2:
                    near.append((y - p[0], x - p[1], q))
        n += 1
        if not near:
            break
        k = len(near)
        new = (sum(q[0] for q in near) / k, sum(q[1] for q in near) / k, tuple(sum(q[2][b] for q in near) / k for b in range(len(v))))
        shift = (new[0] - my) ** 2 + (new[1] - mx) ** 2 + sum((a - b) ** 2 for a, b in zip(new[2], v))
        my, mx, v = new
        if shift <= least**2:
            break
    return (*v, p[0] + my, p[1] + mx, n)


def test_modes_by_brute_force(spark, tile):
    px, cols, df = scene(spark, 14, 17, 1)
    for radius, spread, iterations in ((2, 8.0, 4), (1.5, 100.0, 3), (3, 5.0, 1)):
        got = {(r.y, r.x): tuple(r)[2:] for r in modes(df, cols, radius, spread, iterations, 0.1).collect()}
        assert got.keys() == px.keys()
        for p in px:
            want = one_mode(px, p, radius, spread, iterations, 0.1)
            assert got[p] == (None,) * 5 if want is None else all(abs(a - b) < 1e-9 for a, b in zip(got[p], want)), (p, got[p], want)


def grouped(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def neighbours(p, diagonal=False):
    for dy, dx in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else []):
        yield p[0] + dy, p[1] + dx


def brute_lsms(px, radius, spread, iterations, least):
    mode = {p: one_mode(px, p, radius, spread, iterations, 0.1) for p in px}
    b = len(next(iter(px.values())))
    edges = []
    for p in px:
        for q in neighbours(p):
            m, n = mode[p], mode.get(q)
            if m and n and (m[b] - n[b]) ** 2 + (m[b + 1] - n[b + 1]) ** 2 <= radius**2 and sum((m[k] - n[k]) ** 2 for k in range(b)) <= spread**2:
                edges.append((p, q))
    seg = grouped(px, edges)
    first = dict(seg)
    while True:
        size, mean = {}, {}
        for p, s in seg.items():
            size[s] = size.get(s, 0) + 1
            mean.setdefault(s, [0.0] * b)
            for k in range(b):
                mean[s][k] += mode[p][k] if mode[p] else 0.0
        near = {}
        for p in px:
            for q in neighbours(p):
                if q in seg and seg[p] != seg[q]:
                    near.setdefault(seg[p], set()).add(seg[q])
                    near.setdefault(seg[q], set()).add(seg[p])
        small = [s for s in size if size[s] < least and s in near]
        if not small:
            return first, seg
        low = min(size[s] for s in small)
        far = lambda s, t: sum((mean[s][k] / size[s] - mean[t][k] / size[t]) ** 2 for k in range(b))
        to = [(s, min(near[s], key=lambda t: (far(s, t), t))) for s in small if size[s] == low]
        seg = (lambda m: {p: m[s] for p, s in seg.items()})(grouped(size, to))


def test_lsms_by_brute_force(spark, tile):
    px, cols, df = scene(spark, 13, 15, 2)
    first, want = brute_lsms(px, 2, 9.0, 3, 6)
    found = mode_regions(modes(df, cols, 2, 9.0, 3, 0.1), cols, 2, 9.0)
    assert {(r.y, r.x): divmod(r.region, W) for r in found.collect()} == first
    got = {(r.y, r.x): divmod(r.segment_id, W) for r in lsms(df, cols, 2, 9.0, 3, 6).collect()}
    assert got == want and len(set(want.values())) > 3


def test_regions_without_neighbours_stay(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 0), (5, 5, 2.0, 1)], "y long, x long, b double, region long")
    assert sorted(r.segment_id for r in merge_small(df, ["b"], 50).collect()) == [0, 1]


def flood(px, width=W):
    """A flood from all minima, pixel after pixel in order of height."""
    seg = {}
    for p in sorted(px, key=lambda p: (px[p], p)):
        around = [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (p[0] + a, p[1] + b) in seg]
        seg[p] = seg[min(around, key=lambda q: (px[q], q))] if around else p
    return seg


def one_by_one(px, depth):
    """Passes in ascending order; the side with the higher minimum decides whether they stay one."""
    seg = flood(px)
    passes = {}
    for p in px:
        for q in neighbours(p, True):
            if q in px and seg[p] != seg[q]:
                k = tuple(sorted((seg[p], seg[q])))
                passes[k] = min(passes.get(k, math.inf), max(px[p], px[q]))
    root = {s: s for s in set(seg.values())}
    low = {s: px[s] for s in root}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    kept = []
    for (a, b), h in sorted(passes.items(), key=lambda e: (e[1], e[0])):
        u, v = find(a), find(b)
        if u != v:
            if h - max(low[u], low[v]) <= depth:
                kept.append((a, b))
            root[max(u, v)] = min(u, v)
            low[min(u, v)] = min(low[u], low[v])
    joined = grouped(root, kept)
    return {p: joined[s] for p, s in seg.items()}


def test_watershed_is_a_flood(spark, tile):
    for seed, digits in ((1, None), (2, 0)):
        px, _, df = scene(spark, 14, 18, seed, 1, 0.05, digits)
        px = {p: v[0] for p, v in px.items() if v[0] is not None}
        df = df.withColumnRenamed("b1", "value")
        assert {(r.y, r.x): divmod(r.region, W) for r in basins(df).collect()} == flood(px)
        if digits is None:
            for depth in (3.0, 1000.0):
                assert {(r.y, r.x): divmod(r.segment_id, W) for r in watershed(df, depth).collect()} == one_by_one(px, depth)


def test_flats_are_one_segment(spark, tile):
    df = spark.range(30 * 30).selectExpr("id div 30 AS y", "id % 30 AS x", "cast(abs(id % 30 - 15) < 2 AS double) * 5 AS value")
    assert {r.segment_id for r in watershed(df, 0.0).collect()} == {0, 17}


def test_empty(spark):
    none = spark.createDataFrame([], "y long, x long, value double")
    assert watershed(none, 1.0).count() == 0 and lsms(none, ["value"], 2, 3.0, 2, 4).count() == 0

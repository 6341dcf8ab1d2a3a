"""Relations of whole batches, and the join that brings pairs together."""

import numpy as np

from gridloom.operators import rings as R


def shape(r):
    """A diamond, a frame with a part beside it, or a triangle, on a lattice where they often touch."""
    x, y = (float(v) for v in r.integers(0, 8, 2))
    box = lambda a, b, w: np.array([(a, b), (a + w, b), (a + w, b + w), (a, b + w)])
    kind = r.integers(0, 3)
    if kind == 0:
        n = float(r.integers(1, 5))
        return [np.array([(x + n, y), (x, y + n), (x - n, y), (x, y - n)])]
    return [box(x, y, 5.0), box(x + 1, y + 1, 3.0), box(x + 6, y, 2.0)] if kind == 1 else [np.array([(x, y), (x + 3, y), (x, y + 4)])]


def batch(shapes, closed=True):
    parts = [p for s in shapes for p in s]
    return R._Rings(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), np.cumsum([0, *map(len, shapes)]), closed)


def test_batch_is_pair_by_pair(monkeypatch):
    r = np.random.default_rng(6)
    a, b = ([shape(r) for _ in range(300)] for _ in range(2))
    found = R._relations(batch(a), batch(b), False)
    one = [R.relation(x, y) for x, y in zip(a, b)]
    assert [{k for k, v in found.items() if v[n]} for n in range(300)] == one
    assert {"touches", "within", "overlaps", "disjoint"} <= set().union(*one)
    monkeypatch.setattr(R, "STEP", 5)
    cut = R._relations(batch(a), batch(b), False)
    assert all((cut[k] == found[k]).all() for k in found)


def test_pairs_are_dealt_over_tasks(spark):
    ring = lambda x, y: [[{"x": x, "y": y}, {"x": x + 1, "y": y}, {"x": x, "y": y + 1}]]
    rows = [(k, ring(float(k % 5), float(k % 3))) for k in range(40)]
    a = spark.createDataFrame(rows, "id long, ring array<array<struct<x: double, y: double>>>").coalesce(1)
    found = R.rings_relate(a, a, 16.0)
    assert "SortMergeJoin [c" in found._jdf.queryExecution().toString()
    assert R.rings_meet(a, a, 16.0, "equals").count() == sum(x == y for _, x in rows for _, y in rows)


def test_predicates_by_boxes_first(spark):
    """Boxes rule pairs out before the test of rings: the same pairs as without."""
    r = np.random.default_rng(8)
    rows = [(n, [[{"x": float(x), "y": float(y)} for x, y in p] for p in shape(r)]) for n in range(150)]
    rows += [(n + 500, [[{"x": q["x"] + 1e-12, "y": q["y"]} for q in p] for p in g]) for n, g in rows[:60]]  # equal but for rounding
    a = spark.createDataFrame(rows, "id long, ring array<array<struct<x: double, y: double>>>")
    found = R.rings_relate(a, a, 4.0).collect()
    for name in ("equals", "within", "contains", "overlaps"):
        want = sorted((x.aid, x.bid) for x in found if name in x.predicates)
        assert sorted(map(tuple, R.rings_meet(a, a, 4.0, name).collect())) == want and len(want) > 100

"""Polygons with holes and parts, and crowded cells."""

import numpy as np

from gridloom.operators import rings as R


def box(x, y, w, h=None):
    h = h or w
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], dtype=float)


def test_holes_and_parts():
    plate, hole = box(0, 0, 10), box(3, 3, 4)
    ring = [plate, hole]
    assert R.relation(hole, ring) == {"intersects", "touches"}
    assert R.relation(box(4, 4, 1), ring) == {"disjoint"}
    assert R.relation(plate, ring) == {"intersects", "contains"}
    assert R.relation(ring, plate) == {"intersects", "within"}
    assert R.relation(box(2, 2, 2), ring) == {"intersects", "overlaps"}
    assert R.relation(box(1, 1, 1), ring) == {"intersects", "within"}
    assert R.relation(box(2, 2, 6), ring) == {"intersects", "overlaps"}  # covers the hole
    assert R.relation(ring, [hole[::-1], plate[::-1]]) == {"intersects", "within", "contains", "equals"}
    assert R.relation([box(0, 0, 1), box(5, 0, 1)], [box(0, 0, 1), box(9, 0, 1)]) == {"intersects", "overlaps"}  # a part in common
    assert R.relation([box(0, 0, 1), box(5, 0, 1)], [box(5, 0, 1), box(0, 0, 1), box(9, 0, 1)]) == {"intersects", "within"}
    assert R.relation(np.array([(-1.0, 5), (11, 5)]), ring, line=True) == {"intersects", "crosses"}
    assert R.relation(np.array([(4.0, 5), (6, 5)]), ring, line=True) == {"disjoint"}


def test_cell_sets():
    """Random unions of unit cells in each other's way: shells, holes and corners that touch."""
    r = np.random.default_rng(3)

    def shape():
        cells = {(int(x), int(y)) for x, y in r.integers(0, 4, size=(r.integers(2, 9), 2))}
        kept = set()
        for c in sorted(cells):  # parts that meet nowhere, so that rings are simple
            if all(max(abs(c[0] - k[0]), abs(c[1] - k[1])) > 1 for k in kept):
                kept.add(c)
        return kept

    for _ in range(60):
        a, b = shape(), shape()
        corners = [{(x + i, y + j) for x, y in s for i in (0, 1) for j in (0, 1)} for s in (a, b)]
        want = {"intersects"} if corners[0] & corners[1] else {"disjoint"}
        if corners[0] & corners[1] and not a & b:
            want |= {"touches"}
        if a & b:
            want |= {k for k, ok in (("within", a <= b), ("contains", b <= a), ("equals", a == b), ("overlaps", not a <= b and not b <= a)) if ok}
        assert R.relation([box(*c, 1) for c in a], [box(*c, 1) for c in b]) == want, (a, b)


def test_crowded_cell_is_cut_and_changes_nothing(spark):
    r = np.random.default_rng(4)
    ring = lambda x, y, w: [[{"x": float(p), "y": float(q)} for p, q in box(x, y, w)]]
    kind = "id long, ring array<array<struct<x: double, y: double>>>"
    rows = [[(k, ring(*r.integers(0, 12, 2), 2)) for k in range(n)] for n in (120, 90)]
    odd = [(900, None), (901, []), (902, [[]]), (903, [[{"x": 1.0, "y": 1.0}]])]
    a, b = (spark.createDataFrame(x + odd, kind) for x in rows)
    all_in_one = sorted(map(tuple, R.rings_relate(a, b, 1000.0).select("aid", "bid").collect()))
    cut = sorted(map(tuple, R.rings_relate(a, b, 1000.0, most=7).select("aid", "bid").collect()))
    want = sorted((i, j) for i, p in rows[0] for j, q in rows[1] if abs(p[0][0]["x"] - q[0][0]["x"]) <= 2 and abs(p[0][0]["y"] - q[0][0]["y"]) <= 2)
    assert all_in_one == cut == want
    assert R.rings_meet(a.limit(0), b, 5.0).count() == 0

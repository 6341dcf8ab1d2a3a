"""Exact relations of polygons and lines, on candidate pairs from a cell join.

Geometries are rings ``array<struct<x, y>>`` (simple, not closed by a repeated
point) or open lines of the same type, or ``array`` of those: a polygon's shells
and holes in any order and direction, insides by the even-odd rule, or the parts
of a line.  A boundary is cut where it meets the other one; each piece lies
inside, outside or on it, and where it lies on it, the two sides of the piece
tell which insides meet there.  These few facts decide every predicate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .spatial import cells

PREDICATES = ("intersects", "disjoint", "contains", "within", "touches", "overlaps", "equals", "crosses")


#: Numbers that a step of `_relations` holds at once for each of its arrays.
STEP = 50_000


class _Rings:
    """Geometries of a batch as segments: those of geometry k are ``begin[at[k]:at[k + 1]]`` to ``end[..]``."""

    def __init__(self, points: np.ndarray, rings: np.ndarray, geometries: np.ndarray, closed: bool):
        """``rings`` are offsets into the points, ``geometries`` offsets into the rings."""
        follows = np.arange(1, len(points) + 1)
        last = np.zeros(len(points), dtype=bool)
        there = rings[1:] > rings[:-1]
        follows[rings[1:][there] - 1], last[rings[1:][there] - 1] = rings[:-1][there], True
        kept = np.flatnonzero(~last) if not closed else np.arange(len(points))
        self.begin, self.end = points[kept], points[follows[kept]]
        self.at = np.searchsorted(kept, rings[geometries])

    @classmethod
    def of(cls, column: pa.ListArray, closed: bool) -> _Rings:
        inner = column.flatten()
        points = inner.flatten()
        xy = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in (points.type.get_field_index("x"), points.type.get_field_index("y"))], axis=1).astype(float)
        offsets = [np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) for c in (inner, column)]
        return cls(xy, offsets[0], offsets[1], closed)

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """x and y of begins and ends, each (segments, rows), of geometries that have equally many segments."""
        at = self.at[rows] + np.arange(self.at[rows[0] + 1] - self.at[rows[0]])[:, None]
        return tuple(p[at, k] for p in (self.begin, self.end) for k in (0, 1))


def _within(x: np.ndarray, y: np.ndarray, of: np.ndarray, rings: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each point, on no boundary, is inside geometry ``of`` by the even-odd rule over all rings."""
    ax, ay, bx, by = (g[:, of] for g in rings)
    return _odd(x, y, ax, ay, bx - ax, by)


def _odd(x, y, ax, ay, dx, by) -> np.ndarray:
    spans = (ay > y) != (by > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.logical_xor.reduce(spans & (x < ax + (y - ay) * dx / (by - ay)), axis=0)


def _side(x: np.ndarray, y: np.ndarray, of: np.ndarray, rings: tuple[np.ndarray, ...], tiny: np.ndarray) -> np.ndarray:
    """1 inside, 0 on the boundary, -1 outside of geometry ``of``, for each point."""
    most = max(1, 16 * STEP // len(rings[0]))
    if len(x) > most:
        return np.concatenate([_side(x[k : k + most], y[k : k + most], of[k : k + most], rings, tiny) for k in range(0, len(x), most)])
    ax, ay, bx, by = (g[:, of] for g in rings)
    dx, dy, tx, ty = bx - ax, by - ay, x - ax, y - ay
    t = np.clip((tx * dx + ty * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
    near = ((tx - t * dx) ** 2 + (ty - t * dy) ** 2 <= tiny[of] ** 2).any(axis=0)
    return np.where(near, 0, np.where(_odd(x, y, ax, ay, dx, by), 1, -1))


def _pieces(parts: tuple[np.ndarray, ...], rings: tuple[np.ndarray, ...], scale: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner, middle (x, y) and unit normal (x, y) of the pieces into which ``rings`` cut the boundaries or lines ``parts``."""
    n, most = len(parts[0]), max(1, 4 * STEP // rings[0].size)
    found = [_cut(tuple(g[k : k + most] for g in parts), rings, scale) for k in range(0, n, most)]
    px, py, qx, qy = parts
    lone = np.flatnonzero(((px == qx) & (py == qy)).all(axis=0))  # all points in one place
    found.append((lone, px[0, lone], py[0, lone], np.zeros(len(lone)), np.zeros(len(lone))))
    return tuple(map(np.concatenate, zip(*found)))


def _cut(parts: tuple[np.ndarray, ...], rings: tuple[np.ndarray, ...], scale: np.ndarray) -> tuple[np.ndarray, ...]:
    """`_pieces` of segments that are longer than 0."""
    px, py, qx, qy = parts
    cx, cy, ex, ey = (g[:, None] for g in rings)
    ux, uy = qx - px, qy - py
    vx, vy, wx, wy = ex - cx, ey - cy, cx - px, cy - py
    square = ux * ux + uy * uy
    cross, off = ux * vy - uy * vx, wx * uy - wy * ux
    with np.errstate(divide="ignore", invalid="ignore"):
        t, s = (wx * vy - wy * vx) / cross, off / cross
        along = (wx * ux + wy * uy) / square
        hit = (np.abs(cross) > 1e-12) & (t >= 0) & (t <= 1) & (s >= -1e-12) & (s <= 1 + 1e-12)
        # corners that lie on a parallel piece, or so near to it that a cut does no harm
        beside = (np.abs(off) <= 1e-6 * scale * np.sqrt(square)) & (along > 0) & (along < 1)
    long = square > 0
    cut = (hit | beside).any(axis=0) & long
    k, own = np.nonzero(long & ~cut)
    i, j = np.nonzero(cut)
    cuts = np.concatenate([np.where(hit[:, i, j], t[:, i, j], 0.0), np.where(beside[:, i, j], along[:, i, j], 0.0), np.zeros((1, len(i))), np.ones((1, len(i)))]).T.copy()
    cuts.sort(axis=1)
    row, n = np.nonzero(cuts[:, 1:] > cuts[:, :-1])
    k, own = np.concatenate([k, i[row]]), np.concatenate([own, j[row]])
    at = np.concatenate([np.full(len(k) - len(row), 0.5), (cuts[row, n] + cuts[row, n + 1]) / 2])
    dx, dy, length = ux[k, own], uy[k, own], np.sqrt(square[k, own])
    return own, px[k, own] + at * dx, py[k, own] + at * dy, -dy / length, dx / length


def _facts(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], line: bool) -> dict[str, np.ndarray]:
    """Which predicates hold for each pair of geometries, all of one number of segments a side."""
    size = a[0].shape[1]
    scale = np.maximum(1.0, np.max([np.abs(g).max(axis=0) for g in (*a, *b)], axis=0))
    tiny = 1e-9 * scale

    def some(own, which):
        out = np.zeros(size, dtype=bool)
        out[own[which]] = True
        return out

    def touched(x, y, rings):
        own = np.tile(np.arange(size), len(x))
        return some(own, _side(x.ravel(), y.ravel(), own, rings, tiny) == 0)

    own, mx, my, nx, ny = _pieces(a, b, scale)
    of_a = _side(mx, my, own, b, tiny)
    on = of_a == 0
    touch = some(own, on) | touched(*a[:2], b)
    if line:
        touch |= touched(*a[2:], b)
        inside, outside = some(own, of_a == 1), some(own, of_a == -1)
        met = inside | touch
        return {"intersects": met, "disjoint": ~met, "crosses": inside & outside, "within": inside & ~outside, "touches": met & ~inside}
    own_b, bx, by, _, _ = _pieces(b, a, scale)
    of_b = _side(bx, by, own_b, a, tiny)
    touch |= touched(*b[:2], a)
    one, step = own[on], 1e-7 * scale[own[on]]
    x, y = (np.concatenate([m[on] + step * n[on], m[on] - step * n[on]]) for m, n in ((mx, nx), (my, ny)))
    one = np.concatenate([one, one])
    in_a, in_b = _within(x, y, one, a), _within(x, y, one, b)
    share = some(own, of_a == 1) | some(own_b, of_b == 1) | some(one, in_a & in_b)
    a_out = some(own, of_a == -1) | some(own_b, of_b == 1) | some(one, in_a & ~in_b)
    b_out = some(own_b, of_b == -1) | some(own, of_a == 1) | some(one, in_b & ~in_a)
    within, contains = share & ~a_out, share & ~b_out
    return {"intersects": share | touch, "disjoint": ~(share | touch), "within": within, "contains": contains, "equals": within & contains, "touches": touch & ~share, "overlaps": share & ~within & ~contains}


def _relations(a: _Rings, b: _Rings, line: bool) -> dict[str, np.ndarray]:
    """Which predicates hold for each pair (k-th of ``a``, k-th of ``b``); pairs of equally many segments go together."""
    n, m = np.diff(a.at), np.diff(b.at)
    out = {k: np.zeros(len(n), dtype=bool) for k in (("intersects", "disjoint", "crosses", "within", "touches") if line else PREDICATES[:-1])}
    kind = n * (m.max(initial=0) + 1) + m
    order = np.argsort(kind, kind="stable") if (kind != kind[:1]).any() else np.arange(len(kind))
    for rows in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        step = max(1, STEP // int(n[rows[0]] * m[rows[0]])) if len(rows) else 1
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            for name, held in _facts(a.taken(some), b.taken(some), line).items():
                out[name][some] = held
    return out


def relation(a, b, line: bool = False) -> set[str]:
    """All predicates that hold for polygon (or line) ``a`` and polygon ``b``, each one ring or a list of rings."""

    def one(g, closed):
        parts = [np.asarray(r, dtype=float) for r in (g if isinstance(g, list) else [g])]
        return _Rings(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), np.array([0, len(parts)]), closed)

    return {k for k, held in _relations(one(a, not line), one(b, True), line).items() if held[0]}


def _sides(a: DataFrame, b: DataFrame) -> list[DataFrame]:
    """Both tables with ``ring`` as a list of parts and their boxes; geometries without a part of two points are left out."""
    out = []
    for k, df in (("a", a), ("b", b)):
        parts = F.col("ring") if isinstance(df.schema["ring"].dataType.elementType, ArrayType) else F.when(F.col("ring").isNotNull(), F.array("ring"))
        rows = df.select(F.col("id").alias(f"{k}id"), F.filter(parts, lambda r: F.size(r) > 1).alias(f"{k}ring")).filter(F.size(f"{k}ring") > 0)
        points = F.flatten(f"{k}ring")
        x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        out.append(rows.withColumns({f"{k}x0": F.array_min(x), f"{k}y0": F.array_min(y), f"{k}x1": F.array_max(x), f"{k}y1": F.array_max(y)}))
    return out


def _blocked(met: list[DataFrame], most: int) -> DataFrame:
    """Rows of both sides joined on their cell ``c``.

    Rows are counted per cell.  A cell with over ``most`` rows of a side is cut
    into blocks of about ``most``: every block of one side meets every block of
    the other, so that no task holds a whole crowded cell.
    """
    counts = [m.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(f"_{k}")) for k, m in zip("ab", met)]
    hot = counts[0].join(counts[1], "c").filter("_a > 1 OR _b > 1")
    blocks = []
    for k, other, m in zip("ab", "ba", met):
        of = m.join(hot, "c", "left").withColumn("_own", F.pmod(F.xxhash64(f"{k}id"), F.coalesce(f"_{k}", F.lit(1))))
        blocks.append(of.withColumn("_met", F.explode(F.sequence(F.lit(0), F.coalesce(f"_{other}", F.lit(1)) - 1))).drop("_a", "_b"))
    one = blocks[0].withColumnsRenamed({"_own": "_p", "_met": "_q"})
    two = blocks[1].withColumnsRenamed({"_own": "_q", "_met": "_p"}).withColumn("_p", F.col("_p").cast("bigint"))
    # shuffled however small the tables' files are: the pairs of one file's rows are work for many tasks
    return one.withColumn("_q", F.col("_q").cast("bigint")).join(two.hint("merge"), ["c", "_p", "_q"])


def _candidates(sides: list[DataFrame], size: float, most: int) -> DataFrame:
    """Pairs whose boxes meet, each once."""
    met = [s.withColumn("c", F.explode(cells(F.col(f"{k}x0"), F.col(f"{k}y0"), F.col(f"{k}x1"), F.col(f"{k}y1"), size))) for k, s in zip("ab", sides)]
    pairs = _blocked(met, most)
    pairs = pairs.filter((F.col("c.cx") == F.floor(F.greatest("ax0", "bx0") / size)) & (F.col("c.cy") == F.floor(F.greatest("ay0", "by0") / size)))
    return pairs.filter((F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1")))


def _same_boxes(sides: list[DataFrame], size: float, most: int) -> DataFrame:
    """Pairs whose boxes have their lower and their upper corners in the same cells, each once; ``a`` takes all cells that its corners are nearly in."""
    names = ("x0", "y0", "x1", "y1")
    met = []
    for k, s in zip("ab", sides):
        room = 1e-6 * F.greatest(F.lit(1.0), *[F.abs(F.col(f"{k}{c}")) for c in names]) if k == "a" else F.lit(0.0)
        # the third shifts cells' edges off whole numbers, where corners like to be
        near = lambda x, y, k=k, room=room: cells(*[F.col(f"{k}{c}") + size / 3 + sign * room for sign in (-1, 1) for c in (x, y)], size)
        low = s.withColumn("_low", F.explode(near("x0", "y0"))).withColumn("_high", F.explode(near("x1", "y1")))
        met.append(low.withColumn("c", F.struct("_low", "_high")).drop("_low", "_high"))
    return _blocked(met, most)


def _likely(pairs: DataFrame, predicate: str) -> DataFrame:
    """Candidates less those whose boxes rule the predicate out, with room for what counts as on a boundary."""
    room = 1e-6 * F.greatest(F.lit(1.0), *[F.abs(F.col(f"{k}{c}")) for k in "ab" for c in ("x0", "y0", "x1", "y1")])
    inside = lambda k, o: (F.col(f"{k}x0") >= F.col(f"{o}x0") - room) & (F.col(f"{k}y0") >= F.col(f"{o}y0") - room) & (F.col(f"{k}x1") <= F.col(f"{o}x1") + room) & (F.col(f"{k}y1") <= F.col(f"{o}y1") + room)
    for k, o, which in (("a", "b", ("within", "equals")), ("b", "a", ("contains", "equals"))):
        if predicate in which:
            pairs = pairs.filter(inside(k, o))
    return pairs


def _tested(pairs: DataFrame, line: bool, schema: str, kept) -> DataFrame:
    """``kept(aid, bid, facts)`` of each batch of candidate pairs."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                facts = _relations(_Rings.of(batch.column(2), not line), _Rings.of(batch.column(3), True), line)
                yield kept(batch.column(0), batch.column(1), facts)

    return pairs.select("aid", "bid", "aring", "bring").mapInArrow(run, schema)


def rings_relate(a: DataFrame, b: DataFrame, size: float, line: bool = False, most: int = 5_000) -> DataFrame:
    """``(aid, bid, predicates)`` of the pairs of ``a(id, ring)`` and polygons ``b(id, ring)`` that meet: the names that hold, sorted.

    Repeated ids give repeated rows.  Null geometries and those without two
    points in any part meet nothing.
    """
    sides = _sides(a, b)

    def kept(aid, bid, facts):
        met = facts["intersects"]
        names = sorted(facts)
        held = np.stack([facts[n][met] for n in names], axis=1)
        ends = np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, pa.array(np.array(names, dtype=object)[np.nonzero(held)[1]], pa.string()))
        return pa.RecordBatch.from_arrays([aid.filter(pa.array(met)), bid.filter(pa.array(met)), lists], names=["aid", "bid", "predicates"])

    kinds = {k: s.schema[f"{k}id"].dataType.simpleString() for k, s in zip("ab", sides)}
    return _tested(_candidates(sides, size, most), line, f"aid {kinds['a']}, bid {kinds['b']}, predicates array<string>", kept)


def rings_meet(a: DataFrame, b: DataFrame, size: float, predicate: str = "intersects", line: bool = False, most: int = 5_000) -> DataFrame:
    """``(aid, bid)`` of ``a(id, ring)`` and polygons ``b(id, ring)`` under a predicate of ``PREDICATES``.

    With ``line`` the geometries of ``a`` are open lines.  Two polygons never
    cross (raises).  Cells of side ``size`` bring boxes together, a pair is
    tested in the cell that holds the lower corner of the boxes' common part,
    and ``disjoint`` is what the cell join does not find: a stated set ``a``
    against all of ``b``, whose output is nearly their product.
    """
    if predicate not in PREDICATES or (predicate == "crosses" and not line):
        raise ValueError(f"{predicate} is not defined for these geometries")
    wanted = "intersects" if predicate == "disjoint" else predicate
    sides = _sides(a, b)

    def kept(aid, bid, facts):
        held = pa.array(facts.get(wanted, np.zeros(len(aid), dtype=bool)))
        return pa.RecordBatch.from_arrays([aid.filter(held), bid.filter(held)], names=["aid", "bid"])

    kinds = {k: s.schema[f"{k}id"].dataType.simpleString() for k, s in zip("ab", sides)}
    pairs = _same_boxes(sides, size / 64, most) if predicate == "equals" else _candidates(sides, size, most)
    found = _tested(_likely(pairs, predicate), line, f"aid {kinds['a']}, bid {kinds['b']}", kept)
    if predicate != "disjoint":
        return found
    return sides[0].select("aid").crossJoin(sides[1].select("bid")).join(found, ["aid", "bid"], "left_anti")

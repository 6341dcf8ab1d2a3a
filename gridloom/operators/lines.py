"""Lines over tiles: region boundaries as rings, and contour lines.

A tile turns its pixels into short directed segments whose ends carry keys, so
that the segment that goes on from an end has that key as its start, and traces
them into chains.  Chains that leave their tile meet by the keys, one equi join;
which line a chain belongs to follows from `settled`, and its place in the line
from list ranking by pointer doubling.  Everything between tiles works on one
row a chain.  Lines are the same for every tile size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import _drop, _written, settled

#: Side of a tile.
TILE = 256
POINTS = "array<struct<x: double, y: double>>"
CHAIN = f"grp double, id bigint, head bigint, tail bigint, closed boolean, points {POINTS}, ex double, ey double, twice double"


def _chains(seg: pd.DataFrame, simplify: bool = True) -> pd.DataFrame:
    """Segments ``(grp, id, a, b, ax, ay, bx, by)`` of a tile traced from end key to start key.

    A chain has the id and start key of its first segment, the end key of its
    last, the points at which its direction changes (all, without ``simplify``), and twice the signed area
    that its segments sweep from the origin.
    """
    names = ["grp", "id", "head", "tail", "closed", "points", "ex", "ey", "twice"]
    if seg.empty:
        return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
    seg = seg.sort_values("id", kind="stable").reset_index(drop=True)
    seg["k"] = np.arange(len(seg))
    after = seg[["grp", "b", "k"]].merge(seg[["grp", "a", "k"]], left_on=["grp", "b"], right_on=["grp", "a"], suffixes=("", "_next"))
    follows = np.full(len(seg), -1)
    follows[after["k"].to_numpy()] = after["k_next"].to_numpy()
    first = np.ones(len(seg), bool)
    first[follows[follows >= 0]] = False
    seen, follows = np.zeros(len(seg), bool), follows.tolist()
    ax, ay, bx, by = (seg[c].to_numpy() for c in ("ax", "ay", "bx", "by"))
    swept = ax * by - bx * ay
    out = []
    for start in [*np.flatnonzero(first).tolist(), *range(len(seg))]:
        if seen[start]:
            continue
        chain, k = [], start
        while k >= 0 and not seen[k]:
            seen[k] = True
            chain.append(k)
            k = follows[k]
        closed = k == start
        c = np.array(chain)
        p = c if not simplify else c[(ax[c] != bx[c]) | (ay[c] != by[c])]  # a crossing at a pixel's centre has no length
        if simplify and len(p):
            dx, dy = bx[p] - ax[p], by[p] - ay[p]
            turn = np.roll(dx, 1) * dy != np.roll(dy, 1) * dx
            turn[0] |= not closed
            p = p[turn]
        p = p if len(p) else c[:1]
        points = [{"x": float(x), "y": float(y)} for x, y in zip(ax[p], ay[p])]
        last = c[-1]
        out.append((seg["grp"].iat[start], seg["id"].iat[start], seg["a"].iat[start], seg["b"].iat[last], closed, points, bx[last], by[last], float(swept[c].sum())))
    return pd.DataFrame(out, columns=names)


def _placed(chains: DataFrame) -> DataFrame:
    """``chains`` with ``line`` (the least chain id of its line), ``left`` (chains from it to the line's end) and ``ring`` (the line is closed)."""
    loose = chains.filter("NOT closed")
    links = _written(loose.select(F.col("id").alias("u"), "grp", F.col("tail").alias("key")).join(loose.select(F.col("id").alias("v"), "grp", F.col("head").alias("key")), ["grp", "key"]).select("u", "v"))
    line = settled(links)
    named = loose.select("id").join(line.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("r", "id").alias("line"))
    named = _written(named.join(links.withColumnRenamed("u", "id"), "id", "left").withColumnRenamed("v", "next"))
    rings = named.groupBy("line").agg((F.count("next") == F.count(F.lit(1))).alias("ring"))  # every chain has one after it
    step = named.join(rings, "line").select("id", "line", "ring", F.when(~F.col("ring") | (F.col("next") != F.col("line")), F.col("next")).alias("next"), F.lit(1).cast("bigint").alias("left"))
    step = _written(step)
    while not step.filter("next IS NOT NULL").isEmpty():
        further = step.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("left").alias("_l"))
        old, step = step, _written(step.join(further, "next", "left").select("id", "line", "ring", F.col("_n").alias("next"), (F.col("left") + F.coalesce("_l", F.lit(0))).alias("left")))
        _drop(old)
    _drop(links, named)
    out = chains.join(step.select("id", "line", "ring", "left"), "id", "left")
    return out.withColumns({"line": F.coalesce("line", "id"), "ring": F.coalesce("ring", "closed"), "left": F.coalesce("left", F.lit(1).cast("bigint"))})


def _corners(points: Column, ring: Column) -> Column:
    """Points at which a line turns: joints of chains on straight stretches and repeated points go; an open line keeps its ends, a ring of one place that place."""

    def moved(p: Column, k: Column) -> Column:
        before = F.get(points, F.when(k > 0, k - 1).otherwise(F.size(points) - 1))
        return (p["x"] != before["x"]) | (p["y"] != before["y"]) | (~ring & (k == 0))

    apart = F.filter(points, moved)
    n = F.size(apart)

    def turns(p: Column, k: Column) -> Column:
        before, after = F.get(apart, (k - 1 + n) % n), F.get(apart, (k + 1) % n)
        bent = (p["x"] - before["x"]) * (after["y"] - p["y"]) != (p["y"] - before["y"]) * (after["x"] - p["x"])
        return bent | (~ring & ((k == 0) | (k == n - 1)))

    out = F.filter(apart, turns)
    return F.when(F.size(out) > 0, out).otherwise(F.slice(points, 1, 1))


def _assembled(chains: DataFrame, simplify: bool = True) -> DataFrame:
    """``(grp, line, ring, twice, points)``: one row a line."""
    placed = _placed(_written(chains))
    got = placed.groupBy("grp", "line", "ring").agg(F.sum("twice").alias("twice"), F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("o"), "points", "ex", "ey"))).alias("parts"))
    points = F.flatten(F.transform("parts", lambda p: p["points"]))
    last = F.element_at("parts", -1)
    whole = F.when(F.col("ring"), points).otherwise(F.concat(points, F.array(F.struct(last["ex"].alias("x"), last["ey"].alias("y")))))
    out = got.select("grp", "line", "ring", "twice", whole.alias("points"))
    return out.withColumn("points", _corners(F.col("points"), F.col("ring"))) if simplify else out


def _haloed(df: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Pixels in their tile and in those within ``before`` pixels behind, ``after`` pixels ahead of which they lie."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - after) / size), F.floor((F.col(c) + before) / size)))
    return df.withColumn("_ty", span("y")).withColumn("_tx", span("x"))


# --- region boundaries

#: Sides of a pixel, clockwise on the screen: neighbour beyond, start and end corner (row, column), and the corner pixels that meet at the end.
SIDES = [((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0))]


def region_rings(lab: DataFrame, region: str = "region") -> DataFrame:
    """``(region, ring, hole, area, points)``: the boundary rings of 4-connected regions of ``lab(y, x, region)``.

    Pixel (y, x) is the unit square with corner (x, y).  A ring keeps its region
    on the right on a screen whose rows go down, so a shell's signed area is
    positive and a hole's negative: the areas of a region's rings add up to its
    pixels.  Rings do not cross: where two pixels of a region touch at a corner
    only, each keeps to its own pixel.  ``points`` are the corners, the first not
    repeated.  A ring is one row.
    """
    size = TILE

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        oy, ox = int(key[0]) * size - 1, int(key[1]) * size - 1
        names, code = np.unique(pdf["r"].to_numpy(), return_inverse=True)
        r = np.full((size + 2, size + 2), -1)
        r[pdf["y"].to_numpy() - oy, pdf["x"].to_numpy() - ox] = code
        y, x = np.nonzero(r[1:-1, 1:-1] >= 0)
        y, x = y + 1, x + 1
        own = r[y, x]
        parts = []
        for side, ((dy, dx), a, b) in enumerate(SIDES):
            edge = r[y + dy, x + dx] != own
            ys, xs, o = y[edge], x[edge], own[edge]
            gy, gx = ys + oy, xs + ox
            keys = []
            for cy, cx in (a, b):
                # pixels of the region at this corner: only this one and the one across?
                across = r[ys + 2 * cy - 1, xs + 2 * cx - 1] == o
                beside = (r[ys + 2 * cy - 1, xs] == o) | (r[ys, xs + 2 * cx - 1] == o)
                slot = np.where(across & ~beside, 1 + (1 - cy) * 2 + (1 - cx), 0)  # which pixel of the corner's four
                keys.append(((gy + cy) * (1 << 30) + gx + cx) * 5 + slot)
            parts.append(pd.DataFrame({"grp": names[o].astype(float), "id": (gy * (1 << 30) + gx) * 4 + side, "a": keys[0], "b": keys[1], "ax": (gx + a[1]).astype(float), "ay": (gy + a[0]).astype(float), "bx": (gx + b[1]).astype(float), "by": (gy + b[0]).astype(float)}))
        return _chains(pd.concat(parts, ignore_index=True))

    px = lab.filter(F.col(region).isNotNull()).select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col(region).cast("bigint").alias("r"))
    found = _assembled(_haloed(px, size, 1, 1).groupBy("_ty", "_tx").applyInPandas(run, CHAIN))
    return found.select(F.col("grp").cast("bigint").alias(region), F.col("line").alias("ring"), (F.col("twice") < 0).alias("hole"), (F.col("twice") / 2).alias("area"), "points")


def region_polygons(lab: DataFrame, region: str = "region") -> DataFrame:
    """``(region, shell, holes)``: a region's one shell and its holes, as rings, of 4-connected regions."""
    rings = region_rings(lab, region)
    holes = F.transform(F.sort_array(F.collect_list(F.when(F.col("hole"), F.struct("ring", "points")))), lambda h: h["points"])
    return rings.groupBy(region).agg(F.first(F.when(~F.col("hole"), F.col("points")), ignorenulls=True).alias("shell"), holes.alias("holes"))


# --- contour lines

#: Segments of a cell by which of its corners (top left 1, top right 2, bottom right 4, bottom left 8) are high: sides 0 top, 1 right, 2 bottom, 3 left,
#: directed with the high side on the right of the way on a screen whose rows go down.  5 and 10 are the saddles: their first pair holds where the middle is high.
CELLS = {1: [(0, 3)], 2: [(1, 0)], 3: [(1, 3)], 4: [(2, 1)], 6: [(2, 0)], 7: [(2, 3)], 8: [(3, 2)], 9: [(0, 2)], 11: [(1, 2)], 12: [(3, 1)], 13: [(0, 1)], 14: [(3, 0)]}
SADDLES = {5: ([(0, 1), (2, 3)], [(0, 3), (2, 1)]), 10: ([(3, 0), (1, 2)], [(1, 0), (3, 2)])}


def contour_lines(df: DataFrame, interval: float, base: float = 0.0, simplify: bool = True) -> DataFrame:
    """``(level, line, closed, points)``: lines of equal value of ``df(y, x, value)`` at base + k x interval.

    Values stand at pixel centres (x + 0.5, y + 0.5); a cell between four of them
    with a value is crossed on sides whose ends differ, at the linearly
    interpolated place; a corner is high where value >= level, and a saddle
    follows its mean.  A line, named within its level, is closed or ends where cells do.  The high side is
    on the right of the way on a screen whose rows go down.  Crossings on straight
    stretches are left out unless ``simplify`` is off.
    """
    size = TILE

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        oy, ox = int(key[0]) * size, int(key[1]) * size
        v = np.full((size + 1, size + 1), np.nan)
        v[pdf["y"].to_numpy() - oy, pdf["x"].to_numpy() - ox] = pdf["value"].to_numpy(dtype=float)
        corner = np.stack([v[:-1, :-1], v[:-1, 1:], v[1:, 1:], v[1:, :-1]])
        y, x = np.nonzero(np.isfinite(corner).all(axis=0))
        c = corner[:, y, x]
        low, high = np.ceil((c.min(axis=0) - base) / interval), np.floor((c.max(axis=0) - base) / interval)
        n = np.maximum(high - low + 1, 0).astype(int)
        each = np.repeat(np.arange(len(y)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[each]
        level = base + k * interval
        c, gy, gx = c[:, each], y[each] + oy, x[each] + ox
        code = ((c >= level) * np.array([[1], [2], [4], [8]])).sum(axis=0)
        middle = c.mean(axis=0) >= level
        parts = []
        for kind, pairs, where in [(q, p, None) for q, p in CELLS.items()] + [(q, p[not m], m) for q, p in SADDLES.items() for m in (True, False)]:
            at = np.flatnonzero((code == kind) & (True if where is None else middle == where))
            for j, (s, t) in enumerate(pairs):
                ends = []
                for side in (s, t):
                    # the side's corners in a fixed order, so that both its cells see the same place
                    p, q = [(0, 1), (1, 2), (3, 2), (0, 3)][side]
                    f = (level[at] - c[p][at]) / (c[q][at] - c[p][at])
                    sy, sx = gy[at] + (side == 2), gx[at] + (side == 1)
                    along = side in (0, 2)
                    ends.append(((sy * (1 << 30) + sx) * 2 + (not along), sx + 0.5 + (f if along else 0), sy + 0.5 + (0 if along else f)))
                parts.append(pd.DataFrame({"grp": k[at], "id": (gy[at] * (1 << 30) + gx[at]) * 2 + j, "a": ends[0][0], "b": ends[1][0], "ax": ends[0][1], "ay": ends[0][2], "bx": ends[1][1], "by": ends[1][2]}))
        return _chains(pd.concat(parts, ignore_index=True), simplify)

    px = df.select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("value").cast("double").alias("value"))
    chains = _haloed(px, size, 0, 1).groupBy("_ty", "_tx").applyInPandas(run, CHAIN)
    # a chain's id is of its cell: the level makes it one of a kind
    found = _assembled(chains.withColumn("id", F.struct("grp", "id")), simplify)
    return found.select((F.lit(base) + F.col("grp") * interval).alias("level"), F.col("line.id").alias("line"), F.col("ring").alias("closed"), "points")

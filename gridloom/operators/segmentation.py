"""Segmentation of scenes of any size: mode seeking and watersheds.

Both start on tiles and end on a graph of regions.  What a tile computes depends
on a stated neighbourhood alone, which it is given as a halo, so results are the
same for every tile size; regions that meet over tile borders are joined by
their ids, and everything after that works on one row a region and one row a
pair of neighbouring regions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import _drop, _spread, _written, grown, settled
from .tiles import by_tiles

# --- mean shift


def _mode_seeker(cols: list[str], radius: float, spread: float, iterations: int, least: float):
    """Kernel of `modes` for `by_tiles`; places are kept relative to a mode's own pixel, so that no tile rounds differently."""
    near = int(radius)

    def kernel(arrays: dict[str, np.ndarray], halo: int) -> list[np.ndarray]:
        stack = np.stack([arrays[c] for c in cols])
        there = np.isfinite(stack).all(axis=0)
        height, width = stack.shape[1] - 2 * halo, stack.shape[2] - 2 * halo
        own = there[halo : halo + height, halo : halo + width]
        y, x = (v + halo for v in np.nonzero(own))
        place, value = np.zeros((2, len(y))), stack[:, y, x]
        steps, active = np.zeros(len(y)), np.arange(len(y))
        for _ in range(iterations):
            if not len(active):
                break
            at, v = place[:, active], value[:, active]
            base = np.floor(at).astype(int)
            count, moved, mixed = np.zeros(len(active)), np.zeros((2, len(active))), np.zeros((len(cols), len(active)))
            for a in range(-near, near + 2):
                for b in range(-near, near + 2):
                    dy, dx = base[0] + a, base[1] + b
                    i, j = y[active] + dy, x[active] + dx
                    inside = (i >= 0) & (i < stack.shape[1]) & (j >= 0) & (j < stack.shape[2]) & ((dy - at[0]) ** 2 + (dx - at[1]) ** 2 <= radius**2)
                    i, j = np.where(inside, i, 0), np.where(inside, j, 0)
                    w = stack[:, i, j]
                    with np.errstate(invalid="ignore"):
                        use = inside & there[i, j] & (((w - v) ** 2).sum(axis=0) <= spread**2)
                    count += use
                    moved += np.where(use, np.stack([dy, dx]), 0)
                    mixed += np.where(use, w, 0)
            some = count > 0
            place[:, active[some]], value[:, active[some]] = moved[:, some] / count[some], mixed[:, some] / count[some]
            shift = np.zeros(len(active))
            shift[some] = ((place[:, active[some]] - at[:, some]) ** 2).sum(axis=0) + ((value[:, active[some]] - v[:, some]) ** 2).sum(axis=0)
            steps[active] += 1
            active = active[shift > least**2]
        out = [np.full((height, width), np.nan) for _ in range(len(cols) + 3)]
        for o, found in zip(out, [*value, *place, steps]):
            o[own] = found
        return out

    return kernel


def modes(df: DataFrame, cols: list[str], radius: float = 5, spread: float = 15.0, iterations: int = 10, least: float = 0.1) -> DataFrame:
    """``(y, x, cols.., my, mx, steps)``: the mode that every pixel climbs to, its values and its place.

    A step moves a mode to the mean place and mean values of the pixels within
    ``radius`` of its place and within ``spread`` of its values (Euclidean over
    ``cols``); it ends after ``iterations`` steps, or when a step is shorter than
    ``least``.  A path stays within iterations x radius of its pixel: that is the
    tiles' halo.  Pixels with a missing value in a column have null modes and
    count for none.
    """
    halo = max(1, int(np.ceil(iterations * radius)))
    out = by_tiles(df, cols, halo, _mode_seeker(cols, radius, spread, iterations, least), [*cols, "_dy", "_dx", "steps"], border="none")
    return out.select("y", "x", *cols, (F.col("y") + F.col("_dy")).alias("my"), (F.col("x") + F.col("_dx")).alias("mx"), F.col("steps").cast("int").alias("steps"))


def mode_regions(found: DataFrame, cols: list[str], radius: float, spread: float) -> DataFrame:
    """``(y, x, cols.., region)`` from `modes`: 4-connected pixels whose modes lie within ``radius`` of each other in place and within ``spread`` in values."""

    def alike(a: dict, b: dict):
        place = (a["my"] - b["my"]) * (a["my"] - b["my"]) + (a["mx"] - b["mx"]) * (a["mx"] - b["mx"])
        value = sum([(a[c] - b[c]) * (a[c] - b[c]) for c in cols[1:]], (a[cols[0]] - b[cols[0]]) * (a[cols[0]] - b[cols[0]]))
        return (place <= radius * radius) & (value <= spread * spread)

    return grown(found.select("y", "x", *cols, "my", "mx"), [*cols, "my", "mx"], alike).drop("my", "mx")


def adjacent(lab: DataFrame, region: str = "region") -> DataFrame:
    """``(u, v)``, both ways, of regions with 4-neighbouring pixels."""
    one = _spread(lab.select("y", "x", F.col(region).alias("u")), [(0, 1), (1, 0)]).join(lab.select("y", "x", F.col(region).alias("v")), ["y", "x"]).filter("u <> v").select("u", "v").distinct()
    return one.union(one.select("v", "u")).distinct()


def _renamed(df: DataFrame, roots: DataFrame, *names: str) -> DataFrame:
    """Region ids in ``names`` replaced by what ``roots(u, r)`` says, where it says something."""
    for c in names:
        df = df.join(roots.select(F.col("u").alias(c), F.col("r").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    return df


def merge_small(lab: DataFrame, cols: list[str], least: int) -> DataFrame:
    """``(y, x, segment_id)`` from ``lab(y, x, cols.., region)``: regions under ``least`` pixels join neighbours.

    Sizes are taken in ascending order: all regions of the smallest size below
    ``least`` that have a neighbour join the one with the nearest mean values
    (ties: the smaller id), as these stood before; then sizes and means are taken
    anew.  Each round works on regions and neighbour pairs alone.  A region
    without neighbours stays.
    """
    lab = _written(lab.select("y", "x", *cols, "region"))
    regions = _written(lab.groupBy(F.col("region").alias("u")).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols]))
    edges, names = _written(adjacent(lab)), _written(regions.select(F.col("u").alias("region"), F.col("u").alias("segment_id")))
    while True:
        size = regions.filter(F.col("n") < least).join(edges, "u", "left_semi").agg(F.min("n")).first()[0]
        if size is None:
            return lab.join(names, "region").select("y", "x", "segment_id")
        other = regions.select(F.col("u").alias("v"), *[(F.col(c) / F.col("n")).alias(f"_{c}") for c in cols])
        far = sum([F.pow(F.col(c) / F.col("n") - F.col(f"_{c}"), F.lit(2.0)) for c in cols], F.lit(0.0))
        to = regions.filter(F.col("n") == size).join(edges, "u").join(other, "v").groupBy("u").agg(F.min_by("v", F.struct(far.alias("d"), F.col("v"))).alias("v"))
        roots = settled(to)
        old = regions, edges, names
        regions = _written(_renamed(regions, roots, "u").groupBy("u").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols]))
        edges = _written(_renamed(edges, roots, "u", "v").filter("u <> v").distinct())
        names = _written(_renamed(names, roots, "segment_id"))
        _drop(*old)


def lsms(df: DataFrame, cols: list[str], radius: float = 5, spread: float = 15.0, iterations: int = 10, least: int = 50, threshold: float = 0.1) -> DataFrame:
    """``(y, x, segment_id)``: large-scale mean-shift segmentation, `modes`, `mode_regions` and `merge_small` in turn.  A pixel with a missing value is a region of its own."""
    found = _written(modes(df, cols, radius, spread, iterations, threshold))
    return merge_small(mode_regions(found, cols, radius, spread), cols, least)


# --- watershed

#: Side of the tiles on which water runs and saddles are taken.
TILE = 256


def _with_halo(df: DataFrame, size: int, halo: int = 1) -> DataFrame:
    """Pixels in their tile of ``size`` (``_ty, _tx``) and in those within ``halo`` pixels of them."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)))
    return df.withColumn("_ty", span("y")).withColumn("_tx", span("x"))


def _dense(pdf: pd.DataFrame, key: tuple, name: str, fill: float | int, size: int) -> np.ndarray:
    out = np.full((size + 2, size + 2), fill)
    out[pdf["y"].to_numpy() - int(key[0]) * size + 1, pdf["x"].to_numpy() - int(key[1]) * size + 1] = pdf[name].to_numpy()
    return out


def basins(df: DataFrame, width: int = 1 << 31) -> DataFrame:
    """``(y, x, value, region)``: the minimum that water reaches from every pixel; a region's id is its minimum's ``y * width + x``.

    Water runs to the lowest of the 8 neighbours, of equals to the first by
    rows, until no neighbour is lower; this is what a flood from all minima in
    the order (value, row, column) fills.  Equal neighbours count as lower in
    that order, so a flat may hold several minima; `watershed` joins them.  Pixels
    without a value have no row.
    """
    size = TILE
    pixels = df.select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("value").cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = _dense(pdf, key, "value", np.inf, size)
        place = np.arange(v.size).reshape(v.shape)
        best, to = np.full((size, size), np.inf), place[1:-1, 1:-1].copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                w = v[1 + dy : size + 1 + dy, 1 + dx : size + 1 + dx]
                lower = w < best
                best = np.where(lower, w, best)
                to = np.where(lower, place[1 + dy : size + 1 + dy, 1 + dx : size + 1 + dx], to)
        down = place.copy()
        down[1:-1, 1:-1] = to
        down = down.ravel()  # the halo stands where it is
        while (down[down] != down).any():
            down = down[down]
        y, x = np.nonzero(np.isfinite(v[1:-1, 1:-1]))
        root = down[place[1:-1, 1:-1][y, x]]
        oy, ox = int(key[0]) * size - 1, int(key[1]) * size - 1
        return pd.DataFrame({"y": y + oy + 1, "x": x + ox + 1, "value": v[1:-1, 1:-1][y, x], "root": (root // v.shape[1] + oy) * width + root % v.shape[1] + ox})

    local = _written(_with_halo(pixels, size).groupBy("_ty", "_tx").applyInPandas(run, "y bigint, x bigint, value double, root bigint"))
    # places where water leaves a tile, and where it gets to in the next one; places are doubled until all are minima
    own = (F.floor(F.col("root") / width / size) == F.floor(F.col("y") / size)) & (F.floor(F.col("root") % width / size) == F.floor(F.col("x") / size))
    exits = local.filter(~own).select(F.col("root").alias("id")).distinct()
    there = local.select((F.col("y") * width + F.col("x")).alias("id"), F.col("root").alias("next")).filter("id <> next")
    step = _written(there.join(exits, "id", "left_semi"))
    while not step.join(step.select(F.col("id").alias("next")), "next", "left_semi").isEmpty():
        further = step.select(F.col("id").alias("next"), F.col("next").alias("_n"))
        old, step = step, _written(step.join(further, "next", "left").select("id", F.coalesce("_n", "next").alias("next")))
        _drop(old)
    return local.join(step.withColumnRenamed("id", "root"), "root", "left").select("y", "x", "value", F.coalesce("next", "root").alias("region"))


def saddles(lab: DataFrame) -> DataFrame:
    """``(u, v, height)``, u < v: the lowest pass between two neighbouring regions of ``lab(y, x, value, region)``, the higher pixel of a neighbouring pair (8 neighbours)."""
    size = TILE

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = _dense(pdf, key, "value", np.inf, size)
        r = _dense(pdf, key, "region", -1, size)
        found = []
        for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
            a, b = (r[1:-1, 1:-1], r[1 + dy : size + 1 + dy, 1 + dx : size + 1 + dx])
            h = np.maximum(v[1:-1, 1:-1], v[1 + dy : size + 1 + dy, 1 + dx : size + 1 + dx])
            y, x = np.nonzero((a >= 0) & (b >= 0) & (a != b))
            found.append(pd.DataFrame({"u": np.minimum(a, b)[y, x], "v": np.maximum(a, b)[y, x], "height": h[y, x]}))
        return pd.concat(found).groupby(["u", "v"], as_index=False)["height"].min()

    parts = _with_halo(lab.select("y", "x", "value", "region"), size).groupBy("_ty", "_tx").applyInPandas(run, "u bigint, v bigint, height double")
    return parts.groupBy("u", "v").agg(F.min("height").alias("height"))


def watershed(df: DataFrame, depth: float = 0.0) -> DataFrame:
    """``(y, x, segment_id)``: `basins` of ``df(y, x, value)``, those no deeper than ``depth`` joined over their lowest pass.

    A basin's depth is the height of its lowest pass over its minimum.  Basins
    join along minimum spanning edges, in rounds: each that is too shallow takes
    its lowest pass (ties: the smaller ids), what that connects becomes one
    basin with the lower minimum, and rounds end when none is too shallow.  With
    all heights different the result is what joining passes one by one in
    ascending order gives, where the side with the higher minimum decides.  A
    segment's id is the least of its minima's.
    """
    lab = _written(basins(df))
    low = _written(lab.groupBy(F.col("region").alias("u")).agg(F.min("value").alias("low")))
    edges, names = _written(saddles(lab)), _written(low.select(F.col("u").alias("region"), F.col("u").alias("segment_id")))
    while True:
        both = edges.union(edges.select("v", "u", "height"))
        key: Column = F.struct("height", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        first = both.groupBy("u").agg(F.min(F.struct(key.alias("k"), F.col("v"))).alias("p"))
        shallow = _written(first.join(low, "u").filter(F.col("p.k.height") - F.col("low") <= depth).select("u", F.col("p.v").alias("v")))
        if shallow.isEmpty():
            return lab.join(names, "region").select("y", "x", "segment_id")
        roots = settled(shallow)
        old = low, edges, names, shallow
        low = _written(_renamed(low, roots, "u").groupBy("u").agg(F.min("low").alias("low")))
        merged = _renamed(edges, roots, "u", "v").filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "height")
        edges = _written(merged.groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.min("height").alias("height")))
        names = _written(_renamed(names, roots, "segment_id"))
        _drop(*old)

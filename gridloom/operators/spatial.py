"""Spatial joins by cells, nearest neighbours, geometry columns and resampling.

Both sides are put into square cells, cells meet in an equi join, and the
exact test follows; a pair that shares several cells is kept once.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import _written


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Cells that a box touches, as an array of (cy, cx)."""
    f = lambda c: F.floor(c / size)
    return F.flatten(F.transform(F.sequence(f(y0), f(y1)), lambda a: F.transform(F.sequence(f(x0), f(x1)), lambda b: F.struct(a.alias("cy"), b.alias("cx")))))


def boxes_meet(a: DataFrame, b: DataFrame, size: float, predicate: str = "intersects") -> DataFrame:
    """Pairs of boxes ``(aid, bid)`` under a predicate: intersects, contains, within, touches, overlaps, equals.

    Both tables have ``id, x0, y0, x1, y1``.  A pair is reported from the cell
    that holds the lower corner of the boxes' common part, so none repeats.
    Two areas never cross; `rings` has polygons, lines and ``disjoint``.
    """
    ca = a.select(F.col("id").alias("aid"), *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)).alias("c"))
    cb = b.select(F.col("id").alias("bid"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)).alias("c"))
    p = ca.join(cb, "c")
    p = p.filter((F.col("c.cx") == F.floor(F.greatest("ax0", "bx0") / size)) & (F.col("c.cy") == F.floor(F.greatest("ay0", "by0") / size)))
    meet = (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
    inside = (F.col("ax0") < F.col("bx1")) & (F.col("bx0") < F.col("ax1")) & (F.col("ay0") < F.col("by1")) & (F.col("by0") < F.col("ay1"))
    within = (F.col("ax0") >= F.col("bx0")) & (F.col("ax1") <= F.col("bx1")) & (F.col("ay0") >= F.col("by0")) & (F.col("ay1") <= F.col("by1"))
    contains = (F.col("bx0") >= F.col("ax0")) & (F.col("bx1") <= F.col("ax1")) & (F.col("by0") >= F.col("ay0")) & (F.col("by1") <= F.col("ay1"))
    test = {"intersects": meet, "contains": contains, "within": within, "touches": meet & ~inside, "overlaps": inside & ~within & ~contains, "equals": within & contains}[predicate]
    return p.filter(test).select("aid", "bid")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, closed: bool = False) -> DataFrame:
    """Points joined to the boxes that hold them, [x0, x1) x [y0, y1), or with both ends if ``closed``; columns of both."""
    p = points.withColumn("_c", F.struct(F.floor(F.col("py") / size).alias("cy"), F.floor(F.col("px") / size).alias("cx")))
    b = boxes.withColumn("_c", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)))
    upto = (F.col("px") <= F.col("x1")) & (F.col("py") <= F.col("y1")) if closed else (F.col("px") < F.col("x1")) & (F.col("py") < F.col("y1"))
    return p.join(b, "_c").filter((F.col("px") >= F.col("x0")) & (F.col("py") >= F.col("y0")) & upto).drop("_c")


def profile(pixels: DataFrame, lines: DataFrame, step: float) -> DataFrame:
    """``(line, k, distance, value)``: pixels (y, x, value) under points every ``step`` along ``lines(line, x0, y0, x1, y1)``.

    A point off the pixels has no value; a line shorter than a step has its first point.
    A point that rounding leaves just before a pixel's edge lies on that edge.
    """
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    at = lines.withColumn("_n", length).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / step + 1e-9).cast("int"))))
    t = F.when(F.col("_n") > 0, F.col("k") * step / F.col("_n")).otherwise(0.0)
    tiny = 1e-12 * F.greatest(F.lit(1.0), *[F.abs(F.col(c)) for c in ("x0", "y0", "x1", "y1")])
    place = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * t + tiny)
    at = at.select("line", "k", (F.col("k") * F.lit(float(step))).alias("distance"), place("y0", "y1").alias("y"), place("x0", "x1").alias("x"))
    return at.join(pixels.select("y", "x", "value"), ["y", "x"], "left").select("line", "k", "distance", "value")


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a ring column ``array<struct<x, y>>``."""
    n = F.size(ring)
    hits = F.transform(F.sequence(F.lit(0), n - 1), lambda k: _crosses(x, y, F.get(ring, k), F.get(ring, F.pmod(k + 1, n))))
    return F.aggregate(hits, F.lit(0), lambda a, h: a + h) % 2 == 1


def _crosses(x, y, a, b):
    return F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)


def attribute_join(left: DataFrame, right: DataFrame, on: str, fields: list[str], prefix: str, order: str) -> DataFrame:
    """Left join of chosen fields under a prefix; the first match by ``order`` per target."""
    one = right.groupBy(on).agg(F.min_by(F.struct(*fields), F.col(order)).alias("_m"))
    return left.join(one, on, "left").select(left["*"], *[F.col(f"_m.{f}").alias(prefix + f) for f in fields])


def within_radius(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """``(aid, bid, distance)`` of points at most ``r`` apart: cells of side r, each a point to its 3 x 3 cells."""
    pa = a.select(F.col("id").alias("aid"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.explode(cells(F.col("px") - r, F.col("py") - r, F.col("px") + r, F.col("py") + r, r)).alias("c"))
    pb = b.select(F.col("id").alias("bid"), F.col("px").alias("bx"), F.col("py").alias("by"), F.struct(F.floor(F.col("py") / r).alias("cy"), F.floor(F.col("px") / r).alias("cx")).alias("c"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return pa.join(pb, "c").select("aid", "bid", d.alias("distance")).filter(F.col("distance") <= r)


def nearest(a: DataFrame, b: DataFrame, k: int = 1, cell: float = 10.0, limit: float = 0.0, most: int = 60) -> DataFrame:
    """``(aid, bid, distance, rank)``: the k nearest points of ``b`` (ties: smaller id), within ``limit`` if it is over 0.

    The searched square around each point doubles until it surely holds the k
    nearest; only points that are not settled go on, and every round is written.
    The first is of side ``cell``, or less where ``b`` is so dense that a smaller
    one holds some 3 k points on average.
    """
    box = b.agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in ("px", "py")]).first()
    out, left, r, n = None, a, cell, box["n"]
    span = (box["px"] or 0.0) * (box["py"] or 0.0)
    if span > 0 and math.isfinite(span):
        r = min(cell, math.sqrt(span * k / n))
    for _ in range(most):
        got = within_radius(left, b, r if not limit else min(r, limit))
        w = Window.partitionBy("aid").orderBy("distance", "bid")
        got = _written(got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        full = got.groupBy("aid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, n)).select(F.col("aid").alias("id"))
        last = bool(limit) and r >= limit
        done = got if last else got.join(full, F.col("aid") == F.col("id"), "left_semi")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left = _written(left.join(full, "id", "left_anti"))
        if left.isEmpty():
            return out
        r *= 2
    raise RuntimeError("nearest neighbours did not settle")


def nearest_features(a: DataFrame, b: DataFrame, k: int = 1, cell: float = 10.0, limit: float = 0.0) -> DataFrame:
    """All columns of ``a`` for each of its k nearest points of ``b``, and ``neighbor_id``, ``neighbor_x``, ``neighbor_y``, ``distance``, ``rank``.

    Rows without a place have no neighbours and are left out, as are those that
    have none within ``limit``.  ``id`` is unique in each table; columns of ``a``
    under one of the new names raise.
    """
    new = ("neighbor_id", "neighbor_x", "neighbor_y", "distance", "rank")
    if clash := sorted(set(new) & set(a.columns)):
        raise ValueError(f"columns {clash} are in the way")
    placed = [df.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("px", "py"))) for df in (a, b)]
    found = nearest(*[df.select("id", "px", "py") for df in placed], k, cell, limit)
    places = placed[1].select(F.col("id").alias("bid"), F.col("px").alias("neighbor_x"), F.col("py").alias("neighbor_y"))
    return placed[0].join(found.withColumnRenamed("aid", "id"), "id").join(places, "bid").select(*a.columns, F.col("bid").alias("neighbor_id"), *new[1:])


def distance_matrix(a: DataFrame, queries: DataFrame) -> DataFrame:
    """``(aid, bid, distance)`` of a stated, bounded query set against all rows of ``a``."""
    q = queries.select(F.col("id").alias("bid"), F.col("px").alias("bx"), F.col("py").alias("by"))
    d = F.sqrt((F.col("px") - F.col("bx")) ** 2 + (F.col("py") - F.col("by")) ** 2)
    return a.crossJoin(F.broadcast(q)).select(F.col("id").alias("aid"), "bid", d.alias("distance"))


def grid_points(points: DataFrame, step: float, r: float, how: str = "average", power: float = 2.0, smoothing: float = 0.0) -> DataFrame:
    """Values on cell centres from points within ``r``: nearest, average, invdist, minimum, maximum, range, count."""
    reach = F.explode(cells(F.col("px") - r, F.col("py") - r, F.col("px") + r, F.col("py") + r, step)).alias("c")
    p = points.select("id", "px", "py", "z", reach).withColumns({"cx": (F.col("c.cx") + 0.5) * step, "cy": (F.col("c.cy") + 0.5) * step})
    d = F.sqrt((F.col("px") - F.col("cx")) ** 2 + (F.col("py") - F.col("cy")) ** 2)
    p = p.withColumn("d", d).filter(F.col("d") <= r)
    w = 1 / F.pow(F.sqrt(F.col("d") * F.col("d") + smoothing * smoothing), F.lit(power))
    agg = {"nearest": F.min_by("z", F.struct("d", "id")), "average": F.avg("z"), "invdist": F.sum(w * F.col("z")) / F.sum(w), "minimum": F.min("z"), "maximum": F.max("z"), "range": F.max("z") - F.min("z"), "count": F.count("z").cast("double")}[how]
    return p.groupBy(F.col("c.cy").alias("y"), F.col("c.cx").alias("x")).agg(agg.alias("value"))


def rasterize(boxes: DataFrame, value: str, order: str) -> DataFrame:
    """Pixels whose centre lies in a box get its value; the last box by ``order`` wins."""
    first = lambda c: F.ceil(F.col(c) - 0.5)
    px = boxes.withColumn("y", F.explode(F.sequence(first("y0"), first("y1") - 1))).withColumn("x", F.explode(F.sequence(first("x0"), first("x1") - 1)))
    return px.groupBy("y", "x").agg(F.max_by(value, F.col(order)).alias("value"))


def sample_training(pixels: DataFrame, boxes: DataFrame, cls: str, cap: int, seed: int = 42) -> DataFrame:
    """Pixels inside boxes with the class of the last box, at most ``cap`` a class in a seeded hashed order."""
    inside = points_in_boxes(pixels.withColumns({"px": F.col("x") + 0.5, "py": F.col("y") + 0.5}), boxes, 20.0)
    one = inside.groupBy("y", "x").agg(F.max_by(cls, F.col("zone")).alias("class"), F.first("value").alias("value"))
    w = Window.partitionBy("class").orderBy((F.col("y") * 7919 + F.col("x") * 104729 + seed) % 1000003, "y", "x")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).drop("rank")


# --- resampling to a target grid


def fusion_pixels(ms: DataFrame, pan: DataFrame, bands: list[str], scale: float, offset: float = 0.0, method: str = "bilinear") -> DataFrame:
    """``(y, x, pan, bands..)`` on the grid of ``pan(y, x, value)``: coarser ``ms(y, x, bands..)`` resampled there, then an equi join.

    ``scale`` is a pan pixel's size in ms pixels; pan pixels without ms, or the reverse, go.
    """
    return pan.select("y", "x", F.col("value").alias("pan")).join(resample(ms, pan, scale, offset, method, bands), ["y", "x"])


def resample(df: DataFrame, target: DataFrame, scale: float, offset: float = 0.0, method: str = "nearest", cols: list[str] | None = None) -> DataFrame:
    """Columns ``cols`` (``value``) of ``df`` at the target's pixel centres: source coordinate = (pixel + 0.5) * scale + offset - 0.5.

    nearest (1 tap), bilinear (4) or cubic (16, a = -0.5); missing taps are
    skipped and weights renormalised.
    """
    sy, sx = (F.col("y") + 0.5) * scale + offset - 0.5, (F.col("x") + 0.5) * scale + offset - 0.5
    t = target.select("y", "x", sy.alias("sy"), sx.alias("sx"))
    if method == "nearest":
        taps = t.select("y", "x", F.floor(F.col("sy") + 0.5).alias("ty"), F.floor(F.col("sx") + 0.5).alias("tx"), F.lit(1.0).alias("w"))
    else:
        r = {"bilinear": (0, 1), "cubic": (-1, 0, 1, 2)}[method]
        o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in r for b in r])).alias("o")
        taps = t.select("*", o).withColumns({"ty": F.floor("sy") + F.col("o.a"), "tx": F.floor("sx") + F.col("o.b")})
        taps = taps.withColumn("w", _tap(F.abs(F.col("sy") - F.col("ty")), method) * _tap(F.abs(F.col("sx") - F.col("tx")), method))
    cols = cols or ["value"]
    src = df.select(F.col("y").alias("ty"), F.col("x").alias("tx"), *cols)
    got = taps.join(src, ["ty", "tx"])
    if len(cols) == 1:
        got = got.filter(F.col(cols[0]).isNotNull())
    return got.groupBy("y", "x").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c) for c in cols])


def _tap(d, method):
    if method == "bilinear":
        return F.greatest(1 - d, F.lit(0.0))
    return F.when(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1).when(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2).otherwise(0.0)


# --- geometry columns: rings are array<struct<x, y>>


def centroid(ring: Column) -> Column:
    """Area centroid by shoelace sums."""
    n = F.size(ring)
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: _shoelace(F.get(ring, k), F.get(ring, F.pmod(k + 1, n))))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(parts, zero, lambda s, p: F.struct((s["a"] + p["a"]).alias("a"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
    return F.struct((total["x"] / (3 * total["a"])).alias("x"), (total["y"] / (3 * total["a"])).alias("y"), F.abs(total["a"] / 2).alias("area"))


def _shoelace(a, b):
    c = a["x"] * b["y"] - b["x"] * a["y"]
    return F.struct(c.alias("a"), ((a["x"] + b["x"]) * c).alias("x"), ((a["y"] + b["y"]) * c).alias("y"))


def convex_hull(points: DataFrame, by: str) -> DataFrame:
    """Hull vertices per group: points first shrink to extremes per slice of x (all that a hull can use there), then one chain a group."""
    slices = 512
    ends = points.groupBy(by).agg(F.min("px").alias("lo"), F.max("px").alias("hi"))
    cut = points.join(ends, by).withColumn("s", F.least(F.floor((F.col("px") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * slices), F.lit(slices - 1)))
    # per slice a hull of the slice's own points holds every vertex of the whole hull
    part = cut.groupBy(by, "s").applyInPandas(lambda pdf: _chain(pdf, by), f"{by} {points.schema[by].dataType.simpleString()}, px double, py double")
    return part.groupBy(by).applyInPandas(lambda pdf: _chain(pdf, by), f"{by} {points.schema[by].dataType.simpleString()}, px double, py double")


def _chain(pdf: pd.DataFrame, by: str) -> pd.DataFrame:
    pts = sorted(set(zip(pdf["px"].astype(float), pdf["py"].astype(float))))

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1:
                one, two = (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]), (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
                if one - two > 1e-10 * (abs(one) + abs(two)):  # what is within rounding of a line goes
                    break
                out.pop()
            out.append(p)
        return out

    hull = pts if len(pts) < 3 else half(pts)[:-1] + half(pts[::-1])[:-1]
    return pd.DataFrame({by: [pdf[by].iloc[0]] * len(hull), "px": [p[0] for p in hull], "py": [p[1] for p in hull]})


def single_parts(df: DataFrame, parts: str) -> DataFrame:
    """One row per part, numbered from 0, attributes kept."""
    return df.select(*[c for c in df.columns if c != parts], F.posexplode(parts).alias("part", "ring"))


def smooth(ring: Column, rounds: int = 1) -> Column:
    """Corner cutting: each side gives its points at one and three quarters."""
    for _ in range(rounds):
        n = F.size(ring)
        ring = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), (lambda r, m: lambda k: F.array(_between(F.get(r, k), F.get(r, F.pmod(k + 1, m)), 0.25), _between(F.get(r, k), F.get(r, F.pmod(k + 1, m)), 0.75)))(ring, n)))
    return ring


def _between(a, b, t):
    return F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


# --- overlay as cell coverage, and mosaics


def coverage(boxes: DataFrame, keep: list[str]) -> DataFrame:
    """Unit cells whose centre a box covers, with the box's attributes."""
    first = lambda c: F.ceil(F.col(c) - 0.5)
    return boxes.withColumn("y", F.explode(F.sequence(first("y0"), first("y1") - 1))).withColumn("x", F.explode(F.sequence(first("x0"), first("x1") - 1))).select("y", "x", *keep)


def overlay(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Set algebra of two coverages (cells y, x with attributes): intersection, union, difference, symmetric, clip."""
    cells_b = b.select("y", "x").distinct()
    if how == "clip":
        return a.join(cells_b, ["y", "x"], "left_semi")
    if how == "difference":
        return a.join(cells_b, ["y", "x"], "left_anti")
    if how == "intersection":
        return a.join(b, ["y", "x"])
    if how == "union":
        return a.join(b, ["y", "x"], "full")
    if how == "symmetric":
        return a.join(cells_b, ["y", "x"], "left_anti").unionByName(b.join(a.select("y", "x").distinct(), ["y", "x"], "left_anti"), allowMissingColumns=True)
    raise ValueError(how)


def mosaic(sources: list[DataFrame], rule: str = "first") -> DataFrame:
    """Valid values of overlapping sources: the first or the last source wins."""
    all_ = None
    for k, s in enumerate(sources):
        s = s.select("y", "x", "value", F.lit(k).alias("_k")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
        all_ = s if all_ is None else all_.unionByName(s)
    pick = F.min_by if rule == "first" else F.max_by
    return all_.groupBy("y", "x").agg(pick("value", "_k").alias("value"))

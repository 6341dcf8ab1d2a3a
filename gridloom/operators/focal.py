"""Neighbourhood operators.

They work on tiles with a halo (`tiles`): a pixel is shuffled once, and once
more near a tile's edge, whatever the window.  Only the 2 x 2 cells of contour
crossings send every pixel to each cell that it belongs to.  Borders clamp to
the edge: a border pixel also stands for the positions beyond it.  NaN counts
as a missing value.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import known, ratio
from .components import _written
from .tiles import by_tiles, shifted, strips


def extent(df: DataFrame) -> DataFrame:
    return df.agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))  # one row


def windows(df: DataFrame, radius: int, cols: list[str] = ("value",), border: str = "clamp", offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """``(y, x, dy, dx, cols..)``: for each centre (y, x) its neighbours at (y + dy, x + dx).

    ``border`` clamp repeats edge pixels outwards; none leaves them out.
    """
    sized = df.select("y", "x", *cols).crossJoin(F.broadcast(extent(df)))
    if border == "clamp":
        def reach(c, m):
            return F.sequence(F.when(c == 0, c - radius).otherwise(c), F.when(c == m, c + radius).otherwise(c))

        sized = sized.withColumn("vy", F.explode(reach(F.col("y"), F.col("_my")))).withColumn("vx", F.explode(reach(F.col("x"), F.col("_mx"))))
    else:
        sized = sized.withColumns({"vy": F.col("y"), "vx": F.col("x")})
    offsets = offsets or [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])).alias("o")
    out = sized.select("vy", "vx", "_my", "_mx", *cols, o).select((F.col("vy") - F.col("o.dy")).alias("y"), (F.col("vx") - F.col("o.dx")).alias("x"), "o.dy", "o.dx", "_my", "_mx", *cols)
    return out.filter(F.col("y").between(0, F.col("_my")) & F.col("x").between(0, F.col("_mx"))).drop("_my", "_mx")


def convolve(df: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Weighted sums.  A centre without a value keeps none; missing neighbours are
    skipped, and averaging kernels are renormalised over the rest."""
    total, r = sum(map(sum, kernel)), len(kernel) // 2

    def run(arrays, radius):
        v = arrays["value"]
        there, zero = ~np.isnan(v), np.nan_to_num(v)
        s, w = (np.zeros((v.shape[0] - 2 * r, v.shape[1] - 2 * r)) for _ in range(2))
        for dy, line in enumerate(kernel):
            for dx, k in enumerate(line):
                s += k * shifted(zero, r, dy - r, dx - r)
                w += k * shifted(there, r, dy - r, dx - r)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = s if abs(total) < 1e-12 else np.where(w == 0, np.nan, s * total / w)
        return [np.where(shifted(there, r, 0, 0), out, np.nan)]

    return by_tiles(df.withColumn("value", known(F.col("value"))), ["value"], r, run, ["value"], every=True)


def mean_filter(df: DataFrame, k: int = 3) -> DataFrame:
    return convolve(df, [[1.0 / (k * k)] * k] * k)


def gaussian_kernel(k: int, sigma: float) -> list[list[float]]:
    from math import exp

    r = k // 2
    w = [[exp(-(a * a + b * b) / (2 * sigma * sigma)) for b in range(-r, r + 1)] for a in range(-r, r + 1)]
    s = sum(map(sum, w))
    return [[x / s for x in row] for row in w]


def median_filter(df: DataFrame, k: int = 3) -> DataFrame:
    def run(arrays, radius):
        v = arrays["value"]
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # windows without a value
            middle = strips(v, radius, lambda w: np.nanmedian(w, axis=2))
        return [np.where(np.isnan(shifted(v, radius, 0, 0)), np.nan, middle)]

    return by_tiles(df.withColumn("value", known(F.col("value"))), ["value"], k // 2, run, ["value"], every=True)


SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]


def gradient(df: DataFrame) -> DataFrame:
    """``(y, x, gx, gy, value)``: Sobel derivatives and their magnitude, in one pass; missing neighbours add nothing."""

    def run(arrays, r):
        zero = np.nan_to_num(arrays["value"])
        gx, gy = (sum(k * shifted(zero, r, dy - 1, dx - 1) for dy, line in enumerate(kernel) for dx, k in enumerate(line) if k) for kernel in (SOBEL_X, SOBEL_Y))
        return [gx, gy, np.where(np.isnan(shifted(arrays["value"], r, 0, 0)), np.nan, np.hypot(gx, gy))]

    return by_tiles(df.withColumn("value", known(F.col("value"))), ["value"], 1, run, ["gx", "gy", "value"], every=True)


def thin_edges(df: DataFrame) -> DataFrame:
    """Gradient magnitudes that are largest along their direction (0, 45, 90, 135 degrees), as ``(y, x, value)``."""
    a = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(180.0))
    way = F.when((a < 22.5) | (a >= 157.5), 0).when(a < 67.5, 1).when(a < 112.5, 2).otherwise(3)

    def run(arrays, r):
        v, own, to = arrays["value"], shifted(arrays["value"], r, 0, 0), shifted(arrays["way"], r, 0, 0)
        kept = np.zeros(own.shape, dtype=bool)
        for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
            kept |= (to == k) & (own >= shifted(v, r, dy, dx)) & (own >= shifted(v, r, -dy, -dx))
        return [np.where(kept, own, np.nan)]

    return by_tiles(gradient(df).withColumn("way", way), ["value", "way"], 1, run, ["value"]).filter("value IS NOT NULL")


def _neighbours(a: np.ndarray, r: int):
    """``(dy, dx, values)`` of all window places."""
    return ((dy, dx, shifted(a, r, dy, dx)) for dy in range(-r, r + 1) for dx in range(-r, r + 1))


def _moments(a: np.ndarray, r: int, orders: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Means of the windows' values and central moments, taken around the centre so that equal values vary by exactly 0."""
    base = np.nan_to_num(shifted(a, r, 0, 0))
    n, s = np.zeros_like(base), np.zeros_like(base)
    for _, _, w in _neighbours(a, r):
        n += ~np.isnan(w)
        s += np.nan_to_num(w - base)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s / n
        out = [np.zeros_like(base) for _ in orders]
        for _, _, w in _neighbours(a, r):
            off = w - base - mean
            for o, k in zip(out, orders):
                o += np.nan_to_num(off**k)
        return base + mean, [o / n for o in out]


def _mean_and_variance(a: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum by count, and the running variance column by column: the sums of SQL's ``avg`` and ``var_pop`` over such windows, so that a threshold met exactly falls on the same side; equal values vary by exactly 0."""
    n, s, mean, m2 = (np.zeros((a.shape[0] - 2 * r, a.shape[1] - 2 * r)) for _ in range(4))
    for dx in range(-r, r + 1):
        for dy in range(-r, r + 1):
            w = shifted(a, r, dy, dx)
            there = ~np.isnan(w)
            n += there
            off = np.where(there, w - mean, 0.0)
            mean = mean + off / np.maximum(n, 1)
            m2 += np.where(there, w - mean, 0.0) * off
            s += np.where(there, w, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return s / n, m2 / n


def speckle(df: DataFrame, kind: str, k: int = 3, looks: float = 1.0, damping: float = 1.0) -> DataFrame:
    """lee, enhanced_lee, kuan, gamma_map (local mean and variance weights) or frost (distance and variation weights)."""

    def local_values(arrays, r):
        a = arrays["value"]
        return [shifted(a, r, 0, 0), *_mean_and_variance(a, r)]

    def frost(arrays, r):
        _, mean, var = local_values(arrays, r)
        with np.errstate(divide="ignore", invalid="ignore"):
            ci2 = np.where(mean == 0, 0.0, var / (mean * mean))
            s, total = np.zeros_like(mean), np.zeros_like(mean)
            for dy, dx, v in _neighbours(arrays["value"], r):
                w = np.where(np.isnan(v), 0.0, np.exp(-damping * ci2 * np.hypot(dy, dx)))
                s += w * np.nan_to_num(v)
                total += w
            return [s / total]

    if kind == "frost":
        return by_tiles(df, ["value"], k // 2, frost, ["value"], every=True)
    local = by_tiles(df, ["value"], k // 2, local_values, ["c", "m", "v"], every=True)
    c, m, v = F.col("c"), F.col("m"), F.col("v")
    cu2 = 1.0 / looks
    ci2 = F.coalesce(ratio(v, m * m), F.lit(0.0))
    if kind == "lee":
        w = F.greatest(F.coalesce(1 - cu2 / F.nullif(ci2, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
        value = m + w * (c - m)
    elif kind == "kuan":
        w = F.greatest(F.coalesce((1 - cu2 / F.nullif(ci2, F.lit(0.0))) / (1 + cu2), F.lit(0.0)), F.lit(0.0))
        value = m + w * (c - m)
    elif kind == "enhanced_lee":
        ci, cu, top = F.sqrt(ci2), cu2**0.5, (1 + 2 / looks) ** 0.5
        w = F.exp(-damping * (ci - cu) / (top - ci))
        value = F.when(ci <= cu, m).when(ci >= top, c).otherwise(m * w + c * (1 - w))
    elif kind == "gamma_map":
        ci, cu, top = F.sqrt(ci2), cu2**0.5, (2.0**0.5) * cu2**0.5
        alpha = (1 + cu2) / (ci2 - cu2)
        b = alpha - looks - 1
        d = m * m * b * b + 4 * alpha * looks * m * c
        value = F.when(ci <= cu, m).when(ci >= top, c).otherwise((b * m + F.sqrt(d)) / (2 * alpha))
    else:
        raise ValueError(kind)
    return local.select("y", "x", value.alias("value"))


def morphology(df: DataFrame, kind: str, radius: int = 1, nodata: int = 255) -> DataFrame:
    """erode, dilate, open or close of a mask or grey band; nodata cells never change nor count."""
    dtype = df.schema["value"].dataType

    def kernel(pick, none):
        def run(arrays, r):
            v = arrays["value"]
            out = np.where(np.isnan(v) | (v == nodata), none, v)
            for axis in (0, 1):  # the square is two lines
                out = pick.reduce([out[k : out.shape[0] - 2 * r + k] if axis == 0 else out[:, k : out.shape[1] - 2 * r + k] for k in range(2 * r + 1)])
            own = shifted(v, r, 0, 0)
            return [np.where(own == nodata, own, np.where(np.isinf(out), np.nan, out))]

        return run

    erode, dilate = kernel(np.minimum, np.inf), kernel(np.maximum, -np.inf)
    for run in {"erode": [erode], "dilate": [dilate], "open": [erode, dilate], "close": [dilate, erode]}[kind]:
        df = by_tiles(df, ["value"], radius, run, ["value"], every=True)
    return df.select("y", "x", F.col("value").cast(dtype).alias("value"))


def terrain(df: DataFrame, cell: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Horn slope and aspect (degrees), hillshade in [0, 1], roughness, TRI, TPI.

    A missing neighbour counts as the centre; aspect is -1 on the flat, else
    clockwise from north; a centre without a value gives none.
    """
    names = {(a, b): f"z{a + 1}{b + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1)}

    def run(arrays, r):
        return [shifted(arrays["value"], r, a, b) for a, b in names]

    z = by_tiles(df.withColumn("value", known(F.col("value"))), ["value"], 1, run, list(names.values()), border="none").filter("z11 IS NOT NULL")
    at = {k: F.coalesce(n, "z11") for k, n in names.items()}
    gx = ((at[-1, 1] + 2 * at[0, 1] + at[1, 1]) - (at[-1, -1] + 2 * at[0, -1] + at[1, -1])) / (8 * cell)
    gy = ((at[1, -1] + 2 * at[1, 0] + at[1, 1]) - (at[-1, -1] + 2 * at[-1, 0] + at[-1, 1])) / (8 * cell)
    ring = [v for k, v in at.items() if k != (0, 0)]
    around = sum(ring[1:], ring[0])
    tri = F.sqrt(sum([(v - at[0, 0]) ** 2 for v in ring[1:]], (ring[0] - at[0, 0]) ** 2))
    t = z.select("y", "x", gx.alias("gx"), gy.alias("gy"), (F.greatest(*at.values()) - F.least(*at.values())).alias("roughness"), tri.alias("tri"), (at[0, 0] - around / 8).alias("tpi"))
    slope = F.atan(F.hypot("gx", "gy"))
    aspect = F.when((F.col("gx") == 0) & (F.col("gy") == 0), -1.0).otherwise(F.pmod(F.degrees(F.atan2(-F.col("gx"), F.col("gy"))), F.lit(360.0)))
    alt, az = F.radians(F.lit(altitude)), F.radians(F.lit(azimuth))
    shade = F.sin(alt) * F.cos(slope) + F.cos(alt) * F.sin(slope) * F.when((F.col("gx") == 0) & (F.col("gy") == 0), 0.0).otherwise(F.cos(az - F.radians(aspect)))
    return t.select("y", "x", F.degrees(slope).alias("slope"), aspect.alias("aspect"), F.greatest(F.least(shade, F.lit(1.0)), F.lit(0.0)).alias("hillshade"), "roughness", "tri", "tpi")


def _running(windows: np.ndarray):
    """Places of sorted windows one after the other: ``(values, how often the value came so far)``; 0 where missing (they come last)."""
    w = np.sort(windows, axis=2)
    run = np.zeros(w.shape[:2], dtype=np.int64)
    for k in range(w.shape[2]):
        v = w[:, :, k]
        run = np.where(np.isnan(v), 0, np.where(v == w[:, :, k - 1], run + 1, 1) if k else 1)
        yield v, run


def majority_filter(df: DataFrame, label: str, k: int = 3) -> DataFrame:
    """Commonest class of each window, ties to the smaller; classes are numbers (whole ones up to 2^53), missing ones do not count."""
    dtype = df.schema[label].dataType

    def commonest(windows):
        best, out = np.zeros(windows.shape[:2], dtype=np.int64), np.full(windows.shape[:2], np.nan)
        for v, run in _running(windows):
            more = run > best
            best, out = np.where(more, run, best), np.where(more, v, out)
        return out

    got = by_tiles(df, [label], k // 2, lambda arrays, r: [strips(arrays[label], r, commonest)], [label], every=True)
    return got.filter(F.col(label).isNotNull()).select("y", "x", F.col(label).cast(dtype).alias(label))


def local_statistics(df: DataFrame, radius: int = 1) -> DataFrame:
    """Mean, variance, skewness and excess kurtosis of each window; the last two are null where values do not vary."""

    def run(arrays, r):
        mean, (m2, m3, m4) = _moments(arrays["value"], r, (2, 3, 4))
        with np.errstate(divide="ignore", invalid="ignore"):
            return [mean, m2, np.where(m2 == 0, np.nan, m3 / m2**1.5), np.where(m2 == 0, np.nan, m4 / m2**2 - 3)]

    return by_tiles(df, ["value"], radius, run, ["mean", "variance", "skewness", "kurtosis"], every=True)


def glcm(df: DataFrame, radius: int, levels: int, low: float, high: float, offset: tuple[int, int] = (0, 1)) -> DataFrame:
    """Windowed co-occurrence of quantised levels at one offset: energy, entropy, contrast, homogeneity, correlation (null where a side does not vary).

    A pair belongs to the window that holds its first pixel; windows without a pair have no row.
    """
    far = radius + max(map(abs, offset))

    def disorder(windows):
        squares, logs, n = (np.zeros(windows.shape[:2]) for _ in range(3))
        for _, run in _running(windows):
            there = run > 0
            squares += np.where(there, 2 * run - 1, 0)
            logs += np.where(there, run * np.log(np.maximum(run, 1)) - (run - 1) * np.log(np.maximum(run - 1, 1)), 0)
            n += there
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.stack([squares / n**2, np.log(n) - logs / n], axis=2)

    def run(arrays, r):
        q = np.clip(np.floor((arrays["value"] - low) / (high - low) * levels), 0, levels - 1)
        edge = r - radius  # pairs are needed for the windows' pixels only
        one, two = (q[edge + dy : q.shape[0] - edge + dy, edge + dx : q.shape[1] - edge + dx] for dy, dx in ((0, 0), offset))
        pair = one * levels + two
        energy, entropy = np.moveaxis(strips(pair, radius, disorder), 2, 0)
        there = ~np.isnan(pair)

        def total(a):
            return sum(w for _, _, w in _neighbours(np.where(there, a, 0.0), radius))

        n, d = total(1.0), one - two
        with np.errstate(divide="ignore", invalid="ignore"):
            s1, s2 = total(one), total(two)
            v1, v2 = n * total(one * one) - s1 * s1, n * total(two * two) - s2 * s2  # whole numbers, so 0 is 0
            return [energy, entropy, total(d * d) / n, total(1 / (1 + d * d)) / n, np.where(v1 * v2 == 0, np.nan, (n * total(one * two) - s1 * s2) / np.sqrt(v1 * v2))]

    return by_tiles(df, ["value"], far, run, ["energy", "entropy", "contrast", "homogeneity", "correlation"], border="none", every=True).filter("energy IS NOT NULL")


def _disc(radius: int):
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def fill_nodata(df: DataFrame, distance: int) -> DataFrame:
    """Missing cells by inverse distance from valid ones within ``distance``; valid cells stay."""
    def run(arrays, radius):
        v = arrays["value"]
        there, zero = ~np.isnan(v), np.nan_to_num(v)
        s, w = (np.zeros((v.shape[0] - 2 * radius, v.shape[1] - 2 * radius)) for _ in range(2))
        for dy, dx in _disc(distance):
            if dy or dx:
                k = 1 / np.hypot(dy, dx)
                s += k * shifted(zero, radius, dy, dx)
                w += k * shifted(there, radius, dy, dx)
        own = shifted(v, radius, 0, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return [np.where(np.isnan(own), np.where(w == 0, np.nan, s / w), own)]

    return by_tiles(df, ["value"], distance, run, ["value"], border="none", every=True)


def proximity(df: DataFrame, target: str, distance: int) -> DataFrame:
    """Distance to the nearest pixel that passes ``target``; none beyond ``distance``; `distance.distance_transform` has no such bound."""
    def run(arrays, radius):
        hit = arrays["hit"] == 1
        # along rows first, then the least over rows of both parts: 2 x (2 distance + 1) passes
        along = np.full((hit.shape[0], hit.shape[1] - 2 * radius), np.inf)
        for dx in range(-distance, distance + 1):
            part = hit[:, radius + dx : hit.shape[1] - radius + dx]
            along = np.where(part, np.minimum(along, dx * dx), along)
        best = np.full((hit.shape[0] - 2 * radius, along.shape[1]), np.inf)
        for dy in range(-distance, distance + 1):
            best = np.minimum(best, along[radius + dy : along.shape[0] - radius + dy] + dy * dy)
        return [np.where(best <= distance * distance, np.sqrt(best), np.nan)]

    hit = df.withColumn("hit", F.expr(target).cast("double"))
    return by_tiles(hit, ["hit"], distance, run, ["distance"], border="none")


def mean_shift(df: DataFrame, radius: int, span: float, rounds: int = 3) -> DataFrame:
    """Each round: mean of window values within ``span`` of the centre's; every round is written."""

    def run(arrays, r):
        v = arrays["value"]
        own = shifted(v, r, 0, 0)
        s, n = np.zeros_like(own), np.zeros_like(own)
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                w = shifted(v, r, dy, dx)
                near = np.abs(w - own) <= span
                s += np.where(near, w, 0.0)
                n += near
        with np.errstate(divide="ignore", invalid="ignore"):
            return [s / n]

    out = df.select("y", "x", "value")
    for _ in range(rounds):
        out = _written(by_tiles(out, ["value"], radius, run, ["value"]).filter("value IS NOT NULL"))
    return out


def contours(df: DataFrame, interval: float) -> DataFrame:
    """Marching-squares crossings: ``(level, y, x, edges)`` per 2 x 2 cell and level, with the code of corners above."""
    got = windows(df, 1, border="none", offsets=[(0, 0), (0, 1), (1, 0), (1, 1)])
    v = {k: F.max(F.when((F.col("dy") == a) & (F.col("dx") == b), F.col("value"))).alias(k) for k, (a, b) in {"a": (0, 0), "b": (0, 1), "c": (1, 1), "d": (1, 0)}.items()}
    cells = got.groupBy("y", "x").agg(*v.values()).filter("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL")
    lo, hi = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    cells = cells.withColumn("k", F.explode(F.sequence(F.floor(lo / interval) + 1, F.greatest(F.floor(hi / interval), F.floor(lo / interval) + 1)))).withColumn("level", F.col("k") * interval).filter(hi >= F.col("level"))
    code = sum([F.when(F.col(k) >= F.col("level"), 1 << n).otherwise(0) for n, k in enumerate("bcd", 1)], F.when(F.col("a") >= F.col("level"), 1).otherwise(0))
    return cells.select("level", "y", "x", code.alias("code")).filter("code NOT IN (0, 15)")

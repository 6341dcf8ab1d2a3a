"""Reprojection of rasters onto the grid of another reference system.

The target grid is cut into tiles.  A tile's pixel centres are taken back to
fractional rows and columns of the source through a grid of control points that
is refined until its measured error is under a bound; that gives the tile's
footprint in the source.  Source pixels meet the tiles by blocks under their
footprints (one equi join), and a task resamples one tile from one dense array.
A tile's side shrinks as the target gets coarser than the source, so that a
footprint stays about one source tile, however strong the reduction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projections import between

#: Side of a tile at one source pixel a target pixel, side of the blocks in which source pixels meet tiles, least number of control cells a side.
TILE, BLOCK, CELLS = 256, 64, 2
#: Taps around the pixel below: nearest, bilinear, cubic (a = -0.5).
TAPS = {"nearest": (0,), "bilinear": (0, 1), "cubic": (-1, 0, 1, 2)}


@dataclass(frozen=True)
class Grid:
    """A raster's frame: reference system, outer corner of pixel (0, 0), pixel steps (``dy`` negative where rows go south) and size."""

    crs: str
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int

    def centre(self, row, col):
        return self.x0 + (col + 0.5) * self.dx, self.y0 + (row + 0.5) * self.dy

    def place(self, x, y):
        """Fractional row and column; a pixel's centre has whole ones."""
        return (y - self.y0) / self.dy - 0.5, (x - self.x0) / self.dx - 0.5


def traced(source: Grid, target: Grid, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source rows and columns of the target pixels (or fractions of pixels) ``rows`` x ``cols``; NaN off the target's map."""
    x, y = target.centre(rows[:, None], cols[None, :])
    x, y = np.broadcast_arrays(x, y)
    with np.errstate(all="ignore"):
        if target.crs == "sinusoidal":
            lon, _ = between("sinusoidal", "geographic", x, y, np)
            x = np.where(np.abs(lon) <= 180, x, np.nan)
        got = source.place(*between(target.crs, source.crs, x, y, np))
    return tuple(np.where(np.isfinite(got[0]) & np.isfinite(got[1]), g, np.nan) for g in got)


def located(source: Grid, target: Grid, rows: np.ndarray, cols: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, float]:
    """`traced` by bilinear interpolation of control points, and the error measured half-way between them, in source pixels.

    Cells are halved until the error is within ``tolerance``; where that takes a
    point a pixel, or a control point is off the map, all pixels are traced.
    """
    n = CELLS
    while tolerance > 0 and n < max(len(rows), len(cols)) - 1:
        r, c = np.linspace(rows[0], rows[-1], n + 1), np.linspace(cols[0], cols[-1], n + 1)
        known = traced(source, target, r, c)
        half = traced(source, target, np.linspace(rows[0], rows[-1], 2 * n + 1), np.linspace(cols[0], cols[-1], 2 * n + 1))
        fine = [_interpolated(k, np.arange(2 * n + 1) / 2, np.arange(2 * n + 1) / 2) for k in known]
        error = max(float(np.abs(f - h).max()) for f, h in zip(fine, half))
        if error <= tolerance:  # false for NaN
            at = [(v - v[0]) / max(v[-1] - v[0], 1) * n for v in (rows.astype(float), cols.astype(float))]
            return *(_interpolated(k, *at) for k in known), error
        n *= 2
    return *traced(source, target, rows.astype(float), cols.astype(float)), 0.0


def _interpolated(values: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bilinear values at fractional indices ``r`` x ``c``."""
    i, j = np.minimum(r.astype(int), len(values) - 2), np.minimum(c.astype(int), values.shape[1] - 2)
    a, b = (r - i)[:, None], (c - j)[None, :]
    at = lambda p, q: values[np.ix_(i + p, j + q)]
    return (1 - a) * ((1 - b) * at(0, 0) + b * at(0, 1)) + a * ((1 - b) * at(1, 0) + b * at(1, 1))


def _weight(d: np.ndarray, method: str) -> np.ndarray:
    if method == "bilinear":
        return np.maximum(1 - d, 0)
    return np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))


def sampled(values: np.ndarray, r: np.ndarray, c: np.ndarray, method: str) -> np.ndarray:
    """Values of a dense array at fractional places; taps without a value are left out and the other weights made whole; NaN where none counts."""
    ok = np.isfinite(r) & np.isfinite(c)
    r, c = np.where(ok, r, -9.0), np.where(ok, c, -9.0)
    if method == "nearest":
        i, j = np.floor(r + 0.5).astype(int), np.floor(c + 0.5).astype(int)
    else:
        i, j = np.floor(r).astype(int), np.floor(c).astype(int)
    total, weight = np.zeros(r.shape), np.zeros(r.shape)
    for a in TAPS[method]:
        for b in TAPS[method]:
            y, x = i + a, j + b
            there = ok & (y >= 0) & (y < values.shape[0]) & (x >= 0) & (x < values.shape[1])
            v = np.where(there, values[np.where(there, y, 0), np.where(there, x, 0)], np.nan)
            w = np.ones(r.shape) if method == "nearest" else _weight(np.abs(r - y), method) * _weight(np.abs(c - x), method)
            use = np.isfinite(v)
            total += np.where(use, w * np.where(use, v, 0), 0)
            weight += np.where(use, w, 0)
    return np.divide(total, weight, out=np.full(r.shape, np.nan), where=weight > 1e-12)


def _reduction(source: Grid, target: Grid) -> float:
    """Source pixels a target pixel, the most along rows or columns at 17 x 17 places of the target."""
    r, c = np.linspace(0, target.height - 1, 17), np.linspace(0, target.width - 1, 17)
    most = 1.0
    for dr, dc in ((1, 0), (0, 1)):
        step = [b - a for a, b in zip(traced(source, target, r, c), traced(source, target, r + dr, c + dc))]
        size = np.hypot(*step)
        most = max(most, float(size[np.isfinite(size)].max(initial=1.0)))
    return most


def warp(df: DataFrame, source: Grid, target: Grid, method: str = "bilinear", cols: list[str] | None = None, categorical: bool = False, tolerance: float = 0.125, tile: int | None = None) -> DataFrame:
    """``(y, x, cols..)``: columns ``cols`` (``value``) of ``df(y, x, cols..)`` on ``source``, resampled at the pixel centres of ``target``.

    ``method`` is nearest, bilinear or cubic; ``categorical`` forces nearest, and
    nearest keeps the columns' types, others give doubles.  Taps that are null,
    NaN or beyond the source are left out; a target pixel without a row has no
    tap in any column, a null has none in that one.  Source places are exact to
    ``tolerance`` source pixels (0: every pixel is traced).  No longitude is
    wrapped: a grid over the date line counts on beyond 180 degrees.
    """
    cols = cols or ["value"]
    method = "nearest" if categorical else method
    reach = {"nearest": 1, "bilinear": 1, "cubic": 2}[method]
    side = tile or max(1, int(TILE / _reduction(source, target)))
    wide = -(-target.width // side)
    spark = df.sparkSession

    def frame(ty: int, tx: int) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(ty * side, min((ty + 1) * side, target.height)), np.arange(tx * side, min((tx + 1) * side, target.width))

    def footprints(batches):
        for pdf in batches:
            out = []
            for k in pdf["id"].tolist():
                r, c, _ = located(source, target, *frame(k // wide, k % wide), tolerance)
                if not np.isfinite(r).any():
                    continue
                box = [int(np.floor(np.nanmin(r))) - reach, int(np.ceil(np.nanmax(r))) + reach, int(np.floor(np.nanmin(c))) - reach, int(np.ceil(np.nanmax(c))) + reach]
                box = [max(box[0], 0), min(box[1], source.height - 1), max(box[2], 0), min(box[3], source.width - 1)]
                if box[0] <= box[1] and box[2] <= box[3]:
                    out.append((k // wide, k % wide, *box))
            yield pd.DataFrame(out, columns=["ty", "tx", "r0", "r1", "c0", "c1"], dtype="int64")

    tiles = spark.range(-(-target.height // side) * wide).mapInPandas(footprints, "ty bigint, tx bigint, r0 bigint, r1 bigint, c0 bigint, c1 bigint")
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BLOCK), F.floor(F.col(b) / BLOCK)))
    needs = tiles.withColumn("_by", blocks("r0", "r1")).withColumn("_bx", blocks("c0", "c1"))
    pixels = df.select("y", "x", *cols, F.floor(F.col("y") / BLOCK).alias("_by"), F.floor(F.col("x") / BLOCK).alias("_bx"))
    met = pixels.join(needs, ["_by", "_bx"]).filter("y BETWEEN r0 AND r1 AND x BETWEEN c0 AND c1").drop("_by", "_bx")
    kinds = {c: df.schema[c].dataType.simpleString() if method == "nearest" else "double" for c in cols}
    return met.groupBy("ty", "tx").applyInPandas(_resampler(source, target, frame, cols, kinds, method, tolerance), "y bigint, x bigint, " + ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def _resampler(source: Grid, target: Grid, frame: Callable, cols: list[str], kinds: dict[str, str], method: str, tolerance: float) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = frame(int(key[0]), int(key[1]))
        r, c, _ = located(source, target, rows, columns, tolerance)
        r0, r1, c0, c1 = (int(pdf[k].iloc[0]) for k in ("r0", "r1", "c0", "c1"))
        at = pdf["y"].to_numpy() - r0, pdf["x"].to_numpy() - c0
        found = {}
        for name in cols:
            dense = np.full((r1 - r0 + 1, c1 - c0 + 1), np.nan)
            dense[at] = pdf[name].to_numpy(dtype=float)
            found[name] = sampled(dense, r - r0, c - c0, method)
        keep = np.any([np.isfinite(v) for v in found.values()], axis=0)
        i, j = np.nonzero(keep)
        out = pd.DataFrame({"y": rows[i], "x": columns[j]})
        for name, v in found.items():
            got = pd.Series(v[keep])
            out[name] = got.round().astype("Int64") if "int" in kinds[name] else got
        return out

    return run

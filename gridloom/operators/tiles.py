"""Window kernels on tiles with a halo.

Pixels go once to their own tile and, where they lie within the radius of a
tile's edge, to that neighbour as well; a tile is a few dense arrays and a kernel
works on all of its windows at once.  The shuffle is (1 + border share) rows a
pixel, whatever the window's size, and a task holds one tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256


def by_tiles(df: DataFrame, cols: list[str], radius: int, kernel: Callable, outputs: list[str], border: str = "clamp", every: bool = False) -> DataFrame:
    """``(y, x, outputs..)`` of doubles from ``kernel(arrays, radius)``.

    ``arrays`` has an array of (rows + 2 radius) x (columns + 2 radius) doubles
    per column, NaN where a value is missing, and the kernel gives one of rows x
    columns per output (NaN becomes null).  ``border`` clamp repeats the edge of
    the raster outwards; none leaves it missing.  Pixels without a row get none,
    unless ``every``: then each place whose window has a row gets one.
    """
    size = max(SIZE, 2 * radius)
    sized = df.select("y", "x", *[F.col(c).cast("double").alias(c) for c in cols]).crossJoin(F.broadcast(df.agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))))
    span = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - radius) / size), F.lit(0)), F.floor((F.col(c) + radius) / size)))
    placed = sized.withColumn("_ty", span("y")).withColumn("_tx", span("x")).filter((F.col("_ty") * size <= F.col("_my")) & (F.col("_tx") * size <= F.col("_mx")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = (int(k) for k in key)
        last = int(pdf["_my"].iloc[0]), int(pdf["_mx"].iloc[0])
        y0, x0 = ty * size, tx * size
        height, width = min(size, last[0] + 1 - y0), min(size, last[1] + 1 - x0)
        at = pdf["y"].to_numpy() - y0 + radius, pdf["x"].to_numpy() - x0 + radius
        rows, columns = (np.arange(-radius, n + radius) for n in (height, width))
        if border == "clamp":
            rows, columns = np.clip(rows, -y0, last[0] - y0), np.clip(columns, -x0, last[1] - x0)
        inner = np.ix_(rows + radius, columns + radius)

        def dense(values):
            out = np.full((size + 2 * radius, size + 2 * radius), np.nan)
            out[at] = values
            return out[inner]

        there = dense(1.0)
        found = kernel({c: dense(pdf[c].to_numpy(dtype=float)) for c in cols}, radius)
        if every and radius:
            there = there == 1
            keep = sliding_window_view(there, (2 * radius + 1,) * 2).any(axis=(2, 3))
        else:
            keep = there[radius : radius + height, radius : radius + width] == 1
        y, x = np.nonzero(keep)
        return pd.DataFrame({"y": y + y0, "x": x + x0} | {n: found[k][keep] for k, n in enumerate(outputs)})

    kinds = {n: df.schema[n].dataType.simpleString() for n in ("y", "x")}
    got = placed.groupBy("_ty", "_tx").applyInPandas(run, f"y {kinds['y']}, x {kinds['x']}, " + ", ".join(f"{n} double" for n in outputs))
    return got.select("y", "x", *[F.nanvl(F.col(n), F.lit(None).cast("double")).alias(n) for n in outputs])


def shifted(a: np.ndarray, radius: int, dy: int, dx: int) -> np.ndarray:
    """The neighbours at (dy, dx) of all inner pixels."""
    return a[radius + dy : a.shape[0] - radius + dy, radius + dx : a.shape[1] - radius + dx]


def strips(a: np.ndarray, radius: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``f`` of the windows (rows x columns x window) of all inner pixels, some rows at a time."""
    k = 2 * radius + 1
    windows = sliding_window_view(a, (k, k))
    step = max(1, 2_000_000 // (windows.shape[1] * k * k))
    return np.concatenate([f(windows[n : n + step].reshape(-1, windows.shape[1], k * k)) for n in range(0, windows.shape[0], step)])

"""Grey-scale morphology with square and ball elements of any radius, geodesic reconstruction and morphological profiles.

Erosion and dilation work on tiles with a halo of the radius, by running extrema
along rows that double their length.  Reconstruction has no radius: what a tile
holds may depend on any other.  Tiles are reconstructed with the values that
their neighbours' edges have so far; only those whose surroundings changed are
taken up again, and only edges are kept between rounds, until no edge changes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import _drop, _written
from .tiles import by_tiles

#: Side of the tiles of a reconstruction.
TILE = 256


def _running(a: np.ndarray, n: int, f: Callable) -> np.ndarray:
    """``f`` over every ``n`` neighbours of a row, by windows that double."""
    done, out = 1, a
    while done < n:
        step = min(done, n - done)
        out = f(out[:, : out.shape[1] - step], out[:, step:])
        done += step
    return out


def element(radius: int, shape: str) -> list[int]:
    """Half widths of the element's rows, from the top: all ``radius`` for a square, those of the disc y² + x² <= radius² for a ball."""
    return [radius if shape == "square" else int(np.sqrt(radius * radius - d * d)) for d in range(-radius, radius + 1)]


def _kernel(halves: list[int], f: Callable, outside: float) -> Callable:
    def kernel(arrays: dict[str, np.ndarray], halo: int) -> list[np.ndarray]:
        a = arrays["value"]
        height, width = a.shape[0] - 2 * halo, a.shape[1] - 2 * halo
        filled = np.where(np.isnan(a), outside, a)
        rows = {h: _running(filled, 2 * h + 1, f) for h in set(halves)}
        parts = [rows[h][k : k + height, halo - h : halo - h + width] for k, h in enumerate(halves)]
        out = reduce(f, parts)
        return [np.where(np.isnan(a[halo : halo + height, halo : halo + width]), np.nan, out)]

    return kernel


def shaped(df: DataFrame, how: str, radius: int = 1, shape: str = "ball") -> DataFrame:
    """``(y, x, value)``: erode, dilate, open or close with a square or ball of ``radius``; missing values stay missing and count for nothing."""
    if how in ("open", "close"):
        first, second = ("erode", "dilate") if how == "open" else ("dilate", "erode")
        return shaped(shaped(df, first, radius, shape), second, radius, shape)
    f, outside = {"erode": (np.minimum, np.inf), "dilate": (np.maximum, -np.inf)}[how]
    return by_tiles(df, ["value"], radius, _kernel(element(radius, shape), f, outside), ["value"], border="none")


def _grown_under(g: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Greatest of what 8-connected dilation of ``g`` reaches without rising over ``mask``: sweeps in four directions until nothing changes."""
    g = np.minimum(g, mask)
    while True:
        before = g.copy()
        for v, m in ((g, mask), (g[::-1], mask[::-1]), (g.T, mask.T), (g.T[::-1], mask.T[::-1])):
            for k in range(1, len(v)):
                last = v[k - 1]
                near = np.maximum(last, np.maximum(np.concatenate([last[1:], last[-1:]]), np.concatenate([last[:1], last[:-1]])))
                v[k] = np.minimum(np.maximum(v[k], near), m[k])
        if np.array_equal(g, before):
            return g


def reconstruct(df: DataFrame, marker: str = "marker", mask: str = "mask") -> DataFrame:
    """``(y, x, value)``: reconstruction by dilation, the markers grown over 8 neighbours as far as the mask lets them, pixel by pixel no higher than it.

    Markers over the mask are cut to it; a null marker is lower than everything.
    Pixels with a null mask have a null value and stop growth.  A round takes up
    the tiles whose surroundings changed; values only grow and are values of the
    input, so rounds end.
    """
    size = TILE
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    base = _written(df.select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), number(marker).alias("g"), number(mask).alias("m"), *[F.floor(F.col(c) / size).alias(f"t{c}") for c in "yx"]))

    def tile(border: bool) -> Callable:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            oy, ox = int(key[0]) * size - 1, int(key[1]) * size - 1
            y, x = pdf["y"].to_numpy() - oy, pdf["x"].to_numpy() - ox
            own = pdf["own"].to_numpy(dtype=bool)
            m, g = np.full((size + 2, size + 2), -np.inf), np.full((size + 2, size + 2), -np.inf)
            known = pdf["m"].notna().to_numpy()
            m[y[known], x[known]] = pdf["m"].to_numpy(dtype=float)[known]
            v = pdf["g"].fillna(-np.inf).to_numpy(dtype=float)
            g[y[known], x[known]] = v[known]
            g = _grown_under(g, m)
            keep = own & known if not border else own & known & ((y == 1) | (y == size) | (x == 1) | (x == size))
            out = pd.DataFrame({"y": y[keep] + oy, "x": x[keep] + ox, "m": m[y[keep], x[keep]], "g": g[y[keep], x[keep]]})
            return out if border else out[["y", "x", "g"]]

        return run

    def around(edges: DataFrame) -> DataFrame:
        """Edge pixels in the tiles that they border, their own left out."""
        span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / size), F.floor((F.col(c) + 1) / size)))
        near = edges.withColumn("ty", span("y")).withColumn("tx", span("x"))
        return near.filter((F.col("ty") != F.floor(F.col("y") / size)) | (F.col("tx") != F.floor(F.col("x") / size)))

    def taken(pixels: DataFrame, halo: DataFrame, border: bool) -> DataFrame:
        names = ["ty", "tx", "y", "x", "g", "m"]
        both = pixels.select(*names, F.lit(True).alias("own")).union(halo.select(*names, F.lit(False).alias("own")))
        return both.groupBy("ty", "tx").applyInPandas(tile(border), "y bigint, x bigint, " + ("m double, g double" if border else "g double"))

    at_edge = " OR ".join(f"{c} % {size} IN (0, {size - 1})" for c in "yx")
    edges = _written(base.filter(at_edge).filter("m IS NOT NULL").select("y", "x", "m", F.least(F.coalesce("g", F.lit(float("-inf"))), F.col("m")).alias("g")))
    active = base.select("ty", "tx").distinct()
    while True:
        # halos of the active tiles; a tile's own edges come back with what they are now
        halo = around(edges).join(active, ["ty", "tx"], "left_semi")
        new = _written(taken(base.join(active, ["ty", "tx"], "left_semi"), halo, True).select("y", "x", F.col("g").alias("n")))
        old, edges = edges, _written(edges.join(new, ["y", "x"], "left").select("y", "x", "m", F.greatest("g", F.coalesce("n", "g")).alias("g"), (F.coalesce("n", "g") > F.col("g")).alias("rose")))
        rose = _written(around(edges.filter("rose")).select("ty", "tx").distinct())
        edges_next = edges.drop("rose")
        _drop(old, new)
        if rose.isEmpty():
            break
        edges, active = _written(edges_next), rose
    out = taken(base, around(edges), False)
    filled = base.select("y", "x").join(out, ["y", "x"], "left")
    return filled.select("y", "x", F.when(F.abs("g") != float("inf"), F.col("g")).alias("value"))


def by_reconstruction(df: DataFrame, how: str = "open", radius: int = 1, shape: str = "ball") -> DataFrame:
    """``(y, x, value)``: opening or closing by reconstruction, what an erosion (dilation) leaves grown back under (over) the picture: shapes stay whole or go."""
    sign = {"open": 1.0, "close": -1.0}[how]
    px = df.select("y", "x", (F.col("value") * sign).alias("value"))
    both = px.withColumnRenamed("value", "mask").join(shaped(px, "erode", radius, shape).withColumnRenamed("value", "marker"), ["y", "x"])
    return reconstruct(both).select("y", "x", (F.col("value") * sign + 0.0).alias("value"))


def profile(df: DataFrame, radii: list[int], how: str = "open", shape: str = "ball") -> DataFrame:
    """``(y, x, p<r>.., d<r>..)``: the picture opened (closed) by reconstruction at growing radii, and by how much each step changes it."""
    out, before = df.select("y", "x", F.col("value").cast("double").alias("_last")), "_last"
    for r in radii:
        out = out.join(by_reconstruction(df, how, r, shape).withColumnRenamed("value", f"p{r}"), ["y", "x"])
        out = out.withColumn(f"d{r}", F.abs(F.col(f"p{r}") - F.col(before)))
        before = f"p{r}"
    return out.drop("_last")

"""Exact distance transform without a bound on the distance.

Squared distance splits by axes: the nearest target of a pixel is the least, over
the columns of its row, of (columns between)² + (rows to that column's nearest
target)².  The raster is cut into strips of whole rows.  What lies beyond a strip
is carried in as two numbers a column, the last target above and the first one
below, so a strip is worked on by itself: rows to the nearest target column by
column, then the lower envelope of the row's parabolas.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pixels in a strip, and rows at most.
PIXELS, ROWS = 2_000_000, 256


def envelope(f: np.ndarray) -> np.ndarray:
    """For every row of ``f`` and column x the least (x - c)² + f[row, c] over the columns c; infinite values count for nothing.

    The best column moves right as x does.  So columns are settled coarse to
    fine: one between two settled ones looks only from the one's best column to
    the other's, and a level costs a row's length, all rows at once.
    """
    rows, width = f.shape
    best = np.zeros((rows, width), dtype=np.int64)
    out = np.full(f.shape, np.inf)
    step = 1 << max(width - 1, 0).bit_length()
    while step:
        x = np.arange(step - 1, width, 2 * step) if step > 1 else np.arange(0, width, 2)
        if len(x):
            r, c = (v.ravel() for v in np.meshgrid(np.arange(rows), x, indexing="ij"))
            low = np.where(c - step >= 0, best[r, np.maximum(c - step, 0)], 0)
            high = np.where(c + step < width, best[r, np.minimum(c + step, width - 1)], width - 1)
            n = high - low + 1
            begin = np.cumsum(n) - n
            each = np.repeat(np.arange(len(r)), n)
            at = np.arange(n.sum()) - begin[each] + low[each]
            cost = (c[each] - at) ** 2.0 + f[r[each], at]
            least = np.minimum.reduceat(cost, begin)
            out[r, c] = least
            best[r, c] = np.minimum.reduceat(np.where(cost == least[each], at, width), begin)
        step //= 2
    return out


def _carried(targets: DataFrame, strips: int) -> DataFrame:
    """``(strip, x, above, below)``: the last target of column ``x`` above the strip and the first one below, for columns with a target.

    One row a strip and column that hold a target; the strips between two of
    them see the same two rows.
    """
    ends = targets.groupBy("strip", "x").agg(F.min("y").alias("first"), F.max("y").alias("last"))
    down = Window.partitionBy("x").orderBy("strip")
    ends = ends.select("*", F.lag("last").over(down).alias("before"), F.lead("first").over(down).alias("after"), F.coalesce(F.lead("strip").over(down), F.lit(strips)).alias("next"), F.row_number().over(down).alias("k"))
    part = lambda a, b, above, below: F.struct(a.alias("a"), b.alias("b"), above.cast("bigint").alias("above"), below.cast("bigint").alias("below"))
    own = part(F.col("strip"), F.col("strip"), F.col("before"), F.col("after"))
    behind = part(F.col("strip") + 1, F.col("next") - 1, F.col("last"), F.col("after"))
    ahead = part(F.lit(0), F.when(F.col("k") == 1, F.col("strip") - 1).otherwise(-1), F.lit(None), F.col("first"))
    spans = ends.select("x", F.explode(F.array(own, behind, ahead)).alias("s")).filter("s.a <= s.b")
    return spans.select(F.explode(F.sequence("s.a", "s.b")).alias("strip"), "x", "s.above", "s.below")


def distance_transform(df: DataFrame, where: str | Column, limit: float | None = None, rows: int | None = None) -> DataFrame:
    """``(y, x, distance)``: distance in pixels from every row of ``df(y, x, ..)`` to the nearest one that passes ``where`` (0 for those), exact at any distance.

    Null where there is no target at all, or none within ``limit``.  ``y`` and
    ``x`` count from 0; places without a row take no part but do not shadow
    others.  A task holds one strip of whole rows; a pixel is shuffled once.
    """
    test = F.expr(where) if isinstance(where, str) else where
    px = df.select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.coalesce(test, F.lit(False)).alias("hit"))
    last = px.agg(F.max("y"), F.max("x")).first()
    height, width = (last[0] or 0) + 1, (last[1] or 0) + 1
    size = rows or max(1, min(ROWS, PIXELS // width))
    px = px.withColumn("strip", F.floor(F.col("y") / size))
    carried = _carried(px.filter("hit").select("strip", "y", "x"), -(-height // size))
    kinds = [F.lit(None).cast("bigint").alias(c) for c in ("above", "below")]
    both = px.select("strip", "y", "x", "hit", *kinds).unionByName(carried.select("strip", F.lit(None).cast("bigint").alias("y"), "x", F.lit(None).cast("boolean").alias("hit"), "above", "below"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(key[0]) * size
        pixels = pdf[pdf["y"].notna()]
        sides = pdf[pdf["y"].isna()]
        if pixels.empty:
            return pd.DataFrame({"y": [], "x": [], "distance": []})
        y, x = pixels["y"].to_numpy(dtype=np.int64) - top, pixels["x"].to_numpy(dtype=np.int64)
        tall = int(y.max()) + 1
        up, down = np.full((tall, width), -np.inf), np.full((tall, width), np.inf)
        hit = pixels["hit"].to_numpy(dtype=bool)
        up[y[hit], x[hit]] = down[y[hit], x[hit]] = y[hit]
        over, under = np.full(width, -np.inf), np.full(width, np.inf)
        c = sides["x"].to_numpy(dtype=np.int64)
        over[c] = sides["above"].fillna(-np.inf).to_numpy(dtype=float) - top
        under[c] = sides["below"].fillna(np.inf).to_numpy(dtype=float) - top
        up = np.maximum.accumulate(np.maximum(up, over), axis=0)
        down = np.minimum.accumulate(np.minimum(down, under)[::-1], axis=0)[::-1]
        at = np.arange(tall)[:, None]
        found = np.sqrt(envelope(np.minimum(at - up, down - at) ** 2)[y, x])
        found[~np.isfinite(found) | (found > (np.inf if limit is None else limit))] = np.nan
        return pd.DataFrame({"y": y + top, "x": x, "distance": found})

    out = both.groupBy("strip").applyInPandas(run, "y bigint, x bigint, distance double")
    return out.select("y", "x", F.nanvl("distance", F.lit(None).cast("double")).alias("distance"))

"""Scene-statistics and spectral operators: aggregates for the scene, column expressions for the pixel.

Matrices of band count size are solved on the driver from one aggregate; pixels never leave the executors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from .stats import covariance, order_statistics, quantiles


def array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


# --- atmosphere and stretches


def with_scalars(df: DataFrame, *aggs) -> DataFrame:
    """One aggregate row beside every row."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def dos1(df: DataFrame, col: str = "value") -> DataFrame:
    """Value less the scene's least."""
    return with_scalars(df, F.min(col).alias("_lo")).withColumn(col, F.col(col) - F.col("_lo")).drop("_lo")


def dark_object(df: DataFrame, col: str = "value", bins: int = 1024) -> DataFrame:
    """One row ``dark``: lower edge of the lowest of ``bins`` bins that holds max(2, n / 10000) pixels."""
    s = with_scalars(df.select(col), F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(col).alias("_n"))
    b = F.least(F.floor((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    h = s.groupBy(b.alias("bin"), "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= F.greatest(F.lit(2), F.floor(F.col("_n") / 10000)))
    return h.agg(F.min(F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("dark"))


def dos2(df: DataFrame, path: float, airmass: float, col: str = "value") -> DataFrame:
    return df.withColumn(col, (F.col(col) - path) / float(np.exp(-0.1 * airmass)))


def quac(df: DataFrame, bands: list[str]) -> DataFrame:
    """Each band less its first percentile, over the reach to the 99th, so that the mean bright end is 0.5; clipped to [0, 1]."""
    out = {}
    for b in bands:
        low, high = (F.lit(v).cast("double") for v in quantiles(df, b, [0.01, 0.99]))
        out[b] = F.least(F.greatest(ratio(F.col(b) - low, high - low) * 0.5, F.lit(0.0)), F.lit(1.0))
    return df.withColumns(out)


def percent_clip(df: DataFrame, col: str, percent: float = 2.0) -> DataFrame:
    low, high = (F.lit(v).cast("double") for v in quantiles(df, col, [percent / 100, 1 - percent / 100]))
    return df.withColumn(col, F.least(F.greatest((F.col(col) - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255)


def stddev_stretch(df: DataFrame, col: str, k: float = 2.0) -> DataFrame:
    s = with_scalars(df, F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    lo, hi = F.col("_m") - k * F.col("_s"), F.col("_m") + k * F.col("_s")
    return s.withColumn(col, F.least(F.greatest((F.col(col) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * 255).drop("_m", "_s")


def equalize(df: DataFrame, col: str, bins: int = 256) -> DataFrame:
    """By the cumulative histogram: darkest filled bin 0, brightest 255."""
    s = with_scalars(df, F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    s = s.withColumn("_b", F.least(F.floor((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    h = s.groupBy("_b").agg(F.count(F.lit(1)).alias("k"))  # at most `bins` rows
    h = h.withColumn("c", F.sum("k").over(Window.orderBy("_b")))
    h = h.crossJoin(F.broadcast(h.agg(F.min("c").alias("c0"), F.max("c").alias("n")))).select("_b", ((F.col("c") - F.col("c0")) / (F.col("n") - F.col("c0")) * 255).alias("_v"))
    return s.join(F.broadcast(h), "_b").withColumn(col, F.col("_v")).drop("_b", "_v", "_lo", "_hi")


# --- change and thresholds


def change(df: DataFrame, before: str, after: str, how: str) -> Column:
    a, b = F.col(after), F.col(before)
    return {"difference": a - b, "normalized": ratio(a - b, a + b), "ratio": ratio(a, b)}[how]


def change_vector(before: list[str], after: list[str]) -> Column:
    return F.sqrt(sum([(F.col(a) - F.col(b)) ** 2 for a, b in zip(after[1:], before[1:])], (F.col(after[0]) - F.col(before[0])) ** 2))


def otsu(df: DataFrame, col: str, bins: int = 256) -> DataFrame:
    """One row ``threshold``: centre of the bin that maximises the variance between classes; ties to the first bin."""
    s = with_scalars(df.select(col), F.min(col).alias("lo"), F.max(col).alias("hi"))
    b = F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1))
    h = s.groupBy(b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy("bin")  # at most `bins` rows
    h = h.withColumns({"w0": F.sum("k").over(w), "m0": F.sum(F.col("k") * F.col("bin")).over(w)}).crossJoin(F.broadcast(h.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("bin")).alias("m"))))
    d = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / (F.col("n") - F.col("w0"))
    h = h.filter("w0 < n").withColumn("between", F.col("w0").cast("double") * (F.col("n") - F.col("w0")) * d * d)
    best = h.agg(F.min_by(F.struct("bin", "lo", "hi"), F.struct(-F.col("between"), F.col("bin"))).alias("t"))
    return best.select((F.col("t.lo") + (F.col("t.bin") + 0.5) * (F.col("t.hi") - F.col("t.lo")) / (bins - 1)).alias("threshold"))


def rank_percentile(df: DataFrame, col: str, p: float) -> DataFrame:
    """One row ``threshold`` by nearest rank: the value at ceil(p / 100 * n), from counts of distinct values."""
    n = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).count()
    value = order_statistics(df, col, [max(math.ceil(p / 100 * n) - 1, 0)])[0] if n else None
    return df.sparkSession.range(1).select(F.lit(value).cast("double").alias("threshold"))


def over(df: DataFrame, col: str, threshold: DataFrame) -> DataFrame:
    """``mask``: 1 where the value reaches the one-row ``threshold``."""
    return df.crossJoin(F.broadcast(threshold)).withColumn("mask", (F.col(col) >= F.col("threshold")).cast("int")).drop("threshold")


# --- band algebra on arrays


def with_array(df: DataFrame, bands: list[str], name: str = "spectrum") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(b).cast("double") for b in bands]))


def valid(spectrum: Column) -> Column:
    return F.forall(spectrum, lambda v: v.isNotNull() & ~F.isnan(v))


def _moments(df: DataFrame, size: int, col: str = "spectrum"):
    r = covariance(df.filter(valid(F.col(col))), col, size).first()
    return r["n"], np.array(r["mean"]), np.array(r["cov"]).reshape(size, size)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest loading is positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[top, range(vectors.shape[1])])


def pca(df: DataFrame, size: int, keep: int | None = None, col: str = "spectrum") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``scores`` array of the first ``keep`` components; also variances and loadings."""
    _, mean, cov = _moments(df, size, col)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val, kind="stable")
    val, vec = val[order], _signed(vec[:, order])
    centred = F.zip_with(F.col(col), array(mean), lambda x, m: x - m)
    out = F.when(valid(F.col(col)), F.array(*[dot(centred, array(vec[:, k])) for k in range(keep or size)]))
    return df.withColumn("scores", out), val, vec


def mnf(df: DataFrame, size: int, keep: int | None = None, col: str = "spectrum") -> tuple[DataFrame, np.ndarray]:
    """Minimum noise fraction: noise covariance from right-neighbour differences, whitened components by signal-to-noise."""
    n = df.select("y", (F.col("x") - 1).alias("x"), F.col(col).alias("_n"))
    diff = df.join(n, ["y", "x"]).select(F.zip_with(F.col(col), F.col("_n"), lambda a, b: (a - b) / float(np.sqrt(2))).alias("spectrum"))
    _, _, noise = _moments(diff, size)
    _, mean, cov = _moments(df, size, col)
    val, vec = np.linalg.eigh(noise)
    white = vec / np.sqrt(np.maximum(val, 1e-12))
    snr, turn = np.linalg.eigh(white.T @ cov @ white)
    order = np.argsort(-snr)
    basis = _signed(white @ turn[:, order])
    centred = F.zip_with(F.col(col), array(mean), lambda x, m: x - m)
    return df.withColumn("scores", F.array(*[dot(centred, array(basis[:, k])) for k in range(keep or size)])), snr[order]


def mad(df: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """Multivariate alteration detection: canonical variates of two dates, and their chi-square sum.

    ``df`` has both dates' bands; a pixel counts when finite in all of them.
    """
    k = len(before)
    both = with_array(df, before + after)
    n, mean, cov = _moments(both, 2 * k)
    if n < k + 2:
        raise ValueError("too few valid pixels")
    ridge = 1e-9 * np.eye(k)
    sxx, syy, sxy = cov[:k, :k] + ridge, cov[k:, k:] + ridge, cov[:k, k:]
    lx, ly = np.linalg.cholesky(sxx), np.linalg.cholesky(syy)
    u, rho, vt = np.linalg.svd(np.linalg.solve(lx, sxy) @ np.linalg.inv(ly).T)
    a, b = np.linalg.solve(lx.T, u), np.linalg.solve(ly.T, vt.T)
    c = F.zip_with("spectrum", array(mean), lambda x, m: x - m)
    var = np.maximum(2 * (1 - rho), 1e-12)
    variates = F.array(*[dot(c, array([*a[:, i], *(-b[:, i])])) for i in range(k)])
    out = both.withColumn("variates", F.when(valid(F.col("spectrum")), variates))
    return out.withColumn("chi2", dot(F.transform("variates", lambda v: v * v), array(1 / var))).drop("spectrum")


def fuse(df: DataFrame, bands: list[str], pan: str, how: str, weights: list[float] | None = None, pan_weight: float = 0.5) -> DataFrame:
    """Pan-sharpened bands: linear, brovey, gram_schmidt, ihs (three bands) or pca."""
    p, cols = F.col(pan), [F.col(b) for b in bands]
    if how == "linear":
        w = weights or [1 - pan_weight] * len(bands)
        return df.withColumns({b: F.col(b) * x + p * pan_weight for b, x in zip(bands, w)})
    if how == "brovey":
        s = sum(cols[1:], cols[0])
        return df.withColumns({b: ratio(F.col(b), s) * p for b in bands})
    if how == "gram_schmidt":
        df = df.withColumn("_i", sum(cols[1:], cols[0]) / len(bands))
        s = with_scalars(df, F.avg("_i").alias("_im"), F.stddev_pop("_i").alias("_is"), F.avg(pan).alias("_pm"), F.stddev_pop(pan).alias("_ps"), *[(F.covar_pop(b, "_i") / F.var_pop("_i")).alias(f"_g{b}") for b in bands])
        sharp = (p - F.col("_pm")) * F.col("_is") / F.col("_ps") + F.col("_im")
        return s.withColumns({b: F.col(b) + F.col(f"_g{b}") * (sharp - F.col("_i")) for b in bands}).drop("_i", "_im", "_is", "_pm", "_ps", *[f"_g{b}" for b in bands])
    if how == "ihs":
        df = df.withColumn("_i", sum(cols[1:], cols[0]) / len(bands))
        s = with_scalars(df, F.avg("_i").alias("_im"), F.stddev_pop("_i").alias("_is"), F.avg(pan).alias("_pm"), F.stddev_pop(pan).alias("_ps"))
        step = (p - F.col("_pm")) * F.col("_is") / F.col("_ps") + F.col("_im") - F.col("_i")
        return s.withColumns({b: F.col(b) + step for b in bands}).drop("_i", "_im", "_is", "_pm", "_ps")
    if how == "pca":
        scored, val, vec = pca(with_array(df, bands), len(bands))
        s = with_scalars(scored, F.avg(pan).alias("_pm"), F.stddev_pop(pan).alias("_ps"))
        step = (p - F.col("_pm")) * float(np.sqrt(val[0])) / F.col("_ps") - F.col("scores")[0]
        return s.withColumns({b: F.col(b) + step * float(vec[k, 0]) for k, b in enumerate(bands)}).drop("spectrum", "scores", "_pm", "_ps")
    raise ValueError(how)


# --- matrices of a batch


def by_rows(fn, returns: str):
    """A column function from ``fn(matrix) -> rows``: arrays of a batch stand as rows of one matrix; null arrays and arrays with a missing value give null."""

    @F.arrow_udf(returns)
    def run(spectra: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(spectra), 0).to_numpy(zero_copy_only=False)
        size = int(lengths.max(initial=0))
        whole = lengths == size
        flat = np.full((len(spectra), size), np.nan)
        flat[whole] = spectra.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        ok = ~np.isnan(flat).any(axis=1) & (lengths > 0)
        found = fn(flat[ok]) if ok.any() else np.empty((0, 1))
        if returns == "double":
            values = np.zeros(len(ok))
            values[ok] = found.reshape(-1)
            return pa.array(values, mask=~ok)
        ends = np.concatenate([[0], np.cumsum(ok * found.shape[1])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()), mask=pa.array(~ok))

    return run


# --- spectra against references


def sam(a: Column, b: Column) -> Column:
    """Spectral angle."""
    return F.acos(F.least(F.greatest(ratio(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(-1.0)), F.lit(1.0)))


def sid(a: Column, b: Column) -> Column:
    """Spectral information divergence of positive spectra."""
    p, q = _unit(a), _unit(b)
    return total(F.zip_with(p, q, lambda x, y: (x - y) * (F.log(x) - F.log(y))))


def _unit(a):
    return F.transform(a, lambda v: v / total(a))


def angles_to(references: np.ndarray):
    """A column function: spectral angles to every row of ``references``, one matrix product a batch."""
    unit = references / np.maximum(np.linalg.norm(references, axis=1, keepdims=True), 1e-300)

    def run(x):
        size = np.linalg.norm(x, axis=1, keepdims=True)
        cos = np.divide(x @ unit.T, size, out=np.full((len(x), len(unit)), np.nan), where=size > 0)
        return np.arccos(np.clip(cos, -1, 1))

    return by_rows(run, "array<double>")


def match(df: DataFrame, library: DataFrame, key: list[str], k: int = 1) -> DataFrame:
    """The ``k`` nearest entries of a small library ``(name, reference)`` (class spectra, collected) for every spectrum: rank by SAM, ties by name.

    ``sid`` stands beside the angle, null where a value is not positive; a spectrum with a missing value has no rows.  Nothing is shuffled.
    """
    entries = library.select("name", F.col("reference").cast("array<double>")).orderBy("name").collect()  # a small library
    angles = angles_to(np.array([r["reference"] for r in entries]))
    ranked = F.array_sort(F.transform(angles(F.col("spectrum").cast("array<double>")), lambda a, i: F.struct(a.alias("angle"), i.alias("i"))))
    best = df.select(*key, "spectrum", F.posexplode(F.slice(ranked, 1, k)).alias("rank", "_b"))
    pick = lambda values: F.get(F.array(*values), F.col("_b.i"))
    out = best.select(*key, "spectrum", (F.col("rank") + 1).alias("rank"), F.col("_b.angle").alias("angle"), pick([F.lit(r["name"]) for r in entries]).alias("name"), pick([array(r["reference"]) for r in entries]).alias("reference"))
    divergence = F.when(F.forall("spectrum", lambda v: v > 0) & F.forall("reference", lambda v: v > 0), sid(F.col("spectrum"), F.col("reference")))
    return out.select(*key, "name", "angle", divergence.alias("sid"), "rank", "spectrum", "reference")


def classify_sam(df: DataFrame, references: list[tuple[int, list[float]]], limit: float | None = None) -> DataFrame:
    """Class of the smallest angle (ties to the first), -1 for spectra without a value or beyond ``limit``."""
    angles = angles_to(np.array([r for _, r in references]))(F.col("spectrum").cast("array<double>"))
    out = df.withColumn("_a", angles).withColumn("angle", F.array_min("_a"))
    classes = F.get(F.array(*[F.lit(c) for c, _ in references]), F.array_position("_a", F.col("angle")).cast("int") - 1)
    ok = F.col("angle").isNotNull() if limit is None else F.col("angle") <= limit
    return out.withColumn("class", F.when(ok, classes).otherwise(-1)).drop("_a")


def continuum(df: DataFrame, key: list[str], positions: list[float] | None = None) -> DataFrame:
    """Spectra divided by their upper convex hull over band index or wavelength; a batch at a time."""

    def run(it):
        for pdf in it:
            out = []
            for s in pdf["spectrum"]:
                y = np.asarray(s, dtype=float)
                x = np.arange(len(y), dtype=float) if positions is None else np.asarray(positions, dtype=float)
                hull: list[int] = []
                for k in range(len(y)):
                    while len(hull) > 1 and (y[hull[-1]] - y[hull[-2]]) * (x[k] - x[hull[-2]]) <= (y[k] - y[hull[-2]]) * (x[hull[-1]] - x[hull[-2]]):
                        hull.pop()
                    hull.append(k)
                out.append((y / np.interp(x, x[hull], y[hull])).tolist())
            yield pd.DataFrame({**{k: pdf[k] for k in key}, "removed": out})

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    return df.select(*key, "spectrum").mapInPandas(run, f"{fields}, removed array<double>")


def linear_weights(source: list[float], target: list[float]) -> np.ndarray:
    """Rows of interpolation weights; NaN rows outside the source."""
    out = np.zeros((len(target), len(source)))
    for t, w in enumerate(target):
        if w < source[0] or w > source[-1]:
            out[t] = np.nan
            continue
        k = min(max(int(np.searchsorted(source, w, side="right")) - 1, 0), len(source) - 2)
        f = (w - source[k]) / (source[k + 1] - source[k])
        out[t, k], out[t, k + 1] = 1 - f, f
    return out


def gaussian_weights(source: list[float], target: list[float], fwhm: list[float]) -> np.ndarray:
    """Normalised response weights, sigma = FWHM / 2.35482, cut at 3.5 FWHM."""
    d = np.asarray(source)[None, :] - np.asarray(target)[:, None]
    f = np.asarray(fwhm)[:, None]
    w = np.where(np.abs(d) <= 3.5 * f, np.exp(-(d**2) / (2 * (f / 2.35482) ** 2)), 0)
    s = w.sum(1, keepdims=True)
    return np.where(s > 0, w / np.where(s > 0, s, 1), np.nan)


def resample_spectra(df: DataFrame, weights: np.ndarray) -> DataFrame:
    rows = []
    for w in weights:
        at = np.flatnonzero(np.nan_to_num(w) != 0)
        rows.append(F.lit(None).cast("double") if np.isnan(w).any() else dot(F.array(*[F.col("spectrum")[int(k)] for k in at]), array(w[at])))
    return df.withColumn("spectrum", F.array(*rows))


def unmix(df: DataFrame, endmembers: np.ndarray) -> DataFrame:
    """Ridge least-squares fractions, clipped to [0, 1], scaled to sum 1, and the residual RMSE.  ``endmembers`` is members x bands."""
    e = endmembers.T
    g = e.T @ e
    solve = np.linalg.solve(g + max(1e-9, np.trace(g) / len(g) * 1e-7) * np.eye(len(g)), e.T)
    raw = F.array(*[F.least(F.greatest(dot(F.col("spectrum"), array(r)), F.lit(0.0)), F.lit(1.0)) for r in solve])
    out = df.withColumn("_f", raw).withColumn("_s", total(F.col("_f")))
    out = out.withColumn("fractions", F.when(F.col("_s") > 1e-12, F.transform("_f", lambda f: f / F.col("_s"))).otherwise(F.col("_f")))
    fit = [dot(F.col("fractions"), array(b)) for b in e]
    err = sum([(F.col("spectrum")[k] - f) ** 2 for k, f in enumerate(fit[1:], 1)], (F.col("spectrum")[0] - fit[0]) ** 2)
    return out.withColumn("rmse", F.sqrt(err / len(e))).drop("_f", "_s")


def directions(size: int, n: int, seed: int = 42) -> np.ndarray:
    """``n`` seeded unit vectors."""
    v = np.random.default_rng(seed).standard_normal((n, size))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def endmembers(df: DataFrame, size: int, n: int, projections: int = 200, seed: int = 42) -> DataFrame:
    """Pixel purity: pixels counted at both ends of seeded unit projections; the ``n`` most counted, ties by index.

    A batch is one product with all directions; a task keeps the extreme pixel a
    direction and end (ties to the first by index), and so does the aggregate of
    the tasks.  Spectra that are null, of another length or with a missing value
    are left out.
    """
    v = directions(size, projections, seed)
    x = F.col("spectrum").cast("array<double>")
    px = df.filter((F.size(x) == size) & valid(x)).select("y", "x", x.alias("c"))

    def run(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
            order = np.lexsort((at[:, 1], at[:, 0]))  # the first of equal values is then the first by index
            at = at[order]
            t = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)[order] @ v.T
            for sign, rows in ((1, t.argmin(axis=0)), (-1, t.argmax(axis=0))):
                for k, row in enumerate(rows):
                    found = (sign * float(t[row, k]), *at[row].tolist())
                    end = k if sign == 1 else k + projections
                    best[end] = min(best.get(end, found), found)
        ends = list(best)
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), *[pa.array([best[e][j] for e in ends], kind) for j, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]], names=["end", "t", "y", "x"])

    ends = px.select(F.col("y").cast("bigint"), F.col("x").cast("bigint"), "c").mapInArrow(run, "end bigint, t double, y bigint, x bigint")
    extreme = ends.groupBy("end").agg(F.min(F.struct("t", "y", "x")).alias("p"))
    return extreme.groupBy("p.y", "p.x").agg(F.count(F.lit(1)).alias("purity")).orderBy(F.desc("purity"), "y", "x").limit(n)


def rx(df: DataFrame, size: int) -> DataFrame:
    """Mahalanobis score from the scene mean and biased covariance with ridge 1e-9; null for spectra with a missing value.

    Scores are one product with a whitening matrix a batch.
    """
    _, mean, cov = _moments(df, size)
    white = np.linalg.inv(np.linalg.cholesky(cov + 1e-9 * np.eye(size)))
    score = by_rows(lambda x: (((x - mean) @ white.T) ** 2).sum(axis=1), "double")
    return df.withColumn("score", score(F.col("spectrum").cast("array<double>")))

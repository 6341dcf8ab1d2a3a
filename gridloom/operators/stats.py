"""Statistics: every one a grouped aggregate with map-side combine; the driver only sees a few numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import known, ratio


def band_statistics(df: DataFrame, bands: list[str], nodata: float | None = None) -> DataFrame:
    """``(band, n, min, max, mean, stddev)`` with the population deviation; NaN, infinities and nodata are skipped."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), known(F.col(b)).alias("v")) for b in bands])).alias("p")).select("p.*")
    if nodata is not None:
        long = long.withColumn("v", F.when(F.col("v") == nodata, None).otherwise(F.col("v")))
    return long.groupBy("band").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"))


def partial_statistics(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Mergeable parts: count, sum, sum of squares, min, max."""
    v = F.col(col)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("min"), F.max(v).alias("max"))


def merge_statistics(parts: DataFrame, by: list[str]) -> DataFrame:
    m = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("min").alias("min"), F.max("max").alias("max"))
    mean = F.col("s") / F.col("n")
    return m.select(*by, "n", "min", "max", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("stddev"))


def segment_stats(df: DataFrame, label: str, bands: list[str]) -> DataFrame:
    """``(segment_id, area_pixels, mean_<band>..)``; labels <= 0 and pixels without a value in any band are left out."""
    ok = F.col(label) > 0
    for b in bands:
        ok = ok & known(F.col(b)).isNotNull()
    return df.filter(ok).groupBy(F.col(label).alias("segment_id")).agg(F.count(F.lit(1)).alias("area_pixels"), *[F.avg(b).alias(f"mean_{b}") for b in bands])


def segment_features(df: DataFrame, label: str, bands: str | list[str], levels: int = 8, low: float | list[float] = 0.0, high: float | list[float] = 1.0) -> DataFrame:
    """Per segment (labels above 0): shape, and per band statistics and co-occurrence texture of right and lower neighbours.

    ``perimeter`` counts pixels with a side on another segment or the edge,
    ``compactness`` is its square over 4 pi areas, ``correlation`` that of
    co-occurring levels (null where a side does not vary).  Columns of a list of bands
    end in the band's name, those of a single name do not; ``low`` and ``high`` are
    the ends of the levels, one for all bands or one a band.  A missing value counts for
    the shape only.  Neighbours are met on tiles with a halo of one pixel; what follows
    are aggregates with map-side parts, by segment and by segment, band and levels.
    """
    from .tiles import by_tiles, shifted

    names = [bands] if isinstance(bands, str) else list(bands)
    suffix = (lambda b: "") if isinstance(bands, str) else (lambda b: f"_{b}")
    ends = [[e] * len(names) if isinstance(e, (int, float)) else e for e in (low, high)]
    kept = df.filter(F.col(label) > 0).select("y", "x", F.col(label).alias("seg"), *[known(F.col(b)).alias(f"v{k}") for k, b in enumerate(names)])

    def run(arrays, r):
        own = shifted(arrays["seg"], r, 0, 0)
        right, below, *rest = (shifted(arrays["seg"], r, dy, dx) == own for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        out = [own, right & below & rest[0] & rest[1]]
        for k in range(len(names)):
            v = arrays[f"v{k}"]
            q = np.clip(np.floor((v - ends[0][k]) / (ends[1][k] - ends[0][k]) * levels), 0, levels - 1)
            out += [shifted(v, r, 0, 0), shifted(q, r, 0, 0), np.where(right, shifted(q, r, 0, 1), np.nan), np.where(below, shifted(q, r, 1, 0), np.nan)]
        return out

    outputs = ["seg", "inside", *[f"{c}{k}" for k in range(len(names)) for c in ("v", "q", "r", "b")]]
    px = by_tiles(kept, ["seg", *[f"v{k}" for k in range(len(names))]], 1, run, outputs, border="none")
    values = [f(F.col(f"v{k}")).alias(f"{n}{suffix(b)}") for k, b in enumerate(names) for n, f in (("mean", F.avg), ("stddev", F.stddev_pop), ("min", F.min), ("max", F.max))]
    base = px.groupBy("seg").agg(F.count(F.lit(1)).alias("area"), *values, (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.sum("inside").cast("bigint").alias("inside"))
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"q{k}").alias("qa"), F.col(f"{c}{k}").alias("qb")) for k in range(len(names)) for c in "rb"])).alias("p")
    met = px.select("seg", pair).select("seg", "p.*").filter("qa IS NOT NULL AND qb IS NOT NULL").groupBy("seg", "k", "qa", "qb").agg(F.count(F.lit(1)).cast("double").alias("n"))
    a, b, n, d = F.col("qa"), F.col("qb"), F.col("n"), F.col("qa") - F.col("qb")
    sums = {"n": n, "nn": n * n, "a": n * a, "b": n * b, "aa": n * a * a, "bb": n * b * b, "ab": n * a * b, "dd": n * d * d, "h": n / (1 + F.abs(d))}
    each = met.groupBy("seg").agg(*[F.sum(F.when(F.col("k") == k, c)).alias(f"{s}{k}") for k in range(len(names)) for s, c in sums.items()])
    texture = []
    for k, name in enumerate(names):
        t = {s: F.col(f"{s}{k}") for s in sums}
        spread = (t["n"] * t["aa"] - t["a"] * t["a"]) * (t["n"] * t["bb"] - t["b"] * t["b"])
        found = {"contrast": t["dd"] / t["n"], "correlation": ratio(t["n"] * t["ab"] - t["a"] * t["b"], F.sqrt(spread)), "homogeneity": t["h"] / t["n"], "energy": t["nn"] / (t["n"] * t["n"])}
        texture += [c.alias(f"{n}{suffix(name)}") for n, c in found.items()]
    out = base.join(each, "seg", "left")
    perimeter = F.col("area") - F.col("inside")
    shape = [perimeter.alias("perimeter"), (perimeter / (4 * F.sqrt("area"))).alias("shape_index"), (perimeter * perimeter / (4 * 3.141592653589793 * F.col("area"))).alias("compactness"), (F.col("area") / (F.col("w") * F.col("h"))).alias("rectangularity"), (F.greatest("w", "h") / F.least("w", "h")).alias("aspect_ratio")]
    statistics = [f"{n}{suffix(b)}" for b in names for n in ("mean", "stddev", "min", "max")]
    return out.select(F.col("seg").cast(df.schema[label].dataType).alias("segment_id"), "area", *statistics, *shape, *texture)


def hierarchy_features(features: DataFrame, links: DataFrame, parents: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """``features(segment_id, area, ..)`` of a level with ``parent_id``, ``child_count`` and ``area_ratio``.

    ``links(segment_id, parent_id)`` lead to the next coarser level, whose areas
    are in ``parents(segment_id, area)``; ``children(segment_id, parent_id)`` are the links
    of the next finer level to this one.  Where a segment has no parent, or one
    without an area, ``parent_id`` and ``area_ratio`` are 0; so is the count of the finest
    level.  Repeated links count once; the least parent wins.
    """
    up = links.filter("parent_id IS NOT NULL").groupBy("segment_id").agg(F.min("parent_id").alias("parent_id"))
    out = features.join(up, "segment_id", "left").join(parents.select(F.col("segment_id").alias("parent_id"), F.col("area").alias("_pa")), "parent_id", "left")
    if children is None:
        out = out.withColumn("child_count", F.lit(0).cast("bigint"))
    else:
        n = children.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("segment_id")).agg(F.count_distinct("segment_id").alias("child_count"))
        out = out.join(n, "segment_id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    lone = F.col("_pa").isNull() | (F.col("_pa") == 0)
    parent = F.when(lone, 0).otherwise(F.col("parent_id")).alias("parent_id")
    return out.select(*features.columns, parent, "child_count", F.when(lone, 0.0).otherwise(F.col("area") / F.col("_pa")).alias("area_ratio"))


def transitions(df: DataFrame, before: str, after: str, classes: int) -> DataFrame:
    """``(from_class, to_class, n)``; classes outside [0, classes) are skipped."""
    ok = F.col(before).between(0, classes - 1) & F.col(after).between(0, classes - 1)
    return df.filter(ok).groupBy(F.col(before).alias("from_class"), F.col(after).alias("to_class")).agg(F.count(F.lit(1)).alias("n"))


def change_report(matrix: DataFrame) -> DataFrame:
    """Per class: pixels before and after, net change, unchanged, percent of before that changed."""
    both = matrix.select(F.explode(F.array(F.struct(F.col("from_class").alias("k"), F.col("n").alias("b"), F.lit(0).cast("bigint").alias("a")), F.struct(F.col("to_class").alias("k"), F.lit(0).cast("bigint").alias("b"), F.col("n").alias("a")))).alias("p"), F.when(F.col("from_class") == F.col("to_class"), F.col("n")).otherwise(0).alias("same")).select("p.*", "same")
    g = both.groupBy("k").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), (F.sum("same") / 2).cast("bigint").alias("unchanged"))
    return g.select(F.col("k").alias("class"), "before", "after", (F.col("after") - F.col("before")).alias("net_change"), "unchanged", (ratio(F.col("before") - F.col("unchanged"), F.col("before")) * 100).alias("percent_changed"))


def accuracy(df: DataFrame, truth: str, pred: str) -> tuple[DataFrame, DataFrame]:
    """Overall row ``(n, overall, kappa)`` and per-class ``(class, producer, user, f1)``; 0/0 is 0, kappa is 1 where all or chance agree fully."""
    m = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = m.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("nt"), F.lit(0).cast("bigint").alias("np")), F.struct(F.col("p").alias("k"), F.lit(0).cast("bigint").alias("nt"), F.col("n").alias("np")))).alias("s"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")).select("s.*", "hit")
    each = side.groupBy("k").agg(F.sum("nt").alias("nt"), F.sum("np").alias("np"), (F.sum("hit") / 2).alias("hit"))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    prod, user = zero(F.col("hit"), F.col("nt")), zero(F.col("hit"), F.col("np"))
    classes = each.select(F.col("k").alias("class"), prod.alias("producer"), user.alias("user"), zero(2 * prod * user, prod + user).alias("f1"))
    t = each.agg(F.sum("nt").alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("nt") * F.col("np")).alias("chance"))
    oa, pe = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return t.select("n", oa.alias("overall"), F.when((oa == 1) | (pe == 1), 1.0).otherwise((oa - pe) / (1 - pe)).alias("kappa")), classes


def histogram(df: DataFrame, col: str, bins: int, low: float, high: float) -> DataFrame:
    """``(bin, edge, n)`` over [low, high]; the last bin is closed."""
    b = F.least(F.floor((F.col(col) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    got = df.filter(F.col(col).between(low, high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("bin", (F.lit(low) + F.col("bin") * ((high - low) / bins)).alias("edge"), "n")


def order_statistics(df: DataFrame, col: str, ranks: list[int], most: int = 100_000, bins: int = 2048) -> list[float]:
    """Exact values at 0-based ``ranks`` among the column's known values in ascending order.

    Each pass counts the rows of the intervals that hold a rank in ``bins`` equal
    parts, so that no task ever holds all distinct values; an interval of ``most``
    rows or fewer is sorted as it is.  The driver sees counts only, and such intervals.
    """
    v = F.col(col).cast("double")
    rows = df.select(v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).first()
    held = {r: (ends["lo"], ends["hi"], 0, ends["n"]) for r in set(ranks)}  # rank -> ends, rows before, rows within
    out: dict[int, float] = {}
    while len(out) < len(held):
        for r, (lo, hi, _, _) in held.items():
            if lo == hi:
                out[r] = lo
        open_ = sorted({w for r, w in held.items() if r not in out})
        small = [w for w in open_ if w[3] <= most]
        for lo, hi, before, _ in small:
            got = sorted(x[0] for x in rows.filter((F.col("v") >= lo) & (F.col("v") <= hi)).collect())
            out.update({r: got[r - before] for r, w in held.items() if w[:3] == (lo, hi, before)})
        wide = [w for w in open_ if w[3] > most]
        if not wide:
            continue
        which = F.lit(None).cast("int")
        for k, (lo, hi, _, _) in enumerate(wide):
            which = F.when((F.col("v") >= lo) & (F.col("v") <= hi), k).otherwise(which)
        lo, step = (F.array(*[F.lit(float(x)) for x in side]) for side in ([w[0] for w in wide], [(w[1] - w[0]) / bins for w in wide]))
        part = F.least(F.floor((F.col("v") - F.get(lo, "k")) / F.get(step, "k")), F.lit(bins - 1))
        counts = rows.withColumn("k", which).filter("k IS NOT NULL").groupBy("k", part.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "bin").collect()
        for k, w in enumerate(wide):
            before, found = w[2], []
            for c in (c for c in counts if c["k"] == k):
                found.append((c["lo"], c["hi"], before, c["n"]))
                before += c["n"]
            for r in [r for r, x in held.items() if x == w]:
                held[r] = next(x for x in found if x[2] <= r < x[2] + x[3])
    return [out[r] for r in ranks]


def quantiles(df: DataFrame, col: str, fractions: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; none for a column without values."""
    v = F.col(col).cast("double")
    n = df.filter(v.isNotNull() & ~F.isnan(v)).count()
    if not n:
        return [None] * len(fractions)
    at = [f * (n - 1) for f in fractions]
    low = order_statistics(df, col, [int(k) for k in at] + [min(int(k) + 1, n - 1) for k in at])
    return [a + (b - a) * (k - int(k)) for k, a, b in zip(at, low, low[len(at) :])]


def freedman_diaconis(df: DataFrame, col: str) -> DataFrame:
    """One row ``(width, bins)``: 2 IQR n^(-1/3) and the range in such widths."""
    low, high = quantiles(df, col, [0.25, 0.75])
    r = df.agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
    width = 2 * F.lit(None if low is None else high - low).cast("double") * F.pow("n", F.lit(-1.0 / 3))
    return r.select(width.alias("width"), F.ceil((F.col("hi") - F.col("lo")) / width).cast("bigint").alias("bins"))


# --- class breaks: a few aggregates, then arithmetic on scalars; columns without values have none


def _ends(df, col):
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.avg(col).alias("m"), F.stddev_pop(col).alias("s")).first()
    return None if r["lo"] is None else (float(r["lo"]), float(r["hi"]), float(r["m"]), float(r["s"]))


def breaks(df: DataFrame, col: str, method: str, classes: int = 5, **o) -> list[float]:
    """Upper class ends by ``equal``, ``quantile``, ``pretty``, ``stddev``, ``log``, ``fixed`` (interval=), ``custom`` (ends=), ``jenks``.

    A column without values has no breaks; where all values are one, that value is the only end of the ``equal``, ``pretty`` and ``stddev`` methods.
    """
    if method == "custom":
        return [float(v) for v in o["ends"]]
    if (found := _ends(df, col)) is None:
        return []
    lo, hi, mean, sd = found
    if method in ("equal", "pretty", "stddev") and (lo == hi or sd == 0) and "symmetric" not in o:
        return [hi]
    if method == "equal":
        if "symmetric" in o:  # both sides of the point get the same reach
            reach = max(hi - o["symmetric"], o["symmetric"] - lo)
            lo, hi = o["symmetric"] - reach, o["symmetric"] + reach
        return [lo + (hi - lo) * k / classes for k in range(1, classes + 1)]
    if method == "quantile":
        return quantiles(df, col, [k / classes for k in range(1, classes + 1)])
    if method == "pretty":
        step = (hi - lo) / classes
        unit = 10.0 ** np.floor(np.log10(step))
        size = min((u * unit for u in (1, 2, 5, 10)), key=lambda u: abs(u - step))
        return [float(v) for v in np.arange(np.floor(lo / size) + 1, np.ceil(hi / size) + 1) * size]
    if method == "stddev":
        k0, k1 = int(np.floor((lo - mean) / sd)), int(np.ceil((hi - mean) / sd))
        return [mean + k * sd for k in range(k0 + 1, k1 + 1)]
    if method == "log":
        p0, p1 = int(np.floor(np.log10(max(lo, 1e-300)))), int(np.ceil(np.log10(hi)))
        return [10.0**k for k in range(p0 + 1, p1 + 1)]
    if method == "fixed":
        return [float(v) for v in np.arange(lo + o["interval"], hi + o["interval"], o["interval"])]
    if method == "jenks":
        return jenks(df, col, classes)
    raise ValueError(method)


def _blocks(rows: DataFrame, uppers: np.ndarray, centre: float) -> np.ndarray:
    """``(m, s, q, lo, hi)`` of the values in each block up to and with its upper end, as rows; empty blocks are left out."""

    def run(batches):
        n = len(uppers)
        m, s, q, lo, hi = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(uppers, v, side="left")
            y = v - centre
            m += np.bincount(at, minlength=n)
            s += np.bincount(at, weights=y, minlength=n)
            q += np.bincount(at, weights=y * y, minlength=n)
            np.minimum.at(lo, at, v)
            np.maximum.at(hi, at, v)
        some = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(x[some]) for x in (m, s, q, lo, hi)]], names=["k", "m", "s", "q", "lo", "hi"])

    got = rows.mapInArrow(run, "k bigint, m double, s double, q double, lo double, hi double").groupBy("k")
    found = got.agg(F.sum("m"), F.sum("s"), F.sum("q"), F.min("lo"), F.max("hi")).orderBy("k").collect()  # the blocks at most
    return np.array([r[1:] for r in found], dtype=float)


def _spread(blocks: np.ndarray, centre: float, loose: np.ndarray) -> np.ndarray:
    """Squared deviations of every run of blocks i..j as a class.

    A run's ends that are ``loose`` count with all their values at the side next
    to the rest: no class that ends inside such a block deviates less.
    """
    m, s, q, lo, hi = blocks.T
    n = len(m)
    before = [np.append(0, np.cumsum(x)) for x in (m, s, q)]
    total = [b[None, 1:] - b[:-1, None] for b in before]
    for inner, axis in ((hi - centre, 0), (lo - centre, 1)):  # the first block's upper side, the last one's lower side
        for k, own in ((1, m * inner - s), (2, m * inner * inner - q)):
            total[k] = total[k] + np.expand_dims(np.where(loose, own, 0.0), 1 - axis)
    out = np.maximum(total[2] - total[1] ** 2 / np.where(total[0] > 0, total[0], 1), 0)
    out[np.arange(n), np.arange(n)] = np.where(loose, 0.0, np.maximum(q - s * s / m, 0))
    out[np.tril_indices(n, -1)] = np.inf
    return out


def _cheapest(cost: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """``(least, cut)``: least cost of the blocks before j in k classes, and where the last of them begins."""
    n = len(cost)
    least, cut = np.full((classes + 1, n + 1), np.inf), np.zeros((classes + 1, n + 1), dtype=int)
    least[0, 0] = 0
    for k in range(1, classes + 1):
        all_ = least[k - 1, :n, None] + cost
        cut[k, 1:] = all_.argmin(axis=0)
        least[k, 1:] = all_.min(axis=0)
    return least, cut


def jenks(df: DataFrame, col: str, classes: int, bins: int = 1024) -> list[float]:
    """Natural breaks over all values: the upper ends of the classes with the least sum of squared deviations.

    Values are first counted in ``bins`` equal blocks of their range.  Among classes
    that end between blocks the best are found by dynamic programming; the same
    programme over loosened blocks (`_spread`) bounds what any classes with an end
    at or inside a block could reach.  Blocks whose bound is lower than the best
    found are counted again in finer parts, others never hold an end and grow
    together, until no block is left: the result is then exact (to 1e-11 of the whole
    sum of squares), whatever the number of distinct values.  A pass reads the column
    once; the driver holds blocks only.  With fewer distinct values than classes each
    is a class; a column without values has none.
    """
    rows = df.select(F.col(col).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    r = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean")).first()
    if r["lo"] is None:
        return []
    lo, hi, centre = r["lo"], r["hi"], r["mean"]
    uppers, shut = np.unique(np.append(lo + (hi - lo) * np.arange(bins) / bins, hi)), np.zeros(0)  # shut: upper ends of blocks known to hold no end
    while True:
        blocks = _blocks(rows, uppers, centre)
        n = len(blocks)
        loose = (blocks[:, 3] < blocks[:, 4]) & ~np.isin(blocks[:, 4], shut)
        if n < classes and loose.any():
            open_, held = loose, np.ones(n - 1, dtype=bool)
        else:
            k = min(classes, n)
            least, cut = _cheapest(_spread(blocks, centre, np.zeros(n, dtype=bool)), k)
            if loose.any():
                bound = _spread(blocks, centre, loose)
                ahead = _cheapest(bound, k)[0]
                behind = _cheapest(bound[::-1, ::-1].T, k)[0][:, ::-1]
                via = np.min([ahead[i] + behind[k - i] for i in range(1, k)], axis=0) if k > 1 else np.full(n + 1, np.inf)
                tiny = 1e-11 * blocks[:, 2].sum()
                better, held = via < least[k, n] - tiny, via[1:-1] <= least[k, n] + tiny
                open_ = loose & (better[:-1] | better[1:])
            if not loose.any() or not open_.any():
                ends, at = [], n
                for step in range(k, 0, -1):
                    ends.append(float(blocks[at - 1, 4]))
                    at = cut[step, at]
                return ends[::-1]
        parts = max(2, bins // int(open_.sum()))
        finer = [np.append(a + (b - a) * np.arange(parts) / parts, b) for a, b in blocks[open_][:, 3:]]
        keep = np.append(held | open_[:-1] | open_[1:], True)  # sides that may be an end
        uppers = np.unique(np.concatenate([blocks[keep, 4], *finer]))
        shut = blocks[keep & ~open_, 4]


def classify(v: Column, ends: list[float]) -> Column:
    """Class number from 0 by ascending upper ends, the last one closed above."""
    out = F.when(v.isNull(), None)
    for k, e in enumerate(ends[:-1]):
        out = out.when(v <= e, k)
    return out.otherwise(len(ends) - 1)


def string_summary(df: DataFrame, col: str) -> DataFrame:
    """Count, distinct, missing, min, max, lengths, rarest and commonest value (ties: the smaller)."""
    counts = df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n, v = F.col("n"), F.col("v")
    full = F.when(v.isNotNull() & (v != ""), n)
    return counts.agg(F.sum("n").alias("n"), F.count(v).alias("n_distinct"), F.coalesce(F.sum(F.when(v.isNull() | (v == ""), n)), F.lit(0)).alias("missing"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.min(F.length(v)).alias("min_length"), F.max(F.length(v)).alias("max_length"), (F.sum(F.length(v) * n) / F.sum(n)).alias("mean_length"), F.min_by(v, F.struct(full, v)).alias("minority"), F.min_by(v, F.struct(-full, v)).alias("majority"))


def datetime_summary(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("n_distinct"), (F.count(F.lit(1)) - F.count(c)).alias("missing"), F.min(c).alias("earliest"), F.max(c).alias("latest"), (F.max(F.unix_timestamp(c)) - F.min(F.unix_timestamp(c))).alias("range_seconds"))


def concatenate(df: DataFrame, by: list[str], col: str, order: str, delimiter: str, where: str = "true") -> DataFrame:
    """Values joined in order, of the rows that pass."""
    items = F.array_sort(F.collect_list(F.when(F.expr(where), F.struct(F.col(order).alias("o"), F.col(col).cast("string").alias("v")))))
    return df.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["v"]), delimiter).alias("joined"))


def covariance(df: DataFrame, array: str, size: int, by: list[str] | None = None) -> DataFrame:
    """Rows ``(by.., n, mean array, cov array)`` (population, row-major) of an array column.

    A task sums one matrix product a batch, per group, and gives a row for each
    group it met; those add up element by element.  Sums are taken around one row
    of the table, so that large offsets do not cancel.  Rows that are null, of
    another length or with a missing value are left out; groups without a row
    are, too.
    """
    by = by or []
    x = F.col(array).cast("array<double>")
    whole = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    rows = df.filter(whole).select(*by, x.alias("_x"))
    one = rows.select("_x").first()
    shift = np.array(one["_x"] if one else [0.0] * size)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}

        def out():
            keys = list(sums)
            cols = [pa.array([k[j] for k in keys], t) for j, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=[*by, "_s"])

        types = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - shift
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            if by:
                pdf = pd.DataFrame({c: batch.column(c).to_pandas() for c in by})
                code, firsts = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy(), ~pdf.duplicated().to_numpy()
                names = [tuple(batch.column(c)[int(k)].as_py() for c in by) for k in np.flatnonzero(firsts)]
                parts = [(names[c], x[code == c]) for c in range(len(names))]
            else:
                parts = [((), x)]
            for name, part in parts:
                sums[name] = sums.get(name, 0) + (part.T @ part).ravel()
            if len(sums) > 256:
                yield out()
                sums = {}
        if sums:
            yield out()

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    parts = rows.mapInArrow(run, ", ".join([*fields, "_s array<double>"])).select(*by, F.posexplode("_s").alias("_k", "_v"))
    added = parts.groupBy(*by, "_k").agg(F.sum("_v").alias("_v")).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda e: e["_v"]).alias("_s"))
    width = size + 1  # the Gram matrix of (1, x - shift)
    added = added.filter(F.size("_s") > 0).withColumn("_n", F.col("_s")[0]).withColumn("_d", F.transform(F.slice("_s", 2, size), lambda v: v / F.col("_n")))
    at = F.sequence(F.lit(0), F.lit(size * size - 1))
    row, col = (lambda k: F.floor(k / size).cast("int")), (lambda k: k % size)
    cov = F.transform(at, lambda k: F.get("_s", (row(k) + 1) * width + col(k) + 1) / F.col("_n") - F.get("_d", row(k)) * F.get("_d", col(k)))
    mean = F.zip_with("_d", F.array(*[F.lit(float(v)) for v in shift]), lambda a, b: a + b)
    return added.select(*by, F.col("_n").cast("bigint").alias("n"), mean.alias("mean"), cov.alias("cov"))


def jm_separability(stats: DataFrame, size: int, key: str = "label") -> list[tuple]:
    """``(a, b, jm)`` of class pairs from `covariance` rows by class; -1 where a class has no more samples than bands."""
    rows = sorted(stats.collect(), key=lambda r: r[key])  # one row a class
    out = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if min(a["n"], b["n"]) <= size:
                out.append((a[key], b[key], -1.0))
                continue
            ca, cb = (np.array(r["cov"]).reshape(size, size) * r["n"] / (r["n"] - 1) for r in (a, b))
            c, d = (ca + cb) / 2, np.array(a["mean"]) - np.array(b["mean"])
            log = np.linalg.slogdet(c)[1] - (np.linalg.slogdet(ca)[1] + np.linalg.slogdet(cb)[1]) / 2
            out.append((a[key], b[key], float(2 * (1 - np.exp(-(d @ np.linalg.solve(c, d) / 8 + log / 2))))))
    return out


def linear_fit(df: DataFrame, px: str, py: str, mx: str, my: str) -> DataFrame:
    """Origin and signed scales per axis of control points, by least squares: one row ``(x0, y0, sx, sy, rmse)``; nulls where an axis does not vary."""
    r = df.agg(F.regr_slope(mx, px).alias("sx"), F.regr_slope(my, py).alias("sy"), F.regr_intercept(mx, px).alias("x0"), F.regr_intercept(my, py).alias("y0"))
    both = df.crossJoin(F.broadcast(r))
    ex, ey = F.col(mx) - F.col("x0") - F.col("sx") * F.col(px), F.col(my) - F.col("y0") - F.col("sy") * F.col(py)
    return both.groupBy("x0", "y0", "sx", "sy").agg(F.sqrt(F.avg(ex * ex + ey * ey)).alias("rmse"))


def helmert_fit(df: DataFrame, px: str, py: str, mx: str, my: str) -> DataFrame:
    """Rotation, one scale and shift of control points, by least squares: one row ``(x0, y0, scale, rotation, rmse)``.

    ``X = a x - b y + x0``, ``Y = b x + a y + y0`` with ``a, b`` the scale times
    the rotation's cosine and sine; nulls where all source points are one.
    """
    spread = F.var_pop(px) + F.var_pop(py)
    a = (F.covar_pop(px, mx) + F.covar_pop(py, my)) / F.nullif(spread, F.lit(0.0))
    b = (F.covar_pop(px, my) - F.covar_pop(py, mx)) / F.nullif(spread, F.lit(0.0))
    r = df.agg(a.alias("a"), b.alias("b"), *[F.avg(c).alias(f"_m{k}") for k, c in enumerate((px, py, mx, my))])
    r = r.select("a", "b", (F.col("_m2") - F.col("a") * F.col("_m0") + F.col("b") * F.col("_m1")).alias("x0"), (F.col("_m3") - F.col("b") * F.col("_m0") - F.col("a") * F.col("_m1")).alias("y0"))
    ex = F.col(mx) - (F.col("a") * F.col(px) - F.col("b") * F.col(py) + F.col("x0"))
    ey = F.col(my) - (F.col("b") * F.col(px) + F.col("a") * F.col(py) + F.col("y0"))
    got = df.crossJoin(F.broadcast(r)).groupBy("a", "b", "x0", "y0").agg(F.sqrt(F.avg(ex * ex + ey * ey)).alias("rmse"))
    return got.select("x0", "y0", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("scale"), F.atan2("b", "a").alias("rotation"), "rmse")


def projective_fit(df: DataFrame, px: str, py: str, mx: str, my: str) -> list[float]:
    """The nine numbers, row by row, of the homography of control points (the last is 1), by normalised direct linear transformation.

    Two aggregates: means and mean distances, then the 9 x 9 sums of products of
    the scaled equations, whose least eigenvector is the answer.  Points that do
    not spread raise.
    """
    m = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate((px, py, mx, my))]).first()
    far = lambda x, y, i, j: F.avg(F.sqrt((F.col(x) - m[i]) ** 2 + (F.col(y) - m[j]) ** 2))
    d = df.agg(far(px, py, "m0", "m1").alias("s"), far(mx, my, "m2", "m3").alias("t")).first() if m["m0"] is not None else None
    if d is None or not d["s"] or not d["t"]:
        raise ValueError("control points do not spread")
    s, t = 2**0.5 / d["s"], 2**0.5 / d["t"]
    u, v, x, y = ((F.col(c) - m[f"m{k}"]) * (s if k < 2 else t) for k, c in enumerate((px, py, mx, my)))
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [[-u, -v, -one, zero, zero, zero, x * u, x * v, x], [zero, zero, zero, -u, -v, -one, y * u, y * v, y]]
    sums = df.agg(*[F.sum(rows[0][i] * rows[0][j] + rows[1][i] * rows[1][j]).alias(f"n{i}{j}") for i in range(9) for j in range(i, 9)]).first()
    normal = np.array([[sums[f"n{min(i, j)}{max(i, j)}"] for j in range(9)] for i in range(9)])
    h = np.linalg.eigh(normal)[1][:, 0].reshape(3, 3)
    source = np.array([[s, 0, -s * m["m0"]], [0, s, -s * m["m1"]], [0, 0, 1]])
    target = np.array([[t, 0, -t * m["m2"]], [0, t, -t * m["m3"]], [0, 0, 1]])
    h = np.linalg.solve(target, h @ source)
    return [float(k) for k in (h / h[2, 2]).ravel()]


def projected(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    z = x * h[6] + y * h[7] + h[8]
    return (x * h[0] + y * h[1] + h[2]) / z, (x * h[3] + y * h[4] + h[5]) / z


def affine_fit(df: DataFrame, px: str, py: str, mx: str, my: str) -> DataFrame:
    """Least-squares affine map of control points: one row ``(a0, a1, a2, b0, b1, b2, rmse)``; six sums, a 3 x 3 solve."""
    p = [F.lit(1.0), F.col(px), F.col(py)]
    aggs = [F.sum(p[i] * p[j]).alias(f"n{i}{j}") for i in range(3) for j in range(3)] + [F.sum(p[i] * F.col(t)).alias(f"r{i}{k}") for i in range(3) for k, t in enumerate((mx, my))]
    r = df.agg(*aggs).first()
    sol = np.linalg.solve(np.array([[r[f"n{i}{j}"] for j in range(3)] for i in range(3)]), np.array([[r[f"r{i}{k}"] for k in range(2)] for i in range(3)]))
    ex = F.col(mx) - (sol[0][0] + sol[1][0] * F.col(px) + sol[2][0] * F.col(py))
    ey = F.col(my) - (sol[0][1] + sol[1][1] * F.col(px) + sol[2][1] * F.col(py))
    return df.agg(*[F.lit(float(sol[i][k])).alias(f"{'ab'[k]}{i}") for k in range(2) for i in range(3)], F.sqrt(F.avg(ex * ex + ey * ey)).alias("rmse"))

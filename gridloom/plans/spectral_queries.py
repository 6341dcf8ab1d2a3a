"""Queries of the scene-statistics and spectral operators, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.expressions import clean, nearest
from ..operators import spectral as S
from .fixtures import ctes, load
from .registry import query
from .stats_queries import rounded

MS = ["b1", "b2", "b3", "b4"]


def spectra(spark, d, n=64, plus=0.0):
    """The first ``n`` of 64 bands; all of them unless the query's SQL states fewer or it estimates a covariance a class."""
    s = load(spark, d, "spectra")
    return s.select("y", "x", "label", F.transform(F.slice("spectrum", 1, n), lambda v: v + plus).alias("spectrum"))


def full_ms(spark, d):
    return load(spark, d, "ms").filter("b1 IS NOT NULL")


@query("h01_dos1", f"{ctes('grid')} SELECT y, x, round(value - (SELECT min(value) FROM grid), 6) AS value FROM grid")
def h01(spark, d):
    return rounded(S.dos1(load(spark, d, "grid")), "value").select("y", "x", "value")


@query("h02_dark_object", f"{ctes('grid')}, r AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM grid), h AS (SELECT least(floor((value - lo) / (hi - lo) * 1024), 1023) AS b, count(*) AS k, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n FROM grid, r GROUP BY 1) SELECT round(min(lo + b * (hi - lo) / 1024), 6) AS dark FROM h WHERE k >= greatest(2, floor(n / 10000))")
def h02(spark, d):
    return rounded(S.dark_object(load(spark, d, "grid")), "dark")


@query("h03_dos2", f"{ctes('grid')} SELECT y, x, round((value - 900) / exp(-0.12), 4) AS value FROM grid")
def h03(spark, d):
    return rounded(S.dos2(load(spark, d, "grid"), 900.0, 1.2), "value", digits=4).select("y", "x", "value")


@query("h04_quac", f"{ctes('ms')}, q AS (SELECT quantile_cont(b1, 0.01) AS a1, quantile_cont(b1, 0.99) AS z1, quantile_cont(b2, 0.01) AS a2, quantile_cont(b2, 0.99) AS z2 FROM ms) SELECT y, x, round(least(greatest((b1 - a1) / (z1 - a1) * 0.5, 0.0), 1.0), 6) AS b1, round(least(greatest((b2 - a2) / (z2 - a2) * 0.5, 0.0), 1.0), 6) AS b2 FROM ms, q WHERE b1 IS NOT NULL")
def h04(spark, d):
    return rounded(S.quac(full_ms(spark, d), ["b1", "b2"]), "b1", "b2").select("y", "x", "b1", "b2")


@query("h05_stretches", f"{ctes('grid')}, q AS (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS z, avg(value) AS m, stddev_pop(value) AS s FROM grid) SELECT y, x, round(least(greatest((value - a) / (z - a), 0.0), 1.0) * 255, 4) AS clipped, round(least(greatest((value - (m - 2 * s)) / (4 * s), 0.0), 1.0) * 255, 4) AS sigma FROM grid, q")
def h05(spark, d):
    g = load(spark, d, "grid")
    a = S.percent_clip(g, "value").select("y", "x", nearest("value", 4).alias("clipped"))
    return a.join(S.stddev_stretch(g, "value").select("y", "x", nearest("value", 4).alias("sigma")), ["y", "x"])


@query("h05_equalize", f"{ctes('grid')}, r AS (SELECT min(value) AS lo, max(value) AS hi FROM grid), b AS (SELECT y, x, least(floor((value - lo) / (hi - lo) * 256), 255) AS b FROM grid, r), h AS (SELECT b, sum(count(*)) OVER (ORDER BY b) AS c FROM b GROUP BY b) SELECT y, x, round((c - (SELECT min(c) FROM h)) / ((SELECT max(c) FROM h) - (SELECT min(c) FROM h)) * 255, 6) AS value FROM b JOIN h USING (b)")
def h05e(spark, d):
    return rounded(S.equalize(load(spark, d, "grid"), "value"), "value").select("y", "x", "value")


_CH = f"{ctes('ms_before', 'ms_after')}, j AS (SELECT y, x, b.b1 AS p1, a.b1 AS q1, b.b2 AS p2, a.b2 AS q2 FROM ms_before b JOIN ms_after a USING (y, x))"


def both_dates(spark, d):
    b, a = load(spark, d, "ms_before"), load(spark, d, "ms_after")
    return b.select("y", "x", *[F.col(c).alias("p" + c[1]) for c in MS]).join(a.select("y", "x", *[F.col(c).alias("q" + c[1]) for c in MS]), ["y", "x"])


@query("h06_change", _CH + " SELECT y, x, round(q1 - p1, 6) AS difference, round((q1 - p1) / nullif(q1 + p1, 0), 6) AS normalized, round(q1 / nullif(p1, 0), 6) AS ratio, round(sqrt(pow(q1 - p1, 2) + pow(q2 - p2, 2)), 6) AS cva, cast(abs(q1 - p1) >= 10 AS integer) AS mask FROM j")
def h06(spark, d):
    j = both_dates(spark, d)
    kinds = {k: clean(S.change(j, "p1", "q1", k)) for k in ("difference", "normalized", "ratio")}
    return j.select("y", "x", *[c.alias(k) for k, c in kinds.items()], clean(S.change_vector(["p1", "p2"], ["q1", "q2"])).alias("cva"), (F.abs(F.col("q1") - F.col("p1")) >= 10).cast("int").alias("mask"))


@query("h07_mad")
def h07(spark, d):
    return rounded(S.mad(both_dates(spark, d), ["p1", "p2", "p3", "p4"], ["q1", "q2", "q3", "q4"]), "chi2").select("y", "x", "chi2")


@query("h08_otsu", f"{ctes('grid')}, r AS (SELECT min(value) AS lo, max(value) AS hi FROM grid), h AS (SELECT floor((value - lo) / (hi - lo) * 255) AS b, count(*) AS k FROM grid, r GROUP BY 1), c AS (SELECT b, sum(k) OVER (ORDER BY b) AS w0, sum(k * b) OVER (ORDER BY b) AS m0, sum(k) OVER () AS n, sum(k * b) OVER () AS m FROM h), s AS (SELECT b, cast(w0 AS double) * (n - w0) * pow(m0 / w0 - (m - m0) / (n - w0), 2) AS v FROM c WHERE w0 < n) SELECT round(lo + ((SELECT b FROM s ORDER BY v DESC, b LIMIT 1) + 0.5) * (hi - lo) / 255, 4) AS threshold FROM r")
def h08(spark, d):
    return rounded(S.otsu(load(spark, d, "grid"), "value"), "threshold", digits=4)


@query("h08_percentile_mask", f"{ctes('grid')}, t AS (SELECT quantile_disc(value, 0.9) AS t FROM grid) SELECT y, x, cast(value >= t AS integer) AS mask FROM grid, t")
def h08p(spark, d):
    g = load(spark, d, "grid")
    return S.over(g, "value", S.rank_percentile(g, "value", 90)).select("y", "x", "mask")


def _fusion(how, sql):
    @query({"linear": "h09", "brovey": "h10", "pca": "h11", "ihs": "h12", "gram_schmidt": "h13"}[how] + f"_fusion_{how}", sql)
    def run(spark, d):
        out = S.fuse(full_ms(spark, d), ["b1", "b2", "b3"], "b4", how)
        return rounded(out, "b1", "b2", "b3").select("y", "x", "b1", "b2", "b3")


_M = f"{ctes('ms')}, m AS (SELECT *, (b1 + b2 + b3) / 3 AS i FROM ms WHERE b1 IS NOT NULL), g AS (SELECT avg(i) AS im, stddev_pop(i) AS isd, avg(b4) AS pm, stddev_pop(b4) AS ps, " + ", ".join(f"covar_pop({b}, i) / var_pop(i) AS g{b}" for b in ("b1", "b2", "b3")) + " FROM m)"
_fusion("linear", _M + " SELECT y, x, " + ", ".join(f"round({b} * 0.5 + b4 * 0.5, 6) AS {b}" for b in ("b1", "b2", "b3")) + " FROM m")
_fusion("brovey", _M + " SELECT y, x, " + ", ".join(f"round({b} / (b1 + b2 + b3) * b4, 6) AS {b}" for b in ("b1", "b2", "b3")) + " FROM m")
_fusion("ihs", _M + " SELECT y, x, " + ", ".join(f"round({b} + (b4 - pm) * isd / ps + im - i, 6) AS {b}" for b in ("b1", "b2", "b3")) + " FROM m, g")
_fusion("gram_schmidt", _M + " SELECT y, x, " + ", ".join(f"round({b} + g{b} * ((b4 - pm) * isd / ps + im - i), 6) AS {b}" for b in ("b1", "b2", "b3")) + " FROM m, g")
_fusion("pca", None)


@query("h14_pca")
def h14(spark, d):
    out, _, _ = S.pca(S.with_array(full_ms(spark, d), MS), 4)
    return out.select("y", "x", *[clean(F.col("scores")[k], 5).alias(f"pc{k + 1}") for k in range(4)])


@query("h14_pca_variance", f"{ctes('ms')}, m AS (SELECT * FROM ms WHERE b1 IS NOT NULL) SELECT round(var_pop(b1) + var_pop(b2) + var_pop(b3) + var_pop(b4), 5) AS total FROM m")
def h14v(spark, d):
    out, _, _ = S.pca(S.with_array(full_ms(spark, d), MS), 4)
    return out.agg(nearest(sum([F.var_pop(F.col("scores")[k]) for k in range(1, 4)], F.var_pop(F.col("scores")[0])), 5).alias("total"))


@query("h15_mnf")
def h15(spark, d):
    out, _ = S.mnf(S.with_array(full_ms(spark, d), MS), 4, 2)
    return out.select("y", "x", *[clean(F.col("scores")[k], 5).alias(f"c{k + 1}") for k in range(2)])


def _refs(spark, d, n=64, plus=0.0):
    """Mean spectrum per class: one aggregate, a row a class."""
    s = spectra(spark, d, n, plus)
    return s.groupBy("label").agg(*[F.avg(F.col("spectrum")[k]).alias(f"m{k}") for k in range(n)])


def _ref_list(spark, d, n=64, plus=0.0):
    return [(r["label"], [r[f"m{k}"] for k in range(n)]) for r in _refs(spark, d, n, plus).orderBy("label").collect()]


_SP = f"{ctes('spectra')}, s AS (SELECT y, x, label, spectrum AS v FROM spectra), r AS (SELECT label AS class, [" + ", ".join(f"avg(spectrum[{k}])" for k in range(1, 65)) + "] AS m FROM spectra GROUP BY label)"


@query("h16_sam", _SP + ", a AS (SELECT y, x, class, acos(least(greatest(list_dot_product(v, m) / sqrt(list_dot_product(v, v) * list_dot_product(m, m)), -1.0), 1.0)) AS angle FROM s, r) SELECT y, x, arg_min(class, angle) AS class, round(min(angle), 6) AS angle FROM a GROUP BY y, x")
def h16(spark, d):
    return rounded(S.classify_sam(spectra(spark, d), _ref_list(spark, d)), "angle").select("y", "x", "class", "angle")


@query("h17_sid", _SP + ", p AS (SELECT y, x, list_transform(v, lambda q: q + 1.0) AS v FROM s), b AS (SELECT list_transform(m, lambda q: q + 1.0) AS m FROM r WHERE class = 0), u AS (SELECT y, x, list_transform(v, lambda q: q / list_sum(v)) AS a, list_transform(m, lambda q: q / list_sum(m)) AS b FROM p, b) SELECT y, x, round(list_sum(list_transform(range(1, 65), lambda k: (a[k] - b[k]) * (ln(a[k]) - ln(b[k])))), 6) AS sid FROM u")
def h17(spark, d):
    ref = [v + 1.0 for v in dict(_ref_list(spark, d))[0]]
    return spectra(spark, d, plus=1.0).select("y", "x", clean(S.sid(F.col("spectrum"), S.array(ref))).alias("sid"))


_PLUS = "s AS (SELECT y, x, label, list_transform(spectrum, lambda q: cast(q AS double) + 1.0) AS v FROM spectra), r AS (SELECT label AS class, [" + ", ".join(f"avg(spectrum[{k}] + 1.0)" for k in range(1, 65)) + "] AS m FROM spectra GROUP BY label)"


@query("c11_library_match", f"{ctes('spectra')}, {_PLUS}, a AS (SELECT y, x, class, v, m, acos(least(greatest(list_dot_product(v, m) / sqrt(list_dot_product(v, v) * list_dot_product(m, m)), -1.0), 1.0)) AS angle FROM s, r), k AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY angle, class) AS rank FROM a) SELECT y, x, class AS name, round(angle, 6) AS angle, round(list_sum(list_transform(range(1, 65), lambda k: (v[k] / list_sum(v) - m[k] / list_sum(m)) * (ln(v[k] / list_sum(v)) - ln(m[k] / list_sum(m))))), 6) AS sid, cast(rank AS integer) AS rank FROM k WHERE rank <= 3")
def c11(spark, d):
    lib = _refs(spark, d, 64, 1.0).select(F.col("label").alias("name"), F.array(*[F.col(f"m{k}") for k in range(64)]).alias("reference"))
    return rounded(S.match(spectra(spark, d, 64, 1.0), lib, ["y", "x"], 3), "angle", "sid").select("y", "x", "name", "angle", "sid", "rank")


# the hull at a band is the highest of all chords over it, and the value itself
_HULL = f"{ctes('spectra')}, s AS (SELECT y, x, list_transform(spectrum, lambda q: cast(q AS double) + 1.0) AS v FROM spectra), b AS (SELECT a.k AS i, b.k AS j, c.k AS k FROM range(1, 65) a(k) JOIN range(1, 65) b(k) ON a.k < b.k JOIN range(1, 65) c(k) ON c.k > a.k AND c.k < b.k), h AS (SELECT y, x, k, max(v[i] + (v[j] - v[i]) * cast(k - i AS double) / (j - i)) AS chord FROM s, b GROUP BY y, x, k), p AS (SELECT y, x, k, v[k] / greatest(v[k], coalesce(chord, v[k])) AS removed FROM (SELECT y, x, v, k FROM s, range(1, 65) r(k)) LEFT JOIN h USING (y, x, k))"


@query("h18_continuum", _HULL + " SELECT y, x, round(min(removed), 6) AS deepest, round(max(removed), 6) AS highest FROM p GROUP BY y, x")
def h18(spark, d):
    out = S.continuum(spectra(spark, d, 64, 1.0), ["y", "x"])
    return out.select("y", "x", clean(F.array_min("removed")).alias("deepest"), clean(F.array_max("removed")).alias("highest"))


@query("h19_resample_linear", f"{ctes('spectra')} SELECT y, x, round(spectrum[1] * 0.5 + spectrum[2] * 0.5, 6) AS v405, round(spectrum[11], 6) AS v500 FROM spectra")
def h19(spark, d):
    w = S.linear_weights([400 + 10.0 * k for k in range(64)], [405.0, 500.0, 2000.0])
    out = S.resample_spectra(spectra(spark, d, 64), w)
    return out.select("y", "x", clean(F.col("spectrum")[0]).alias("v405"), clean(F.col("spectrum")[1]).alias("v500"))


@query("h19_resample_gaussian", f"{ctes('spectra')}, w AS (SELECT k, exp(-pow(400 + 10 * (k - 1) - 600, 2) / (2 * pow(12 / 2.35482, 2))) AS w FROM range(1, 65) r(k) WHERE abs(400 + 10 * (k - 1) - 600) <= 42) SELECT y, x, round(sum(w * spectrum[k]) / sum(w), 6) AS v600 FROM spectra, w GROUP BY y, x")
def h19g(spark, d):
    w = S.gaussian_weights([400 + 10.0 * k for k in range(64)], [600.0], [12.0])
    return S.resample_spectra(spectra(spark, d, 64), w).select("y", "x", clean(F.col("spectrum")[0]).alias("v600"))


@query("h20_unmixing")
def h20(spark, d):
    e = np.array([v for _, v in _ref_list(spark, d, plus=1.0)][:4])
    out = S.unmix(spectra(spark, d, plus=1.0), e)
    return out.select("y", "x", clean(F.aggregate("fractions", F.lit(0.0), lambda a, v: a + v)).alias("total"), clean(F.col("rmse")).alias("rmse"))


# the same seeded directions, as a table; the mean shifts all of a direction's values alike
_DIRECTIONS = "p(k, w) AS (VALUES " + ", ".join(f"({k}, {[float(v) for v in w]})" for k, w in enumerate(S.directions(64, 100))) + ")"


@query("h21_endmembers", f"{ctes('spectra')}, {_DIRECTIONS}, t AS (SELECT y, x, k, list_dot_product(spectrum, w) AS t FROM spectra, p), e AS (SELECT y, x FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY t, y, x) = 1 UNION ALL SELECT y, x FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, y, x) = 1) SELECT y, x, count(*) AS purity FROM e GROUP BY y, x ORDER BY purity DESC, y, x LIMIT 5")
def h21(spark, d):
    return S.endmembers(spectra(spark, d), 64, 5, 100)


@query("h22_rx_anomaly")
def h22(spark, d):
    return rounded(S.rx(spectra(spark, d), 64), "score", digits=5).select("y", "x", "score")


@query("h22_rx_mean", f"{ctes('ms')}, t AS (SELECT label, b1, b2 FROM ms WHERE b1 IS NOT NULL AND b2 IS NOT NULL), c AS (SELECT avg(b1) AS m1, avg(b2) AS m2, var_pop(b1) + 1e-9 AS a, var_pop(b2) + 1e-9 AS d, covar_pop(b1, b2) AS b FROM t), s AS (SELECT label, (d * (b1 - m1) * (b1 - m1) - 2 * b * (b1 - m1) * (b2 - m2) + a * (b2 - m2) * (b2 - m2)) / (a * d - b * b) AS score FROM t, c) SELECT label, round(avg(score), 4) AS mean_score, round(max(score), 3) AS top, count(*) AS n FROM s GROUP BY label")
def h22m(spark, d):
    """Two bands, where SQL can write the inverse covariance out."""
    px = load(spark, d, "ms").filter("b1 IS NOT NULL AND b2 IS NOT NULL").withColumn("spectrum", F.array("b1", "b2"))
    return S.rx(px, 2).groupBy("label").agg(nearest(F.avg("score"), 4).alias("mean_score"), nearest(F.max("score"), 3).alias("top"), F.count(F.lit(1)).alias("n"))

"""Matrix operators on two bands, where SQL can write the decomposition out.

The queries go through the same operators as those of all bands; the SQL solves
the two by two eigenproblems by their quadratic equations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.expressions import clean
from ..operators import spectral as S
from .fixtures import ctes, load
from .registry import query
from .spectral_queries import both_dates, full_ms, spectra
from .stats_queries import rounded

#: The first component of a symmetric matrix (a, b; b, d) as a unit vector (u1, u2), and its variance; the second is (-u2, u1).
_TOP = "t AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS top FROM c), n AS (SELECT *, (top - d) / sqrt(pow(top - d, 2) + b * b) AS u1, b / sqrt(pow(top - d, 2) + b * b) AS u2 FROM t), s AS (SELECT *, sign(CASE WHEN abs(u1) >= abs(u2) THEN u1 ELSE u2 END) AS s1, sign(CASE WHEN abs(u2) >= abs(u1) THEN -u2 ELSE u1 END) AS s2 FROM n)"
_TWO = f"{ctes('ms')}, m AS (SELECT y, x, b1, b2, b4 FROM ms WHERE b1 IS NOT NULL), c AS (SELECT avg(b1) AS m1, avg(b2) AS m2, avg(b4) AS pm, stddev_pop(b4) AS ps, var_pop(b1) AS a, covar_pop(b1, b2) AS b, var_pop(b2) AS d FROM m), {_TOP}"


@query("h14_pca_scores", _TWO + " SELECT y, x, round(s1 * (u1 * (b1 - m1) + u2 * (b2 - m2)), 5) AS pc1, round(s2 * (u1 * (b2 - m2) - u2 * (b1 - m1)), 5) AS pc2 FROM m, s")
def h14s(spark, d):
    out, _, _ = S.pca(S.with_array(full_ms(spark, d), ["b1", "b2"]), 2)
    return out.select("y", "x", *[clean(F.col("scores")[k], 5).alias(f"pc{k + 1}") for k in range(2)])


@query("h11_fusion_pca_two", _TWO + ", k AS (SELECT y, x, b1, b2, s1 * u1 AS w1, s1 * u2 AS w2, (b4 - pm) * sqrt(top) / ps - s1 * (u1 * (b1 - m1) + u2 * (b2 - m2)) AS step FROM m, s) SELECT y, x, round(b1 + step * w1, 6) AS b1, round(b2 + step * w2, 6) AS b2 FROM k")
def h11two(spark, d):
    return rounded(S.fuse(full_ms(spark, d), ["b1", "b2"], "b4", "pca"), "b1", "b2").select("y", "x", "b1", "b2")


# w: noise covariance (p, q; q, r) from right neighbours; its inverse times the scene's has the components as eigenvectors
_NOISE = f"{ctes('ms')}, m AS (SELECT y, x, b1, b2 FROM ms WHERE b1 IS NOT NULL), c AS (SELECT avg(b1) AS m1, avg(b2) AS m2, var_pop(b1) AS a, covar_pop(b1, b2) AS b, var_pop(b2) AS d FROM m), f AS (SELECT (m.b1 - o.b1) / sqrt(2) AS e1, (m.b2 - o.b2) / sqrt(2) AS e2 FROM m JOIN m o ON o.y = m.y AND o.x = m.x + 1), w AS (SELECT var_pop(e1) AS p, covar_pop(e1, e2) AS q, var_pop(e2) AS r FROM f), g AS (SELECT *, (r * a - q * b) / (p * r - q * q) AS g11, (r * b - q * d) / (p * r - q * q) AS g12, (p * b - q * a) / (p * r - q * q) AS g21, (p * d - q * b) / (p * r - q * q) AS g22 FROM c, w), l AS (SELECT *, (g11 + g22) / 2 + k * sqrt(pow((g11 - g22) / 2, 2) + g12 * g21) AS snr, k FROM g, (VALUES (1), (-1)) v(k)), v AS (SELECT *, g12 / sqrt(p * g12 * g12 + 2 * q * g12 * (snr - g11) + r * pow(snr - g11, 2)) AS v1, (snr - g11) / sqrt(p * g12 * g12 + 2 * q * g12 * (snr - g11) + r * pow(snr - g11, 2)) AS v2 FROM l), z AS (SELECT *, sign(CASE WHEN abs(v1) >= abs(v2) THEN v1 ELSE v2 END) AS sg FROM v)"


@query("h15_mnf_two", _NOISE + " SELECT y, x, round(max(CASE WHEN k = 1 THEN sg * (v1 * (b1 - m1) + v2 * (b2 - m2)) END), 5) AS c1, round(max(CASE WHEN k = -1 THEN sg * (v1 * (b1 - m1) + v2 * (b2 - m2)) END), 5) AS c2 FROM m, z GROUP BY y, x")
def h15two(spark, d):
    out, _ = S.mnf(S.with_array(full_ms(spark, d), ["b1", "b2"]), 2)
    return out.select("y", "x", *[clean(F.col("scores")[k], 5).alias(f"c{k + 1}") for k in range(2)])


# canonical variates: inv(Sxx) Sxy inv(Syy) Syx has the first date's directions as eigenvectors and squared correlations as values
_MAD = f"{ctes('ms_before', 'ms_after')}, j AS (SELECT y, x, b.b1 AS p1, b.b2 AS p2, a.b1 AS q1, a.b2 AS q2 FROM ms_before b JOIN ms_after a USING (y, x)), c AS (SELECT avg(p1) AS mp1, avg(p2) AS mp2, avg(q1) AS mq1, avg(q2) AS mq2, var_pop(p1) + 1e-9 AS xa, covar_pop(p1, p2) AS xb, var_pop(p2) + 1e-9 AS xd, var_pop(q1) + 1e-9 AS ya, covar_pop(q1, q2) AS yb, var_pop(q2) + 1e-9 AS yd, covar_pop(p1, q1) AS s11, covar_pop(p1, q2) AS s12, covar_pop(p2, q1) AS s21, covar_pop(p2, q2) AS s22 FROM j), h AS (SELECT *, (yd * s11 - yb * s12) / (ya * yd - yb * yb) AS t11, (yd * s21 - yb * s22) / (ya * yd - yb * yb) AS t12, (ya * s12 - yb * s11) / (ya * yd - yb * yb) AS t21, (ya * s22 - yb * s21) / (ya * yd - yb * yb) AS t22 FROM c), i AS (SELECT *, (xd * s11 - xb * s21) / (xa * xd - xb * xb) AS r11, (xd * s12 - xb * s22) / (xa * xd - xb * xb) AS r12, (xa * s21 - xb * s11) / (xa * xd - xb * xb) AS r21, (xa * s22 - xb * s12) / (xa * xd - xb * xb) AS r22 FROM h), g AS (SELECT *, r11 * t11 + r12 * t21 AS g11, r11 * t12 + r12 * t22 AS g12, r21 * t11 + r22 * t21 AS g21, r21 * t12 + r22 * t22 AS g22 FROM i), l AS (SELECT *, (g11 + g22) / 2 + k * sqrt(pow((g11 - g22) / 2, 2) + g12 * g21) AS rr FROM g, (VALUES (1), (-1)) v(k)), v AS (SELECT *, sqrt(rr) AS rho, g12 / sqrt(xa * g12 * g12 + 2 * xb * g12 * (rr - g11) + xd * pow(rr - g11, 2)) AS a1, (rr - g11) / sqrt(xa * g12 * g12 + 2 * xb * g12 * (rr - g11) + xd * pow(rr - g11, 2)) AS a2 FROM l), z AS (SELECT *, (t11 * a1 + t12 * a2) / rho AS e1, (t21 * a1 + t22 * a2) / rho AS e2 FROM v)"


@query("h07_mad_two", _MAD + " SELECT y, x, round(sum(pow(a1 * (p1 - mp1) + a2 * (p2 - mp2) - e1 * (q1 - mq1) - e2 * (q2 - mq2), 2) / (2 * (1 - rho))), 5) AS chi2 FROM j, z GROUP BY y, x")
def h07two(spark, d):
    return rounded(S.mad(both_dates(spark, d), ["p1", "p2"], ["q1", "q2"]), "chi2", digits=5).select("y", "x", "chi2")


_PAIR = f"{ctes('spectra')}, s AS (SELECT y, x, label, list_transform(spectrum, lambda q: cast(q AS double) + 1.0) AS v FROM spectra), r AS (SELECT label, [" + ", ".join(f"avg(spectrum[{k}] + 1.0)" for k in range(1, 65)) + "] AS m FROM spectra GROUP BY label), e AS (SELECT a.m AS e1, b.m AS e2, list_dot_product(a.m, a.m) AS p, list_dot_product(a.m, b.m) AS q, list_dot_product(b.m, b.m) AS r FROM r a, r b WHERE a.label = 0 AND b.label = 1), k AS (SELECT *, greatest(1e-9, (p + r) / 2 * 1e-7) AS ridge FROM e), i AS (SELECT *, p + ridge AS pp, r + ridge AS rr FROM k), f AS (SELECT y, x, v, e1, e2, least(greatest((rr * list_dot_product(e1, v) - q * list_dot_product(e2, v)) / (pp * rr - q * q), 0), 1) AS f1, least(greatest((pp * list_dot_product(e2, v) - q * list_dot_product(e1, v)) / (pp * rr - q * q), 0), 1) AS f2 FROM s, i), u AS (SELECT y, x, v, e1, e2, CASE WHEN f1 + f2 > 1e-12 THEN f1 / (f1 + f2) ELSE f1 END AS f1, CASE WHEN f1 + f2 > 1e-12 THEN f2 / (f1 + f2) ELSE f2 END AS f2 FROM f)"


@query("h20_unmixing_pair", _PAIR + " SELECT y, x, round(f1, 5) AS first, round(f2, 5) AS second, round(sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(v[k] - f1 * e1[k] - f2 * e2[k], 2))) / 64), 5) AS rmse FROM u")
def h20pair(spark, d):
    """Fractions of two class means over all bands."""
    s = spectra(spark, d, plus=1.0)
    means = s.filter("label IN (0, 1)").groupBy("label").agg(*[F.avg(F.col("spectrum")[k]).alias(f"m{k}") for k in range(64)]).orderBy("label").collect()
    out = S.unmix(s, np.array([[r[f"m{k}"] for k in range(64)] for r in means]))
    return out.select("y", "x", clean(F.col("fractions")[0], 5).alias("first"), clean(F.col("fractions")[1], 5).alias("second"), clean(F.col("rmse"), 5).alias("rmse"))

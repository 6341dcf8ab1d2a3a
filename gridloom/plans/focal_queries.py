"""Queries of the neighbourhood operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import clean
from ..operators import focal as O
from .fixtures import ctes, load
from .registry import query
from .stats_queries import rounded


def around(table: str, r: int, cols: str = "value", clamp: bool = True, extra: str = "") -> str:
    """CTE ``n(y, x, dy, dx, cols)`` of neighbours in DuckDB."""
    at = ("least(greatest(t.y + dy, 0), my)", "least(greatest(t.x + dx, 0), mx)") if clamp else ("t.y + dy", "t.x + dx")
    pick = ", ".join(f"v.{c}" for c in cols.split(", "))
    return f"{ctes(table)}, e AS (SELECT max(y) AS my, max(x) AS mx FROM {table}), o AS (SELECT dy, dx FROM range({-r}, {r + 1}) a(dy), range({-r}, {r + 1}) b(dx) {extra}), nq AS MATERIALIZED (SELECT t.y, t.x, dy, dx, cast({at[0]} AS bigint) AS ty, cast({at[1]} AS bigint) AS tx FROM {table} t CROSS JOIN o CROSS JOIN e), n AS (SELECT t.y, t.x, dy, dx, {pick} FROM nq t JOIN {table} v ON v.y = t.ty AND v.x = t.tx)"


def _kernel(k):
    r = len(k) // 2
    return "CASE " + " ".join(f"WHEN dy = {a - r} AND dx = {b - r} THEN {k[a][b]}" for a in range(len(k)) for b in range(len(k))) + " END"


@query("e01_mean_blur", around("grid", 1) + " SELECT y, x, round(avg(value), 4) AS value FROM n GROUP BY y, x")
def e01(spark, d):
    return rounded(O.mean_filter(load(spark, d, "grid")), "value", digits=4)


@query("e01_gaussian_blur", around("grid", 2) + " SELECT y, x, round(sum(exp(-(dy * dy + dx * dx) / 2.0) * value) / sum(exp(-(dy * dy + dx * dx) / 2.0)), 4) AS value FROM n GROUP BY y, x")
def e01g(spark, d):
    return rounded(O.convolve(load(spark, d, "grid"), O.gaussian_kernel(5, 1.0)), "value", digits=4)


@query("e02_median_blur", around("grid", 1) + " SELECT y, x, round(quantile_cont(value, 0.5), 4) AS value FROM n GROUP BY y, x")
def e02(spark, d):
    return rounded(O.median_filter(load(spark, d, "grid")), "value", digits=4)


@query("e03_sobel", around("dem", 1) + f" SELECT y, x, round(sqrt(pow(sum(({_kernel(O.SOBEL_X)}) * value), 2) + pow(sum(({_kernel(O.SOBEL_Y)}) * value), 2)), 6) AS value FROM n GROUP BY y, x")
def e03(spark, d):
    return rounded(O.gradient(load(spark, d, "dem")), "value").select("y", "x", "value")


@query("e03_laplacian", around("dem", 1) + f" SELECT y, x, round(sum(({_kernel(O.LAPLACIAN)}) * value), 6) AS value FROM n GROUP BY y, x")
def e03l(spark, d):
    return rounded(O.convolve(load(spark, d, "dem"), O.LAPLACIAN), "value")


_WAYS = [(0, 1), (1, 1), (1, 0), (1, -1)]
_KEPT = " OR ".join(f"(way = {k} AND value >= n{k}a AND value >= n{k}b)" for k in range(4))
_AT = ", ".join(f"max(CASE WHEN dy = {s * a} AND dx = {s * b} THEN value END) AS n{k}{t}" for k, (a, b) in enumerate(_WAYS) for s, t in ((1, "a"), (-1, "b")))
_CANNY = (
    f"WITH RECURSIVE {around('dem', 1)[5:]}, b AS (SELECT y, x, sum(exp(-(dy * dy + dx * dx) / 2.0) * value) / sum(exp(-(dy * dy + dx * dx) / 2.0)) AS value FROM n GROUP BY y, x), "
    f"g AS (SELECT nq.y, nq.x, sum(({_kernel(O.SOBEL_X)}) * value) AS gx, sum(({_kernel(O.SOBEL_Y)}) * value) AS gy FROM nq JOIN b ON b.y = ty AND b.x = tx GROUP BY nq.y, nq.x), "
    "a AS (SELECT y, x, sqrt(gx * gx + gy * gy) AS value, degrees(atan2(gy, gx)) AS turn FROM g), r AS (SELECT y, x, value, CASE WHEN turn < 0 THEN turn + 180 WHEN turn >= 180 THEN turn - 180 ELSE turn END AS turn FROM a), "
    "m AS (SELECT y, x, value, CASE WHEN turn < 22.5 OR turn >= 157.5 THEN 0 WHEN turn < 67.5 THEN 1 WHEN turn < 112.5 THEN 2 ELSE 3 END AS way FROM r), "
    f"k AS (SELECT nq.y, nq.x, max(CASE WHEN dy = 0 AND dx = 0 THEN value END) AS value, max(CASE WHEN dy = 0 AND dx = 0 THEN way END) AS way, {_AT} FROM nq JOIN m ON m.y = ty AND m.x = tx GROUP BY nq.y, nq.x), "
    f"t AS MATERIALIZED (SELECT y, x, value FROM k WHERE value >= 20 AND ({_KEPT})), w(y, x) AS (SELECT y, x FROM t WHERE value >= 60 UNION SELECT t.y, t.x FROM w JOIN t ON abs(t.y - w.y) <= 1 AND abs(t.x - w.x) <= 1) SELECT y, x FROM w"
)


@query("e04_canny", _CANNY)
def e04(spark, d):
    from ..operators.components import reach

    dem = O.convolve(load(spark, d, "dem"), O.gaussian_kernel(3, 1.0))
    edges = O.thin_edges(dem).filter("value >= 20")
    return reach(edges.select("y", "x"), edges.filter("value >= 60").select("y", "x"), diagonal=True)


_L = around("dem", 1) + ", s AS (SELECT y, x, max(CASE WHEN dy = 0 AND dx = 0 THEN value END) AS c, avg(value) AS m, var_pop(value) AS v FROM n GROUP BY y, x)"


@query("e05_lee", _L + " SELECT y, x, round(m + greatest(coalesce(1 - 0.25 / nullif(coalesce(v / nullif(m * m, 0), 0), 0), 0), 0) * (c - m), 6) AS value FROM s")
def e05(spark, d):
    return rounded(O.speckle(load(spark, d, "dem"), "lee", looks=4), "value")


@query("e05_kuan", _L + " SELECT y, x, round(m + greatest(coalesce((1 - 0.25 / nullif(coalesce(v / nullif(m * m, 0), 0), 0)) / 1.25, 0), 0) * (c - m), 6) AS value FROM s")
def e05k(spark, d):
    return rounded(O.speckle(load(spark, d, "dem"), "kuan", looks=4), "value")


@query("e05_frost", _L + ", w AS (SELECT n.y, n.x, n.value, exp(-coalesce(v / nullif(m * m, 0), 0) * sqrt(dy * dy + dx * dx)) AS w FROM n JOIN s USING (y, x)) SELECT y, x, round(sum(w * value) / sum(w), 6) AS value FROM w GROUP BY y, x")
def e05f(spark, d):
    return rounded(O.speckle(load(spark, d, "dem"), "frost"), "value")


@query("e05_enhanced_lee", _L + ", q AS (SELECT *, sqrt(coalesce(v / nullif(m * m, 0), 0)) AS ci FROM s) SELECT y, x, round(CASE WHEN ci <= 0.5 THEN m WHEN ci >= sqrt(1.5) THEN c ELSE m * exp(-(ci - 0.5) / (sqrt(1.5) - ci)) + c * (1 - exp(-(ci - 0.5) / (sqrt(1.5) - ci))) END, 6) AS value FROM q")
def e05e(spark, d):
    return rounded(O.speckle(load(spark, d, "dem"), "enhanced_lee", looks=4), "value")


@query("e05_gamma_map", _L + ", q AS (SELECT *, coalesce(v / nullif(m * m, 0), 0) AS ci2, sqrt(coalesce(v / nullif(m * m, 0), 0)) AS ci FROM s), a AS (SELECT *, 1.25 / nullif(ci2 - 0.25, 0) AS alpha FROM q) SELECT y, x, round(CASE WHEN ci <= 0.5 THEN m WHEN ci >= sqrt(2) * 0.5 THEN c ELSE ((alpha - 5) * m + sqrt(m * m * (alpha - 5) * (alpha - 5) + 16 * alpha * m * c)) / (2 * alpha) END, 6) AS value FROM a")
def e05m(spark, d):
    return rounded(O.speckle(load(spark, d, "dem"), "gamma_map", looks=4), "value")


@query("e06_open", "WITH RECURSIVE " + around("dem", 1)[5:] + ", er AS (SELECT y, x, min(value) AS value FROM n GROUP BY y, x) SELECT nq.y, nq.x, max(v.value) AS value FROM nq JOIN er v ON v.y = nq.ty AND v.x = nq.tx GROUP BY nq.y, nq.x")
def e06(spark, d):
    return O.morphology(load(spark, d, "dem"), "open")


@query("e06_dilate", around("dem", 1) + " SELECT y, x, max(value) AS value FROM n GROUP BY y, x")
def e06d(spark, d):
    return O.morphology(load(spark, d, "dem"), "dilate")


@query("e06_erode", around("dem", 1) + " SELECT y, x, min(value) AS value FROM n GROUP BY y, x")
def e06e(spark, d):
    return O.morphology(load(spark, d, "dem"), "erode")


@query("e06_close", "WITH RECURSIVE " + around("dem", 1)[5:] + ", di AS (SELECT y, x, max(value) AS value FROM n GROUP BY y, x) SELECT nq.y, nq.x, min(v.value) AS value FROM nq JOIN di v ON v.y = nq.ty AND v.x = nq.tx GROUP BY nq.y, nq.x")
def e06c(spark, d):
    return O.morphology(load(spark, d, "dem"), "close")


_T = around("dem", 1, clamp=False) + ", c AS (SELECT y, x, " + ", ".join(f"max(CASE WHEN dy = {a} AND dx = {b} THEN value END) AS z{a + 1}{b + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1)) + " FROM n GROUP BY y, x), f AS (SELECT y, x, z11, " + ", ".join(f"coalesce(z{a}{b}, z11) AS f{a}{b}" for a in (0, 1, 2) for b in (0, 1, 2)) + " FROM c), g AS (SELECT *, ((f02 + 2 * f12 + f22) - (f00 + 2 * f10 + f20)) / 8 AS gx, ((f20 + 2 * f21 + f22) - (f00 + 2 * f01 + f02)) / 8 AS gy FROM f), h AS (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS sl, CASE WHEN gx = 0 AND gy = 0 THEN -1.0 ELSE (degrees(atan2(-gx, gy)) + 360.0) % 360.0 END AS asp FROM g)"


@query("e07_terrain", _T + " SELECT y, x, round(degrees(sl), 5) AS slope, round(asp, 5) AS aspect, round(greatest(least(sin(radians(45.0)) * cos(sl) + cos(radians(45.0)) * sin(sl) * CASE WHEN asp < 0 THEN 0 ELSE cos(radians(315.0) - radians(asp)) END, 1.0), 0.0), 5) AS hillshade, greatest(f00, f01, f02, f10, f11, f12, f20, f21, f22) - least(f00, f01, f02, f10, f11, f12, f20, f21, f22) AS roughness, round(sqrt(pow(f00 - z11, 2) + pow(f01 - z11, 2) + pow(f02 - z11, 2) + pow(f10 - z11, 2) + pow(f12 - z11, 2) + pow(f20 - z11, 2) + pow(f21 - z11, 2) + pow(f22 - z11, 2)), 5) AS tri, round(z11 - (f00 + f01 + f02 + f10 + f12 + f20 + f21 + f22) / 8, 5) AS tpi FROM h")
def e07(spark, d):
    return rounded(O.terrain(load(spark, d, "dem")), "slope", "aspect", "hillshade", "tri", "tpi", digits=5)


@query("e08_majority_filter", around("grid", 1, "label") + ", c AS (SELECT y, x, label, count(*) AS k FROM n GROUP BY ALL) SELECT y, x, label FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY k DESC, label) AS rn FROM c) WHERE rn = 1")
def e08(spark, d):
    return O.majority_filter(load(spark, d, "grid"), "label")


@query("e09_glcm", around("dem", 1, clamp=False).replace("SELECT t.y, t.x, dy, dx, v.value", "SELECT t.y, t.x, dy, dx, v.y AS vy, v.x AS vx, v.value") + ", q AS (SELECT y, x, cast(least(floor(value / 50.0 * 8), 7) AS bigint) AS q FROM dem), p AS (SELECT a.y, a.x, a.q AS q1, b.q AS q2 FROM q a JOIN q b ON b.y = a.y AND b.x = a.x + 1), k AS (SELECT n.y, n.x, q1, q2, count(*) AS c FROM n JOIN p ON p.y = vy AND p.x = vx GROUP BY ALL), f AS (SELECT *, c / sum(c) OVER (PARTITION BY y, x) AS pr FROM k) SELECT y, x, round(sum(pr * pr), 6) AS energy, round(sum(-pr * ln(pr)), 6) AS entropy, round(sum((q1 - q2) * (q1 - q2) * pr), 6) AS contrast, round(sum(pr / (1 + (q1 - q2) * (q1 - q2))), 6) AS homogeneity, round((sum(c) * sum(c * q1 * q2) - sum(c * q1) * sum(c * q2)) / nullif(sqrt(cast(sum(c) * sum(c * q1 * q1) - pow(sum(c * q1), 2) AS double) * cast(sum(c) * sum(c * q2 * q2) - pow(sum(c * q2), 2) AS double)), 0), 6) AS correlation FROM f GROUP BY y, x")
def e09(spark, d):
    return rounded(O.glcm(load(spark, d, "dem"), 1, 8, 0.0, 50.0), "energy", "entropy", "contrast", "homogeneity", "correlation")


@query("e10_local_statistics", around("dem", 1) + ", m AS (SELECT y, x, avg(value) AS mean, var_pop(value) AS variance FROM n GROUP BY y, x) SELECT m.y, m.x, round(any_value(mean), 5) AS mean, round(any_value(variance), 5) AS variance, round(avg(pow(value - mean, 3)) / nullif(pow(any_value(variance), 1.5), 0), 5) AS skewness, round(avg(pow(value - mean, 4)) / nullif(pow(any_value(variance), 2), 0) - 3, 5) AS kurtosis FROM n JOIN m USING (y, x) GROUP BY m.y, m.x")
def e10(spark, d):
    return rounded(O.local_statistics(load(spark, d, "dem")), "mean", "variance", "skewness", "kurtosis", digits=5)


@query("e11_feature_stack", around("dem", 1) + f", s AS (SELECT y, x, max(CASE WHEN dy = 0 AND dx = 0 THEN value END) AS value, avg(value) AS mean, sqrt(pow(sum(({_kernel(O.SOBEL_X)}) * value), 2) + pow(sum(({_kernel(O.SOBEL_Y)}) * value), 2)) AS edge FROM n GROUP BY y, x) SELECT y, x, value, round(mean, 6) AS mean, round(edge, 6) AS edge FROM s")
def e11(spark, d):
    dem = load(spark, d, "dem")
    parts = [dem, O.mean_filter(dem).withColumnRenamed("value", "mean"), O.gradient(dem).select("y", "x", F.col("value").alias("edge"))]
    out = parts[0].join(parts[1], ["y", "x"]).join(parts[2], ["y", "x"])
    return rounded(out, "mean", "edge")


def _holes(table):
    return table.select("y", "x", F.when(F.pmod(F.col("y") * 7 + F.col("x") * 3, F.lit(11)) != 0, F.col("value")).alias("value"))


_H = "dem AS (SELECT y, x, CASE WHEN (y * 7 + x * 3) % 11 <> 0 THEN value END AS value FROM dem0)"


@query("e12_fill_nodata", around("dem", 2, clamp=False, extra="WHERE dy * dy + dx * dx <= 4").replace("WITH dem AS (", "WITH dem0 AS (").replace("), e AS", f"), {_H}, e AS", 1) + ", s AS (SELECT y, x, max(CASE WHEN dy = 0 AND dx = 0 THEN value END) AS c, sum(CASE WHEN dy * dy + dx * dx > 0 AND value IS NOT NULL THEN value / sqrt(dy * dy + dx * dx) END) AS s, sum(CASE WHEN dy * dy + dx * dx > 0 AND value IS NOT NULL THEN 1 / sqrt(dy * dy + dx * dx) END) AS w FROM n GROUP BY y, x) SELECT y, x, round(coalesce(c, s / w), 6) AS value FROM s")
def e12(spark, d):
    return rounded(O.fill_nodata(_holes(load(spark, d, "dem")), 2), "value")


@query("e13_proximity", around("dem", 4, clamp=False, extra="WHERE dy * dy + dx * dx <= 16") + " SELECT y, x, round(min(CASE WHEN value >= 48 THEN sqrt(dy * dy + dx * dx) END), 6) AS distance FROM n GROUP BY y, x")
def e13(spark, d):
    return rounded(O.proximity(load(spark, d, "dem"), "value >= 48", 4), "distance")


@query("e14_mean_shift", around("dem", 1) + ", r1 AS (SELECT n.y, n.x, avg(n.value) AS value FROM n JOIN dem c ON c.y = n.y AND c.x = n.x WHERE abs(n.value - c.value) <= 10 GROUP BY n.y, n.x), n2 AS (SELECT nq.y, nq.x, v.value, c.value AS c FROM nq JOIN r1 v ON v.y = nq.ty AND v.x = nq.tx JOIN r1 c ON c.y = nq.y AND c.x = nq.x) SELECT y, x, round(avg(value), 6) AS value FROM n2 WHERE abs(value - c) <= 10 GROUP BY y, x")
def e14(spark, d):
    return rounded(O.mean_shift(load(spark, d, "dem"), 1, 10.0, 2), "value")


@query("e15_contours", f"{ctes('dem')}, c AS (SELECT a.y, a.x, a.value AS a, b.value AS b, c.value AS c, d.value AS d FROM dem a JOIN dem b ON b.y = a.y AND b.x = a.x + 1 JOIN dem c ON c.y = a.y + 1 AND c.x = a.x + 1 JOIN dem d ON d.y = a.y + 1 AND d.x = a.x), l AS (SELECT cast(k * 10.0 AS double) AS level, * FROM c, range(1, 20) r(k) WHERE k * 10.0 > least(a, b, c, d) AND k * 10.0 <= greatest(a, b, c, d)), q AS (SELECT level, y, x, (a >= level)::int + 2 * (b >= level)::int + 4 * (c >= level)::int + 8 * (d >= level)::int AS code FROM l) SELECT level, y, x, code FROM q WHERE code NOT IN (0, 15)")
def e15(spark, d):
    return O.contours(load(spark, d, "dem"), 10.0)


def _seek(a: str, b: str) -> str:
    return f"{b} AS (SELECT m.y, m.x, coalesce(avg(q.y), any_value(m.my)) AS my, coalesce(avg(q.x), any_value(m.mx)) AS mx, coalesce(avg(q.value), any_value(m.v)) AS v FROM {a} m LEFT JOIN dem q ON q.y BETWEEN m.my - 1.618 AND m.my + 1.618 AND pow(q.y - m.my, 2) + pow(q.x - m.mx, 2) <= 1.618 * 1.618 AND abs(q.value - m.v) <= 10.237 GROUP BY m.y, m.x)"


@query("e14_mode_seeking", f"{ctes('dem')}, m0 AS (SELECT y, x, y::double AS my, x::double AS mx, value AS v FROM dem), {_seek('m0', 'm1')}, {_seek('m1', 'm2')}, {_seek('m2', 'm3')} SELECT y, x, round(v, 5) AS value, round(my, 5) AS my, round(mx, 5) AS mx FROM m3")
def e14m(spark, d):
    """Windows that follow their modes in place and value, three steps."""
    from ..operators.segmentation import modes

    return rounded(modes(load(spark, d, "dem"), ["value"], 1.618, 10.237, 3, 0.0), "value", "my", "mx", digits=5).select("y", "x", "value", "my", "mx")


@query("e13_distance_transform", f"{ctes('dem')} SELECT t.y, t.x, round(sqrt(min(pow(t.y - s.y, 2) + pow(t.x - s.x, 2))), 6) AS distance FROM dem t, dem s WHERE s.value = 50 GROUP BY t.y, t.x")
def e13d(spark, d):
    """Distance to the nearest of few targets, however far."""
    from ..operators.distance import distance_transform

    return rounded(distance_transform(load(spark, d, "dem"), "value = 50"), "distance")


_BALL = around("dem", 2, extra="WHERE dy * dy + dx * dx <= 4")


@query("e06_ball_erode", _BALL + " SELECT y, x, min(value) AS value FROM n GROUP BY y, x")
def e06ball(spark, d):
    """Erosion by a ball of radius 2."""
    from ..operators.morphology import shaped

    return shaped(load(spark, d, "dem"), "erode", 2, "ball")


@query("e06_open_by_reconstruction", "WITH RECURSIVE " + _BALL[5:] + ", er AS (SELECT y, x, min(value) AS value FROM n GROUP BY y, x), nb AS MATERIALIZED (SELECT a.y, a.x, a.value AS m, b.y AS vy, b.x AS vx FROM dem a JOIN dem b ON abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1), re(k, y, x, v) AS (SELECT 0, y, x, value FROM er UNION ALL SELECT k + 1, nb.y, nb.x, least(max(v), any_value(m)) FROM re JOIN nb ON nb.vy = re.y AND nb.vx = re.x WHERE k < 120 GROUP BY k, nb.y, nb.x) SELECT y, x, v AS value FROM re WHERE k = 120")
def e06r(spark, d):
    """What a ball of radius 2 leaves, grown back under the picture; the SQL dilates 120 times."""
    from ..operators.morphology import by_reconstruction

    return by_reconstruction(load(spark, d, "dem"), "open", 2)


@query("e06_morphological_profile")
def e06p(spark, d):
    """Openings by reconstruction at radii 1 and 2, and what each takes away."""
    from ..operators.morphology import profile

    return profile(load(spark, d, "dem"), [1, 2])

"""Queries of the statistics operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import clean, nearest
from ..operators import stats as S
from .fixtures import ctes, load
from .registry import query

BANDS = ["b1", "b2", "b3", "b4"]


def rounded(df, *cols, digits=6):
    return df.withColumns({c: clean(F.col(c), digits) for c in cols})


@query("d01_raster_statistics", f"{ctes('ms')}, l AS (" + " UNION ALL ".join(f"SELECT '{b}' AS band, {b} AS v FROM ms" for b in BANDS) + ") SELECT band, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev FROM l GROUP BY band")
def d01(spark, d):
    return rounded(S.band_statistics(load(spark, d, "ms"), BANDS), "min", "max", "mean", "stddev")


@query("d02_mergeable_statistics", f"{ctes('grid')} SELECT label, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 3) AS stddev FROM grid GROUP BY label")
def d02(spark, d):
    g = load(spark, d, "grid").withColumn("tile", F.floor(F.col("x") / 25))
    return rounded(rounded(S.merge_statistics(S.partial_statistics(g, "value", ["label", "tile"]), ["label"]), "mean", digits=4), "stddev", digits=3)


@query("d03_segment_stats", f"{ctes('ms')} SELECT label AS segment_id, count(*) AS area_pixels, round(avg(b1), 6) AS mean_b1, round(avg(b2), 6) AS mean_b2 FROM ms WHERE label > 0 AND b1 IS NOT NULL AND b2 IS NOT NULL GROUP BY label")
def d03(spark, d):
    return rounded(S.segment_stats(load(spark, d, "ms"), "label", ["b1", "b2"]), "mean_b1", "mean_b2")


_D4 = f"""{ctes('grid')}, p AS (SELECT y, x, label AS seg, value AS v, cast(least(greatest(floor(value / 500000.0 * 8), 0), 7) AS bigint) AS q FROM grid),
 b AS (SELECT seg, count(*) AS area, avg(v) AS mean, stddev_pop(v) AS stddev, min(v) AS min, max(v) AS max, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM p GROUP BY seg),
 i AS (SELECT a.seg, a.q AS qa, c.q AS qb, a.y AS y1, a.x AS x1, c.y AS y2, c.x AS x2 FROM p a JOIN p c ON a.seg = c.seg AND ((c.y = a.y AND c.x = a.x + 1) OR (c.y = a.y + 1 AND c.x = a.x))),
 t AS (SELECT seg, count(*) AS pairs, avg((qa - qb) * (qa - qb)) AS contrast, avg(1.0 / (1 + abs(qa - qb))) AS homogeneity, corr(qa, qb) AS correlation FROM i GROUP BY seg),
 s AS (SELECT seg, count(*) AS inside FROM (SELECT seg, y, x FROM (SELECT seg, y1 AS y, x1 AS x FROM i UNION ALL SELECT seg, y2, x2 FROM i) GROUP BY seg, y, x HAVING count(*) = 4) GROUP BY seg),
 e AS (SELECT seg, sum(n * n) / (sum(n) * sum(n)) AS energy FROM (SELECT seg, qa, qb, cast(count(*) AS double) AS n FROM i GROUP BY ALL) GROUP BY seg)
SELECT b.seg AS segment_id, area, round(mean, 4) AS mean, round(stddev, 3) AS stddev, min, max, area - coalesce(inside, 0) AS perimeter, round((area - coalesce(inside, 0)) / (4 * sqrt(area)), 6) AS shape_index, round(pow(area - coalesce(inside, 0), 2) / (4 * pi() * area), 6) AS compactness, round(area / (w * h), 6) AS rectangularity, round(greatest(w, h) / least(w, h), 6) AS aspect_ratio, round(contrast, 6) AS contrast, round(correlation, 6) AS correlation, round(homogeneity, 6) AS homogeneity, round(energy, 6) AS energy
FROM b LEFT JOIN t USING (seg) LEFT JOIN e ON e.seg = b.seg LEFT JOIN s ON s.seg = b.seg"""


@query("d04_segment_features", _D4)
def d04(spark, d):
    out = S.segment_features(load(spark, d, "grid"), "label", "value", 8, 0.0, 500000.0)
    out = rounded(rounded(rounded(out, "mean", digits=4), "stddev", digits=3), "shape_index", "compactness", "rectangularity", "aspect_ratio", "contrast", "correlation", "homogeneity", "energy")
    return out


@query("d05_hierarchy_features", f"{ctes('grid')}, f AS (SELECT label * 1000 + cast(floor(x / 10) AS bigint) AS seg, label AS parent, count(*) AS area FROM grid GROUP BY ALL), p AS (SELECT label AS parent, count(*) AS parent_area FROM grid GROUP BY label) SELECT seg, parent, area, round(area / parent_area, 6) AS area_ratio, count(*) OVER (PARTITION BY parent) AS child_count FROM f JOIN p USING (parent)")
def d05(spark, d):
    g = load(spark, d, "grid")
    fine = g.groupBy((F.col("label") * 1000 + F.floor(F.col("x") / 10)).alias("seg"), F.col("label").alias("parent")).agg(F.count(F.lit(1)).alias("area"))
    up = fine.groupBy("parent").agg(F.sum("area").alias("pa"), F.count(F.lit(1)).alias("child_count"))
    return fine.join(up, "parent").select("seg", "parent", "area", clean(F.col("area") / F.col("pa")).alias("area_ratio"), "child_count")


_LEVELS = {"fine": "label * 10000 + cast(floor(x / 20) AS bigint) * 100 + cast(floor(y / 5) AS bigint)", "mid": "label * 100 + cast(floor(x / 20) AS bigint)", "top": "cast(label AS bigint)"}
_RANGES = {"b1": (0.0, 50.0), "b2": (0.0, 60.0)}
_TEXTURE = ("contrast", "correlation", "homogeneity", "energy")
_D5 = f"""{ctes('ms')}, p AS (SELECT y, x, {_LEVELS['mid']} AS seg, b1, b2 FROM ms),
 b AS (SELECT seg, count(*) AS area, {', '.join(f"avg({b}) AS mean_{b}, stddev_pop({b}) AS stddev_{b}, min({b}) AS min_{b}, max({b}) AS max_{b}" for b in _RANGES)}, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM p GROUP BY seg),
 s AS (SELECT seg, count(*) AS inside FROM (SELECT a.seg, a.y, a.x FROM p a JOIN p c ON a.seg = c.seg AND abs(a.y - c.y) + abs(a.x - c.x) = 1 GROUP BY ALL HAVING count(*) = 4) GROUP BY seg),
 q AS ({' UNION ALL '.join(f"SELECT y, x, seg, '{b}' AS band, cast(least(greatest(floor(({b} - {lo}) / ({hi} - {lo}) * 8), 0), 7) AS bigint) AS q FROM p WHERE {b} IS NOT NULL" for b, (lo, hi) in _RANGES.items())}),
 i AS (SELECT a.seg, a.band, a.q AS qa, c.q AS qb FROM q a JOIN q c ON a.seg = c.seg AND a.band = c.band AND ((c.y = a.y AND c.x = a.x + 1) OR (c.y = a.y + 1 AND c.x = a.x))),
 e AS (SELECT seg, band, sum(n * n) / (sum(n) * sum(n)) AS energy FROM (SELECT seg, band, qa, qb, cast(count(*) AS double) AS n FROM i GROUP BY ALL) GROUP BY ALL),
 t AS (SELECT seg, band, avg((qa - qb) * (qa - qb)) AS contrast, CASE WHEN min(qa) < max(qa) AND min(qb) < max(qb) THEN corr(qa, qb) END AS correlation, avg(1.0 / (1 + abs(qa - qb))) AS homogeneity FROM i GROUP BY ALL),
 z AS (SELECT seg, {', '.join(f"max(CASE WHEN band = '{b}' THEN {c} END) AS {c}_{b}" for b in _RANGES for c in _TEXTURE)} FROM t JOIN e USING (seg, band) GROUP BY seg),
 u AS (SELECT label AS parent_id, count(*) AS pa FROM ms WHERE label <> 3 GROUP BY label), f AS (SELECT {_LEVELS['mid']} AS seg, count(DISTINCT {_LEVELS['fine']}) AS child_count FROM ms GROUP BY 1)
SELECT b.seg AS segment_id, area, {', '.join(f"round({c}_{b}, 5) AS {c}_{b}" for b in _RANGES for c in ('mean', 'stddev', 'min', 'max', *_TEXTURE))}, area - coalesce(inside, 0) AS perimeter, round((area - coalesce(inside, 0)) / (4 * sqrt(area)), 5) AS shape_index, round(pow(area - coalesce(inside, 0), 2) / (4 * pi() * area), 5) AS compactness, round(area / (w * h), 5) AS rectangularity, round(greatest(w, h) / least(w, h), 5) AS aspect_ratio, coalesce(parent_id, 0) AS parent_id, child_count, round(coalesce(area / pa, 0), 5) AS area_ratio
FROM b LEFT JOIN s ON s.seg = b.seg LEFT JOIN z ON z.seg = b.seg LEFT JOIN f ON f.seg = b.seg LEFT JOIN u ON u.parent_id = b.seg // 100"""


@query("d05_feature_matrix", _D5)
def d05m(spark, d):
    """All features of two bands at the middle of three levels; segments of class 3 have no parent."""
    px = load(spark, d, "ms").select("y", "x", "b1", "b2", "label", *[F.expr(e).alias(n) for n, e in _LEVELS.items()])
    own = S.segment_features(px, "mid", list(_RANGES), 8, *[[r[k] for r in _RANGES.values()] for k in (0, 1)])
    up = px.filter("label <> 3").select(F.col("mid").alias("segment_id"), F.col("top").alias("parent_id")).distinct()
    down = px.select(F.col("fine").alias("segment_id"), F.col("mid").alias("parent_id")).distinct()
    out = S.hierarchy_features(own, up, px.groupBy(F.col("top").alias("segment_id")).agg(F.count(F.lit(1)).alias("area")), down)
    return rounded(out, *[c for c in out.columns if c not in ("segment_id", "area", "perimeter", "parent_id", "child_count")], digits=5)


@query("d06_post_classification_change", f"{ctes('truth')}, m AS (SELECT truth AS f, pred AS t, count(*) AS n FROM truth GROUP BY ALL), k AS (SELECT f AS class FROM m UNION SELECT t FROM m), s AS (SELECT class, (SELECT coalesce(sum(n), 0) FROM m WHERE f = class) AS before, (SELECT coalesce(sum(n), 0) FROM m WHERE t = class) AS after, (SELECT coalesce(sum(n), 0) FROM m WHERE f = class AND t = class) AS unchanged FROM k) SELECT class, cast(before AS bigint) AS before, cast(after AS bigint) AS after, cast(after - before AS bigint) AS net_change, cast(unchanged AS bigint) AS unchanged, round(100.0 * (before - unchanged) / nullif(before, 0), 6) AS percent_changed FROM s")
def d06(spark, d):
    return rounded(S.change_report(S.transitions(load(spark, d, "truth"), "truth", "pred", 5)), "percent_changed")


@query("d06_transition_matrix", f"{ctes('truth')} SELECT truth AS from_class, pred AS to_class, count(*) AS n FROM truth GROUP BY ALL")
def d06m(spark, d):
    return S.transitions(load(spark, d, "truth"), "truth", "pred", 5)


_D7 = f"{ctes('truth')}, m AS (SELECT truth AS t, pred AS p, count(*) AS n FROM truth GROUP BY ALL), k AS (SELECT DISTINCT t AS class FROM m), c AS (SELECT class, (SELECT sum(n) FROM m WHERE t = class) AS nt, (SELECT sum(n) FROM m WHERE p = class) AS np, (SELECT sum(n) FROM m WHERE t = class AND p = class) AS hit FROM k)"


@query("d07_accuracy", _D7 + " SELECT cast(sum(nt) AS bigint) AS n, round(sum(hit) / sum(nt), 6) AS overall, round((sum(hit) / sum(nt) - sum(nt * np) / (sum(nt) * sum(nt))) / (1 - sum(nt * np) / (sum(nt) * sum(nt))), 6) AS kappa FROM c")
def d07(spark, d):
    return rounded(S.accuracy(load(spark, d, "truth"), "truth", "pred")[0], "overall", "kappa")


@query("d07_class_accuracy", _D7 + " SELECT class, round(hit / nt, 6) AS producer, round(hit / np, 6) AS user, round(2 * (hit / nt) * (hit / np) / (hit / nt + hit / np), 6) AS f1 FROM c")
def d07c(spark, d):
    return rounded(S.accuracy(load(spark, d, "truth"), "truth", "pred")[1], "producer", "user", "f1")


@query("d08_change_statistics", f"{ctes('ms_before', 'ms_after')}, e AS (SELECT a.b1 - b.b1 AS v FROM ms_before b JOIN ms_after a USING (y, x)) SELECT count(*) AS n, count(v) AS valid, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS stddev, count(*) FILTER (WHERE abs(v) >= 10) AS changed, round(100.0 * count(*) FILTER (WHERE abs(v) >= 10) / count(v), 6) AS percent, round(900.0 * count(*) FILTER (WHERE abs(v) >= 10), 6) AS area FROM e")
def d08(spark, d):
    e = load(spark, d, "ms_before").select("y", "x", F.col("b1").alias("p")).join(load(spark, d, "ms_after").select("y", "x", F.col("b1").alias("q")), ["y", "x"]).select((F.col("q") - F.col("p")).alias("v"))
    hit = F.count(F.when(F.abs("v") >= 10, 1))
    return rounded(e.agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("valid"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("stddev"), hit.alias("changed"), (hit * 100.0 / F.count("v")).alias("percent"), (hit * 900.0).alias("area")), "mean", "min", "max", "stddev", "percent", "area")


@query("d09_histogram", f"{ctes('grid')} SELECT cast(least(floor(value / 500000.0 * 20), 19) AS integer) AS bin, round(0.0 + least(floor(value / 500000.0 * 20), 19) * 25000.0, 6) AS edge, count(*) AS n FROM grid WHERE value BETWEEN 0 AND 500000 GROUP BY ALL")
def d09(spark, d):
    return S.histogram(load(spark, d, "grid"), "value", 20, 0.0, 500000.0)


@query("d09_freedman_diaconis", f"{ctes('grid')}, r AS (SELECT 2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) * pow(count(value), -1.0 / 3) AS w, min(value) AS lo, max(value) AS hi FROM grid) SELECT round(w, 4) AS width, cast(ceil((hi - lo) / w) AS bigint) AS bins FROM r")
def d09f(spark, d):
    return rounded(S.freedman_diaconis(load(spark, d, "grid"), "value"), "width", digits=4)


def _breaks(name, sql, **o):
    @query(f"d10_breaks_{name}", f"{ctes('grid')} {sql}")
    def run(spark, d):
        g = load(spark, d, "grid")
        ends = S.breaks(g, "value", **o)
        return g.groupBy(S.classify(F.col("value"), ends).cast("bigint").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


_AGG = "count(*) AS n, min(value) AS low, max(value) AS high FROM k GROUP BY class"
_breaks("equal", f", r AS (SELECT min(value) AS lo, max(value) AS hi FROM grid), k AS (SELECT value, cast((value > lo + (hi - lo) * 1 / 5)::int + (value > lo + (hi - lo) * 2 / 5)::int + (value > lo + (hi - lo) * 3 / 5)::int + (value > lo + (hi - lo) * 4 / 5)::int AS bigint) AS class FROM grid, r) SELECT class, {_AGG}", method="equal")
_breaks("quantile", f", r AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM grid), k AS (SELECT value, cast((value > q[1])::int + (value > q[2])::int + (value > q[3])::int AS bigint) AS class FROM grid, r) SELECT class, {_AGG}", method="quantile", classes=4)
_breaks("stddev", f", r AS (SELECT avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM grid), k AS (SELECT value, cast(least(ceil((value - m) / s) - floor((lo - m) / s) - 1, ceil((hi - m) / s) - floor((lo - m) / s) - 1) AS bigint) AS class FROM grid, r) SELECT class, {_AGG}", method="stddev")
_breaks("log", f", r AS (SELECT floor(log10(min(value))) AS p FROM grid), k AS (SELECT value, cast(ceil(log10(value)) - p - 1 AS bigint) AS class FROM grid, r) SELECT class, {_AGG}", method="log")
_breaks("fixed", f", r AS (SELECT min(value) AS lo FROM grid), k AS (SELECT value, cast(greatest(ceil((value - lo) / 40000.0) - 1, 0) AS bigint) AS class FROM grid, r) SELECT class, {_AGG}", method="fixed", interval=40000.0)


_breaks("custom", f", k AS (SELECT value, cast((value > 50000)::int + (value > 90000.5)::int + (value > 200000)::int AS bigint) AS class FROM grid) SELECT class, {_AGG}", method="custom", ends=[50000.0, 90000.5, 200000.0, 1e9])
_breaks("symmetric", f", r AS (SELECT greatest(max(value) - 150000, 150000 - min(value)) AS d FROM grid), k AS (SELECT value, cast((value > 150000 - d + 2 * d * 1 / 4)::int + (value > 150000 - d + 2 * d * 2 / 4)::int + (value > 150000 - d + 2 * d * 3 / 4)::int AS bigint) AS class FROM grid, r) SELECT class, {_AGG}", method="equal", classes=4, symmetric=150000.0)
_breaks("pretty", f", r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 5 AS step, pow(10, floor(log10((max(value) - min(value)) / 5))) AS unit FROM grid), u AS (SELECT lo, min_by(unit * k, abs(unit * k - step)) AS size FROM r, (VALUES (1), (2), (5), (10)) t(k) GROUP BY lo), k AS (SELECT value, cast(ceil(value / size) - floor(lo / size) - 1 AS bigint) AS class FROM grid, u) SELECT class, {_AGG}", method="pretty")


@query("d10_breaks_jenks")
def d10j(spark, d):
    g = load(spark, d, "grid")
    ends = S.breaks(g, "value", "jenks", 4)
    return g.groupBy(S.classify(F.col("value"), ends).cast("bigint").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("d10_breaks_jenks_two", f"{ctes('grid')}, m AS (SELECT avg(value) AS c FROM grid), v AS (SELECT value, count(*) AS m, sum(value - c) AS s, sum(pow(value - c, 2)) AS q FROM grid, m GROUP BY value), c AS (SELECT value, sum(m) OVER w AS m, sum(s) OVER w AS s, sum(q) OVER w AS q FROM v WINDOW w AS (ORDER BY value)), t AS (SELECT max(m) AS m, arg_max(s, value) AS s, max(q) AS q FROM c), b AS (SELECT arg_min(value, c.q - c.s * c.s / c.m + (t.q - c.q) - pow(t.s - c.s, 2) / (t.m - c.m)) AS b FROM c, t WHERE c.m < t.m) SELECT cast(value > b AS integer) AS class, count(*) AS n, min(value) AS low, max(value) AS high FROM grid, b GROUP BY 1")
def d10j2(spark, d):
    """Two classes of a column of many distinct values; SQL tries every break."""
    g = load(spark, d, "grid")
    return g.groupBy(S.classify(F.col("value"), S.breaks(g, "value", "jenks", 2)).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("d10_breaks_jenks_exact", f"{ctes('dem')}, v AS (SELECT value, count(*) AS m, sum(value) AS s, sum(value * value) AS q FROM dem GROUP BY value), c AS (SELECT value, sum(m) OVER w AS m, sum(s) OVER w AS s, sum(q) OVER w AS q FROM v WINDOW w AS (ORDER BY value)), t AS (SELECT max(m) AS m, max(s) AS s, max(q) AS q FROM c), p AS (SELECT a.value AS a, b.value AS b, a.q - a.s * a.s / a.m + (b.q - a.q) - pow(b.s - a.s, 2) / (b.m - a.m) + (t.q - b.q) - pow(t.s - b.s, 2) / (t.m - b.m) AS cost FROM c a JOIN c b ON a.value < b.value JOIN t ON b.m < t.m), o AS (SELECT arg_min(a, cost) AS a, arg_min(b, cost) AS b FROM p) SELECT cast((value > a)::int + (value > b)::int AS bigint) AS class, count(*) AS n, min(value) AS low, max(value) AS high FROM dem, o GROUP BY 1")
def d10je(spark, d):
    """Three classes of few distinct values; SQL tries every pair of breaks."""
    g = load(spark, d, "dem")
    ends = S.breaks(g, "value", "jenks", 3)
    return g.groupBy(S.classify(F.col("value"), ends).cast("bigint").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("d11_string_summary", "WITH c AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1) SELECT cast(sum(n) AS bigint) AS n, count(v) AS n_distinct, cast(0 AS bigint) AS missing, min(v) AS min_value, max(v) AS max_value, min(length(v)) AS min_length, max(length(v)) AS max_length, round(sum(length(v) * n) / sum(n), 6) AS mean_length, (SELECT v FROM c ORDER BY n, v LIMIT 1) AS minority, (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS majority FROM c")
def d11(spark, d):
    return rounded(S.string_summary(spark.read.parquet(f"{d}/part.parquet"), "p_brand"), "mean_length")


@query("d12_datetime_summary", "SELECT count(*) AS n, count(DISTINCT ts) AS n_distinct, count(*) - count(ts) AS missing, min(ts) AS earliest, max(ts) AS latest, cast(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS bigint) AS range_seconds FROM events")
def d12(spark, d):
    return S.datetime_summary(spark.read.parquet(f"{d}/events.parquet"), "ts")


@query("d13_concatenate", "SELECT s_nationkey, string_agg(s_name, '; ' ORDER BY s_suppkey) FILTER (WHERE s_suppkey > 3) AS joined FROM supplier GROUP BY s_nationkey")
def d13(spark, d):
    joined = S.concatenate(spark.read.parquet(f"{d}/supplier.parquet"), ["s_nationkey"], "s_name", "s_suppkey", "; ", "s_suppkey > 3")
    return joined.select("s_nationkey", F.nullif("joined", F.lit("")).alias("joined"))


@query("d14_category_counts", "SELECT p_type AS category, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY p_type")
def d14(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"))


@query("d16_point_statistics", f"{ctes('pts')}, l AS (SELECT 'px' AS attribute, px AS v FROM pts UNION ALL SELECT 'py', py FROM pts UNION ALL SELECT 'z', z FROM pts) SELECT attribute, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev FROM l GROUP BY attribute")
def d16(spark, d):
    out = S.band_statistics(load(spark, d, "pts"), ["px", "py", "z"]).withColumnRenamed("band", "attribute")
    return rounded(out, "min", "max", "mean", "stddev")


@query("d17_jm_separability")
def d17(spark, d):
    s = load(spark, d, "spectra").select("label", F.slice("spectrum", 1, 8).alias("s"))
    return spark.createDataFrame(S.jm_separability(S.covariance(s, "s", 8, ["label"]), 8), "a int, b int, jm double")


_JM = f"{ctes('ms')}, t AS (SELECT label, b1, b2 FROM ms WHERE b1 IS NOT NULL AND b2 IS NOT NULL), c AS (SELECT label, avg(b1) AS m, avg(b2) AS n, var_samp(b1) AS a, var_samp(b2) AS d, covar_samp(b1, b2) AS b FROM t GROUP BY label), p AS (SELECT x.label AS k, y.label AS l, x.m - y.m AS u, x.n - y.n AS v, (x.a + y.a) / 2 AS a, (x.b + y.b) / 2 AS b, (x.d + y.d) / 2 AS d, x.a * x.d - x.b * x.b AS dx, y.a * y.d - y.b * y.b AS dy FROM c x JOIN c y ON x.label < y.label)"


@query("d17_jm_two_bands", _JM + " SELECT k AS a, l AS b, round(2 * (1 - exp(-((d * u * u - 2 * b * u * v + a * v * v) / (a * d - b * b) / 8 + ln((a * d - b * b) / sqrt(dx * dy)) / 2))), 6) AS jm FROM p")
def d17t(spark, d):
    """Two bands, where SQL can write the matrices out."""
    s = load(spark, d, "ms").filter("b1 IS NOT NULL AND b2 IS NOT NULL").select("label", F.array("b1", "b2").alias("s"))
    rows = S.jm_separability(S.covariance(s, "s", 2, ["label"]), 2)
    return rounded(spark.createDataFrame(rows, "a int, b int, jm double"), "jm")


@query("d17_class_means", f"{ctes('spectra')} SELECT label, count(*) AS n, round(avg(spectrum[1]), 6) AS m0, round(var_pop(spectrum[1]), 6) AS v0, round(covar_pop(spectrum[1], spectrum[2]), 6) AS c01 FROM spectra GROUP BY label")
def d17m(spark, d):
    s = load(spark, d, "spectra").select("label", F.slice("spectrum", 1, 2).alias("s"))
    return S.covariance(s, "s", 2, ["label"]).select("label", "n", clean(F.col("mean")[0]).alias("m0"), clean(F.col("cov")[0]).alias("v0"), clean(F.col("cov")[1]).alias("c01"))


@query("d18_time_aggregates", "SELECT user_id AS face, round(sum(value), 4) AS total, max(value) AS highest, min(value) AS lowest, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def d18(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.groupBy(F.col("user_id").alias("face")).agg(nearest(F.sum("value"), 4).alias("total"), F.max("value").alias("highest"), F.min("value").alias("lowest"), nearest(F.avg("value"), 6).alias("mean"))


# normal equations of centred points, two unknowns a side
_AFFINE = f"{ctes('pts')}, g AS (SELECT px, py, 5 + 2 * px - py + z / 1000 AS mx, 7 + 0.5 * px + 3 * py - z / 2000 + id % 7 AS my FROM pts), k AS (SELECT avg(px) AS cx, avg(py) AS cy, avg(mx) AS tx, avg(my) AS ty, var_pop(px) AS a, covar_pop(px, py) AS b, var_pop(py) AS d, covar_pop(px, mx) AS xu, covar_pop(py, mx) AS xv, covar_pop(px, my) AS yu, covar_pop(py, my) AS yv FROM g), s AS (SELECT *, (d * xu - b * xv) / (a * d - b * b) AS a1, (a * xv - b * xu) / (a * d - b * b) AS a2, (d * yu - b * yv) / (a * d - b * b) AS b1, (a * yv - b * yu) / (a * d - b * b) AS b2 FROM k), o AS (SELECT tx - a1 * cx - a2 * cy AS a0, a1, a2, ty - b1 * cx - b2 * cy AS b0, b1, b2 FROM s)"


@query("d19_affine_fit", _AFFINE + " SELECT round(a0, 4) AS a0, round(a1, 4) AS a1, round(a2, 4) AS a2, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round(sqrt(avg(pow(mx - a0 - a1 * px - a2 * py, 2) + pow(my - b0 - b1 * px - b2 * py, 2))), 4) AS rmse FROM g, o GROUP BY ALL")
def d19(spark, d):
    """Points with residues that no affine map explains."""
    g = load(spark, d, "pts").select("px", "py", (5 + 2 * F.col("px") - F.col("py") + F.col("z") / 1000).alias("mx"), (7 + 0.5 * F.col("px") + 3 * F.col("py") - F.col("z") / 2000 + F.col("id") % 7).alias("my"))
    return rounded(S.affine_fit(g, "px", "py", "mx", "my"), "a0", "a1", "a2", "b0", "b1", "b2", "rmse", digits=4)


@query("d21_sql_layer", "SELECT n_regionkey, p_type, count(*) AS n FROM part JOIN nation ON p_size % 25 = n_nationkey GROUP BY CUBE (n_regionkey, p_type)")
def d21(spark, d):
    for t in ("part", "nation"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql("SELECT n_regionkey, p_type, count(*) AS n FROM part JOIN nation ON p_size % 25 = n_nationkey GROUP BY CUBE (n_regionkey, p_type)")


#: Control points: a known map of the points, and what is left over.
_GCP = f"{ctes('pts')}, g AS (SELECT id, px, py, 3 * px - 7 + (id % 7 - 3) * 0.01 AS lx, -2 * py + 40 + (id % 5 - 2) * 0.02 AS ly, 1.6 * px - 1.2 * py + 5 + (id % 7 - 3) * 0.01 AS hx, 1.2 * px + 1.6 * py - 9 + (id % 5 - 2) * 0.02 AS hy FROM pts)"


def _control_points(spark, d):
    x, y, k = F.col("px"), F.col("py"), F.col("id")
    a, b = (k % 7 - 3) * 0.01, (k % 5 - 2) * 0.02
    return load(spark, d, "pts").withColumns({"lx": 3 * x - 7 + a, "ly": -2 * y + 40 + b, "hx": 1.6 * x - 1.2 * y + 5 + a, "hy": 1.2 * x + 1.6 * y - 9 + b})


@query("d19_linear_fit", _GCP + ", f AS (SELECT regr_intercept(lx, px) AS x0, regr_intercept(ly, py) AS y0, regr_slope(lx, px) AS sx, regr_slope(ly, py) AS sy FROM g) SELECT round(any_value(x0), 6) AS x0, round(any_value(y0), 6) AS y0, round(any_value(sx), 6) AS sx, round(any_value(sy), 6) AS sy, round(sqrt(avg(pow(lx - x0 - sx * px, 2) + pow(ly - y0 - sy * py, 2))), 6) AS rmse FROM g, f")
def d19l(spark, d):
    return rounded(S.linear_fit(_control_points(spark, d), "px", "py", "lx", "ly"), "x0", "y0", "sx", "sy", "rmse")


_CENTRED = "m AS (SELECT avg(px) AS cx, avg(py) AS cy, avg(hx) AS dx, avg(hy) AS dy FROM g), c AS (SELECT px, py, hx, hy, px - cx AS u, py - cy AS v, hx - dx AS p, hy - dy AS q FROM g, m), k AS (SELECT sum(u * p + v * q) / sum(u * u + v * v) AS a, sum(u * q - v * p) / sum(u * u + v * v) AS b FROM c), o AS (SELECT a, b, dx - a * cx + b * cy AS x0, dy - b * cx - a * cy AS y0 FROM k, m)"


@query("d19_helmert_fit", _GCP + f", {_CENTRED} SELECT round(any_value(x0), 6) AS x0, round(any_value(y0), 6) AS y0, round(any_value(sqrt(a * a + b * b)), 6) AS scale, round(any_value(atan2(b, a)), 6) AS rotation, round(sqrt(avg(pow(hx - (a * px - b * py + x0), 2) + pow(hy - (b * px + a * py + y0), 2))), 6) AS rmse FROM c, o")
def d19h(spark, d):
    return rounded(S.helmert_fit(_control_points(spark, d), "px", "py", "hx", "hy"), "x0", "y0", "scale", "rotation", "rmse")


@query("d19_projective_fit", f"{ctes('pts')} SELECT id, round((1.5 * px + 0.2 * py + 40) / (0.002 * px + 0.001 * py + 1), 5) AS mx, round((0.1 * px + 1.2 * py - 30) / (0.002 * px + 0.001 * py + 1), 5) AS my FROM pts")
def d19p(spark, d):
    """The fit finds the homography that made the control points (those with ids divisible by 3), and maps all points with it."""
    p = load(spark, d, "pts")
    x, y = S.projected(F.col("px"), F.col("py"), [1.5, 0.2, 40.0, 0.1, 1.2, -30.0, 0.002, 0.001, 1.0])
    h = S.projective_fit(p.filter("id % 3 = 0").withColumns({"mx": x, "my": y}), "px", "py", "mx", "my")
    x, y = S.projected(F.col("px"), F.col("py"), h)
    return p.select("id", clean(x, 5).alias("mx"), clean(y, 5).alias("my"))

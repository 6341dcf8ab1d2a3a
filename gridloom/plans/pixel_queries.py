"""Queries of the pixel-wise operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projections as J
from ..functions.expressions import band_math, clean, nearest, ratio, referenced_bands
from ..operators import pixel as P
from .fixtures import ctes, load
from .registry import query

NDVI = "CASE WHEN b2 + b1 = 0 THEN NULL ELSE (b2 - b1) / (b2 + b1) END"


@query("ndvi_zonal_stats", f"{ctes('ms')} SELECT label, count(*) AS total_pixels, count(nd) AS area_pixels, round(avg(nd), 6) AS mean_nd, round(stddev_pop(nd), 6) AS stddev_nd FROM (SELECT label, {NDVI} AS nd FROM ms) GROUP BY label")
def ndvi_zonal_stats(spark, d):
    nd = load(spark, d, "ms").select("label", P.spectral_index("ndvi", n="b2", r="b1").alias("nd"))
    return nd.groupBy("label").agg(F.count(F.lit(1)).alias("total_pixels"), F.count("nd").alias("area_pixels"), nearest(F.avg("nd"), 6).alias("mean_nd"), nearest(F.stddev_pop("nd"), 6).alias("stddev_nd")).orderBy("label")


@query("b01_band_math", f"{ctes('ms')} SELECT y, x, round(CASE WHEN b1 IS NULL OR b2 IS NULL OR b3 IS NULL THEN NULL WHEN b2 / b1 > 1 AND b3 < 6 THEN sqrt(b2) + pow(b1, 2) / 100 ELSE least(b1, b2) - b3 END, 6) AS value FROM ms")
def b01(spark, d):
    ms = load(spark, d, "ms")
    e = "(b2 / b1 > 1 && b3 < 6) ? (sqrt(b2) + pow(b1, 2) / 100) : (min(b1, b2) - b3)"
    return ms.select("y", "x", *referenced_bands(e)).select("y", "x", clean(band_math(e)).alias("value"))


@query("b03_raster_calculator", f"{ctes('ms_before', 'ms_after')} SELECT y, x, round((a.b1 - b.b1) / CASE WHEN b.b2 = 0 THEN NULL ELSE b.b2 END, 6) AS value FROM ms_before b JOIN ms_after a USING (y, x)")
def b03(spark, d):
    before, after = load(spark, d, "ms_before").select("y", "x", "b1", "b2"), load(spark, d, "ms_after").select("y", "x", F.col("b1").alias("b3"))
    return before.join(after, ["y", "x"]).select("y", "x", clean(band_math("(b3 - b1) / b2")).alias("value"))


@query("b04_spectral_indices", f"{ctes('ms')} SELECT y, x, round({NDVI}, 6) AS ndvi, round((b3 - b2) / nullif(b3 + b2, 0), 6) AS ndwi, round((b4 - b2) / nullif(b4 + b2, 0), 6) AS ndbi, round((b3 - b4) / nullif(b3 + b4, 0), 6) AS mndwi, round(2.5 * (b2 - b1) / nullif(b2 + 6.0 * b1 - 7.5 * b3 + 1.0, 0), 6) AS evi, round(1.5 * (b2 - b1) / nullif(b2 + b1 + 0.5, 0), 6) AS savi FROM ms")
def b04(spark, d):
    ix = P.spectral_index
    return load(spark, d, "ms").select("y", "x", clean(ix("ndvi", n="b2", r="b1")).alias("ndvi"), clean(ix("ndwi", g="b3", n="b2")).alias("ndwi"), clean(ix("ndbi", s="b4", n="b2")).alias("ndbi"), clean(ix("mndwi", g="b3", s="b4")).alias("mndwi"), clean(ix("evi", n="b2", r="b1", b="b3")).alias("evi"), clean(ix("savi", n="b2", r="b1")).alias("savi"))


@query("b05_band_roles", f"{ctes('ms')} SELECT y, x, b1 AS red, b2 AS nir FROM ms")
def b05(spark, d):
    return P.by_role(load(spark, d, "ms"), {"red": "b1", "nir": "b2"}).select("y", "x", "red", "nir")


@query("b06_qa_mask", f"{ctes('qa')} SELECT y, x, CASE WHEN qa & 20 <> 0 THEN 1 ELSE 0 END AS mask, CASE WHEN qa % 16 IN (8, 4) THEN 1 ELSE 0 END AS class_mask FROM qa")
def b06(spark, d):
    return load(spark, d, "qa").select("y", "x", P.qa_bits(F.col("qa"), [2, 4]).alias("mask"), P.qa_classes(F.col("qa") % 16, [8, 4, 16]).alias("class_mask"))


@query("b07_apply_mask", f"{ctes('ms', 'qa')}, m AS (SELECT ms.*, coalesce(CASE WHEN qa & 20 <> 0 THEN 1 ELSE 0 END, 0) AS mask FROM ms LEFT JOIN qa USING (y, x)) SELECT cast(sum(mask) AS bigint) AS masked_pixels, count(*) AS total_pixels, round(100.0 * sum(mask) / count(*), 6) AS masked_percent, round(sum(CASE WHEN mask > 0 THEN NULL ELSE b1 END), 6) AS sum_b1 FROM m")
def b07(spark, d):
    mask = load(spark, d, "qa").select("y", "x", P.qa_bits(F.col("qa"), [2, 4]).alias("mask"))
    out = P.apply_mask(load(spark, d, "ms"), mask, ["b1", "b2", "b3", "b4"])
    return out.agg(F.sum("masked").cast("bigint").alias("masked_pixels"), F.count(F.lit(1)).alias("total_pixels"), nearest(F.lit(100.0) * F.sum("masked") / F.count(F.lit(1)), 6).alias("masked_percent"), nearest(F.sum("b1"), 6).alias("sum_b1"))


@query("b08_recode", f"{ctes('grid')} SELECT y, x, CASE label WHEN 1 THEN 10 WHEN 3 THEN 30 ELSE label END AS label FROM grid")
def b08(spark, d):
    return load(spark, d, "grid").select("y", "x", P.recode(F.col("label"), {1: 10, 3: 30}).alias("label"))


@query("b09_b10_calibration", f"{ctes('ms')} SELECT y, x, round(b2 * 0.05 + 1.5, 6) AS radiance, round((b2 * 0.00002 - 0.1) / sin(radians(40.0)), 6) AS toa, round((b2 - 1000) / 10000.0, 6) AS scaled, round(1321.08 / ln(774.89 / CASE WHEN b2 * 0.05 + 1.5 > 0 THEN b2 * 0.05 + 1.5 END + 1), 6) AS kelvin FROM ms")
def b09(spark, d):
    b2 = F.col("b2")
    rad = P.radiance(b2, 0.05, 1.5)
    return load(spark, d, "ms").select("y", "x", clean(rad).alias("radiance"), clean(P.toa_reflectance(b2, 0.00002, -0.1, 40.0)).alias("toa"), clean(P.scaled_reflectance(b2, 10000.0, -1000)).alias("scaled"), clean(P.brightness_temperature(rad, 774.89, 1321.08)).alias("kelvin"))


@query("b11_stretch", f"{ctes('grid')}, r AS (SELECT min(value) AS lo, max(value) AS hi FROM grid) SELECT y, x, round(least(greatest((value - 50000.0) / 250000.0, 0.0), 1.0) * 255, 6) AS linear, round(CASE WHEN value <= 1000 THEN 0 WHEN value <= 100000 THEN (value - 1000) * (200.0 / 99000.0) WHEN value <= 400000 THEN 200 + (value - 100000) * (55.0 / 300000.0) ELSE 255 END, 6) AS piecewise, round((value - lo) / nullif(hi - lo, 0) * 255.0, 6) AS rescaled FROM grid, r")
def b11(spark, d):
    g = load(spark, d, "grid").withColumn("rescaled", F.col("value"))
    v = F.col("value")
    return P.rescale(g, "rescaled").select("y", "x", clean(P.linear_stretch(v, 50000.0, 300000.0)).alias("linear"), clean(P.piecewise_stretch(v, [(1000.0, 0.0), (100000.0, 200.0), (400000.0, 255.0)])).alias("piecewise"), clean(F.col("rescaled")).alias("rescaled"))


@query("b12_band_ratio", f"{ctes('ms')} SELECT y, x, round(b2 / nullif(b3, 0), 6) AS ratio FROM ms")
def b12(spark, d):
    return load(spark, d, "ms").select("y", "x", clean(ratio(F.col("b2"), F.col("b3"))).alias("ratio"))


@query("b13_ihs_round_trip", f"{ctes('ms')} SELECT y, x, round((b1 + b2 + b3) / 3.0, 8) AS intensity, round(b1, 9) AS r, round(b2, 9) AS g, round(b3, 9) AS b FROM ms")
def b13(spark, d):
    i, h, s = P.rgb_to_ihs(F.col("b1"), F.col("b2"), F.col("b3"))
    out = load(spark, d, "ms").select("y", "x", i.alias("i"), h.alias("h"), s.alias("s"))
    r, g, b = P.ihs_to_rgb(F.col("i"), F.col("h"), F.col("s"))
    return out.select("y", "x", clean(F.col("i"), 8).alias("intensity"), clean(r, 9).alias("r"), clean(g, 9).alias("g"), clean(b, 9).alias("b"))


@query("b14_palette", f"{ctes('ms')}, p(e, r, g, b) AS (VALUES (1, 10, 10, 3), (2, 30, 30, 5), (3, 40, 80, 8)) SELECT y, x, min_by(e, (b1 - r) * (b1 - r) + (b2 - g) * (b2 - g) + (b3 - b) * (b3 - b)) AS entry FROM ms, p WHERE b1 IS NOT NULL GROUP BY y, x")
def b14(spark, d):
    ms = load(spark, d, "ms").filter("b1 IS NOT NULL")
    return P.nearest_palette(ms, ["b1", "b2", "b3"], [(1, 10, 10, 3), (2, 30, 30, 5), (3, 40, 80, 8)]).select("y", "x", "entry")


@query("b15_extract_by_attribute", "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size >= 20 - 1e-9 AND contains(p_brand, '3')")
def b15(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_brand")
    return P.extract_by_attribute(P.extract_by_attribute(part, "p_size", ">=", "20"), "p_brand", "contains", "3")


@query("b16_attribute_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderpriority LIKE '1%'")
def b16(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").filter("o_totalprice > 200000 AND o_orderpriority LIKE '1%'").select("o_orderkey", "o_totalprice")


@query("b17_field_calculator", "SELECT p_partkey, cast(p_size * 2 AS bigint) AS twice, round(cast(p_retailprice / 3 AS double), 6) AS third, p_brand || '-' || cast(p_size AS varchar) AS tag FROM part")
def b17(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    part = P.calculate_field(part, "twice", "Integer", "p_size * 2")
    part = P.calculate_field(part, "third", "Float", "round(p_retailprice / 3, 6)")
    return P.calculate_field(part, "tag", "String", "concat(p_brand, '-', p_size)").select("p_partkey", "twice", "third", "tag")


@query("b18_clip", f"{ctes('grid')} SELECT y - 2 AS y, x - 10 AS x, value FROM grid WHERE x >= 10 AND x < 40 AND y >= 2 AND y < 9")
def b18(spark, d):
    return P.clip(load(spark, d, "grid"), 10, 2, 40, 9).select("y", "x", "value")


@query("b19_ignore", f"{ctes('ms')} SELECT y, x FROM ms WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND abs(b1 - 25) > 0.5 AND abs(b2 - 25) > 0.5")
def b19(spark, d):
    return P.ignore(load(spark, d, "ms"), ["b1", "b2"], 25.0, 0.5).select("y", "x")


@query("b20_nuller", f"{ctes('grid')} SELECT y, x, CASE WHEN value BETWEEN 0 AND 50000 OR value BETWEEN 200000 AND 250000 THEN NULL ELSE value END AS value FROM grid")
def b20(spark, d):
    return load(spark, d, "grid").select("y", "x", P.nullify(F.col("value"), [(0.0, 50000.0), (200000.0, 250000.0)]).alias("value"))


@query("b21_temporal_filter", "SELECT event_id FROM events WHERE ts < timestamp '2024-01-20 00:00:00' AND ts >= timestamp '2024-01-10 00:00:00'")
def b21(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return P.overlapping_time(ev, "ts", "ts", "2024-01-10 00:00:00", "2024-01-20 00:00:00").select("event_id")


@query("b22_constraints", "SELECT 'not_null:p_name' AS constraint_name, cast(count(*) - count(p_name) AS bigint) AS violations FROM part UNION ALL SELECT 'unique:p_brand', cast(count(p_brand) - count(DISTINCT p_brand) AS bigint) FROM part UNION ALL SELECT 'check:size', cast(count(*) FILTER (WHERE NOT coalesce(p_size < 40, false)) AS bigint) FROM part")
def b22(spark, d):
    return P.constraint_report(spark.read.parquet(f"{d}/part.parquet"), ["p_name"], ["p_brand"], {"size": "p_size < 40"})


@query("b23_point_filter", f"{ctes('pts')} SELECT id FROM pts WHERE z BETWEEN 0 AND 5000 AND px > 20 AND NOT (py IN (1, 2))")
def b23(spark, d):
    return load(spark, d, "pts").filter("z BETWEEN 0 AND 5000 AND px > 20 AND NOT (py IN (1, 2))").select("id")


@query("b24_projections", f"{ctes('pts')}, g AS (SELECT id, px / 100 * 6 + 6 AS lon, py / 2 AS lat FROM pts) SELECT id, round(radians(lon) * 6378137.0, 4) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 4) AS my, round(lon, 6) AS lon, round(lat, 6) AS lat, round(radians(lon) * cos(radians(lat)) * 6371007.181, 4) AS sx, round(radians(lat) * 6371007.181, 4) AS sy FROM g")
def b24(spark, d):
    g = load(spark, d, "pts").select("id", (F.col("px") / 100 * 6 + 6).alias("lon"), (F.col("py") / 2).alias("lat"))
    mx, my = J.to_web_mercator(F.col("lon"), F.col("lat"))
    g = g.withColumns({"mx": mx, "my": my})
    lon, lat = J.from_web_mercator(F.col("mx"), F.col("my"))
    sx, sy = J.to_sinusoidal(F.col("lon"), F.col("lat"))
    return g.select("id", clean(F.col("mx"), 4).alias("mx"), clean(F.col("my"), 4).alias("my"), clean(lon).alias("lon"), clean(lat).alias("lat"), clean(sx, 4).alias("sx"), clean(sy, 4).alias("sy"))


@query("b25_modis_georeference", "SELECT c_custkey, round((c_custkey % 36 - 18) * (6371007.181 * pi() / 18), 3) AS ox, round((9 - c_custkey % 18) * (6371007.181 * pi() / 18), 3) AS oy FROM customer")
def b25(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    ox, oy = P.modis_origin(F.col("name"))
    return c.select("c_custkey", F.format_string("MOD09.h%02dv%02d.hdf", F.col("c_custkey") % 36, F.col("c_custkey") % 18).alias("name")).select("c_custkey", clean(ox, 3).alias("ox"), clean(oy, 3).alias("oy"))

"""Queries of sources, classification, provenance and operator chains, with their SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.expressions import clean, nearest
from ..operators import chain as K
from ..operators import focal, kernels, ml, pixel, provenance, stats
from ..operators.components import _written as written
from ..operators.components import shared_path
from ..sources import blocks
from ..sources import rasters as R
from .fixtures import ctes, load
from .registry import query
from .spectral_queries import spectra
from .stats_queries import rounded

MS = ["b1", "b2", "b3", "b4"]


@query("a01_round_trip", f"{ctes('ms')} SELECT y, x, b1 FROM ms")
def a01(spark, d):
    path = shared_path(spark, "pixels")
    R.write_pixels(load(spark, d, "ms").select("y", "x", "b1"), path)
    return R.read_pixels(spark, path).select("y", "x", "b1")


@query("a01_raster_blocks", f"{ctes('ms')} SELECT y, x, round(b3, 6) AS b3, round(b1, 6) AS b1 FROM ms WHERE x BETWEEN 10 AND 69 AND y >= 2")
def a01b(spark, d):
    """Two of four bands of a window, from block files."""
    path = shared_path(spark, "blocks")
    blocks.write_blocks(load(spark, d, "ms"), path, MS, 64)
    return rounded(blocks.read_blocks(spark, path, ["b3", "b1"], (10, 2, 60, 1 << 40)), "b3", "b1")


@query("a02_features", "SELECT s_suppkey AS id, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier")
def a02(spark, d):
    """Features written as GeoJSON collections and read back."""
    path = shared_path(spark, "features")
    s = spark.read.parquet(f"{d}/supplier.parquet")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey") % 360 - 180.0, F.lit(0.0)).alias("coordinates"))
    R.convert_features(s.select(point.alias("geometry"), F.struct("s_suppkey", "s_name", "s_acctbal").alias("properties")), path, "geojson")
    p = F.col("properties")
    return R.read_features(spark, path, "geojson").select(p["s_suppkey"].alias("id"), p["s_name"].alias("name"), F.round(p["s_acctbal"], 2).alias("balance"))


@query("a03_key_values", "SELECT s_suppkey AS id, s_name AS scene, round(s_acctbal, 2) AS sun FROM supplier")
def a03(spark, d):
    """Metadata text, a document a supplier and up to 20,000 in a file, parsed into one row a document."""
    path = shared_path(spark, "metadata")
    s = spark.read.parquet(f"{d}/supplier.parquet")
    text = F.format_string('GROUP = META\n  ID = %d\n  SCENE_ID = "%s"\n  SUN_ELEVATION = %.2f\nEND', "s_suppkey", "s_name", "s_acctbal")
    s.select(text.alias("value")).write.option("maxRecordsPerFile", 20_000).text(path)
    got = R.key_values(spark, path, ["ID", "SCENE_ID", "SUN_ELEVATION"])
    return got.select(F.col("ID").cast("bigint").alias("id"), F.col("SCENE_ID").alias("scene"), F.round(F.col("SUN_ELEVATION").cast("double"), 2).alias("sun"))


@query("a04_xml", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def a04(spark, d):
    """XML product files of up to 1,000 scenes, parsed into one row a scene."""
    path = shared_path(spark, "xml")
    s = spark.read.parquet(f"{d}/supplier.parquet")
    scene = F.concat(F.lit("<scene><id>"), F.col("s_suppkey").cast("string"), F.lit("</id><name>"), F.col("s_name"), F.lit("</name></scene>"))
    products = s.groupBy(F.floor(F.col("s_suppkey") / 1000).alias("k")).agg(F.concat(F.lit("<product>"), F.concat_ws("", F.collect_list(scene)), F.lit("</product>")).alias("value"))
    products.write.partitionBy("k").text(path)
    return R.xml_rows(spark, path + "/*", "scene", "id bigint, name string")


@query("a14_convert", "SELECT p_partkey AS id, p_brand AS brand FROM part")
def a14(spark, d):
    """The same features as csv, parquet and GeoJSON: rows that all three hold."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    found = None
    for fmt in ("csv", "parquet", "geojson"):
        path = shared_path(spark, fmt)
        R.convert_features(p.select(F.lit(None).cast("string").alias("geometry"), F.struct("id", "brand").alias("properties")) if fmt == "geojson" else p, path, fmt)
        rows = R.read_features(spark, path, fmt)
        rows = rows.select("properties.*") if fmt == "geojson" else rows
        rows = rows.select(F.col("id").cast("bigint").alias("id"), "brand")
        found = rows if found is None else found.join(rows, ["id", "brand"])
    return found


@query("a05_discover_others", "SELECT 'sentinel2' AS sensor, 'T' || lpad(cast(10 + c_custkey % 50 AS varchar), 2, '0') || 'ABC_' || lpad(cast(20240000 + c_custkey AS varchar), 8, '0') || 'T101010' AS product, 'B08' AS band, 'nir' AS role FROM customer UNION ALL SELECT 'modis', 'MOD09GA.A' || lpad(cast(2024000 + c_custkey % 366 AS varchar), 7, '0') || '.h12v' || lpad(cast(c_custkey % 18 AS varchar), 2, '0'), 'b02', 'nir' FROM customer")
def a05o(spark, d):
    c, k = spark.read.parquet(f"{d}/customer.parquet"), F.col("c_custkey")
    files = c.select(F.explode(F.array(F.format_string("T%02dABC_%08dT101010_B08.jp2", 10 + k % 50, 20240000 + k), F.format_string("MOD09GA.A%07d.h%02dv%02d.061_b02.tif", 2024000 + k % 366, F.lit(12), k % 18))).alias("name"))
    return R.discover(files).select("sensor", "product", "band", "role")


@query("a05_discover", "SELECT 'LC08_' || lpad(cast(c_custkey AS varchar), 6, '0') AS product, 'B4' AS band, 'red' AS role, 654.5 AS wavelength FROM customer")
def a05(spark, d):
    files = spark.read.parquet(f"{d}/customer.parquet").select(F.explode(F.array(F.format_string("LC08_%06d_B4.TIF", "c_custkey"), F.format_string("notes_%06d.txt", "c_custkey"))).alias("name"))
    return R.discover(files).select("product", "band", "role", "wavelength")


@query("a06_stack", f"{ctes('ms')} SELECT y, x, b1, b2 FROM ms")
def a06(spark, d):
    return R.stack(R.unstack(load(spark, d, "ms").select("y", "x", "b1", "b2"), ["b1", "b2"]), ["b1", "b2"])


@query("a07_xyz", f"{ctes('grid')} SELECT 100 + (x + 0.5) * 30.0 AS cx, 900 - (y + 0.5) * 30.0 AS cy, value FROM grid WHERE y % 2 = 0 AND x % 2 = 0")
def a07(spark, d):
    return R.to_xyz(load(spark, d, "grid"), 100.0, 900.0, 30.0, -30.0, 2)


_XYZ = f"{ctes('ms')} SELECT 100 + (x + 0.5) * 30.0 AS cx, 900 - (y + 0.5) * 30.0 AS cy, coalesce(round(nullif(floor(b1), 25), 6), -9999.0) AS b1, coalesce(round(b3, 6), -9999.0) AS b3 FROM ms WHERE x BETWEEN 5 AND 84 AND y >= 3 AND (x - 5) % 3 = 0 AND (y - 3) % 3 = 0 AND NOT (nullif(floor(b1), 25) IS NULL AND b3 IS NULL)"


@query("a07_xyz_window", _XYZ)
def a07w(spark, d):
    """Two bands of a window without its empty pixels; 25 stands for no value."""
    ms = load(spark, d, "ms").withColumn("b1", F.floor("b1").cast("double"))
    return rounded(R.to_xyz(ms, 100.0, 900.0, 30.0, -30.0, 3, ["b1", "b3"], (5, 3, 80, 1 << 40), 25.0, -9999.0, True), "b1", "b3")


@query("a08_footprints", f"{ctes('grid')} SELECT label, format('POLYGON(({{}} {{}}, {{}} {{}}, {{}} {{}}, {{}} {{}}, {{}} {{}}))', min(x), min(y), max(x) + 1, min(y), max(x) + 1, max(y) + 1, min(x), max(y) + 1, min(x), min(y)) AS wkt FROM grid GROUP BY label")
def a08(spark, d):
    return R.footprint(load(spark, d, "grid"), "label")


@query("a09_tiles", f"{ctes('grid')} SELECT cast(floor(y / 16) AS bigint) AS tile_y, cast(floor(x / 16) AS bigint) AS tile_x, count(*) AS n FROM grid GROUP BY ALL")
def a09(spark, d):
    return R.tiled(load(spark, d, "grid"), 16).groupBy("tile_y", "tile_x").agg(F.count(F.lit(1)).alias("n"))


@query("a10_info", f"{ctes('ms')} SELECT max(y) + 1 AS height, max(x) + 1 AS width, 2 AS bands, count(b1) AS valid_b1, count(b2) AS valid_b2 FROM ms")
def a10(spark, d):
    return R.info(load(spark, d, "ms"), ["b1", "b2"])


@query("a11_virtual_raster", f"{ctes('ms_before', 'ms_after')} SELECT coalesce(b.y, a.y) AS y, coalesce(b.x, a.x) AS x, coalesce(b.b1, -1.0) AS before, coalesce(a.b1, -1.0) AS after FROM ms_before b FULL JOIN ms_after a ON a.y = b.y AND a.x = b.x")
def a11(spark, d):
    one = lambda t: load(spark, d, t).select("y", "x", F.col("b1").alias("value"))
    return R.virtual({"before": one("ms_before"), "after": one("ms_after")}, "union", -1.0)


@query("a12_overviews", f"{ctes('grid')} SELECT cast(floor(y / 4) AS bigint) AS y, cast(floor(x / 4) AS bigint) AS x, round(avg(value), 6) AS mean, arg_min(value, y * 1000 + x) AS nearest FROM grid GROUP BY ALL")
def a12(spark, d):
    g = load(spark, d, "grid")
    return R.overview(g, 4).select("y", "x", nearest("value", 6).alias("mean")).join(R.overview(g, 4, "nearest").withColumnRenamed("value", "nearest"), ["y", "x"])


@query("a12_overview_gaussian", f"{ctes('grid')}, w AS (SELECT cast(floor(y / 4) AS bigint) AS y, cast(floor(x / 4) AS bigint) AS x, value, exp(-(pow(y % 4 - 1.5, 2) + pow(x % 4 - 1.5, 2)) / 8.0) AS w FROM grid) SELECT y, x, round(sum(w * value) / sum(w), 6) AS value FROM w GROUP BY y, x")
def a12g(spark, d):
    return R.overview(load(spark, d, "grid"), 4, "gaussian").select("y", "x", nearest("value", 6).alias("value"))


@query("a13_convert_type", f"{ctes('grid')} SELECT y, x, cast(round(least(greatest(value / 1000, 0.0), 255.0)) AS integer) AS value FROM grid")
def a13(spark, d):
    return load(spark, d, "grid").select("y", "x", pixel.convert_type(F.col("value") / 1000, 0.0, 255.0, "int").alias("value"))


@query("a15_stac", "SELECT 'i' || cast(s_suppkey AS varchar) AS id, 'b' || cast(s_suppkey AS varchar) || '.tif' AS href FROM supplier WHERE s_suppkey % 360 - 180 <= -100 AND s_suppkey % 360 - 179 >= -175 AND s_suppkey % 2 = 0")
def a15(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    json = F.to_json(F.struct(F.concat(F.lit("i"), F.col("s_suppkey")).alias("id"), F.array((F.col("s_suppkey") % 360 - 180).cast("double"), F.lit(0.0), (F.col("s_suppkey") % 360 - 179).cast("double"), F.lit(1.0)).alias("bbox"), F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("collection"), F.create_map(F.lit("datetime"), F.lit("2024-01-05T00:00:00Z")).alias("properties"), F.create_map(F.lit("a"), F.struct(F.lit("a.json").alias("href"), F.lit("text").alias("type")), F.lit("b"), F.struct(F.concat(F.lit("b"), F.col("s_suppkey"), F.lit(".tif")).alias("href"), F.lit("x").alias("type"))).alias("assets")))
    items = R.stac_items(s.select(json.alias("json")))
    return R.stac_search(items, [-175.0, -5.0, -100.0, 5.0], "2024-01-01 00:00:00", "2024-01-31 00:00:00", "even").select("id", "href")


@query("a16_remap_fields", "SELECT cast(p_partkey AS varchar) AS code, cast(p_size * 1.5 AS double) AS size FROM part")
def a16(spark, d):
    return R.remap_fields(spark.read.parquet(f"{d}/part.parquet"), {"code": ("p_partkey", "string"), "size": ("p_size * 1.5D", "double")})


_GRIDS = "WITH k AS (SELECT p_partkey AS id, p_partkey % 12 AS k FROM part WHERE p_partkey > 0), g AS (SELECT id, CASE WHEN k = 1 THEN NULL WHEN k IN (2, 10) THEN 'EPSG:4326' ELSE 'EPSG:32648' END AS crs, CASE WHEN k IN (5, 10) THEN 60.0 ELSE 30.0 END AS pw, CASE WHEN k IN (3, 11) THEN 30.0 ELSE -30.0 END AS ph, CASE WHEN k IN (4, 11) THEN 0.001 ELSE 0.0 END AS rx, CASE k WHEN 6 THEN 12.0 WHEN 7 THEN 90.0 ELSE 0.0 END AS ox, CASE k WHEN 8 THEN 10 ELSE 20 END AS width, CASE k WHEN 9 THEN 0.0 ELSE -9999.0 END AS nodata FROM k), r AS (SELECT 'EPSG:32648' AS crs, 30.0 AS pw, -30.0 AS ph, 0.0 AS ox, 20 AS width, -9999.0 AS nodata)"


@query("c10_grid_report", _GRIDS + " SELECT 0 AS a, g.id AS b, CASE WHEN (g.crs IS NULL) <> (r.crs IS NULL) THEN 'missing_crs' WHEN g.crs <> r.crs THEN 'crs' WHEN sign(g.pw) <> sign(r.pw) OR sign(g.ph) <> sign(r.ph) THEN 'axis' WHEN abs(g.rx) > 1e-12 THEN 'rotation' WHEN abs(g.pw - r.pw) > 1e-9 OR abs(g.ph - r.ph) > 1e-9 THEN 'pixel_size' WHEN abs((g.ox - r.ox) / r.pw - round((g.ox - r.ox) / r.pw)) > 1e-6 THEN 'origin' WHEN g.ox <> r.ox OR g.width <> r.width THEN 'extent' WHEN g.nodata <> r.nodata THEN 'nodata_warning' ELSE 'ok' END AS verdict FROM g, r")
def c10(spark, d):
    """Grids with one fault each (10: also a pixel size, 11: also a rotation), and one sound reference."""
    key = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.lit(False).alias("reference"))
    rows = key.union(spark.createDataFrame([(0, True)], "id bigint, reference boolean"))
    k = F.when(F.col("reference"), 0).otherwise(F.col("id") % 12)
    pick = lambda usual, **odd: reduce(lambda c, o: F.when(k == int(o[0][1:]), F.lit(o[1])).otherwise(c), odd.items(), F.lit(usual))
    grids = rows.select("id", "reference", pick("EPSG:32648", k1=None, k2="EPSG:4326", k10="EPSG:4326").alias("crs"), pick(30.0, k5=60.0, k10=60.0).alias("pw"), pick(-30.0, k3=30.0, k11=30.0).alias("ph"), pick(0.0, k4=0.001, k11=0.001).alias("rx"), F.lit(0.0).alias("ry"), pick(0.0, k6=12.0, k7=90.0).alias("ox"), F.lit(0.0).alias("oy"), pick(20, k8=10).alias("width"), F.lit(20).alias("height"), pick(-9999.0, k9=0.0).alias("nodata"))
    return R.grid_report(grids)


@query("i01_kmeans")
def i01(spark, d):
    return ml.kmeans(spectra(spark, d), 3).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def _dealt(spark, d):
    """Spectra with ``train``: seven in ten of each class, in a seeded order; the rest is held out."""
    s = spectra(spark, d).withColumn("id", F.col("y") * 25 + F.col("x"))
    return written(ml.stratified_split(s, "id", "label"))


def _fitted(spark, d, kind):
    """Classes and probabilities of the rows held out."""
    s = ml.featured(_dealt(spark, d)).withColumn("label", F.col("label").cast("double"))
    model = ml.classifier(kind, 64, 10).fit(s.filter("train"))
    sure = F.element_at(vector_to_array("probability"), F.col("prediction").cast("int") + 1)
    return model.transform(s.filter("NOT train")).select("y", "x", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("class"), F.round(sure, 6).alias("probability"))


@query("i02_svm")
def i02(spark, d):
    """Kernel machines of the training rows, saved and loaded, over the rows held out; unit spectra need no scaling."""
    s, path = _dealt(spark, d), shared_path(spark, "machine")
    kernels.kernel_machine(s.filter("train"), 64, scale=False).save(spark, path)
    found = kernels.classify(s.filter("NOT train"), kernels.KernelMachine.load(spark, path))
    return found.select("y", "x", "label", F.col("class").cast("int").alias("class"), F.round("share", 6).alias("share"))


@query("i03_normal_bayes")
def i03(spark, d):
    s = spectra(spark, d, 8)
    return rounded(ml.normal_bayes(s, 8)(s), "probability").select("y", "x", "class", "probability")


_GAUSS = f"{ctes('ms')}, t AS (SELECT * FROM ms WHERE b1 IS NOT NULL AND b2 IS NOT NULL), c AS (SELECT label, count(*) AS n, avg(b1) AS m1, avg(b2) AS m2, var_pop(b1) + 1e-6 AS a, var_pop(b2) + 1e-6 AS d, covar_pop(b1, b2) AS b FROM t GROUP BY label), s AS (SELECT y, x, c.label, ln(c.n / (SELECT count(*) FROM t)) - ln(a * d - b * b) / 2 - (d * (b1 - m1) * (b1 - m1) - 2 * b * (b1 - m1) * (b2 - m2) + a * (b2 - m2) * (b2 - m2)) / (a * d - b * b) / 2 AS l FROM t, c)"


@query("i03_normal_bayes_two_bands", _GAUSS + " SELECT y, x, arg_max(label, l) AS class, round(1 / sum(exp(l - top)), 6) AS probability FROM (SELECT *, max(l) OVER (PARTITION BY y, x) AS top FROM s) GROUP BY y, x")
def i03t(spark, d):
    """Two bands, where SQL can write the matrices out."""
    s = load(spark, d, "ms").filter("b1 IS NOT NULL AND b2 IS NOT NULL").withColumn("spectrum", F.array("b1", "b2"))
    return rounded(ml.normal_bayes(s, 2)(s), "probability").select("y", "x", "class", "probability")


@query("i04_random_forest")
def i04(spark, d):
    return _fitted(spark, d, "forest")


@query("i05_mlp")
def i05(spark, d):
    return _fitted(spark, d, "mlp")


_NB = f"{ctes('ms')}, t AS (SELECT * FROM ms WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AND b4 IS NOT NULL), n AS (SELECT count(*) AS n FROM t), k AS (SELECT label, ln(count(*) / any_value(n.n)) AS p, " + ", ".join(f"avg({b}) AS m{b}, var_pop({b}) AS v{b}" for b in MS) + " FROM t, n GROUP BY label), s AS (SELECT y, x, k.label, p - " + " - ".join(f"(ln(2 * pi() * v{b}) + pow({b} - m{b}, 2) / v{b}) / 2" for b in MS) + " AS s FROM t, k)"


@query("i06_saved_model", _NB + " SELECT y, x, cast(max_by(label, s) AS integer) AS class FROM s GROUP BY y, x UNION ALL SELECT y, x, NULL FROM ms WHERE b1 IS NULL OR b2 IS NULL OR b3 IS NULL OR b4 IS NULL")
def i06(spark, d):
    """A model trained on an attribute table, saved, and loaded to predict only."""
    ms, path = load(spark, d, "ms"), shared_path(spark, "model")
    ml.save_model(ml.train_table(ms, MS, "label", "bayes"), path)
    return ml.apply_model(ms, path, MS).select("y", "x", F.col("class").cast("int").alias("class"))


@query("i07_scaler", f"{ctes('ms')}, r AS (SELECT avg(b1) AS m, greatest(stddev_pop(b1), 1e-6) AS s, min(b2) AS lo, max(b2) AS hi FROM ms) SELECT y, x, round((b1 - m) / s, 6) AS b1, round((b2 - lo) / (hi - lo), 6) AS b2 FROM ms, r WHERE b1 IS NOT NULL")
def i07(spark, d):
    ms = load(spark, d, "ms").filter("b1 IS NOT NULL")
    return rounded(ml.scaled(ml.scaled(ms, ["b1"]), ["b2"], "minmax"), "b1", "b2").select("y", "x", "b1", "b2")


_HASH = "(id * 2654435761 + 42) % 1000003"


@query("i08_split", f"{ctes('truth')}, r AS (SELECT id, truth, count(*) OVER (PARTITION BY truth) AS n, row_number() OVER (PARTITION BY truth ORDER BY {_HASH}, id) AS k FROM truth) SELECT id, n < 7 OR k <= floor(n * 0.7 + 0.5) AS train FROM r")
def i08(spark, d):
    return ml.stratified_split(load(spark, d, "truth"), "id", "truth").select("id", "train")


@query("i08_split_groups", f"{ctes('truth')}, t AS (SELECT id, truth, id // 5 AS roi FROM truth), v AS (SELECT roi, truth, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT roi AS id, arg_min(truth, truth - n * 1000) AS truth FROM v GROUP BY roi), r AS (SELECT id, count(*) OVER (PARTITION BY truth) AS n, row_number() OVER (PARTITION BY truth ORDER BY {_HASH}, id) AS k FROM g) SELECT t.id, r.n < 2 OR k <= floor(r.n * 0.7 + 0.5) AS train FROM t JOIN r ON r.id = roi")
def i08g(spark, d):
    t = load(spark, d, "truth").withColumn("roi", F.floor(F.col("id") / 5))
    return ml.stratified_split(t, "id", "truth", group="roi").select("id", "train")


@query("i09_folds", f"{ctes('truth')} SELECT id, cast((row_number() OVER (PARTITION BY truth ORDER BY {_HASH}, id) - 1) % 5 AS integer) AS fold FROM truth")
def i09(spark, d):
    return ml.folds(load(spark, d, "truth"), "id", "truth").select("id", "fold")


@query("i09_cross_validation")
def i09c(spark, d):
    s = spectra(spark, d, 8).withColumn("id", F.col("y") * 25 + F.col("x"))
    return rounded(ml.cross_validate(s, "id", 8, 3), "accuracy")


_CV = f"{ctes('ms')}, t AS (SELECT y * 100 + x AS id, label, b1, b2 FROM ms WHERE b1 IS NOT NULL AND b2 IS NOT NULL), f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {_HASH}, id) - 1) % 3 AS fold FROM t), z AS (SELECT k AS fold, avg(b1) AS u1, avg(b2) AS u2, greatest(stddev_pop(b1), 1e-6) AS w1, greatest(stddev_pop(b2), 1e-6) AS w2 FROM f, range(0, 3) r(k) WHERE fold <> k GROUP BY k), g AS (SELECT z.fold, f.fold = z.fold AS test, id, label, (b1 - u1) / w1 AS b1, (b2 - u2) / w2 AS b2 FROM f, z), c AS (SELECT fold, label AS class, count(*) AS n, sum(count(*)) OVER (PARTITION BY fold) AS total, avg(b1) AS m1, avg(b2) AS m2, var_pop(b1) + 1e-6 AS a, var_pop(b2) + 1e-6 AS d, covar_pop(b1, b2) AS b FROM g WHERE NOT test GROUP BY fold, label), s AS (SELECT g.fold, id, label, class, ln(n / total) - ln(a * d - b * b) / 2 - (d * (b1 - m1) * (b1 - m1) - 2 * b * (b1 - m1) * (b2 - m2) + a * (b2 - m2) * (b2 - m2)) / (a * d - b * b) / 2 AS l FROM g JOIN c ON c.fold = g.fold WHERE test), p AS (SELECT fold, id, label, arg_max(class, l) AS class FROM s GROUP BY fold, id, label), v AS (SELECT fold, avg(cast(class = label AS integer)) AS accuracy FROM p GROUP BY fold)"


@query("i09_validation_summary", _CV + " SELECT count(*) AS folds, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM v")
def i09s(spark, d):
    """Three folds over two bands, each scaled by its own training rows."""
    ms = load(spark, d, "ms").filter("b1 IS NOT NULL AND b2 IS NOT NULL")
    s = ms.select((F.col("y") * 100 + F.col("x")).alias("id"), "label", F.array("b1", "b2").alias("spectrum"))
    return rounded(ml.validation_summary(ml.cross_validate(s, "id", 2, 3)), "mean", "std")


_PERMS = "RECURSIVE w AS (SELECT DISTINCT cluster FROM g), o AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS k FROM w), c AS (SELECT cluster, truth, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT 0::bigint AS k, []::bigint[] AS used, 0::bigint AS total UNION ALL SELECT p.k + 1, list_append(used, t.truth), total + coalesce(c.n, 0) FROM p JOIN o ON o.k = p.k + 1 CROSS JOIN (SELECT DISTINCT truth FROM g) t LEFT JOIN c ON c.cluster = o.cluster AND c.truth = t.truth WHERE NOT list_contains(used, t.truth)), b AS (SELECT max_by(used, total) AS used FROM p WHERE k = (SELECT count(*) FROM w))"


@query("i10_remap_clusters", f"{ctes('truth')}, g AS (SELECT id, truth, (pred * 3 + 1) % 5 AS cluster FROM truth), {_PERMS[10:]} SELECT id, cast(b.used[o.k] AS integer) AS mapped FROM g JOIN o USING (cluster), b".replace("WITH ", "WITH RECURSIVE ", 1))
def i10(spark, d):
    """Clusters made from the predictions; SQL tries every assignment."""
    t = load(spark, d, "truth").withColumn("cluster", (F.col("pred") * 3 + 1) % 5)
    return ml.remap_clusters(t, "cluster", "truth").select("id", "mapped")


@query("i11_infer", f"{ctes('ms')} SELECT y, x, round(b1 * 0.5 + b2 * 2 - b3, 6) AS value FROM ms WHERE b1 IS NOT NULL")
def i11(spark, d):
    ms = load(spark, d, "ms").filter("b1 IS NOT NULL").select("y", "x", F.array("b1", "b2", "b3").alias("spectrum"))
    return rounded(ml.infer(ms, ["y", "x"], lambda x: x @ np.array([0.5, 2.0, -1.0])), "value")


_SEG = f"{ctes('grid')}, f AS (SELECT cast(floor(x / 7) + 100 * floor(y / 3) + 1 AS bigint) AS seg, label, value FROM grid)"


def _segments(spark, d):
    return load(spark, d, "grid").select((F.floor(F.col("x") / 7) + 100 * F.floor(F.col("y") / 3) + 1).alias("seg"), "label", "value")


@query("i13_majority_label", _SEG + ", c AS (SELECT seg, label, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY n DESC, label) AS rn FROM c) SELECT seg, label AS class, n FROM r WHERE rn = 1")
def i13(spark, d):
    return ml.majority_label(_segments(spark, d), "seg", "label", 2)


_OBJECTS = _SEG + ", o AS (SELECT seg, avg(value) / 1e5 AS b1, stddev_pop(value) / 1e5 AS b2 FROM f GROUP BY seg), n AS (SELECT seg, label, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY n DESC, label) AS k FROM n), t AS (SELECT o.*, label FROM o JOIN r ON r.seg = o.seg AND k = 1), c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total, avg(b1) AS m1, avg(b2) AS m2, var_pop(b1) + 1e-6 AS a, var_pop(b2) + 1e-6 AS d, covar_pop(b1, b2) AS b FROM t GROUP BY label) SELECT seg, arg_max(label, ln(n / total) - ln(a * d - b * b) / 2 - (d * (b1 - m1) * (b1 - m1) - 2 * b * (b1 - m1) * (b2 - m2) + a * (b2 - m2) * (b2 - m2)) / (a * d - b * b) / 2) AS class FROM o, c GROUP BY seg"


@query("i12_object_classes", _OBJECTS)
def i12(spark, d):
    seg = _segments(spark, d)
    feats = seg.groupBy("seg").agg(F.array(F.avg("value") / 1e5, F.stddev_pop("value") / 1e5).alias("spectrum"))
    train = feats.join(ml.majority_label(seg, "seg", "label", 2), "seg").withColumnRenamed("class", "label")
    return ml.normal_bayes(train, 2)(feats).select("seg", "class")


@query("i14_hierarchy", _SEG + ", c AS (SELECT seg, seg // 100 AS parent, label, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY n DESC, label) AS rn FROM c), k AS (SELECT seg AS child, parent, label AS class, n AS area FROM r WHERE rn = 1), v AS (SELECT parent, class, sum(area) AS a FROM k GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY a DESC, class) AS rn FROM v) SELECT child, k.parent, k.class, area, p.class AS parent_class FROM k JOIN p ON p.parent = k.parent AND rn = 1")
def i14(spark, d):
    kids = ml.majority_label(_segments(spark, d), "seg", "label").select(F.col("seg").alias("child"), F.floor(F.col("seg") / 100).alias("parent"), "class", F.col("n").alias("area"))
    return ml.consolidate(kids).select("child", "parent", "class", "area", "parent_class")


@query("l01_fingerprints", "SELECT p_partkey, sha256('ndvi|1.0|a=' || p_brand || ';b=2|in' || cast(p_partkey AS varchar) || '@' || cast(p_size AS varchar)) AS fingerprint FROM part")
def l01(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    f = provenance.fingerprint(F.lit("ndvi"), F.lit("1.0"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.col("p_brand")), F.array(F.struct(F.concat(F.lit("in"), F.col("p_partkey")).alias("asset"), F.col("p_size").alias("revision"))))
    return p.select("p_partkey", f.alias("fingerprint"))


@query("l02_lineage", "WITH RECURSIVE e AS (SELECT p_partkey AS o, cast(floor(p_partkey / 2) AS bigint) AS i FROM part WHERE p_partkey > 0), w AS (SELECT cast(199 AS bigint) AS asset, 0 AS depth UNION SELECT i, depth + 1 FROM w JOIN e ON o = asset) SELECT asset, min(depth) AS depth FROM w GROUP BY asset")
def l02(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey > 0")
    edges = p.select(F.col("p_partkey").alias("output"), F.floor(F.col("p_partkey") / 2).alias("input"))
    return provenance.upstream(edges, p.filter("p_partkey = 199").select(F.col("p_partkey").alias("asset")))


@query("l03_collections", "SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS assets FROM supplier GROUP BY s_nationkey")
def l03(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return provenance.collections(s, "s_nationkey", "s_name", "s_suppkey").select("s_nationkey", F.array_join("assets", ",").alias("assets"))


def _register():
    if "mean" in K.OPERATORS:
        return
    K.register("mean", lambda df, k=3: focal.mean_filter(df, k), k=(1, 99))
    K.register("threshold", lambda df, t: df.withColumn("mask", (F.col("value") >= t).cast("int")))
    K.register("histogram", lambda df, bins, low, high: stats.histogram(df, "value", bins, low, high), bins=(1, 65536))


_register()


@query("m03_chain", f"{ctes('dem')}, e AS (SELECT max(y) AS my, max(x) AS mx FROM dem), q AS MATERIALIZED (SELECT t.y, t.x, cast(least(greatest(t.y + dy, 0), my) AS bigint) AS ty, cast(least(greatest(t.x + dx, 0), mx) AS bigint) AS tx FROM dem t CROSS JOIN e CROSS JOIN range(-1, 2) a(dy) CROSS JOIN range(-1, 2) b(dx)), n AS (SELECT q.y, q.x, v.value FROM q JOIN dem v ON v.y = q.ty AND v.x = q.tx) SELECT y, x, round(avg(value), 6) AS value, cast(avg(value) >= 25.05 AS integer) AS mask FROM n GROUP BY y, x")
def m03(spark, d):
    out = K.chain({"dem": load(spark, d, "dem")}, [{"id": "smooth", "operator": "mean", "params": {"input": "$dem.output", "k": 3}}, {"id": "mask", "operator": "threshold", "params": {"input": "$smooth.output", "t": 25.05}}])
    return out["mask"].select("y", "x", clean(F.col("value")).alias("value"), "mask")


@query("m02_user_function", f"{ctes('grid')} SELECT label, round(sum(value * value), 0) AS total FROM grid GROUP BY label")
def m02(spark, d):
    @F.pandas_udf("double")
    def squared(v: pd.Series) -> pd.Series:
        return v * v

    return load(spark, d, "grid").select("label", squared("value").alias("q")).groupBy("label").agg(nearest(F.sum("q"), 0).alias("total"))


@query("m02_table_function", "WITH e AS (SELECT event_id, user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e) SELECT user_id, cast(session AS bigint) AS session, arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session")
def m02t(spark, d):
    """Sessions of a user, events no more than six hours apart, by a table function over ordered partitions."""
    from datetime import timedelta

    from ..operators.functions import table_function

    def step(state, row):
        user, last, session, first, n, total = state
        if last is not None and row.ts - last <= timedelta(hours=6):
            return (user, row.ts, session, first, n + 1, total + row.value), []
        return (row.user_id, row.ts, session + 1, row.event_id, 1, row.value), closed(state)

    def closed(state):
        user, last, session, first, n, total = state
        return [(user, session, first, n, total)] if n else []

    sessions = table_function(step, "user_id bigint, session bigint, first_event bigint, n bigint, total double", (None, None, 0, None, 0, 0.0), closed)
    out = sessions(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"])
    return out.withColumn("total", clean(F.col("total"), 4))

"""Reading, writing and re-laying pixel tables, features and scene metadata."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pixels(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Missing values are written as null, NaN too; one folder per ``by`` value where given."""
    out = df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    (out.write.partitionBy(*by) if by else out.write).parquet(path)


def read_features(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """geojson (a FeatureCollection), csv with a header, or parquet."""
    if fmt == "geojson":
        return spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)


def convert_features(df: DataFrame, path: str, fmt: str) -> None:
    """parquet, csv, or geojson: one FeatureCollection a file of ``type, geometry, properties`` rows."""
    if fmt == "geojson":
        one = F.to_json(F.struct(F.lit("Feature").alias("type"), "geometry", "properties"))

        def lines(batches):
            comma = ""
            for pdf in batches:
                for v in pdf["value"]:
                    yield pd.DataFrame({"value": [(comma or '{"type":"FeatureCollection","features":[\n') + v]})
                    comma = ","
            if comma:
                yield pd.DataFrame({"value": ["]}"]})

        df.select(one.alias("value")).mapInPandas(lines, "value string").write.text(path)
        return
    df.write.format({"geojson": "json"}.get(fmt, fmt)).option("header", True).save(path)


def key_values(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``(file, keys..)`` of KEY = VALUE text: one row a document, each ended by a line END or by its file, if it has any of the keys.

    A file may hold many documents; large files are split between documents.
    """
    text = spark.read.option("lineSep", "\nEND\n").text(path)
    line = {k: rf'(?m)^[ \t]*{re.escape(k)}[ \t]*=[ \t]*"?([^"\r\n]*?)"?[ \t\r]*$' for k in keys}
    rows = text.select(F.input_file_name().alias("file"), *[F.when(F.col("value").rlike(e), F.regexp_extract("value", e, 1)).alias(k) for k, e in line.items()])
    return rows.dropna(how="all", subset=keys)


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """Elements ``tag`` as rows; without a ``schema`` all files are read once more to infer it."""
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


#: Band name, role, wavelength and width (nm) of three sensors.
BANDS = {
    "landsat": [("B2", "blue", 482.0, 60.0), ("B3", "green", 561.5, 57.0), ("B4", "red", 654.5, 37.0), ("B5", "nir", 865.0, 28.0), ("B6", "swir1", 1608.5, 85.0), ("B7", "swir2", 2200.5, 187.0)],
    "sentinel2": [("B02", "blue", 492.4, 66.0), ("B03", "green", 559.8, 36.0), ("B04", "red", 664.6, 31.0), ("B08", "nir", 832.8, 106.0), ("B11", "swir1", 1613.7, 91.0), ("B12", "swir2", 2202.4, 175.0)],
    "modis": [("b01", "red", 645.0, 50.0), ("b02", "nir", 858.5, 35.0), ("b03", "blue", 469.0, 20.0), ("b04", "green", 555.0, 20.0)],
}
PATTERNS = {"landsat": r"(L[COTE]0[4-9]_\w+?)_(B\d+)\.", "sentinel2": r"(T\d{2}[A-Z]{3}_\d{8}T\d{6})_(B\d{1,2}A?)", "modis": r"(M[OY]D\w+\.A\d{7}\.h\d{2}v\d{2})\.\w*?_(b\d{2})"}


def discover(files: DataFrame, col: str = "name") -> DataFrame:
    """``(product, sensor, band, role, wavelength, fwhm, name)`` of recognised band files."""
    spark = files.sparkSession
    roles = spark.createDataFrame([(s, *b) for s, bands in BANDS.items() for b in bands], "sensor string, band string, role string, wavelength double, fwhm double")
    parts = [files.select(F.lit(s).alias("sensor"), F.regexp_extract(col, p, 1).alias("product"), F.regexp_extract(col, p, 2).alias("band"), F.col(col).alias("name")) for s, p in PATTERNS.items()]
    found = reduce(DataFrame.unionByName, parts).filter("product <> ''")
    return found.join(F.broadcast(roles), ["sensor", "band"]).select("product", "sensor", "band", "role", "wavelength", "fwhm", "name")  # a fixed table


def stack(bands: DataFrame, names: list[str]) -> DataFrame:
    """Long ``(y, x, band, value)`` to one column a band."""
    return bands.groupBy("y", "x").pivot("band", names).agg(F.first("value"))


def unstack(df: DataFrame, names: list[str]) -> DataFrame:
    return df.unpivot(["y", "x"], names, "band", "value")


def to_xyz(df: DataFrame, ox: float, oy: float, pw: float, ph: float, skip: int = 1, bands: list[str] | None = None, window: tuple[int, int, int, int] | None = None, nodata: float | None = None, fill: float | None = None, drop: bool = False) -> DataFrame:
    """Pixel centres as coordinates ``(cx, cy, bands..)``, every ``skip``-th row and column.

    ``window`` is (first column, first row, columns, rows); skipping starts at its
    corner, and rows outside are pruned at the source.  ``nodata`` in a band and
    nulls become ``fill`` (null without one); ``drop`` leaves out pixels that
    have no value in any band.
    """
    bands = bands or ["value"]
    x0, y0 = window[:2] if window else (0, 0)
    px = df.select("y", "x", *bands)
    if window:
        px = px.filter(F.col("x").between(x0, x0 + window[2] - 1) & F.col("y").between(y0, y0 + window[3] - 1))
    px = px.filter(((F.col("y") - y0) % skip == 0) & ((F.col("x") - x0) % skip == 0))
    if nodata is not None:
        px = px.withColumns({c: F.nullif(F.col(c), F.lit(nodata)) for c in bands})
    if drop:
        px = px.dropna(how="all", subset=bands)
    if fill is not None:
        px = px.fillna(fill, bands)
    return px.select((ox + (F.col("x") + 0.5) * pw).alias("cx"), (oy + (F.col("y") + 0.5) * ph).alias("cy"), *bands)


def footprint(df: DataFrame, by: str) -> DataFrame:
    """Box of each scene as WKT."""
    g = df.groupBy(by).agg(F.min("x").alias("a"), F.min("y").alias("b"), (F.max("x") + 1).alias("c"), (F.max("y") + 1).alias("d"))
    return g.select(by, F.format_string("POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))", "a", "b", "c", "b", "c", "d", "a", "d", "a", "b").alias("wkt"))


def tiled(df: DataFrame, size: int) -> DataFrame:
    return df.withColumns({"tile_y": F.floor(F.col("y") / size), "tile_x": F.floor(F.col("x") / size)})


def info(df: DataFrame, bands: list[str]) -> DataFrame:
    return df.agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.lit(len(bands)).alias("bands"), *[F.count(b).alias(f"valid_{b}") for b in bands])


def virtual(sources: dict[str, DataFrame], extent: str = "intersection", fill: float | None = None) -> DataFrame:
    """Lazy stack of single-band tables ``(y, x, value)``: common pixels, or all with ``fill``."""
    named = [s.select("y", "x", F.col("value").alias(n)) for n, s in sources.items()]
    out = reduce(lambda a, b: a.join(b, ["y", "x"], "inner" if extent == "intersection" else "full"), named)
    return out if fill is None or extent == "intersection" else out.fillna(fill, list(sources))


def overview(df: DataFrame, factor: int, method: str = "mean") -> DataFrame:
    """Coarser level: mean, nearest (upper-left) or gaussian-weighted blocks."""
    ky, kx = F.floor(F.col("y") / factor), F.floor(F.col("x") / factor)
    dy, dx = F.col("y") % factor - (factor - 1) / 2, F.col("x") % factor - (factor - 1) / 2
    w = F.exp(-(dy * dy + dx * dx) / (2.0 * (factor / 2) ** 2))
    agg = {"mean": F.avg("value"), "nearest": F.min_by("value", F.struct("y", "x")), "gaussian": F.sum(w * F.col("value")) / F.sum(F.when(F.col("value").isNotNull(), w))}[method]
    return df.groupBy(ky.alias("ky"), kx.alias("kx")).agg(agg.alias("value")).withColumnsRenamed({"ky": "y", "kx": "x"})


def grid_report(grids: DataFrame) -> DataFrame:
    """``(a, b, verdict)`` of grids against the one reference row: the first issue that blocks, or ``nodata_warning``, or ``ok``.

    ``grids(id, crs, pw, ph, rx, ry, ox, oy, width, height, nodata, reference)``
    with signed pixel sizes and rotation terms.  In order: missing_crs (one has
    none), crs, axis (an axis runs the other way), rotation, pixel_size, origin
    (off by part of a pixel), extent (the same lattice, another extent).  Two
    grids without a CRS are not comparable and pass; unknown nodata never warns.
    """
    names = ("id", "crs", "pw", "ph", "rx", "ry", "ox", "oy", "width", "height", "nodata")
    ref = grids.filter("reference").select(*[F.col(c).alias("r_" + c) for c in names])
    both = grids.filter("NOT reference").crossJoin(F.broadcast(ref.limit(1)))
    pair = lambda c: (F.col(c), F.col("r_" + c))
    differ = lambda c, tiny: F.abs(F.col(c) - F.col("r_" + c)) > tiny
    none = [c.isNull() | (c == "") for c in pair("crs")]
    lone = none[0] != none[1]
    part = lambda o, p: (lambda k: F.abs(k - F.round(k)) > 1e-6)((F.col(o) - F.col("r_" + o)) / F.col("r_" + p))
    checks = [
        ("missing_crs", lone),
        ("crs", ~lone & (F.col("crs") != F.col("r_crs"))),
        ("axis", (F.signum("pw") != F.signum("r_pw")) | (F.signum("ph") != F.signum("r_ph"))),
        ("rotation", (F.abs("rx") > 1e-12) | (F.abs("ry") > 1e-12) | (F.abs("r_rx") > 1e-12) | (F.abs("r_ry") > 1e-12)),
        ("pixel_size", differ("pw", 1e-9) | differ("ph", 1e-9)),
        ("origin", part("ox", "pw") | part("oy", "ph")),
        ("extent", differ("ox", 1e-9) | differ("oy", 1e-9) | (F.col("width") != F.col("r_width")) | (F.col("height") != F.col("r_height"))),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    warned = F.when(F.col("nodata") != F.col("r_nodata"), F.lit("nodata_warning")).otherwise(F.lit("ok"))
    verdict = F.when(none[0] & none[1], F.lit("ok")).otherwise(F.coalesce(F.get(found, F.lit(0)), warned))
    return both.select(F.col("r_id").alias("a"), F.col("id").alias("b"), verdict.alias("verdict"))


ITEM = "id string, bbox array<double>, collection string, properties map<string,string>, assets map<string,struct<href:string,type:string>>"


def stac_items(df: DataFrame, col: str = "json") -> DataFrame:
    """Item JSON to columns, with the begin and end of its instant or interval."""
    i = df.select(F.from_json(col, ITEM).alias("i")).select("i.*")
    at = lambda k: F.col("properties")[k].cast("timestamp")
    return i.withColumns({"begin": F.coalesce(at("start_datetime"), at("datetime")), "until": F.coalesce(at("end_datetime"), at("datetime"))})


def stac_search(items: DataFrame, bbox: list[float], begin: str, until: str, collection: str | None = None) -> DataFrame:
    """Items that meet the box and the time range, with the picked image asset.

    The pick is the first asset in key order whose href ends in .tif or whose type is image/tiff.
    """
    b = F.col("bbox")
    out = items.filter((b[0] <= bbox[2]) & (b[2] >= bbox[0]) & (b[1] <= bbox[3]) & (b[3] >= bbox[1]) & (F.col("begin") <= F.lit(until).cast("timestamp")) & (F.col("until") >= F.lit(begin).cast("timestamp")))
    if collection is not None:
        out = out.filter(F.col("collection") == collection)
    picks = F.filter(F.array_sort(F.map_entries("assets")), lambda e: e["value"]["href"].endswith(".tif") | F.coalesce(e["value"]["type"].startswith("image/tiff"), F.lit(False)))
    return out.withColumn("href", F.get(picks, F.lit(0))["value"]["href"])


def remap_fields(df: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """Target name -> (expression, type)."""
    return df.select(*[F.expr(e).cast(t).alias(n) for n, (e, t) in mapping.items()])

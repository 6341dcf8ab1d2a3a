"""Pixel-wise operators: each is columns over one table, or one equi join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import known, ratio
from ..functions.projections import SINUSOID

KEY = ["y", "x"]

#: Formulas of the named indices over nir n, red r, green g, blue b, swir s.
INDICES = {
    "ndvi": lambda c: ratio(c["n"] - c["r"], c["n"] + c["r"]),
    "ndwi": lambda c: ratio(c["g"] - c["n"], c["g"] + c["n"]),
    "ndbi": lambda c: ratio(c["s"] - c["n"], c["s"] + c["n"]),
    "mndwi": lambda c: ratio(c["g"] - c["s"], c["g"] + c["s"]),
    "evi": lambda c: ratio(2.5 * (c["n"] - c["r"]), c["n"] + 6.0 * c["r"] - 7.5 * c["b"] + 1.0),
    "savi": lambda c: ratio(1.5 * (c["n"] - c["r"]), c["n"] + c["r"] + 0.5),
}


def spectral_index(name: str, **bands: str) -> Column:
    """A named index; ``bands`` maps n, r, g, b, s to column names."""
    return INDICES[name]({k: known(F.col(v)) for k, v in bands.items()})


def by_role(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Rename bands to their roles (role -> band)."""
    return df.select("*", *[F.col(b).alias(r) for r, b in roles.items()])


def qa_bits(qa: Column, bits: list[int]) -> Column:
    """1 where any of the bits is set, else 0."""
    return (qa.bitwiseAND(F.lit(sum(1 << b for b in bits))) != 0).cast("int")


def qa_classes(scl: Column, classes: list[int]) -> Column:
    """1 for the listed classes below 16, else 0."""
    return (scl.isin([c for c in classes if c < 16])).cast("int")


def apply_mask(df: DataFrame, mask: DataFrame, bands: list[str]) -> DataFrame:
    """No value in any band where the aligned mask is over 0; outside the mask is clear."""
    m = mask.select(*KEY, F.col("mask").alias("_mask"))
    on = F.coalesce("_mask", F.lit(0)) > 0
    return df.join(m, KEY, "left").select(*[F.when(on, None).otherwise(F.col(c)).alias(c) if c in bands else F.col(c) for c in df.columns], on.cast("int").alias("masked"))


def recode(c: Column, table: dict[int, int]) -> Column:
    """Mapped classes; others stay."""
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), table.items(), F.when(F.lit(False), c)).otherwise(c)


def radiance(dn: Column, gain: float, bias: float) -> Column:
    return dn * gain + bias


def toa_reflectance(dn: Column, mult: float, add: float, sun_elevation: float) -> Column:
    return (dn * mult + add) / F.sin(F.radians(F.lit(sun_elevation)))


def scaled_reflectance(dn: Column, scale: float, offset: float) -> Column:
    return (dn + offset) / scale


def brightness_temperature(rad: Column, k1: float, k2: float) -> Column:
    """K2 / ln(K1 / L + 1); none where L <= 0."""
    return F.when(rad > 0, F.lit(k2) / F.log(F.lit(k1) / rad + 1))


def linear_stretch(v: Column, low: float, high: float) -> Column:
    """0..255 by clamping to [low, high]."""
    return F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255


def piecewise_stretch(v: Column, points: list[tuple[float, float]]) -> Column:
    """Through control points in ascending order; flat outside."""
    out = F.when(v <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(v <= x1, F.lit(y0) + (v - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(v.isNotNull(), points[-1][1])


def rescale(df: DataFrame, col: str, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """``col`` spread over [low, high] by its own range: one aggregate, joined back as one row."""
    r = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return df.crossJoin(F.broadcast(r)).withColumn(col, F.lit(low) + ratio(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (high - low)).drop("_lo", "_hi")


def rgb_to_ihs(r: Column, g: Column, b: Column) -> list[Column]:
    """Intensity, hue (radians) and saturation by the linear transform."""
    v1, v2 = (-r - g + 2 * b) / 6.0, (r - g) / 2.0
    return [(r + g + b) / 3.0, F.atan2(v2, v1), F.sqrt(v1 * v1 + v2 * v2)]


def ihs_to_rgb(i: Column, h: Column, s: Column) -> list[Column]:
    v1, v2 = s * F.cos(h), s * F.sin(h)
    return [i - v1 + v2, i - v1 - v2, i + 2 * v1]


def nearest_palette(df: DataFrame, rgb: list[str], palette: list[tuple[int, int, int, int]]) -> DataFrame:
    """``entry``: the palette entry nearest to each colour, ties to the smaller one.  A palette is a short literal list."""
    away = [F.struct(sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(rgb, p[1:])).alias("d"), F.lit(p[0]).alias("e")) for p in palette]
    return df.withColumn("entry", F.least(*away)["e"])


def extract_by_attribute(df: DataFrame, field: str, op: str, value: str | None = None) -> DataFrame:
    """Rows by one test: = != > >= < <= begins contains null notnull.

    Both sides numeric: numbers within 1e-9 are equal; else text comparison.
    """
    c = F.col(field)
    if op in ("null", "notnull"):
        return df.filter(c.isNull() if op == "null" else c.isNotNull())
    if op in ("begins", "contains"):
        return df.filter(c.cast("string").startswith(value) if op == "begins" else c.cast("string").contains(value))
    n, v = c.try_cast("double"), float(value) if _numeric(value) else None
    text = c.cast("string")
    plain = {"=": text == value, "!=": text != value, ">": text > value, ">=": text >= value, "<": text < value, "<=": text <= value}[op]
    if v is None:
        return df.filter(plain)
    d = n - v
    near = {"=": F.abs(d) <= 1e-9, "!=": F.abs(d) > 1e-9, ">": d > 1e-9, ">=": d >= -1e-9, "<": d < -1e-9, "<=": d <= 1e-9}[op]
    return df.filter(F.when(n.isNull(), plain).otherwise(near))


def _numeric(value) -> bool:
    try:
        float(value)
        return True
    except (TypeError, ValueError):
        return False


def calculate_field(df: DataFrame, name: str, kind: str, formula: str) -> DataFrame:
    """Add or replace a field of kind Integer, Float or String."""
    return df.withColumn(name, F.expr(formula).cast({"Integer": "bigint", "Float": "double", "String": "string"}[kind]))


def clip(df: DataFrame, x0: float, y0: float, x1: float, y1: float, crop: bool = True) -> DataFrame:
    """Pixels whose index lies in [x0, x1) x [y0, y1); ``crop`` moves the origin there."""
    out = df.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return out.withColumns({"x": F.col("x") - F.lit(int(x0)), "y": F.col("y") - F.lit(int(y0))}) if crop else out


def cutline(df: DataFrame, ring: Column, crop: bool = False) -> DataFrame:
    """Pixels whose centre lies inside a polygon (``array<struct<x, y>>``, even-odd); ``crop`` moves the origin to its box."""
    from .spatial import in_polygon

    out = df.filter(in_polygon(F.col("x") + 0.5, F.col("y") + 0.5, ring))
    low = lambda c: F.floor(F.array_min(F.transform(ring, lambda p: p[c])))
    return out.withColumns({"x": F.col("x") - low("x"), "y": F.col("y") - low("y")}) if crop else out


def ignore(df: DataFrame, bands: list[str], value: float | None = None, tolerance: float = 1e-9, mode: str = "any") -> DataFrame:
    """Drop pixels with no value, or the ignore value, in any or all bands."""
    bad = [known(F.col(b)).isNull() | (F.lit(False) if value is None else F.coalesce(F.abs(F.col(b) - value) <= tolerance, F.lit(False))) for b in bands]
    return df.filter(~reduce(lambda a, b: (a | b) if mode == "any" else (a & b), bad))


def nullify(v: Column, ranges: list[tuple[float, float]]) -> Column:
    """No value inside any closed range."""
    return F.when(reduce(lambda a, b: a | b, [v.between(lo, hi) for lo, hi in ranges]), None).otherwise(v)


def convert_type(v: Column, low: float, high: float, kind: str) -> Column:
    """Clamp, round half away from zero, cast."""
    return F.round(F.least(F.greatest(v, F.lit(low)), F.lit(high))).cast(kind)


def overlapping_time(df: DataFrame, start: str, end: str, begin: str, until: str) -> DataFrame:
    """Rows whose [start, end] meets [begin, until)."""
    return df.filter((F.col(start) < F.lit(until).cast("timestamp")) & (F.col(end) >= F.lit(begin).cast("timestamp")))


def constraint_report(df: DataFrame, not_null: list[str] = (), unique: list[str] = (), checks: dict[str, str] | None = None) -> DataFrame:
    """Violations of each constraint, one row each: ``(constraint_name, violations)``."""
    parts = [F.sum(F.col(c).isNull().cast("bigint")).alias(f"not_null:{c}") for c in not_null]
    parts += [(F.count(c) - F.count_distinct(c)).alias(f"unique:{c}") for c in unique]
    parts += [F.sum((~F.coalesce(F.expr(e), F.lit(False))).cast("bigint")).alias(f"check:{n}") for n, e in (checks or {}).items()]
    one = df.agg(*parts)
    return one.unpivot([], one.columns, "constraint_name", "violations")


# --- tiles of the sinusoidal grid


def modis_origin(name: Column) -> list[Column]:
    """Sinusoidal x, y of the upper-left corner of a tile named ..hXXvYY.."""
    tile = SINUSOID * 3.141592653589793 / 18
    h, v = F.regexp_extract(name, r"h(\d{2})v\d{2}", 1).cast("int"), F.regexp_extract(name, r"h\d{2}v(\d{2})", 1).cast("int")
    return [(h - 18) * tile, (9 - v) * tile]

"""Queries of projections and reprojected rasters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projections as J
from ..functions.expressions import clean
from ..operators.warp import Grid, warp
from .fixtures import ctes, load
from .registry import query
from .stats_queries import rounded

#: The transverse Mercator series in SQL, from ``lon`` and ``lat`` of zone 33; constants are WGS84's.
_E2 = J.FLATTENING * (2 - J.FLATTENING)
_EP = _E2 / (1 - _E2)
_UTM = f"""u AS (SELECT *, radians(lat) AS phi, 6378137.0 / sqrt(1 - {_E2} * pow(sin(radians(lat)), 2)) AS nn, pow(tan(radians(lat)), 2) AS tt, {_EP} * pow(cos(radians(lat)), 2) AS cc, cos(radians(lat)) * radians(lon - 15) AS aa FROM g),
     v AS (SELECT *, 6378137.0 * ({1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256} * phi - {3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024} * sin(2 * phi) + {15 * _E2**2 / 256 + 45 * _E2**3 / 1024} * sin(4 * phi) - {35 * _E2**3 / 3072} * sin(6 * phi)) AS mm FROM u),
     w AS (SELECT *, 0.9996 * nn * (aa + (1 - tt + cc) * pow(aa, 3) / 6 + (5 - 18 * tt + tt * tt + 72 * cc - 58 * {_EP}) * pow(aa, 5) / 120) + 500000.0 AS east,
            0.9996 * (mm + nn * tan(phi) * (pow(aa, 2) / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * pow(aa, 4) / 24 + (61 - 58 * tt + tt * tt + 600 * cc - 330 * {_EP}) * pow(aa, 6) / 720)) AS north FROM v)"""


@query("b24_utm", f"{ctes('pts')}, g AS (SELECT id, px / 100 * 6 + 12 AS lon, py * 1.6 - 80 AS lat FROM pts), {_UTM} SELECT id, round(east, 3) AS east, round(north + CASE WHEN lat < 0 THEN 10000000.0 ELSE 0 END, 3) AS north, round(lon, 4) AS lon, round(lat, 4) AS lat FROM w")
def b24u(spark, d):
    """Points of zone 33, both hemispheres, there and back again."""
    g = load(spark, d, "pts").select("id", (F.col("px") / 100 * 6 + 12).alias("lon"), (F.col("py") * 1.6 - 80).alias("lat"))
    south = F.col("lat") < 0
    north_side, south_side = J.forward("utm:33", F.col("lon"), F.col("lat")), J.forward("utm:33s", F.col("lon"), F.col("lat"))
    there = g.select("id", south.alias("south"), *[F.when(south, s).otherwise(n).alias(c) for s, n, c in zip(south_side, north_side, ("east", "north"))])
    at = F.col("east"), F.col("north")
    back = [F.when(F.col("south"), s).otherwise(n).alias(c) for s, n, c in zip(J.inverse("utm:33s", *at), J.inverse("utm:33", *at), ("lon", "lat"))]
    return rounded(there.select("id", "east", "north", *back), "lon", "lat", digits=4).withColumns({c: clean(F.col(c), 3) for c in ("east", "north")})


@query("b24_reproject", f"{ctes('pts')}, g AS (SELECT id, px / 100 * 6 + 6 AS lon, py / 2 AS lat FROM pts) SELECT id, round(radians(lon) * 6378137.0, 3) AS px, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS py FROM g")
def b24r(spark, d):
    """Sinusoidal coordinates to the web map's, through geographic ones."""
    g = load(spark, d, "pts").select("id", (F.col("px") / 100 * 6 + 6).alias("px"), (F.col("py") / 2).alias("py"))
    out = J.reproject(J.reproject(g, "geographic", "sinusoidal"), "sinusoidal", "mercator")
    return out.select("id", *[clean(F.col(c), 3).alias(c) for c in ("px", "py")])


def frames(spark, d, name: str) -> tuple[Grid, Grid]:
    """``grid`` as a sinusoidal raster of 5 km pixels, ``dem`` as one of zone 33 of 1 km pixels, and a geographic grid over each."""
    last = load(spark, d, name).agg(F.max("y"), F.max("x")).first()
    height, width = last[0] + 1, last[1] + 1
    if name == "grid":
        return Grid("sinusoidal", 0.0, 6000000.0, 5000.0, -5000.0, width, height), Grid("geographic", 0.0, 54.0, 0.05, -0.05, 160, int(height * 0.9) + 2)
    return Grid("utm:33", 500000.0, 5500000.0, 1000.0, -1000.0, width, height), Grid("geographic", 15.0, 49.7, 0.01, -0.01, 40, int(height * 0.9) + 10)


_GRID = f"{ctes('grid')}, g AS (SELECT y, x, 54.0 - (y + 0.5) * 0.05 AS lat, (x + 0.5) * 0.05 AS lon FROM (SELECT unnest(range(0, (SELECT cast(floor((max(y) + 1) * 0.9) AS bigint) + 2 FROM grid))) AS y), range(0, 160) r(x)), s AS (SELECT y, x, (radians(lat) * 6371007.181 - 6000000.0) / -5000.0 - 0.5 AS sy, radians(lon) * cos(radians(lat)) * 6371007.181 / 5000.0 - 0.5 AS sx FROM g)"
_DEM = f"{ctes('dem')}, g AS (SELECT y, x, 49.7 - (y + 0.5) * 0.01 AS lat, 15.0 + (x + 0.5) * 0.01 AS lon FROM (SELECT unnest(range(0, (SELECT cast(floor((max(y) + 1) * 0.9) AS bigint) + 10 FROM dem))) AS y), range(0, 40) r(x)), {_UTM}, s AS (SELECT y, x, (north - 5500000.0) / -1000.0 - 0.5 AS sy, (east - 500000.0) / 1000.0 - 0.5 AS sx FROM w)"
_CUBIC = "CASE WHEN {d} <= 1 THEN 1.5 * pow({d}, 3) - 2.5 * pow({d}, 2) + 1 WHEN {d} < 2 THEN -0.5 * pow({d}, 3) + 2.5 * pow({d}, 2) - 4 * {d} + 2 ELSE 0 END"


def _taps(table: str, low: int, high: int, weight: str) -> str:
    w = " * ".join("(" + weight.replace("{d}", f"abs({s} - floor({s}) - {o})") + ")" for s, o in (("sy", "a"), ("sx", "b")))
    return f", k AS (SELECT s.y, s.x, cast(floor(sy) + a AS bigint) AS ty, cast(floor(sx) + b AS bigint) AS tx, {w} AS w FROM s, range({low}, {high}) p(a), range({low}, {high}) q(b)), z AS (SELECT k.y, k.x, sum(w * value) / nullif(sum(w), 0) AS value, sum(w) AS w FROM k JOIN {table} v ON v.y = ty AND v.x = tx GROUP BY k.y, k.x) SELECT y, x, round(value, 4) AS value FROM z WHERE w > 1e-12"


@query("c09_warp_nearest", _GRID + " SELECT s.y, s.x, label FROM s JOIN grid v ON v.y = floor(sy + 0.5) AND v.x = floor(sx + 0.5)")
def c09n(spark, d):
    """Classes of a sinusoidal raster on a geographic grid."""
    return warp(load(spark, d, "grid"), *frames(spark, d, "grid"), method="cubic", cols=["label"], categorical=True, tolerance=0)


@query("c09_warp_bilinear", _GRID + _taps("grid", 0, 2, "1 - {d}"))
def c09b(spark, d):
    return rounded(warp(load(spark, d, "grid"), *frames(spark, d, "grid"), method="bilinear", tolerance=0), "value", digits=4)


@query("c09_warp_cubic", _GRID + _taps("grid", -1, 3, _CUBIC))
def c09c(spark, d):
    return rounded(warp(load(spark, d, "grid"), *frames(spark, d, "grid"), method="cubic", tolerance=0), "value", digits=4)


@query("c09_warp_utm", _DEM + _taps("dem", 0, 2, "1 - {d}"))
def c09u(spark, d):
    """A raster of a transverse Mercator zone on a geographic grid."""
    return rounded(warp(load(spark, d, "dem"), *frames(spark, d, "dem"), method="bilinear", tolerance=0), "value", digits=4)

"""Map projections in closed form, both ways.

Every function works on columns (``m=F``, the default) and on arrays
(``m=numpy``), so points of a table and pixels of a tile are transformed by the
same formulas.  Reference systems are named ``geographic``, ``mercator``,
``sinusoidal``, ``utm:33`` or ``utm:33s``; longitudes and latitudes are degrees
and pass between systems without a datum shift.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius of the web map's sphere and WGS84's long axis, radius of the sinusoidal grid's sphere, WGS84's flattening, scale on a zone's meridian.
EARTH = 6378137.0
SINUSOID = 6371007.181
FLATTENING = 1 / 298.257223563
MERIDIAN_SCALE = 0.9996
FALSE_EAST, FALSE_NORTH_SOUTH = 500000.0, 10000000.0


def to_web_mercator(lon, lat, m=F) -> list:
    return [m.radians(lon) * EARTH, m.log(m.tan(math.pi / 4 + m.radians(lat) / 2)) * EARTH]


def from_web_mercator(x, y, m=F) -> list:
    return [m.degrees(x / EARTH), m.degrees(2 * m.atan(m.exp(y / EARTH)) - math.pi / 2)]


def to_sinusoidal(lon, lat, m=F) -> list:
    return [m.radians(lon) * m.cos(m.radians(lat)) * SINUSOID, m.radians(lat) * SINUSOID]


def from_sinusoidal(x, y, m=F) -> list:
    """Longitude is beyond 180 degrees outside the map's outline."""
    phi = y / SINUSOID
    return [m.degrees(x / (SINUSOID * m.cos(phi))), m.degrees(phi)]


def _ellipsoid() -> tuple[float, float, list[float]]:
    """Squared eccentricities, and the meridian arc's coefficients of phi, sin 2 phi, sin 4 phi and sin 6 phi."""
    e2 = FLATTENING * (2 - FLATTENING)
    arc = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072]
    return e2, e2 / (1 - e2), arc


def to_utm(lon, lat, zone: int, m=F, south: bool = False) -> list:
    """Transverse Mercator on WGS84 by the usual series."""
    e2, ep, arc = _ellipsoid()
    phi, lam = m.radians(lat), m.radians(lon - float(zone * 6 - 183))
    n = EARTH / m.sqrt(1 - e2 * m.sin(phi) ** 2)
    t, c, a = m.tan(phi) ** 2, ep * m.cos(phi) ** 2, m.cos(phi) * lam
    along = EARTH * (arc[0] * phi - arc[1] * m.sin(2 * phi) + arc[2] * m.sin(4 * phi) - arc[3] * m.sin(6 * phi))
    east = MERIDIAN_SCALE * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep) * a**5 / 120) + FALSE_EAST
    north = MERIDIAN_SCALE * (along + n * m.tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c**2) * a**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep) * a**6 / 720))
    return [east, north + (FALSE_NORTH_SOUTH if south else 0.0)]


def from_utm(x, y, zone: int, m=F, south: bool = False) -> list:
    """The inverse series, about the latitude whose meridian arc the northing is; within a zone it undoes `to_utm` to about 1e-8 degrees."""
    e2, ep, arc = _ellipsoid()
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = (y - (FALSE_NORTH_SOUTH if south else 0.0)) / (MERIDIAN_SCALE * EARTH * arc[0])
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * m.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * m.sin(4 * mu) + 151 * e1**3 / 96 * m.sin(6 * mu) + 1097 * e1**4 / 512 * m.sin(8 * mu)
    s = 1 - e2 * m.sin(foot) ** 2
    n, r = EARTH / m.sqrt(s), EARTH * (1 - e2) / (s * m.sqrt(s))
    t, c, d = m.tan(foot) ** 2, ep * m.cos(foot) ** 2, (x - FALSE_EAST) / (n * MERIDIAN_SCALE)
    lat = foot - n * m.tan(foot) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep + 24 * t**2) * d**5 / 120) / m.cos(foot)
    return [m.degrees(lon) + float(zone * 6 - 183), m.degrees(lat)]


def _zone(crs: str) -> tuple[int, bool]:
    name = crs.removeprefix("utm:")
    zone = int(name.rstrip("s"))
    if not 1 <= zone <= 60:
        raise ValueError(f"no such zone: {crs}")
    return zone, name.endswith("s")


def forward(crs: str, lon, lat, m=F) -> list:
    """Coordinates in ``crs`` of a longitude and latitude."""
    if crs == "geographic":
        return [lon, lat]
    if crs.startswith("utm:"):
        zone, south = _zone(crs)
        return to_utm(lon, lat, zone, m, south)
    return {"mercator": to_web_mercator, "sinusoidal": to_sinusoidal}[crs](lon, lat, m)


def inverse(crs: str, x, y, m=F) -> list:
    """Longitude and latitude of coordinates in ``crs``."""
    if crs == "geographic":
        return [x, y]
    if crs.startswith("utm:"):
        zone, south = _zone(crs)
        return from_utm(x, y, zone, m, south)
    return {"mercator": from_web_mercator, "sinusoidal": from_sinusoidal}[crs](x, y, m)


def between(source: str, target: str, x, y, m=F) -> list:
    """Coordinates in ``target`` of coordinates in ``source``."""
    return [x, y] if source == target else forward(target, *inverse(source, x, y, m), m)


def reproject(df: DataFrame, source: str, target: str, x: str = "px", y: str = "py") -> DataFrame:
    """Columns ``x`` and ``y`` of a table of points moved from one system to another."""
    px, py = between(source, target, F.col(x).cast("double"), F.col(y).cast("double"))
    return df.withColumns({x: px, y: py})


def reproject_ring(ring: Column, source: str, target: str) -> Column:
    """A ring's vertices moved from one system to another."""

    def moved(p: Column) -> Column:
        x, y = between(source, target, p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, moved)

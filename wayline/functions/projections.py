"""Projected coordinates by code: web Mercator, polar stereographic, Lambert conformal conic and the universal transverse Mercator zones.

All but the last are closed forms of the isometric latitude; the way back takes a fixed number of rounds. Columns are staged, in generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.functions import spatial as sp

#: First eccentricities of WGS84 and GRS80: fixed values.
WGS84, GRS80 = geo.E2**0.5, (2 / 298.257222101 - 1 / 298.257222101**2) ** 0.5
A = geo.SEMI_MAJOR


@dataclass(frozen=True)
class Polar:
    """Polar stereographic: by the scale at the pole, or by the parallel of true scale."""

    north: bool
    lon: float
    scale: float | None = None
    parallel: float | None = None
    east0: float = 0.0
    north0: float = 0.0


@dataclass(frozen=True)
class Conic:
    """Lambert's conformal conic with two standard parallels."""

    first: float
    second: float
    lat: float
    lon: float
    east0: float
    north0: float
    e: float = GRS80


#: Parameters by code: fixed values.
CODES: dict[int, Polar | Conic] = {
    2154: Conic(49.0, 44.0, 46.5, 3.0, 700_000.0, 6_600_000.0),
    3031: Polar(False, 0.0, parallel=-71.0),
    3032: Polar(False, 70.0, parallel=-71.0, east0=6_000_000.0, north0=6_000_000.0),
    3034: Conic(35.0, 65.0, 52.0, 10.0, 4_000_000.0, 2_800_000.0),
    3413: Polar(True, -45.0, parallel=70.0),
    5041: Polar(True, 0.0, scale=0.994, east0=2_000_000.0, north0=2_000_000.0),
    5042: Polar(False, 0.0, scale=0.994, east0=2_000_000.0, north0=2_000_000.0),
}
GEODETIC, MERCATOR = 4326, 3857
#: Rounds from isometric to geodetic latitude, each about 150 times nearer.
ROUNDS = 6


def _zone(code: int) -> tuple[int, bool] | None:
    """(zone, southern) of a UTM code."""
    return (code % 100, code // 100 == 327) if code // 100 in (326, 327) and 1 <= code % 100 <= 60 else None


def _t(lat: float, e: float) -> float:
    s = math.sin(math.radians(lat))
    return math.exp(-(math.asinh(math.tan(math.radians(lat))) - e * math.atanh(e * s)))


def _m(lat: float, e: float) -> float:
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - (e * s) ** 2)


def _polar_scale(p: Polar) -> float:
    """Radius for each unit of t."""
    if p.scale is not None:
        return 2 * A * p.scale / math.sqrt((1 + WGS84) ** (1 + WGS84) * (1 - WGS84) ** (1 - WGS84))
    return A * _m(abs(p.parallel), WGS84) / _t(abs(p.parallel), WGS84)


def _cone(c: Conic) -> tuple[float, float, float]:
    """(n, radius for each unit of t ** n, radius of the origin)."""
    t1, t2 = _t(c.first, c.e), _t(c.second, c.e)
    n = math.log(_m(c.first, c.e) / _m(c.second, c.e)) / math.log(t1 / t2)
    size = A * _m(c.first, c.e) / (n * t1**n)
    return n, size, size * _t(c.lat, c.e) ** n


def _turned(degrees: Column) -> Column:
    """Radians of an angle brought to [-180, 180)."""
    return F.radians(degrees - 360.0 * F.floor((degrees + 180.0) / 360.0))


def _known(code: int) -> None:
    if code not in (GEODETIC, MERCATOR, *CODES) and _zone(code) is None:
        raise ValueError(f"unknown code {code}")


def with_projected(df: DataFrame, g: str, output: str, code: int) -> DataFrame:
    """df with (east, north) in metres of a geodetic column (lat, lon, alt); missing where it is missing."""
    _known(code)
    lat, lon = F.col(f"{g}.lat"), F.col(f"{g}.lon")
    if code == GEODETIC:
        raise ValueError("the geodetic position is no projection")
    if zone := _zone(code):
        out = geo.with_utm(df, g, "__utm", F.lit(zone[0]))
        plain = F.col("__utm.north") - F.when(F.col("__utm.south"), geo.FALSE_NORTH).otherwise(0.0)
        made = F.struct(F.col("__utm.east").alias("east"), (plain + (geo.FALSE_NORTH if zone[1] else 0.0)).alias("north"))
        return out.withColumn(output, F.when(F.col("__utm").isNotNull(), made)).drop("__utm")
    if code == MERCATOR:
        made = F.struct((A * _turned(lon)).alias("east"), (A * F.asinh(F.tan(F.radians(lat)))).alias("north"))
        return df.withColumn(output, F.when(lat.isNotNull(), made))
    p = CODES[code]
    e = p.e if isinstance(p, Conic) else WGS84
    side = lat if isinstance(p, Conic) or p.north else -lat
    t = F.exp(F.lit(e) * F.atanh(F.lit(e) * F.sin(F.radians(side))) - F.asinh(F.tan(F.radians(side))))
    if isinstance(p, Polar):
        steps = {"__r": F.lit(_polar_scale(p)) * F.when(side == 90, 0.0).otherwise(t), "__w": _turned(lon - p.lon)}
        up = -F.cos("__w") if p.north else F.cos("__w")
        made = F.struct((p.east0 + F.col("__r") * F.sin("__w")).alias("east"), (p.north0 + F.col("__r") * up).alias("north"))
    else:
        n, size, origin = _cone(p)
        steps = {"__r": F.lit(size) * F.pow(t, F.lit(n)), "__w": F.lit(n) * _turned(lon - p.lon)}
        made = F.struct((p.east0 + F.col("__r") * F.sin("__w")).alias("east"), (p.north0 + origin - F.col("__r") * F.cos("__w")).alias("north"))
    return sp.staged(df, steps, {output: F.when(lat.isNotNull(), made)}).drop("__r", "__w")


def with_geodetic(df: DataFrame, u: str, output: str, code: int, alt: Column | None = None) -> DataFrame:
    """df with the geodetic position of a projected column (east, north)."""
    _known(code)
    east, north, high = F.col(f"{u}.east"), F.col(f"{u}.north"), F.lit(0.0) if alt is None else alt
    if zone := _zone(code):
        held = F.struct(east.alias("east"), (north - (geo.FALSE_NORTH if zone[1] else 0.0)).alias("north"), F.lit(zone[0]).alias("zone"), F.lit(False).alias("south"))
        return geo.with_lla_of_utm(df.withColumn("__utm", F.when(east.isNotNull(), held)), "__utm", output, alt).drop("__utm")
    if code == MERCATOR:
        return df.withColumn(output, F.when(east.isNotNull(), geo.lla(F.degrees(F.atan(F.sinh(north / A))), F.degrees(east / A), high)))
    p = CODES[code]
    e, flip = (p.e, 1.0) if isinstance(p, Conic) else (WGS84, 1.0 if p.north else -1.0)
    if isinstance(p, Polar):
        x, y = east - p.east0, (north - p.north0) * (-1.0 if p.north else 1.0)
        steps = [{"__t": F.sqrt(x * x + y * y) / F.lit(_polar_scale(p)), "__lon": F.degrees(F.atan2(x, y)) + p.lon}]
    else:
        n, size, origin = _cone(p)
        x, y = east - p.east0, F.lit(origin) - (north - p.north0)
        steps = [{"__t": F.pow(F.sqrt(x * x + y * y) / F.lit(size), F.lit(1 / n)), "__lon": F.degrees(F.atan2(x, y)) / F.lit(n) + p.lon}]
    psi = -F.ln(F.when(F.col("__t") > 0, F.col("__t")))
    steps += [{"__psi": psi}, {"__lat": F.atan(F.sinh("__psi"))}]
    steps += [{"__lat": F.atan(F.sinh(F.col("__psi") + F.lit(e) * F.atanh(F.lit(e) * F.sin("__lat"))))}] * ROUNDS
    lat = F.when(F.col("__t") == 0, 90.0).otherwise(F.degrees("__lat")) * flip
    return sp.staged(df, *steps, {output: F.when(east.isNotNull(), geo.lla(lat, F.col("__lon"), high))}).drop("__t", "__lon", "__psi", "__lat")


def transformed(df: DataFrame, column: str, source: int, target: int, output: str) -> DataFrame:
    """df with a position of one code in another: (lat, lon, alt) for the geodetic one, else (east, north)."""
    _known(source)
    _known(target)
    if source == target:
        return df.withColumn(output, F.col(column))
    if source == GEODETIC:
        return with_projected(df, column, output, target)
    if target == GEODETIC:
        return with_geodetic(df, column, output, source)
    return with_projected(with_geodetic(df, column, "__lla", source), "__lla", output, target).drop("__lla")

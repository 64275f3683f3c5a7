"""Geodetic positions on WGS84 and the direction to the sun, in closed forms.

Angles are degrees, heights metres above the ellipsoid; (lat, lon, alt) and (x, y, z) are structs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from wayline.functions import spatial as sp
from wayline.functions.ellipsoid import WGS84

#: WGS84: fixed values.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
SEMI_MINOR = SEMI_MAJOR * (1 - FLATTENING)


def lla(lat: Column, lon: Column, alt: Column) -> Column:
    """A position with its longitude in [-180, 180)."""
    wrapped = lon - 360.0 * F.floor((lon + 180.0) / 360.0)
    return F.struct(lat.cast("double").alias("lat"), wrapped.cast("double").alias("lon"), alt.cast("double").alias("alt"))


def to_ecef(g: Column) -> Column:
    lat, lon = F.radians(g["lat"]), F.radians(g["lon"])
    n = SEMI_MAJOR / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return sp.vector((n + g["alt"]) * F.cos(lat) * F.cos(lon), (n + g["alt"]) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + g["alt"]) * F.sin(lat))


def from_ecef(v: Column, rounds: int = 5) -> Column:
    """By fixed-point rounds on the latitude; five are good to far below a millimetre near the ground."""

    def solved(v: Column) -> Column:
        p = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])

        def closer(lat: Column) -> Column:
            s = F.sin(lat)
            return F.atan2(v["z"] + E2 * SEMI_MAJOR / F.sqrt(1 - E2 * s * s) * s, p)

        def done(lat: Column) -> Column:
            s = F.sin(lat)
            alt = p * F.cos(lat) + v["z"] * s - SEMI_MAJOR * F.sqrt(1 - E2 * s * s)
            return lla(F.degrees(lat), F.degrees(F.atan2(v["y"], v["x"])), alt)

        steps = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(v["z"], p * (1 - E2)), lambda lat, _: closer(lat))
        return sp.let(steps, done)

    return sp.let(v, solved)


def enu_basis(origin: Column) -> tuple[Column, Column, Column]:
    lat, lon = F.radians(origin["lat"]), F.radians(origin["lon"])
    east = sp.vector(-F.sin(lon), F.cos(lon), F.lit(0.0))
    north = sp.vector(-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat))
    up = sp.vector(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    return east, north, up


def ecef_to_enu(v: Column, origin: Column) -> Column:
    pair = F.struct(sp.vsub(v, to_ecef(origin)).alias("d"), origin.alias("o"))
    return sp.let(pair, lambda e: sp.vector(*(sp.vdot(b, e["d"]) for b in enu_basis(e["o"]))))


def enu_to_ecef(v: Column, origin: Column) -> Column:

    def moved(p: Column) -> Column:
        (e, n, u), v, o = enu_basis(p["o"]), p["v"], p["c"]
        return sp.vector(*(e[k] * v["x"] + n[k] * v["y"] + u[k] * v["z"] + o[k] for k in sp.VECTOR))

    return sp.let(F.struct(origin.alias("o"), v.alias("v"), to_ecef(origin).alias("c")), moved)


def to_enu(g: Column, origin: Column) -> Column:
    return ecef_to_enu(to_ecef(g), origin)


def local_distance(a: Column, b: Column, with_altitude: bool = False) -> Column:
    """Distance in the local tangent plane at a."""
    d = to_enu(b, a)
    flat = d["x"] * d["x"] + d["y"] * d["y"]
    return F.sqrt(flat + d["z"] * d["z"] if with_altitude else flat)


@pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("distance", "initial_bearing", "final_bearing")]))
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    """Distance and bearings on the ellipsoid, wherever the points are (see ``ellipsoid``).

    Bearings are missing where the points are the same, and where one is a pole (``initial_bearing`` and ``final_bearing`` make that an error).
    """
    a, b = lat1.to_numpy(float), lat2.to_numpy(float)
    distance, first, last = WGS84.inverse(a, lon1.to_numpy(float), b, lon2.to_numpy(float))
    some = (distance > 0) & ~_pole(a) & ~_pole(b)
    return pd.DataFrame({"distance": distance, "initial_bearing": np.where(some, first % 360, np.nan), "final_bearing": np.where(some, last % 360, np.nan)})


def _pole(lat: np.ndarray) -> np.ndarray:
    return np.isclose(np.abs(lat), 90.0)


def _bearing(way: Column, a: Column, b: Column, name: str) -> Column:
    at_pole = (F.abs(a["lat"]) >= 90 - 1e-3) | (F.abs(b["lat"]) >= 90 - 1e-3)  # what isclose means at 90
    fault = F.raise_error(F.lit("a bearing is ambiguous at a pole")).cast("double")
    return F.when(at_pole & (way["distance"] > 0), fault).otherwise(way[name])


def initial_bearing(a: Column, b: Column) -> Column:
    """Bearing at a of the geodesic to b, in [0, 360); missing where they are the same, an error where one is a pole."""
    return _bearing(geodesic(a["lat"], a["lon"], b["lat"], b["lon"]), a, b, "initial_bearing")


def final_bearing(a: Column, b: Column) -> Column:
    """Bearing at b of the geodesic from a; like ``initial_bearing``."""
    return _bearing(geodesic(a["lat"], a["lon"], b["lat"], b["lon"]), a, b, "final_bearing")


@pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("lat", "lon")]))
def geodesic_between(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series, share: pd.Series) -> pd.DataFrame:
    """The point at a share of the geodesic between two points; one inside a geodesic that begins or ends at a pole is an error."""
    a, o, b, p, k = (x.to_numpy(float) for x in (lat1, lon1, lat2, lon2, share))
    moved = ~(np.isclose(a, b) & np.isclose((p - o + 180) % 360 - 180, 0))
    if np.any((_pole(a) | _pole(b)) & moved & (k > 0) & (k < 1)):
        raise ValueError("a geodesic between a pole and another point is ambiguous")
    distance, first, _ = WGS84.inverse(a, o, b, p)
    lat, lon, _ = WGS84.direct(a, o, first, distance * k)
    return pd.DataFrame({"lat": lat, "lon": lon})


@pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("distance", "initial_bearing", "final_bearing")]))
def vincenty(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    """``geodesic`` by Vincenty's inverse method, for comparisons: within a tenth of a millimetre, and missing near the antipode, where it doesn't converge.

    Bearings are missing where the points are the same, and at the poles.
    """
    f, b = FLATTENING, SEMI_MINOR
    p1, p2 = np.radians(lat1.to_numpy(float)), np.radians(lat2.to_numpy(float))
    span = np.radians((lon2.to_numpy(float) - lon1.to_numpy(float) + 180) % 360 - 180)
    u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = span.copy()
    with np.errstate(all="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, cu1 * cu2 * sl / ss)
            c2 = 1 - sa * sa
            cm = np.where(c2 == 0, 0, cs - 2 * su1 * su2 / c2)
            c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
            new = span + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            done = np.abs(new - lam) < 1e-13
            lam = new
            if done.all():
                break
        k = c2 * (SEMI_MAJOR**2 - b**2) / b**2
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        d = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        distance = np.where(done, b * big * (sigma - d), np.nan)
        first = np.degrees(np.arctan2(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam))) % 360
        last = np.degrees(np.arctan2(cu1 * np.sin(lam), -su1 * cu2 + cu1 * su2 * np.cos(lam))) % 360
    some = done & (distance > 0)
    pole1, pole2 = np.abs(np.abs(lat1) - 90) < 1e-12, np.abs(np.abs(lat2) - 90) < 1e-12
    return pd.DataFrame({"distance": distance, "initial_bearing": np.where(some & ~pole1, first, np.nan), "final_bearing": np.where(some & ~pole2, last, np.nan)})


def sun_direction(seconds: Column, lat: Column, lon: Column) -> Column:
    """(altitude, azimuth) of the sun in degrees at seconds since 1970 UTC, by the low-precision almanac series (about 0.01 degrees; no refraction)."""
    n = seconds / 86400.0 - 10957.5  # days since noon of 2000-01-01
    mean = F.radians((280.460 + 0.9856474 * n) % 360)
    anomaly = F.radians((357.528 + 0.9856003 * n) % 360)
    ecliptic = mean + F.radians(1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(23.439 - 0.0000004 * n)
    right = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.radians((280.46061837 + 360.98564736629 * n) % 360) + F.radians(lon)
    hour, p = sidereal - right, F.radians(lat)
    altitude = F.asin(F.sin(p) * F.sin(declination) + F.cos(p) * F.cos(declination) * F.cos(hour))
    azimuth = F.atan2(-F.cos(declination) * F.sin(hour), F.sin(declination) * F.cos(p) - F.cos(declination) * F.cos(hour) * F.sin(p))
    return F.struct(F.degrees(altitude).alias("altitude"), F.pmod(F.degrees(azimuth) + 360.0, F.lit(360.0)).alias("azimuth"))


def direction_vector(d: Column) -> Column:
    """Unit vector (east, north, up) of an (altitude, azimuth)."""
    a, z = F.radians(d["altitude"]), F.radians(d["azimuth"])
    return sp.vector(F.cos(a) * F.sin(z), F.cos(a) * F.cos(z), F.sin(a))


@pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("lat", "lon")]))
def geodesic_point(lat: pd.Series, lon: pd.Series, bearing: pd.Series, distance: pd.Series) -> pd.DataFrame:
    """The point at a distance and initial bearing."""
    there, east, _ = WGS84.direct(*(x.to_numpy(float) for x in (lat, lon, bearing, distance)))
    return pd.DataFrame({"lat": there, "lon": east})


# the universal transverse Mercator projection, by Krueger's series in the third flattening

N = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
#: Coefficients of the series, forward and back, to the fourth order in the third flattening: fixed values.
FORWARD = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BACK = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)


def utm_zone(lon: Column) -> Column:
    """Zone of a longitude in [-180, 180); the exceptions of Norway and Svalbard are not made."""
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def with_utm(df: DataFrame, g: str, output: str, zone: Column | None = None) -> DataFrame:
    """df with (east, north, zone, south) of a geodetic column, in metres; good to well below a millimetre within its zone, staged."""
    lat, e = F.radians(F.col(f"{g}.lat")), E2**0.5
    steps = [
        {"__zone": utm_zone(F.col(f"{g}.lon")) if zone is None else zone.cast("int"), "__s": F.sin(lat)},
        {"__l": F.radians(F.col(f"{g}.lon") - (F.col("__zone") * 6 - 183)), "__c": F.sinh(F.atanh(F.col("__s")) - e * F.atanh(e * F.col("__s")))},
        {"__x": F.atan2(F.col("__c"), F.cos("__l")), "__y": F.atanh(F.sin("__l") / F.sqrt(1 + F.col("__c") * F.col("__c")))},
    ]
    east, north = F.col("__y"), F.col("__x")
    for j, a in enumerate(FORWARD, 1):
        east = east + a * F.cos(2 * j * F.col("__x")) * F.sinh(2 * j * F.col("__y"))
        north = north + a * F.sin(2 * j * F.col("__x")) * F.cosh(2 * j * F.col("__y"))
    south = F.col(f"{g}.lat") < 0
    made = F.struct(
        (FALSE_EAST + SCALE * RECTIFYING * east).alias("east"),
        (SCALE * RECTIFYING * north + F.when(south, FALSE_NORTH).otherwise(0.0)).alias("north"),
        F.col("__zone").alias("zone"),
        south.alias("south"),
    )
    return sp.staged(df, *steps, {output: F.when(F.col(f"{g}.lat").isNotNull(), made)}).drop("__zone", "__s", "__l", "__c", "__x", "__y")


def with_lla_of_utm(df: DataFrame, u: str, output: str, alt: Column | None = None) -> DataFrame:
    """df with the geodetic position of a UTM column (east, north, zone, south), staged."""
    xi = (F.col(f"{u}.north") - F.when(F.col(f"{u}.south"), FALSE_NORTH).otherwise(0.0)) / (SCALE * RECTIFYING)
    steps = [{"__x": xi, "__y": (F.col(f"{u}.east") - FALSE_EAST) / (SCALE * RECTIFYING)}]
    east, north = F.col("__y"), F.col("__x")
    for j, b in enumerate(BACK, 1):
        east = east - b * F.cos(2 * j * F.col("__x")) * F.sinh(2 * j * F.col("__y"))
        north = north - b * F.sin(2 * j * F.col("__x")) * F.cosh(2 * j * F.col("__y"))
    steps.append({"__x1": north, "__y1": east})
    t = F.sin("__x1") / F.sqrt(F.sinh("__y1") * F.sinh("__y1") + F.cos("__x1") * F.cos("__x1"))
    steps.append({"__t": t, "__lat": F.atan(t)})
    e = E2**0.5
    for _ in range(5):  # conformal to geodetic latitude: rounds gain about a factor of 150 each
        s = F.sin("__lat")
        steps.append({"__lat": F.atan(F.sinh(F.asinh(F.col("__t")) + e * F.atanh(e * s)))})
    lon = F.degrees(F.atan2(F.sinh("__y1"), F.cos("__x1"))) + (F.col(f"{u}.zone") * 6 - 183)
    done = F.when(F.col(f"{u}.east").isNotNull(), lla(F.degrees("__lat"), lon, F.lit(0.0) if alt is None else alt))
    return sp.staged(df, *steps, {output: done}).drop("__x", "__y", "__x1", "__y1", "__t", "__lat")

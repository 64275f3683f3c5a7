"""The sun's apparent direction to about an arc second, in plain columns.

The earth's heliocentric place is a truncated planetary series; then come light time and aberration, nutation, leap seconds, sidereal time and
the observer's parallax on the ellipsoid. There is no refraction. The earth's rotation is UTC but for ``dut1``, which moves the direction by
up to fifteen arc seconds a second where it isn't given. Good between 1972 and 2050; before 1972 the offset of 1972 is taken, and after the last leap second its own.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.functions import spatial as sp

#: Series of the earth's longitude, latitude (1e-8 radians) and distance (1e-8 astronomical units), by powers of the time in thousands of
#: years: amplitude, phase, frequency of each cosine, down to an amplitude of 100 for the longitude. Fixed values.
LONGITUDE = (
    (
        (175347046, 0, 0), (3341656, 4.6692568, 6283.07585), (34894, 4.6261, 12566.1517), (3497, 2.7441, 5753.3849), (3418, 2.8289, 3.5231),
        (3136, 3.6277, 77713.7715), (2676, 4.4181, 7860.4194), (2343, 6.1352, 3930.2097), (1324, 0.7425, 11506.7698), (1273, 2.0371, 529.691),
        (1199, 1.1096, 1577.3435), (990, 5.233, 5884.927), (902, 2.045, 26.298), (857, 3.508, 398.149), (780, 1.179, 5223.694),
        (753, 2.533, 5507.553), (505, 4.583, 18849.228), (492, 4.205, 775.523), (357, 2.92, 0.067), (317, 5.849, 11790.629),
        (284, 1.899, 796.298), (271, 0.315, 10977.079), (243, 0.345, 5486.778), (206, 4.806, 2544.314), (205, 1.869, 5573.143),
        (202, 2.458, 6069.777), (156, 0.833, 213.299), (132, 3.411, 2942.463), (126, 1.083, 20.775), (115, 0.645, 0.98),
        (103, 0.636, 4694.003), (102, 0.976, 15720.839), (102, 4.267, 7.114),
    ),
    ((628331966747, 0, 0), (206059, 2.678235, 6283.07585), (4303, 2.6351, 12566.1517), (425, 1.59, 3.523), (119, 5.796, 26.298), (109, 2.966, 1577.344)),
    ((52919, 0, 0), (8720, 1.0721, 6283.0758), (309, 0.867, 12566.152)),
    ((289, 5.844, 6283.076),),
)
LATITUDE = (((280, 3.199, 84334.662), (102, 5.422, 5507.553), (80, 3.88, 5223.69), (44, 3.7, 2352.87), (32, 4, 1577.34)),)
DISTANCE = (
    (
        (100013989, 0, 0), (1670700, 3.0984635, 6283.07585), (13956, 3.05525, 12566.1517), (3084, 5.1985, 77713.7715), (1628, 1.1739, 5753.3849),
        (1576, 2.8469, 7860.4194), (925, 5.453, 11506.77), (542, 4.564, 3930.21), (472, 3.661, 5884.927), (346, 0.964, 5507.553),
        (329, 5.9, 5223.694), (307, 0.299, 5573.143),
    ),
    ((103019, 1.10749, 6283.07585), (1721, 1.0644, 12566.1517)),
    ((4359, 5.7846, 6283.0758),),
)
#: Arguments of the nutation in degrees, as polynomials of the time in centuries: the moon's node, mean elongation, the sun's and the moon's anomaly,
#: the moon's argument of latitude. Then its terms: multiples of these, and arc seconds of longitude (sine) and obliquity (cosine). Fixed values.
ARGUMENTS = {"o": (125.04452, -1934.136261), "d": (297.85036, 445267.11148), "m": (357.52772, 35999.05034), "a": (134.96298, 477198.867398), "f": (93.27191, 483202.017538)}
NUTATION = (
    ("o", -17.1996, 9.2025), ("2f-2d+2o", -1.3187, 0.5736), ("2f+2o", -0.2274, 0.0977), ("2o", 0.2062, -0.0895), ("m", 0.1426, 0.0054),
    ("a", 0.0712, -0.0007), ("m+2f-2d+2o", -0.0517, 0.0224), ("2f+o", -0.0386, 0.02), ("a+2f+2o", -0.0301, 0.0129), ("2f-2d+2o-m", 0.0217, -0.0095),
)
#: Days on which a leap second was in force, from the tenth on: fixed values.
LEAPS = (
    "1972-01-01", "1972-07-01", "1973-01-01", "1974-01-01", "1975-01-01", "1976-01-01", "1977-01-01", "1978-01-01", "1979-01-01", "1980-01-01",
    "1981-07-01", "1982-07-01", "1983-07-01", "1985-07-01", "1988-01-01", "1990-01-01", "1991-01-01", "1992-07-01", "1993-07-01", "1994-07-01",
    "1996-01-01", "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01",
)
#: Seconds between atomic and terrestrial time; light's aberration, the change of equinox between catalogues, in arc seconds; metres of an astronomical unit.
ATOMIC, ABERRATION, EQUINOX, UNIT = 32.184, 20.4898, 0.09033, 149_597_870_700.0
NAMES = ("altitude", "azimuth", "right_ascension", "declination", "distance")


def terrestrial(seconds: Column) -> Column:
    """Seconds by which terrestrial time is ahead of UTC, at seconds since 1970."""
    days = F.array(*(F.unix_date(F.lit(d).cast("date")) for d in LEAPS))
    passed = F.aggregate(days, F.lit(0), lambda n, d: n + (seconds >= d * 86400).cast("int"))
    return F.greatest(passed, F.lit(1)) + (9 + ATOMIC)


def multiples(term: str) -> list[tuple[int, str]]:
    """Multiples of the arguments in a term such as ``2f-2d+o``."""
    found = []
    for part in term.replace("-", "+-").split("+"):
        digits = part[:-1]
        found.append((int(digits + "1" if digits in ("", "-") else digits), part[-1]))
    return found


def _series(parts: tuple, t: Column) -> Column:
    return reduce(add, (reduce(add, (F.lit(float(a)) * F.cos(b + c * t) for a, b, c in terms)) * (F.lit(1.0) if k == 0 else F.pow(t, F.lit(k))) for k, terms in enumerate(parts))) * 1e-8


def with_sun(df: DataFrame, seconds: Column, g: str, output: str, dut1: Column | float = 0.0) -> DataFrame:
    """df with the sun as seen from a geodetic column at seconds since 1970 UTC, staged.

    altitude and azimuth (from north by east) of the observer, degrees; right ascension and declination from the earth's centre, of the date, degrees;
    distance from the earth's centre, astronomical units. Null where the time or the place is.
    """
    arc = lambda x: F.radians(x / 3600.0)
    t, c, s = F.col("__t"), F.col("__c"), F.sin
    turn = {k: F.radians(F.lit(a) + F.lit(b) * c) for k, (a, b) in ARGUMENTS.items()}
    terms = [(reduce(add, (n * F.col(f"__{k}") for n, k in multiples(term))), psi, eps) for term, psi, eps in NUTATION]
    place = F.radians(F.col(f"{g}.lat"))
    n = geo.SEMI_MAJOR / F.sqrt(1 - geo.E2 * s(F.col("__p")) * s(F.col("__p")))
    steps = [
        {"__u": seconds.cast("double"), "__p": place},
        {"__n": F.col("__u") / 86400.0 - 10957.5, "__tt": terrestrial(F.col("__u"))},
        {"__t": (F.col("__n") + F.col("__tt") / 86400.0) / 365250.0, "__c": (F.col("__n") + F.col("__tt") / 86400.0) / 36525.0},
        {"__l": _series(LONGITUDE, t), "__b": -_series(LATITUDE, t), "__r": _series(DISTANCE, t), **{f"__{k}": x for k, x in turn.items()}},
        {"__psi": arc(reduce(add, (F.lit(p) * F.sin(x) for x, p, _ in terms))), "__eps": arc(reduce(add, (F.lit(e) * F.cos(x) for x, _, e in terms)) + F.lit(84381.448) - 46.815 * c - 0.00059 * c * c)},
        {"__l": F.col("__l") + F.pi() + F.col("__psi") - arc(ABERRATION / F.col("__r") + EQUINOX)},
        {
            "__ra": F.atan2(s("__l") * F.cos("__eps") - F.tan("__b") * s("__eps"), F.cos("__l")),
            "__de": F.asin(s("__b") * F.cos("__eps") + F.cos("__b") * s("__eps") * s("__l")),
            "__st": F.radians((280.46061837 + 360.98564736629 * (F.col("__n") + (dut1 if isinstance(dut1, Column) else F.lit(dut1)) / 86400.0)) % 360.0 + 0.000387933 * c * c) + F.col("__psi") * F.cos("__eps"),
        },
        {"__h": F.col("__st") + F.radians(F.col(f"{g}.lon")) - F.col("__ra"), "__nn": n},
        {
            "__x": F.col("__r") * F.cos("__de") * F.cos("__h") - (F.col("__nn") + F.col(f"{g}.alt")) * F.cos("__p") / UNIT,
            "__y": -F.col("__r") * F.cos("__de") * s("__h"),
            "__z": F.col("__r") * s("__de") - (F.col("__nn") * (1 - geo.E2) + F.col(f"{g}.alt")) * s("__p") / UNIT,
        },
        {"__up": F.col("__x") * F.cos("__p") + F.col("__z") * s("__p"), "__no": F.col("__z") * F.cos("__p") - F.col("__x") * s("__p")},
    ]
    altitude = F.degrees(F.atan2(F.col("__up"), F.hypot("__y", "__no")))
    found = [altitude, F.pmod(F.degrees(F.atan2("__y", "__no")) + 360.0, F.lit(360.0)), F.pmod(F.degrees("__ra") + 360.0, F.lit(360.0)), F.degrees("__de"), F.col("__r")]
    there = altitude.isNotNull()
    made = F.when(there, F.struct(*(x.alias(k) for k, x in zip(NAMES, found, strict=True))))
    out = sp.staged(df, *steps, {output: made})
    return out.drop(*{k for step in steps for k in step})

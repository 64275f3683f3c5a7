"""The sun as it is seen, to an arc second; ``tests/test_sun.py`` holds the series to published places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import geo, sun
from wayline.plans.catalog import query
from wayline.plans.q_space import PLACES, _places


def _sum(parts: tuple) -> str:
    return "(" + " + ".join(f"({' + '.join(f'{a} * cos({b} + {c} * t)' for a, b, c in terms)}) * t ** {k}" for k, terms in enumerate(parts)) + ") / 100000000"


def _nutation(f: str, at: int) -> str:
    return " + ".join(f"{term[at]} * {f}({' + '.join(f'{n} * q{k}' for n, k in sun.multiples(term[0]))})" for term in sun.NUTATION)


PASSED = " + ".join(f"CAST(u >= epoch(TIMESTAMP '{d} 00:00:00') AS INT)" for d in sun.LEAPS)
TURNS = ", ".join(f"radians({a} + {b} * c) AS q{k}" for k, (a, b) in sun.ARGUMENTS.items())
APPARENT = f"""i AS (SELECT user_id, seq, t + 1704067200 AS u, radians(lat) AS p, lon, 250 AS alt FROM g),
j AS (SELECT *, u / 86400 - 10957.5 AS n, greatest({PASSED}, 1) + 41.184 AS tt FROM i),
k AS (SELECT *, (n + tt / 86400) / 365250 AS t, (n + tt / 86400) / 36525 AS c FROM j),
l AS (SELECT *, {_sum(sun.LONGITUDE)} AS heliocentric, -{_sum(sun.LATITUDE)} AS be, {_sum(sun.DISTANCE)} AS r, {TURNS} FROM k),
m AS (SELECT *, radians(({_nutation('sin', 1)}) / 3600) AS psi, radians((84381.448 - 46.815 * c - 0.00059 * c * c + {_nutation('cos', 2)}) / 3600) AS eps FROM l),
o AS (SELECT *, heliocentric + pi() + psi - radians((20.4898 / r + 0.09033) / 3600) AS el FROM m),
p AS (SELECT *, atan2(sin(el) * cos(eps) - tan(be) * sin(eps), cos(el)) AS ra, asin(sin(be) * cos(eps) + cos(be) * sin(eps) * sin(el)) AS de,
  radians((280.46061837::DOUBLE + 360.98564736629::DOUBLE * n) % 360 + 0.000387933 * c * c) + psi * cos(eps) + radians(lon) AS st, {geo.SEMI_MAJOR!r}::DOUBLE / sqrt(1 - {geo.E2!r}::DOUBLE * sin(p) ** 2) AS nn FROM o),
q AS (SELECT *, r * cos(de) * cos(st - ra) - (nn + alt) * cos(p) / 149597870700 AS x, -r * cos(de) * sin(st - ra) AS y, r * sin(de) - (nn * (1 - {geo.E2!r}::DOUBLE) + alt) * sin(p) / 149597870700 AS z FROM p),
s AS (SELECT *, x * cos(p) + z * sin(p) AS up, z * cos(p) - x * sin(p) AS north FROM q)"""


@query(f"""WITH {{e}}, {PLACES}, {APPARENT}
SELECT user_id, seq, round(degrees(atan2(up, sqrt(y ** 2 + north ** 2))), 4) AS altitude, round((degrees(atan2(y, north)) + 360) % 360, 4) AS azimuth,
  round((degrees(ra) + 360) % 360, 4) AS right_ascension, round(degrees(de), 4) AS declination, round(r, 6) AS distance FROM s""")
def sun_apparent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _places(spark, sf_dir).withColumn("g", geo.lla(F.col("g.lat"), F.col("g.lon"), F.lit(250.0)))
    df = sun.with_sun(df, F.col("t") + 1_704_067_200, "g", "s").select("user_id", "seq", "s.*")
    return df.select("user_id", "seq", *(F.round(c, 6 if c == "distance" else 4).alias(c) for c in sun.NAMES))

"""Projections against published pairs, and back again."""

import pytest
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.functions import projections as pj

#: Published examples (code, latitude, longitude, east, north): fixed values.
PAIRS = [
    (3857, 24 + 22 / 60 + 54.433 / 3600, -(100 + 20 / 60), -11169055.58, 2800000.00),
    (5041, 73.0, 44.0, 3320416.75, 632668.43),
    (3032, -75.0, 120.0, 7255380.79, 7053389.56),
    (2154, 46.5, 3.0, 700000.0, 6600000.0),
    (3034, 52.0, 10.0, 4000000.0, 2800000.0),
    (32631, 0.0, 3.0, 500000.0, 0.0),
    (32731, 0.0, 3.0, 500000.0, 10000000.0),
]


@pytest.mark.parametrize("code, lat, lon, east, north", PAIRS)
def test_published_pairs(spark, code, lat, lon, east, north):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double").withColumn("g", geo.lla(F.col("lat"), F.col("lon"), F.lit(0.0)))
    got = pj.with_projected(df, "g", "u", code).first().u
    assert got.east == pytest.approx(east, abs=0.011) and got.north == pytest.approx(north, abs=0.011)


@pytest.mark.parametrize("code", [3857, 32633, 32733, *pj.CODES])
def test_there_and_back(spark, code):
    south = code in (3031, 3032, 5042, 32733)
    polar = isinstance(pj.CODES.get(code), pj.Polar)
    rows = [((-1 if south else 1) * (lat + (40 if polar else 0)), lon) for lat in (0.5, 20.0, 45.0, 49.9) for lon in ((-179.0, -60.0, 0.0, 33.3, 120.0) if polar or code == 3857 else (9.0, 12.0, 16.5))]
    df = spark.createDataFrame([*rows, (None, None)], "lat double, lon double")
    df = df.withColumn("g", F.when(F.col("lat").isNotNull(), geo.lla(F.col("lat"), F.col("lon"), F.lit(0.0))))
    back = pj.with_geodetic(pj.with_projected(df, "g", "u", code), "u", "b", code).collect()
    assert all((r.b is None and r.u is None) if r.lat is None else (abs(r.b.lat - r.lat) < 1e-9 and abs((r.b.lon - r.lon + 180) % 360 - 180) < 1e-9) for r in back)


def test_poles_and_unknown_codes(spark):
    df = spark.createDataFrame([(90.0, 10.0)], "lat double, lon double").withColumn("g", geo.lla(F.col("lat"), F.col("lon"), F.lit(0.0)))
    r = pj.with_geodetic(pj.with_projected(df, "g", "u", 3413), "u", "b", 3413).first()
    assert (r.u.east, r.u.north, r.b.lat) == (0.0, 0.0, 90.0)
    with pytest.raises(ValueError, match="unknown code"):
        pj.with_projected(df, "g", "u", 32661)
    both = pj.transformed(pj.with_projected(df.withColumn("g", geo.lla(F.lit(50.0), F.lit(11.0), F.lit(0.0))), "g", "u", 3034), "u", 3034, 3857, "m").first().m
    assert both.east == pytest.approx(1224514.3987, abs=1e-3)

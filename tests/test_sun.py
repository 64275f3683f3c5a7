"""The sun against published places."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayline.functions import geo, sun

UTC = dt.timezone.utc


def seen(spark, at, lat, lon, alt=0.0, dut1=0.0):
    df = spark.createDataFrame([(at.timestamp(), lat, lon, alt)], "u double, lat double, lon double, alt double").withColumn("g", geo.lla(F.col("lat"), F.col("lon"), F.col("alt")))
    return sun.with_sun(df, F.col("u"), "g", "s", dut1).first().s


def test_published_example_of_the_solar_position_algorithm(spark):
    """Golden, Colorado, 17 October 2003, 12:30:30 at UTC-7; the example's own terrestrial time is 67 seconds ahead, here it is 64.184."""
    s = seen(spark, dt.datetime(2003, 10, 17, 19, 30, 30, tzinfo=UTC), 39.742476, -105.1786, 1830.14)
    assert s.right_ascension == pytest.approx(202.22741, abs=4e-4) and s.declination == pytest.approx(-9.31434, abs=4e-4)
    assert s.altitude == pytest.approx(39.872046, abs=4e-4) and s.azimuth == pytest.approx(194.340241, abs=4e-4)
    assert s.distance == pytest.approx(0.9965422974, abs=2e-5)


def test_published_apparent_place(spark):
    """13 October 1992, 0h terrestrial time: 13h 13m 30.749s, -7 degrees 47' 01.74"."""
    at = dt.datetime(1992, 10, 13, tzinfo=UTC) - dt.timedelta(seconds=27 + 32.184)
    s = seen(spark, at, 0.0, 0.0)
    assert s.right_ascension == pytest.approx((13 + 13 / 60 + 30.749 / 3600) * 15, abs=2e-4)
    assert s.declination == pytest.approx(-(7 + 47 / 60 + 1.74 / 3600), abs=2e-4)
    assert s.distance == pytest.approx(0.99760853, abs=2e-5)


@pytest.mark.parametrize("at, lam", [((2024, 3, 20, 3, 6), 0), ((2024, 6, 20, 20, 51), 90), ((2024, 9, 22, 12, 44), 180), ((2024, 12, 21, 9, 20), 270)])
def test_published_seasons(spark, at, lam):
    """Equinoxes and solstices are published to the minute: within one, the longitude moves by 0.0007 degrees."""
    s = seen(spark, dt.datetime(*at, tzinfo=UTC), 0.0, 0.0)
    off = abs((s.right_ascension - lam + 180) % 360 - 180)
    assert off < 0.0009


def test_terrestrial_time(spark):
    got = {}
    for day, ahead in (("1960-01-01", 42.184), ("1972-06-30", 42.184), ("1972-07-01", 43.184), ("2016-12-31", 68.184), ("2017-01-01", 69.184), ("2040-01-01", 69.184)):
        u = dt.datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp()
        got[day] = (spark.range(1).select(sun.terrestrial(F.lit(u))).first()[0], ahead)
    assert all(a == pytest.approx(b, abs=1e-9) for a, b in got.values())


def test_missing_times_and_places_and_the_turn_of_the_earth(spark):
    df = spark.createDataFrame([(None, 1.0), (0.0, None), (0.0, 1.0)], "u double, lat double").withColumn("g", geo.lla(F.col("lat"), F.lit(0.0), F.lit(0.0)))
    assert [r.s is None for r in sun.with_sun(df, F.col("u"), "g", "s").collect()] == [True, True, False]
    a, b = (seen(spark, dt.datetime(2024, 1, 1, 12, tzinfo=UTC), 0.0, 0.0, dut1=d) for d in (0.0, 0.5))
    assert b.right_ascension == a.right_ascension and abs(b.altitude - a.altitude) < 0.5 * 15 / 3600

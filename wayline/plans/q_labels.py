"""Labelled vectors and matrices, read from a snapshot of their columns; projections by code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import labels as lb
from wayline.functions import projections as pj
from wayline.plans.catalog import lanes, query, rounded
from wayline.plans.q_motion import _places
from wayline.sources import shared

XYZ, ZXY, AB = lb.Axis("part", ("x", "y", "z")), lb.Axis("part", ("z", "x", "y")), lb.Axis("row", ("a", "b"))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vectors of permuted labels and a matrix, written and read again with their axes."""
    v, t = F.col("value"), F.col("t") / 86_400
    df = lanes(spark, sf_dir).df.select("user_id", "seq", F.array(v, v * 2, t).alias("p"), F.array(t * 3, v + 1, F.lit(7.0)).alias("q"), F.array(F.array(v, F.lit(1.0), t), F.array(F.lit(2.0), -v, F.lit(0.5))).alias("m"))
    df = lb.set_axes(lb.set_axes(lb.set_axes(df, "p", XYZ), "q", ZXY), "m", AB, ZXY)
    at = shared.folder(spark, "labelled")
    df.write.parquet(at)
    return spark.read.parquet(at)


@query("WITH {e} SELECT user_id, seq, round(2 * value + 1, 4) AS x, round(2 * value + 7, 4) AS y, round(4 * t / 86400, 4) AS z FROM e")
def labels_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p is (x, y, z), q is (z, x, y)."""
    df = lb.add(_arrays(spark, sf_dir), "p", "q", "s")
    for c in "xyz":
        df = lb.pick(df, "s", c, part=c)
    return rounded(df.select("user_id", "seq", "x", "y", "z"), 4)


@query("""WITH {e}, d AS (SELECT *, t / 86400 AS t1 FROM e)
SELECT user_id, seq, round(value * t1 + value + t1 * 2 * value, 3) AS a, round(2 * t1 - value * value + value, 3) AS b, round(sqrt((value * t1 + value + t1 * 2 * value) ** 2 + (2 * t1 - value * value + value) ** 2), 3) AS size FROM d""")
def labels_matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix's columns are (z, x, y), the vector is (x, y, z)."""
    df = lb.matmul(_arrays(spark, sf_dir), "m", "p", "r")
    df = lb.norm(df, "r", "size")
    for c in "ab":
        df = lb.pick(df, "r", c, row=c)
    return rounded(df.select("user_id", "seq", "a", "b", "size"), 3)


# projections: formulas of the textbook in SQL, with tangents of half angles

E1 = "0.08181919084262149::DOUBLE"
HALF = "tan(pi() / 4 - {p} / 2) / pow((1 - {e} * sin({p})) / (1 + {e} * sin({p})), {e} / 2)"
POLE = f"2 * 6378137.0::DOUBLE * 0.994::DOUBLE / sqrt(pow(1 + {E1}, 1 + {E1}) * pow(1 - {E1}, 1 - {E1})) * ({HALF.format(p='p', e=E1)})"


@query(f"""WITH {{e}}, g AS (SELECT user_id, seq, radians(least(value, 80)) AS p, t / 20000 - 60 AS lon FROM e), r AS (SELECT *, {POLE} AS r FROM g)
SELECT user_id, seq, round(6378137.0::DOUBLE * radians(lon), 2) AS x, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + p / 2)), 2) AS y,
  round(2000000 + r * sin(radians(lon)), 2) AS east, round(2000000 - r * cos(radians(lon)), 2) AS north FROM r""")
def to_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web Mercator and the northern polar stereographic grid."""
    df = pj.with_projected(pj.with_projected(_places(spark, sf_dir), "g", "m", 3857), "g", "u", 5041)
    return rounded(df.select("user_id", "seq", F.col("m.east").alias("x"), F.col("m.north").alias("y"), "u.east", "u.north"), 2)


@query("WITH {e} SELECT user_id, seq, round(least(value, 80), 7) AS lat, round(t / 20000 - 60, 7) AS lon FROM e")
def crs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the European conic, from there to the northern polar grid, and back to places."""
    df = pj.with_projected(_places(spark, sf_dir), "g", "c", 3034)
    df = pj.with_geodetic(pj.transformed(df, "c", 3034, 3413, "n"), "n", "back", 3413)
    return rounded(df.select("user_id", "seq", "back.lat", "back.lon"), 7)

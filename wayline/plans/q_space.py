"""Kinematics, rotations, poses, frames and geodesy, on poses made from the lanes' values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions import geo
from wayline.functions import spatial as sp
from wayline.operators import frames as fr
from wayline.operators import kinematics as kn
from wayline.plans.catalog import lanes, query, rounded

W = "WINDOW p AS (PARTITION BY user_id ORDER BY seq)"


def _hours(spark: SparkSession, sf_dir: str) -> LaneFrame:
    f = lanes(spark, sf_dir)
    return f.over(f.df.withColumn("t", F.col("t") / 3600.0))


HOURS = "h AS (SELECT user_id, seq, t / 3600 AS t, value FROM e)"


@query(f"""WITH {{e}}, {HOURS}, d AS (SELECT *, (value - lag(value) OVER p) / (t - lag(t) OVER p) AS d FROM h {W})
SELECT user_id, seq, round(coalesce(d, lead(d) OVER p), 6) AS value FROM d {W}""")
def derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kn.differentiate(_hours(spark, sf_dir)).df.select("user_id", "seq", "value"))


@query(f"""WITH {{e}}, {HOURS}, d AS (SELECT *, 0.5::DOUBLE * (value + lag(value) OVER p) * (t - lag(t) OVER p) AS d FROM h {W})
SELECT user_id, seq, round(1 + coalesce(sum(d) OVER (PARTITION BY user_id ORDER BY seq), 0), 5) AS value FROM d""")
def trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kn.integrate(_hours(spark, sf_dir), initial=1.0).df.select("user_id", "seq", "value"), 5)


@query(f"""WITH {{e}}, {HOURS},
d AS (SELECT *, t - lag(t) OVER p AS h1, lead(t) OVER p - t AS h2, lag(t) OVER p - lag(t, 2) OVER p AS h0, lag(value) OVER p AS vb, lag(value, 2) OVER p AS vbb, lead(value) OVER p AS va FROM h {W}),
s AS (SELECT *, CASE WHEN seq > 0 AND (seq - 1) % 2 = 0 AND h2 IS NOT NULL
    THEN h1 / 6 * ((3 - h1 / (h1 + h2)) * vb + (3 + h1 * h1 / ((h1 + h2) * h2) + h1 / (h1 + h2)) * value - h1 * h1 / ((h1 + h2) * h2) * va)
    ELSE h1 / 6 * ((3 - h1 / (h1 + h0)) * value + (3 + h1 * h1 / ((h1 + h0) * h0) + h1 / (h1 + h0)) * vb - h1 * h1 / ((h1 + h0) * h0) * vbb) END AS d FROM d)
SELECT user_id, seq, round(coalesce(sum(d) OVER (PARTITION BY user_id ORDER BY seq), 0) / 1000, 5) AS value FROM s""")
def simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kn.integrate(_hours(spark, sf_dir), "cumulative_simpson").df
    return rounded(out.select("user_id", "seq", (F.col("value") / 1000).alias("value")), 5)


@query("WITH {e} SELECT user_id, seq, round(avg(value) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS value FROM e")
def smooth_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kn.smooth(lanes(spark, sf_dir)).df.select("user_id", "seq", "value"))


@query(f"""WITH {{e}}, {HOURS}, x AS (SELECT a.user_id, a.seq, b.value, exp(-0.5::DOUBLE * ((b.t - a.t) / 12) ** 2) AS w FROM h AS a JOIN h AS b ON a.user_id = b.user_id AND abs(b.seq - a.seq) <= 1)
SELECT user_id, seq, round(sum(w * value) / sum(w), 6) AS value FROM x GROUP BY user_id, seq""")
def smooth_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kn.smooth(_hours(spark, sf_dir), "gaussian", window=3, sigma=12.0).df.select("user_id", "seq", "value"))


@query(f"""WITH {{e}}, {HOURS}, x AS (SELECT a.user_id, a.seq, b.value AS v, b.t - a.t AS d FROM h AS a JOIN h AS b ON a.user_id = b.user_id AND abs(b.seq - a.seq) <= 2),
s AS (SELECT user_id, seq, count(*) AS n, sum(d) AS s1, sum(d ** 2) AS s2, sum(d ** 3) AS s3, sum(d ** 4) AS s4, sum(v) AS y0, sum(v * d) AS y1, sum(v * d ** 2) AS y2 FROM x GROUP BY user_id, seq)
SELECT user_id, seq, CASE WHEN n >= 3 THEN round((y0 * (s2 * s4 - s3 ** 2) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / (n * (s2 * s4 - s3 ** 2) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 ** 2)), 3) END AS value FROM s""")
def smooth_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL solves the normal equations of each window."""
    return rounded(kn.smooth(_hours(spark, sf_dir), "local_polynomial", window=5, poly_order=2).df.select("user_id", "seq", "value"), 3)


def _poses(spark: SparkSession, sf_dir: str) -> LaneFrame:
    """A pose per sample: position from clock and value, a turn about z by the value."""
    f = lanes(spark, sf_dir)
    p = sp.vector(F.col("t") / 86_400, F.col("value"), F.lit(1.0))
    return f.with_fields(pose=sp.pose(p, sp.yaw(F.col("value") / 50))).select("pose")


def _xyz(v: Column, name: str) -> list[Column]:
    return [v[c].alias(f"{name}_{c}") for c in "xyz"]


@query("WITH {e} SELECT user_id, seq, round(cos(value / 50) * value - sin(value / 50) * 2, 6) AS v_x, round(sin(value / 50) * value + cos(value / 50) * 2, 6) AS v_y, 3.0::DOUBLE AS v_z FROM e")
def rot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lanes(spark, sf_dir).df
    v = sp.rotate(sp.yaw(F.col("value") / 50), sp.vector(F.col("value"), F.lit(2.0), F.lit(3.0)))
    return rounded(df.select("user_id", "seq", *_xyz(v, "v")))


@query("WITH {e} SELECT user_id, seq, round(abs(sin((value / 50 + t / 1000000) / 2)), 6) AS s, round(abs(cos((value / 50 + t / 1000000) / 2)), 6) AS c FROM e")
def rot_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = sp.rotation_compose(sp.yaw(F.col("value") / 50), sp.yaw(F.col("t") / 1_000_000))
    return rounded(lanes(spark, sf_dir).df.select("user_id", "seq", F.abs(q["z"]).alias("s"), F.abs(q["w"]).alias("c")))


@query("WITH {e} SELECT user_id, seq, round(2 * atan2(abs(sin(value / 100)), abs(cos(value / 100))), 6) AS angle FROM e")
def rot_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir).df.select("user_id", "seq", sp.angle(sp.yaw(F.col("value") / 50)).alias("angle")))


@query("WITH {e} SELECT user_id, seq, round(sin(0.1 + 0.3::DOUBLE * (least(value, 100) / 100)), 6) AS s, round(cos(0.1 + 0.3::DOUBLE * (least(value, 100) / 100)), 6) AS c FROM e")
def rot_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = sp.slerp(sp.yaw(F.lit(0.2)), sp.yaw(F.lit(0.8)), F.least(F.col("value"), F.lit(100.0)) / 100)
    return rounded(lanes(spark, sf_dir).df.select("user_id", "seq", q["z"].alias("s"), q["w"].alias("c")))


@query("""
WITH {e}, s AS (SELECT user_id, sum(sin(value / 100) ** 2) AS ss, sum(cos(value / 100) ** 2) AS cc, sum(sin(value / 100) * cos(value / 100)) AS sc FROM e GROUP BY user_id)
SELECT user_id, round(0.5::DOUBLE * atan2(2 * sc, cc - ss), 4) AS half_angle FROM s""")
def rot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean turn about one axis: its half angle has a closed form."""
    f = lanes(spark, sf_dir).df.withColumn("q", sp.yaw(F.col("value") / 50))
    return rounded(sp.rotation_mean(f, ["user_id"], "q").select("user_id", F.atan2("mean.z", "mean.w").alias("half_angle")), 4)


C, S = "cos(value / 50)", "sin(value / 50)"


@query(f"WITH {{e}} SELECT user_id, seq, round({C} * 1 - {S} * 2 + t / 86400, 6) AS v_x, round({S} * 1 + {C} * 2 + value, 6) AS v_y, 4.0::DOUBLE AS v_z FROM e")
def pose_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _poses(spark, sf_dir)
    v = sp.pose_apply(F.col("pose"), sp.vector(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return rounded(f.df.select("user_id", "seq", *_xyz(v, "v")))


@query(f"WITH {{e}} SELECT user_id, seq, round(-({C} * t / 86400 + {S} * value), 6) AS p_x, round(-(-{S} * t / 86400 + {C} * value), 6) AS p_y, -1.0::DOUBLE AS p_z FROM e")
def pose_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sp.pose_inverse(F.col("pose"))["p"]
    return rounded(_poses(spark, sf_dir).df.select("user_id", "seq", *_xyz(v, "p")))


@query(f"WITH {{e}} SELECT user_id, seq, round({C} * t / 86400 - {S} * value + t / 86400, 6) AS p_x, round({S} * t / 86400 + {C} * value + value, 6) AS p_y, 2.0::DOUBLE AS p_z FROM e")
def pose_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sp.pose_compose(F.col("pose"), F.col("pose"))["p"]
    return rounded(_poses(spark, sf_dir).df.select("user_id", "seq", *_xyz(v, "p")))


def _graph(f: LaneFrame) -> fr.FrameGraph:
    """world <- ship (moves) <- camera (fixed), world <- base (fixed)."""
    fixed = sp.pose(sp.vector(F.lit(0.0), F.lit(0.0), F.lit(2.0)), sp.yaw(F.lit(0.0)))
    base = sp.pose(sp.vector(F.lit(10.0), F.lit(0.0), F.lit(0.0)), sp.yaw(F.lit(0.0)))
    g = fr.FrameGraph()
    g.bind("world", "ship", f)
    g.bind("ship", "camera", fixed)
    g.bind("world", "base", base)
    return g


@query(f"WITH {{e}} SELECT user_id, seq, round({C} * 1 - {S} * 2 + t / 86400 - 10, 6) AS v_x, round({S} * 1 + {C} * 2 + value, 6) AS v_y, 6.0::DOUBLE AS v_z FROM e")
def to_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _poses(spark, sf_dir)
    rows = f.with_fields(point=sp.vector(F.lit(1.0), F.lit(2.0), F.lit(3.0))).select("point")
    out = fr.to_frame(_graph(f), rows, "point", "camera", "base")
    return rounded(out.df.select("user_id", "seq", *_xyz(F.col("point"), "v")))


@query(f"WITH {{e}} SELECT user_id, seq, round({C} * 1 - {S} * 2, 6) AS v_x, round({S} * 1 + {C} * 2, 6) AS v_y, 3.0::DOUBLE AS v_z FROM e")
def express_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _poses(spark, sf_dir)
    rows = f.with_fields(point=sp.vector(F.lit(1.0), F.lit(2.0), F.lit(3.0))).select("point")
    out = fr.express_in(_graph(f), rows, "point", "camera", "base")
    return rounded(out.df.select("user_id", "seq", *_xyz(F.col("point"), "v")))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lanes(spark, sf_dir).df
    return df.withColumn("g", geo.lla(F.least(F.col("value"), F.lit(80.0)), F.col("t") / 20_000 - 60, F.lit(100.0)))


NORMAL = "6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sin(radians(least(value, 80))) ** 2)"


@query(f"""WITH {{e}}, n AS (SELECT *, {NORMAL} AS n, radians(least(value, 80)) AS lat, radians(t / 20000 - 60) AS lon FROM e)
SELECT user_id, seq, round((n + 100) * cos(lat) * cos(lon) / 1000, 4) AS p_x, round((n + 100) * cos(lat) * sin(lon) / 1000, 4) AS p_y, round((n * (1 - 0.0066943799901413165::DOUBLE) + 100) * sin(lat) / 1000, 4) AS p_z FROM n""")
def lla_to_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_places(spark, sf_dir).select("user_id", "seq", *(x.alias(n) for x, n in zip((geo.to_ecef(F.col("g"))[c] / 1000 for c in "xyz"), ("p_x", "p_y", "p_z"), strict=True))), 4)


@query("WITH {e} SELECT user_id, seq, round(least(value, 80), 6) AS lat, round(t / 20000 - 60, 6) AS lon, 100.0::DOUBLE AS alt FROM e")
def ecef_to_lla(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = geo.from_ecef(geo.to_ecef(F.col("g")))
    df = _places(spark, sf_dir).select("user_id", "seq", back.alias("b")).select("user_id", "seq", "b.lat", "b.lon", F.round("b.alt", 3).alias("alt"))
    return rounded(df)


@query("WITH {e} SELECT user_id, seq, round(value, 3) AS x, 5.0::DOUBLE AS y, -2.0::DOUBLE AS z FROM e")
def enu_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sp.vector(F.col("value"), F.lit(5.0), F.lit(-2.0))
    df = _places(spark, sf_dir).withColumn("v", geo.ecef_to_enu(geo.enu_to_ecef(v, F.col("g")), F.col("g")))
    return rounded(df.select("user_id", "seq", "v.x", "v.y", "v.z"), 3)


PLACES = "g AS (SELECT user_id, seq, t, least(value, 80) AS lat, t / 20000 - 60 AS lon FROM e)"
F1, B1 = geo.FLATTENING, geo.SEMI_MINOR
STEP = """lateral (SELECT sin({l}) AS sl, cos({l}) AS cl) AS p{i}, lateral (SELECT sqrt((cu2 * p{i}.sl) ** 2 + (cu1 * su2 - su1 * cu2 * p{i}.cl) ** 2) AS ss, su1 * su2 + cu1 * cu2 * p{i}.cl AS cs) AS q{i},
lateral (SELECT atan2(q{i}.ss, q{i}.cs) AS sigma, cu1 * cu2 * p{i}.sl / q{i}.ss AS sa) AS r{i}, lateral (SELECT 1 - r{i}.sa ** 2 AS c2) AS s{i}, lateral (SELECT q{i}.cs - 2 * su1 * su2 / s{i}.c2 AS cm) AS t{i}"""


def _vincenty(rounds: int = 5) -> str:
    """Vincenty's inverse method with a fixed number of rounds, to (40, 10)."""
    parts, at = [], "span"
    for i in range(rounds):
        parts.append(STEP.format(l=at, i=i))
        c = f"({F1!r}::DOUBLE / 16 * s{i}.c2 * (4 + {F1!r}::DOUBLE * (4 - 3 * s{i}.c2)))"
        parts.append(f"lateral (SELECT span + (1 - {c}) * {F1!r}::DOUBLE * r{i}.sa * (r{i}.sigma + {c} * q{i}.ss * (t{i}.cm + {c} * q{i}.cs * (2 * t{i}.cm ** 2 - 1))) AS l) AS u{i}")
        at = f"u{i}.l"
    z = rounds - 1
    ratio = (geo.SEMI_MAJOR**2 - B1**2) / B1**2
    return f"""WITH {{e}}, {PLACES}, w AS (SELECT *, atan((1 - {F1!r}::DOUBLE) * tan(radians(lat))) AS u1, atan((1 - {F1!r}::DOUBLE) * tan(radians(40))) AS u2, radians(10 - lon) AS span FROM g),
y AS (SELECT *, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2 FROM w),
d AS (SELECT user_id, seq, y.*, {at} AS l, q{z}.ss AS ss, q{z}.cs AS cs, r{z}.sigma AS sigma, t{z}.cm AS cm, s{z}.c2 * {ratio!r}::DOUBLE AS k FROM y, {', '.join(parts)}),
n AS (SELECT *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS big, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS small FROM d)
SELECT user_id, seq, round({B1!r}::DOUBLE * big * (sigma - small * ss * (cm + small / 4 * (cs * (2 * cm ** 2 - 1) - small / 6 * cm * (4 * ss ** 2 - 3) * (4 * cm ** 2 - 3)))), 3) AS distance,
  round((degrees(atan2(cu2 * sin(l), cu1 * su2 - su1 * cu2 * cos(l))) + 360) % 360, 3) AS initial_bearing, round((degrees(atan2(cu1 * sin(l), -su1 * cu2 + cu1 * su2 * cos(l))) + 360) % 360, 3) AS final_bearing FROM n"""


@query(_vincenty())
def geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vincenty's method, as in the SQL; ``geodesic_meridian`` and ``geodesic_antipode`` try the exact one."""
    df = _places(spark, sf_dir).select("user_id", "seq", geo.vincenty(F.col("g.lat"), F.col("g.lon"), F.lit(40.0), F.lit(10.0)).alias("d"))
    return rounded(df.select("user_id", "seq", "d.*"), 3)


@query(f"""WITH {{e}}, {PLACES}, n AS (SELECT *, (t + 1704067200) / 86400 - 10957.5 AS n FROM g),
a AS (SELECT *, radians((280.460 + 0.9856474 * n) % 360) AS mean, radians((357.528 + 0.9856003 * n) % 360) AS an FROM n),
l AS (SELECT *, mean + radians(1.915 * sin(an) + 0.020 * sin(2 * an)) AS el, radians(23.439 - 0.0000004 * n) AS tilt FROM a),
q AS (SELECT *, asin(sin(tilt) * sin(el)) AS de, radians((280.46061837::DOUBLE + 360.98564736629::DOUBLE * n) % 360) + radians(lon) - atan2(cos(tilt) * sin(el), cos(el)) AS h, radians(lat) AS p FROM l)
SELECT user_id, seq, round(degrees(asin(sin(p) * sin(de) + cos(p) * cos(de) * cos(h))), 4) AS altitude,
  round((degrees(atan2(-cos(de) * sin(h), sin(de) * cos(p) - cos(de) * cos(h) * sin(p))) + 360) % 360, 4) AS azimuth FROM q""")
def sun(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _places(spark, sf_dir).select("user_id", "seq", geo.sun_direction(F.col("t") + 1_704_067_200, F.col("g.lat"), F.col("g.lon")).alias("s"))
    return rounded(df.select("user_id", "seq", "s.*"), 4)

"""Kinematics of vectors and six-vectors, turns about any axis, rotations and places on a clock, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions import geo
from wayline.functions import motion as mo
from wayline.functions import spatial as sp
from wayline.operators import asof
from wayline.operators import frames as fr
from wayline.operators import kinematics as kn
from wayline.operators import places
from wayline.plans.catalog import lanes, query, rounded
from wayline.plans.q_clock import BRACKET, GRID, LINEAR
from wayline.plans.q_space import HOURS, W


def _hours(spark: SparkSession, sf_dir: str) -> LaneFrame:
    f = lanes(spark, sf_dir)
    return f.over(f.df.withColumn("t", F.col("t") / 3600.0))


def _vectors(spark: SparkSession, sf_dir: str, kind: str) -> LaneFrame:
    f = _hours(spark, sf_dir)
    v = F.col("value")
    return f.with_fields(v=sp.vector(v, v * v / 100, F.col("t"))).select("v").retag(kind=kind)


def _parts(v: Column, names: str = "xyz") -> list[Column]:
    return [v[c].alias(n) for c, n in zip("xyz", names, strict=True)]


def _slope(x: str) -> str:
    return f"({x} - lag({x}) OVER p) / (t - lag(t) OVER p)"


@query(f"""WITH {{e}}, {HOURS}, v AS (SELECT *, value * value / 100 AS y FROM h),
d AS (SELECT user_id, seq, {_slope('value')} AS x, {_slope('y')} AS y, CASE WHEN lag(t) OVER p IS NOT NULL THEN 1.0::DOUBLE END AS z FROM v {W})
SELECT user_id, seq, round(coalesce(x, lead(x) OVER p), 4) AS x, round(coalesce(y, lead(y) OVER p), 4) AS y, round(coalesce(z, lead(z) OVER p), 4) AS z FROM d {W}""")
def vel_differentiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions become linear velocities."""
    out = kn.differentiate(_vectors(spark, sf_dir, "position"))
    assert out.attrs["kind"] == "linear_velocity"
    return rounded(out.df.select("user_id", "seq", *_parts(F.col("v"))), 4)


def _running(x: str) -> str:
    return f"0.5::DOUBLE * ({x} + lag({x}) OVER p) * (t - lag(t) OVER p)"


@query(f"""WITH {{e}}, {HOURS}, v AS (SELECT *, value * value / 100 AS y FROM h), d AS (SELECT user_id, seq, {_running('value')} AS x, {_running('y')} AS y FROM v {W})
SELECT user_id, seq, round(2 + coalesce(sum(x) OVER q, 0), 4) AS x, round(2 + coalesce(sum(y) OVER q, 0), 4) AS y FROM d WINDOW q AS (PARTITION BY user_id ORDER BY seq)""")
def acc_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear accelerations become velocities."""
    out = kn.integrate(_vectors(spark, sf_dir, "linear_acceleration"), initial=2.0)
    assert out.attrs["kind"] == "linear_velocity"
    return rounded(out.df.select("user_id", "seq", F.col("v.x").alias("x"), F.col("v.y").alias("y")), 4)


def _six(spark: SparkSession, sf_dir: str, kind: str) -> LaneFrame:
    f = _hours(spark, sf_dir)
    v = F.col("value")
    six = F.array(v, v + 1, v * 2, -v, v / 2, F.lit(3.0))
    return f.with_fields(m=mo.from_vector6(six)).select("m").retag(kind=kind)


def _around(x: str) -> str:
    return f"round(avg({x}) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6)"


@query(f"WITH {{e}} SELECT user_id, seq, {_around('value')} AS vx, {_around('value + 1')} AS vy, {_around('value * 2')} AS vz, {_around('-value')} AS wx, {_around('value / 2')} AS wy, 3.0::DOUBLE AS wz FROM e")
def vel6_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kn.smooth(_six(spark, sf_dir, "velocity"))
    six = mo.as_vector6(F.col("m"))
    return rounded(out.df.withColumn("six", six).select("user_id", "seq", *(F.get("six", F.lit(i)).alias(n) for i, n in enumerate(mo.LABELS))))


@query(f"""WITH {{e}}, {HOURS}, d AS (SELECT user_id, seq, {_slope('value')} AS d FROM h {W}), s AS (SELECT user_id, seq, coalesce(d, lead(d) OVER p) AS d FROM d {W})
SELECT user_id, seq, round(d, 4) AS vx, round(-d, 4) AS wx, round(d / 2, 4) AS wy, round(sqrt(d * d + d * d + 4 * d * d), 4) AS size FROM s""")
def vel6_differentiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities of both parts become accelerations."""
    out = kn.differentiate(_six(spark, sf_dir, "velocity"))
    assert out.attrs["kind"] == "acceleration"
    m = F.col("m")
    return rounded(out.df.select("user_id", "seq", m["linear"]["x"].alias("vx"), m["angular"]["x"].alias("wx"), m["angular"]["y"].alias("wy"), mo.norm(mo.linear(m)).alias("size")), 4)


@query(f"""WITH {{e}}, {HOURS}, d AS (SELECT user_id, seq, t, {_slope('value')} AS d FROM h {W}), s AS (SELECT user_id, seq, t, coalesce(d, lead(d) OVER p) AS d FROM d {W}),
x AS (SELECT user_id, seq, {_slope('d')} AS d FROM s {W}) SELECT user_id, seq, round(coalesce(d, lead(d) OVER p), 2) AS value FROM x {W}""")
def derivative_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kn.differentiate(_hours(spark, sf_dir), order=2).df.select("user_id", "seq", "value"), 2)


# turns about the axis (1, 2, 2) / 3

AXIS = (1 / 3, 2 / 3, 2 / 3)


def _tilted(theta: Column) -> Column:
    return sp.axis_angle(sp.vector(*(F.lit(x) for x in AXIS)), theta)


def _turned(c: str, s: str, v: tuple[str, str, str]) -> list[str]:
    """Rodrigues' formula in SQL."""
    k = ("(1.0::DOUBLE / 3)", "(2.0::DOUBLE / 3)", "(2.0::DOUBLE / 3)")
    dot = f"({k[0]} * {v[0]} + {k[1]} * {v[1]} + {k[2]} * {v[2]})"
    cross = [f"({k[1]} * {v[2]} - {k[2]} * {v[1]})", f"({k[2]} * {v[0]} - {k[0]} * {v[2]})", f"({k[0]} * {v[1]} - {k[1]} * {v[0]})"]
    return [f"{v[i]} * {c} + {cross[i]} * {s} + {k[i]} * {dot} * (1 - {c})" for i in range(3)]


X, Y, Z = _turned("cos(value / 50)", "sin(value / 50)", ("value", "2", "3"))


@query(f"WITH {{e}} SELECT user_id, seq, round({X}, 6) AS x, round({Y}, 6) AS y, round({Z}, 6) AS z FROM e")
def rot_any_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lanes(spark, sf_dir).df
    return rounded(df.select("user_id", "seq", *_parts(sp.rotate(_tilted(F.col("value") / 50), sp.vector(F.col("value"), F.lit(2.0), F.lit(3.0))))))


@query(f"""WITH {{e}} SELECT user_id, seq, round({X}, 6) AS x, round({Y}, 6) AS y, round({Z}, 6) AS z FROM e""")
def rot_matrix_any_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same turn by way of a matrix and back to a quaternion."""
    df = lanes(spark, sf_dir).df.withColumn("q0", _tilted(F.col("value") / 50))
    df = sp.staged(df, {"m": sp.to_matrix(F.col("q0"))}, {"q": sp.from_matrix(F.col("m"))})
    return rounded(df.select("user_id", "seq", *_parts(sp.rotate(F.col("q"), sp.vector(F.col("value"), F.lit(2.0), F.lit(3.0))))))


@query("""WITH {e}, h AS (SELECT user_id, seq, sin(value / 100) AS s, cos(value / 100) AS c, sin(t / 2000000) AS sz, cos(t / 2000000) AS cz FROM e)
SELECT user_id, seq, round(cz * s / 3 - sz * s * 2 / 3, 6) AS x, round(cz * s * 2 / 3 + sz * s / 3, 6) AS y, round(cz * s * 2 / 3 + sz * c, 6) AS z, round(cz * c - sz * s * 2 / 3, 6) AS w FROM h""")
def rot_compose_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First the tilted turn, then one about z, with the signs of all components."""
    q = sp.rotation_compose(_tilted(F.col("value") / 50), sp.yaw(F.col("t") / 1_000_000))
    return rounded(lanes(spark, sf_dir).df.select("user_id", "seq", *(q[c].alias(c) for c in sp.QUATERNION)))


ANGLES = "least(value, 100) / 100"
TURNED = LINEAR.replace("lv", f"({ANGLES.replace('value', 'lv')})").replace("rv", f"({ANGLES.replace('value', 'rv')})")


@query(f"WITH {{e}}, {BRACKET}, r AS (SELECT user_id, seq, q, {TURNED} AS a FROM b) SELECT user_id, seq, round(q, 6) AS t, round(sin(a / 2) * 2 / 3, 6) AS y, round(cos(a / 2), 6) AS w FROM r")
def rot_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns about one tilted axis on another clock: slerp blends their angles."""
    f = lanes(spark, sf_dir)
    f = f.with_fields(r=_tilted(F.least(F.col("value"), F.lit(100.0)) / 100)).select("r")
    out = fr.resampled_rotations(f, "r", asof.grid_for(f, GRID))
    return rounded(out.df.select("user_id", "seq", "t", F.col("r.y").alias("y"), F.col("r.w").alias("w")))


@query(f"""WITH {{e}}, {BRACKET}, r AS (SELECT user_id, seq, q, {TURNED} AS a, {LINEAR} AS v FROM b)
SELECT user_id, seq, round(q, 6) AS t, round(v, 6) AS p_x, round(sin(a / 2) * 2 / 3, 6) AS y, round(cos(a / 2), 6) AS w FROM r""")
def pose_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    p = sp.pose(sp.vector(F.col("value"), F.lit(1.0), F.lit(2.0)), _tilted(F.least(F.col("value"), F.lit(100.0)) / 100))
    out = fr.resampled_poses(f.with_fields(pose=p).select("pose"), "pose", asof.grid_for(f, GRID))
    return rounded(out.df.select("user_id", "seq", "t", F.col("pose.p.x").alias("p_x"), F.col("pose.q.y").alias("y"), F.col("pose.q.w").alias("w")))


@query(f"WITH {{e}} SELECT user_id, seq, round({X.replace('value / 50', '-value / 50')}, 6) AS x, round({Y.replace('value / 50', '-value / 50')}, 6) AS y FROM e")
def rot_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of the world in the basis of a turning frame: rotations alone along the path."""
    f = lanes(spark, sf_dir)
    turns = f.with_fields(rotation=_tilted(F.col("value") / 50)).select("rotation")
    g = fr.FrameGraph()
    g.bind("world", "body", turns)
    df = fr.with_rotation_path(g, f.select("value"), "world", "body")
    v = sp.rotate(F.col("rotation"), sp.vector(F.col("value"), F.lit(2.0), F.lit(3.0)))
    return rounded(df.select("user_id", "seq", v["x"].alias("x"), v["y"].alias("y")))


CV, SV = "cos(value / 50)", "sin(value / 50)"


@query(f"""WITH {{e}} SELECT user_id, seq, round({CV} * value - {SV} * 2 + t / 86400, 6) AS vx, round({SV} * value + {CV} * 2 - 1, 6) AS vy, round({CV} * 1, 6) AS wx, round({SV} * 1 + 0.5, 6) AS wy FROM e""")
def motion_to_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A velocity of both parts in the world: turned, with the moving frame's own motion added; the fixed step adds none."""
    f = lanes(spark, sf_dir)
    zero = sp.vector(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    turning = f.with_fields(pose=sp.pose(zero, sp.yaw(F.col("value") / 50))).select("pose")
    g = fr.FrameGraph()
    g.bind("world", "ship", turning)
    g.bind("ship", "camera", sp.pose(sp.vector(F.lit(0.0), F.lit(0.0), F.lit(2.0)), sp.yaw(F.lit(0.0))))
    g.set_motion_class("camera", "static")
    own = mo.motion(sp.vector(F.col("t") / 86_400, F.lit(-1.0), F.lit(0.0)), sp.vector(F.lit(0.0), F.lit(0.5), F.lit(0.0)))
    rows = f.with_fields(m=mo.motion(sp.vector(F.col("value"), F.lit(2.0), F.lit(0.0)), sp.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0)))).select("m")
    out = fr.couple_motion(g, rows, "m", "camera", "world", lambda step: own, pair=True)
    m = F.col("m")
    return rounded(out.df.select("user_id", "seq", m["linear"]["x"].alias("vx"), m["linear"]["y"].alias("vy"), m["angular"]["x"].alias("wx"), m["angular"]["y"].alias("wy")))


# places on a clock, and projections


@query(f"WITH {{e}}, {BRACKET}, r AS (SELECT user_id, seq, q, {LINEAR.replace('lv', '(lt / 20000 - 60)').replace('rv', '(rt / 20000 - 60)')} AS lon, {LINEAR} AS alt FROM b) SELECT user_id, seq, round(q, 6) AS t, round(lon, 5) AS lon, round(alt, 5) AS alt FROM r")
def place_geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along the equator, which is a geodesic: its longitude is blended."""
    f = lanes(spark, sf_dir)
    f = f.with_fields(g=geo.lla(F.lit(0.0), F.col("t") / 20_000 - 60, F.col("value"))).select("g")
    out = places.resample_to(f, "g", asof.grid_for(f, GRID))
    return rounded(out.df.select("user_id", "seq", "t", F.col("g.lon").alias("lon"), F.col("g.alt").alias("alt")), 5)


@query(f"""WITH {{e}}, {BRACKET}, r AS (SELECT user_id, seq, q,
  {LINEAR.replace('lv', '((6378137 + lv) * cos(radians(lt / 20000 - 60)))').replace('rv', '((6378137 + rv) * cos(radians(rt / 20000 - 60)))')} AS x,
  {LINEAR.replace('lv', '((6378137 + lv) * sin(radians(lt / 20000 - 60)))').replace('rv', '((6378137 + rv) * sin(radians(rt / 20000 - 60)))')} AS y FROM b)
SELECT user_id, seq, round(q, 6) AS t, round(degrees(atan2(y, x)), 5) AS lon, round(sqrt(x * x + y * y) - 6378137, 2) AS alt FROM r""")
def place_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along the straight line through the Earth."""
    f = lanes(spark, sf_dir)
    f = f.with_fields(g=geo.lla(F.lit(0.0), F.col("t") / 20_000 - 60, F.col("value"))).select("g")
    out = places.resample_to(f, "g", asof.grid_for(f, GRID), "ecef_linear")
    return out.df.select("user_id", "seq", F.round("t", 6).alias("t"), F.round("g.lon", 5).alias("lon"), F.round("g.alt", 2).alias("alt"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes(spark, sf_dir).df.withColumn("g", geo.lla(F.least(F.col("value"), F.lit(80.0)), F.col("t") / 20_000 - 60, F.lit(100.0)))


def _series(f: str, g: str) -> str:
    return " + ".join(f"{a!r}::DOUBLE * {f}(2 * {j} * x) * {g}(2 * {j} * y)" for j, a in enumerate(geo.FORWARD, 1))


@query(f"""WITH {{e}}, p AS (SELECT user_id, seq, radians(least(value, 80)) AS lat, t / 20000 - 60 AS lon FROM e),
z AS (SELECT *, floor((lon + 180) / 6) + 1 AS zone, sinh(atanh(sin(lat)) - {geo.E2**0.5!r}::DOUBLE * atanh({geo.E2**0.5!r}::DOUBLE * sin(lat))) AS c FROM p),
l AS (SELECT *, radians(lon - (zone * 6 - 183)) AS l FROM z), x AS (SELECT *, atan2(c, cos(l)) AS x, atanh(sin(l) / sqrt(1 + c * c)) AS y FROM l)
SELECT user_id, seq, CAST(zone AS INT) AS zone, round(500000 + 0.9996::DOUBLE * {geo.RECTIFYING!r}::DOUBLE * (y + {_series('cos', 'sinh')}), 1) AS east,
  round(0.9996::DOUBLE * {geo.RECTIFYING!r}::DOUBLE * (x + {_series('sin', 'cosh')}), 1) AS north FROM x""")
def to_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = geo.with_utm(_places(spark, sf_dir), "g", "u")
    return rounded(df.select("user_id", "seq", "u.zone", "u.east", "u.north"), 1)


@query("WITH {e} SELECT user_id, seq, round(least(value, 80), 7) AS lat, round(t / 20000 - 60, 7) AS lon FROM e")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = geo.with_lla_of_utm(geo.with_utm(_places(spark, sf_dir), "g", "u"), "u", "back")
    return rounded(df.select("user_id", "seq", "back.lat", "back.lon"), 7)

"""Clocks of instants, slices by lane, tolerances, folds, and lanes cut into ranges.

The twins named ``_ts`` work on the timestamps of ``events`` themselves and share the SQL of their numeric namesakes; clock values are told
in seconds since the start of 2024 on both sides.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions import geo
from wayline.functions.clocks import Clock
from wayline.operators import asof, folds, places, scan
from wayline.operators import events as ev
from wayline.operators import frames as fr
from wayline.operators import kinematics as kn
from wayline.plans import kernels, q_clock, q_events, q_motion, q_space
from wayline.plans.catalog import EPOCH, ORACLE_SQL, lanes, query, rounded, table
from wayline.plans.q_clock import BOTH, TWO, UNION

START = datetime.datetime(2024, 1, 1)
HOUR = datetime.timedelta(hours=1)


def ts_lanes(spark: SparkSession, sf_dir: str, zoned: bool = False, *more: str) -> LaneFrame:
    """Samples of ``events`` on their own timestamps; zoned: as TIMESTAMP instead of TIMESTAMP_NTZ."""
    df = scan.spread(table(spark, sf_dir, "events"), ["user_id"])
    df = df.withColumn("ts", F.col("ts").cast("timestamp" if zoned else "timestamp_ntz"))
    return LaneFrame.of(df, ["user_id"], "ts", ["value", *more], order=["event_id"])


def _seconds(df: DataFrame, column: str) -> Column:
    return (Clock.of(df, column).ticks(F.col(column)) - F.lit(EPOCH)).cast("double") / 1_000_000.0


def _told(df: DataFrame, **names: str) -> DataFrame:
    """Clock columns in seconds under other names."""
    return rounded(df.withColumns({c: _seconds(df, c) for c in names}).withColumnsRenamed(names))


def _grid(f: LaneFrame) -> DataFrame:
    return asof.grid_for(f, [START + k * 12 * HOUR for k in range(q_clock.POINTS)]).withColumnRenamed("ts", "q")


def twin(of: str):
    """Register a query with the SQL of another one."""
    return query(ORACLE_SQL[of])


@twin("param_index")
def param_index_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts_lanes(spark, sf_dir)
    return _told(asof.index(f, _grid(f), "q"), q="q")


@twin("param_sel_point")
def param_sel_point_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts_lanes(spark, sf_dir, True)
    return _told(asof.select_points(f, _grid(f), "q"), q="q")


@twin("param_sel_slice")
def param_sel_slice_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts_lanes(spark, sf_dir)
    lo, hi = (START + datetime.timedelta(seconds=s) for s in (200_000, 900_000))
    return _told(asof.select_range(f, lo, hi).df, ts="t")


@twin("param_at_linear")
def param_at_linear_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts_lanes(spark, sf_dir)
    return _told(asof.at(f, _grid(f), "q"), q="q")


@twin("param_at_nearest")
def param_at_nearest_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts_lanes(spark, sf_dir, True)
    return _told(asof.at(f, _grid(f), "q", "nearest"), q="q")


@twin("resample_grid")
def resample_grid_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts_lanes(spark, sf_dir, True)
    return _told(asof.resample_to(f, [str(START + k * 12 * HOUR) for k in range(q_clock.POINTS)]).df, ts="t")


def _dates(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    """A clock of dates, on which samples of a day coincide."""
    f = ts_lanes(spark, sf_dir)
    f = f.over(f.df.withColumn("ts", F.col("ts").cast("date")))
    q = asof.grid_for(f, [(START + k * 24 * HOUR).date() for k in range(31)]).select("user_id", F.col("ts").alias("q"))
    found = asof.at(f, q, "q", duplicates=policy)
    return rounded(found.withColumn("q", F.datediff("q", F.lit(START.date())).cast("double")))


@twin("param_dup_invalid")
def param_dup_invalid_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, "invalid")


@twin("param_dup_left")
def param_dup_left_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, "left")


@twin("param_dup_right")
def param_dup_right_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, "right")


def _two(spark: SparkSession, sf_dir: str) -> tuple[LaneFrame, LaneFrame]:
    df = ts_lanes(spark, sf_dir, False, "event_type").df
    hours = df.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")).groupBy("user_id", "ts", "event_type").agg(F.avg("value").alias("value"))
    return tuple(LaneFrame.of(hours.where(F.col("event_type") == kind).withColumnRenamed("value", name), ["user_id"], "ts", [name]) for kind, name in (("view", "a"), ("click", "b")))


def _synced(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    out = asof.synchronized(_two(spark, sf_dir), **options).df.select("user_id", "seq", "ts", "a", "b")
    return rounded(out.select("user_id", "seq", (_seconds(out, "ts") / 3600).alias("t"), "a", "b"))


@twin("sync_outer")
def sync_outer_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir, join="outer")


@twin("sync_inner")
def sync_inner_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir, join="inner")


@twin("sync_domain")
def sync_domain_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir, join="domain")


@twin("sync_fill")
def sync_fill_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir, join="left", how="fill", tol=5 * HOUR, fill=-1.0)


@twin("interp_like")
def interp_like_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    out = asof.interp_like(a, b).df
    return rounded(out.select("user_id", "seq", (_seconds(out, "ts") / 3600).alias("t"), "a"))


@twin("around_segments")
def around_segments_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts_lanes(spark, sf_dir)
    anchors = ev.pick(ev.events(f, q_events.high()), f.keys, "enter")
    out = ev.around(f, anchors, ev.tau_grid(2 * HOUR, 2 * HOUR, HOUR))
    tau = Clock.of(f.df, "ts").offset_ticks(F.col("tau")).cast("double") / 1_000_000
    return rounded(out.select("user_id", "event", tau.alias("tau"), _seconds(out, "event_time").alias("event_time"), "value"))


def _per_hour(f: LaneFrame) -> LaneFrame:
    """Rates on clocks of instants are per second; the SQL's are per hour."""
    return f.map_fields(lambda x: x * 3600)


@twin("derivative")
def derivative_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_per_hour(kn.differentiate(ts_lanes(spark, sf_dir))).df.select("user_id", "seq", "value"))


@twin("trapezoid")
def trapezoid_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kn.integrate(ts_lanes(spark, sf_dir, True)).map_fields(lambda x: 1 + x / 3600)
    return rounded(out.df.select("user_id", "seq", "value"), 5)


@twin("smooth_gauss")
def smooth_gauss_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kn.smooth(ts_lanes(spark, sf_dir), "gaussian", window=3, sigma=12 * 3600.0).df.select("user_id", "seq", "value"))


@twin("rot_resample")
def rot_resample_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts_lanes(spark, sf_dir)
    f = f.with_fields(r=q_motion._tilted(F.least(F.col("value"), F.lit(100.0)) / 100)).select("r")
    out = fr.resampled_rotations(f, "r", _grid(f).withColumnRenamed("q", "ts")).df
    return rounded(out.select("user_id", "seq", _seconds(out, "ts").alias("t"), F.col("r.y").alias("y"), F.col("r.w").alias("w")))


@twin("place_geodesic")
def place_geodesic_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts_lanes(spark, sf_dir)
    f = f.with_fields(g=geo.lla(F.lit(0.0), _seconds(f.df, "ts") / 20_000 - 60, F.col("value"))).select("g")
    out = places.resample_to(f, "g", _grid(f).withColumnRenamed("q", "ts")).df
    return rounded(out.select("user_id", "seq", _seconds(out, "ts").alias("t"), F.col("g.lon").alias("lon"), F.col("g.alt").alias("alt")), 5)


# tolerances: in the SQL every point knows the next one that is far enough, and the lane's first point starts the chain


def _thinned(source: str, keys: str, t: str, tol: str) -> str:
    same = " AND ".join(f"x.{k} = n.{k}" for k in keys.split(", "))
    chain = " AND ".join(f"r.{k} = j.{k}" for k in keys.split(", "))
    xs, rs = (", ".join(f"{p}.{k}" for k in keys.split(", ")) for p in "xr")
    return f"""j AS MATERIALIZED (SELECT {xs}, x.{t}, min(n.{t}) AS next FROM {source} AS x JOIN {source} AS n ON {same} AND n.{t} > x.{t} + {tol} GROUP BY ALL),
r AS (SELECT {keys}, min({t}) AS {t} FROM {source} GROUP BY ALL UNION ALL SELECT {rs}, j.next FROM r JOIN j ON {chain} AND r.{t} = j.{t})"""


TOLERANT = f"WITH RECURSIVE {{e}}, {TWO}, o AS (SELECT DISTINCT * FROM ({UNION})), {_thinned('o', 'user_id', 't', '2')}, g AS (SELECT DISTINCT * FROM r), {BOTH}"


@query(TOLERANT)
def sync_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock values of two streams, without those within two hours of the last one kept."""
    return q_clock._synced(spark, sf_dir, join="outer", tol=2.0)


@query(TOLERANT)
def sync_tolerance_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir, join="outer", tol=2 * HOUR)


DEDUPED = f"""WITH RECURSIVE {{e}}, {q_events._events(False)}, y AS (SELECT DISTINCT user_id, edge_code, time FROM x), {_thinned('y', 'user_id, edge_code', 'time', '86400')}
SELECT x.user_id, CAST(row_number() OVER (PARTITION BY x.user_id ORDER BY x.time, x.edge_code, x.sample_index_before) - 1 AS INT) AS event, round(x.time, 6) AS time, x.edge_code, x.sample_index_before, x.sample_index_after
FROM x JOIN (SELECT DISTINCT * FROM r) AS k ON x.user_id = k.user_id AND x.edge_code = k.edge_code AND x.time = k.time"""


@query(DEDUPED)
def events_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.events(lanes(spark, sf_dir), q_events.high(), dedupe_atol=86_400.0))


@query(DEDUPED)
def events_dedupe_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(ev.events(ts_lanes(spark, sf_dir), q_events.high(), dedupe_atol=24 * HOUR), time="time")


# slices with bounds from a table

SLICES = """WITH {e}, b AS (SELECT user_id, seq AS slice, t - 50000 AS lo, CASE WHEN seq % 40 = 0 THEN t + 250000 END AS hi FROM e WHERE seq % 20 = 0)
SELECT b.user_id, b.slice, row_number() OVER (PARTITION BY b.user_id, b.slice ORDER BY e.seq) - 1 AS seq, e.seq AS sample_index, round(e.t, 6) AS t, e.value FROM b JOIN e ON b.user_id = e.user_id AND e.t >= b.lo AND (b.hi IS NULL OR e.t <= b.hi)"""


@query(SLICES)
def param_sel_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals of each lane, some open at the end."""
    f = lanes(spark, sf_dir)
    b = f.df.where("seq % 20 = 0").select("user_id", F.col("seq").alias("slice"), (F.col("t") - 50_000).alias("lo"), F.when(F.col("seq") % 40 == 0, F.col("t") + 250_000).alias("hi"))
    return rounded(asof.select_slices(f, b, "lo", "hi").drop("lo", "hi"))


@query(SLICES)
def param_sel_slices_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ts_lanes(spark, sf_dir)
    lo, hi = (F.col("ts") + F.lit(datetime.timedelta(seconds=s)) for s in (-50_000, 250_000))
    b = f.df.where("seq % 20 = 0").select("user_id", F.col("seq").alias("slice"), lo.alias("lo"), F.when(F.col("seq") % 40 == 0, hi).alias("hi"))
    return _told(asof.select_slices(f, b, "lo", "hi").drop("lo", "hi"), ts="t")


@query("""WITH {e}, b AS (SELECT user_id, seq AS slice, t - 50000 AS lo, CASE WHEN seq % 40 = 0 THEN t + 250000 END AS hi FROM e WHERE seq % 20 = 0)
SELECT b.user_id, b.slice, count(*) FILTER (WHERE e.t < b.lo) AS i0, count(*) FILTER (WHERE b.hi IS NULL OR e.t <= b.hi) AS i1 FROM b JOIN e USING (user_id) GROUP BY b.user_id, b.slice""")
def param_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    b = f.df.where("seq % 20 = 0").select("user_id", F.col("seq").alias("slice"), (F.col("t") - 50_000).alias("lo"), F.when(F.col("seq") % 40 == 0, F.col("t") + 250_000).alias("hi"))
    return asof.bounds_map(f, b, "lo", "hi").select("user_id", "slice", "i0", "i1")


# lanes cut into ranges give the rows of whole ones; here every lane of more than ROWS samples is cut

ROWS = 12


@twin("param_at_linear")
def param_at_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan.split_lanes(lanes(spark, sf_dir), ROWS)
    return rounded(asof.at(f, q_clock._grid(f), "q"))


@twin("param_dup_right")
def param_dup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    f = scan.split_lanes(f.over(f.df.withColumn("t", F.floor(F.col("t") / 86400).cast("double"))), ROWS)
    q = asof.grid_for(f, [float(k) for k in range(31)]).select("user_id", F.col("t").alias("q"))
    return rounded(asof.at(f, q, "q", duplicates="right"))


@twin("sync_outer")
def sync_outer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = q_clock._two(spark, sf_dir)
    return rounded(asof.synchronized([scan.split_lanes(a, 4), b], "outer").df.select("user_id", "seq", "t", "a", "b"))


@twin("sync_domain")
def sync_domain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    out = asof.synchronized([scan.split_lanes(a, 4), b], "domain").df
    return rounded(out.select("user_id", "seq", (_seconds(out, "ts") / 3600).alias("t"), "a", "b"))


@twin("trapezoid")
def trapezoid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan.split_lanes(q_space._hours(spark, sf_dir), ROWS)
    return rounded(kn.integrate(f, initial=1.0).df.select("user_id", "seq", "value"), 5)


@query("WITH {e} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS seq, round(t, 6) AS t, value FROM e WHERE value > 5")
def renumbered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan.split_lanes(lanes(spark, sf_dir), ROWS)
    return rounded(f.over(f.df.where("value > 5")).renumbered("t", "seq").df)


# a user's function of a state and a batch


@query("""WITH RECURSIVE {e}, r AS (SELECT user_id, seq, value AS level FROM e WHERE seq = 0 UNION ALL SELECT e.user_id, e.seq, 0.71::DOUBLE * r.level + 0.29::DOUBLE * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.seq = r.seq + 1)
SELECT user_id, seq, round(level, 6) AS level, seq + 1 AS n FROM r""")
def fold_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential smoother as a user writes it, over lanes of any length."""
    out = folds.fold_lanes(lanes(spark, sf_dir), kernels.no_state, kernels.smoothed, "level double, n bigint")
    return rounded(out.df.select("user_id", "seq", "level", "n"))


# geodesics that aren't along the equator: up a meridian past the pole's neighbourhood, and across the antipode

def _arc(x: str) -> str:
    """Length of the meridian from the equator in SQL, by Bessel's series in the third flattening."""
    n = "0.0016792203863837047::DOUBLE"
    lat = f"radians({x})"
    terms = f"""(1 + {n}**2 / 4 + {n}**4 / 64 + {n}**6 / 256) * {lat} - 3.0::DOUBLE / 2 * ({n} - {n}**3 / 8 - {n}**5 / 64) * sin(2 * {lat}) + 15.0::DOUBLE / 16 * ({n}**2 - {n}**4 / 4) * sin(4 * {lat})
 - 35.0::DOUBLE / 48 * ({n}**3 - 5 * {n}**5 / 16) * sin(6 * {lat}) + 315.0::DOUBLE / 512 * {n}**4 * sin(8 * {lat})"""
    return f"(6378137.0::DOUBLE / (1 + {n}) * ({terms}))"


@query(f"""WITH {{e}}, v AS (SELECT user_id, seq, least(value, 85) AS a, greatest(-85, 20 - value) AS b FROM e)
SELECT user_id, seq, round(abs({_arc('b')} - {_arc('a')}), 4) AS along, round(20003931.458625 - abs({_arc('a')} + {_arc('b')}), 4) AS across, CASE WHEN a < b THEN 0.0::DOUBLE WHEN a > b THEN 180.0::DOUBLE END AS bearing FROM v""")
def geodesic_meridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along a meridian, and over a pole to the opposite one: lengths are arcs of the meridian."""
    a, b = F.least(F.col("value"), F.lit(85.0)), F.greatest(F.lit(-85.0), 20 - F.col("value"))
    df = lanes(spark, sf_dir).df.select("user_id", "seq", geo.geodesic(a, F.lit(30.0), b, F.lit(30.0)).alias("g"), geo.geodesic(a, F.lit(30.0), b, F.lit(-150.0)).alias("o"))
    return df.select("user_id", "seq", F.round("g.distance", 4).alias("along"), F.round("o.distance", 4).alias("across"), F.when(F.col("g.distance") > 0, F.col("g.initial_bearing")).alias("bearing"))


@query("WITH {e} SELECT user_id, seq, 0.0::DOUBLE AS gap, true AS shortest FROM e")
def geodesic_antipode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To points near the antipode and back by the direct problem: the gap is nothing, and no way is longer than half a meridian."""
    lat, lon = F.least(F.col("value"), F.lit(80.0)) - 30, F.col("t") / 20_000 - 60
    df = lanes(spark, sf_dir).df.select("user_id", "seq", lat.alias("lat"), lon.alias("lon"), (-lat + F.col("value") / 400).alias("b_lat"), (lon + 180 - F.col("value") / 300).alias("b_lon"))
    df = df.withColumn("g", geo.geodesic("lat", "lon", "b_lat", "b_lon")).withColumn("p", geo.geodesic_point("lat", "lon", "g.initial_bearing", "g.distance"))
    a, b = geo.to_ecef(geo.lla(F.col("p.lat"), F.col("p.lon"), F.lit(0.0))), geo.to_ecef(geo.lla(F.col("b_lat"), F.col("b_lon"), F.lit(0.0)))
    gap = F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "yz"), (a["x"] - b["x"]) * (a["x"] - b["x"])))
    return df.select("user_id", "seq", F.round(gap, 4).alias("gap"), (F.col("g.distance") <= 20_003_931.4587).alias("shortest"))

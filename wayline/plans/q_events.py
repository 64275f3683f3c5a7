"""Conditions, events, intervals and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import asof
from wayline.operators import events as ev
from wayline.plans.catalog import lanes, query, rounded

def high() -> Column:
    return F.col("value") > 20


ON = """
o AS (SELECT *, value > 20 AS o FROM e),
w AS (SELECT *, lag(o) OVER p AS was, lead(o) OVER p AS will, coalesce(lag(seq) OVER p, -1) AS bf, coalesce(lead(seq) OVER p, -1) AS af FROM o WINDOW p AS (PARTITION BY user_id ORDER BY seq))"""


def _events(initial: bool) -> str:
    first = "was = false OR was IS NULL" if initial else "was = false"
    return f"""{ON},
v AS (
  SELECT user_id, t AS time, 1 AS edge_code, bf AS b, seq AS a FROM w WHERE o AND ({first})
  UNION ALL SELECT user_id, t, 2, seq, af FROM w WHERE o AND coalesce(will, false) = false
),
x AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY time, edge_code, b, a) - 1 AS INT) AS event, time, edge_code, b AS sample_index_before, a AS sample_index_after FROM v)"""


ISLANDS = f"""{ON},
i AS (SELECT *, sum(CASE WHEN o AND coalesce(was, false) = false THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM w),
s AS (SELECT user_id, island, min(t) AS start_time, max(t) AS end_time, min(seq) AS start_index, max(seq) AS end_index, bool_or(was IS NULL) AS first FROM i WHERE o GROUP BY user_id, island)"""


@query("WITH {e} SELECT user_id, seq, round(t, 6) AS t, value, coalesce(NOT (value > 20 AND value < 50) OR event_type = 'error', false) AS mask FROM e")
def cond_mask_3vl(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir, "event_type")
    cond = ~((F.col("value") > 20) & (F.col("value") < 50)) | (F.col("event_type") == "error")
    return rounded(ev.mask(f, cond).drop("event_type"))


@query("WITH {e} SELECT user_id, seq, abs(value - 10) <= 0.5 + 0.01 * 10 AS mask FROM e")
def cond_eq_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.mask(lanes(spark, sf_dir), ev.equals(F.col("value"), F.lit(10.0), 0.5, 0.01)).select("user_id", "seq", "mask")


@query(f"WITH {{e}}, {_events(False)} SELECT user_id, event, round(time, 6) AS time, edge_code, sample_index_before, sample_index_after FROM x")
def events_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.events(lanes(spark, sf_dir), high()))


@query(f"WITH {{e}}, {_events(True)} SELECT user_id, event, round(time, 6) AS time, edge_code, sample_index_before, sample_index_after FROM x")
def events_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.events(lanes(spark, sf_dir), high(), include_initial=True))


@query(f"WITH {{e}}, {ON}, x AS (SELECT user_id, seq, t FROM o WHERE abs(value - 10) <= 0.6) SELECT user_id, count(*) AS n, round(sum(t), 3) AS total FROM x GROUP BY user_id")
def events_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.events(lanes(spark, sf_dir), ev.equals(F.col("value"), F.lit(10.0), 0.5, 0.01), trigger=True).where(F.col("edge_code") == ev.TRIGGER)
    return rounded(found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("time").alias("total")), 3)


@query(f"""WITH {{e}}, {ISLANDS} SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_index) - 1 AS INT) AS segment,
  round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, start_index, end_index FROM s WHERE NOT first""")
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.intervals(lanes(spark, sf_dir), high()))


@query(f"WITH {{e}}, {ISLANDS} SELECT user_id, count(*) AS n, round(avg(end_time - start_time), 6) AS mean_duration FROM s WHERE NOT first GROUP BY user_id")
def interval_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and mean length of the stretches above a threshold, per lane."""
    found = ev.intervals(lanes(spark, sf_dir), high())
    return rounded(found.groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.col("end_time") - F.col("start_time")).alias("mean_duration")))


@query(f"""WITH {{e}}, {_events(False)} SELECT x.user_id, event, round(time, 6) AS time, edge_code, sample_index_before, sample_index_after, e.value
FROM x JOIN e ON x.user_id = e.user_id AND x.time = e.t QUALIFY row_number() OVER (PARTITION BY x.user_id, edge_code = 1 ORDER BY event) = 1 AND edge_code = 1""")
def at_boundaries_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.at_boundaries(lanes(spark, sf_dir), high(), edges="enter", mode="first"))


@query(f"""WITH {{e}}, {_events(False)} SELECT x.user_id, event, round(time, 6) AS time, edge_code, sample_index_before, sample_index_after, e.value
FROM x JOIN e ON x.user_id = e.user_id AND x.time = e.t QUALIFY row_number() OVER (PARTITION BY x.user_id ORDER BY event DESC) = 1""")
def at_boundaries_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.at_boundaries(lanes(spark, sf_dir), high(), mode="last"))


@query("WITH {e} SELECT user_id, seq, round(t, 6) AS t, CASE WHEN value > 20 THEN value END AS value FROM e")
def when_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.when(lanes(spark, sf_dir), high()).df)


@query("WITH {e} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS seq, round(t, 6) AS t, value, seq AS orig_index FROM e WHERE value <= 20")
def when_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.when(lanes(spark, sf_dir), high(), "stream", inside=False).df)


@query(f"""WITH {{e}}, {ISLANDS}, z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_index) - 1 AS segment FROM s)
SELECT z.user_id, i.seq - z.start_index AS seq, round(i.t, 6) AS t, i.value, CAST(z.segment AS INT) AS segment, round(start_time, 6) AS segment_start_time, round(end_time, 6) AS segment_end_time,
       start_index AS segment_start_index, end_index AS segment_end_index, i.seq AS orig_index
FROM z JOIN i ON z.user_id = i.user_id AND z.island = i.island AND i.o""")
def when_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.when(lanes(spark, sf_dir), high(), "segments"))


AROUND = f"""{_events(False)},
c AS (SELECT user_id, event, time FROM x WHERE edge_code = 1),
g AS (SELECT user_id, event, time, i AS tau_index, (i - 2) * 3600::DOUBLE AS tau, time + (i - 2) * 3600::DOUBLE AS q FROM c, range(5) AS r(i)),
f AS (
  SELECT g.user_id, g.event, g.tau_index, g.tau, g.time,
    CASE WHEN g.q = y.t AND (l.t IS NULL OR g.q = m.hi) THEN y.value ELSE (1 - (g.q - l.t) / (y.t - l.t)) * l.value + (g.q - l.t) / (y.t - l.t) * y.value END AS value
  FROM g ASOF LEFT JOIN e AS l ON g.user_id = l.user_id AND g.q > l.t ASOF LEFT JOIN e AS y ON g.user_id = y.user_id AND g.q <= y.t
  JOIN (SELECT user_id, max(t) AS hi FROM e GROUP BY user_id) AS m ON g.user_id = m.user_id
)"""


def _anchors(f):
    return ev.pick(ev.events(f, high()), f.keys, "enter")


@query(f"WITH {{e}}, {AROUND} SELECT user_id, event, tau, round(time, 6) AS event_time, round(value, 6) AS value FROM f")
def around_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    out = ev.around(f, _anchors(f), ev.tau_grid(7200.0, 7200.0, 3600.0))
    return rounded(out.select("user_id", "event", "tau", "event_time", "value"))


@query(f"WITH {{e}}, {AROUND} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event, tau_index) - 1 AS seq, event AS window_event_index, tau AS window_tau, round(value, 6) AS value FROM f")
def around_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    out = ev.around(f, _anchors(f), ev.tau_grid(7200.0, 7200.0, 3600.0), "stacked")
    return rounded(out.select("user_id", "seq", "window_event_index", "window_tau", "value"))


@query(f"WITH {{e}}, {AROUND} SELECT user_id, event, tau, round(time, 6) AS event_time, round(value, 6) AS value FROM f")
def around_segments_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    out = ev.around(f, _anchors(f), ev.tau_grid(7200.0, 7200.0, 3600.0))
    return rounded(out.select("user_id", "event", "tau", "event_time", "value"))


@query(f"WITH {{e}}, {AROUND} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event, tau_index) - 1 AS seq, event AS window_event_index, tau AS window_tau, round(value, 6) AS value FROM f")
def around_stacked_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    out = ev.around(f, _anchors(f), ev.tau_grid(7200.0, 7200.0, 3600.0), "stacked")
    return rounded(out.select("user_id", "seq", "window_event_index", "window_tau", "value"))


@query(f"""WITH {{e}}, {_events(False)} SELECT x.user_id, event, round(time, 6) AS time, edge_code, sample_index_before, sample_index_after, e.value
FROM x JOIN e ON x.user_id = e.user_id AND x.time = e.t WHERE edge_code = 1 QUALIFY row_number() OVER (PARTITION BY x.user_id ORDER BY event) <= 3""")
def at_boundaries_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three enter events of each lane, which is what this mode is for."""
    return rounded(ev.at_boundaries(lanes(spark, sf_dir), high(), edges="enter", mode="first_n", n=3))


@query("""WITH {e}, g AS (SELECT user_id, max(t) / 2 AS q FROM e GROUP BY user_id),
n AS (SELECT g.user_id, g.q, e.value, row_number() OVER (PARTITION BY g.user_id ORDER BY abs(e.t - g.q), e.t) AS r FROM g JOIN e USING (user_id))
SELECT user_id, round(q, 6) AS q, value FROM n WHERE r = 1""")
def sel_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    q = f.df.groupBy("user_id").agg((F.max("t") / 2).alias("q"))
    return rounded(asof.select_points(f, q, "q").select("user_id", "q", "value"))

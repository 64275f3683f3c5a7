"""Selection, interpolation and synchronisation on the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.operators import asof
from wayline.plans.catalog import lanes, query, rounded

STEP, POINTS = 43_200.0, 61
GRID = [k * STEP for k in range(POINTS)]

BRACKET = """
g AS (SELECT user_id, CAST(i AS BIGINT) AS seq, i * 43200::DOUBLE AS q FROM (SELECT DISTINCT user_id FROM e), range(61) AS r(i)),
b AS (
  SELECT g.user_id, g.seq, g.q, l.t AS lt, l.value AS lv, l.seq AS ls, x.t AS rt, x.value AS rv, x.seq AS rs, m.hi
  FROM g ASOF LEFT JOIN e AS l ON g.user_id = l.user_id AND g.q > l.t
  ASOF LEFT JOIN e AS x ON g.user_id = x.user_id AND g.q <= x.t
  JOIN (SELECT user_id, max(t) AS hi FROM e GROUP BY user_id) AS m ON g.user_id = m.user_id
)"""
LINEAR = "CASE WHEN q = rt AND (lt IS NULL OR q = hi) THEN rv ELSE (1 - (q - lt) / (rt - lt)) * lv + (q - lt) / (rt - lt) * rv END"
LEFT = "(rt IS NULL OR (lt IS NOT NULL AND q - lt <= rt - q))"


def _grid(f: LaneFrame) -> DataFrame:
    return asof.grid_for(f, GRID).withColumnRenamed("t", "q")


@query(f"WITH {{e}}, {BRACKET} SELECT user_id, seq, q, CASE WHEN {LEFT} THEN ls ELSE rs END AS sample_index, true AS valid FROM b")
def param_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    return asof.index(f, _grid(f), "q")


@query(f"WITH {{e}}, {BRACKET} SELECT user_id, seq, q, CASE WHEN {LEFT} THEN ls ELSE rs END AS sample_index, true AS valid, CASE WHEN {LEFT} THEN lv ELSE rv END AS value FROM b")
def param_sel_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    return asof.select_points(f, _grid(f), "q")


@query("WITH {e} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS seq, round(t, 6) AS t, value, seq AS sample_index FROM e WHERE t BETWEEN 200000 AND 900000")
def param_sel_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asof.select_range(lanes(spark, sf_dir), 200_000.0, 900_000.0).df)


@query(f"WITH {{e}}, {BRACKET} SELECT user_id, seq, q, round({LINEAR}, 6) AS value FROM b")
def param_at_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    return rounded(asof.at(f, _grid(f), "q"))


@query(f"WITH {{e}}, {BRACKET} SELECT user_id, seq, q, CASE WHEN {LEFT} THEN lv ELSE rv END AS value FROM b")
def param_at_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    return asof.at(f, _grid(f), "q", "nearest")


@query(f"WITH {{e}}, {BRACKET} SELECT user_id, seq, q AS t, round({LINEAR}, 6) AS value FROM b")
def resample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asof.resample_to(lanes(spark, sf_dir), GRID).df)


DAYS = """
d AS (SELECT user_id, seq, floor(t / 86400) AS day, value FROM e),
p AS (SELECT user_id, day, count(*) AS n, min_by(value, seq) AS v0, max_by(value, seq) AS v1, min_by(value, seq) AS a, max_by(value, seq) AS z FROM d GROUP BY user_id, day),
g AS (SELECT user_id, i::DOUBLE AS q FROM (SELECT DISTINCT user_id FROM e), range(31) AS r(i)),
b AS (
  SELECT g.user_id, g.q, l.day AS lt, l.z AS lv, x.day AS rt, x.a AS rv, x.z AS rz, x.n AS n, m.hi
  FROM g ASOF LEFT JOIN p AS l ON g.user_id = l.user_id AND g.q > l.day
  ASOF LEFT JOIN p AS x ON g.user_id = x.user_id AND g.q <= x.day
  JOIN (SELECT user_id, max(day) AS hi FROM p GROUP BY user_id) AS m ON g.user_id = m.user_id
)"""
BLEND = "WHEN q = rt AND (lt IS NULL OR q = hi) THEN rv ELSE (1 - (q - lt) / (rt - lt)) * lv + (q - lt) / (rt - lt) * rv END"


def _days(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    f = f.over(f.df.withColumn("t", F.floor(F.col("t") / 86400).cast("double")))
    q = asof.grid_for(f, [float(k) for k in range(31)]).select("user_id", F.col("t").alias("q"))
    return rounded(asof.at(f, q, "q", duplicates=policy))


@query(f"WITH {{e}}, {DAYS} SELECT user_id, q, round(CASE WHEN q = rt AND n > 1 THEN NULL {BLEND}, 6) AS value FROM b")
def param_dup_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir, "invalid")


@query(f"WITH {{e}}, {DAYS} SELECT user_id, q, round(CASE WHEN q = rt AND n > 1 THEN rv {BLEND}, 6) AS value FROM b")
def param_dup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir, "left")


@query(f"WITH {{e}}, {DAYS} SELECT user_id, q, round(CASE WHEN q = rt AND n > 1 THEN rz {BLEND}, 6) AS value FROM b")
def param_dup_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir, "right")


def _two(spark: SparkSession, sf_dir: str) -> tuple[LaneFrame, LaneFrame]:
    """Views and clicks of each user: two streams with clocks of their own, in whole hours so that they meet."""
    df = lanes(spark, sf_dir, "event_type").df
    hours = df.withColumn("t", F.floor(F.col("t") / 3600).cast("double")).groupBy("user_id", "t", "event_type").agg(F.avg("value").alias("value"))
    return tuple(LaneFrame.of(hours.where(F.col("event_type") == kind).withColumnRenamed("value", name), ["user_id"], "t", [name]) for kind, name in (("view", "a"), ("click", "b")))


TWO = """
h AS (SELECT user_id, floor(t / 3600) AS t, event_type, avg(value) AS value FROM e GROUP BY ALL),
a AS (SELECT user_id, t, value FROM h WHERE event_type = 'view'), b AS (SELECT user_id, t, value FROM h WHERE event_type = 'click'),
u AS (SELECT DISTINCT user_id FROM a WHERE user_id IN (SELECT user_id FROM b))"""


def _filled(side: str, name: str) -> str:
    return f"""{name} AS (
  SELECT g.user_id, g.t, CASE WHEN g.t = x.t AND (l.t IS NULL OR g.t = m.hi) THEN x.value
         ELSE (1 - (g.t - l.t) / (x.t - l.t)) * l.value + (g.t - l.t) / (x.t - l.t) * x.value END AS v
  FROM g ASOF LEFT JOIN {side} AS l ON g.user_id = l.user_id AND g.t > l.t ASOF LEFT JOIN {side} AS x ON g.user_id = x.user_id AND g.t <= x.t
  JOIN (SELECT user_id, max(t) AS hi FROM {side} GROUP BY user_id) AS m ON g.user_id = m.user_id)"""


BOTH = f"{_filled('a', 'fa')}, {_filled('b', 'fb')} SELECT fa.user_id, row_number() OVER (PARTITION BY fa.user_id ORDER BY fa.t) - 1 AS seq, fa.t, round(fa.v, 6) AS a, round(fb.v, 6) AS b FROM fa JOIN fb ON fa.user_id = fb.user_id AND fa.t = fb.t"
UNION = "SELECT * FROM (SELECT user_id, t FROM a UNION SELECT user_id, t FROM b) WHERE user_id IN (SELECT user_id FROM u)"


def _synced(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return rounded(asof.synchronized(_two(spark, sf_dir), **options).df.select("user_id", "seq", "t", "a", "b"))


@query(f"WITH {{e}}, {TWO}, g AS ({UNION}), {BOTH}")
def sync_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir, join="outer")


@query(f"WITH {{e}}, {TWO}, g AS (SELECT user_id, t FROM a INTERSECT SELECT user_id, t FROM b), {BOTH}")
def sync_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir, join="inner")


@query(f"""WITH {{e}}, {TWO}, o AS (
  SELECT user_id, greatest(min(t) FILTER (WHERE s = 'a'), min(t) FILTER (WHERE s = 'b')) AS lo, least(max(t) FILTER (WHERE s = 'a'), max(t) FILTER (WHERE s = 'b')) AS hi
  FROM (SELECT *, 'a' AS s FROM a UNION ALL SELECT *, 'b' AS s FROM b) GROUP BY user_id),
g AS (SELECT x.user_id, x.t FROM ({UNION}) AS x JOIN o USING (user_id) WHERE x.t BETWEEN o.lo AND o.hi), {BOTH}""")
def sync_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir, join="domain")


@query("WITH {e} SELECT user_id, seq, round(t, 6) AS t, round(value, 6) AS a, round(value + 1, 6) AS b FROM e")
def sync_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    out = asof.synchronized([f.rename(value="a"), f.with_fields(b=F.col("value") + 1).select("b")], join="exact")
    return rounded(out.df.select("user_id", "seq", "t", "a", "b"))


@query(f"""WITH {{e}}, {TWO}, g AS (SELECT user_id, t FROM a WHERE user_id IN (SELECT user_id FROM u))
SELECT g.user_id, row_number() OVER (PARTITION BY g.user_id ORDER BY g.t) - 1 AS seq, g.t, round(n.value, 6) AS a,
       round(CASE WHEN (l.t IS NOT NULL AND g.t - l.t <= 5 AND (x.t IS NULL OR g.t - l.t <= x.t - g.t)) THEN l.value WHEN x.t - g.t <= 5 THEN x.value ELSE -1 END, 6) AS b
FROM g JOIN a AS n ON g.user_id = n.user_id AND g.t = n.t
ASOF LEFT JOIN b AS l ON g.user_id = l.user_id AND g.t > l.t ASOF LEFT JOIN b AS x ON g.user_id = x.user_id AND g.t <= x.t""")
def sync_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir, join="left", how="fill", tol=5.0, fill=-1.0)


@query(f"WITH {{e}}, {TWO}, g AS (SELECT user_id, t FROM b WHERE user_id IN (SELECT user_id FROM u)), {_filled('a', 'fa')} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS seq, t, round(v, 6) AS a FROM fa")
def interp_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return rounded(asof.interp_like(a, b).df.select("user_id", "seq", "t", "a"))

"""Values at the edges (infinities, NaN, numbers beyond whole ones, null lanes), names that operators use themselves, and logs that are written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions import numeric as nm
from wayline.operators import asof
from wayline.operators import combine as cb
from wayline.operators import kinematics as kn
from wayline.operators import reduce as rd
from wayline.plans.catalog import lanes, query, rounded, table
from wayline.plans.q_clock import BRACKET, LINEAR
from wayline.plans.q_space import W
from wayline.sources import logs, shared

#: Odd numbers, by a remainder: what they are in Spark and in SQL (fixed values); others are the quantity less 25.
ODD = {0: float("inf"), 1: float("-inf"), 2: float("nan"), 3: 1e20, 4: -1e20, 5: 0.0, 6: -2.5, 7: 2.5, 8: 9007199254740993.0}
#: What infinities are shown as, on both sides.
FAR = 9e99


def _odd(by: Column) -> Column:
    out = None
    for k, v in ODD.items():
        out = F.when(by == k, F.lit(v)) if out is None else out.when(by == k, F.lit(v))
    return out.otherwise(F.col("l_quantity") - 25)


def _odd_sql(by: str) -> str:
    return "CASE " + " ".join(f"WHEN {by} = {k} THEN '{v!r}'::DOUBLE" for k, v in ODD.items()) + " ELSE l_quantity - 25 END"


#: NaN counts as missing: rules of the array library in SQL, on x and y where both, or one, are there.
WHOLE = "CASE WHEN isinf(x) OR abs(x) >= 9007199254740992 THEN x ELSE {f}(x) END"
EDGES = {
    "floor": WHOLE.format(f="floor"), "ceil": WHOLE.format(f="ceil"), "trunc": WHOLE.format(f="trunc"),
    "fmax": "CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE greatest(x, y) END", "fmin": "CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE least(x, y) END",
    "maximum": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END", "minimum": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END",
    "heaviside": "CASE WHEN x < 0 THEN 0.0::DOUBLE WHEN x = 0 THEN y WHEN x > 0 THEN 1.0::DOUBLE END",
}
COMPARED = {"greater": ">", "greater_equal": ">=", "less": "<", "less_equal": "<=", "equal": "=", "not_equal": "<>"}


def _shown(x: Column) -> Column:
    x = nm.number(x)
    return F.when(F.abs(x) == float("inf"), F.signum(x) * FAR).otherwise(x)


_VALUES = f"SELECT l_orderkey, l_linenumber, CASE WHEN isnan(x) THEN NULL ELSE x END AS x, CASE WHEN isnan(y) THEN NULL ELSE y END AS y FROM (SELECT *, {_odd_sql('(l_orderkey + l_linenumber) % 11')} AS x, {_odd_sql('(l_orderkey // 3) % 10')} AS y FROM lineitem)"
_SQL = ", ".join(
    [f"CASE WHEN isinf(v_{n}) THEN sign(v_{n}) * 9e99::DOUBLE ELSE v_{n} END AS {n}" for n in EDGES] + [f"coalesce(x {o} y, false) AS {n}" for n, o in COMPARED.items()]
)
_EACH = ", ".join(f"{x} AS v_{n}" for n, x in EDGES.items())


@query(f"WITH i AS ({_VALUES}), v AS (SELECT *, {_EACH} FROM i) SELECT l_orderkey, l_linenumber, {_SQL} FROM v")
def ufunc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumns({"x": _odd((F.col("l_orderkey") + F.col("l_linenumber")) % 11), "y": _odd(F.floor(F.col("l_orderkey") / 3) % 10)})
    x, y = F.col("x"), F.col("y")
    made = [_shown(nm.UNARY[n](x) if n in nm.UNARY else nm.BINARY[n](x, y)).alias(n) for n in EDGES]
    return df.select("l_orderkey", "l_linenumber", *made, *(F.coalesce(nm.BINARY[n](x, y), F.lit(False)).alias(n) for n in COMPARED))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x, CAST(l_linenumber - 3 AS DOUBLE) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN y = 0 THEN CASE WHEN x = 0 THEN NULL ELSE sign(x) * 9e99::DOUBLE END ELSE floor(x / y) + 0.0::DOUBLE END AS quotient FROM v""")
def floor_divide_by_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", (_shown(nm.floor_divide(F.col("l_quantity") - 25, F.col("l_linenumber") - 3)) + F.lit(0.0)).alias("quotient"))


# null lane keys are lanes like others

NULLED = """n AS (SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS lane, row_number() OVER (PARTITION BY CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END ORDER BY t, event_id) - 1 AS seq, event_type, value FROM e)"""


def _nulled(spark: SparkSession, sf_dir: str) -> LaneFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    events = events.withColumn("lane", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))
    return LaneFrame.of(events, ["lane"], "ts", ["value", "event_type"], order=["event_id"])


@query(f"WITH {{e}}, {NULLED} SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY lane NULLS FIRST, seq) - 1 AS member, value FROM n")
def group_padded_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _nulled(spark, sf_dir).set_roles(fields=("value",))
    return rd.Grouped(f, {"event_type": F.col("event_type")}).padded()


@query(f"WITH {{e}}, {NULLED} SELECT lane, seq, round(value * 2 + 1, 6) AS value FROM n")
def binary_null_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames with a null lane meet in it too."""
    f = _nulled(spark, sf_dir).select("value")
    return rounded(cb.binary(f, f.map_fields(lambda x: x + 1), lambda a, b: a + b, lanes="exact", samples="exact").df.select("lane", "seq", "value"))


@query("WITH {e} SELECT user_id, round(sum(value * (1 + user_id % 3) * (1 + seq % 2)) / sum((1 + user_id % 3) * (1 + seq % 2)), 6) AS value FROM e GROUP BY user_id")
def weighted_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of lanes times weights of sample numbers."""
    f = lanes(spark, sf_dir)
    by_lane = f.df.select("user_id").distinct().withColumn("weight", 1 + F.col("user_id") % 3)
    by_seq = f.df.select("seq").distinct().withColumn("weight", 1 + F.col("seq") % 2)
    return rounded(rd.reduce_by(rd.weighted_product(f, {"lanes": by_lane, "samples": by_seq}).df, ["user_id"], "mean", ["value"], weight=F.col("weight")))


@query("SELECT CAST(median(value) AS DOUBLE) AS value, CAST((SELECT median(l_extendedprice) FROM lineitem) AS DOUBLE) AS price FROM events")
def reduce_all_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of whole tables by counting passes."""
    f = lanes(spark, sf_dir)
    price = rd.median_of_all(table(spark, sf_dir, "lineitem"), ["l_extendedprice"]).withColumnRenamed("l_extendedprice", "price")
    return rd.reduce_lanes(f, "median", over="all").withColumn("price", F.lit(price.first()["price"]))


# names that operators use for themselves

@query(f"""WITH {{e}}, d AS (SELECT *, (value - lag(value) OVER p) / (t - lag(t) OVER p) * 3600 AS d FROM e {W})
SELECT user_id, seq, round(coalesce(d, lead(d) OVER p), 6) AS _dt, round(2 * coalesce(d, lead(d) OVER p), 6) AS "left" FROM d {W}""")
def names_in_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    f = f.with_fields(_dt=F.col("value"), left=F.col("value") * 2).select("_dt", "left")
    out = kn.differentiate(f).map_fields(lambda x: x * 3600)
    return rounded(out.df.select("user_id", "seq", "_dt", "left"))


@query(f"""WITH {{e}}, {BRACKET} SELECT user_id, seq AS "left", seq + 1 AS "right", seq + 2 AS "end", seq + 3 AS _alpha, round({LINEAR}, 6) AS value FROM b""")
def names_in_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.plans.q_clock import _grid

    f = lanes(spark, sf_dir)
    g = _grid(f)
    asked = g.select("user_id", F.col("seq").alias("left"), *((F.col("seq") + i).alias(n) for i, n in ((1, "right"), (2, "end"), (3, "_alpha"))), "q")
    return rounded(asof.at(f, asked, "q").drop("q"))


# logs and snapshots, by way of the shared folder


@query("WITH {e} SELECT user_id, seq, round(t, 6) AS time, round(value, 6) AS value, round(value / 7, 6) AS share FROM e")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes as CSV logs, read again as lanes."""
    f = lanes(spark, sf_dir).with_fields(share=F.col("value") / 7)
    at = shared.folder(spark, "logs")
    logs.write_csv_logs(f, at)
    back = logs.read_csv_logs(spark, at, logs.CsvOptions(time="t"))
    return rounded(back.df.select(F.col("user_id").cast("long").alias("user_id"), "seq", "time", "value", "share"))


@query("WITH {e} SELECT user_id, seq, round(t, 6) AS t, round(value, 6) AS value FROM e")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared.folder(spark, "snapshot")
    logs.save(lanes(spark, sf_dir), at)
    return rounded(logs.load(spark, at).df)


@query("""WITH {e} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS seq, round(t, 3) AS t, round(value, 6) AS x, round(sin(value / 100), 6) AS qz FROM e""")
def poses_from_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamped poses with whole nanoseconds become pose samples."""
    df = table(spark, sf_dir, "events").orderBy("event_id")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    stamp = F.struct(F.floor(us / 1_000_000).alias("sec"), ((us % 1_000_000) * 1000).alias("nanosec"))
    v, zero = F.col("value"), F.lit(0.0)
    pose = F.struct(F.struct(v.alias("x"), zero.alias("y"), zero.alias("z")).alias("position"), F.struct(zero.alias("x"), zero.alias("y"), F.sin(v / 100).alias("z"), F.cos(v / 100).alias("w")).alias("orientation"))
    out = logs.poses_from_messages(df.select("user_id", F.struct(stamp.alias("stamp")).alias("header"), pose.alias("pose")), lane="user_id")
    return out.df.select("user_id", "seq", F.round(F.col("time") / 1e9, 3).alias("t"), F.round("pose.p.x", 6).alias("x"), F.round("pose.q.z", 6).alias("qz"))

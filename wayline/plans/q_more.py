"""Missing values, every arithmetic function, frames across frames, and policies of clocks and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions import numeric as nm
from wayline.operators import asof
from wayline.operators import combine as cb
from wayline.operators import events as ev
from wayline.operators import reduce as rd
from wayline.plans.catalog import lanes, query, rounded, table
from wayline.plans.q_clock import TWO, _filled, _two
from wayline.plans.q_combine import PAIR, _pair

# NULL in every seventh sample, NaN in every eleventh: both are missing

GAPS = "m AS (SELECT user_id, seq, t, CASE WHEN seq % 7 = 3 OR seq % 11 = 5 THEN NULL ELSE value END AS value FROM e)"


def _gaps(spark: SparkSession, sf_dir: str) -> LaneFrame:
    f = lanes(spark, sf_dir)
    nan = F.when(F.col("seq") % 11 == 5, F.lit(float("nan"))).otherwise(F.col("value"))
    return f.with_fields(value=F.when(F.col("seq") % 7 == 3, F.lit(None)).otherwise(nan))


@query(f"""WITH {{e}}, {GAPS} SELECT user_id, round(avg(value), 6) AS mean, round(coalesce(sum(value), 0), 6) AS sum, round(var_pop(value), 6) AS var, round(stddev_pop(value), 6) AS std, CAST(round(median(value), 6) AS DOUBLE) AS median,
  min(value) AS min, max(value) AS max, count(value) AS count, bool_or(value IS NULL OR value <> 0) AS any, bool_and(value IS NULL OR value <> 0) AS all FROM m GROUP BY user_id""")
def reduce_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _gaps(spark, sf_dir).df
    return rounded(df.groupBy("user_id").agg(*(rd.reducer(op, F.col("value")).alias(op) for op in rd.REDUCERS)))


@query("WITH {e} SELECT user_id, round(avg(CASE WHEN seq % 11 = 5 THEN NULL ELSE value END), 6) AS value FROM e GROUP BY user_id")
def reduce_raw_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN in a plain table is skipped like a missing value."""
    df = lanes(spark, sf_dir).df.withColumn("value", F.when(F.col("seq") % 11 == 5, F.lit(float("nan"))).otherwise(F.col("value")))
    return rounded(rd.reduce_by(df, ["user_id"], "mean", ["value"]))


@query(f"""WITH {{e}}, {GAPS}, o AS (SELECT *, coalesce(value > 20, false) AS o FROM m), w AS (SELECT *, coalesce(lag(o) OVER p, false) AS was FROM o WINDOW p AS (PARTITION BY user_id ORDER BY seq)),
i AS (SELECT *, sum(CASE WHEN o AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM w),
s AS (SELECT user_id, min(t) AS a, max(t) AS b, min(seq) AS start_index, max(seq) AS end_index FROM i WHERE o GROUP BY user_id, island)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_index) - 1 AS INT) AS segment, round(a, 6) AS start_time, round(b, 6) AS end_time, start_index, end_index FROM s""")
def intervals_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value makes a condition false."""
    return rounded(ev.intervals(_gaps(spark, sf_dir), F.col("value") > 20, include_initial=True))


@query(f"WITH {{e}}, {GAPS} SELECT user_id, seq, round(value, 6) AS value, value IS NULL AS missing, value IS NOT NULL AS finite FROM m")
def isnan_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _gaps(spark, sf_dir).df
    return rounded(df.select("user_id", "seq", "value", nm.UNARY["isnan"](F.col("value")).alias("missing"), nm.UNARY["isfinite"](F.col("value")).alias("finite")))


# every arithmetic function

ONE = {
    "abs": "abs(x)", "absolute": "abs(x)", "fabs": "abs(x)", "negative": "-x", "positive": "x", "sign": "CAST(sign(x) AS DOUBLE)", "sqrt": "sqrt(abs(x))", "square": "x * x", "cbrt": "cbrt(x)", "reciprocal": "1 / (y + 1)",
    "exp": "exp(y)", "exp2": "2.0::DOUBLE ** y", "expm1": "exp(y) - 1", "log": "ln(y + 1)", "log2": "log2(y + 1)", "log10": "log10(y + 1)", "log1p": "ln(1 + y)",
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(y)", "arcsin": "asin(y / 10)", "asin": "asin(y / 10)", "arccos": "acos(y / 10)", "acos": "acos(y / 10)", "arctan": "atan(x)", "atan": "atan(x)",
    "sinh": "sinh(y)", "cosh": "cosh(y)", "tanh": "tanh(y)", "arcsinh": "asinh(x)", "asinh": "asinh(x)", "arccosh": "acosh(y + 1)", "acosh": "acosh(y + 1)", "arctanh": "atanh(y / 10)", "atanh": "atanh(y / 10)",
    "deg2rad": "radians(x)", "radians": "radians(x)", "rad2deg": "degrees(y)", "degrees": "degrees(y)", "ceil": "ceil(x)", "floor": "floor(x)", "trunc": "trunc(x)", "rint": "round_even(x, 0)",
    "isnan": "false", "isinf": "false", "isfinite": "true", "signbit": "x < 0", "conj": "x", "conjugate": "x", "angle": "CASE WHEN x < 0 THEN pi() ELSE 0.0 END",
}
#: What a function is given where it isn't x, with y between 0 and 4.
GIVEN = {"sqrt": "abs", "arcsin": "tenth", "asin": "tenth", "arccos": "tenth", "acos": "tenth", "arctanh": "tenth", "atanh": "tenth", "reciprocal": "more", "log": "more", "log2": "more", "log10": "more", "arccosh": "more", "acosh": "more"} | dict.fromkeys(
    ("exp", "exp2", "expm1", "log1p", "tan", "sinh", "cosh", "tanh", "rad2deg", "degrees"), "y"
)
TWO_ARGS = {
    "add": "x + y", "subtract": "x - y", "multiply": "x * y", "divide": "x / (y + 1)", "true_divide": "x / (y + 1)", "floor_divide": "floor(x / (y + 1))", "mod": "x - (y + 1) * floor(x / (y + 1))", "remainder": "x - (y + 1) * floor(x / (y + 1))",
    "fmod": "x - (y + 1) * trunc(x / (y + 1))", "power": "(y + 1) ** y", "pow": "(y + 1) ** y", "float_power": "(y + 1) ** y", "maximum": "greatest(x, y)", "minimum": "least(x, y)", "fmax": "greatest(x, y)", "fmin": "least(x, y)",
    "arctan2": "atan2(x, y + 1)", "atan2": "atan2(x, y + 1)", "hypot": "sqrt(x * x + y * y)", "copysign": "CASE WHEN x < 0 THEN -y ELSE y END", "logaddexp": "ln(exp(y) + exp(y + 1))", "logaddexp2": "log2(2.0::DOUBLE ** y + 2.0::DOUBLE ** (y + 1))",
    "heaviside": "CASE WHEN x < 0 THEN 0.0 WHEN x = 0 THEN y ELSE 1.0 END::DOUBLE", "ldexp": "x * 2.0::DOUBLE ** n", "bitwise_and": "k & n", "bitwise_or": "k | n", "bitwise_xor": "xor(k, n)", "left_shift": "k << n", "right_shift": "k >> n",
    "gcd": "gcd(k, n)", "lcm": "lcm(k, n)", "equal": "x = y", "not_equal": "x <> y", "greater": "x > y", "greater_equal": "x >= y", "less": "x < y", "less_equal": "x <= y",
}
INPUTS = "SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 2 + 0.25::DOUBLE AS x, l_discount * 40 AS y, CAST(l_quantity AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem"


def _shown(sql: str, boolean: bool) -> str:
    return sql if boolean else f"round(CAST({sql} AS DOUBLE), 5)"


BOOLEAN = ("isnan", "isinf", "isfinite", "signbit", "equal", "not_equal", "greater", "greater_equal", "less", "less_equal")


def _columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    x = (F.col("l_quantity") - 25) / 2 + 0.25
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), (F.col("l_discount") * 40).alias("y"), F.col("l_quantity").cast("long").alias("k"), F.col("l_linenumber").cast("long").alias("n"))
    return df, {"x": F.col("x"), "y": F.col("y"), "abs": F.abs("x"), "tenth": F.col("y") / 10, "more": F.col("y") + 1}


def _out(name: str, value: Column) -> Column:
    return (value if name in BOOLEAN else F.round(value.cast("double"), 5)).alias(f"f_{name}")


@query(f"WITH i AS ({INPUTS}) SELECT l_orderkey, l_linenumber, {', '.join(f'{_shown(s, n in BOOLEAN)} AS f_{n}' for n, s in ONE.items())} FROM i")
def ufunc_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, given = _columns(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", *(_out(n, nm.UNARY[n](given[GIVEN.get(n, "x")])) for n in ONE))


@query(f"WITH i AS ({INPUTS}) SELECT l_orderkey, l_linenumber, {', '.join(f'{_shown(s, n in BOOLEAN)} AS f_{n}' for n, s in TWO_ARGS.items())} FROM i")
def ufunc_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, given = _columns(spark, sf_dir)
    whole = ("bitwise_and", "bitwise_or", "bitwise_xor", "left_shift", "right_shift", "gcd", "lcm")
    shifted = {"divide", "true_divide", "floor_divide", "mod", "remainder", "fmod", "arctan2", "atan2"}

    def args(n: str) -> tuple[Column, Column]:
        if n in whole:
            return F.col("k"), F.col("n")
        if n in ("power", "pow", "float_power"):
            return given["more"], given["y"]
        if n in ("logaddexp", "logaddexp2"):
            return given["y"], given["more"]
        if n == "copysign":
            return given["y"], given["x"]
        if n == "ldexp":
            return given["x"], F.col("n")
        return given["x"], given["more"] if n in shifted else given["y"]

    return df.select("l_orderkey", "l_linenumber", *(_out(n, nm.BINARY[n](*args(n))) for n in TWO_ARGS))


# clocks

LONE = """
h AS (SELECT user_id, floor(t / 3600) AS t, event_type, avg(value) AS value FROM e GROUP BY ALL),
a AS (SELECT user_id, t, value FROM h WHERE event_type = 'view' AND user_id % 3 > 0), b AS (SELECT user_id, t, value FROM h WHERE event_type = 'click' AND user_id % 3 < 2)"""


@query(f"""WITH {{e}}, {LONE}, g AS (SELECT user_id, t FROM a UNION SELECT user_id, t FROM b), {_filled('a', 'fa')}, {_filled('b', 'fb')}
SELECT g.user_id, row_number() OVER (PARTITION BY g.user_id ORDER BY g.t) - 1 AS seq, g.t, round(fa.v, 6) AS a, round(fb.v, 6) AS b
FROM g LEFT JOIN fa ON g.user_id = fa.user_id AND g.t = fa.t LEFT JOIN fb ON g.user_id = fb.user_id AND g.t = fb.t""")
def sync_outer_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes that only one of the streams has stay, with the other's values missing."""
    a, b = _two(spark, sf_dir)
    a, b = a.over(a.df.where("user_id % 3 > 0")), b.over(b.df.where("user_id % 3 < 2"))
    return rounded(asof.synchronized([a, b], join="outer", lanes="outer").df.select("user_id", "seq", "t", "a", "b"))


@query("WITH {e} SELECT user_id, seq, round(t, 6) AS t, round(value, 6) AS a, round(value + 1, 6) AS b FROM e")
def sync_exact_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks that differ by less than the tolerance count as the same."""
    f = lanes(spark, sf_dir)
    late = f.over(f.df.withColumn("t", F.col("t") + 1e-7)).with_fields(b=F.col("value") + 1).select("b")
    return rounded(asof.synchronized([f.rename(value="a"), late], join="exact", how="nearest", tol=1e-6).df.select("user_id", "seq", "t", "a", "b"))


@query(f"""WITH {{e}}, {TWO}, g AS (SELECT user_id, t FROM a), {_filled('b', 'fb')}
SELECT a.user_id, row_number() OVER (PARTITION BY a.user_id ORDER BY a.t) - 1 AS seq, a.t, round(a.value, 6) AS a, coalesce(a.value > fb.v, false) AS mask FROM a LEFT JOIN fb ON a.user_id = fb.user_id AND a.t = fb.t""")
def cond_across_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition between a stream and another one on its clock."""
    a, b = _two(spark, sf_dir)
    both = ev.with_operands(a, {"other": b})
    return rounded(ev.mask(both, F.col("a") > F.col("other")).select("user_id", "seq", "t", "a", "mask"))


@query("""WITH {e}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(t - 500000), t) AS r FROM e) SELECT user_id, seq, round(t, 6) AS t, value FROM n WHERE r = 1""")
def sel_nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir).sel(method="nearest", t=500_000.0).df)


@query("""WITH {e}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS r FROM e WHERE t <= 500000 AND t >= 400000) SELECT user_id, seq, round(t, 6) AS t, value FROM n WHERE r = 1""")
def sel_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir).sel(method="pad", tolerance=100_000.0, t=500_000.0).df)


@query("""WITH {e}, s AS (SELECT * FROM e WHERE abs(value - 10) <= 0.6)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS INT) AS event, round(t, 6) AS time, 3 AS edge_code, seq AS sample_index_before, seq AS sample_index_after FROM s""")
def events_trigger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.events(lanes(spark, sf_dir), ev.equals(F.col("value"), F.lit(10.0), 0.5, 0.01), trigger=True).where(F.col("edge_code") == ev.TRIGGER)
    anchors = ev.explicit_anchors(found, ["user_id"], "time").select("user_id", "event", "time")
    return rounded(anchors.join(found.drop("event"), ["user_id", "time"]).select("user_id", "event", "time", "edge_code", "sample_index_before", "sample_index_after"))


@query("""WITH {e}, o AS (SELECT *, abs(value - 10) <= 3 AS o FROM e), i AS (SELECT *, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS g FROM o WHERE o),
s AS (SELECT user_id, min(t) AS a, max(t) AS b, min(seq) AS i, max(seq) AS j, false AS is_trigger FROM i GROUP BY user_id, g HAVING count(*) > 1 AND min(seq) > 0 UNION ALL SELECT user_id, t, t, seq, seq, true FROM i)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY i, is_trigger) - 1 AS INT) AS segment, round(a, 6) AS start_time, round(b, 6) AS end_time, i AS start_index, j AS end_index, is_trigger FROM s""")
def intervals_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of an equality: those of one sample are told as triggers only."""
    return rounded(ev.intervals(lanes(spark, sf_dir), ev.equals(F.col("value"), F.lit(10.0), 3.0, 0.0), trigger=True))


@query("""WITH {e}, o AS (SELECT *, value > 20 AS o FROM e), w AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY seq), false) AS was FROM o),
i AS (SELECT *, sum(CASE WHEN o AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) - 1 AS s FROM w)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS seq, CAST(s AS INT) AS stream_segment_index, seq AS orig_index, value FROM i WHERE o""")
def when_segments_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    return ev.stream_segments(ev.when(f, F.col("value") > 20, "segments"), f.keys, f.seq).select("user_id", "seq", "stream_segment_index", "orig_index", "value")


# frames of frames

THREE = f"{PAIR}, c AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS seq, t, value AS c FROM e WHERE event_type = 'purchase')"


@query(f"WITH {{e}}, {THREE} SELECT user_id, seq, round(coalesce(a.t, b.t, c.t), 6) AS t, a, b, c FROM a FULL JOIN b USING (user_id, seq) FULL JOIN c USING (user_id, seq)")
def merge_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark, sf_dir)
    f = lanes(spark, sf_dir, "event_type")
    c = f.over(f.df.where("event_type = 'purchase'")).set_roles(fields=("value",)).renumbered().select("value").rename(value="c")
    return rounded(cb.merge(a, b, c, lanes="outer", samples="outer").df)


@query("WITH {e} SELECT user_id, seq, round(t, 6) AS t, value, round(value * 2, 6) AS twice FROM e")
def merge_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    return rounded(cb.merge(f, f.with_fields(twice=F.col("value") * 2), compat="equals").df)


@query(f"WITH {{e}}, {PAIR} SELECT a.user_id, a.seq, a, b FROM a LEFT JOIN b USING (user_id, seq)")
def align_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = cb.align_pair(*_pair(spark, sf_dir), lanes="left", samples="left")
    return a.df.drop("t").join(b.df.drop("t"), ["user_id", "seq"])


@query(f"WITH {{e}}, {PAIR} SELECT a.user_id, a.seq, a AS m00, b AS m01, b AS m10, a AS m11 FROM a JOIN b USING (user_id, seq)")
def assemble_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four frames as one of 2 x 2 matrices."""
    a, b = _pair(spark, sf_dir)
    out = cb.assemble_core([[a, b], [b, a]], "m", lanes="inner", samples="inner").df
    return out.select("user_id", "seq", *(F.get(F.get("m", F.lit(i)), F.lit(j)).alias(f"m{i}{j}") for i in (0, 1) for j in (0, 1)))


@query("WITH {e} SELECT user_id, seq, value AS v0, round(value + 1, 6) AS v1, round(value * 2, 6) AS v2 FROM e")
def concat_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array fields of two frames end to end."""
    f = lanes(spark, sf_dir)
    a, b = f.with_fields(v=F.array("value", F.col("value") + 1)).select("v"), f.with_fields(v=F.array(F.col("value") * 2)).select("v")
    out = cb.concat_frames([a, b], "w").df
    return rounded(out.select("user_id", "seq", *(F.get("w", F.lit(i)).alias(f"v{i}") for i in range(3))))


@query("WITH {e} SELECT user_id, seq, round(value * 2 - 1, 6) AS value FROM e")
def binary_on_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that number their samples differently meet by the clock."""
    f = lanes(spark, sf_dir)
    once = f.over(f.df.dropDuplicates(["user_id", "t"]))
    other = once.over(once.df.withColumn("seq", F.lit(10_000_000) - F.col("seq"))).map_fields(lambda x: x - 1)
    return rounded(cb.binary(once, other, lambda a, b: a + b, on="param").df.select("user_id", "seq", "value"))


@query("WITH {e} SELECT user_id, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 6) AS value FROM e GROUP BY user_id")
def weighted_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights labelled by lane, from another table."""
    f = lanes(spark, sf_dir)
    w = f.df.select("user_id").distinct().withColumn("weight", 1 + F.col("user_id") % 3)
    return rounded(rd.reduce_by(rd.weighted(f, w).df, ["user_id"], "mean", ["value"], weight=F.col("weight")))


@query("WITH {e} SELECT user_id, seq, round(value * 2, 6) AS a, round(value + 1, 6) AS b FROM e")
def components_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    a, b = f.with_fields(a=F.col("value") * 2).select("a"), f.with_fields(b=F.col("value") + 1).select("b")
    return rounded(LaneFrame.compose_components({"first": a, "second": b}).df.select("user_id", "seq", "a", "b"))




@query("WITH {e} SELECT user_id, seq, round(t, 6) AS t, event_type, 'value' AS field, round(value, 6) AS value FROM e UNION ALL SELECT user_id, seq, round(t, 6), event_type, 'half', round(value / 2, 6) FROM e WHERE value > 1")
def tidy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows for plotting, without missing values."""
    f = lanes(spark, sf_dir, "event_type").set_roles(fields=("value",))
    f = f.over(f.df.withColumn("half", F.when(F.col("value") > 1, F.col("value") / 2)), fields=("value", "half"))
    return rounded(f.tidy("event_type"))

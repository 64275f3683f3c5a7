"""Projection, selection and elementwise functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import numeric as nm
from wayline.plans.catalog import lanes, query, rounded, table


@query("WITH {e} SELECT user_id, seq, round(t, 6) AS t, value FROM e")
def select_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir, "event_type").select("value").df)


@query("WITH {e} SELECT user_id, seq, round(t, 6) AS t, CASE WHEN value > 20 THEN value ELSE -1.0::DOUBLE END AS value FROM e")
def where_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir).where(F.col("value") > 20, other=-1.0).df)


@query("WITH {e} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS seq, round(t, 6) AS t, value FROM e WHERE value > 20")
def where_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir).where(F.col("value") > 20, drop=True).df)


@query("""
WITH {e}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS seq, round(t, 6) AS t, value FROM n WHERE seq >= greatest(n - 5, 0) AND seq < n - 1""")
def isel_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir).isel(slice(-5, -1)).df)


@query("WITH {e} SELECT user_id, seq // 7 AS seq, round(t, 6) AS t, value FROM e WHERE seq % 7 = 0")
def isel_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir).isel(slice(None, None, 7)).df)


@query("""
WITH {e}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e), p(i, p) AS (VALUES (0, 3), (1, -1), (2, 0))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS seq, round(t, 6) AS t, value
FROM n JOIN p ON seq = CASE WHEN p.p >= 0 THEN p.p ELSE n + p.p END""")
def isel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir).isel([3, -1, 0]).df)


@query("WITH {e} SELECT user_id, seq, round(t, 6) AS t, value FROM e WHERE user_id BETWEEN 3 AND 9 AND seq IN (0, 2, 4)")
def sel_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes(spark, sf_dir).sel(user_id=slice(3, 9), seq=[0, 2, 4]).df)


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 6) AS net, round(l_extendedprice / l_quantity * 0.123456789::DOUBLE, 6) AS unit,
       CASE WHEN l_linenumber = 3 THEN 'inf' ELSE CAST(CAST(round(l_quantity / (l_linenumber - 3)) AS BIGINT) AS VARCHAR) END AS pole,
       CAST(floor(l_quantity / 7) AS DOUBLE) AS whole, round(l_linenumber - 3 - floor((l_linenumber - 3) / 4::DOUBLE) * 4, 6) AS remainder, round(l_quantity ** 2, 6) AS squared
FROM lineitem""")
def ufunc_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    pole = nm.divide(q, n - 3)
    return rounded(
        li.select(
            "l_orderkey", "l_linenumber",
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax")).alias("net"),
            (nm.divide(F.col("l_extendedprice"), q) * 0.123456789).alias("unit"),
            F.when(pole == float("inf"), "inf").otherwise(F.round(F.when(pole != float("inf"), pole)).cast("long").cast("string")).alias("pole"),
            nm.floor_divide(q, F.lit(7.0)).alias("whole"), nm.mod(n - 3, F.lit(4.0)).alias("remainder"), nm.power(q, F.lit(2)).alias("squared"),
        )
    )


@query("""
SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS root, round(ln(l_quantity), 6) AS log, round(log2(l_quantity), 6) AS log2, round(exp(-l_quantity / 10), 6) AS exp,
       round(sin(l_quantity), 6) AS sin, round(atan2(l_tax, l_quantity), 6) AS atan2, round(sqrt(l_tax * l_tax + l_quantity * l_quantity), 6) AS hypot,
       CAST(sign(l_quantity - 25) AS DOUBLE) AS sign, CAST(trunc(-l_quantity / 7) AS DOUBLE) AS trunc, round(cbrt(l_quantity), 6) AS cbrt,
       CASE WHEN l_quantity < 25 THEN 0.0 WHEN l_quantity = 25 THEN 0.5 ELSE 1.0 END::DOUBLE AS heaviside, greatest(l_quantity, 30.0) AS top
FROM lineitem""")
def ufunc_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, tax = F.col("l_quantity"), F.col("l_tax")
    return rounded(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", nm.UNARY["sqrt"](q).alias("root"), nm.UNARY["log"](q).alias("log"), nm.UNARY["log2"](q).alias("log2"), nm.UNARY["exp"](-q / 10).alias("exp"),
            nm.UNARY["sin"](q).alias("sin"), nm.BINARY["arctan2"](tax, q).alias("atan2"), nm.BINARY["hypot"](tax, q).alias("hypot"), nm.UNARY["sign"](q - 25).alias("sign"),
            nm.UNARY["trunc"](-q / 7).alias("trunc"), nm.UNARY["cbrt"](q).alias("cbrt"), nm.BINARY["heaviside"](q - 25, F.lit(0.5)).alias("heaviside"), nm.BINARY["maximum"](q, F.lit(30.0)).alias("top"),
        )
    )


@query("""
WITH {e} SELECT user_id, seq, round(value, 6) AS low FROM e""")
def components_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir).with_fields(high=F.col("value") + 1).rename(value="low").define_components(bottom=["low"], top=["high"])
    return rounded(f.component("bottom").df.select("user_id", "seq", "low"))


@query("WITH {e} SELECT user_id, seq, round(value * 2, 6) AS a, round(value + 1, 6) AS b FROM e")
def components_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir).with_fields(a=F.col("value"), b=F.col("value") + 1).select("a", "b").define_components(first=["a"], second=["b"])
    return rounded(f.patch_component("first", f.component("first").map_fields(lambda x: x * 2)).df.select("user_id", "seq", "a", "b"))

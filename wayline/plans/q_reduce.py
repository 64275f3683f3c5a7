"""Reducers and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.operators import reduce as rd
from wayline.plans.catalog import lanes, query, rounded, table

SQL_OF = {
    "mean": "avg(value)", "sum": "sum(value)", "std": "stddev_pop(value)", "var": "var_pop(value)", "median": "CAST(median(value) AS DOUBLE)", "min": "min(value)", "max": "max(value)",
    "count": "count(value)", "any": "bool_or(value <> 0)", "all": "bool_and(value <> 0)",
}


def _register(op: str) -> None:
    shown = f"round({SQL_OF[op]}, 6)" if op not in ("count", "any", "all") else SQL_OF[op]

    @query(f"WITH {{e}} SELECT user_id, {shown} AS value FROM e GROUP BY user_id", f"reduce_{op}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(rd.reduce_lanes(lanes(spark, sf_dir), op))


for _op in rd.REDUCERS:
    _register(_op)


@query("WITH {e} SELECT seq, round(avg(value), 6) AS value FROM e GROUP BY seq")
def reduce_over_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rd.reduce_lanes(lanes(spark, sf_dir), "mean", over="lanes"))


@query("WITH {e} SELECT round(sum(value), 3) AS value FROM e")
def reduce_all_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rd.reduce_lanes(lanes(spark, sf_dir), "sum", over="all"), 3)


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS l_extendedprice FROM lineitem GROUP BY l_orderkey")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rd.reduce_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "mean", ["l_extendedprice"], weight=F.col("l_quantity")))


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_discount), 6) AS l_extendedprice FROM lineitem GROUP BY l_orderkey")
def weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rd.reduce_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "sum", ["l_extendedprice"], weight=F.col("l_discount")))


@query("SELECT l_orderkey, round(var_samp(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY l_orderkey")
def sample_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rd.reduce_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "var", ["l_quantity"], ddof=1))


@query("WITH {e} SELECT user_id, CASE WHEN min(value) >= 0.2 THEN round(avg(value), 6) END AS value FROM e GROUP BY user_id")
def skipna_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    return rounded(rd.reduce_lanes(f.where(F.col("value") >= 0.2), "mean", skipna=False))


@query("WITH {e} SELECT event_type, round(avg(value), 6) AS value FROM e GROUP BY event_type")
def group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rd.Grouped(lanes(spark, sf_dir, "event_type").set_roles(fields=("value",)), {"event_type": F.col("event_type")}).reduce("mean"))


@query("WITH {e} SELECT user_id, event_type, CAST(floor(t / 604800) AS BIGINT) AS week, round(max(value), 6) AS value FROM e GROUP BY ALL")
def group_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir, "event_type").set_roles(fields=("value",))
    keys = {"event_type": F.col("event_type"), "week": F.floor(F.col("t") / 604_800)}
    return rounded(rd.Grouped(f, keys, preserve_lanes=True).reduce("max"))


BINS = "CASE WHEN value > 0 AND value <= 10 THEN 0 WHEN value > 10 AND value <= 50 THEN 1 WHEN value > 50 AND value <= 1000 THEN 2 WHEN value > 1000 AND value <= 2000 THEN 3 END"


@query(f"WITH {{e}} SELECT {BINS} AS bin, round(avg(value), 6) AS value FROM e WHERE {BINS} IS NOT NULL GROUP BY 1")
def group_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rd.Grouped.by_bins(lanes(spark, sf_dir), F.col("value"), [0, 10, 50, 1000, 2000], empty=False).reduce("mean"))


@query(f"WITH {{e}}, b AS (SELECT {BINS} AS bin, value FROM e) SELECT CAST(i AS INT) AS bin, count(value) AS value FROM range(4) AS r(i) LEFT JOIN b ON b.bin = i GROUP BY i")
def group_bins_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.Grouped.by_bins(lanes(spark, sf_dir), F.col("value"), [0, 10, 50, 1000, 2000]).reduce("count")


@query("WITH {e} SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY user_id, seq) - 1 AS member, value FROM e")
def group_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir, "event_type").set_roles(fields=("value",))
    return rd.Grouped(f, {"event_type": F.col("event_type")}).padded()


@query("""
WITH {e}, n AS (SELECT *, row_number() OVER (ORDER BY user_id, seq) AS n FROM e), r AS (SELECT event_type, row_number() OVER (ORDER BY min(n)) - 1 AS group_rank FROM n GROUP BY event_type)
SELECT event_type, group_rank, row_number() OVER (PARTITION BY event_type ORDER BY n) - 1 AS member, seq AS sequence_index, value FROM n JOIN r USING (event_type)""")
def group_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir, "event_type").set_roles(fields=("value",))
    return rd.Grouped(f, {"event_type": F.col("event_type")}).stacked()


@query("""
SELECT c_mktsegment, round(avg(o_totalprice), 4) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def batch_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = LaneFrame.of(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_totalprice"], order=["o_orderkey"])
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return rounded(rd.group_lanes(f, customers, "c_mktsegment", "mean"), 4)

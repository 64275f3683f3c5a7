"""Queries over the given tables, each with SQL for the same rows.

Lanes are the users of ``events``: their clock is seconds since the start of 2024, their field is ``value``. Doubles
are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.operators import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EPOCH = 1_704_067_200_000_000
LANES_SQL = f"""e AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS BIGINT) AS seq, t, value, event_type, event_id
  FROM (SELECT *, (epoch_us(ts) - {EPOCH}) / CAST(1000000 AS DOUBLE) AS t FROM events)
)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL for its rows (``{e}`` stands for the lanes)."""

    def held(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql.replace("{e}", LANES_SQL).strip()
        return f

    return held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', {ts})")
    return micros.cast("double") / 1_000_000.0


def lanes(spark: SparkSession, sf_dir: str, *more: str) -> LaneFrame:
    """The samples of ``events``, with further payload columns if named."""
    df = scan.spread(table(spark, sf_dir, "events"), ["user_id"]).withColumn("t", seconds("ts"))
    return LaneFrame.of(df, ["user_id"], "t", ["value", *more], order=["event_id"])


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["interval_durations"](spark, sf_dir)


# the queries register themselves
from wayline.plans import q_bags, q_clock, q_combine, q_edges, q_events, q_labels, q_more, q_motion, q_reduce, q_sky, q_space, q_structure, q_time  # noqa: E402, F401

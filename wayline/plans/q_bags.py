"""Lanes of poses written as bags to the shared folder, and read again by the data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions import spatial as sp
from wayline.plans.catalog import query, table
from wayline.sources import bags, shared


def _poses(spark: SparkSession, sf_dir: str) -> LaneFrame:
    """Each event as a pose, with whole nanoseconds as the clock."""
    v = F.col("value")
    pose = sp.pose(sp.vector(v, v / 2, F.lit(-1.0)), sp.quaternion(F.lit(0.0), F.lit(0.0), F.sin(v / 100), F.cos(v / 100)))
    time = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") * 1000
    return LaneFrame.of(table(spark, sf_dir, "events").withColumns({"time": time, "pose": pose}), ["user_id"], "time", ["pose"], order=["event_id"])


def _written(spark: SparkSession, sf_dir: str, **named: str) -> str:
    at = shared.folder(spark, "bags")
    bags.write_bag_logs(_poses(spark, sf_dir), at, **named)
    return at


SAMPLES = "b AS (SELECT CAST(user_id AS VARCHAR) AS trial, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_us(ts) * 1000 AS time, value FROM events)"


@query(f"WITH {SAMPLES} SELECT trial, seq, time, round(value, 6) AS x, round(value / 2, 6) AS y, -1.0::DOUBLE AS z, round(sin(value / 100), 6) AS qz, round(cos(value / 100), 6) AS qw FROM b")
def bag_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bags.read_bag_logs(spark, _written(spark, sf_dir, parent="map")).df
    parts = {"x": "pose.p.x", "y": "pose.p.y", "z": "pose.p.z", "qz": "pose.q.z", "qw": "pose.q.w"}
    return got.select("trial", "seq", "time", *(F.round(c, 6).alias(n) for n, c in parts.items()))


@query("SELECT CAST(user_id AS VARCHAR) AS trial, 'map' AS parent, 'base' AS child, count(*) AS messages, min(epoch_us(ts)) * 1000 AS first, max(epoch_us(ts)) * 1000 AS last FROM events GROUP BY user_id")
def bag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bag holds: its frames, and its messages with their first and last time."""
    return bags.bag_index(spark, _written(spark, sf_dir, parent="map", child="base"))

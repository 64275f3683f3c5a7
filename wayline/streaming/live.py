"""The lane operators that make sense while samples still arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_samples(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of samples as they appear in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def windowed(samples: DataFrame, keys: list[str], time: str, field: str, every: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean, least and greatest value of each lane in tumbling or sliding windows; rows later than ``late`` go."""
    span = F.window(time, every, slide) if slide else F.window(time, every)
    held = samples.withWatermark(time, late).groupBy(*keys, span.alias("window"))
    out = held.agg(F.count(field).alias("n"), F.avg(field).alias("mean"), F.min(field).alias("low"), F.max(field).alias("high"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "low", "high")


def sessions(samples: DataFrame, keys: list[str], time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Stretches of each lane without a pause of ``gap``."""
    held = samples.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("session"))
    return held.agg(F.count("*").alias("n")).select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def live_intervals(samples: DataFrame, key: str, clock: str, cond: Column) -> DataFrame:
    """(key, start_time, end_time) of true stretches, each given out when the first false sample after it arrives.

    The state of a lane is the open stretch and the clock so far; samples behind that clock are left out.
    """
    kind = dict(samples.dtypes)[key]
    rows = samples.select(F.col(key).alias("key"), F.col(clock).cast("double").alias("t"), F.coalesce(cond, F.lit(False)).alias("on"))

    def advance(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, start, last, seen = state.get if state.exists else (False, 0.0, 0.0, float("-inf"))
        out = []
        batch = pd.concat(list(frames)).sort_values("t", kind="stable")
        for t, on in zip(batch["t"], batch["on"], strict=True):
            if t < seen:
                continue
            if on and not opened:
                opened, start = True, t
            elif not on and opened:
                out.append((k[0], start, last))
                opened = False
            last, seen = (t if on else last), t
        state.update((opened, start, last, seen))
        yield pd.DataFrame(out, columns=["key", "start_time", "end_time"])

    return rows.groupBy("key").applyInPandasWithState(
        advance, f"key {kind}, start_time double, end_time double", "opened boolean, start double, last double, seen double", "append", GroupStateTimeout.NoTimeout
    )

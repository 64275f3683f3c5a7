"""Geodetic positions on the clock of each lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions import geo
from wayline.functions import spatial as sp
from wayline.operators import asof
from wayline.operators.frames import _alpha, _bracketed, _policy

METHODS = ("nearest", "geodesic_linear", "ecef_linear", "local_enu_linear")


def at(samples: LaneFrame, name: str, queries: DataFrame, on: str, output: str, method: str = "geodesic_linear", duplicates: str = "invalid", origin: Column | None = None) -> DataFrame:
    """queries with the position (lat, lon, alt) at their clock.

    geodesic_linear: along the geodesic, heights blended; ecef_linear: along the straight line through the Earth; local_enu_linear: blended
    in the tangent plane at ``origin`` (default: the left sample); nearest: clamped outside, ties go left.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    q = asof.ticks_of(queries, on)
    found, last = _bracketed(samples, name, queries, on, duplicates)
    a, b = F.col(f"__left.{name}"), F.col(f"__right.{name}")
    if method == "nearest":
        return found.select(*queries.columns, F.when(q.isNotNull(), F.when(asof._nearest_left(q), a).otherwise(b)).alias(output))
    found, k = found.withColumn("__alpha", _alpha(q)), F.col("__alpha")
    if method == "geodesic_linear":
        found = found.withColumn("__point", geo.geodesic_between(a["lat"], a["lon"], b["lat"], b["lon"], k))
        inner = geo.lla(F.col("__point.lat"), F.col("__point.lon"), (1 - k) * a["alt"] + k * b["alt"])
    else:
        line = sp.vadd(sp.vscale(F.col("__a"), 1 - k), sp.vscale(F.col("__b"), k))
        if method == "ecef_linear":
            found = found.withColumns({"__a": geo.to_ecef(a), "__b": geo.to_ecef(b)}).withColumn("__line", line)
            inner = geo.from_ecef(F.col("__line"))
        else:
            found = found.withColumn("__o", a if origin is None else origin).withColumns({"__a": geo.to_enu(a, F.col("__o")), "__b": geo.to_enu(b, F.col("__o"))}).withColumn("__line", line)
            inner = geo.from_ecef(geo.enu_to_ecef(F.col("__line"), F.col("__o")))
    found = found.withColumn("__inner", F.when(F.col("__left").isNotNull() & F.col("__right").isNotNull(), inner))
    return found.select(*queries.columns, _policy(q, duplicates, b, b, last, F.col("__inner")).alias(output))


def resample_to(samples: LaneFrame, name: str, grid: DataFrame, method: str = "geodesic_linear", duplicates: str = "invalid") -> LaneFrame:
    """Positions on another clock (lane keys, seq, clock)."""
    points = grid.select(*samples.keys, samples.seq, samples.clock)
    return samples.select(name).over(at(samples, name, points, samples.clock, name, method, duplicates))


def interp_like(samples: LaneFrame, name: str, other: LaneFrame, method: str = "geodesic_linear", lanes: str = "inner") -> LaneFrame:
    """Positions on the clock of another frame; lanes: inner, or left to keep lanes of other that samples lacks, as missing."""
    clock = other.df.select(*(F.col(c).alias(k) for c, k in zip(other.keys, samples.keys, strict=True)), F.col(other.seq).alias(samples.seq), F.col(other.clock).alias(samples.clock))
    if lanes == "inner":
        clock = clock.join(samples.df.select(*samples.keys).distinct(), list(samples.keys), "left_semi")
    return resample_to(samples, name, clock, method)

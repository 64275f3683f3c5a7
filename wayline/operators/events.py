"""Conditions, boundary events, intervals and event-centred windows.

A condition is a boolean Column over a sample; unknown counts as false. Boundaries are sample times: the first true
sample enters, the last true one exits.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions.clocks import Clock
from wayline.functions.numeric import isclose
from wayline.operators import asof, folds

#: Edge codes and the mark for "no sample": fixed values.
ENTER, EXIT, TRIGGER, NONE = 1, 2, 3, -1


def mask(frame: LaneFrame, cond: Column, name: str = "mask") -> DataFrame:
    """The samples with a boolean column of the condition."""
    return frame.df.withColumn(name, F.coalesce(cond, F.lit(False)))


def equals(a: Column, b: Column, atol: float = 1e-9, rtol: float = 1e-12) -> Column:
    """Equality within tolerances, as events use it."""
    return isclose(a, b, atol, rtol)


def with_operands(frame: LaneFrame, others: dict[str, LaneFrame], interp: str = "linear") -> LaneFrame:
    """The frame with fields of other frames on its own clock, for conditions across frames.

    others: a name to the frame whose one field it becomes; interp: linear or nearest. Lanes that another frame lacks have missing values.
    """
    out = frame
    for name, other in others.items():
        if len(other.fields) != 1:
            raise ValueError(f"operand {name} needs one field")
        value = other.rename(**dict(zip((*other.keys, other.seq, other.clock, other.fields[0]), (*frame.keys, frame.seq, frame.clock, name), strict=True)))
        on_clock = asof.at(value.select(name), out.df.select(*out.df.columns), frame.clock, interp)
        out = out.over(on_clock.select(*out.df.columns, name), fields=(*out.fields, name))
    return out


def _edges(frame: LaneFrame, cond: Column) -> DataFrame:
    order = frame.ordered
    df = mask(frame, cond, "__on")
    return df.withColumns(
        {
            "__was": F.lag("__on").over(order),
            "__will": F.lead("__on").over(order),
            "__before": F.coalesce(F.lag(frame.seq).over(order), F.lit(NONE)).cast("long"),
            "__after": F.coalesce(F.lead(frame.seq).over(order), F.lit(NONE)).cast("long"),
        }
    )


def _event(code: int, time: Column, before: Column, after: Column) -> Column:
    return F.struct(time.alias("time"), F.lit(code).alias("edge_code"), before.cast("long").alias("sample_index_before"), after.cast("long").alias("sample_index_after"))


def _deduped(rows: DataFrame, keys: Sequence[str], atol: object) -> DataFrame:
    """Events without those within atol of the last one kept of the same code, in one pass over a lane's events."""
    clock = Clock.of(rows, "time")
    ticked = rows.withColumn("__ticks", clock.ticks(F.col("time")))
    return folds.thinned(ticked, [*keys, "edge_code"], "__ticks", clock.span(atol), ["sample_index_before", "sample_index_after"]).drop("__ticks")


def events(frame: LaneFrame, cond: Column, include_initial: bool = False, trigger: bool = False, max_events: int | None = None, dedupe_atol: object = None) -> DataFrame:
    """Lane keys, event, time, edge_code, sample_index_before and _after of every boundary.

    include_initial: a lane that begins true enters at its first sample. trigger: also an event at every true sample
    (for equality conditions). dedupe_atol: leave out events so close to the last kept one of their code (with clocks that increase by more
    it never happens); a timedelta where the clock is of instants.
    """
    e, seq, t = _edges(frame, cond), F.col(frame.seq), F.col(frame.clock)
    began = (F.col("__was") == F.lit(False)) | (F.col("__was").isNull() if include_initial else F.lit(False))
    enter = F.when(F.col("__on") & F.coalesce(began, F.lit(False)), _event(ENTER, t, F.col("__before"), seq))
    leave = F.when(F.col("__on") & ~F.coalesce(F.col("__will"), F.lit(False)), _event(EXIT, t, seq, F.col("__after")))
    found = [enter, *([F.when(F.col("__on"), _event(TRIGGER, t, seq, seq))] if trigger else []), leave]
    rows = e.select(*frame.keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select(*frame.keys, "x.*")
    rows = rows if dedupe_atol is None else _deduped(rows, frame.keys, dedupe_atol)
    rank = F.when(F.col("edge_code") == ENTER, 0).when(F.col("edge_code") == TRIGGER, 1).otherwise(2)
    order = W.partitionBy(*frame.keys).orderBy("time", rank, "sample_index_before", "sample_index_after")
    out = rows.withColumn("event", (F.row_number().over(order) - 1).cast("int"))
    out = out if max_events is None else out.where(F.col("event") < max_events)
    return out.select(*frame.keys, "event", "time", "edge_code", "sample_index_before", "sample_index_after")


def intervals(frame: LaneFrame, cond: Column, include_initial: bool = False, max_segments: int | None = None, trigger: bool = False) -> DataFrame:
    """Lane keys, segment, start_time, end_time, start_index, end_index of every true stretch.

    One that begins with its lane counts only with include_initial. trigger (for equality conditions): every true sample is a stretch of
    its own too, with a column is_trigger, and stretches of one sample are told only once, as triggers.
    """
    order = frame.ordered
    df = mask(frame, cond, "__on").withColumn("__was", F.lag("__on").over(order))
    start = F.col("__on") & ~F.coalesce(F.col("__was"), F.lit(False))
    df = df.withColumn("__island", F.sum(start.cast("int")).over(order)).withColumn("__first", F.col("__was").isNull())
    on = df.where("__on").groupBy(*frame.keys, "__island").agg(
        F.min(frame.clock).alias("start_time"), F.max(frame.clock).alias("end_time"), F.min(frame.seq).alias("start_index"), F.max(frame.seq).alias("end_index"), F.bool_or("__first").alias("__first")
    )
    on = on if include_initial else on.where("NOT __first")
    on = on.withColumn("is_trigger", F.lit(False))
    if trigger:
        t, n = F.col(frame.clock), F.col(frame.seq)
        single = df.where("__on").select(*frame.keys, t.alias("start_time"), t.alias("end_time"), n.alias("start_index"), n.alias("end_index"), F.lit(True).alias("is_trigger"))
        on = on.where(F.col("start_index") < F.col("end_index")).unionByName(single, allowMissingColumns=True)
    out = on.withColumn("segment", (F.row_number().over(frame.lane.orderBy("start_index", "is_trigger")) - 1).cast("int"))
    out = out if max_segments is None else out.where(F.col("segment") < max_segments)
    return out.select(*frame.keys, "segment", "start_time", "end_time", "start_index", "end_index", *(["is_trigger"] if trigger else []))


def pick(found: DataFrame, keys: Sequence[str], edges: str = "all", mode: str = "all", n: int = 1) -> DataFrame:
    """Events of some edges; mode: all, first, first_n or last of each lane."""
    codes = {"all": (ENTER, EXIT, TRIGGER), "enter": (ENTER,), "exit": (EXIT,)}[edges]
    kept = found.where(F.col("edge_code").isin(*codes))
    if mode == "all":
        return kept
    order = W.partitionBy(*keys).orderBy(F.col("event").desc() if mode == "last" else F.col("event"))
    return kept.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= (n if mode == "first_n" else 1)).drop("__r")


def at_boundaries(frame: LaneFrame, cond: Column, edges: str = "all", mode: str = "all", n: int = 1, include_initial: bool = False, on_empty: str = "empty") -> DataFrame:
    """The chosen events with the fields at their times; on_empty="error": an error when no lane has any."""
    chosen = pick(events(frame, cond, include_initial), frame.keys, edges, mode, n)
    return _or_error(asof.at(frame, chosen, "time"), on_empty)


def _or_error(df: DataFrame, on_empty: str) -> DataFrame:
    if on_empty not in ("empty", "error"):
        raise ValueError(f"unknown policy {on_empty}")
    if on_empty == "error" and df.isEmpty():
        raise ValueError("the condition holds nowhere")
    return df


def stream_segments(segments: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Segments (of ``when``) one after another as one sequence per lane, with stream_segment_index."""
    order = W.partitionBy(*keys).orderBy("segment", seq)
    return segments.withColumn("__n", (F.row_number().over(order) - 1).cast("long")).withColumn(seq, F.col("__n")).drop("__n").withColumnRenamed("segment", "stream_segment_index")


def when(frame: LaneFrame, cond: Column, layout: str = "mask", inside: bool = True, max_segments: int | None = None, on_empty: str = "empty") -> LaneFrame | DataFrame:
    """Samples where the condition holds (or, with inside=False, doesn't).

    mask: all samples, fields missing elsewhere; stream: only those, numbered anew with orig_index; segments: those with
    their segment, numbered in it.
    """
    if layout not in ("mask", "stream", "segments"):
        raise ValueError(f"unknown layout {layout}")
    cond = F.coalesce(cond, F.lit(False))
    cond = cond if inside else ~cond
    _or_error(frame.df.where(cond), on_empty)
    if layout == "mask":
        return frame.where(cond)
    if layout == "stream":
        return frame.over(frame.df.withColumn("orig_index", F.col(frame.seq))).where(cond, drop=True)
    order = frame.ordered
    df = mask(frame, cond, "__on")
    start = F.col("__on") & ~F.coalesce(F.lag("__on").over(order), F.lit(False))
    df = df.withColumn("segment", (F.sum(start.cast("int")).over(order) - 1).cast("int")).where("__on")
    whole = W.partitionBy(*frame.keys, "segment")
    df = df.withColumns(
        {
            "segment_start_time": F.min(frame.clock).over(whole), "segment_end_time": F.max(frame.clock).over(whole),
            "segment_start_index": F.min(frame.seq).over(whole), "segment_end_index": F.max(frame.seq).over(whole),
            "orig_index": F.col(frame.seq), "__n": (F.row_number().over(whole.orderBy(frame.seq)) - 1).cast("long"),
        }
    )
    df = df if max_segments is None else df.where(F.col("segment") < max_segments)
    return df.withColumn(frame.seq, F.col("__n")).drop("__n", "__on")


def tau_grid(pre: object, post: object, dt: object) -> list:
    """-pre, -pre + dt, ... up to post, with 0 put in where it is not hit; of numbers, or of timedeltas."""
    if isinstance(dt, datetime.timedelta):
        found = [-pre + k * dt for k in range((pre + post) // dt + 1)]
        return sorted({*found, datetime.timedelta(0)})
    n = math.floor((pre + post) / dt + 1e-9)
    taus = [-pre + k * dt for k in range(n + 1)]
    taus = [0.0 if abs(x) < 1e-12 else x for x in taus]
    return taus if 0.0 in taus else sorted([*taus, 0.0])


def around(frame: LaneFrame, anchors: DataFrame, taus: Sequence[object], layout: str = "segments") -> DataFrame:
    """Fields at anchor time + tau for every anchor (lane keys, event, time, edge_code) and tau; missing outside the lane.

    taus: numbers, or timedeltas where the clock is of instants (tau is an interval then). stacked: one sequence per lane, in order of event and tau, with
    window_tau and window_event_index.
    """
    clock = Clock.of(frame.df, frame.clock)
    grid = F.array(*(F.struct(F.lit(i).alias("i"), clock.offset(x).alias("tau"), F.lit(clock.span(x) if clock.instants else float(x)).cast("long" if clock.instants else "double").alias("ticks")) for i, x in enumerate(taus)))
    q = anchors.select(*frame.keys, "event", F.col("time").alias("event_time"), F.col("edge_code").alias("event_edge_code"), F.explode(grid).alias("__g"))
    there = clock.same(anchors, "time").ticks(F.col("event_time")) + F.col("__g.ticks")
    q = q.select(*frame.keys, "event", "event_time", "event_edge_code", F.col("__g.i").alias("tau_index"), F.col("__g.tau").alias("tau"), clock.value(there).alias("at"))
    out = asof.at(frame, q, "at")
    if layout == "segments":
        return out
    order = W.partitionBy(*frame.keys).orderBy("event", "tau_index")
    return out.withColumn(frame.seq, (F.row_number().over(order) - 1).cast("long")).withColumnsRenamed({"tau": "window_tau", "event": "window_event_index"})


def explicit_anchors(times: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Anchors at given times: triggers, numbered per lane."""
    order = W.partitionBy(*keys).orderBy(time)
    return times.select(*keys, (F.row_number().over(order) - 1).cast("int").alias("event"), F.col(time).alias("time"), F.lit(TRIGGER).alias("edge_code"))

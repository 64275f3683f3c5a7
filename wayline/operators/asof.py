"""Selection, interpolation and synchronisation on the clock of each lane.

Samples and queries are put in one order per lane, and two running windows carry the last sample before a query and
the first one at or after it. That is one shuffle by lane and two sorts, without any inequality join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions.clocks import Clock, common
from wayline.operators import folds, scan

POLICIES = ("invalid", "left", "right", "raise")


def ticks_of(df: DataFrame, column: str) -> Column:
    """A column of clock values in whole ticks."""
    return Clock.of(df, column).ticks(F.col(column))


def bracket(samples: LaneFrame, queries: DataFrame, at: str, last_of_equal: bool = False) -> DataFrame:
    """queries (lane keys, ``at``, ...) with __left, __right (structs of a sample) and __end (the lane's last clock value), clock values in ticks.

    __left: the last sample before the query; __right: the first sample at or after it; __right.again: whether the next
    sample has the same clock value. last_of_equal: also ``__upto``, the last sample at or before the query.

    One shuffle by lane, a sort up and one down. Lanes with cuts are worked on range by range, with the samples next to each range.
    """
    keys, clock = list(samples.keys), Clock.of(samples.df, samples.clock)
    extra, t = [c for c in queries.columns if c not in keys], clock.ticks(F.col(samples.clock))
    sample = F.struct(F.col(samples.seq).alias("seq"), t.alias("t"), *(F.col(c) for c in samples.fields))
    held = samples.df.where(F.col(samples.clock).isNotNull()).select(*keys, t.alias("__t"), F.col(samples.seq).alias("__n"), sample.alias("__s"), F.lit(1).alias("__kind"))
    asked = queries.select(*keys, clock.same(queries, at).ticks(F.col(at)).alias("__t"), F.struct(*extra).alias("__q"), F.lit(0).alias("__kind"))
    part = keys
    if samples.cuts is not None:
        more = scan.sentinels(held, keys, samples.cuts, "__t", ["__t", "__n"])
        held = scan.with_chunk(held, keys, samples.cuts, "__t").unionByName(more)
        asked, part = scan.with_chunk(asked, keys, samples.cuts, "__t"), [*keys, scan.CHUNK]
    held, lane = held.unionByName(asked, allowMissingColumns=True), W.partitionBy(*part)
    up = lane.orderBy("__t", "__kind", "__n")
    down = lane.orderBy(F.col("__t").desc(), F.col("__kind").desc(), F.col("__n").desc())
    so_far, before = (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)
    # in the order of a clock that never goes back, numbers never go back either
    held = held.withColumns({"__left": F.last("__s", ignorenulls=True).over(up.rowsBetween(*so_far)), "__high": F.max("__n").over(up.rowsBetween(*before))})
    back = F.when(F.col("__high") > F.col("__n"), F.raise_error(F.lit("the clock of a lane goes back")).cast("boolean"))
    held = held.withColumn("__next", F.last("__s", ignorenulls=True).over(down.rowsBetween(*before))["t"])
    again = F.coalesce(back, F.col("__next") == F.col("__t"), F.lit(False))
    held = held.withColumn("__r", F.when(F.col("__kind") == 1, F.struct("__s.seq", "__s.t", again.alias("again"), *(F.col(f"__s.`{c}`") for c in samples.fields))))
    # running from the end, the greatest clock value of a sample so far is the lane's last one as soon as there is a right neighbour
    held = held.withColumns({"__right": F.last("__r", ignorenulls=True).over(down.rowsBetween(*so_far)), "__end": F.max(F.when(F.col("__kind") == 1, F.col("__t"))).over(down.rowsBetween(*so_far))})
    more = []
    if last_of_equal:
        held = held.withColumn("__upto", F.last("__s", ignorenulls=True).over(lane.orderBy("__t", F.col("__kind").desc(), "__n").rowsBetween(*so_far)))
        more = ["__upto"]
    return held.where("__kind = 0").select(*keys, *(F.col(f"__q.`{c}`").alias(c) for c in extra), "__left", "__right", "__end", *more)


def _finite(q: Column) -> Column:
    return q.isNotNull() & ~q.cast("double").isin(float("inf"), float("-inf"), float("nan"))


def _picked(duplicates: str, q: Column) -> tuple[Column, Column]:
    """(whether the query meets repeated clock values, the sample that the policy takes there)."""
    many = (F.col("__right.t") == q) & F.col("__right.again")
    if duplicates == "left":
        return many, F.col("__right")
    if duplicates == "right":
        return many, F.col("__upto")
    return many, F.lit(None)


def at(samples: LaneFrame, queries: DataFrame, on: str, method: str = "linear", duplicates: str = "invalid") -> DataFrame:
    """queries with the samples' fields evaluated at the clock value ``on``.

    linear: missing outside the lane's clock and where a sample of the bracket is missing; a query at an end is that
    sample; one at an inner sample takes the bracket that ends there. Repeated clock values equal to the query follow
    ``duplicates``: invalid (missing), left (first sample), right (last) or raise. nearest: clamps outside, ties go left.
    """
    if duplicates not in POLICIES or method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method} or policy {duplicates}")
    q = ticks_of(queries, on)
    cols = [c for c in queries.columns if c not in samples.keys]
    found = bracket(samples, queries, on, last_of_equal=method == "linear" and duplicates == "right")
    out = {}
    if method == "nearest":
        side = _nearest_left(q)
        for c in samples.fields:
            out[c] = F.when(_finite(q), F.when(side, F.col(f"__left.`{c}`")).otherwise(F.col(f"__right.`{c}`")))
    else:
        width = F.col("__right.t") - F.col("__left.t")
        alpha = (q - F.col("__left.t")).cast("double") / F.when(width != 0, width.cast("double"))
        many, _ = _picked(duplicates, q)
        end = (q == F.col("__right.t")) & (F.col("__left").isNull() | (q == F.col("__end")))
        for c in samples.fields:
            blend = (1 - alpha) * F.col(f"__left.`{c}`") + alpha * F.col(f"__right.`{c}`")
            exact = {"left": F.col(f"__right.`{c}`"), "right": F.col(f"__upto.`{c}`"), "invalid": F.lit(None)}.get(duplicates, F.raise_error(F.lit("a query meets repeated clock values")))
            out[c] = F.when(_finite(q), F.when(many, exact.cast("double")).when(end, F.col(f"__right.`{c}`").cast("double")).otherwise(blend))
    return found.select(*samples.keys, *cols, *(x.alias(c) for c, x in out.items()))


def _nearest_left(q: Column) -> Column:
    """Whether the left sample is nearest; ties go left."""
    left, right = F.col("__left"), F.col("__right")
    return right.isNull() | (left.isNotNull() & ((q - F.col("__left.t")) <= (F.col("__right.t") - q)))


def index(samples: LaneFrame, queries: DataFrame, on: str) -> DataFrame:
    """queries with sample_index (number of the nearest sample, -1 if none) and valid."""
    q = ticks_of(queries, on)
    found = bracket(samples, queries, on)
    n = F.when(_finite(q), F.when(_nearest_left(q), F.col("__left.seq")).otherwise(F.col("__right.seq")))
    return found.select(*queries.columns, F.coalesce(n, F.lit(-1)).cast("long").alias("sample_index"), n.isNotNull().alias("valid"))


def select_points(samples: LaneFrame, queries: DataFrame, on: str) -> DataFrame:
    """queries with sample_index, valid and the fields of the nearest recorded sample."""
    q = ticks_of(queries, on)
    found = bracket(samples, queries, on)
    left = _nearest_left(q)

    def of(c):
        return F.when(_finite(q), F.when(left, F.col(f"__left.`{c}`")).otherwise(F.col(f"__right.`{c}`")))

    return found.select(*queries.columns, F.coalesce(of("seq"), F.lit(-1)).cast("long").alias("sample_index"), of("seq").isNotNull().alias("valid"), *(of(c).alias(c) for c in samples.fields))


def select_range(samples: LaneFrame, start: object, stop: object) -> LaneFrame:
    """Samples with start <= clock <= stop, numbered anew; sample_index is their number before. A clock that goes back is an error."""
    t, clock = F.col(samples.clock), Clock.of(samples.df, samples.clock)
    back = F.when(F.lag(samples.clock).over(samples.ordered) > t, F.raise_error(F.lit("the clock of a lane goes back")).cast("boolean"))
    samples = samples.over(samples.df.withColumn("__back", back).where(F.col("__back").isNull()).drop("__back"))
    cond = (F.lit(True) if start is None else t >= clock.literal(start)) & (F.lit(True) if stop is None else t <= clock.literal(stop))
    kept = samples.over(samples.df.where(cond).withColumn("sample_index", F.col(samples.seq)))
    out = kept.renumbered()
    return out.set_roles(fields=(*samples.fields, "sample_index"))


def bounds_map(samples: LaneFrame, bounds: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """bounds (lane keys, start, stop, ...) with i0 and i1: the lane's samples i0 <= place < i1 have start <= clock <= stop.

    Bounds differ from lane to lane, and a lane may have any number of them, overlapping or not; null bounds are open. Lanes without samples have i0 = i1 = 0.
    """
    keys, clock = list(samples.keys), Clock.of(samples.df, samples.clock)
    for c in (start, stop):
        clock.same(bounds, c)
    placed = samples.over(samples.df.where(F.col(samples.clock).isNotNull())).renumbered(samples.clock, samples.seq)
    placed = placed.over(placed.df.withColumn("__p", F.col(samples.seq)), fields=("__p",))
    found = bracket(placed, bounds, start)
    found = found.withColumn("i0", F.coalesce(F.col("__left.seq") + 1, F.lit(0))).select(*bounds.columns, "i0")
    found = bracket(placed, found, stop, last_of_equal=True)
    found = found.select(*bounds.columns, "i0", F.coalesce(F.col("__upto.seq") + 1, F.lit(0)).alias("__i1"))
    sizes = placed.df.groupBy(*(F.col(k).alias(f"__z{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("__size"))
    found = found.join(sizes, scan.same_lane(found, sizes, keys, [f"__z{i}" for i in range(len(keys))]), "left")
    last = F.when(F.col(stop).isNull(), F.coalesce("__size", F.lit(0))).otherwise(F.col("__i1"))
    return found.select(*bounds.columns, F.col("i0").cast("long").alias("i0"), F.greatest(F.col("i0"), last).cast("long").alias("i1"))


#: Neighbouring samples that meet a slice together.
BLOCK = 1024


def select_slices(samples: LaneFrame, bounds: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """A row for each sample in each interval of its lane (bounds: lane keys, start, stop, ...): columns of bounds, seq from 0 in the interval, sample_index, clock, fields.

    Intervals become ranges of places in their lane and meet the samples by blocks of BLOCK places, so the join is an equality on lane and
    block, its candidates are about as many as its rows, and a long lane is spread over as many tasks as it has blocks.
    """
    keys, seq = list(samples.keys), samples.seq
    placed = samples.over(samples.df.where(F.col(samples.clock).isNotNull()).withColumn("sample_index", F.col(seq))).renumbered(samples.clock, seq)
    rows = placed.df.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(seq).alias("__p"), F.floor(F.col(seq) / BLOCK).alias("__b"), F.struct("sample_index", samples.clock, *samples.fields).alias("__row"))
    wanted = bounds_map(samples, bounds, start, stop).where("i1 > i0")
    wanted = wanted.withColumn("__block", F.explode(F.sequence(F.floor(F.col("i0") / BLOCK), F.floor((F.col("i1") - 1) / BLOCK))))
    meet = scan.same_lane(wanted, rows, keys, [f"__k{i}" for i in range(len(keys))]) & (F.col("__block") == F.col("__b"))
    inside = (F.col("__p") >= F.col("i0")) & (F.col("__p") < F.col("i1"))
    cols = [F.col(f"__row.`{c}`").alias(c) for c in ("sample_index", samples.clock, *samples.fields)]
    return wanted.join(rows, meet & inside).select(*bounds.columns, (F.col("__p") - F.col("i0")).alias(seq), *cols)


def grid_for(samples: LaneFrame, grid: Sequence[object]) -> DataFrame:
    """Lane keys, seq and clock of the same grid in every lane: numbers, or instants as datetime, date or text."""
    clock = Clock.of(samples.df, samples.clock)
    lanes = samples.df.select(*samples.keys).distinct()
    points = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), (clock.literal(x) if clock.instants else F.lit(x if isinstance(x, int) else float(x)).cast(clock.kind)).alias("x")) for i, x in enumerate(grid)))
    return lanes.withColumn("__p", F.explode(points)).select(*samples.keys, F.col("__p.i").alias(samples.seq), F.col("__p.x").alias(samples.clock))


def resample_to(samples: LaneFrame, grid: Sequence[object] | DataFrame, method: str = "linear", duplicates: str = "invalid") -> LaneFrame:
    """The lanes on another clock: the same points for all, or a DataFrame of lane keys, seq and clock."""
    queries = grid if isinstance(grid, DataFrame) else grid_for(samples, grid)
    out = at(samples.select(*samples.fields), queries.select(*samples.keys, samples.seq, samples.clock), samples.clock, method, duplicates)
    return samples.over(out)


def interp_like(samples: LaneFrame, other: LaneFrame, method: str = "linear", lanes: str = "inner") -> LaneFrame:
    """samples on the clock of other; lanes: inner, or left to keep lanes of other that samples lacks, as missing."""
    clock = other.df.select(*(F.col(c).alias(k) for c, k in zip(other.keys, samples.keys, strict=True)), F.col(other.seq).alias(samples.seq), F.col(other.clock).alias(samples.clock))
    if lanes == "inner":
        clock = clock.join(samples.df.select(*samples.keys).distinct(), list(samples.keys), "left_semi")
    return resample_to(samples, clock, method)


def _ticked(frame: LaneFrame) -> LaneFrame:
    """The frame on a clock of ticks."""
    return frame.over(frame.df.withColumn(frame.clock, ticks_of(frame.df, frame.clock)))


def join_clocks(frames: Sequence[LaneFrame], join: str = "outer", tol: object = 0.0, lanes: str = "inner") -> DataFrame:
    """Lane keys, seq and clock of a common grid per lane.

    lanes: those that all frames have (inner), the first has (left), any has (outer), or all must be the same (exact).

    outer: all clock values; inner: those of the first that every frame has within tol; domain: outer between the
    latest start and the earliest end; exact: all frames must have the same, sample for sample within tol, and the first's are taken; left
    and right: the first's and last's. In lanes that some frames lack, inner, domain and exact leave nothing. Clocks of instants take tol as a timedelta.
    """
    clock, base = common([Clock.of(f.df, f.clock) for f in frames]), frames[0]
    grid = _joined_clocks([_ticked(f) for f in frames], join, clock.span(tol), lanes)
    return grid.withColumn(base.clock, clock.value(F.col(base.clock)))


def _joined_clocks(frames: Sequence[LaneFrame], join: str, tol: float, lanes: str) -> DataFrame:
    """``join_clocks`` in ticks."""
    base = frames[0]
    keys, t, n = list(base.keys), base.clock, len(frames)
    clocks = [f.df.where(F.col(f.clock).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(f.keys, keys, strict=True)), F.col(f.clock).alias(t), F.lit(i).alias("__f")) for i, f in enumerate(frames)]
    every = reduce(DataFrame.unionByName, clocks)
    lane = W.partitionBy(*keys)
    every = every.withColumns({"__all": F.size(F.collect_set("__f").over(lane)), "__first": F.min("__f").over(lane) == 0})
    whole = F.col("__all") == n
    every = every.where({"inner": whole, "left": F.col("__first"), "outer": F.lit(True), "exact": F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("the frames have different lanes")))}[lanes])
    if join in ("inner", "domain", "exact"):
        every = every.where(whole)
    if join in ("left", "right", "override"):
        grid = every.where(F.col("__f") == (n - 1 if join == "right" else 0)).select(*keys, t).distinct()
    elif tol > 0 and join == "inner":
        grid = every.where("__f = 0").select(*keys, t).distinct()
        for f in clocks[1:]:
            other = LaneFrame(f.withColumn("__n", F.row_number().over(lane.orderBy(t)).cast("long")).withColumn("__v", F.col(t)), tuple(keys), "__n", t, ("__v",))
            near = at(other, grid, t, "nearest")
            grid = near.where(F.abs(F.col("__v") - F.col(t)) <= tol).select(*keys, t)
    elif join == "exact":
        ranked = every.withColumn("__k", F.row_number().over(W.partitionBy(*keys, "__f").orderBy(t)))
        counted = ranked.groupBy(*keys, "__k").agg(F.count("*").alias("__c"), F.min(t).alias("__lo"), F.max(t).alias("__hi"), F.min(F.when(F.col("__f") == 0, F.col(t))).alias(t))
        same = (F.col("__c") == n) & (F.col("__hi") - F.col("__lo") <= tol)
        grid = counted.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("the clocks differ")))).select(*keys, t).distinct()
    elif join == "inner":
        grid = every.groupBy(*keys, t).agg(F.count_distinct("__f").alias("__c")).where(F.col("__c") == n).select(*keys, t)
    elif join in ("outer", "domain"):
        if join == "domain":
            own = W.partitionBy(*keys, "__f")
            ends = every.withColumn("__lo", F.min(t).over(own)).withColumn("__hi", F.max(t).over(own))
            every = ends.withColumn("__from", F.max("__lo").over(lane)).withColumn("__to", F.min("__hi").over(lane)).where(F.col(t).between(F.col("__from"), F.col("__to")))
        if tol > 0:
            grid = folds.thinned(every.select(*keys, t), keys, t, tol)
        else:
            grid = every.select(*keys, t).distinct()
    else:
        raise ValueError(f"unknown join {join}")
    return grid.withColumn(base.seq, (F.row_number().over(lane.orderBy(t)) - 1).cast("long"))


#: Joins whose points are samples that are told by their neighbours: no grid is made for them.
IN_ONE = ("outer", "inner", "domain", "left", "right", "override")


def synchronized(frames: Sequence[LaneFrame], join: str = "left", how: str = "interp", grid: DataFrame | None = None, tol: object = 0.0, fill: float | None = None, lanes: str = "inner") -> LaneFrame:
    """The fields of all frames, which have names of their own, on one clock per lane; how: interp, nearest, or fill (the nearest within tol, else ``fill``).

    All frames are put in one order per lane, so the neighbours of every frame come from one shuffle and two sorts. Points of the common clock are samples in
    that order too, unless a grid is given or the join needs one (exact, or with tolerance). Cuts of the first frame count for all. Clocks of instants take
    tol as a timedelta.
    """
    if how not in ("interp", "nearest", "fill"):
        raise ValueError(f"unknown way {how}")
    base, clock = frames[0], common([Clock.of(f.df, f.clock) for f in frames])
    keys, seq, t, tol = list(base.keys), base.seq, base.clock, clock.span(tol)
    held = [_ticked(f.rename(**{a: b for a, b in zip((*f.keys, f.seq, f.clock), (*keys, seq, t), strict=True) if a != b})) for f in frames]
    fields = [c for f in held for c in f.fields]
    if len(set(fields)) < len(fields):
        raise ValueError("frames to be put together need fields with names of their own")
    one, several = grid is None and join in IN_ONE and not (tol > 0 and join in ("outer", "inner", "domain")), range(len(held))
    if grid is not None:
        clock.same(grid, t)
        grid = grid.withColumn(t, ticks_of(grid, t))
    points = None if one else grid if grid is not None else _joined_clocks(held, join, tol, lanes)
    source = {"left": (0,), "override": (0,), "right": (len(held) - 1,)}.get(join, several)
    samples = []
    for i, f in enumerate(held):
        row = F.struct(F.col(t).alias("t"), F.col(seq).alias("n"), *f.fields).alias(f"__s{i}")
        samples.append(f.df.where(F.col(t).isNotNull()).select(*keys, F.col(t).alias("__t"), F.col(seq).alias("__n"), F.lit(1 + i).alias("__kind"), F.lit(1 << i).alias("__f"), row))
    part = keys
    if base.cuts is not None:
        part = [*keys, scan.CHUNK]
        more = [scan.sentinels(x, keys, base.cuts, "__t", ["__t", "__n"]) for x in samples]
        samples = [scan.with_chunk(x, keys, base.cuts, "__t") for x in samples]
    rows = list(samples)
    if one:  # the points: samples once more, before all samples of their clock value
        for i in source:
            c = samples[i].columns
            twice = samples[i].withColumn("__kind", F.explode(F.array(F.lit(0), F.col("__kind"))))
            rows[i] = twice.select(*(F.when(F.col("__kind") > 0, F.col(x)).alias(x) if x == f"__s{i}" else F.col(x) for x in c))
    else:
        asked = points.select(*keys, F.col(t).alias("__t"), F.col(seq).alias("__n"), F.lit(0).alias("__kind"))
        rows.append(asked if base.cuts is None else scan.with_chunk(asked, keys, base.cuts, "__t"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows if base.cuts is None else [*rows, *more])
    lane = W.partitionBy(*part)
    up, down = lane.orderBy("__t", "__kind", "__n"), lane.orderBy(F.col("__t").desc(), F.col("__kind").desc(), F.col("__n").desc())
    so_far, before = (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)
    rows = rows.withColumns({
        **{f"__l{i}": F.last(f"__s{i}", ignorenulls=True).over(up.rowsBetween(*so_far)) for i in several},
        **{f"__h{i}": F.max(f"__s{i}.n").over(up.rowsBetween(*before)) for i in several},
        "__up": F.bit_or("__f").over(up.rowsBetween(*so_far)),
        "__repeat": (F.lag("__kind").over(up) == 0) & (F.lag("__t").over(up) == F.col("__t")),
    })
    back = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"__h{i}") > F.col(f"__s{i}.n"), F.lit(False)) for i in several))
    rows = rows.withColumn("__back", F.when(back, F.raise_error(F.lit("the clock of a lane goes back")).cast("boolean")))
    right = {f"__r{i}": F.last(f"__s{i}", ignorenulls=True).over(down.rowsBetween(*so_far)) for i in several}
    ends = {f"__e{i}": F.max(f"__s{i}.t").over(down.rowsBetween(*so_far)) for i in several}
    rows = rows.where(F.col("__back").isNull()).withColumns({**right, **ends, "__down": F.bit_or("__f").over(down.rowsBetween(*so_far))})
    if how == "interp":  # whether the right neighbour's clock value comes again in the sample after it
        rows = rows.withColumns({f"__d{i}": F.when(F.col(f"__s{i}").isNotNull(), F.coalesce(F.lag(f"__r{i}").over(down)["t"] == F.col(f"__s{i}.t"), F.lit(False))) for i in several})
        rows = rows.withColumns({f"__again{i}": F.last(f"__d{i}", ignorenulls=True).over(down.rowsBetween(*so_far)) for i in several})
    q, out = F.col("__t"), {}
    for i, f in enumerate(held):
        left, near_left = F.col(f"__l{i}"), F.col(f"__r{i}").isNull() | (F.col(f"__l{i}").isNotNull() & (q - F.col(f"__l{i}.t") <= F.col(f"__r{i}.t") - q))
        close = F.when(near_left, q - F.col(f"__l{i}.t")).otherwise(F.col(f"__r{i}.t") - q) <= tol
        width = F.col(f"__r{i}.t") - F.col(f"__l{i}.t")
        alpha = (q - F.col(f"__l{i}.t")).cast("double") / F.when(width != 0, width.cast("double"))
        end = (q == F.col(f"__r{i}.t")) & (left.isNull() | (q == F.col(f"__e{i}")))
        for c in f.fields:
            nearest = F.when(near_left, F.col(f"__l{i}.`{c}`")).otherwise(F.col(f"__r{i}.`{c}`"))
            if how == "interp":
                blend = (1 - alpha) * F.col(f"__l{i}.`{c}`") + alpha * F.col(f"__r{i}.`{c}`")
                many = (q == F.col(f"__r{i}.t")) & F.col(f"__again{i}")
                out[c] = F.when(many, F.lit(None)).when(end, F.col(f"__r{i}.`{c}`").cast("double")).otherwise(blend)
            else:
                out[c] = nearest if how == "nearest" else F.when(F.coalesce(close, F.lit(False)), nearest).otherwise(F.lit(fill))
    rows = rows.where("__kind = 0")
    if one:
        rows = _points(rows, part, keys, join, lanes, len(held), base.cuts)
    df = rows.select(*keys, F.col("__n").alias(seq), clock.value(F.col("__t")).alias(t), *(x.alias(c) for c, x in out.items()))
    return LaneFrame(df, tuple(keys), seq, t, tuple(fields))


def _points(rows: DataFrame, part: list[str], keys: list[str], join: str, lanes: str, n: int, cuts: DataFrame | None) -> DataFrame:
    """The points that a join takes, each clock value once, numbered in their lanes (__n); rows know the neighbours of all n frames."""
    q, held = F.col("__t"), F.coalesce("__up", F.lit(0)).bitwiseOR(F.coalesce("__down", F.lit(0)))  # frames that have the lane
    whole = held == (1 << n) - 1
    kept = {"inner": whole, "left": held.bitwiseAND(F.lit(1)) == 1, "outer": F.lit(True), "exact": F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("the frames have different lanes")))}[lanes]
    for i in range(n):
        here = F.col(f"__r{i}.t") == q
        if join == "inner":
            kept = kept & F.coalesce(here, F.lit(False))
        elif join == "domain":
            kept = kept & F.coalesce(here | (F.col(f"__r{i}").isNotNull() & F.col(f"__l{i}").isNotNull()), F.lit(False))
    rows = rows.where(kept & ~F.coalesce("__repeat", F.lit(False)))
    if cuts is None:
        return rows.withColumn("__n", (F.row_number().over(W.partitionBy(*part).orderBy("__t")) - 1).cast("long"))
    rows = scan.carried(rows.drop("__n"), keys, cuts, {"__before": F.count("*")})
    place = F.row_number().over(W.partitionBy(*part).orderBy("__t")) - 1
    return rows.withColumn("__n", (place + F.coalesce("__before", F.lit(0))).cast("long"))


def synchronize(frames: Sequence[LaneFrame], join: str = "left", how: str = "interp", grid: DataFrame | None = None, tol: object = 0.0, fill: float | None = None, lanes: str = "inner") -> list[LaneFrame]:
    """``synchronized``, each frame for itself under its own field names."""
    own = [f.rename(**{c: f"__{i}_{c}" for c in f.fields}) for i, f in enumerate(frames)]
    whole = synchronized(own, join, how, grid, tol, fill, lanes)
    return [whole.select(*mine.fields).rename(**dict(zip(mine.fields, f.fields, strict=True))) for mine, f in zip(own, frames, strict=True)]

"""Derivatives, integrals and smoothing along the clock of each lane; on clocks of instants per second, and with sigma in seconds.

Fields are numbers, or structs of numbers however nested (positions, velocities, pairs of linear and angular parts): then
every number of the struct is worked on for itself and the structs are put together again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from wayline.frame import LaneFrame
from wayline.functions.clocks import Clock
from wayline.operators import scan


#: What a derivative, and an integral, of each kind of quantity is.
DERIVED = {"position": "linear_velocity", "linear_velocity": "linear_acceleration", "angular_velocity": "angular_acceleration", "velocity": "acceleration"}
INTEGRATED = {"linear_velocity": "position", "linear_acceleration": "linear_velocity", "angular_acceleration": "angular_velocity", "acceleration": "velocity"}


def _leaves(kind: T.DataType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in _leaves(f.dataType, (*path, f.name))]
    return [path]


def _rebuilt(kind: T.DataType, path: tuple[str, ...], names: dict[tuple[str, ...], str]) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*(_rebuilt(f.dataType, (*path, f.name), names).alias(f.name) for f in kind))
    return F.col(names[path])


def by_component(work: Callable) -> Callable:
    """A lane operator on numbers that takes structs of numbers too, whatever their parts."""

    @wraps(work)
    def run(frame: LaneFrame, *args, **options) -> LaneFrame:
        kinds = {c: frame.df.schema[c].dataType for c in frame.fields}
        if not any(isinstance(k, T.StructType) for k in kinds.values()):
            return work(frame, *args, **options)
        names = {p: f"__part_{'_'.join(p)}" for c, k in kinds.items() for p in _leaves(k, (c,))}
        flat = frame.df.select(*frame.keys, frame.seq, frame.clock, *(F.col(".".join(f"`{x}`" for x in p)).alias(n) for p, n in names.items()))
        done = work(frame.over(flat, fields=tuple(names.values()), components={}), *args, **options)
        cols = [_rebuilt(k, (c,), names).alias(c) for c, k in kinds.items()]
        return frame.over(done.df.select(*frame.keys, frame.seq, frame.clock, *cols))

    return run


def _kind(frame: LaneFrame, table: dict[str, str], what: str) -> LaneFrame:
    """The frame with the kind of quantity that it becomes, if it says what it is."""
    kind = frame.attrs.get("kind")
    if kind is None:
        return frame
    if kind not in table:
        raise ValueError(f"{kind} has no {what}")
    return frame.retag(kind=table[kind])


def _dt(frame: LaneFrame, order: W | None = None) -> Column:
    """Clock step from the sample before, in seconds where the clock is of instants; a step that isn't positive is an error."""
    clock = Clock.of(frame.df, frame.clock)
    t = clock.ticks(F.col(frame.clock))
    step = t - F.lag(t).over(frame.ordered if order is None else order)
    return F.when(step <= 0, F.raise_error(F.lit("the clock must increase")).cast("double")).otherwise(step.cast("double") / F.lit(clock.unit()))


def differentiate(frame: LaneFrame, method: str = "finite_difference", window: int = 5, poly_order: int = 2, order: int = 1) -> LaneFrame:
    """Slope to the sample before, ``order`` times; the first sample has the slope of the first pair, a lane of one sample none.

    A frame whose attribute ``kind`` says position, velocity and so on becomes the kind of its derivative.
    """
    if method not in ("finite_difference", "local_polynomial") or order < 1:
        raise ValueError(f"unknown method {method} or order {order}")
    for _ in range(order):
        frame = _kind(_slope(frame, method, window, poly_order), DERIVED, "derivative")
    return frame


@by_component
def _slope(frame: LaneFrame, method: str, window: int, poly_order: int) -> LaneFrame:
    if method == "local_polynomial":
        return local_polynomial(frame, window, poly_order, derivative=True)
    df = frame.df.withColumn("__dt", _dt(frame))
    slopes = {f"__d_{c}": (F.col(c) - F.lag(c).over(frame.ordered)) / F.col("__dt") for c in frame.fields}
    df = df.withColumns(slopes)
    first = F.col("__dt").isNull()
    return frame.over(df.withColumns({c: F.when(first, F.lead(f"__d_{c}").over(frame.ordered)).otherwise(F.col(f"__d_{c}")) for c in frame.fields}).drop("__dt", *slopes))


def _running(frame: LaneFrame, steps: dict[str, Column], initial: float) -> LaneFrame:
    """Running sums from the initial value; from a missing step on the sum is missing."""
    order = frame.ordered.rowsBetween(W.unboundedPreceding, 0)
    df = frame.df.withColumns({f"__s_{c}": x for c, x in steps.items()})
    first = F.row_number().over(frame.ordered) == 1
    sums = {c: F.when(F.count(F.when(~F.col("__first") & F.col(f"__s_{c}").isNull(), 1)).over(order) == 0, F.lit(float(initial)) + F.coalesce(F.sum(f"__s_{c}").over(order), F.lit(0.0))) for c in steps}
    return frame.over(df.withColumn("__first", first).withColumns(sums).drop("__first", *(f"__s_{c}" for c in steps)))


def integrate(frame: LaneFrame, method: str = "cumulative_trapezoid", initial: float = 0.0) -> LaneFrame:
    """Cumulative integral by trapezoids, or by parabolas through three samples (cumulative_simpson), from the initial value on.

    A frame whose attribute ``kind`` says velocity, acceleration and so on becomes the kind of its integral.
    """
    return _kind(_area(frame, method, initial), INTEGRATED, "integral")


@by_component
def _area(frame: LaneFrame, method: str, initial: float) -> LaneFrame:
    order = frame.ordered
    if method == "cumulative_trapezoid" and frame.cuts is not None:
        order = W.partitionBy(*frame.keys, scan.CHUNK).orderBy(frame.seq)
        steps = {c: 0.5 * (F.col(c) + F.lag(c).over(order)) * F.col("__dt") for c in frame.fields}
        sums = frame.over(scan.running(frame, steps, {"__dt": _dt(frame, order)}, [frame.seq]))
        return sums.over(sums.df.withColumns({c: F.col(c) + F.lit(float(initial)) for c in frame.fields}))
    if method == "cumulative_trapezoid":
        frame = frame.over(frame.df.withColumn("__dt", _dt(frame)))
        out = _running(frame, {c: 0.5 * (F.col(c) + F.lag(c).over(order)) * F.col("__dt") for c in frame.fields}, initial)
        return out.over(out.df.drop("__dt"))
    if method != "cumulative_simpson":
        raise ValueError(f"unknown method {method}")
    df = frame.df.withColumn("__dt", _dt(frame)).withColumn("__k", F.row_number().over(order) - 2)  # interval k ends at this sample
    df = df.withColumn("__next", F.lead("__dt").over(order)).withColumn("__prior", F.lag("__dt").over(order))
    ahead = (F.col("__k") % 2 == 0) & F.col("__next").isNotNull()

    def area(f1: Column, f2: Column, f3: Column, h: Column, g: Column) -> Column:
        """Over h of the parabola through values f1, f2 at its ends and f3 a further g away."""
        return h / 6 * ((3 - h / (h + g)) * f1 + (3 + h * h / ((h + g) * g) + h / (h + g)) * f2 - h * h / ((h + g) * g) * f3)

    frame = frame.over(df)
    steps = {}
    for c in frame.fields:
        here, before = F.col(c), F.lag(c).over(order)
        forward = area(before, here, F.lead(c).over(order), F.col("__dt"), F.col("__next"))
        back = area(here, before, F.lag(c, 2).over(order), F.col("__dt"), F.col("__prior"))
        steps[c] = F.when(ahead, forward).otherwise(back)
    out = _running(frame, steps, initial)
    return out.over(out.df.drop("__dt", "__k", "__next", "__prior"))


@by_component
def smooth(frame: LaneFrame, method: str = "moving_average", window: int = 5, sigma: float = 1.0, poly_order: int = 2) -> LaneFrame:
    """Centred smoothing over an odd number of samples, fewer at the ends; a missing value makes its windows missing."""
    if window < 1 or window % 2 == 0:
        raise ValueError("a window is an odd number of samples")
    if method == "local_polynomial":
        return local_polynomial(frame, window, poly_order, derivative=False)
    r, order = window // 2, frame.ordered
    around = order.rowsBetween(-r, r)
    if method == "moving_average":
        return frame.over(frame.df.withColumns({c: F.when(F.count(c).over(around) == F.count(F.lit(1)).over(around), F.avg(c).over(around)) for c in frame.fields}))
    if method != "gaussian":
        raise ValueError(f"unknown method {method}")
    clock = Clock.of(frame.df, frame.clock)
    t = clock.ticks(F.col(frame.clock))
    near = {k: F.lag(t, k).over(order) if k > 0 else F.lead(t, -k).over(order) if k < 0 else t for k in range(-r, r + 1)}
    df = frame.df.withColumns({f"__w{k + r}": F.exp(-0.5 * F.pow((near[k] - t).cast("double") / F.lit(clock.unit() * sigma), 2)) for k in near})
    out = {}
    for c in frame.fields:
        total = weight = F.lit(0.0)
        for k in near:
            v = F.lag(c, k).over(order) if k > 0 else F.lead(c, -k).over(order) if k < 0 else F.col(c)
            w = F.col(f"__w{k + r}")
            total = total + F.when(w.isNotNull(), w * v).otherwise(0.0)
            weight = weight + F.coalesce(w, F.lit(0.0))
        out[c] = total / weight
    return frame.over(df.withColumns(out).drop(*(f"__w{k + r}" for k in near)))


def local_polynomial(frame: LaneFrame, window: int, poly_order: int, derivative: bool) -> LaneFrame:
    """Value or slope at the centre of a least-squares polynomial over a centred window of samples.

    A sample's window is gathered by a window function, as an array of bounded length, and fitted in Arrow batches of samples, so no
    lane has to fit in memory. With fewer samples than the polynomial has coefficients, or a missing value in the window, the result is missing.
    """
    r, fields, clock = window // 2, frame.fields, Clock.of(frame.df, frame.clock)
    t = clock.ticks(F.col(frame.clock))
    around = frame.ordered.rowsBetween(-r, r)
    numbers = F.struct(t.alias("t"), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(fields)))
    df = frame.df.withColumn("__near", F.collect_list(numbers).over(around))
    offsets = F.transform("__near", lambda s: (s["t"] - t).cast("double") / F.lit(clock.unit()))
    values = F.array(*(F.col(f"__near.v{i}") for i in range(len(fields))))
    fitted = _fitted(poly_order, 1 if derivative else 0)(offsets, values)
    df = df.withColumn("__fit", fitted)
    return frame.over(df.withColumns({c: F.when(~F.isnan(F.get("__fit", F.lit(i))), F.get("__fit", F.lit(i))) for i, c in enumerate(fields)}).drop("__near", "__fit"))


def _fitted(poly_order: int, which: int) -> Callable:
    """Coefficient of the least-squares polynomial of each row's window, for each of its fields."""

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def run(offsets: pd.Series, values: pd.Series) -> pd.Series:
        out, sizes = [None] * len(offsets), offsets.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            y = np.stack([np.stack([np.asarray(v, float) for v in values.iloc[i]]) for i in at])
            if n <= poly_order:
                fit = np.full(y.shape[:2], np.nan)
            else:
                x = np.stack([np.asarray(offsets.iloc[i], float) for i in at])
                design = x[..., None] ** np.arange(poly_order + 1)
                back = np.swapaxes(design, 1, 2)
                row = (np.linalg.pinv(back @ design, rcond=1e-12) @ back)[:, which]
                fit = np.einsum("rn,rfn->rf", row, y)
            for i, f in zip(at, fit, strict=True):
                out[i] = f.tolist()
        return pd.Series(out)

    return run

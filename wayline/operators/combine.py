"""Concatenation, merging and alignment by label, and assembly of core axes from fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.frame import LaneFrame, meet
from wayline.operators import asof

COMPAT = ("no_conflicts", "identical", "equals", "broadcast_equals", "override")


def _common(frames: Sequence[LaneFrame]) -> list[LaneFrame]:
    base = frames[0]
    return [f.rename(**{a: b for a, b in zip((*f.keys, f.seq), (*base.keys, base.seq), strict=True) if a != b}) for f in frames]


def concat_batch(frames: dict[str, LaneFrame], batch: str = "batch", sequence: str = "outer", fill: float | None = None) -> LaneFrame:
    """Frames under a further lane key with their label.

    sequence: outer keeps all samples, inner only numbers that every frame has, exact wants the same numbers in all.
    """
    if sequence not in ("outer", "inner", "exact"):
        raise ValueError(f"unknown join {sequence}")
    base = next(iter(frames.values()))
    held = dict(zip(frames, _common(list(frames.values())), strict=True))
    fields = tuple(dict.fromkeys(c for f in held.values() for c in f.fields))
    parts = [f.df.withColumn(batch, F.lit(name)).withColumns({c: F.lit(fill).cast("double") for c in fields if c not in f.fields}) for name, f in held.items()]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if sequence == "exact":
        counted = df.groupBy(base.seq).agg(F.count_distinct(batch).alias("__n"))
        same = F.when(F.col("__n") == len(frames), F.lit(True)).otherwise(F.raise_error(F.lit("the frames have different samples")))
        df = df.join(counted.where(same).select(base.seq), base.seq, "left_semi")
    if sequence == "inner":
        shared = df.groupBy(base.seq).agg(F.count_distinct(batch).alias("__n")).where(F.col("__n") == len(frames)).select(base.seq)
        df = df.join(shared, base.seq, "left_semi")
    return LaneFrame(df, (batch, *base.keys), base.seq, base.clock, fields)


def concat_sequence(frames: Sequence[LaneFrame], overlap: str = "error", lanes: str = "outer") -> LaneFrame:
    """Frames one after another in each lane, numbered anew.

    overlap: error where a frame begins before the one before it ends, or sort by the clock (stable).
    lanes: outer, or inner for lanes that every frame has.
    """
    base, held = frames[0], _common(frames)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.df.withColumn("__part", F.lit(i)) for i, f in enumerate(held)])
    out = base.over(df)
    if lanes == "inner":
        out = out.over(out.df.withColumn("__n", F.size(F.collect_set("__part").over(base.lane))).where(F.col("__n") == len(frames)).drop("__n"))
    if overlap == "sort":
        return out.renumbered(base.clock, "__part", base.seq).select(*base.fields)
    if base.clock:
        before = F.lag(base.clock).over(base.lane.orderBy("__part", base.seq))
        late = F.when(F.coalesce(before > F.col(base.clock), F.lit(False)), F.raise_error(F.lit("frames overlap on the clock"))).otherwise(F.lit(True))
        out = out.over(out.df.withColumn("__late", late).where("__late").drop("__late"))
    return out.renumbered("__part", base.seq).select(*base.fields)


def _joined(left: LaneFrame, right: LaneFrame, lanes: str, samples: str) -> tuple[DataFrame, list[str]]:
    """Rows of both by lane (null keys too) and sample; __l and __r say which side is there."""
    at = [*left.keys, left.seq]
    if lanes not in ("inner", "outer", "exact", "left", "right") or samples not in ("inner", "outer", "exact", "left", "right"):
        raise ValueError("joins are inner, outer, left, right or exact")
    a = left.df.withColumnsRenamed({c: f"__l_{c}" for c in (*left.fields, *([left.clock] if left.clock else []))}).withColumn("__l", F.lit(True))
    b = right.df.withColumnsRenamed({c: f"__r_{c}" for c in (*right.fields, *([right.clock] if right.clock else []))}).withColumn("__r", F.lit(True))
    if lanes == samples and lanes in ("inner", "left", "right"):
        return meet(a, b, at, lanes), at
    df = meet(a, b, at, "full")
    lane = left.lane
    has_l, has_r = F.bool_or(F.coalesce("__l", F.lit(False))).over(lane), F.bool_or(F.coalesce("__r", F.lit(False))).over(lane)
    df = df.withColumn("__lane_l", has_l).withColumn("__lane_r", has_r)
    both = F.col("__lane_l") & F.col("__lane_r")
    keep = {"inner": both, "outer": F.lit(True), "left": F.col("__lane_l"), "right": F.col("__lane_r"), "exact": F.when(both, F.lit(True)).otherwise(F.raise_error(F.lit("the frames have different lanes")))}[lanes]
    df = df.where(keep)
    there = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    same = F.when(there | ~both, F.lit(True)).otherwise(F.raise_error(F.lit("the frames have different samples")))
    rows = {"inner": there | ~both, "outer": F.lit(True), "left": F.col("__l").isNotNull() | ~both, "right": F.col("__r").isNotNull() | ~both, "exact": same}[samples]
    return df.where(rows).drop("__lane_l", "__lane_r"), at


def align_pair(left: LaneFrame, right: LaneFrame, lanes: str = "inner", samples: str = "exact", fill: float | None = None) -> tuple[LaneFrame, LaneFrame]:
    """Both frames over the same lanes and samples; holes that the join makes get ``fill``, missing values stay missing."""
    df, at = _joined(left, right, lanes, samples)
    out = []
    for f, side in ((left, "l"), (right, "r")):
        clock = [F.col(f"__{side}_{f.clock}").alias(f.clock)] if f.clock else []
        cols = [F.when(F.col(f"__{side}").isNotNull(), F.col(f"__{side}_{c}")).otherwise(F.lit(fill)).alias(c) for c in f.fields]
        out.append(f.over(df.select(*at, *clock, *cols), keys=left.keys, seq=left.seq))
    return out[0], out[1]


def align_many(frames: Sequence[LaneFrame], lanes: str = "inner", samples: str = "exact", fill: float | None = None) -> list[LaneFrame]:
    """All frames over the lanes and samples that all (inner), any (outer) or exactly all (exact) have, or that the first (left) or last (right) has."""
    for join in (lanes, samples):
        if join not in ("inner", "outer", "exact", "left", "right"):
            raise ValueError(f"unknown join {join}")
    base, held = frames[0], _common(frames)
    at = [*base.keys, base.seq]
    every = reduce(DataFrame.unionByName, [f.df.select(*at).withColumn("__f", F.lit(i)) for i, f in enumerate(held)])
    final = len(held) - 1
    index = every.groupBy(*at).agg(F.count_distinct("__f").alias("__n"), (F.min("__f") == 0).alias("__first"), (F.max("__f") == final).alias("__last"))
    own = every.groupBy(*base.keys).agg(F.count_distinct("__f").alias("__m"), (F.min("__f") == 0).alias("__lane_first"), (F.max("__f") == final).alias("__lane_last"))
    index = meet(index, own, base.keys, "inner")
    n = len(frames)
    keep_lane = {"inner": F.col("__m") == n, "outer": F.lit(True), "left": F.col("__lane_first"), "right": F.col("__lane_last"), "exact": F.when(F.col("__m") == n, F.lit(True)).otherwise(F.raise_error(F.lit("the frames have different lanes")))}[lanes]
    keep = {"inner": F.col("__n") == F.col("__m"), "outer": F.lit(True), "left": F.col("__first"), "right": F.col("__last"), "exact": F.when(F.col("__n") == F.col("__m"), F.lit(True)).otherwise(F.raise_error(F.lit("the frames have different samples")))}[samples]
    index = index.where(keep_lane).where(keep).select(*at)
    out = []
    for f in held:
        df = meet(index, f.df.withColumn("__there", F.lit(True)), at, "left")
        out.append(f.over(df.withColumns({c: F.when(F.col("__there"), F.col(c)).otherwise(F.lit(fill)) for c in f.fields}).drop("__there")))
    return out


def _agreed(a: Column, b: Column, compat: str, name: str, kind: str) -> Column:
    """A field of both frames as the policy takes it."""
    if compat == "override":
        return F.coalesce(a, b)
    bad = F.coalesce(a != b, F.lit(False)) if compat == "no_conflicts" else ~a.eqNullSafe(b)
    return F.when(bad, F.raise_error(F.lit(f"the frames disagree about {name}")).cast(kind)).otherwise(F.coalesce(a, b))


def merge(left: LaneFrame, right: LaneFrame, *more: LaneFrame, lanes: str = "inner", samples: str = "exact", compat: str = "no_conflicts", fill: float | None = None, prealign: dict | None = None, combine_attrs: str = "override") -> LaneFrame:
    """The fields of two or more frames over joined lanes and samples, one after another.

    A field of several must agree where both have it (no_conflicts), everywhere (equals; broadcast_equals is the same here, where a lane's
    samples always have rows of their own; identical: their attributes too), or the first one wins and later ones fill its holes (override). prealign:
    options of ``asof.synchronize`` to bring all to one clock first. combine_attrs: attributes of the first frame (override), none (drop), those of all, which must agree
    where several have them (no_conflicts), those that don't disagree (drop_conflicts), or the same in all (identical).
    """
    attrs = combined_attrs([left, right, *more], combine_attrs)
    if compat not in COMPAT:
        raise ValueError(f"unknown compat {compat}")
    frames = [left, right, *more]
    if prealign is not None:
        frames = asof.synchronize(frames, **prealign)
    if compat == "identical" and any(f.attrs != frames[0].attrs for f in frames):
        raise ValueError("the frames have different attributes")
    out = reduce(lambda a, b: _merged(a, b, lanes, samples, compat, fill), frames)
    return replace(out, attrs=attrs)


def combined_attrs(frames: Sequence[LaneFrame], how: str) -> dict[str, str]:
    """Attributes of several frames as one frame's, by the policy of ``merge``."""
    if how not in ("override", "drop", "no_conflicts", "drop_conflicts", "identical"):
        raise ValueError(f"unknown way to combine attributes {how}")
    first = dict(frames[0].attrs)
    if how in ("override", "drop"):
        return first if how == "override" else {}
    if how == "identical":
        if any(dict(f.attrs) != first for f in frames):
            raise ValueError("the frames have different attributes")
        return first
    said: dict[str, set[str]] = {}
    for f in frames:
        for k, v in f.attrs.items():
            said.setdefault(k, set()).add(v)
    if how == "no_conflicts" and (differ := sorted(k for k, v in said.items() if len(v) > 1)):
        raise ValueError(f"the frames disagree about {differ}")
    return {k: next(iter(v)) for k, v in said.items() if len(v) == 1}


def _merged(left: LaneFrame, right: LaneFrame, lanes: str, samples: str, compat: str, fill: float | None) -> LaneFrame:
    right = _common([left, right])[1]
    df, at = _joined(left, right, lanes, samples)
    cols = []
    for c in dict.fromkeys([*left.fields, *right.fields]):
        if c in left.fields and c in right.fields:
            x, hole = _agreed(F.col(f"__l_{c}"), F.col(f"__r_{c}"), compat, c, left.df.schema[c].dataType), F.lit(False)
        else:
            side = "l" if c in left.fields else "r"
            x, hole = F.col(f"__{side}_{c}"), F.col(f"__{side}").isNull()
        cols.append((x if fill is None else F.when(hole, F.lit(fill)).otherwise(x)).alias(c))
    clock = [F.coalesce(F.col(f"__l_{left.clock}"), *([F.col(f"__r_{right.clock}")] if right.clock else [])).alias(left.clock)] if left.clock else []
    out = df.select(*at, *clock, *cols)
    return LaneFrame(out, left.keys, left.seq, left.clock, tuple(dict.fromkeys([*left.fields, *right.fields])), {**right.components, **left.components}, left.attrs)


def topology(left: LaneFrame, right: LaneFrame, semantic: bool = False) -> str:
    """How two frames meet: same (lanes and samples of the same keys), or, semantically, broadcast (right lacks some of left's keys or its samples)."""
    if set(left.keys) == set(right.keys):
        return "same"
    if semantic and set(right.keys) < set(left.keys):
        return "broadcast"
    raise ValueError(f"lane keys {left.keys} and {right.keys} do not match")


def binary(left: LaneFrame, right: LaneFrame, f, lanes: str = "exact", samples: str = "exact", broadcast: bool = False, on: str = "sequence") -> LaneFrame:
    """f(left, right) of the fields that both have, aligned by lane and sample.

    on: sequence, by sample number; param, by equal clock values, which both must have alike (exact) and once each; auto, by the clock where both
    have one.
    broadcast: right has one row for some of left's lane keys and no samples; it is joined on the keys that it has, and several rows of a key are an error.
    """
    shared = [c for c in left.fields if c in right.fields]
    if broadcast:
        on = [k for k in right.keys if k in left.keys]
        once = right.df.groupBy(*on).agg(F.count("*").alias("__n"), *(F.first(c).alias(f"__r_{c}") for c in shared))
        alone = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("the right side has several rows of a key")))
        other = once.where(alone).drop("__n")
        if not on:
            raise ValueError("the frames share no lane key; give a single value as a column to map_fields")
        df = meet(left.df, other, on, "inner")
        return left.over(df.withColumns({c: f(F.col(c), F.col(f"__r_{c}")) for c in shared}).drop(*(f"__r_{c}" for c in shared))).select(*shared)
    topology(left, right)
    if on not in ("sequence", "param", "auto"):
        raise ValueError(f"unknown alignment {on}")
    right = _common([left, right])[1]
    if on == "param" or on == "auto" and left.clock and right.clock:
        if samples != "exact":
            raise ValueError("clocks are aligned exactly")
        a, b = _by_clock(left), _by_clock(right.rename(**{right.clock: left.clock}) if right.clock != left.clock else right)
        df, at = _joined(a, b, lanes, "exact")
        out = df.select(*left.keys, F.col(f"__l_{left.seq}").alias(left.seq), F.col(left.clock), *(f(F.col(f"__l_{c}"), F.col(f"__r_{c}")).alias(c) for c in shared))
        return left.over(out, fields=tuple(shared), components={})
    df, at = _joined(left, right, lanes, samples)
    clock = [F.col(f"__l_{left.clock}").alias(left.clock)] if left.clock else []
    return left.over(df.select(*at, *clock, *(f(F.col(f"__l_{c}"), F.col(f"__r_{c}")).alias(c) for c in shared)), fields=tuple(shared), components={})


def _by_clock(frame: LaneFrame) -> LaneFrame:
    """The frame with its clock as sample number and its number as clock; clock values that repeat are an error."""
    again = F.lead(frame.clock).over(frame.lane.orderBy(frame.clock)) == F.col(frame.clock)
    once = F.when(F.coalesce(again, F.lit(False)), F.raise_error(F.lit("a clock value repeats in a lane")).cast("boolean"))
    df = frame.df.withColumn("__once", once).where(F.col("__once").isNull()).drop("__once")
    return LaneFrame(df, frame.keys, frame.clock, frame.seq, frame.fields)


# core axes


def assemble_core(values: Sequence, output: str, lanes: str = "exact", samples: str = "exact") -> LaneFrame:
    """Frames of one scalar field each, in nested lists, as one field of nested arrays of the same shape."""
    flat: list[LaneFrame] = []

    def laid(v) -> Column:
        if isinstance(v, LaneFrame):
            if len(v.fields) != 1:
                raise ValueError("a core is assembled from frames of one field each")
            flat.append(v)
            return F.col(f"__c{len(flat) - 1}")
        if not v or len({_shape(x) for x in v}) > 1:
            raise ValueError("a core needs lists of the same shape")
        return F.array(*map(laid, v))

    core = laid(values)
    named = [f.rename(**{f.fields[0]: f"__c{i}"}) for i, f in enumerate(_common(flat))]
    out = reduce(lambda a, b: _merged(a, b, lanes, samples, "no_conflicts", None), named)
    return out.over(out.df.withColumn(output, core), fields=(*out.fields, output), components={}).select(output)


def _shape(v) -> tuple[int, ...]:
    return () if isinstance(v, LaneFrame) else (len(v), *(_shape(v[0]) if v else ()))


def stack_frames(frames: Sequence[LaneFrame], output: str) -> LaneFrame:
    """Frames of one scalar field each as one array field."""
    return assemble_core(list(frames), output)


def block_frames(rows: Sequence[Sequence[LaneFrame]], output: str) -> LaneFrame:
    """Frames of one scalar field each as one matrix field, row by row."""
    return assemble_core([list(r) for r in rows], output)


def concat_frames(frames: Sequence[LaneFrame], output: str, lanes: str = "exact", samples: str = "exact") -> LaneFrame:
    """Frames of one array field each, end to end."""
    named = [f.rename(**{f.fields[0]: f"__c{i}"}) for i, f in enumerate(_common(list(frames)))]
    out = reduce(lambda a, b: _merged(a, b, lanes, samples, "no_conflicts", None), named)
    return out.over(out.df.withColumn(output, F.concat(*(f"__c{i}" for i in range(len(named))))), fields=(*out.fields, output), components={}).select(output)


def stack_core(frame: LaneFrame, fields: Sequence[str], output: str) -> LaneFrame:
    """Scalar fields as one array field, in the given order."""
    return frame.with_fields(**{output: F.array(*fields)}).select(*(c for c in (*frame.fields, output) if c not in fields))


def block_core(frame: LaneFrame, rows: Sequence[Sequence[str]], output: str) -> LaneFrame:
    """Scalar fields as one matrix field, row by row."""
    used = {c for r in rows for c in r}
    return frame.with_fields(**{output: F.array(*(F.array(*r) for r in rows))}).select(*(c for c in (*frame.fields, output) if c not in used))


def concat_core(frame: LaneFrame, fields: Sequence[str], output: str) -> LaneFrame:
    """Array fields end to end."""
    return frame.with_fields(**{output: F.concat(*fields)}).select(*(c for c in (*frame.fields, output) if c not in fields))


def decompose_core(frame: LaneFrame, field: str, labels: Sequence[str], key_mode: str = "label") -> dict:
    """Label (or, with key_mode="index", place) -> frame of the scalar at its place in an array field."""
    if key_mode not in ("label", "index"):
        raise ValueError(f"unknown keys {key_mode}")
    return {(name if key_mode == "label" else i): frame.with_fields(**{name: F.get(field, F.lit(i))}).select(name) for i, name in enumerate(labels)}


def overlay_core(frame: LaneFrame, field: str, labels: Sequence[str], patches: Sequence[dict[str, Column]], on_overlap: str = "error") -> LaneFrame:
    """An array field with some labels replaced; labels in several patches are an error, or the last wins (replace)."""
    new: dict[str, Column] = {}
    for p in patches:
        if on_overlap == "error" and set(p) & set(new):
            raise ValueError(f"patches overlap in {sorted(set(p) & set(new))}")
        if set(p) - set(labels):
            raise ValueError(f"no labels {sorted(set(p) - set(labels))}")
        new |= p
    return frame.with_fields(**{field: F.array(*(new.get(x, F.get(field, F.lit(i))) for i, x in enumerate(labels)))})

"""LaneFrame: a DataFrame whose columns have roles.

Each row is one sample of one lane (an independent run). ``keys`` name the lane, ``seq`` orders its samples,
``clock`` is the time-like parameter, ``fields`` are the payload. Samples past the end of a lane are simply not
there, and a missing value is NULL: NaN is turned into NULL on entry and wherever a field is set.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: How the names of columns begin that operators add and take away again.
RESERVED = "__"


class RoleError(ValueError):
    """Roles that the columns can't have."""


def meet(a: DataFrame, b: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """A join on columns that both have, null with null; each of them once in the result, then the others of a and of b."""
    named = {c: f"__on{i}" for i, c in enumerate(on)}
    other = b.withColumnsRenamed(named)
    same = reduce(lambda x, y: x & y, (a[c].eqNullSafe(other[n]) for c, n in named.items()))
    taken = {"right": lambda c, n: F.col(n), "full": lambda c, n: F.coalesce(c, n)}.get(how, lambda c, n: F.col(c))
    rest = [c for df in (a, other) for c in df.columns if c not in named and c not in named.values()]
    return a.join(other, same, how).select(*(taken(c, n).alias(c) for c, n in named.items()), *rest)


@dataclass(frozen=True)
class LaneFrame:
    df: DataFrame
    keys: tuple[str, ...]
    seq: str
    clock: str | None = None
    fields: tuple[str, ...] = ()
    components: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    attrs: Mapping[str, str] = field(default_factory=dict)
    #: Clock values between the ranges of long lanes, in ticks (see operators.scan).
    cuts: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        named = [*self.keys, self.seq, *([self.clock] if self.clock else []), *self.fields]
        if missing := [c for c in dict.fromkeys(named) if c not in self.df.columns]:
            raise RoleError(f"no columns {missing}")
        if len(set(self.keys)) < len(self.keys) or len(set(self.fields)) < len(self.fields):
            raise RoleError("a key or field is named twice")
        if {self.seq, *self.keys} & set(self.fields) or self.seq in self.keys:
            raise RoleError("a column has two roles")
        seen: set[str] = set()
        for name, labels in self.components.items():
            if set(labels) - set(self.fields) or seen & set(labels):
                raise RoleError(f"component {name} needs fields of its own")
            seen |= set(labels)

    # construction

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], clock: str | None, fields: Sequence[str], order: Sequence[str] = (), seq: str = "seq", size: str | None = None) -> LaneFrame:
        """Roles for df; without a column ``seq`` samples are numbered from 0 by the clock and ``order``.

        size: column with the number of real samples of padded lanes; the padding goes.
        """
        if own := [c for c in df.columns if c.startswith(RESERVED)]:
            raise RoleError(f"names that begin with {RESERVED} are the library's own: {own}")
        if seq not in df.columns:
            by = [*([clock] if clock else []), *order]
            if not by:
                raise RoleError("samples need a clock or an order")
            df = df.withColumn(seq, (F.row_number().over(W.partitionBy(*keys).orderBy(*by)) - 1).cast("long"))
        if size:
            df = df.where(F.col(seq) < F.col(size)).drop(size)
        floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in [*fields, *([clock] if clock else [])] if c in floats})
        cols = dict.fromkeys([*keys, seq, *([clock] if clock else []), *fields])
        return cls(df.select(*cols), tuple(keys), seq, clock, tuple(fields))

    def over(self, df: DataFrame, **roles) -> LaneFrame:
        """The same roles, or changed ones, over other rows."""
        return replace(self, df=df, **roles)

    # windows that the lane operators share

    @property
    def lane(self) -> W:
        return W.partitionBy(*self.keys)

    @property
    def ordered(self) -> W:
        return self.lane.orderBy(self.seq)

    def renumbered(self, *by: str | Column) -> LaneFrame:
        """Samples numbered from 0 again, in order of ``by`` (default: as they are). Lanes with cuts are numbered range by range where the clock's order is asked for."""
        if self.cuts is not None and by and by[0] == self.clock:
            from wayline.operators import scan

            return self.over(scan.numbered(self, by))
        return self.over(self.df.withColumn(self.seq, (F.row_number().over(self.lane.orderBy(*(by or (self.seq,)))) - 1).cast("long")))

    # roles

    def set_roles(self, **roles) -> LaneFrame:
        """Change some of keys, seq, clock and fields; the others stay."""
        held = {"cuts": None} if {"keys", "clock"} & set(roles) else {}
        return replace(self, **held, **{k: tuple(v) if k in ("keys", "fields") else v for k, v in roles.items()})

    def merge_schema(self, other: LaneFrame) -> LaneFrame:
        """Components and attributes of both; the same roles are needed, and what both name must agree."""
        if (self.keys, self.seq, self.clock) != (other.keys, other.seq, other.clock):
            raise RoleError("frames with different lane keys, numbers or clocks have no common schema")
        for mine, theirs in ((self.components, other.components), (self.attrs, other.attrs)):
            if differ := sorted(k for k in mine.keys() & theirs.keys() if mine[k] != theirs[k]):
                raise RoleError(f"the frames disagree about {differ}")
        parts = {k: v for k, v in {**other.components, **self.components}.items() if set(v) <= set(self.fields)}
        return replace(self, components=parts, attrs={**other.attrs, **self.attrs})

    def patch_schema(self, patch: Mapping[str, object]) -> LaneFrame:
        """The frame with its schema patched: keys, seq, clock and fields replaced; components and attrs key by key, where None takes one away. What comes out must be sound."""
        if unknown := sorted(set(patch) - {"keys", "seq", "clock", "fields", "components", "attrs"}):
            raise RoleError(f"a schema has no {unknown}")
        roles = {k: patch[k] for k in ("keys", "seq", "clock", "fields") if k in patch}
        held = {}
        for part, now in (("components", self.components), ("attrs", self.attrs)):
            new = {**now, **(patch.get(part) or {})} if patch.get(part, now) is not None else {}
            held[part] = {k: tuple(v) if part == "components" else v for k, v in new.items() if v is not None}
        if "fields" in roles and "components" not in patch:
            held["components"] = {k: v for k, v in held["components"].items() if set(v) <= set(roles["fields"])}
        out = replace(self, **held, **({"cuts": None} if {"keys", "clock"} & set(roles) else {}), **{k: tuple(v) if k in ("keys", "fields") else v for k, v in roles.items()})
        return out

    def set_validity(self, size: str | Column) -> LaneFrame:
        """Only the samples below a lane's size (a column of it), or where a condition holds, numbered as they are; a column named for it leaves the frame."""
        if isinstance(size, str):
            if size not in self.df.columns:
                raise RoleError(f"no column {size}")
            return replace(self, df=self.df.where(F.col(self.seq) < F.col(size)), fields=tuple(f for f in self.fields if f != size))
        return self.over(self.df.where(F.coalesce(size, F.lit(False))))

    @classmethod
    def compose_components(cls, parts: Mapping[str, LaneFrame]) -> LaneFrame:
        """Frames of the same lanes and samples as components of one; their fields have names of their own."""
        (name, out), *rest = parts.items()
        found, at = {name: out.fields}, [*out.keys, out.seq]
        for label, part in rest:
            if set(part.fields) & set(out.fields):
                raise RoleError(f"component {label} repeats fields")
            new = part.df.select(*(F.col(a).alias(b) for a, b in zip((*part.keys, part.seq), at, strict=True)), *part.fields, F.lit(True).alias("__there"))
            matched = F.when(F.col("__there") & F.col("__here"), F.lit(True)).otherwise(F.raise_error(F.lit("components have different samples")))
            joined = meet(out.df.withColumn("__here", F.lit(True)), new, at, "full").where(matched).drop("__there", "__here")
            out, found = out.over(joined, fields=(*out.fields, *part.fields)), {**found, label: part.fields}
        return out.define_components(**found)

    def define_components(self, **components: Sequence[str]) -> LaneFrame:
        return replace(self, components={**self.components, **{k: tuple(v) for k, v in components.items()}})

    def component(self, name: str) -> LaneFrame:
        """Only the fields of one component."""
        return self.select(*self.components[name])

    def patch_component(self, name: str, values: LaneFrame) -> LaneFrame:
        """The component's fields with the values of another frame that has exactly its fields and samples."""
        labels = self.components[name]
        if set(values.fields) != set(labels):
            raise RoleError(f"component {name} has the fields {labels}")
        at = [*self.keys, self.seq]
        new = values.df.select(*at, *(F.col(c).alias(f"__new_{c}") for c in labels), F.lit(True).alias("__there"))
        matched = F.when(F.col("__there") & F.col("__here"), F.lit(True)).otherwise(F.raise_error(F.lit("patch and base have different samples")))
        joined = meet(self.df.withColumn("__here", F.lit(True)), new, at, "full").where(matched)
        return self.over(joined.withColumns({c: F.col(f"__new_{c}") for c in labels}).select(*self.df.columns))

    def frame_ids(self) -> dict[str, str | None]:
        return {k: self.attrs.get(k) for k in ("parent", "child", "expressed_in")}

    def retag(self, **ids: str | None) -> LaneFrame:
        """Frame ids without any change of numbers; None clears one."""
        kept = {**self.attrs, **ids}
        return replace(self, attrs={k: v for k, v in kept.items() if v is not None})

    def remap_ids(self, names: Mapping[str, str]) -> LaneFrame:
        """Frame ids renamed by a mapping that must not bring two together."""
        if len(set(names.values())) < len(names):
            raise RoleError("two frame ids would become one")
        return replace(self, attrs={k: names.get(v, v) if k in ("parent", "child", "expressed_in") else v for k, v in self.attrs.items()})

    def to_json(self) -> str:
        return json.dumps({"keys": self.keys, "seq": self.seq, "clock": self.clock, "fields": self.fields, "components": dict(self.components), "attrs": dict(self.attrs)})

    @classmethod
    def from_json(cls, df: DataFrame, text: str) -> LaneFrame:
        r = json.loads(text)
        parts = {k: tuple(v) for k, v in r["components"].items()}
        return cls(df, tuple(r["keys"]), r["seq"], r["clock"], tuple(r["fields"]), parts, r["attrs"])

    def faults(self, phases: Sequence[str] = ("roles", "samples", "clock")) -> list[tuple[str, str, int]]:
        """(phase, code, count) of what is wrong, in the order of the phases, which are roles (kinds of columns), samples and clock (values, in one pass).

        Codes: clock.dtype.invalid, seq.dtype.invalid, seq.missing, seq.repeated, key.missing, clock.missing, clock.back, clock.repeated.
        """
        if unknown := set(phases) - {"roles", "samples", "clock"}:
            raise ValueError(f"unknown phases {sorted(unknown)}")
        out, kinds = [], {f.name: f.dataType for f in self.df.schema}
        if "roles" in phases:
            if self.clock and not isinstance(kinds[self.clock], (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
                out.append(("roles", "clock.dtype.invalid", 1))
            if not isinstance(kinds[self.seq], T.IntegralType):
                out.append(("roles", "seq.dtype.invalid", 1))
        order, seq, t = self.ordered, F.col(self.seq), F.col(self.clock or self.seq)
        held = {
            "seq.missing": seq.isNull(), "seq.repeated": F.lag(self.seq).over(order) == seq,
            "key.missing": F.lit(False) if not self.keys else reduce(lambda a, b: a | b, (F.col(k).isNull() for k in self.keys)),
            "clock.missing": t.isNull(), "clock.back": t < F.lag(t).over(order), "clock.repeated": t == F.lag(t).over(order),
        }
        asked = [c for c in held if ("clock" if c.startswith("clock") else "samples") in phases and (self.clock or not c.startswith("clock"))]
        if asked:
            row = self.df.select(*(held[c].alias(f"c{i}") for i, c in enumerate(asked))).agg(*(F.count_if(f"c{i}").alias(f"c{i}") for i in range(len(asked)))).first()
            out += [("clock" if c.startswith("clock") else "samples", c, row[i]) for i, c in enumerate(asked) if row[i]]
        return out

    def validate(self) -> list[str]:
        """Faults of the values, found in one pass: empty when the frame is sound."""
        order = self.ordered
        t, before = F.col(self.clock or self.seq), F.lag(self.clock or self.seq).over(order)
        again = F.lag(self.seq).over(order) == F.col(self.seq)
        row = (
            self.df.select(again.alias("again"), (t < before).alias("back"), F.col(self.seq).isNull().alias("none"))
            .agg(*(F.count_if(c).alias(c) for c in ("again", "back", "none")))
            .first()
        )
        said = {"again": "samples of a lane with the same number", "back": "clock values that go back", "none": "samples without a number"}
        return [f"{row[k]} {said[k]}" for k in said if row[k]]

    # structure

    def select(self, *fields: str) -> LaneFrame:
        kept = {c: tuple(x) for c, x in self.components.items() if set(x) <= set(fields)}
        cols = dict.fromkeys([*self.keys, self.seq, *([self.clock] if self.clock else []), *fields])
        return replace(self, df=self.df.select(*cols), fields=tuple(fields), components=kept)

    def drop(self, *fields: str) -> LaneFrame:
        return self.select(*(f for f in self.fields if f not in fields))

    def rename(self, **names: str) -> LaneFrame:
        def new(c):
            return names.get(c, c)

        parts = {k: tuple(map(new, v)) for k, v in self.components.items()}
        return LaneFrame(self.df.withColumnsRenamed(names), tuple(map(new, self.keys)), new(self.seq), self.clock and new(self.clock), tuple(map(new, self.fields)), parts, self.attrs, self.cuts and self.cuts.withColumnsRenamed(names))

    def with_fields(self, **columns: Column) -> LaneFrame:
        """Payload columns added or replaced; NaN becomes a missing value."""
        df = self.df.withColumns(columns)
        floats = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        return replace(self, df=df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}), fields=tuple(dict.fromkeys([*self.fields, *columns])))

    def map_fields(self, f: Callable[[Column], Column]) -> LaneFrame:
        return self.with_fields(**{c: f(F.col(c)) for c in self.fields})

    def isel(self, at: int | slice | Sequence[int]) -> LaneFrame:
        """Samples by position in their lane, as slices and lists do: negative from the end, strides, repeats; numbered anew."""
        numbered = self.renumbered()
        p, n = F.col(self.seq), F.count("*").over(self.lane)
        if isinstance(at, int):
            return self.over(numbered.df.withColumn("__n", n).where(p == (F.lit(at) if at >= 0 else F.col("__n") + at)).drop("__n"))
        if isinstance(at, slice):
            step = 1 if at.step is None else at.step
            if step == 0:
                raise ValueError("a slice's step is not 0")
            df = numbered.df.withColumn("__n", n)
            size = F.col("__n")

            def bound(x, default):
                if x is None:
                    return default
                raw = F.lit(x) if x >= 0 else size + x
                low, high = (F.lit(0), size) if step > 0 else (F.lit(-1), size - 1)
                return F.greatest(low, F.least(high, raw))

            start = bound(at.start, F.lit(0) if step > 0 else size - 1)
            stop = bound(at.stop, size if step > 0 else F.lit(-1))
            inside = (p >= start) & (p < stop) if step > 0 else (p <= start) & (p > stop)
            hit = inside & (F.abs(p - start) % abs(step) == 0)
            picked = numbered.over(df.where(hit).drop("__n"))
            return picked.renumbered(F.col(self.seq) if step > 0 else F.col(self.seq).desc())
        wanted = self.df.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(at)], "__i long, __p long")
        df = numbered.df.withColumn("__n", n).join(F.broadcast(wanted), p == F.when(F.col("__p") >= 0, F.col("__p")).otherwise(F.col("__n") + F.col("__p")))
        return numbered.over(df.withColumn(self.seq, F.col("__i")).drop("__n", "__i", "__p")).renumbered()

    def sel(self, method: str | None = None, tolerance: float | None = None, **labels: object) -> LaneFrame:
        """Rows by label: a value, a list of values, or a slice with both ends included.

        method: nearest, pad (the last label not above the value) or backfill (the first not below) for single numbers, at most
        ``tolerance`` away: of a lane key among all lanes, of other columns in each lane. Ties go to the smaller label.
        """
        cond, df = F.lit(True), self.df
        if method is not None:
            for i, (c, want) in enumerate(labels.items()):
                away = {"nearest": F.abs(F.col(c) - want), "pad": F.lit(want) - F.col(c), "backfill": F.col(c) - want}[method]
                near = F.when((away >= 0) & (F.lit(True) if tolerance is None else away <= tolerance), F.struct(away, F.col(c).alias("at")))
                if c in self.keys:
                    best = df.agg(F.min(near)["at"].alias(f"__best{i}"))
                    df = df.join(F.broadcast(best), F.col(c) == F.col(f"__best{i}")).drop(f"__best{i}")
                else:
                    df = df.withColumn(f"__best{i}", F.min(near).over(self.lane)["at"]).where(F.col(c) == F.col(f"__best{i}")).drop(f"__best{i}")
            return self.over(df)
        for c, want in labels.items():
            if isinstance(want, slice):
                if want.step is not None:
                    raise ValueError("a label slice has no step")
                cond = cond & (F.lit(True) if want.start is None else F.col(c) >= want.start) & (F.lit(True) if want.stop is None else F.col(c) <= want.stop)
            else:
                cond = cond & (F.col(c).isin(*want) if isinstance(want, (list, tuple, set)) else F.col(c) == want)
        return self.over(self.df.where(cond))

    def where(self, cond: Column, other: object = None, drop: bool = False) -> LaneFrame:
        """Fields where the condition holds, else ``other``; drop: leave those samples out and number the rest anew."""
        true = F.coalesce(cond, F.lit(False))
        if drop:
            return self.over(self.df.where(true)).renumbered()
        return self.over(self.df.withColumn("__true", true).withColumns({c: F.when(F.col("__true"), F.col(c)).otherwise(F.lit(other)) for c in self.fields}).drop("__true"))

    def tidy(self, *by: str) -> DataFrame:
        """Rows for plotting: lane keys, number, clock, columns ``by`` that group lines, and a row for each numeric field and value that is there."""
        numbers = [f.name for f in self.df.schema if f.name in self.fields and f.name not in by and isinstance(f.dataType, T.NumericType)]
        kept = list(dict.fromkeys([*self.keys, self.seq, *([self.clock] if self.clock else []), *by]))
        cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in numbers))
        return self.df.select(*kept, F.explode(cells).alias("x")).select(*kept, "x.field", "x.value").where("value IS NOT NULL")

    def lane_sizes(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count("*").alias("size"))

    def apply_lanes(self, f: Callable, schema: str | T.StructType) -> DataFrame:
        """A pandas function of each lane, for what columns can't say; a lane must fit in a task."""
        return self.df.groupBy(*self.keys).applyInPandas(f, schema)

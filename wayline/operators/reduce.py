"""Reducers over samples, lanes or groups; grouping by keys and bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.frame import LaneFrame, meet

REDUCERS = ("mean", "sum", "std", "var", "median", "min", "max", "count", "any", "all")


def reducer(op: str, x: Column, skipna: bool = True, ddof: int = 0, weight: Column | None = None, numeric: bool = False) -> Column:
    """One aggregate over a column in which missing values are NULL.

    Sums of nothing are 0, other reducers of nothing missing. skipna=False: any missing value makes the result missing.
    Weights (mean and sum) count only where the value is there and must not be negative. NaN counts as missing. The median is exact,
    so all values of one key pass through one task; give keys, or use an approximate percentile, for tables as a whole.
    """
    if numeric:
        x = F.nullif(x.cast("double"), F.lit(float("nan")))
    if weight is not None and op not in ("mean", "sum"):
        raise ValueError(f"{op} takes no weights")
    n = F.count(x)
    if op == "count":
        return n
    if op in ("any", "all"):  # a missing number counts as true, as NaN does
        true = x.isNull() | (x.cast("double") != 0)
        return F.coalesce(F.bool_or(true), F.lit(False)) if op == "any" else F.coalesce(F.bool_and(true), F.lit(True))
    if weight is not None:
        w = F.when(weight < 0, F.raise_error(F.lit("a weight is negative")).cast("double")).otherwise(weight.cast("double"))
        total, seen = F.sum(x * w), F.sum(F.when(x.isNotNull(), w))
        out = total / F.when(seen != 0, seen) if op == "mean" else F.coalesce(total, F.lit(0.0))
    else:
        spread = F.var_pop(x) if ddof == 0 else F.var_pop(x) * n / F.when(n > ddof, n - ddof)
        out = {
            "mean": lambda: F.avg(x), "sum": lambda: F.coalesce(F.sum(x), F.lit(0)), "var": lambda: spread, "std": lambda: F.sqrt(spread),
            "median": lambda: F.median(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
        }[op]()
    return out if skipna else F.when(F.count("*") == n, out)


def reduce_by(df: DataFrame, keys: Sequence[str], op: str, fields: Sequence[str], **options) -> DataFrame:
    """One row per key, the fields reduced under their own names; no keys: one row in all."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.groupBy(*keys).agg(*(reducer(op, F.col(c), numeric=c in floats, **options).alias(c) for c in fields))


def reduce_lanes(frame: LaneFrame, op: str, over: str = "sequence", **options) -> DataFrame:
    """Fields reduced over the samples of each lane (sequence), over lanes at each sample number (lanes), or over all."""
    keys = {"sequence": frame.keys, "lanes": (frame.seq,), "all": ()}[over]
    if op == "median" and over == "all":
        return median_of_all(frame.df, frame.fields, **options)
    return reduce_by(frame.df, keys, op, frame.fields, **options)


#: Values that one task may sort at the end of a search for a median, and the accuracy of the quantile sketches before it.
LAST_VALUES, ACCURACY = 100_000, 10_000


def median_of_all(df: DataFrame, fields: Sequence[str], skipna: bool = True) -> DataFrame:
    """The exact median of each field over all rows, as one row; NaN counts as missing.

    Counting passes: quantile sketches say between which values the middle ranks are, tasks count what is below and inside, and the search
    goes on inside, which has about two thousand times fewer values after each pass. No task gets more than LAST_VALUES values. The passes run when this is called.
    """
    return df.sparkSession.createDataFrame([tuple(_median(df.select(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias("x")), skipna) for c in fields)], ", ".join(f"`{c}` double" for c in fields))


def _median(values: DataFrame, skipna: bool) -> float | None:
    seen = values.agg(F.count("x").alias("n"), F.count("*").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n, lo, hi = seen["n"], seen["lo"], seen["hi"]
    if n == 0 or not skipna and n < seen["rows"]:
        return None
    first, last, below, width = (n - 1) // 2, n // 2, 0, 2.0
    inside = n  # values in [lo, hi], of which the middle ones are to be found; below: those under lo
    while lo != hi and inside > LAST_VALUES:
        held = values.where(F.col("x").between(lo, hi))
        at = [min(1.0, max(0.0, (r - below) / inside + d * width / ACCURACY)) for r, d in ((first, -1), (last + 1, 1))]
        a, b = held.agg(F.percentile_approx("x", at, F.lit(ACCURACY)).alias("q")).first()["q"]
        c = held.agg(F.count_if(F.col("x") < a).alias("under"), F.count_if(F.col("x").between(a, b)).alias("in")).first()
        if below + c["under"] <= first and last < below + c["under"] + c["in"] and (a, b) != (lo, hi):
            lo, hi, below, inside = a, b, below + c["under"], c["in"]
        elif width > ACCURACY:
            break
        else:
            width *= 4
    if lo == hi:
        return lo
    counts = values.where(F.col("x").between(lo, hi)).groupBy("x").count().orderBy("x").collect() if inside <= LAST_VALUES else None
    if counts is None:
        raise RuntimeError("the search for the median did not narrow")
    found, rank = [], below
    for r in counts:
        found += [r["x"]] * sum(rank <= k < rank + r["count"] for k in (first, last))
        rank += r["count"]
    return found[0] + (found[1] - found[0]) / 2 if found[0] != found[1] else found[0]


def bin_of(x: Column, edges: Sequence[float], right: bool = True, include_lowest: bool = False) -> Column:
    """Number of the bin that holds x; missing outside all. right: bins include their right edges, else their left ones."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        low = (x >= a) if not right or (include_lowest and i == 0) else (x > a)
        cond = low & ((x <= b) if right else (x < b))
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def group_key(keys: dict[str, Column], missing: str = "error", label: object = None):
    """A function that adds group key columns to rows; missing keys: error, drop, or group under ``label``, which no key may be already."""

    def add(df: DataFrame) -> DataFrame:
        df = df.withColumns(keys)
        for k in keys:
            if missing == "drop":
                df = df.where(F.col(k).isNotNull())
            elif missing == "group":
                taken = F.raise_error(F.lit(f"a group key {k} is the label of missing keys")).cast(df.schema[k].dataType)
                df = df.withColumn(k, F.when(F.col(k) == F.lit(label), taken).otherwise(F.coalesce(k, F.lit(label))))
            else:
                df = df.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"a group key {k} is missing"))).otherwise(F.col(k)))
        return df

    return add


class Grouped:
    """Samples (or lanes) under group keys; lanes are pooled unless preserve_lanes keeps their keys too."""

    def __init__(self, frame: LaneFrame, keys: dict[str, Column], missing: str = "error", label: object = None, preserve_lanes: bool = False, domain: Sequence[object] | None = None):
        self.frame, self.names = frame, tuple(keys)
        self.lanes = frame.keys if preserve_lanes else ()
        self.df, self.domain = group_key(keys, missing, label)(frame.df), domain
        if domain is not None and (len(keys) != 1 or preserve_lanes):
            raise ValueError("a list of groups needs a single key and pooled lanes")

    @classmethod
    def by_bins(cls, frame: LaneFrame, source: Column, edges: Sequence[float], labels: Sequence[str] | None = None, right: bool = True, include_lowest: bool = False, empty: bool = True) -> Grouped:
        """Groups are the bins, in their order; samples outside all bins go. empty: keep bins without samples."""
        number = bin_of(source, edges, right, include_lowest)
        return cls(frame, {"bin": number if labels is None else F.element_at(F.array(*map(F.lit, labels)), number + 1)}, "drop", domain=(list(labels) if labels else list(range(len(edges) - 1))) if empty else None)

    def reduce(self, op: str, **options) -> DataFrame:
        out = reduce_by(self.df, [*self.lanes, *self.names], op, self.frame.fields, **options)
        if self.domain is None:
            return out
        name = self.names[0]
        every = self.frame.df.sparkSession.createDataFrame([(x,) for x in self.domain], f"{name} {self.df.schema[name].dataType.simpleString()}")
        joined = every.join(out, name, "left")
        return joined.fillna(0, list(self.frame.fields)) if op in ("count", "sum") else joined

    def ranks(self) -> DataFrame:
        """Groups in order of first appearance, or of the given list; many groups are numbered in ranges."""
        order = [F.min(F.struct(*self.frame.keys, self.frame.seq)).alias("__first")]
        firsts = self.df.groupBy(*self.lanes, *self.names).agg(*order)
        if self.lanes:
            over = W.partitionBy(*self.lanes).orderBy("__first")
            return firsts.withColumn("group_rank", (F.row_number().over(over) - 1).cast("long")).drop("__first")
        return ranked(firsts, "__first", "group_rank").drop("__first")

    def _numbered(self) -> DataFrame:
        """Rows with member, their place in their group in order of lane and sample.

        Samples are numbered in their lane, and lanes get the number of the group's samples before them; so what one task sorts is
        a lane of a group, or a row for each lane of a group, never all samples of a group.
        """
        by, keys = [*self.lanes, *self.names], list(dict.fromkeys([*self.lanes, *self.names, *self.frame.keys]))
        own = F.row_number().over(W.partitionBy(*keys).orderBy(self.frame.seq))
        counts = self.df.groupBy(*keys).agg(F.count("*").alias("__n"))
        lanes = W.partitionBy(*by).orderBy(*self.frame.keys).rowsBetween(W.unboundedPreceding, -1)
        before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(lanes), F.lit(0))).drop("__n")
        found = meet(self.df.withColumn("__own", own), before, keys, "inner")
        return found.withColumn("member", (F.col("__before") + F.col("__own") - 1).cast("long")).drop("__own", "__before")

    def padded(self) -> DataFrame:
        """Group keys, member (position in the group, in row order) and the fields."""
        return self._numbered().select(*self.lanes, *self.names, "member", *self.frame.fields)

    def stacked(self) -> DataFrame:
        """Samples with their group's rank and original number; sort by group_rank and member for the one sequence."""
        ranks = self.ranks()
        return meet(self._numbered(), ranks, [*self.lanes, *self.names], "inner").select(
            *self.lanes, *self.names, "group_rank", "member", F.col(self.frame.seq).alias("sequence_index"), *self.frame.fields
        )


#: Keys that one task numbers at most.
RANKED_ROWS = 200_000


def ranked(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows numbered from 0 in the order of a column whose values differ, in two passes where they are many.

    Bounds from a sample cut the order into ranges; a range's number of rows says where the next one begins. The bounds are literals, so both passes have the same
    ranges. Counting and sampling run when this is called.
    """
    n = rows.count()
    if n <= RANKED_ROWS:
        return rows.withColumn(name, (F.row_number().over(W.orderBy(by)) - 1).cast("long"))
    ranges = min(1_000, -(-n // (RANKED_ROWS // 4)))
    chosen = F.pmod(F.xxhash64(by), F.lit(n)) < min(n, 20 * ranges)
    sample = sorted((r[0] for r in rows.where(chosen).select(by).limit(100 * ranges).collect()), key=lambda r: tuple((x is not None, x) for x in r) if isinstance(r, tuple) else (r is not None, r))
    kind = rows.schema[by].dataType
    bounds = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []
    literals = F.array(*(_literal(b, kind) for b in dict.fromkeys(bounds))) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    rows = rows.withColumn("__range", F.size(F.filter(literals, lambda b: b <= F.col(by))))
    counts = rows.groupBy("__range").count()
    before = counts.select("__range", F.coalesce(F.sum("count").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(by)) - 1
    return rows.join(F.broadcast(before), "__range").withColumn(name, (place + F.col("__before")).cast("long")).drop("__range", "__before")


def _literal(value: object, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind, strict=True)))
    return F.lit(value).cast(kind)


def weighted_product(frame: LaneFrame, factors: Mapping[str, DataFrame], name: str = "weight") -> LaneFrame:
    """The frame with the product of several labelled weights (a name to rows of labels and the factor in ``name``); a negative factor is an error, whatever the product."""
    out = frame
    for i, (label, factor) in enumerate(factors.items()):
        out = weighted(out, factor.withColumn(name, F.when(F.col(name) < 0, F.raise_error(F.lit(f"negative weights of {label}")).cast("double")).otherwise(F.col(name).cast("double"))), name)
        out = out.over(out.df.withColumnRenamed(name, f"__factor{i}"))
    product = F.lit(1.0)
    for i in range(len(factors)):
        product = product * F.col(f"__factor{i}")
    df = out.df.withColumn(name, product).drop(*(f"__factor{i}" for i in range(len(factors))))
    return frame.over(df.select(*dict.fromkeys([*(c for c in frame.df.columns if c != name), name])))


def weighted(frame: LaneFrame, weights: DataFrame, name: str = "weight") -> LaneFrame:
    """The frame with a weight for each sample from labelled weights: rows of some of its lane keys, sample number or clock, and the weight.

    Labels must be there once each (rows are not multiplied), and a sample without a weight is an error; null lane keys are labels like others.
    """
    on = [c for c in weights.columns if c in (*frame.keys, frame.seq, frame.clock)]
    if not on or name not in weights.columns:
        raise ValueError("weights need labels that the frame has")
    once = weights.groupBy(*on).agg(F.count("*").alias("__n"), F.first(name).alias("__w"))
    once = once.select(*on, F.when(F.col("__n") > 1, F.raise_error(F.lit("a label has several weights")).cast("double")).otherwise(F.col("__w").cast("double")).alias("__w"))
    joined = meet(frame.df.drop(name), once, on, "left")
    there = F.when(F.col("__w").isNull(), F.raise_error(F.lit("a sample has no weight")).cast("double")).otherwise(F.col("__w"))
    return frame.over(joined.withColumn(name, there).drop("__w").select(*dict.fromkeys([*(c for c in frame.df.columns if c != name), name])))


def group_lanes(frame: LaneFrame, attributes: DataFrame, by: str, op: str, empty: Sequence[object] | None = None, **options) -> DataFrame:
    """Fields reduced over all samples of the lanes that share an attribute (lane keys, by)."""
    joined = frame.df.join(attributes.select(*frame.keys, by), list(frame.keys))
    out = reduce_by(joined, [by], op, frame.fields, **options)
    if empty is None:
        return out
    every = frame.df.sparkSession.createDataFrame([(x,) for x in empty], f"{by} {attributes.schema[by].dataType.simpleString()}")
    return every.join(out, by, "left")

"""Lanes cut into time ranges, so that a lane of any size runs in many tasks.

A split frame has cuts: clock values between the ranges of each long lane, from quantiles that tasks sketch for themselves.
Operators then work on a lane's ranges apart. What crosses a cut is a row or two for each range: the last sample before it and the
first one after it, which join the range's rows as sentinels, or the sum or number of what came before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions.clocks import Clock

#: Samples that a range of a split lane has, about, and ranges of a lane at most.
ROWS, RANGES = 4_000_000, 1024
CUTS, CHUNK = "__cuts", "__chunk"

#: Samples that a task of lanes holds in its sorts at once, about; more of them make more tasks.
TASK_ROWS = 100_000


def spread(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """df dealt by its keys over a task for each ``rows`` of it (default: TASK_ROWS); what one task holds is left to the session's settings.

    For tables that are read as they are, as their rows are counted first. The session's partitions, whose number may be small, and which are joined again
    by their packed bytes, would give a task more samples the larger the table is.
    """
    n = -(-df.count() // (rows or TASK_ROWS))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df


def split_lanes(frame: LaneFrame, rows: int = ROWS) -> LaneFrame:
    """The frame with lanes of more than ``rows`` samples cut into ranges of about so many (no more than RANGES of them); results don't change."""
    t = Clock.of(frame.df, frame.clock).ticks(F.col(frame.clock))
    clocked = frame.df.where(F.col(frame.clock).isNotNull()).select(*frame.keys, t.alias("__t"))
    sizes = clocked.groupBy(*frame.keys).agg(F.count("*").alias("__n")).where(F.col("__n") > rows)
    longs = clocked.join(sizes, same_lane(clocked, sizes, frame.keys), "left_semi")
    fractions = [k / RANGES for k in range(1, RANGES)]
    sketched = longs.groupBy(*frame.keys).agg(F.count("*").alias("__n"), F.percentile_approx("__t", fractions, F.lit(20_000)).alias("__q"))
    every = F.greatest(F.lit(1), F.floor(F.lit(RANGES * rows) / F.col("__n"))).cast("int")
    picked = F.filter("__q", lambda x, i: (i + 1) % every == 0)
    return replace(frame, cuts=sketched.select(*frame.keys, F.array_distinct(picked).alias(CUTS)))


def same_lane(a: DataFrame, b: DataFrame, keys: Sequence[str], other: Sequence[str] | None = None) -> Column:
    """Lane keys of two tables are the same, null with null."""
    out = F.lit(True)
    for k, o in zip(keys, other or keys, strict=True):
        out = out & a[k].eqNullSafe(b[o])
    return out


def with_chunk(rows: DataFrame, keys: Sequence[str], cuts: DataFrame, ticks: str) -> DataFrame:
    """rows with the number of their lane's range; 0 in lanes without cuts."""
    named = {k: f"__c{i}" for i, k in enumerate(keys)}
    cuts = cuts.select(*(F.col(k).alias(n) for k, n in named.items()), CUTS)
    joined = rows.join(cuts, same_lane(rows, cuts, keys, list(named.values())), "left")
    number = F.coalesce(F.size(F.filter(CUTS, lambda c: c <= F.col(ticks))), F.lit(0))
    return joined.withColumn(CHUNK, F.when(F.col(CUTS).isNull() | F.col(ticks).isNull(), 0).otherwise(number)).drop(CUTS, *named.values())


def _chunks(cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each range of the long lanes."""
    return cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size(CUTS))).alias(CHUNK))


def _around(found: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    every = _chunks(cuts, keys)
    named = {k: f"__k{i}" for i, k in enumerate([*keys, CHUNK])}
    found = found.withColumnsRenamed(named)
    return every.join(found, same_lane(every, found, [*keys, CHUNK], list(named.values())), "left").drop(*named.values())


def sentinels(rows: DataFrame, keys: Sequence[str], cuts: DataFrame, ticks: str, order: Sequence[str], after: bool = True) -> DataFrame:
    """Rows (with CHUNK) of the long lanes that each range is to know: the last row before it and, with ``after``, the first one behind it."""
    payload = F.struct(*(F.col(c) for c in rows.columns if c not in keys)).alias("__row")
    ranged = with_chunk(rows.join(cuts, same_lane(rows, cuts, keys), "left_semi"), keys, cuts, ticks)
    place = F.struct(*order)
    ends = ranged.select(*keys, CHUNK, payload, place.alias("__at")).groupBy(*keys, CHUNK).agg(F.max_by("__row", "__at").alias("__last"), F.min_by("__row", "__at").alias("__least"))
    lane = W.partitionBy(*keys)
    held = _around(ends, cuts, keys).withColumn("__before", F.last("__last", ignorenulls=True).over(lane.orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)))
    found = [F.col("__before")]
    if after:
        held = held.withColumn("__after", F.last("__least", ignorenulls=True).over(lane.orderBy(F.col(CHUNK).desc()).rowsBetween(W.unboundedPreceding, -1)))
        found.append(F.col("__after"))
    return held.select(*keys, CHUNK, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("__row")).select(*keys, CHUNK, "__row.*")


def carried(rows: DataFrame, keys: Sequence[str], cuts: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """rows (with CHUNK) with the totals of their lane's ranges before theirs: sums of a row for each range."""
    sums = rows.groupBy(*keys, CHUNK).agg(*(x.alias(c) for c, x in totals.items()))
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumns({c: F.sum(c).over(before) for c in totals}).withColumnsRenamed({k: f"__k{i}" for i, k in enumerate([*keys, CHUNK])})
    return rows.join(sums, same_lane(rows, sums, [*keys, CHUNK], [f"__k{i}" for i in range(len(keys) + 1)]), "left").drop(*(f"__k{i}" for i in range(len(keys) + 1)))


def numbered(frame: LaneFrame, by: Sequence[str]) -> DataFrame:
    """The frame's rows numbered anew in each lane, by the clock and what else is in ``by``: places in a range, and how many came before it."""
    t = Clock.of(frame.df, frame.clock).ticks(F.col(frame.clock))
    rows = with_chunk(frame.df.withColumn("__t", t), frame.keys, frame.cuts, "__t").drop("__t")
    rows = carried(rows, frame.keys, frame.cuts, {"__before": F.count("*")})
    place = F.row_number().over(W.partitionBy(*frame.keys, CHUNK).orderBy(*by)) - 1
    return rows.withColumn("__place", (place + F.coalesce("__before", F.lit(0))).cast("long")).withColumn(frame.seq, F.col("__place")).select(*frame.df.columns)


def running(frame: LaneFrame, steps: dict[str, Column], ahead: dict[str, Column], order: Sequence[str]) -> DataFrame:
    """Running sums of steps over lanes with cuts, under the steps' names; a missing step makes the sum missing from there on.

    ahead: columns that steps need, worked out first in each range, where the sample before the range is at hand. The first step of a lane counts as 0.
    """
    keys, t = list(frame.keys), Clock.of(frame.df, frame.clock).ticks(F.col(frame.clock))
    rows = frame.df.withColumns({"__t": t, "__own": F.lit(True)})
    more = sentinels(rows, keys, frame.cuts, "__t", ["__t", frame.seq], after=False).withColumn("__own", F.lit(False))
    rows = with_chunk(rows, keys, frame.cuts, "__t").unionByName(more)
    rows = rows.withColumns(ahead).withColumns({f"__step_{c}": x for c, x in steps.items()})
    lane = W.partitionBy(*keys, CHUNK).orderBy(*order)
    rows = rows.withColumn("__start", F.lag(F.lit(1)).over(lane).isNull()).where("__own")
    for c in steps:
        hole = F.col(f"__step_{c}").isNull() & ~F.col("__start")
        rows = rows.withColumns({f"__hole_{c}": hole.cast("int"), f"__step_{c}": F.coalesce(f"__step_{c}", F.lit(0.0))})
    sums = [f"__step_{c}" for c in steps] + [f"__hole_{c}" for c in steps]
    rows = carried(rows, keys, frame.cuts, {f"__b{i}": F.sum(x) for i, x in enumerate(sums)})
    so_far = lane.rowsBetween(W.unboundedPreceding, 0)
    total = {x: F.coalesce(F.col(f"__b{i}"), F.lit(0)) + F.sum(x).over(so_far) for i, x in enumerate(sums)}
    rows = rows.withColumns({f"__total{i}": v for i, v in enumerate(total.values())})
    n = len(steps)
    return rows.withColumns({c: F.when(F.col(f"__total{n + i}") == 0, F.col(f"__total{i}")) for i, c in enumerate(steps)}).select(*frame.df.columns)

"""Clocks of numbers and of instants, as exact whole ticks.

A clock is a number, TIMESTAMP, TIMESTAMP_NTZ or DATE. Instants become microseconds since 1970 in 64 bits before anything is taken from
anything else, so a difference is exact and only then a double; whole numbers (nanoseconds, say) are their own ticks, and doubles stay as they are.
Tolerances and offsets are numbers for clocks of numbers and intervals (``timedelta``) for clocks of instants. Rates are per second.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Microseconds of a second and of a day.
SECOND, DAY = 1_000_000, 86_400_000_000
INSTANTS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _of_day(value: Column) -> Column:
    """Microseconds of an instant or interval beyond its days."""
    hours, minutes, seconds = (F.extract(F.lit(part), value) for part in ("HOUR", "MINUTE", "SECOND"))
    return (hours.cast("long") * 3600 + minutes.cast("long") * 60) * F.lit(SECOND) + (seconds * F.lit(SECOND)).cast("long")


@dataclass(frozen=True)
class Clock:
    kind: T.DataType

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Clock:
        kind = df.schema[column].dataType
        if not isinstance(kind, (T.NumericType, *INSTANTS)):
            raise ValueError(f"a clock is a number or an instant, not {kind.simpleString()}")
        return cls(kind)

    @property
    def instants(self) -> bool:
        return isinstance(self.kind, INSTANTS)

    def ticks(self, value: Column) -> Column:
        if isinstance(self.kind, T.TimestampType):
            return F.unix_micros(value)
        if isinstance(self.kind, T.TimestampNTZType):
            return F.unix_date(value.cast("date")).cast("long") * F.lit(DAY) + _of_day(value)  # no session's time zone comes in
        if isinstance(self.kind, T.DateType):
            return F.unix_date(value).cast("long") * F.lit(DAY)
        return value

    def value(self, ticks: Column) -> Column:
        """The clock's value at ticks (a date at the day that they are in)."""
        if isinstance(self.kind, T.TimestampType):
            return F.timestamp_micros(ticks)
        if isinstance(self.kind, T.TimestampNTZType):
            return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.lit(datetime.timedelta(microseconds=1)) * ticks
        if isinstance(self.kind, T.DateType):
            return F.date_from_unix_date(F.floor(ticks / F.lit(DAY)).cast("int"))
        return ticks

    def span(self, length: object) -> float | int:
        """A tolerance or an offset in ticks; for instants only 0 may be a plain number."""
        if isinstance(length, datetime.timedelta):
            if not self.instants:
                raise ValueError("an interval goes with a clock of instants only")
            return (length.days * 86_400 + length.seconds) * SECOND + length.microseconds
        if self.instants and length != 0:
            raise ValueError("a clock of instants needs a timedelta here")
        return length

    def offset(self, tau: object) -> Column:
        """An offset as a column: a number, or an interval."""
        self.span(tau)
        return F.lit(tau if self.instants and tau != 0 else datetime.timedelta(0) if self.instants else float(tau))

    def offset_ticks(self, tau: Column) -> Column:
        """Ticks of an offset column."""
        return (F.extract(F.lit("DAY"), tau).cast("long") * F.lit(DAY) + _of_day(tau)) if self.instants else tau

    def literal(self, value: object) -> Column:
        """A value of this clock; instants as datetime, date or text."""
        if not self.instants:
            if isinstance(value, (datetime.date, str)):
                raise ValueError("a clock of numbers needs numbers")
            return F.lit(value)
        if isinstance(value, (int, float)):
            raise ValueError("a clock of instants needs instants")
        if isinstance(self.kind, T.TimestampType) and isinstance(value, datetime.datetime):
            return F.lit(value)
        return F.lit(value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else str(value)).cast(self.kind)

    def same(self, df: DataFrame, column: str) -> Clock:
        """The clock of another column, which must be of instants as this one is, or of numbers."""
        other = Clock.of(df, column)
        if other.instants != self.instants or (isinstance(other.kind, T.TimestampType) != isinstance(self.kind, T.TimestampType) and self.instants):
            raise ValueError(f"{column} and the clock are of different kinds: {other.kind.simpleString()} and {self.kind.simpleString()}")
        return other

    def unit(self) -> float:
        """Ticks of the unit that rates are per."""
        return float(SECOND) if self.instants else 1.0


def common(clocks: Sequence[Clock]) -> Clock:
    """The one kind of several clocks."""
    if len({(c.instants, isinstance(c.kind, T.TimestampType)) for c in clocks}) > 1:
        raise ValueError("frames to be put on one clock need clocks of the same kind")
    return reduce(lambda a, b: a if a.kind == b.kind or not isinstance(b.kind, (T.DoubleType, T.TimestampNTZType)) else b, clocks)

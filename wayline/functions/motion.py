"""Velocities and accelerations with a linear and an angular part, as struct columns and as six-vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.functions import spatial as sp

#: Order of a six-vector: fixed values.
LABELS = ("vx", "vy", "vz", "wx", "wy", "wz")


def motion(linear: Column, angular: Column) -> Column:
    """A velocity or acceleration of both parts, each a vector."""
    return F.struct(linear.alias("linear"), angular.alias("angular"))


def from_vector6(six: Column) -> Column:
    """Both parts from an array, the linear part first; another length is an error."""
    parts = [F.get(six, F.lit(i)) for i in range(6)]
    good = motion(sp.vector(*parts[:3]), sp.vector(*parts[3:]))
    fault = F.raise_error(F.lit("a six-vector has six numbers")).cast("boolean")
    return F.when(six.isNotNull() & F.coalesce(F.when(F.size(six) == 6, F.lit(True)), fault), good)


def as_vector6(m: Column) -> Column:
    return F.when(m.isNotNull(), F.array(*(m["linear"][c] for c in sp.VECTOR), *(m["angular"][c] for c in sp.VECTOR)))


def to_rep(m: Column, rep: str) -> Column:
    """components, or vector6."""
    if rep not in ("components", "vector6"):
        raise ValueError(f"unknown representation {rep}")
    return m if rep == "components" else as_vector6(m)


def linear(m: Column) -> Column:
    return m["linear"]


def angular(m: Column) -> Column:
    return m["angular"]


def madd(a: Column, b: Column) -> Column:
    return motion(sp.vadd(a["linear"], b["linear"]), sp.vadd(a["angular"], b["angular"]))


def msub(a: Column, b: Column) -> Column:
    return motion(sp.vsub(a["linear"], b["linear"]), sp.vsub(a["angular"], b["angular"]))


def turned(q: Column, m: Column) -> Column:
    """Both parts in another basis."""
    return motion(sp.rotate(q, m["linear"]), sp.rotate(q, m["angular"]))


def norm(v: Column, order: float = 2) -> Column:
    """Norm of any order of a vector struct."""
    size = [F.abs(v[c]) for c in sp.VECTOR]
    if order == float("inf"):
        return F.greatest(*size)
    if order == float("-inf"):
        return F.least(*size)
    if order == 0:
        return sum((F.when(x != 0, 1.0).when(x.isNotNull(), 0.0) for x in size[1:]), F.when(size[0] != 0, 1.0).when(size[0].isNotNull(), 0.0))
    if order == 2:
        return sp.magnitude(v)
    return F.pow(sum((F.pow(x, F.lit(float(order))) for x in size[1:]), F.pow(size[0], F.lit(float(order)))), F.lit(1.0 / order))

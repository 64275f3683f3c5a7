"""Vectors and matrices whose axes have names and labels, carried by the column itself.

Axes are metadata of an array column, so they pass through selections and Parquet files. Arithmetic brings the second operand's numbers into the order of
the first one's labels; products meet over the axis that both name. All of it is column expressions, and what labels say is settled when the plan is made.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import vectors

#: Key of a column's metadata.
KEY = "wayline.axes"


@dataclass(frozen=True)
class Axis:
    """An axis of arrays: its name, and a label for each place."""

    name: str
    labels: tuple[str, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "labels", tuple(self.labels))
        if not self.name or not self.labels or len(set(self.labels)) < len(self.labels):
            raise ValueError(f"axis {self.name!r} needs a name and labels that differ: {self.labels}")


def _metadata(axes: Sequence[Axis]) -> dict[str, str]:
    return {KEY: json.dumps([[a.name, list(a.labels)] for a in axes])}


def named(column: Column, name: str, *axes: Axis) -> Column:
    """The column under a name, with axes from the outermost in."""
    if len({a.name for a in axes}) < len(axes):
        raise ValueError("an axis is named twice")
    return column.alias(name, metadata=_metadata(axes))


def set_axes(df: DataFrame, column: str, *axes: Axis, check: bool = True) -> DataFrame:
    """df with axes on an array column (one axis: vector, two: matrix); with ``check`` an array of another size is an error where it is read."""
    kind, depth = df.schema[column].dataType, 0
    while kind.typeName() == "array":
        kind, depth = kind.elementType, depth + 1
    if depth != len(axes):
        raise ValueError(f"{column} has {depth} axes, not {len(axes)}")
    value = _sized(F.col(column), [len(a.labels) for a in axes]) if check else F.col(column)
    return df.select(*(named(value, c, *axes) if c == column else F.col(c) for c in df.columns))


def _sized(value: Column, sizes: list[int]) -> Column:
    right = F.size(value) == sizes[0]
    if len(sizes) == 2:
        right = right & F.forall(value, lambda row: F.size(row) == sizes[1])
    return F.when(value.isNull() | right, value).otherwise(F.raise_error(F.lit(f"an array has not the size {sizes}")))


def axes_of(df: DataFrame, column: str) -> tuple[Axis, ...]:
    held = df.schema[column].metadata.get(KEY)
    if held is None:
        raise ValueError(f"{column} has no axes")
    return tuple(Axis(n, tuple(x)) for n, x in json.loads(held))


def axis(df: DataFrame, column: str, name: str) -> Axis:
    found = [a for a in axes_of(df, column) if a.name == name]
    if not found:
        raise ValueError(f"{column} has no axis {name}")
    return found[0]


def _places(have: Axis, want: Axis) -> list[int]:
    if have.name != want.name:
        raise ValueError(f"axes {have.name} and {want.name} do not meet")
    return [have.labels.index(x) for x in want.labels]


def _reordered(value: Column, have: Sequence[Axis], want: Sequence[Axis]) -> Column:
    """An array of the axes ``have`` with its numbers where ``want`` has their labels."""
    if tuple(have) == tuple(want):
        return value
    inner = (lambda x: x) if len(have) == 1 else (lambda x: _reordered(x, have[1:], want[1:]))
    return F.array(*(inner(F.get(value, F.lit(i))) for i in _places(have[0], want[0])))


def _shared(a: Sequence[Axis], b: Sequence[Axis], join: str) -> list[Axis]:
    """Axes that both operands are brought to: labels must be the same (exact), or those that both have count (inner), in the first one's order."""
    if [x.name for x in a] != [x.name for x in b]:
        raise ValueError(f"axes {[x.name for x in a]} and {[x.name for x in b]} do not meet")
    if join not in ("exact", "inner"):
        raise ValueError(f"unknown join {join}")
    out = []
    for x, y in zip(a, b, strict=True):
        if join == "exact" and set(x.labels) != set(y.labels):
            raise ValueError(f"axis {x.name} has different labels: {x.labels} and {y.labels}")
        out.append(Axis(x.name, tuple(v for v in x.labels if v in y.labels)))
    return out


def elementwise(df: DataFrame, a: str, b: str, output: str, f: Callable[[Column, Column], Column], join: str = "exact") -> DataFrame:
    """df with f of two labelled arrays, number by number of the same labels."""
    mine, theirs = axes_of(df, a), axes_of(df, b)
    axes = _shared(mine, theirs, join)
    x, y = _reordered(F.col(a), mine, axes), _reordered(F.col(b), theirs, axes)
    made = F.zip_with(x, y, f) if len(axes) == 1 else F.zip_with(x, y, lambda p, q: F.zip_with(p, q, f))
    return df.select(*(F.col(c) for c in df.columns if c != output), named(made, output, *axes))


def add(df: DataFrame, a: str, b: str, output: str, join: str = "exact") -> DataFrame:
    return elementwise(df, a, b, output, lambda x, y: x + y, join)


def sub(df: DataFrame, a: str, b: str, output: str, join: str = "exact") -> DataFrame:
    return elementwise(df, a, b, output, lambda x, y: x - y, join)


def matmul(df: DataFrame, a: str, b: str, output: str, over: str | None = None) -> DataFrame:
    """df with the product of two labelled arrays (vectors or matrices) over the axis that both name (``over``, where they share two), by its labels."""
    mine, theirs = axes_of(df, a), axes_of(df, b)
    shared = [x.name for x in mine if x.name in {y.name for y in theirs}]
    if over is None and len(shared) != 1 or over is not None and over not in shared:
        raise ValueError(f"the product is over one axis that both have, of {shared}")
    over = over or shared[0]
    inner, other = axis(df, a, over), axis(df, b, over)
    if set(inner.labels) != set(other.labels):
        raise ValueError(f"axis {over} has different labels")
    x, y = F.col(a), F.col(b)
    if mine[0].name == over and len(mine) == 2:
        x = vectors.transpose(x)
    if theirs[-1].name == over and len(theirs) == 2:
        y = vectors.transpose(y)
    y = F.array(*(F.get(y, F.lit(i)) for i in _places(other, inner)))
    left, right = [q for q in mine if q.name != over], [q for q in theirs if q.name != over]
    if {q.name for q in left} & {q.name for q in right}:
        raise ValueError("the product would name an axis twice")
    if left and right:
        made = vectors.matmul(x, y)
    elif left:
        made = vectors.matvec(x, y)
    elif right:
        made = vectors.matvec(vectors.transpose(y), x)
    else:
        made = vectors.dot(x, y)
    out = named(made, output, *left, *right) if left or right else made.alias(output)
    return df.select(*(F.col(c) for c in df.columns if c != output), out)


def norm(df: DataFrame, column: str, output: str, order: float = 2, over: str | None = None) -> DataFrame:
    """df with the norm of a labelled vector, or of a matrix's vectors along an axis."""
    axes, x = axes_of(df, column), F.col(column)
    if len(axes) == 1:
        made = vectors.norm(x, order).alias(output)
    else:
        along = axis(df, column, over) if over else axes[-1]
        rest = [a for a in axes if a != along]
        rows = vectors.transpose(x) if axes[0] == along else x
        made = named(F.transform(rows, lambda row: vectors.norm(row, order)), output, *rest)
    return df.select(*(F.col(c) for c in df.columns if c != output), made)


def _at(x: Column, place: int, depth: int) -> Column:
    return F.get(x, F.lit(place)) if depth == 0 else F.transform(x, lambda row: F.get(row, F.lit(place)))


def pick(df: DataFrame, column: str, output: str, **labels: str) -> DataFrame:
    """df with the part of a labelled array at a label of some of its axes."""
    axes, x = list(axes_of(df, column)), F.col(column)
    for name, label in labels.items():
        at = [a.name for a in axes].index(axis(df, column, name).name)
        x = _at(x, axes[at].labels.index(label), at)
        axes.pop(at)
    return df.select(*(F.col(c) for c in df.columns if c != output), named(x, output, *axes) if axes else x.alias(output))

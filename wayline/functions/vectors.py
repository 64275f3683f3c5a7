"""Vectors and matrices as array columns: column expressions for small work, Arrow functions for solvers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def by_label(a: Column, have: list[str], want: list[str]) -> Column:
    """A vector's numbers in the order of wanted labels; a label that it lacks is an error."""
    if missing := [x for x in want if x not in have]:
        raise ValueError(f"no labels {missing}")
    return a if have == want else F.array(*(F.get(a, F.lit(have.index(x))) for x in want))


def add_labelled(a: Column, have: list[str], b: Column, other: list[str]) -> Column:
    """Sum of two labelled vectors, in the order of the first one's labels, which both must have."""
    if len(have) != len(other):
        raise ValueError("vectors with different labels")
    return add(a, by_label(b, other, have))


def sub_labelled(a: Column, have: list[str], b: Column, other: list[str]) -> Column:
    if len(have) != len(other):
        raise ValueError("vectors with different labels")
    return sub(a, by_label(b, other, have))


def dot_labelled(a: Column, have: list[str], b: Column, other: list[str]) -> Column:
    if len(have) != len(other):
        raise ValueError("vectors with different labels")
    return dot(a, by_label(b, other, have))


def matrix_norm(m: Column, order: str | float = "fro") -> Column:
    """Norm of a matrix: fro, 1 and -1 (columns), inf and -inf (rows), nuc, 2 and -2 (singular values)."""
    size = F.transform(m, lambda row: F.transform(row, lambda x: F.abs(x.cast("double"))))
    if order == "fro":
        return F.sqrt(total(F.transform(m, lambda row: dot(row, row))))
    if order in (1, -1, float("inf"), float("-inf")):
        sums = F.transform(transpose(size) if order in (1, -1) else size, total)
        return F.array_max(sums) if order > 0 else F.array_min(sums)
    if order not in ("nuc", 2, -2):
        raise ValueError(f"unknown order {order}")
    values = singular_values(m)
    return total(values) if order == "nuc" else F.array_max(values) if order == 2 else F.array_min(values)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column, order: float = 2) -> Column:
    """Vector norm of any order, as array libraries define them."""
    size = F.transform(a, lambda x: F.abs(x.cast("double")))
    if order == float("inf"):
        return F.array_max(size)
    if order == float("-inf"):
        return F.array_min(size)
    if order == 0:
        return total(F.transform(a, lambda x: F.when(x != 0, 1.0).otherwise(0.0)))
    if order == 1:
        return total(size)
    if order == 2:
        return F.sqrt(total(F.transform(size, lambda x: x * x)))
    return F.pow(total(F.transform(size, lambda x: F.pow(x, F.lit(float(order))))), F.lit(1.0 / order))


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def matvec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: dot(row, v))


def matmul(a: Column, b: Column) -> Column:
    turned = transpose(b)
    return F.transform(a, lambda row: F.transform(turned, lambda col: dot(row, col)))


def matmul_fixed(a: Column, b: Column, n: int, k: int, m: int) -> Column:
    """Product of matrices of known size, unrolled so that it stays in generated code."""

    def cell(i: int, j: int) -> Column:
        out = F.lit(0.0)
        for p in range(k):
            out = out + F.get(F.get(a, F.lit(i)), F.lit(p)) * F.get(F.get(b, F.lit(p)), F.lit(j))
        return out

    return F.array(*(F.array(*(cell(i, j) for j in range(m))) for i in range(n)))


def _cells(m: Column, n: int) -> list[list[Column]]:
    return [[F.get(F.get(m, F.lit(i)), F.lit(j)).cast("double") for j in range(n)] for i in range(n)]


def det(m: Column, n: int) -> Column:
    """Determinant of a 2 x 2 or 3 x 3 matrix."""
    a = _cells(m, n)
    if n == 2:
        return a[0][0] * a[1][1] - a[0][1] * a[1][0]
    return sum((a[0][i] * (a[1][(i + 1) % 3] * a[2][(i + 2) % 3] - a[1][(i + 2) % 3] * a[2][(i + 1) % 3]) for i in range(3)), F.lit(0.0))


def inv_small(m: Column, n: int) -> Column:
    """Inverse of a 2 x 2 or 3 x 3 matrix by cofactors; a singular one is an error."""
    a, d = _cells(m, n), det(m, n)
    d = F.when(d == 0, F.raise_error(F.lit("a matrix is singular")).cast("double")).otherwise(d)
    if n == 2:
        return F.array(F.array(a[1][1] / d, -a[0][1] / d), F.array(-a[1][0] / d, a[0][0] / d))

    def cofactor(i: int, j: int) -> Column:
        r, c = [(i + 1) % 3, (i + 2) % 3], [(j + 1) % 3, (j + 2) % 3]
        return a[r[0]][c[0]] * a[r[1]][c[1]] - a[r[0]][c[1]] * a[r[1]][c[0]]

    return F.array(*(F.array(*(cofactor(j, i) / d for j in range(3))) for i in range(3)))


def solve_small(m: Column, v: Column, n: int) -> Column:
    return matvec(inv_small(m, n), v)


def _stacked(s: pd.Series) -> np.ndarray:
    return np.stack([np.stack(x) if isinstance(x[0], np.ndarray) else np.asarray(x, float) for x in s]).astype(float)


def _each_shape(*series: pd.Series) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row positions and stacked operands, for rows of the same shapes together."""
    shapes: dict[tuple, list[int]] = {}
    for i, row in enumerate(zip(*series, strict=True)):
        if all(x is not None for x in row):
            shapes.setdefault(tuple((len(x), len(x[0]) if isinstance(x[0], np.ndarray) else 0) for x in row), []).append(i)
    for at in shapes.values():
        yield np.array(at), [_stacked(s.iloc[at]) for s in series]


VECTOR, MATRIX = T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.DoubleType()))


@pandas_udf(VECTOR)
def singular_values(m: pd.Series) -> pd.Series:
    """Singular values, the greatest first."""
    out: list = [None] * len(m)
    for at, (a,) in _each_shape(m):
        for i, x in zip(at, np.linalg.svd(a, compute_uv=False), strict=True):
            out[i] = x.tolist()
    return pd.Series(out)


@pandas_udf(MATRIX)
def inv(m: pd.Series) -> pd.Series:
    """Inverse of square matrices; a singular one is an error."""
    out: list = [None] * len(m)
    for at, (a,) in _each_shape(m):
        for i, x in zip(at, np.linalg.inv(a), strict=True):
            out[i] = x.tolist()
    return pd.Series(out)


@pandas_udf(VECTOR)
def solve(m: pd.Series, v: pd.Series) -> pd.Series:
    """x with m x = v: exactly for square matrices, by least squares for others."""
    out: list = [None] * len(m)
    for at, (a, b) in _each_shape(m, v):
        square = a.shape[1] == a.shape[2]
        x = np.linalg.solve(a, b[..., None])[..., 0] if square else np.stack([np.linalg.lstsq(p, q, rcond=None)[0] for p, q in zip(a, b, strict=True)])
        for i, y in zip(at, x, strict=True):
            out[i] = y.tolist()
    return pd.Series(out)


def lstsq(m: Column, v: Column, rcond: float | None = None) -> Column:
    """x that makes m x nearest to v; singular values below rcond times the greatest count as zero."""

    @pandas_udf(VECTOR)
    def run(m: pd.Series, v: pd.Series) -> pd.Series:
        out: list = [None] * len(m)
        for at, (a, b) in _each_shape(m, v):
            for i, p, q in zip(at, a, b, strict=True):
                out[i] = np.linalg.lstsq(p, q, rcond=rcond)[0].tolist()
        return pd.Series(out)

    return run(m, v)


def pinv(m: Column, rcond: float = 1e-15, hermitian: bool = False) -> Column:
    """Pseudo-inverse."""

    @pandas_udf(MATRIX)
    def run(s: pd.Series) -> pd.Series:
        out: list = [None] * len(s)
        for at, (a,) in _each_shape(s):
            for i, x in zip(at, np.linalg.pinv(a, rcond=rcond, hermitian=hermitian), strict=True):
                out[i] = x.tolist()
        return pd.Series(out)

    return run(m)

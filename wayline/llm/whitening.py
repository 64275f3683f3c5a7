"""Whitening of embeddings from an exact scatter matrix.

Components become integers. A task takes blocks of rows, subtracts each dimension's least value, and packs every bit of every
dimension across the rows of the block into 64-bit words. The product of two dimensions, summed over the block, is the sum over their
bit planes of 2 ** (bit + bit) times the number of ones in the AND of two planes, so all cross-products are exact integers, whatever the
order of rows or tasks. Spark adds up the tasks' numbers as decimals; a row for each pair of dimensions comes to the driver, which
centres them as integers (n * sum(xy) - sum(x) * sum(y)) before the only rounding, divides and takes eigenvectors.

Defined cases: a null vector, or one with a null or non-finite component, is left out; so are empty vectors and those of another length than most have (of
equally frequent lengths the longest counts), which can't share a covariance; null or repeated ids and repeated rows count like any
other; an empty table gives no rows. A component without variance (beyond rounding) has null for whitened values and doesn't count for the
identity error, which is 0 where no component has variance; explained is then 0. A component beyond 64 bits is an error. Further
columns pass through, of the names that this operator adds the input's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.clustering import whole
from wayline.llm.common import free, others, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows whose bits are packed together; a multiple of 64. All planes of a block take one bit for each row, dimension and bit.
BLOCK_ROWS = 1 << 14
#: Eigenvalues up to this share of the largest one, times the number of dimensions, are rounding.
ROUNDING = 1e-14
ADDED = ("n", "deviation", "whitened", "explained", "identity_error")
_SUMS = "i int, j int, total decimal(38,0)"


def integers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of every component c, worked out in doubles."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(offset).cast("long"))


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of non-negative integers (rows, dims): (words of each plane, its dimension, its bit)."""
    rows = -(-len(y) // 64) * 64
    made, dims, bits = [], [], []
    for d in range(y.shape[1]):
        column = np.zeros(rows, np.uint64)
        column[: len(y)] = y[:, d]
        for b in range(int(column.max(initial=0)).bit_length()):
            made.append(np.packbits((column >> np.uint64(b)).astype(np.uint8) & 1).view(np.uint64))
            dims.append(d)
            bits.append(b)
    return np.array(made, np.uint64).reshape(len(made), rows // 64), np.array(dims, np.int64), np.array(bits, np.int64)


def scatter(x: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """(rows, sums, sums of products) of integers (rows, dims), exact, by population counts of bit planes."""
    n, dims = x.shape
    base = [int(v) for v in x.min(axis=0)] if n else [0] * dims
    # a difference of two 64-bit integers is right modulo 2 ** 64, and it isn't negative
    words, dim, bit = planes(x.astype(np.uint64) - np.array([b % (1 << 64) for b in base], np.uint64))
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    sums = [0] * dims
    for d, b, c in zip(dim.tolist(), bit.tolist(), ones.tolist(), strict=True):
        sums[d] += c << b
    products = [[0] * dims for _ in range(dims)]
    top = int(bit.max(initial=0)) + n.bit_length() + 1  # bits of a weighted count, and of their sum over a dimension's planes
    weight = np.left_shift(np.int64(1), bit) if top < 62 else np.array([1 << b for b in bit.tolist()], object)
    starts = np.flatnonzero(np.diff(dim, prepend=-1))
    for p in range(len(words)):
        d, b = int(dim[p]), int(bit[p])
        first = int(starts[np.searchsorted(dim[starts], d)])  # planes of this dimension and of all after it
        counts = np.bitwise_count(words[first:] & words[p]).sum(axis=1, dtype=np.int64) * weight[first:]
        edges = starts[starts >= first] - first
        for e, total in zip(dim[first:][edges].tolist(), np.add.reduceat(counts, edges).tolist(), strict=True):
            products[d][e] += int(total) << b
    for i in range(dims):
        for j in range(i, dims):
            full = products[i][j] + base[i] * sums[j] + base[j] * sums[i] + n * base[i] * base[j]
            products[i][j] = products[j][i] = full
    return n, [s + n * b for s, b in zip(sums, base, strict=True)], products


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _scattered(batches: Iterator[pa.RecordBatch], x: str, dims: int) -> Iterator[pa.RecordBatch]:
    """A task's totals as rows (i, j, total): products for i <= j, sums as (i, -1), rows as (-1, -1)."""
    totals: dict[tuple[int, int], int] = {}
    held, size = [], 0

    def add(rows: np.ndarray) -> None:
        n, sums, products = scatter(rows)
        totals[-1, -1] = totals.get((-1, -1), 0) + n
        for i in range(dims):
            totals[i, -1] = totals.get((i, -1), 0) + sums[i]
            for j in range(i, dims):
                totals[i, j] = totals.get((i, j), 0) + products[i][j]

    for batch in batches:
        rows = _matrix(batch.column(x), dims)
        for at in range(0, len(rows), BLOCK_ROWS):
            part = rows[at : at + BLOCK_ROWS]
            if size + len(part) > BLOCK_ROWS:
                add(np.concatenate(held))
                held, size = [], 0
            held.append(part)
            size += len(part)
    if held:
        add(np.concatenate(held))
    if totals:
        with localcontext(prec=60):
            made = [pa.array([k[0] for k in totals], pa.int32()), pa.array([k[1] for k in totals], pa.int32()), pa.array([Decimal(v) for v in totals.values()], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(made, names=["i", "j", "total"])


def _summed(partial_rows: DataFrame) -> dict[tuple[int, int], int]:
    """A row for each pair of dimensions, to the driver."""
    rows = partial_rows.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    return {(r["i"], r["j"]): r["total"] for r in rows}


def principal(n: int, sums: list[int], products: dict[tuple[int, int], int], components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit eigenvectors as columns, eigenvalues falling, trace) of the covariance; products: exact, for i <= j."""
    dims = len(sums)
    v = np.zeros((dims, dims))
    for (i, j), total in products.items():
        v[i, j] = v[j, i] = (n * total - sums[i] * sums[j]) / (n * n)  # of integers: rounded once
    values, vectors = np.linalg.eigh(v)
    trace = sum(n * products[i, i] - sums[i] ** 2 for i in range(dims)) / (n * n)
    order = np.argsort(-values, kind="stable")[:components]
    return vectors[:, order], values[order], trace


def _projected(batches: Iterator[pa.RecordBatch], passed: list[str], x: str, n: int, sums: list[int], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """passed columns, deviation and whitened (axes: eigenvectors over roots of eigenvalues, NaN where there is no variance)."""
    dims, live = axes.shape[0], ~np.isnan(axes).any(axis=0)
    scaled = np.where(live, axes, 0.0)
    for batch in batches:
        rows = _matrix(batch.column(x), dims)
        most = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))) * n + max(map(abs, sums))
        off = (rows if most < 1 << 62 else rows.astype(object)) * n - np.array(sums, np.int64 if most < 1 << 62 else object)
        spread = int(np.abs(off).max(initial=0))
        squares = off if spread * spread * dims < 1 << 62 else off.astype(object)
        deviation = (squares * squares).sum(axis=1)
        values = (off / n).astype(float) @ scaled
        gone = np.broadcast_to(~live, values.shape).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), mask=gone))
        with localcontext(prec=60):
            exact = pa.array([Decimal(int(d)) for d in deviation], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), exact, lists], names=[*passed, "deviation", "whitened"])


def _moments(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sums and sums of products of a task's whitened values, those without variance as 0."""
    total, products, n = np.zeros(k), np.zeros((k, k)), 0
    for batch in batches:
        w = _matrix(batch.column("whitened").combine_chunks() if isinstance(batch.column("whitened"), pa.ChunkedArray) else batch.column("whitened"), k)
        w = np.nan_to_num(w.astype(float))
        total, products, n = total + w.sum(axis=0), products + w.T @ w, n + len(w)
    if n:
        i, j = np.triu_indices(k)
        made = [np.append(i, np.arange(k)), np.append(j, np.full(k, -1)), np.append(products[i, j], total)]
        yield pa.RecordBatch.from_arrays([pa.array(made[0].astype(np.int32)), pa.array(made[1].astype(np.int32)), pa.array(made[2])], names=["i", "j", "total"])


def identity_error(rows: DataFrame, n: int, live: np.ndarray) -> float:
    """The largest absolute entry of (covariance of the whitened values - identity), measured on the rows."""
    k = len(live)
    found = rows.select("whitened").mapInArrow(partial(_moments, k=k), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    of = {(r["i"], r["j"]): r["total"] for r in found}
    pairs = [(i, j) for i in range(k) for j in range(i, k) if live[i] and live[j]]
    return max((abs(of[i, j] / n - of[i, -1] * of[j, -1] / (n * n) - (i == j)) for i, j in pairs), default=0.0)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, vector: str = "embedding") -> DataFrame:
    """Whole vectors with n, deviation (decimal: exact sum of (n * x - sum) squared), whitened (array, by component), explained (array) and identity_error."""
    passed = others(vectors.columns, ADDED)
    (x,) = free([*passed, *ADDED], "x")
    kept = vectors.where(whole(F.col(vector)) & (F.size(vector) > 0)).select(*passed, integers(F.col(vector), scale, offset).alias(x))
    kept = written(kept, "integers")
    lengths = kept.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        kinds = dict(zip(ADDED, ("bigint", "decimal(38,0)", "array<double>", "array<double>", "double"), strict=True))
        return kept.select(*passed, *(F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()))
    dims = lengths[0]["d"]
    kept = kept.where(F.size(x) == dims)
    totals = _summed(kept.select(x).mapInArrow(partial(_scattered, x=x, dims=dims), _SUMS))
    totals = {k: int(v) for k, v in totals.items()}
    n, sums = totals.pop((-1, -1)), [totals.pop((i, -1)) for i in range(dims)]
    axes, values, trace = principal(n, sums, totals, components)
    live = values > ROUNDING * dims * max(values.max(), 0.0)
    axes = np.where(live, axes / np.sqrt(np.where(live, values, 1.0)), np.nan)
    schema = T.StructType([*(kept.schema[c] for c in passed), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    rows = written(kept.mapInArrow(partial(_projected, passed=passed, x=x, n=n, sums=sums, axes=axes), schema), "whitened")
    shares = [float(e / trace) if trace > 0 else 0.0 for e in values]
    error = identity_error(rows, n, live)
    return rows.select(*passed, F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, shares)).alias("explained"), F.lit(error).alias("identity_error"))

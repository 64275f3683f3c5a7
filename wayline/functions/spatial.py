"""Rotations, poses and vectors in space as struct columns, in closed forms.

Vectors are structs (x, y, z), quaternions (x, y, z, w) with the scalar last, poses (p, q). ``compose(a, b)`` applies a
first and then b.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

VECTOR, QUATERNION = ("x", "y", "z"), ("x", "y", "z", "w")


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))


def pose(p: Column, q: Column) -> Column:
    return F.struct(p.alias("p"), q.alias("q"))


def vadd(a: Column, b: Column) -> Column:
    return vector(*(a[c] + b[c] for c in VECTOR))


def vsub(a: Column, b: Column) -> Column:
    return vector(*(a[c] - b[c] for c in VECTOR))


def vscale(a: Column, k: Column) -> Column:
    return vector(*(a[c] * k for c in VECTOR))


def vdot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def magnitude(a: Column) -> Column:
    return F.sqrt(vdot(a, a))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once; without it expressions that use their input many times grow out of bounds.

    Higher-order functions are outside generated code: functions of plain columns do without, and ``staged`` serves whole tables.
    """
    return F.element_at(F.transform(F.array(x), f), 1)


def staged(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """df with columns added step by step: each step is worked out once and later ones use it, all in generated code."""
    for step in steps:
        df = df.withColumns(step)
    return df


def qdot(a: Column, b: Column) -> Column:
    return sum((a[c] * b[c] for c in QUATERNION[1:]), a["x"] * b["x"])


def normalised(q: Column) -> Column:
    """Unit quaternion; one of no length is an error."""

    def scaled(u: Column) -> Column:
        bad = (u["n"] == 0) | F.isnan(u["n"])
        n = F.when(bad, F.raise_error(F.lit("a quaternion has no direction")).cast("double")).otherwise(u["n"])
        return let(F.struct(u["q"].alias("q"), n.alias("n")), lambda v: quaternion(*(v["q"][c] / v["n"] for c in QUATERNION)))

    return let(q, lambda v: let(F.struct(v.alias("q"), F.sqrt(qdot(v, v)).alias("n")), scaled))


def hamilton(a: Column, b: Column) -> Column:
    """a times b."""
    return quaternion(
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
    )


def rotation_compose(a: Column, b: Column) -> Column:
    """First a, then b."""
    return hamilton(b, a)


def rotation_inverse(q: Column) -> Column:
    return quaternion(-q["x"], -q["y"], -q["z"], q["w"])


def rotate(q: Column, v: Column) -> Column:
    """v turned by a unit quaternion; both should be columns or small expressions."""
    t = [2.0 * (q[j] * v[k] - q[k] * v[j]) for j, k in (("y", "z"), ("z", "x"), ("x", "y"))]
    turned = [q["y"] * t[2] - q["z"] * t[1], q["z"] * t[0] - q["x"] * t[2], q["x"] * t[1] - q["y"] * t[0]]
    return vector(*(v[c] + q["w"] * t[i] + turned[i] for i, c in enumerate(VECTOR)))


def angle(q: Column) -> Column:
    """Angle of a rotation, 0 to pi."""
    return 2 * F.atan2(F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"]), F.abs(q["w"]))


def axis_angle(axis: Column, theta: Column) -> Column:
    """Quaternion of a turn by theta about a unit axis."""
    s = F.sin(theta / 2)
    return quaternion(axis["x"] * s, axis["y"] * s, axis["z"] * s, F.cos(theta / 2))


def to_matrix(q: Column) -> Column:
    x, y, z, w = (q[c] for c in QUATERNION)
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        F.array(2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        F.array(2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def from_matrix(m: Column) -> Column:
    """Quaternion of a rotation matrix, by its largest component."""
    a = [[F.get(F.get(m, F.lit(i)), F.lit(j)) for j in range(3)] for i in range(3)]
    trace = a[0][0] + a[1][1] + a[2][2]
    s0 = F.sqrt(F.greatest(trace + 1, F.lit(0.0))) * 2
    scalar = quaternion((a[2][1] - a[1][2]) / F.nullif(s0, F.lit(0.0)), (a[0][2] - a[2][0]) / F.nullif(s0, F.lit(0.0)), (a[1][0] - a[0][1]) / F.nullif(s0, F.lit(0.0)), s0 / 4)

    def led_by(i: int) -> Column:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = F.sqrt(F.greatest(1 + a[i][i] - a[j][j] - a[k][k], F.lit(0.0))) * 2
        d = F.nullif(s, F.lit(0.0))
        parts = {i: s / 4, j: (a[i][j] + a[j][i]) / d, k: (a[i][k] + a[k][i]) / d}
        return quaternion(parts[0], parts[1], parts[2], (a[k][j] - a[j][k]) / d)

    x_leads = (a[0][0] >= a[1][1]) & (a[0][0] >= a[2][2])
    return F.when(trace > 0, scalar).when(x_leads, led_by(0)).when(a[1][1] >= a[2][2], led_by(1)).otherwise(led_by(2))


def slerp(a: Column, b: Column, alpha: Column) -> Column:
    """Shortest turn from a to b; nearly equal ones are blended and normalised; the ends are exact.

    At half turns, where two ways are equally short, the sign of the quaternions' product decides as it comes: a product of zero or
    more turns forward, as the principal rotation vector of the turn between them does.
    """

    def turned(e: Column) -> Column:
        a, b, k, d = e["a"], e["b"], e["k"], F.least(F.abs(e["d"]), F.lit(1.0))
        theta, near, sign = F.acos(d), d > 1 - 1e-12, F.when(e["d"] < 0, -1.0).otherwise(1.0)
        s = F.when(near, F.lit(1.0)).otherwise(F.sin(theta))
        wa = F.when(near, 1 - k).otherwise(F.sin((1 - k) * theta) / s)
        wb = F.when(near, k).otherwise(F.sin(k * theta) / s) * sign
        mixed = let(F.struct(wa.alias("wa"), wb.alias("wb")), lambda w: normalised(quaternion(*(w["wa"] * a[c] + w["wb"] * b[c] for c in QUATERNION))))
        return F.when(k == 0, a).when(k == 1, b).when(k.isNotNull(), mixed)

    ends = F.struct(normalised(a).alias("a"), normalised(b).alias("b"), alpha.cast("double").alias("k"))
    return let(ends, lambda e: let(F.struct(e["a"].alias("a"), e["b"].alias("b"), e["k"].alias("k"), qdot(e["a"], e["b"]).alias("d")), turned))


def with_slerp(df: DataFrame, a: Column, b: Column, alpha: Column, output: str) -> DataFrame:
    """df with ``slerp(a, b, alpha)``, staged."""
    n = {f"__{x}n": F.sqrt(qdot(q, q)) for x, q in (("a", a), ("b", b))}
    unit = {}
    for x, q in (("a", a), ("b", b)):
        size = F.when((F.col(f"__{x}n") == 0) | F.isnan(f"__{x}n"), F.raise_error(F.lit("a quaternion has no direction")).cast("double")).otherwise(F.col(f"__{x}n"))
        unit |= {f"__{x}{c}": q[c] / size for c in QUATERNION}
    d = sum((F.col(f"__a{c}") * F.col(f"__b{c}") for c in QUATERNION[1:]), F.col("__ax") * F.col("__bx"))
    near = F.abs(F.col("__d")) > 1 - 1e-12
    sign = F.when(F.col("__d") < 0, -1.0).otherwise(1.0)
    k, theta = F.col("__k"), F.col("__theta")
    s = F.when(near, F.lit(1.0)).otherwise(F.sin("__theta"))
    weights = {"__wa": F.when(near, 1 - k).otherwise(F.sin((1 - k) * theta) / s), "__wb": F.when(near, k).otherwise(F.sin(k * theta) / s) * sign}
    mixed = {f"__m{c}": F.col("__wa") * F.col(f"__a{c}") + F.col("__wb") * F.col(f"__b{c}") for c in QUATERNION}
    size = F.sqrt(sum((F.col(f"__m{c}") * F.col(f"__m{c}") for c in QUATERNION[1:]), F.col("__mx") * F.col("__mx")))
    out = {c: F.when(k == 0, F.col(f"__a{c}")).when(k == 1, F.col(f"__b{c}")).otherwise(F.col(f"__m{c}") / F.col("__mn")) for c in QUATERNION}
    done = F.when(k.isNotNull() & F.col("__d").isNotNull(), quaternion(*out.values()))
    steps = staged(df, {**n, "__k": alpha.cast("double")}, unit, {"__d": d}, {"__theta": F.acos(F.least(F.abs("__d"), F.lit(1.0)))}, weights, mixed, {"__mn": size}, {output: done})
    return steps.drop("__k", "__d", "__theta", "__wa", "__wb", "__mn", *(f"__{x}{c}" for x in "abm" for c in QUATERNION), "__an", "__bn")


def pose_compose(a: Column, b: Column) -> Column:
    """First a, then b; both should be columns or small expressions (``with_composed`` stages longer chains)."""
    return pose(vadd(rotate(b["q"], a["p"]), b["p"]), rotation_compose(a["q"], b["q"]))


def with_composed(df: DataFrame, poses: list[Column], output: str) -> DataFrame:
    """df with poses put together, the first one first, a step at a time."""
    df = df.withColumn(output, poses[0])
    for p in poses[1:]:
        df = df.withColumn("__next", p).withColumn(output, pose_compose(F.col(output), F.col("__next")))
    return df.drop("__next")


def pose_inverse(a: Column) -> Column:
    back = rotation_inverse(a["q"])
    return pose(vscale(rotate(back, a["p"]), F.lit(-1.0)), back)


def pose_apply(a: Column, v: Column) -> Column:
    """A point turned and moved; for velocities and accelerations use ``rotate`` alone."""
    return vadd(rotate(a["q"], v), a["p"])


def pose_matrix(a: Column) -> Column:
    m = to_matrix(a["q"])
    return F.concat(F.zip_with(m, F.array(*(a["p"][c] for c in VECTOR)), lambda row, x: F.concat(row, F.array(x))), F.array(F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))))


def pose_from_matrix(m: Column, tol: float = 1e-6) -> Column:
    """Pose of a rigid 4 x 4 matrix; one that isn't rigid is an error."""
    a = [[F.get(F.get(m, F.lit(i)), F.lit(j)) for j in range(4)] for i in range(4)]
    faults = [F.abs(sum((a[i][k] * a[j][k] for k in (1, 2)), a[i][0] * a[j][0]) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)]
    faults += [F.abs(a[3][j] - (1.0 if j == 3 else 0.0)) for j in range(4)]
    p = vector(a[0][3], a[1][3], a[2][3])
    good = F.when(F.greatest(*faults) <= tol, pose(p, from_matrix(m)))
    return F.when(m.isNotNull(), F.coalesce(good, F.when(F.raise_error(F.lit("a matrix is not rigid")).cast("boolean"), good)))


def vector_of(df: DataFrame, pattern: str) -> Column:
    """Struct of columns named by a pattern such as ``drone.position.{x,y,z}``."""
    head, _, rest = pattern.partition("{")
    labels, _, tail = rest.partition("}")
    names = [f"{head}{x}{tail}" for x in labels.split(",")]
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no columns {missing}")
    return F.struct(*(F.col(f"`{n}`").cast("double").alias(c) for n, c in zip(names, QUATERNION if len(names) == 4 else VECTOR, strict=True)))


@pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in QUATERNION]))
def _dominant(rows: pd.Series) -> pd.DataFrame:
    """Eigenvector of the largest eigenvalue of 4 x 4 matrices given as their upper triangles."""
    there = rows.notna().to_numpy()
    out = np.full((len(rows), 4), np.nan)
    if there.any():
        m = np.zeros((int(there.sum()), 4, 4))
        at = np.triu_indices(4)
        m[:, at[0], at[1]] = m[:, at[1], at[0]] = np.stack(rows[there])
        v = np.linalg.eigh(m)[1][:, :, -1]
        out[there] = v * np.where(v[:, 3:] < 0, -1, 1)
    return pd.DataFrame(out, columns=list(QUATERNION))


def rotation_mean(df: DataFrame, keys: list[str], q: str, weight: str | None = None, output: str = "mean", skipna: bool = True) -> DataFrame:
    """Mean rotation of each group: ten sums of products that Spark adds up, then one eigenvector per group.

    Rows with a missing or non-finite rotation are skipped; with skipna=False they make their group's mean missing. A
    rotation without length is an error. Groups without rotations, or whose weights add up to nothing, have none.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    good = F.lit(True)
    for c in QUATERNION:
        good = good & F.coalesce(F.abs(F.col(q)[c]) < float("inf"), F.lit(False))
    u = df.withColumn("__good", good).withColumn("__u", F.when(F.col("__good"), normalised(F.col(q))))
    sums = [F.sum(w * F.col(f"__u.{a}") * F.col(f"__u.{b}")) for i, a in enumerate(QUATERNION) for b in QUATERNION[i:]]
    some = F.sum(F.when(F.col("__good"), w)) > 0
    some = some if skipna else some & F.bool_and("__good")
    packed = u.groupBy(*keys).agg(F.when(some, F.array(*sums)).alias("__m"))
    return packed.select(*keys, _dominant("__m").alias(output))


def yaw(theta: Column) -> Column:
    """Turn about z."""
    return quaternion(F.lit(0.0), F.lit(0.0), F.sin(theta / 2), F.cos(theta / 2))


HALF_TURN = math.pi

"""Array-library semantics for column arithmetic: signed infinities, floor modulo, half-even rounding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

INF, NAN = float("inf"), float("nan")


def divide(n: Column, d: Column) -> Column:
    """n / d where a zero divisor gives a signed infinity, or NaN for 0 / 0."""
    n, d = n.cast("double"), d.cast("double")
    zero = F.when((n == 0) | F.isnan(n), F.lit(NAN)).otherwise(F.signum(n) * F.lit(INF))
    return F.when(n.isNull() | d.isNull(), F.lit(None)).when(d == 0, zero).otherwise(n / F.when(d != 0, d))


def number(x: Column) -> Column:
    """x with NaN as a missing value: Spark itself orders NaN above all numbers."""
    return F.when(~F.isnan(x.cast("double")), x)


def _whole(x: Column, f) -> Column:
    """f of x where x has a fraction at all; infinities, NaN and numbers of 2 ** 53 and more are whole as they are."""
    x = x.cast("double")
    return F.when(F.abs(x) < 2.0**53, f(x).cast("double")).otherwise(x)


def floor_divide(n: Column, d: Column) -> Column:
    """The whole number of divisors in n, downwards; a zero divisor gives what division gives."""
    n, d = n.cast("double"), d.cast("double")
    some = F.when(d != 0, d)
    r = n % some
    q = (n - r) / some - F.when((r != 0) & ((r < 0) != (some < 0)), 1.0).otherwise(0.0)
    down = floor(q)
    return F.when(d == 0, divide(n, d)).otherwise(down + F.when(q - down > 0.5, 1.0).otherwise(0.0))


def mod(n: Column, d: Column) -> Column:
    """Modulo with the sign of the divisor; NaN for a zero divisor."""
    n, d = n.cast("double"), d.cast("double")
    some = F.when(d != 0, d)
    r = n % some
    r = F.when((r != 0) & ((r < 0) != (some < 0)), r + some).otherwise(r)
    return F.when(n.isNull() | d.isNull(), F.lit(None)).when(d == 0, F.lit(NAN)).otherwise(r)


def fmod(n: Column, d: Column) -> Column:
    """Modulo with the sign of the dividend."""
    return F.when(d == 0, F.lit(NAN)).otherwise(n.cast("double") % F.when(d != 0, d))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def _guarded(f, low: float, at: float | None):
    def log(x: Column) -> Column:
        x = x.cast("double")
        edge = F.lit(-INF if at is not None else NAN)
        return F.when(x.isNull(), F.lit(None)).when(x == low, edge).when(x < low, F.lit(NAN)).otherwise(f(x))

    return log


#: Logarithms with -inf at the pole and NaN below it.
log = _guarded(F.ln, 0, -INF)
log2 = _guarded(F.log2, 0, -INF)
log10 = _guarded(F.log10, 0, -INF)
log1p = _guarded(F.log1p, -1, -INF)


def sqrt(x: Column) -> Column:
    return F.sqrt(x.cast("double"))


def trunc(x: Column) -> Column:
    return _whole(x, lambda v: F.signum(v) * F.floor(F.abs(v)))


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil)


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def maximum(a: Column, b: Column) -> Column:
    """Greater of two, missing where either is (NaN too); ``fmax`` skips the missing one."""
    a, b = number(a), number(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def minimum(a: Column, b: Column) -> Column:
    a, b = number(a), number(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def fmax(a: Column, b: Column) -> Column:
    return F.greatest(number(a), number(b))


def fmin(a: Column, b: Column) -> Column:
    return F.least(number(a), number(b))


def signbit(x: Column) -> Column:
    """Whether the sign is minus, of zeros and infinities too."""
    return x.cast("double").cast("string").startswith("-")


def copysign(a: Column, b: Column) -> Column:
    a = F.abs(a.cast("double"))
    return F.when(signbit(b), -a).when(b.isNotNull(), a)


def logaddexp(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)); equal infinities stay what they are."""
    return F.when(a == b, a + math.log(2)).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def logaddexp2(a: Column, b: Column) -> Column:
    return F.when(a == b, a + 1.0).otherwise(F.greatest(a, b) + F.log1p(exp2(-F.abs(a - b))) / math.log(2))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers, by a bounded number of Euclid's steps; 0 and 0 give 0."""
    pair = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    # numbers of 63 bits take at most 91 steps
    done = F.aggregate(F.sequence(F.lit(1), F.lit(91)), pair, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b"))))
    return F.when(a.isNotNull() & b.isNotNull(), done["a"])


def lcm(a: Column, b: Column) -> Column:
    a, b = F.abs(a.cast("long")), F.abs(b.cast("long"))
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.expr("1L") * (a / F.nullif(gcd(a, b), F.lit(0).cast("long"))).cast("long") * b)


@pandas_udf(T.DoubleType())
def nextafter(a: pd.Series, b: pd.Series) -> pd.Series:
    """The next double from a towards b."""
    return pd.Series(np.nextafter(a.to_numpy(float), b.to_numpy(float))).where(a.notna() & b.notna(), None)


@pandas_udf(T.DoubleType())
def spacing(x: pd.Series) -> pd.Series:
    """Distance from x to the next double away from zero."""
    return pd.Series(np.spacing(x.to_numpy(float))).where(x.notna(), None)


def heaviside(x: Column, half: Column) -> Column:
    x = number(x)
    return F.when(x < 0, 0.0).when(x == 0, half).when(x > 0, 1.0)


def reciprocal(x: Column) -> Column:
    return divide(F.lit(1.0), x)


def isclose(a: Column, b: Column, atol: float = 1e-9, rtol: float = 1e-12) -> Column:
    """|a - b| <= atol + rtol * |b|, which is not symmetric in a and b."""
    a, b = number(a), number(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def _unary(name: str):
    return lambda x: getattr(F, name)(x.cast("double"))


#: Unary functions by name; those without an entry of their own are the built-in of the same meaning.
UNARY = {n: _unary(n) for n in ("abs", "cbrt", "exp", "expm1", "sin", "cos", "tan", "sinh", "cosh", "tanh", "asin", "acos", "atan", "asinh", "acosh", "atanh", "degrees", "radians", "rint")} | {
    "absolute": _unary("abs"), "fabs": _unary("abs"), "arcsin": _unary("asin"), "arccos": _unary("acos"), "arctan": _unary("atan"), "arcsinh": _unary("asinh"), "arccosh": _unary("acosh"), "arctanh": _unary("atanh"),
    "deg2rad": _unary("radians"), "rad2deg": _unary("degrees"), "sign": _unary("signum"), "sqrt": sqrt, "exp2": exp2, "log": log, "log2": log2, "log10": log10, "log1p": log1p, "trunc": trunc, "ceil": ceil, "floor": floor,
    "reciprocal": reciprocal, "square": lambda x: x * x, "negative": lambda x: -x, "positive": lambda x: x,
    "isnan": lambda x: x.isNull() | F.isnan(x), "isfinite": lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF), "isinf": lambda x: F.coalesce(F.abs(x) == INF, F.lit(False)), "signbit": signbit, "spacing": spacing, "conj": lambda x: x, "conjugate": lambda x: x, "angle": lambda x: F.atan2(F.lit(0.0), x.cast("double")),
    "invert": F.bitwise_not, "logical_not": lambda x: ~x,
}

def _compared(f):
    """A comparison of numbers that is missing where one of them is, NaN too."""
    return lambda a, b: f(number(a), number(b))


#: Binary functions by name.
BINARY = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": divide, "true_divide": divide, "floor_divide": floor_divide, "mod": mod, "remainder": mod, "fmod": fmod,
    "power": power, "pow": power, "float_power": power, "maximum": maximum, "minimum": minimum, "fmax": fmax, "fmin": fmin, "arctan2": F.atan2, "atan2": F.atan2, "hypot": F.hypot, "copysign": copysign,
    "logaddexp": logaddexp, "logaddexp2": logaddexp2, "heaviside": heaviside, "gcd": gcd, "lcm": lcm, "nextafter": nextafter, "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
    "left_shift": lambda a, b: F.call_function("shiftleft", a, b.cast("int")), "right_shift": lambda a, b: F.call_function("shiftright", a, b.cast("int")), "ldexp": lambda a, b: a * exp2(b),
    "equal": _compared(lambda a, b: a == b), "not_equal": _compared(lambda a, b: a != b), "greater": _compared(lambda a, b: a > b), "greater_equal": _compared(lambda a, b: a >= b), "less": _compared(lambda a, b: a < b), "less_equal": _compared(lambda a, b: a <= b),
    "logical_and": lambda a, b: a & b, "logical_or": lambda a, b: a | b, "logical_xor": lambda a, b: (a | b) & ~(a & b),
}

"""Column expressions with the semantics of IEEE doubles, where Spark SQL's own differ.

Spark's floor returns integers, NaN equals itself and sorts last, division by zero is an error, and the
logarithm of a negative number is null. These helpers stay inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def lit(x: float) -> Column:
    return F.lit(float(x))


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != lit(INF))


def dfloor(v: Column) -> Column:
    """Floor that stays a double; whole numbers beyond 2^53, infinities and NaN are their own floor."""
    return F.when(F.abs(v) < lit(2.0**53), F.floor(v).cast("double")).otherwise(v)


def dceil(v: Column) -> Column:
    return -dfloor(-v)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero it is an infinity, or NaN for 0/0 and NaN/0."""
    by_zero = F.when(F.isnan(a) | (a == 0.0), lit(NAN)).when(a > 0.0, lit(INF)).otherwise(lit(-INF))
    return F.when(b == 0.0, by_zero).otherwise(F.try_divide(a, b))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return a - b * dfloor(divide(a, b))


def rounded(v: Column, digits: int) -> Column:
    """To so many digits as the SQL beside it rounds: the product with a power of ten to whole numbers, halves away from zero.

    F.round takes each value's decimal text, which is slow, and goes the other way where the product just misses or meets a half.
    """
    unit = lit(10.0**digits)
    scaled = v * unit
    even = F.rint(scaled)
    out = F.when(F.abs(scaled - even) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(even) / unit
    return F.when(F.abs(out) < lit(INF), out).otherwise(v)


def power(a: Column, b: Column) -> Column:
    """C99 pow: one to any power is one, NaN included."""
    return F.when((a == 1.0) & ~F.isnan(a), lit(1.0)).otherwise(F.pow(a, b))


def sign(v: Column) -> Column:
    """-1, 0 or 1; NaN stays, and both zeros give 0.0."""
    return F.when(F.isnan(v), v).when(v > 0.0, lit(1.0)).when(v < 0.0, lit(-1.0)).otherwise(lit(0.0))


def log(v: Column, fn=F.log) -> Column:
    """A logarithm that is NaN below zero and minus infinity at zero."""
    return F.when(v < 0.0, lit(NAN)).when(v == 0.0, lit(-INF)).otherwise(fn(v))


#: Comparisons in which NaN equals nothing and is neither smaller nor larger than anything.
COMPARE = {
    "equal": lambda a, b: (a == b) & ~F.isnan(a) & ~F.isnan(b),
    "not_equal": lambda a, b: (a != b) | F.isnan(a) | F.isnan(b),
    "less": lambda a, b: (a < b) & ~F.isnan(a) & ~F.isnan(b),
    "less_equal": lambda a, b: (a <= b) & ~F.isnan(a) & ~F.isnan(b),
    "greater": lambda a, b: (a > b) & ~F.isnan(a) & ~F.isnan(b),
    "greater_equal": lambda a, b: (a >= b) & ~F.isnan(a) & ~F.isnan(b),
}


def _either(pick):
    return lambda a, b: F.when(F.isnan(a) | F.isnan(b), lit(NAN)).otherwise(pick(a, b))


def _as_bool(fn):
    return lambda a, b: fn(a != 0.0, b != 0.0)


def _as_long(fn):
    return lambda a, b: fn(a.cast("long"), b.cast("long")).cast("double")


#: Functions of one value, and whether they keep zero (so that missing cells may stay missing).
UNARY = {
    "abs": (F.abs, True),
    "negative": (lambda v: -v, True),
    "positive": (lambda v: v, True),
    "sign": (sign, True),
    "signbit": (lambda v: (v < 0.0) | (v.cast("string") == "-0.0"), True),
    "sqrt": (F.sqrt, True),
    "square": (lambda v: v * v, True),
    "floor": (dfloor, True),
    "ceil": (dceil, True),
    "trunc": (lambda v: F.when(v < 0.0, dceil(v)).otherwise(dfloor(v)), True),
    "round": (F.rint, True),
    "exp": (F.exp, False),
    "expm1": (F.expm1, True),
    "log": (log, False),
    "log1p": (lambda v: F.when(v < -1.0, lit(NAN)).when(v == -1.0, lit(-INF)).otherwise(F.log1p(v)), True),
    "log2": (lambda v: log(v, F.log2), False),
    "log10": (lambda v: log(v, F.log10), False),
    "sin": (F.sin, True),
    "cos": (F.cos, False),
    "tan": (F.tan, True),
    "asin": (F.asin, True),
    "acos": (F.acos, False),
    "atan": (F.atan, True),
    "sinh": (F.sinh, True),
    "cosh": (F.cosh, False),
    "tanh": (F.tanh, True),
    "asinh": (F.asinh, True),
    "acosh": (F.acosh, False),
    "atanh": (F.atanh, True),
    "isfinite": (is_finite, False),
    "isinf": (lambda v: F.abs(v) == lit(INF), True),
    "isnan": (F.isnan, True),
    "logical_not": (lambda v: v == 0.0, False),
    "bitwise_invert": (lambda v: F.bitwise_not(v.cast("long")).cast("double"), False),
    "real": (lambda v: v, True),
    "imag": (lambda v: v * 0.0, True),
    "conj": (lambda v: v, True),
}

#: Functions of one value that are true or false.
TESTS = ("signbit", "isfinite", "isinf", "isnan", "logical_not")

#: Functions of two values.
BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": divide,
    "floor_divide": lambda a, b: dfloor(divide(a, b)),
    "remainder": floor_mod,
    "pow": power,
    "maximum": _either(F.greatest),
    "minimum": _either(F.least),
    "atan2": F.atan2,
    "copysign": lambda a, b: F.when((b < 0.0) | (b.cast("string") == "-0.0"), -F.abs(a)).otherwise(F.abs(a)),
    "logaddexp": lambda a, b: F.when(a == b, a + lit(math.log(2.0))).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))),
    "logical_and": _as_bool(lambda a, b: a & b),
    "logical_or": _as_bool(lambda a, b: a | b),
    "logical_xor": _as_bool(lambda a, b: a != b),
    "bitwise_and": _as_long(lambda a, b: a.bitwiseAND(b)),
    "bitwise_or": _as_long(lambda a, b: a.bitwiseOR(b)),
    "bitwise_xor": _as_long(lambda a, b: a.bitwiseXOR(b)),
    "bitwise_left_shift": _as_long(lambda a, b: F.call_function("shiftleft", a, b.cast("int"))),
    "bitwise_right_shift": _as_long(lambda a, b: F.call_function("shiftright", a, b.cast("int"))),
} | COMPARE


def binomials(n: int) -> list[int]:
    """Signed weights of the n-th difference: of the value k places on."""
    return [(-1) ** (n - k) * math.comb(n, k) for k in range(n + 1)]

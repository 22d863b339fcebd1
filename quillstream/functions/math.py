"""Arithmetic, comparison, boolean, time and conditional functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import BOOLEAN, FLOAT64, INT64, STRING, TIME64NS, UINT128, Value, constant, define

EPSILON = 2.220446049250313e-16
NUMBERS = (INT64, FLOAT64)
PAIRS = [((a, b), INT64 if a == b == INT64 else FLOAT64) for a in NUMBERS for b in NUMBERS]
TO_FLOAT = [((a, b), FLOAT64) for a in NUMBERS for b in NUMBERS]
ONE_FLOAT = [((a,), FLOAT64) for a in NUMBERS]


def _nan() -> Column:
    return F.lit(float("nan"))


def _inf() -> Column:
    return F.lit(float("inf"))


def _double(v: Value) -> Column:
    return v.col.cast("double")


def _wrapping(a: Value, b: Value, sign: str) -> Column | None:
    """64-bit integers wrap on overflow; ANSI mode would raise."""
    if a.type == FLOAT64 or b.type == FLOAT64:
        return None
    wide = F.lit(None)
    x, y = a.col.cast("decimal(38,0)"), b.col.cast("decimal(38,0)")
    wide = {"+": x + y, "-": x - y, "*": x * y}[sign]
    fast = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sign](a.col, b.col)
    span = F.lit(str(2**64)).cast("decimal(38,0)")
    low = F.pmod(wide + F.lit(str(2**63)).cast("decimal(38,0)"), span) - F.lit(str(2**63)).cast("decimal(38,0)")
    return F.coalesce(fast, F.when(a.col.isNotNull() & b.col.isNotNull(), low.cast("long")))


@define("add", *PAIRS, ((TIME64NS, INT64), TIME64NS), ((INT64, TIME64NS), TIME64NS), ((STRING, STRING), STRING))
def add(a: Value, b: Value) -> Column:
    """Sum, or concatenation of strings."""
    if a.type == STRING:
        return F.concat(a.col, b.col)
    found = _wrapping(a, b, "+")
    return a.col + b.col if found is None else found


@define("subtract", *PAIRS, ((TIME64NS, TIME64NS), INT64), ((TIME64NS, INT64), TIME64NS), ((INT64, TIME64NS), TIME64NS))
def subtract(a: Value, b: Value) -> Column:
    """Difference."""
    found = _wrapping(a, b, "-")
    return a.col - b.col if found is None else found


@define("multiply", *PAIRS)
def multiply(a: Value, b: Value) -> Column:
    """Product."""
    found = _wrapping(a, b, "*")
    return a.col * b.col if found is None else found


@define("divide", *TO_FLOAT)
def divide(a: Value, b: Value) -> Column:
    """IEEE quotient as a double: division by zero gives infinities or NaN."""
    x, y = _double(a), _double(b)
    by_zero = F.when((x == 0) | F.isnan(x), _nan()).when(x > 0, _inf()).otherwise(-_inf())
    return F.when(y == 0, by_zero).otherwise(x / F.when(y == 0, F.lit(None)).otherwise(y))


@define("modulo", ((INT64, INT64), INT64), ((TIME64NS, INT64), INT64), ((INT64, TIME64NS), INT64), ((TIME64NS, TIME64NS), INT64))
def modulo(a: Value, b: Value) -> Column:
    """Remainder with the sign of the dividend."""
    return F.try_mod(a.col, b.col)


def _log(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), _nan()).when(x == 0, -_inf()).otherwise(F.ln(x))


@define("log", *TO_FLOAT)
def log(base: Value, v: Value) -> Column:
    """Logarithm of v to a base; the base comes first."""
    return _log(_double(v)) / _log(_double(base))


@define("ln", *ONE_FLOAT)
def ln(v: Value) -> Column:
    """Natural logarithm: NaN below zero, minus infinity at zero."""
    return _log(_double(v))


@define("log2", *ONE_FLOAT)
def log2(v: Value) -> Column:
    """Logarithm to base 2."""
    x = _double(v)
    return F.when(F.isnan(x) | (x < 0), _nan()).when(x == 0, -_inf()).otherwise(F.log2(x))


@define("log10", *ONE_FLOAT)
def log10(v: Value) -> Column:
    """Logarithm to base 10."""
    x = _double(v)
    return F.when(F.isnan(x) | (x < 0), _nan()).when(x == 0, -_inf()).otherwise(F.log10(x))


@define("pow", *TO_FLOAT)
def power(x: Value, y: Value) -> Column:
    """x to the power y."""
    return F.pow(_double(x), _double(y))


@define("exp", *ONE_FLOAT)
def exp(v: Value) -> Column:
    """e to the power v."""
    return F.exp(_double(v))


@define("abs", ((INT64,), INT64), ((FLOAT64,), FLOAT64))
def absolute(v: Value) -> Column:
    """Absolute value."""
    return F.abs(v.col)


@define("sqrt", *ONE_FLOAT)
def sqrt(v: Value) -> Column:
    """Square root; NaN below zero."""
    return F.sqrt(_double(v))


@define("ceil", ((FLOAT64,), INT64))
def ceil(v: Value) -> Column:
    """Least integer that is not smaller."""
    return F.ceil(v.col).cast("long")


@define("floor", ((FLOAT64,), INT64))
def floor(v: Value) -> Column:
    """Greatest integer that is not larger."""
    return F.floor(v.col).cast("long")


@define("round", ((FLOAT64, INT64), STRING))
def round_(v: Value, places: Value) -> Column:
    """The number with so many decimals, as text (ties go up, on the shortest decimal form)."""
    return F.format_string(f"%.{max(0, int(constant(places, 'the number of decimals')))}f", v.col)


@define("negate", ((INT64,), INT64), ((FLOAT64,), FLOAT64))
def negate(v: Value) -> Column:
    """Unary minus."""
    return -v.col


@define("invert", ((INT64,), INT64))
def invert(v: Value) -> Column:
    """Bitwise complement."""
    return F.bitwise_not(v.col)


def _truth(v: Value) -> Column:
    return v.col if v.type == BOOLEAN else v.col != 0


@define("logicalOr", ((BOOLEAN, BOOLEAN), BOOLEAN), ((INT64, INT64), BOOLEAN))
def logical_or(a: Value, b: Value) -> Column:
    """Either is true (or non-zero)."""
    return _truth(a) | _truth(b)


@define("logicalAnd", ((BOOLEAN, BOOLEAN), BOOLEAN), ((INT64, INT64), BOOLEAN))
def logical_and(a: Value, b: Value) -> Column:
    """Both are true (or non-zero)."""
    return _truth(a) & _truth(b)


@define("logicalNot", ((BOOLEAN,), BOOLEAN), ((INT64,), BOOLEAN))
def logical_not(v: Value) -> Column:
    """Not true (or zero)."""
    return ~_truth(v)


COMPARED = [((t, t), BOOLEAN) for t in (INT64, STRING, BOOLEAN, TIME64NS, UINT128, FLOAT64)]
MIXED = [((INT64, FLOAT64), BOOLEAN), ((FLOAT64, INT64), BOOLEAN), ((INT64, BOOLEAN), BOOLEAN), ((BOOLEAN, INT64), BOOLEAN)]


def _comparable(a: Value, b: Value) -> tuple[Column, Column]:
    if a.type == b.type:
        return a.col, b.col
    kind = "double" if FLOAT64 in (a.type, b.type) else "long"
    return a.col.cast(kind), b.col.cast(kind)


@define("equal", *COMPARED, *MIXED)
def equal(a: Value, b: Value) -> Column:
    """Equality; of two floats, to within the double epsilon."""
    x, y = _comparable(a, b)
    return F.abs(x - y) < EPSILON if a.type == b.type == FLOAT64 else x == y


@define("notEqual", *COMPARED, *MIXED)
def not_equal(a: Value, b: Value) -> Column:
    """Inequality; of two floats, by more than the double epsilon."""
    x, y = _comparable(a, b)
    return F.abs(x - y) > EPSILON if a.type == b.type == FLOAT64 else x != y


@define("approxEqual", ((FLOAT64, FLOAT64), BOOLEAN))
def approx_equal(a: Value, b: Value) -> Column:
    """Equality to within the double epsilon."""
    return F.abs(a.col - b.col) < EPSILON


ORDERED = [((t, t), BOOLEAN) for t in (INT64, TIME64NS, FLOAT64, STRING)] + [((INT64, FLOAT64), BOOLEAN), ((FLOAT64, INT64), BOOLEAN)]


@define("greaterThan", *ORDERED)
def greater_than(a: Value, b: Value) -> Column:
    """a > b; strings compare by bytes."""
    x, y = _comparable(a, b)
    return x > y


@define("greaterThanEqual", *ORDERED)
def greater_than_equal(a: Value, b: Value) -> Column:
    """a >= b."""
    x, y = _comparable(a, b)
    return x >= y


@define("lessThan", *ORDERED)
def less_than(a: Value, b: Value) -> Column:
    """a < b."""
    x, y = _comparable(a, b)
    return x < y


@define("lessThanEqual", *ORDERED)
def less_than_equal(a: Value, b: Value) -> Column:
    """a <= b."""
    x, y = _comparable(a, b)
    return x <= y


@define("bin", ((INT64, INT64), INT64), ((TIME64NS, INT64), TIME64NS), ((TIME64NS, TIME64NS), TIME64NS), ((FLOAT64, INT64), INT64), ((INT64, TIME64NS), INT64))
def bin_(v: Value, size: Value) -> Column:
    """The start of v's bucket: v - v % size."""
    x = v.col.cast("long")
    return x - x % size.col


@define("time_to_int64", ((TIME64NS,), INT64))
def time_to_int64(v: Value) -> Column:
    """Nanoseconds since the epoch."""
    return v.col


@define("int64_to_time", ((INT64,), TIME64NS))
def int64_to_time(v: Value) -> Column:
    """A time from nanoseconds since the epoch."""
    return v.col


@define("select", *[((BOOLEAN, t, t), t) for t in (STRING, INT64, FLOAT64, BOOLEAN, TIME64NS)])
def select(s: Value, a: Value, b: Value) -> Column:
    """a where s is true, else b."""
    return F.when(s.col, a.col).otherwise(b.col)

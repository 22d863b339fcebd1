"""Typed values over Spark columns, and the registry of functions that take them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOLEAN, INT64, FLOAT64, STRING, TIME64NS, UINT128 = "BOOLEAN", "INT64", "FLOAT64", "STRING", "TIME64NS", "UINT128"
TYPES = (BOOLEAN, INT64, UINT128, FLOAT64, STRING, TIME64NS)
UINT128_TYPE = T.StructType([T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])
SPARK_TYPES = {BOOLEAN: T.BooleanType(), INT64: T.LongType(), FLOAT64: T.DoubleType(), STRING: T.StringType(), TIME64NS: T.LongType(), UINT128: UINT128_TYPE}
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


class CompileError(ValueError):
    """A query that can't be built: unknown names, wrong types, wrong shapes."""


def zero(kind: str) -> Column:
    """The value that stands for a missing one: outer joins and failed lookups fill with it."""
    if kind == UINT128:
        return F.struct(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))
    return F.lit({BOOLEAN: False, INT64: 0, FLOAT64: 0.0, STRING: "", TIME64NS: 0}[kind]).cast(SPARK_TYPES[kind])


def type_of(field_: T.StructField) -> str:
    """The engine's type of a Spark column. A long is a time if its metadata say so or if it is called time_."""
    kind = field_.dataType
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return TIME64NS
    if isinstance(kind, T.IntegralType):
        return TIME64NS if field_.name == "time_" or field_.metadata.get("type") == TIME64NS else INT64
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return FLOAT64
    if isinstance(kind, T.StructType) and kind.fieldNames() == ["high", "low"]:
        return UINT128
    return STRING


def normalised(name: str, field_: T.StructField) -> Column:
    """A source column in the engine's representation: longs, doubles, strings, times as nanoseconds since the epoch."""
    kind, col = type_of(field_), F.col(f"`{name}`")
    if isinstance(field_.dataType, T.TimestampNTZType):
        return (F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{name}`)") * 1000).alias(name, metadata={"type": TIME64NS})
    if isinstance(field_.dataType, T.TimestampType):
        return (F.unix_micros(col) * 1000).alias(name, metadata={"type": TIME64NS})
    if field_.dataType == SPARK_TYPES[kind]:
        return col
    return (F.to_json(col) if kind == STRING and isinstance(field_.dataType, (T.ArrayType, T.MapType, T.StructType)) else col.cast(SPARK_TYPES[kind])).alias(name)


@dataclass(frozen=True, eq=False)
class Value:
    """A typed expression: a Spark column, its type, its constant if it is one, and its display (semantic) type."""

    col: Column
    type: str
    const: object = None
    semantic: str = ""
    owner: object = field(default=None, repr=False)

    def named(self, name: str) -> Column:
        meta = ({"type": TIME64NS} if self.type == TIME64NS else {}) | ({"semantic": self.semantic} if self.semantic else {})
        return self.col.alias(name, metadata=meta) if meta else self.col.alias(name)

    def _call(self, name: str, *args: object) -> Value:
        return call(name, *args)

    def __add__(self, o): return call("add", self, o)  # noqa: E704
    def __radd__(self, o): return call("add", o, self)  # noqa: E704
    def __sub__(self, o): return call("subtract", self, o)  # noqa: E704
    def __rsub__(self, o): return call("subtract", o, self)  # noqa: E704
    def __mul__(self, o): return call("multiply", self, o)  # noqa: E704
    def __rmul__(self, o): return call("multiply", o, self)  # noqa: E704
    def __truediv__(self, o): return call("divide", self, o)  # noqa: E704
    def __rtruediv__(self, o): return call("divide", o, self)  # noqa: E704
    def __mod__(self, o): return call("modulo", self, o)  # noqa: E704
    def __rmod__(self, o): return call("modulo", o, self)  # noqa: E704
    def __eq__(self, o): return call("equal", self, o)  # noqa: E704
    def __ne__(self, o): return call("notEqual", self, o)  # noqa: E704
    def __gt__(self, o): return call("greaterThan", self, o)  # noqa: E704
    def __ge__(self, o): return call("greaterThanEqual", self, o)  # noqa: E704
    def __lt__(self, o): return call("lessThan", self, o)  # noqa: E704
    def __le__(self, o): return call("lessThanEqual", self, o)  # noqa: E704
    def __and__(self, o): return call("logicalAnd", self, o)  # noqa: E704
    def __rand__(self, o): return call("logicalAnd", o, self)  # noqa: E704
    def __or__(self, o): return call("logicalOr", self, o)  # noqa: E704
    def __ror__(self, o): return call("logicalOr", o, self)  # noqa: E704
    def __invert__(self): return call("invert" if self.type == INT64 else "logicalNot", self)  # noqa: E704
    def __neg__(self): return call("negate", self)  # noqa: E704
    __hash__ = object.__hash__

    def __bool__(self):
        raise CompileError("a column has no truth value; combine conditions with & | ~, or with and/or/not in a script")


def lift(x: object) -> Value:
    """A Python constant as a value."""
    if isinstance(x, Value):
        return x
    if isinstance(x, bool):
        return Value(F.lit(x), BOOLEAN, x)
    if isinstance(x, int):
        return Value(F.lit(x).cast("long"), INT64, x)
    if isinstance(x, float):
        return Value(F.lit(x), FLOAT64, x)
    if isinstance(x, str):
        return Value(F.lit(x), STRING, x)
    raise CompileError(f"{x!r} isn't a value")


@dataclass(frozen=True)
class Overload:
    args: tuple[str, ...]
    returns: str


@dataclass(frozen=True)
class Function:
    name: str
    overloads: tuple[Overload, ...]
    build: Callable[..., Column]
    aggregate: bool = False
    variadic: bool = False
    doc: str = ""
    #: For aggregates in two steps: merges the texts that ``build`` gave for parts of a group.
    merge: Callable[[Column], Column] | None = None

    def resolve(self, types: Sequence[str]) -> Overload:
        if self.variadic:
            return self.overloads[0]
        for o in self.overloads:
            if o.args == tuple(types):
                return o
        # An integer goes where a float or a time is asked for.
        widen = {(INT64, FLOAT64), (INT64, TIME64NS), (TIME64NS, INT64), (BOOLEAN, INT64)}
        best = None
        for o in self.overloads:
            if len(o.args) == len(types) and all(a == b or (b, a) in widen for a, b in zip(o.args, types)):
                cost = sum(a != b for a, b in zip(o.args, types))
                if best is None or cost < best[0]:
                    best = (cost, o)
        if best is None:
            raise CompileError(f"{self.name} isn't defined for ({', '.join(types)})")
        return best[1]

    def __call__(self, *args: object) -> Value:
        values = [lift(a) for a in args]
        chosen = self.resolve([v.type for v in values])
        cast = values if self.variadic else [v if v.type == t or {v.type, t} <= {INT64, TIME64NS} else replace(v, col=v.col.cast(SPARK_TYPES[t]), type=t) for v, t in zip(values, chosen.args)]
        return Value(self.build(*cast), chosen.returns, owner=next((v.owner for v in values if v.owner is not None), None))


REGISTRY: dict[str, Function] = {}


def call(name: str, *args: object) -> Value:
    if name not in REGISTRY:
        raise CompileError(f"there is no function {name}")
    return REGISTRY[name](*args)


def define(name: str, *overloads: tuple[Sequence[str], str], aggregate: bool = False, variadic: bool = False, merge: Callable[[Column], Column] | None = None):
    """Registers a builder: it takes values and gives a column."""

    def add(build: Callable[..., Column]) -> Callable[..., Column]:
        REGISTRY[name] = Function(name, tuple(Overload(tuple(a), r) for a, r in overloads), build, aggregate, variadic, (build.__doc__ or "").strip(), merge)
        return build

    return add


def constant(value: Value, what: str) -> object:
    if value.const is None:
        raise CompileError(f"{what} must be a constant")
    return value.const

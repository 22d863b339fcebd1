"""Frames: immutable, typed handles on Spark DataFrames with a pandas-like interface."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import ranked_quantiles
from ..functions.core import BOOLEAN, REGISTRY, TIME64NS, CompileError, Function, Value, lift, zero
from ..plans.timeparse import parse_duration

PART_ROWS = 50_000


def _names(columns: str | Sequence[str], what: str) -> list[str]:
    if isinstance(columns, str):
        return [columns]
    if not isinstance(columns, (list, tuple)) or not all(isinstance(c, str) for c in columns):
        raise CompileError(f"{what} must be a column name or a list of names")
    return list(columns)


class Context:
    """``frame.ctx[...]``: attributes of entities, looked up from the columns that the frame has."""

    def __init__(self, frame: Frame):
        self._frame = frame

    def __getitem__(self, name: str) -> Value:
        return self._frame._attribute(name)

    def __getattr__(self, name: str) -> Value:
        return self._frame._attribute(name)


class Frame:
    """A table of typed columns. Assignments replace the handle's plan; other methods return a new handle."""

    def __init__(self, df: DataFrame, types: dict[str, str], session=None, group: tuple[str, ...] = (), streaming: bool = False, blocking: bool = False, window: tuple | None = None):
        put = object.__setattr__
        for name, value in (("_df", df), ("_types", types), ("_session", session), ("_group", group), ("_streaming", streaming), ("_blocking", blocking), ("_window", window)):
            put(self, name, value)

    def _with(self, df: DataFrame, types: dict[str, str], **changes) -> Frame:
        return Frame(df, types, self._session, changes.get("group", ()), changes.get("streaming", self._streaming), self._blocking or changes.get("blocking", False), changes.get("window"))

    # --- columns --------------------------------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return list(self._types)

    @property
    def types(self) -> dict[str, str]:
        return dict(self._types)

    def spark(self) -> DataFrame:
        """The Spark DataFrame."""
        return self._df if self._df.columns == list(self._types) else self._df.select(*[F.col(f"`{c}`") for c in self._types])

    def _column(self, name: str) -> Value:
        if name not in self._types:
            raise CompileError(f"there is no column {name!r}; columns are {self.columns}")
        return Value(F.col(f"`{name}`"), self._types[name], owner=self)

    def __getitem__(self, key):
        if isinstance(key, str):
            return self._column(key)
        if isinstance(key, (list, tuple)):
            return self.keep(list(key))
        return self.filter(key)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        if name == "ctx":
            return Context(self)
        return self._column(name)

    def __setitem__(self, name: str, value: object) -> None:
        new = self.assign(name, value)
        object.__setattr__(self, "_df", new._df)
        object.__setattr__(self, "_types", new._types)

    def __setattr__(self, name: str, value: object) -> None:
        self[name] = value

    def assign(self, name: str, value: object) -> Frame:
        """With a column added or replaced."""
        v = lift(value)
        return self._with(self._df.withColumn(name, v.named(name)), self._types | {name: v.type})

    def lookup(self, key: Value, table: DataFrame, name: str, kind: str, at: Value | None = None, field: str | None = None) -> Value:
        """A value from a table of unique keys (k, v), or of keys with disjoint times (k, v, start, stop); zero where there is none.

        With a ``field``, v is a struct that has it: all fields of one key come with one join. The joined column is hidden:
        the handle's plan carries it, but it isn't among its columns.
        """
        hidden = f"__{name}_{abs(hash((key.col._jc.toString(), at is not None and at.col._jc.toString()))) % 10**9}"
        if hidden not in self._df.columns:
            side = table.select(*[F.col(c).alias(f"{hidden}_{c}") for c in table.columns])
            condition = key.col == F.col(f"{hidden}_k")
            if at is not None:
                condition = condition & (F.col(f"{hidden}_start") <= at.col) & (at.col < F.col(f"{hidden}_stop"))
            value = F.col(f"{hidden}_v")
            found = self._df.join(side, condition, "left").withColumn(hidden, value if field else F.coalesce(value, zero(kind)))
            object.__setattr__(self, "_df", found.drop(*side.columns))
        return Value(F.coalesce(F.col(hidden)[field], zero(kind)) if field else F.col(hidden), kind, owner=self)

    def keep(self, columns: list[str]) -> Frame:
        """These columns, in this order."""
        if len(set(columns)) < len(columns):
            raise CompileError(f"columns are kept twice: {columns}")
        return self._with(self._df.select(*[self._column(c).col for c in columns]), {c: self._types[c] for c in columns})

    def drop(self, columns: str | list[str]) -> Frame:
        """Without these columns."""
        gone = _names(columns, "drop's argument")
        for c in gone:
            self._column(c)
        return self._with(self._df.drop(*gone), {c: t for c, t in self._types.items() if c not in gone})

    def map(self, *_, **__):
        raise CompileError("map isn't a method; assign to a column: df.new = expression")

    # --- rows -----------------------------------------------------------------------------------------------------

    def filter(self, condition: object) -> Frame:
        """The rows for which a condition is true."""
        v = lift(condition)
        if v.type != BOOLEAN:
            raise CompileError(f"a filter needs a BOOLEAN, not {v.type}")
        return self._with(self._df if v.const is True else self._df.where(v.col), self._types)

    def head(self, n: int = 5) -> Frame:
        """Some n rows; which ones is open."""
        if isinstance(n, Value):
            n = n.const
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise CompileError("head needs a number of rows")
        return self._with(self._df.limit(n), self._types, blocking=True)

    # --- joins ----------------------------------------------------------------------------------------------------

    def merge(self, right: Frame, how: str = "inner", left_on: str | list[str] = (), right_on: str | list[str] = (), suffixes: Sequence[str] = ("_x", "_y"), null_fill: str | None = None) -> Frame:
        """An equi-join: all left columns, then all right ones; equal names get the suffixes; a missing side is filled with zero values."""
        if how not in ("inner", "left", "right", "outer"):
            raise CompileError(f"there is no {how} join; use inner, left, right or outer")
        on, by = _names(left_on, "left_on"), _names(right_on, "right_on")
        if not on or len(on) != len(by):
            raise CompileError("left_on and right_on must name as many columns")
        for a, b in zip(on, by):
            x, y = self._column(a).type, right._column(b).type
            if x != y:
                raise CompileError(f"{a} is {x} but {b} is {y}")
        names: dict[str, tuple[str, str, str]] = {}
        both = set(self._types) & set(right._types)
        for side, frame, suffix in (("l", self, suffixes[0]), ("r", right, suffixes[1])):
            for c, t in frame._types.items():
                name = c + suffix if c in both else c
                if name in names:
                    raise CompileError(f"{name} comes twice out of the join; choose other suffixes")
                names[name] = (side, c, t)
        left = self._df.select(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(self._types)], *([F.lit(True).alias("l_")] if how in ("right", "outer") else []))
        other = right._df.select(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(right._types)], *([F.lit(True).alias("r_")] if how in ("left", "outer") else []))
        at = {("l", c): f"l{i}" for i, c in enumerate(self._types)} | {("r", c): f"r{i}" for i, c in enumerate(right._types)}
        condition = None
        for a, b in zip(on, by):
            equal = F.col(at["l", a]) == F.col(at["r", b])
            condition = equal if condition is None else condition & equal
        joined = left.join(other, condition, how)
        fill = (null_fill or (self._session.null_fill if self._session else "zero")) == "zero"
        out = []
        for name, (side, c, t) in names.items():
            col = F.col(at[side, c])
            if fill and (how == "outer" or how == "left" and side == "r" or how == "right" and side == "l"):
                col = F.when(F.col(f"{side}_").isNull(), zero(t)).otherwise(col)
            out.append(Value(col, t).named(name))
        return self._with(joined.select(*out), {n: t for n, (_, _, t) in names.items()}, blocking=True, streaming=self._streaming or right._streaming)

    # --- aggregation ----------------------------------------------------------------------------------------------

    def groupby(self, by: str | list[str]) -> Frame:
        """Grouped by columns; an aggregation must follow."""
        keys = _names(by, "groupby's argument")
        for c in keys:
            self._column(c)
        return self._with(self._df, self._types, group=tuple(keys), window=self._window)

    def agg(self, *args, **outputs) -> Frame:
        """Aggregates: out=(column, ..., function). Without outputs the distinct groups."""
        if args:
            raise CompileError("agg takes only named outputs: out=('column', function)")
        keys = list(self._group)
        if not outputs and not keys:
            raise CompileError("agg needs outputs or a groupby")
        aggs, types, drawn, stepped, ranked = [], {c: self._types[c] for c in keys}, False, {}, {}
        for name, spec in outputs.items():
            if not isinstance(spec, tuple) or len(spec) < 2:
                raise CompileError(f"{name} must be a tuple of columns and a function")
            *inputs, function = spec
            if isinstance(function, str):
                function = REGISTRY.get(function)
            if not isinstance(function, Function) or not function.aggregate:
                raise CompileError(f"{name}: the last part must be an aggregate function")
            if not all(isinstance(c, (str, Value)) for c in inputs):
                raise CompileError(f"{name}: all but the last part must be columns")
            values = [self._column(c) if isinstance(c, str) else c for c in inputs]
            v = function(*values)
            if function.name == "quantiles" and not self._df.isStreaming:
                ranked[name] = values[0].col
            elif function.merge:
                stepped[name] = (v.col, function.merge)
            else:
                aggs.append(v.named(name))
            types[name] = v.type
            drawn = drawn or function.name == "sample"
        by = [F.col(f"`{c}`") for c in keys]
        if self._window:
            on, size = self._window
            start = (F.col(f"`{on}`") - F.col(f"`{on}`") % size).alias(on, metadata={"type": TIME64NS})
            by, types = [start, *by], {on: TIME64NS} | types
        rows = self._df.withColumn("__draw", F.rand()) if drawn else self._df
        df = rows.groupBy(*by).agg(*aggs) if aggs and by else rows.agg(*(aggs or [F.count(F.lit(1)).alias("__n")])) if aggs or not by else rows.select(*by).distinct()
        for name, (part, merge) in stepped.items():
            df = self._stepped(df, rows, by, name, part, merge)
        for name, value in ranked.items():
            df = self._ranked(df, rows, by, name, value)
        if stepped or ranked:
            df = df.select(*[F.col(f"`{c}`") for c in types])
        return self._with(df, types, blocking=True)

    @staticmethod
    def _stepped(df: DataFrame, rows: DataFrame, by: list, name: str, part, merge) -> DataFrame:
        """With an aggregate in two steps: of parts of each group, by a hash of the row, then of the parts' results.

        A group has one part for about ``PART_ROWS`` of its rows, so no part grows with the group.
        """
        grouped = df.select("*", *[F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(df.columns[: len(by)])] or [F.lit(0).alias("__g0")])
        by = by or [F.lit(0)]
        keys = [F.col(f"__g{i}") for i in range(len(by))]
        marked = rows.select(*[c.alias(f"__k{i}") for i, c in enumerate(by)], *[F.col(f"`{c}`") for c in rows.columns])
        names = [F.col(f"__k{i}") for i in range(len(by))]
        sizes = marked.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("__parts")).select(*[c.alias(f"__s{i}") for i, c in enumerate(names)], "__parts")
        same = lambda left, right: reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in zip(left, right)])
        sided = marked.join(sizes, same(names, [F.col(f"__s{i}") for i in range(len(by))]))
        parts = sided.groupBy(*names, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col("__parts")).alias("__part")).agg(part.alias("__p"))
        merged = parts.groupBy(*names).agg(merge(F.col("__p")).alias("__merged"))
        return grouped.join(merged, same(keys, names), "left").select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col("__merged").alias(name))

    @staticmethod
    def _ranked(df: DataFrame, rows: DataFrame, by: list, name: str, value: Column) -> DataFrame:
        """With the exact quantiles of each group: its distinct values are counted, sorted and summed up in order.

        Sorting spills to disk, so no group has to fit in memory; but the distinct values of one group are sorted by one task.
        """
        grouped = df.select("*", *[F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(df.columns[: len(by)])] or [F.lit(0).alias("__g0")])
        by = by or [F.lit(0)]
        names = [F.col(f"__k{i}") for i in range(len(by))]
        counted = rows.select(*[c.alias(f"__k{i}") for i, c in enumerate(by)], value.cast("double").alias("__v")).where("__v IS NOT NULL").groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__n"))
        group = Window.partitionBy(*names)
        upto = F.sum("__n").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = counted.select(*names, "__v", upto.alias("__upto"), F.sum("__n").over(group).alias("__of"))
        found = placed.groupBy(*names).agg(ranked_quantiles(F.col("__v"), F.col("__upto"), F.col("__of")).alias("__found"))
        same = reduce(lambda x, y: x & y, [F.col(f"__g{i}").eqNullSafe(c) for i, c in enumerate(names)])
        return grouped.join(found, same, "left").select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.coalesce("__found", F.lit("{}")).alias(name))

    # --- sets -----------------------------------------------------------------------------------------------------

    def append(self, others: Frame | list[Frame], ordered: bool = False) -> Frame:
        """All rows of frames with the same columns; optionally in order of time_, ties in order of the frames."""
        frames = [self, *(others if isinstance(others, (list, tuple)) else [others])]
        for f in frames[1:]:
            if f._types.keys() != self._types.keys() or any(f._types[c] != t for c, t in self._types.items()):
                raise CompileError(f"appended frames must have the same columns and types: {self._types} and {f._types}")
        select = [F.col(f"`{c}`") for c in self._types]
        sort = ordered and "time_" in self._types
        parts = [f._df.select(*select, *([F.lit(i).alias("__part")] if sort else [])) for i, f in enumerate(frames)]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        if sort:
            df = df.orderBy("time_", "__part").drop("__part")
        return self._with(df, self._types, blocking=True)

    # --- streams --------------------------------------------------------------------------------------------------

    def stream(self) -> Frame:
        """The same query over a growing table; only operators that don't wait for the end may come before it."""
        if self._blocking:
            raise CompileError("a stream can't have an aggregation, join, append or head before it")
        return self._with(self._df, self._types, streaming=True)

    def rolling(self, window: str | int, on: str = "time_") -> Frame:
        """Tumbling windows of time: an aggregation that follows is per window (and group)."""
        size = parse_duration(window) if isinstance(window, str) else window
        if size <= 0:
            raise CompileError("a window must be longer than nothing")
        if on != "time_" or self._types.get(on) != TIME64NS:
            raise CompileError("windows go over time_")
        return self._with(self._df, self._types, group=self._group, window=(on, size))

    # --- attributes -----------------------------------------------------------------------------------------------

    def _attribute(self, name: str) -> Value:
        if self._session is None or self._session.metadata is None:
            raise CompileError("this session has no metadata tables")
        return self._session.metadata.attribute(self, name)

    # --- extensions beyond the script language ----------------------------------------------------------------------

    def sort(self, by: str | list[str], ascending: bool = True) -> Frame:
        """Extension: in order of columns."""
        keys = [self._column(c).col for c in _names(by, "sort's argument")]
        return self._with(self._df.orderBy(*[k.asc() if ascending else k.desc() for k in keys]), self._types, blocking=True)

    def top(self, n: int, by: str | list[str]) -> Frame:
        """Extension: the n rows with the largest values."""
        ordered = self.sort(by, ascending=False)
        return self._with(ordered._df.limit(n), self._types, blocking=True)

    def spread(self) -> Frame:
        """Extension: the same rows, dealt evenly to twice as many tasks as there are cores, for costly functions over a small file.

        A file's row group is never split by a scan, and one holds millions of narrow rows.
        """
        return self._with(self._df.repartition(2 * self._df.sparkSession.sparkContext.defaultParallelism), self._types)

    def distinct(self) -> Frame:
        """Extension: without repeated rows."""
        return self._with(self.spark().distinct(), self._types, blocking=True)

    def semi(self, right: Frame, left_on: str | list[str], right_on: str | list[str], anti: bool = False) -> Frame:
        """Extension: the rows that have (or, anti, don't have) a partner."""
        on, by = _names(left_on, "left_on"), _names(right_on, "right_on")
        other = right._df.select(*[F.col(f"`{c}`").alias(f"__r{i}") for i, c in enumerate(by)]).distinct()
        condition = None
        for i, c in enumerate(on):
            equal = F.col(f"`{c}`") == F.col(f"__r{i}")
            condition = equal if condition is None else condition & equal
        return self._with(self._df.join(other, condition, "left_anti" if anti else "left_semi"), self._types, blocking=True)


def frame_of(df: DataFrame, session=None) -> Frame:
    """A frame over any Spark DataFrame, its columns in the engine's types."""
    from ..functions.core import normalised, type_of

    types = {f.name: type_of(f) for f in df.schema}
    return Frame(df.select(*[normalised(f.name, f) for f in df.schema]), types, session)



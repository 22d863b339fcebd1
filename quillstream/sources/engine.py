"""Engine sessions: a catalog of tables, a clock, named outputs and options."""

from __future__ import annotations

import time
from collections.abc import Callable, MutableMapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import REGISTRY, CompileError, normalised, type_of
from ..operators.frame import Frame, frame_of
from ..plans.timeparse import parse_time

TIME = "time_"


class Tables(MutableMapping):
    """Tables by name. A stored one is opened, and its schema read, when it is first used."""

    def __init__(self):
        self._held: dict[str, DataFrame | Callable[[], DataFrame]] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if callable(self._held[name]):
            self._held[name] = self._held[name]()
        return self._held[name]

    def __setitem__(self, name: str, table: DataFrame | Callable[[], DataFrame]) -> None:
        self._held[name] = table

    def __contains__(self, name: object) -> bool:
        return name in self._held

    def __delitem__(self, name: str) -> None:
        del self._held[name]

    def __iter__(self):
        return iter(self._held)

    def __len__(self) -> int:
        return len(self._held)


class Engine:
    """Runs queries over named tables.

    Options: ``null_fill`` ("zero" or "null") for outer joins; ``max_rows`` caps every displayed table (off by default);
    ``restricted`` maps a table to columns that only show as "REDACTED" or without personal data ("pii").
    """

    def __init__(self, spark: SparkSession, now: int | None = None, null_fill: str = "zero", max_rows: int | None = None, restricted: dict[str, dict[str, str]] | None = None):
        self.spark, self.null_fill, self.max_rows = spark, null_fill, max_rows
        self.now = time.time_ns() if now is None else now
        self.restricted = restricted or {}
        self.tables = Tables()
        self.paths: dict[str, str] = {}
        self.descriptions: dict[str, str] = {}
        self.outputs: dict[str, Frame] = {}
        self.plans: dict[str, str] = {}
        self.exports: list[tuple[Frame, object]] = []
        self.metadata = None
        self.history: list[tuple] = []

    # --- catalog --------------------------------------------------------------------------------------------------

    def register(self, name: str, source: DataFrame | str, time_column: str | None = None, description: str = "") -> None:
        """Names a table: a DataFrame, or a Parquet path. ``time_column`` becomes time_."""
        if isinstance(source, str):
            self.paths[name] = source

        def opened() -> DataFrame:
            df = self.spark.read.parquet(source) if isinstance(source, str) else source
            return df.withColumnRenamed(time_column, TIME) if time_column and time_column != TIME else df

        self.tables[name] = opened
        self.descriptions[name] = description

    def register_folder(self, folder: str, time_columns: dict[str, str] | None = None) -> None:
        """Every Parquet table of a folder, by its file's name."""
        for path in sorted(Path(folder).glob("*.parquet")):
            self.register(path.stem, str(path), (time_columns or {}).get(path.stem))

    def table(self, name: str, select: list[str] | None = None, start_time: int | str | None = None, end_time: int | str | None = None) -> Frame:
        """A scan of chosen columns between two times, both inclusive. Bounds apply to the stored column, so they reach the scan."""
        if name not in self.tables:
            raise CompileError(f"there is no table {name!r}")
        df = self.tables[name]
        fields = {f.name: f for f in df.schema}
        for bound, compare in ((start_time, "__ge__"), (end_time, "__le__")):
            if bound is None:
                continue
            if TIME not in fields:
                raise CompileError(f"{name} has no {TIME} column for time bounds")
            ns = parse_time(bound, self.now)
            if isinstance(fields[TIME].dataType, T.LongType):
                df = df.where(getattr(F.col(TIME), compare)(F.lit(ns)))
            else:  # stored in microseconds: the first one not before start, the last one not after end
                us = -(-ns // 1000) if compare == "__ge__" else ns // 1000
                kind = "timestamp_ntz" if isinstance(fields[TIME].dataType, T.TimestampNTZType) else "timestamp"
                stamp = F.timestamp_micros(F.lit(us))
                if kind == "timestamp_ntz":
                    stamp = F.expr(f"timestampadd(MICROSECOND, {us}L, timestamp_ntz'1970-01-01 00:00:00')")
                df = df.where(getattr(F.col(TIME), compare)(stamp))
        if select:
            for c in select:
                if c not in fields:
                    raise CompileError(f"{name} has no column {c!r}")
            df = df.select(*[F.col(f"`{c}`") for c in select])
        frame = frame_of(df, self)
        for column, how in self.restricted.get(name, {}).items():
            if column in frame._types:
                frame = frame.assign(column, REGISTRY["redact_pii_best_effort"](frame[column]) if how == "pii" else "REDACTED")
        return frame

    def empty(self, types: dict[str, str]) -> Frame:
        """No rows of these columns."""
        from ..functions.core import SPARK_TYPES

        return Frame(self.spark.createDataFrame([], T.StructType([T.StructField(c, SPARK_TYPES[t]) for c, t in types.items()])), dict(types), self)

    def frame(self, df: DataFrame) -> Frame:
        return frame_of(df, self)

    def stream(self, name: str) -> Frame:
        """A table's path as an unbounded source: files that come later are read too."""
        if name not in self.paths:
            raise CompileError(f"{name} isn't stored under a path")
        path, reader = self.paths[name], self.spark.readStream.schema(self.spark.read.parquet(self.paths[name]).schema)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
            folder, _, file = path.rpartition("/")
            path, reader = folder, reader.option("pathGlobFilter", file)
        df = reader.parquet(path)
        schema = {f.name: f for f in self.tables[name].schema}
        stored = self.spark.read.parquet(self.paths[name]).schema.names
        for old, new in zip(stored, schema):
            df = df.withColumnRenamed(old, new)
        return Frame(df.select(*[normalised(f.name, f) for f in df.schema]), {f.name: type_of(f) for f in df.schema}, self, streaming=True)

    # --- outputs --------------------------------------------------------------------------------------------------

    def display(self, frame: Frame, name: str = "output", cols: list[str] | None = None) -> Frame:
        """Names an output; a name that is taken gets a number."""
        if not isinstance(frame, Frame):
            raise CompileError("only frames can be displayed")
        if cols:
            frame = frame.keep(list(cols))
        if self.max_rows is not None and not frame._streaming:
            frame = frame.head(self.max_rows)
        unique, i = name, 0
        while unique in self.outputs:
            i += 1
            unique = f"{name}_{i}"
        self.outputs[unique] = frame
        return frame

    def debug(self, frame: Frame, name: str = "output", cols: list[str] | None = None) -> Frame:
        return self.display(frame, f"_{name}", cols)

    def export(self, frame: Frame, data: object) -> None:
        """Names a frame for export; ``sources.otel`` turns it into records."""
        self.exports.append((frame, data))

    def run(self, script: str, functions: list[tuple] | None = None) -> dict[str, DataFrame]:
        """Runs a script and gives its named outputs."""
        from ..plans.script import run_script

        begun = time.time_ns()
        error = ""
        self.outputs, self.exports = {}, []
        try:
            run_script(self, script, functions)
        except CompileError as e:
            error = str(e)
            raise
        finally:
            self.history.append((len(self.history), begun, error, 0, time.time_ns() - begun))
        if not self.outputs and not self.exports:
            raise CompileError("the script displays nothing")
        return {name: f.spark() for name, f in self.outputs.items()}



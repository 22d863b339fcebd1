"""Table functions: what the session and the registry know about themselves, as frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions.core import BOOLEAN, INT64, REGISTRY, STRING, TIME64NS, CompileError, type_of
from ..operators.frame import Frame
from .engine import Engine

KINDS = {STRING: "string", INT64: "bigint", TIME64NS: "bigint", BOOLEAN: "boolean"}


def _frame(engine: Engine, types: dict[str, str], rows: list[tuple]) -> Frame:
    df = engine.spark.createDataFrame(rows, ", ".join(f"`{c}` {KINDS[t]}" for c, t in types.items()))
    return Frame(df, types, engine)


def get_tables(engine: Engine) -> Frame:
    return _frame(engine, {"table_name": STRING, "table_desc": STRING}, [(n, engine.descriptions.get(n, "")) for n in sorted(engine.tables)])


def get_schemas(engine: Engine) -> Frame:
    rows = [(n, f.name, type_of(f), f.metadata.get("pattern", "GENERAL"), f.metadata.get("comment", "")) for n, df in sorted(engine.tables.items()) for f in df.schema]
    return _frame(engine, dict.fromkeys(("table_name", "column_name", "column_type", "pattern_type", "column_desc"), STRING), rows)


def _functions(engine: Engine, aggregate: bool) -> Frame:
    rows = [(f.name, o.returns, ", ".join(o.args)) for f in REGISTRY.values() if f.aggregate == aggregate for o in f.overloads]
    return _frame(engine, dict.fromkeys(("name", "return_type", "args"), STRING), rows)


def get_udf_list(engine: Engine) -> Frame:
    return _functions(engine, False)


def get_uda_list(engine: Engine) -> Frame:
    return _functions(engine, True)


def get_udtf_list(engine: Engine) -> Frame:
    return _frame(engine, dict.fromkeys(("name", "executor", "init_args", "output_relation"), STRING), [(n, "driver", "", (f.__doc__ or "").strip()) for n, f in TABLE_FUNCTIONS.items()])


AGENT = {"agent_id": STRING, "asid": INT64, "hostname": STRING, "ip_address": STRING, "agent_state": STRING, "create_time": TIME64NS, "last_heartbeat_ns": INT64, "kernel_headers_installed": BOOLEAN}


def _agents(engine: Engine, columns: dict[str, str]) -> Frame:
    if "agents" not in engine.tables:
        return engine.empty(columns)
    return engine.frame(engine.tables["agents"].select(*[F.col(c) for c in columns]))


def get_agent_status(engine: Engine, include_collectors: bool = True) -> Frame:
    """Rows of the registered table ``agents``."""
    return _agents(engine, AGENT)


def get_linux_headers_status(engine: Engine) -> Frame:
    return _agents(engine, {"asid": INT64, "kernel_headers_installed": BOOLEAN})


def get_profiler_sampling_period(engine: Engine) -> Frame:
    columns = {"asid": INT64, "profiler_sampling_period_ms": INT64}
    if "profiler" not in engine.tables:
        return engine.empty(columns)
    return engine.frame(engine.tables["profiler"].select(*columns))


def get_cron_script_history(engine: Engine) -> Frame:
    """The scripts that this session ran."""
    types = {"script_id": STRING, "timestamp": TIME64NS, "error_message": STRING, "execution_time_ns": INT64, "compilation_time_ns": INT64, "bytes_processed": INT64, "records_processed": INT64}
    return _frame(engine, types, [(str(i), begun, error, run, build, 0, 0) for i, begun, error, run, build in engine.history])


def debug_table_info(engine: Engine) -> Frame:
    """Files and bytes of the tables that are stored under a path."""
    rows = []
    for name, path in sorted(engine.paths.items()):
        hadoop = engine.spark._jvm.org.apache.hadoop.fs.Path(path)
        summary = hadoop.getFileSystem(engine.spark._jsc.hadoopConfiguration()).getContentSummary(hadoop)
        rows.append((name, int(summary.getFileCount()), int(summary.getLength())))
    return _frame(engine, {"name": STRING, "files": INT64, "bytes": INT64}, rows)


def version(engine: Engine) -> Frame:
    return _frame(engine, {"version": STRING}, [(engine.spark.version,)])


TABLE_FUNCTIONS: dict[str, Callable[..., Frame]] = {
    "GetTables": get_tables,
    "GetSchemas": get_schemas,
    "GetUDFList": get_udf_list,
    "GetUDAList": get_uda_list,
    "GetUDTFList": get_udtf_list,
    "GetAgentStatus": get_agent_status,
    "GetLinuxHeadersStatus": get_linux_headers_status,
    "GetProfilerSamplingPeriodMS": get_profiler_sampling_period,
    "GetCronScriptHistory": get_cron_script_history,
    "_DebugTableInfo": debug_table_info,
    "Version": version,
}


def table_function(engine: Engine, name: str, *args, **kwargs) -> Frame:
    if name not in TABLE_FUNCTIONS:
        raise CompileError(f"there is no table function {name}")
    return TABLE_FUNCTIONS[name](engine, *args, **kwargs)

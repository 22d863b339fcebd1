"""Library views over the usual telemetry tables, for scripts that import a module whose name ends in "views".

Tables: ``http_events`` (upid, remote_addr, req_path, resp_status, latency, body sizes, trace_role), ``process_stats`` (counters and
sizes by upid) and ``network_stats`` (counters by pod_id). Counters are read as last less first within a group; rates are per
nanosecond of the window, or of the time between the bounds.
"""

from __future__ import annotations

from functools import reduce

from ..functions.core import REGISTRY, CompileError, call
from ..operators.frame import Frame
from .timeparse import parse_time

SERVER = 2
PLACE = ("pod", "service", "namespace", "node")
DISK = {"actual_disk_read_throughput": "read_bytes", "actual_disk_write_throughput": "write_bytes", "total_disk_read_throughput": "rchar_bytes", "total_disk_write_throughput": "wchar_bytes"}
CPU = ("cpu_ktime_ns", "cpu_utime_ns")
NETWORK = ("rx_bytes", "tx_bytes", "rx_drops", "tx_drops", "rx_errors", "tx_errors")
LOCAL = r"127\.0\.0\.[0-9]+"


def _fn(name: str):
    return REGISTRY[name]


def _placed(df: Frame, names=PLACE) -> Frame:
    for name in names:
        df[name] = df.ctx[name]
    return df


def _span(engine, start_time, end_time) -> int:
    if start_time is None or end_time is None:
        raise CompileError("a summary of rates needs both times")
    return parse_time(end_time, engine.now) - parse_time(start_time, engine.now)


def _growth(df: Frame, keys: list[str], counters, **more) -> Frame:
    """By keys, how much each counter grew, and other aggregates."""
    ends = {f"{c}_{how}": (c, _fn(how)) for c in counters for how in ("max", "min")}
    df = df.groupby(keys).agg(**more, **ends)
    for c in counters:
        df[c] = df[f"{c}_max"] - df[f"{c}_min"]
    return df.drop(list(ends))


def http_events(engine, start_time=None, end_time=None, health_checks: bool = False, ready_checks: bool = False, unresolved: bool = False) -> Frame:
    """HTTP events and whether the response failed; checks and requests without a remote address only where asked for."""
    df = engine.table("http_events", None, start_time, end_time)
    df["failure"] = df["resp_status"] >= 400
    for wanted, column, value in ((health_checks, "req_path", "/healthz"), (ready_checks, "req_path", "/readyz"), (unresolved, "remote_addr", "-")):
        if not wanted:
            df = df[df[column] != value]
    return df


def _inbound(engine, start_time, end_time) -> Frame:
    df = http_events(engine, start_time, end_time)
    df = df[df["trace_role"] == SERVER]
    df["pod_id"] = df.ctx["pod_id"]
    return df


def _requests() -> dict:
    sums = {"latency_sum": "latency", "num_errors": "failure", "req_bytes": "req_body_size", "resp_bytes": "resp_body_size"}
    return {"latency_quantiles": ("latency", _fn("quantiles")), "num_requests": ("latency", _fn("count"))} | {out: (c, _fn("sum")) for out, c in sums.items()}


COUNTED = ["latency_quantiles", "latency_sum", "num_requests", "num_errors", "req_bytes", "resp_bytes"]


def inbound_http_summary(engine, start_time=None, end_time=None) -> Frame:
    """Requests to each pod by who asks."""
    df = _inbound(engine, start_time, end_time).groupby(["pod_id", "remote_addr"]).agg(**_requests(), time_=("time_", _fn("max")))
    df["requestor_ip"] = df["remote_addr"]
    asker = call("ip_to_pod_id", df["remote_addr"])
    df["requestor_id"] = asker
    df["requestor_pod"], df["requestor_service"] = call("pod_id_to_pod_name", df["requestor_id"]), call("pod_id_to_service_name", df["requestor_id"])
    return _placed(df)[["time_", "pod_id", *PLACE, "requestor_ip", "requestor_pod", "requestor_service", *COUNTED]]


def http_graph(engine, start_time=None, end_time=None) -> Frame:
    """Who asks whom: requests between pods, whichever side of them was traced.

    Latency percentiles of an edge are the means of its parts' percentiles.
    """
    df = http_events(engine, start_time, end_time)
    df["pod_id"] = df.ctx["pod_id"]
    df = df.groupby(["pod_id", "remote_addr", "trace_role"]).agg(**_requests(), time_=("time_", _fn("max")))
    own = _placed(df, ("pod", "service"))
    own["ip"] = call("pod_name_to_pod_ip", own["pod"])
    local = call("regex_match", LOCAL, own["remote_addr"])
    own["far_id"] = call("select", local, own["pod_id"], call("ip_to_pod_id", own["remote_addr"]))
    own["far_pod"] = call("pod_id_to_pod_name", own["far_id"])
    own["far_service"] = call("select", local, own["service"], call("service_id_to_service_name", call("ip_to_service_id", own["remote_addr"])))
    served = own["trace_role"] == SERVER
    sides = {"pod_id": "far_id", "pod": "far_pod", "ip": "remote_addr", "service": "far_service"}
    edges = [f"{role}_{what}" for what in sides for role in ("responder", "requestor")]
    for what, far in sides.items():
        own[f"responder_{what}"], own[f"requestor_{what}"] = call("select", served, own[what], own[far]), call("select", served, own[far], own[what])
    for p in ("p50", "p90", "p99"):
        own[f"latency_{p}"] = call("floor", call("pluck_float64", own["latency_quantiles"], p))
    sums = {c: (c, _fn("sum")) for c in COUNTED[1:]}
    df = own.groupby(edges).agg(latency_quantiles=("latency_quantiles", _fn("any")), **{f"latency_{p}": (f"latency_{p}", _fn("mean")) for p in ("p50", "p90", "p99")}, **sums, time_=("time_", _fn("max")))
    for role in ("responder", "requestor"):
        df[f"{role}_node"], df[f"{role}_namespace"] = call("pod_id_to_node_name", df[f"{role}_pod_id"]), call("pod_name_to_namespace", df[f"{role}_pod"])
    both = [f"{role}_{what}" for what in ("pod", "namespace", "node", "ip", "service") for role in ("responder", "requestor")]
    return df[["time_", *both, "latency_p50", "latency_p90", "latency_p99", *COUNTED]]


def inbound_http_throughput_timeseries(engine, start_time, end_time, window_ns: int) -> Frame:
    """Requests to each container, and how many failed, by window."""
    df = _inbound(engine, start_time, end_time)
    df["container"] = df.ctx["container"]
    df["time_"] = call("bin", df["time_"], window_ns)
    out = df.groupby(["time_", "container", "pod_id"]).agg(num_requests=("latency", _fn("count")), num_errors=("failure", _fn("sum")))
    return _placed(out)[["time_", "pod_id", *PLACE, "container", "num_requests", "num_errors"]]


def inbound_http_latency_timeseries(engine, start_time, end_time, window_ns: int) -> Frame:
    """Latency, failures and sizes of the requests to each pod, by window."""
    df = _inbound(engine, start_time, end_time)
    df["time_"] = call("bin", df["time_"], window_ns)
    return _placed(df.groupby(["time_", "pod_id"]).agg(**_requests()))[["time_", "pod_id", *PLACE, *COUNTED]]


def _processes(engine, start_time, end_time, window_ns: int | None) -> Frame:
    """By container, and by window if there is one: memory of its processes, and rates of what they did."""
    span = window_ns or _span(engine, start_time, end_time)
    df = engine.table("process_stats", None, start_time, end_time)
    if window_ns:
        df["time_"] = call("bin", df["time_"], window_ns)
    df["container"], df["pod_id"] = df.ctx["container"], df.ctx["pod_id"]
    time = ["time_"] if window_ns else []
    latest = {} if window_ns else {"time_": ("time_", _fn("max"))}
    one = _growth(df, ["upid", "container", "pod_id", *time], [*CPU, *DISK.values()], rss=("rss_bytes", _fn("mean")), vsize=("vsize_bytes", _fn("mean")), **latest)
    for out, counter in DISK.items():
        one[out] = one[counter] / span
    sums = {c: (c, _fn("sum")) for c in (*CPU, *DISK, "rss", "vsize")}
    df = one.groupby([*time, "pod_id", "container"]).agg(**sums, **latest)
    df["cpu_usage"] = reduce(lambda a, b: a + b, (df[c] for c in CPU)) / span
    return _placed(df)[["time_", "pod_id", "container", *PLACE, "cpu_usage", *DISK, "rss", "vsize"]]


def container_process_timeseries(engine, start_time, end_time, window_ns: int) -> Frame:
    """CPU, memory and disk use of each container, by window."""
    return _processes(engine, start_time, end_time, window_ns)


def container_process_summary(engine, start_time=None, end_time=None) -> Frame:
    """CPU, memory and disk use of each container between the times."""
    return _processes(engine, start_time, end_time, None)


def pod_resource_stats(engine, start_time=None, end_time=None) -> Frame:
    """The containers' use by pod, with the pod's start and status."""
    use = ["cpu_usage", "rss", "vsize", *DISK]
    df = _processes(engine, start_time, end_time, None).groupby(["pod_id", *PLACE]).agg(**{c: (c, _fn("sum")) for c in use}, time_=("time_", _fn("max")), container_count=("vsize", _fn("count")))
    df["pod_start_time"], df["pod_status"] = call("pod_name_to_start_time", df["pod"]), call("pod_name_to_status", df["pod"])
    return df[["time_", "pod_id", *PLACE, "container_count", "pod_start_time", "pod_status", *use]]


def _network(engine, start_time, end_time, window_ns: int | None) -> Frame:
    span = window_ns or _span(engine, start_time, end_time)
    df = engine.table("network_stats", None, start_time, end_time)
    if window_ns:
        df["time_"] = call("bin", df["time_"], window_ns)
    keys, latest = (["pod_id", "time_"], {}) if window_ns else (["pod_id"], {"time_": ("time_", _fn("max"))})
    df = _growth(df, keys, NETWORK, **latest)
    for c in NETWORK:
        df[f"{c}_per_ns"] = df[c] / span
    return _placed(df)[["time_", "pod_id", *PLACE, *[f"{c}_per_ns" for c in NETWORK]]]


def pod_network_timeseries(engine, start_time, end_time, window_ns: int) -> Frame:
    """Rates of bytes, drops and errors of each pod, by window."""
    return _network(engine, start_time, end_time, window_ns)


def pod_network_summary(engine, start_time=None, end_time=None) -> Frame:
    """Rates of bytes, drops and errors of each pod between the times."""
    return _network(engine, start_time, end_time, None)


VIEWS = (http_events, inbound_http_summary, http_graph, inbound_http_throughput_timeseries, inbound_http_latency_timeseries, container_process_timeseries, container_process_summary, pod_resource_stats, pod_network_timeseries, pod_network_summary)


def module(engine):
    from .script import Namespace

    return Namespace({f.__name__: lambda *a, f=f, **k: f(engine, *a, **k) for f in VIEWS})

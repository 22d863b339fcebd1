"""Entity metadata: dimension tables of processes, containers, pods, services and their owners, and the lookups over them."""

from __future__ import annotations

import json
import os
import re
import socket

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import BOOLEAN, INT64, REGISTRY, STRING, TIME64NS, UINT128, UINT128_TYPE, CompileError, Function, Overload, Value, define, lift

FOREVER = 2**63 - 1

#: Attributes with their other names, and the key columns that they can come from, in this order.
ATTRIBUTES = {
    "container_id": ([], ["upid"]),
    "service_id": ([], ["upid", "service_name", "pod_id", "pod_name"]),
    "pod_id": ([], ["upid", "pod_name"]),
    "deployment_id": ([], ["upid", "deployment_name", "pod_id", "pod_name", "replicaset_id", "replicaset_name"]),
    "replicaset_id": (["replica_set_id"], ["upid", "pod_id", "pod_name", "replicaset_name"]),
    "service_name": (["service"], ["upid", "service_id", "pod_id", "pod_name"]),
    "pod_name": (["pod"], ["upid", "pod_id"]),
    "deployment_name": (["deployment"], ["upid", "deployment_id", "pod_id", "pod_name", "replicaset_id", "replicaset_name"]),
    "namespace": ([], ["upid", "pod_id", "pod_name", "service_name"]),
    "replicaset_name": (["replica_set", "replicaset"], ["upid", "pod_id", "pod_name", "replicaset_id"]),
    "node_name": (["node"], ["upid", "pod_id"]),
    "hostname": (["host"], ["upid"]),
    "container_name": (["container"], ["upid"]),
    "cmdline": (["cmd"], ["upid"]),
    "asid": ([], ["upid"]),
    "pid": ([], ["upid"]),
}
ALIASES = {a: name for name, (others, _) in ATTRIBUTES.items() for a in (name, *others)}

SCHEMAS = {
    "process": "upid struct<high:bigint,low:bigint>, cmdline string, container_id string",
    "container": "container_id string, name string, pod_id string, state string, reason string, message string, start_time bigint, stop_time bigint",
    "pod": "pod_id string, name string, namespace string, node_name string, hostname string, pod_ip string, qos string, phase string, message string, reason string, ready boolean, labels string, owner_references string, start_time bigint, stop_time bigint",
    "pod_ip": "ip string, pod_id string, start_time bigint, stop_time bigint",
    "service": "service_id string, name string, namespace string, cluster_ip string, external_ips string, pod_ids array<string>",
    "replicaset": "replicaset_id string, name string, namespace string, deployment_id string, status string, owner_references string, start_time bigint, stop_time bigint",
    "deployment": "deployment_id string, name string, namespace string, status string, start_time bigint, stop_time bigint",
    "namespace": "namespace_id string, name string",
}

#: Per entity: its keys, and what can be looked up by them: property to column and type.
TIMES = {"start_time": ("start_time", TIME64NS), "stop_time": ("stop_time", TIME64NS)}
POD = {p: (p, STRING) for p in ("pod_id", "pod_name", "namespace", "node_name", "replicaset_id", "replicaset_name", "deployment_id", "deployment_name", "service_id", "service_name", "owner_references", "pod_labels", "pod_ip")} | {"status": ("pod_status", STRING)}
LOOKUPS = {
    "container": ({"container_id": "container_id", "container_name": "container_name"}, {"status": ("container_status", STRING), "container_id": ("container_id", STRING)} | TIMES),
    "pod": ({"pod_id": "pod_id", "pod_name": "pod_name"}, POD | TIMES),
    "service": ({"service_id": "service_id", "service_name": "service_name"}, {p: (p, STRING) for p in ("service_id", "service_name", "namespace", "cluster_ip", "external_ips")}),
    "replicaset": ({"replicaset_id": "replicaset_id", "replicaset_name": "replicaset_name"}, {p: (p, STRING) for p in ("replicaset_id", "replicaset_name", "namespace", "owner_references", "deployment_id", "deployment_name")} | {"status": ("replicaset_status", STRING)} | TIMES),
    "deployment": ({"deployment_id": "deployment_id", "deployment_name": "deployment_name"}, {p: (p, STRING) for p in ("deployment_id", "deployment_name", "namespace")} | {"status": ("deployment_status", STRING)} | TIMES),
    "namespace": ({"namespace_name": "namespace_name"}, {"namespace_id": ("namespace_id", STRING)}),
    "process": ({"upid": "upid"}, {p: (p, STRING) for p in ("container_id", "container_name", "cmdline", "hostname", "namespace", "node_name", "pod_id", "pod_name", "pod_qos", "pod_status", "service_id", "service_name", "replicaset_id", "replicaset_name", "deployment_id", "deployment_name")}),
}


def _status(phase: str, message: str, reason: str, ready: str | None = None) -> Column:
    fields = [F.coalesce(F.col(phase), F.lit("")).alias("phase" if ready else "state"), F.coalesce(F.col(message), F.lit("")).alias("message"), F.coalesce(F.col(reason), F.lit("")).alias("reason")]
    return F.to_json(F.struct(*fields, *([F.coalesce(F.col(ready), F.lit(False)).alias("ready")] if ready else [])))


class Metadata:
    """The dimension tables of a session. Missing tables are empty; joins are left to Catalyst, which broadcasts small ones."""

    def __init__(self, spark, tables: dict[str, DataFrame] | None = None, asid: int = 0, cluster: dict[str, str] | None = None, cidrs: list[str] | None = None):
        self.spark, self.asid, self.cluster, self.cidrs = spark, asid, cluster or {}, cidrs or []
        given = tables or {}
        if unknown := set(given) - set(SCHEMAS):
            raise CompileError(f"unknown metadata tables: {sorted(unknown)}")
        self.tables = {name: self._shaped(given.get(name), T.StructType.fromDDL(schema)) for name, schema in SCHEMAS.items()}
        self._views: dict[str, DataFrame] = {}
        self._records: dict[tuple[str, str], DataFrame] = {}

    def _shaped(self, df: DataFrame | None, schema: T.StructType) -> DataFrame:
        if df is None:
            return self.spark.createDataFrame([], schema)
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def view(self, entity: str) -> DataFrame:
        """An entity's table with everything that hangs on it."""
        if entity not in self._views:
            self._views[entity] = getattr(self, f"_{entity}")()
        return self._views[entity]

    def _namespace(self) -> DataFrame:
        return self.tables["namespace"].withColumnRenamed("name", "namespace_name")

    def _deployment(self) -> DataFrame:
        return self.tables["deployment"].withColumnsRenamed({"name": "deployment_name", "status": "deployment_status"})

    def _replicaset(self) -> DataFrame:
        sets = self.tables["replicaset"].withColumnsRenamed({"name": "replicaset_name", "status": "replicaset_status"})
        return sets.join(self.view("deployment").select("deployment_id", "deployment_name"), "deployment_id", "left")

    def _service(self) -> DataFrame:
        return self.tables["service"].withColumnRenamed("name", "service_name")

    def _pod(self) -> DataFrame:
        pods = self.tables["pod"].withColumnsRenamed({"name": "pod_name", "qos": "pod_qos", "labels": "pod_labels"})
        pods = pods.withColumn("pod_status", _status("phase", "message", "reason", "ready"))
        owners = F.from_json("owner_references", "array<struct<uid:string,kind:string,name:string>>")
        owner = lambda kind: F.get(F.filter(owners, lambda o: o["kind"] == kind), F.lit(0))["uid"]
        pods = pods.withColumn("replicaset_id", owner("ReplicaSet"))
        sets = self.view("replicaset").select("replicaset_id", "replicaset_name", "deployment_id", "deployment_name")
        pods = pods.join(sets, "replicaset_id", "left")
        one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.to_json(c))
        served = self.view("service").select(F.explode("pod_ids").alias("pod_id"), "service_id", "service_name").groupBy("pod_id").agg(F.array_sort(F.collect_set(F.struct("service_id", "service_name"))).alias("s"))
        served = served.select("pod_id", one(F.col("s.service_id")).alias("service_id"), one(F.col("s.service_name")).alias("service_name"))
        return pods.join(served, "pod_id", "left")

    def _container(self) -> DataFrame:
        return self.tables["container"].withColumnRenamed("name", "container_name").withColumn("container_status", _status("state", "message", "reason"))

    def _process(self) -> DataFrame:
        boxes = self.view("container").select("container_id", "container_name", "pod_id")
        pods = self.view("pod").drop("start_time", "stop_time")
        return self.tables["process"].join(boxes, "container_id", "left").join(pods, "pod_id", "left")

    def records(self, entity: str, key: str) -> DataFrame:
        """(k, v): one struct of all columns per key, of the entity that started last."""
        if (entity, key) not in self._records:
            view = self.view(entity)
            order = F.coalesce(F.col("start_time"), F.lit(0)) if "start_time" in view.columns else F.lit(0)
            self._records[entity, key] = view.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max_by(F.struct(*view.columns), order).alias("v"))
        return self._records[entity, key]

    def addresses(self) -> DataFrame:
        """(k, v, start, stop): pods by address, each time span cut at the next one's start."""
        after = F.lead("start_time").over(Window.partitionBy("ip").orderBy("start_time"))
        stop = F.when(F.coalesce(F.col("stop_time"), F.lit(0)) > 0, F.col("stop_time")).otherwise(F.lit(FOREVER))
        return self.tables["pod_ip"].select(F.col("ip").alias("k"), F.col("pod_id").alias("v"), F.col("start_time").alias("start"), F.least(stop, F.coalesce(after, F.lit(FOREVER))).alias("stop"))

    def attribute(self, frame, name: str) -> Value:
        """``frame.ctx[name]``: by the first of its key columns that the frame has."""
        if name not in ALIASES:
            raise CompileError(f"there is no attribute {name!r}; attributes are {sorted(ALIASES)}")
        attribute = ALIASES[name]
        for key in ATTRIBUTES[attribute][1]:
            column = next((c for c in frame.columns if ALIASES.get(c, c) == key), None)
            if column:
                if attribute == "pod_name" and key == "upid" and {"local_addr", "time_"} <= set(frame.columns):
                    return REGISTRY["_upid_to_podname_local_addr_fallback"](frame[column], frame["local_addr"], frame["time_"])
                found = REGISTRY[f"{key}_to_{attribute}"](frame[column])
                return Value(found.col, found.type, semantic=attribute, owner=frame)
        raise CompileError(f"{name} needs one of the columns {ATTRIBUTES[attribute][1]}")


def upid(asid: int, pid: int, start: int) -> tuple[int, int]:
    """(high, low) of a process id."""
    if not 0 <= asid < 1 << 32 or not 0 <= pid < 1 << 32:
        raise CompileError("asid and pid must be 32-bit numbers")
    high = asid << 32 | pid
    return high - (1 << 64) if high >= 1 << 63 else high, start


def uint128(text: str) -> Value:
    """A literal from the text of a UUID."""
    digits = text.replace("-", "")
    if not re.fullmatch("[0-9a-fA-F]{32}", digits):
        raise CompileError(f"{text!r} isn't a UUID")
    halves = [int(digits[i : i + 16], 16) for i in (0, 16)]
    high, low = (h - (1 << 64) if h >= 1 << 63 else h for h in halves)
    return Value(F.struct(F.lit(high).cast("long").alias("high"), F.lit(low).cast("long").alias("low")), UINT128, text)


class Lookup(Function):
    """A function whose value comes from a metadata table of the session that its argument's frame belongs to."""

    def __call__(self, *args: object) -> Value:
        values = [lift(a) for a in args]
        chosen = self.resolve([v.type for v in values])
        frame = next((v.owner for v in values if v.owner is not None), None)
        if frame is None or frame._session is None or frame._session.metadata is None:
            raise CompileError(f"{self.name} needs a column of a frame whose session has metadata")
        return self.build(frame, frame._session.metadata, chosen, *values)


def _lookup(name: str, overloads: list[tuple[tuple[str, ...], str]], build) -> None:
    REGISTRY[name] = Lookup(name, tuple(Overload(a, r) for a, r in overloads), build)


def _fill() -> None:
    for entity, (keys, properties) in LOOKUPS.items():
        for key, key_column in keys.items():
            for prop, (column, kind) in properties.items():
                if column == key_column:
                    continue
                name = f"{key}_to_{prop}"

                def build(frame, md, chosen, value, entity=entity, key_column=key_column, column=column):
                    return frame.lookup(value, md.records(entity, key_column), f"{entity}_by_{key_column}", chosen.returns, field=column)

                _lookup(name, [((UINT128 if key == "upid" else STRING,), kind)], build)

    def by_address(frame, md, chosen, ip, at=None):
        table = md.addresses()
        if at is None:
            table = table.groupBy("k").agg(F.max_by("v", "start").alias("v"))
        return frame.lookup(ip, table, "ip_to_pod_id", STRING, at)

    _lookup("ip_to_pod_id", [((STRING,), STRING), ((STRING, TIME64NS), STRING)], by_address)
    _lookup("ip_to_service_id", [((STRING,), STRING)], lambda frame, md, chosen, ip: frame.lookup(ip, md.records("service", "cluster_ip"), "service_by_cluster_ip", STRING, field="service_id"))

    def fallback(frame, md, chosen, process, ip, at):
        by_process = REGISTRY["upid_to_pod_name"](process)
        pod_id = by_address(frame, md, chosen, ip, at)
        by_ip = REGISTRY["pod_id_to_pod_name"](pod_id)
        return Value(F.when(by_process.col != "", by_process.col).otherwise(by_ip.col), STRING, owner=frame)

    _lookup("_upid_to_podname_local_addr_fallback", [((UINT128, STRING, TIME64NS), STRING)], fallback)
    constant = lambda value: lambda frame, md, chosen, *_: Value(F.lit(value(md)), chosen.returns, owner=frame)
    _lookup("asid", [((), INT64)], constant(lambda md: md.asid))
    for part in ("id", "name", "namespace"):
        _lookup(f"cluster_{part}", [((), STRING)], constant(lambda md, part=part: md.cluster.get(part, "")))
    _lookup("get_cidrs", [((), STRING)], constant(lambda md: json.dumps(md.cidrs)))
    _lookup("_exec_hostname", [((), STRING)], constant(lambda md: socket.gethostname()))
    _lookup("_exec_host_num_cpus", [((), INT64)], constant(lambda md: os.cpu_count() or 0))


@define("upid", ((INT64, INT64, INT64), UINT128), ((INT64, INT64), UINT128))
def make_upid(*parts: Value) -> Column:
    """A process id from (asid, pid, start) or, with asid 0, (pid, start)."""
    asid, pid, start = (lift(0), *parts) if len(parts) == 2 else parts
    return F.struct(F.shiftleft(asid.col, 32).bitwiseOR(pid.col).alias("high"), start.col.alias("low")).cast(UINT128_TYPE)


@define("upid_to_asid", ((UINT128,), INT64))
def upid_to_asid(v: Value) -> Column:
    """The agent's number in a process id."""
    return F.shiftrightunsigned(v.col["high"], 32)


@define("upid_to_pid", ((UINT128,), INT64))
def upid_to_pid(v: Value) -> Column:
    """The process number in a process id."""
    return v.col["high"].bitwiseAND(F.lit(0xFFFFFFFF))


@define("upid_to_start_ts", ((UINT128,), TIME64NS))
def upid_to_start_ts(v: Value) -> Column:
    """The start time in a process id."""
    return v.col["low"]


@define("upid_to_string", ((UINT128,), STRING))
def upid_to_string(v: Value) -> Column:
    """asid:pid:start."""
    return F.concat_ws(":", upid_to_asid(v).cast("string"), upid_to_pid(v).cast("string"), v.col["low"].cast("string"))


def _has(listed: Value, value: Value) -> Column:
    parts = F.when(F.ltrim(listed.col).startswith("["), F.from_json(listed.col, "array<string>"))
    return F.coalesce(F.array_contains(parts, value.col), listed.col == value.col)


for _name in ("has_service_id", "has_service_name", "has_value"):
    define(_name, ((STRING, STRING), BOOLEAN))(_has)
_fill()

"""Export of frames as OpenTelemetry records: OTLP-shaped JSON, one record a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import FLOAT64, INT64, STRING, TIME64NS, CompileError, Value, lift
from ..operators.frame import Frame

SPAN_KIND_SERVER = 2


@dataclass(frozen=True)
class Endpoint:
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    insecure: bool = False
    timeout: int = 5


@dataclass(frozen=True)
class Gauge:
    name: str
    value: Value
    description: str = ""
    attributes: dict[str, Value] = field(default_factory=dict)
    unit: str = ""
    time: Value | None = None


@dataclass(frozen=True)
class Summary:
    name: str
    count: Value
    sum: Value
    quantile_values: dict[float, Value]
    description: str = ""
    attributes: dict[str, Value] = field(default_factory=dict)
    unit: str = ""
    time: Value | None = None


@dataclass(frozen=True)
class Span:
    name: Value | str
    start_time: Value
    end_time: Value
    trace_id: Value | None = None
    span_id: Value | None = None
    parent_span_id: Value | None = None
    kind: int = SPAN_KIND_SERVER
    attributes: dict[str, Value] = field(default_factory=dict)


@dataclass(frozen=True)
class Log:
    body: Value
    severity_number: int = 9
    severity_text: str = "INFO"
    time: Value | None = None
    attributes: dict[str, Value] = field(default_factory=dict)


@dataclass(frozen=True)
class Data:
    resource: dict[str, Value | str]
    data: list[Gauge | Summary | Span | Log]
    endpoint: Endpoint | None = None

    def __post_init__(self):
        if "service.name" not in self.resource:
            raise CompileError("the resource must have service.name")
        if not self.data:
            raise CompileError("there is nothing to export")


def _any(v: Value) -> Column:
    kind = {STRING: "stringValue", FLOAT64: "doubleValue"}.get(v.type, "intValue" if v.type in (INT64, TIME64NS) else "boolValue")
    return F.struct((v.col.cast("string") if kind == "intValue" else v.col).alias(kind))


def _attributes(given: dict[str, Value]) -> Column:
    if not given:
        return F.lit("[]")
    parts = [F.to_json(F.struct(F.lit(k).alias("key"), _any(lift(v)).alias("value"))) for k, v in given.items()]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _text(v: Value | None, frame: Frame) -> Column:
    if v is not None:
        return v.col.cast("string")
    if "time_" not in frame.types:
        raise CompileError("exported rows need a time_ column or an explicit time")
    return F.col("time_").cast("string")


def _quoted(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def _id(v: Value | None, size: int) -> Column:
    """A given hex id of the right size, else a random one."""
    fresh = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(1), F.lit(size))
    if v is None:
        return fresh
    return F.when(v.col.rlike(f"^[0-9a-fA-F]{{{size}}}$"), F.lower(v.col)).otherwise(fresh)


def _record(item: Gauge | Summary | Span | Log, frame: Frame) -> tuple[str, Column]:
    q = _quoted
    lit = F.lit
    if isinstance(item, Gauge):
        value = lift(item.value)
        number = F.concat(lit('"asInt":"'), value.col.cast("string"), lit('"')) if value.type == INT64 else F.concat(lit('"asDouble":'), value.col.cast("string"))
        point = F.concat(lit('{"attributes":'), _attributes(item.attributes), lit(',"timeUnixNano":"'), _text(item.time, frame), lit('",'), number, lit("}"))
        head = F.concat(lit('{"name":'), q(lit(item.name)), lit(',"description":'), q(lit(item.description)), lit(',"unit":'), q(lit(item.unit)))
        return "metrics", F.concat(head, lit(',"gauge":{"dataPoints":['), point, lit("]}}"))
    if isinstance(item, Summary):
        levels = [F.concat(lit(f'{{"quantile":{k},"value":'), lift(v).col.cast("string"), lit("}")) for k, v in sorted(item.quantile_values.items())]
        point = F.concat(
            lit('{"attributes":'), _attributes(item.attributes), lit(',"timeUnixNano":"'), _text(item.time, frame), lit('","count":"'), lift(item.count).col.cast("string"),
            lit('","sum":'), lift(item.sum).col.cast("double").cast("string"), lit(',"quantileValues":['), F.concat_ws(",", *levels), lit("]}"),
        )
        head = F.concat(lit('{"name":'), q(lit(item.name)), lit(',"description":'), q(lit(item.description)), lit(',"unit":'), q(lit(item.unit)))
        return "metrics", F.concat(head, lit(',"summary":{"dataPoints":['), point, lit("]}}"))
    if isinstance(item, Span):
        parent = F.when(item.parent_span_id.col.rlike("^[0-9a-fA-F]{16}$"), F.lower(item.parent_span_id.col)).otherwise(lit("")) if item.parent_span_id is not None else lit("")
        return "spans", F.concat(
            lit('{"traceId":"'), _id(item.trace_id, 32), lit('","spanId":"'), _id(item.span_id, 16), lit('","parentSpanId":"'), parent, lit('","name":'), q(lift(item.name).col), lit(f',"kind":{item.kind},"startTimeUnixNano":"'),
            item.start_time.col.cast("string"), lit('","endTimeUnixNano":"'), item.end_time.col.cast("string"), lit('","attributes":'), _attributes(item.attributes), lit("}"),
        )
    return "logs", F.concat(
        lit('{"timeUnixNano":"'), _text(item.time, frame), lit(f'","severityNumber":{item.severity_number},"severityText":'), q(lit(item.severity_text)), lit(',"body":{"stringValue":'), q(lift(item.body).col),
        lit('},"attributes":'), _attributes(item.attributes), lit("}"),
    )


def records(frame: Frame, data: Data) -> DataFrame:
    """(kind, resource, record): the kind of signal, and resource attributes and record as JSON.

    A resource attribute that is a JSON array gives a copy of the record for each of its values, for several such attributes
    for each combination.
    """
    rows = frame._df
    resource: list[Column] = []
    for i, (key, value) in enumerate(data.resource.items()):
        v = lift(value)
        if v.type == STRING:
            listed = F.when(v.col.startswith("["), F.from_json(v.col, "array<string>"))
            rows = rows.withColumn(f"__res{i}", F.explode(F.when(F.size(listed) > 0, listed).otherwise(F.array(v.col))))
            resource.append(F.to_json(F.struct(F.lit(key).alias("key"), F.struct(F.col(f"__res{i}").alias("stringValue")).alias("value"))))
        else:
            resource.append(F.to_json(F.struct(F.lit(key).alias("key"), _any(v).alias("value"))))
    attributes = F.concat(F.lit('{"attributes":['), F.concat_ws(",", *resource), F.lit("]}"))
    made = F.array(*[F.struct(F.lit(kind).alias("kind"), record.alias("record")) for kind, record in (_record(d, frame) for d in data.data)])
    return rows.select(attributes.alias("resource"), F.explode(made).alias("r")).select("r.kind", "resource", "r.record")


def write(frame: Frame, data: Data, send: Callable[[str, list[dict]], None] | None = None, path: str | None = None) -> None:
    """Writes the records as JSON lines under a path, or hands each partition's to ``send(url, records)`` on the executors."""
    found = records(frame, data)
    if path:
        found.write.mode("append").json(path)
    elif send:
        url = data.endpoint.url if data.endpoint else ""
        found.foreachPartition(lambda rows: send(url, [r.asDict() for r in rows]))
    else:
        raise CompileError("an export needs a path or a sender")

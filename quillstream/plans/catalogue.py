"""The registered queries of the engine, and the same as DuckDB SQL.

Every query runs over its whole tables. Sums and means of floats are rounded in both engines, as their order of addition differs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import REGISTRY, Value, call
from ..operators.frame import Frame
from ..operators.metadata import Metadata
from ..session import shared_dir
from ..sources import otel, udtf
from ..sources.engine import Engine
from ..streaming import queries as streams
from . import views
from .script import equals_any

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TIME_COLUMNS = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
DAY = 86_400_000_000_000
NOW = 1_735_689_600_000_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NS = "(epoch_us({}) * 1000)"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, now=NOW)
    for name in TABLES:
        e.register(name, f"{sf_dir}/{name}.parquet", TIME_COLUMNS.get(name))
    return e


def query(sql: str | None = None):
    """Registers a function of an engine that gives a frame or a DataFrame."""

    def add(build: Callable[[Engine], Frame | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = build(engine(spark, sf_dir))
            return found.spark() if isinstance(found, Frame) else found

        QUERIES[build.__name__] = run
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return add


def rounded(v: Value, places: int = 9) -> Value:
    return Value(F.round(v.col, places), v.type, owner=v.owner)


def agg(name: str):
    return REGISTRY[name]


# --- sources ----------------------------------------------------------------------------------------------------------


@query(f"""SELECT event_type, {NS.format("date_trunc('day', ts)")} AS day, count(*) AS n, round(avg(value), 9) AS mean_value, round(min(value), 9) AS min_value, round(max(value), 9) AS max_value
FROM events GROUP BY ALL""")
def flagship_events_per_day(e):
    df = e.table("events", ["time_", "event_type", "value"])
    df["day"] = call("bin", df["time_"], DAY)
    out = df.groupby(["event_type", "day"]).agg(n=("value", agg("count")), mean_value=("value", agg("mean")), min_value=("value", agg("min")), max_value=("value", agg("max")))
    for c in ("mean_value", "min_value", "max_value"):
        out[c] = rounded(out[c])
    return out


@query("SELECT event_id, user_id, event_type FROM events")
def scan_select(e):
    return e.table("events", ["event_id", "user_id", "event_type"])


@query(f"SELECT event_id, {NS.format('ts')} AS time_ FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def scan_time_range(e):
    return e.table("events", ["event_id", "time_"], "2024-01-05 00:00:00", "2024-01-20 12:00:00")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE false")
def source_empty(e):
    return e.empty({"n_nationkey": "INT64", "n_name": "STRING"})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def script_run(e):
    return e.run("""
import q
def by_type(table: str):
    df = q.DataFrame(table, select=['event_type', 'value'])
    return df.groupby('event_type').agg(n=('value', q.count))
q.display(by_type('events'), 'out')
""")["out"]


LISTED = "table_name IN (" + ", ".join(f"'{n}'" for n in TABLES) + ")"


@query(f"""SELECT table_name, CASE WHEN (table_name, column_name) IN (('events', 'ts'), ('orders', 'o_orderdate'), ('lineitem', 'l_shipdate')) THEN 'time_' ELSE column_name END AS column_name,
CASE WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'TIME64NS' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'FLOAT64' WHEN data_type = 'BOOLEAN' THEN 'BOOLEAN' WHEN data_type LIKE '%[]' OR data_type IN ('VARCHAR', 'BLOB') THEN 'STRING' ELSE 'INT64' END AS column_type,
'GENERAL' AS pattern_type, '' AS column_desc FROM information_schema.columns WHERE {LISTED}""")
def udtf_schemas(e):
    return udtf.get_schemas(e)


@query(f"SELECT table_name, '' AS table_desc FROM information_schema.tables WHERE {LISTED}")
def udtf_tables(e):
    return udtf.get_tables(e)


@query()
def udf_list(e):
    return udtf.get_udf_list(e)


@query()
def uda_list(e):
    return udtf.get_uda_list(e)


OTEL_SQL = f"""SELECT 'metrics' AS kind, '{{"attributes":[{{"key":"service.name","value":{{"stringValue":"' || event_type || '"}}}}]}}' AS resource, event_type, {NS.format('ts')}::VARCHAR AS time_unix_nano, round(value, 9) AS value FROM events"""


@query(OTEL_SQL)
def otel_gauge(e):
    """The parts of the gauge records, read back from their JSON."""
    found = otel_metrics(e)
    part = lambda path: F.get_json_object("record", path)
    at = "$.gauge.dataPoints[0]"
    return found.select("kind", "resource", part(f"{at}.attributes[0].value.stringValue").alias("event_type"), part(f"{at}.timeUnixNano").alias("time_unix_nano"), F.round(part(f"{at}.asDouble").cast("double"), 9).alias("value"))


@query()
def otel_metrics(e):
    df = e.table("events", ["time_", "event_type", "value"])
    return otel.records(df, otel.Data({"service.name": df["event_type"]}, [otel.Gauge("value", df["value"], unit="1", attributes={"type": df["event_type"]})]))


# --- projection, filter, limit ---------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def project_keep(e):
    return e.table("lineitem")[["l_orderkey", "l_quantity"]]


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def project_drop(e):
    return e.table("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]).drop("o_totalprice")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 7::BIGINT AS seven, 'x' AS label FROM lineitem")
def assign_const(e):
    df = e.table("lineitem", ["l_orderkey", "l_linenumber"])
    df["seven"] = 7
    df["label"] = "x"
    return df


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 9) AS charge FROM lineitem")
def assign_expr(e):
    df = e.table("lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"])
    df["charge"] = rounded(df["l_extendedprice"] * (1 - df["l_discount"]) * (1 + df["l_tax"]))
    return df[["l_orderkey", "l_linenumber", "charge"]]


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000.0")
def filter_numeric(e):
    df = e.table("orders", ["o_orderkey", "o_totalprice"])
    return df[df["o_totalprice"] > 200000.0]


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_string(e):
    df = e.table("orders", ["o_orderkey", "o_orderpriority"])
    return df[df["o_orderpriority"] == "1-URGENT"]


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice < 1000.0) AND NOT o_custkey % 2 = 0")
def filter_bool_ops(e):
    df = e.table("orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey"])
    return df[((df["o_orderstatus"] == "F") | (df["o_totalprice"] < 1000.0)) & ~(df["o_custkey"] % 2 == 0)][["o_orderkey"]]


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 're')")
def filter_contains(e):
    df = e.table("part", ["p_partkey", "p_name"])
    return df[call("contains", df["p_name"], "re")]


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def filter_equals_any(e):
    df = e.table("events", ["event_id", "event_type"])
    return df[equals_any(df["event_type"], ["click", "view"])][["event_id"]]


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 17)")
def limit_head(e):
    return e.table("orders", ["o_orderkey"]).head(17).agg(n=("o_orderkey", agg("count")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def ext_top(e):
    return e.table("orders", ["o_orderkey", "o_totalprice"]).top(10, ["o_totalprice", "o_orderkey"])


# --- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(e):
    return e.table("orders", ["o_orderkey", "o_custkey"]).merge(e.table("customer", ["c_custkey", "c_name"]), "inner", "o_custkey", "c_custkey")


@query("SELECT c_custkey, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(o_custkey, 0) AS o_custkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_totalprice, 0.0) AS o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left_zero_fill(e):
    return e.table("customer", ["c_custkey"]).merge(e.table("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]), "left", "c_custkey", "o_custkey")


@query("SELECT coalesce(o_orderkey, 0) AS o_orderkey, coalesce(o_custkey, 0) AS o_custkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(e):
    return e.table("orders", ["o_orderkey", "o_custkey"]).merge(e.table("customer", ["c_custkey"]), "right", "o_custkey", "c_custkey")


@query("""WITH a AS (SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey FROM supplier), b AS (SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_acctbal > 5000.0)
SELECT coalesce(s_suppkey, 0) AS s_suppkey, coalesce(s_nationkey, 0) AS s_nationkey, coalesce(c_custkey, 0) AS c_custkey, coalesce(c_nationkey, 0) AS c_nationkey FROM a FULL JOIN b ON s_suppkey = c_custkey""")
def join_outer_zero_fill(e):
    right = e.table("customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    right = right[right["c_acctbal"] > 5000.0].drop("c_acctbal")
    return e.table("supplier", ["s_suppkey", "s_nationkey"]).merge(right, "outer", "s_suppkey", "c_custkey")


@query("SELECT s_suppkey, c_custkey, s_nationkey::BIGINT AS s_nationkey, c_nationkey::BIGINT AS c_nationkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
def join_multi_key(e):
    return e.table("supplier", ["s_suppkey", "s_nationkey"]).merge(e.table("customer", ["c_custkey", "c_nationkey"]), "inner", ["s_nationkey", "s_suppkey"], ["c_nationkey", "c_custkey"])


@query("SELECT a.n_nationkey::BIGINT AS n_nationkey_x, a.n_regionkey::BIGINT AS n_regionkey_x, b.n_nationkey::BIGINT AS n_nationkey_y, b.n_regionkey::BIGINT AS n_regionkey_y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(e):
    df = e.table("nation", ["n_nationkey", "n_regionkey"])
    return df.merge(df, "inner", "n_regionkey", "n_regionkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def ext_anti(e):
    return e.table("customer", ["c_custkey"]).semi(e.table("orders", ["o_custkey"]), "c_custkey", "o_custkey", anti=True)


# --- aggregation ------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 9) AS mean_qty, min(l_tax) AS min_tax, max(l_discount) AS max_discount FROM lineitem")
def agg_none(e):
    out = e.table("lineitem").agg(n=("l_orderkey", agg("count")), total=("l_extendedprice", agg("sum")), mean_qty=("l_quantity", agg("mean")), min_tax=("l_tax", agg("min")), max_discount=("l_discount", agg("max")))
    out["total"], out["mean_qty"] = rounded(out["total"], 2), rounded(out["mean_qty"], 9)
    return out


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL")
def agg_group(e):
    out = e.table("lineitem", ["l_returnflag", "l_quantity"]).groupby("l_returnflag").agg(n=("l_quantity", agg("count")), qty=("l_quantity", agg("sum")))
    out["qty"] = rounded(out["qty"], 2)
    return out


@query("SELECT l_returnflag, l_linestatus, round(avg(l_discount), 9) AS disc, max(l_suppkey) AS supp FROM lineitem GROUP BY ALL")
def agg_multi_key(e):
    out = e.table("lineitem", ["l_returnflag", "l_linestatus", "l_discount", "l_suppkey"]).groupby(["l_returnflag", "l_linestatus"]).agg(disc=("l_discount", agg("mean")), supp=("l_suppkey", agg("max")))
    out["disc"] = rounded(out["disc"], 9)
    return out


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def agg_distinct_groups(e):
    return e.table("orders", ["o_orderstatus", "o_orderpriority"]).groupby(["o_orderstatus", "o_orderpriority"]).agg()


@query("SELECT c_custkey, any_value(c_name) AS name FROM customer GROUP BY ALL")
def agg_any(e):
    return e.table("customer", ["c_custkey", "c_name"]).groupby("c_custkey").agg(name=("c_name", agg("any")))


@query("SELECT event_type, sum((value > 50.0)::BIGINT)::BIGINT AS large, round(avg((value > 50.0)::INT), 9) AS share FROM events GROUP BY ALL")
def agg_bool(e):
    df = e.table("events", ["event_type", "value"])
    df["large"] = df["value"] > 50.0
    out = df.groupby("event_type").agg(large=("large", agg("sum")), share=("large", agg("mean")))
    out["share"] = rounded(out["share"], 9)
    return out


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.01) AS p01, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY ALL")
def agg_quantiles_pluck(e):
    out = e.table("lineitem", ["l_returnflag", "l_extendedprice"]).groupby("l_returnflag").agg(q=("l_extendedprice", agg("quantiles")))
    for p in ("p01", "p50", "p99"):
        out[p] = call("pluck_float64", out["q"], p)
    return out.drop("q")


@query()
def agg_sample(e):
    return e.table("events", ["event_type", "value"]).groupby("event_type").agg(one=("value", agg("sample")))


@query()
def agg_path_clusters(e):
    df = e.table("pages", ["url"])
    df["path"] = Value(F.regexp_extract(df["url"].col, "://[^/]*([^?#]*)", 1), "STRING")
    return df.agg(clusters=("path", agg("_build_request_path_clusters")))


@query()
def agg_kmeans(e):
    df = e.table("embeddings", ["embedding", "label"])
    df["k"] = 8
    return df.groupby("label").agg(model=("embedding", "k", agg("_kmeans_fit")))


@query(f"SELECT {NS.format("date_trunc('hour', ts)")} AS hour, count(*) AS n FROM events GROUP BY ALL")
def bin_time(e):
    df = e.table("events", ["time_", "event_id"])
    df["hour"] = call("bin", df["time_"], DAY // 24)
    return df.groupby("hour").agg(n=("event_id", agg("count")))


@query("SELECT floor(l_extendedprice)::BIGINT - floor(l_extendedprice)::BIGINT % 1000 AS bucket, count(*) AS n FROM lineitem GROUP BY ALL")
def bin_value(e):
    df = e.table("lineitem", ["l_extendedprice"])
    df["bucket"] = call("bin", df["l_extendedprice"], 1000)
    return df.groupby("bucket").agg(n=("bucket", agg("count")))


@query(f"SELECT {NS.format("date_trunc('day', ts)")} AS time_, event_type, count(*) AS n FROM events GROUP BY ALL")
def rolling_tumbling(e):
    return e.table("events", ["time_", "event_type", "value"]).rolling("1d").groupby("event_type").agg(n=("value", agg("count")))


# --- sets -------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 100000.0")
def union_all(e):
    df = e.table("orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return df[df["o_orderstatus"] == "F"][["o_orderkey"]].append(df[df["o_totalprice"] > 100000.0][["o_orderkey"]])


@query(f"SELECT event_id, {NS.format('ts')} AS time_ FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, {NS.format('ts')} FROM events WHERE event_type = 'view'")
def union_ordered(e):
    df = e.table("events", ["event_id", "time_", "event_type"])
    part = lambda t: df[df["event_type"] == t][["event_id", "time_"]]
    return part("click").append(part("view"), ordered=True)


@query("SELECT DISTINCT event_type FROM events")
def ext_distinct(e):
    return e.table("events", ["event_type"]).distinct()


# --- functions --------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(ln(l_extendedprice), 6) AS a, round(sqrt(l_quantity), 6) AS b, ceil(l_tax)::BIGINT AS c, floor(l_extendedprice)::BIGINT AS d, abs(l_discount - 0.05) AS f,
round(log2(l_quantity), 6) AS g, round(log10(l_quantity), 6) AS h, round(pow(l_tax, 2.0), 8) AS i, round(exp(l_discount), 6) AS j, ~l_orderkey AS k, -l_linenumber::BIGINT AS m FROM lineitem""")
def fn_math(e):
    df = e.table("lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax", "l_discount"])
    out = {
        "a": rounded(call("ln", df["l_extendedprice"]), 6), "b": rounded(call("sqrt", df["l_quantity"]), 6), "c": call("ceil", df["l_tax"]), "d": call("floor", df["l_extendedprice"]), "f": call("abs", df["l_discount"] - 0.05),
        "g": rounded(call("log2", df["l_quantity"]), 6), "h": rounded(call("log10", df["l_quantity"]), 6), "i": rounded(call("pow", df["l_tax"], 2.0), 8), "j": rounded(call("exp", df["l_discount"]), 6), "k": ~df["l_orderkey"], "m": -df["l_linenumber"],
    }
    for name, v in out.items():
        df[name] = v
    return df[["l_orderkey", "l_linenumber", *out]]


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_tax = 0 THEN 'inf' ELSE 'finite' END AS kind FROM lineitem""")
def fn_divide_zero(e):
    df = e.table("lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"])
    df["kind"] = call("select", (df["l_quantity"] / df["l_tax"]) > 1e300, "inf", "finite")
    return df[["l_orderkey", "l_linenumber", "kind"]]


@query("SELECT event_id, event_id % 7 AS r, (event_id - 500) % 7 AS s, log(2, event_id + 1) > 3 AS t FROM events")
def fn_modulo_log(e):
    df = e.table("events", ["event_id"])
    df["r"], df["s"], df["t"] = df["event_id"] % 7, (df["event_id"] - 500) % 7, call("log", 2, df["event_id"] + 1) > 3.0
    return df


@query("SELECT o_orderkey, printf('%.0f', floor(o_totalprice)) AS t FROM orders")
def fn_round_str(e):
    df = e.table("orders", ["o_orderkey", "o_totalprice"])
    df["t"] = call("round", call("floor", df["o_totalprice"]) * 1.0, 0)
    return df[["o_orderkey", "t"]]


@query("SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, strlen(c_name)::BIGINT AS n, strpos(c_name, '0') - 1 AS f, substr(c_name, 3, 4) AS s, c_name || '!' AS c FROM customer")
def fn_string(e):
    df = e.table("customer", ["c_custkey", "c_name", "c_mktsegment"])
    df["u"], df["l"], df["n"] = call("toupper", df["c_name"]), call("tolower", df["c_mktsegment"]), call("length", df["c_name"])
    df["f"], df["s"], df["c"] = call("find", df["c_name"], "0"), call("substring", df["c_name"], 2, 4), df["c_name"] + "!"
    return df.drop(["c_name", "c_mktsegment"])


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, strpos(text, 'the') - 1 AS at, substr(text, 11, 20) AS part FROM documents")
def fn_find_substring(e):
    df = e.table("documents", ["doc_id", "text"])
    df["bytes"], df["at"], df["part"] = call("length", df["text"]), call("find", df["text"], "the"), call("substring", df["text"], 10, 20)
    return df.drop("text")


@query("SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer') THEN substr(c_name, 9) ELSE c_name END AS bare, trim('  ' || c_mktsegment || ' ') AS t FROM customer")
def fn_trim_prefix(e):
    df = e.table("customer", ["c_custkey", "c_name", "c_mktsegment"])
    df["bare"], df["t"] = call("strip_prefix", "Customer", df["c_name"]), call("trim", call("add", call("add", "  ", df["c_mktsegment"]), " "))
    return df[["c_custkey", "bare", "t"]]


@query(r"SELECT n_nationkey::BIGINT AS n_nationkey, regexp_replace(lower(hex(n_name)), '(..)', '\\x\1', 'g') AS h, n_name AS back FROM nation")
def fn_hex(e):
    df = e.table("nation", ["n_nationkey", "n_name"])
    df["h"] = call("bytes_to_hex", df["n_name"])
    df["back"] = call("hex_to_ascii", Value(F.hex(df["n_name"].col), "STRING"))
    return df.drop("n_name")


@query("SELECT o_orderkey, coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT), -1) AS p, o_custkey::VARCHAR AS c, coalesce(TRY_CAST(o_orderstatus AS BIGINT), -1) AS x FROM orders")
def fn_atoi(e):
    df = e.table("orders", ["o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus"])
    df["p"], df["c"], df["x"] = call("atoi", call("substring", df["o_orderpriority"], 0, 1), -1), call("itoa", df["o_custkey"]), call("atoi", df["o_orderstatus"], -1)
    return df[["o_orderkey", "p", "c", "x"]]


@query("SELECT event_id, coalesce(props ->> '$.k', '') AS k, coalesce(props ->> '$.none', '') AS none FROM events")
def fn_pluck(e):
    df = e.table("events", ["event_id", "props"])
    df["k"], df["none"] = call("pluck", df["props"], "k"), call("pluck", df["props"], "none")
    return df.drop("props")


@query("SELECT event_id, coalesce(TRY_CAST(props ->> '$.k' AS BIGINT), 0) AS k, 0.0::DOUBLE AS f FROM events")
def fn_pluck_int64(e):
    df = e.table("events", ["event_id", "props"])
    df["k"], df["f"] = call("pluck_int64", df["props"], "k"), call("pluck_float64", df["props"], "k")
    return df.drop("props")


@query("SELECT p_partkey, to_json(string_split(p_name, ' '))::VARCHAR AS words, coalesce(string_split(p_name, ' ')[2], '') AS second FROM part")
def fn_split_pluck_array(e):
    df = e.table("part", ["p_partkey", "p_name"])
    df["words"] = call("split", df["p_name"], " ")
    df["second"] = call("pluck_array", df["words"], 1)
    return df.drop("p_name")


@query("SELECT event_id, CASE WHEN value > 50.0 THEN 'high' ELSE 'low' END AS level, CASE WHEN value > 50.0 THEN event_id ELSE user_id END AS pick FROM events")
def fn_select(e):
    df = e.table("events", ["event_id", "user_id", "value"])
    high = df["value"] > 50.0
    df["level"], df["pick"] = call("select", high, "high", "low"), call("select", high, df["event_id"], df["user_id"])
    return df[["event_id", "level", "pick"]]


@query("SELECT p_partkey, regexp_full_match(p_type, '[A-Z]+ .*') AS m, regexp_replace(p_brand, '#([0-9]+)', '<\\1>', 'g') AS r FROM part")
def fn_regex(e):
    df = e.table("part", ["p_partkey", "p_type", "p_brand"])
    df["m"], df["r"] = call("regex_match", "[A-Z]+ .*", df["p_type"]), call("replace", "#([0-9]+)", df["p_brand"], r"<\1>")
    return df[["p_partkey", "m", "r"]]


@query("SELECT o_orderkey, CASE WHEN regexp_full_match(o_orderpriority, '[12]-.*') THEN 'top' WHEN regexp_full_match(o_orderpriority, '.*LOW') THEN 'low' ELSE '' END AS rule FROM orders")
def fn_match_rule(e):
    df = e.table("orders", ["o_orderkey", "o_orderpriority"])
    df["rule"] = call("_match_regex_rule", '{"top": "[12]-.*", "low": ".*LOW"}', df["o_orderpriority"])
    return df.drop("o_orderpriority")


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages")
def fn_uri_parse(e):
    df = e.table("pages", ["page_id", "url"])
    df["j"] = call("uri_parse", df["url"])
    for part in ("scheme", "host", "path", "query"):
        df[part] = call("pluck", df["j"], part)
    return df.drop(["url", "j"])


@query("SELECT c_custkey, 'https://h.example.com:8080/' || lower(c_mktsegment) || '?k=1' AS uri FROM customer")
def fn_uri_recompose(e):
    df = e.table("customer", ["c_custkey", "c_mktsegment"])
    df["uri"] = call("uri_recompose", "https", "", "h.example.com", 8080, call("tolower", df["c_mktsegment"]), "k=1", "")
    return df.drop("c_mktsegment")


@query("SELECT page_id, regexp_full_match(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/en/[^/]*') AS fits FROM pages")
def fn_match_endpoint(e):
    df = e.table("pages", ["page_id", "url"])
    df["fits"] = call("_match_endpoint", call("replace", "^[a-z]+://[^/]*|[?#].*$", df["url"], ""), "/en/*")
    return df.drop("url")


@query("SELECT c_custkey, (c_custkey % 256) < 64 AS inside FROM customer")
def fn_cidr(e):
    df = e.table("customer", ["c_custkey"])
    df["inside"] = call("cidrs_contain_ip", '["10.1.0.0/26", "fe80::/10"]', call("add", "10.1.0.", call("itoa", df["c_custkey"] % 256)))
    return df


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Sleep' WHEN 1 THEN 'Quit' WHEN 2 THEN 'InitDB' ELSE 'Query' END AS mysql, CASE c_custkey % 4 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'FORMERR' WHEN 2 THEN 'SERVFAIL' ELSE 'NXDOMAIN' END AS dns,
CASE c_custkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'Created' WHEN 2 THEN 'Accepted' ELSE 'Non-Authoritative Information' END AS http, CASE c_custkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'HTTP' WHEN 2 THEN 'HTTP2' ELSE 'MySQL' END AS protocol FROM customer""")
def fn_protocol_names(e):
    df = e.table("customer", ["c_custkey"])
    code = df["c_custkey"] % 4
    df["mysql"], df["dns"], df["http"], df["protocol"] = call("mysql_command_name", code), call("dns_rcode_name", code), call("http_resp_message", code + 200), call("protocol_name", code)
    return df


@query()
def fn_pii(e):
    df = e.table("documents", ["doc_id", "text"])
    df["clean"] = call("redact_pii_best_effort", df["text"])
    return df.drop("text")


@query("""SELECT c_custkey, 'n ' || c_custkey || ': <REDACTED_EMAIL> at <REDACTED_IPV4> or <REDACTED_IPV6>, <REDACTED_MAC_ADDR>; <REDACTED_CC_NUMBER>, <REDACTED_SSN>, <REDACTED_IBAN>.' AS clean FROM customer""")
def fn_pii_made(e):
    df = e.table("customer", ["c_custkey"]).spread()
    key = call("itoa", df["c_custkey"])
    df["clean"] = call("redact_pii_best_effort", call("add", "n ", key) + ": u" + key + "@mail.example.org at 10.1.2.3 or 2001:db8:0:0:0:0:2:1, 00:1b:44:11:3a:b7; 4111 1111 1111 1111, 123-45-6789, DE89 3704 0044 0532 0130 00.")
    return df


@query("SELECT o_orderkey, '{\"query\":\"SELECT * FROM t WHERE k=$1 AND p=$2\",\"params\":[\"' || o_orderkey || '\",\"''' || o_orderpriority || '''\"],\"error\":\"\"}' AS n FROM orders")
def fn_normalize_sql(e):
    df = e.table("orders", ["o_orderkey", "o_orderpriority"])
    sql = call("add", "SELECT * FROM t WHERE k=", call("itoa", df["o_orderkey"])) + " AND p='" + df["o_orderpriority"] + "'"
    df["n"] = call("normalize_pgsql", sql, "Query")
    return df.drop("o_orderpriority")


# --- metadata ---------------------------------------------------------------------------------------------------------


def with_metadata(e: Engine) -> Engine:
    """Nations stand in for pods, regions for services; addresses change hands at the middle of January."""
    nations, regions = e.tables["nation"], e.tables["region"]
    pods = nations.select(F.col("n_nationkey").cast("string").alias("pod_id"), F.concat(F.lit("ns/"), "n_name").alias("name"), F.lit("ns").alias("namespace"), F.concat(F.lit("node"), F.col("n_regionkey").cast("string")).alias("node_name"))
    served = nations.groupBy(F.col("n_regionkey").alias("r")).agg(F.collect_list(F.col("n_nationkey").cast("string")).alias("pod_ids"))
    services = regions.join(served, regions["r_regionkey"] == served["r"]).select(F.col("r_regionkey").cast("string").alias("service_id"), F.col("r_name").alias("name"), F.lit("ns").alias("namespace"), "pod_ids")
    cut = 1_705_276_800_000_000_000
    spans = [(0, 0, cut), (1, cut, 0)]
    ips = None
    for shift, start, stop in spans:
        part = nations.select(F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("ip"), ((F.col("n_nationkey") + shift) % 25).cast("string").alias("pod_id"), F.lit(start).cast("long").alias("start_time"), F.lit(stop).cast("long").alias("stop_time"))
        ips = part if ips is None else ips.unionByName(part)
    e.metadata = Metadata(e.spark, {"pod": pods, "service": services, "pod_ip": ips})
    return e


@query("SELECT c_custkey, c_nationkey::VARCHAR AS pod_id, 'ns/' || n_name AS pod, r_name AS service, 'node' || n_regionkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def md_ctx_lookup(e):
    df = with_metadata(e).table("customer", ["c_custkey", "c_nationkey"])
    df["pod_id"] = call("itoa", df["c_nationkey"])
    df = df.drop("c_nationkey")
    df["pod"], df["service"], df["node"] = df.ctx["pod"], df.ctx["service"], df.ctx["node"]
    return df


@query("""SELECT event_id, ((user_id % 25 + CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 0 ELSE 1 END) % 25)::VARCHAR AS pod_id FROM events""")
def md_ip_at_time(e):
    df = with_metadata(e).table("events", ["event_id", "user_id", "time_"])
    df["ip"] = call("add", "10.0.0.", call("itoa", df["user_id"] % 25))
    df["pod_id"] = REGISTRY["ip_to_pod_id"](df["ip"], df["time_"])
    return df[["event_id", "pod_id"]]


@query("SELECT c_custkey, 7::BIGINT AS asid, c_custkey AS pid, '7:' || c_custkey || ':100' AS text FROM customer")
def md_upid(e):
    df = e.table("customer", ["c_custkey"])
    df["u"] = call("upid", 7, df["c_custkey"], 100)
    df["asid"], df["pid"], df["text"] = call("upid_to_asid", df["u"]), call("upid_to_pid", df["u"]), call("upid_to_string", df["u"])
    return df.drop("u")


POD_STATUS = """'{"phase":"Running","message":"","reason":"","ready":' || (n % 2 = 0)::VARCHAR || '}'"""
OWNED = """'[{"uid":"rs' || n || '","kind":"ReplicaSet","name":"rs/' || n_name || '"}]'"""
DEPLOYED = """'[{"uid":"d' || r || '","kind":"Deployment","name":"dep/' || r || '"}]'"""
SET = {"replicaset_id": "'rs' || n", "replicaset_name": "'rs/' || n_name", "deployment_id": "'d' || r", "deployment_name": "'dep/' || r"}
SERVED = {"service_id": "'s' || r", "service_name": "'svc/' || r"}
POD_SQL = SET | SERVED | {"pod_id": "'p' || n", "pod_name": "'ns/' || n_name", "namespace": "'ns'", "node_name": "'node' || r", "owner_references": OWNED, "start_time": "n + 1", "stop_time": "n + 1000", "status": POD_STATUS, "pod_ip": "'10.0.0.' || n", "pod_labels": """'{"app":"a' || n || '"}'"""}
#: Of each entity: its keys, and what its lookups give, as SQL over n (nation), r (its region) and n_name.
EXPECTED = {
    "pod": (("pod_id", "pod_name"), POD_SQL),
    "container": (("container_id", "container_name"), {"container_id": "'c' || n", "container_name": "'box' || n", "status": """'{"state":"Running","message":"m' || n || '","reason":""}'""", "start_time": "n + 5", "stop_time": "n + 50"}),
    "service": (("service_id", "service_name"), SERVED | {"namespace": "'ns'", "cluster_ip": "'10.1.0.' || r", "external_ips": """'["1.2.3.' || r || '"]'"""}),
    "replicaset": (("replicaset_id", "replicaset_name"), SET | {"namespace": "'ns'", "owner_references": DEPLOYED, "status": "'ok' || n", "start_time": "n + 100", "stop_time": "n + 200"}),
    "deployment": (("deployment_id", "deployment_name"), {"deployment_id": "'d' || r", "deployment_name": "'dep/' || r", "namespace": "'ns'", "status": "'up' || r", "start_time": "r + 10", "stop_time": "r + 20"}),
    "process": (("upid",), {k: v for k, v in POD_SQL.items() if k in {"namespace", "node_name", "pod_id", "pod_name", *SET, *SERVED}} | {"pod_qos": "'Burstable'", "pod_status": POD_STATUS, "hostname": "'host' || n", "container_id": "'c' || n", "container_name": "'box' || n", "cmdline": "'run ' || n"}),
}
NATIONS = "(SELECT n_nationkey AS n, n_regionkey AS r, n_name FROM nation)"


def with_all_metadata(e: Engine) -> Engine:
    """A pod, container, replica set and process for each nation, a service and deployment for each region."""
    rows = e.tables["nation"].select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_regionkey").cast("string").alias("r"), "n_name", F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("j"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    n, r, name = F.col("n"), F.col("r"), F.col("n_name")
    pods = rows.select(
        text("p", n).alias("pod_id"), text("ns/", name).alias("name"), F.lit("ns").alias("namespace"), text("node", r).alias("node_name"), text("host", n).alias("hostname"), text("10.0.0.", n).alias("pod_ip"), F.lit("Burstable").alias("qos"), F.lit("Running").alias("phase"),
        (F.col("i") % 2 == 0).alias("ready"), text('{"app":"a', n, '"}').alias("labels"), text('[{"uid":"rs', n, '","kind":"ReplicaSet","name":"rs/', name, '"}]').alias("owner_references"), (F.col("i") + 1).alias("start_time"), (F.col("i") + 1000).alias("stop_time"),
    )
    sets = rows.select(text("rs", n).alias("replicaset_id"), text("rs/", name).alias("name"), F.lit("ns").alias("namespace"), text("d", r).alias("deployment_id"), text("ok", n).alias("status"), text('[{"uid":"d', r, '","kind":"Deployment","name":"dep/', r, '"}]').alias("owner_references"), (F.col("i") + 100).alias("start_time"), (F.col("i") + 200).alias("stop_time"))
    deployments = rows.select("r", "j").distinct().select(text("d", r).alias("deployment_id"), text("dep/", r).alias("name"), F.lit("ns").alias("namespace"), text("up", r).alias("status"), (F.col("j") + 10).alias("start_time"), (F.col("j") + 20).alias("stop_time"))
    services = rows.groupBy("r").agg(F.collect_list(text("p", n)).alias("pod_ids")).select(text("s", r).alias("service_id"), text("svc/", r).alias("name"), F.lit("ns").alias("namespace"), text("10.1.0.", r).alias("cluster_ip"), text('["1.2.3.', r, '"]').alias("external_ips"), "pod_ids")
    boxes = rows.select(text("c", n).alias("container_id"), text("box", n).alias("name"), text("p", n).alias("pod_id"), F.lit("Running").alias("state"), text("m", n).alias("message"), (F.col("i") + 5).alias("start_time"), (F.col("i") + 50).alias("stop_time"))
    processes = rows.select(F.struct(((F.lit(7).cast("long") * (1 << 32)) + F.col("i")).alias("high"), F.lit(100).cast("long").alias("low")).alias("upid"), text("run ", n).alias("cmdline"), text("c", n).alias("container_id"))
    spaces = e.spark.createDataFrame([("n0", "ns")], "namespace_id string, name string")
    addresses = pods.select(F.col("pod_ip").alias("ip"), "pod_id", F.lit(0).cast("long").alias("start_time"), F.lit(0).cast("long").alias("stop_time"))
    e.metadata = Metadata(e.spark, {"pod": pods, "replicaset": sets, "deployment": deployments, "service": services, "container": boxes, "process": processes, "namespace": spaces, "pod_ip": addresses}, asid=7, cluster={"id": "k1", "name": "main", "namespace": "ops"}, cidrs=["10.0.0.0/8"])
    return e


def keyed_nations(e: Engine) -> Frame:
    """The nations with a column for every key of ``EXPECTED``."""
    df = with_all_metadata(e).table("nation", ["n_nationkey", "n_regionkey", "n_name"])
    n, r = call("itoa", df["n_nationkey"]), call("itoa", df["n_regionkey"])
    for column, prefix, part in (("pod_id", "p", n), ("container_id", "c", n), ("container_name", "box", n), ("service_id", "s", r), ("service_name", "svc/", r), ("replicaset_id", "rs", n), ("deployment_id", "d", r), ("deployment_name", "dep/", r)):
        df[column] = call("add", prefix, part)
    df["pod_name"], df["replicaset_name"] = call("add", "ns/", df["n_name"]), call("add", "rs/", df["n_name"])
    df["upid"] = call("upid", 7, df["n_nationkey"], 100)
    return df


def _entity_query(entity: str, key: str, properties: dict[str, str]) -> None:
    names = {f"{key}_to_{p}": sql for p, sql in properties.items() if f"{key}_to_{p}" in REGISTRY}

    def build(e):
        df = keyed_nations(e)
        for name in names:
            df[name] = REGISTRY[name](df[key])
        return df[["n_nationkey", *names]]

    build.__name__ = f"md_{key}_to_all"
    query(f"SELECT n AS n_nationkey, {', '.join(f'{sql} AS {name}' for name, sql in names.items())} FROM {NATIONS}")(build)


for _entity, (_keys, _properties) in EXPECTED.items():
    for _key in _keys:
        _entity_query(_entity, _key, _properties)


@query(f"""SELECT n AS n_nationkey, 'p' || n AS pod_id, 's' || r AS service_id, 'n0' AS namespace_id, r = 1 AS has_id, r = 2 AS has_name, n = 3 AS has_it, 7::BIGINT AS asid, 'k1' AS cluster_id, 'main' AS cluster_name, 'ops' AS cluster_namespace, '["10.0.0.0/8"]' AS cidrs, 100::BIGINT AS start_ts, 'ns/' || n_name AS by_ip
FROM {NATIONS}""")
def md_others(e):
    df = keyed_nations(e)
    df["ip"], df["cluster_ip"], df["ns"] = call("add", "10.0.0.", call("itoa", df["n_nationkey"])), call("add", "10.1.0.", call("itoa", df["n_regionkey"])), call("substring", df["pod_name"], 0, 2)
    df["found"], df["served"], df["space"] = REGISTRY["ip_to_pod_id"](df["ip"]), REGISTRY["ip_to_service_id"](df["cluster_ip"]), REGISTRY["namespace_name_to_namespace_id"](df["ns"])
    df["has_id"], df["has_name"], df["has_it"] = call("has_service_id", '["s1","s9"]', df["service_id"]), call("has_service_name", "svc/2", df["service_name"]), call("has_value", '["p3"]', df["pod_id"])
    for column, name in (("asid", "asid"), ("cluster_id", "cluster_id"), ("cluster_name", "cluster_name"), ("cluster_namespace", "cluster_namespace"), ("cidrs", "get_cidrs")):
        found = REGISTRY[name].build(df, e.metadata, REGISTRY[name].overloads[0])
        df[column] = found
    df["start_ts"] = call("upid_to_start_ts", df["upid"])
    nobody = call("upid", 9, df["n_nationkey"], 100)
    df["time_"] = call("int64_to_time", df["n_nationkey"] + 5)
    df["nobody"] = nobody
    df["by_ip"] = REGISTRY["_upid_to_podname_local_addr_fallback"](df["nobody"], df["ip"], df["time_"])
    out = df[["n_nationkey", "found", "served", "space", "has_id", "has_name", "has_it", "asid", "cluster_id", "cluster_name", "cluster_namespace", "cidrs", "start_ts", "by_ip"]]
    return out.spark().withColumnsRenamed({"found": "pod_id", "served": "service_id", "space": "namespace_id"})


@query(f"SELECT n AS n_nationkey, 'p' || n AS pod_id, 'ns/' || n_name AS pod, 'svc/' || r AS service, 's' || r AS service_id, 'ns' AS namespace, 'rs/' || n_name AS replicaset, 'd' || r AS deployment_id, 'dep/' || r AS deployment, 'node' || r AS node, 'host' || n AS hostname, 'c' || n AS container_id, 'box' || n AS container, 'run ' || n AS cmdline, 7::BIGINT AS asid, n::BIGINT AS pid FROM {NATIONS}")
def md_ctx_all(e):
    names = ["pod_id", "pod", "service", "service_id", "namespace", "replicaset", "deployment_id", "deployment", "node", "hostname", "container_id", "container", "cmdline", "asid", "pid"]
    out = keyed_nations(e)[["n_nationkey", "upid"]]
    for name in names:
        out[f"x_{name}"] = out.ctx[name]
    return out.spark().select("n_nationkey", *[F.col(f"x_{name}").alias(name) for name in names])


# --- library views -----------------------------------------------------------------------------------------------------

FROM, TO, WEEK = "2024-01-03 00:00:00", "2024-01-24 00:00:00", 7 * DAY
SPAN = f"{21 * DAY}::DOUBLE"
#: Events with the nation n that stands behind each, between the two times.
TELEMETRY = f"""(SELECT event_id AS i, {NS.format('ts')} AS t, user_id % 25 AS n, user_id % 7 AS k, r, n_name FROM events JOIN {NATIONS} ON n = user_id % 25 WHERE ts >= TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{TO}')"""
PLACE_SQL = "'ns/' || n_name AS pod, 'svc/' || r AS service, 'ns' AS namespace, 'node' || r AS node"
USE = {"actual_disk_read_throughput": 3, "actual_disk_write_throughput": 4, "total_disk_read_throughput": 5, "total_disk_write_throughput": 6}
#: Windows start at whole multiples of a week since the epoch.
WINDOW = f"t - t % {WEEK}"


def with_telemetry(e: Engine) -> Engine:
    """Events as telemetry of the nations' pods: counters grow with the event's number."""
    with_all_metadata(e)
    rows = e.tables["events"].select("event_id", "time_", (F.col("user_id") % 25).alias("n"), (F.col("user_id") % 7).alias("k"))
    upid = F.struct(((F.lit(7).cast("long") * (1 << 32)) + F.col("n")).alias("high"), F.lit(100).cast("long").alias("low")).alias("upid")
    i = F.col("event_id").cast("long")
    counters = ["cpu_ktime_ns", "cpu_utime_ns", "read_bytes", "write_bytes", "rchar_bytes", "wchar_bytes"]
    e.register("process_stats", rows.select("time_", upid, (i % 100).alias("rss_bytes"), (i % 1000).alias("vsize_bytes"), *[(i * (x + 1)).alias(c) for x, c in enumerate(counters)]))
    e.register("network_stats", rows.select("time_", F.concat(F.lit("p"), F.col("n").cast("string")).alias("pod_id"), *[(i * (x + 1)).alias(c) for x, c in enumerate(views.NETWORK)]))
    path = F.when(F.col("k") == 0, "/healthz").when(F.col("k") == 1, "/readyz").otherwise("/a")
    address = F.when(F.col("k") == 2, "-").when(F.col("k") == 3, "127.0.0.1").otherwise(F.concat(F.lit("10.0.0."), ((F.col("n") + 1) % 25).cast("string")))
    e.register("http_events", rows.select("time_", upid, address.alias("remote_addr"), path.alias("req_path"), F.when(i % 3 == 0, 500).otherwise(200).cast("long").alias("resp_status"), (i % 50).alias("latency"), (i % 11).alias("req_body_size"), (i % 13).alias("resp_body_size"), F.when(F.col("k") == 6, 1).otherwise(2).cast("long").alias("trace_role")))
    return e


def _rounded(frame: Frame, columns, places: int = 9) -> Frame:
    for c in columns:
        frame[c] = rounded(frame[c], places)
    return frame


def _use_sql(group: str, span: str) -> str:
    return f"round(3 * (max(i) - min(i)) / {span}, 15) AS cpu_usage, " + ", ".join(f"round({x} * (max(i) - min(i)) / {span}, 15) AS {c}" for c, x in USE.items()) + ", round(avg(i % 100), 9) AS rss, round(avg(i % 1000), 9) AS vsize"


def _use(frame: Frame) -> Frame:
    return _rounded(_rounded(frame, ["cpu_usage", *USE], 15), ["rss", "vsize"])


@query(f"SELECT max(t) AS time_, 'p' || n AS pod_id, 'box' || n AS container, {PLACE_SQL}, {_use_sql('n', SPAN)} FROM {TELEMETRY} GROUP BY n, r, n_name")
def view_process_summary(e):
    return _use(views.container_process_summary(with_telemetry(e), FROM, TO))


@query(f"SELECT {WINDOW} AS time_, 'p' || n AS pod_id, 'box' || n AS container, {PLACE_SQL}, {_use_sql('n', f'{WEEK}::DOUBLE')} FROM {TELEMETRY} GROUP BY {WINDOW}, n, r, n_name")
def view_process_timeseries(e):
    return _use(views.container_process_timeseries(with_telemetry(e), FROM, TO, WEEK))


@query(f"SELECT max(t) AS time_, 'p' || n AS pod_id, {PLACE_SQL}, 1::BIGINT AS container_count, n + 1 AS pod_start_time, {POD_STATUS} AS pod_status, {_use_sql('n', SPAN)} FROM {TELEMETRY} GROUP BY n, r, n_name")
def view_pod_resources(e):
    return _use(views.pod_resource_stats(with_telemetry(e), FROM, TO))


def _net_sql(span: str) -> str:
    return ", ".join(f"round({x + 1} * (max(i) - min(i)) / {span}, 15) AS {c}_per_ns" for x, c in enumerate(views.NETWORK))


@query(f"SELECT max(t) AS time_, 'p' || n AS pod_id, {PLACE_SQL}, {_net_sql(SPAN)} FROM {TELEMETRY} GROUP BY n, r, n_name")
def view_network_summary(e):
    return _rounded(views.pod_network_summary(with_telemetry(e), FROM, TO), [f"{c}_per_ns" for c in views.NETWORK], 15)


@query(f"SELECT {WINDOW} AS time_, 'p' || n AS pod_id, {PLACE_SQL}, {_net_sql(f'{WEEK}::DOUBLE')} FROM {TELEMETRY} GROUP BY {WINDOW}, n, r, n_name")
def view_network_timeseries(e):
    return _rounded(views.pod_network_timeseries(with_telemetry(e), FROM, TO, WEEK), [f"{c}_per_ns" for c in views.NETWORK], 15)


HTTP_SQL = "sum(i % 50)::BIGINT AS latency_sum, count(*) AS num_requests, sum((i % 3 = 0)::INT)::BIGINT AS num_errors, sum(i % 11)::BIGINT AS req_bytes, sum(i % 13)::BIGINT AS resp_bytes"


@query(f"""SELECT max(t) AS time_, 'p' || n AS pod_id, {PLACE_SQL}, CASE WHEN k = 3 THEN '127.0.0.1' ELSE '10.0.0.' || ((n + 1) % 25) END AS requestor_ip, CASE WHEN k = 3 THEN '' ELSE 'ns/' || (SELECT any_value(x.n_name) FROM nation x WHERE x.n_nationkey = (n + 1) % 25) END AS requestor_pod,
CASE WHEN k = 3 THEN '' ELSE 'svc/' || (SELECT any_value(x.n_regionkey) FROM nation x WHERE x.n_nationkey = (n + 1) % 25) END AS requestor_service, {HTTP_SQL}, quantile_disc(i % 50, 0.5)::DOUBLE AS p50 FROM (SELECT *, CASE WHEN k = 3 THEN 3 ELSE 4 END AS kind FROM {TELEMETRY}) u(i, t, n, k0, r, n_name, k) WHERE k0 IN (3, 4, 5) GROUP BY n, r, n_name, k""")
def view_http_summary(e):
    df = views.inbound_http_summary(with_telemetry(e), FROM, TO)
    df["p50"] = call("pluck_float64", df["latency_quantiles"], "p50")
    return df.drop("latency_quantiles")


@query(f"""SELECT max(t) AS time_, a.n_name AS responder_pod, b.n_name AS requestor_pod, count(*) AS num_requests, sum((i % 3 = 0)::INT)::BIGINT AS num_errors FROM
(SELECT i, t, CASE WHEN k = 6 THEN (n + 1) % 25 ELSE n END AS x, CASE k WHEN 3 THEN n WHEN 6 THEN n ELSE (n + 1) % 25 END AS y, k = 3 AS home, k = 6 AS asked FROM {TELEMETRY} WHERE k > 2) JOIN nation a ON a.n_nationkey = x JOIN nation b ON b.n_nationkey = y GROUP BY a.n_name, b.n_name""")
def view_http_graph(e):
    df = views.http_graph(with_telemetry(e), FROM, TO)
    out = df.groupby(["responder_pod", "requestor_pod"]).agg(time_=("time_", agg("max")), num_requests=("num_requests", agg("sum")), num_errors=("num_errors", agg("sum")))
    out["responder_pod"], out["requestor_pod"] = call("strip_prefix", "ns/", out["responder_pod"]), call("strip_prefix", "ns/", out["requestor_pod"])
    return out


@query(f"SELECT {WINDOW} AS time_, 'p' || n AS pod_id, {PLACE_SQL}, 'box' || n AS container, count(*) AS num_requests, sum((i % 3 = 0)::INT)::BIGINT AS num_errors FROM {TELEMETRY} WHERE k IN (3, 4, 5) GROUP BY {WINDOW}, n, r, n_name")
def view_http_throughput(e):
    return views.inbound_http_throughput_timeseries(with_telemetry(e), FROM, TO, WEEK)


@query(f"SELECT {WINDOW} AS time_, 'p' || n AS pod_id, {PLACE_SQL}, {HTTP_SQL}, quantile_disc(i % 50, 0.9)::DOUBLE AS p90 FROM {TELEMETRY} WHERE k IN (3, 4, 5) GROUP BY {WINDOW}, n, r, n_name")
def view_http_latency(e):
    df = views.inbound_http_latency_timeseries(with_telemetry(e), FROM, TO, WEEK)
    df["p90"] = call("pluck_float64", df["latency_quantiles"], "p90")
    return df.drop("latency_quantiles")


# --- streams ----------------------------------------------------------------------------------------------------------


def _streamed(frame: Frame, name: str) -> DataFrame:
    """Runs a stream over all present files and reads what it wrote."""
    spark = frame.spark().sparkSession
    run = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/stream-{name}-{run}"
    q = streams.start(frame, f"{name}_{run}", f"{path}/out", f"{path}/log")
    q.awaitTermination()
    return spark.read.schema(frame.spark().schema).parquet(f"{path}/out")


@query("SELECT event_id, event_type FROM events WHERE value > 100.0")
def stream_filter(e):
    rows = e.stream("events")
    return _streamed(rows[rows["value"] > 100.0][["event_id", "event_type"]].stream(), "filter")


# --- composites in the shapes of TPC-H ---------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 6) AS sum_disc, round(avg(l_quantity), 9) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def tpch_q1(e):
    df = e.table("lineitem", ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "time_"], end_time="1998-09-02")
    df["disc"] = df["l_extendedprice"] * (1 - df["l_discount"])
    out = df.groupby(["l_returnflag", "l_linestatus"]).agg(sum_qty=("l_quantity", agg("sum")), sum_base=("l_extendedprice", agg("sum")), sum_disc=("disc", agg("sum")), avg_qty=("l_quantity", agg("mean")), n=("l_quantity", agg("count")))
    for c, places in (("sum_qty", 2), ("sum_base", 2), ("sum_disc", 6), ("avg_qty", 9)):
        out[c] = rounded(out[c], places)
    return out


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey""")
def tpch_q3(e):
    c = e.table("customer", ["c_custkey", "c_mktsegment"])
    o = c[c["c_mktsegment"] == "BUILDING"].merge(e.table("orders", ["o_orderkey", "o_custkey"]), "inner", "c_custkey", "o_custkey")
    df = o.merge(e.table("lineitem", ["l_orderkey", "l_extendedprice", "l_discount"]), "inner", "o_orderkey", "l_orderkey")
    df["revenue"] = df["l_extendedprice"] * (1 - df["l_discount"])
    out = df.groupby("l_orderkey").agg(revenue=("revenue", agg("sum")))
    out["revenue"] = rounded(out["revenue"], 6)
    return out


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY ALL""")
def tpch_q5(e):
    r = e.table("region", ["r_regionkey", "r_name"])
    n = r[r["r_name"] == "ASIA"].merge(e.table("nation", ["n_nationkey", "n_name", "n_regionkey"]), "inner", "r_regionkey", "n_regionkey")
    s = n.merge(e.table("supplier", ["s_suppkey", "s_nationkey"]), "inner", "n_nationkey", "s_nationkey")[["s_suppkey", "s_nationkey", "n_name"]]
    li = e.table("lineitem", ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"]).merge(s, "inner", "l_suppkey", "s_suppkey")
    o = e.table("orders", ["o_orderkey", "o_custkey"]).merge(e.table("customer", ["c_custkey", "c_nationkey"]), "inner", "o_custkey", "c_custkey")
    df = li.merge(o, "inner", ["l_orderkey", "s_nationkey"], ["o_orderkey", "c_nationkey"])
    df["revenue"] = df["l_extendedprice"] * (1 - df["l_discount"])
    out = df.groupby("n_name").agg(revenue=("revenue", agg("sum")))
    out["revenue"] = rounded(out["revenue"], 6)
    return out


@query("SELECT round(coalesce(sum(l_extendedprice * l_discount), 0), 6) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate <= TIMESTAMP '1994-12-31' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24")
def tpch_q6(e):
    df = e.table("lineitem", ["l_extendedprice", "l_discount", "l_quantity", "time_"], "1994-01-01", "1994-12-31")
    df = df[(df["l_discount"] >= 0.05) & (df["l_discount"] <= 0.07) & (df["l_quantity"] < 24)]
    df["revenue"] = df["l_extendedprice"] * df["l_discount"]
    out = df.agg(revenue=("revenue", agg("sum")))
    out["revenue"] = rounded(out["revenue"], 6)
    return out


@query("""SELECT c_custkey, c_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY ALL""")
def tpch_q10(e):
    li = e.table("lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"])
    li = li[li["l_returnflag"] == "R"]
    c = e.table("customer", ["c_custkey", "c_name", "c_nationkey"]).merge(e.table("nation", ["n_nationkey", "n_name"]), "inner", "c_nationkey", "n_nationkey")
    df = li.merge(e.table("orders", ["o_orderkey", "o_custkey"]), "inner", "l_orderkey", "o_orderkey").merge(c, "inner", "o_custkey", "c_custkey")
    df["revenue"] = df["l_extendedprice"] * (1 - df["l_discount"])
    out = df.groupby(["c_custkey", "c_name", "n_name"]).agg(revenue=("revenue", agg("sum")))
    out["revenue"] = rounded(out["revenue"], 6)
    return out

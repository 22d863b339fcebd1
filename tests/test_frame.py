import json

import pytest
from pyspark.sql import functions as F

from quillstream.functions import REGISTRY, CompileError, call
from quillstream.operators.metadata import Metadata
from quillstream.sources import otel
from quillstream.sources.engine import Engine
from quillstream.streaming import queries as streams

ROWS = [(1, 0.5, 6, 1, "sum"), (2, 1.2, 2, 1, "mean"), (3, 5.3, 12, 3, "sum"), (5, 0.1, 5, 1, "mean"), (6, 5.1, 60, 2, "sum"), (8, 5.2, 56, 2, "mean"), (9, 0.1, 12, 3, "sum"), (11, 7.3, 13, 2, "mean")]
A = REGISTRY


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, now=1_000_000_000_000)
    e.register("big", spark.createDataFrame(ROWS, "time_ bigint, col2 double, col3 bigint, num_groups bigint, string_groups string"))
    e.register("pairs", spark.createDataFrame([(0.5, 1), (1.2, 2), (5.3, 3), (0.1, 5), (5.1, 6)], "col1 double, col2 bigint"))
    return e


def rows(frame):
    return sorted(tuple(r) for r in frame.spark().collect())


def test_scan_map(engine):
    df = engine.table("pairs")
    df.res = df.col1 + df.col2
    assert [round(x[0], 6) for x in rows(df[["res"]])] == [1.5, 3.2, 5.1, 8.3, 11.1]


def test_time_range_is_inclusive(engine):
    assert len(rows(engine.table("big", start_time=2, end_time=9))) == 6
    assert rows(engine.table("big", start_time=100, end_time=200)) == []


def test_group_by_two_keys(engine):
    out = engine.table("big").groupby(["num_groups", "string_groups"]).agg(s=("col3", A["sum"]))
    assert rows(out) == [(1, "mean", 7), (1, "sum", 6), (2, "mean", 69), (2, "sum", 60), (3, "sum", 24)]


def test_global_aggregate(engine):
    out = engine.table("big").agg(n=("col2", A["count"]), lo=("col2", A["min"]), top=("col3", A["max"]), s=("col3", A["sum"]))
    assert rows(out) == [(8, 0.1, 60, 166)]


def test_aggregates_of_nothing(engine):
    df = engine.table("big")
    out = df[df.col3 > 1000].agg(n=("col2", A["count"]), s=("col3", A["sum"]))
    assert rows(out) == [(0, 0)]


def test_join_on_two_keys_and_self(engine):
    df = engine.table("pairs")
    out = df.merge(df, "inner", ["col1", "col2"], ["col1", "col2"], ["", "_x"])
    assert out.columns == ["col1", "col2", "col1_x", "col2_x"]
    assert len(rows(out)) == 5


def test_outer_joins_fill_with_zeros(engine, spark):
    left = engine.frame(spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string"))
    right = engine.frame(spark.createDataFrame([(2, 0.5), (3, 1.5)], "j bigint, w double"))
    assert rows(left.merge(right, "left", "k", "j")) == [(1, "a", 0, 0.0), (2, "b", 2, 0.5)]
    assert rows(left.merge(right, "right", "k", "j")) == [(0, "", 3, 1.5), (2, "b", 2, 0.5)]
    assert rows(left.merge(right, "outer", "k", "j")) == [(0, "", 3, 1.5), (1, "a", 0, 0.0), (2, "b", 2, 0.5)]
    assert (1, "a", None, None) in [tuple(r) for r in left.merge(right, "left", "k", "j", null_fill="null").spark().collect()]


def test_append(engine):
    df = engine.table("big", ["time_", "col3"])
    both = df.append(df[["col3", "time_"]], ordered=True)
    times = [r["time_"] for r in both.spark().collect()]
    assert times == sorted(times) and len(times) == 16


@pytest.mark.parametrize(
    ("build", "message"),
    [
        (lambda df: df.agg(("col2", A["sum"])), "named outputs"),
        (lambda df: df.agg(x="col2"), "tuple"),
        (lambda df: df.agg(x=("col2", A["add"])), "aggregate function"),
        (lambda df: df.agg(), "outputs or a groupby"),
        (lambda df: df.head("5"), "number of rows"),
        (lambda df: df[["col2", "col2"]], "kept twice"),
        (lambda df: df.groupby(["col2", 3]), "list of names"),
        (lambda df: df["nothing"], "no column"),
        (lambda df: df[df.col3], "BOOLEAN"),
        (lambda df: df.map("x"), "assign"),
        (lambda df: df.merge(df, "cross", "col2", "col2"), "no cross join"),
        (lambda df: df.merge(df, "inner", "col2", "col3"), "is FLOAT64 but"),
        (lambda df: df.merge(df, "inner", "col2", "col2", ["", ""]), "comes twice"),
        (lambda df: df.append(df[["col2"]]), "same columns"),
        (lambda df: df.head(2).stream(), "stream"),
        (lambda df: df.rolling("1m", on="col2"), "time_"),
        (lambda df: df.ctx["pod"], "metadata"),
    ],
)
def test_errors(engine, build, message):
    with pytest.raises(CompileError, match=message):
        build(engine.table("big"))


def test_rolling(engine):
    out = engine.table("big").rolling(5).agg(n=("col3", A["count"]))
    assert rows(out) == [(0, 3), (5, 4), (10, 1)]


def test_quantiles(engine):
    out = engine.table("big").agg(q=("col3", A["quantiles"]))
    out.p50 = call("pluck_float64", out.q, "p50")
    assert 6 <= rows(out[["p50"]])[0][0] <= 13


def test_quantiles_of_large_groups_are_exact(spark):
    """Ties, nulls, a group of nulls alone, and groups with more rows than the accuracy of a sketch."""
    rows_of = {"a": [(i * 7919) % 45_007 / 4 for i in range(45_007)], "b": [float(i % 3) for i in range(30_000)], None: [2.5], "d": [None]}
    table = spark.createDataFrame([(g, v) for g, values in rows_of.items() for v in [*values, None]], "g string, v double")
    engine = Engine(spark)
    engine.register("many", table)
    for by, groups in (("g", rows_of), (None, {0: sum(rows_of.values(), [])})):
        df = engine.table("many")
        out = (df.groupby(by) if by else df).agg(n=("v", A["count"]), q=("v", A["quantiles"])).spark()
        found = {r["g"] if by else 0: json.loads(r["q"]) for r in out.collect()}
        assert found.keys() == groups.keys()
        for g, values in groups.items():
            known = sorted(v for v in values if v is not None)
            assert found[g] == {f"p{p:02}": known[max(0, -(-p * len(known) // 100) - 1)] for p in (1, 10, 25, 50, 75, 90, 99) if known}


def test_script(engine):
    script = """
import q
'''A docstring.'''
def pick(groups: int):
    df = q.DataFrame('big', select=['col3', 'num_groups'])
    df.large = df.col3 >= 12 and not df.num_groups == 3
    return df[df.large and df.num_groups == groups]
q.display(pick(2), 'two')
q.display(pick(1), 'two')
q.debug(pick(2), 'dbg', ['col3'])
"""
    out = engine.run(script)
    assert list(out) == ["two", "two_1", "_dbg"]
    assert sorted(r[0] for r in out["_dbg"].collect()) == [13, 56, 60]
    again = engine.run(script, [("pick", {"groups": "2"}, "mine")])
    assert again["mine"].count() == 3
    with pytest.raises(CompileError, match="must be int"):
        engine.run(script, [("pick", {"groups": "x"}, "mine")])


@pytest.mark.parametrize("bad", ["while True: pass", "import q\nq.display(q.DataFrame('none'))", "x = 1", "import q\nq.nothing(1)", "import q\ndf = q.DataFrame('big')\ndf._df", "[x for x in y]", "import q\nq.display(3)", "f(*a)"])
def test_script_errors(engine, bad):
    with pytest.raises(CompileError):
        engine.run(bad)


def test_script_time_functions(engine):
    out = engine.run("import q\ndf = q.DataFrame('big')\ndf.a = q.parse_duration('-5m')\ndf.b = q.minutes(2)\ndf.c = q.now()\ndf.d = q.parse_time('-1s')\nq.display(df[['a', 'b', 'c', 'd']].head(1))")
    assert tuple(out["output"].first()) == (-300_000_000_000, 120_000_000_000, 10**12, 10**12 - 10**9)


def test_time_parsing():
    from quillstream.plans.timeparse import format_duration, parse_time, strptime

    assert [format_duration(x) for x in (5 * 86_400 * 10**9, 3 * 3600 * 10**9, -120 * 10**9, 7_000_000)] == ["5d", "3h", "-2m", "7ms"]
    assert parse_time("1970-01-01 00:00:01.5 +0000", 0) == 1_500_000_000
    assert strptime("2020-01-01", "%E4Y-%m-%d") == 1577836800 * 10**9


def test_restricted_and_limited(spark, engine):
    e = Engine(spark, max_rows=2, restricted={"t": {"secret": "all", "mail": "pii"}})
    e.register("t", spark.createDataFrame([("x", "a@b.org")] * 3, "secret string, mail string"))
    got = [tuple(r) for r in e.run("import q\nq.display(q.DataFrame('t'))")["output"].collect()]
    assert got == [("REDACTED", "<REDACTED_EMAIL>")] * 2


def test_metadata(spark, engine):
    md = Metadata(
        spark,
        {
            "process": spark.createDataFrame([((123 << 32 | 567, 89101), "cmd", "c1")], "upid struct<high:bigint,low:bigint>, cmdline string, container_id string"),
            "container": spark.createDataFrame([("c1", "box", "1_uid", "Running")], "container_id string, name string, pod_id string, state string"),
            "pod": spark.createDataFrame([("1_uid", "pl/running", "pl", '[{"uid":"rs0","kind":"ReplicaSet","name":"rs0"}]')], "pod_id string, name string, namespace string, owner_references string"),
            "service": spark.createDataFrame([("3_uid", "pl/a", ["1_uid"]), ("4_uid", "pl/b", ["1_uid"])], "service_id string, name string, pod_ids array<string>"),
            "replicaset": spark.createDataFrame([("rs0", "pl/rs0", "d0")], "replicaset_id string, name string, deployment_id string"),
            "deployment": spark.createDataFrame([("d0", "pl/dep")], "deployment_id string, name string"),
            "pod_ip": spark.createDataFrame([("1.1.1.1", "1_uid", 5, 50), ("1.1.1.1", "101_uid", 90, 0)], "ip string, pod_id string, start_time bigint, stop_time bigint"),
        },
        asid=123,
    )
    e = Engine(spark)
    e.metadata = md
    df = e.frame(spark.createDataFrame([((123 << 32 | 567, 89101), "1.1.1.1", 8), ((1, 1), "1.1.1.1", 4), ((1, 2), "1.1.1.1", 100)], "upid struct<high:bigint,low:bigint>, ip string, time_ bigint"))
    for name in ("pod", "service", "container", "deployment", "replica_set", "cmd", "pid", "namespace"):
        df[name] = df.ctx[name]
    df["at"] = REGISTRY["ip_to_pod_id"](df["ip"], df["time_"])
    found = {r["time_"]: r for r in df.spark().collect()}
    r = found[8]
    assert (r["pod"], r["service"], r["container"], r["deployment"], r["replica_set"], r["cmd"], r["pid"], r["namespace"]) == ("pl/running", '["pl/a","pl/b"]', "box", "pl/dep", "pl/rs0", "cmd", 567, "pl")
    assert [found[t]["at"] for t in (4, 8, 100)] == ["", "1_uid", "101_uid"]
    assert found[4]["pod"] == ""
    kept = df[df.ctx["pod"] == "pl/running"]
    assert kept.spark().count() == 1 and kept.spark().columns == df.columns


def test_otel(spark, engine):
    import json

    df = engine.frame(spark.createDataFrame([(7, '["a","b"]', 1.5)], "time_ bigint, svc string, v double"))
    data = otel.Data({"service.name": df["svc"]}, [otel.Gauge("g", df["v"]), otel.Span("s", df["time_"], df["time_"])])
    got = otel.records(df, data).collect()
    assert len(got) == 4
    assert {json.loads(r["resource"])["attributes"][0]["value"]["stringValue"] for r in got} == {"a", "b"}
    for r in got:
        assert json.loads(r["record"])
    with pytest.raises(CompileError, match="service.name"):
        otel.Data({}, [])


def test_stream(spark, tmp_path):
    e = Engine(spark)
    spark.createDataFrame(ROWS, "time_ bigint, col2 double, col3 bigint, num_groups bigint, string_groups string").write.parquet(str(tmp_path / "t"))
    e.register("t", str(tmp_path / "t"))
    df = e.stream("t")
    q = streams.start(df[df["col3"] > 10].stream(), "s1", str(tmp_path / "out"), str(tmp_path / "log"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_windows_and_sessions(spark):
    df = spark.createDataFrame([(0, "a"), (50, "a"), (400, "a")], "s bigint, k string").select(F.timestamp_seconds("s").alias("ts"), "k")
    assert streams.windowed(df, "ts", "1 minute", ["k"], [F.count("*").alias("n")]).count() == 2
    assert sorted(r["n"] for r in streams.sessions(df, "ts", "2 minutes", ["k"]).collect()) == [1, 2]


def test_two_step_groups_of_signed_zeros_and_nulls(spark):
    engine = Engine(spark)
    engine.register("t", spark.createDataFrame([(0.0, "a;b", 1), (-0.0, "a;c", 2), (None, "a;b", 4)], "k double, stack string, n bigint"))
    df = engine.table("t")
    df["period"] = 10
    out = df.groupby("k").agg(p=("stack", "n", "period", "pprof"), n=("n", "sum")).spark().collect()
    assert sorted(r["n"] for r in out) == [3, 4] and all(r["p"] for r in out)
    assert len(df.agg(p=("stack", "n", "period", "pprof")).spark().collect()) == 1


def test_flags_hold_for_one_run(spark):
    engine = Engine(spark)
    engine.register("t", spark.range(50).withColumnRenamed("id", "x"))
    script = "import q\ndf = q.DataFrame('t')\nq.display(df.groupby('x').agg(n=('x', q.count)), 'a')\n"
    assert engine.run("#q:set max_output_rows_per_table=3\n" + script)["a"].count() == 3
    assert engine.run(script)["a"].count() == 50 and not engine.plans
    engine.run("#q:set explain=true\n" + script)
    assert "HashAggregate" in engine.plans["a"] and "isFinalPlan=true" not in engine.plans["a"]
    engine.run("#q:set analyze=true\n" + script)
    assert "isFinalPlan=true" in engine.plans["a"]

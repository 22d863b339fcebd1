import json
import re
import math

import pytest

from quillstream.functions import REGISTRY, CompileError, call
from quillstream.session import ship
from quillstream.operators import metadata  # noqa: F401  (fills the registry)

CASES = [
    ('substring',('gridtables',4,20),'tables'),('substring',('abc',9,20),''),('substring',('abc',-1,2),''),('substring',('abc',0,-1),''),('find',('engine','hello'),-1),
    ('strip_prefix',('sock-shop/carts','sock-shop/carts123'),'123'),('hex_to_ascii',('333',),''),('hex_to_ascii',('6162',),'ab'),('bytes_to_hex',('abc',),r'\x61\x62\x63'),('atoi',('+1111111',0),1111111),('atoi',('not an int',1234),1234),
    ('pluck',('{"a": {"b": 1}, "c": 1.5, "d": 3, "n": null, "s":"x"}','a'),'{"b":1}'),('pluck',('{"c": 1.5}','c'),'1.5'),('pluck',('{"d": 3}','d'),'3'),('pluck',('{"n": null}','n'),''),('pluck',('[1]','a'),''),('pluck',('{bad','a'),''),
    ('pluck_int64',('{"d": 3}','d'),3),('pluck_int64',('{"d": 3.5}','d'),0),('pluck_int64',('{"d": "3"}','d'),0),('pluck_float64',('{"d": 3}','d'),0.0),('pluck_float64',('{"d": 3.5}','d'),3.5),('pluck_float64',('{"d": 10.0}','d'),10.0),
    ('pluck_array',('["a",{"b": 1}]',1),'{"b":1}'),('pluck_array',('["a"]',4),''),('split',('foo,bar,baz',','),'["foo","bar","baz"]'),('split',('foo,bar',';'),'["foo,bar"]'),
    ('regex_match',('.*','a\nb'),True),('regex_match',(r'\K','a'),False),('regex_match',('a','ab'),False),('replace',('a(.)','xabab',r'<\1>'),'x<b><b>'),('replace',(r'(','x','y'),'Invalid regex expr: ('),
    ('log',(2,4),2.0),('logicalOr',(4,0),True),('logicalAnd',(4,0),False),('divide',(1,0),float('inf')),('modulo',(-7,3),-1),('round',(2.71,1),'2.7'),('bin',(17,5),15),('add',(2**63-1,1),-2**63),('multiply',(2**62,4),0),
    ('uri_parse',('https://h.dev/community/?p=1&q=2#c',),'{"scheme":"https","host":"h.dev","path":"community/","query":"p=1&q=2","fragment":"c"}'),('uri_parse',('grpc://127.0.0.1:9876/stream',),'{"scheme":"grpc","host":"127.0.0.1","port":9876,"path":"stream"}'),('uri_parse',('http://127.0.0.1',),'{"scheme":"http","host":"127.0.0.1"}'),('uri_parse',('http://127.0.0.1:-1234',),'Failed to parse URI'),
    ('uri_recompose',('https','','h.dev',0,'community/','p=1','c'),'https://h.dev/community/?p=1#c'),('uri_recompose',('grpc','','127.0.0.1',9876,'path','',''),'grpc://127.0.0.1:9876/path'),('uri_recompose',('a','','b',-1,'','',''),'Failed to recompose URI'),
    ('_match_endpoint',('/a/b/c','/a/b/*'),True),('_match_endpoint',('/a/b/*','/a/b/c'),False),('_match_regex_rule',('{"one":"a+","two":"b+"}','bb'),'two'),
    ('protocol_name',(9999,),'Invalid (9999)'),('protocol_name',(10,),'Kafka'),('http_resp_message',(400,),'Bad Request'),('http_resp_message',(0,),'Unassigned'),('mysql_command_name',(0x17,),'StmtExecute'),('cql_opcode_name',(5,),'Options'),('amqp_method_name',(60,40),'BasicPublish'),('mux_frame_type_name',(-68,),'Rinit'),('dns_rcode_name',(3,),'NXDOMAIN'),('kafka_api_key_name',(9999,),'9999'),('amqp_frame_type_name',(8,),'Heartbeat'),
    ('cidrs_contain_ip',('["10.0.0.0/8"]','10.1.2.3'),True),('cidrs_contain_ip',('bad','10.1.2.3'),False),
    ('redact_pii_best_effort',('mail a.b@c.org from 10.0.0.1',),'mail <REDACTED_EMAIL> from <REDACTED_IPV4>'),
    ('normalize_pgsql',("SELECT * FROM test WHERE prop='abcd'",'Query'),'{"query":"SELECT * FROM test WHERE prop=$1","params":["\'abcd\'"],"error":""}'),
    ('normalize_mysql',("query=[SELECT * FROM test WHERE prop=? AND prop2='abcd'] params=[1234]",0x17),'{"query":"SELECT * FROM test WHERE prop=? AND prop2=?","params":["1234","\'abcd\'"],"error":""}'),
    ('has_value',('["3", "4"]','4'),True),('has_value',('1','1'),True),('has_value',('[]','4'),False),('select',(True,'a','b'),'a'),('trim',(' \t a \n',),'a'),('length',('é',),2),('toupper',('aé',),'Aé'),('equal',(0.1+0.2,0.3),True),('_script_reference',('l','s','a',1),'{"label":"l","script":"s","args":{"a":"1"}}'),('itoa',(5,),'5'),('ceil',(1.2,),2),('invert',(5,),-6),('ln',(0,),float('-inf')),
]


@pytest.fixture(scope="module")
def row(spark):
    ship(spark)
    return spark.range(1)


@pytest.mark.parametrize(("name", "args", "expected"), CASES)
def test_case(row, name, args, expected):
    found = row.select(call(name, *args).col.alias("x")).first()[0]
    assert found == expected


def test_nan(row):
    assert math.isnan(row.select(call("ln", -1).col).first()[0])
    assert math.isnan(row.select(call("divide", 0, 0).col).first()[0])


def test_wrong_types():
    with pytest.raises(CompileError, match="isn't defined for"):
        call("substring", 1, 2, 3)
    with pytest.raises(CompileError, match="no function"):
        call("nothing", 1)


def test_every_function_has_overloads():
    assert len(REGISTRY) > 150
    assert all(f.overloads for f in REGISTRY.values())


def test_path_clusters():
    from quillstream.functions.paths import build_clusters, predict

    six = build_clusters([f"/a/b/{i}" for i in range(6)])
    assert predict("/a/b/3", six) == "/a/b/*"
    assert predict("/a/b/new?x=1", six) == "/a/b/*"
    two = build_clusters(["/a/b/1", "/a/b/2"])
    assert predict("/a/b/1", two) == "/a/b/1"


@pytest.mark.parametrize(
    ("text", "redacted"),
    [
        ("card 4111 1111 1111 1111.", "card <REDACTED_CC_NUMBER>."),
        ("card 4111 1111 1111 1112.", "card 4111 1111 1111 1112."),
        ("iban GB82 WEST 1234 5698 7654 32", "iban <REDACTED_IBAN>"),
        ("mac 00:1B:44:11:3A:B7", "mac <REDACTED_MAC_ADDR>"),
        ("ip 2001:db8::ff00:42:8329 end", "ip <REDACTED_IPV6> end"),
        ("ssn 078-05-1120", "ssn <REDACTED_SSN>"),
        ("ssn 000-05-1120", "ssn 000-05-1120"),
        ("nothing here", "nothing here"),
    ],
)
def test_redact(text, redacted):
    from quillstream.functions.pii import redact

    assert redact(text) == redacted


def test_pprof():
    import base64

    from quillstream.functions.pprof import profile

    assert base64.b64decode(profile(["a;b", "a;c"], [1, 2], [10, 10]))
    assert profile(["a"] * 2, [1, 2], [10, 11]).startswith("Error")


def test_redaction_of_overlapping_finds():
    from quillstream.functions import pii

    tag = lambda n, pattern: (n, re.compile(pattern), pii.ANY)
    kept = pii.TAGGERS
    try:
        pii.TAGGERS = [tag("A", "aaa111"), tag("B", "11bbbb22"), tag("C", "22ccc")]
        assert pii.redact("x aaa111bbbb22ccc y") == "x aaa1<REDACTED_B>ccc y"
        pii.TAGGERS = [tag("A", "aaa11111"), tag("B", "11bb22"), tag("C", "22cccccc")]
        assert pii.redact("x aaa11111bb22cccccc y") == "x <REDACTED_A>bb<REDACTED_C> y"
    finally:
        pii.TAGGERS = kept


def test_path_clusters_of_parts():
    from quillstream.functions.paths import build_clusters, merge_clusters

    paths = [f"/a/{i}/x" for i in range(20)] + [f"/b/{i}" for i in range(3)] + ["/c/d/e/f"]
    whole = json.loads(build_clusters(sorted(paths)))
    parts = json.loads(merge_clusters([build_clusters(sorted(paths[i::3])) for i in range(3)]))
    assert {x["c"] for x in whole} == {x["c"] for x in parts} and merge_clusters([build_clusters(paths)]) == build_clusters(paths)

"""Network functions and the names of protocol codes."""

from __future__ import annotations

import functools
import http
import ipaddress
import json
import socket

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import BOOLEAN, INT64, STRING, UINT128, Value, define


def _numbered(text: str, start: int = 0) -> dict[int, str]:
    return {i: n for i, n in enumerate(text.split(), start)}


PROTOCOLS = _numbered("Unknown HTTP HTTP2 MySQL CQL PGSQL DNS Redis NATS Mongo Kafka") | {12: "AMQP"}
KAFKA = _numbered(
    """Produce Fetch ListOffsets Metadata LeaderAndIsr StopReplica UpdateMetadata ControlledShutdown OffsetCommit OffsetFetch
FindCoordinator JoinGroup Heartbeat LeaveGroup SyncGroup DescribeGroups ListGroups SaslHandshake ApiVersions CreateTopics DeleteTopics DeleteRecords
InitProducerId OffsetForLeaderEpoch AddPartitionsToTxn AddOffsetsToTxn EndTxn WriteTxnMarkers TxnOffsetCommit DescribeAcls CreateAcls DeleteAcls
DescribeConfigs AlterConfigs AlterReplicaLogDirs DescribeLogDirs SaslAuthenticate CreatePartitions CreateDelegationToken RenewDelegationToken
ExpireDelegationToken DescribeDelegationToken DeleteGroups ElectLeaders IncrementalAlterConfigs AlterPartitionReassignments
ListPartitionReassignments OffsetDelete DescribeClientQuotas AlterClientQuotas DescribeUserScramCredentials AlterUserScramCredentials"""
) | {56: "AlterIsr", 57: "UpdateFeatures", 60: "DescribeCluster", 61: "DescribeProducers"}
MYSQL = _numbered(
    """Sleep Quit InitDB Query FieldList CreateDB DropDB Refresh Shutdown Statistics ProcessInfo Connect ProcessKill Debug Ping Time
DelayedInsert ChangeUser BinlogDump TableDump ConnectOut RegisterSlave StmtPrepare StmtExecute StmtSendLongData StmtClose StmtReset SetOption StmtFetch
Daemon BinlogDumpGTID ResetConnection"""
)
CQL = dict(zip([0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16], "Error Startup Ready Authenticate Options Supported Query Result Prepare Execute Register Event Batch AuthChallenge AuthResponse AuthSuccess".split()))
DNS = _numbered("NOERROR FORMERR SERVFAIL NXDOMAIN NOTIMP REFUSED YXDOMAIN YXRRSET NXRRSET NOTAUTH NOTZONE DSOTYPENI") | _numbered("BADVERS BADKEY BADTIME BADMODE BADNAME BADALG BADTRUNC BADCOOKIE", 16)
MUX = {1: "Treq", -1: "Rreq", 2: "Tdispatch", -2: "Rdispatch", 64: "Tdrain", -64: "Rdrain", 65: "Tping", -65: "Rping", 66: "Tdiscarded", -66: "Rdiscarded", 67: "Tlease", 68: "Tinit", -68: "Rinit", -128: "Rerr", 127: "Rerr (legacy)", -62: "Tdiscarded (legacy)"}
AMQP_FRAMES = {1: "Frame method", 2: "Content Header", 3: "Content Body", 8: "Heartbeat"}
AMQP_CLASSES = {10: "Connection", 20: "Channel", 40: "Exchange", 50: "Queue", 60: "Basic", 90: "Tx"}
AMQP_METHODS = {
    10: "10 Start 11 Start-ok 20 Secure 21 Secure-ok 30 Tune 31 Tune-ok 40 Open 41 Open-ok 50 Close 51 Close-ok",
    20: "10 Open 11 Open-ok 20 Flow 21 Flow-ok 40 Close 41 Close-ok",
    40: "10 Declare 11 Declare-ok 20 Delete 21 Delete-ok",
    50: "10 Declare 11 Declare-ok 20 Bind 21 Bind-ok 30 Purge 31 Purge-ok 40 Delete 41 Delete-ok 50 Unbind 51 Unbind-ok",
    60: "10 Qos 11 Qos-ok 20 Consume 21 Consume-ok 30 Cancel 31 Cancel-ok 40 Publish 50 Return 60 Deliver 70 Get 71 Get-ok 72 Get-empty 80 Ack 90 Reject 100 Recover-async 110 Recover 111 Recover-ok",
    90: "10 Select 11 Select-ok 20 Commit 21 Commit-ok 30 Rollback 31 Rollback-ok",
}
HTTP = {s.value: s.phrase for s in http.HTTPStatus} | {
    203: "Non-Authoritative Information", 306: "(Unused)", 413: "Payload Too Large", 414: "URI Too Long", 416: "Range Not Satisfiable", 422: "Unprocessable Entity", 505: "HTTP Version Not Supported",
}
HTTP.pop(418, None)
GRPC = _numbered("OK CANCELLED UNKNOWN INVALID_ARGUMENT DEADLINE_EXCEEDED NOT_FOUND ALREADY_EXISTS PERMISSION_DENIED RESOURCE_EXHAUSTED FAILED_PRECONDITION ABORTED OUT_OF_RANGE UNIMPLEMENTED INTERNAL UNAVAILABLE DATA_LOSS UNAUTHENTICATED")


def _names(table: dict[int, str], code: Column) -> Column:
    found = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    return F.try_element_at(found, code.cast("int"))


def _plain(name: str, table: dict[int, str], other=None):
    @define(name, ((INT64,), STRING))
    def build(code: Value) -> Column:
        return F.coalesce(_names(table, code.col), other(code.col) if other else code.col.cast("string"))

    return build


_plain("protocol_name", PROTOCOLS, lambda c: F.concat(F.lit("Invalid ("), c.cast("string"), F.lit(")")))
_plain("http_resp_message", HTTP, lambda c: F.lit("Unassigned"))
_plain("kafka_api_key_name", KAFKA)
_plain("mysql_command_name", MYSQL)
_plain("cql_opcode_name", CQL)
_plain("dns_rcode_name", DNS)
_plain("mux_frame_type_name", MUX, lambda c: F.concat(F.lit("Unknown ("), c.cast("string"), F.lit(")")))
_plain("amqp_frame_type_name", AMQP_FRAMES, lambda c: F.lit("Unknown"))
_plain("grpc_status_code_to_str", GRPC, lambda c: F.lit("unknown code"))


@define("amqp_method_name", ((INT64, INT64), STRING))
def amqp_method_name(class_id: Value, method_id: Value) -> Column:
    """The class and method of an AMQP frame; method 0 gives the class alone."""
    table = {}
    for c, name in AMQP_CLASSES.items():
        words = AMQP_METHODS[c].split()
        table |= {c * 1000 + int(m): name + what for m, what in zip(words[::2], words[1::2])}
        table[c * 1000] = name
    return F.coalesce(_names(table, class_id.col * 1000 + method_id.col), F.lit("Unknown"))


@functools.lru_cache(maxsize=256)
def _networks(cidrs: str) -> list | None:
    try:
        return [ipaddress.ip_network(c, strict=False) for c in json.loads(cidrs)]
    except (ValueError, TypeError):
        return None


@define("cidrs_contain_ip", ((STRING, STRING), BOOLEAN))
def cidrs_contain_ip(cidrs: Value, ip: Value) -> Column:
    """Whether an address lies in one of the networks of a JSON list; false if anything can't be parsed."""

    @F.pandas_udf("boolean")
    def run(lists: pd.Series, addresses: pd.Series) -> pd.Series:
        def one(cidr_list: str, address: str) -> bool:
            try:
                nets, at = _networks(cidr_list), ipaddress.ip_address(address)
            except ValueError:
                return False
            return nets is not None and any(at.version == n.version and at in n for n in nets)

        return pd.Series([one(c, a) for c, a in zip(lists, addresses)], dtype=bool)

    return run(cidrs.col, ip.col)


@define("nslookup", ((STRING,), STRING))
def nslookup(ip: Value) -> Column:
    """The host name of an address by reverse lookup, or the address."""

    @F.pandas_udf("string")
    def run(addresses: pd.Series) -> pd.Series:
        @functools.lru_cache(maxsize=4096)
        def one(a: str) -> str:
            try:
                return socket.gethostbyaddr(a)[0]
            except OSError:
                return a

        return addresses.map(one, na_action="ignore")

    return run(ip.col)


@define("shared_libraries", ((UINT128,), STRING))
def shared_libraries(upid: Value) -> Column:
    """Shared libraries of a process: host access is out of a cluster query's reach, so an empty list."""
    return F.when(upid.col.isNotNull(), F.lit("[]"))

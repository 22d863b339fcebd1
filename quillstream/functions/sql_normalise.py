"""Normalises SQL statements: constants become placeholders, and are returned beside the query as JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import INT64, STRING, Value, define

QUERY, EXECUTE = "Query", "Execute"
MYSQL_QUERY, MYSQL_EXECUTE = 3, 0x17

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<string>(?:[eExXbBnN]|[uU]&)?'(?:[^'\\]|\\.|'')*')
      | (?P<dollar>\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$)
      | (?P<param>\$[0-9]+|\?)
      | (?P<name>"(?:[^"]|"")*"|`[^`]*`|@{1,2}[\w.]*|[A-Za-z_\x80-\U0010ffff][\w$]*)
      | (?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|0[xX][0-9a-fA-F]+)
      | (?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)
CALL = re.compile(r"\s*query=\[(?P<query>.*)\]\s*params=\[(?P<params>.*)\]\s*", re.DOTALL)


class Unparsable(ValueError):
    pass


def split_params(text: str) -> list[str]:
    """The comma-separated constants of a parameter list, quotes respected."""
    out, depth, current, quote = [], 0, "", ""
    for c in text:
        if quote:
            current += c
            quote = "" if c == quote else quote
            continue
        if c in "'\"":
            quote = c
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(current.strip())
            current = ""
        else:
            current += c
    if current.strip() or out:
        out.append(current.strip())
    return out


def normalise(query: str, given: list[str], mysql: bool) -> tuple[str, list[str]]:
    """The query with all constants as placeholders, and the constants in the order of the placeholders."""
    out: list[str] = []
    params: list[str] = []
    numbers: dict[str, int] = {}
    taken = 0
    depth = 0

    def put(constant: str) -> None:
        params.append(constant)
        out.append("?" if mysql else f"${len(params)}")

    for m in TOKEN.finditer(query):
        kind, text = m.lastgroup, m.group()
        if kind == "tag" or kind == "dollar":
            kind = "string"
        if kind == "other":
            if text in "'\"`":
                raise Unparsable(f"unterminated {text}")
            depth += (text == "(") - (text == ")")
            if depth < 0:
                raise Unparsable("unbalanced parentheses")
        if kind in ("string", "number") or kind == "name" and text.lower() in ("true", "false", "null") and not _is_test(out):
            put(text)
        elif kind == "name" and mysql and text.startswith('"'):
            put(text)
        elif kind == "param":
            if mysql:
                at, taken = taken, taken + 1
            else:
                at = int(text[1:]) - 1 if text != "?" else taken
            if not 0 <= at < len(given):
                raise Unparsable(f"no parameter for {text}")
            if not mysql and text in numbers:
                out.append(f"${numbers[text]}")
            else:
                put(given[at])
                numbers[text] = len(params)
        else:
            out.append(text)
    if depth:
        raise Unparsable("unbalanced parentheses")
    return "".join(out), params


def _is_test(out: list[str]) -> bool:
    """Whether NULL, TRUE or FALSE comes after IS or NOT (a test or a column constraint, not a constant)."""
    return next((x for x in reversed(out) if x.strip()), "").lower() in ("is", "not", "default")


def to_json(sql: str, execute: bool, mysql: bool) -> str:
    given: list[str] = []
    if execute:
        m = CALL.fullmatch(sql)
        if not m:
            return json.dumps({"query": "", "params": [], "error": "Failed to parse the query and its parameters"})
        sql, given = m["query"], split_params(m["params"])
    try:
        query, params = normalise(sql, given, mysql)
    except Unparsable as e:
        return json.dumps({"query": "", "params": [], "error": str(e)}, ensure_ascii=False)
    return json.dumps({"query": query, "params": params, "error": ""}, ensure_ascii=False, separators=(",", ":"))


@define("normalize_pgsql", ((STRING, STRING), STRING))
def normalize_pgsql(sql: Value, command: Value) -> Column:
    """A PostgreSQL statement with $n placeholders; only Query and Execute commands have one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, commands: pd.Series) -> pd.Series:
        return pd.Series([to_json(t or "", c == EXECUTE, False) if c in (QUERY, EXECUTE) else "" for t, c in zip(texts, commands)])

    return run(sql.col, command.col)


@define("normalize_mysql", ((STRING, INT64), STRING))
def normalize_mysql(sql: Value, command: Value) -> Column:
    """A MySQL statement with ? placeholders; only the query and execute commands have one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, commands: pd.Series) -> pd.Series:
        return pd.Series([to_json(t or "", c == MYSQL_EXECUTE, True) if c in (MYSQL_QUERY, MYSQL_EXECUTE) else "" for t, c in zip(texts, commands)])

    return run(sql.col, command.col)

"""String, JSON, URI and regular-expression functions. Offsets count characters; length counts UTF-8 bytes."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import BOOLEAN, FLOAT64, INT64, STRING, CompileError, Value, constant, define

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _empty() -> Column:
    return F.lit("")


@define("contains", ((STRING, STRING), BOOLEAN))
def contains(s: Value, part: Value) -> Column:
    """Whether the string has the other one in it."""
    return F.lit(True) if part.const == "" else F.contains(s.col, part.col)


@define("length", ((STRING,), INT64))
def length(s: Value) -> Column:
    """Length in bytes."""
    return F.octet_length(s.col).cast("long")


@define("find", ((STRING, STRING), INT64))
def find(s: Value, part: Value) -> Column:
    """Offset of the first occurrence from 0, or -1."""
    return (F.instr(s.col, part.col) - 1).cast("long")


@define("substring", ((STRING, INT64, INT64), STRING))
def substring(s: Value, start: Value, size: Value) -> Column:
    """So many characters from an offset; empty if the offset is outside or the size negative."""
    bad = (start.col < 0) | (start.col > F.char_length(s.col)) | (size.col < 0)
    return F.when(bad, _empty()).otherwise(F.substring(s.col, (start.col + 1).cast("int"), F.greatest(size.col, F.lit(0)).cast("int")))


@define("tolower", ((STRING,), STRING))
def tolower(s: Value) -> Column:
    """A to Z in lower case."""
    return F.translate(s.col, UPPER, LOWER)


@define("toupper", ((STRING,), STRING))
def toupper(s: Value) -> Column:
    """a to z in upper case."""
    return F.translate(s.col, LOWER, UPPER)


@define("trim", ((STRING,), STRING))
def trim(s: Value) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(s.col, F.lit(" \t\n\x0b\x0c\r"))


@define("strip_prefix", ((STRING, STRING), STRING))
def strip_prefix(prefix: Value, s: Value) -> Column:
    """The string without a prefix, if it has it."""
    return F.when(F.startswith(s.col, prefix.col), F.substring(s.col, F.char_length(prefix.col) + 1, F.char_length(s.col))).otherwise(s.col)


@define("hex_to_ascii", ((STRING,), STRING))
def hex_to_ascii(s: Value) -> Column:
    """The text that hex digits stand for; empty if they are invalid."""
    return F.when(s.col.rlike("^([0-9a-fA-F]{2})*$"), F.try_to_binary(s.col, F.lit("hex")).cast("string")).otherwise(_empty())


@define("bytes_to_hex", ((STRING,), STRING))
def bytes_to_hex(s: Value) -> Column:
    r"""Bytes as \x61\x62."""
    return F.regexp_replace(F.lower(F.hex(s.col)), "(..)", r"\\x$1")


@define("atoi", ((STRING, INT64), INT64))
def atoi(s: Value, default: Value) -> Column:
    """The integer that the string is, or the default."""
    return F.coalesce(F.when(F.trim(s.col).rlike(r"^[+-]?[0-9]+$"), F.trim(s.col).try_cast("long")), default.col)


@define("itoa", ((INT64,), STRING))
def itoa(v: Value) -> Column:
    """The integer as text."""
    return v.col.cast("string")


# --- JSON -----------------------------------------------------------------------------------------------------------


def _member(text: Value, key: Value) -> tuple[Column, Column]:
    """A top-level member of a JSON object as a variant, and its kind; both null if there is none."""
    if key.const is None:
        raise CompileError("the key must be a constant")
    path = "$[" + json.dumps(str(key.const), ensure_ascii=False) + "]"
    whole = F.when(F.ltrim(text.col).startswith("{"), F.try_parse_json(text.col))
    member = F.try_variant_get(whole, path, "variant")
    return member, F.schema_of_variant(member)


@define("pluck", ((STRING, STRING), STRING))
def pluck(text: Value, key: Value) -> Column:
    """A top-level member of a JSON object as text; empty for bad JSON, a missing key or null."""
    name = str(constant(key, "the key"))
    if "'" in name or "\\" in name:
        member, _ = _member(text, key)
        return F.coalesce(F.try_variant_get(member, "$", "string"), _empty())
    return F.coalesce(F.when(F.ltrim(text.col).startswith("{"), F.get_json_object(text.col, f"$['{name}']")), _empty())


@define("pluck_int64", ((STRING, STRING), INT64))
def pluck_int64(text: Value, key: Value) -> Column:
    """An integer member of a JSON object; 0 if it is missing or anything else."""
    member, kind = _member(text, key)
    return F.coalesce(F.when(kind == "BIGINT", F.try_variant_get(member, "$", "bigint")), F.lit(0).cast("long"))


@define("pluck_float64", ((STRING, STRING), FLOAT64))
def pluck_float64(text: Value, key: Value) -> Column:
    """A member of a JSON object that is written as a float; 0.0 if it is missing or anything else, integers included."""
    member, kind = _member(text, key)
    return F.coalesce(F.when((kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(member, "$", "double")), F.lit(0.0))


@define("pluck_array", ((STRING, INT64), STRING))
def pluck_array(text: Value, index: Value) -> Column:
    """An element of a JSON array as text; empty if there is none."""
    array = F.when(F.ltrim(text.col).startswith("["), F.from_json(text.col, "array<string>"))
    return F.coalesce(F.when(index.col >= 0, F.get(array, index.col.cast("int"))), _empty())


@define("split", ((STRING, STRING), STRING))
def split(text: Value, delimiter: Value) -> Column:
    """The pieces between a delimiter, as a JSON array."""
    mark = constant(delimiter, "the delimiter")
    return F.to_json(F.split(text.col, "\\Q" + str(mark).replace("\\E", "\\E\\\\E\\Q") + "\\E", -1))


@define("_script_reference", ((STRING, STRING), STRING), variadic=True)
def script_reference(label: Value, script: Value, *args: Value) -> Column:
    """A link to another script as JSON: label, script and arguments by name."""
    names = [str(constant(a, "an argument's name")) for a in args[::2]]
    fields = [v.col.cast("string").alias(n) for n, v in zip(names, args[1::2])]
    inner = F.struct(*fields) if fields else F.from_json(F.lit("{}"), "struct<>")
    return F.to_json(F.struct(label.col.alias("label"), script.col.alias("script"), inner.alias("args")))


# --- URI ------------------------------------------------------------------------------------------------------------

URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
BAD_URI = r"[\x00-\x20\x7f\"<>\\^`{|}]|%(?![0-9A-Fa-f]{2})"


@define("uri_parse", ((STRING,), STRING))
def uri_parse(uri: Value) -> Column:
    """The parts of a URI as JSON; a path below a host is given without its leading slash."""
    s = uri.col
    part = lambda i: F.regexp_extract(s, URI, i)
    given = lambda c: F.when(c != "", c)
    authority = part(2)
    has_host = s.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    user = F.when(F.contains(authority, F.lit("@")), F.substring_index(authority, "@", 1))
    place = F.when(F.contains(authority, F.lit("@")), F.substring(authority, F.instr(authority, "@") + 1, F.char_length(authority))).otherwise(authority)
    host = F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1)
    port = F.substring(place, F.char_length(host) + 1, F.char_length(place))
    path = F.when(has_host, F.regexp_replace(part(3), "^/", "")).otherwise(F.regexp_replace(part(3), "^/", ""))
    fields = F.struct(
        given(part(1)).alias("scheme"),
        user.alias("userInfo"),
        F.when(has_host, F.regexp_replace(host, r"^\[|\]$", "")).alias("host"),
        F.when(port.rlike("^:[0-9]+$"), F.substring(port, F.lit(2), F.char_length(port)).try_cast("long")).alias("port"),
        F.when(part(3) != "", path).alias("path"),
        F.when(s.rlike(r"^[^#]*\?"), part(4)).alias("query"),
        F.when(F.contains(s, F.lit("#")), part(5)).alias("fragment"),
    )
    bad = s.rlike(BAD_URI) | ((port != "") & ~port.rlike("^:[0-9]*$"))
    return F.when(bad, F.lit("Failed to parse URI")).otherwise(F.to_json(fields))


@define("uri_recompose", ((STRING, STRING, STRING, INT64, STRING, STRING, STRING), STRING))
def uri_recompose(scheme: Value, user: Value, host: Value, port: Value, path: Value, query: Value, fragment: Value) -> Column:
    """A URI from its parts; empty parts and port 0 are left out, a negative port is an error text."""
    opt = lambda c, whole: F.when(c != "", whole).otherwise(_empty())
    whole = F.concat(
        opt(scheme.col, F.concat(scheme.col, F.lit(":"))), opt(host.col, F.lit("//")), opt(user.col, F.concat(user.col, F.lit("@"))), host.col,
        F.when(port.col > 0, F.concat(F.lit(":"), port.col.cast("string"))).otherwise(_empty()), F.lit("/"), path.col,
        opt(query.col, F.concat(F.lit("?"), query.col)), opt(fragment.col, F.concat(F.lit("#"), fragment.col)),
    )
    return F.when(port.col < 0, F.lit("Failed to recompose URI")).otherwise(whole)


# --- regular expressions --------------------------------------------------------------------------------------------

NOT_LINEAR = re.compile(r"\\[1-9]|\(\?(?:=|!|<=|<!|>)|\\[KGZR]|[+*?}]\+")


def linear_regex(pattern: str) -> str | None:
    """The pattern if a linear-time engine takes it: no back-references, lookaround or possessive forms, and it parses."""
    if NOT_LINEAR.search(pattern):
        return None
    try:
        re.compile(re.sub(r"\(\?P?<", "(?P<", pattern).replace("\\z", "\\Z").replace("\\Q", "").replace("\\E", ""))
    except re.error:
        return None
    return pattern.replace("(?P<", "(?<")


@define("regex_match", ((STRING, STRING), BOOLEAN))
def regex_match(pattern: Value, s: Value) -> Column:
    """Whether the whole string matches; the dot matches line ends; an invalid pattern matches nothing."""
    found = linear_regex(str(constant(pattern, "the pattern")))
    return F.lit(False) if found is None else s.col.rlike(rf"\A(?s:{found})\z")


@define("replace", ((STRING, STRING, STRING), STRING))
def replace(pattern: Value, s: Value, by: Value) -> Column:
    r"""All matches replaced; \1 stands for a group; an invalid pattern gives an error text."""
    text = str(constant(pattern, "the pattern"))
    found = linear_regex(text)
    if found is None:
        return F.lit(f"Invalid regex expr: {text}")
    to = str(constant(by, "the substitution"))
    groups = re.compile(re.sub(r"\(\?<", "(?P<", found)).groups
    out, i = [], 0
    while i < len(to):
        c = to[i]
        if c == "\\" and i + 1 < len(to):
            i += 1
            if to[i].isdigit():
                if int(to[i]) > groups:
                    return F.lit(f"Invalid substitution: {to}")
                out.append(f"${to[i]}")
            elif to[i] == "\\":
                out.append("\\\\")
            else:
                return F.lit(f"Invalid substitution: {to}")
        else:
            out.append("\\$" if c == "$" else c)
        i += 1
    return F.regexp_replace(s.col, F.lit(found), F.lit("".join(out)))


@define("_match_regex_rule", ((STRING, STRING), STRING))
def match_regex_rule(rules: Value, s: Value) -> Column:
    """The name of the first rule (a JSON object of name and pattern) that matches the whole string, else nothing."""
    try:
        found = json.loads(str(constant(rules, "the rules")))
    except ValueError as e:
        raise CompileError("the rules aren't JSON") from e
    out = _empty()
    for name, pattern in reversed(list(found.items())):
        if linear := linear_regex(pattern):
            out = F.when(s.col.rlike(rf"\A(?s:{linear})\z"), F.lit(name)).otherwise(out)
    return out


@define("_match_endpoint", ((STRING, STRING), BOOLEAN))
def match_endpoint(path: Value, template: Value) -> Column:
    """Whether a request path fits a template of the same depth; * stands for any segment, the query is ignored."""
    cut = lambda c: F.split(F.regexp_replace(F.substring_index(c, "?", 1), "^/", ""), "/", -1)
    p, t = cut(path.col), cut(template.col)
    return (F.size(p) == F.size(t)) & F.forall(F.zip_with(p, t, lambda x, y: (y == "*") | x.eqNullSafe(y)), lambda ok: ok)

"""Constant time functions: units, durations, absolute times."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from ..functions.core import CompileError

NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}
DURATION = re.compile(r"([-]?[0-9]+)(ms|m|s|h|d)")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def parse_duration(text: str) -> int:
    """Nanoseconds of a text such as 5m or -30s, found anywhere in it."""
    m = DURATION.search(text)
    if not m:
        raise CompileError(f"{text!r} isn't a duration")
    return int(m[1]) * NS[m[2]]


def format_duration(ns: int) -> str:
    """The duration in its largest unit, truncated: 5d, 3h, -2m, 7ms."""
    for unit in ("d", "h", "m", "s", "ms"):
        if abs(ns) >= NS[unit] or unit == "ms":
            return f"{int(ns / NS[unit])}{unit}"
    raise AssertionError


def nanoseconds(moment: datetime) -> int:
    delta: timedelta = (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)) - EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000_000 + delta.microseconds * 1_000


def strptime(text: str, form: str) -> int:
    """Nanoseconds of a text in a strptime format, with %E4Y and %E*S for years and fractional seconds."""
    form = form.replace("%E4Y", "%Y")
    fraction = 0
    if "%E*S" in form:
        form = form.replace("%E*S", "%S")
        if m := re.search(r"(:[0-9]{2})\.([0-9]+)", text):
            fraction = int((m[2] + "0" * 9)[:9])
            text = text[: m.start(2) - 1] + text[m.end(2) :]
    try:
        return nanoseconds(datetime.strptime(text, form)) + fraction
    except ValueError as e:
        raise CompileError(str(e)) from e


def parse_time(when: int | str, now: int) -> int:
    """Nanoseconds of a number, a duration relative to now, or an absolute time."""
    if isinstance(when, int):
        return when
    if re.fullmatch(r"\s*[-]?[0-9]+(ms|m|s|h|d)\s*", when):
        return now + parse_duration(when)
    for form in ("%E4Y-%m-%d %H:%M:%E*S %z", "%E4Y-%m-%d %H:%M:%E*S", "%E4Y-%m-%dT%H:%M:%E*S%z", "%E4Y-%m-%d"):
        try:
            return strptime(when, form)
        except CompileError:
            continue
    raise CompileError(f"{when!r} is neither a time nor a duration")

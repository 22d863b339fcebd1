"""Profiles in the pprof protobuf layout, gzip-free and as base64 text, from folded stack traces."""

from __future__ import annotations

import base64
import json
from collections import Counter
from collections.abc import Iterable


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def count_part(stacks: Iterable[str], counts: Iterable[int], periods: Iterable[int]) -> str:
    """What a part of a group contributes: its counts by stack and its periods, as JSON."""
    total: Counter = Counter()
    for stack, n in zip(stacks, counts):
        total[stack] += int(n)
    return json.dumps([dict(total), sorted({int(p) for p in periods})])


def merge_parts(parts: Iterable[str]) -> str:
    """The profile of a group from its parts."""
    stacks, counts, periods = [], [], []
    for total, some in map(json.loads, parts):
        stacks += total
        counts += total.values()
        periods += some
    if len(set(periods)) > 1:
        return profile(["a"] * len(periods), [0] * len(periods), periods)
    return profile(stacks, counts, periods[:1] * len(stacks))


def profile(stacks: Iterable[str], counts: Iterable[int], periods: Iterable[int]) -> str:
    """Sample types (samples, count) and (cpu, nanoseconds); frames are joined by ';', the leaf last."""
    total: Counter = Counter()
    seen = set()
    for stack, n, period in zip(stacks, counts, periods):
        total[stack] += int(n)
        seen.add(int(period))
    if len(seen) > 1:
        return "Error: the sampling periods differ: " + ", ".join(map(str, sorted(seen)))
    period = (seen.pop() if seen else 0) * 1_000_000
    strings: dict[str, int] = {"": 0}
    name = lambda s: strings.setdefault(s, len(strings))
    kinds = [(name("samples"), name("count")), (name("cpu"), name("nanoseconds"))]
    frames: dict[str, int] = {}
    samples = []
    for stack, n in sorted(total.items()):
        ids = [frames.setdefault(f, len(frames) + 1) for f in reversed(stack.split(";"))]
        samples.append(_block(2, b"".join(_number(1, i) for i in ids) + _number(2, n) + _number(2, n * period)))
    out = b"".join(_block(1, _number(1, a) + _number(2, b)) for a, b in kinds) + b"".join(samples)
    for frame, i in frames.items():
        out += _block(4, _number(1, i) + _block(4, _number(1, i)))
    for frame, i in frames.items():
        out += _block(5, _number(1, i) + _number(2, name(frame)) + _number(3, name(frame)))
    out += b"".join(_block(6, s.encode()) for s in strings)
    out += _block(11, _number(1, kinds[1][0]) + _number(2, kinds[1][1])) + _number(12, period)
    return base64.b64encode(out).decode()

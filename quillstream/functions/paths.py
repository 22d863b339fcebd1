"""Clusters of request paths: paths of one depth whose segments mostly agree share a template with wildcards."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import STRING, Value, define

WILD = "*"
LEAST_ALIKE = 0.5
MEMBERS_KEPT = 5


def segments(path: str) -> tuple[str, ...]:
    bare = path.split("?", 1)[0]
    return tuple(bare.removeprefix("/").split("/"))


def text(parts: tuple[str, ...]) -> str:
    return "/" + "/".join(parts)


def alike(centre: tuple[str, ...], path: tuple[str, ...]) -> float:
    """The share of segments that are equal and no wildcards; 0 for another depth."""
    if len(centre) != len(path):
        return 0.0
    return sum(a == b and a != WILD for a, b in zip(centre, path)) / len(path)


def nearest(clusters: list[list], path: tuple[str, ...]) -> tuple[int, float]:
    best, at = 0.0, -1
    for i, (centre, _) in enumerate(clusters):
        if (found := alike(centre, path)) > best:
            best, at = found, i
    return at, best


def build_clusters(paths: list[str]) -> str:
    """Clusters as JSON: a centroid and, while there are at most five, the member paths."""
    clusters: list[list] = []
    by_depth: dict[int, list[list]] = {}
    for path in paths:
        parts = segments(path)
        mine = by_depth.setdefault(len(parts), [])
        at, best = nearest(mine, parts)
        if at < 0 or best < LEAST_ALIKE:
            cluster = [parts, {parts}]
            mine.append(cluster)
            clusters.append(cluster)
            continue
        cluster = mine[at]
        cluster[0] = tuple(a if a == b else WILD for a, b in zip(cluster[0], parts))
        if cluster[1]:
            cluster[1].add(parts)
            if len(cluster[1]) > MEMBERS_KEPT:
                cluster[1] = set()
    return json.dumps([{"c": text(c), "m": sorted(map(text, m))} for c, m in clusters])


def merge_clusters(models: list[str]) -> str:
    """The clusters of a group from those of its parts: equal or mostly agreeing templates become one, and share their members."""
    if len(models) == 1:
        return models[0]
    merged: dict[int, list[list]] = {}
    found = [(segments(x["c"]), {segments(m) for m in x["m"]}) for model in models for x in json.loads(model)]
    for centre, members in sorted(found, key=lambda c: (c[0], sorted(c[1]))):
        mine = merged.setdefault(len(centre), [])
        same = next((c for c in mine if c[0] == centre), None)
        at, best = nearest(mine, centre) if same is None else (0, 0.0)
        if same is None and (at < 0 or best < LEAST_ALIKE):
            mine.append([centre, members])
            continue
        cluster = same or mine[at]
        cluster[0] = tuple(a if a == b else WILD for a, b in zip(cluster[0], centre))
        cluster[1] = cluster[1] | members if cluster[1] and members else set()
        if len(cluster[1]) > MEMBERS_KEPT:
            cluster[1] = set()
    return json.dumps([{"c": text(c), "m": sorted(map(text, m))} for clusters in merged.values() for c, m in clusters])


@functools.lru_cache(maxsize=64)
def _parsed(model: str) -> list[tuple[tuple[str, ...], frozenset[str]]]:
    return [(segments(x["c"]), frozenset(x["m"])) for x in json.loads(model)]


def predict(path: str, model: str) -> str:
    """The path itself if it is a remembered member of its nearest cluster, else the cluster's template."""
    parts = segments(path)
    clusters = _parsed(model)
    at, _ = nearest([list(c) for c in clusters], parts)
    if at < 0:
        return text(parts)
    centre, members = clusters[at]
    return text(parts) if text(parts) in members else text(centre)


@define("_predict_request_path_cluster", ((STRING, STRING), STRING))
def predict_cluster(path: Value, model: Value) -> Column:
    """The template of a path's cluster."""

    @F.pandas_udf("string")
    def run(paths: pd.Series, models: pd.Series) -> pd.Series:
        return pd.Series([predict(p or "", m) for p, m in zip(paths, models)])

    return run(path.col, model.col)

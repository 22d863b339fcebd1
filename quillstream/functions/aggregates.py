"""Aggregate functions. Those with built-in counterparts merge partial results; the others pre-aggregate what they can."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import BOOLEAN, FLOAT64, INT64, STRING, TIME64NS, TYPES, Value, define
from .ml import kmeans_merge, kmeans_part
from .paths import build_clusters, merge_clusters
from .pprof import count_part, merge_parts

ALL = [((t,), t) for t in TYPES]
DRAW = "__draw"
QUANTILES = {"p01": 0.01, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}


@define("any", *ALL, aggregate=True)
def any_(v: Value) -> Column:
    """Some value of the group."""
    return F.any_value(v.col)


@define("mean", *[((t,), FLOAT64) for t in (INT64, FLOAT64, BOOLEAN)], aggregate=True)
def mean(v: Value) -> Column:
    """Arithmetic mean."""
    return F.avg((v.col.cast("int") if v.type == BOOLEAN else v.col).cast("double"))


@define("sum", ((INT64,), INT64), ((FLOAT64,), FLOAT64), ((BOOLEAN,), INT64), aggregate=True)
def sum_(v: Value) -> Column:
    """Sum; true counts as one, and nothing sums up to zero."""
    return F.coalesce(F.sum(v.col.cast("long") if v.type == BOOLEAN else v.col), F.lit(0.0 if v.type == FLOAT64 else 0).cast("double" if v.type == FLOAT64 else "long"))


@define("max", *[((t,), t) for t in (INT64, FLOAT64, TIME64NS)], aggregate=True)
def max_(v: Value) -> Column:
    """Largest value."""
    return F.max(v.col)


@define("min", *[((t,), t) for t in (INT64, FLOAT64, TIME64NS)], aggregate=True)
def min_(v: Value) -> Column:
    """Smallest value."""
    return F.min(v.col)


@define("count", *[((t,), INT64) for t in TYPES], aggregate=True)
def count(v: Value) -> Column:
    """Number of rows."""
    return F.count(F.lit(1))


@define("quantiles", ((FLOAT64,), STRING), ((INT64,), STRING), aggregate=True)
def quantiles(v: Value) -> Column:
    """Seven quantiles as JSON. Over streams they are a mergeable sketch's, with a rank error of at most one in ten thousand;
    elsewhere the aggregation puts ``ranked_quantiles`` in its place."""
    found = F.percentile_approx(v.col.cast("double"), list(QUANTILES.values()), 10_000)
    return F.to_json(F.struct(*[F.get(found, F.lit(i)).alias(name) for i, name in enumerate(QUANTILES)]))


def ranked_quantiles(value: Column, upto: Column, of: Column) -> Column:
    """The exact quantiles as JSON: the least values whose rows, with those of all lesser ones (``upto``), are that share of the group's (``of``)."""
    return F.to_json(F.struct(*[F.min(F.when(upto * 100 >= of * round(100 * p), value)).alias(name) for name, p in QUANTILES.items()]))


@define("sample", *ALL, aggregate=True)
def sample(v: Value) -> Column:
    """A random value of the group: that of the row with the largest draw, a column that the aggregation adds first."""
    return F.max_by(v.col, F.col(DRAW))


def _merge_kmeans(parts: Column) -> Column:
    @F.pandas_udf("string")
    def merge(texts: pd.Series) -> str:
        return kmeans_merge(list(texts))

    return merge(parts)


@define("_kmeans_fit", ((STRING, INT64), STRING), aggregate=True, merge=_merge_kmeans)
def kmeans(v: Value, k: Value) -> Column:
    """Centroids of embeddings (JSON lists of floats) as JSON, from coresets of parts of the group."""

    @F.pandas_udf("string")
    def part(embeddings: pd.Series, ks: pd.Series) -> str:
        return kmeans_part([json.loads(e) for e in embeddings], int(ks.iloc[0]) if len(ks) else 0)

    return part(v.col, k.col)


def _merge_profiles(parts: Column) -> Column:
    @F.pandas_udf("string")
    def merge(texts: pd.Series) -> str:
        return merge_parts(texts)

    return merge(parts)


@define("pprof", ((STRING, INT64, INT64), STRING), aggregate=True, merge=_merge_profiles)
def pprof(stack: Value, n: Value, period: Value) -> Column:
    """Stack traces with counts and sampling period in ms, as a base64 profile; an error text if periods differ."""

    @F.pandas_udf("string")
    def build(stacks: pd.Series, counts: pd.Series, periods: pd.Series) -> str:
        return count_part(stacks, counts, periods)

    return build(stack.col, n.col, period.col)


def _merge_paths(parts: Column) -> Column:
    @F.pandas_udf("string")
    def merge(models: pd.Series) -> str:
        return merge_clusters(sorted(models))

    return merge(parts)


@define("_build_request_path_clusters", ((STRING,), STRING), aggregate=True, merge=_merge_paths)
def path_clusters(v: Value) -> Column:
    """Clusters of request paths as JSON, from those of parts of the group. Distinct paths are enough, and sorting them makes the result one and the same."""

    @F.pandas_udf("string")
    def part(paths: pd.Series) -> str:
        return build_clusters(sorted(set(paths.dropna())))

    return part(v.col)

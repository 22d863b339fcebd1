"""K-means over small embeddings, text embeddings, and token ids: Arrow-batched functions."""

from __future__ import annotations

import functools
import json
import os
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import INT64, STRING, Value, define

DIMENSIONS = 64
CORESET = 4096
BLOCK = 1024


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each point's nearest centre, the first of equals.

    Distances come from a matrix product; where its rounding leaves open which is least, those of the differences decide.
    """
    squares = (centres**2).sum(axis=1)
    near = np.empty(len(points), dtype=np.int64)
    for at in range(0, len(points), BLOCK):
        p = points[at : at + BLOCK]
        own = (p**2).sum(axis=1)
        rough = squares - 2 * (p @ centres.T) + own[:, None]
        found = rough.argmin(axis=1)
        slack = 1e-9 * (own + squares.max())
        unclear = np.flatnonzero(~((rough <= (rough[np.arange(len(p)), found] + slack)[:, None]).sum(axis=1) == 1))
        for i in unclear:
            found[i] = ((p[i] - centres) ** 2).sum(axis=1).argmin()
        near[at : at + BLOCK] = found
    return near


def _lloyd(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    draw = np.random.default_rng(0)
    centres = [points[draw.choice(len(points), p=weights / weights.sum())]]
    least = np.full(len(points), np.inf)
    for _ in range(1, k):
        least = np.minimum(least, ((points - centres[-1]) ** 2).sum(axis=1))
        d = least * weights
        centres.append(points[draw.choice(len(points), p=d / d.sum())] if d.sum() > 0 else points[draw.integers(len(points))])
    c = np.array(centres)
    for _ in range(rounds):
        near = nearest_centres(points, c)
        new = np.array([np.average(points[near == i], axis=0, weights=weights[near == i]) if (near == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c


def coreset(points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``CORESET`` weighted points that stand for the given ones, reduced chunk by chunk."""
    while len(points) > CORESET:
        parts, sizes = [], []
        for at in range(0, len(points), CORESET):
            p, w = points[at : at + CORESET], weights[at : at + CORESET]
            c = _lloyd(p, w, min(len(p), CORESET // 8), 3)
            near = nearest_centres(p, c)
            mass = np.bincount(near, weights=w, minlength=len(c))
            parts.append(c[mass > 0])
            sizes.append(mass[mass > 0])
        points, weights = np.concatenate(parts), np.concatenate(sizes)
    return points, weights


def kmeans_part(embeddings: list[list[float]], k: int) -> str:
    """What a part of a group contributes: its coreset as JSON."""
    if not embeddings:
        return json.dumps({"k": k, "points": [], "weights": []})
    points, weights = coreset(np.array(embeddings, dtype=np.float64), np.ones(len(embeddings)))
    return json.dumps({"k": k, "points": points.tolist(), "weights": weights.tolist()})


def kmeans_merge(parts: list[str]) -> str:
    """Centroids as JSON from the coresets of a group's parts."""
    loaded = [json.loads(p) for p in parts]
    k = max((p["k"] for p in loaded), default=0)
    loaded = [p for p in loaded if p["points"]]
    if not loaded or k < 1:
        return json.dumps({"k": 0, "centroids": []})
    points, weights = coreset(np.concatenate([np.array(p["points"]) for p in loaded]), np.concatenate([np.array(p["weights"]) for p in loaded]))
    found = _lloyd(points, weights, min(k, len(points)))
    return json.dumps({"k": len(found), "centroids": found.round(6).tolist()})


@define("_kmeans_inference", ((STRING, STRING), INT64))
def kmeans_inference(embedding: Value, model: Value) -> Column:
    """The number of the nearest centroid, or -1."""

    @F.pandas_udf("long")
    def nearest(points: pd.Series, models: pd.Series) -> pd.Series:
        @functools.lru_cache(maxsize=64)
        def centres(text: str) -> np.ndarray:
            return np.array(json.loads(text)["centroids"], dtype=np.float64)

        def one(p: str, m: str) -> int:
            c = centres(m)
            return int(((c - np.array(json.loads(p), dtype=np.float64)) ** 2).sum(axis=1).argmin()) if len(c) else -1

        return pd.Series([one(p, m) for p, m in zip(points, models)], dtype="int64")

    return nearest(embedding.col, model.col)


def hashed_embedding(text: str) -> list[float]:
    """A deterministic stand-in for a model: signed hashes of words, normalised."""
    out = np.zeros(DIMENSIONS)
    for word in text.lower().split():
        h = zlib.crc32(word.encode())
        out[h % DIMENSIONS] += 1.0 if h >> 16 & 1 else -1.0
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).round(6).tolist()


@define("_text_embedding", ((STRING,), STRING))
def text_embedding(text: Value) -> Column:
    """An embedding as JSON. No model comes with the engine, so words are hashed; swap ``hashed_embedding`` for one."""

    @F.pandas_udf("string")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(hashed_embedding(t or "")))

    return embed(text.col)


@functools.cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@define("_encode_sentence_piece", ((STRING,), STRING))
def encode_sentence_piece(text: Value) -> Column:
    """Token ids as JSON, by the model file that QUILLSTREAM_SENTENCEPIECE_MODEL names."""
    path = os.environ.get("QUILLSTREAM_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

    @F.pandas_udf("string")
    def encode(texts: pd.Series) -> pd.Series:
        model = _pieces(path)
        return pd.Series([json.dumps(ids, separators=(",", ":")) for ids in model.encode(texts.fillna("").tolist(), num_threads=1)])

    return encode(text.col)



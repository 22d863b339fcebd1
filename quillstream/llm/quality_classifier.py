"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each document becomes a short vector of statistics (lengths, shares of letters, digits, capitals, symbols, repeats).
Random Fourier features approximate a Gaussian kernel over the standardised vectors; ridge scores come from normal
equations that every partition sums over its rows and Spark sums over partitions, cell by cell, so the driver receives a
fixed number of cells whatever the input. Raw scores are calibrated by isotonic regression (pool adjacent violators) over
a histogram of the learning rows, also of fixed size. All labelled learning rows take part; nothing is sampled.

Texts are read once and never shuffled: only ids and statistics are joined with labels.

Defined cases: null and empty texts have the statistics of an empty text; several labels of one id count as the larger of
them; without labelled rows every score is 0.5, with one class alone its share; repeated rows each get their row; extra
columns are ignored by ``score`` and kept as they are by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .quality_rules import SYMBOLS, duplicate_lines, repeat_words
from .support import WordTable, bytes_of, crc_bucket, materialise, release_memory, text_of, texts_in

FEATURES = 192
RIDGE = 1e-3
BINS = 4000
LOW, HIGH = -1.0, 2.0
N_STATS = 16


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    levels: np.ndarray


def _describe(words: list[bytes]) -> np.ndarray:
    """Of each word: code points, letters, capitals, digits, whether it is all capitals, has no letter, ends in punctuation."""
    out = np.zeros((len(words), 7))
    for row, word in zip(out, words):
        w = word.decode("utf-8", "surrogatepass")
        if w.isalpha() and w.islower():
            row[0] = row[1] = len(w)
            continue
        letters = sum(map(str.isalpha, w))
        capitals = sum(map(str.isupper, w))
        row[:] = len(w), letters, capitals, sum(map(str.isdigit, w)), letters > 1 and capitals == letters, letters == 0, not w[-1].isalnum()
    return out


class Statistics:
    """A worker's computation of a document's statistics."""

    def __init__(self):
        self.words = WordTable(_describe)

    def of(self, text: str | None) -> np.ndarray:
        text = text_of(text)
        words = bytes_of(text).split()
        n = len(words)
        out = np.zeros(N_STATS)
        if not n:
            return out
        ids = self.words.rows(words)
        chars, letters, capitals, digits, shouted, bare, ended = self.words.table[ids].sum(axis=0)
        counts = np.unique(ids, return_counts=True)[1]
        p = counts / n
        lines = text.count("\n") + 1
        symbols = sum(map(text.count, SYMBOLS))
        out[:] = (
            np.log1p(n), chars / n, len(counts) / n, float(-(p * np.log(p)).sum()) / np.log(n + 1), p.max(), symbols / n, text.count("!") / n, letters / chars,
            capitals / max(letters, 1), digits / chars, shouted / n, bare / n, ended / n, duplicate_lines(text) / lines, repeat_words(ids) / n, np.log1p(n / lines),
        )
        return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Statistics()
        for batch in batches:
            rows = [own.of(t) for t in texts_in(batch.column(1))]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * N_STATS
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "stats"])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, stats array<double>")


def _projection() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(10)
    return draw.normal(size=(N_STATS, FEATURES)) / np.sqrt(N_STATS), draw.uniform(0, 2 * np.pi, FEATURES)


def _fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows of random Fourier features, with a constant one at the end."""
    w, phase = _projection()
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip((stats - mean) / scale, -8, 8) @ w + phase)
    return np.concatenate((z, np.ones((len(z), 1))), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def _raw(stats: np.ndarray, model: Model) -> np.ndarray:
    return np.clip(_fourier(stats, model.mean, model.scale) @ model.ridge, LOW, HIGH)


def _calibrated(raw: np.ndarray, model: Model) -> np.ndarray:
    return np.clip(np.interp(raw, model.knots, model.levels), 0, 1)


def isotonic(at: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted positions: knots (block means of position) and non-decreasing levels."""
    blocks: list[list[float]] = []
    for x, p, n in zip(at.tolist(), positive.tolist(), count.tolist()):
        blocks.append([x * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", learn=None) -> Model:
    """Fits on all rows of ``stats`` (id, stats) that have a label and pass ``learn`` (a condition on ``id``)."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    rows = stats.join(known, "id")
    rows = materialise(rows if learn is None else rows.where(learn), "labelled")
    cells = [f(F.get("stats", F.lit(i))) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]
    n, share, *moments = rows.agg(F.count(F.lit(1)), F.avg("label"), *cells).first()
    if not n or share in (0.0, 1.0):
        level = 0.5 if not n else float(share)
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FEATURES + 1), np.array([0.0]), np.array([level]))
    mean, scale = np.array(moments[0::2]), np.maximum(np.array(moments[1::2]), 1e-6)
    upper = np.triu_indices(FEATURES + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                z = _fourier(_matrix(batch.column(0)), mean, scale)
                gram += z.T @ z
                right += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        values = np.concatenate((gram[upper], right))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["cell", "value"])

    summed = rows.select("stats", F.col("label").cast("double")).mapInArrow(sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(len(upper[0]) + FEATURES + 1)
    for r in summed:
        values[r["cell"]] = r["value"]
    gram = np.zeros((FEATURES + 1, FEATURES + 1))
    gram[upper] = values[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    ridge = np.linalg.solve(gram + RIDGE * n * np.eye(FEATURES + 1) / FEATURES, values[len(upper[0]) :])
    model = Model(mean, scale, ridge, np.array([0.0]), np.array([0.0]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw(_matrix(batch.column(0)), model) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int32)), batch.column(1)], names=["bin", "label"])

    hist = rows.select("stats", F.col("label").cast("double").alias("label")).mapInArrow(binned, "bin int, label double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).orderBy("bin").collect()
    at = np.array([r["bin"] for r in hist], dtype=np.float64)
    knots, levels = isotonic(LOW + (at + 0.5) / BINS * (HIGH - LOW), np.array([r["p"] for r in hist]), np.array([r["n"] for r in hist], dtype=np.float64))
    return Model(mean, scale, ridge, knots, levels)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) of every row of ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _calibrated(_raw(_matrix(batch.column(1)), shared.value), shared.value) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "score"])

    return stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", keep_at: float = 0.7) -> DataFrame:
    """The documents that score at least ``keep_at``, with all their columns; nothing is shuffled.

    Python sees the texts alone and returns the verdict.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("boolean")
    def verdict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Statistics()
        for column in columns:
            stats = np.array([own.of(t) for t in texts_in(column)]).reshape(-1, N_STATS)
            yield pa.array(_calibrated(_raw(stats, shared.value), shared.value) >= keep_at)
        release_memory()

    return docs.where(verdict(F.col(f"`{text_col}`").cast("string")))


def held_out(id_col: str = "id"):
    """The rows whose labels a fit must not see: crc32 of the id's text leaves 2 modulo 4; rows without an id learn nothing either."""
    return F.coalesce(crc_bucket(id_col, 4) == 2, F.lit(False))

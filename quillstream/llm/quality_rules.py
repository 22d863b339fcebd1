"""Quality rules: counted base rules, then a calibrated linear verdict over hashed n-grams.

The verdict is a logistic regression. A word's feature vector holds its own hash, the hash of the word pair that it ends,
and the hashes of its character n-grams (with word ends marked); a document's vector is the mean of its words' vectors, so
its logit is the mean of its words' weights. Word weights are kept per worker in a bounded cache and pairs are hashed in
bulk, so scoring is a few array operations per document. The model is fitted on the driver on a bounded sample of labelled
rows (``sample_rows``, only texts up to ``max_chars``, whole); a third of the sample is held back to calibrate the
probabilities (Platt). It is then applied in Arrow batches against the fixed threshold.

Defined cases: a null text has no words; texts below 50 words or with more than half of their words in repeated three-word
windows fail the base rules; several labels of one id count as the larger;
without labelled rows of both classes the verdict keeps what passes the base rules; repeated
rows each get their row; an empty table gives an empty result; extra columns are ignored by ``assess`` and kept as they are,
whatever their names, by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .support import WordTable, bytes_of, expected_sample, ranges_of, release_memory, text_of, texts_in

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 16
PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    keep_at: float = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window which occurs at least twice, its first occurrence included."""
    n = len(ids) - 2
    if n < 2:
        return 0
    top = np.int64(ids.max()) + 1
    if top < 1 << 20:
        code = (ids[:-2] * top + ids[1:-1]) * top + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * top + ids[1:], return_inverse=True)[1].astype(np.int64)
        code = pairs[:-1] * top + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + n] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def base_counts(text: str | None, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); ids: equal for equal words.

    Words are the pieces that bytes.split() gives: it cuts at U+0020 and U+0009 to U+000D alone.
    """
    text = text_of(text)
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat_words(ids)


def failed(n_words: int, n_repeat: int, limits: Limits) -> bool:
    return n_words < limits.min_words or 100 * n_repeat > limits.max_repeat_percent * n_words


def _grams(word: bytes) -> list[int]:
    """Buckets of a word's own hash, then of its marked character trigrams (of UTF-8 bytes)."""
    marked = b"^" + word + b"$"
    crc = zlib.crc32
    return [crc(marked, 7) % BUCKETS, *[crc(marked[i : i + 3]) % BUCKETS for i in range(len(marked) - 2)]]


def _pair_buckets(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes[:-1] * PAIR) ^ (hashes[1:] + (hashes[:-1] >> np.uint64(7)))
    return ((mixed * PAIR) >> np.uint64(48)).astype(np.int64) % BUCKETS


class Scorer:
    """A worker's view of a model: row numbers of words, and a document's probability given them."""

    def __init__(self, model: Model):
        self.model = model
        self.words = WordTable(self._describe)

    def _describe(self, words: list[bytes]) -> np.ndarray:
        """Rows (weight, crc32): the word's own weight plus the mean weight of its trigrams."""
        if not words:
            return np.zeros((0, 2))
        weights = self.model.weights
        grams = [_grams(w) for w in words]
        sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
        starts = ranges_of(sizes)[:-1]
        flat = weights[np.fromiter(chain.from_iterable(grams), dtype=np.int64, count=int(sizes.sum()))]
        own = flat[starts]
        more = np.maximum(sizes - 1, 1)
        return np.stack((own + (np.add.reduceat(flat, starts) - own) / more, np.fromiter(map(zlib.crc32, words), dtype=np.float64, count=len(words))), axis=1)

    def probability(self, ids: np.ndarray) -> float:
        z = self.model.bias
        if len(ids):
            rows = self.words.table[ids]
            total = rows[:, 0].sum()
            if len(ids) > 1:
                total += self.model.weights[_pair_buckets(rows[:, 1].astype(np.uint64))].sum()
            z += total / len(ids)
        return float(1 / (1 + np.exp(-np.clip(self.model.slope * z + self.model.shift, -60, 60))))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A document's buckets and values: what ``Scorer`` sums up, as a sparse vector."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    n = len(words)
    at: list[int] = []
    value: list[float] = []
    for w, k in Counter(words).items():
        grams = _grams(w)
        at.extend(grams)
        value.append(k / n)
        value.extend([k / n / max(1, len(grams) - 1)] * (len(grams) - 1))
    pairs = _pair_buckets(np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=n))
    index = np.concatenate((np.array(at, dtype=np.int64), pairs))
    values = np.concatenate((np.array(value), np.full(len(pairs), 1 / n)))
    found, inverse = np.unique(index, return_inverse=True)
    return found, np.bincount(inverse, weights=values)


def fit_model(texts: list[str | None], labels: list[int], rounds: int = 250, l2: float = 1e-4) -> Model:
    """Weighted logistic regression by full-batch Adam on the driver; every third row only calibrates."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 4.0)
    rows = [features(bytes_of(t).split()) for t in texts]
    hold = np.arange(len(rows)) % 3 == 2
    if not hold.any() or len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
        hold[:] = False
    train = np.flatnonzero(~hold)
    index = np.concatenate([rows[i][0] for i in train])
    value = np.concatenate([rows[i][1] for i in train])
    cuts = ranges_of(np.array([len(rows[i][0]) for i in train]))
    owner = np.repeat(np.arange(len(train)), np.diff(cuts))
    target = y[train]
    cost = np.where(target == 1, 0.5 / target.sum(), 0.5 / (len(target) - target.sum()))
    w, bias = np.zeros(BUCKETS), 0.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(owner, weights=value * w[index], minlength=len(train)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) * cost
        g = np.bincount(index, weights=value * error[owner], minlength=BUCKETS) + l2 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a = 0.3 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= a * m / (np.sqrt(v) + 1e-8)
        bias -= a * mb / (np.sqrt(vb) + 1e-8)
    if not hold.any():
        return Model(w, bias)
    held = np.flatnonzero(hold)
    z = np.array([rows[i][1] @ w[rows[i][0]] + bias for i in held])
    return Model(w, bias, *_platt(z, y[held]))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid over logits, with Platt's smoothed targets, by Newton steps."""
    up, down = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(z.std(), 1e-9)
    x = np.stack((z / scale, np.ones_like(z)), axis=1)
    theta = np.array([1.0, 0.0])
    loss = lambda t: float(np.logaddexp(0, x @ t).sum() - goal @ (x @ t)) + 1e-3 * float(t @ t)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (p - goal) + 2e-3 * theta)
        size = 1.0
        while size > 1e-4 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(theta[0] / scale), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 1500, max_chars: int = 20_000) -> Model:
    """Fits on about ``sample_rows`` labelled rows of each class with texts of up to ``max_chars``, chosen by a hash of the id."""
    chosen = expected_sample(labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias(label_col)), id_col, label_col, sample_rows, 9)
    wanted = docs.select(id_col, F.col(text_col).cast("string").alias("__text")).where(F.char_length("__text") <= max_chars)
    rows = wanted.join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("id"), "__text", F.col(label_col).alias("label")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["__text"]))
    return fit_model([r["__text"] for r in rows], [r["label"] for r in rows])


ASSESSED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean"


def assess(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Per document its id, the base counts, whether it fails the base rules, the calibrated score, the verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out: list[tuple] = []
            for text in texts_in(batch.column(1)):
                words = bytes_of(text).split()
                ids = scorer.words.rows(words)
                counts = base_counts(text, words, ids)
                bad = failed(counts[0], counts[4], limits)
                score = scorer.probability(ids)
                out.append((*counts, bad, score, not bad and score >= limits.keep_at))
            columns = [list(c) for c in zip(*out)] if out else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["id", *[x.split()[0] for x in ASSESSED.split(", ")]])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, {ASSESSED}")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass the base rules and the verdict, with all their columns; nothing is shuffled.

    Python sees the texts alone and returns the verdict.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("boolean")
    def verdict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for column in columns:
            keep = []
            for text in texts_in(column):
                ids = scorer.words.rows(bytes_of(text).split())
                keep.append(not failed(len(ids), repeat_words(ids), limits) and scorer.probability(ids) >= limits.keep_at)
            yield pa.array(keep, pa.bool_())
        release_memory()

    return docs.where(verdict(F.col(f"`{text_col}`").cast("string")))

"""Language ID by a linear-chain conditional random field over words.

A word's features are hashed: itself, its prefixes and suffixes of up to three bytes, its character trigrams, and whether the
lexicon of a language (its most telling frequent words) has it. A label's emission is the sum of its weights over the features, and
transitions between labels are learnt too, so a code-switched text gets a language for each stretch of words. A document's
language is the one with the largest mean posterior over its words by forward-backward, and its score is that mean.

Learning is weakly supervised: every word of a learning document has the document's language. A bounded sample (about
``docs_per_label`` documents of each language with up to ``max_chars`` code points, whole) goes to the driver, where it is cut
into windows of ``WINDOW`` words; every third window is spliced from two languages, so that switches occur. Word emissions are
kept per worker in a bounded table; forward-backward runs over many documents at once, one step a word position.

Defined cases: null texts and texts without letters give ``und`` with score 0, as do all texts if there is nothing to learn from; texts of
more than ``SEGMENT`` words are decoded in consecutive segments, whose posteriors add up; repeated rows each get their row;
extra columns are ignored; languages of equal posterior: the first by name; an empty table gives an empty result. Nothing is
shuffled. Letters are the characters of Unicode's letter categories.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import WordTable, crc_bucket, expected_sample, ranges_of, release_memory, slices, text_of

UNDETERMINED = "und"
BUCKETS = 1 << 15
WINDOW = 40
SEGMENT = 50_000
BATCH_WORDS = 400_000
LEXICON = 150

#: Word characters that are neither letters nor digits, such as fractions and superscripts.
OTHER = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_plain = re.compile(r"[^\W\d_]+").findall
_strict = re.compile(rf"[^\W\d_{''.join(sorted(OTHER))}]+").findall


def words_of(text: str) -> list[str]:
    """The runs of letters."""
    return _plain(text) if text.isascii() or OTHER.isdisjoint(text) else _strict(text)


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    transitions: np.ndarray  # from x to
    start: np.ndarray
    lexicons: list[frozenset[str]]


def _features(word: str, lexicons: list[frozenset[str]]) -> list[int]:
    marked = f"^{word}$".encode("utf-8", "surrogatepass")
    crc, n = zlib.crc32, len(marked)
    out = [crc(marked, 1)]
    out += [crc(marked[:k], 2) for k in range(2, min(n, 5))]
    out += [crc(marked[n - k :], 3) for k in range(2, min(n, 5))]
    out += [crc(marked[i : i + 3], 4) for i in range(1, n - 3)]
    out += [i + 1 for i, lexicon in enumerate(lexicons) if word in lexicon]
    return [h % BUCKETS for h in out]


def _emissions(words: list[str], model: Model) -> np.ndarray:
    if not words:
        return np.zeros((0, len(model.labels)))
    found = [_features(w, model.lexicons) for w in words]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(sizes.sum()))
    return np.add.reduceat(model.weights[flat], ranges_of(sizes)[:-1], axis=0)


def posteriors(rows: np.ndarray, lengths: np.ndarray, emissions: np.ndarray, model: Model) -> np.ndarray:
    """Summed posteriors of each sequence: sequences are consecutive in ``rows`` (row numbers of ``emissions``), longest first."""
    starts = ranges_of(lengths)[:-1]
    step = np.exp(model.transitions)
    e = emissions[rows]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    n, k = len(lengths), len(model.labels)
    active = n - np.searchsorted(lengths[::-1], np.arange(lengths[0] + 1), side="right")
    alpha = np.empty_like(e)
    a = np.exp(model.start - model.start.max()) * e[starts]
    a /= a.sum(axis=1, keepdims=True)
    alpha[starts] = a
    for t in range(1, lengths[0]):
        at = starts[: active[t]] + t
        a = (a[: active[t]] @ step) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    total = np.zeros((n, k))
    b = np.ones((n, k))
    for t in range(lengths[0] - 1, -1, -1):
        on = active[t]
        after = active[t + 1]
        if after:
            x = (e[starts[:after] + t + 1] * b[:after]) @ step.T
            b[:after] = x / x.sum(axis=1, keepdims=True)
        p = alpha[starts[:on] + t] * b[:on]
        total[:on] += p / p.sum(axis=1, keepdims=True)
    return total


def _lexicons(texts: list[list[str]], owners: list[int], k: int) -> list[frozenset[str]]:
    """The most telling of each label's words: frequent there, and much rarer elsewhere."""
    counts = [Counter() for _ in range(k)]
    for words, y in zip(texts, owners):
        counts[y].update(words)
    sums = [max(1, sum(c.values())) for c in counts]
    out = []
    for y in range(k):
        rate = lambda w: min(counts[y][w] / sums[y] / (1e-6 + max((counts[z][w] / sums[z] for z in range(k) if z != y), default=0)), 50) * counts[y][w]  # noqa: B023, E731
        out.append(frozenset(sorted((w for w, n in counts[y].items() if n > 1), key=lambda w: (-rate(w), w))[:LEXICON]))
    return out


def fit_model(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.2, l2: float = 1e-5) -> Model:
    """Trains on the driver: batches of windows, exact gradients by forward-backward, AdaGrad steps."""
    labels = sorted(set(langs))
    k = len(labels)
    if not k:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0), [])
    owners = [labels.index(x) for x in langs]
    split = [words_of(t.lower()) for t in texts]
    lexicons = _lexicons(split, owners, k)
    draw = np.random.default_rng(8)
    windows = [(words[i : i + WINDOW], [y] * len(words[i : i + WINDOW])) for words, y in zip(split, owners) for i in range(0, len(words), WINDOW)]
    order = draw.permutation(len(windows))
    for i, j in zip(order[::3], order[1::3]):
        (a, ya), (b, yb) = windows[i], windows[j]
        windows[i] = (a[: len(a) // 2] + b[len(b) // 2 :], ya[: len(a) // 2] + yb[len(b) // 2 :])
    windows = [(w, y) for w, y in windows if w]
    table: dict[str, list[int]] = {}
    for word in chain.from_iterable(w for w, _ in windows):
        if word not in table:
            table[word] = _features(word, lexicons)
    weights, transitions, start = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
    squares = [np.full_like(x, 1e-6) for x in (weights, transitions, start)]
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for at in range(0, len(order), 64):
            batch = sorted((windows[i] for i in order[at : at + 64]), key=lambda w: -len(w[0]))
            n, longest = len(batch), len(batch[0][0])
            mask = np.array([[t < len(w) for t in range(longest)] for w, _ in batch])
            gold = np.zeros((n, longest), dtype=np.int64)
            feats, sizes = [], []
            for i, (w, y) in enumerate(batch):
                gold[i, : len(y)] = y
                feats += [table[x] for x in w]
            sizes = np.fromiter(map(len, feats), dtype=np.int64, count=len(feats))
            flat = np.fromiter(chain.from_iterable(feats), dtype=np.int64, count=int(sizes.sum()))
            e = np.zeros((n, longest, k))
            e[mask] = np.add.reduceat(weights[flat], ranges_of(sizes)[:-1], axis=0)
            e = np.exp(e - e.max(axis=2, keepdims=True))
            step = np.exp(transitions)
            alpha, beta = np.zeros_like(e), np.ones_like(e)
            alpha[:, 0] = np.exp(start) * e[:, 0]
            alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, longest):
                alpha[:, t] = (alpha[:, t - 1] @ step) * e[:, t]
                alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
            for t in range(longest - 2, -1, -1):
                x = (e[:, t + 1] * beta[:, t + 1]) @ step.T
                beta[:, t] = np.where(mask[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
            p = alpha * beta
            p /= p.sum(axis=2, keepdims=True)
            hot = np.eye(k)[gold]
            error = (p - hot) * mask[:, :, None] / n
            g_start = error[:, 0].sum(axis=0)
            g_trans = np.zeros((k, k))
            if longest > 1:
                pair = alpha[:, :-1, :, None] * step * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
                pair /= pair.sum(axis=(2, 3), keepdims=True)
                both = mask[:, 1:, None, None]
                g_trans = ((pair - hot[:, :-1, :, None] * hot[:, 1:, None, :]) * both).sum(axis=(0, 1)) / n
            g_weights = np.zeros((BUCKETS, k))
            per_word = np.repeat(error[mask], sizes, axis=0)
            for y in range(k):
                g_weights[:, y] = np.bincount(flat, weights=per_word[:, y], minlength=BUCKETS)
            for x, g, s in zip((weights, transitions, start), (g_weights + l2 * weights, g_trans + 1e-3 * transitions, g_start), squares):
                s += g * g
                x -= rate * g / np.sqrt(s)
    return Model(labels, weights, transitions, start, lexicons)


def held_out(id_col: str = "doc_id"):
    """The documents that learning must not see: crc32 of the id's text is divisible by 5. A row without an id isn't one, but teaches nothing."""
    return F.coalesce(crc_bucket(id_col, 5) == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_label: int = 150, max_chars: int = 20_000) -> Model:
    """Fits on a bounded sample of the documents that are not held out and have a language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & (F.char_length(F.col(text_col).cast("string")) <= max_chars))
    rows = expected_sample(known.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), "id", "lang", docs_per_label, 8).collect()
    rows.sort(key=lambda r: (r["id"], r["lang"], r["text"]))
    return fit_model([r["text"] for r in rows], [r["lang"] for r in rows])


class Tagger:
    """A worker's view of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.words = WordTable(lambda words: _emissions(words, model))

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.model.labels:
            return out
        pieces: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, text in enumerate(texts):
            words = words_of(text_of(text).lower())
            for at in range(0, len(words), SEGMENT):
                rows = self.words.rows(words[at : at + SEGMENT])
                # The table may start anew before the batch is decoded, so the emissions are taken now.
                pieces.append((i, rows, self.words.table[rows].astype(np.float32)))
        order = sorted(range(len(pieces)), key=lambda p: -len(pieces[p][1]))
        sums = np.zeros((len(texts), len(self.model.labels)))
        at = 0
        while at < len(order):
            to, size = at, 0
            while to < len(order) and (to == at or size + len(pieces[order[to]][1]) <= BATCH_WORDS):
                size += len(pieces[order[to]][1])
                to += 1
            group = [pieces[p] for p in order[at:to]]
            lengths = np.array([len(rows) for _, rows, _ in group])
            emissions = np.concatenate([e for *_, e in group]).astype(np.float64)
            np.add.at(sums, [i for i, *_ in group], posteriors(np.arange(size), lengths, emissions, self.model))
            at = to
        for i in np.flatnonzero(sums.sum(axis=1) > 0).tolist():
            share = sums[i] / sums[i].sum()
            best = int(share.argmax())
            out[i] = (self.model.labels[best], float(min(1.0, share[best])))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Stretches of one language: (start, end, language) in words, by each word's best posterior."""
        words = words_of(text_of(text).lower())
        if not words or not self.model.labels:
            return []
        rows = self.words.rows(words)
        best = _tags(self.words.table[rows], self.model)
        cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
        return [(a, b, self.model.labels[best[a]]) for a, b in zip(cuts, cuts[1:])]


def _tags(emissions: np.ndarray, model: Model) -> np.ndarray:
    """Each word's best label by forward-backward over one text."""
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    step = np.exp(model.transitions)
    alpha, b = np.empty_like(e), np.ones(e.shape[1])
    a = np.exp(model.start) * e[0]
    for t in range(len(e)):
        if t:
            a = (a @ step) * e[t]
        a = a / a.sum()
        alpha[t] = a
    best = np.empty(len(e), dtype=np.int64)
    for t in range(len(e) - 1, -1, -1):
        best[t] = int((alpha[t] * b).argmax())
        b = step @ (e[t] * b)
        b = b / b.sum()
    return best


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch_docs: int = 2000) -> DataFrame:
    """(id, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for whole in batches:
            for batch in slices(whole, 1, batch_docs):
                found = tagger.classify(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["id", "lang_pred", "score"])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")

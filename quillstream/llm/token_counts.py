"""Token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words with the word-start marks before them. The distinct new pre-tokens of a batch of texts are
sorted, which lays out their trie depth first, and the trie is walked with the nodes from the root to the current one on a
stack: what the recurrence computes for a prefix it computes once, and every pre-token that shares the prefix goes on from
there. The terminal node's count is the pre-token's and is stored in a table of bounded size (``words_held``) that later
batches of the worker use; a text's count is the sum over its pre-tokens.

The recurrence follows the model's kind. For a unigram model it is the forward score: the best sum of piece scores over the
segmentations of the prefix, with the number of pieces of the best one. The model file of the box is a BPE model, whose
tokens aren't the best sum of scores; for such a model a node holds the last token of its prefix's encoding. That is the one
piece ending there whose predecessor's last token stays apart from it when the two are encoded alone, because a merge that
crosses the boundary in the whole text would also cross it in the pair. Counts then equal the tokenizer's own.

Nothing is shuffled. Defined cases: a null text counts as empty and has no tokens; a character without a piece counts as its
UTF-8 bytes if the model falls back on bytes, else as one unknown token (a run of them as one in a unigram model);
repeated rows each get their row; a very long text is counted whole, so memory grows with its distinct pre-tokens; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_model import MARK, UNIGRAM, Model, default_model_path, load, normaliser
from .support import release_memory, slices, text_of

UNKNOWN_PENALTY = 10.0
SPAN = 1 << 32
TEXTS_AT_ONCE = 4096


def _shared(a: str, b: str) -> int:
    """The length of the common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Fits(dict):
    """Of last * SPAN + piece: whether the two tokens stay apart when encoded together (last -1: whether the piece is one token)."""

    def __init__(self, trie: CountingTrie, limit: int = 1_500_000):
        super().__init__()
        self.trie, self.limit = trie, limit

    def __missing__(self, key: int) -> bool:
        if len(self) >= self.limit:
            self.clear()
        last, piece = divmod(key, SPAN)
        parts = [self.trie.model.pieces[i] for i in (last, piece) if i >= 0]
        found = self[key] = self.trie._merge("".join(parts)) == parts
        return found


class CountingTrie:
    """Counts the tokens of pre-tokens, sharing the work of common prefixes."""

    def __init__(self, model: Model, words_held: int = 250_000, chars_held: int = 8 << 20):
        if not model.splits_at_marks():
            raise ValueError("a piece of this model runs over a word start; its words can't be counted one by one")
        self.model, self.words_held, self.chars_held, self.held = model, words_held, chars_held, 0
        self.vocab = model.text_pieces()
        self.longest = max(map(len, self.vocab))
        self.unigram = model.algorithm == UNIGRAM
        self.unknown_score = min(model.scores[i] for i in self.vocab.values()) - UNKNOWN_PENALTY
        self.fits = Fits(self)
        self.terminals: dict[str, int] = {}
        plain = not model.charsmap and not model.remove_extra_whitespaces
        self.normalise = self._plain if plain else normaliser(model).normalize_str
        self.find = re.compile(f"^[^{MARK}]+|{MARK}+[^{MARK}]*").findall

    def _plain(self, text: str) -> str:
        if not text:
            return text
        return (MARK + text if self.model.add_dummy_prefix else text).replace(" ", MARK)

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        if len(self.terminals) >= self.words_held or self.held > self.chars_held:
            self.forget()
        out = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            cut = [self.find(self.normalise(text_of(t))) for t in texts[at : at + TEXTS_AT_ONCE]]
            self._insert(sorted({w for words in cut for w in words}.difference(self.terminals)))
            out.extend(sum(map(self.terminals.__getitem__, words)) for words in cut)
        return out

    def _insert(self, words: list[str]) -> None:
        """Walks the trie of these sorted pre-tokens depth first: the stacks hold the nodes from the root to here."""
        counts, lasts, scores = [0], [-1], [0.0]
        grow = self._forward if self.unigram else self._last
        before = ""
        for word in words:
            shared = _shared(before, word)
            del counts[shared + 1 :], lasts[shared + 1 :], scores[shared + 1 :]
            grow(word, shared, counts, lasts, scores)
            self.terminals[word] = counts[-1]
            self.held += len(word)
            before = word

    def forget(self) -> None:
        """Drops the table of pre-tokens."""
        self.terminals.clear()
        self.held = 0

    def _unknown(self, char: str, last: int) -> int:
        """What an unknown character adds to the count."""
        if self.model.byte_fallback:
            return len(char.encode("utf-8", "surrogatepass"))
        return 0 if self.unigram and last == -2 else 1

    def _forward(self, word: str, shared: int, counts: list[int], lasts: list[int], scores: list[float]) -> None:
        """Unigram: the best score of each new prefix of the word, and its number of pieces."""
        for depth in range(shared + 1, len(word) + 1):
            best, count, last = -np.inf, 0, -1
            for before in range(max(0, depth - self.longest), depth):
                piece = self.vocab.get(word[before:depth])
                if piece is not None:
                    score = scores[before] + self.model.scores[piece]
                    if score > best:
                        best, count, last = score, counts[before] + 1, piece
                elif before == depth - 1 and scores[before] + self.unknown_score > best:
                    best, count, last = scores[before] + self.unknown_score, counts[before] + self._unknown(word[before], lasts[before]), -2
            scores.append(best)
            counts.append(count)
            lasts.append(last)

    def _last(self, word: str, shared: int, counts: list[int], lasts: list[int], scores: list[float]) -> None:
        """BPE: the last token of the encoding of each new prefix of the word, and the number of tokens."""
        find, fits, longest = self.vocab.get, self.fits, self.longest
        for depth in range(shared + 1, len(word) + 1):
            for before in range(depth - longest if depth > longest else 0, depth):
                piece = find(word[before:depth])
                if piece is not None and fits[lasts[before] * SPAN + piece]:
                    counts.append(counts[before] + 1)
                    lasts.append(piece)
                    break
            else:  # only a character without a piece comes here
                counts.append(counts[-1] + self._unknown(word[depth - 1], lasts[-1]))
                lasts.append(-1)

    def _merge(self, text: str) -> list[str]:
        """BPE of a short text: always the neighbours whose union has the best score, the leftmost first."""
        parts, scores, vocab = list(text), self.model.scores, self.vocab
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = vocab.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


@functools.cache
def trie(path: str) -> CountingTrie:
    """One trie a worker process and file; its pre-tokens go at the end of each partition."""
    return CountingTrie(load(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_chars, n_tokens) of every document."""
    path = path or default_model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(path)
        for batch in batches:
            chars, counts = [], []
            for part in slices(batch, 1, TEXTS_AT_ONCE):
                texts = part.column(1).to_pylist()
                chars.extend(len(text_of(t)) for t in texts)
                counts.extend(own.count(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_chars", "n_tokens"])
        own.forget()
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_chars bigint, n_tokens bigint")

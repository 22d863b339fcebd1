"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here and rebuilt as a tokenizers.Tokenizer: normaliser, word-start marks, unigram scores (or, for a
BPE file, the merge list that its scores stand for), byte fallback. If no piece runs over a word start, texts are
normalised, cut at word starts, and only words that a worker hasn't met are encoded and their ids decoded; a text's ids and its
decoded bytes are then put together from its words'. For a BPE file, some words at a time go into the library as one string, as no
merge runs over a word start; each word's ids begin at its one token with a mark, and if there aren't as many of these as words, the
words are encoded one by one. The library's own threads are switched off: Spark runs a task on each core. The table of words is
bounded in words and bytes, but for the words of the few texts at hand. At its first use in a worker the
rebuilt tokenizer is compared with the sentencepiece library on probe texts; a difference stops the job.

Nothing is shuffled. Defined cases: a null text gives null ids, zero tokens and a null decoded text; an empty text gives no ids; repeated
rows each get their row; a very long text is encoded whole, so memory grows with it; an empty table gives an empty result; every input column is kept by ``encode`` unless it has the name of a new one, which then replaces it.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .sentencepiece_model import BPE, BYTE, CONTROL, MARK, UNKNOWN, default_model_path, load, tokenizer
from .support import ranges_of, release_memory, slices

PROBES = ["", " ", "a", "Hello  world", "  two\n\tlines \r\n", "éè 中文 \U0001f600 ﬁ", "x" * 70 + "   7*7 = 49", "▁ mark▁ed", "a    b      c          d", "\x00\x1f\x7f"]
WORDS_HELD, BYTES_HELD = 250_000, 32 << 20
TEXTS_AT_ONCE = 512
WORDS_A_STRING, WORDS_AT_ONCE = 32, 4_096
ROWS_AT_ONCE = 1 << 14


class Numbers(dict):
    """Numbers words in the order in which they are asked for; ``new`` has the latest, until it is emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at


class Runs:
    """A run of values for each of a growing number of rows, in one array."""

    def __init__(self, dtype: type):
        self.flat, self.used = np.zeros(1024, dtype=dtype), 0
        self.start = self.size = np.zeros(0, dtype=np.int64)

    def grow(self, rows: int) -> None:
        more = np.zeros(rows - len(self.start), dtype=np.int64)
        self.start, self.size = np.concatenate((self.start, more)), np.concatenate((self.size, more))

    def put(self, rows: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
        """Gives these rows the runs of ``flat`` that ``ends`` (one more than rows) delimits."""
        if (need := self.used + len(flat)) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(need, 2 * self.used) - self.used, dtype=self.flat.dtype)))
        self.flat[self.used : need] = flat
        self.start[rows], self.size[rows] = self.used + ends[:-1], np.diff(ends)
        self.used = need

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' runs one after another, and where each begins and the last ends."""
        found = []
        for at in range(0, len(rows), ROWS_AT_ONCE):
            some = rows[at : at + ROWS_AT_ONCE]
            ends = ranges_of(self.size[some])
            found.append(self.flat[np.repeat(self.start[some] - ends[:-1], self.size[some]) + np.arange(ends[-1])])
        return np.concatenate(found) if found else self.flat[:0], ranges_of(self.size[rows])


class Codec:
    """Encodes and decodes batches with one model file."""

    def __init__(self, path: str, check: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = load(path)
        self.tokenizer = tokenizer(self.model)
        self.by_words = self.model.splits_at_marks()
        self.forget()
        self.find = re.compile(f"^[^{MARK}]+|{MARK}+[^{MARK}]*").findall
        plain = not self.model.charsmap and not self.model.remove_extra_whitespaces
        self.normalise = self._plain if plain else self.tokenizer.normalizer.normalize_str
        self.lead = MARK if plain and self.model.add_dummy_prefix else ""
        self.marked = np.array([p.startswith(MARK) for p in self.model.pieces])
        self.outputs = [self._output(i) for i in range(len(self.model.pieces))]
        self.bytes_of = Runs(np.uint8)
        self.bytes_of.grow(len(self.outputs))
        self.bytes_of.put(np.arange(len(self.outputs)), np.frombuffer(b"".join(self.outputs), dtype=np.uint8), ranges_of(np.array([len(x) for x in self.outputs])))
        if check:
            self.verify(path, PROBES)

    def _plain(self, text: str) -> str:
        if not text:
            return text
        return (MARK + text if self.model.add_dummy_prefix else text).replace(" ", MARK)

    def _output(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return piece.replace(MARK, " ").encode()

    def _cut(self, text: str) -> list[str]:
        """The words of a text, without ``lead``."""
        if not self.lead:
            return self.find(self.normalise(text))
        if text and text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [w[1:] for w in self.find(self.normalise(text))]

    def _learn(self) -> None:
        """Puts the new words into the tables."""
        words, self.numbers.new = self.numbers.new, []
        first = len(self.numbers) - len(words)
        for table in (self.ids, self.decoded):
            table.grow(len(self.numbers))
        by_mark = bool(self.lead) and self.model.algorithm == BPE
        joined = [k for k, w in enumerate(words) if not w.startswith(MARK)] if by_mark else []
        single = [k for k, w in enumerate(words) if w.startswith(MARK)] if by_mark else [*range(len(words))]
        for at in range(0, len(joined), WORDS_AT_ONCE):
            some = joined[at : at + WORDS_AT_ONCE]
            found = self._encode_words([MARK + MARK.join([words[k] for k in some[i : i + WORDS_A_STRING]]) for i in range(0, len(some), WORDS_A_STRING)])
            ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in found])
            starts = np.flatnonzero(self.marked[ids])
            if len(starts) == len(some) and starts[0] == 0:
                self._keep(first + np.array(some), ids, np.append(starts, len(ids)))
            else:
                single += some
        for at in range(0, len(single), WORDS_AT_ONCE):
            some = single[at : at + WORDS_AT_ONCE]
            found = [np.array(e.ids, dtype=np.int32) for e in self._encode_words([self.lead + words[k] for k in some])]
            self._keep(first + np.array(some), np.concatenate(found), ranges_of(np.array([len(x) for x in found])))
        self.held += sum(map(len, words))

    def _keep(self, rows: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Takes the ids of words, one word's after another's, and decodes them."""
        data, at = self.bytes_of.take(ids)
        self.ids.put(rows, ids, ends)
        self.decoded.put(rows, data, at[ends])
        self.held += ids.nbytes + data.nbytes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as int32."""
        return self.code(texts, False)[0]

    def code(self, texts: list[str], back: bool = True) -> tuple[list[np.ndarray], list[str]]:
        """The ids of each text, as int32, and, if asked for, the text that ``decode`` makes of them."""
        if not self.by_words:
            ids = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return ids, [self.decode(i.tolist()) for i in ids] if back else []
        if len(self.numbers) >= WORDS_HELD or self.held > BYTES_HELD:
            self.forget()
        out, texts_back = [], []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            cut = [self._cut(t) for t in texts[at : at + TEXTS_AT_ONCE]]
            ends = ranges_of(np.array([len(words) for words in cut]))
            rows = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(cut)), dtype=np.int64, count=ends[-1])
            if self.numbers.new:
                self._learn()
            ids, of_words = self.ids.take(rows)
            of_texts = of_words[ends].tolist()
            out.extend(ids[s:e] for s, e in zip(of_texts, of_texts[1:]))
            if back:
                data, of_words = self.decoded.take(rows)
                of_texts = of_words[ends].tolist()
                texts_back.extend(self._text(data[s:e].tobytes(), i) for s, e, i in zip(of_texts, of_texts[1:], out[at:]))
        return out, texts_back

    def forget(self) -> None:
        """Drops the tables: of each word, without ``lead``, its number, its ids and what they decode to."""
        self.numbers, self.ids, self.decoded = Numbers(), Runs(np.int32), Runs(np.uint8)
        self.held = 0

    @functools.cached_property
    def _bare(self):
        from tokenizers import Tokenizer

        return Tokenizer(self.tokenizer.model)

    def _encode_words(self, words: list[str]):
        return self._bare.encode_batch_fast(words, add_special_tokens=False)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of a list of ids, as sentencepiece gives it: bytes that are no UTF-8 become U+FFFD."""
        return self._text(b"".join(map(self.outputs.__getitem__, ids)), ids)

    def _text(self, data: bytes, ids: list[int] | np.ndarray) -> str:
        """The text of the bytes that the ids stand for."""
        if self.model.add_dummy_prefix and data.startswith(b" ") and len(ids) and self.model.pieces[ids[0]].startswith(MARK):
            data = data[1:]
        return data.decode("utf-8", "replace")

    def verify(self, path: str, texts: list[str]) -> None:
        """Raises unless the sentencepiece library gives the same ids and the same decoded texts."""
        import sentencepiece

        other = sentencepiece.SentencePieceProcessor(model_file=path)
        for text, ids in zip(texts, self.encode(texts)):
            theirs = other.encode(text)
            if ids.tolist() != theirs or self.decode(theirs) != other.decode(theirs):
                raise ValueError(f"the rebuilt tokenizer differs from sentencepiece on {text!r}: {ids.tolist()} and {theirs}")


@functools.cache
def codec(path: str) -> Codec:
    """One codec a worker process and file; its words go at the end of each partition."""
    return Codec(path)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids", count_col: str = "n_tokens", round_trip_col: str | None = None) -> DataFrame:
    """The documents with their ids and number of tokens, and optionally whether decoding gives the text again."""
    path = path or default_model_path()
    new = [ids_col, count_col, *([round_trip_col] if round_trip_col else [])]
    kept = [c for c in docs.columns if c not in new]
    kinds = [T.ArrayType(T.IntegerType(), False), T.LongType(), T.BooleanType()]

    @arrow_udf(T.StructType([T.StructField(name, kind) for name, kind in zip(new, kinds)]))
    def coded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for column in columns:
            ids, same = [], []
            for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0, TEXTS_AT_ONCE):
                texts = part.column(0).to_pylist()
                made, back = own.code([t or "" for t in texts], bool(round_trip_col))
                ids.extend(made)
                same.extend(None if t is None else t == b for t, b in zip(texts, back))
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(ranges_of(sizes).astype(np.int32), pa.array(flat, pa.int32()), mask=column.is_null())
            yield pa.StructArray.from_arrays([lists, pa.array(sizes), *([pa.array(same, pa.bool_())] if round_trip_col else [])], names=new)
        own.forget()
        release_memory()

    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    return docs.select(row, coded(F.col(f"`{text_col}`").cast("string")).alias("coded")).select("row.*", "coded.*")


def ids_in(column: pa.Array) -> Iterator[list[int] | None]:
    """The lists of ids of an Arrow column, a few at a time."""
    for at in range(0, len(column), 64):
        yield from column.slice(at, 64).to_pylist()


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids."""
    path = path or default_model_path()
    kept = [c for c in rows.columns if c != text_col]

    @arrow_udf("string")
    def decoded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for column in columns:
            yield pa.array([None if i is None else own.decode(i) for i in ids_in(column)], pa.string())
        release_memory()

    return rows.select(*[F.col(f"`{c}`") for c in kept], decoded(F.col(f"`{ids_col}`")).alias(text_col))

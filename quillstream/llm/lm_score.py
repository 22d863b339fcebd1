"""Language-model scores by Ziv-Merhav cross-parsing against reference text.

A document is cut greedily into phrases: the longest run of words that occurs in the reference text, or one word that doesn't.
With c phrases over n words and a reference of m words the cross-entropy is c log2(m + 1) / n bits a word; the
document's own entropy is estimated from its Lempel-Ziv 78 phrases, k of them, as k log2(k) / n. The score is their difference,
the length-normalised relative entropy: the higher, the less alike. A second parse takes all other documents
for the reference (``corpus_phrases``, ``corpus_entropy``).

Every document is parsed against the whole reference, itself left out. One suffix automaton of all of it fits no task, and one
for each part of it would have to meet every document, which is quadratic. So the automaton is spread out: its states are the distinct
runs of up to ``context`` words, and a state lives in the part of the hash space that its run falls in. A match of ``context`` words
or more goes on as long as the last ``context`` words occur somewhere: phrases have no greatest length, but a longer one may be
pieced together from texts that overlap in context - 1 words or more.

Texts are read once, into blocks of whole documents of about ``block_words`` words (word codes and the words' hashes). For runs of 1 and
2, then 3 and 4, then 5 to 8 words each block sends the hashes of its distinct runs, with the number of its documents that
have them (0, 1, more), to the parts; a run is sent only if its sub-runs occur in other documents. The parts add these up and
answer. A run that is in a third of all documents is one hash a block; a block's messages hold at least some 32 hashes each.
Words are told apart by 48 bits of their hashes, runs within a part by 40. The number of parts follows the input, so at any size about two
runs in a million are taken for ones that occur.

Defined cases: a null text counts as empty; a text without words has zero phrases, entropies and score; without reference text (besides the
document's own) the cross-entropy and the score are null; repeated rows each get their row and are reference text to
each other; rows without an id are no reference text; an empty table gives an empty result; extra columns are ignored. A very long text is one
block, so memory grows with the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import bytes_of, discard, materialise, ranges_of, release_memory, texts_in

STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
WORD_BITS, KEY_BITS = 48, 40
WORD_MASK = (1 << WORD_BITS) - 1
STATE = "sizes binary, vocabulary binary, codes binary, reference binary, shared binary, matched binary, words bigint, reference_words bigint"
SCORED = "n_words bigint, phrases bigint, own_phrases bigint, reference_words bigint, cross_entropy double, own_entropy double, score double, corpus_phrases bigint, corpus_entropy double"


def rounds(context: int) -> list[range]:
    """The run lengths that each exchange asks for: 1 and 2, 3 and 4, 5 to 8, 9 to 16 and so on."""
    out, low, high = [], 1, min(2, context)
    while low <= context:
        out.append(range(low, high + 1))
        low, high = high + 1, min(2 * high, context)
    return out


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of whole numbers, all highest ones first: small numbers then compress well."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T.tobytes()


def _from_planes(data: bytes | np.ndarray, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, 8 - width :] = planes.T
    return out.view(">u8")[:, 0].astype(np.uint64)


def _packed(x: bytes | np.ndarray) -> bytes:
    return pa.compress(x if isinstance(x, bytes) else x.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, "zstd"), dtype=np.uint8)


class Codes(dict):
    """Words to numbers in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


class Block:
    """Some documents: word codes, the hashes of the words, which documents are reference text, and match lengths so far.

    shared and matched: of each word the length, up to the context, of the longest run from there that is in another
    document, and in another document that is reference text.
    """

    def __init__(self, sizes: np.ndarray, vocabulary: np.ndarray, codes: np.ndarray, reference: np.ndarray, shared: np.ndarray, matched: np.ndarray):
        self.sizes, self.vocabulary, self.codes, self.reference, self.shared, self.matched = sizes, vocabulary, codes, reference, shared, matched
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.end = np.repeat(np.cumsum(sizes), sizes)

    @classmethod
    def read(cls, row: dict) -> Block:
        n = row["words"]
        codes, shared, matched = (_unpacked(row[name], size) for name, size in (("codes", 4 * n), ("shared", n), ("matched", n)))
        sizes, reference = (np.frombuffer(row[name], dtype=kind) for name, kind in (("sizes", np.int32), ("reference", np.uint8)))
        return cls(sizes, _from_planes(row["vocabulary"], WORD_BITS // 8), _from_planes(codes, 4).astype(np.int32), reference, shared, matched)

    def row(self) -> list:
        n = int(self.sizes.sum())
        return [self.sizes.tobytes(), _planes(self.vocabulary, WORD_BITS // 8), _packed(_planes(self.codes, 4)), self.reference.tobytes(), _packed(self.shared), _packed(self.matched), n, int(self.sizes[self.reference > 0].sum())]

    def runs(self, lengths: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, length) of every run of these lengths whose shorter runs all occur in other documents."""
        words = self.vocabulary[self.codes]
        n = len(words)
        known = lengths[0] - 1
        fits = self.shared >= known
        hashes = np.zeros(n, dtype=np.uint64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(1, min(lengths[-1], n) + 1):
            hashes = hashes[: n - k + 1] * STEP + words[k - 1 :]
            if k < lengths[0]:
                continue
            if k > max(known, 1):
                fits = fits[:-1] & (self.shared[k - known :] >= known if known else True)
            at = np.flatnonzero(fits & (np.arange(len(fits)) + k <= self.end[: len(fits)]))
            x = hashes[at] ^ np.uint64(k * int(MIX) % (1 << 64))
            x = (x ^ (x >> np.uint64(31))) * MIX
            out.append((x ^ (x >> np.uint64(29)), at, np.full(len(at), k, dtype=np.uint8)))
        return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    def asked(self, lengths: range) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, sorted, and of each the number of documents (1, 2 for more) plus 4 times that of reference documents (0, 1, 2)."""
        hashes, start, _ = self.runs(lengths)
        if not len(hashes):
            return hashes, np.zeros(0, dtype=np.uint8)
        order = np.argsort(hashes)
        hashes, owner = hashes[order], self.owner[start[order]]
        at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        known = self.reference[owner] > 0
        low, high = (f.reduceat(owner, at) for f in (np.minimum, np.maximum))
        first, last = np.minimum.reduceat(np.where(known, owner, len(self.sizes)), at), np.maximum.reduceat(np.where(known, owner, -1), at)
        return hashes[at], (1 + (low < high) + 4 * ((last >= 0) + (first < last).astype(np.int8))).astype(np.uint8)

    def told(self, lengths: range, answer: np.ndarray) -> None:
        """Takes in the answers to ``asked``: both counts over all documents."""
        hashes, start, length = self.runs(lengths)
        total = np.zeros(len(hashes), dtype=np.uint8)
        if len(hashes):
            order = np.argsort(hashes)
            new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])
            total[order] = answer[np.cumsum(new) - 1]
        shared = (total & 3) > 1
        matched = (total >> 2) > self.reference[self.owner[start]]
        self.shared, self.matched = self.shared.copy(), self.matched.copy()
        for k in lengths:
            own = length == k
            self.shared[start[own & shared]] = k
            self.matched[start[own & matched]] = k

    def phrase_lengths(self, matches: np.ndarray, context: int) -> np.ndarray:
        """The length of the phrase that would start at each word."""
        end = np.where(matches < context, np.arange(len(matches)), len(matches))
        end = np.minimum.accumulate(end[::-1])[::-1]  # where the run of full matches ends
        return np.where(matches < context, np.maximum(matches, 1), end - np.arange(len(matches)) + context - 1)


def count_phrases(lengths: list[int]) -> int:
    """The number of phrases of a text, given the length of the one that would start at each of its words."""
    at = count = 0
    n = len(lengths)
    while at < n:
        at += lengths[at]
        count += 1
    return count


def own_phrases(words: list) -> int:
    """The number of Lempel-Ziv 78 phrases of a text."""
    nodes: dict[tuple, int] = {}
    find = nodes.get
    node = count = 0
    for word in words:
        key = (node, word)
        to = find(key)
        if to is None:
            count += 1
            nodes[key] = count
            node = 0
        else:
            node = to
    return count + (node > 0)


def scores(n: int, phrases: int, own: int, reference: int) -> tuple[float | None, float, float | None]:
    """(cross-entropy, own entropy, relative entropy) in bits a word."""
    itself = own * math.log2(own) / n if own else 0.0
    if not reference:
        return None, itself, None
    cross = phrases * math.log2(reference + 1) / n if n else 0.0
    return cross, itself, cross - itself


def _blocks(kind: str, block_words: int):
    """Over rows (id, text): rows (block, ids, state) of whole documents with about so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        ids, sizes, codes, held = [], [], [], 0
        table = Codes()

        def block() -> pa.RecordBatch:
            nonlocal number
            own = Block(np.array(sizes, np.int32), np.fromiter((xxhash.xxh64_intdigest(w, 7) & WORD_MASK for w in table), np.uint64, len(table)), np.concatenate(codes), *[np.zeros(n, np.uint8) for n in (len(sizes), held, held)])
            columns = [pa.array([task | number], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), *[pa.array([x]) for x in own.row()]]
            number += 1
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", *[x.split()[0] for x in STATE.split(", ")]])

        for batch in batches:
            for i, text in enumerate(texts_in(batch.column(1))):
                words = bytes_of(text).split()
                ids.append(batch.column(0).slice(i, 1))
                sizes.append(len(words))
                codes.append(np.fromiter(map(table.__getitem__, words), np.int32, len(words)))
                held += len(words)
                if held >= block_words or 16 * len(sizes) >= block_words:
                    yield block()
                    ids, sizes, codes, held, table = [], [], [], 0, Codes()
        if sizes:
            yield block()
        release_memory()

    return run


def _asks(lengths: range, part_bits: int):
    """Over rows (block, state): the block's messages (part, block, hashes, counts).

    A hash's first bits name its part, the next ones tell it apart there. They are sent as steps from one to the next, packed.
    """
    shift, mask = np.uint64(64 - KEY_BITS - part_bits), np.uint64((1 << KEY_BITS) - 1)
    bounds = np.array([p << (64 - part_bits) for p in range(1, 1 << part_bits)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                hashes, counts = Block.read(row).asked(lengths)
                cuts = np.concatenate(([0], np.searchsorted(hashes, bounds), [len(hashes)]))
                some = np.flatnonzero(np.diff(cuts))
                hashes = (hashes >> shift) & mask
                steps = np.diff(hashes, prepend=np.uint64(0))
                steps[cuts[some]] = hashes[cuts[some]]
                spans = list(zip(cuts[some].tolist(), cuts[some + 1].tolist()))
                messages = [[_packed(_planes(steps[a:b], KEY_BITS // 8)) for a, b in spans], [_packed(counts[a:b]) for a, b in spans]]
                columns = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), row["block"], np.int64)), pa.array([b - a for a, b in spans], pa.int32()), *[pa.array(x, pa.binary()) for x in messages]]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "size", "hashes", "counts"])
        release_memory()

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over messages sorted by part: (block, part, answer), the counts of each message's hashes over all blocks."""

    def answer(part: int, blocks: list[int], messages: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        kinds, inverse = np.unique(np.concatenate(messages), return_inverse=True)
        own = np.concatenate(counts)
        total = sum(np.minimum(np.bincount(inverse, weights=(own >> shift) & 3, minlength=len(kinds)), 2).astype(np.uint8) << shift for shift in (0, 2))
        told, cuts = total[inverse], ranges_of(np.array([len(m) for m in messages]))
        sizes = np.diff(cuts).tolist()
        answers = pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array([_packed(told[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["size", "counts"])
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([part] * len(blocks), pa.int32()), answers], names=["block", "part", "answer"])

    here, blocks, messages, counts = -1, [], [], []
    for batch in batches:
        for i, part in enumerate(batch.column(0).to_pylist()):
            if part != here:
                if blocks:
                    yield answer(here, blocks, messages, counts)
                here, blocks, messages, counts = part, [], [], []
            blocks.append(batch.column(1)[i].as_py())
            size = batch.column(2)[i].as_py()
            messages.append(np.cumsum(_from_planes(_unpacked(batch.column(3)[i].as_py(), size * KEY_BITS // 8), KEY_BITS // 8)))
            counts.append(_unpacked(batch.column(4)[i].as_py(), size))
    if blocks:
        yield answer(here, blocks, messages, counts)
    release_memory()


def _with_answers(lengths: range | None, finish):
    """Over rows of blocks, each followed by its answers in order of part: what ``finish`` makes of a block's first row and the block.

    Without ``lengths`` the answers are the numbers of the documents that are reference text.
    """

    def taken(row: dict, answers: list) -> Iterator[pa.RecordBatch]:
        own = Block.read(row)
        if lengths:
            own.told(lengths, np.concatenate([_unpacked(x["counts"], x["size"]) for x in answers] or [np.zeros(0, np.uint8)]))
        else:
            own.reference = own.reference.copy()
            own.reference[[i for rows in answers for i in rows]] = 1
        yield from finish(row, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, answers = None, []
        for batch in batches:
            parts, told = batch.column(1).to_pylist(), batch.column(batch.num_columns - 1)
            for i, part in enumerate(parts):
                if part < 0:
                    if row:
                        yield from taken(row, answers)
                    row, answers = batch.slice(i, 1).to_pylist()[0], []
                else:
                    answers.append(told[i].as_py())
        if row:
            yield from taken(row, answers)
        release_memory()

    return run


def _joined(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks (part -1), each followed by its answers; both sides have (block, part, answer)."""
    rows = blocks.withColumns({"part": F.lit(-1), "answer": F.lit(None).cast(answers.schema["answer"].dataType)}).select("block", "part", "ids", *[x.split()[0] for x in STATE.split(", ")], "answer")
    rest = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[2:-1]]
    return rows.unionByName(answers.select("block", "part", *rest, "answer")).repartition("block").sortWithinPartitions("block", "part")


def _keep(kind: pa.DataType):
    def finish(row: dict, own: Block) -> Iterator[pa.RecordBatch]:
        columns = [pa.array([row["block"]], pa.int64()), pa.array([row["ids"]], pa.list_(kind)), *[pa.array([x]) for x in own.row()]]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", *[x.split()[0] for x in STATE.split(", ")]])

    return finish


def _score(kind: pa.DataType, context: int, total: int, reference: int):
    names = ["id", *[x.split()[0] for x in SCORED.split(", ")]]
    kinds = [pa.float64() if x.endswith("double") else pa.int64() for x in SCORED.split(", ")]

    def finish(row: dict, own: Block) -> Iterator[pa.RecordBatch]:
        matched, shared = (own.phrase_lengths(x, context) for x in (own.matched, own.shared))
        cuts = ranges_of(own.sizes)
        out = []
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            n = b - a
            phrases, among, itself = count_phrases(matched[a:b].tolist()), count_phrases(shared[a:b].tolist()), own_phrases(own.codes[a:b].tolist())
            size = reference - (n if own.reference[i] else 0)
            out.append((n, phrases, itself, size, *scores(n, phrases, itself, size), among, scores(n, among, itself, total - n)[0]))
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), *[pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]], names=names)

    return finish


def score(docs: DataFrame, reference_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = 8, block_words: int = 1 << 20, part_words: int = 1 << 20) -> DataFrame:
    """(id, n_words, phrases, own_phrases, reference_words, cross_entropy, own_entropy, score, corpus_phrases, corpus_entropy) of every document.

    The reference text is that of the documents whose ids are in ``reference_ids`` (column ``id_col``).
    """
    if context < 2:
        raise ValueError("context must be at least 2")
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    kept = f"block bigint, ids array<{kind}>, {STATE}"
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    read = materialise(narrow.mapInArrow(_blocks(kind, block_words), kept), "blocks")
    places = read.select("block", F.posexplode("ids").alias("at", "id")).join(reference_ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    flags = places.groupBy("block").agg(F.collect_list("at").alias("answer")).withColumn("part", F.lit(0))
    blocks = materialise(_joined(read, flags).mapInArrow(_with_answers(None, _keep(arrow)), kept), "blocks")
    discard(read)
    total, reference = (x or 0 for x in blocks.agg(F.sum("words"), F.sum("reference_words")).first())
    part_bits = max(0, min(-(-total // part_words) - 1, block_words // 64)).bit_length()
    steps = rounds(context)
    for lengths in steps:
        asks = blocks.drop("ids").mapInArrow(_asks(lengths, part_bits), "part int, block bigint, size int, hashes binary, counts binary")
        answers = asks.repartition("part").sortWithinPartitions("part").mapInArrow(_answers, "block bigint, part int, answer struct<size: int, counts: binary>")
        rows = _joined(blocks, answers)
        if lengths is steps[-1]:
            return rows.mapInArrow(_with_answers(lengths, _score(arrow, context, total, reference)), f"id {kind}, {SCORED}")
        before, blocks = blocks, materialise(rows.mapInArrow(_with_answers(lengths, _keep(arrow)), kept), "blocks")
        discard(before)

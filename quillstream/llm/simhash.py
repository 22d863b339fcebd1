"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A document's fingerprint has 64 bits; bit i is one if it is set in more than half of the hashes of the document's word
shingles (repeats count). Two fingerprints are linked if they differ in at most ``radius`` bits.

Candidate search is a covering code rather than a random one: bit i gets a non-zero vector m(i) of radius+1 bits, and for
each non-zero vector v there is a mask of the bits with <m(i), v> odd. Up to ``radius`` differing bits span a space of
dimension at most ``radius``, so some v is orthogonal to all of them, and under that mask both fingerprints are equal.
Thus 2^(radius+1) - 1 tables find every linked pair, with certainty.

Scale: only distinct fingerprints take part (copies collapse in a pre-aggregated groupBy), so a group of copies that holds
a third of all rows is one fingerprint. Buckets are runs of a sorted partition, read as a stream. A bucket of at most
``bucket_rows`` fingerprints is compared in memory and yields a spanning forest of its links, never all its pairs. A larger
one is passed on: the bits that its mask leaves free are cut into radius+1 parts, of which at least one agrees between
linked fingerprints, and its members go into the narrower buckets of the next round. With 11 free bits a bucket can't hold
more than 2048 fingerprints, so this ends. Components come from large-star/small-star rounds over tables in the shared
folder; links and labels never reach the driver.

``keep_one`` links texts at a Jaccard similarity of 0.8 on five-word shingles. Texts whose fingerprints are linked are compared
by their shingle sets, as unlike texts of one template can have near fingerprints. Other pairs at 0.8 differ in four to fifteen bits, far
beyond what covering tables can reach (2^(radius+1) - 1 of them), so an exact set join finds these: shingles have
one order, rare ones first, and two texts of n shingles each at similarity s share one of the first n - ceil(s n) + 1 of each.
Texts meet in a bucket for every such shingle, and are a pair if the places of the shingle leave room for enough shared ones
from there on (there is such a bucket, that of the first one that they share). Of larger buckets each member is first compared with the
head and the one before; what that links is one component already, and then every pair that is still apart is compared. A pair
goes on only if the parities of 1024 classes of its shingles leave it similar, so pages of one template with few words in their
slots, which meet in many buckets, don't become tables of all their pairs.
A pair whose first shingles share too few of each other is dropped by those alone; the exact similarity of the shingle sets
decides on the rest, so no pair is lost. The order rests on a sample of texts: it sets how many pairs are compared, never
which are found.

Defined cases: null texts count as empty; texts without words have fingerprint zero and are linked like any other; rows
with a null id take part, and a component's id is its smallest non-null id (null if it has none); repeated rows each
get their row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import discard, materialise, ranges_of, release_memory, slices, text_of, texts_in, whole_rows

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
CHUNK = 1 << 17
ORDER_TEXTS, ORDER_SHINGLES = 20_000, 200_000
PARITY_BITS = 1024


def shingle_hashes(text: str | None, shingle_words: int) -> Iterator[np.ndarray]:
    """The XXH64 digests (seed 42) of a text's word shingles, repeats included, as rows of eight bytes, in chunks."""
    words = text_of(text).encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return
    k = min(shingle_words, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    joined = b" ".join(words)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - k + 1
    digest = xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())
        yield np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in spans]), dtype=np.uint8).reshape(-1, 8)


class Majority:
    """Counts set bits of digests; the fingerprint has those that are set in over half of them."""

    def __init__(self):
        self.ones, self.n = np.zeros((8, 8), dtype=np.int64), 0

    def add(self, digests: np.ndarray) -> None:
        self.n += len(digests)
        for byte in range(8):
            self.ones[byte] += np.bincount(digests[:, byte], minlength=256) @ BYTE_BITS

    def value(self) -> int:
        return int.from_bytes(np.packbits((2 * self.ones > self.n).astype(np.uint8).reshape(64)).tobytes(), "big")


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text."""
    bits = Majority()
    for digests in shingle_hashes(text, shingle_words):
        bits.add(digests)
    return bits.value()


def shingle_set(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; texts without words all have the one hash 0."""
    parts = [d.view(">u8")[:, 0].astype(np.uint64) for d in shingle_hashes(text, shingle_words)]
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(1, dtype=np.int64)


def masks(radius: int) -> list[int]:
    """The covering masks, as unsigned 64-bit numbers."""
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def narrower(mask: int, radius: int) -> list[int]:
    """The mask widened by each of radius+1 parts of the bits that it leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[p :: radius + 1]) for p in range(radius + 1)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, text_hash, fp): the id, a hash of the text that tells repeated rows apart, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in texts_in(batch.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["id", "text_hash", "fp"])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, text_hash bigint, fp bigint")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket of distinct fingerprints (uint64)."""
    left = np.ones(len(fps), dtype=bool)
    out: list[tuple[int, int]] = []
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[at]) <= radius))
            left[near] = False
            queue.extend(near.tolist())
            out.extend((at, j) for j in near.tolist())
    return out


def _links_of_buckets(radius: int, bucket_rows: int):
    """Arrow function over rows (mask, key, fp) sorted by all three: links (kind 0) and rows for narrower masks (kind 1)."""
    names = ["kind", "a", "b"]

    def pack(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=names)

    def split(mask: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for wider in narrower(mask & (1 << 64) - 1, radius):
            yield pack(1, np.full(len(fps), signed(wider), dtype=np.int64), fps)

    def bucket(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(fps) > 1 and (found := _forest(fps.view(np.uint64), radius)):
            at = np.array(found, dtype=np.int64)
            a, b = fps[at[:, 0]], fps[at[:, 1]]
            yield pack(0, np.maximum(a, b), np.minimum(a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # mask, key, arrays of the open bucket; arrays is None once it has been passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(fp)]))
            first, last = 0, len(starts)
            # The open bucket goes on, or ends here.
            if held and held[0] == mask[0] and held[1] == key[0]:
                part = fp[: ends[0]]
                if held[2] is None:
                    yield from split(held[0], part)
                else:
                    held[2].append(part)
                first = 1
            elif held and held[2] is not None:
                yield from bucket(np.concatenate(held[2]))
                held = None
            else:
                held = None
            if first == 0 or last > 1:
                if first == 1 and held[2] is not None:
                    yield from bucket(np.concatenate(held[2]))
                # Whole buckets of two are compared at once, larger ones by themselves.
                sizes = ends - starts
                inner = np.arange(first, last - 1)
                twos = starts[inner[sizes[inner] == 2]]
                if len(twos):
                    a, b = fp[twos], fp[twos + 1]
                    near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
                    if near.any():
                        yield pack(0, np.maximum(a, b)[near], np.minimum(a, b)[near])
                for i in inner[sizes[inner] > 2].tolist():
                    run_of = fp[starts[i] : ends[i]]
                    yield from (bucket(run_of) if len(run_of) <= bucket_rows else split(int(mask[starts[i]]), run_of))
                held = (int(mask[-1]), int(key[-1]), [fp[starts[-1] :].copy()])
            if held[2] is not None and sum(map(len, held[2])) > bucket_rows:
                for part in held[2]:
                    yield from split(held[0], part)
                held = (held[0], held[1], None)
        if held and held[2] is not None:
            yield from bucket(np.concatenate(held[2]))

    return run


def links(fps: DataFrame, radius: int = 3, bucket_rows: int = 2048) -> DataFrame:
    """Links (a > b) that connect what pairs of distinct fingerprints (column fp) within the radius connect."""
    if bucket_rows < 2048:
        floor = max(4, bucket_rows.bit_length() - 1)
    else:
        floor = 11
    if 2**floor > bucket_rows:
        raise ValueError("bucket_rows must be at least 16")
    tables = F.array(*[F.lit(signed(m)) for m in masks(radius)])
    rows = fps.select(F.explode(tables).alias("mask"), "fp")
    found: DataFrame | None = None
    while True:
        keyed = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        if found is not None:  # the same narrow bucket can be reached from several wide ones
            keyed = keyed.distinct()
        out = materialise(keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_links_of_buckets(radius, bucket_rows), "kind int, a bigint, b bigint"), "links")
        new = out.where("kind = 0").select("a", "b")
        found = new if found is None else found.unionByName(new)
        rows = out.where("kind = 1").select(F.col("a").alias("mask"), F.col("b").alias("fp"))
        if rows.isEmpty():
            return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Large-star and small-star rounds: each round points nodes to smaller neighbours' minima until only stars are left.
    Minima are pre-aggregated; a node with a great many links is joined to its one minimum, which adaptive execution
    splits if it is skewed.
    """
    stars = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)))).first())
    before = mark(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        old, stars = stars, materialise(small, "stars")
        discard(old)
        now = mark(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(marked: DataFrame, radius: int = 3, bucket_rows: int = 2048, edges: DataFrame | None = None) -> DataFrame:
    """(fp, first): every distinct fingerprint of ``marked`` (id, text_hash, fp) with the first row of its component.

    ``first`` is struct(no_id, id, text_hash), the least in that order, so rows without an id come last. ``edges`` (a, b)
    take the place of the fingerprints' links.
    """
    row = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("text_hash"))
    distinct = materialise(marked.groupBy("fp").agg(F.min(row).alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius, bucket_rows) if edges is None else edges)
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    alone = placed.where("root IS NULL").select("fp", "first")
    linked = materialise(placed.where("root IS NOT NULL"), "linked")
    firsts = linked.groupBy("root").agg(F.min("first").alias("first"))
    return alone.unionByName(linked.drop("first").join(firsts, "root").select("fp", "first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 3, bucket_rows: int = 2048) -> DataFrame:
    """One row per document: (id, fp, component): its fingerprint as a signed long, the smallest id that links reach."""
    marked = materialise(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    return marked.join(classes(marked, radius, bucket_rows), "fp").select("id", "fp", F.col("first.id").alias("component"))


def _all_shingles(shingle_words: int):
    """Over rows (text_hash, text): the shingles of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in texts_in(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle_words))], names=["shingle"])

    return run


def _parity(shingles: np.ndarray) -> bytes:
    """Of each hash class the parity of its number of shingles: two sets differ by at least as many shingles as classes."""
    return np.packbits((np.bincount(shingles & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes()


PREFIX = "text_hash bigint, n int, prefix array<bigint>, small array<int>, rest int, last_count bigint, last_key bigint, parity binary"


def _prefixes(shingle_words: int, similarity: float, common: np.ndarray, counts: np.ndarray):
    """Over rows (text_hash, text): the first shingles of each text's n, in order of count and hash.

    small: 32 bits of each; rest: how many shared shingles they don't show (the ones after them, or with equal 32 bits); last_count and
    last_key: the last one's place in the order; parity: whether the number of shingles of each of 1024 hash classes is odd.
    """

    def first(shingles: np.ndarray) -> tuple[np.ndarray, int]:
        want = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1
        if not len(common):
            return shingles[:want], 0
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        often = common[at] == shingles
        rare = shingles[~often]
        if len(rare) >= want:
            return rare[:want], 0
        rest, known = shingles[often], counts[at[often]]
        order = np.argsort(known, kind="stable")[: want - len(rare)]
        return np.concatenate((rare, rest[order])), int(known[order[-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 512):
                rows: list[list] = [[] for _ in PREFIX.split(", ")[1:]]
                for text in texts_in(part.column(1)):
                    shingles = shingle_set(text, shingle_words)
                    found, last = first(shingles)
                    small = found.astype(np.uint64).astype(np.uint32).view(np.int32)
                    for column, x in zip(rows, (len(shingles), found, small, len(shingles) - len(np.unique(small)), last, int(found[-1]) ^ -(1 << 63), _parity(shingles))):
                        column.append(x)
                offsets = ranges_of(np.array([len(x) for x in rows[1]])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in rows[1:3]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows[0], pa.int32()), *lists, pa.array(rows[3], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[4:6]], pa.array(rows[6], pa.binary())], names=[x.split()[0] for x in PREFIX.split(", ")])
        release_memory()

    return run


def _buckets(columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[list[np.ndarray]]]:
    """Turns batches sorted by their first column into the arrays of one bucket after another, a batch's whole buckets at once.

    A binary column of equal lengths becomes rows of 64-bit words.
    """

    def values(column: pa.Array) -> np.ndarray:
        if not pa.types.is_binary(column.type):
            return column.to_numpy()
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [values(batch.column(i)) for i in range(columns)]
            cuts = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
            if held and held[-1][0][-1] != now[0][0]:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            if len(cuts):
                held.append([x[: cuts[-1]] for x in now])
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
                now = [x[cuts[-1] :].copy() for x in now]
            held.append(now)
        if held:
            yield [np.concatenate(x) for x in zip(*held)]

    return run


def _room(similarity: float, n: np.ndarray, at: np.ndarray, i, j) -> np.ndarray:
    """Whether members i and j, whose shingle of this bucket is in place ``at`` of n, can be similar with it as the first they share."""
    return np.minimum(n[i] - at[i], n[j] - at[j]) >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6


def _neighbours(similarity: float):
    """Over rows (shingle, text_hash, n, at) sorted by the first two: of each bucket each member with its head and the one before
    (kind 0: a, b), and the members of buckets of three or more (kind 1: shingle, text_hash, n, at)."""

    def pack(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *map(pa.array, columns)], names=["kind", "a", "b", "n", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, text, n, place in _buckets(4)(batches):
            new = np.append(True, shingle[1:] != shingle[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(text)))
            head = np.repeat(starts, sizes)
            at = np.flatnonzero(~new)
            other = np.concatenate((head[at], at - 1))
            at = np.concatenate((at, at))
            fits = _room(similarity, n, place, at, other)
            pairs = np.unique(np.stack((np.maximum(text[at], text[other])[fits], np.minimum(text[at], text[other])[fits])), axis=1)
            none = np.zeros(pairs.shape[1], dtype=np.int32)
            yield pack(0, pairs[0], pairs[1], none, none)
            large = np.repeat(sizes > 2, sizes)
            yield pack(1, shingle[large], text[large], n[large], place[large])

    return run


def _apart(similarity: float):
    """Over rows (shingle, root, text_hash, n, at, parity) sorted by the first two: the pairs (a, b) of each bucket that no component
    holds yet, but for those whose parities show that too many shingles differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, root, text, n, place, parity in _buckets(6)(batches):
            starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
            ends = np.append(starts[1:], len(shingle))
            mixed = root[starts] != root[ends - 1]
            found: list[np.ndarray] = []
            held = 0
            for start, end in zip(starts[mixed].tolist(), ends[mixed].tolist()):
                # Roots are sorted: of each run of a root, every member goes with all that come after the run.
                after = np.searchsorted(root[start:end], root[start:end], side="right") + start
                for i in range(start, end):
                    to = slice(int(after[i - start]), end)
                    if to.start == end:
                        break
                    fits = np.flatnonzero(_room(similarity, n, place, to, i)) + to.start
                    differ = np.bitwise_count(parity[fits] ^ parity[i]).sum(axis=1, dtype=np.int64)
                    others = text[fits[differ <= (1 - similarity) / (1 + similarity) * (n[fits] + n[i]) + 1e-6]]
                    if len(others):
                        found.append(np.stack((np.maximum(others, text[i]), np.minimum(others, text[i]))))
                        held += len(others)
                    if held > CHUNK * 4:
                        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                        found, held = [], 0
            if found:
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _shingle_sets(shingle_words: int):
    """Over rows (text_hash, text): the text's hash and its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 512):
                sets = [shingle_set(t, shingle_words) for t in texts_in(part.column(1))]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets), pa.int64()))], names=["text_hash", "shingles"])
        release_memory()

    return run


def _likely(pairs: DataFrame, prefixes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose first shingles don't rule them out: what they share there, and all after the earlier end, reaches what it takes."""
    names = ["n", "small", "rest", "last"]
    known = prefixes.select("text_hash", "n", "small", "rest", F.struct("last_count", "last_key").alias("last"))
    left, right = (known.select(F.col("text_hash").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in names]) for p in ("a", "b"))
    most = F.size(F.array_intersect("a_small", "b_small")) + F.when(F.col("a_last") <= F.col("b_last"), F.col("a_rest")).otherwise(F.col("b_rest"))
    return pairs.join(left, "a").join(right, "b").where(most >= F.lit(similarity / (1 + similarity)) * (F.col("a_n") + F.col("b_n")) - 1e-6).select("a", "b")


def _verified(pairs: DataFrame, prefixes: DataFrame, keyed: DataFrame, rows: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """The pairs (a, b) of text hashes whose texts share at least so much of their shingles. Only the texts of likely pairs are joined."""
    likely = materialise(_likely(pairs, prefixes, similarity), "likely")
    asked = likely.select(F.col("a").alias("__text")).unionByName(likely.select(F.col("b").alias("__text"))).distinct()
    wanted = rows.join(asked, "__text")
    texts = keyed.join(wanted.hint("shuffle_hash"), ["__text", "__row"]).select("__text", "text").mapInArrow(_shingle_sets(shingle_words), "text_hash bigint, shingles array<bigint>")
    sets = materialise(texts.dropDuplicates(["text_hash"]), "shingles")
    left, right = (sets.select(F.col("text_hash").alias(p), F.col("shingles").alias(x)) for p, x in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    all_of = F.size("x") + F.size("y") - both
    found = materialise(likely.join(left, "a").join(right, "b").where(both >= F.lit(similarity) * all_of).select("a", "b"), "verified")
    discard(sets)
    discard(likely)
    return found


def fingerprint_pairs(marked: DataFrame, radius: int) -> DataFrame:
    """Pairs (a > b) of text hashes that connect the texts whose fingerprints the radius connects, equal ones included.

    ``marked`` has (text_hash, fp); of each fingerprint the least text hash stands for it in its links.
    """
    texts = materialise(marked.select("fp", "text_hash").distinct(), "fingerprinted")
    heads = texts.groupBy("fp").agg(F.min("text_hash").alias("head"))
    equal = texts.join(heads, "fp").where("text_hash <> head").select(F.col("text_hash").alias("a"), F.col("head").alias("b"))
    left, right = (heads.select(F.col("fp").alias(p), F.col("head").alias(x)) for p, x in (("a", "x"), ("b", "y")))
    near = links(heads.select("fp"), radius).join(left, "a").join(right, "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return equal.unionByName(near)


def similar(marked: DataFrame, keyed: DataFrame, similarity: float, shingle_words: int, radius: int = 3) -> DataFrame:
    """Links (a > b) between text hashes that connect what all pairs of at least this similarity connect.

    ``marked`` has (id, text_hash, fp), ``keyed`` the texts with their keys (__text, __row, text); rows of one text hash are one text.
    """
    rows = materialise(marked.groupBy("text_hash").agg(F.min(F.xxhash64("id")).alias("__row")).withColumnRenamed("text_hash", "__text"), "texts")
    texts = keyed.select(F.col("__text").alias("text_hash"), "text")
    top = 1 << 30
    share = int(min(1.0, ORDER_TEXTS / max(rows.count(), 1)) * top)
    sample = texts.where(F.pmod(F.xxhash64(F.lit(3), "text_hash"), F.lit(top)) < share).mapInArrow(_all_shingles(shingle_words), "shingle bigint")
    often = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).toArrow()
    common, counts = (often.column(i).to_numpy() for i in range(2))
    by_hash = np.argsort(common)
    prefixes = materialise(texts.mapInArrow(_prefixes(shingle_words, similarity, common[by_hash], counts[by_hash]), PREFIX).dropDuplicates(["text_hash"]), "prefixes")
    members = prefixes.select("text_hash", "n", F.posexplode("prefix").alias("at", "shingle")).select("shingle", "text_hash", "n", "at")
    met = materialise(members.repartition("shingle").sortWithinPartitions("shingle", "text_hash").mapInArrow(_neighbours(similarity), "kind int, a bigint, b bigint, n int, at int"), "met")
    near = materialise(met.where("kind = 0").select("a", "b").unionByName(fingerprint_pairs(marked, radius)).distinct(), "pairs")
    linked = _verified(near, prefixes, keyed, rows, similarity, shingle_words)
    roots = components(linked)
    members = met.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("node"), "n", "at").join(roots, "node", "left")
    members = members.select("shingle", F.coalesce("root", "node").alias("root"), F.col("node").alias("text_hash"), "n", "at")
    mixed = members.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("shingle")
    members = members.join(mixed, "shingle", "left_semi").join(prefixes.select("text_hash", "parity"), "text_hash").select("shingle", "root", "text_hash", "n", "at", "parity")
    apart = members.repartition("shingle").sortWithinPartitions("shingle", "root").mapInArrow(_apart(similarity), "a bigint, b bigint")
    rest = materialise(apart.distinct().join(near, ["a", "b"], "left_anti"), "apart")
    discard(met)
    more = _verified(rest, prefixes, keyed, rows, similarity, shingle_words)
    for table in (near, rest, rows, prefixes):
        discard(table)
    return linked.unionByName(more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, fingerprint_words: int = 3, radius: int = 3) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays, once.

    Candidates are texts with fingerprints within ``radius`` bits, and those of the exact join of shingle sets. Links are pairs of at least ``similarity``, and equal texts. Rows of the same id and text are one document.
    All columns are kept as they are. Texts are shuffled to verify pairs, and to keep the survivors.
    """
    keys = ["__text", "__row"]
    text = F.col(text_col).cast("string")
    row = {"__text": F.xxhash64(F.coalesce(text, F.lit(""))), "__row": F.xxhash64(id_col)}
    marked = materialise(fingerprints(docs, id_col, text_col, fingerprint_words), "marked")
    links_too = similar(marked, docs.select(*[value.alias(name) for name, value in row.items()], text.alias("text")), similarity, shingle_words, radius)
    firsts = classes(marked.withColumn("fp", F.col("text_hash")), edges=links_too).select(F.col("first.text_hash").alias("__text"), F.xxhash64("first.id").alias("__row")).distinct()
    stay = whole_rows(docs, **row).join(firsts.hint("shuffle_hash"), keys, "left_semi")
    return stay.dropDuplicates(keys).select("row.*")

"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of their ids, are cut into blocks. Block j (from 0) of a source that gets a of
every W slots may be released at slot floor(j W / a) and is due by slot ceil((j + 1) W / a); in every slot the released
block with the earliest deadline goes next. With weights that add up to one this meets all deadlines, so after any number
of slots each source has had its share to within less than one block.

Windows follow from the target weights themselves, in whole numbers of any size, and nothing is rounded: W and a are the
weights times a common factor. A phase lasts until some source has no block left; the next phase goes on with the others at
the same relative weights. Every document gets exactly one position; within a phase all deviations are below one block.

The driver schedules the blocks one by one and holds three numbers for each (24 bytes for ``block_docs`` documents); each
hash range gets those of its own blocks.

The numbering of documents within a source never gathers a source in one task: a source is cut into hash ranges of about
``range_rows`` documents, whose counts are aggregated first. The driver sees one row a range: the list of sources is part of the
weights, which are a parameter, and is taken to be of that size. Without weights a source gets a share in proportion to
its documents to the power ``alpha``.

Defined cases: documents without a source form a source of their own; sources that the weights don't name raise an error;
weights of sources without documents are left out; repeated rows each get their position (which of them comes first is open when
their ids are equal); an empty table gives an empty result. ``positions`` ignores extra columns;
``interleave`` keeps all, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate, count, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import whole_rows

SEED = 1
HASH_BITS = 40
LAST = (1 << 63) - 1


def whole_weights(weights: dict) -> dict:
    """Whole numbers in exactly the proportions of the weights."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    factor = math.lcm(*[x.denominator for x in exact.values()])
    whole = {s: int(x * factor) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def earliest(shares: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, release, deadline) of the block that each slot gets, without end: the earliest deadline among released blocks."""
    period = sum(shares)
    waiting = [(0, i, 0) for i in range(len(shares))]  # (release, source, block)
    ready: list[tuple[int, int, int, int]] = []  # (deadline, source, block, release)
    for slot in count():
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[i]), i, j, release))
        due, i, j, release = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        yield i, release, due
        heapq.heappush(waiting, ((j + 1) * period // shares[i], i, j + 1))


def schedule(shares: dict) -> dict:
    """The slots of each source in one period of sum(shares) slots."""
    names = sorted(shares, key=str)
    slots: dict = {s: [] for s in names}
    for slot, (i, _, _) in enumerate(islice(earliest([shares[s] for s in names]), sum(shares.values()))):
        slots[names[i]].append(slot)
    return slots


@dataclass
class Timetable:
    """Of a source, by block: slot, release and deadline; and of each of its phases the first block and the weight."""

    slot: array
    release: array
    deadline: array
    first_block: list
    weight: list


def timetables(blocks: dict, shares: dict) -> dict:
    """The timetable of every source that has blocks."""
    left = {s: n for s, n in blocks.items() if n}
    out = {s: Timetable(array("q"), array("q"), array("q"), [], []) for s in left}
    slot = 0
    while left:
        names = sorted(left, key=str)
        total = sum(shares[s] for s in names)
        for s in names:
            out[s].first_block.append(len(out[s].slot))
            out[s].weight.append(shares[s] / total)
        first = slot
        for i, release, due in earliest([shares[s] for s in names]):
            own = out[names[i]]
            own.slot.append(slot)
            own.release.append(first + release)
            own.deadline.append(min(first + due, LAST))
            slot += 1
            left[names[i]] -= 1
            if not left[names[i]]:
                del left[names[i]]
                break
    return out


def source_key(source_col: str):
    """A source's name as a text that is never null: "=name", or "" for none."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def _numbered(docs: DataFrame, range_rows: int) -> tuple[DataFrame, dict]:
    """The rows (id, source and others) with __source, __range and __row (from 1 within both), and by source the number of rows of each range."""
    hashed = docs.withColumns({"__source": source_key("source"), "__hash": F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("id")), 64 - HASH_BITS)})
    counts = {r["__source"]: r["n"] for r in hashed.groupBy("__source").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = F.lit(1)
    for s, n in counts.items():
        if n > range_rows:
            ranges = F.when(F.col("__source") == F.lit(s), F.lit(-(-n // range_rows))).otherwise(ranges)
    # Hashes are uniform, so equal ranges of them hold about equally many documents.
    placed = hashed.withColumn("__range", F.shiftright(F.col("__hash") * ranges.cast("long"), HASH_BITS))
    sizes: dict = {s: {} for s in counts}
    for r in placed.groupBy("__source", "__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__source", "__range").collect():
        sizes[r["__source"]][r["__range"]] = r["n"]
    within = Window.partitionBy("__source", "__range").orderBy("__hash", "id")
    return placed.withColumn("__row", F.row_number().over(within)).drop("__hash"), sizes


def _placed(docs: DataFrame, weights: dict | None, block_docs: int, alpha: float, range_rows: int) -> DataFrame:
    """The rows (id, source and others) with a struct __at: block, phase, release, deadline, slot, position, weight."""
    spark = docs.sparkSession
    ranked, sizes = _numbered(docs, range_rows)
    counts = {s: sum(x.values()) for s, x in sizes.items()}
    if weights is None:
        weights = {s: n**alpha for s, n in counts.items()}
    else:
        weights = {"" if s is None else f"={s}": w for s, w in weights.items()}
    if missing := [s for s in counts if s not in weights]:
        raise ValueError(f"sources without a weight: {sorted(map(str, missing))[:5]}")
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    tables = timetables(blocks, whole_weights({s: weights[s] for s in counts})) if counts else {}
    short = sorted((tables[s].slot[-1], blocks[s] * block_docs - n) for s, n in counts.items() if n % block_docs)
    rows = []
    for s, of in sizes.items():
        t = tables[s]
        for r, n, end in zip(of, of.values(), accumulate(of.values())):
            first, last = (end - n) // block_docs, (end - 1) // block_docs + 1
            rows.append((s, r, end - n, first, *(x[first:last] for x in (t.slot, t.release, t.deadline)), t.first_block, t.weight))
    names = ["__s", "__r", "__start", "__first", "__slots", "__releases", "__deadlines", "__phases", "__weights"]
    kinds = [pa.string(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 4, pa.list_(pa.float64())]
    table = spark.createDataFrame(pa.table([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names=names))
    # Both sides are partitioned by the keys, or the table is small: the documents aren't shuffled again.
    one = ranked.join(table, (F.col("__source") == F.col("__s")) & (F.col("__range") == F.col("__r")))
    rank = F.col("__start") + F.col("__row") - 1
    block = F.floor(rank / block_docs).cast("long") if block_docs > 1 else rank
    of = lambda name: F.get(name, (block - F.col("__first")).cast("int"))
    phase = F.size(F.filter("__phases", lambda x: x <= block)) - 1
    missing_before = F.lit(0)
    if short:
        literal = F.array(*[F.struct(F.lit(at).cast("long").alias("slot"), F.lit(gap).cast("long").alias("gap")) for at, gap in short])
        missing_before = F.aggregate(literal, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["slot"] < of("__slots"), x["gap"]).otherwise(F.lit(0)))
    position = of("__slots") * block_docs + rank % block_docs - missing_before
    struct = F.struct(block.alias("block"), phase.alias("phase"), of("__releases").alias("release"), of("__deadlines").alias("deadline"), of("__slots").alias("slot"), position.cast("long").alias("position"), F.get("__weights", phase).alias("weight"))
    return one.withColumn("__at", struct).drop(*names, "__source", "__range", "__row")


def positions(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, block_docs: int = 16, period: int | None = None, alpha: float = 0.5, range_rows: int = 50_000) -> DataFrame:
    """One row per document: id, source, block, phase, release, deadline, slot, position (from 0), weight (the target in its phase).

    ``period`` has no effect: weights aren't rounded to slots of a period.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    placed = _placed(narrow, weights, block_docs, alpha, range_rows)
    return placed.select("id", "source", "__at.*")


def interleave(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, block_docs: int = 16, period: int | None = None, alpha: float = 0.5, range_rows: int = 50_000) -> DataFrame:
    """The documents, all columns kept, in the order of the mix: partition after partition, and sorted within each."""
    placed = _placed(whole_rows(docs, id=F.col(id_col), source=F.col(source_col)), weights, block_docs, alpha, range_rows)
    return placed.repartitionByRange("__at.position").sortWithinPartitions("__at.position").select("row.*")


def stored_order(docs: DataFrame, position_col: str) -> DataFrame:
    """A table of Parquet files as ``interleave`` wrote it, with each row's place (from 0): files in order of name, and their rows.

    The driver sees one row a file; the texts aren't shuffled.
    """
    name = F.col("_metadata.file_name")
    sizes = docs.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()
    start, rows = 0, []
    for r in sorted(sizes, key=lambda r: r["name"]):
        rows.append((r["name"], start))
        start += r["n"]
    starts = docs.sparkSession.createDataFrame(rows, "name string, start bigint")
    kept = [c for c in docs.columns if c != position_col]
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), name.alias("name"), F.col("_metadata.row_index").alias("at"))
    return placed.join(F.broadcast(starts), "name").select("row.*", (F.col("start") + F.col("at")).alias(position_col))

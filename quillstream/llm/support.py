"""What several operators of this subpackage share: the shared scratch folder, table reading, text statistics."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is read from ``spark.checkpoint.dir``. Only a single-machine session (master ``local`` or ``local[...]``) may
    leave that unset; it then gets a temporary folder that goes when Python ends.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="quillstream-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set(CHECKPOINT_KEY, f"file://{base}")
    return f"file://{base}"


_written: dict[str, Callable[[], bool]] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: later jobs neither recompute it nor depend on its executors.

    The table goes with ``discard``, or else when Python ends: a result may be read until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if not _written:
        atexit.register(_discard_all)
    _written[path] = lambda: jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).delete(jvm.org.apache.hadoop.fs.Path(path), True)
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")  # the shuffle files go as soon as the table is there
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def discard(table: DataFrame) -> None:
    """Deletes a table that ``materialise`` returned; nothing may read it any more."""
    if delete := _written.pop(table._written_at, None):
        delete()


def _discard_all() -> None:
    while _written:
        try:
            _written.popitem()[1]()
        except Exception:  # the JVM has ended before Python
            return


def release_memory() -> None:
    """Gives a Python worker's freed memory back to the system at the end of a partition, as the next task there may be another operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def crc_bucket(id_col: str, n: int):
    """crc32 of the id's decimal text, modulo n: the split into learning and held-out rows."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def expected_sample(df: DataFrame, id_col: str, group_col: str | None, per_group: int, seed: int) -> DataFrame:
    """About ``per_group`` rows of each group, chosen by a hash of the id, so the same rows at every run.

    The counts of the groups are aggregated first; a row stays when its hash falls under the share that its group needs.
    The number of rows is therefore bounded in expectation by ``per_group`` times the number of groups, at any input size.
    """
    top = 1 << 30
    group = F.col(group_col).cast("string") if group_col else F.lit("")
    counts = {r["g"]: r["n"] for r in df.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(top))
    limit = F.lit(0)
    for g, n in sorted(counts.items(), key=lambda kv: (kv[0] is None, kv[0] or "")):
        share = int(min(1.0, per_group / max(n, 1)) * top)
        limit = F.when(group.eqNullSafe(F.lit(g)), F.lit(share)).otherwise(limit)
    return df.where(draw < limit)


def slices(batch: pa.RecordBatch, texts: int, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most so many rows and, but for single rows, so many bytes of the column numbered ``texts``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def texts_in(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The texts of an Arrow column, a few at a time: a batch's texts are never all Python strings at once."""
    for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0, rows):
        yield from part.column(0).to_pylist()


def whole_rows(docs: DataFrame, **keys) -> DataFrame:
    """The documents as one struct column ``row`` beside the keys: no name of theirs can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[value.alias(name) for name, value in keys.items()])


def text_of(value: str | None) -> str:
    return "" if value is None else value


def bytes_of(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class WordTable(dict):
    """A worker's bounded word table: words (bytes) to row numbers of ``table``, whose rows ``describe`` computes in bulk.

    It empties itself between documents once it holds ``limit`` words or ``size`` bytes of them: memory stays bounded and
    results don't depend on it.
    """

    def __init__(self, describe: Callable[[list[bytes]], np.ndarray], limit: int = 200_000, size: int = 16 << 20):
        super().__init__()
        self.describe, self.limit, self.size, self.held, self.new = describe, limit, size, 0, []
        self.table = self.empty = describe([])

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self.held += len(word)
        at = self[word] = len(self)
        return at

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The words' row numbers; afterwards ``table`` has all of them."""
        if len(self) >= self.limit or self.held > self.size:
            self.clear()
            self.held, self.table = 0, self.empty
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self.new:
            start, need = len(self) - len(self.new), len(self)
            if need > len(self.table):
                grown = np.zeros((max(need, 2 * len(self.table), 1024), *self.empty.shape[1:]), dtype=self.empty.dtype)
                grown[:start] = self.table[:start]
                self.table = grown
            self.table[start:need] = self.describe(self.new)
            self.new = []
        return ids


def ranges_of(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive runs with these lengths, and the total at the end."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out

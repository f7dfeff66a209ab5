"""What the operators of this subpackage share: scratch tables, folds and batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers live on after a task: what Arrow frees goes back to the system.
pa.set_memory_pool(pa.system_memory_pool())


def _trim(phase: str, info: dict[str, int]) -> None:
    """Spark's workers collect all garbage after each task: the pages that malloc then holds free go back too."""
    if phase == "stop" and info["generation"] == 2:
        _malloc_trim(0)


if _malloc_trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
    gc.callbacks.append(_trim)

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local one is made if driver and executors are one
    process (master ``local[...]``); on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def small_batches(spark: SparkSession) -> None:
    """Rows here are whole documents: unless the session says otherwise, Arrow batches get a thousand of them, not ten thousand.

    The setting stays, for results that are computed after the operator has returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written below the shared checkpoint folder while an operator runs.

    ``table`` cuts the lineage: what is read back survives a lost executor, and the
    shuffle files behind it go at once, so disk holds one step's shuffles at a time.
    ``free`` removes a table that nothing reads any more; all go when the block ends, so
    results that outlive it go through ``keep``.  Their files go with the last DataFrame
    that uses them where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set,
    and with the checkpoint folder otherwise.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.root = f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.clean_up = None
        self.paths: dict[int, str] = {}

    def __enter__(self) -> Scratch:
        self.clean_up = self.spark.conf.get(_CLEAN_UP)
        self.spark.conf.set(_CLEAN_UP, "true")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(_CLEAN_UP, self.clean_up)
        self.drop(self.root)

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Remove ``tables``, as ``table`` returned them; nothing that is still to be computed may read them."""
        for t in tables:
            self.drop(self.paths.pop(id(t)))

    def keep(self, df: DataFrame) -> DataFrame:
        return df.checkpoint(eager=True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of ``column``; one long text makes a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 bytes of a text column, null kept."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", most: int = 4 << 20) -> DataFrame:
    """Apply ``make`` to each piece of rows that hold at most ``most`` bytes of ``column`` together."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column, most):
            out = make(piece)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def most_frequent(df: DataFrame, count_col: str, most: int) -> DataFrame:
    """Rows of the largest counts, ``most`` of them at most, chosen by a histogram of fixed size.

    Counts of one logarithmic step of the histogram come together or not at all, so what
    a driver collects is bounded without any task that sees all rows.
    """
    step = F.floor(F.log2(F.col(count_col)) * 64).cast("int")
    found = df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = 1 << 30, 0
    for r in sorted(found, reverse=True):
        held += r["n"]
        if held > most:
            break
        least = r["step"]
    return df.filter(step >= least)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs to equal, other inputs to well spread outputs."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


#: Masks that keep the first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes, A-Z lower-cased, and where each word begins.

    Words are what ASCII white space parts.  A word is cut into chunks of eight bytes; its
    hash mixes its length with the sum of what each chunk and its place give, so the work
    is by words and not by bytes, and memory is in proportion to the text.
    """
    n = len(text)
    low = text.tobytes().lower() + bytes(8)
    raw = np.frombuffer(low, np.uint8, n)
    inside = (raw != 0x20) & (raw - np.uint8(9) > 4)
    turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lens = turns[::2], turns[1::2] - turns[::2]
    loads = np.ndarray((n + 1,), "<u8", low, 0, (1,))
    sums = mix64(loads[starts] & _FIRST[np.minimum(lens, 8)])
    long = np.flatnonzero(lens > 8)
    if len(long):
        more = (lens[long] - 1) // 8  # chunks beside the first
        begin = np.cumsum(more) - more
        k = np.arange(more.sum()) - np.repeat(begin, more) + 1
        rest = np.repeat(lens[long], more) - 8 * k
        chunks = loads[np.repeat(starts[long], more) + 8 * k] & _FIRST[np.minimum(rest, 8)]
        sums[long] += np.add.reduceat(mix64(chunks + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin)
    return mix64(sums + lens.astype(np.uint64)), starts


def joined(raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each ended by a line feed, and where each begins."""
    sizes = np.fromiter((len(r) + 1 if r else 1 for r in raws), np.int64, len(raws))
    return np.frombuffer(b"\n".join([r or b"" for r in raws] + [b""]), np.uint8), np.cumsum(sizes) - sizes

"""What the operators of this subpackage share: tables, staging, batches of text, hashing kernels.

Hashes are 64-bit polynomials over random byte values: `prefix[j] - prefix[i]`, divided by the
base's power at `i`, is the hash of the bytes from `i` to `j`, so that every substring's hash costs
two lookups once the prefix sums of a piece of text are known.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Text handed to numpy at once. A longer single document is handled alone.
PIECE_BYTES = 1 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows and bytes of one Arrow batch: bounds a Python worker's memory.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}

# Sketches of sets: so many columns of 64 bits, and their names.
SKETCH = 8
SKETCHES = [f"sketch{k}" for k in range(SKETCH)]

_BASE = 0x9E3779B97F4A7C55 | 1
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Sets the Arrow batch bounds on the session."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the table does not have yet, whatever its columns are called."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


# Staged tables -------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees. Where none is named (tests), one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception as error:  # a session that has ended cannot delete; the cluster's clean-up does
        if spark.sparkContext._jsc is not None:
            raise error


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does only for plans that the
    JVM has collected. Called between steps that each shuffle a multiple of the input."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Staged:
    """Tables written to the shared folder: each cuts the lineage and survives a lost executor.

    `drop` deletes tables no later job reads. The rest stay until the Python process ends, because
    the caller's result is lazy and reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self.paths.append(f"{self.folder}/{name}-{len(self.paths)}")
        return self.paths[-1]

    def _save(self, df: DataFrame, path: str, *by: str) -> None:
        # The plan ends with this table, so its shuffle files can go at once.
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.partitionBy(*by).parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)

    def _read(self, df: DataFrame, path: str) -> DataFrame:
        staged = self.spark.read.schema(df.schema).parquet(path)
        staged._staged_path = path
        return staged

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        self._save(df, path)
        return self._read(df, path)

    def write_parts(self, df: DataFrame, name: str, by: str, values: list[int]) -> list[DataFrame]:
        """A table of its own for each of the values of the integer column `by`, from one pass."""
        path = self.path(name)
        empty = df.limit(0).coalesce(1)
        self._save(df, path, by)
        parts = [f"{path}/{by}={value}" for value in values]
        for part in parts:  # a value without rows has no folder yet
            empty.drop(by).write.mode("append").parquet(part)
        return [self._read(df.drop(by), part) for part in parts]

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _delete(self.spark, df._staged_path)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            _delete(self.spark, self.folder)


# Text of Arrow batches -----------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows end to end, and where each row starts; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers, width = column.buffers(), np.int64 if large else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, and the C library
    keeps what numpy's temporary arrays have used."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        release_ = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if release_ is not None:
            release_(0)


_caches: list[dict] = []


def cached(held: dict) -> dict:
    """A dictionary in which a Python worker keeps something from task to task, until `forget`."""
    _caches.append(held)
    return held


def forget(but: dict | None = None) -> None:
    """Drops what earlier stages left in this worker, but for one cache; called by functions that need none of it."""
    left = [held for held in _caches if held and held is not but]
    for held in left:
        held.clear()
    if left:
        trim()


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of at most `limit` bytes of text, or one longer row."""
    _, at = utf8(batch.column(column))
    begin, rows = 0, batch.num_rows
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


# Hashes --------------------------------------------------------------------------------------


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base**position; one longer than `values`."""
    up, _ = powers(len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return prefix


def range_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges; equal ranges have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[begin]) * down[begin]


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all others."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, ...]:
    """Maximal runs of bytes for which `inside` is true, never across rows.

    Returns for each word its first byte, its end, its hash and its row.
    """
    flags = inside[data]
    step = np.empty(len(data), bool)
    if len(data):
        step[0] = True
        np.not_equal(flags[1:], flags[:-1], out=step[1:])
        step[at[:-1][at[:-1] < len(data)]] = True
    edges = np.flatnonzero(step)
    ends = np.append(edges[1:], len(data))
    taken = flags[edges]
    begin, end = edges[taken], ends[taken]
    prefix = prefix_hashes(BYTE_VALUES[LOWER[data] if lower else data])
    row = np.searchsorted(at, begin, side="right") - 1
    return begin, end, mix(range_hashes(prefix, begin, end) + (end - begin).astype(np.uint64)), row


def set_sketches(sets: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Parity sketches of sets of hashes (distinct within each row), SKETCH columns of 64 bits.

    Each element flips one bit, so two sketches differ in at most as many bits as elements are in one
    set alone."""
    rows = len(begin) - 1
    out = np.zeros((rows, SKETCH), np.int64)
    bit = (sets & np.uint64(64 * SKETCH - 1)).astype(np.int64)
    for low in range(0, rows, 1024):
        high = min(low + 1024, rows)
        owner = np.repeat(np.arange(high - low), np.diff(begin[low : high + 1]))
        flips = np.bincount(owner * (64 * SKETCH) + bit[begin[low] : begin[high]], minlength=(high - low) * 64 * SKETCH)
        out[low:high] = np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(high - low, SKETCH)
    return list(out.T)


def may_be_similar(percent: int, a: str, b: str) -> Column:
    """Whether the sizes and sketches of two sets, columns with these prefixes, allow the Jaccard similarity.

    At a similarity of t the smaller set has t times the larger one's size at least, and at most
    (1 - t) / (1 + t) of both sizes together are elements of one set alone. Never false for similar sets."""
    sizes = F.col(f"{a}size"), F.col(f"{b}size")
    apart = sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in SKETCHES), F.lit(0))
    return (F.least(*sizes) * 100 >= F.greatest(*sizes) * percent) & (apart * (100 + percent) <= (sizes[0] + sizes[1]) * (100 - percent))


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (count[0] of them), then those of begin[1], and so on."""
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first, count) + np.repeat(begin, count)


def digest_of(column: str) -> Column:
    """128 bits that tell texts apart; null is told from the empty text."""
    return F.md5(F.concat(F.when(F.col(column).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(column), F.lit(""))))

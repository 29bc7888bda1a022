"""What several operators of this subpackage share: table access, lineage cuts and vectorised text hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage

#: Fixed odd multipliers of the 64-bit finaliser and of the polynomial word hash.
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_small(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``cut_lineage`` into one partition for every ``each`` rows; later shuffles of a small table then write few files."""
    parts = max(1, min(-(-rows // each), shuffle_partitions(df.sparkSession)))
    return cut_lineage(df.coalesce(parts))


def release(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, so that Spark removes the shuffle files of rounds that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Give memory that this process has freed back to the system; Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):  # glibc only
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which its worker gives back what it has freed. Workers wait beside the executor's heap for the
    next task, of any stage, and would hold the most that each of them ever took."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def fresh(name: str) -> Column:
    """A text column whose partitioning is not known, so that a join by it has exchanges on both sides and is split where it is hot."""
    return F.concat(F.col(name), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _C1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each maximal run of bytes outside x20 and x09-x0D, in order."""
    if not data:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[buf], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _C1)


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; null is the empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


_PLACE = mix(np.arange(101, 165, dtype=np.uint64) * _C1) | np.uint64(1)


def shingle_hashes(data: bytes, width: int = 5) -> np.ndarray:
    """Hashes of the shingles of ``width`` words, in order; a shorter text is one shingle, no words make none."""
    words = word_hashes(data)
    if not len(words):
        return words
    if len(words) < width:
        place = _PLACE[: len(words)] + np.uint64(2 * len(words))
        return mix((words * place).sum(keepdims=True))
    n = len(words) - width + 1
    total = words[:n] * _PLACE[0]
    for k in range(1, width):
        total += words[k : n + k] * _PLACE[k]
    return mix(total)


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(data, width))

"""Helpers of the training-data operators: written tables, id hashing and byte-level text columns."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrylens.session import shared_dir

# The six ASCII white-space bytes that separate words: tab, line feed, vertical tab, form feed, return, space.
SPACE_BYTES = bytes([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])

IS_SPACE = np.isin(np.arange(256), list(SPACE_BYTES))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 2_000_000
#: The same for operators that the pipeline runs one after another in workers that keep what they once took.
SMALL_STEP_BYTES = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def giving_back(run: Callable) -> Callable:
    """``run`` for mapInArrow; at its end the worker, which lives on, gives back the memory that it no longer uses."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return wrapped


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; 0 for a null id is avoided by giving it mod - 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(mod - 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 to n - 1, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SMALL_STEP_BYTES + 1)
        both = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` gets the hash of any span of ``buf`` in constant time."""
    up, _ = powers(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[buf] * up, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column with the start and end of each row in them; null is empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    return buf, starts, ends


def steps(starts: np.ndarray, ends: np.ndarray, limit: int = STEP_BYTES):
    """Row ranges whose texts together have at most ``limit`` bytes, or one row."""
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(ends, starts[lo] + limit, side="right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


class Words:
    """The words of a few texts: where they start and end in ``buf``, and which row they are of."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False):
        base = int(starts[0])
        self.buf = buf[base : int(ends[-1])]
        if lower:
            self.buf = LOWER[self.buf]
        self.rows = len(starts)
        self.row_start, self.row_end = starts - base, ends - base
        inside = ~IS_SPACE[self.buf]
        cut = np.zeros(len(self.buf) + 1, dtype=bool)
        cut[self.row_start] = True
        cut[self.row_end] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first_word = np.searchsorted(self.start, self.row_start)
        self.per_row = np.searchsorted(self.start, self.row_end) - self.first_word
        self.row = np.repeat(np.arange(self.rows), self.per_row)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_sums(self.buf), self.start, self.end)

    def row_sums(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array over each row."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.row_end] - total[self.row_start]


def word_windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and the index of each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x100000001B3) + hashes[at + k])
    return out, at


def repeated_words(words: Words, hashes: np.ndarray, size: int) -> np.ndarray:
    """For each row, its words in runs of ``size`` words that the row holds twice or more."""
    runs, at = word_windows(words, hashes, size)
    count = np.zeros(words.rows, dtype=np.int64)
    if not len(runs):
        return count
    key = mixed(runs + words.row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(ranked) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    often = order[same[1:] | same[:-1]]
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, at[often], 1)
    np.add.at(edge, at[often] + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.row[covered], minlength=words.rows).astype(np.int64)

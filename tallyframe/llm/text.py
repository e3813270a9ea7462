"""Whole columns of text as bytes, words and hashes, in numpy.

Everything here works inside a task on one slice of an Arrow batch; Spark cuts and
moves the rows. A null text counts as empty.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that one vectorised step takes at a time (a longer text is taken alone)
SLICE_BYTES = (1 << 20) - 2

# white space of the word pattern [^\x20\x09-\x0D]+ (fixed values)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# lower-cases A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def set_up(spark, rows: int = 256) -> None:
    """Small Arrow batches, as texts can be long and two Python workers share an executor;
    workers that give freed memory back; and this package's folder on their path, for
    sessions started elsewhere."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    environment = spark.sparkContext.environment
    here, given = str(Path(__file__).resolve().parents[2]), environment.get("PYTHONPATH", "")
    if here not in given.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [given, here]))
    environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    environment.setdefault("MALLOC_ARENA_MAX", "1")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows back to back, and the n + 1 offsets of the rows."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of at most `limit` bytes of text (or one row)."""
    for batch in batches:
        _, offsets = byte_view(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words; a word never runs over the end of its row."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    letter = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first, last = letter.copy(), letter
    first[1:] &= ~letter[:-1] | edge[1:n]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((BASE, INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _tables[k] = np.multiply.accumulate(step)
    return _tables[0][:n], _tables[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: differences of prefix sums, in pieces of
    bounded size. Starts and ends must ascend."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        base, top = int(starts[i]), int(ends[i:j].max())
        piece = data[base:top].astype(np.uint64) + np.uint64(1)
        power, inverse = powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * power[:-1], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s])
        i = j
    return out


def words(column: pa.Array, lower: bool = True):
    """Rows, hashes, starts and ends of the words of a column, and its bytes and offsets."""
    data, offsets = byte_view(column)
    starts, ends, rows = word_spans(data, offsets)
    return rows, hash_spans(LOWER[data] if lower else data, starts, ends), starts, ends, data, offsets


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring word hashes, whatever their rows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + n]
    return mix(out)


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of the runs of each row in an ascending row index."""
    return np.searchsorted(rows, np.arange(n + 1))

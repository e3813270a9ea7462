"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last 7 bytes ends a chunk where its lowest `e` bits are zero (block
size 2**e); each chunk gives one of 64 characters of a signature. `e` is the least that
lets a text of this length expect CHUNKS chunks at most; a fingerprint is
``e:signature at e:signature at e + 1``. Two fingerprints are compared where block sizes
are compatible (equal, or one twice the other) by edit distance of the signatures of equal
block size; likeness is 1 - distance / length of the longer, and 0 at other block sizes.

Defined cases: a null text counts as empty; an empty text has empty signatures and two
of them have likeness 1; equal texts have equal fingerprints; the last of SIGNATURE
characters stands for all the rest of a text, so texts of any length are hashed whole. The
next document is the one that follows by (doc_id, hash of the text, text), nulls first; after the
last comes the first, so one row alone is its own next. Of the input doc_id and text are used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BASE, INVERSE, SLICE_BYTES, byte_view, mix, powers

WINDOW = 7
SIGNATURE = 64  # characters at most
CHUNKS = 64  # expected at most, by a text's length
MIN_E, MAX_E = 1, 30
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PRIME = np.uint32(0x01000193)
_MASK = (1 << 64) - 1


def _end_levels(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, how many low bits of the rolling hash are zero there (at most 31)."""
    n, rows = len(data), len(offsets) - 1
    padded = np.zeros(n + WINDOW * rows, np.uint32)  # a window never reaches into the row before
    at = np.arange(n) + np.repeat(np.arange(1, rows + 1) * WINDOW, np.diff(offsets))
    padded[at] = data
    padded[at] += np.uint32(1)
    h = np.zeros(len(padded), np.uint32)
    for j in range(WINDOW):
        h[WINDOW:] = h[WINDOW:] * _PRIME + padded[j + 1:len(padded) - WINDOW + j + 1]
    h = h[at]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return np.minimum(np.bitwise_count(((h & (~h + np.uint32(1))) - np.uint32(1))), 31).astype(np.int8)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans in any order, from prefix sums in pieces of bounded size."""
    places, back = np.unique(np.concatenate([starts, ends]), return_inverse=True)
    sums, inverse = np.empty(len(places), np.uint64), np.empty(len(places), np.uint64)
    total, i = 0, 0
    for base in range(0, len(data) + 1, SLICE_BYTES):
        piece = data[base:base + SLICE_BYTES].astype(np.uint64) + np.uint64(1)
        power, inv = powers(len(piece) + 1)
        local = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * power[:-1], out=local[1:])
        j = int(np.searchsorted(places, base + len(piece), side="right" if base + SLICE_BYTES > len(data) else "left"))
        own = places[i:j] - base
        shift = np.uint64(pow(BASE, base, 1 << 64))
        sums[i:j] = np.uint64(total) + local[own] * shift
        inverse[i:j] = inv[own] * np.uint64(pow(INVERSE, base, 1 << 64))
        total = (total + int(local[-1]) * int(shift)) & _MASK
        i = j
    s, e = back[:len(starts)], back[len(starts):]
    return mix((sums[e] - sums[s]) * inverse[s])


def _signatures(data, offsets, levels, exponent) -> list[bytes]:
    """One signature for each row, at its block size."""
    n_rows, size = len(offsets) - 1, np.diff(offsets)
    row_of = np.repeat(np.arange(n_rows), size)
    ends = np.flatnonzero(levels >= exponent[row_of]) + 1
    rows = row_of[ends - 1]
    # the end of a text ends a chunk too
    full = np.flatnonzero(size)
    last = offsets[full + 1]
    ends = np.concatenate([ends, last])
    rows = np.concatenate([rows, full])
    order = np.lexsort((ends, rows))
    ends, rows = ends[order], rows[order]
    new = np.ones(len(ends), bool)
    new[1:] = ends[1:] != ends[:-1]
    ends, rows = ends[new], rows[new]
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    nth = np.arange(len(ends)) - at[rows]
    # from character SIGNATURE on, one chunk holds all the rest
    keep = (nth < SIGNATURE - 1) | (np.arange(len(ends)) == at[rows + 1] - 1)
    ends, rows = ends[keep], rows[keep]
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    starts[at[:-1][np.diff(at) > 0]] = offsets[:-1][np.diff(at) > 0]
    letters = ALPHABET[(_span_hashes(data, starts, ends) >> np.uint64(58)).astype(np.int64)].tobytes()
    return [letters[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]


Print = tuple[int, bytes, bytes]


def fingerprints(texts: list[str]) -> list[Print]:
    """Exponent and both signatures of each whole text."""
    if not texts:
        return []
    data, offsets = byte_view(pa.array(texts, pa.large_string()))
    n = len(texts)
    if not len(data):
        return [(MIN_E, b"", b"")] * n
    levels = _end_levels(data, offsets)
    size = np.maximum(np.diff(offsets), 1)
    exponent = np.clip(np.ceil(np.log2(size / CHUNKS)).astype(np.int64), MIN_E, MAX_E)
    one = _signatures(data, offsets, levels, exponent)
    two = _signatures(data, offsets, levels, exponent + 1)
    return list(zip(exponent.tolist(), one, two))


def as_text(f: Print) -> str:
    return f"{f[0]}:{f[1].decode()}:{f[2].decode()}"


def edit_distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Levenshtein distances of pairs of at most 64 characters, bit by bit for all pairs at
    once (Myers' and Hyyro's recurrence, one column after the other)."""
    n = len(a)
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    if n == 0:
        return np.empty(0, np.int64)
    rows = np.arange(n)
    grid = lambda x: np.frombuffer(b"".join(s.ljust(SIGNATURE, b"\0") for s in x), np.uint8).reshape(n, SIGNATURE)
    ga, gb = grid(a), grid(b)
    places = np.zeros((n, 128), np.uint64)
    for j in range(int(la.max(initial=0))):
        places[rows, ga[:, j]] |= np.where(j < la, np.uint64(1 << j), np.uint64(0))
    one = np.uint64(1)
    high = one << np.maximum(la - 1, 0).astype(np.uint64)
    plus, minus = np.full(n, _MASK, np.uint64), np.zeros(n, np.uint64)
    distance = la.copy()
    for j in range(int(lb.max(initial=0))):
        eq = places[rows, gb[:, j]]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        active = j < lb
        distance += active * (((ph & high) != 0).astype(np.int64) - ((mh & high) != 0))
        ph = (ph << one) | one
        mh = mh << one
        plus, minus = mh | ~(xv | ph), ph & xv
    return np.where(la == 0, lb, distance)


def _likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    longest = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b)), np.int64, len(a))
    return 1.0 - edit_distances(a, b) / np.maximum(longest, 1)


def likeness(a: list[Print], b: list[Print]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out = np.zeros(len(a))
    step = np.fromiter((x[0] - y[0] for x, y in zip(a, b)), np.int64, len(a))
    for difference, pairs in ((0, ((1, 1), (2, 2))), (1, ((1, 2),)), (-1, ((2, 1),))):
        at = np.flatnonzero(step == difference)
        for i, j in pairs if len(at) else ():
            out[at] = np.maximum(out[at], _likeness([a[k][i] for k in at], [b[k][j] for k in at]))
    return out


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_FIRST = -(1 << 63)


def edit(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text, text of the next)."""
    texts = [t for _, t, _ in rows]
    follow = []
    for k, (_, _, nxt) in enumerate(rows):
        if k + 1 < len(rows) and rows[k + 1][1] is nxt:
            follow.append(k + 1)
        else:
            follow.append(len(texts))
            texts.append(nxt)
    own = fingerprints(texts)
    edited = [edit(t, nxt) for _, t, nxt in rows]
    new = fingerprints(edited)
    first = own[:len(rows)]
    columns = [[r[0] for r in rows], [len(r[1]) for r in rows], edited, [as_text(f) for f in first],
               [as_text(f) for f in new], likeness(first, new), likeness(first, [own[k] for k in follow])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=SCHEMA.names)


def _chained(batches):
    """Rows sorted by (range, ahead, key, hash, text); rows ahead are the first of the next range."""
    rows: list[tuple] = []
    size, last = 0, None  # last: (range, doc_id, text) of the row whose next isn't known yet
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("range", "ahead", "doc_id", "text")]
        for part, ahead, doc_id, text in zip(*columns):
            if last is not None and last[0] == part:
                rows.append((last[1], last[2], text))
                size += len(last[2])
            last = None if ahead else (part, doc_id, text)
            if size > SLICE_BYTES // 4:
                yield _compare(rows)
                rows, size = [], 0
    if rows:
        yield _compare(rows)


def fingerprint(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited (the text), both fingerprints and their likenesses.

    Documents go to ranges of doc_id, cut at approximate quantiles; a doc_id (or the rows without
    one) that fills several ranges is cut again by the hash of its texts. The first document of
    each range also goes, marked ahead, to the range before it. Only ids and one row for
    each range pass through the driver."""
    spark = docs.sparkSession
    ranges = ranges or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), F.xxhash64("text").alias("hash"))
    cuts = docs.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts")).first()["cuts"]
    edge_keys, parts = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    # the number of ranges below a key, and the width in hashes of each range of a key
    below = np.concatenate([[0], np.cumsum(parts)])

    @F.pandas_udf("int")
    def range_of(key: pd.Series, hashed: pd.Series) -> pd.Series:
        key = key.to_numpy()
        at = np.searchsorted(edge_keys, key, side="left")
        own = np.append(edge_keys, 0)[at] == key
        own &= at < len(edge_keys)
        n = np.append(parts, 1)[at]
        # a key of m cuts begins m ranges; those beyond its first split its hashes evenly
        share = ((hashed.to_numpy() >> 32) + (1 << 31)) * n >> 32
        return pd.Series((below[at] + np.where(own, 1 + share, 0)).astype(np.int32))

    docs = docs.withColumn("range", range_of("key", "hash"))
    firsts = [(r["range"], r["first"]["key"], r["first"]["hash"]) for r in
              docs.groupBy("range").agg(F.min(F.struct("key", "hash")).alias("first")).orderBy("range").collect()]
    before = spark.createDataFrame([(key, h, firsts[i - 1][0]) for i, (_, key, h) in enumerate(firsts)], "key long, hash long, ahead_of int")
    spread = (docs.join(F.broadcast(before), ["key", "hash"], "left")
              .withColumn("to", F.explode(F.when(F.col("ahead_of").isNull(), F.array(F.struct("range", F.lit(False).alias("ahead"))))
                                          .otherwise(F.array(F.struct("range", F.lit(False).alias("ahead")),
                                                             F.struct(F.col("ahead_of").alias("range"), F.lit(True).alias("ahead"))))))
              .select("to.range", "to.ahead", "key", "hash", "doc_id", "text"))
    return (spread.repartition("range").sortWithinPartitions("range", "ahead", "key", "hash", "text")
            .select("range", "ahead", "doc_id", "text").mapInArrow(_chained, SCHEMA))

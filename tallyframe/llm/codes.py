"""Vector codes: product quantisation in whole numbers, nearest entries found in a GNAT.

Each component x becomes floor(1024 * x); a vector is cut into 4 parts, each with a codebook of at
most 256 entries that starts as those parts of the smallest ids and is improved in 4 rounds. The
entries of a part are held in a geometric near-neighbour access tree: a node has split points, every
other entry goes to its nearest split point, and for each pair (split, child) the least and the largest
distance from the split point to the child's entries are kept. A query's distance d to a split point
bounds its distances to a child from below by low - d and d - high; a child is left out only where
that bound, rounded down, is above the best distance, rounded up. What is left is compared by exact
squared distances in 64-bit integers, ties to the lower index, so the result is that of a full search.

Every round is one pass over the rows: a task sums its parts by entry, and the sums (at most 1024 rows
a task) are added by Spark. The driver sees the 4 * 256 entries alone.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped. The
dimension is that of the vector of the smallest id whose length is a positive multiple of 4; a vector of
another length, or with a whole number too large for exact 64-bit distances (`largest`: 2^17 * 1024
and more up to 64 components), stays, but has no code and no error (null) and takes no part in the codebooks.
Rows of one id are ordered by their components, null ids come last; repeated rows count each.
With fewer than 256 rows there are as many entries as rows; an empty table gives no rows. Extra
columns pass through; `code` and `error` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SPLITS = 16  # split points of a node
LEAF = 24  # entries that are compared without splitting
BLOCK, BLOCK_BYTES = 8_192, 1 << 24  # queries that go down the tree together


def largest(width: int) -> int:
    """Components below this in size have part distances below 2^62 (width: components of a part)."""
    return 1 << ((60 - max(width - 1, 0).bit_length()) // 2)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of y."""
    top = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)), 1)
    if top * top * max(x.shape[1], 1) < 1 << 52:  # every step is a whole number that a double holds
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(y)), np.int64)
    for j in range(x.shape[1]):
        step = x[:, j, None] - y[None, :, j]
        out += step * step
    return out


def low(square: np.ndarray) -> np.ndarray:
    """Roots, surely not too large: a 64-bit integer rounds to a double within 2^-53 of itself."""
    return np.sqrt(square.astype(np.float64)) * (1 - 1e-15)


def high(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + 1e-15)


class Gnat:
    """The tree over entries (rows of `book`); nodes are lists, as there are at most 256 entries."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.visited = 0  # distances computed, for tests and measurements
        self.root = self._node(np.arange(len(book)))

    def _node(self, own: np.ndarray):
        if len(own) <= LEAF:
            return own, None, None, None
        # split points far from each other, the first one the lowest index
        chosen = [0]
        nearest = squared(self.book[own], self.book[own[:1]])[:, 0]
        while len(chosen) < SPLITS and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(self.book[own], self.book[own[chosen[-1]]][None])[:, 0])
        splits = own[chosen]
        if len(chosen) == 1:  # all entries are equal: ties go to the lowest index
            return splits, None, None, None
        rest = np.delete(own, chosen)
        d = squared(self.book[splits], self.book[rest])
        home = d.argmin(axis=0)
        ranges, children = [], []
        for j in range(len(splits)):
            mine = d[:, home == j]
            if mine.shape[1]:
                ranges.append((low(mine.min(axis=1)), high(mine.max(axis=1))))
                children.append((j, self._node(rest[home == j])))
        lows = np.stack([r[0] for r in ranges], axis=1) if ranges else np.empty((len(splits), 0))
        highs = np.stack([r[1] for r in ranges], axis=1) if ranges else np.empty((len(splits), 0))
        return splits, children, lows, highs

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        index, best = np.full(len(x), len(self.book)), np.full(len(x), np.iinfo(np.int64).max)
        for i in range(0, len(x), BLOCK):
            rows = np.arange(i, min(i + BLOCK, len(x)))
            self._visit(self.root, x, rows, index, best)
        return index, best

    def _visit(self, node, x, rows, index, best) -> None:
        points, children, lows, highs = node
        d = squared(x[rows], self.book[points])
        self.visited += d.size
        at = np.where(d == d.min(axis=1)[:, None], points, len(self.book)).min(axis=1)
        least = d.min(axis=1)
        better = (least < best[rows]) | ((least == best[rows]) & (at < index[rows]))
        best[rows[better]], index[rows[better]] = least[better], at[better]
        if not children:
            return
        down, up = low(d), high(d)
        # the largest lower bound that any split point gives a child, rounded down
        bound = np.stack([np.maximum(lows[:, j] - up, down - highs[:, j]).max(axis=1) for j in range(len(children))], axis=1)
        bound -= 1e-15 * np.abs(up).max(axis=1)[:, None] + 1e-15 * highs.max(axis=0)
        # each query goes to its likeliest child first, then to those that can still hold a nearer entry
        first = bound.argmin(axis=1)
        for again in (False, True):
            for j, (_, child) in enumerate(children):
                now = np.flatnonzero((first != j) if again else (first == j))
                now = now[bound[now, j] <= high(best[rows[now]])]
                if len(now):
                    self._visit(child, x, rows[now], index, best)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BLOCK rows or BLOCK_BYTES, as one step down the tree takes many."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BLOCK or size >= BLOCK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def usable(column: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def _whole(column: str) -> Column:
    """floor(1024 * x): the product is exact, as 1024 is a power of two."""
    return F.transform(column, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(2.0 ** 62)), F.lit(-2.0 ** 62))).cast("long"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def fit(rows: DataFrame, dimension: int) -> list[np.ndarray]:
    """The codebooks after all rounds. `rows` has `whole` (array<long> of one dimension) and `first_by`."""
    first = rows.orderBy(F.asc_nulls_last("first_by"), "whole").limit(ENTRIES).select("whole").collect()
    book = np.array([r["whole"] for r in first], np.int64).reshape(len(first), dimension)
    width = dimension // PARTS
    books = [book[:, p * width:(p + 1) * width] for p in range(PARTS)]
    for _ in range(ROUNDS):
        trees = rows.sparkSession.sparkContext.broadcast([Gnat(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((PARTS, ENTRIES), np.int64)
            total = np.zeros((PARTS, ENTRIES, width), np.int64)
            for batch in blocks(batches):
                x = _matrix(batch.column(0), dimension)
                for p, tree in enumerate(trees.value):
                    part = x[:, p * width:(p + 1) * width]
                    index, _ = tree.nearest(part)
                    np.add.at(n[p], index, 1)
                    np.add.at(total[p], index, part)
            p, e = np.nonzero(n)
            if len(p):
                columns = [p.astype(np.int32), e.astype(np.int32), n[p, e], *total[p, e].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["part", "entry", "n", *names])

        names = [f"s{j}" for j in range(width)]
        schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names)
        merged = (rows.select("whole").mapInArrow(sums, schema).groupBy("part", "entry")
                  .agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in names]))
        new = [b.copy() for b in books]
        for r in merged.collect():  # at most 4 * 256 rows
            new[r["part"]][r["entry"]] = [int(r[s]) // r["n"] for s in names]
        books = new
        trees.unpersist()
    return books


def encode(rows: DataFrame, books: list[np.ndarray], dimension: int) -> DataFrame:
    """`code` and `error` beside the columns of rows; null where `whole` is null."""
    width = dimension // PARTS
    trees = rows.sparkSession.sparkContext.broadcast([Gnat(b) for b in books])
    names = rows.columns

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            column = batch.column(names.index("whole"))
            there = np.asarray(column.is_valid())
            code, error = np.full(len(there), None, object), np.zeros(len(there), np.int64)
            if there.any():
                x = _matrix(column.drop_null(), dimension)
                found = [tree.nearest(x[:, p * width:(p + 1) * width]) for p, tree in enumerate(trees.value)]
                digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                code[there] = [d.tobytes().hex() for d in digits]
                error[there] = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.string()), pa.array(error, mask=~there)], names=[*names, "code", "error"])

    return rows.mapInArrow(coded, T.StructType([*rows.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compress(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """The rows kept, with `code` (two hex digits a part) and `error` (summed squared distances), and the codebooks."""
    own = [c for c in vectors.columns if c not in ("code", "error")]
    kept = vectors.where(usable(embedding)).select(F.struct(*own).alias("row"), F.col(id).alias("first_by"), _whole(embedding).alias("whole"))
    kept = written(kept, "whole-vectors")
    fits = (F.size("whole") > 0) & (F.size("whole") % PARTS == 0)
    first = kept.where(fits).orderBy(F.asc_nulls_last("first_by"), "whole").select(F.size("whole")).first()
    if first is None:
        return kept.select("row.*", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    dimension = first[0]
    top = largest(dimension // PARTS)
    small = (F.size("whole") == dimension) & ~F.exists("whole", lambda c: (c >= top) | (c <= -top))
    books = fit(kept.where(small), dimension)
    coded = encode(kept.select("row", F.when(small, F.col("whole")).alias("whole")), books, dimension)
    return coded.select("row.*", "code", "error"), books


def numbers(books: list[np.ndarray]) -> str:
    """All components by part, entry and position, joined by commas."""
    return ",".join(str(c) for book in books for c in book.ravel().tolist())


def with_group_error(coded: DataFrame, group: str, salts: int = 64) -> DataFrame:
    """`group_error`: the errors summed over rows of an equal `group` (nulls together; a null error counts
    nothing). The sums are joined to salted rows, as one group may hold most of them."""
    sums = coded.groupBy(F.col(group).alias("s_group")).agg(F.sum("error").alias("group_error"))
    sums = sums.withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("code", *[c for c in coded.columns if c not in ("code", group)]), F.lit(salts)).cast("int")
    return coded.join(sums, F.col(group).eqNullSafe(F.col("s_group")) & (salt == F.col("s_salt")), "left").drop("s_group", "s_salt")

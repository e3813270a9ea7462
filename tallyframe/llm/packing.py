"""Lexical retrieval packing: each window is a seed document and its BM25 neighbours.

Documents are tokenised and cut into windows of WINDOW ids. What is left of each (a piece,
always under a window) is weighted by BM25 with the frequencies, number and mean length of all
pieces of the table, and routed by those weights: a random projection of the weighted terms
goes down a tree of median splits along the directions of greatest variance, fitted on a sample
of at most about SAMPLE pieces that the hashes of rows choose. Pieces that share their rare terms meet in a
leaf, of SHARD pieces or so, from wherever in the table they come; a leaf has an inverted index.
Its first unused piece is a seed: all its terms are looked up in the postings, and the
unused neighbours, best score first, fill its window; at the end the best one that is too
long is cut to fill the rest, and its other part stays unused. So every window is full. The
last pieces of a leaf, under one window, are cut to lengths that are powers of two.

A neighbour in another leaf is not found (the README has the measured recall). Neither the
leaves nor their windows depend on the order of rows or on splits of the input; only the numbers
of windows that lie in one document hold the input's partition. Defined cases: a null or empty
text has the end id alone; pieces of a leaf stand in the order of (doc_id, hash of the text),
and ties go to the earlier one; repeated rows are documents of their own; no rows give no
sequences. Of the input, `doc_id` and the text are used; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .tables import written
from .wordids import word_ids

WINDOW = 2048
SHARD = 4096  # pieces of one leaf, about; an index takes twice as many at most
SAMPLE, WIDTH, DEEPEST = 32_768, 48, 13  # pieces that fit the tree, size of the projection, levels at most
JITTER = 1e-4  # tells copies apart at a split
DENSE = 12  # terms in at least a 12th of an index's pieces are multiplied as a matrix
AHEAD = 16  # seeds scored at a time
WHOLE = 1 << 62  # marks the numbers of windows that lie in one document
END_ID = 1
K1, B = 1.2, 0.75
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def _counts(pieces: list[np.ndarray], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, terms and counts of all (piece, term), sorted, and the sizes of the pieces."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    of = np.repeat(np.arange(len(pieces)), size)
    ids = np.concatenate(pieces).astype(np.int64)
    keep = ids != end_id
    key, count = np.unique(of[keep] << 32 | ids[keep], return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count, size


class Model:
    """What BM25 has of all pieces: the inverse frequency of each id, and the mean length."""

    def __init__(self, idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean

    @classmethod
    def of(cls, terms: np.ndarray, df: np.ndarray, size: np.ndarray) -> Model:
        return cls.fitted(terms, df, len(size), int(size.sum()))

    @classmethod
    def fitted(cls, terms, df, n: int, total: int) -> Model:
        idf = np.zeros(int(max(terms, default=0)) + 1)
        idf[terms] = np.log1p((n - df + 0.5) / (df + 0.5))
        return cls(idf, max(1.0, total / max(1, n)))

    def weights(self, of, ids, count, size) -> np.ndarray:
        norm = K1 * (1 - B + B * size / self.mean)
        return self.idf[ids] * count * (K1 + 1) / (count + norm[of])

    def projected(self, pieces: list[np.ndarray], end_id: int, base: np.ndarray) -> np.ndarray:
        """A row of length 1 for each piece (0 for one without terms)."""
        of, ids, count, size = _counts(pieces, end_id)
        out = np.zeros((len(pieces), WIDTH))
        weight = self.weights(of, ids, count, size)[:, None]
        at = np.searchsorted(of, np.arange(len(pieces) + 1)).tolist()
        for piece, (a, b) in enumerate(zip(at, at[1:])):
            # a piece at a time, so that its rows of `base` stay in the cache
            if a < b:
                rows = base[ids[a:b]]
                rows *= weight[a:b]
                np.add.reduceat(rows, [0], axis=0, out=out[piece:piece + 1])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def base_of(model: Model) -> np.ndarray:
    """Fixed random directions of the ids."""
    return np.random.default_rng(7).standard_normal((len(model.idf), WIDTH))


class Tree:
    """Median splits; the nodes of a level follow those of the level above."""

    def __init__(self, sample: np.ndarray, names: np.ndarray, depth: int):
        self.depth = depth
        self.directions = np.zeros(((1 << depth) - 1, WIDTH))
        self.middles = np.zeros((1 << depth) - 1)
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            for k in range((1 << level) - 1, (2 << level) - 1):
                own = np.flatnonzero(node == k)
                if len(own):
                    part = sample[own] - sample[own].mean(axis=0)
                    self.directions[k] = np.linalg.eigh(part.T @ part)[1][:, -1]
                    self.middles[k] = np.median(sample[own] @ self.directions[k] + self._jitter(names[own], level))
            node = self._down(sample, names, node, level)

    @staticmethod
    def _jitter(names: np.ndarray, level: int) -> np.ndarray:
        return (X.mix(names + np.uint64(level + 1)) >> np.uint64(11)) * (JITTER / (1 << 53))

    def _down(self, rows, names, node, level) -> np.ndarray:
        value = np.einsum("ij,ij->i", rows, self.directions[node]) + self._jitter(names, level)
        return 2 * node + 1 + (value > self.middles[node])

    def leaves(self, rows: np.ndarray, names: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for level in range(self.depth):
            node = self._down(rows, names, node, level)
        return node - ((1 << self.depth) - 1)


class Index:
    """BM25 over pieces of ids: postings by term, and the terms of each piece."""

    def __init__(self, pieces: list[np.ndarray], end_id: int, model: Model | None = None):
        of, ids, count, size = _counts(pieces, end_id)
        terms, term = np.unique(ids, return_inverse=True)
        df = np.bincount(term, minlength=len(terms))
        model = model or Model.of(terms, df, size)
        weight = model.weights(of, ids, count, size)
        self.n = len(pieces)
        often = df * DENSE >= self.n
        column = np.cumsum(often) - 1
        dense = often[term]
        self.weights = np.zeros((int(often.sum()), self.n))
        self.weights[column[term[dense]], of[dense]] = weight[dense]
        self.has = (self.weights > 0).T.astype(float)
        of, term, weight = of[~dense], term[~dense], weight[~dense]
        self.term, self.df = term, np.where(often, 0, df)
        self.at = np.searchsorted(of, np.arange(self.n + 1))
        order = np.argsort(term, kind="stable")
        self.posting, self.weight = of[order], weight[order]
        self.first = np.cumsum(self.df) - self.df

    def scores(self, seeds: list[int]) -> np.ndarray:
        """Of all pieces, for the terms of each seed."""
        out = self.has[seeds] @ self.weights
        for row, seed in zip(out, seeds):
            terms = self.term[self.at[seed]:self.at[seed + 1]]
            df = self.df[terms]
            ends = np.cumsum(df)
            if len(ends):
                place = np.arange(ends[-1]) + np.repeat(self.first[terms] - (ends - df), df)
                row += np.bincount(self.posting[place], self.weight[place], self.n)
        # sums of a product may differ in the last bits for equal pieces
        return np.round(out, 6)


class Piece:
    """Ids of a document from `start` on; a part may be used up."""

    __slots__ = ("doc_id", "start", "ids", "total")

    def __init__(self, doc_id, start, ids, total):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def take(self, n: int) -> Piece:
        head = Piece(self.doc_id, self.start, self.ids[:n], self.total)
        self.start, self.ids = self.start + n, self.ids[n:]
        return head


def pack_shard(pieces: list[Piece], window: int, end_id: int, model: Model | None = None) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces of the last one where it is not full."""
    index = Index([p.ids for p in pieces], end_id, model)
    unused = np.ones(len(pieces), bool)
    sizes = np.fromiter((len(p.ids) for p in pieces), np.int64, len(pieces))
    windows: list[list[Piece]] = []
    scored: dict[int, np.ndarray] = {}
    seed = 0
    while seed < len(pieces):
        if not unused[seed]:
            seed += 1
            continue
        if seed not in scored:
            ahead = (seed + np.flatnonzero(unused[seed:seed + 8 * AHEAD])[:AHEAD]).tolist()
            scored = dict(zip(ahead, index.scores(ahead)))
        unused[seed] = False
        members, room = [pieces[seed]], window - len(pieces[seed].ids)
        rest = np.flatnonzero(unused)
        score, size, too_long = scored[seed][rest], sizes[rest], -1
        while room and len(rest):
            # the best one that is left; of equal ones the first
            best = int(score.argmax())
            if score[best] < 0:
                break
            if size[best] > room:
                if too_long < 0:
                    too_long = int(rest[best])
                fits = size <= room
                rest, score, size = rest[fits], score[fits], size[fits]
                continue
            i = int(rest[best])
            unused[i] = False
            members.append(pieces[i])
            room -= int(size[best])
            score[best] = -1  # scores are sums of weights, so none is below 0
        if room and too_long >= 0:
            members.append(pieces[too_long].take(room))
            sizes[too_long] -= room
            room = 0
        if room:
            return windows, members
        windows.append(members)
    return windows, []


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences whose lengths are falling powers of two."""
    out: list[list[Piece]] = []
    left = sum(len(p.ids) for p in pieces)
    queue = list(pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        members: list[Piece] = []
        while room:
            head = queue[0]
            if len(head.ids) <= room:
                members.append(queue.pop(0))
            else:
                members.append(head.take(room))
            room -= len(members[-1].ids)
        out.append(members)
    return out


def _cut(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Windows that lie in one document, with their numbers, and the pieces, without."""

    def run(batches):
        coder = word_ids(path)
        number = WHOLE | TaskContext.get().partitionId() << 40
        for part in X.slices(batches):
            flat, at = coder.encode(part.column(part.schema.get_field_index("text")))
            doc_ids, hashes = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "part"))
            rows: list[tuple] = []
            for doc_id, name, a, b in zip(doc_ids, hashes, at.tolist(), at[1:].tolist()):
                ids = np.append(flat[a:b], np.int32(end_id))
                for start in range(0, len(ids), window):
                    own = ids[start:start + window]
                    kind = "<u2" if own.max() < 1 << 16 else "<u4"
                    whole = len(own) == window
                    rows.append((doc_id, name, start, len(own), own.astype(kind).tobytes(), len(ids), number if whole else None))
                    number += whole
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CUT_TYPES)], names=CUT_NAMES)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("part")).mapInArrow(run, CUT)


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    lengths, data = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("length", "ids"))
    return [np.frombuffer(d, "<u2" if len(d) == 2 * n else "<u4") for n, d in zip(lengths, data)]


def fit(pieces: DataFrame, shard: int, end_id: int) -> tuple[Model, Tree]:
    """Frequencies over all pieces, and the tree that routes them."""

    def count(batches):
        found, n, total = np.zeros(1, np.int64), 0, 0
        for batch in batches:
            if batch.num_rows:
                _, ids, _, size = _counts(_ids(batch), end_id)
                own = np.bincount(ids, minlength=len(found))
                own[:len(found)] += found
                found, n, total = own, n + len(size), total + int(size.sum())
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], some)), pa.array(np.append([n, total], found[some]))], names=["term", "n"])

    # a row for each id of the vocabulary, whatever the input
    df = {r["term"]: r["n"] for r in pieces.select("length", "ids").mapInArrow(count, "term long, n long")
          .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = df.pop(-1, 0), df.pop(-2, 0)
    model = Model.fitted(np.array(list(df), np.int64), np.array(list(df.values()), float), n, total)
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(1, n) / shard)))))
    if not depth:
        return model, Tree(np.empty((0, WIDTH)), np.empty(0, np.uint64), 0)
    # rows that are equal count once, so the hashes take no more than about SAMPLE
    share = min(1 << 30, int((1 << 30) * SAMPLE / n))
    some = pieces.where(F.pmod(F.col("name"), F.lit(1 << 30)) < share).dropDuplicates(["name"])
    base = base_of(model)

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                rows = model.projected(_ids(batch), end_id, base).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["name", "row"])

    sample = some.select("name", "length", "ids").mapInArrow(project, "name long, row binary").orderBy("name").collect()
    rows = np.frombuffer(b"".join(bytes(r["row"]) for r in sample), "<f4").reshape(-1, WIDTH).astype(float)
    return model, Tree(rows, np.array([r["name"] for r in sample], np.int64).view(np.uint64), depth)


def routed(pieces: DataFrame, model: Model, tree: Tree, end_id: int) -> DataFrame:
    """With the leaf of each piece."""
    shared = pieces.sparkSession.sparkContext.broadcast((model, tree))
    schema = T.StructType([*pieces.schema.fields, T.StructField("leaf", T.LongType())])
    at = pieces.columns.index("name")

    def run(batches):
        model, tree = shared.value
        base = base_of(model)
        for batch in batches:
            if batch.num_rows:
                names = batch.column(at).to_numpy().view(np.uint64)
                leaf = tree.leaves(model.projected(_ids(batch), end_id, base), names)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=schema.names)

    return pieces.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard: int = SHARD, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian 32-bit integers),
    doc_tokens, sequence_id, offset."""
    if window & (window - 1):
        raise ValueError("window is a power of two")
    cut = written(_cut(docs, path, window, end_id), "cut")
    pieces = (cut.where("sequence_id is null").drop("sequence_id")
              .withColumn("name", F.xxhash64("doc_id", "part", "start")))
    model, tree = fit(pieces, shard, end_id)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        leaf, number = -1, 0
        pool: list[Piece] = []
        rows: list[tuple] = []

        def emit(sequences):
            nonlocal number
            for members in sequences:
                offset = 0
                for p in members:
                    rows.append((p.doc_id, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.total, number, offset))
                    offset += len(p.ids)
                number += 1

        def flush():
            for i in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 1024]), TYPES)], names=SCHEMA.names)
            rows.clear()

        def end():
            if pool:
                windows, left = pack_shard(pool, window, end_id, model)
                emit([*windows, *powers_of_two(left)])
                pool.clear()

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("leaf", "doc_id", "start", "doc_tokens")]
            for own, doc_id, start, total, ids in zip(*columns, _ids(batch)):
                if own != leaf:
                    end()
                    leaf, number = own, own << 40
                pool.append(Piece(doc_id, start, ids, total))
                if len(pool) >= 2 * shard:
                    windows, pool[:] = pack_shard(pool, window, end_id, model)
                    emit(windows)
            yield from flush()
        end()
        yield from flush()

    def widened(batches):
        for batch in batches:
            if batch.num_rows:
                ids = pa.array([x.astype("<u4").tobytes() for x in _ids(batch)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids if n == "ids" else batch.column(batch.schema.get_field_index(n)) for n in SCHEMA.names],
                                                 names=SCHEMA.names)

    whole = cut.where("sequence_id is not null").withColumn("offset", F.lit(0).cast("long")).mapInArrow(widened, SCHEMA)
    return whole.union(routed(pieces, model, tree, end_id).repartition("leaf").sortWithinPartitions("leaf", "doc_id", "part", "start")
                       .mapInArrow(run, SCHEMA))


TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
CUT = "doc_id long, part long, start long, length long, ids binary, doc_tokens long, sequence_id long"
CUT_NAMES = ["doc_id", "part", "start", "length", "ids", "doc_tokens", "sequence_id"]
CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

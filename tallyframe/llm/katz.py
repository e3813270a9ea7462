r"""Katz backoff language model of words: training and scoring as exchanges of packed blocks.

P(w | h) is r*(c(h w)) / c(h) for an n-gram seen in training, else alpha(h) P(w | h'), where h'
is h without its first word; P(w) is r*(c(w)) / N, and what is left is the probability of one
unknown word. r* is the Good-Turing count of each order from a line fitted to the counts of
counts (simple Good-Turing), so every seen count is discounted and something is always left;
alpha(h) makes P(. | h) sum to exactly 1 over all training words and the unknown one. A context
that training does not have is shortened. A text starts after one start mark, which stands in
contexts as a word, and ends with the end token. `order` is the longest n-gram.

Documents are cut once into blocks of BLOCK words, kept as a table. A block sends its distinct
words to word buckets and gets back ids and counts. Then the orders follow, lowest first: a block
sends its distinct n-grams, with training counts and the probability of the last word in the
shorter context, to buckets by the context's id (that of a very frequent context is split by the
last word). Each bucket is a row of a partitioned table, from which counts of counts and weights
are computed. Below the longest order, blocks get back the ids, counts and probabilities of
their n-grams, which are the contexts and the lower probabilities of the next order; of the
longest order, the n-grams are scored to sums by document. What moves are compressed arrays, in
proportion to the words; the driver gets counts of counts alone. The sums of a split context go
to its buckets by a join.

Words are `[^\x20\x09-\x0D]+` with A-Z lower-cased, as 64-bit hashes; ids of words and n-grams
have 64 bits. Defined cases: a null or empty text has the end token alone; with no training rows
every word is unknown and every score 0; equal texts get equal scores, repeated rows are documents
of their own. Of the input, doc_id, text and held_out are used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .tables import written

ORDER = 2
BLOCK = 2_000_000  # words
BUCKET = 1_000_000  # words of an n-gram bucket to aim at
SPLIT = 500_000  # a context with so many occurrences is split
UNKNOWN, START = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFE)
NOWHERE = np.uint32(0xFFFFFFFF)  # in place of an n-gram: the word is scored already
END_HASH = np.uint64(0xC0FFEE0000000001)


def pack(x: np.ndarray) -> bytes:
    """Compressed array; the bytes of all items are sorted by place first."""
    head = x.dtype.str[1:].encode().ljust(2) + len(x).to_bytes(6, "little")
    return head + zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    dtype, n = np.dtype("<" + blob[:2].decode().strip()), int.from_bytes(blob[2:8], "little")
    data = np.frombuffer(zstandard.decompress(blob[8:]), np.uint8)
    return np.ascontiguousarray(data.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype) if n else np.empty(0, dtype)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    x = unpack(blob)
    return np.cumsum(x, dtype=x.dtype)


@dataclass
class Discount:
    """Simple Good-Turing: r* = r (1 + 1/r) ** (slope + 1)."""

    slope: float

    @staticmethod
    def fit(r: np.ndarray, n: np.ndarray) -> Discount:
        slope = -2.0
        if len(r) > 1:
            before, after = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
            slope = float(np.polyfit(np.log(r), np.log(2.0 * n / (after - before)), 1)[0])
        return Discount(min(slope, -1.05))

    def __call__(self, r: np.ndarray) -> np.ndarray:
        r = np.maximum(np.asarray(r, float), 1e-300)
        return np.where(r >= 1, r * (1 + 1 / np.maximum(r, 1)) ** (self.slope + 1), 0.0)


@dataclass
class Unigrams:
    total: int  # N
    distinct: int  # V
    discount: Discount
    unknown: float

    def probability(self, count: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(count))
        return np.where(np.asarray(count) > 0, self.discount(count) / self.total, self.unknown)


def _blocks(batches, size: int):
    """(number, doc_ids, held_out, words of each document with the end token, hashes)."""
    number, held = TaskContext.get().partitionId() << 24, [[], [], [], []]
    count = 0

    def done():
        return number, held[0], np.array(held[1], bool), np.concatenate(held[2]), np.concatenate(held[3])

    for part in X.slices(batches):
        rows, hashes, *_ = X.words(part.column(1))
        at = X.row_starts(rows, part.num_rows)
        held[0] += part.column(0).to_pylist()
        held[1] += part.column(2).to_pylist()
        held[2].append(np.diff(at) + 1)
        held[3].append(np.insert(hashes, at[1:], END_HASH))
        count += len(held[3][-1])
        if count >= size:
            yield done()
            number, held, count = number + 1, [[], [], [], []], 0
    if held[0]:
        yield done()


def _hist(table: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the counts packed in a column; at most about sqrt(2 N) of them."""

    def count(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                r, n = np.unique(unpack(blob), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), pa.array(n.astype(np.int64))], names=["r", "n"])

    found = (table.select(column).where(F.col(column).isNotNull()).mapInArrow(count, "r long, n long").where("r > 0")
             .groupBy("r").agg(F.sum("n").alias("n")).orderBy("r").toPandas())
    return found["r"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def score(docs: DataFrame, order: int = ORDER, block: int = BLOCK, bucket: int = BUCKET, split: int = SPLIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row;
    the model learns from the rows with held_out false."""
    if order < 2:
        raise ValueError("an order of 2 at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(size / 6 / bucket))
    blocks = written(docs.mapInArrow(lambda batches: _cut(batches, block), _BLOCKS), "blocks")
    words, unigrams = _words(blocks, max(2, (buckets // 4).bit_length()))
    base_scale = np.log10(unigrams.total + unigrams.distinct + 1)

    def first_sent(state: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        replies = replies.sort_values("part")
        word_ids, local = np.unique(np.concatenate([unpack(b) for b in replies["ids"]]), return_inverse=True)
        row = state.iloc[0]
        lengths, tokens = unpack(row["lengths"]).astype(np.int64), unpack(row["places"])[unpack(row["tokens"])]
        count, at = np.concatenate([unpack(b) for b in replies["counts"]])[tokens], local.astype(np.int32)[tokens]
        end = np.cumsum(lengths) - 1
        starts = end - lengths + 1
        context, context_count = np.empty_like(at), np.empty_like(count)
        context[1:], context_count[1:] = at[:-1], count[:-1]
        context[starts], context_count[starts] = len(word_ids), count[end[0]]  # as many starts as ends in training
        context[context_count == 0] = -1
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        alone = context < 0
        about = {"block": row["block"], "doc_ids": row["doc_ids"], "held_out": row["held_out"], "lengths": row["lengths"],
                 "known": pack(np.bincount(doc, count > 0, len(lengths))),
                 "base": pack(np.bincount(doc, np.log10(count.astype(float) + 1) - base_scale, len(lengths)))}
        direct = np.bincount(doc[alone], np.log10(unigrams.probability(count[alone])), len(lengths)).astype(float)
        return _messages(about, doc, direct, context, np.append(word_ids, START), context_count, at, word_ids, count, buckets, split, order > 2)

    def next_sent(k: int):
        def send(pdf: pd.DataFrame) -> pd.DataFrame:
            row = next(r for r in pdf["about"] if r is not None)
            replies = pdf[pdf["ids"].notna()].sort_values("bucket")
            ids = np.concatenate([np.empty(0, np.uint64), *map(unpack, replies["ids"])])
            counts = np.concatenate([np.empty(0, np.uint32), *map(unpack, replies["counts"])])
            p = np.concatenate([np.empty(0, np.float64), *map(unpack, replies["p"])])
            gram, at = unpack(row["grams"]), unpack(row["words"])
            lengths = unpack(row["lengths"]).astype(np.int64)
            doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            here = gram != NOWHERE
            low = np.zeros(len(gram))
            low[here] = p[gram[here]]
            # the n-gram that ends one word before is the context, if training has it
            context, context_count = np.full(len(gram), -1, np.int32), np.zeros(len(gram), np.uint32)
            before = np.flatnonzero(here[:-1] & (doc[1:] == doc[:-1]))
            before = before[counts[gram[before]] > 0]
            context[before + 1], context_count[before + 1] = gram[before], counts[gram[before]]
            alone = here & (context < 0)
            direct = unpack(row["direct"]) + np.bincount(doc[alone], np.log10(low[alone]), len(lengths))
            return _messages(row, doc, direct, context, ids, context_count, at, unpack(row["word_ids"]), low, buckets, split, k < order)
        return send

    sent = (blocks.drop("words", "counts").groupBy("block").cogroup(words.where("block >= 0").select("block", "part", "ids", "counts").groupBy("block"))
            .applyInPandas(first_sent, _SENT))
    for k in range(2, order + 1):
        grams = written(sent.groupBy("bucket").applyInPandas(_count, _GRAMS), f"grams-{k}")
        weigh = Weights(Discount.fit(*_hist(grams, "counts")), unigrams.probability if k == 2 else None)
        known = grams.join(_shared(grams, weigh), "bucket", "left")
        if k < order:
            replies = known.select("bucket", "first", "low", "counts", "shared", "asked", "about").mapInArrow(weigh.replies, _REPLIES)
            sent = replies.groupBy("block").applyInPandas(next_sent(k + 1), _SENT)
    partial = known.select("bucket", "first", "low", "counts", "shared", "asked", "about").mapInArrow(
        weigh.document_sums, f"block long, docs binary, sums binary, about struct<{_ABOUT}>")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        info = next(r for r in pdf["about"] if r is not None)
        out = unpack(info["direct"]).copy()
        for docs_, sums_ in zip(pdf["docs"], pdf["sums"]):
            if docs_ is not None:
                out[unpack_sorted(docs_)] += unpack(sums_)
        return pd.DataFrame({"doc_id": pd.array(list(info["doc_ids"]), "Int64"), "held_out": list(info["held_out"]), "n_tokens": unpack(info["lengths"]).astype(np.int64),
                             "n_known": unpack(info["known"]).astype(np.int64), "train_tokens": unigrams.total, "base_score": unpack(info["base"]), "score": out})

    return partial.groupBy("block").applyInPandas(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_BLOCKS = "block long, doc_ids array<long>, held_out array<boolean>, lengths binary, tokens binary, places binary, words binary, counts binary"
# `words`, `word_ids` and `grams` are there as long as an order follows
_ABOUT = ("block:long,doc_ids:array<long>,held_out:array<boolean>,lengths:binary,known:binary,base:binary,direct:binary,"
          "words:binary,word_ids:binary,grams:binary")
_SENT = f"block long, bucket int, first binary, second binary, low binary, learned binary, times binary, docs binary, divided binary, about struct<{_ABOUT}>"
_GRAMS = (f"bucket int, first binary, low binary, counts binary, divided binary, "
          f"asked array<struct<block:long,at:binary,times:binary,docs:binary>>, about array<struct<{_ABOUT}>>")
_REPLIES = f"block long, bucket int, ids binary, counts binary, p binary, about struct<{_ABOUT}>"
_ABOUT_TYPE = pa.struct([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                         *((n, pa.binary()) for n in ("lengths", "known", "base", "direct", "words", "word_ids", "grams"))])


def _cut(batches, block: int):
    """Blocks of documents: their distinct words with training counts, and the words as places among them."""
    for number, ids, held, lengths, hashes in _blocks(batches, block):
        words, back, often = np.unique(hashes, return_inverse=True, return_counts=True)
        counts = np.bincount(back, np.repeat(~held, lengths), len(words)).astype(np.uint32)
        # commonest words first: small numbers are packed best
        order = np.argsort(-often, kind="stable").astype(np.uint32)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())),
             *(pa.array([b], pa.binary()) for b in (pack(lengths.astype(np.uint32)), pack(rank[back]), pack(order), pack_sorted(words), pack(counts)))],
            names=["block", "doc_ids", "held_out", "lengths", "tokens", "places", "words", "counts"])


def _words(blocks: DataFrame, bits: int) -> tuple[DataFrame, Unigrams]:
    """Ids and counts of each block's words, by buckets of the first bits of their hashes."""

    def send(batches):
        for batch in batches:
            for number, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                words, counts = unpack_sorted(words), unpack(counts)
                cuts = np.searchsorted(words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                some = [i for i in range(1 << bits) if cuts[i] < cuts[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32()),
                     pa.array([pack_sorted(words[cuts[i]:cuts[i + 1]]) for i in some], pa.binary()),
                     pa.array([pack(counts[cuts[i]:cuts[i + 1]]) for i in some], pa.binary())], names=["block", "part", "words", "counts"])

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sent = [unpack_sorted(b) for b in pdf["words"]]
        words, back = np.unique(np.concatenate(sent), return_inverse=True)
        counts = np.bincount(back, np.concatenate([unpack(b) for b in pdf["counts"]]), len(words)).astype(np.uint32)
        order = np.argsort(-counts.astype(np.int64), kind="stable")
        ids = np.empty(len(words), np.uint64)
        ids[order] = np.arange(len(words), dtype=np.uint64) << np.uint64(bits) | np.uint64(key[0])
        ids[counts == 0] = UNKNOWN
        at = np.cumsum([0, *map(len, sent)])
        found = [back[a:b] for a, b in zip(at, at[1:])]
        return pd.DataFrame({"block": [*pdf["block"], -1], "part": key[0], "ids": [*(pack(ids[f]) for f in found), None],
                             "counts": [*(pack(counts[f]) for f in found), None], "model": [*[None] * len(found), pack(counts)]})

    sent = blocks.select("block", "words", "counts").mapInArrow(send, "block long, part int, words binary, counts binary")
    words = written(sent.groupBy("part").applyInPandas(count, "block long, part int, ids binary, counts binary, model binary"), "words")
    r, n = _hist(words, "model")
    total, discount = int((r * n).sum()), Discount.fit(r, n)
    return words, Unigrams(total, int(n.sum()), discount, 1 - float((discount(r) * n).sum()) / total if total else 1.0)


def _messages(about: dict, doc, direct, context, context_ids, context_count, word, word_ids, low, buckets: int, split: int, follows: bool) -> pd.DataFrame:
    """A block's distinct n-grams by buckets, and the block's own row; `context` (-1: none) and `word` of
    each place are places in `context_ids` and `word_ids`."""
    held = np.array(about["held_out"], bool)
    keep = np.flatnonzero(context >= 0).astype(np.int32)
    key = context[keep].astype(np.uint64) << np.uint64(32) | word[keep].astype(np.uint64)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key, keep = key[order], keep[order]
    del order
    fresh = np.append(True, key[1:] != key[:-1]) if len(keep) else np.empty(0, bool)
    new = np.flatnonzero(fresh).astype(np.int32)
    times = np.diff(np.append(new, np.int32(len(key))))
    del key
    learned = np.add.reduceat(~held[doc[keep]], new, dtype=np.int64) if len(new) else new
    at = keep[new]
    first, second, splits = context_ids[context[at]], word_ids[word[at]], context_count[at] // split + 1
    salt = X.mix(second) % splits.astype(np.uint64)
    to = (X.mix(first ^ X.mix(salt)) % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(to, kind="stable").astype(np.int32)
    cuts = np.searchsorted(to[by], np.arange(buckets + 1))
    # the occurrences of each n-gram follow it
    ends = np.cumsum(times[by], dtype=np.int32)
    place = np.arange(len(keep), dtype=np.int32) + np.repeat(new[by] - (ends - times[by]), times[by])
    docs, ends = doc[keep][place].astype(np.uint16 if len(held) < 1 << 16 else np.uint32), np.append(0, ends)
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        s = by[cuts[b]:cuts[b + 1]]
        rows.append((about["block"], b, pack_sorted(first[s]), pack(second[s]), pack(low[at[s]]), pack(learned[s].astype(np.uint32)),
                     None if follows else pack(times[s].astype(np.uint32)), None if follows else pack(docs[ends[cuts[b]]:ends[cuts[b + 1]]]),
                     pack_sorted(np.unique(first[s][splits[s] > 1])), None))
    own = {**about, "direct": pack(direct), "words": None, "word_ids": None, "grams": None}
    if follows:
        rank = np.empty(len(by), np.uint32)
        rank[by] = np.arange(len(by), dtype=np.uint32)
        grams = np.full(len(doc), NOWHERE)
        grams[keep] = rank[np.cumsum(fresh) - 1]
        own |= {"words": pack(word.astype(np.uint32)), "word_ids": pack(word_ids), "grams": pack(grams)}
    rows.append((about["block"], int(X.mix(np.array([about["block"]], np.uint64))[0] % np.uint64(buckets)), *[None] * 7, own))
    return pd.DataFrame(rows, columns=["block", "bucket", "first", "second", "low", "learned", "times", "docs", "divided", "about"])


def _count(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's n-grams with training counts and ids, and which of them each block asks for."""
    info = pdf["first"].isna()
    mine, about = pdf[~info], [r for r in pdf["about"] if r is not None]
    firsts, none = [unpack_sorted(b) for b in mine["first"]], np.empty(0, np.uint64)
    first = np.concatenate([none, *firsts])
    second = np.concatenate([none, *map(unpack, mine["second"])])
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    fresh = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])) if len(first) else np.empty(0, bool)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    low = np.concatenate([unpack(b) for b in mine["low"]])[order[fresh]] if len(order) else np.empty(0, np.uint32)
    learned = np.concatenate([unpack(b) for b in mine["learned"]]) if len(order) else np.empty(0, np.uint32)
    counts = np.bincount(back, learned, int(fresh.sum())).astype(np.uint32)
    cuts = np.cumsum([0, *map(len, firsts)])
    asked = [{"block": int(b), "at": pack(back[i:j].astype(np.uint32)), "times": t, "docs": d}
             for b, i, j, t, d in zip(mine["block"], cuts, cuts[1:], mine["times"], mine["docs"])]
    divided = np.unique(np.concatenate([none, *map(unpack_sorted, mine["divided"])]))
    return pd.DataFrame({"bucket": [key[0]], "first": [pack_sorted(first[fresh])], "low": [pack(low)], "counts": [pack(counts)],
                         "divided": [pack_sorted(divided)], "asked": [asked], "about": [about]})


@dataclass
class Weights:
    """Probabilities of one order; `lower` makes what was sent as `low` the probability in the shorter context."""

    discount: Discount
    lower: object = None

    def sums(self, first, low, counts):
        """By context: training count, discounted mass of its n-grams, their last words' mass in the shorter context."""
        ids, back = np.unique(first, return_inverse=True)
        seen = counts > 0
        total = lambda at, x: np.bincount(at, x, len(ids)).astype(float)
        return ids, back, total(back, counts), total(back, self.discount(counts)), total(back[seen], self._low(low)[seen])

    def _low(self, low):
        return self.lower(low) if self.lower else low

    def probability(self, first, low, counts, shared):
        ids, back, c, mass, under = self.sums(first, low, counts)
        if shared:
            at = np.searchsorted(ids, np.array([r["first"] for r in shared], np.int64).view(np.uint64))
            c[at], mass[at], under[at] = ([r[n] for r in shared] for n in ("c", "mass", "low"))
        with np.errstate(divide="ignore", invalid="ignore"):
            # a context without n-grams in training has no counts here: its words back off whole
            alpha = np.where(c > 0, (1 - mass / c) / (1 - under), 1.0)
            return np.where(counts > 0, self.discount(counts) / c[back], alpha[back] * self._low(low))

    def _rows(self, batches):
        for batch in batches:
            for bucket, first, low, counts, shared, asked, about in zip(*(c.to_pylist() for c in batch.columns)):
                counts = unpack(counts)
                yield bucket, counts, self.probability(unpack_sorted(first), unpack(low), counts, shared), asked, about

    def replies(self, batches):
        """To each block the ids, counts and probabilities of its n-grams, and its own row."""
        names = ["block", "bucket", "ids", "counts", "p", "about"]
        for bucket, counts, p, asked, about in self._rows(batches):
            # numbers that no other n-gram of this order has; those that training lacks are never contexts
            for r in asked:
                at = unpack(r["at"])
                ids = at.astype(np.uint64) << np.uint64(31) | np.uint64(bucket)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([bucket], pa.int32()), pa.array([pack(ids)], pa.binary()),
                                                  pa.array([pack(counts[at])], pa.binary()), pa.array([pack(p[at])], pa.binary()), pa.nulls(1, _ABOUT_TYPE)], names=names)
            for r in about:
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.nulls(1, pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(3)),
                                                  pa.array([r], _ABOUT_TYPE)], names=names)

    def document_sums(self, batches):
        names = ["block", "docs", "sums", "about"]
        for _, _, p, asked, about in self._rows(batches):
            value = np.log10(p)
            for r in asked:
                doc = unpack(r["docs"])
                found = np.bincount(doc, np.repeat(value[unpack(r["at"])], unpack(r["times"])))
                some = np.unique(doc)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([pack_sorted(some)], pa.binary()),
                                                  pa.array([pack(found[some])], pa.binary()), pa.nulls(1, _ABOUT_TYPE)], names=names)
            for r in about:
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                                                  pa.array([r], _ABOUT_TYPE)], names=names)


def _shared(grams: DataFrame, weigh: Weights) -> DataFrame:
    """bucket, shared: the sums over all buckets of the split contexts that a bucket has."""

    def partial(batches):
        for batch in batches:
            for bucket, first, low, counts, divided in zip(*(c.to_pylist() for c in batch.columns)):
                divided = unpack_sorted(divided)
                if not len(divided):
                    continue
                ids, _, c, mass, under = weigh.sums(unpack_sorted(first), unpack(low), unpack(counts))
                some = np.isin(ids, divided)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), bucket, np.int32)), pa.array(ids[some].view(np.int64)),
                                                  *(pa.array(x[some]) for x in (c, mass, under))], names=["bucket", "first", "c", "mass", "low"])

    parts = written(grams.select("bucket", "first", "low", "counts", "divided").mapInArrow(
        partial, "bucket int, first long, c double, mass double, low double"), "split-contexts")
    # in one order, so that sums of doubles do not depend on the shuffle
    whole = parts.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("bucket", "c", "mass", "low"))).alias("parts"))
    add = [F.aggregate(F.col("parts")[n], F.lit(0.0), lambda x, y: x + y).alias(n) for n in ("c", "mass", "low")]
    whole = (whole.select("first", F.col("parts.bucket").alias("in"), *add)
             .select(F.explode("in").alias("bucket"), F.struct("first", "c", "mass", "low").alias("s")))
    return written(whole.groupBy("bucket").agg(F.collect_list("s").alias("shared")), "split-sums")

"""Repeated passages by sparse suffix arrays.

A passage is a run of at least LENGTH words (A-Z lower-cased) that occurs elsewhere in the
corpus. Suffixes are kept at minimiser positions only: the least hash of K-word runs in every
window of LENGTH words, so all copies of a passage keep suffixes at the same places of it.
Suffixes whose first K words occur once are dropped; equal suffixes with equal
surroundings become one. The rest are sorted, neighbours compared (longest common
prefixes), and the matches extended to the right and left over the words of a window; of
every repeated window the first occurrence by (doc_id, hash of the text, place) stays, and all
others are to go.
Suffixes that share their first K words with more than CROWD others are compared by hashes
of all windows through an aggregate instead, so no group has to fit into a task.

Defined cases: null, empty and short texts have no passages; rows of equal doc_id and text are
one document, and rows of equal doc_id (or of none) and different texts are documents of their own,
told apart by 64 bits of the text's hash; a null doc_id comes first in order; a text that repeats
within itself counts.
`spans` uses doc_id and text; `remove` passes all other columns through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .tables import may_be_in, split_by, written

LENGTH, K = 50, 16
AROUND = LENGTH - K  # words of context on each side
CROWD = 20_000
CHUNK = 20_000  # suffixes that are sorted at a time, at least
_MIX = X.mix(np.arange(1, 2 * AROUND + 3, dtype=np.uint64)) | np.uint64(1)


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the K-word runs at the minimiser positions of one text, and the positions."""
    runs = X.window_hashes(words, K)
    n = len(runs) - AROUND
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(runs, AROUND + 1).argmin(axis=1) + np.arange(n)
    at = np.unique(least)
    return runs[at], at


def contexts(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words on both sides of each run, nearest first (0 beyond the text), and how many there are."""
    n = len(words)
    padded = np.zeros(n + 2 * AROUND, np.uint32)
    padded[AROUND:AROUND + n] = words.astype(np.uint32)
    left = padded[at[:, None] + np.arange(AROUND - 1, -1, -1)]
    right = padded[at[:, None] + np.arange(AROUND + K, 2 * AROUND + K)]
    return np.hstack([left, right]), np.minimum(at, AROUND), np.minimum(n - at - K, AROUND)


def runs(head: np.ndarray, cx: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's suffixes: the indexes of the first ones of runs, and from each the
    distances to the second and to the last one of its run (0 if alone).

    A run has equal suffixes with equal surroundings at most LENGTH words apart, as in a text
    that repeats a few words on and on; their windows touch, so a run is one row."""
    if len(np.unique(head)) == len(head):
        none = np.zeros(len(head), np.int64)
        return np.arange(len(head)), none, none
    order = np.lexsort((at, cx, head))
    h, c, a = head[order], cx[order], at[order]
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (a[1:] - a[:-1] > LENGTH))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h)) - 1
    return order[first], a[np.minimum(first + 1, last)] - a[first], a[last] - a[first]


def _by_text(column: pa.Array) -> Iterator[np.ndarray]:
    rows, hashes, *_ = X.words(column)
    at = X.row_starts(rows, len(column)).tolist()
    for a, b in zip(at, at[1:]):
        yield hashes[a:b]


def compare(group: np.ndarray, around: np.ndarray, lefts: np.ndarray, rights: np.ndarray,
            rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes of ascending groups: the least and greatest extension to the left of repeated
    windows, and the same of those that have an occurrence of lower rank (least > greatest: none)."""
    n = len(group)
    order = np.lexsort([*around[:, :AROUND - 1:-1].T, group])  # by group, then the words to the right
    group, around, lefts, rights, rank = group[order], around[order], lefts[order], rights[order], rank[order]
    # longest common prefixes of neighbours
    same = np.column_stack([around[1:, AROUND:] == around[:-1, AROUND:], np.zeros(n - 1, bool)])
    common = np.append(-1, np.where(group[1:] == group[:-1], same.argmin(axis=1), -1))
    least, most = np.full((2, n), AROUND + 1), np.full((2, n), -1)
    left_hash = np.zeros(n, np.uint64)
    for left in range(AROUND + 1):
        if left:
            left_hash = X.mix(left_hash * np.uint64(0x9FB21C651E98DF25) + around[:, left - 1])
        right = AROUND - left
        block = np.cumsum(common < right)
        valid = np.flatnonzero((lefts >= left) & (rights >= right))
        if len(valid) < 2:
            continue
        by = valid[np.lexsort((rank[valid], left_hash[valid], block[valid]))]
        new = np.append(True, (block[by[1:]] != block[by[:-1]]) | (left_hash[by[1:]] != left_hash[by[:-1]]))
        alone = new & np.append(new[1:], True)
        for k, some in ((0, by[~alone]), (1, by[~new])):
            least[k, some] = np.minimum(least[k, some], left)
            most[k, some] = np.maximum(most[k, some], left)
    out = np.empty((4, n), np.int64)
    out[:, order] = least[0], most[0], least[1], most[1]
    return out[0], out[1], out[2], out[3]


_FOUND = "head long, cx long, low int, high int, cut_low int, cut_high int"
_FIRST_ID = -(1 << 63)  # stands for a null doc_id
# a place: the word number, and 6 bits each for the context on the left and right


def _around(column: pa.Array) -> np.ndarray:
    data, _ = X.byte_view(column)
    return data.view(np.uint32).reshape(len(column), 2 * AROUND)


def _compare_sorted(batches):
    """Rows sorted by head; whole groups are compared, many at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def run(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        heads, cx, doc, part, place = (batch.column(i).to_numpy() for i in range(5))
        rank = np.empty(len(heads), np.int64)
        rank[np.lexsort((place, part, doc))] = np.arange(len(heads))
        found = compare(np.cumsum(np.append(True, heads[1:] != heads[:-1])), _around(batch.column(5)),
                        (place >> 6) & 63, place & 63, rank)
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(f.astype(np.int32)) for f in found)],
                                         names=["head", "cx", "low", "high", "cut_low", "cut_high"])
        return out.filter(pa.array(found[1] >= 0))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            table = pa.Table.from_batches(held)
            heads = table.column(0).to_numpy()
            whole = int(np.flatnonzero(heads == heads[-1])[0])
            if whole:
                yield run(table.slice(0, whole))
                held, size = table.slice(whole).to_batches(), table.num_rows - whole
    if size:
        yield run(pa.Table.from_batches(held))


def _window_hashes(batches):
    """One row for each window around a run: a hash of its words."""
    for batch in batches:
        heads, place, around = batch.column(0).to_numpy().view(np.uint64), batch.column(4).to_numpy(), _around(batch.column(5))
        for left in range(AROUND + 1):
            right = AROUND - left
            h = X.mix(heads + np.uint64(left))
            for j in [*range(left), *range(AROUND, AROUND + right)]:
                h = X.mix(h * np.uint64(0x9FB21C651E98DF25) + around[:, j])
            some = pa.array(np.flatnonzero(((place >> 6) & 63 >= left) & (place & 63 >= right)))
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)).take(some), *(batch.column(i).take(some) for i in range(5)),
                     pa.array(np.full(len(some), left, np.int32))], names=["window", "head", "cx", "doc", "part", "place", "left"])


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans, sorted by start, with those that touch made one."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], reach[last]


def _settled(batches):
    """Rows sorted by (doc, part, start): of each text the spans to go, and what stays of the rest."""
    held: list[tuple] = []

    def settle():
        doc, part = held[0][:2]
        gone, start, end = (np.array([r[k] for r in held]) for k in (2, 3, 4))
        out = _union(start[gone], end[gone])
        starts, ends = _union(start, end)
        # every span to go lies in one span of all: what is between them stays
        begin = np.concatenate([starts, out[1]])
        finish = np.concatenate([out[0], ends])
        begin.sort()
        finish.sort()
        some = begin < finish
        stay = begin[some], finish[some]
        for removed, (a, b) in ((True, out), (False, stay)):
            for x, y in zip(a.tolist(), b.tolist()):
                yield doc, part, removed, x, y

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SPAN_TYPES)],
                                          names=["doc", "part", "removed", "start", "end"])

    for batch in batches:
        rows: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:2] != row[:2]:
                rows += settle()
                held = []
            held.append(row)
        if rows:
            yield as_batch(rows)
    if held:
        yield as_batch(list(settle()))


_SPAN_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]


def _keyed(docs: DataFrame) -> DataFrame:
    """With doc, the document's number in order, and part, which tells texts of one number apart."""
    return (docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)))
            .withColumn("part", F.xxhash64("text")))


def spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc, part, removed, start, end: the repeated passages of each text in words.

    removed: words in windows whose content occurs earlier; else the words of repeated windows
    that stay, as they occur here first. Spans of one text do not overlap."""
    docs = _keyed(docs.select("doc_id", "text")).select("doc", "part", "text")

    def suffix(doc, part, words, at):
        around, lefts, rights = contexts(words, at)
        cx = X.mix((np.column_stack([around, lefts, rights]).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64))
        place = (at.astype(np.int64) << 12) | (lefts << 6) | rights
        return around, [cx.view(np.int64), np.full(len(at), doc), np.full(len(at), part), place]

    def all_suffixes(batches):
        for batch in X.slices(batches):
            found = [[np.empty(0, np.int64)] for _ in range(7)]
            for doc, part, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _by_text(batch.column(2))):
                head, at = minimisers(words)
                if len(at):
                    cx, docs_, parts, place = suffix(doc, part, words, at)[1]
                    some, second, last = runs(head, cx, at)
                    for to, x in zip(found, (head.view(np.int64)[some], cx[some], docs_[some], parts[some], place[some], second, last)):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found],
                                             names=["head", "cx", "doc", "part", "place", "second", "last"])

    suffixes = written(docs.mapInArrow(all_suffixes, "head long, cx long, doc long, part long, place long, second long, last long"), "suffixes")
    repeated = suffixes.groupBy("head").agg(F.count("*").alias("n"), F.max("last").alias("run")).where("n > 1 or run > 0").select("head")
    occurrences = written(suffixes.join(repeated.hint("shuffle_hash"), "head"), "occurrences")
    # equal surroundings: one suffix stands for all, its first occurrence
    own = F.struct("doc", "part", "place")
    classes = written(occurrences.groupBy("head", "cx").agg(F.min(own).alias("first"), F.max(own).alias("final")), "classes")
    heads = classes.groupBy("head").agg(F.count("*").alias("n")).where("n > 1")
    reps = written(classes.join(heads, "head").select("head", "n", "first.*"), "reps")
    places = reps.groupBy("doc", "part").agg(F.sort_array(F.collect_set("place")).alias("places"))

    def surroundings(batches):
        for batch in X.slices(batches):
            for doc, part, places, words in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), _by_text(batch.column(2))):
                at = np.array(places) >> 12
                around, (cx, docs_, parts, place) = suffix(doc, part, words, at)
                head = X.window_hashes(words, K)[at].view(np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (head, cx, docs_, parts, place)),
                                                  pa.array([a.tobytes() for a in around], pa.binary())],
                                                 names=["head", "cx", "doc", "part", "place", "around"])

    # sort-merge also where one side is small: the bit map and the texts then take a Python worker each in turn
    around = (may_be_in(docs, "part", reps).join(places.hint("merge"), ["doc", "part"]).select("doc", "part", "text", "places")
              .mapInArrow(surroundings, "head long, cx long, doc long, part long, place long, around binary"))
    crowds = heads.where(F.col("n") > crowd).select("head")
    crowded = not crowds.isEmpty()
    if crowded:
        around = written(around, "around")
    few = around.join(crowds, "head", "left_anti") if crowded else around
    matches = few.repartition("head").sortWithinPartitions("head").mapInArrow(_compare_sorted, _FOUND)
    if crowded:
        windows = written(around.join(crowds, "head").mapInArrow(
            _window_hashes, "window long, head long, cx long, doc long, part long, place long, left int"), "windows")
        firsts = windows.groupBy("window").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = F.when(own != F.col("first"), F.col("left"))
        matches = matches.union(
            windows.join(firsts, "window").groupBy("head", "cx")
            .agg(F.min("left").alias("low"), F.max("left").alias("high"), F.min(later).alias("cut_low"), F.max(later).alias("cut_high")))
    matches = classes.join(matches, ["head", "cx"], "left")
    each = (occurrences.join(matches, ["head", "cx"]).withColumn("is_first", own == F.col("first"))
            .withColumn("at", F.shiftright("place", 12).cast("int")))
    # all windows of a copy repeat; of a first occurrence those do that another suffix has, or all if it has copies
    low = F.greatest(F.lit(0), F.lit(AROUND) - F.col("place").bitwiseAND(F.lit(63))).cast("int")
    high = F.shiftright("place", 6).bitwiseAND(F.lit(63)).cast("int")
    copied, first = (F.col("first") != F.col("final")) | (F.col("last") > 0), F.col("is_first")
    # ranges of extensions to the left, from the suffix `at + skip` to `at + reach`: of a run, all
    # but its very first suffix are copies
    def part_of(low, high, removed, skip, reach):
        return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(removed).alias("removed"),
                        skip.cast("int").alias("skip"), reach.cast("int").alias("reach"))

    start, run = F.lit(0), F.col("last")
    ranges = F.array(
        part_of(F.when(first, F.col("cut_low")).otherwise(low), F.when(first, F.col("cut_high")).otherwise(high), True,
                start, F.when(first, 0).otherwise(run)),
        part_of(F.when(first & (run > 0), low), high, True, F.col("second"), run),
        part_of(F.when(first & copied, low).when(first, F.col("low")), F.when(copied, high).otherwise(F.col("high")), False, start, start))
    found = (each.withColumn("r", F.filter(ranges, lambda r: r["low"] <= r["high"])).where(F.size("r") > 0)
             .select("doc", "part", "at", F.explode("r").alias("r"))
             .select("doc", "part", "r.removed", (F.col("at") + F.col("r.skip") - F.col("r.high")).alias("start"),
                     (F.col("at") + F.col("r.reach") - F.col("r.low") + LENGTH).alias("end")))
    return (found.repartition("doc", "part").sortWithinPartitions("doc", "part", "start")
            .mapInArrow(_settled, "doc long, part long, removed boolean, start int, end int"))


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, removed, start_word, end_word of all repeated passages."""
    return spans(docs).select(F.when(F.col("doc") != _FIRST_ID, F.col("doc")).alias("doc_id"), "removed",
                              F.col("start").alias("start_word"), F.col("end").alias("end_word"))


def cut(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words of the spans; what stands between kept parts is one line end."""
    column = pa.array([text])
    data, offsets = X.byte_view(column)
    first, last, _ = X.word_spans(data, offsets)
    kept, at = [], 0
    for a, b in zip(starts, ends):
        kept.append(data[at:first[a]].tobytes())
        at = int(last[b - 1])
    kept.append(data[at:].tobytes())
    parts = [k.decode().strip() for k in kept]
    return "\n".join(p for p in parts if p)


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without all but the first occurrence of each passage; other columns stay."""
    cuts = (found.where("removed").groupBy("doc", "part").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts")))
    schema = docs.schema
    keyed = _keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    touched, rest = split_by(keyed, "part", cuts)
    own = touched.join(cuts.hint("merge"), ["doc", "part"], "left").select("row.*", "cuts")
    at = docs.columns.index("text")

    def run(batches):
        for part in X.slices(batches):
            cuts = part.column(part.num_columns - 1).to_pylist()
            texts = part.column(at).to_pylist()
            new = [t if not c else cut(t, [x["start"] for x in c], [x["end"] for x in c]) for t, c in zip(texts, cuts)]
            columns = list(part.columns[:-1])
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(run, schema).union(rest.select("row.*"))

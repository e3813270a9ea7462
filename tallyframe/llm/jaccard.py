"""N-gram Jaccard join by token-combination prefixes.

A document's set has its distinct k-word shingles, as 64-bit hashes. Equal sets form one
class first, whatever their number. All sets share one order of tokens: rare ones first
(by hash), then frequent ones. Tokens are frequent by counts over all documents in a
table of 2**22 cells. A set's prefix is so long that two sets over the threshold must share
a signature in it: a single rare token, or a pair of frequent tokens of one token group.

  With e tokens of a set at most outside its partner, a prefix of r rare tokens and
  groups of n1, n2, .. frequent tokens suffices if r + (n1 - 1) + (n2 - 1) + .. > e: else
  the partner would have at most one token of each group and no rare one. Groups depend
  on a size class; a set uses those of its own class and the one below, so any two sets
  whose sizes allow a link have a class in common.

Signatures with up to MANY sets give pairs; what two sets share of their prefixes bounds
their overlap, and most pairs go by that. A set has a parity of about one bit for each token:
bit i tells whether an odd number of its tokens fall on i. Bits that differ in two parities
are no more than tokens that only one of the sets has, so they bound the overlap too. Pairs
that pass both bounds, and those of sets of a larger signature (a crowd) that pass the second
one, make clusters, whose pairs are all verified on the whole sets as bit sets. A task returns
a spanning forest of such pairs or links, never all.

  A large crowd or cluster is dealt into blocks, and some of its sets (hubs) to every block. What
  that leaves apart meets in a second round: sets of the commonest component with all others,
  and those with each other. So where sets are near to each other, each goes to few tasks.

No link is missed, but for equal hashes of different shingles (64 bits).

Defined cases: null, empty or blank texts have an empty set and link with nothing; fewer
than k words make one shingle of the whole sequence; equal sets link; repeated rows are
documents of their own. Of the input, doc_id and text are used. Rows with a null doc_id
follow the other rows of their set; a set that only such rows have links with nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .katz import pack, unpack
from .tables import components, may_be_in, written
from .vectors import _forest

WORDS = 5
SKETCH_BITS, CHUNK_BITS = 22, 12
MANY = 96  # sets of a signature that are paired one by one
BLOCK = 512  # sets of a block, where whole sets are compared
CROWD = 2048  # the same where parities stand for the sets
HUBS = 32  # sets that go to every block, as expected
PARITY_BITS = 256  # of small sets
GROUP = 3  # frequent tokens of a group, as expected
MIXED = np.uint64(0)
_SALT = np.uint64(0xA24BAED4963EE407)


def shingles(column: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    rows, hashes, *_ = X.words(column)
    at = X.row_starts(rows, len(column))
    runs = X.window_hashes(hashes, k)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a:b - k + 1]))
        else:
            out.append(X.window_hashes(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def class_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def spare(n: int, percent: int) -> int:
    """How many of n tokens a partner may lack."""
    return n - -(-percent * n // 100)


def _size_classes(percent: int) -> np.ndarray:
    """Lower ends of size classes: sets that may link are in one class or in neighbours."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] * 100 // percent + 1)
    return np.array(ends)


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int, classes: np.ndarray) -> np.ndarray:
    """Signatures of a set; MIXED is one of them if they are not all single rare tokens."""
    need = spare(len(s), percent) + 1
    flag = frequent[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    rare = s[~flag][:need]
    if len(rare) == need:
        return rare
    rest = s[flag]
    need -= len(rare)
    own = int(np.searchsorted(classes, len(s), side="right")) - 1
    found = [rare]
    for c in {own, max(own - 1, 0)}:
        groups = int(classes[c]) // GROUP
        salted = X.mix(rest ^ np.uint64((int(_SALT) * (c + 1)) & ((1 << 64) - 1)))
        if groups < 4:  # small sets: single tokens
            found.append(np.sort(salted)[:need])
            continue
        group = (salted >> np.uint64(32)) % np.uint64(groups)
        order = np.lexsort((salted, group))
        group, salted = group[order], salted[order]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        end = int(np.searchsorted(np.cumsum(~new), need)) + 1  # tokens of the prefix
        group, salted = group[:end], salted[:end]
        cuts = [*np.flatnonzero(new[:end]).tolist(), end]
        for a, b in zip(cuts, cuts[1:]):
            i, j = np.triu_indices(b - a, 1)
            found.append(X.mix(salted[a + i] * np.uint64(0x9FB21C651E98DF25) + salted[a + j]))
    return np.append(np.unique(np.concatenate(found)), MIXED)


def parity(s: np.ndarray) -> bytes:
    """For each place of a table as large as the set, whether an odd number of its tokens fall
    there. Twice the bits, folded in two halves, give half the bits."""
    bits = max(PARITY_BITS, 1 << max(0, len(s) - 1).bit_length())
    count = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    """False only for sets (by parity and size) that can't be over the threshold."""
    if len(a) > len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    both = (n + m - (x ^ y).bit_count()) // 2
    return 100 * both >= percent * (n + m - both)


def _folded(parities: list[bytes], size: int) -> np.ndarray:
    """Parities of ascending sizes, all folded to the smallest one, as rows of words."""
    out, i = [], 0
    while i < len(parities):
        own = len(parities[i])
        j = i
        while j < len(parities) and len(parities[j]) == own:
            j += 1
        rows = np.frombuffer(b"".join(parities[i:j]), np.uint64).reshape(j - i, own // 8)
        while own > size:
            own //= 2
            rows = rows[:, :own // 8] ^ rows[:, own // 8:]
        out.append(rows)
        i = j
    return np.concatenate(out)


def near_forest(n: np.ndarray, parities: list[bytes], own: np.ndarray, root: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that may link, as few as make the same components; root has those known
    before. Of sets in two blocks, only pairs of one of each are compared."""
    order = np.argsort(n, kind="stable")
    n, own, root, parities = n[order], own[order], root[order], [parities[i] for i in order.tolist()]
    cross = bool((own != own[:1]).any())
    end = np.searchsorted(n, 100 * n // percent, side="right")
    width = np.fromiter(map(len, parities), np.int64, len(parities))
    one, other = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in np.unique(width).tolist():
        low, high = np.searchsorted(width, size), np.searchsorted(width, size, side="right")
        rows = _folded(parities[low:int(end[high - 1])], size)
        for p in range(low, high):
            q = np.arange(p + 1, end[p])
            q = q[(root[q] != root[p]) & (own[q] != own[p] if cross else True)]
            if not len(q):
                continue
            both = (n[p] + n[q] - np.bitwise_count(rows[q - low] ^ rows[p - low]).sum(axis=1, dtype=np.int64)) // 2
            q = q[100 * both >= percent * (n[p] + n[q] - both)]
            if len(q):
                roots, first = np.unique(root[q], return_index=True)
                one.append(np.full(len(first), p))
                other.append(q[first])
                root[np.isin(root, roots)] = root[p]
                if (root == root[0]).all():
                    return order[np.concatenate(one)], order[np.concatenate(other)]
    return order[np.concatenate(one)], order[np.concatenate(other)]


def dealt(rows: DataFrame, count: str, size: int, hubs: int) -> DataFrame:
    """Rows with the block `left` (and `right`, `own`) of the set `key` in its group of `count`
    sets; those of hubs once for each block."""
    blocks = F.ceil(F.col(count) / size).cast("int")
    hub = (blocks > 1) & (F.pmod(F.xxhash64("key", F.lit(1)), F.col(count)) < hubs)
    at = F.when(hub, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), blocks).cast("int")))
    return rows.withColumn("left", F.explode(at)).withColumns({"right": F.col("left"), "own": F.col("left")})


def apart(rows: DataFrame, group: str, labels: DataFrame, size: int) -> DataFrame:
    """Rows (one for each set of a group) dealt to pairs of blocks, so that all pairs of different
    components meet. Sets of a group's commonest component make blocks of their own, which
    meet only those of the others."""
    rows = (rows.join(labels.select(F.col("id").alias("key"), "component"), "key", "left")
            .withColumn("component", F.coalesce("component", "key")))
    counts = rows.groupBy(group, "component").agg(F.count("*").alias("c"))
    main = (counts.groupBy(group).agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("all"))
            .select(group, F.col("main.component").alias("main"), F.ceil((F.col("all") - F.col("main.c")) / size).cast("int").alias("others"),
                    F.ceil(F.col("main.c") / size).cast("int").alias("mains")).where("others > 0"))
    rows = rows.join(main, group).withColumn("other", F.col("component") != F.col("main"))
    own = F.when(F.col("other"), F.pmod(F.xxhash64("key"), F.col("others"))).otherwise(F.col("others") + F.pmod(F.xxhash64("key"), F.col("mains")))
    reach = F.when(F.col("other"), F.col("others") + F.col("mains")).otherwise(F.col("others"))
    return (rows.withColumns({"own": own.cast("int"), "at": F.explode(F.sequence(F.lit(0), reach - 1))})
            .withColumns({"left": F.least("own", "at"), "right": F.greatest("own", "at")}).drop("main", "others", "mains", "other", "at"))


def _bits(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bit sets over the tokens that at least two of the sets have, and the sizes."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    keep = count[token] > 1
    row, bit = row[keep], place[token[keep]]
    out = np.zeros((len(sets), (int((count > 1).sum()) + 63) // 64), np.uint64)
    np.bitwise_or.at(out, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out, sizes


def _linked(bits: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    out = np.zeros(len(i), bool)
    step = max(1, (8 << 20) // max(1, 8 * bits.shape[1]))
    for a in range(0, len(i), step):
        p, q = i[a:a + step], j[a:a + step]
        both = np.bitwise_count(bits[p] & bits[q]).sum(axis=1, dtype=np.int64)
        out[a:a + step] = 100 * both >= percent * (sizes[p] + sizes[q] - both)
    return out


def join(docs: DataFrame, percent: int = 80, k: int = WORDS, many: int = MANY, block: int = BLOCK, crowd: int = CROWD,
         hubs: int = HUBS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = _size_classes(percent)
    chunk = 1 << CHUNK_BITS
    names = ["doc_id", "key", "n", "parity", "chunk", "cells"]

    def first_pass(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for part in X.slices(batches):
            sets = shingles(part.column(1), k)
            np.add.at(cells, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([class_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([parity(s) for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if cells.any():
            parts = cells.reshape(-1, chunk)
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                 pa.array(np.arange(n, dtype=np.int32)), pa.array([pack(p) for p in parts], pa.binary())], names=names)

    first = written(docs.mapInArrow(first_pass, "doc_id long, key long, n long, parity binary, chunk int, cells binary"), "sets")
    members = first.where("chunk is null").select("doc_id", "key", "n")
    total = members.agg(F.sum("n")).first()[0] or 0
    mean = total / (1 << SKETCH_BITS)
    limit = mean + 6 * mean ** 0.5 + 30

    def over(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(chunk, np.int64)
        for blob in pdf["cells"]:
            cells += unpack(blob)
        return pd.DataFrame({"chunk": [key[0]], "flags": [np.packbits(cells > limit).tobytes()]})

    flags = np.zeros((1 << SKETCH_BITS) // chunk * (chunk // 8), np.uint8)
    for r in first.where("chunk is not null").select("chunk", "cells").groupBy("chunk").applyInPandas(over, "chunk int, flags binary").collect():
        flags[r["chunk"] * (chunk // 8):(r["chunk"] + 1) * (chunk // 8)] = np.frombuffer(r["flags"], np.uint8)
    frequent = spark.sparkContext.broadcast(flags)  # 512 KB, whatever the input

    def second_pass(batches):
        flag = np.unpackbits(frequent.value).astype(bool)
        for part in X.slices(batches):
            sets = {class_key(s): s for s in shingles(part.column(0), k) if len(s)}
            sig, own = [], []
            for key, s in sets.items():
                found = signatures(s, flag, percent, classes)
                sig.append(found)
                own.append(np.full(len(found), key))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(own))],
                                                 names=["sig", "key"])

    rows = written(docs.select("text").mapInArrow(second_pass, "sig long, key long"), "signatures")
    shared = written(rows.where(F.col("sig") != int(MIXED)).groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig"), "shared")
    # one class for equal sets, named by its smallest doc_id; its size and the bound its prefix gives
    sets = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    # signatures that came twice with equal sets alone go before the next shuffle
    several = (may_be_in(rows, "sig", shared).join(shared.hint("shuffle_hash"), "sig").distinct()
               .withColumn("sets", F.count("*").over(Window.partitionBy("sig"))).where("sets > 1"))
    hits = written(several.join(sets.where("rep is not null"), "key").select("sig", "key", "n", "sets"), "hits")
    # equal sets have equal parities
    parities = written(first.where("n > 0").select("key", "parity").dropDuplicates(["key"]), "parities")
    crowded = hits.where(F.col("sets") > many)
    # of signatures that the same sets have, one will do for a crowd
    enough = (crowded.groupBy("sig", "sets").agg(F.bit_xor(F.xxhash64("key")).alias("who"))
              .groupBy("sets", "who").agg(F.min("sig").alias("sig")).select("sig"))
    crowds = written(crowded.join(enough, "sig").select("sig", "key", "n", "sets"), "crowds")
    lists = (hits.where(F.col("sets") <= many).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("of"))
             .groupBy("of").agg(F.count("*").alias("shared")))
    # the smaller set first; sizes must allow a link
    pairs = F.expr(f"""flatten(transform(of, (x, i) -> transform(
        filter(slice(of, i + 2, size(of)), y -> 100 * x.n >= {percent} * y.n), y -> struct(x.key AS a, x.n AS n, y.key AS b, y.n AS m))))""")
    pairs = (lists.select("shared", F.explode(pairs).alias("p")).groupBy("p.a", "p.n", "p.b", "p.m").agg(F.sum("shared").alias("shared")))
    # two prefixes of single rare tokens hold all that the sets share up to the end of one of
    # them, so this and what lies beyond bounds the overlap; crowds and pairs of tokens
    # give no such bound
    least = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    beyond = F.greatest(*[F.expr(f"cast(ceil({percent} * {c} / 100) as bigint) - 1") for c in ("n", "m")])
    unbound = written(crowded.select("key").union(rows.where(F.col("sig") == int(MIXED)).select("key")).distinct(), "unbound")
    free = lambda c: unbound.select(F.col("key").alias(c), F.lit(True).alias(f"free_{c}"))
    pairs = (pairs.join(free("a"), "a", "left").join(free("b"), "b", "left")
             .where(F.coalesce("free_a", "free_b", F.col("shared") + beyond >= least)).select("a", "n", "b", "m"))
    has = lambda c: parities.select(F.col("key").alias(c), F.col("parity").alias(f"{c}_parity"))

    def near(batches):
        for part in batches:
            a, n, x, b, m, y = (c.to_pylist() for c in part.columns)
            ok = pa.array([may_link(*z, percent) for z in zip(x, n, y, m)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3)], names=["a", "b"]).filter(ok)

    pairs = pairs.join(has("a"), "a").join(has("b"), "b").select("a", "n", "a_parity", "b", "m", "b_parity").mapInArrow(near, "a long, b long")

    def crowd_forest(batches):
        """Rows sorted by (sig, left, right)."""
        at, held = None, []

        def found():
            key, n, own, root = (np.array(x, np.int64) for x in list(zip(*held))[:4])
            i, j = near_forest(n, [x[4] for x in held], own, root, percent)
            return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[j])], names=["a", "b"])

        for part in batches:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if row[:3] != at:
                    if len(held) > 1:
                        yield found()
                    at, held = row[:3], []
                held.append(row[3:])
        if len(held) > 1:
            yield found()

    def compared(rows):
        by = ["sig", "left", "right"]
        return (rows.select(*by, "key", "n", "own", "component", "parity").repartition(*by).sortWithinPartitions(*by)
                .mapInArrow(crowd_forest, "a long, b long"))

    near_pairs = written(pairs.union(compared(dealt(crowds.join(parities, "key").withColumn("component", F.col("key")), "sets", crowd, hubs))), "near")
    clusters = components(near_pairs)
    large = crowds.where(F.col("sets") > crowd)
    if not large.isEmpty():
        # parities go along only with the crowds that are not yet one component
        more = written(compared(apart(large, "sig", clusters, crowd).join(parities, "key")), "near")
        if not more.isEmpty():
            clusters = components(near_pairs.union(more))
    clusters = clusters.withColumnsRenamed({"id": "key", "component": "cluster"})
    size = clusters.groupBy("cluster").agg(F.count("*").alias("sets"))
    wanted = written(clusters.join(size, "cluster").join(sets, "key").select("key", F.col("rep").alias("doc_id"), "cluster", "sets"), "wanted")

    def linked(left: int, right: int, own: np.ndarray, docs_: np.ndarray, sets_: list[np.ndarray]) -> pa.RecordBatch:
        """Forest of the links between two blocks of a cluster (or within one)."""
        bits, sizes = _bits(sets_)
        a, b = np.flatnonzero(own == left), np.flatnonzero(own == right)
        links = []
        for p in a.tolist():
            q = b[b > p] if left == right else b
            q = q[(100 * sizes[q] >= percent * sizes[p]) & (100 * sizes[p] >= percent * sizes[q])]
            if len(q):
                p = np.full(len(q), p)
                ok = _linked(bits, sizes, p, q, percent)
                links.append((p[ok], q[ok]))
        i = np.concatenate([x for x, _ in links]) if links else np.empty(0, np.int64)
        j = np.concatenate([y for _, y in links]) if links else np.empty(0, np.int64)
        root = _forest(len(own), i, j) if len(i) else np.arange(len(own))
        some = np.flatnonzero(root != np.arange(len(own)))
        return pa.RecordBatch.from_arrays([pa.array(docs_[some]), pa.array(docs_[root[some]])], names=["a", "b"])

    def compare(batches):
        """Rows sorted by (cluster, left, right): one task's texts after the other's."""
        at, held = None, [[], [], []]
        for part in X.slices(batches):
            keys = list(zip(*(part.column(i).to_pylist() for i in range(3))))
            found = shingles(part.column(6), k)
            for to, own, key, doc_id, s in zip(keys, *(part.column(i).to_pylist() for i in (3, 4, 5)), found):
                if to != at:
                    if len(held[0]) > 1:
                        yield linked(at[1], at[2], *map(np.array, held[:2]), held[2])
                    at, held = to, [[], [], []]
                if class_key(s) == key:  # else another text of the same number
                    for x, y in zip(held, (own, doc_id, s)):
                        x.append(y)
        if len(held[0]) > 1:
            yield linked(at[1], at[2], *map(np.array, held[:2]), held[2])

    def verified(rows):
        by = ["cluster", "left", "right"]
        tasks = may_be_in(docs, "doc_id", rows).join(rows, "doc_id").select(*by, "own", "key", "doc_id", "text")
        return written(tasks.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long"), "verified")

    links = verified(dealt(wanted, "sets", block, hubs))
    groups = components(links)
    large = wanted.where(F.col("sets") > block)
    if not large.isEmpty():
        names_ = sets.select("rep", F.col("key").alias("id"))
        labels = groups.withColumnRenamed("id", "rep").join(names_, "rep").select("id", "component")
        more = written(apart(large, "cluster", labels, block).select("cluster", "left", "right", "own", "key", "doc_id"), "apart")
        if not more.isEmpty():
            groups = components(links.union(verified(more)))
    named = (sets.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
             .select("key", F.coalesce("component", "rep").alias("component_id")))
    out = members.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))

"""Merkle manifest of a table, its leaves placed by bitmap ranks.

1. Each row's leaf: sha256 over the fields, each `-` or its byte count, `:` and value.
2. Bitmaps: 64 neighbouring doc_ids of a language are one word, built by bit_or with partial
   aggregation (only words that hold ids exist). The directory gives each word the number of leaves
   before it: sums over 1, 2^13, 2^26, 2^39 and 2^52 words, each a window of at most 8193 rows inside
   the next.
3. Rank: a leaf's place in its language is its word's `before` and the bits under its own (bit_count).
   No leaf is sorted. Only ids that occur more than once need an order among themselves: equal rows
   are counted first, then counts by the first three digits of the leaf are summed.
4. Levels: the nodes of one run of 8 meet as slots of one row; sha256 of the slots is the node above.
   Each language ends in its subroot, the subroots in the root.
5. Proofs go down again: a run passes the pairs (left, right) of siblings above it to its nodes; a
   leaf's proof is folded from them.

Defined cases: null fields are `-`; within a language leaves with a null doc_id come first, and
leaves of equal doc_id ascend by leaf hash, so that repeated rows get places of their own; a null
language is a language of its own, before all others; an empty table gives no rows. Columns beyond
the five are ignored, whatever their names. doc_id must fit a 64-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

RUN = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BITS, STEP_BITS = 6, 13
SALTS, LANGUAGE_SALTS = 8, 32
LEVELS = "array<struct<left:string,right:string>>"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(text: str | Column = "text") -> Column:
    """H of the five fields, with another text if given."""
    values = [F.col(c).cast("string") for c in FIELDS[:-1]] + [F.col(text) if isinstance(text, str) else text]
    return sha256(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def lowered() -> Column:
    return F.translate("text", UPPER, LOWER)


def placed(leaves: DataFrame, words: DataFrame) -> DataFrame:
    """lang, doc_id, leaf and other of all rows with `at`, the leaf's place (0, 1, ...) in its
    language, and `total`, the leaves of its language."""
    leaves = leaves.withColumn("word", F.shiftright("doc_id", WORD_BITS))
    own = ["lang", "doc_id", "leaf", "other"]
    # a word is given to each salt, as an id may be repeated without bound
    salted = words.where("word is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    l = leaves.where("doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS))).alias("l")
    found = l.join(salted.alias("r"), F.col("l.lang").eqNullSafe(F.col("r.lang")) & (F.col("l.word") == F.col("r.word"))
                   & (F.col("l.salt") == F.col("r.salt")))
    found = found.select(*[F.col(f"l.{c}") for c in [*own, "word"]], "bits", "many", "before", "total")
    under = F.expr(f"bits & ~shiftleft(-1L, cast(doc_id & {(1 << WORD_BITS) - 1} as int))")
    # in words with as many leaves as bits each id occurs once
    once = found.where("many = 0").select(*own, (F.col("before") + F.bit_count(under)).alias("at"), "total")
    again = found.where("many > 0").select(*own, "word")
    return once.unionByName(_among_equals(again.unionByName(leaves.where("doc_id is null").select(*own, "word")), words))


def directory(leaves: DataFrame) -> DataFrame:
    """The bitmap and its directory: lang, word, bits, many (leaves beyond one for an id), before
    (leaves in smaller words of the language) and total (leaves of the language)."""
    bit = F.bit_or(F.expr(f"shiftleft(1L, cast(doc_id & {(1 << WORD_BITS) - 1} as int))"))
    words = leaves.groupBy("lang", F.shiftright("doc_id", WORD_BITS).alias("word")).agg(bit.alias("bits"), F.count("*").alias("n"))
    words = written(words.withColumn("many", F.col("n") - F.coalesce(F.bit_count("bits"), F.lit(0))), "bitmap")
    out = words.select("lang", "word", "bits", "many", F.lit(0).cast("long").alias("before"))
    level, top = words.select("lang", F.col("word").alias("unit"), "n"), (64 - WORD_BITS) // STEP_BITS
    for k in range(top + 1):
        # the few units of the top level share one parent; a null unit stands before all
        parent = F.shiftright("unit", STEP_BITS) if k < top else F.lit(None).cast("long")
        level = level.withColumn("parent", parent)
        group = Window.partitionBy("lang", "parent")
        lower = F.sum("n").over(group.orderBy(F.asc_nulls_first("unit")).rowsBetween(Window.unboundedPreceding, -1))
        step = level.select(F.col("lang").alias("s_lang"), F.col("unit").alias("s_unit"), F.coalesce(lower, F.lit(0)).alias("lower"),
                            F.sum("n").over(group).alias("total"))
        out = (out.drop("total").withColumn("unit", F.shiftright("word", STEP_BITS * k))
               .join(step, F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("unit").eqNullSafe(F.col("s_unit")))
               .select("lang", "word", "bits", "many", (F.col("before") + F.col("lower")).alias("before"), "total"))
        level = level.groupBy("lang", F.col("parent").alias("unit")).agg(F.sum("n").alias("n"))
    return written(out, "directory")


def _among_equals(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The same for leaves in words that hold an id more than once: by doc_id, then leaf."""
    group = ["lang", "word", "doc_id", "head"]
    rows = rows.withColumn("head", F.substring("leaf", 1, 3)).groupBy(*group, "leaf", "other").agg(F.count("*").alias("n"))
    heads = rows.groupBy(*group).agg(F.sum("n").alias("n"))
    up = Window.partitionBy("lang", "word").orderBy("doc_id", "head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("lower", F.coalesce(F.sum("n").over(up), F.lit(0))).alias("h")
    heads = heads.join(words.alias("w"), F.col("h.lang").eqNullSafe(F.col("w.lang")) & F.col("h.word").eqNullSafe(F.col("w.word"))).select(
        *[F.col(f"h.{c}").alias(f"h_{c}") for c in group], (F.col("before") + F.col("lower")).alias("lower"), "total")
    same = Window.partitionBy(*group).orderBy("leaf", "other").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n").over(same), F.lit(0)))
    equal = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in group]
    first = F.col("lower") + F.col("inner")
    return rows.join(heads, equal[0] & equal[1] & equal[2] & equal[3]).select(
        "lang", "doc_id", "leaf", "other", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("at"), "total")


def _runs(nodes: DataFrame, node: Column) -> DataFrame:
    """The nodes (lang, at, total) of each run as slots of one row."""
    return (nodes.select("lang", "total", F.shiftright("at", 3).alias("run"), F.struct((F.col("at") % RUN).alias("slot"), node.alias("node")).alias("s"))
            .groupBy("lang", "total", "run").agg(F.sort_array(F.collect_list("s")).alias("slots"))
            .withColumn("slots", F.transform("slots", lambda s: s["node"])))


def _text(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n["hash"]), "")


def _above_nodes(runs: DataFrame) -> DataFrame:
    return runs.select("lang", F.shiftright(F.col("total") + RUN - 1, 3).alias("total"), F.col("run").alias("at"),
                       sha256(_text(F.col("slots"))).alias("hash"))


def _tree(runs: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels of runs, lowest first, and (lang, hash) of the node that remains of each
    language. `most` is the largest total, so the number of levels is known."""
    hash_of = F.col("slots")[0]["hash"].alias("hash")
    levels, tops = [runs], runs.where("total = 1").select("lang", hash_of)
    while most > 1:
        most = (most + RUN - 1) // RUN
        nodes = _above_nodes(levels[-1].where("total > 1"))
        tops = tops.unionByName(nodes.where("total = 1").select("lang", "hash"))
        if most > 1:
            levels.append(written(_runs(nodes.where("total > 1"), F.struct("hash")), f"{name}-runs"))
    return levels, tops


def _sides(i: Column) -> Column:
    """What stands left and right of the node at place i of its run."""
    slots = F.col("slots")
    return F.struct(_text(F.slice(slots, F.lit(1), i)).alias("left"),
                    _text(F.slice(slots, i + 2, F.greatest(F.size(slots) - i - 1, F.lit(0)))).alias("right"))


def _exploded(levels: list[DataFrame], name: str, ends: DataFrame | None = None) -> DataFrame:
    """lang, at, node and proof (the sides at each level, lowest first) of all nodes of the lowest
    level; only runs with what stands over them are shuffled, never the proofs of single nodes.

    `ends` may have more sides for a language (t_lang, t_salt, over) and further columns."""
    none = F.array().cast(LEVELS)
    above = None
    for k, runs in reversed(list(enumerate(levels))):
        if above is None:
            runs = runs.withColumn("above", none)
        else:
            runs = (runs.join(above, F.col("lang").eqNullSafe(F.col("a_lang")) & (F.col("run") == F.col("a_run")), "left")
                    .drop("a_lang", "a_run").withColumn("above", F.coalesce("above", none)))
        more = []
        if k == 0 and ends is not None:
            salt = F.pmod(F.col("run"), F.lit(LANGUAGE_SALTS)).cast("int")
            runs = runs.join(ends, F.col("lang").eqNullSafe(F.col("t_lang")) & (salt == F.col("t_salt"))).withColumn("above", F.concat("above", "over"))
            more = [c for c in ends.columns if c not in ("t_lang", "t_salt", "over")]
        # a node that is alone in its language has no run
        proof = F.when(F.col("total") > 1, F.concat(F.array(_sides(F.col("i"))), "above")).otherwise(F.col("above"))
        nodes = runs.select("*", F.posexplode("slots").alias("i", "node")).select(
            "lang", (F.col("run") * RUN + F.col("i")).alias("at"), "node", proof.alias("proof"), *more)
        if k:
            above = written(nodes.select(F.col("lang").alias("a_lang"), F.col("at").alias("a_run"), F.col("proof").alias("above")), f"{name}-above")
    return nodes


def _ordered(names: DataFrame) -> DataFrame:
    """The rows of distinct `lang` with `at`, their places in order (null first), by sorted ranges."""
    ranges = written(names.repartitionByRange("lang").sortWithinPartitions(F.asc_nulls_first("lang"))
                     .withColumn("part", F.spark_partition_id()), "languages")
    # one row a range, as many as shuffle partitions
    sizes = Window.orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(F.col("part").alias("s_part")).count().select("s_part", F.coalesce(F.sum("count").over(sizes), F.lit(0)).alias("lower"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first("lang"))) - 1
    return ranges.withColumn("at", within).join(sizes, F.col("part") == F.col("s_part")).select("lang", "hash", (F.col("at") + F.col("lower")).alias("at"))


def manifest(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """doc_id, lang, at (place in the language), leaf, other, subroot, root and proof: the
    siblings (left, right) at each level from the leaf up to the root.

    `other` is a second leaf of each row, carried along to be folded (the leaf if None)."""
    leaves = docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"),
                         (leaf() if other is None else other).alias("other"))
    leaves = written(leaves, "leaves")
    words = directory(leaves)
    most = words.agg(F.max("total")).first()[0] or 0
    runs = _runs(placed(leaves, words), F.struct(F.col("leaf").alias("hash"), "doc_id", "other"))
    levels, subroots = _tree(written(runs, "leaf-runs"), most, "leaf")
    subroots = written(_ordered(subroots), "subroots")
    n = subroots.count()
    tree = subroots.select(F.lit("").alias("all"), "at", "lang", "hash").select(
        F.col("all").alias("lang"), "at", F.lit(n).cast("long").alias("total"), F.struct("hash", F.col("lang").alias("name")).alias("node"))
    top_levels, root = _tree(written(_runs(tree, F.col("node")), "subroot-runs"), n, "subroot")
    found = root.first()  # one row
    ends = _exploded(top_levels, "subroot").select(
        F.col("node")["name"].alias("t_lang"), F.explode(F.sequence(F.lit(0), F.lit(LANGUAGE_SALTS - 1))).alias("t_salt"),
        F.col("proof").alias("over"), F.col("node")["hash"].alias("subroot"), F.lit(found and found["hash"]).cast("string").alias("root"))
    return _exploded(levels, "leaf", written(ends, "subroot-proofs")).select(
        "node.doc_id", "lang", "at", F.col("node")["hash"].alias("leaf"), "node.other", "subroot", "root", "proof")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda node, side: sha256(F.concat(side["left"], node, side["right"])))


def proof_hash(proof: Column) -> Column:
    return sha256(F.array_join(F.transform(proof, lambda side: F.concat(side["left"], side["right"])), ""))

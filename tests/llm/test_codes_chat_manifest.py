"""Vector codes, chat formatting and the Merkle manifest against plain loops, on odd rows too."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import chat, codes, manifest, queries, text


@pytest.fixture(autouse=True)
def small_batches(spark):
    text.set_up(spark)


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


# vector codes

def brute_nearest(book, x):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(row, e)) for e in book] for row in x]
    return [min(range(len(book)), key=lambda j: (r[j], j)) for r in d], [min(r) for r in d]


@given(st.integers(0, 10_000), st.integers(1, 120), st.integers(1, 5), st.sampled_from([1, 3, 40, 10 ** 8]))
@settings(max_examples=60, deadline=None)
def test_tree_equals_full_search(seed, entries, width, size):
    rnd = np.random.default_rng(seed)
    book = rnd.integers(-size, size + 1, (entries, width))
    x = np.concatenate([rnd.integers(-size, size + 1, (40, width)), book])
    index, best = codes.Gnat(book).nearest(x)
    assert (index.tolist(), best.tolist()) == brute_nearest(book, x)


def test_tree_leaves_children_out():
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-10_000, 10_000, (16, 8))
    book = (centres[:, None] + rnd.integers(-50, 50, (16, 16, 8))).reshape(-1, 8)
    tree = codes.Gnat(book)
    x = book[rnd.integers(0, 256, 500)] + rnd.integers(-30, 30, (500, 8))
    index, best = tree.nearest(x)
    assert (index.tolist(), best.tolist()) == brute_nearest(book, x)
    assert tree.visited < 0.5 * 500 * 256


def brute_codes(rows, rounds=4):
    """rows: (id, vector) of one dimension, usable."""
    whole = sorted((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows)
    width = len(whole[0][1]) // 4
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[part(v, p) for _, v in whole[:256]] for p in range(4)]
    for _ in range(rounds):
        for p in range(4):
            found, _ = brute_nearest(books[p], [part(v, p) for _, v in whole])
            for e in set(found):
                own = [part(v, p) for (_, v), f in zip(whole, found) if f == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, v in whole:
        found = [brute_nearest(books[p], [part(v, p)]) for p in range(4)]
        out.append((i, "".join(f"{f[0][0]:02x}" for f in found), sum(f[1][0] for f in found)))
    return out, ",".join(str(c) for b in books for e in b for c in e)


def test_codes_equal_plain_loops(spark):
    rnd = random.Random(4)
    base = [[rnd.choice([-0.5, 0.25, rnd.uniform(-1, 1)]) for _ in range(8)] for _ in range(300)]
    rows = [(i, base[i]) for i in range(300)] + [(1000 + i, base[7]) for i in range(40)] + [(3, base[9])]
    odd = [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7),
           (2004, [0.5] * 4), (2005, []), (2006, [1e30] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, "c", "r", i % 3) for i, v in rows + odd], "vec_id long, embedding array<float>, code string, row string, whole int")
    coded, books = codes.compress(df.repartition(5))
    got = sorted((r["vec_id"], r["code"], r["error"]) for r in coded.where("code is not null").collect())
    want, text = brute_codes(rows)
    assert got == sorted(want)
    assert codes.numbers(books) == text
    left = {r["vec_id"]: (r["code"], r["error"]) for r in coded.where("code is null").collect()}
    assert left == {2004: (None, None), 2005: (None, None), 2006: (None, None)}
    assert coded.columns == ["vec_id", "embedding", "row", "whole", "code", "error"]
    summed = codes.with_group_error(coded.withColumn("g", F.when(F.col("vec_id") > 50, F.col("vec_id") % 2)).select("vec_id", "g", "code", "error"), "g")
    key = lambda i: None if i <= 50 else i % 2
    total = {k: sum(e for i, _, e in want if key(i) == k) for k in (None, 0, 1)}
    assert {(r["vec_id"], r["group_error"]) for r in summed.collect()} == {(i, total[key(i)]) for i, *_ in got + [(j, 0) for j in left]}


def test_codes_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5] * 3)]):
        coded, books = codes.compress(spark.createDataFrame(rows, schema))
        assert books == [] and [r["code"] for r in coded.collect()] == [None] * (len(rows) if rows and rows[0][1] is not None else 0)
    rows = [(None, [0.1, 0.2, 0.3, 0.4]), (5, [1.0, -1.0, 0.0, 2.5]), (4, [1.0, -1.0, 0.0, 2.5])]
    coded, _ = codes.compress(spark.createDataFrame(rows, schema))
    assert {r["vec_id"]: (r["code"], r["error"]) for r in coded.collect()} == {None: ("02020202", 0), 5: ("00000000", 0), 4: ("00000000", 0)}


# chat

ODD = ["", " ", "\\", "\\s", "\\l", "\\g", "<", "<turn user>", "</turn>", "</turn>\n", "<more/>", "<tur", "n x>", ">", "\\<turn ", "a\nb", "é😀", "</", "<<turn "]
PIECES = st.lists(st.sampled_from(ODD), max_size=4).map("".join)


@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</turn>", "a>b\\", ""]), PIECES), min_size=1, max_size=7), min_size=1, max_size=12))
@settings(max_examples=12, deadline=None)
def test_format_reads_back(spark, conversations):
    rows = [(c, t, role, x) for c, turns in enumerate(conversations) for t, (role, x) in enumerate(turns)]
    found = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    got = {r["conv_id"]: r for r in found.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss")).collect()}
    for c, turns in enumerate(conversations):
        r = got[c]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss"] == "".join(x for role, x in turns if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert r["formatted"].count("<turn ") == r["formatted"].count("</turn>\n") == blocks


def test_format_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, segments int, t int"
    rows = [(1, 2, "assistant", "b", "x", 1, 1), (1, 1, "user", None, "x", 1, 1), (1, None, None, "z", "x", 1, 1), (1, 2, "assistant", "b", "x", 1, 1),
            (1, 2, "assistant", "a", "x", 1, 1), (None, 1, "user", "q", "x", 1, 1), (None, 1, "assistant", "q", "x", 1, 1), (2, 1, "user", "w" * 200_000, "x", 1, 1)]
    got = chat.format_conversations(spark.createDataFrame(rows, schema)).collect()
    texts = sorted((r["conv_id"] or 0, r["formatted"]) for r in got)
    assert texts == [(0, "<turn assistant>q</turn>\n"), (0, "<turn user>q</turn>\n"),
                     (1, "<turn >z</turn>\n<turn user></turn>\n<turn assistant>a<more/>b<more/>b</turn>\n"), (2, f"<turn user>{'w' * 200_000}</turn>\n")]
    assert chat.format_conversations(spark.createDataFrame([], schema)).collect() == []


def test_format_is_built_in_expressions_only(spark, sf_small):
    plan = queries.op12_chat_format(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# manifest

def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). Sorted (doc_id, leaf, subroot, root, proof, folded) tuples."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def leaf(r, tampered=False):
        t = r[4].translate(low) if tampered and r[4] is not None else r[4]
        return digest("".join(field(v) for v in (*r[:4], t)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def sides(levels, at):
        out = []
        for level in levels[:-1]:
            run, i = level[at // 8 * 8:at // 8 * 8 + 8], at % 8
            out.append(("".join(run[:i]), "".join(run[i + 1:])))
            at //= 8
        return out

    langs = sorted({r[2] for r in rows}, key=lambda l: (l is not None, (l or "").encode()))
    own = {l: sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == l), key=lambda x: x[:3]) for l in langs}
    trees = {l: tree([x[2] for x in own[l]]) for l in langs}
    top = tree([trees[l][-1][0] for l in langs])
    out = []
    for k, l in enumerate(langs):
        for at, (known, _, h, r) in enumerate(own[l]):
            proof = sides(trees[l], at) + sides(top, k)
            node = leaf(r, known and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for a, b in proof:
                node = digest(a + node + b)
            out.append((r[0], h, trees[l][-1][0], top[-1][0], digest("".join(a + b for a, b in proof)), node))
    return sorted(out, key=str)


def spark_manifest(df):
    tampered = F.when((queries.remainder("doc_id", 3) == 0) & F.col("text").isNotNull(), manifest.leaf(manifest.lowered())).otherwise(manifest.leaf())
    found = manifest.manifest(df, tampered).select("doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("proof")), manifest.folded(F.col("other"), F.col("proof")))
    return sorted((tuple(r) for r in found.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at int, word int, leaf string, total int"


def test_manifest_equals_plain_tree(spark):
    rnd = random.Random(3)
    rows = [(i * 3 - 100, "s", rnd.choice(["en", "en", "en", "de", None, "É", ""]), i, rnd.choice(["Ab", "é B", "", None])) for i in range(400)]
    rows += [(2 ** 62 + 7 ** k, "s", "far", 1, "Far") for k in range(22)] + [(-(2 ** 63), "s", "far", 1, "X"), (2 ** 63 - 1, None, "far", None, "Y")]
    rows += [(5, "s", "one", 1, "Alone")]
    assert spark_manifest(spark.createDataFrame([(*r, 1, 2, "l", 3) for r in rows], SCHEMA).repartition(6)) == brute_manifest(rows)


def test_manifest_of_repeated_and_null_ids(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, 7, 7, 7, 8, 63, 64, 70, -1]), "s", rnd.choice(["en", None]), 1, rnd.choice(["A", "B", "C", "d" * 1000, None])) for _ in range(300)]
    rows += [(i, "s", "en", 1, f"T{i}") for i in range(1000, 1100)]
    assert spark_manifest(spark.createDataFrame([(*r, 1, 2, "l", 3) for r in rows], SCHEMA).repartition(4)) == brute_manifest(rows)


def test_manifest_of_one_and_of_none(spark):
    assert spark_manifest(spark.createDataFrame([], SCHEMA)) == []
    rows = [(3, "s", "en", 1, "Only")]
    assert spark_manifest(spark.createDataFrame([(*r, 1, 2, "l", 3) for r in rows], SCHEMA)) == brute_manifest(rows)


def test_manifest_has_no_python_step(spark, odd):
    plan = manifest.manifest(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

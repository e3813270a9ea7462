"""Each operator against brute force, a round trip or held-out accuracy, on odd inputs too."""

import base64
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import (fingerprints, jaccard, katz, language, licences, packing, quality, queries, repeats, tables, text,
                            tokens, vectors)
from tallyframe.llm.wordids import word_ids

from .conftest import sentence

BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(autouse=True)
def small_batches(spark):
    text.set_up(spark)


def word_list(t):
    return WORD.findall((t or "").encode().translate(LOWER))


# helpers

def test_words_equal_the_pattern():
    import pyarrow as pa
    texts = ["a B\x0bc", None, "", " x ", "é y z", "\x1c q"]
    rows, hashes, starts, ends, data, _ = text.words(pa.array(texts), lower=False)
    got = [[] for _ in texts]
    for r, a, b in zip(rows, starts, ends):
        got[r].append(bytes(data[a:b]))
    assert got == [WORD.findall((t or "").encode()) for t in texts]
    assert len(set(hashes.tolist())) == len({w for g in got for w in g})


def test_components_of_long_chains(spark):
    rnd = random.Random(2)
    order = list(range(300))
    rnd.shuffle(order)
    links = list(zip(order[:200], order[1:201])) + [(order[250], order[260])] + [(5, 5)]
    got = {r["id"]: r["component"] for r in tables.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(order[:201]) | {order[250], order[260]} == set(got)
    assert {got[i] for i in order[:201]} == {min(order[:201])}
    assert got[order[250]] == got[order[260]] == min(order[250], order[260])
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_by_loses_nothing(spark):
    rows, wanted = spark.range(1000).selectExpr("id AS k"), spark.createDataFrame([(3,), (999,), (None,)], "k long")
    hit, rest = tables.split_by(rows, "k", wanted)
    assert {3, 999} <= {r["k"] for r in hit.collect()} and hit.count() + rest.count() == 1000 and hit.count() < 10


# 1 language

def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null")
    out = queries.op1_language_id(spark, "/root/testdata/sf0.001").join(docs, "doc_id").where("held_out").toPandas()
    assert len(out) > 10 and (out["lang"] == out["lang_pred"]).mean() >= 0.95


def test_language_odd_rows(odd, none):
    model = language.fit(odd)
    out = {(r["doc_id"], r["text"]): r for r in language.predict(odd, model).collect()}
    assert sum(1 for _ in out) == 16 and language.predict(odd, model).count() == odd.count()
    assert {k[0] for k, r in out.items() if r["lang_pred"] == "und"} == {1, 2, 3, 15}
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[(7, odd.where("doc_id = 7").first()["text"])]["key"] == "k"
    untrained = language.fit(none)
    assert {r["lang_pred"] for r in language.predict(odd, untrained).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


# 2 byte-level BPE

@pytest.fixture(scope="module")
def reference_bpe():
    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_bpe_equals_tiktoken(reference_bpe, texts):
    coder = tokens.byte_pairs(BYTES, public_tokenizers.PATTERN)
    ids = coder.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [reference_bpe.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]


def test_bpe_long_words(reference_bpe):
    rnd = random.Random(3)
    texts = ["a" * 3000, "ab" * 700 + "c", "".join(rnd.choice("0123456789abcdef") for _ in range(700)), "$$$***" * 200, "日本" * 300]
    ids = tokens.byte_pairs(BYTES, public_tokenizers.PATTERN).encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [reference_bpe.encode_ordinary(t) for t in texts]


def test_bpe_rows(odd, none, reference_bpe):
    rows = tokens.encode(odd, BYTES, public_tokenizers.PATTERN, decode=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference_bpe.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["key"] == "k"
    assert tokens.encode(none, BYTES, public_tokenizers.PATTERN).count() == 0


# 3 repeated passages

def brute_repeats(rows):
    """{(doc_id, text): words to go}, {..: repeated words that stay}, by all windows of LENGTH words."""
    at = {}
    docs = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1]})
    for d in docs:
        w = word_list(d[2])
        for i in range(len(w) - repeats.LENGTH + 1):
            at.setdefault(tuple(w[i:i + repeats.LENGTH]), []).append((d, i))
    gone, any_ = {}, {}
    for places in at.values():
        if len(places) > 1:
            first = min(places)
            for d, i in places:
                for to in [any_] if (d, i) == first else [any_, gone]:
                    to.setdefault(d, set()).update(range(i, i + repeats.LENGTH))
    return gone, {d: w - gone.get(d, set()) for d, w in any_.items() if w - gone.get(d, set())}


def as_words(rows):
    out = {True: {}, False: {}}
    for r in rows:
        out[r["removed"]].setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out[True], out[False]


def by_id(found):
    out = {}
    for (has, number, _), words in found.items():
        out.setdefault(number if has else None, set()).update(words)
    return out


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_repeats_equal_all_windows(spark, crowd):
    rnd = random.Random(11)
    parts = [sentence(rnd, n) for n in (20, 35, 45, 50, 52, 64, 120)]
    rows = []
    for i in range(90):
        chosen = [rnd.choice(parts) if rnd.random() < 0.6 else sentence(rnd, rnd.randint(1, 60)) for _ in range(rnd.randint(1, 6))]
        rows.append((i, " ".join(chosen)))
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, "ha " * 130), (301, "ha " * 61)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.spans(docs, crowd=crowd).withColumnsRenamed({"doc": "doc_id", "start": "start_word", "end": "end_word"}).collect()
    gone, first = as_words(found)
    want_gone, want_first = brute_repeats(rows)
    assert gone == by_id(want_gone)
    assert first == by_id(want_first)


def test_repeats_odd_rows(odd, none, odd_rows):
    gone, first = as_words(repeats.passages(odd).collect())
    want_gone, want_first = brute_repeats(odd_rows)
    assert gone == by_id(want_gone) and first == by_id(want_first)
    left = repeats.remove(odd, repeats.spans(odd))
    assert left.count() == odd.count() and left.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[9] == "" and texts[1] is None and texts[5].split() == odd.where("doc_id = 5").first()["text"].split()
    assert repeats.passages(none).count() == 0 and repeats.remove(none, repeats.spans(none)).count() == 0


def test_repeats_of_many_texts_without_a_number(spark):
    rnd = random.Random(21)
    passage = sentence(rnd, 70)
    own = [" ".join(f"u{i}x{j}" for j in range(3 + i % 40)) for i in range(3000)]
    docs = spark.createDataFrame([(None, f"{t} {passage}") for t in own], "doc_id long, text string")
    left = [r["text"] for r in repeats.remove(docs, repeats.spans(docs)).collect()]
    whole = [t for t in left if t.endswith(passage)]
    assert len(whole) == 1
    assert sorted([t.removesuffix(" " + passage) for t in left]) == sorted(own)


def test_cut_keeps_the_rest():
    assert repeats.cut(" a b  c\nd e ", [1], [3]) == "a\nd e"
    assert repeats.cut("a b", [0], [2]) == ""


# 4 quality

def test_quality_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    out = queries.op4_quality(spark, path).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 50 and (out["predicted"] == out["quality"]).mean() >= 0.95


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 1), (12, 0), (11, 0), (15, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(quality.labelled_rows(odd.select("doc_id", "text"), labels))
    rows = quality.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "")}) == 1 and rows[0]["key"] == "k"
    for few, share in ((labels.where("quality = 1"), 1.0), (labels.limit(0), 0.5)):
        model = quality.fit(quality.labelled_rows(odd.select("doc_id", "text"), few))
        assert {r["score"] for r in quality.predict(odd, model).collect()} == {share}
    assert quality.predict(none, model).count() == 0


# 5 licences

def test_licences_and_inheritance(spark):
    mit = licences.TEMPLATES["MIT"][3]
    rows = [("r/LICENSE", mit + ".\n"), ("r/a/x.txt", "some words of prose\nthat go on"), ("r/a/b/y.txt", "prose"),
            ("r/a/b/LICENSE", "Licensed under the Apache License, Version 2.0.\n"), ("r/a/b/c/z.txt", "more prose here\n"),
            ("r/a/n.txt", "prose and\nLicensed under CC BY-NC 4.0.\nprose again and more"), ("q/x.txt", "nothing to see"),
            ("q/long.txt", "word " * 500 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "word " * 500),
            (None, "prose"), ("r/empty", ""), ("r/null", None), ("r/null", None)]
    out = licences.scan(spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit(3)))
    got = [(r["path"], r["license"]) for r in out.collect()]
    assert len(got) == len(rows)
    assert dict(got) == {"r/LICENSE": "MIT", "r/a/x.txt": "MIT", "r/a/b/y.txt": "Apache-2.0", "r/a/b/LICENSE": "Apache-2.0",
                         "r/a/b/c/z.txt": "Apache-2.0", "r/a/n.txt": "CC-BY-NC-4.0", "q/x.txt": None, "q/long.txt": "GPL-3.0", None: None,
                         "r/empty": "MIT", "r/null": "MIT"}
    assert licences.scan(out.limit(0).select("path", "text")).count() == 0


def test_whole_licences_rule_their_folders(spark):
    docs = [(f"d/{r['doc_id']}.txt", r["text"], None) for r in
            spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    rows = []
    # an own line first, other line ends, and a few words gone: a copy as it stands in a folder
    for name, whole in licences.whole_texts().items():
        words = whole.split(" ")
        copy = " ".join(w for i, w in enumerate(words) if i % 50 != 7)
        rows += [(f"{name}/COPYING", "Copyright (c) 2019 Jane Roe and others\n\n" + copy, name), (f"{name}/src/a/b.txt", "some prose\n", name),
                 (f"{name}-x/TERMS", whole.replace("\n", " "), name), (f"{name}-x/c", None, name)]
    rows += [("own/LICENSE", "All rights reserved. You have bought a ticket for one ride on the ferry; keep it until you land.", None),
             ("own/a", "prose", None)]
    found = licences.scan(spark.createDataFrame([(p, t) for p, t, _ in rows + docs], "path string, text string")).collect()
    got = {r["path"]: r for r in found}
    assert {p: got[p]["file_license"] or got[p]["inherited_license"] for p, *_ in rows} == {p: want for p, _, want in rows}
    assert all(got[p]["file_license"] is None for p, *_ in docs)


def test_licence_lines_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = {r["doc_id"]: {n for line, n in lines.items() if line in r["text"]} for r in docs.collect()}
    got = {r["doc_id"]: r["notice_license"] for r in queries.op5_licence_scan(spark, "/root/testdata/sf0.01").collect()}
    assert all(got[k] in v if v else got[k] is None for k, v in want.items())


def test_contraction_in_several_calls_gives_the_same_ids(monkeypatch):
    words = ["語" * n + w for n in (1, 5, 20) for w in ("a", "tion", " wörter", "ぁぃ")]
    want = tokens.BytePairs(BYTES, public_tokenizers.PATTERN).encode(words)
    calls = []
    plain = tokens.BytePairs._contract
    monkeypatch.setattr(tokens, "KEPT_ROWS", 500)
    monkeypatch.setattr(tokens.BytePairs, "_contract", lambda self, w: (calls.append(len(w)), plain(self, w))[1])
    assert tokens.BytePairs(BYTES, public_tokenizers.PATTERN).encode(words) == want
    assert len(calls) > 3


# 6 Katz

def brute_katz(rows, order):
    end, start = b"\0end", b"\0start"
    seqs = [(r[0], r[2], [*word_list(r[1]), end]) for r in rows]
    uni, grams = {}, [{} for _ in range(order + 1)]  # grams[k]: context of k - 1 words -> next word -> count

    def contexts(seq, i, k):
        return tuple([start, *seq][i + 2 - k:i + 1]) if i + 2 >= k else None

    for _, held, seq in seqs:
        if not held:
            for i, w in enumerate(seq):
                uni[w] = uni.get(w, 0) + 1
                for k in range(2, order + 1):
                    if (h := contexts(seq, i, k)) is not None:
                        row = grams[k].setdefault(h, {})
                        row[w] = row.get(w, 0) + 1
    total = sum(uni.values())
    hist = lambda counts: tuple(np.array(x) for x in zip(*sorted(pd.Series(list(counts)).value_counts().items())))
    if not total:
        return None
    d1 = katz.Discount.fit(*hist(uni.values()))
    more = [None, None, *(katz.Discount.fit(*hist(c for row in grams[k].values() for c in row.values())) for k in range(2, order + 1))]
    unknown = 1 - sum(float(d1(c)) for c in uni.values()) / total

    def p(h, w):
        if not h:
            return float(d1(uni[w])) / total if w in uni else unknown
        k = len(h) + 1
        if h not in grams[k]:
            return p(h[1:], w)
        row = grams[k][h]
        c = sum(row.values())
        if w in row:
            return float(more[k](row[w])) / c
        left = 1 - sum(float(more[k](x)) for x in row.values()) / c
        return left / (1 - sum(p(h[1:], x) for x in row)) * p(h[1:], w)

    for k in range(2, order + 1):
        for h in [(b"never seen",) * (k - 1), *list(grams[k])[:5]]:
            assert abs(sum(p(h, w) for w in uni) + p(h, b"never seen") - 1) < 1e-9
    v_size = len(uni)
    return [(i, len(seq), sum(w in uni for w in seq), total, sum(np.log10((uni.get(w, 0) + 1) / (total + v_size + 1)) for w in seq),
             sum(np.log10(p(next(h for k in range(order, 1, -1) if (h := contexts(seq, at, k)) is not None), w)) for at, w in enumerate(seq)))
            for i, _, seq in seqs]


@pytest.mark.parametrize("order, sizes", [(2, {}), (2, {"block": 40, "bucket": 30, "split": 5}), (3, {}),
                                          (3, {"block": 40, "bucket": 30, "split": 3}), (4, {"block": 100, "split": 2})])
def test_katz_equals_brute_force(spark, order, sizes):
    rnd = random.Random(4)
    rows = [(i, " ".join(["the"] * rnd.randint(0, 3) + [sentence(rnd, rnd.randint(0, 20), 15), "The end"]), i % 7 == 2) for i in range(60)]
    rows += [(60, None, False), (61, "", True), (62, "unknown words only", True), (62, "unknown words only", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(2)
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
                 for r in katz.score(docs, order=order, **sizes).collect())
    want = sorted(brute_katz(rows, order))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


def test_katz_odd_rows(odd, none):
    out = katz.score(odd.withColumn("held_out", F.col("doc_id") == 10)).collect()
    assert len(out) == odd.count() and all(np.isfinite(r["score"]) for r in out)
    assert {r["score"] for r in katz.score(odd.withColumn("held_out", F.lit(True))).collect()} == {0.0}
    assert katz.score(none.withColumn("held_out", F.lit(False))).count() == 0


# 7 packing

@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=50), max_size=6))
def test_word_ids_equal_the_tokenizer(texts):
    import pyarrow as pa
    plain = Tokenizer.from_file(WORDS)
    flat, at = word_ids(WORDS).encode(pa.array([*texts, None], pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def check_packed(rows, docs, window=packing.WINDOW):
    plain = Tokenizer.from_file(WORDS)
    want = sorted([*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for _, t in docs)
    pieces, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    single = {k: v for k, v in pieces.items() if sum(1 for d in docs if d[0] == k[0]) == 1}
    got = []
    for (_, total), parts in single.items():
        ids = []
        for start, own in sorted(parts):
            assert start == len(ids)
            ids += own
        assert len(ids) == total
        got.append(ids)
    assert all(ids in want for ids in got)
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    return sequences


def test_packing_odd_rows(odd, none, odd_rows):
    check_packed(packing.pack(odd, WORDS).collect(), [(r[0], r[1]) for r in odd_rows])
    assert packing.pack(none, WORDS).count() == 0


def test_packing_prefers_neighbours(spark):
    rnd = random.Random(8)
    topics = [[f"t{k}w{i}" for i in range(60)] for k in range(4)]
    docs = [(i, " ".join(rnd.choice(topics[i % 4]) for _ in range(150))) for i in range(40)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), WORDS).collect()
    check_packed(rows, docs)
    together = {}
    for r in rows:
        together.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 4)
    assert np.mean([len(x) for x in list(together.values())[:4]]) < 2.5


def test_packing_finds_neighbours_anywhere(spark):
    rnd = random.Random(9)
    topics = [["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(40)] for _ in range(40)]
    docs = [(i, " ".join(rnd.choice(topics[i % 40]) for _ in range(150))) for i in range(1600)] + [(None, "same words " * 90)] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = []
    for rows in (packing.pack(frame, WORDS, shard=200), packing.pack(frame.orderBy(F.desc("doc_id")).coalesce(2), WORDS, shard=200)):
        rows = rows.collect()
        check_packed(rows, docs)
        found.append(sorted((r["sequence_id"], r["offset"], r["doc_id"] or -1, r["start"], r["length"]) for r in rows))
    # neither order nor splits of the input matter
    assert found[0] == found[1]
    together = {}
    for r in found[0]:
        together.setdefault(r[0], set()).add(r[2] % 40)
    # three documents or more fill a window: by chance nearly all would be of different topics
    assert np.mean([len(x) for x in together.values()]) < 2.2


# 8 embeddings

def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in base[i % 60] + rng.normal(size=16) * (0.15 if i >= 60 else 0)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16),
             (504, [None] * 16), (505, [1.0, 2.0]), (506, [1.0, 2.0]), (507, [1e-300] * 16), (508, [1e300] * 16), (None, rows[7][1])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit("x")).withColumn("home", F.lit(1))
    got = vectors.near_duplicates(data, reach=0.436, cell=40, block=16)
    assert got.count() == len(rows)
    got = {r["vec_id"]: r for r in got.where("vec_id is not null").collect()}
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None for x in v) and np.isfinite(v).all() and any(v)]
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in usable}
    near = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in unit}
    for i, _ in rows:
        if i is None:
            continue
        reach, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, ())), min(reach), i == min(reach))
    assert vectors.near_duplicates(data.limit(0)).count() == 0


def test_vectors_recall_with_cells(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 64))
    v = np.vstack([base, base + rng.normal(size=base.shape) * 0.3])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=60)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = int((unit @ unit.T >= 0.9).sum()) - len(v)
    assert links > 200 and found.agg(F.sum("n_links")).first()[0] >= 0.95 * links


# 9 Jaccard join

def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = word_list(t)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows) if d is not None)


def near_copies(rnd, n):
    rows, bases = [], [sentence(rnd, k).split() for k in (5, 9, 30, 90, 200)]
    for i in range(n):
        w = list(rnd.choice(bases)) if rnd.random() < 0.7 else sentence(rnd, rnd.randint(0, 40)).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            if w:
                w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("many", [jaccard.MANY, 2])
def test_jaccard_equals_all_pairs(spark, many):
    rows = near_copies(random.Random(many), 260)
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), many=many, block=16)
    assert sorted(map(tuple, found.collect())) == brute_jaccard(rows)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.floats(0, 1))
def test_prefixes_of_linked_sets_share_a_signature(seed, share):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 300))
    x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    keep = rng.random(len(x)) > rng.random() * 0.25
    y = np.unique(np.concatenate([x[keep], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 5)), dtype=np.uint64)]))
    both = len(np.intersect1d(x, y))
    frequent = rng.random(1 << jaccard.SKETCH_BITS) < share
    classes = jaccard._size_classes(80)
    if both and 100 * both >= 80 * (len(x) + len(y) - both):
        a, b = (set(jaccard.signatures(s, frequent, 80, classes).tolist()) - {0} for s in (x, y))
        assert a & b


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 1500))
def test_parities_keep_every_link(seed, n):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * 0.25],
                                  rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 4)), dtype=np.uint64)]))
    both = len(np.intersect1d(x, y))
    if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
        assert jaccard.may_link(jaccard.parity(x), len(x), jaccard.parity(y), len(y), 80)
        assert jaccard.may_link(jaccard.parity(y), len(y), jaccard.parity(x), len(x), 80)


def test_near_forest_makes_the_components_of_all_pairs():
    rng = np.random.default_rng(6)
    bases = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (3, 40, 250, 260, 500, 520, 2100)]
    sets = []
    for i in range(120):
        base = bases[i % len(bases)]
        sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0.0, 0.02, 0.1, 0.4])],
                                              rng.integers(0, 1 << 63, 1 + len(base) // 30, dtype=np.uint64)])))
    n, parities = np.array([len(s) for s in sets]), [jaccard.parity(s) for s in sets]
    for blocks, known in ((1, 0), (2, 0), (2, 30)):
        own = np.arange(len(sets)) % blocks
        root = np.where(np.arange(len(sets)) < known, 0, np.arange(len(sets)))
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (blocks == 1 or own[i] != own[j])
                 and 80 * max(n[i], n[j]) <= 100 * min(n[i], n[j]) and jaccard.may_link(parities[i], n[i], parities[j], n[j], 80)]
        i, j = jaccard.near_forest(n, parities, own, root, 80)
        assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} <= {tuple(sorted(p)) for p in pairs} and len(i) < len(sets)
        known_pairs = [(int(k), 0) for k in range(known)]
        both = [jaccard._forest(len(sets), *np.array(p + known_pairs).T) for p in (pairs, list(zip(i, j)))]
        assert (both[0] == both[1]).all()


def test_jaccard_of_large_crowds_and_clusters(spark):
    rows = near_copies(random.Random(3), 260)
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), many=2, block=8, crowd=4, hubs=2)
    assert sorted(map(tuple, found.collect())) == brute_jaccard(rows)


def test_texts_that_share_a_common_passage_are_not_compared_in_full(spark, monkeypatch):
    rnd, rows, counts = random.Random(12), [], {}
    for i in range(300):
        rows.append((i, sentence(rnd, 30, 10**6) + " words that all of them have " + sentence(rnd, 30, 10**6)))
    rows += [(300 + i, t + " more") for i, t in rows[:5]]
    kept = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: counts.setdefault(name, kept(df, name)))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), many=20)
    assert sorted(map(tuple, found.collect())) == brute_jaccard(rows)
    assert counts["wanted"].count() == 10


def test_signatures_of_equal_sets_alone_are_left_out(spark, monkeypatch):
    rnd, counts = random.Random(13), {}
    texts = [sentence(rnd, 40, 10**6) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(None, texts[0] + " more"), (200, texts[1] + " more")]
    kept = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: counts.setdefault(name, kept(df, name)))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect() if r["doc_id"] is not None) == brute_jaccard(rows)
    # of the sets, the two of texts[1] share signatures, and that of texts[0] with one that has no number
    assert counts["hits"].select("key").distinct().count() == 3 and counts["hits"].where("sets > 2").count() == 0


def test_sets_of_one_component_go_to_few_blocks(spark):
    keys = spark.range(400).select(F.lit(1).alias("g"), F.col("id").alias("key"), F.lit(400).cast("long").alias("sets"))
    blocks = 400 // 8
    assert 400 <= jaccard.dealt(keys, "sets", 8, 2).count() < 400 + 8 * blocks
    # all of one component but a few: the others go to all blocks, the rest to one each
    of = lambda k: 0 if k >= 5 else k
    labels = spark.createDataFrame([(k, of(k)) for k in range(400)], "id long, component long")
    tasks = jaccard.apart(keys, "g", labels, 8).collect()
    assert len(tasks) <= 400 + 5 * (blocks + 1)
    held = {}
    for r in tasks:
        held.setdefault((r["left"], r["right"]), []).append((r["key"], r["own"]))
    met = {(a, b) for at, x in held.items() for a, p in x for b, q in x if a < b and (p != q or at[0] == at[1])}
    assert {(a, b) for a in range(400) for b in range(a + 1, 400) if of(a) != of(b)} <= met
    assert jaccard.apart(keys, "g", labels.withColumn("component", F.lit(0).cast("long")), 8).count() == 0


def test_jaccard_odd_rows(odd, none, odd_rows):
    found = jaccard.join(odd).collect()
    assert len(found) == odd.count()
    assert sorted(tuple(r) for r in found if r["doc_id"] is not None) == brute_jaccard([(r[0], r[1]) for r in odd_rows])
    assert jaccard.join(none).count() == 0


# 10 fingerprints

def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=64).map(lambda x: bytes(65 + c % 6 for c in x)),
                          st.binary(max_size=64).map(lambda x: bytes(65 + c % 6 for c in x))), max_size=5))
def test_edit_distances(pairs):
    assert fingerprints.edit_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain_distance(a, b) for a, b in pairs]


def test_fingerprints_of_neighbours(spark, odd, none, odd_rows):
    out = fingerprints.fingerprint(odd, ranges=4).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = {}
    for i, r in enumerate(order):
        own, following = texts[i], texts[(i + 1) % len(texts)]
        n = len(own) // 4
        want.setdefault(r[0], []).append((len(own), own[:len(own) - n] + following[:n]))
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited"]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    prints = {}
    for r in out:
        prints.setdefault(r["doc_id"], r)
    assert prints[5]["fingerprint"] == prints[7]["fingerprint"] and prints[5]["near_next"] > 0.8
    assert prints[10]["near_edited"] > 0.6 and prints[10]["near_next"] == 0
    assert fingerprints.fingerprint(none).count() == 0
    one = fingerprints.fingerprint(odd.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_fingerprints_do_not_depend_on_batches():
    rnd = random.Random(1)
    texts = [sentence(rnd, rnd.randint(0, 400)) for _ in range(40)] + ["", "a", "a" * 5000]
    assert fingerprints.fingerprints(texts) == [fingerprints.fingerprints([t])[0] for t in texts]


def test_held_out_rows(spark):
    docs = spark.range(40).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["m"] for r in docs.select("doc_id", queries.remainder("doc_id", 5).alias("m")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(40)}

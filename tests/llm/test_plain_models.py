"""Operators held against plain loops over a few rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from tallyframe.llm import fingerprints, language, licences, text

from .conftest import sentence

LETTERS = {"en": "etaoinshrdlu", "pl": "ąęłńóśźżwzky", "el": "αβγδεζηθικλμ"}


@pytest.fixture(autouse=True)
def small_batches(spark):
    text.set_up(spark)


def written_in(rnd, lang, words):
    return " ".join("".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(words))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")


# language

def plain_bucket(gram, n):
    h = n
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
        h ^= h >> 15
    return h >> (32 - language.BUCKET_BITS)


def plain_grams(t):
    """Buckets by order of the n-grams of a text between blanks; other characters are one blank."""
    blanked = " " + "".join(c if c.isalpha() else " " for c in (t or "").lower())
    chars = " " + " ".join(blanked.split()) + " "
    return [[plain_bucket(chars[i:i + n], n) for i in range(len(chars) - n + 1)] for n in language.ORDERS]


def test_language_equals_plain_naive_bayes(spark):
    rnd = random.Random(4)
    rows = [(i, written_in(rnd, "en" if i % 3 else "pl", rnd.randint(3, 12)), "en" if i % 3 else "pl") for i in range(60)]
    model = language.fit(frame(spark, rows).select("doc_id", "text", "lang"))
    asked = [written_in(rnd, "en", 1)[:2] + written_in(rnd, "pl", 1)[:2] for _ in range(30)]
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        for k, found in enumerate(plain_grams(t)):
            counts[lang, k].update(found)
    size = 1 << language.BUCKET_BITS
    langs, score, _ = language.score_texts(model, asked)
    for t, lang, s in zip(asked, langs, score):
        total = {x: math.log(sum(r[2] == x for r in rows) / len(rows)) for x in ("en", "pl")}
        for x in total:
            for k, found in enumerate(plain_grams(t)):
                n = sum(counts[x, k].values())
                total[x] += sum(math.log((counts[x, k][b] + 0.5) / (n + 0.5 * size)) for b in found)
        top = max(total, key=total.get)
        odds = 1 / sum(math.exp(v - total[top]) for v in total.values())
        assert lang == top and s == pytest.approx(odds, abs=1e-4)


def test_language_scores_do_not_depend_on_the_batch(spark):
    rnd = random.Random(14)
    rows = [(i, written_in(rnd, "en" if i % 3 else "pl", 6), "en" if i % 3 else "pl") for i in range(60)]
    model = language.fit(frame(spark, rows).select("doc_id", "text", "lang"))
    asked = [written_in(rnd, "en", 1)[:3] + written_in(rnd, "pl", 1)[:3] for _ in range(30)] + ["", None, "é", "1"]
    _, together, _ = language.score_texts(model, asked)
    assert together.tolist() == [language.score_texts(model, [t])[1][0] for t in asked]
    assert language.score_texts(model, [])[0] == []


def test_rare_languages_are_learned(spark):
    rnd = random.Random(5)
    rows = [(i, written_in(rnd, "en", 20), "en") for i in range(2000)] + [(9000 + i, written_in(rnd, "pl", 20), "pl") for i in range(4)]
    docs = frame(spark, rows)
    model = language.fit(docs.select("doc_id", "text", "lang"), max_rows=100)
    asked = [(i, written_in(rnd, "pl", 20), None) for i in range(20)]
    assert {r["lang_pred"] for r in language.predict(frame(spark, asked), model).collect()} == {"pl"}


def test_quota():
    assert language._quota([4, 3000], 100) == 96
    assert language._quota([50, 50], 100) == float("inf")
    assert language._quota([], 100) == float("inf")
    assert language._quota([10, 1000, 1000], 110) == 50


def test_many_languages_share_the_matrix(spark):
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} word{'klmnopqrst'[i // 10 % 10]}", f"x{i:04}") for i in range(700)]
    model = language.fit(frame(spark, rows).select("doc_id", "text", "lang"))
    assert len(model.languages) == 700 and model.log_prob.nbytes <= language.MAX_MODEL_BYTES
    assert model.bits < language.BUCKET_BITS


def test_texts_in_other_languages_are_rejected(spark):
    rnd = random.Random(6)
    rows = [(i, written_in(rnd, "en" if i % 2 else "pl", rnd.randint(5, 80)), "en" if i % 2 else "pl") for i in range(800)]
    other = [(5000 + i, written_in(rnd, "el", 60), None) for i in range(20)]
    short = [(6000 + i, written_in(rnd, "en", 1), None) for i in range(20)]
    docs = frame(spark, rows + other + short + [(7000, None, "en"), (7001, "12 --", "en"), (7002, "", None)])
    kept = {r["doc_id"] for r in P.keep_language(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows + short}


# fingerprints

def plain_signature(data, e):
    chunks, start = [], 0
    for i in range(len(data)):
        h = 0
        for b in ([None] * fingerprints.WINDOW + [*data[:i + 1]])[-fingerprints.WINDOW:]:
            h = (h * 0x01000193 + (0 if b is None else b + 1)) & 0xFFFFFFFF
        h ^= h >> 16
        h = h * 0x7FEB352D & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x846CA68B & 0xFFFFFFFF
        h ^= h >> 16
        if h & ((1 << e) - 1) == 0 or i == len(data) - 1:
            chunks.append(data[start:i + 1])
            start = i + 1
    return chunks


def test_signatures_equal_plain_chunks():
    rnd = random.Random(7)
    texts = [sentence(rnd, rnd.randint(1, 60)) for _ in range(12)] + ["", "a", "é" * 40, "ab" * 300]
    prints = fingerprints.fingerprints(texts)
    letters = {}
    for t, (e, one, two) in zip(texts, prints):
        data = t.encode()
        assert e == max(fingerprints.MIN_E, math.ceil(math.log2(max(len(data), 1) / fingerprints.CHUNKS)))
        for signature, exponent in ((one, e), (two, e + 1)):
            chunks = plain_signature(data, exponent)
            if len(chunks) > fingerprints.SIGNATURE:
                chunks = [*chunks[:fingerprints.SIGNATURE - 1], b"".join(chunks[fingerprints.SIGNATURE - 1:])]
            assert len(signature) == len(chunks)
            # equal chunks have equal letters wherever they stand
            for chunk, letter in zip(chunks, signature):
                assert letters.setdefault(chunk, letter) == letter
    assert len(set(letters.values())) > 30


def test_fingerprints_spread_a_hot_number(spark):
    rnd = random.Random(8)
    rows = [(None, sentence(rnd, 8)) for _ in range(400)] + [(i, sentence(rnd, 8)) for i in range(100)] + [(50, sentence(rnd, 8)) for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fingerprints.fingerprint(docs, ranges=12).collect()
    # the rows form one ring: each text is followed by another, and each follows one
    edited = Counter(r["edited"] for r in out)
    assert len(out) == 700 and sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == sorted(i for i, _ in rows if i is not None)
    one = Counter(r["edited"] for r in fingerprints.fingerprint(docs, ranges=1).collect())
    assert edited == one


# licences

HEADERS = {
    "Apache-2.0": ["/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n */",
                   "// SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files (the \"Software\")",
            "// SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
                "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\n"
                "as published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.",
                "/* SPDX-License-Identifier: GPL-2.0-or-later */"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public\nLicense as "
                 "published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or any later"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": ["// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"],
    "EPL-2.0": ["This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0 which is available at"],
    None: ["// SPDX-License-Identifier: Beerware", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 7 of the License",
           "He was granted a driving license under the old law, released in June."],
}


def test_headers_of_source_files(spark):
    docs = [(f"d/{r['doc_id']}.txt", r["text"], None) for r in
            spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect() if "icense" not in r["text"] and "CC" not in r["text"]]
    rnd = random.Random(11)
    rows = []
    for name, texts in HEADERS.items():
        for i, t in enumerate(texts):
            before, after = sentence(rnd, 70), sentence(rnd, 70)
            rows += [(f"a/{name}{i}", t, name), (f"b/{name}{i}", f"#!/bin/sh\n{t}\n\n{after}", name),
                     (f"c/{name}{i}", f"{before} {t} {after}".replace("\n", " "), name), (f"e/{name}{i}", f"{before}\r\n{t}\r\n", name)]
    got = {r["path"]: r for r in licences.scan(spark.createDataFrame([r[:2] for r in rows + docs], "path string, text string")).collect()}
    assert {p: got[p]["notice_license"] for p, _, _ in rows} == {p: want for p, _, want in rows}
    assert all(got[p]["notice_license"] is None for p, *_ in docs)


def plain_words(t):
    return "".join(" " if c in ".,;:()\"'*#/" else c for c in t.lower()).split()


def test_licence_scores_equal_plain_cosines(spark):
    rnd = random.Random(12)
    texts = [f"{sentence(rnd, 6)}\n{notice}\n{sentence(rnd, 9)}" if i % 2 else f"{sentence(rnd, 80)} {notice} {sentence(rnd, 80)}"
             for i, notice in enumerate(t for ts in licences.TEMPLATES.values() for t in ts)] + ["", sentence(rnd, 30)]
    notices = [(n, plain_words(t)) for n, t in zip(licences._names, licences._notices)]
    known = {w for _, t in notices for w in t}
    df = Counter(w for t in texts for w in set(plain_words(t)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1
    strange = math.log(1 + len(texts)) + 1

    def vector(words):
        return {w: (1 + math.log(k)) * idf(w) for w, k in Counter(w for w in words if w in known).items()}, sum(w not in known for w in words)

    of_notices = [(n, vector(t)[0]) for n, t in notices]

    def nearest(words):
        v, others = vector(words)
        norm = math.sqrt(sum(x * x for x in v.values()) + others * strange ** 2)
        found = []
        for n, t in of_notices:
            dot = sum(x * v.get(w, 0) for w, x in t.items())
            found.append((dot / norm / math.sqrt(sum(x * x for x in t.values())) if norm else 0, n, t))
        score, name, t = max(found, key=lambda x: x[0])
        rival = max((x for x in found if x[1] != name), key=lambda x: x[0])[2]
        own = {w: idf(w) ** 2 for w in t if w not in rival}
        if score >= licences.NOTICE and sum(x for w, x in own.items() if w in v) < licences.OWN * sum(own.values()):
            return 0.0, None
        return score, name

    got = licences.scan(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")).collect()
    for r in got:
        words = plain_words(r["text"])
        units = [u for u in map(plain_words, r["text"].split("\n")) if u and len(u) <= licences.LINE_WORDS]
        for _, t in notices:
            rare = max(t, key=idf)
            units += [words[max(0, i - t.index(rare)):i - t.index(rare) + len(t)] for i, w in enumerate(words) if w == rare]
        score, name = max(map(nearest, units), key=lambda x: x[0], default=(0.0, None))
        assert r["notice_score"] == pytest.approx(min(score, 1.0), abs=1e-9)
        assert r["notice_license"] == (name if score >= licences.NOTICE else None)

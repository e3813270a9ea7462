"""Licence scans: TF-IDF cosine to templates, and inheritance from the nearest directory.

Units of a file are sparse vectors over words: 1 + log of the count, times the inverse document
frequency over all files. Its cosine to each template is taken, and the best over a threshold
names the licence. Lines, and windows in the text of each notice's length around its rarest word
(a notice may wrap over lines or stand inside a long one), are compared to notices over the words
of the notices. A unit names a licence only if it has the words that tell its notice from the nearest
notice of another licence (OWN of their weight), so an unknown version or sibling names none. Whole files are
compared to notices and to the licences' whole texts (folder `licence_texts`) over the words of both. A
licence file (of a usual name and a cosine over NAMED, or any over WHOLE) rules its
directory and all below; a file without a notice of its own takes
the licence of its nearest ancestor directory that has one, found by joins on path.

Defined cases: null, empty and blank texts match nothing but can inherit; a null path has no
directory; of several licence files in a directory the one of the smallest path rules; equal
rows are files of their own; notice_score is that of the best unit, those over the threshold that
name none left out. Extra columns
pass through; the result's columns replace those of the same names.
"""

from __future__ import annotations

from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

NOTICE, WHOLE, NAMED = 0.6, 0.8, 0.35
NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"  # names of licence files
OWN = 0.5  # share of the weight of a notice's own words that a unit needs
LINE_WORDS = 64  # a longer line is far from every notice as a whole; its windows are compared
BLOCK = 16_384  # units compared at once
# notices and opening sentences of public licences (fixed values)
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
                "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
                "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
                "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                 "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
                 "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "LGPL-2.0": ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
                 "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
                 "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD License.",
                     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": ["Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "EPL-2.0": ["Licensed under the Eclipse Public License, Version 2.0.",
                "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "Mozilla Public License Version 2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_MARKS = bytes(".,;:()\"'*#/", "ascii")
# a name as it stands in a tag line; the GNU licences are followed by -only or -or-later
_TAGS = [f"SPDX-License-Identifier: {n}{x}" for n in TEMPLATES for x in (["", "-only", "-or-later"] if "GPL" in n else [""])]
_tags_of = lambda n: [t for t in _TAGS if t.split(": ")[1].removesuffix("-only").removesuffix("-or-later") == n]
_names = [n for n, texts in TEMPLATES.items() for _ in [*texts, *_tags_of(n)]]
_notices = [t for n, texts in TEMPLATES.items() for t in [*texts, *_tags_of(n)]]
_licence_of = np.array([list(TEMPLATES).index(n) for n in _names])


def _terms(data: np.ndarray) -> np.ndarray:
    """Lower case, and marks at words as blanks."""
    table = X.LOWER.copy()
    table[list(_MARKS)] = 32
    return table[data]


def _hashes(column: pa.Array):
    data, offsets = X.byte_view(column)
    clean = _terms(data)
    starts, ends, rows = X.word_spans(clean, offsets)
    return rows, X.hash_spans(clean, starts, ends), starts, data, offsets


def whole_texts() -> dict[str, str]:
    """The whole texts of public licences, by name."""
    found = resources.files(__package__) / "licence_texts"
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(found.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def _vocabulary(texts: list[str]) -> np.ndarray:
    _, hashes, *_ = _hashes(pa.array(texts))
    return np.unique(hashes)


def _lookup(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each word in the vocabulary, or -1."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def _vectors(texts: list[str], vocabulary: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """One row of length 1 for each template."""
    rows, hashes, *_ = _hashes(pa.array(texts))
    found = np.zeros((len(texts), len(idf)))
    np.add.at(found, (rows, _lookup(vocabulary, hashes)), 1.0)
    found = np.where(found > 0, 1 + np.log(np.maximum(found, 1)), 0) * idf
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _cosines(unit: np.ndarray, term: np.ndarray, n: int, idf: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Cosines of n units, given by (unit, term) entries, to all templates; the last weight
    of idf is that of every word outside the vocabulary, each counted as one of its own."""
    known = term >= 0
    key, count = np.unique(unit[known] * len(idf) + term[known], return_counts=True)
    of, term = key // len(idf), key % len(idf)
    weight = (1 + np.log(count)) * idf[term]
    norm = np.bincount(of, weight ** 2, n) + np.bincount(unit[~known], minlength=n) * idf[-1] ** 2
    dot = np.zeros((n, len(templates)))
    if len(of):
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        dot[of[first]] = np.add.reduceat(weight[:, None] * templates.T[term], first, axis=0)
    return dot / np.sqrt(np.maximum(norm, 1e-12))[:, None]


def _anchors(vocabulary: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """For each notice its rarest word (place in the vocabulary), where it stands in it, and its
    length in words; distinct rows."""
    rows, hashes, *_ = _hashes(pa.array(_notices))
    term = _lookup(vocabulary, hashes)
    at = X.row_starts(rows, len(_notices))
    own = [(int(term[a + k]), k, int(b - a)) for a, b in zip(at, at[1:]) for k in [int(idf[term[a:b]].argmax())]]
    return np.array(sorted(set(own)))


def _windows(rows: np.ndarray, line_term: np.ndarray, n: int, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows around rare words start and end; they do not leave their text."""
    at = X.row_starts(rows, n)
    rare = np.flatnonzero(np.isin(line_term, anchors[:, 0]))
    of = line_term[rare]
    starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for term, place, length in anchors.tolist():
        found = rare[of == term]
        starts.append(np.maximum(found - place, at[rows[found]]))
        ends.append(np.minimum(found - place + length, at[rows[found] + 1]))
    return np.concatenate(starts), np.concatenate(ends)


def _nearest(cos: np.ndarray, unit: np.ndarray, term: np.ndarray, idf: np.ndarray, notices: np.ndarray,
             notice: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest notice of each unit and its cosine, 0 where it is over the threshold but the unit
    lacks the words that the nearest notice of another licence lacks too."""
    top = cos.argmax(axis=1)
    best = cos[np.arange(len(cos)), top]
    high = np.flatnonzero(best >= notice)
    others = np.where(_licence_of == _licence_of[top[high], None], -1.0, cos[high])
    number = np.full(len(cos), -1)
    number[high] = np.arange(len(high))
    has, weight = notices > 0, idf[:notices.shape[1]] ** 2
    own = has[top[high]] & ~has[others.argmax(axis=1)]
    here = np.zeros(own.shape, bool)
    entry = (number[unit] >= 0) & (term >= 0)
    here[number[unit[entry]], term[entry]] = True
    best[high[(own & here) @ weight < OWN * (own @ weight)]] = 0.0
    return top, best


def scan(files: DataFrame, notice: float = NOTICE, whole: float = WHOLE, named: float = NAMED) -> DataFrame:
    """Adds notice_license, notice_score, file_license, inherited_license and license to files
    of columns path and text."""
    spark = files.sparkSession
    added = ["notice_license", "notice_score", "file_license", "inherited_license", "license"]
    files = files.drop(*added, "file_best", "file_score", "folder")
    of_texts = whole_texts()
    vocabulary, line_vocabulary = _vocabulary([*_notices, *of_texts.values()]), _vocabulary(_notices)
    file_names = [*_names, *of_texts]

    def count(batches):
        found = np.zeros(len(vocabulary), np.int64)
        n = 0
        for part in X.slices(batches):
            rows, hashes, *_ = _hashes(part.column(0))
            term = _lookup(vocabulary, hashes)
            keep = term >= 0
            n += part.num_rows
            found += np.bincount(np.unique(rows[keep] * len(vocabulary) + term[keep]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary))), pa.array(np.append(n, found))], names=["term", "n"])

    # a row for each word of the templates, whatever the input
    df = {r["term"]: r["n"] for r in files.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = df.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([df.get(i, 0) for i in range(len(vocabulary))], float))) + 1
    idf = np.append(idf, np.log(1.0 + total) + 1)
    in_file = np.searchsorted(vocabulary, line_vocabulary)
    line_idf = np.append(idf[in_file], idf[-1])
    # the place of each word among the words of the notices; the last is that of other words
    in_line = np.full(len(vocabulary) + 1, -1)
    in_line[in_file] = np.arange(len(in_file))
    model = spark.sparkContext.broadcast((
        vocabulary, idf, _vectors([*_notices, *of_texts.values()], vocabulary, idf),
        in_line, line_idf, _vectors(_notices, line_vocabulary, line_idf), _anchors(line_vocabulary, line_idf)))
    schema = T.StructType([*files.schema.fields, T.StructField("notice_license", T.StringType()),
                           T.StructField("notice_score", T.DoubleType()), T.StructField("file_best", T.StringType()),
                           T.StructField("file_score", T.DoubleType())])
    at = files.columns.index("text")

    def match(batches):
        vocabulary, idf, templates, in_line, line_idf, notices, anchors = model.value
        for part in X.slices(batches):
            n = part.num_rows
            rows, hashes, starts, data, offsets = _hashes(part.column(at))
            term = _lookup(vocabulary, hashes)
            line_term = in_line[term]
            # lines: an end of line or of a text ends one; only those with a word of the notices can match
            line = np.cumsum(data == 10)[starts] if len(starts) else starts
            new = np.append(True, (rows[1:] != rows[:-1]) | (line[1:] != line[:-1])) if len(rows) else np.empty(0, bool)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(rows)))
            some = (np.add.reduceat(line_term >= 0, first, dtype=np.int64) > 0) & (size <= LINE_WORDS) if len(first) else first > 0
            begin, end = _windows(rows, line_term, n, anchors)
            begin, end = np.concatenate([first[some], begin]), np.concatenate([(first + size)[some], end])
            best_line, name_line = np.zeros(n), np.full(n, -1)
            for k in range(0, len(begin), BLOCK):
                a, length = begin[k:k + BLOCK], (end - begin)[k:k + BLOCK]
                unit = np.repeat(np.arange(len(a)), length)
                word = np.arange(len(unit)) + np.repeat(a - (np.cumsum(length) - length), length)
                top, best = _nearest(_cosines(unit, line_term[word], len(a), line_idf, notices), unit, line_term[word], line_idf, notices, notice)
                owner = rows[a]
                order = np.lexsort((top, -best, owner))
                order = order[np.append(True, owner[order][1:] != owner[order][:-1])]
                owner, top, best = owner[order], top[order], best[order]
                nearer = best > best_line[owner]
                best_line[owner[nearer]], name_line[owner[nearer]] = best[nearer], top[nearer]
            cos = _cosines(rows, term, n, idf, templates)
            top, best = cos.argmax(axis=1), cos.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([_names[k] if s >= notice else None for k, s in zip(name_line, best_line)], pa.string()),
                 pa.array(np.minimum(best_line, 1.0)), pa.array([file_names[k] for k in top], pa.string()), pa.array(best)],
                names=schema.names)

    found = files.mapInArrow(match, schema)
    ruling = (F.col("file_score") >= whole) | (F.col("path").rlike(NAMES) & (F.col("file_score") >= named))
    found = found.withColumn("folder", _folder()).withColumn("file_license", F.when(ruling, F.col("file_best")))
    return _inherit(found, files.select(_folder().alias("folder"))).select(*files.columns, *added)


def _folder():
    """Of a path: all before the last slash; "" where there is none."""
    return F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))


def _inherit(found: DataFrame, folders: DataFrame) -> DataFrame:
    """Joins on folders: each distinct folder looks for its nearest ancestor with a licence file."""
    rulers = (found.where("file_license is not null and folder is not null").groupBy("folder")
              .agg(F.min(F.struct("path", "file_license")).alias("ruler")).select(F.col("folder").alias("above"), "ruler.file_license"))
    # "a/b/c" has the ancestors "a/b/c", "a/b", "a" and ""
    parts = F.split("folder", "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))
    nearest = (folders.where("folder is not null").distinct()
               .withColumn("above", F.explode(F.array_distinct(above))).join(rulers, "above")
               .groupBy("folder").agg(F.max(F.struct(F.length("above").alias("depth"), "file_license")).alias("near"))
               .select("folder", F.col("near.file_license").alias("inherited_license")))
    return (found.join(nearest, "folder", "left")
            .withColumn("license", F.coalesce("file_license", "notice_license", "inherited_license")))

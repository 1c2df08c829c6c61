"""Licence scans by a trained paragraph classifier, with DataFrame functions only.

A paragraph is a line of a text, or a block: the lines of a sentence that was
wrapped. It is read as lower-cased words; its unigrams and bigrams are the
features of a softmax regression over licence families, whose weights are
sparse. The training paragraphs are made from the notices below and from plain
sentences by fixed rules; training runs on the driver. A temperature fitted on
notices that the model hasn't seen calibrates the probabilities; a paragraph
under ``THRESHOLD`` is of the unknown class. A predicted family stands only if
the paragraph shares enough word bigrams with one of its templates.

Every paragraph is scored where it stands, in the row of its text: nothing is
joined or shuffled but the few confirmed paragraphs and a row per document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
THRESHOLD = 0.7
#: The least share of a template's bigrams that a paragraph must have.
CONFIRM = 0.5
#: What a weight costs by its absolute value; it makes the weights sparse.
PENALTY = 0.002
#: Training steps, and parts of the notices that are held out in turn for the calibration.
STEPS, FOLDS = 800, 4

#: Notices by which texts name their licences, and sentences of the licences themselves.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution 4.0 licence.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright Example Corporation. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Sentences that are no licence notices.
PLAIN = [
    "The driver's license was renewed at the office under the old bridge.",
    "All rights and duties are the same for every member.",
    "A new version of the software was released under pressure from users.",
    "The work is free and open to the public on Sundays.",
    "The general told the public that the software works.",
    "You may use this file for the meeting.",
    "Copyright law was discussed in the first chapter.",
    "The terms of the agreement are subject to change.",
    "She obtained a copy of the book without charge.",
    "The apache helicopter landed in the field at noon.",
    "The following conditions were met by the source.",
    "Version 2.0 of the report is on the table.",
    "The room is reserved for all guests of the hotel.",
    "They granted permission to any person who asked.",
    "Mozilla and the foundation work in the same common house.",
    "The text is the one and only that was in the house of the father.",
    "This is a plain line of prose, with words and commas in it.",
    "Creative people share common attributes.",
    "The name of the holder and the names of the contributors were read aloud.",
    "Goods are distributed in all parts of the country without a fee.",
    "The notice of the meeting shall be included in the letter to all members.",
    "The law requires that an agreement is made in writing.",
]

_WORD = re.compile("[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def _variants(text: str) -> list[list[str]]:
    """A notice whole, within other words, and with words left out one at a time, unless that makes another notice."""
    words = words_of(text)
    others = [words_of(t) for ts in TEMPLATES.values() for t in ts]
    out = [words, ["notice", *words], [*words, "see", "the", "file"], ["copyright", "2020", "by", "the", "authors", *words]]
    if len(words) > 5:
        out += [words[:i] + words[i + 1 :] for i in range(0, len(words), max(1, len(words) // 6))]
    return [v for v in out if v == words or v not in others]


@dataclass(frozen=True)
class Classifier:
    """Families, and by feature the weights of each; ``bias`` belongs to every paragraph."""

    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float

    def logits(self, words: list[str]) -> np.ndarray:
        rows = [self.weights[f] for f in features_of(words) if f in self.weights]
        return (np.sum(rows, axis=0) if rows else 0.0) + np.array(self.bias)

    def probabilities(self, words: list[str]) -> list[float]:
        return _softmax(self.logits(words)[None, :] / self.temperature)[0].tolist()


def _softmax(x: np.ndarray) -> np.ndarray:
    parts = np.exp(x - x.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def _train(x: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """Weights (features and, last, the bias, by families) by accelerated proximal steps of an L1-penalised softmax regression."""
    x = np.column_stack([x, np.ones(len(x))])
    aim = np.eye(n)[label]
    # each family weighs the same, however many notices it has
    share = (1 / np.bincount(label, minlength=n)[label] / n)[:, None]
    # the curvature is at most half the largest eigenvalue of the weighted products
    top = np.ones(x.shape[1])
    for _ in range(30):
        top = x.T @ (share[:, 0] * (x @ top))
        size = np.linalg.norm(top)
        top /= size
    step = 1.8 / size
    cost = np.full((x.shape[1], 1), PENALTY / len(x))
    cost[-1] = 0
    w = z = np.zeros((x.shape[1], n))
    t = 1.0
    for _ in range(STEPS):
        after = z - step * (x.T @ (share * (_softmax(x @ z) - aim)))
        after = np.sign(after) * np.maximum(np.abs(after) - step * cost, 0)
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = after + (t - 1) / following * (after - w), after, following
    return w


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    """The trained classifier; every run gives the same one."""
    families = (UNKNOWN, *sorted(TEMPLATES))
    sources = [(t, families.index(f)) for f, texts in sorted(TEMPLATES.items()) for t in texts] + [(t, 0) for t in PLAIN]
    rows = [(features_of(v), label, k) for k, (t, label) in enumerate(sources) for v in _variants(t)]
    rows.append((set(), 0, len(sources)))
    names = sorted(set().union(*(r[0] for r in rows)))
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (features, _, _) in enumerate(rows):
        x[i, [at[f] for f in features]] = 1
    label, source = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    # a notice is held out with all that was made from it
    logits, held = np.zeros((len(rows), len(families))), source % FOLDS
    for k in range(FOLDS):
        w = _train(x[held != k], label[held != k], len(families))
        logits[held == k] = x[held == k] @ w[:-1] + w[-1]

    # how sure a prediction may be is judged on the unseen notices that it gets right in kind: licence or none
    known = (logits.argmax(axis=1) == 0) == (label == 0)

    def loss(t: float) -> float:
        p = _softmax(logits[known] / t)
        return -np.log(np.maximum(p[np.arange(known.sum()), label[known]], 1e-12)).mean()

    best = min((0.15, 0.2, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    w = _train(x, label, len(families))
    kept = np.flatnonzero(np.abs(w[:-1]).max(axis=1) > 1e-4)
    return Classifier(families, {names[i]: tuple(w[i].tolist()) for i in kept}, tuple(w[-1].tolist()), best)


# ---- the same by Column expressions ---------------------------------------------


def _literal(values: list, kind: str = "string") -> Column:
    """A constant array; one literal, so that the plan stays small."""
    return F.split(F.lit("\u001f".join(map(str, values))), "\u001f").cast(f"array<{kind}>")


class _Numbers:
    """Numbers from 1 for a fixed set of values, found by a small table each.

    Tables are chosen by ``bucket``, which gives the same for a value here and,
    as an expression, for a Column.
    """

    BUCKETS = 64

    def __init__(self, values: set, kind: str, bucket, expression):
        self.kind, self.expression = kind, expression
        tables: list[list] = [[] for _ in range(self.BUCKETS)]
        for v in sorted(values):
            tables[bucket(v)].append(v)
        starts = np.cumsum([0, *map(len, tables)]).tolist()
        self.of = {v: starts[b] + i + 1 for b, table in enumerate(tables) for i, v in enumerate(table)}
        # one constant, as nothing in it depends on a row
        quote = "'{}'" if kind == "string" else "{}L"
        self.tables = F.expr(f"array({', '.join(f'cast(array({", ".join(map(quote.format, t))}) as array<{kind}>)' for t in tables)})")
        self.starts = _literal(starts[:-1], "int")

    def __call__(self, value: Column) -> Column:
        """The value's number, or 0."""
        at = (self.expression(value) % self.BUCKETS + 1).cast("int")
        found = F.coalesce(F.array_position(F.element_at(self.tables, at), value), F.lit(0))
        return F.when(found > 0, found.cast("int") + F.element_at(self.starts, at)).otherwise(0)


#: More than there are known words; a pair of words has the code first * PAIR + second.
PAIR = 100_000


@lru_cache(maxsize=1)
def _vocabulary() -> tuple[dict[str, int], dict[int, int]]:
    """Numbers of the known words, and by code those of the features with weights."""
    model = classifier()
    known = {w for f in model.weights for w in f.split()} | {w for ts in TEMPLATES.values() for t in ts for w in words_of(t)}
    return known, model.weights


def _once(rows: DataFrame, *made: Column) -> DataFrame:
    """``rows`` with columns that are evaluated once, however often they are used: a generator's output isn't inlined."""
    return rows.select("*", F.inline(F.array(F.struct(*made))))


def _blocks(text: Column) -> Column:
    """Blocks of a text: a line goes on in the next one where it doesn't end a sentence.

    Lines of a block stand apart by U+001F. Marks of comments at the start of a line are no words.
    """
    lines = F.regexp_replace(text, "\r\n?|\u001f", "\n")
    return F.split(F.regexp_replace(lines, r"(?<=[^\s.!?])[ \t]*\n(?=[ \t]*(?:[#*;/%!-]+[ \t]+)?[\p{L}\p{N}(\"'<])", "\u001f"), "\n")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, block, wrapped, paragraph, family, probability, confirmed`` of every paragraph.

    Paragraphs are the lines and, ``wrapped``, the blocks of several lines.
    ``block`` numbers the blocks of all documents. Paragraphs without a
    confirmed family are of the family ``unknown``; ``probability`` is that of
    the family predicted. Null texts have no paragraphs.
    """
    model, (known, weighed) = classifier(), _vocabulary()
    words = _Numbers(known, "string", lambda w: (ord(w[0]) + 31 * len(w)) % 64, lambda w: F.ascii(w) + 31 * F.length(w))

    def code(feature: str) -> int:
        first, *second = [words.of[w] for w in feature.split()]
        return first * PAIR + second[0] if second else first

    codes = {code(f): f for f in weighed}
    features = _Numbers(set(codes), "bigint", lambda c: (c + c // PAIR) % 64, lambda c: c + F.floor(c / PAIR))
    by_number = [f for _, f in sorted((features.of[c], f) for c, f in codes.items())]

    blocks = docs.select(F.col(id_col).alias("doc_id"), F.explode(_blocks(F.col(text_col))).alias("own"))
    blocks = blocks.select("doc_id", F.monotonically_increasing_id().alias("block"), F.split("own", "\u001f").alias("lines"))
    whole = F.when(F.size("lines") > 1, F.array(F.array_join("lines", " "))).otherwise(F.array().cast("array<string>"))
    rows = blocks.select("doc_id", "block", F.size("lines").alias("n_lines"), F.posexplode(F.concat("lines", whole)).alias("at", "paragraph"))
    rows = rows.select("doc_id", "block", (F.col("at") == F.col("n_lines")).alias("wrapped"), "paragraph")
    # words as numbers; unknown ones are 0 and part the others
    plain = F.trim(F.regexp_replace(F.lower("paragraph"), "[^a-z0-9]+", " "))
    rows = _once(rows, F.transform(F.split(plain, " "), lambda w: words(w)).alias("words"))
    following = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.zip_with("words", following, lambda a, b: F.when((a > 0) & (b > 0), a.cast("long") * PAIR + b))
    rows = _once(rows, F.array_distinct(F.array_compact(pairs)).alias("pairs"))
    single = F.transform(F.array_remove(F.array_distinct("words"), 0), lambda w: w.cast("long"))
    rows = _once(rows, F.array_remove(F.transform(F.concat(single, "pairs"), lambda c: features(c)), 0).alias("met"))

    def logit(k: int) -> Column:
        own = _literal([repr(float(weighed[f][k])) for f in by_number], "double")
        return F.aggregate("met", F.lit(float(model.bias[k])), lambda acc, i: acc + F.element_at(own, i))

    rows = _once(rows, F.array(*map(logit, range(len(model.families)))).alias("logits"))
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda acc, v: acc + F.exp((v - F.array_max("logits")) / model.temperature))
    predicted = F.element_at(_literal(list(model.families)), F.array_position("logits", top).cast("int"))
    rows = _once(rows, predicted.alias("predicted"), (1 / total).alias("probability"))
    share = F.lit(0.0)
    for family, texts in sorted(TEMPLATES.items()):
        near = []
        for own in map(words_of, texts):
            own_pairs = sorted({words.of[a] * PAIR + words.of[b] for a, b in zip(own, own[1:], strict=False)})
            near.append(F.size(F.array_intersect(_literal(own_pairs, "bigint"), F.col("pairs"))) / len(own_pairs))
        share = F.when(F.col("predicted") == family, F.greatest(*near)).otherwise(share)
    sure = (F.col("predicted") != UNKNOWN) & (F.col("probability") >= THRESHOLD)
    rows = _once(rows, F.when(sure, share >= CONFIRM).otherwise(False).alias("confirmed"))
    family = F.when(F.col("confirmed"), F.col("predicted")).otherwise(UNKNOWN)
    return rows.select("doc_id", "block", "wrapped", "paragraph", family.alias("family"), "probability", "confirmed")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, licences, n_paragraphs, probability``, one row per distinct id.

    ``licences`` lists the confirmed families in order, with commas; it is empty
    where none is found, as for null and empty texts. ``n_paragraphs`` counts
    their paragraphs, repeats included; a block counts only if none of its lines
    does. ``probability`` is the least sure of them, or null. Rows of one id,
    null ids too, count as parts of one document. Other columns are ignored.
    """
    found = paragraphs(docs, id_col, text_col).where("confirmed")
    lines, block = F.struct("family", "probability"), F.col("wrapped")
    by_block = found.groupBy("doc_id", "block").agg(
        F.collect_list(F.when(~block, lines)).alias("lines"), F.collect_list(F.when(block, lines)).alias("whole")
    )
    named = by_block.select("doc_id", F.explode(F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.col("whole"))).alias("f"))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("struct<family:string,probability:double>").alias("f"))
    return (
        ids.unionByName(named)
        .groupBy("doc_id")
        .agg(
            F.array_join(F.array_sort(F.collect_set("f.family")), ",").alias("licences"),
            F.count("f.family").alias("n_paragraphs"),
            F.min("f.probability").alias("probability"),
        )
    )

"""Licence scan: a trained paragraph classifier in SQL expressions.

A paragraph is a run of lines that were wrapped: a line goes on in the next one if
it ends no sentence and the next one's first word would have made it longer than
the lines around it.  Paragraphs and their single lines are scored alike.  Their
word 1-, 2- and 3-grams are looked up in the sparse
weights of a multinomial logistic regression over licence families and an
unknown class; a temperature fitted on held-out variants calibrates the
probabilities.  A prediction is confirmed by comparing the paragraph's n-grams
with the family's templates; one that isn't confirmed is unknown.

Notices of licences outside the families teach what is unknown although it
speaks of a licence.

The model is trained here from the templates (whole, cut and noised) and, for
the unknown class, from a bounded sample of the corpus's own lines.  Every
n-gram outside the templates has no weight, so a line without any trigger word
can't be predicted to be a licence and is passed over by one regular expression.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Short public licence notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice in the documentation and/or other materials provided with the distribution.",
        "Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under GPLv3.", "Licensed under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "Copyright Example Corporation. All rights reserved.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
}
# Notices of other licences, unknown on purpose.
OTHERS = (
    "Licensed under the Artistic License 2.0.", "This package is distributed under the terms of the zlib License.", "Distributed under the Boost Software License, Version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the European Union Public Licence, version 1.2.",
    "Released under the PostgreSQL License.", "Licensed under the Academic Free License version 3.0.", "SPDX-License-Identifier: WTFPL",
    "This product is licensed under the Oracle Technology Network License Agreement.", "Use of this data is governed by the Open Database License.",
    "You may not use this software without a valid licence key from your vendor.", "The driver needs a licence before the car may leave.")
FAMILIES = (*sorted(TEMPLATES), "unknown")
SPLIT = r"[^\p{L}\p{N}]+"
_WORDS = re.compile(r"[^\W_]+").findall
ORDERS = (1, 2, 3)


def grams(text: str) -> list[str]:
    words = _WORDS(text.lower())
    return sorted({" ".join(words[k:k + n]) for n in ORDERS for k in range(len(words) - n + 1)})


@dataclass
class Model:
    weights: dict[str, np.ndarray]  # n-gram -> weight by family
    bias: np.ndarray
    temperature: float
    triggers: list[str]


def _variants(rng: random.Random, text: str, background: list[str]) -> list[str]:
    """The text whole, cut, with lost words, and between words of other text."""
    words = text.split()
    out = [text]
    for _ in range(6):
        w = list(words)
        if len(w) > 6 and rng.random() < 0.5:
            a = rng.randrange(len(w) // 3)
            w = w[a:max(a + 5, len(w) - rng.randrange(len(w) // 3))]
        w = [x for x in w if len(words) < 6 or rng.random() > 0.08]
        if background and rng.random() < 0.5:
            w = w + rng.choice(background).split()[:rng.randrange(1, 8)]
        out.append(" ".join(w))
    return out


def fit(background: list[str], steps: int = 400) -> Model:
    """Sparse multinomial logistic regression by proximal gradient (L1), then a temperature on held-out variants."""
    rng = random.Random(11)
    background = [b for b in background if b.strip()]
    common: dict[str, int] = {}
    for b in background:
        for g in grams(b):
            common[g] = common.get(g, 0) + 1
    most = max(2, len(background) // 200)
    vocab = sorted({g for own in TEMPLATES.values() for t in own for g in grams(t) if common.get(g, 0) < most})
    place = {g: k for k, g in enumerate(vocab)}
    rows: list[tuple[list[int], int]] = []
    for k, family in enumerate(FAMILIES[:-1]):
        for t in TEMPLATES[family]:
            rows += [([place[g] for g in grams(v) if g in place], k) for v in _variants(rng, t, background)]
    rng.shuffle(background)
    unknown = len(FAMILIES) - 1
    for t in OTHERS:
        for v in [v for _ in range(4) for v in _variants(rng, t, background)]:
            rows.append(([place[g] for g in grams(v) if g in place], unknown))
    loose = [w for own in TEMPLATES.values() for t in own for w in _WORDS(t.lower())]
    for b in [*background[:len(rows)], *(" ".join(rng.sample(loose, 3)) for _ in range(len(rows) // 4)), *[""] * 20]:
        rows.append(([place[g] for g in grams(b) if g in place], unknown))
    rng.shuffle(rows)
    x = np.zeros((len(rows), len(vocab)))
    for i, (own, _) in enumerate(rows):
        x[i, own] = 1
    y = np.eye(len(FAMILIES))[[k for _, k in rows]]
    held = np.arange(len(rows)) % 5 == 0
    xt, yt = x[~held], y[~held]
    w, b = np.zeros((len(vocab), len(FAMILIES))), np.zeros(len(FAMILIES))
    rate = 4.0 / max(1.0, (xt**2).sum(1).max() / 4)
    penalty = 2e-5
    ahead_w, ahead_b, t = w.copy(), b.copy(), 1.0
    for _ in range(steps):  # accelerated, with soft thresholds
        err = (_softmax(xt @ ahead_w + ahead_b) - yt) / len(xt)
        new = ahead_w - rate * (xt.T @ err)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = ahead_b - rate * err.sum(0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w, ahead_b = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    heat = _temperature(x[held] @ w + b, y[held])
    use = np.flatnonzero(np.abs(w).max(1) > 1e-6)
    weights = {vocab[k]: w[k] for k in use}
    return Model(weights, b, heat, _triggers({vocab[k]: w[k] for k in use}, b, common))


def _triggers(weights: dict[str, np.ndarray], bias: np.ndarray, common: dict[str, int]) -> list[str]:
    """Words without which no line can win against the unknown class, whatever other n-grams it holds; rare ones first."""
    gain = {g: np.maximum(w[:-1] - w[-1], 0) for g, w in weights.items()}
    need = bias[-1] - bias[:-1]
    chosen: list[str] = []
    while gain and ((left := sum(gain.values())) >= need).any():
        by_word: dict[str, float] = {}
        for g, v in gain.items():
            for word in set(g.split()):
                by_word[word] = by_word.get(word, 0.0) + float(v[left >= need].sum())
        best = max(sorted(by_word), key=lambda x: by_word[x] / (1 + common.get(x, 0)))
        chosen.append(best)
        gain = {g: v for g, v in gain.items() if best not in g.split()}
    return sorted(chosen)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """What the held-out scores are divided by to be likeliest, by golden section over its logarithm."""
    def loss(h: float) -> float:
        return float(-(np.log(_softmax(z / np.exp(h)) + 1e-12) * y).sum())

    low, high, g = np.log(0.1), np.log(10.0), (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(docs: DataFrame, max_lines: int = 2000) -> Model:
    """Fit with a line of each of at most ``max_lines`` documents, those with the smallest hash of ``doc_id``, as unknown text.

    It is the line with the smallest hash, so any may be; lines that say licence,
    license, copyright or rights aren't used.
    """
    ids = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").orderBy(F.xxhash64(F.lit("licence"), "doc_id"), "doc_id").limit(max_lines).distinct()
    lines = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(~F.lower("line").rlike("licen[cs]e|copyright|rights") & F.col("line").rlike(r"\S"))
    # one line for each id, however often it is repeated
    rows = lines.groupBy("doc_id").agg(F.min_by("line", F.struct(F.xxhash64("line"), "line")).alias("line")).collect()
    return fit([r["line"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["line"]))])


def _pieces(docs: DataFrame) -> DataFrame:
    """``doc_id, dh, a, b, line, whole, para``: every line, and every paragraph of several lines (``whole``); ``a`` and ``b`` are the first and last line of a piece's paragraph."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("dh"), F.split("text", "\r?\n").alias("lines"))
    wrapped = (
        "i + 1 < size(lines) AND lines[i] RLIKE '[\\\\p{L}\\\\p{N}]' AND lines[i + 1] RLIKE '[\\\\p{L}\\\\p{N}]' AND NOT lines[i] RLIKE '[.!?][\"\\')]*\\\\s*$' AND "
        "length(lines[i]) + 1 + length(regexp_extract(lines[i + 1], '^\\\\W*\\\\w*', 0)) > greatest(length(lines[i]), length(lines[i + 1]), length(lines[greatest(i - 1, 0)]))")
    rows = rows.withColumn("ends", F.expr(f"filter(sequence(0, size(lines) - 1), i -> NOT ({wrapped}))"))
    rows = rows.select("doc_id", "dh", "lines", F.explode(F.expr("transform(ends, (e, k) -> struct(IF(k = 0, 0, ends[k - 1] + 1) AS a, e AS b))")).alias("p"))
    rows = rows.select("doc_id", "dh", "p.a", "p.b", F.expr("slice(lines, p.a + 1, p.b - p.a + 1)").alias("own"))
    lines = F.expr("transform(own, (x, k) -> struct(a + k AS line, false AS whole, x AS para))")
    whole = F.expr("IF(a < b, array(struct(a AS line, true AS whole, array_join(own, ' ') AS para)), array())")
    return rows.select("doc_id", "dh", "a", "b", F.explode(F.concat(lines, whole)).alias("piece")).select("doc_id", "dh", "a", "b", "piece.*")


def scan(docs: DataFrame, model: Model, least_probability: float = 0.5, least_similarity: float = 0.6) -> DataFrame:
    """``doc_id, line, first_line, last_line, family, probability, template, similarity, confirmed`` for each notice of a licence.

    ``line`` counts from 0.  A confirmed paragraph of several lines is one row
    with its first and last line; its ``line`` is the likeliest one that is
    confirmed by itself, with that line's figures, or else the first, with those
    of the paragraph.  Confirmed lines of another family stay beside it.  Other
    lines are rows of their own.  Lines that speak of a licence but fit no family, or
    whose prediction no template confirms, have the family ``unknown`` and no
    template.  ``probability`` is that of the likeliest class.  Null and empty texts have no rows;
    repeated rows are scanned once per different text; other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = len(FAMILIES)
    weights = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in sorted(model.weights.items())] or [("", [0.0] * size)], "gram string, w array<double>")
    known = sorted({(g, f"{family}/{k}", family) for family, own in TEMPLATES.items() for k, t in enumerate(own) for g in grams(t)})
    sizes: dict[str, int] = {}
    for _, t, _ in known:
        sizes[t] = sizes.get(t, 0) + 1
    templates = spark.createDataFrame([(g, t, f, sizes[t]) for g, t, f in known], "gram string, template string, family string, size int")

    speaks = "licen[cs]e|copyright|rights reserved|warranty"
    words = "|".join(map(re.escape, model.triggers))
    trigger = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words or 'licen[cs]e'})(?![\p{{L}}\p{{N}}])|{speaks}"
    key = ["doc_id", "dh", "a", "b", "line", "whole"]
    rows = _pieces(docs.where(F.col("text").rlike(trigger)))
    rows = rows.where(F.col("para").rlike(trigger)).dropDuplicates(key)
    rows = rows.withColumn("ws", F.filter(F.split(F.lower("para"), SPLIT), lambda x: x != ""))
    lists = [F.col("ws")] + [F.expr(
        f"CASE WHEN size(ws) < {n} THEN array() ELSE transform(sequence(1, size(ws) - {n - 1}), i -> array_join(slice(ws, i, {n}), ' ')) END") for n in ORDERS[1:]]
    rows = rows.withColumn("speaks", F.lower("para").rlike(speaks)).withColumn("gs", F.array_distinct(F.concat(*lists)))
    # the n-grams of the model and the templates; the rest of the line counts only by its length
    vocabulary = sorted({*model.weights, *(g for g, *_ in known)})
    rows = rows.select(*key, "speaks", F.size("gs").alias("n"), F.array_intersect("gs", F.lit(vocabulary)).alias("gs")).where("speaks OR size(gs) > 0")
    each = rows.select(*key, "speaks", "n", F.explode_outer("gs").alias("gram"))

    hit = each.join(F.broadcast(weights), "gram", "left")
    sums = hit.groupBy(*key, "n", "speaks").agg(*(F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(size)))
    z = [(F.coalesce(f"z{k}", F.lit(0.0)) + float(model.bias[k])) / model.temperature for k in range(size)]
    scored = sums.select(*key, "n", "speaks", F.array(*z).alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top")))
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("z", F.col("top")).cast("int"))
    scored = scored.withColumn("probability", 1 / total).withColumn("guess", family)
    scored = scored.withColumn("family", F.when((F.col("guess") != "unknown") & (F.col("probability") >= least_probability), F.col("guess")).otherwise("unknown"))
    scored = scored.where((F.col("family") != "unknown") | F.col("speaks"))

    near = each.join(F.broadcast(templates), "gram").groupBy(*key, "template", F.col("family").alias("f"), "size", "n").agg(F.count("*").alias("both"))
    near = near.select(*key, "f", "template", (F.col("both") / F.least("size", "n")).alias("similarity"), (F.col("both") / F.greatest("size", "n")).alias("tie"))
    best = near.groupBy(*key, "f").agg(F.max(F.struct("similarity", "tie", "template")).alias("best"))
    out = scored.join(best, [*(scored[c].eqNullSafe(best[c]) for c in key), scored["family"] == best["f"]], "left")
    out = out.select(
        *(scored[c] for c in key), F.col("family").alias("predicted"), "probability", "speaks", F.col("best.template").alias("template"),
        F.coalesce("best.similarity", F.lit(0.0)).alias("similarity"), F.coalesce(F.col("best.similarity") >= least_similarity, F.lit(False)).alias("confirmed"))
    out = out.where("confirmed OR speaks").withColumn("family", F.when(F.col("confirmed"), F.col("predicted")).otherwise("unknown"))
    # a paragraph that is confirmed takes the place of its lines
    own = Window.partitionBy("doc_id", "dh", "a")
    out = out.withColumn("of", F.max(F.expr("CASE WHEN whole AND confirmed THEN family END")).over(own))
    out = out.withColumn("fits", F.coalesce(F.col("confirmed") & (F.col("family") == F.col("of")), F.lit(False)))
    best = Window.partitionBy("doc_id", "dh", "a", "fits").orderBy("whole", F.desc("probability"), "line")
    out = out.withColumn("r", F.row_number().over(best)).where("CASE WHEN fits THEN r = 1 ELSE NOT whole AND (of IS NULL OR confirmed) END")
    return out.select(
        "doc_id", F.col("line").cast("long").alias("line"), F.expr("CAST(CASE WHEN fits THEN a ELSE line END AS LONG)").alias("first_line"),
        F.expr("CAST(CASE WHEN fits THEN b ELSE line END AS LONG)").alias("last_line"), "family", "probability",
        F.when(F.col("confirmed"), F.col("template")).alias("template"), "similarity", "confirmed")

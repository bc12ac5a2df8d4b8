"""Licence scans: a sparse word n-gram logistic regression over paragraphs, with an unknown class and templates."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import constant, softmax_fit

#: Words that carry no feature by themselves.
COMMON = frozenset("the a an of and or to in on for is are be it its this that with by from as at under you may not no any all your see use used".split())
#: A template confirms a prediction if so much of its word pairs stand in the paragraph.
SIMILAR = 0.6
#: A notice may be wrapped over so many lines.
LINES = 8

#: Notices by family, as public licences word them. A paragraph is compared with these, and the model learns from them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC 4.0, for noncommercial use with attribution.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
#: Paragraphs without a licence, among them some that share its words.
OTHER = (
    "The driver showed a valid licence at the border and drove on to the city.",
    "She studied physics at MIT and later moved to the public library of the town.",
    "The restaurant lost its liquor license in March, the council said.",
    "Apache is the name of several related peoples of the southwest.",
    "Version 2.0 of the report was released on Friday, version 3 follows in May.",
    "The software comes with a manual and a warranty of two years.",
    "Permission to enter the building was granted by the general manager.",
    "The gnu is a large antelope that lives in the public parks of the country.",
    "He was free to modify the terms of the contract under the new law.",
    "The foundation published the first copy of the journal in 1998.",
    "All rights of way across the field are open to the public.",
    "A commercial version of the work was distributed by the publisher.",
    "Creative people are common in this part of the country.",
    "The source of the river lies in the mountains above the village.",
    "The file was copied to another disk and the program started again.",
    "In compliance with the rules the binary star was observed for a year.",
    "Er kam mit dem Zug aus der Stadt und ging mit ihr nach Hause.",
    "Mit der Zeit wurde es besser, sagte der Mann mit dem Hut.",
    "Please subscribe to our newsletter and follow us for more news.",
    "The weather was mild and the harvest good, the farmers reported.",
    "Working conditions are met with protest in many factories.",
    "International attribution of the painting is disputed among scholars.",
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams_of(text: str) -> set[str]:
    """Words and word pairs, but for those of common words only."""
    w = words_of(text)
    pairs = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if not (a in COMMON and b in COMMON)}
    return {x for x in w if x not in COMMON} | pairs


class LicenseModel:
    """Vocabulary, weights by family, the probability from which a family is held to be known, and the words of which
    a paragraph must have one to get there: without them, no feature of positive weight can occur."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, threshold: float):
        self.vocabulary, self.weights, self.bias, self.threshold = vocabulary, weights, bias, threshold
        self.families = list(TEMPLATES)
        gap = weights[:, 1:] - weights[:, :1]
        positive = [g for g, row in zip(vocabulary, gap, strict=True) if (row > 0).any()]
        self.anchors = sorted({w for g in positive for w in g.split() if w not in COMMON})


def _training() -> tuple[list[set[str]], list[int]]:
    """Each notice whole, and with runs of words left out, as writers shorten them; class 0 is other text."""
    x, y = [], []
    for label, texts in enumerate([OTHER, *TEMPLATES.values()]):
        for text in texts:
            w = words_of(text)
            for cut in [(0, 0), (0, 1), (len(w) - 1, len(w)), (1, 2)]:
                x.append(grams_of(" ".join(w[: cut[0]] + w[cut[1] :])))
                y.append(label)
    return x, y


@lru_cache(maxsize=1)
def fit_licenses(folds: int = 5) -> LicenseModel:
    """Fit on the notices above; the threshold is set from held-out folds, half way between the most probable family of
    other text and the least probable right family of notices, within [0.5, 0.9]."""
    x, y = _training()
    vocabulary = sorted(set().union(*x))
    at = {g: i for i, g in enumerate(vocabulary)}
    rows = np.zeros((len(x), len(vocabulary)))
    for i, grams in enumerate(x):
        rows[i, [at[g] for g in grams]] = 1.0
    label = np.array(y)
    fit = lambda keep: softmax_fit(rows[keep], label[keep], len(TEMPLATES) + 1, l2=1e-4, l1=2e-5, steps=1500)
    other, own = [], []
    for f in range(folds):
        held = np.arange(len(x)) // 4 % folds == f
        w, b = fit(~held)
        z = rows[held] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        other += p[label[held] == 0, 1:].max(1).tolist()
        own += [q[k] for q, k in zip(p, label[held], strict=True) if k and q.argmax() == k]
    threshold = float(np.clip((max(other, default=0.5) + np.quantile(own or [0.9], 0.05)) / 2, 0.5, 0.9))
    return LicenseModel(vocabulary, *fit(np.ones(len(x), bool)), threshold)


def _literal(values: list[str]) -> Column:
    """An array of strings as one literal; none of them has a line feed."""
    return F.split(F.lit("\n".join(values)), "\n")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def scan_licenses(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, n_unconfirmed, license, paragraph, probability, similarity for each row of docs.

    A paragraph is a line with a word; its number counts all lines from 0. Notices are wrapped, so up to LINES lines in
    a row are judged together as well, if all have words: of the first and the last line as many words as the longest
    template has, of those between no more than that. license is the family of the most probable paragraph or run of
    them whose probability reaches the model's threshold and which a template of that family confirms (similarity: share
    of the template's n-grams in it, 0 if a number of the template's isn't there); else null, the unknown class; paragraph is the number of its first line. Of runs
    that hold each other or overlap and have the same family, the shorter or else the first counts. n_unconfirmed counts
    paragraphs that reach the threshold by themselves without a template like them, and aren't in a run that counts.
    Ties go to the first paragraph. Null and empty texts have no paragraph. Built-in functions only, without a shuffle:
    paragraphs and runs without an anchor word are passed over, since the model can't reach its threshold on them.
    Repeated rows give repeated rows; other columns aren't read.
    """
    vocabulary = _literal(model.vocabulary)
    anchors = _literal(model.anchors)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    lines = F.split("text", "\n", -1)
    longest = max(len(words_of(t)) for family in TEMPLATES.values() for t in family)
    none = F.array().cast("array<struct<words:array<string>,anchored:boolean>>")
    numbered = F.transform(F.transform(lines, _words), lambda w: F.struct(w.alias("words"), F.arrays_overlap(w, anchors).alias("anchored")))
    rows = rows.select(
        "doc_id",
        F.size(F.filter(lines, lambda p: p.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_paragraphs"),
        F.when(F.arrays_overlap(_words(F.col("text")), anchors), numbered).otherwise(none).alias("lines"),
    )

    def spans(k: int) -> Column:
        """Runs of k lines, by their first line."""

        def span(line: Column, i: Column) -> Column:
            if k == 1:
                return F.when(line["anchored"], F.struct(i.alias("at"), i.alias("end"), line["words"].alias("words")))
            run = F.slice("lines", i + 1, k)
            words = F.transform(run, lambda p: p["words"])
            middle = F.flatten(F.slice(words, 2, k - 2))
            first, last = F.get(words, F.lit(0)), F.get(words, F.lit(k - 1))
            fits = (F.size(run) == k) & F.exists(run, lambda p: p["anchored"]) & F.forall(words, lambda w: F.size(w) > 0)
            if k > 2:
                fits = fits & (F.size(middle) <= longest)
            first = F.slice(first, F.greatest(F.size(first) - longest, F.lit(0)) + 1, longest)
            return F.when(fits, F.struct(i.alias("at"), (i + k - 1).alias("end"), F.concat(first, middle, F.slice(last, 1, longest)).alias("words")))

        return F.filter(F.transform("lines", span), lambda p: p.isNotNull())

    rows = rows.select("doc_id", "n_paragraphs", F.concat(*[spans(k) for k in range(1, LINES + 1)]).alias("found"))

    def grams(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
        return F.array_distinct(F.concat(w, pairs))

    def judged(p: Column) -> Column:
        """Hits as places in the vocabulary, then each family's logit over that of other text."""
        own = grams(p["words"])
        hits = F.transform(F.array_intersect(own, vocabulary), lambda g: (F.array_position(vocabulary, g) - 1).cast("int"))
        return F.struct(p["at"].alias("at"), p["end"].alias("end"), own.alias("grams"), hits.alias("hits"))

    rows = rows.withColumn("found", F.transform("found", judged))
    gap, gap_bias = model.weights[:, 1:] - model.weights[:, :1], model.bias[1:] - model.bias[0]

    def with_odds(p: Column) -> Column:
        odds = [
            F.exp(F.aggregate(p["hits"], F.lit(float(gap_bias[k])), (lambda t: lambda a, h: a + F.get(t, h))(constant(gap[:, k].tolist()))))
            for k in range(len(model.families))
        ]
        return F.struct(p["at"].alias("at"), p["end"].alias("end"), p["grams"].alias("grams"), F.array(*odds).alias("odds"))

    def similarity(p: Column, k: int) -> Column:
        shares = []
        for template in TEMPLATES[model.families[k]]:
            own = sorted(grams_of(template))
            share = F.size(F.array_intersect(p["grams"], _literal(own))) / F.lit(float(len(own)))
            # A notice of another version isn't like the template, however many words they share.
            version = sorted({w for w in words_of(template) if w.isdigit()})
            same = F.size(F.array_intersect(p["grams"], _literal(version))) == len(version) if version else F.lit(True)
            shares.append(F.when(same, share).otherwise(0.0))
        return F.greatest(*shares)

    def decided(p: Column) -> Column:
        total = F.aggregate(p["odds"], F.lit(1.0), lambda a, o: a + o)
        best = F.array_max(p["odds"])
        family = F.array_position(p["odds"], best).cast("int") - 1
        alike = F.lit(0.0)
        for k in range(len(model.families)):
            alike = F.when(family == k, similarity(p, k)).otherwise(alike)
        return F.struct(
            (alike >= SIMILAR).alias("confirmed"), (best / total).alias("probability"), (-p["at"]).alias("back"), p["end"].alias("end"),
            F.get(_literal(model.families), family).alias("license"), alike.alias("similarity"),
        )

    rows = rows.withColumn("found", F.transform(F.transform("found", with_odds), decided))
    rows = rows.withColumn("found", F.filter("found", lambda p: p["probability"] >= model.threshold))
    rows = rows.withColumn("good", F.filter("found", lambda p: p["confirmed"]))

    def within(p: Column, q: Column) -> Column:
        return (q["back"] <= p["back"]) & (q["end"] <= p["end"]) & (q["end"] + q["back"] < p["end"] + p["back"]) & (q["license"] == p["license"])

    least = F.filter("good", lambda p: ~F.exists("good", lambda q: within(p, q)))
    ordered = F.array_sort(least, lambda p, q: q["back"] - p["back"])
    apart = F.aggregate(
        ordered, F.slice("good", 1, 0),
        lambda done, p: F.when(F.exists(done, lambda q: (q["end"] >= -p["back"]) & (q["license"] == p["license"])), done).otherwise(F.concat(done, F.array(p))),
    )
    rows = rows.withColumn("good", apart)
    alone = F.filter("found", lambda p: (p["end"] == -p["back"]) & ~p["confirmed"] & ~F.exists("good", lambda q: (-q["back"] <= p["end"]) & (q["end"] >= p["end"])))
    top = F.array_max("good")
    return rows.select(
        "doc_id", "n_paragraphs", F.size("good").cast("long").alias("n_licensed"),
        F.size(alone).cast("long").alias("n_unconfirmed"),
        top["license"].alias("license"), (-top["back"]).alias("paragraph"), top["probability"].alias("probability"), top["similarity"].alias("similarity"),
    )

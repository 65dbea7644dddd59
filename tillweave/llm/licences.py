"""Licence scan: a trained classifier of paragraphs, in DataFrame and MLlib operations only.

1. Training rows: the templates and titles below with words dropped at random (by hash), texts that
   sound like licences of no known family, ordinary sentences with words of licences, and paragraphs of a bounded sample of documents (`SAMPLE` of them,
   least digest first) as the class `none`, unless they repeat a template.
2. Features: word bigrams and trigrams of the licence rows, without those that ordinary paragraphs
   of the sample share. The model is a sparse multinomial logistic regression.
3. A fifth of the rows is held out. On it a temperature is chosen by log loss, and the confidence
   below which a paragraph counts as `unknown` by the precision above it.
4. A document can only score if it holds a feature. Its words are read once for that: either a word
   that is rare in ordinary text and part of a feature, or a whole feature of common words.
5. Of the others every paragraph (line with a word) is looked at, and every run of lines without a
   blank one between them as a whole, since notices are often wrapped. A piece without any feature
   stays `none`; the rest is scored in pieces of `SPAN` words.
6. A predicted family is confirmed where a template of it shares enough word trigrams with the
   piece; unconfirmed or unsure predictions are `unknown`.

A notice found in a run of lines counts once, and its lines that no family is confirmed for do not
count beside it; one that a line of the run shows already is not counted again.

Defined cases: NULL and empty texts have no paragraphs and no licence; repeated rows each give a
row; ties between families go to the first by name; an empty table gives no rows (the model is then
fitted on templates only).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.llm.words import fresh, has_word, let
from tillweave.session import stash

SAMPLE, SAMPLE_CHARS = 400, 4000  # documents, and characters of each, that training may read
VOCABULARY = 4096  # features at most
VARIANTS = 25  # training rows per template
SPAN, STEP = 96, 48  # words of a scored piece, and between the starts of two
RARE = 200  # an anchor is in one of so many ordinary paragraphs at most
PRECISION = 0.99
CONFIRMED = 0.6  # share of a template's trigrams
NONE, UNKNOWN = "none", "unknown"

# Notices by which licences are named in texts.
TEMPLATES = [
    ("AGPL", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
    ("reserved", "Copyright by the authors. All rights reserved. No part of this text may be reproduced without permission."),
]
# Titles and tags by which licences are named.
TITLES = [
    ("AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"), ("AGPL", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "BSD 3-Clause License"), ("BSD", "BSD 2-Clause License"), ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC0", "CC0 1.0 Universal"), ("EPL", "Eclipse Public License v 2.0"), ("GPL", "GNU GENERAL PUBLIC LICENSE Version 3"), ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "The ISC License (ISC)"), ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"), ("LGPL", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("MIT", "The MIT License (MIT)"), ("MIT", "SPDX-License-Identifier: MIT"), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
# Ordinary sentences with words of licences.
ORDINARY = [
    "We discussed the license of the fishing boat with the harbour master.", "Drivers need a valid license to use the public roads.", "The work was made available to the general public without charge.",
    "You may copy the file to any folder of your own.", "The software is subject to the rules of the school.", "They were granted permission to use the library after hours.",
    "The terms of the agreement were published by the foundation in May.", "Copies of the text may be obtained from the source.", "Members can see the conditions under which the product was released.",
    "The program was distributed to all members of the society without restriction.", "He lost his license in the city and can not work as a driver.", "Part of the form was reproduced in the national statistics.",
]
# Texts in the manner of licences, of no family above.
OTHERS = [
    "Licensed under the Orchard Community License, version 1.", "Released under the Riverside Data License.", "Use of this product is governed by the end user license agreement.",
    "This content is licensed under the terms of the Harbour Open Content Agreement.", "Distributed under our own license; see the file for details.",
    "Permission to read this text is granted to members of the society only.", "This data is made available under the National Statistics Terms of Reuse.",
    "You may share this work under the conditions of the Meadow Sharing Pledge.", "Copies may be made for teaching under the Schools Copying Scheme.",
    "This software is subject to the Evaluation License of its vendor.",
]


class Model(NamedTuple):
    features: CountVectorizerModel
    classes: list[str]
    logistic: LogisticRegressionModel
    temperature: float
    confidence: float
    anchors: list[str]  # words that are rare in ordinary text; every feature holds one,
    common: list[str]  # or is one of these
    accuracy: float  # on the held-out rows


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(w: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    def of(n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, sizes)))


def paragraphs(text: Column) -> Column:
    """(run, joined, w): words of each line with a word and of each run of several such lines with no
    blank line between, long ones in overlapping pieces."""
    def pieces(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - STEP - 1, F.lit(0)), F.lit(STEP))
        return F.when(F.size(w) <= SPAN, F.array(w)).otherwise(F.transform(starts, lambda s: F.slice(w, s + 1, SPAN)))

    def of_run(lines: Column, k: Column) -> Column:
        def marked(ws: Column, joined: bool) -> Column:
            return F.transform(ws, lambda w: F.struct(k.alias("run"), F.lit(joined).alias("joined"), w.alias("w")))

        own = F.flatten(F.transform(lines, lambda line: let(tokens(line), pieces)))
        whole = F.when(F.size(lines) > 1, let(tokens(F.array_join(lines, "\n")), pieces)).otherwise(F.array().cast("array<array<string>>"))
        return F.concat(marked(own, False), marked(whole, True))

    runs = F.split(text, r"\n(?:[\x20\x09\x0B-\x0D]*\n)+")
    return F.flatten(F.transform(runs, lambda run, k: let(F.filter(F.split(run, "\n"), has_word), lambda lines: of_run(lines, k))))


def likeness(g: Column, family: Column | None = None) -> Column:
    """Largest share of the trigrams of a template (of the family) that `g` holds."""
    known = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, _trigrams(t))).alias("grams")) for f, t in [*TEMPLATES, *TITLES]])
    if family is not None:
        known = F.filter(known, lambda t: t["family"] == family)

    def shares(own: Column) -> Column:  # `own` is computed once, not once per template
        return F.array_max(F.transform(known, lambda t: F.size(F.array_intersect(own, t["grams"])) / F.size(t["grams"])))

    return F.coalesce(let(g, shares), F.lit(0.0))


def _trigrams(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(" ".join(words[k : k + 3]) for k in range(len(words) - 2))) or [" ".join(words)]


def training_rows(docs: DataFrame) -> DataFrame:
    """(label, words, held_out), a bounded number of rows."""
    spark = docs.sparkSession
    fixed = spark.createDataFrame([*TEMPLATES, *TITLES, *[(UNKNOWN, t) for t in OTHERS], *[(NONE, t) for t in ORDINARY]], "label string, text string")
    variants = fixed.select("label", tokens(F.col("text")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v"))
    dropped = F.filter("w", lambda x, i: (F.col("v") == 0) | (F.pmod(F.xxhash64(x, i, F.col("v")), F.lit(12)) > 0))
    positive = variants.select("label", dropped.alias("w"), (F.pmod(F.xxhash64("w", "v"), F.lit(5)) == 0).alias("held_out"))
    # digests are picked first, so that neither texts nor copies crowd the pick; SAMPLE rows are broadcast
    keyed = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("k"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    least = keyed.select("k").distinct().orderBy("k").limit(SAMPLE)
    chosen = keyed.join(F.broadcast(least), "k", "left_semi").groupBy("k").agg(F.min("text").alias("text"))
    plain = chosen.select(F.explode(paragraphs(F.col("text"))).alias("p")).select("p.w")
    negative = plain.filter(likeness(grams(F.col("w"), (3,))) < 0.5).select(F.lit(NONE).alias("label"), "w", (F.pmod(F.xxhash64("w"), F.lit(5)) == 0).alias("held_out"))
    return positive.union(negative)


def fit(docs: DataFrame) -> Model:
    """Vocabulary, weights, temperature and confidence; what reaches the driver is bounded by
    `VOCABULARY` and the number of families."""
    rows = stash(training_rows(docs).withColumn("g", grams(F.col("w"))))
    counted = rows.filter("NOT held_out").select((F.col("label") == NONE).alias("plain"), F.explode("g").alias("gram")).groupBy("gram").agg(F.count_if("plain").alias("n"), F.count_if(~F.col("plain")).alias("p"))
    best = counted.filter("p >= 5 AND n * 50 < p").orderBy(F.desc("p"), "gram").limit(VOCABULARY)
    vocabulary = [r[0] for r in best.collect()]
    common = {r[0]: r[1] for r in rows.filter((F.col("label") == NONE)).select(F.explode(F.array_distinct("w")).alias("x")).filter(F.col("x").isin(sorted({x for g in vocabulary for x in g.split()}))).groupBy("x").count().collect()}
    plain = max(1, rows.filter(F.col("label") == NONE).count())
    rarest = {g: min(g.split(), key=lambda x: (common.get(x, 0), x)) for g in vocabulary}
    anchors = sorted({x for x in rarest.values() if common.get(x, 0) * RARE <= plain})
    usual = sorted(g for g, x in rarest.items() if x not in anchors)
    classes = [NONE, *sorted({f for f, _ in TEMPLATES}), UNKNOWN]
    features = CountVectorizerModel.from_vocabulary(vocabulary, "g", "features", binary=True)
    at = F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("double") - 1
    prepared = stash(features.transform(rows).select("features", at.alias("label"), "held_out"))
    weights = LogisticRegression(family="multinomial", regParam=1e-4, elasticNetParam=0.2, maxIter=30, aggregationDepth=2).fit(prepared.filter("NOT held_out"))
    raw = weights.transform(prepared.filter("held_out")).select(vector_to_array("rawPrediction").alias("raw"), F.col("label").cast("int").alias("label"))
    tried = raw.withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0)]))).withColumn("p", _softmax(F.col("raw"), F.col("t")))
    loss = tried.groupBy("t").agg(F.avg(-F.log(F.greatest(F.col("p")[F.col("label")], F.lit(1e-9)))).alias("loss")).orderBy("loss", "t").first()
    temperature = float(loss["t"]) if loss else 1.0
    sure = raw.withColumn("p", _softmax(F.col("raw"), F.lit(temperature))).select(F.array_max("p").alias("top"), (F.array_position("p", F.array_max("p")) - 1).alias("said"), "label")
    named = sure.filter(f"said > 0 AND said < {len(classes) - 1}")
    levels = named.withColumn("level", F.explode(F.array(*[F.lit(x / 20) for x in range(8, 20)]))).filter("top >= level")
    good = levels.groupBy("level").agg(F.avg((F.col("said") == F.col("label")).cast("double")).alias("right")).filter(F.col("right") >= PRECISION).orderBy("level").first()
    right = sure.agg(F.avg((F.col("said") == F.col("label")).cast("double"))).first()[0]
    return Model(features, classes, weights, temperature, float(good["level"]) if good else 0.95, anchors, usual, float(right or 0.0))


def _softmax(raw: Column, temperature: Column) -> Column:
    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return F.transform(e, lambda x: x / total)

    return let(F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / temperature)), shares)


def scan(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`docs` with a struct `_licence`: paragraphs, those with a licence, family, probability,
    likeness, confirmed. The most probable confirmed paragraph speaks for its document.

    `carry` names the columns that travel to the grouping by document; all by default.
    """
    carry = docs.columns if carry is None else carry
    name = fresh(docs.columns, "_licence")
    row = F.monotonically_increasing_id()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_doc"), row.alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    nothing = F.array().cast("array<struct<run:int,joined:boolean,w:array<string>>>")
    found = F.when(_may_hold(F.col("_text"), model), let(paragraphs(F.col("_text")), lambda ps: F.filter(ps, lambda p: _holds(p["w"], model)))).otherwise(nothing)
    lines = held.select("_doc", "_row", F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("bigint").alias("_n"), F.explode_outer(found).alias("_p"))
    narrow = lines.select("_row", "_doc", "_n", F.struct("_p.run", "_p.joined").alias("_at"), F.col("_p.w").alias("w"), F.when(F.col("_p.w").isNotNull(), grams(F.col("_p.w"))).otherwise(F.array().cast("array<string>")).alias("g"))
    raw = vector_to_array("rawPrediction").alias("raw")
    scored = model.logistic.transform(model.features.transform(narrow)).select("_row", "_doc", "_n", "_at", "w", "g", raw)
    p = scored.withColumn("p", F.when(F.col("w").isNotNull(), _softmax(F.col("raw"), F.lit(model.temperature))))
    top = p.withColumn("top", F.array_max("p")).withColumn("said", F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("p", F.col("top")).cast("int")))
    alike = top.withColumn("like", F.when(F.col("said").isin(NONE, UNKNOWN), 0.0).otherwise(likeness(grams(F.col("w"), (3,)), F.col("said"))))
    sure = (F.col("top") >= model.confidence) & (F.col("like") >= CONFIRMED)
    family = F.when(F.col("said") == NONE, None).when(~F.col("said").isin(UNKNOWN) & sure, F.col("said")).otherwise(F.when(F.col("said").isNotNull(), UNKNOWN))
    judged = alike.withColumn("family", F.when(F.col("w").isNotNull(), family))
    best = F.struct((F.col("family") != UNKNOWN).alias("known"), F.col("top"), F.col("family"), F.col("like"))
    # per run of lines first: sets of families, so a text of very many notices is no long list
    whole, known = F.col("_at.joined"), F.col("family") != UNKNOWN
    per_run = judged.groupBy("_row", "_at.run").agg(
        F.first("_doc").alias("_doc"), F.first("_n").alias("_n"), F.max(F.when(F.col("family").isNotNull(), best)).alias("b"),
        F.collect_set(F.when(~whole & known, F.col("family"))).alias("own"), F.count_if(~whole & known).alias("n_own"), F.count_if(~whole & ~known).alias("n_unsure"),
        F.collect_set(F.when(whole & known, F.col("family"))).alias("wrapped"), F.max(whole & ~known).alias("unsure"),
    )
    covered, scored_lines = F.size("wrapped") > 0, F.col("n_own") + F.col("n_unsure") > 0
    notices = (
        F.col("n_own") + F.when(covered, 0).otherwise(F.col("n_unsure")) + F.size(F.array_except("wrapped", "own"))
        + F.when(F.coalesce("unsure", F.lit(False)) & ~scored_lines & ~covered, 1).otherwise(0)
    )
    grouped = per_run.groupBy("_row").agg(F.first("_doc").alias("_doc"), F.first("_n").alias("_n"), F.sum(notices).cast("bigint").alias("_hits"), F.max("b").alias("b"))
    made = F.struct(
        F.col("_n").alias("n_paragraphs"), F.col("_hits").alias("n_licence"), F.col("b.family").alias("licence"), F.round("b.top", 6).alias("probability"), F.round("b.like", 6).alias("likeness"),
        F.coalesce(F.col("b.known"), F.lit(False)).alias("confirmed"),
    )
    return grouped.select("_doc.*", made.alias(name))


def _may_hold(text: Column, model: Model) -> Column:
    """Whether a text holds an anchor or a feature of common words; never false where it holds a feature.
    Latin letters and digits are split off here, which is quicker and finds no fewer words."""
    return let(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: _has(w, model))


def _has(w: Column, model: Model) -> Column:
    found = F.arrays_overlap(w, F.array(*map(F.lit, model.anchors))) if model.anchors else F.lit(False)
    if not model.common:
        return found
    joined = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return found | let(joined, lambda t: F.exists(F.array(*[F.lit(f" {g} ") for g in model.common]), lambda g: F.contains(t, g)))


def _holds(w: Column, model: Model) -> Column:
    """Whether a piece holds a feature: quickly if it can, then exactly."""
    vocabulary = F.array(*map(F.lit, model.features.vocabulary)) if model.features.vocabulary else F.array().cast("array<string>")
    return _has(w, model) & F.arrays_overlap(grams(w), vocabulary)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: paragraphs, licence paragraphs, family, probability, likeness."""
    found = scan(docs.select("doc_id", "text"), fit(docs), carry=["doc_id"])
    return found.select("doc_id", *[F.col(f"_licence.{c}").alias(c) for c in ("n_paragraphs", "n_licence", "licence", "probability", "likeness", "confirmed")])

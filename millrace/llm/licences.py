"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines of a text, and runs of lines that a notice is wrapped into: from every line with a licence word on,
all runs of lines without an empty one (comment marks alone are empty) that are as long as the longest template. Where
they overlap, the one that holds most of a template counts. Lines without any licence word are unknown. Features are the one- and two-word n-grams of
the templates that hold a licence word or a number. A multinomial logistic regression tells the families and an unknown class apart; it learns from
altered copies of the templates, from fragments of them that are too short to count (unknown), and from
paragraphs of the corpus that use licence words without resembling any template (unknown). Its probabilities are
calibrated by a temperature on copies that it has not seen. A predicted family is confirmed if the paragraph holds enough
of one of that family's templates. Everything is made of DataFrame operations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import col, hash_sample
from millrace.llm.main_text import STOPS
from millrace.session import stage

UNKNOWN = "unknown"

# Usual notices of each family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
FAMILIES = [UNKNOWN, *TEMPLATES]

# Ordinary words that say nothing about a licence by themselves, besides the common stop words.
ORDINARY = frozenset(
    "all any author be can charge conditions either except extent file files following form forms found free general governed january june later law "
    "may met must only or other part permitted person possible prior program project provided related subject terms under use version work works you".split()
)

WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
# Copies of each template for training and calibration; every copy lacks other words and has other words around it.
COPIES = 40
HELD_OUT_COPIES = 10
# Paragraphs of the corpus that are shown to the classifier as unknown, at most.
CORPUS_SAMPLE = 2000
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
MIN_PROBABILITY = 0.5
MIN_CONTAINMENT = 0.6


def words(text: Column) -> Column:
    """Words of a paragraph: runs of ASCII letters and digits in lower case; numbers keep their inner dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def grams(word_array: Column) -> Column:
    """Distinct one- and two-word n-grams."""
    n = F.size(word_array)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(word_array, i), F.element_at(word_array, i + 1))))
    return F.array_distinct(F.concat(word_array, F.coalesce(pairs, F.array().cast("array<string>"))))


def _content(gram: str) -> bool:
    """A licence word, or a pair with such a word or a number in it ("version 3")."""
    parts = gram.split()
    numbered = len(parts) > 1 and any(w[0].isdigit() for w in parts)
    return numbered or any(w not in STOPS and w not in ORDINARY and not w[0].isdigit() and len(w) > 1 for w in parts)


@dataclass(frozen=True)
class Model:
    """Vocabulary with a weight for each family, intercepts and temperature; its size is set by the templates."""

    vocabulary: list[str]
    weights: list[list[float]]  # for each n-gram, by family
    other: list[float]  # for each word outside of the vocabulary (logarithm of one plus their number)
    intercepts: list[float]
    temperature: float

    @property
    def terms(self) -> list[str]:
        """Licence words: single words of the vocabulary. A paragraph without any is unknown."""
        return [g for g in self.vocabulary if " " not in g]


def template_table(spark: SparkSession) -> DataFrame:
    """(family, template, words, grams), a row for each template."""
    rows = [(family, i, text) for family, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "family string, template int, text string").withColumn("words", words(F.col("text")))
    return table.select("family", "template", "words", grams(F.col("words")).alias("grams"))


def vocabulary(spark: SparkSession) -> list[str]:
    found = template_table(spark).select(F.explode("grams").alias("gram")).distinct().collect()  # n-grams of the templates
    return sorted(r.gram for r in found if _content(r.gram))


def longest_template() -> int:
    return max(len(re.findall(WORD, text.lower())) for texts in TEMPLATES.values() for text in texts)


def _following(lines: Column, at: Column) -> Column:
    """Words of each line after ``at``, up to the first line without words or until they are as many as the longest template's."""
    longest = longest_template()
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<array<string>>").alias("lines"))

    def add(so_far, line):
        n = F.size(line)
        going = so_far["n"] < longest
        return F.struct(
            F.when(going & (n > 0), so_far["n"] + n).otherwise(F.lit(longest)).alias("n"),
            F.when(going & (n > 0), F.concat(so_far["lines"], F.array(line))).otherwise(so_far["lines"]).alias("lines"),
        )

    return F.aggregate(F.transform(F.slice(lines, at + 2, longest), words), start, add, lambda x: x["lines"])


def candidates(df: DataFrame, vocab: list[str], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_paragraphs, hits): for every row the paragraphs that hold a single word of the vocabulary.

    ``hits`` has (paragraph, words, after): the line, counted from 0, its words, and those of the lines that go on from it.
    """
    terms = F.array(*[F.lit(g) for g in vocab if " " not in g])
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    spelled = F.transform(F.col("_lines"), lambda line, i: F.struct(i.alias("paragraph"), words(line).alias("words")))
    hits = F.filter(spelled, lambda x: F.arrays_overlap(x["words"], terms))
    hits = F.transform(hits, lambda x: F.struct(x["paragraph"].cast("long").alias("paragraph"), x["words"].alias("words"), _following(F.col("_lines"), x["paragraph"]).alias("after")))
    # the whole text is looked at once; only texts with such a word are taken apart
    some = F.arrays_overlap(words(text), terms)
    return df.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("doc_id"), lines.alias("_lines"), some.alias("_some")).select(
        "row",
        "doc_id",
        F.size(F.filter("_lines", lambda line: F.length(F.trim(line)) > 0)).cast("long").alias("n_paragraphs"),
        F.when(F.col("_some"), hits).alias("hits"),
    )


def paragraphs(found: DataFrame) -> DataFrame:
    """(row, paragraph, last, grams, n_words) of all lines with a licence word."""
    hits = found.select("row", F.explode("hits").alias("x")).select("row", "x.paragraph", "x.words")
    return hits.select("row", "paragraph", F.col("paragraph").alias("last"), grams(F.col("words")).alias("grams"), F.size("words").alias("n_words"))


def wrapped(found: DataFrame) -> DataFrame:
    """(row, paragraph, last, grams, n_words) of the runs of two lines and more that hold enough of any template."""
    hits = found.select("row", F.explode("hits").alias("x")).where(F.size("x.after") > 0)
    # made inside of the array, so that no later filter works them out again for every template
    joined = F.transform(F.sequence(F.lit(1), F.size("x.after")), lambda k: F.struct(k.alias("more"), F.concat("x.words", F.flatten(F.slice("x.after", 1, k))).alias("words")))
    runs = F.transform(joined, lambda r: F.struct(r["more"].alias("more"), grams(r["words"]).alias("grams"), F.size(r["words"]).alias("n_words")))
    table = hits.select("row", "x.paragraph", F.explode(runs).alias("r")).select("row", "paragraph", (F.col("paragraph") + F.col("r.more")).alias("last"), "r.grams", "r.n_words")
    return containment(table).where(F.col("similarity") >= MIN_CONTAINMENT).drop("similarity")


def strongest(confirmed: DataFrame) -> DataFrame:
    """Of overlapping confirmed (row, paragraph, last, family, evidence, ...) those that say most of a template."""
    whole = F.struct(*confirmed.columns)

    def least(table: DataFrame, keys: list[str], end: Column) -> DataFrame:
        return table.groupBy("row", "family", "evidence", *keys).agg(F.min_by(whole, end).alias("x")).select("x.*")

    # lines around it that add nothing do not belong to a notice
    short = least(least(confirmed, ["paragraph"], F.col("last")), ["last"], -F.col("paragraph"))
    order = F.struct((-F.col("evidence")).alias("evidence"), (F.col("last") - F.col("paragraph")).alias("lines"), (-F.col("probability")).alias("p"), "paragraph", "family")
    by_line = short.withColumn("order", order).withColumn("line", F.explode(F.sequence("paragraph", "last")))
    won = by_line.groupBy("row", "line").agg(F.min_by(whole, "order").alias("x"))
    lines_won = won.groupBy("row", "x").agg(F.count(F.lit(1)).alias("n")).where("n = x.last - x.paragraph + 1")
    return lines_won.select("x.*")


def containment(table: DataFrame, families: Column | None = None) -> DataFrame:
    """Add ``similarity``: the largest share of a template's n-grams that the paragraph holds, over its own family's
    templates (column ``family``) or over all; with families also ``evidence``, the most n-grams held of a template that
    is held well enough."""
    spark = table.sparkSession
    shapes = template_table(spark).select(F.col("family").alias("_family"), F.col("grams").alias("_grams"))
    by_family = {}
    for r in shapes.collect():  # the templates
        by_family.setdefault(r["_family"], []).append(r["_grams"])

    def best(texts: list[list[str]]) -> Column:
        shares = [F.size(F.array_intersect(F.col("grams"), F.array(*map(F.lit, g)))) / F.lit(float(len(g))) for g in texts]
        return F.greatest(*shares) if len(shares) > 1 else shares[0]

    def most(texts: list[list[str]]) -> Column:
        held = [F.size(F.array_intersect(F.col("grams"), F.array(*map(F.lit, g)))) for g in texts]
        held = [F.when(n >= MIN_CONTAINMENT * len(g), n).otherwise(0) for n, g in zip(held, texts)]
        return F.greatest(*held) if len(held) > 1 else held[0]

    if families is None:
        return table.withColumn("similarity", best([g for texts in by_family.values() for g in texts]))
    chosen, evidence = F.lit(0.0), F.lit(0)
    for family, texts in by_family.items():
        chosen = F.when(families == family, best(texts)).otherwise(chosen)
        evidence = F.when(families == family, most(texts)).otherwise(evidence)
    return table.withColumn("similarity", chosen).withColumn("evidence", evidence)


def training_rows(spark: SparkSession, corpus: DataFrame | None = None) -> DataFrame:
    """(label, held_out, grams, n_words): altered copies of the templates, fragments of them, and corpus paragraphs."""
    table = template_table(spark)
    noise = F.array(*[F.concat(F.lit("w"), F.lit(i)) for i in range(50)])
    copies = table.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES + HELD_OUT_COPIES - 1))))

    def draw(*parts) -> Column:
        return F.pmod(F.xxhash64("family", "template", "copy", *parts), F.lit(100))

    def thinned(share: int, salt: str) -> Column:
        return F.filter(F.transform("words", lambda w, i: F.when(draw(F.lit(salt), i) < share, w)), lambda w: w.isNotNull())

    def padded(inner: Column, salt: str) -> Column:
        around = F.slice(noise, 1 + draw(F.lit(salt + "from")).cast("int") % 30, draw(F.lit(salt + "many")).cast("int") % 12)
        return F.when(draw(F.lit(salt)) < 50, F.concat(around, inner)).otherwise(F.concat(inner, around))

    whole = copies.select(F.col("family").alias("label"), "copy", padded(F.when(F.col("copy") % 10 == 0, F.col("words")).otherwise(thinned(92, "keep")), "pad").alias("words"))
    pieces = copies.where("copy % 2 = 0").select(F.lit(UNKNOWN).alias("label"), "copy", padded(thinned(20, "piece"), "piece pad").alias("words"))
    foreign = copies.where("copy % 2 = 1").select(F.lit(UNKNOWN).alias("label"), "copy", F.slice(noise, 1, draw(F.lit("foreign")).cast("int") % 40).alias("words"))
    made = whole.unionByName(pieces).unionByName(foreign)
    rows = made.select("label", (F.col("copy") >= COPIES).alias("held_out"), grams(F.col("words")).alias("grams"), F.size("words").alias("n_words"))
    if corpus is not None:
        unlike = containment(corpus.select("grams", "n_words")).where("similarity < 0.3").select("grams", "n_words")
        some = hash_sample(unlike, ["grams"], CORPUS_SAMPLE)
        rows = rows.unionByName(some.select(F.lit(UNKNOWN).alias("label"), (F.pmod(F.xxhash64("grams"), F.lit(5)) == 0).alias("held_out"), "grams", "n_words"))
    return rows


def fit(spark: SparkSession, corpus: DataFrame | None = None) -> Model:
    """Train on ``training_rows`` (a few thousand, set by COPIES and CORPUS_SAMPLE) and calibrate on its held-out part."""
    vocab = vocabulary(spark)
    rows = stage(training_rows(spark, corpus), "training")
    number = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("label")) - 1
    # One more feature for words outside of the vocabulary, in steps of powers of two.
    steps = [f"<foreign {i}>" for i in range(12)]
    foreign = _foreign(F.col("grams"), F.col("n_words"), vocab)
    reached = F.slice(F.array(*map(F.lit, steps)), 1, F.least(F.floor(foreign * 2).cast("int"), F.lit(len(steps))))
    shown = rows.withColumn("label_id", number.cast("double")).withColumn("shown", F.concat("grams", reached))
    vectors = CountVectorizerModel.from_vocabulary(vocab + steps, inputCol="shown", outputCol="features")
    vectors.setBinary(True)
    # every family occurs, so the numbers are complete
    regression = LogisticRegression(featuresCol="features", labelCol="label_id", family="multinomial", regParam=2e-3, maxIter=60, standardization=False)
    trained = regression.fit(vectors.transform(shown.where("not held_out")).select("label_id", "features"))
    matrix = trained.coefficientMatrix.toArray()
    # The steps' weights add up to a line in the logarithm, so that texts of any length are scored alike.
    slope = matrix[:, len(vocab) :].mean(axis=1) * 2
    model = Model(vocab, matrix[:, : len(vocab)].T.tolist(), slope.tolist(), trained.interceptVector.toArray().tolist(), 1.0)
    held = classify(rows.where("held_out").withColumn("row", F.monotonically_increasing_id()).withColumn("paragraph", F.lit(0).cast("long")), model, keep=["label"])
    losses = held.agg(*[F.avg(-F.log(F.greatest(F.element_at(_softmax(F.col("margins"), t), (F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("label"))).cast("int")), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: losses[i])
    return Model(model.vocabulary, model.weights, model.other, model.intercepts, TEMPERATURES[best])


def _foreign(gram_array: Column, n_words: Column, vocab: list[str]) -> Column:
    single = F.array(*[F.lit(g) for g in vocab if " " not in g])
    return F.log1p(F.greatest(n_words - F.size(F.array_intersect(gram_array, single)), F.lit(0)).cast("double"))


def _softmax(margins: Column, temperature: float) -> Column:
    top = F.array_max(margins)
    powers = F.transform(margins, lambda m: F.exp((m - top) / F.lit(temperature)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def classify(table: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """Add to (row, paragraph, [last,] grams, n_words) the margins, the most probable family and its probability.

    The n-grams meet the weights in a join; the weights are as many rows as the templates have n-grams, so they are
    broadcast. Sums are made per paragraph.
    """
    spark = table.sparkSession
    k = len(FAMILIES)
    keys = [c for c in ("row", "paragraph", "last") if c in table.columns]
    weights = spark.createDataFrame(list(zip(model.vocabulary, model.weights)), "gram string, w array<double>")
    sums = table.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
    sums = sums.groupBy(*keys).agg(*[F.sum(F.col("w")[i]).alias(f"_s{i}") for i in range(k)])
    foreign = _foreign(F.col("grams"), F.col("n_words"), model.vocabulary)
    margins = F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) + F.lit(model.intercepts[i]) + F.lit(model.other[i]) * foreign for i in range(k)])
    joined = table.join(sums, keys, "left").select(*keys, "grams", *keep, margins.alias("margins"))
    scored = joined.withColumn("_p", _softmax(F.col("margins"), model.temperature)).withColumn("probability", F.array_max("_p"))
    return scored.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(F.col("_p"), F.col("probability")).cast("int"))).drop("_p")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, probability, similarity, licences, n_licence_paragraphs, n_unknown_paragraphs, n_paragraphs) of every row.

    ``licence`` is the confirmed family with the highest probability (the first by name among equals), null if there is
    none; ``licences`` lists all confirmed families. ``n_unknown_paragraphs`` counts paragraphs that use licence words
    but are unknown or not confirmed; ``n_paragraphs`` counts lines, and lines joined to one notice are one licence paragraph. A null or empty text has no paragraphs. Repeated rows are scanned each for
    itself, ids may be null, and further columns are not read.
    """
    spark = df.sparkSession
    found = stage(candidates(df, vocabulary(spark), id_col, text_col), "candidates")
    hits = paragraphs(found)
    model = fit(spark, hits)
    told = stage(classify(hits.unionByName(wrapped(found)), model).select("row", "paragraph", "last", "grams", "family", "probability"), "classified")
    likely = told.where((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY))
    confirmed = stage(containment(likely, F.col("family")), "similar").where(F.col("similarity") >= MIN_CONTAINMENT)
    notices = stage(strongest(confirmed.select("row", "paragraph", "last", "family", "evidence", "probability", "similarity")), "notices")
    # lines with a licence word that no notice covers
    covered = notices.select("row", F.explode(F.sequence("paragraph", "last")).alias("paragraph"))
    unknown = hits.select("row", "paragraph").join(covered, ["row", "paragraph"], "left_anti").select("row", F.lit(None).cast(notices.schema["family"].dataType).alias("family"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("similarity"))
    told = notices.select("row", "family", "probability", "similarity").unionByName(unknown).withColumn("ok", F.col("family").isNotNull())
    best = F.struct((-F.col("probability")).alias("p"), F.col("family").alias("family"), F.col("similarity").alias("similarity"))
    by_row = told.groupBy("row").agg(
        F.min(F.when(F.col("ok"), best)).alias("best"),
        F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("family")))).alias("licences"),
        F.count_if("ok").alias("n_licence_paragraphs"),
        F.count_if(~F.col("ok")).alias("n_unknown_paragraphs"),
    )
    return found.select("row", "doc_id", "n_paragraphs").join(by_row, "row", "left").select(
        "doc_id",
        F.col("best.family").alias("licence"),
        (-F.col("best.p")).alias("probability"),
        F.col("best.similarity").alias("similarity"),
        F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("n_licence_paragraphs", F.lit(0)).alias("n_licence_paragraphs"),
        F.coalesce("n_unknown_paragraphs", F.lit(0)).alias("n_unknown_paragraphs"),
        "n_paragraphs",
    )
